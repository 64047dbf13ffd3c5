"""Words of many texts at once: 64-bit word hashes and endings by numpy over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _table(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(20, (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[name] = np.cumprod(have, dtype=np.uint64)
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _piece(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = raw + np.where((raw >= 65) & (raw <= 90), np.uint8(32), np.uint8(0))
    edge = np.diff(np.concatenate([[0], (~_is_space(raw)).view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _table("pow", _BASE, len(raw) + 1)[: len(raw)], out=total[1:])
    h = (total[end] - total[start]) * _table("inv", _INVERSE, len(raw) + 1)[start]
    return mixed(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), start, end, low


def _is_space(raw: np.ndarray) -> np.ndarray:
    return (raw == 32) | ((raw >= 9) & (raw <= 13))


def hashed(data: bytes, piece: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, lower-cased bytes) of the words of data; A-Z count as a-z.

    Words are what stands between \\x20 and \\x09-\\x0D.  Equal words have equal hashes; two of a million
    different words share one with a chance of about 3e-8.  Long data is read in pieces that end between words, so
    that the arrays over bytes stay small (a single word longer than a piece is a piece of its own).
    """
    raw = np.frombuffer(data, np.uint8)
    if len(raw) <= piece:
        return _piece(raw)
    parts, at = [], 0
    while at < len(raw):
        end = min(len(raw), at + piece)
        if end < len(raw):
            gaps = np.flatnonzero(_is_space(raw[at:end]))
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < len(raw) and not _is_space(raw[end : end + 1])[0]:
                    end += 1
        h, start, stop, low = _piece(raw[at:end])
        parts.append((h, start + at, stop + at, low))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def in_chunks(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """[from, to) of consecutive texts with about size bytes together; a long text is a chunk of its own."""
    first, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > size:
            yield first, k
            first, held = k, 0
        held += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end, bytes, bounds): the words of all texts; text k has words bounds[k] to bounds[k + 1]."""
    h, start, end, low = hashed(b"\n".join(texts))
    offset = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return h, start, end, low, np.searchsorted(start, offset)
