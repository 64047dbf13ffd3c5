import hashlib
import json
import zlib

import numpy as np
import pytest

from lorewright.llm import media


def test_png_round_trip_and_all_filters():
    rng = np.random.default_rng(1)
    payload = rng.integers(0, 256, 192 * 5, dtype=np.uint8).tobytes()
    assert media.decode_png(media.encode_png(payload)).tobytes() == payload
    rows = np.frombuffer(payload, np.uint8).reshape(5, 192).astype(int)
    lines = []
    for y, kind in enumerate((4, 1, 2, 3, 4)):
        up = rows[y - 1] if y else np.zeros(192, int)
        line = [kind]
        for x in range(192):
            a, b, c = (rows[y][x - 1] if x else 0), up[x], (up[x - 1] if x else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((rows[y][x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        lines.append(bytes(int(v) for v in line))
    import struct

    png = media._PNG + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 192, 5, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(b"".join(lines))) + media._chunk(b"IEND", b"")
    assert media.decode_png(png).tobytes() == payload
    with pytest.raises(ValueError):
        media.decode_png(png[:60] + b"?" + png[61:])


def test_stored_and_read_back_over_small_ranges(spark, monkeypatch):
    data = [(1, "Ärger " * 40), (2, None), (3, ""), (None, "x" * 192), (5, "y" * 193), (6, "Ärger " * 40), (6, "Ärger " * 40), (7, "long " * 60_000)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    manifest = media.archive_documents(docs)
    assert media.read_archives(spark, manifest, range_bytes=200).count() == len(data)
    got = {str(r.doc_id): r for r in media.media_features(spark, manifest).collect()}
    for key, text in data:
        r, raw = got[str(key)], (text or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        png = media.encode_png(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest())
    assert got["1"].feature == got["6"].feature != got["5"].feature
    empty = media.archive_documents(docs.limit(0))
    assert media.media_features(spark, empty).count() == 0


def test_members_are_retried_alone(tmp_path, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array(["a", "b", "c"])], ["doc_id", "text"])
    written = next(media.write_archives(iter([batch]), f"file://{tmp_path}")).to_pylist()[0]
    monkeypatch.setattr(media, "PAUSE_S", 0)
    reader = media.ArchiveReader({"path": "unused"})
    part = media.ByteRange(f"{written['path']}#{written['bytes']}", 0, 1 << 30)
    plain, calls = media.Members.at, []

    def flaky(self, offset, size):
        calls.append(offset)
        if offset == 0 and calls.count(0) < 3:
            raise OSError("lost")
        return plain(self, offset, size)

    monkeypatch.setattr(media.Members, "at", flaky)
    rows = [r for b in reader.read(part) for r in b.to_pylist()]
    assert [r["error"] for r in rows] == [None] * 3 and calls.count(0) == 3 and len(calls) == 2 + 3 + 2
    monkeypatch.setattr(media.Members, "at", plain)
    path = written["path"].removeprefix("file://")
    raw = bytearray(open(path, "rb").read())
    raw[60] ^= 255
    open(path, "wb").write(bytes(raw))
    rows = [r for b in reader.read(part) for r in b.to_pylist()]
    assert rows[0]["media"] is None and "check" in rows[0]["error"]
    assert [r["doc_id"] for r in rows] == [1, 2, 3] and all(r["error"] is None for r in rows[1:])


def test_features_match_plain_loops():
    """The feature string, computed again from the text without arrays or storage."""
    for text in ("", "a", "Ärger " * 300, "x" * 5000, "line\n" * 77):
        raw = text.encode()
        raw += b" " * (-len(raw) % 192 or (0 if raw else 192))
        rows = [raw[k : k + 192] for k in range(0, len(raw), 192)]
        got = json.loads(media.features_of(np.frombuffer(raw, np.uint8).reshape(-1, 192)))
        mean = sum(raw) / len(raw)
        assert got["height"] == len(rows) and abs(got["mean"] - mean) < 1e-3 and (got["least"], got["most"]) == (min(raw), max(raw))
        assert abs(got["dev"] - (sum((x - mean) ** 2 for x in raw) / len(raw)) ** 0.5) < 1e-3
        assert got["levels"] == [int(1000 * sum(16 * k <= x < 16 * k + 16 for x in raw) / len(raw)) for k in range(16)]
        cut = lambda n, k: [n // k + (j < n % k) for j in range(k)]
        bits, at = "", 0
        for height in cut(len(rows), min(8, len(rows))):
            part, cells, x = rows[at : at + height], [], 0
            for width in cut(192, 9):
                cells.append(sum(sum(r[x : x + width]) for r in part) / (height * width))
                x += width
            bits += "".join("1" if b > a + 1e-9 else "0" for a, b in zip(cells, cells[1:]))
            at += height
        assert got["dhash"] == f"{int(bits.ljust(64, '0'), 2):016x}"
