"""Media columns: archives of media members, and a Spark data source that reads them by byte ranges.

An archive file is the members' bytes one after another, then an index entry for each (offset, length, CRC-32,
key, unpadded size), then a footer with the index's place.  A directory of archives has a written manifest, which
names the files of tasks that ended well; files of lost tasks are never read.  The data source plans one
partition for each byte range of each file; a member belongs to the range that its offset falls in.  A partition
reads the index, streams its members in bounded Arrow batches, checks each, and reads a member that fails again
by its own offset, without the others; one that keeps failing yields a row with the error and no payload.
"""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lorewright.llm.common import scratch_path, table, text_or_empty

UNIT, LEVEL = 192, 3
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES = 64 << 20, 8 << 20, 4 << 20
MOST_RANGES = 200_000
RETRIES, PAUSE_S = 4, 0.05
MAGIC = b"LWAR0001"
_ENTRY, _FOOTER = struct.Struct("<QQIBqQ"), struct.Struct("<QQ8s")
_PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str) -> bytes:
    """UTF-8, filled with spaces to a positive multiple of UNIT."""
    raw = text.encode()
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = UNIT) -> bytes:
    """8-bit grey samples, width to a row, as a PNG."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, LEVEL)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG that is not interlaced, as rows; any filter."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG")
    at, parts, width, height = 8, [], 0, 0
    while at < len(media):
        (size,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + size]
        if zlib.crc32(kind + data) != struct.unpack(">I", media[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("PNG chunk is damaged")
        if kind == b"IHDR":
            width, height, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", data)
            if (depth, colour, laced) != (8, 0, 0):
                raise ValueError("only 8-bit grey PNGs without interlacing")
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(height, width + 1)
    kinds = lines[:, 0]
    if not kinds.any():
        return lines[:, 1:]
    out = np.zeros((height + 1, width + 1), np.uint8)  # a row above and a column to the left of zeros
    for y in range(1, height + 1):
        line, kind, up = lines[y - 1, 1:], kinds[y - 1], out[y - 1]
        if kind == 0:
            out[y, 1:] = line
        elif kind == 1:
            out[y, 1:] = np.cumsum(line, dtype=np.uint8)
        elif kind == 2:
            out[y, 1:] = line + up[1:]
        else:
            for x in range(1, width + 1):
                a, b, c = int(out[y, x - 1]), int(up[x]), int(up[x - 1])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    guess = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                out[y, x] = (int(line[x - 1]) + guess) & 255
    return out[1:, 1:]


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def write_archives(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Writes rows (doc_id, text) as members; yields (path, bytes, members) of each closed archive."""
    system, base = _open(folder)
    system.create_dir(base)
    out, name, entries, at = None, "", [], 0

    def close() -> pa.RecordBatch:
        index = b"".join(_ENTRY.pack(*e) for e in entries)
        out.write(index + _FOOTER.pack(at, len(entries), MAGIC))
        out.close()
        return pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([at + len(index) + _FOOTER.size]), pa.array([len(entries)])], ["path", "bytes", "members"])

    for batch in batches:
        for key, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            if out is None:
                name, entries, at = f"{uuid.uuid4().hex}.lwar", [], 0
                out = system.open_output_stream(f"{base}/{name}")
            text = text.as_py() or ""
            media = encode_png(payload_of(text))
            out.write(media)
            entries.append((at, len(media), zlib.crc32(media), key.is_valid, key.as_py() or 0, len(text.encode())))
            at += len(media)
            if at >= ARCHIVE_BYTES:
                yield close()
                out = None
    if out is not None:
        yield close()


def archive_documents(docs: DataFrame) -> str:
    """Stores the texts of docs (doc_id, text) as an archive directory with a manifest; returns the manifest's folder."""
    folder = scratch_path(docs.sparkSession, "archive")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    written = slim.mapInArrow(lambda it: write_archives(it, folder), "path string, bytes long, members long")
    manifest = f"{folder}-manifest"
    written.write.parquet(manifest)
    return manifest


class ByteRange(InputPartition):
    def __init__(self, path: str, start: int, end: int) -> None:
        self.path, self.start, self.end = path, start, end


class Members:
    """The members of one archive; a failed read is repeated for the member alone, over a new handle."""

    def __init__(self, path: str) -> None:
        self.system, self.name = _open(path)
        self.file = None

    def at(self, offset: int, size: int) -> bytes:
        if self.file is None:
            self.file = self.system.open_input_file(self.name)
        return self.file.read_at(size, offset)

    def again(self, offset: int, size: int, good) -> tuple[bytes | None, str | None]:
        """(bytes, None), or (None, why) after RETRIES attempts; good tells whether bytes are right."""
        why = None
        for k in range(RETRIES):
            try:
                data = self.at(offset, size)
                if good(data):
                    return data, None
                why = f"{len(data)} of {size} bytes at {offset} fail their check"
            except OSError as e:
                why = str(e)
            self.file = None
            time.sleep(PAUSE_S * 2**k)
        return None, why

    def index(self, total: int) -> list[tuple]:
        foot, why = self.again(total - _FOOTER.size, _FOOTER.size, lambda d: d[-8:] == MAGIC)
        if foot is None:
            raise OSError(f"{self.name}: {why}")
        at, count, _ = _FOOTER.unpack(foot)
        data, why = self.again(at, count * _ENTRY.size, lambda d: len(d) == count * _ENTRY.size)
        if data is None:
            raise OSError(f"{self.name}: {why}")
        return list(_ENTRY.iter_unpack(data))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.manifest, self.range_bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[ByteRange]:
        """Byte ranges over the manifest's files; the members are looked up by the tasks."""
        system, name = _open(self.manifest)
        found = pads.dataset(name, filesystem=system, format="parquet").to_table(columns=["path", "bytes"]).to_pylist()
        # ranges widen with the archives, so that the driver plans MOST_RANGES and one a file at most; batches stay small
        step = max(self.range_bytes, -(-sum(x["bytes"] for x in found) // MOST_RANGES))
        return [ByteRange(f"{x['path']}#{x['bytes']}", at, at + step) for x in sorted(found, key=lambda x: x["path"]) for at in range(0, x["bytes"], step)]

    def read(self, part: ByteRange | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # what Spark asks for when there are no partitions
            return
        path, total = part.path.rsplit("#", 1)
        members, rows, held = Members(path), [], 0
        for offset, size, crc, known, key, n_bytes in members.index(int(total)):
            if part.start <= offset < part.end:
                media, why = members.again(offset, size, lambda d, crc=crc: zlib.crc32(d) == crc)
                rows.append((key if known else None, n_bytes, media, why))
                held += size
                if held >= BATCH_BYTES:
                    yield self._batch(rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "media", "error"])


class ArchiveSource(DataSource):
    """spark.read.format("media_archive").option("rangeBytes", n).load(manifest folder)."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, n_bytes long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, manifest: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").option("rangeBytes", str(range_bytes)).load(manifest)


def features_of(samples: np.ndarray) -> str:
    """Height, mean, deviation, range, a histogram of 16 grey levels in thousandths and a 64-bit difference hash."""
    flat = samples.reshape(-1)
    count = np.bincount(flat, minlength=256)
    levels = np.arange(256)
    n = int(count.sum())
    mean = float((count * levels).sum()) / n
    dev = float((count * (levels - mean) ** 2).sum() / n) ** 0.5
    grid = np.array([[float(c.mean()) for c in np.array_split(r.mean(axis=0), 9)] for r in np.array_split(samples, min(8, len(samples)))])
    bits = "".join("1" if a else "0" for a in (np.diff(grid, axis=1) > 0).reshape(-1)).ljust(64, "0")
    used = np.flatnonzero(count)
    return json.dumps(
        {
            "height": int(samples.shape[0]), "mean": round(mean, 4), "dev": round(dev, 4), "least": int(used[0]), "most": int(used[-1]),
            "levels": [int(1000 * x / n) for x in count.reshape(16, 16).sum(axis=1).tolist()], "dhash": f"{int(bits, 2):016x}",
        }
    )


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, n_bytes, media, error in zip(*batch.columns, strict=True):
            if error.is_valid:
                raise OSError(f"member {key.as_py()}: {error.as_py()}")
            data = media.as_py()
            samples = decode_png(data)
            payload = samples.tobytes()
            rows.append((key.as_py(), n_bytes.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features_of(samples)))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def media_features(spark: SparkSession, manifest: str) -> DataFrame:
    """A row per member: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    Values depend on the stored bytes only.  A member that cannot be read fails the query; read_archives() alone
    returns it with its error.  Null and empty texts are UNIT spaces.  No members give no rows.  Repeated rows are members
    each, with equal values; a very long text is one member, read whole.  Only doc_id and text are archived.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return read_archives(spark, manifest).mapInArrow(_measured, schema)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(spark, archive_documents(table(spark, sf_dir, "documents").select("doc_id", "text")))
