"""Sharding by histogram sort: splitters from exact byte counts, then one exchange.

Rows are ordered by a 64-bit key: a hash of the text in the leading 32 bits, a hash of the row in the others.
Equal texts are therefore neighbours.  Each round counts, in every partition, the exact bytes and rows below a
set of candidate boundaries; the counts are added up, and the probes close in on the splitters until each is
within tolerance or has too few rows around it to matter, when those rows' keys finish it exactly.  A boundary
between two texts is preferred when it is within tolerance, so copies share a shard unless a group of them
outweighs the tolerance; a heavier group is cut by the row hash.  Only then are the rows dealt, once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.llm.common import materialize, row_print, table, text_or_empty

SHARDS, OVERHEAD, TOLERANCE, PROBES = 40, 16, 0.005, 24
#: Rows around unsettled splitters that the driver may look at one by one.
EXACT_ROWS = 100_000
#: Rows that one task ranks at most, about.
SLICE_ROWS = 500_000
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


def sized_rows(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes + 16), text_crc32 and the sort key of every row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_print(docs).alias("row_print"), text_or_empty().alias("t"))
    high = F.shiftleft(F.shiftright(F.xxhash64("t"), 32), 32)
    low = F.shiftrightunsigned(F.xxhash64("row_print", F.lit(1)), 32)
    return base.select(
        "doc_id", (F.octet_length("t") + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(F.col("t").cast("binary")).alias("text_crc32"), high.bitwiseOR(low).alias("key"),
    )


def bytes_below(rows: DataFrame, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows with a key below each probe (ascending); a task returns a row per probe interval."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for batch in batches:
            at = np.searchsorted(probes, batch.column("key").to_numpy(), side="right")
            size = batch.column("size").to_numpy()
            np.add.at(total, at, size)
            n += np.bincount(at, minlength=len(n))
        got = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(got), pa.array(total[got]), pa.array(n[got])], ["slot", "bytes", "rows"])

    sums = rows.select("key", "size").mapInArrow(count, "slot long, bytes long, rows long").groupBy("slot")
    total, n = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for r in sums.agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows")).collect():  # a row per probe at most
        total[r.slot], n[r.slot] = r.bytes, r.rows
    return np.cumsum(total)[:-1], np.cumsum(n)[:-1]


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, exact_rows: int = EXACT_ROWS) -> np.ndarray:
    """shards - 1 ascending keys; shard i has the keys from splitter i - 1 up to, and without, splitter i."""
    whole = rows.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    if not whole.rows:
        return np.full(shards - 1, _HIGH, np.int64)
    goal = np.array([whole.bytes * i / shards for i in range(1, shards)])
    slack = tolerance * whole.bytes / shards
    low, high = [_LOW] * len(goal), [_HIGH] * len(goal)  # bytes below low < goal <= bytes below high
    n_low, n_high = [0] * len(goal), [whole.rows] * len(goal)
    b_low, b_high = [0] * len(goal), [whole.bytes] * len(goal)
    found: list[int | None] = [None] * len(goal)
    for _ in range(64):
        left = [i for i in range(len(goal)) if found[i] is None]
        for i in left:
            if high[i] - low[i] <= 1:  # rows with one key cannot be cut: the nearer side
                found[i] = low[i] if goal[i] - b_low[i] < b_high[i] - goal[i] else high[i]
        left = [i for i in left if found[i] is None]
        spans = {(low[i], high[i]): n_high[i] - n_low[i] for i in left}
        if not left or sum(spans.values()) <= exact_rows:
            break
        probes = set()
        for i in left:
            step = max(1, (high[i] - low[i]) // (PROBES + 1))
            raw = [low[i] + step * k for k in range(1, PROBES + 1)]
            edges = [((p >> 32) << 32) for p in raw]  # between two texts
            probes |= {p for p in edges + raw if low[i] < p < high[i]}
        at = np.array(sorted(probes), np.int64)
        below, n_below = bytes_below(rows, at)
        for i in left:
            inside = [j for j in range(np.searchsorted(at, low[i], "right"), np.searchsorted(at, high[i], "left"))]
            close = [j for j in inside if abs(below[j] - goal[i]) <= slack]
            if close:
                found[i] = int(at[min(close, key=lambda j: (int(at[j]) & 0xFFFFFFFF != 0, abs(below[j] - goal[i]), j))])
                continue
            for j in inside:
                if below[j] < goal[i] and at[j] > low[i]:
                    low[i], b_low[i], n_low[i] = int(at[j]), int(below[j]), int(n_below[j])
                if below[j] >= goal[i] and at[j] < high[i]:
                    high[i], b_high[i], n_high[i] = int(at[j]), int(below[j]), int(n_below[j])
    if left := [i for i in range(len(goal)) if found[i] is None]:
        cond = F.lit(False)
        for lo, hi in sorted({(low[i], high[i]) for i in left}):
            cond |= (F.col("key") >= F.lit(lo)) & (F.col("key") < F.lit(hi))
        got = sorted((r.key, r.bytes) for r in rows.where(cond).groupBy("key").agg(F.sum("size").alias("bytes")).collect())  # exact_rows at most
        for i in left:
            at, cut = b_low[i], []
            for key, size in got:
                if low[i] <= key < high[i]:
                    cut.append((at, key))  # bytes below key
                    at += size
            cut.append((at, high[i]))
            near = [c for c in cut if abs(c[0] - goal[i]) <= slack]
            texts = {key for (_, before), (_, key) in zip([(0, None), *cut], cut, strict=False) if before is None or key >> 32 != before >> 32}
            found[i] = min(near or cut, key=lambda c: (c[1] not in texts if near else False, abs(c[0] - goal[i]), c[1]))[1]
    return np.maximum.accumulate(np.array(found, np.int64))


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Every row of docs in one of the shards: doc_id, size, text_crc32, shard, slot.

    Shards have near equal bytes: a splitter is off by tolerance of a shard, or by less than the row around it.
    Slots are gapless from 0 in each shard, in key order; wholly identical rows share a key and stay together.
    A null text has size 16.  Null doc_ids are rows like others.  Very long texts are sized whole, and one larger than a
    shard fills a shard of its own.  An empty table gives no rows.  Other columns are not read, whatever their names.
    """
    rows = materialize(sized_rows(docs), "sized")
    cuts = splitters(rows, shards, tolerance)
    # finer boundaries inside the shards, so that no task ranks a whole shard
    n = rows.count()
    fine = max(8, -(-n // (shards * SLICE_ROWS)))
    edges = [_LOW, *cuts.tolist(), _HIGH]
    inner = {a + (b - a) * k // fine for a, b in zip(edges[:-1], edges[1:], strict=True) for k in range(1, fine)}
    bounds = np.array(sorted(inner | set(cuts.tolist())), np.int64)
    most = max(64, min(SLICE_ROWS, 2 * n // (shards * fine)))
    while True:  # a slice with a heavy text is cut further, down to single keys
        _, below = bytes_below(rows, bounds)
        start = np.r_[0, below]  # rows before each slice
        held = np.diff(np.r_[start, n])
        ends = [_LOW, *bounds.tolist(), _HIGH]
        heavy = [(ends[k], ends[k + 1]) for k in np.flatnonzero(held > most).tolist() if ends[k + 1] - ends[k] > 1]
        if not heavy:
            break
        bounds = np.array(sorted(set(bounds.tolist()) | {a + (b - a) * k // 16 for a, b in heavy for k in range(1, 16)} - {_LOW}), np.int64)
    shard_of = np.searchsorted(cuts, np.r_[np.int64(_LOW), bounds], side="right")
    first = {int(s): int(start[shard_of == s].min()) for s in np.unique(shard_of)}
    offset = np.array([int(start[k]) - first[int(shard_of[k])] for k in range(len(start))], np.int64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(bounds, batch.column("key").to_numpy(), side="right")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(at), pa.array(shard_of[at].astype(np.int32)), pa.array(offset[at])], [*batch.schema.names, "slice", "shard", "offset"]
            )

    placed = rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, key long, slice long, shard int, offset long")
    rank = F.row_number().over(Window.partitionBy("slice").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + rank - 1).cast("long").alias("slot"))


def op2_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shard_by_bytes(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
