"""SimHash near-dedup: fingerprints of word shingles, linked within a Hamming radius by BK-trees.

Every pair of fingerprints within radius r agrees on at least blocks - r of the blocks that the 64 bits are cut
into, so it meets in a shard keyed by those blocks.  With 8 blocks and radius 2 a shard fixes 48 bits and holds
at most 65,536 distinct fingerprints, whatever the input.  The tree of a shard is built and searched by the task
that owns the shard: broadcasting the trees would send data that grows with the input, so the shards are
exchanged instead.  In the tree a child hangs at its integer distance from its parent, and a search follows
only edges within the radius.  A shard emits links to the root of each local group, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from lorewright.llm.common import materialize, row_print, rows_kept, table
from lorewright.operators.components import connected_components

SHINGLE, SEED, RADIUS, BLOCKS = 3, 42, 2, 8
_STEP = 1 << 15
_BATCH = 4 << 20


def words_joined(raw: bytes) -> bytes:
    """A-Z lower-cased, words joined by one space; bytes.split() splits at \\x20 and \\x09 to \\x0D."""
    return b" ".join(raw.lower().split())


def fingerprint(raw: bytes, size: int = SHINGLE) -> int:
    """A bit is 1 if more than half of the shingles' XXH64 have it; no words: 0."""
    norm = words_joined(raw)
    if not norm:
        return 0
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 32)
    if len(gaps) < size:
        starts, ends = [0], [len(norm)]
    else:
        starts = [0, *(gaps[: len(gaps) - size + 1] + 1).tolist()]
        ends = [*gaps[size - 1 :].tolist(), len(norm)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(starts), _STEP):  # bounded memory for texts of any length
        part = [xxh64_intdigest(norm[a:b], SEED) for a, b in zip(starts[at : at + _STEP], ends[at : at + _STEP], strict=True)]
        bits = np.unpackbits(np.array(part, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        prints = np.array([fingerprint(t.as_py() or b"") for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.select([n for n in batch.schema.names if n != "text"]).columns, pa.array(prints)], [*[n for n in batch.schema.names if n != "text"], "fp"])


class BKTree:
    """A BK-tree over distinct 64-bit integers; nodes in insertion order, children keyed by distance."""

    def __init__(self) -> None:
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        self.value.append(x)
        self.children.append({})
        if len(self.value) == 1:
            return
        node = 0
        while True:
            d = (self.value[node] ^ x).bit_count()
            below = self.children[node].get(d)
            if below is None:
                self.children[node][d] = len(self.value) - 1
                return
            node = below

    def within(self, x: int, radius: int) -> list[int]:
        """Positions of the values within radius of x."""
        found, stack = [], [0] if self.value else []
        while stack:
            node = stack.pop()
            d = (self.value[node] ^ x).bit_count()
            if d <= radius:
                found.append(node)
            for key, below in self.children[node].items():
                if d - radius <= key <= d + radius:
                    stack.append(below)
        return found


def local_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(value, root) of the local groups of distinct values; a root is the first value of its group."""
    tree, root = BKTree(), list(range(len(values)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, x in enumerate(values):
        for j in tree.within(x, radius):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
        tree.add(x)
    return [(values[i], values[find(i)]) for i in range(len(values)) if find(i) != i]


def _shard_masks(radius: int, blocks: int) -> list[int]:
    width = 64 // blocks
    one = (1 << width) - 1
    return [sum(one << (width * b) for b in kept) for kept in combinations(range(blocks), blocks - radius)]


def _linker(radius: int):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (shard, key, fp); a shard may run over batches."""
        rest = None
        names = ["a", "b"]

        def emit(shard: np.ndarray, key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (shard[1:] != shard[:-1]), True])
            size = np.diff(edge)
            two = edge[:-1][size == 2]
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius]
            a, b = [fp[near + 1]], [fp[near]]
            for at, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
                if pairs := local_links(fp[at : at + n].tolist(), radius):
                    found = np.array(pairs, np.uint64)
                    a.append(found[:, 0])
                    b.append(found[:, 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.uint64).view(np.int64)) for x in (a, b)], names)

        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column("shard").to_numpy(), batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64)]
            cur = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
            last = np.flatnonzero((cur[1] != cur[1][-1]) | (cur[0] != cur[0][-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            rest = [x[cut:] for x in cur]
            if cut:
                yield from emit(*[x[:cut] for x in cur])
        if rest is not None and len(rest[0]):
            yield from emit(*rest)

    return link


def near_links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within radius; prints has distinct values fp."""
    masks = _shard_masks(radius, blocks)
    as_long = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keyed = prints.select(
        "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in as_long])).alias("shard", "key")
    )
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(n, "shard", "key").sortWithinPartitions("shard", "key", "fp")
    return dealt.mapInArrow(_linker(radius), "a long, b long")


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per row of docs: doc_id, row_print, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id of the rows whose fingerprints can be reached by links of at most
    radius bits.  Null and empty texts have fingerprint zero and are linked like any other.  Null doc_ids
    count only where a component has no other.  Repeated rows and ties share fingerprint and component.  Texts go
    to Python in batches that end with the row that passes 4 MB; very long ones are fingerprinted whole, one at a
    time.  An empty table gives no rows.  Columns other than doc_id and text only enter the row fingerprint.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_print(docs).alias("row_print"), F.col("text").cast("string").alias("text"))
    rows = materialize(slim.mapInArrow(_fingerprints, "doc_id long, row_print long, fp long"), "prints", batch_bytes=_BATCH)
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    first = materialize(first, "first")
    parts = connected_components(near_links(first.select("fp")))
    members = first.join(parts, F.col("fp") == F.col("node"), "left").select(
        F.col("fp").alias("m_fp"), "first_id", F.coalesce("component", "fp").alias("part")
    )
    smallest = members.groupBy(F.col("part").alias("s_part")).agg(F.min("first_id").alias("component_id"))
    named = materialize(members.join(smallest, F.col("part") == F.col("s_part")).select("m_fp", "component_id"), "classes")
    return rows.join(named, F.col("fp") == F.col("m_fp")).select(
        "doc_id", "row_print", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, all columns: that of the smallest doc_id (null last), then the smallest row
    fingerprint; of wholly identical rows one."""
    found = near_dedup(docs)
    kept = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_print")).alias("row"))
    return rows_kept(docs, kept.select("row.doc_id", "row.row_print"))


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup(docs).select("doc_id", "fingerprint", "component_id")
