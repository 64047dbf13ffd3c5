"""The prefix trie of rebuilt conversations, merged family first.

A family is what shares a base id (conv_id - conv_id % 20).  Turns become digests before anything is exchanged; families
are cogrouped with the first turns of their base, rebuilt, and each family's small trie is built where its rows meet.  A
node's key is a polynomial hash of its sequence in four prime fields (124 bits), so equal sequences of different families
have equal keys; only the families' combined nodes are exchanged to be merged.

A conversation with more than BLOCK turns is dealt in blocks: the key before a block is a sum over the blocks before, so
no task holds a long conversation.  Subtree sums need no walk over depths: nodes that share their smallest member form a
vertical path, the path of that conversation.  Paths hang on paths, sums over that tree come from pointer doubling, and
sums along a path from slices of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewright.llm.common import joined_few, materialize, release, table, text_or_empty, word_count
from lorewright.operators.ranking import HEAVY, rank_in_groups

FAMILY, HEADS = 20, 4
#: Turns of one conversation in a group; depths of one path in a window.
BLOCK, SLICE = 512, 4_096
#: Families whose end lists one row joins.
ENDS = 1_024
#: Fixed values of the hash: a prime and a multiplier for each of the four fields.
PRIME, MULTIPLIERS = (1 << 31) - 1, (1_220_703_125, 630_360_016, 742_938_285, 950_706_376)
#: Rounds after which the tree of paths is taken to be broken and raises.
ROUNDS = 64
KEY = ["depth", "k1", "k2"]
NODES = "base long, depth long, k1 long, k2 long, p1 long, p2 long, n long, conv long, words long, ends string"


def _powers(first: int, n: int) -> np.ndarray:
    """(n, 4): the multipliers to the powers first to first + n - 1."""
    out = np.empty((n, 4), np.int64)
    for lane, m in enumerate(MULTIPLIERS):
        x = pow(m, first, PRIME)
        for i in range(n):
            out[i, lane] = x
            x = x * m % PRIME
    return out


_TABLE = _powers(0, BLOCK + HEADS)


def _powers_at(at: np.ndarray) -> np.ndarray:
    """The multipliers to the powers in at, which are 0 or more."""
    block, inverse = np.unique(at // BLOCK, return_inverse=True)
    start = np.array([[pow(m, int(b) * BLOCK, PRIME) for m in MULTIPLIERS] for b in block], np.int64).reshape(-1, 4)
    return start[inverse] * _TABLE[at % BLOCK] % PRIME


def _lanes(t: pa.Table | pa.RecordBatch) -> np.ndarray:
    """(rows, 4): the two 64-bit digests of every turn as residues."""
    both = np.stack([np.asarray(t.column("d1")), np.asarray(t.column("d2"))], axis=1)
    return np.ascontiguousarray(both).view(np.uint32).reshape(-1, 4).astype(np.int64) % PRIME


def _packed(lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (lanes[:, 0] << 31) | lanes[:, 1], (lanes[:, 2] << 31) | lanes[:, 3]


def family_trie(key: tuple, own: pa.Table, given: pa.Table) -> pa.Table:
    """The nodes of one family in one block of turns.

    own: conv_id, h, pos, d1, d2, words of the members' own turns in the block.  given: the first turns of the base
    (kind 0), and for members of several blocks the sum of the blocks before and whether more follow (kind 1).
    """
    base, block = key[0].as_py(), key[1].as_py()
    own = own.sort_by([("conv_id", "ascending"), ("pos", "ascending")])
    head = given.filter(pc.equal(given.column("kind"), 0)).sort_by("pos")
    conv, h, pos, words = (own.column(c).to_numpy() for c in ("conv_id", "h", "pos", "words"))
    members, first = np.unique(conv, return_index=True)
    shift = np.minimum(h[first], len(head)) - h[first]  # of a member's own positions
    kept = h[first] + shift  # turns of the base in front
    head_lanes = np.vstack([np.zeros((1, 4), np.int64), _lanes(head) * _TABLE[1 : len(head) + 1] % PRIME])
    head_sum = np.cumsum(head_lanes, axis=0) % PRIME
    head_words = np.concatenate([[0], head.column("words").to_numpy()]).astype(np.int64)
    start = head_sum[kept].copy()
    more = np.zeros(len(members), bool)
    marks = given.filter(pc.equal(given.column("kind"), 1))
    for c, follows, *before in zip(*(marks.column(x).to_pylist() for x in ("conv_id", "more", "s0", "s1", "s2", "s3")), strict=True):
        m = int(np.searchsorted(members, c))
        more[m] = follows
        factor = np.array([pow(x, int(shift[m]), PRIME) for x in MULTIPLIERS], np.int64)
        start[m] = (start[m] + np.array(before, np.int64) * factor) % PRIME

    mine = pos > h
    of = np.searchsorted(members, conv[mine])
    depth = pos[mine] + shift[of]
    term = _lanes(own.filter(pa.array(mine))) * _powers_at(depth) % PRIME
    total = np.cumsum(term, axis=0)
    opening = np.searchsorted(of, np.arange(len(members)))
    before = np.vstack([np.zeros((1, 4), np.int64), total])[opening]
    lanes = (total - before[of] + start[of]) % PRIME
    parts = [(of, depth, lanes, (lanes - term) % PRIME, words[mine])]
    if block == 0:
        everyone = np.arange(len(members))
        for d in range(len(head) + 1):
            at = everyone[kept >= d]
            same = lambda row: np.repeat(row[None, :], len(at), axis=0)
            parts.append((at, np.full(len(at), d), same(head_sum[d]), same(head_sum[max(d - 1, 0)]), np.full(len(at), head_words[d])))
    of, depth, lanes, above, words = (np.concatenate(x) for x in zip(*parts, strict=True))
    (k1, k2), (p1, p2) = _packed(lanes), _packed(above)
    deepest = np.zeros(len(members), np.int64) - 1
    np.maximum.at(deepest, of, depth)
    ends = (depth == deepest[of]) & ~more[of]

    order = np.lexsort((of, k2, k1, depth))
    of, depth, k1, k2, p1, p2, words, ends = (x[order] for x in (of, depth, k1, k2, p1, p2, words, ends))
    new = np.ones(len(of), bool)
    new[1:] = (depth[1:] != depth[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    top = np.flatnonzero(new)
    node = np.cumsum(new) - 1
    lists: list[str | None] = [None] * len(top)
    for at in np.flatnonzero(ends):
        text = str(members[of[at]])
        lists[node[at]] = text if lists[node[at]] is None else f"{lists[node[at]]},{text}"
    n = np.diff(np.append(top, len(of)))
    return pa.table(
        {
            "base": np.full(len(top), base, np.int64), "depth": depth[top].astype(np.int64), "k1": k1[top], "k2": k2[top], "p1": p1[top], "p2": p2[top],
            "n": n.astype(np.int64), "conv": members[of[top]].astype(np.int64), "words": words[top].astype(np.int64), "ends": pa.array(lists, pa.string()),
        }
    )


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the terms of a batch by conversation and block, at the conversation's own positions."""
    for batch in batches:
        conv, block, h, pos = (batch.column(c).to_numpy() for c in ("conv_id", "block", "h", "pos"))
        term = np.where((pos > h)[:, None], _lanes(batch) * _powers_at(pos) % PRIME, 0)
        order = np.lexsort((block, conv))
        conv, block, term = conv[order], block[order], term[order]
        top = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])])) if len(conv) else np.zeros(0, int)
        sums = np.add.reduceat(term, top, axis=0) % PRIME if len(top) else term
        yield pa.RecordBatch.from_pydict({"conv_id": conv[top], "block": block[top], **{f"s{i}": sums[:, i] for i in range(4)}})


def turn_digests(conversations: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """conv_id, h, pos (from 1), d1, d2, words: every turn without its text."""
    role, text = text_or_empty("role"), text_or_empty("text")
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(F.lit(1), role, text).alias("d1"),
        F.xxhash64(F.lit(2), role, text).alias("d2"), word_count(text).alias("words"),
    )
    rows = rank_in_groups(rows, "conv_id", [F.asc_nulls_first("turn"), F.col("role"), F.col("d1"), F.col("d2")], "pos", heavy)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    return rows.select("conv_id", h.alias("h"), F.col("pos").cast("long").alias("pos"), "d1", "d2", "words")


def family_nodes(turns: DataFrame) -> DataFrame:
    """The nodes of every family's own trie (NODES); ends lists the members that end at a node."""
    base = F.col("conv_id") - F.col("conv_id") % FAMILY
    own = turns.withColumns({"base": base, "block": F.floor((F.col("pos") - 1) / BLOCK)})
    none = F.lit(None)
    heads = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < HEADS))
    heads = heads.select(F.col("conv_id").alias("base"), "pos", "d1", "d2", "words")
    sums = [none.cast("long").alias(f"s{i}") for i in range(4)]
    as_head = [F.lit(0).alias("kind"), none.cast("long").alias("conv_id"), "pos", "d1", "d2", "words", none.cast("boolean").alias("more"), *sums]
    given = heads.select("base", F.lit(0).cast("long").alias("block"), *as_head)
    long_ones = turns.where(F.col("pos") > BLOCK).select("conv_id").distinct()
    if not long_ones.isEmpty():
        far = own.join(long_ones, "conv_id", "left_semi").select("conv_id", "block", "h", "pos", "d1", "d2")
        blocks = far.mapInArrow(_block_sums, "conv_id long, block long, s0 long, s1 long, s2 long, s3 long").groupBy("conv_id", "block")
        blocks = blocks.agg(*[(F.sum(f"s{i}") % PRIME).alias(f"s{i}") for i in range(4)])
        along = Window.partitionBy("conv_id").orderBy("block")  # a row a block
        before = along.rowsBetween(Window.unboundedPreceding, -1)
        marks = blocks.select(
            base.alias("base"), "block", "conv_id", F.lead("block").over(along).isNotNull().alias("more"),
            *[F.coalesce(F.sum(f"s{i}").over(before) % PRIME, F.lit(0)).alias(f"s{i}") for i in range(4)],
        )
        marks = materialize(marks, "trie-marks")
        zero = [F.lit(0).cast("long").alias(c) for c in ("pos", "d1", "d2", "words")]
        later = marks.where("block > 0").select("base", "block").distinct().join(heads, "base").select("base", "block", *as_head)
        marked = marks.select("base", "block", F.lit(1).alias("kind"), "conv_id", *zero, "more", *[f"s{i}" for i in range(4)])
        given = materialize(given.unionByName(later).unionByName(marked), "trie-given")
    return own.groupBy("base", "block").cogroup(given.groupBy("base", "block")).applyInArrow(family_trie, NODES)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lists of a node, which follow each other in order; one list is held at a time."""
    at, digest = None, hashlib.sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({**{c: pa.array([v], pa.int64()) for c, v in zip(KEY, at, strict=True)}, "ends_sha256": [digest.hexdigest()]})

    for batch in batches:
        for *key, text in zip(*(batch.column(c).to_pylist() for c in [*KEY, "text"]), strict=True):
            if key != at:
                if at is not None:
                    yield row()
                at, digest = key, hashlib.sha256(text.encode())
            else:
                digest.update(b"," + text.encode())
    if at is not None:
        yield row()


def end_digests(nodes: DataFrame, families: int = ENDS) -> DataFrame:
    """depth, k1, k2, ends_sha256 of nodes where members end.

    Families are ranges of ids, so their lists follow each other.  A row joins the lists of at most so many families;
    where a node has more such rows, one task reads them in order and holds one at a time.
    """
    lists = nodes.where("ends IS NOT NULL").select(*KEY, "base", "ends", F.floor(F.col("base") / (FAMILY * families)).alias("bucket"))
    lists = lists.groupBy(*KEY, "bucket").agg(F.sort_array(F.collect_list(F.struct("base", "ends"))).alias("l"))
    lists = materialize(lists.select(*KEY, "bucket", F.concat_ws(",", F.col("l.ends")).alias("text")), "trie-ends")
    several = lists.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    several = materialize(several, "trie-several")
    sha = F.sha2(F.col("text").cast("binary"), 256).alias("ends_sha256")
    if several.isEmpty():
        return lists.select(*KEY, sha)
    alone = lists.join(several, KEY, "left_anti").select(*KEY, sha)
    rest = lists.join(several, KEY, "left_semi").repartition(*KEY).sortWithinPartitions(*KEY, "bucket").select(*KEY, "text")
    return alone.unionByName(rest.mapInArrow(_hashed, "depth long, k1 long, k2 long, ends_sha256 string"))


def _path_totals(paths: DataFrame) -> DataFrame:
    """conv, saved, leaves: sums over a path and all that hangs on it; paths is conv, up (null: none), saved, leaves.

    After k rounds a path has the sums of what hangs less than 2^k steps below, and up points 2^k steps above.
    """
    state = paths
    for _ in range(ROUNDS):
        if state.where("up IS NOT NULL").isEmpty():
            return state.select("conv", "saved", "leaves")
        got = state.where("up IS NOT NULL").groupBy(F.col("up").alias("conv")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        moving = state.where("up IS NOT NULL").select("conv", "up")
        above = state.where("up IS NOT NULL").select(F.col("conv").alias("up"), F.col("up").alias("next"))
        moved = joined_few(moving, above, ["up"]).select("conv", "next")
        new = materialize(
            state.join(got, "conv", "left").join(moved, "conv", "left").select(
                "conv", F.col("next").alias("up"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"),
                (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"),
            ),
            "trie-totals",
        )
        if state is not paths:
            release(state)
        state = new
    raise RuntimeError(f"paths did not settle in {ROUNDS} rounds")


def _below(value: str, before: Column) -> Column:
    """Sum of value from a node down its path: within its slice, and of the slices below."""
    down = Window.partitionBy("conv", "slice").orderBy(F.desc("depth"))
    return F.sum(value).over(down.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(before, F.lit(0))


def prefix_trie(conversations: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """A row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts count as empty, null turns come first; rows that share a turn are ordered by role and digest, so
    repeated rows are turns like others.  Rows without conv_id belong to no conversation and are left out.  A conversation
    without turns of its own after its first h whose base is absent ends at the root.  Very long texts travel as two
    64-bit digests, by which sequences are equal.  An empty table gives no rows, since then nothing has the root.
    Other columns are not read, whatever their names.
    """
    turns = materialize(turn_digests(conversations, heavy), "trie-turns")
    families = materialize(family_nodes(turns), "trie-families")
    merged = families.groupBy(*KEY).agg(
        F.sum("n").alias("n"), F.min("conv").alias("conv"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2")
    )  # equal keys have equal words and parents
    nodes = materialize(
        merged.select(*KEY, "p1", "p2", "n", "conv", ((F.col("n") - 1) * F.col("words")).alias("saved"), F.floor(F.col("depth") / SLICE).alias("slice")),
        "trie-nodes",
    )
    slices = nodes.groupBy("conv", "slice").agg(F.min("depth").alias("low"), F.max("depth").alias("high"))
    whole = slices.groupBy("conv").agg(F.min("low").alias("low"), F.max("high").alias("high"))  # depths of a path are consecutive
    paths = materialize(whole, "trie-paths")

    tops = nodes.join(paths.select("conv", F.col("low").alias("depth")), ["conv", "depth"]).where("depth > 0")
    tops = tops.select("conv", (F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"))
    hung = joined_few(tops, nodes.select(*KEY, F.col("conv").alias("up")), KEY)
    hung = materialize(hung.select("conv", "up", F.col("depth").alias("at")), "trie-hung")
    children = hung.groupBy(F.col("up").alias("conv"), F.col("at").alias("depth")).agg(F.count(F.lit(1)).alias("hung"))
    bottoms = children.join(paths.select("conv", F.col("high").alias("depth")), ["conv", "depth"], "left_semi").select("conv", F.lit(0).alias("leaf"))
    saved = nodes.groupBy("conv").agg(F.sum("saved").alias("saved"))
    own = saved.join(bottoms, "conv", "left").join(hung.select("conv", "up"), "conv", "left").select(
        "conv", "up", "saved", F.coalesce("leaf", F.lit(1)).cast("long").alias("leaves")
    )
    totals = _path_totals(materialize(own, "trie-own"))
    at = hung.join(totals, "conv").groupBy(F.col("up").alias("conv"), F.col("at").alias("depth")).agg(
        F.count(F.lit(1)).alias("hung"), F.sum("saved").alias("hung_saved"), F.sum("leaves").alias("hung_leaves")
    )

    zero = F.lit(0).cast("long")
    full = nodes.join(at, ["conv", "depth"], "left").join(end_digests(families), KEY, "left")
    full = full.join(paths.select("conv", "low", "high"), "conv").join(hung.select("conv", "up"), "conv", "left")
    full = full.withColumns(
        {
            "chained": (F.col("depth") < F.col("high")).cast("long"), "hung": F.coalesce("hung", zero),
            "saved": F.col("saved") + F.coalesce("hung_saved", zero), "hung_leaves": F.coalesce("hung_leaves", zero),
        }
    )
    leaf = ((F.col("chained") == 0) & (F.col("hung") == 0)).cast("long")
    full = full.withColumn("leaves", F.col("hung_leaves") + leaf)
    keep = ["conv", "depth", "slice", "n", "low", "up", "chained", "hung", "saved", "leaves", "ends_sha256"]
    full = materialize(full.select(*keep), "trie-full")
    parts = full.groupBy("conv", "slice").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    lower = Window.partitionBy("conv").orderBy(F.desc("slice")).rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    parts = parts.select("conv", "slice", F.sum("saved").over(lower).alias("saved_below"), F.sum("leaves").over(lower).alias("leaves_below"))
    return full.join(parts, ["conv", "slice"]).select(
        F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("low"), F.col("up")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), (F.col("chained") + F.col("hung")).alias("n_children"), _below("leaves", F.col("leaves_below")).alias("n_leaves"),
        _below("saved", F.col("saved_below")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP11_SQL = r"""
WITH RECURSIVE bits(i) AS (SELECT 0 UNION ALL SELECT i + 1 FROM bits WHERE i < 7),
tr AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT c, c - c % 20 AS b, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''),
  lambda ch: ascii(ch)::BIGINT)), lambda acc, ch: list_reduce(list_prepend(xor(acc, ch), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
  lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 4 AS h FROM tr),
hd AS (SELECT i.c, i.b, i.h, count(b.pos) AS k FROM ids i LEFT JOIN tr b ON b.c = i.b AND b.pos <= i.h GROUP BY i.c, i.b, i.h),
rb AS (SELECT hd.c, b.pos AS d, b.r, b.x FROM hd JOIN tr b ON b.c = hd.b AND b.pos <= hd.h
  UNION ALL SELECT hd.c, o.pos - hd.h + hd.k, o.r, o.x FROM hd JOIN tr o ON o.c = hd.c AND o.pos > hd.h),
mb AS (SELECT c, d, string_agg(sha256(r || chr(1) || sha256(x)), '') OVER (PARTITION BY c ORDER BY d) AS k,
  len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM rb UNION ALL SELECT c, 0, '', 0 FROM ids),
nd AS (SELECT d, k, min(c) AS conv, count(*) AS n, any_value(w) AS w FROM mb GROUP BY d, k),
ch AS (SELECT d - 1 AS d, left(k, length(k) - 64) AS k, count(*) AS n FROM nd WHERE d > 0 GROUP BY ALL),
fu AS (SELECT nd.*, coalesce(ch.n, 0) AS children FROM nd LEFT JOIN ch USING (d, k)),
su AS (SELECT m.d, m.k, sum(CASE WHEN f.children = 0 THEN 1 ELSE 0 END) AS leaves, sum((f.n - 1) * f.w) AS saved
  FROM mb m JOIN fu f ON f.conv = m.c AND f.d >= m.d GROUP BY m.d, m.k),
la AS (SELECT c, max(d) AS d FROM mb GROUP BY c),
en AS (SELECT m.d, m.k, string_agg(m.c::VARCHAR, ',' ORDER BY m.c) AS t FROM mb m JOIN la USING (c, d) GROUP BY m.d, m.k)
SELECT f.conv AS conv_id, f.d AS depth, p.conv AS parent_conv_id, f.n AS n_convs, f.children AS n_children, su.leaves::BIGINT AS n_leaves,
  su.saved::BIGINT AS saved_tokens, sha256(coalesce(en.t, '')) AS ends_sha256
FROM fu f JOIN su USING (d, k) LEFT JOIN en USING (d, k) LEFT JOIN nd p ON p.d = f.d - 1 AND p.k = left(f.k, greatest(length(f.k) - 64, 0))
"""
