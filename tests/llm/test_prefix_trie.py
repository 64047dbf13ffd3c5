import hashlib
import random
import re
import zlib
from collections import defaultdict

from lorewright.llm import common, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(t)] for c, t in own.items()}
    members, ends, tree = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        seq = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
            if d:
                tree[seq[: d - 1]].add(seq[:d])
        ends[seq].append(c)
    leaves, saved = {}, {}
    for s in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) if s else 0
        leaves[s] = sum(leaves[t] for t in tree[s]) or 1
        saved[s] = (len(members[s]) - 1) * words + sum(saved[t] for t in tree[s])
    sha = lambda s: hashlib.sha256(",".join(map(str, ends[s])).encode()).hexdigest()
    return sorted(
        str((members[s][0], len(s), members[s[:-1]][0] if s else None, len(members[s]), len(tree[s]), leaves[s], saved[s], sha(s))) for s in members
    )


def got(df):
    return sorted(str(tuple(r[c] for c in COLUMNS)) for r in df.collect())


def test_random_families_equal_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for c in [*range(0, 70), *rng.sample(range(100, 4000), 40)]:
        if rng.random() < 0.9:
            for t in range(rng.randrange(1, 7)):
                rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a b", "a", "", "c d e"]) if t < 4 else f"x {rng.random()}"))
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_nulls_repeated_rows_extra_columns_and_empty_tables(spark):
    rows = [(40, None, None, None), (40, 0, "user", "a\tb"), (40, 0, "user", "a\tb"), (41, 1, "", ""), (None, 1, "user", "x"), (43, 5, "user", None), (45, 1, None, "w " * 200_000)]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], SCHEMA + ", depth int, n string")
    assert got(prefix_trie.prefix_trie(docs)) == brute(rows)
    assert prefix_trie.prefix_trie(docs.where("false")).count() == 0


def test_long_conversations_are_dealt_in_blocks(spark):
    """Two copies of 1,300 turns, one that leaves them after 900, one of exactly a block, and a base of many turns."""
    base = [(c, t, "user", f"turn {t}") for c, n in ((60, 1300), (61, 1300), (62, 512), (80, 513)) for t in range(n)]
    rows = base + [(63, t, "user", f"turn {t}" if t < 900 else "off") for t in range(1100)]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), heavy=100)) == brute(rows)


def test_hot_conversations_ends_and_paths(spark, monkeypatch):
    """Every third conversation is the same one; heavy keys are met apart, end lists are joined in several rows."""
    monkeypatch.setattr(common, "HEAVY_KEYS", 3)
    monkeypatch.setattr(prefix_trie, "joined_few", lambda rows, found, keys, how="inner": common.joined_few(rows, found, keys, how, 5))
    lists = prefix_trie.end_digests
    monkeypatch.setattr(prefix_trie, "end_digests", lambda nodes: lists(nodes, 2))
    rows = []
    for c in range(300):
        kind = c % 3
        for t in range(5):
            rows.append((c, t, "user", f"same {t}" if kind == 0 or kind == 1 and t < c % 5 else f"{c} {t} words"))
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_paths_that_hang_on_paths(spark):
    """A comb: each conversation leaves the one before it a turn later, so the tree of paths is deep."""
    rows = [(c * 20 + 19, t, "user", f"{min(c, max(t - 3, 0))}") for c in range(12) for t in range(18)]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_query_equals_its_sql(spark):
    from tests.compare import connect, same

    sf = "/root/testdata/sf0.01"
    n, why = same(prefix_trie.op11_prefix_trie(spark, sf), connect(sf), prefix_trie.OP11_SQL)
    assert n > 300 and not why
