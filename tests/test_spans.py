import random
import re

from lorewright.operators.spans import source_spans


def walk(text):
    compact = re.sub(r"\s+", " ", text or "").strip()
    parts = []
    for rest in re.split(r"(?<=[.!?])\s+", compact) if compact else []:
        while len(rest) > 600:
            cut = rest.rfind(" ", 0, 601)
            cut = cut if cut >= 200 else 600
            parts.append(rest[:cut].strip())
            rest = rest[cut:].strip()
        parts += [rest] if rest else []
    out = []
    for p in parts:
        if out and len(out[-1]) < 200 and len(out[-1]) + 1 + len(p) <= 600:
            out[-1] += " " + p
        else:
            out.append(p)
    if len(out) > 1 and len(out[-1]) < 200 and len(out[-2]) + 1 + len(out[-1]) <= 600:
        out[-2:] = [out[-2] + " " + out[-1]]
    return out


def test_spans_equal_a_walk(spark):
    rng = random.Random(3)
    word = lambda: rng.choice(["a", "of", "longer", "x" * 40, "é", "." if rng.random() < 0.1 else "end.", "why?", "\n"])
    texts = ["".join(word() + rng.choice([" "] * 9 + [""]) for _ in range(rng.choice([0, 3, 40, 200, 500]))) for _ in range(60)] + [None, "", " ", "y" * 2000, "z " * 900, "q" * 599 + " r. s"]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    got = {}
    for r in source_spans(df, ["k"]).orderBy("k", "span").collect():
        got.setdefault(r.k, []).append(r.text)
    assert got == {k: walk(t) for k, t in enumerate(texts) if walk(t)}
