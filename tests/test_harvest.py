import random
import re

import regex

from lorewright.operators import harvest as H

TOKEN = regex.compile(H.TOKEN)


def plain(text):
    """Every occurrence by a scan of the page: surface, signals, whether it opens a sentence."""
    out, start = [], 0
    caps = lambda x: any(c.isalpha() for c in x) and x == x.upper() and x != x.lower()
    named = lambda t: t[0].isupper()
    for line in re.split(r"\r?\n", text):
        start = text.index(line, start)
        tokens = [(m[0], start + m.start(), start + m.end()) for m in TOKEN.finditer(line)]
        said = line.strip()
        heading = bool(said) and len(said) <= 100 and 0 < len(tokens) <= 10 and (said[-1] not in ".!?" or caps(said)) and sum(named(t[0]) for t in tokens) * 2 >= len(tokens)
        at, k = [i for i, t in enumerate(tokens) if named(t[0])], 0
        runs = []
        for i in at:
            last = runs[-1][-1] if runs else None
            if last is not None and (i == last + 1 or i == last + 2 and tokens[last + 1][0].lower() in H.CONNECTORS):
                runs[-1].append(i)
            else:
                runs.append([i])
        for run in runs:
            for a in range(len(run)):
                for b in range(a, min(len(run), a + 8)):
                    x, y = tokens[run[a]][1], tokens[run[b]][2]
                    before, after = text[max(0, x - 70) : x], text[y : y + 32]
                    signals = ["title-case-span" if len(run) > 1 else "capitalized-token"]
                    signals += ["heading"] * heading + ["all-caps"] * caps(text[x:y])
                    signals += ["naming-cue"] * bool(re.search(rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(H.CUES)})\s+(?:of\s+)?$", before))
                    signals += ["predicate-naming-cue"] * bool(re.match(r"(?i)\s+(?:is|was|became)\s+(?:a|an|the)(?![A-Za-z0-9_])", after))
                    out.append((text[x:y], signals, x == 0 or bool(re.search(r"[.!?]\s+$", text[max(0, x - 12) : x]))))
        start += len(line)
    out += [(re.sub(r"\s+", " ", m[0]), ["wrapped-title-case-span"], False) for m in regex.finditer(H.WRAPPED, text)]
    out += [(m[1], ["article-name-cue"], False) for m in regex.finditer(H.ARTICLE, text)]
    lower = [t for t in TOKEN.findall(text) if t[0].islower() and len(t) >= 6]
    out += [(t, ["repeated-lowercase-term"], False) for t in lower if sum(norm(t) == norm(x) for x in lower) >= 3 and norm(t) not in H.COMMON]
    return out


def norm(x):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", x.lower()).strip()


def brute(pages):
    groups = {}
    for chunk, page, text in pages:
        for surface, signals, opens in plain(text or ""):
            groups.setdefault((chunk, norm(surface)), []).append((page, surface, signals, opens))
    out = {}
    for (chunk, n), found in groups.items():
        clear = lambda f: len(TOKEN.findall(f[1])) > 1 or not f[3] or any(s != "capitalized-token" for s in f[2])
        if n and n not in H.GENERIC and (len(found) > 1 or clear(found[0])):
            out[chunk, n] = (sorted({f[0] for f in found}), len(found), sorted({s for f in found for s in f[2]}))
    return out


def check(spark, pages):
    df = spark.createDataFrame(pages, "chunk long, page long, text string")
    got = {(r.chunk, r.normalized): (r.pages, r.occurrences, r.signals) for r in H.harvest(df, ["chunk"], "page").collect()}
    want = brute(pages)
    assert got == want
    return got


def test_rules(spark):
    text = (
        "THE COPPER SEA\nKing Ari of the Red Hills met Sela. Sela is a scholar named Vex.\nThey saw a Tower, the Moon Spire and the city of\nMill Ford. Alone went Ben\n"
        "a dragon-rider, dragon-rider and dragon-rider. One Two Three Four Five Six Seven Eight Nine"
    )
    got = check(spark, [(1, 1, text), (1, 2, None), (2, 1, ""), (3, 7, "Sela")])
    assert (1, "king ari") in got and (1, "tower the moon spire") in got
    assert "naming-cue" in got[1, "mill ford"][2] and "predicate-naming-cue" in got[1, "sela"][2]
    assert got[1, "dragon rider"] == ([1], 3, ["repeated-lowercase-term"])
    assert (1, "one two three four five six seven eight") in got and got[1, "one two three four five six seven eight nine"][2] == ["wrapped-title-case-span"]


def test_random_pages_equal_a_plain_scan(spark):
    rng = random.Random(5)
    words = ["Ann", "of", "the", "Bo's", "king", "named", "Élan", "lower-case", "ordinary", "A", "von", "is", "was", "a", "X", "known as", "stone", "HALL", "it"]
    gap = lambda: rng.choice([" "] * 6 + ["\n", ". ", ", ", " - ", "! ", "\n\n", "; "])
    pages = [(c, p, "".join(rng.choice(words) + gap() for _ in range(rng.randint(0, 60)))) for c in range(12) for p in range(3)]
    check(spark, pages)
