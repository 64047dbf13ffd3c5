"""Main text of web pages by a maximum-scoring subsequence.

A page is a sequence of words and tags.  A word scores the log odds that it belongs to the main text, given the
elements around it and their names, how long its block is and how much of that are links; a tag scores below zero, the more
so the rarer it is inside main text.  The weights come from labelled pages.  The elements html, head and body, which pages may
leave out, say nothing.  One linear scan finds the contiguous region of the highest sum; blocks
inside it that score below zero, such as adverts within an article, are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Container, Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lorewright.llm.common import table
from lorewright.llm.html_samples import labelled_pages

TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|</\Z""",
    re.S,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
TOKEN = re.compile(r"[a-z]+")
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no main text by what they are.
NEVER = frozenset("head script style noscript template nav aside footer iframe object svg canvas select option button textarea dialog menu title audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag closes open elements of these names first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table select body html article main section div".split())
#: A form wraps the page if it holds one of these, or half of the page's words with a block of FORM_TEXT words among them.
PAGE_PARTS = frozenset("article main header nav footer h1".split())
FORM_TEXT = 20
#: Elements that pages may leave out are no marks.
IMPLIED = frozenset({"html", "head", "body"})
#: Words from which a block is of the next length.
LENGTHS = (5, 15, 40)
CONTAINERS = frozenset({"<article", "<main"})
MAIN_WORD, CLIP, TAG_COST = 0.05, 3.0, 0.3


class Run:
    """A run of text: what it says, the features of the elements around it, its form, its place in a block."""

    __slots__ = ("text", "marks", "never", "block", "form")

    def __init__(self, text: str, marks: frozenset, never: bool, block: int, form: int = -1) -> None:
        self.text, self.marks, self.never, self.block, self.form = text, marks, never, block, form


class Open:
    """The open elements.  What tags need to know of them is kept as they come and go, so a tag costs what it closes."""

    def __init__(self) -> None:
        self.names, self.marks, self.never, self.form = [""], [frozenset()], [False], [-1]
        self.near: list[dict[str, int]] = [{}]  # of the elements that later tags may close: the outermost in scope
        self.places: dict[str, list[int]] = {}
        self.outside: list[int] = []  # places of headers and elements that hold no main text

    def push(self, name: str, marks: frozenset, never: bool, form: int) -> None:
        place = len(self.names)
        near = {} if name in SCOPE else self.near[-1]
        if (name == "p" or name in CLOSES) and name not in near:
            near = {**near, name: place}
        for column, value in zip((self.names, self.marks, self.never, self.form, self.near), (name, marks, never, form, near), strict=True):
            column.append(value)
        self.places.setdefault(name, []).append(place)
        if name in NEVER or name == "header":
            self.outside.append(place)

    def cut(self, place: int) -> None:
        while self.outside and self.outside[-1] >= place:
            self.outside.pop()
        for name in self.names[place:]:
            self.places[name].pop()
        for column in (self.names, self.marks, self.never, self.form, self.near):
            del column[place:]

    def last(self, name: str) -> int | None:
        places = self.places.get(name)
        return places[-1] if places else None


def page_sequence(html: str, known: Container[str] | None = None) -> list[Run | str]:
    """Text runs and tag names ("/p" for an end tag) in page order; marks outside known are left out."""
    out: list[Run | str] = []
    stack, wraps = Open(), []
    block, at = 0, 0

    def text(raw: str) -> None:
        if raw and not raw.isspace():
            out.append(Run(unescape(raw), stack.marks[-1], stack.never[-1], block, stack.form[-1]))
        elif raw:
            out.append(Run(" ", frozenset(), False, block))

    while True:
        m = TAG.search(html, at)
        if m is None:
            text(html[at:])
            _judge_forms(out, wraps)
            return out
        text(html[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ends, attrs = (m[1], m[3]) if m[2] else (m[4], m[6])
        if name in BLOCK:
            block += 1
        out.append(("/" if ends else "") + name)
        if name == "br":
            out.append(Run(" ", frozenset(), False, block))
        if ends:
            place = stack.last(name)
            if place is not None:
                stack.cut(place)
            continue
        if name in VOID:
            continue
        if name in BLOCK and "p" in stack.near[-1]:
            stack.cut(stack.near[-1]["p"])
        if name in CLOSES:
            found = [stack.near[-1][x] for x in CLOSES[name] if x in stack.near[-1]]
            if found:
                stack.cut(min(found))
        if stack.outside and (name == "main" or name == "article" and (stack.places.get("nav") or stack.places.get("header"))):
            stack.cut(stack.outside[0])  # a menu that was never closed ends here
        form = stack.form[-1]
        if form >= 0 and name in PAGE_PARTS:
            wraps[form] = True
        if name == "form" and form < 0:  # a form within a form is part of it
            form = len(wraps)
            wraps.append(False)
        marks, own = stack.marks[-1], set() if name in IMPLIED else {f"<{name}"}
        if attrs and "=" in attrs and (told := {t for x in NAMES.findall(attrs) for t in TOKEN.findall("".join(x).lower())}):
            own |= {f".{t}" for t in told} | {f"@{t}" for t in told}
            marks = frozenset(m for m in marks if m[0] != "@")  # "@": of the innermost element with a name
        if known is not None:
            own = {x for x in own if x in known or x in CONTAINERS or x == "<a"}
        outer = name == "header" and not marks & CONTAINERS
        if name in RAW:
            close = re.compile(rf"</{name}\b", re.I).search(html, at)
            at = close.start() if close else len(html)
        stack.push(name, marks | own if own - marks else marks, stack.never[-1] or name in NEVER or outer, form)


def _judge_forms(sequence: list[Run | str], wraps: list[bool]) -> None:
    """Forms that do not wrap the page hold no main text."""
    if not wraps:
        return
    words, longest, total, blocks = Counter(), Counter(), 0, Counter()
    for x in sequence:
        if isinstance(x, Run) and not x.never:
            n = len(x.text.split())
            total += n
            if x.form >= 0:
                words[x.form] += n
                blocks[x.form, x.block] += n
                longest[x.form] = max(longest[x.form], blocks[x.form, x.block])
    for x in sequence:
        if isinstance(x, Run) and x.form >= 0:
            x.never |= not (wraps[x.form] or longest[x.form] >= FORM_TEXT and 2 * words[x.form] >= total)


def block_marks(sequence: list[Run | str]) -> dict[int, frozenset]:
    """The marks that all words of a block share: its length, and whether most of its words are links."""
    words, linked = Counter(), Counter()
    for x in sequence:
        if isinstance(x, Run):
            n = len(x.text.split())
            words[x.block] += n
            linked[x.block] += n if "<a" in x.marks else 0
    return {b: frozenset({f"#{sum(n >= k for k in LENGTHS)}"} | ({"#links"} if 2 * linked[b] > n else set())) for b, n in words.items()}


class Weights:
    def __init__(self, bias: float, marks: dict[str, float], tags: dict[str, float]) -> None:
        self.bias, self.marks, self.tags = bias, marks, tags
        self._seen: dict[tuple[frozenset, frozenset], float] = {}

    def word(self, marks: frozenset, shared: frozenset) -> float:
        found = self._seen.get((marks, shared))
        if found is None:
            if len(self._seen) > 50_000:
                self._seen.clear()
            total = self.bias + sum(self.marks.get(m, 0.0) for m in marks | shared)
            self._seen[marks, shared] = found = max(-CLIP, min(CLIP, total))
        return found

    def tag(self, name: str) -> float:
        return self.tags.get(name.lstrip("/"), -TAG_COST)


def fit_weights(pages: list[tuple[str, list[str]]], penalty: float = 2.0) -> Weights:
    """Logistic weights of the elements' marks over words; a tag costs more the less it occurs in main text."""
    rows: list[tuple[frozenset, int, bool]] = []
    tags, inside = Counter(), Counter()
    for html, blocks in pages:
        wanted = Counter(blocks)
        grouped: dict[int, list[Run]] = {}
        for x in (sequence := page_sequence(html)):
            if isinstance(x, Run):
                grouped.setdefault(x.block, []).append(x)
        main, shared = set(), block_marks(sequence)
        for block, runs in grouped.items():
            said = " ".join("".join(r.text for r in runs).split())
            if said and not any(r.never for r in runs):
                good = wanted[said] > 0
                wanted[said] -= good
                main |= {block} if good else set()
                rows += [(r.marks | shared[block], len(r.text.split()), good) for r in runs if r.text.split()]
        for k, x in enumerate(sequence):
            if isinstance(x, str):
                near = next((y for y in sequence[k + 1 :] if isinstance(y, Run)), None)
                tags[x.lstrip("/")] += 1
                inside[x.lstrip("/")] += near is not None and near.block in main
    names = sorted({m for marks, _, _ in rows for m in marks})
    place = {m: k + 1 for k, m in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    x[:, 0] = 1
    for k, (marks, _, _) in enumerate(rows):
        for m in marks:
            x[k, place[m]] = 1
    y = np.array([good for *_, good in rows], float)
    weight = np.sqrt([n for _, n, _ in rows])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Weights(float(w[0]), {m: float(w[place[m]]) for m in names}, {t: -(MAIN_WORD + TAG_COST * (1 - inside[t] / n)) for t, n in tags.items()})


@cache
def default_weights() -> Weights:
    return fit_weights(labelled_pages())


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous part with the highest sum above zero; the first, longest of equals."""
    best, span, total, start = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best or total == best and total > 0:
            best, span = total, (start, k + 1)
    return span


def main_text(html: str | None, weights: Weights) -> str:
    sequence = page_sequence(html or "", weights.marks)
    scores, blocks, shared = [], {}, block_marks(sequence)
    for x in sequence:
        if isinstance(x, str):
            scores.append(weights.tag(x))
            continue
        n = 0 if x.never else len(x.text.split())
        score = n * weights.word(x.marks, shared[x.block]) if n else 0.0
        blocks[x.block] = blocks.get(x.block, 0.0) + score
        # what is no main text within an article is left out below, and does not part the article
        scores.append(max(0.0, score) if x.marks & CONTAINERS else score)
    start, end = best_region(scores)
    kept: dict[int, list[str]] = {}
    for x in sequence[start:end]:
        if isinstance(x, Run) and not x.never and blocks[x.block] > 0:
            kept.setdefault(x.block, []).append(x.text)
    said = (" ".join("".join(parts).split()) for parts in kept.values())
    return "\n\n".join(b for b in said if b)


def extract(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars (code points).

    A null or empty page, or one without main text, has an empty text.  Nothing is cut off, however long a page is
    or however deep its elements; repeated rows stay, an empty table gives no rows, and other columns are not read.  Of
    equally good regions the first, longest one is taken.  A form that wraps the page does not hide it.  Pages with and without
    html and body tags, with text in paragraphs, sections, plain boxes or between line breaks give their text.
    """
    fitted = weights or default_weights()
    model = (fitted.bias, fitted.marks, fitted.tags)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Weights(*model)
        for batch in batches:
            texts = [main_text(h.as_py(), own) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(read, "page_id long, url string, text string, n_chars long")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
