import random
import re
import time
from collections import Counter
from html import unescape

import pandas as pd
import pytest

from lorewright.llm import html_text as H
from lorewright.llm.html_samples import labelled_pages

W = H.default_weights()


def test_article_of_every_page():
    pages = pd.read_parquet("/root/testdata/sf0.1/pages.parquet")
    wrong = 0
    for html in pages.html:
        article = re.search(r"<article>(.*)</article>", html, re.S)[1]
        blocks = (" ".join(unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        wrong += H.main_text(html, W) != "\n\n".join(b for b in blocks if b)
    assert wrong == 0


def test_held_out_labelled_pages():
    pages = labelled_pages(200, seed=99)
    same = sum(H.main_text(h, W) == "\n\n".join(b) for h, b in pages)
    assert same >= 0.9 * len(pages), same


def test_parts_that_are_not_the_article():
    html = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body><div id="cookie-notice"><p>We use cookies here for you and more words</p></div>
    <header><h2>Site name</h2></header><nav><ul><li><a href=x>Home</a></ul></nav>
    <article><h1>Title &amp; more</h1><p>First&nbsp;one <b>bold<br>text</b> &lt;tag&gt; a < b.</p><!-- <p>no</p> --><div class="advert">Buy this now please</div>
    <script>if (a < b) document.write("<p>no</p>")</script><p title="a > b">Second.<form><label>Mail</label><input></form><p>S.</p>
    <section class="comments"><h3>Comments</h3><p>A reader says many words about this article and goes on and on</p></section></article>
    <aside class="sidebar"><p>Related words that go on for a while too</p></aside><footer>&copy; all words reserved</footer></body></html>"""
    assert H.main_text(html, W) == "Title & more\n\nFirst one bold text <tag> a < b.\n\nSecond.\n\nS."


def test_odd_pages():
    for html in (None, "", "</", "<p", "<!--", "<script>", "<nav>only a menu</nav>", "<html><body></body></html>", "<a href='x"):
        assert H.main_text(html, W) == ""
    assert H.main_text("<article><p>a &am", W) == "a &am"
    assert H.main_text("<main><p>a &#x41;&#66; &eacute</p></main", W) == "a AB é"
    assert len(H.main_text("<article>" + "<p>" + "word " * 200_000 + "</p></article>", W)) == 999_999
    rng = random.Random(3)
    for _ in range(300):
        H.main_text("".join(rng.choice(["<p>", "</p>", "<div class='ad'>", "</div>", "<", ">", '"', "'", "&", "word ", "<!--", "-->", "<b", "<script>"]) for _ in range(40)), W)


def test_forms_that_wrap_the_page_and_labels():
    body = '<h1>Title here</h1><p>First words of the text.</p><p>A <label>label</label> within.</p>'
    want = "Title here\n\nFirst words of the text.\n\nA label within."
    assert H.main_text(f"<html><body><form id=aspnet><nav><ul><li>Home</ul></nav><article>{body}</article><input></form></body></html>", W) == want
    assert H.main_text(f"<html><body><article>{body}</article><form><label>Mail</label><p>Sign up for our many words</p></form></body></html>", W) == want
    assert H.main_text(f"<form><article>{body}<form><label>Mail</label><input></form></article></form>", W).startswith(want)


def test_deep_pages_take_linear_time():
    for unit in ("<p><div>", "<li>", "<div><li><span>", "<address>", "<nav><article>", "<b class=x%d>", "<form><p>"):
        one, two = ("".join(unit % k if "%" in unit else unit for k in range(n // len(unit))) + "words at the end" for n in (250_000, 1_000_000))
        times = []
        for html in (one, two):
            start = time.perf_counter()
            H.main_text(html, W)
            times.append(time.perf_counter() - start)
        assert times[1] < 8 * times[0] + 0.5, (unit, times)  # four times the input


def test_quality_without_article_elements():
    """Share of words found and right on unseen pages whose article is a div, of no name or of a name of its own."""
    for name in ("div", 'div class="content"'):
        found = said = right = 0
        for html, blocks in labelled_pages(200, seed=77):
            html = html.replace("<article>", f"<{name}>").replace("</article>", "</div>").replace("<main>", "<div>").replace("</main>", "</div>")
            got, want = Counter(H.main_text(html, W).split()), Counter(" ".join(blocks).split())
            both = sum((got & want).values())
            found, said, right = found + both, said + sum(got.values()), right + sum(want.values())
        print(name, "precision", found / said, "recall", found / right)
        assert found / said > 0.9 and found / right > 0.9


T = " ".join(f"word{i % 9} of the text" for i in range(18))[:-9]
SHAPES = {
    "bare": "<div>{T}</div>", "breaks": "<div>{T}<br><br>{T}</div>", "section": "<div><section><p>{T}</p></section></div>", "body": "<body><div><p>{T}</p><p>{T}</p></div></body>",
    "form": "<form id=aspnetForm><div><p>{T}</p></div></form>", "title": "<div><h1>Title</h1><p>{T}</p></div>", "class": "<div class='foo'><h1>Title</h1><p>{T}</p></div>",
    "menu": "<ul><li><a href=x>Home</a><li><a href=y>News and more</a></ul><div><div>{T}</div></div><footer>All rights reserved</footer>", "text": "{T}",
}


@pytest.mark.parametrize("name", SHAPES)
@pytest.mark.parametrize("tagged", [True, False])
def test_shapes_of_pages(name, tagged):
    """Text without paragraphs, in sections, in a form around the page; with html tags and without."""
    html = SHAPES[name].replace("{T}", T)
    html = f"<html><head><title>x</title></head><body>{html}</body></html>" if tagged else html
    want = {"breaks": f"{T} {T}", "body": f"{T}\n\n{T}", "title": f"Title\n\n{T}", "class": f"Title\n\n{T}"}.get(name, T)
    assert H.main_text(html, W) == want


@pytest.mark.parametrize("tagged", [True, False])
@pytest.mark.parametrize("form", [True, False])
@pytest.mark.parametrize("shape", ["parts", "boxes", "breaks", "sections"])
def test_recall_by_shape(shape, form, tagged):
    found = said = right = 0
    for html, blocks in labelled_pages(100, seed=5, shape=shape, form=form, tagged=tagged):
        got, want = Counter(H.main_text(html, W).split()), Counter(" ".join(blocks).split())
        found, said, right = found + sum((got & want).values()), said + sum(got.values()), right + sum(want.values())
    print(shape, form, tagged, round(found / said, 3), round(found / right, 3))
    assert found / said > 0.9 and found / right > 0.9


def reference(html, weights):
    """The result by plain loops: every region tried, its first and longest best one taken, its blocks written out."""
    sequence = H.page_sequence(html)
    shared, worth = H.block_marks(sequence), Counter()
    scores = []
    for x in sequence:
        if isinstance(x, str):
            scores.append(weights.tags.get(x.lstrip("/"), -H.TAG_COST))
            continue
        odds = weights.bias + sum(weights.marks.get(m, 0) for m in x.marks | shared[x.block])
        score = 0 if x.never else len(x.text.split()) * max(-H.CLIP, min(H.CLIP, odds))
        worth[x.block] += score
        scores.append(max(score, 0) if x.marks & H.CONTAINERS else score)
    spans = [(round(sum(scores[a:b]), 6), -a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    best = max(spans, default=(0, 0, 0))
    kept = {}
    for x in sequence[-best[1] : best[2]] if best[0] > 0 else []:
        if isinstance(x, H.Run) and not x.never and worth[x.block] > 0:
            kept[x.block] = kept.get(x.block, "") + x.text
    return "\n\n".join(b for b in (" ".join(t.split()) for t in kept.values()) if b)


def test_whole_result_equals_plain_loops():
    pages = [h for h, _ in labelled_pages(60, seed=123) if len(h) < 4_000]
    assert len(pages) > 20
    for html in pages:
        assert H.main_text(html, W) == reference(html, W)


def test_scan_is_optimal():
    rng = random.Random(8)
    for _ in range(300):
        scores = [rng.randint(-5, 5) for _ in range(rng.randint(0, 12))]
        a, b = H.best_region(scores)
        assert sum(scores[a:b]) == max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])


def test_rows_nulls_and_empty_table(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>x y</p></article>", 5), (1, None, None, None), (None, "u", "", 1)], "page_id long, url string, html string, text int")
    got = H.extract(pages).collect()
    assert sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in got) == [("1", "None", "", 0), ("1", "u", "x y", 3), ("None", "u", "", 0)]
    assert H.extract(pages.limit(0)).count() == 0
