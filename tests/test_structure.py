import re

from lorewright.operators import cleaning
from lorewright.operators import structure as S

PAGE_SCHEMA = "document_id long, page long, text string"


def test_passages_cite_their_raw_lines(spark):
    pages = {
        1: "• 1 •\nThe  Guide\n  The fi rst\tman , he  sacrifi ced it.\n\nmy fi rsts\n12\n(Order #7)\n",
        2: "", 3: None, 4: "• 1 •", 5: "a\nb\n• 2 •\n7\nc\nd\ne\nf (Order #1)\ng",
    }
    df = spark.createDataFrame([(1, p, t) for p, t in pages.items()], PAGE_SCHEMA)
    rows = sorted(S.reading_passages(df, ["the guide"]).collect(), key=lambda r: (r.page, r.line_no))
    assert [(r.page, r.line_no, r.passage) for r in rows if not r.removed] == [
        (1, 2, "The first man, he sacrificed it."), (1, 4, "my fi rsts"), (5, 0, "a"), (5, 1, "b"), (5, 2, "• 2 •"), (5, 3, "7"), (5, 4, "c"), (5, 5, "d"), (5, 6, "e"), (5, 7, "f (Order #1)"), (5, 8, "g"),
    ]
    assert {(r.page, r.line_no) for r in rows if r.removed} == {(1, 0), (1, 1), (1, 5), (1, 6), (4, 0)}
    for page, text in pages.items():
        clean = "\n".join(r.passage for r in rows if r.page == page and not r.removed)
        for r in (r for r in rows if r.page == page):
            assert text[r.raw_start : r.raw_end] == text.split("\n")[r.line_no]
            assert r.removed or clean[r.clean_start : r.clean_end] == r.passage


def contexts(spark, pages):
    lines = [(1, p, k, t) for p, text in enumerate(pages, 1) for k, t in enumerate(text.split("\n"))]
    df = spark.createDataFrame(lines, "document_id long, page long, line_no int, text string")
    return [r.context for r in S.section_contexts(df).orderBy("page").collect()]


def test_sections_open_and_close(spark):
    assert contexts(spark, ["prose first.", "# One\nmore.", "### Deep\nText.", "## Two\nText.", "1.2 Numbered\nText.", "Day 4\ntext.", "THE END"]) == [
        "main", "one", "one > deep", "one > two", "one > 1_2_numbered", "one > day_4", "the_end",
    ]
    # a title before a continuation is none, table rows of dice are none, stat blocks end with their page
    assert contexts(spark, ["Old Mill\nof the river.", "Old Mill\nThe river.", "Traits\nText.", "text.", "3 Goblins\nroll d6.", "3 Goblins\nText."]) == ["main", "old_mill", "traits", "main", "main", "3_goblins"]
    # titles below a collection of reports are its children
    told = ["RUMORS\nIt is told in various regions.", "It is told in various regions.", "Old Mill\nText.", "New Mill\nText.", "THE END"]
    assert contexts(spark, told) == ["rumors", "rumors", "rumors > old_mill", "new_mill", "the_end"]


def test_running_lines_open_no_section(spark):
    assert contexts(spark, ["Old Mill\nThe river."] * 2) == ["old_mill"] * 2
    assert contexts(spark, ["Old Mill\nThe river."] * 3) == ["main"] * 3
    assert contexts(spark, ["RUMORS\nThe river."] * 3) == ["rumors"] * 3
    assert contexts(spark, ["", "  "]) == ["main", "main"]


def test_of_copies_that_support_each_other_one_stays(spark):
    title = "The Adventure Guide"
    same = "a line that stands twice"
    rows = [(1, 1, f"{title}\n{same}\n{title}\n{same}\n{title}\nshort\n{title}"), (1, 2, f"{title}\nother text\n12\n{title}\nshort")]
    marked = cleaning.marked_lines(spark.createDataFrame(rows, PAGE_SCHEMA))
    got = {(r.page, r.line_no, r.reason) for r in cleaning.overlaid_lines(marked).collect()}
    assert {g for g in got if g[2] == "duplicate_overlay"} == {(1, 1, "duplicate_overlay")}
    kept = {r.page: r.model_text for r in cleaning.clean_pages(spark.createDataFrame(rows, PAGE_SCHEMA), layers=True).collect()}
    assert len(re.findall(same, kept[1])) == 1 and "other text" in kept[2]
