"""The knowledge tree and the lesson parser on small lectures whose results are known."""

from __future__ import annotations


from lectern.operators import lecture_tree as lt
from lectern.operators import lesson_parse as lp
from lectern.operators import search


def deck(spark, pages, blocks=(), outline=()):
    slides = spark.createDataFrame([("d", i, t) for i, t in enumerate(pages, 1)], "deck string, page int, text string")
    b = spark.createDataFrame([("d", k, p) for k, p in enumerate(blocks, 1)], "deck string, block int, page int")
    o = spark.createDataFrame([("d", i, *x) for i, x in enumerate(outline)], "deck string, segment int, title string, `from` int, `to` int")
    topics, placed, decks = lt.build_tree(slides, b, o)
    return [tuple(r)[2:] for r in topics.orderBy("topic").collect()], {r.block: (r.topic, r.orphan) for r in placed.collect()}, decks.first()


def body(k):
    return f"the body of page number {k} is a long line of words that nobody takes for a title at all, as it ends like a sentence."


def test_standard_deck(spark):
    names = ["Alpha"] * 3 + ["Beta"] * 2 + ["Gamma"] * 3
    pages = [f"Course on Things\n**{n}**\n{body(k)}" for k, n in enumerate(names)]
    topics, placed, d = deck(spark, pages, [1, 2, 4, 6, 8, 99], [("first half", 1, 2), ("second half", 3, 6)])
    assert topics == [("Alpha", 1, 3, 3, 2, 1, "first half"), ("Beta", 4, 5, 2, 1, 2, "second half"), ("Gamma", 6, 8, 3, 3, 2, "second half")]
    assert placed == {1: (1, False), 2: (1, False), 3: (2, False), 4: (3, False), 5: (3, False), 6: (3, True)}
    assert (d.pages, d.header_pages, d.shell_pages, d.template, d.topics, d.covered_topics, d.chapters) == (8, 8, 0, "header", 3, 3, 2)


def test_dividers_windows_and_covers(spark):
    pages = ["A Lecture on Trees", "Chapter 1 Roots\n" + body(1), body(2), "窗口标题栏：x.xlsx - Excel\nrows", "Chapter 2 Leaves", body(3)]
    topics, _, d = deck(spark, pages, [], [("unused", 1, 9)])
    assert [(t[0], t[1], t[2], t[5], t[6]) for t in topics] == [
        ("A Lecture on Trees", 1, 1, 1, ""), ("Chapter 1 Roots", 2, 3, 2, "Chapter 1 Roots"), ("", 4, 4, 2, "Chapter 1 Roots"), ("Chapter 2 Leaves", 5, 6, 3, "Chapter 2 Leaves"),
    ]
    assert d.shell_pages == 1 and d.template == "plain"


def test_a_deck_without_pages_is_no_tree(spark):
    topics, placed, d = deck(spark, [], [1, 2])
    assert topics == [] and placed == {} and d is None


def test_anchors_place_every_line_once(spark):
    """Ten lines a second apart under anchors of every shape; a page with no answer is one block."""
    for anchors in ([0, 0, 0], [1, 1, 3, 0], [0, 3, 0, 7], [4, 2, 1], []):
        slides = spark.createDataFrame([("l", i, a * 1000 if a else None) for i, a in enumerate(anchors, 1)], "lesson string, page int, anchor_ms long")
        lines = spark.createDataFrame([("l", i, i * 1000, i * 1000 + 800, f"line {i}") for i in range(10)], "lesson string, line int, start_ms long, end_ms long, text string")
        answers = spark.createDataFrame([], "lesson string, page int, raw string")
        sentences, blocks, status = lp.parse(slides, lines, answers)
        s = status.first()
        assert s.lines == 10 and s.lossless and s.sentences == (10 if anchors else 0)
        spans = sorted((r["from"], r["to"]) for r in blocks.collect())
        assert [n for a, b in spans for n in range(a, b + 1)] == list(range(1, s.sentences + 1))
        assert sentences.select("line").distinct().count() == s.sentences


def test_edits_past_their_limit_and_gaps_fail_a_page(spark):
    slides = spark.createDataFrame([("l", 1, 0), ("l", 2, 10_000)], "lesson string, page int, anchor_ms long")
    lines = spark.createDataFrame([("l", i, i * 5000, i * 5000 + 1000, t) for i, t in enumerate(["概率密度函数", "旧事史", "x", "y"])], "lesson string, line int, start_ms long, end_ms long, text string")
    answers = spark.createDataFrame([("l", 1, "1. 概率密度函数。\n2. 一段完全不同而且长得多的文字\n块 1-2"), ("l", 2, "块 1\n块 3")], "lesson string, page int, raw string")
    sentences, blocks, status = lp.parse(slides, lines, answers)
    got = {r.line: (r.page, r.text, r.rejected) for r in sentences.collect()}
    assert got[0] == (1, "概率密度函数。", False) and got[1] == (1, "旧事史", True)
    assert status.first().failed_pages == [1, 2]
    assert [(r["from"], r["to"]) for r in blocks.collect()] == [(1, 4)]


def test_search_of_one_lesson(spark):
    blocks = spark.createDataFrame([(1, 1, 1, "主线", ["概念"], "概率")], "lesson int, block int, page int, role string, facets array<string>, summary string")
    sentences = spark.createDataFrame([(1, 1, 0, 2, "密度函数")], "lesson int, block int, ord int, page int, text string")
    pages = spark.createDataFrame([(1, 1, "密度 on the page", "密度 in the picture", False, True), (1, 2, "密度", "", True, False)], "lesson int, page int, page_text string, page_visual string, failed boolean, gated boolean")
    spines = spark.createDataFrame([(1, "概率 then 密度")], "lesson int, text string")
    terms = spark.createDataFrame([(1, 1, "密度", 3)], "lesson int, ord int, term string, page int")
    topics = spark.createDataFrame([(1, 1, 4, "密度", ["密度 body"])], "lesson int, topic int, page int, title string, bodies array<string>")

    def found(**how):
        return [r.layer for r in search.search_lessons(blocks, sentences, pages, spines, terms, topics, **how).orderBy("branch", "at").collect()]

    assert found(query="密度") == ["teacher", "outline", "pageText", "glossary", "lecture", "lecture"]
    assert found(query="概率") == ["final", "outline"]
    assert found(query="密度", mode=search.TITLE_ONLY) == ["outline", "glossary", "lecture"]
    assert found(query="密度", mode=search.TAG_FILTER, role="支线") == [] and found(query="密度", mode=search.TAG_FILTER, facets=("概念", "x")) == ["teacher"]
    assert found(mode=search.TAG_FILTER, role="主线") == ["final"] and found() == [] and found(query=" ") == []
    assert found(query="密度", layers=("glossary", "rag")) == ["glossary"] and found(query="密度", limit=2) == ["teacher", "outline"]


def test_blocks_are_placed_in_linear_time(spark):
    """No window's frame ends with its partition: such a frame is read again for every row."""
    topics = spark.createDataFrame([("d", 1, 3, 4, False), ("d", 2, 5, 9, False), ("d", 3, 20, 20, False)], "deck string, topic int, from_page int, to_page int, divided boolean")
    blocks = spark.createDataFrame([("d", i, p) for i, p in enumerate((1, 3, 4, 5, 9, 14, 15, 20, 30))], "deck string, block int, page int")
    placed = lt.placed_blocks(topics, blocks)
    assert [(r.topic, r.orphan) for r in placed.orderBy("block").collect()] == [(1, True), (1, False), (1, False), (2, False), (2, False), (2, True), (3, True), (3, False), (3, True)]
    assert "unboundedfollowing" not in placed._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_cleaned_as_by_every_round(spark):
    from pyspark.sql import functions as F

    from lectern.functions import slide_text as st

    texts = ["plain words, and more.", "a  b", "a\tb", "1. x", "1.5 x", "- x", "x...", "x..", "x……y", "标题：x", "a: b", "~~x~~", "a~b", "*x*", "x_1", "　x", "+", "12) y", "`q`", " x ", ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    x = F.regexp_replace("t", r"^\s+|\s+$", "")
    for _ in range(st.CLEAN_ROUNDS):
        for pattern, to in st.CLEAN_STEPS:
            x = F.regexp_replace(x, pattern, to)
        rows = rows.withColumn("x", x).localCheckpoint()
        x = F.col("x")
    assert [r[0] for r in rows.orderBy("i").select(st.clean_line(F.col("t")) == F.col("x")).collect()] == [True] * len(texts)
