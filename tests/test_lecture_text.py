"""Lectures as text on stated lectures: the round trip of awkward units, and every problem of an edited text by itself."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lectern.operators import lecture_text as lt
from lectern.operators import lecture_write as lw

BLOCKS = "array<struct<kind: string, title: string, text: string, stem: string, solution: string, sources: array<int>>>"
TOPICS = f"deck string, chapter int, chapter_title string, topic int, title string, sources array<int>, blocks {BLOCKS}"


def lecture(spark):
    rows = [
        ("x", 1, "Old", 1, "Cover", [1, 2], [("definition", "Def", "text of it", "", "", []), ("example", "Ex", "", "given", "worked out", [2])]),
        ("x", 1, "Old", 2, "", [3], [("note", "a|b\nc", "#!odd\n\\##!topic 1 1\r\n>>> SOLUTION\n>>> SOLUTION no\nplain ", "", "", None), ("procedure", "src=1", "\\\\>>> BLOCK x", "", "", []), ("elaboration", "", " \n ", "", "", [])]),
    ]
    units = lt.review_units(spark.createDataFrame(rows, TOPICS))
    sources = spark.createDataFrame([("x", i, i + 3, i * 1000, f"s{i}") for i in (1, 2, 3)], "deck string, source int, page int, start_ms long, summary string")
    decks = spark.createDataFrame([("x", "T", None)], "deck string, title string, outline string")
    return units, decks, sources


def test_round_trip_of_awkward_units(spark):
    units, decks, sources = lecture(spark)
    text = lt.write_lecture(units, decks, sources)
    read = text.select(lt.read_lecture(F.col("text")).alias("x")).first().x
    got = [(b.kind, b.title, b.refs, b.sources, b.text, b.solution) for t in read.topics for b in t.blocks]
    assert got == [
        ("definition", "Def", ["c1t1b1"], [1, 2], "text of it", ""), ("example", "Ex", ["c1t1b2"], [2], "given", "worked out"),
        ("note", "a b c", ["c1t2b1"], [3], "#!odd\n\\##!topic 1 1\n>>> SOLUTION\n>>> SOLUTION no\nplain", ""), ("procedure", "", ["c1t2b2"], [3], "\\\\>>> BLOCK x", ""),
    ]
    assert [(t.chapter, t.topic, t.title, t.chapter_title) for t in read.topics] == [(1, 1, "Cover", "Old"), (1, 2, "未命名知识点", "Old")]
    assert lt.merge_lecture(text, units, sources)[1].count() == 0 and lt.merge_lecture(text, units, sources)[0].count() == 4


GOOD = """#!section x T
##!topic 1 1 | Notion | 章=Theory
>>> BLOCK 定义 | Def | ref=c1t1b1 | src=1,2
words
>>> BLOCK 说明 | more | ref=c1t2b1,c1t2b2 | src=3
# a heading stays
##!topic 2 1 | Use | 章=Practice
>>> BLOCK 例题 | Ex | ref=c1t1b2 | src=2
given
>>> SOLUTION
worked"""
BAD = [
    ("SECTION", "#!section x T", "#!section y T"), ("TOPIC_FORMAT", "##!topic 2 1 | Use | 章=Practice", "##!topic 2 1 | Use"), ("TOPIC_REPEATED", "##!topic 2 1 | Use | 章=Practice", "##!topic 1 1 | Use | 章=Theory"),
    ("CHAPTER_SPLIT", "##!topic 2 1 | Use | 章=Practice", "##!topic 1 2 | Use | 章=Practice"), ("STRAY_BLOCK", "##!topic 1 1 |", ">>> BLOCK 说明 | a\n##!topic 1 1 |"), ("EMPTY_TOPIC", "##!topic 2 1 |", "##!topic 1 2 | none | 章=Theory\n##!topic 2 1 |"),
    ("BLOCK_KIND", "BLOCK 说明", "BLOCK other"), ("SOLUTION_PLACE", "# a heading stays", "# a\n>>> SOLUTION\nb"), ("SRC_FORMAT", "src=3", "src=3,x"), ("EMPTY_BLOCK", "words", " "), ("REF_UNKNOWN", "ref=c1t2b1,", "ref=c9t9b9,c1t2b1,"),
    ("REF_UNKNOWN", "ref=c1t1b1 |", "ref= |"), ("SRC_UNKNOWN", "src=1,2", "src=1,2,9"), ("SRC_UNKNOWN", "src=3", "src="), ("SRC_OUTSIDE", "src=1,2", "src=1,2,3"), ("UNIT_LOST", "ref=c1t2b1,c1t2b2", "ref=c1t2b1"), ("SOURCE_LOST", "src=1,2", "src=2"),
    ("EXAMPLE_LOST", ">>> SOLUTION\nworked", ""), ("EXAMPLE_LOST", "BLOCK 例题 | Ex | ref=c1t1b2 | src=2\ngiven\n>>> SOLUTION\nworked", "BLOCK 讲解 | Ex | ref=c1t1b2 | src=2\ngiven"),
]


def test_problems(spark):
    units, _, sources = lecture(spark)
    names = [f"x{i}" for i in range(len(BAD) + 2)]
    texts = [GOOD, *[GOOD.replace(a, b) for _, a, b in BAD], "no lecture"]
    assert all(t != GOOD for t in texts[1:])
    deck = F.explode(F.array(*map(F.lit, names)))
    edits = spark.createDataFrame([(n, t.replace("#!section x ", f"#!section {n} ")) for n, t in zip(names, texts, strict=True)], "deck string, text string")
    kept, problems = lt.merge_lecture(edits, units.withColumn("deck", deck), sources.withColumn("deck", deck))
    got = {}
    for r in problems.collect():
        got.setdefault(r.deck, set()).add(r.code)
    for name, (code, _, _) in zip(names[1:], BAD, strict=False):
        assert code in got[name], (name, code, got.get(name))
    assert "x0" not in got and got[names[-1]] >= {"NO_TOPIC", "SECTION", "UNIT_LOST", "SOURCE_LOST"}
    rows = sorted((r.chapter_no, r.topic_no, r.block_no, r.kind, r.text, r.stem, r.solution, r.from_page, r.to_page, r.start_ms, r.first_source) for r in kept.collect())
    assert {r.deck for r in kept.select("deck").distinct().collect()} == {"x0"}
    assert rows == [
        (1, 1, 1, "definition", "words", "", "", 4, 5, 1000, 1), (1, 1, 2, "note", "# a heading stays", "", "", 6, 6, 3000, 3), (2, 1, 1, "example", "", "given", "worked", 5, 5, 2000, 2),
    ]


def test_passages_are_blocks_of_their_label(spark):
    df = spark.createDataFrame([([], [("定义", "a"), ("", "b")])], f"b {BLOCKS}, p array<struct<label: string, text: string>>")
    assert [(x.kind, x.text) for x in df.select(lt.effective_blocks(F.col("b"), F.col("p")).alias("x")).first().x] == [("definition", "a"), ("elaboration", "b")]


@pytest.mark.parametrize(
    ("source", "body", "want"),
    [
        ("abc def", "abc, def.", (None, ["SAME"], "draft")), ("abc", "x" * 66, ("TOO_LONG", [], None)), ("abc", "类型：教学安排", ("BROKEN", [], None)), ("word " * 60, "tiny", ("BROKEN", ["SHRUNK"], None)),
        ("嗯" * 3 + "abc", "嗯嗯 finished", (None, ["FILLER"], "draft")), ("abc", "同学们 look", (None, ["ADDRESS:同学们"], "draft")), ("abc", "a cut，", (None, ["CUT"], "draft")), ("letters " * 20, "some of the letters again", (None, ["SHRUNK"], "written")),
        ("abc", "better", (None, [], "written")), ("abc", " ", ("EMPTY", None, None)),
    ],
)
def test_guards(spark, source, body, want):
    g = spark.createDataFrame([(source, body)], "s string, b string").select(lw.guarded(F.col("s"), F.col("b")).alias("g")).first().g
    assert g.refused == want[0]
    if want[0] is None:
        assert (sorted(g.notes), g.register) == want[1:]
