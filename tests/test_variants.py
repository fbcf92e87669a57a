"""Readers of model answers on stated answers of every shape."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lectern.functions import variants as va


def plain(x):
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    return [plain(v) for v in x] if isinstance(x, list) else x


def run(spark, fn, *rows):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, raw string" + (", n int" if isinstance(rows[0], tuple) else ""))
    return [plain(r.x) for r in df.select("i", fn(df).alias("x")).orderBy("i").collect()]


def topic(t, *passages, **more):
    return {"t": t, "passages": list(passages)} | more


GOOD = {"chapters": [{"c": 1, "topics": [topic(1, {"label": " L ", "text": " one "}, "two", 3, "")]}]}
READ = [(1, 1, [("L", "one"), ("", "two")])]
ANSWERS = [
    ("", "EMPTY", []), (None, "EMPTY", []), (" \n ", "EMPTY", []), ("so what", "NOT_JSON", []), ('"text"', "NOT_OBJECT", []), ("7", "NOT_OBJECT", []), ("null", "NOT_OBJECT", []), ("{}", "NO_CHAPTERS", []),
    ('{"chapters": "x"}', "NO_CHAPTERS", []), ('{"chapters": []}', "NO_TOPIC", []), ("[]", "NO_TOPIC", []), ('[1, "a", null]', "NO_TOPIC", []),
    (json.dumps(GOOD), None, READ), ("```json\n" + json.dumps(GOOD) + "\n```", None, READ), ("\n```\n" + json.dumps(GOOD) + "```\n", None, READ),
    (json.dumps({"result": GOOD}), None, READ), (json.dumps(GOOD["chapters"]), None, READ),
    ('{"chapters": [{"c": "1", "topics": []}]}', "CHAPTER_NUMBER", []), ('{"chapters": [{"c": 1.5, "topics": []}]}', "CHAPTER_NUMBER", []), ('{"chapters": [{"topics": []}]}', "CHAPTER_NUMBER", []),
    ('{"chapters": [{"c": 2.0, "items": [{"i": 3, "body": "b", "label": "x"}]}]}', None, [(2, 3, [("x", "b")])]),
    ('{"chapters": [{"c": 1, "topics": [{"t": "3", "text": "b"}]}]}', "TOPIC_NUMBER", []), ('{"chapters": [{"c": 1, "topics": [{"t": 3, "text": " "}]}]}', "NO_BODY", []),
    ('{"chapters": [{"c": 1, "topics": [{"t": 1, "text": "a"}, {"t": null, "text": "b"}]}, {"c": "x"}]}', "TOPIC_NUMBER", []), ('{"chapters": [{"c": "x"}, {"c": 1, "topics": [{"t": "1"}]}]}', "CHAPTER_NUMBER", []),
    ('{"chapters": [{"c": 1, "topics": [{"t": 1, "paragraphs": [{"label": 5, "body": "a"}, {"text": null, "body": "c"}, ["x"], true]}, 4, "z"]}, "no", {"c": 2, "topics": 7}]}', None, [(1, 1, [("5", "a"), ("", "c")])]),
    ('{"slots": [{"kind": "定义", "text": " d "}, {"kind": "example", "stem": "s", "solution": " t ", "title": "T"}, {"label": "note", "body": ""}], "t": 4, "c": 9}', None, [(9, 4, [("定义", "d"), ("T", "s\n\nt")])]),
    ('{"slots": [{"kind": "概念", "body": "b", "title": " "}], "t": 4}', None, [(1, 4, [("定义", "b")])]), ('{"slots": [{"kind": "odd", "text": "d"}], "t": 1}', "BLOCK_KIND", []), ('{"slots": [], "t": 1}', "NO_BODY", []),
    ('{"slots": {}, "t": 1}', "NO_CHAPTERS", []), ('{"a": 1, "a": 2}', "NOT_JSON", []),
]


def test_written_answers(spark):
    got = run(spark, lambda d: va.written_answer(d.raw), *[a for a, _, _ in ANSWERS])
    assert [(g["problem"], [(t["chapter"], t["topic"], [(p["label"], p["text"]) for p in t["passages"]]) for t in g["topics"]]) for g in got] == [(p, t) for _, p, t in ANSWERS]
    block = got[[a[0] for a in ANSWERS].index(ANSWERS[-6][0])]["topics"][0]["blocks"]
    assert [(b["kind"], b["title"], b["text"], b["stem"], b["solution"]) for b in block] == [("definition", "定义", " d ", "", ""), ("example", "T", "", "s", " t ")]


DRAFTS = [
    ('{"questions": [{"题型": "选择题", "题干": "s", "答案": "A", "自审": "通过", "选项": "A. x\\n b) y\\nno", "依据": "web｜q1\\nq2；知识库|q3;课外｜"}, 5, null]}',
     [("mcq", "s", "A", True, [("web", "q1"), ("knowledge", "q2"), ("knowledge", "q3")], [("A", "x"), ("B", "y")])]),
    ('{"items": [{"type": "cloze", "stem": 3, "pass": 1, "evidence": {"kind": "Web", "quote": "q"}, "choices": [{"label": "c", "text": "z"}, "D、w", {"label": "", "text": "n"}]}]}',
     [("cloze", "3", "", True, [("web", "q")], [("C", "z"), ("D", "w")])]),
    ('[{"stem": "a", "pass": "no", "evidence": ["x|y", {"quote": " "}, 4]}]', [("shortAnswer", "a", "", False, [("x", "y")], [])]),
    ('{"stem": "lone", "type": "essay"}', [("essay", "lone", "", False, [], [])]), ('{"questions": "[{\\"stem\\": \\"t\\"}]"}', [("shortAnswer", "t", "", False, [], [])]),
    ('noise {"questions": "so {\\"items\\": [{\\"stem\\": \\"u\\"}]} end"} noise', [("shortAnswer", "u", "", False, [], [])]), ("nothing", None), ("", None), ('{"x": 1}', None), ('{"questions": []}', []),
]


def shape(ds):
    return None if ds is None else [(d["type"], d["stem"], d["answer"], d["pass"], [(e["kind"], e["quote"]) for e in d["evidence"]], [(c["label"], c["text"]) for c in d["choices"]]) for d in ds]


def test_drafts(spark):
    got = run(spark, lambda d: va.submitted(d.raw), *[a for a, _ in DRAFTS])
    assert [shape(g) for g in got] == [w for _, w in DRAFTS]


TURNS = [
    ("no json", (None, None, None, "NO_JSON")), (None, (None, None, None, "NO_JSON")), ('{"a": 1}', (None, None, None, "NEITHER")), ('{"tool": "rm", "args": {}}', (None, None, None, "TOOL_NOT_ALLOWED")),
    ('{"tool": " web_search ", "args": {"query": " q "}}', ("web_search", "q", None, None)), ('{"tool": "web_search", "args": [1]}', (None, None, None, "NO_QUERY")), ('{"tool": "web_search"}', (None, None, None, "NO_QUERY")),
    ('first {"questions": []} then {"tool": "search_course", "args": {"query": "}{"}} and {"note": 1}', ("search_course", "}{", None, None)),
    ('{"tool": "web_search", "args": {"query": "a"}}\n```json\n{"questions": [{"stem": "s"}]}\n```', (None, None, 1, None)), ('```\n{"tool": "search_course", "args": {"query": 5}}\n``` and ```{broken```', ("search_course", "5", None, None)),
    ('open { and "odd quote\n {"questions": [{"stem": "x {"}, {"stem": "y"}]}', (None, None, 2, None)), ('{"tool": "", "questions": [1, {"stem": "z"}]}', (None, None, 1, None)),
]


def test_turns(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(TURNS)], "i int, raw string").withColumn("c", va.json_candidates("raw"))
    got = [r.x for r in df.select("i", va.question_turn(F.col("c")).alias("x")).orderBy("i").collect()]
    assert [(g.tool, g.query, None if g.questions is None else len(g.questions), g.problem) for g in got] == [w for _, w in TURNS]


def test_balanced_is_linear_and_outermost():
    assert va.balanced('a {b {c} "}" } { {d} {"e": "\\"}"} f') == ['{b {c} "}" }', "{d}", '{"e": "\\"}"}']
    assert va.balanced("}{") == [] and va.balanced("{\n\"x\n}") == ["{\n\"x\n}"]
    assert len(va.balanced("{" * 200_000 + "}" * 199_999)) == 1 and va.balanced('{"' * 100_000) == []


def test_duplicate_indexes(spark):
    rows = [("x", 3), ("[1]", 3), ("{}", 3), ('{"duplicateIndexes": [2, 0, 2, "1", 3, -1, null, "2x", 1.7, true]}', 3), ('{"duplicates": []}', 0), ('{"duplicateIndexes": 3}', 3)]
    got = run(spark, lambda d: va.duplicate_indexes(d.raw, d.n), *rows)
    assert [(g["indexes"], g["problem"]) for g in got] == [([], "NOT_JSON"), ([], "NOT_OBJECT"), ([], "NO_LIST"), ([0, 1, 2], None), ([], None), ([], "NO_LIST")]


def test_vocabulary(spark):
    rows = [None, "{", "null", "7", '{"terms": 3}', "[]", '[{"name": " b ", "aliases": ["x", " ", 4, " y"]}, {"name": ""}, 5, {"name": "a"}]', '{"terms": [{"name": "a"}, {"name": "s"}, {"name": "b", "aliases": "no"}]}']
    got = run(spark, lambda d: va.vocabulary(d.raw, ("a", "s")), *rows)
    assert [([(t["name"], t["aliases"]) for t in g["terms"]], g["issues"]) for g in got] == [
        ([("a", []), ("s", [])], []), ([("a", []), ("s", [])], ["NOT_JSON"]), ([("a", []), ("s", [])], []), ([("a", []), ("s", [])], ["NO_TERMS"]), ([("a", []), ("s", [])], ["NO_TERMS"]), ([("a", []), ("s", [])], ["SEED:2"]),
        ([("s", []), ("b", ["x", "y"]), ("a", [])], ["NO_NAME:2", "NO_NAME:3", "SEED:1"]), ([("a", []), ("s", []), ("b", [])], []),
    ]


@pytest.mark.parametrize("value", ["3", "3.0", "1e3", "-4"])
def test_whole(spark, value):
    assert run(spark, lambda d: va.whole(F.try_parse_json(d.raw)), value, f'"{value}"', "2.5", "true") == [int(float(value)), None, None, None]


def test_nothing_stands_behind_a_value(spark):
    texts = ["7 men", '{"a": 1} so', "1] x", '1} x', "1]}", "1}]", "1, 2", "1],[2", '{"a": 1}, "b": 2', '[1]"x"', "", " ", None, ' {"a": 1} ', "[1, 2]", "7", '"]"', "null"]
    read = run(spark, lambda d: F.to_json(va.parsed(d.raw)), *texts)
    assert read == [None] * 13 + ['{"a":1}', "[1,2]", "7", '"]"', "null"]
    problems = run(spark, lambda d: va.written_answer(d.raw)["problem"], "4537 and more", '[] end', '{"slots": [], "t": 1} end', "4537")
    assert problems == ["NOT_JSON", "NOT_JSON", "NOT_JSON", "NOT_OBJECT"]
