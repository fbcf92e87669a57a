"""Operators against hand-written folds and the invariants they keep."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lectern.operators import analytics as an
from lectern.operators import quality as ql
from lectern.operators import transcript as tr
from lectern.operators import tree


def fold_assign(anchors, times):
    """A cursor over the slides, as a plain loop."""
    out, n, at = {}, len(anchors), 0
    order = sorted(range(len(times)), key=lambda i: (times[i], i))
    starts = [next((a for a in reversed(anchors[: i + 1]) if a is not None), None) for i in range(n)]
    ends = [next((a for a in anchors[i + 1 :] if a is not None), None) for i in range(n)]
    for i in range(n):
        while at < len(order):
            t = times[order[at]]
            if t < (starts[i] if starts[i] is not None else -1) or ends[i] is None or t < ends[i]:
                out[order[at]] = i + 1
                at += 1
            else:
                break
    return out


def test_assignment_equals_a_cursor(spark):
    rng = random.Random(3)
    slides, lines, want = [], [], {}
    for lesson in range(60):
        anchors = [rng.choice([None, rng.randrange(0, 12)]) for _ in range(rng.randrange(1, 7))]
        if all(a is None for a in anchors):
            anchors[0] = 3
        times = [rng.randrange(0, 14) for _ in range(rng.randrange(0, 9))]
        slides += [(lesson, i + 1, a) for i, a in enumerate(anchors)]
        lines += [(lesson, i, t) for i, t in enumerate(times)]
        want |= {(lesson, i): p for i, p in fold_assign(anchors, times).items()}
    s = spark.createDataFrame(slides, "lesson int, page int, anchor_ms long")
    x = spark.createDataFrame(lines, "lesson int, ord int, start_ms long")
    got = {(r.lesson, r.ord): r.page for r in tr.assign_lines(s, x).collect()}
    assert got == want and len(got) == len(lines)


def test_lines_without_slides_stay(spark):
    s = spark.createDataFrame([], "lesson int, page int, anchor_ms long")
    x = spark.createDataFrame([(1, 1, 5)], "lesson int, ord int, start_ms long")
    assert [r.page for r in tr.assign_lines(s, x).collect()] == [None]


def test_outline_keeps_the_first_good_span(spark):
    spans = F.array(*[F.struct(F.lit(a).alias("from"), F.lit(b).alias("to")) for a, b in ((1, 3), (3, 4), (2, 2), (9, 9), (5, 2))])
    got = spark.range(1).select(tr.folded_outline(spans, F.lit(4)).alias("x")).first().x
    assert [r.kept for r in got] == [True, False, False, False, False]


def test_bins(spark):
    sizes = F.array_repeat(F.lit(100), 50)
    got = spark.range(1).select(tr.greedy_bins(sizes).alias("x")).first().x
    assert [got.count(b) for b in (1, 2, 3)] == [24, 24, 2]


def test_coverage(spark):
    rows = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 2, 4), (1, 3, 7, 8)], "lesson int, ord int, from int, to int")
    got = sorted((r.ord, r.issue) for r in tr.coverage_issues(rows, F.lit(9), "lesson", "ord").collect())
    assert got == [(2, "overlap"), (3, "gap"), (3, "missing end")]


def test_coverage_with_open_spans_and_bare_lessons(spark):
    rows = spark.createDataFrame([("a", 1, 1, 2), ("a", 2, 3, None), ("a", 3, 3, 6), ("b", 1, 1, 4)], "lesson string, ord int, `from` int, `to` int")
    lessons = spark.createDataFrame([("a", 6), ("b", 6), ("c", 4), ("d", 0)], "lesson string, n int")
    counts = lessons.select("lesson", "n")
    got = sorted((r.lesson, r.ord or 0, r.expected, r.issue) for r in tr.coverage_issues(rows.join(counts, "lesson"), F.col("n"), "lesson", "ord", lessons=lessons).collect())
    assert got == [("a", 2, 3, "open"), ("b", 1, 5, "missing end"), ("c", 0, 1, "missing end")]



def test_page_gate(spark):
    gate = tr.page_gate(F.lit("x" * 200), F.lit("a toolbar"), ("toolbar",))
    assert spark.range(1).select(gate).first()[0] is False
    assert spark.range(1).select(tr.page_gate(F.lit("x"), F.lit("a toolbar"), ("toolbar",))).first()[0] is True


def attempts(spark, flags):
    return spark.createDataFrame([(1, "A", i, i, f) for i, f in enumerate(flags)], "user int, point string, at int, seq int, wrong boolean")


def test_mastery_looks_at_the_last_three(spark):
    assert an.mastery(attempts(spark, [True] * 3), ["user"], "at", "seq").first().label == "allWrong"
    assert an.mastery(attempts(spark, [True] * 3 + [False]), ["user"], "at", "seq").first().label == "mixed"
    assert an.mastery(attempts(spark, [True] * 2), ["user"], "at", "seq").first().label == "insufficient"


def test_attribution(spark):
    a = spark.createDataFrame([("q1", True, 1), ("q2", False, 2), ("q3", False, 3), ("gone", True, 4)], "quiz string, wrong boolean, at int").withColumn("seq", F.col("at"))
    p = spark.createDataFrame([("q1", "A"), ("q1", "B"), ("q2", "A"), ("q3", "A"), ("q4", "C")], "quiz string, point string")
    got = {r.point: (r.attempts, r.wrong) for r in an.attribution(a, p, "quiz", "point", "at", "seq").collect()}
    assert got == {"A": (3, 1), "B": (1, 1), "C": (0, 0)}


def test_self_rating_wins(spark):
    rows = spark.createDataFrame([("again", "correct"), (None, "unknown"), (None, "incorrect"), ("good", "incorrect")], "recall string, auto string")
    assert [r[0] for r in rows.select(an.counts_as_wrong(F.col("recall"), F.col("auto"))).collect()] == [True, False, True, False]


def test_no_sample_no_interval(spark):
    low, high = an.wilson(F.lit(0), F.lit(0))
    assert tuple(spark.range(1).select(low, high).first()) == (None, None)


def test_missing_source_is_undecided(spark):
    got = spark.range(1).select(ql.answer_in_source(F.lit("x"), F.lit(None).cast("string"))).first()[0]
    assert got == "undecided"


def test_votes_break_ties_by_first_seen(spark):
    v = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4)], "t int, seg string, ord int")
    assert tree.majority_vote(v, ["t"], "seg", "ord").first().seg == "b"
