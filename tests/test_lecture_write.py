"""Written lectures: how often answers are read, and what becomes of each topic of a request."""

from __future__ import annotations

import pytest

from lectern.operators import lecture_write as lw


@pytest.mark.parametrize("name", ["lecture_failures", "lecture_assembled"])
def test_answers_are_read_once(spark, name):
    """One step of the plan reads the answers."""
    from lectern.plans import all_queries

    plan = all_queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("parse" in line.lower() for line in plan.splitlines()) <= 2  # the answers are a union of two tables


def test_requests_answered_in_every_way(spark):
    """A topic named twice, one of another request, none back, an unread request; each told once."""
    topics = spark.createDataFrame([(1, 1, t, "t", t, t) for t in (1, 2, 3)], "deck int, chapter int, topic int, title string, from_page int, to_page int")
    blocks = spark.createDataFrame([(1, 1, t, t, t, 0, f"words of topic {t} as they were said", "") for t in (1, 2, 3)], "deck int, chapter int, topic int, block int, page int, start_ms long, text string, summary string")

    def said(*ts):
        return '{"chapters": [{"c": 1, "topics": [' + ", ".join(f'{{"t": {t}, "passages": ["Words of topic {t} as they were written."]}}' for t in ts) + "]}]}"

    answers = spark.createDataFrame([(1, 1, 1, "no answer"), (1, 1, 2, said(1, 3, 1)), (1, 1, 3, said(2)), (1, 2, 1, said(1)), (1, 2, 2, "")], "deck int, part int, attempt int, raw string")
    lecture, failures, _ = lw.assemble(topics, blocks, answers, 2, 0)
    assert sorted((r.topic, r.register) for r in lecture.collect()) == [(1, "written"), (2, "failed"), (3, "failed")]
    assert sorted((r.part, r.topic or 0, r.code) for r in failures.collect()) == [(1, 1, "REPEATED"), (1, 2, "NOT_RETURNED"), (1, 3, "FOREIGN"), (2, 0, "EMPTY")]
