from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import functions as F

from lectern.sources import ingest, store


SCHEMA = "account string, course string, sub string, v int, body string"


def test_document_table(spark, tmp_path):
    t = store.DocumentTable(spark, str(tmp_path / "t"), SCHEMA)
    assert t.read().count() == 0
    rows = spark.createDataFrame([("1", "c", "s", 1, "a"), ("10", "c", "s", 1, "b"), ("1", "c:x", "s", 1, "bad"), ("007", "c", "s", 1, "agent")], SCHEMA)
    assert [r.reason for r in t.put(rows, ["v"]).collect()] == ["bad course"]
    t.put(spark.createDataFrame([("1", "c", "s", 2, "new"), ("1", "c", "s", 3, "newest")], SCHEMA), ["v"])
    again = store.DocumentTable(spark, str(tmp_path / "t"), SCHEMA)  # another session opens it by its log
    assert sorted((r.account, r.body) for r in again.read().collect()) == [("007", "agent"), ("1", "newest"), ("10", "b")]
    assert [r.body for r in again.get(account="1").collect()] == ["newest"]
    assert [r.body for r in again.get(account="007", course="c").collect()] == ["agent"] and again.get(account="7").count() == 0
    again.remove(spark.createDataFrame([("1", "c", "s")], "account string, course string, sub string"))
    assert sorted(r.account for r in t.read().collect()) == ["007", "10"] and t.get(account="1").count() == 0


def test_a_failed_write_leaves_the_table_as_it_was(spark, tmp_path):
    t = store.DocumentTable(spark, str(tmp_path / "t"), SCHEMA)
    t.put(spark.createDataFrame([("a", "c", "s", 1, "x")], SCHEMA), ["v"])
    broken = spark.createDataFrame([("a", "c", "s", 2, "y")], SCHEMA).withColumn("body", F.expr("raise_error('no')"))
    try:
        t.put(broken, ["v"])
    except Exception as e:  # noqa: BLE001
        assert "no" in str(e)
    assert [(r.account, r.v, r.body) for r in t.read().collect()] == [("a", 1, "x")]


def test_snapshot_reports_bad_lines(spark, tmp_path):
    p = str(tmp_path / "s")
    store.snapshot(spark.createDataFrame([(1, "x"), (2, None)], "id int, t string"), p)
    wrong = ["not json", '{"id": "one", "t": "z"}', '{"id": 3, "t": "z", "n": [1]}', "[1]"]
    (Path(p) / "extra.json").write_text("\n".join([*wrong, '{"t": "no id"}']) + "\n")
    good, bad = store.load_snapshot(spark, p, "id int, t string, n int")
    assert sorted((r.id or 0, r.t) for r in good.collect() if r.t) == [(0, "no id"), (1, "x")] and good.count() == 3
    assert sorted(r.value for r in bad.collect()) == sorted(wrong)


def test_renumbering(spark):
    rows = spark.createDataFrame([(1, "u", 5), (1, "v", 6), (1, "u", 7)], "lesson int, url string, ord int")
    got = [(r.url, r.page) for r in ingest.renumbered(rows, ["lesson"], ["url"], ["ord"]).orderBy("page").collect()]
    assert got == [("u", 1), ("v", 2)]
    assert spark.range(1).select(ingest.total_of(F.lit("n/a"), F.lit("7"))).first()[0] == 7
    assert sys.version_info >= (3, 10)
