"""Growing vocabularies against a plain loop over lessons, in a batch and as a stream."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from lectern.operators import vocabulary as vo


def loop(rows, seed=vo.SEED, known=()):
    """(decision, name) by place, one row after another."""
    names, aliases, out = {}, {}, {}
    old = {(v, name) for v, name, _ in known}
    for v, name, al in known:
        names.setdefault(v, set()).add(name)
        for a in al:
            aliases[v, a] = min(name, aliases.get((v, a), name))
    for v, place, value in sorted(rows, key=lambda r: r[1]):
        s, mine = (value or "").strip(), names.setdefault(v, set())
        m = re.match(vo.PROPOSAL, s)
        part = next((x for x in seed if x in s), None)
        new = m[1].strip() if m and not part else None
        if s == "":
            got = ("refused", None)
        elif s in seed:
            got = ("seed", s)
        elif (v, s) in old and new is None:
            got = ("known", s)
        elif (v, s) in aliases:
            got = ("alias", aliases[v, s])  # of a term from before, which stands in front of those added since
        elif s in mine and new is None:
            got = ("known", s)
        elif part:
            got = ("part", part)
        elif new is not None:
            got = ("again" if new in mine else "added", new)
            mine.add(new)
        else:
            got = ("refused", None)
        out[place] = got
    return out, {(v, n) for v, ns in names.items() for n in ns}


def rows_of(n, seed=1):
    rng = random.Random(seed)
    words = ["a", "b", "cc", "法则", "新概念", "d e", "", " ", "f:g", "新增", "新增：", "新增: 概念x"]
    out = []
    for i in range(n):
        w = rng.choice(words)
        out.append((rng.choice("xy"), i, rng.choice([w, f"新增：{w}", f" 新增 : {w} ", f"新增：新增：{w}", None if rng.random() < 0.1 else w])))
    return out


def test_batch_is_the_loop(spark):
    known = [("x", "k", ["b", "kk"]), ("x", "cc", []), ("y", "z", ["a"]), ("y", "q", ["a"])]
    rows = rows_of(400) + [("x", 1000, "kk"), ("x", 1001, "k"), ("x", 1002, "新增：k")]
    df = spark.createDataFrame(rows, "vocabulary string, place long, value string")
    for k in ((), known):
        terms = spark.createDataFrame(k, "vocabulary string, name string, aliases array<string>") if k else None
        got = {r.place: (r.decision, r.name) for r in vo.decide(df, known=terms).collect()}
        assert got == loop(rows, known=k)[0]
    assert vo.decide(df.limit(0)).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = rows_of(300, 7)
    for i in range(0, 300, 60):  # lessons arrive in order, a file each
        spark.createDataFrame(rows[i : i + 60], "vocabulary string, place long, value string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    kept = vo.VocabularyTable(spark, f"{tmp_path}/terms", "long")
    stream = spark.readStream.schema("vocabulary string, place long, value string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")

    def each(df, n):
        kept.grow(df, n)
        kept.grow(df, n)  # a batch that runs again adds nothing twice

    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination(200)
    assert q.exception() is None
    got = [(r.vocabulary, r.name) for r in kept.terms().collect()]
    assert sorted(got) == sorted(loop(rows)[1])
    batch = vo.added_terms(vo.decide(spark.createDataFrame(rows, "vocabulary string, place long, value string")))
    assert sorted((r.vocabulary, r.name) for r in batch.collect()) == sorted(got)


def test_tags_and_stored_terms(spark):
    rows = [("x", 1, 1, "新增：n"), ("x", 1, 2, "zz"), ("x", 1, 3, "n"), ("x", 2, 4, "zz"), ("x", 3, 5, "法则")]
    df = spark.createDataFrame(rows, "vocabulary string, block int, place int, value string")
    got = {r.block: (r.facets, r.refused) for r in vo.tag_facets(vo.decide(df), "block").collect()}
    assert got == {1: (["n"], ["zz"]), 2: (None, ["zz"]), 3: (["法则"], [])}
    raw = spark.createDataFrame([("x", '{"terms": [{"name": "n", "aliases": ["m"]}]}'), ("y", None)], "vocabulary string, stored string")
    terms = vo.stored_terms(raw, ("s",))
    assert sorted((r.vocabulary, r.name, r.aliases) for r in terms.collect()) == [("x", "n", ["m"]), ("x", "s", []), ("y", "s", [])]
    one = spark.createDataFrame([("x", 1, "m"), ("y", 2, "m")], "vocabulary string, place int, value string")
    assert {(r.vocabulary, r.decision, r.name) for r in vo.decide(one, ("s",), terms).withColumn("n", F.lit(1)).collect()} == {("x", "alias", "n"), ("y", "refused", None)}


def test_marks_without_a_name_propose_nothing(spark):
    rows = [("x", i, v) for i, v in enumerate(["新增：", "新增 : 新增: ", "新增:新增：新增 :", "新增：新增：n", "新增 : 新增:"])]
    got = vo.decide(spark.createDataFrame(rows, "vocabulary string, place int, value string")).orderBy("place").collect()
    assert [(r.decision, r.name) for r in got] == [("refused", None)] * 3 + [("added", "n"), ("refused", None)]
