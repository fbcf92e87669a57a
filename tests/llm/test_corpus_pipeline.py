from __future__ import annotations

from collections import Counter

import duckdb
import pytest
from test_llm_operators import brute_components, brute_leaks

import corpus_pipeline
from lectern.llm import registry
from lectern.llm.common import durable

DIR = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, DIR), "test-stage")
        kept = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and kept <= ids and len(kept) > 0.7 * len(ids), name
        ids = kept
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, DIR)
    rows = mixed.select("doc_id", "mix_copy", "mix_copies", "mix_size").collect()
    assert {r.doc_id for r in rows} <= ids
    assert len(rows) == len({(r.doc_id, r.mix_copy) for r in rows}) and max(r.mix_copies for r in rows) <= 2
    total = sum(len((r.text or "").split()) for r in docs.collect())
    assert sum(r.mix_size for r in rows) == pytest.approx(1.5 * total, rel=0.05)


def awkward(spark, rows):
    """documents with an extra column whose name a stage adds itself."""
    full = [(i, t, "en", s, len(t or ""), 7) for i, t, s in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, mix_size int").repartition(3)


def left(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_exact_stage_with_repeated_and_missing_ids(spark):
    rows = [(1, "a a", "s"), (1, "a a", "s"), (2, "aa", "s"), (2, "unique text", "s"), (None, "aa", "s"), (None, "other", "s"), (None, "other", "s"), (5, None, "s"), (4, "", "s"), (None, " ", "s")]
    got = left(STAGE["exact dedup"](spark, awkward(spark, rows), DIR))
    assert got == Counter({(1, "a a"): 1, (2, "unique text"): 1, (None, "other"): 1, (None, " "): 1})
    assert STAGE["exact dedup"](spark, awkward(spark, []), DIR).count() == 0


def test_near_stage_against_brute_force(spark):
    base = [f"w{i}" for i in range(40)]
    a, b = " ".join(base), " ".join([*base[:39], "new"])
    far = " ".join(f"v{i}" for i in range(30))
    rows = [(2, a, "s"), (None, b, "s"), (1, b + " z", "s"), (1, far, "s"), (3, far, "s"), (3, far, "s"), (None, far + " y", "s"), (7, None, "s"), (7, None, "s"), (8, "one", "s"), (9, "one", "s"), (None, "x y", "s"), (None, "x y", "s")]
    got = left(STAGE["n-gram Jaccard join"](spark, awkward(spark, rows), DIR))
    places = brute_components([(k, t) for k, (_, t, _) in enumerate(rows)])
    want = Counter()
    for root in {c for _, c in places.values()}:
        members = [k for k, (_, c) in places.items() if c == root]
        best = min(members, key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
        want[rows[best][0], rows[best][1]] += 1
    assert got == want and got[7, None] == 2
    assert STAGE["n-gram Jaccard join"](spark, awkward(spark, []), DIR).count() == 0


def test_leak_stage_against_brute_force(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    leak = items[3][1]
    rows = [(1, "clean text of some words", "s"), (1, "before " + leak, "s"), (None, leak + " after", "s"), (None, "also clean", "s"), (2, None, "s"), (3, "", "s"), (4, leak, "s"), (4, leak, "s")]
    bad = {k for k, _ in brute_leaks([(k, t) for k, (_, t, _) in enumerate(rows)], items)}
    got = left(STAGE["benchmark decontamination"](spark, awkward(spark, rows), DIR))
    assert got == Counter((i, t) for k, (i, t, _) in enumerate(rows) if k not in bad) and len(bad) == 4


def test_quality_stage_judges_each_row_by_its_text(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    some = [r.text for r in docs.filter("lang = 'en' AND length(text) > 400").orderBy("doc_id").limit(40).collect()]
    junk = "zq xv ## " * 200
    rows = [(None, t, "s") for t in some] + [(None, junk, "s"), (10**9, some[0], "s"), (10**9, junk, "s"), (10**9 + 1, None, "s"), (10**9 + 2, " ", "s")]
    extra = awkward(spark, rows).drop("mix_size").select(docs.columns)
    got = left(STAGE["quality classifier"](spark, docs.unionByName(extra), DIR).filter("doc_id IS NULL OR doc_id >= 1000000000"))
    assert not any(t in (junk, None, " ") for _, t in got)
    assert sum(n for (i, _), n in got.items() if i is None) >= 36


def test_mix_stage_keeps_every_row(spark):
    rows = [(k % 50 or None, " ".join(["w"] * (1 + k % 17)), "abc"[k % 3]) for k in range(600)] + [(None, "same text", "d")] * 40 + [(1, None, "a"), (None, "", None)]
    got = STAGE["mixing sources"](spark, awkward(spark, rows), DIR)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken", "mix_copy"]
    found, have = Counter(), Counter((i, t, s) for i, t, s in rows)
    words, targets, seen = Counter(), {}, set()
    for r in got.collect():
        found[r.doc_id, r.text, r.source] += 1
        words[r.source] += len(r.text.split())
        targets[r.source] = r.mix_target
        seen.add((r.doc_id, r.text, r.source, r.mix_copy))
    assert len(seen) == sum(found.values())
    assert all(found[k] <= 2 * have[k] for k in found) and any(i is None for i, _, _ in found)
    assert all(abs(words[s] - targets[s]) <= 20 for s in targets) and set(targets) == {"a", "b", "c", "d"}
    assert STAGE["mixing sources"](spark, awkward(spark, []), DIR).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    found = con.execute(registry.ORACLE[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == want
