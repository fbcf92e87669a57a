"""Queries of growing vocabularies: documents are lessons, the words that their lines begin with are facets, proposed, plain or joined to a seed."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import vocabulary as vo
from lectern.plans.registry import query
from lectern.session import table


def _facets(spark, d):
    """vocabulary (the source), place (document, line) and value of the first word of every line."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    x = table(spark, d, "documents").select(F.coalesce("source", F.lit("")).alias("vocabulary"), "doc_id", F.posexplode(lines).alias("line", "s"))
    word, k = F.regexp_extract("s", "([a-zA-Z]+)", 1), (F.col("doc_id") + F.col("line")) % 5
    value = F.when(k == 0, F.concat(F.lit("新增："), word)).when(k == 1, F.concat(F.lit(" "), word)).when(k == 2, F.concat(F.lit("概念"), word)).when(k == 3, F.concat(F.lit("新增 : 新增:"), F.lower(word), F.lit(" "))).otherwise(F.lower(word))
    return x.select("vocabulary", F.struct("doc_id", "line").alias("place"), value.alias("value"))


_DECIDED = r"""
x AS (SELECT coalesce(source, '') AS vocabulary, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
w AS (SELECT vocabulary, doc_id, line, (doc_id + line) % 5 AS k, regexp_extract(s, '([a-zA-Z]+)', 1) AS word FROM x),
v AS (SELECT *, CASE WHEN k IN (3, 4) THEN lower(word) ELSE word END AS key, k IN (0, 3) AND word <> '' AS proposed, k IN (0, 3) AND word = '' AS hollow FROM w),
f AS (SELECT vocabulary, key, min(doc_id * 10000000 + line) AS first FROM v WHERE proposed GROUP BY vocabulary, key),
j AS (SELECT v.*, CASE WHEN k = 2 THEN 'part' WHEN hollow THEN 'refused' WHEN v.key = '' THEN 'refused' WHEN proposed THEN CASE WHEN doc_id * 10000000 + line = first THEN 'added' ELSE 'again' END WHEN doc_id * 10000000 + line > first THEN 'known' ELSE 'refused' END AS d
  FROM v LEFT JOIN f ON v.vocabulary = f.vocabulary AND v.key = f.key),
j2 AS (SELECT * REPLACE (CASE WHEN k = 2 AND word = '' THEN 'seed' ELSE d END AS d) FROM j)"""


@query("vocabulary_decisions", f"WITH {_DECIDED} SELECT vocabulary, doc_id, line, d AS decision, CASE WHEN k = 2 THEN '概念' WHEN d <> 'refused' THEN key END AS name FROM j2")
def decisions(spark, d):
    """What becomes of every facet of every lesson."""
    return vo.decide(_facets(spark, d)).select("vocabulary", "place.doc_id", "place.line", "decision", "name")


@query("vocabulary_added", f"WITH {_DECIDED} SELECT vocabulary, key AS name, doc_id FROM j2 WHERE d = 'added'")
def added(spark, d):
    """The terms that lessons added, with the lesson."""
    return vo.added_terms(vo.decide(_facets(spark, d))).select("vocabulary", "name", "place.doc_id")


@query("vocabulary_tags", f"""
WITH {_DECIDED}, n AS (SELECT vocabulary, doc_id, line, CASE WHEN k = 2 THEN '概念' WHEN d <> 'refused' THEN key END AS name FROM j2),
u AS (SELECT vocabulary, doc_id, name, min(line) AS l FROM n WHERE name IS NOT NULL GROUP BY ALL), g AS (SELECT vocabulary, doc_id, string_agg(name, '|' ORDER BY l) AS facets FROM u GROUP BY ALL)
SELECT n.vocabulary, n.doc_id, facets, count(*) - count(name) AS refused FROM n LEFT JOIN g ON n.vocabulary = g.vocabulary AND n.doc_id = g.doc_id GROUP BY ALL
""")
def tags(spark, d):
    """The facets of every lesson, in order and each once; none at all where all were refused."""
    got = vo.tag_facets(vo.decide(_facets(spark, d)).withColumn("doc_id", F.col("place.doc_id")), "vocabulary", "doc_id")
    return got.select("vocabulary", "doc_id", F.array_join("facets", "|").alias("facets"), F.size("refused").cast("long").alias("refused"))
