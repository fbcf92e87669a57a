"""Queries of the layered search of lessons: conversations are lessons of blocks of two turns, web pages are their slides."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import search
from lectern.plans.registry import query
from lectern.session import table

NEEDLE, LIMIT = "ser", 6
FACETS = ("the", "de")


def _lesson(spark, d):
    c = table(spark, d, "conversations").withColumn("block", F.floor(F.col("turn") / 2))
    sentences = c.select(F.col("conv_id").alias("lesson"), "block", F.col("turn").alias("ord"), F.when(F.col("role") != "system", F.col("turn")).alias("page"), "text")
    words = F.filter(F.split(F.lower("text"), " "), lambda w: w.isin("the", "of", "la", "de", "und"))
    blocks = c.groupBy(F.col("conv_id").alias("lesson"), "block").agg(
        F.min("turn").alias("page"), F.min_by("role", "turn").alias("role"), F.flatten(F.collect_list(words)).alias("facets"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), " ").alias("summary"),
    )
    pages = table(spark, d, "pages").select(
        F.col("page_id").alias("lesson"), F.lit(1).alias("page"), F.regexp_replace("html", "<[^>]*>", "").alias("page_text"), F.col("html").alias("page_visual"),
        F.coalesce(F.contains("url", F.lit("/de/")), F.lit(False)).alias("failed"), F.coalesce(F.contains("html", F.lit("cookie")), F.lit(False)).alias("gated"),
    )
    spines = table(spark, d, "documents").select(F.col("doc_id").alias("lesson"), "text")
    terms = table(spark, d, "nation").select(F.col("n_nationkey").alias("lesson"), F.lit(1).alias("ord"), F.concat(F.lit("Ser "), F.col("n_name")).alias("term"), F.col("n_regionkey").alias("page"))
    topics = table(spark, d, "part").select(F.col("p_size").alias("lesson"), F.col("p_partkey").alias("topic"), F.lit(None).cast("long").alias("page"), F.col("p_type").alias("title"), F.array("p_name", "p_brand", F.concat(F.lit("user "), F.col("p_name"))).alias("bodies"))
    return blocks, sentences, pages, spines, terms, topics


_DATA = """
c AS (SELECT conv_id AS lesson, turn // 2 AS block, turn, role, text, CASE WHEN role <> 'system' THEN turn END AS page FROM conversations),
b AS (SELECT lesson, block, min(turn) AS page, arg_min(role, turn) AS role, flatten(list(list_filter(string_split(lower(text), ' '), lambda w: w IN ('the', 'of', 'la', 'de', 'und')))) AS facets, string_agg(role, ' ' ORDER BY turn) AS summary FROM c GROUP BY lesson, block),
pg AS (SELECT page_id AS lesson, 1 AS page, trim(regexp_replace(html, '<[^>]*>', '', 'g')) AS page_text, trim(html) AS page_visual, contains(url, '/de/') AS failed, contains(html, 'cookie') AS gated FROM pages),
tm AS (SELECT n_nationkey AS lesson, 1 AS ord, 'Ser ' || n_name AS term, n_regionkey AS page FROM nation),
tp AS (SELECT p_size AS lesson, p_partkey AS topic, p_type AS title, [p_name, p_brand, 'user ' || p_name] AS bodies FROM part)"""


def _counted(hits: str) -> str:
    return f"""
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lesson, branch ORDER BY pos) AS k FROM ({hits})) WHERE k <= {LIMIT}),
n AS (SELECT *, count(*) OVER (PARTITION BY lesson, layer) AS in_layer, greatest(0, count(*) OVER (PARTITION BY lesson) - {LIMIT}) AS omitted, row_number() OVER (PARTITION BY lesson ORDER BY branch, pos) AS n FROM k)
SELECT lesson, layer, branch, array_to_string(pos, '.') AS place, page, sha256(text) AS digest, start, in_layer, omitted FROM n WHERE n <= {LIMIT}"""


def _hit(layer: str, branch: int, at: str, page: str, text: str, source: str, more: str = "true") -> str:
    return f"SELECT lesson, '{layer}' AS layer, {branch} AS branch, {at} AS pos, {page} AS page, {text} AS text, strpos(lower({text}), '{NEEDLE}') - 1 AS start FROM {source} WHERE strpos(lower({text}), '{NEEDLE}') > 0 AND {more}"


def _said(blocks: str) -> str:
    told = f"SELECT c.lesson, 'teacher' AS layer, 1 AS branch, [c.block, 0, turn] AS pos, coalesce(c.page, b.page) AS page, c.text, strpos(lower(c.text), '{NEEDLE}') - 1 AS start FROM c JOIN {blocks} b ON c.lesson = b.lesson AND c.block = b.block WHERE strpos(lower(c.text), '{NEEDLE}') > 0"
    return told + " UNION ALL " + _hit("final", 1, "[block, 1, 0]", "page", "summary", blocks, f"(lesson, block) NOT IN (SELECT lesson, block FROM c WHERE strpos(lower(text), '{NEEDLE}') > 0)")


_OTHERS = [
    _hit("outline", 2, "[-1, 0, 0]", "NULL", "trim(text)", "(SELECT doc_id AS lesson, text FROM documents)"),
    _hit("glossary", 3, "[ord, 0, 0]", "page", "term", "tm"),
    _hit("lecture", 4, "[topic, 0, 0]", "NULL", "title", "tp"),
]
_BODIES = [
    _hit("pageText", 2, "[page, 0, 0]", "page", "page_text", "pg", "NOT failed"),
    _hit("pageVisual", 2, "[page, 1, 0]", "page", "page_visual", "pg", "NOT failed AND NOT gated"),
    _hit("lecture", 4, "[topic, 1, i]", "NULL", "body", "(SELECT lesson, topic, unnest(bodies) AS body, generate_subscripts(bodies, 1) - 1 AS i FROM tp)"),
]
_PASSING = f"(SELECT * FROM b WHERE role = 'user' AND list_has_any(facets, [{', '.join(repr(x) for x in FACETS)}]))"


def _run(spark, d, **how):
    found = search.search_lessons(*_lesson(spark, d), limit=LIMIT, **how)
    return found.select("lesson", "layer", "branch", F.array_join(F.transform("at", lambda x: x.cast("string")), ".").alias("place"), "page", F.sha2("text", 256).alias("digest"), "start", "in_layer", "omitted")


@query("search_title_body", f"WITH {_DATA}, {_counted(' UNION ALL '.join([_said('b'), *_OTHERS, *_BODIES]))}")
def title_body(spark, d):
    """The default mode: filters do not hold."""
    return _run(spark, d, query=" SER ", mode="unknown", role="user", facets=FACETS)


@query("search_title_only", f"WITH {_DATA}, {_counted(' UNION ALL '.join([_hit('final', 1, '[block, 1, 0]', 'page', 'summary', 'b'), *_OTHERS]))}")
def title_only(spark, d):
    return _run(spark, d, query=NEEDLE, mode=search.TITLE_ONLY)


@query("search_tag_filter", f"WITH {_DATA}, {_counted(_said(_PASSING))}")
def tag_filter(spark, d):
    """Role and any facet first, then the query; layers without tags are left out."""
    return _run(spark, d, query=NEEDLE, mode=search.TAG_FILTER, role="user", facets=FACETS)


@query("search_filter_only", f"WITH {_DATA}, {_counted(f'SELECT lesson, {chr(39)}final{chr(39)} AS layer, 1 AS branch, [block, 1, 0] AS pos, page, summary AS text, CAST(NULL AS INTEGER) AS start FROM {_PASSING}')}")
def filter_only(spark, d):
    return _run(spark, d, mode=search.TAG_FILTER, role="user", facets=FACETS)


@query("search_chosen_layers", f"WITH {_DATA}, {_counted(' UNION ALL '.join([_OTHERS[1], _BODIES[0]]))}")
def chosen_layers(spark, d):
    return _run(spark, d, query=NEEDLE, layers=("pageText", "glossary", "rag"))


@query("search_layer_registry", f"""
SELECT id, source, available, unasked, source IS NOT NULL AS known FROM (SELECT DISTINCT event_type AS id FROM events UNION ALL VALUES {', '.join(f"('{x[0]}')" for x in search.LAYERS)}) a
LEFT JOIN (VALUES {', '.join(f"('{i}', '{s}', {a}, {u})" for i, s, a, u in search.LAYERS)}) r(id, source, available, unasked) USING (id)
""")
def layer_registry(spark, d):
    asked = table(spark, d, "events").select(F.col("event_type").alias("id")).distinct().unionByName(search.layer_table(spark).select("id"))
    return search.layers_named(asked, spark)


@query("search_layer_signature", "SELECT user_id, string_agg(DISTINCT event_type, '+' ORDER BY event_type) AS signature FROM events GROUP BY user_id")
def layer_signature(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(search.layer_signature(F.collect_set("event_type")).alias("signature"))
