"""Search and tree queries over documents (pages of lines), conversations and web pages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import slide_text as st
from lectern.functions import text
from lectern.operators import search, tree
from lectern.plans.registry import query
from lectern.session import table


def _lines(spark, d):
    """Non-empty trimmed lines of documents: doc_id, ord (from 1), line."""
    x = table(spark, d, "documents").select("doc_id", F.posexplode(F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")).alias("o", "line"))
    return x.select("doc_id", (F.col("o") + 1).alias("ord"), "line")


_LINES = """
ll AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS ls FROM documents),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ord FROM ll)"""


@query("search_literal_ignore_case", """
WITH h AS (SELECT doc_id, text, strpos(lower(text), 'thonre') - 1 AS start FROM documents)
SELECT doc_id, start, (CASE WHEN start > 60 THEN '…' ELSE '' END) || substr(text, greatest(0, start - 60) + 1, least(length(text), start + 66) - greatest(0, start - 60))
   || (CASE WHEN start + 66 < length(text) THEN '…' ELSE '' END) AS preview FROM h WHERE start >= 0
""")
def literal_ignore_case(spark, d):
    f = search.layer(table(spark, d, "documents"), "document", F.col("doc_id"), F.lit(0), F.col("text"))
    return search.literal_hits(f, "THONRE").select(F.col("key").cast("long").alias("doc_id"), "start", "preview")


@query("search_literal_exact", """
SELECT conv_id, count(*) AS hits, list(turn ORDER BY turn) AS turns FROM conversations WHERE strpos(text, 'The ') > 0 GROUP BY conv_id
""")
def literal_exact(spark, d):
    """Case-sensitive search: hits grouped by record, every match listed."""
    f = search.layer(table(spark, d, "conversations"), "turn", F.col("conv_id"), F.col("turn"), F.col("text"))
    hits = search.literal_hits(f, "The ", ignore_case=False)
    return hits.groupBy(F.col("key").cast("long").alias("conv_id")).agg(F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_list("place")).alias("turns"))


_LAYERS = """
f AS (SELECT 'turn' AS layer, CAST(conv_id AS VARCHAR) AS key, turn AS place, text FROM conversations WHERE role = 'user'
      UNION ALL SELECT 'line', CAST(doc_id AS VARCHAR), ord, line FROM lines
      UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), 0, html FROM pages),
h AS (SELECT *, strpos(lower(text), 'ering') - 1 AS start FROM f WHERE strpos(lower(text), 'ering') > 0)"""


def _layered(spark, d):
    turns = search.layer(table(spark, d, "conversations").filter("role = 'user'"), "turn", F.col("conv_id"), F.col("turn"), F.col("text"))
    lines = search.layer(_lines(spark, d), "line", F.col("doc_id"), F.col("ord"), F.col("line"))
    pages = search.layer(table(spark, d, "pages"), "page", F.col("page_id"), F.lit(0), F.col("html"))
    return search.literal_hits(turns.unionByName(lines).unionByName(pages), "ering")


@query("search_layer_counts", f"WITH {_LINES}, {_LAYERS} SELECT layer, count(*) AS found, greatest(0, count(*) - 40) AS omitted FROM h GROUP BY layer")
def layer_counts(spark, d):
    n = F.count(F.lit(1))
    return _layered(spark, d).groupBy("layer").agg(n.alias("found"), F.greatest(F.lit(0), n - search.LIMIT).alias("omitted"))


@query("search_layered_limited", f"""
WITH {_LINES}, {_LAYERS}, c AS (SELECT layer, count(*) AS found FROM h GROUP BY layer),
r AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY key, place) AS n FROM h),
t AS (SELECT * FROM r WHERE n <= 15 ORDER BY CASE layer WHEN 'turn' THEN 0 WHEN 'line' THEN 1 ELSE 2 END, key, place LIMIT 40)
SELECT t.layer, t.key, t.place, t.start, c.found FROM t JOIN c ON t.layer = c.layer
""")
def layered_limited(spark, d):
    return search.limited(_layered(spark, d), {"turn": 0, "line": 1, "page": 2}, limit=15).select("layer", "key", "place", "start", "found")


@query("search_filter_then_scan", """
SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND length(text) > 100 AND strpos(lower(text), 'and') > 0
""")
def filter_then_scan(spark, d):
    c = table(spark, d, "conversations").filter("role = 'assistant'").filter(F.length("text") > 100)
    return c.filter(text.find_literal(F.col("text"), F.lit("AND")) >= 0).select("conv_id", "turn")


@query("search_facet_catalog", """
WITH b AS (SELECT role, list_distinct(list_filter(string_split(lower(text), ' '), lambda w: w IN ('the', 'of', 'la', 'de', 'und'))) AS f FROM conversations)
SELECT 'facet' AS kind, name, count(*) AS n FROM (SELECT unnest(f) AS name FROM b) GROUP BY name
UNION ALL SELECT 'role', role, count(*) FROM b GROUP BY role
""")
def facet_catalog(spark, d):
    facets = F.filter(F.split(F.lower("text"), " "), lambda w: w.isin("the", "of", "la", "de", "und"))
    return search.catalog(table(spark, d, "conversations").select("role", facets.alias("facets")), "facets", "role")


@query("search_fallback_summary", """
WITH t AS (SELECT conv_id, turn, strpos(lower(text), 'thing') > 0 AS hit FROM conversations), b AS (SELECT conv_id, max(CASE WHEN hit THEN 1 ELSE 0 END) AS any_hit FROM t GROUP BY conv_id), s AS (SELECT conv_id FROM conversations WHERE turn = 0 AND strpos(lower(role || ' ' || text), 'a') > 0)
SELECT t.conv_id, t.turn, 'sentence' AS kind FROM t WHERE hit
UNION ALL SELECT conv_id, 0, 'summary' FROM b WHERE any_hit = 0 AND conv_id IN (SELECT conv_id FROM s)
""")
def fallback_summary(spark, d):
    """Sentence hits of a block; its summary counts only where no sentence hits."""
    c = table(spark, d, "conversations").select(
        "conv_id", "turn", (text.find_literal(F.col("text"), F.lit("thing")) >= 0).alias("hit"),
        ((F.col("turn") == 0) & (text.find_literal(F.concat_ws(" ", "role", "text"), F.lit("a")) >= 0)).alias("in_summary"),
    )
    found = c.groupBy("conv_id").agg(F.max("hit").alias("any"), F.max("in_summary").alias("in_summary"))
    summary = found.filter("NOT any AND in_summary").select("conv_id", F.lit(0).cast("long").alias("turn"), F.lit("summary").alias("kind"))
    return c.filter("hit").select("conv_id", "turn", F.lit("sentence").alias("kind")).unionByName(summary)


@query("tree_line_frequency", f"WITH {_LINES} SELECT line, count(DISTINCT doc_id) AS pages FROM lines GROUP BY line HAVING count(DISTINCT doc_id) >= 3")
def line_frequency(spark, d):
    return tree.line_frequency(_lines(spark, d), "line", "doc_id").filter("pages >= 3")


@query("tree_header_statistics", f"""
WITH {_LINES}, p AS (SELECT line, doc_id, min(ord) AS o FROM lines GROUP BY line, doc_id)
SELECT line, count(*) AS pages, sum(CASE WHEN o = 1 THEN 1 ELSE 0 END) / count(*) AS first_ratio, max(doc_id) - min(doc_id) + 1 AS span, count(*) / (max(doc_id) - min(doc_id) + 1) AS density
FROM p GROUP BY line HAVING count(*) >= 2
""")
def header_statistics(spark, d):
    return tree.header_statistics(_lines(spark, d), "line", "doc_id", "ord")


@query("tree_template_class", f"""
WITH {_LINES}, hd AS (SELECT line FROM lines WHERE ord = 1 GROUP BY line HAVING count(DISTINCT doc_id) >= 2),
p AS (SELECT d.doc_id, d.source, max(CASE WHEN hd.line IS NOT NULL THEN 1 ELSE 0 END) AS h, max(CASE WHEN strpos(l.line, '|') > 0 THEN 1 ELSE 0 END) AS s
      FROM documents d LEFT JOIN lines l ON d.doc_id = l.doc_id LEFT JOIN hd ON l.line = hd.line AND l.ord = 1 GROUP BY d.doc_id, d.source),
g AS (SELECT source, count(*) AS pages, sum(h) AS hp, sum(s) AS sp FROM p GROUP BY source)
SELECT source, pages, hp AS header_pages, sp AS shell_pages, CASE WHEN hp / pages >= 0.3 AND sp / pages >= 0.25 THEN 'shellHeavy' WHEN hp / pages >= 0.3 THEN 'header' ELSE 'plain' END AS template FROM g
""")
def template(spark, d):
    lines = _lines(spark, d)
    headers = lines.filter("ord = 1").groupBy("line").agg(F.countDistinct("doc_id").alias("n")).filter("n >= 2").select("line", F.lit(1).alias("is_header"))
    flags = lines.join(headers, "line", "left").groupBy("doc_id").agg(
        F.max(F.when((F.col("ord") == 1) & (F.col("is_header") == 1), 1).otherwise(0)).alias("h"), F.max(F.col("line").contains("|").cast("int")).alias("s")
    )
    docs = table(spark, d, "documents").select("doc_id", "source").join(flags, "doc_id", "left")
    g = docs.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.coalesce("h", F.lit(0))).alias("header_pages"), F.sum(F.coalesce("s", F.lit(0))).alias("shell_pages"))
    return g.withColumn("template", tree.template_class(F.col("pages"), F.col("header_pages"), F.col("shell_pages")))


@query("tree_title_flags", f"WITH {_LINES} SELECT doc_id, ord, {st.rejected_as_title_sql('line')} AS rejected, {st.looks_like_divider_sql('line')} AS divider FROM lines")
def title_flags(spark, d):
    return _lines(spark, d).select("doc_id", "ord", st.rejected_as_title(F.col("line")).alias("rejected"), st.looks_like_divider(F.col("line")).alias("divider"))


@query("tree_titles", f"""
WITH {_LINES}, df AS (SELECT line, count(DISTINCT doc_id) AS pages FROM lines GROUP BY line),
ok AS (SELECT l.*, df.pages, NOT {st.rejected_as_title_sql('line')} AS fine, count_if(NOT contains(line, '|')) OVER (PARTITION BY doc_id) - CASE WHEN contains(line, '|') THEN 0 ELSE count(*) OVER (PARTITION BY doc_id, line) END AS others,
   count_if(length(line) <= 30 AND NOT contains(line, '|')) OVER (PARTITION BY doc_id) - CASE WHEN length(line) <= 30 AND NOT contains(line, '|') THEN count(*) OVER (PARTITION BY doc_id, line) ELSE 0 END AS shorts FROM lines l JOIN df USING (line))
SELECT doc_id, ord, line FROM ok WHERE fine AND (pages >= 2 OR regexp_matches(line, '{st.TITLE_BEGIN}') OR (length(line) <= 30 AND (others = 0 OR shorts = 0)))
""")
def titles(spark, d):
    """Lines that look like titles: not rejected, and on several pages, or begun like one, or the only short line of their page."""
    line, page = F.col("line"), W.partitionBy("doc_id")
    bare = ~line.contains("|")
    # a line too long for a title only counts as one more of its page: its text moves nowhere
    lines = _lines(spark, d).select("doc_id", "ord", F.when(F.length(line) <= st.TITLE_LIMIT, line).alias("line"), bare.alias("bare"), (bare & (F.length(line) <= st.SHORT_LINE)).alias("short"))
    shared = lines.filter("line IS NOT NULL").groupBy("line").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("line", F.lit(2).alias("pages"))  # few lines: those on two pages or more
    same = F.count(F.lit(1)).over(W.partitionBy("doc_id", "line"))
    x = lines.repartition("doc_id").withColumns({"others": F.count_if("bare").over(page) - F.when(F.col("bare"), same).otherwise(0), "shorts": F.count_if("short").over(page) - F.when(F.col("short"), same).otherwise(0)})
    x = x.filter("line IS NOT NULL")
    x = x.filter(~st.rejected_as_title(line)).join(shared, "line", "left")
    return x.filter(st.title_evidence(line, F.coalesce("pages", F.lit(1)), F.col("others"), F.col("shorts"))).select("doc_id", "ord", "line")


_TOPICS = """
topics AS (SELECT conv_id, turn AS topic, CAST((turn * 5) % 17 AS BIGINT) AS lo, CAST((turn * 5) % 17 + 2 + length(text) % 3 AS BIGINT) AS hi FROM conversations),
blocks AS (SELECT conv_id, turn AS block, CAST(length(text) % 20 AS BIGINT) AS page FROM conversations)"""


def _topics(spark, d):
    c = table(spark, d, "conversations")
    lo = (F.col("turn") * 5) % 17
    topics = c.select("conv_id", F.col("turn").alias("topic"), lo.alias("lo"), (lo + 2 + F.length("text") % 3).alias("hi"))
    return topics, c.select("conv_id", F.col("turn").alias("block"), (F.length("text") % 20).cast("long").alias("page"))


@query("tree_interval_attach", f"WITH {_TOPICS} SELECT b.conv_id, block, topic FROM blocks b JOIN topics t ON b.conv_id = t.conv_id AND page BETWEEN lo AND hi")
def interval_attach(spark, d):
    topics, blocks = _topics(spark, d)
    return tree.attach_by_interval(blocks, topics, ["conv_id"], "page", "lo", "hi").select("conv_id", "block", "topic")


@query("tree_nearest_interval", f"""
WITH {_TOPICS}, x AS (SELECT b.conv_id, block, topic, greatest(lo - page, page - hi, 0) AS gap FROM blocks b JOIN topics t ON b.conv_id = t.conv_id),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, block ORDER BY gap, topic) AS n FROM x)
SELECT conv_id, block, gap, topic FROM r WHERE n = 1
""")
def nearest(spark, d):
    topics, blocks = _topics(spark, d)
    return tree.attach_nearest(blocks, topics, ["conv_id"], "block", "page", "lo", "hi", "topic")


@query("tree_outline_expand", f"""
WITH {_TOPICS}, x AS (SELECT conv_id, topic, unnest(range(lo, hi + 1)) AS block FROM topics) SELECT conv_id, block, max(topic) AS topic FROM x GROUP BY conv_id, block
""")
def outline_expand(spark, d):
    topics, _ = _topics(spark, d)
    return tree.expanded_outline(topics, ["conv_id"], "lo", "hi", "topic")


@query("tree_majority_vote", """
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY user_id, event_type),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS k FROM c) SELECT user_id, event_type, n FROM r WHERE k = 1
""")
def vote(spark, d):
    return tree.majority_vote(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


_PAGED = """
pg AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, CASE WHEN event_type <> 'click' THEN event_type END AS title FROM events),
nm AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM pg)"""


def _paged(spark, d):
    page = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("user_id", page.alias("page"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("title"))


@query("tree_merged_runs", f"""
WITH {_PAGED}, w AS (SELECT *, CASE WHEN page = 1 OR coalesce(lag(t) OVER (PARTITION BY user_id ORDER BY page), '') <> coalesce(t, '') THEN 1 ELSE 0 END AS new FROM nm),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM w)
SELECT user_id, run, CAST(min(page) AS INTEGER) AS from_page, CAST(max(page) AS INTEGER) AS to_page, max(t) AS title FROM r GROUP BY user_id, run
""")
def merged_runs(spark, d):
    return tree.merged_runs(_paged(spark, d), "user_id", "page", "title")


@query("tree_chapters", f"""
WITH {_PAGED}, w AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM pg)
SELECT user_id, CAST(page AS INTEGER) AS page, title, CAST(sum(CASE WHEN page = 1 OR page % 50 = 0 OR coalesce(title <> b, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS chapter
FROM w
""")
def chapters(spark, d):
    return tree.chapter_numbers(_paged(spark, d), "user_id", "page", F.col("page") % 50 == 0, "title")


@query("tree_cover_fallback", f"""
WITH {_PAGED}, u AS (SELECT *, coalesce(max(CASE WHEN title IS NOT NULL THEN 1 END) OVER (PARTITION BY user_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS named FROM pg)
SELECT user_id, CAST(min(page) AS INTEGER) AS cover_page, count(*) AS unnamed_prefix FROM u WHERE named = 0 GROUP BY user_id
""")
def cover(spark, d):
    """The unnamed pages before the first title, with the first of them as the cover."""
    w = W.partitionBy("user_id").orderBy("page").rowsBetween(W.unboundedPreceding, 0)
    x = _paged(spark, d).withColumn("named", F.max(F.col("title").isNotNull()).over(w)).filter("NOT named")
    return x.groupBy("user_id").agg(F.min("page").alias("cover_page"), F.count(F.lit(1)).alias("unnamed_prefix"))


@query("tree_totals", f"""
WITH {_TOPICS}, a AS (SELECT t.conv_id, t.topic, count(b.block) AS n FROM topics t LEFT JOIN blocks b ON b.conv_id = t.conv_id AND page BETWEEN lo AND hi GROUP BY t.conv_id, t.topic)
SELECT conv_id, count(*) AS topics, sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS covered, sum(n) AS blocks FROM a GROUP BY conv_id
""")
def totals(spark, d):
    topics, blocks = _topics(spark, d)
    per = topics.join(tree.attach_by_interval(blocks, topics, ["conv_id"], "page", "lo", "hi").groupBy("conv_id", "topic").agg(F.count(F.lit(1)).alias("n")), ["conv_id", "topic"], "left")
    n = F.coalesce("n", F.lit(0))
    return per.groupBy("conv_id").agg(F.count(F.lit(1)).alias("topics"), F.count_if(n > 0).alias("covered"), F.sum(n).alias("blocks"))


@query("tree_clean_lines", f"WITH {_LINES} SELECT doc_id, ord, {st.clean_line_sql('line')} AS line FROM lines")
def clean_lines(spark, d):
    return _lines(spark, d).select("doc_id", "ord", st.clean_line(F.col("line")).alias("line"))
