"""Transcript queries: conversations are lessons of lines, event streams are timed lessons."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import clock, text
from lectern.operators import transcript as tr
from lectern.plans.registry import query
from lectern.session import table


def _timed(spark, d):
    """A user's views are slides (an anchor is missing where the value is under 10), other events are lines."""
    e = table(spark, d, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    views = e.filter("event_type = 'view'")
    page = F.row_number().over(W.partitionBy("user_id").orderBy("ms", "event_id"))
    slides = views.select(F.col("user_id").alias("lesson"), page.alias("page"), F.when(F.col("value") >= 10, F.col("ms")).alias("anchor_ms"))
    lines = e.filter("event_type <> 'view'").select(F.col("user_id").alias("lesson"), "event_id", F.col("ms").alias("start_ms"))
    return slides, lines


_TIMED_SQL = """
e AS (SELECT *, (epoch_us(ts) // 1000) AS ms FROM events),
slides AS (SELECT user_id AS lesson, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS page,
             CASE WHEN value >= 10 THEN (epoch_us(ts) // 1000) END AS anchor_ms FROM events WHERE event_type = 'view'),
lines AS (SELECT user_id AS lesson, event_id, ms AS start_ms FROM e WHERE event_type <> 'view'),
b AS (SELECT lesson, page, anchor_ms,
        last_value(anchor_ms IGNORE NULLS) OVER (PARTITION BY lesson ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s,
        first_value(anchor_ms IGNORE NULLS) OVER (PARTITION BY lesson ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f FROM slides)"""


@query("transcript_anchor_assign", f"""
WITH {_TIMED_SQL},
p AS (SELECT l.event_id, min(b.page) AS page FROM lines l JOIN b ON b.lesson = l.lesson AND (b.f IS NULL OR l.start_ms < greatest(coalesce(b.s, -1), b.f)) GROUP BY l.event_id)
SELECT l.lesson, l.event_id, l.start_ms, CAST(p.page AS INTEGER) AS page FROM lines l LEFT JOIN p ON l.event_id = p.event_id
""")
def anchor_assign(spark, d):
    slides, lines = _timed(spark, d)
    return tr.assign_lines(slides, lines)


@query("transcript_slide_windows", f"""
WITH {_TIMED_SQL}
SELECT lesson, CAST(page AS INTEGER) AS page, anchor_ms, s AS from_ms, f AS to_ms FROM b
""")
def slide_windows(spark, d):
    slides, _ = _timed(spark, d)
    w, back = W.partitionBy("lesson").orderBy("page"), W.partitionBy("lesson").orderBy(F.desc("page"))
    return slides.withColumns({
        "from_ms": F.last("anchor_ms", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)),
        "to_ms": F.last("anchor_ms", ignorenulls=True).over(back.rowsBetween(W.unboundedPreceding, -1)),
    })


@query("transcript_even_split", """
SELECT conv_id, turn, CAST(floor((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) * 3.0 / count(*) OVER (PARTITION BY conv_id)) + 1 AS INTEGER) AS page
FROM conversations
""")
def even_split(spark, d):
    return tr.even_split(table(spark, d, "conversations").select("conv_id", "turn"), F.lit(3), "conv_id", "turn")


_SPANS_SQL = """
t AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, length(text) AS n FROM conversations),
sp AS (SELECT conv_id, turn, CAST(i * 3 + 1 + (CASE WHEN n % 7 = 0 THEN 1 WHEN n % 13 = 0 THEN -1 ELSE 0 END) AS INTEGER) AS f,
         CAST(i * 3 + 3 - (CASE WHEN n % 11 = 0 THEN 3 WHEN n % 5 = 0 THEN 1 ELSE 0 END) AS INTEGER) AS t,
         CAST(count(*) OVER (PARTITION BY conv_id) * 3 AS INTEGER) AS cnt FROM t)"""


def _spans(spark, d):
    """Spans of three sentences for each turn, some of them wrong by rule of the text's length."""
    c = table(spark, d, "conversations")
    i, n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn")) - 1, F.length("text")
    return c.select(
        "conv_id", "turn",
        (i * 3 + 1 + F.when(n % 7 == 0, 1).when(n % 13 == 0, -1).otherwise(0)).alias("from"),
        (i * 3 + 3 - F.when(n % 11 == 0, 3).when(n % 5 == 0, 1).otherwise(0)).alias("to"),
        (F.count(F.lit(1)).over(W.partitionBy("conv_id")) * 3).cast("int").alias("cnt"),
    )


@query("transcript_coverage_issues", f"""
WITH {_SPANS_SQL},
x AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY conv_id ORDER BY turn), 0) + 1 AS e, lead(t) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL AS last FROM sp)
SELECT conv_id, turn, e AS expected, f AS "from", t AS "to",
  CASE WHEN t < f THEN 'reversed' WHEN f < 1 THEN 'below' WHEN t > cnt THEN 'beyond' WHEN f > e THEN 'gap' ELSE 'overlap' END AS issue
FROM x WHERE t < f OR f < 1 OR t > cnt OR f <> e
UNION ALL SELECT conv_id, turn, t + 1, NULL, NULL, 'missing end' FROM x WHERE last AND t <> cnt
""")
def coverage(spark, d):
    return tr.coverage_issues(_spans(spark, d), F.col("cnt"), "conv_id", "turn")


@query("transcript_outline_sanitize", f"""
WITH RECURSIVE {_SPANS_SQL},
o AS (SELECT conv_id, turn, f, t, cnt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM sp),
r AS (
  SELECT conv_id, turn, f, t, cnt, k, (f >= 1 AND t <= cnt AND f <= t) AS kept, CASE WHEN f >= 1 AND t <= cnt AND f <= t THEN t ELSE 0 END AS last FROM o WHERE k = 1
  UNION ALL
  SELECT o.conv_id, o.turn, o.f, o.t, o.cnt, o.k, (o.f >= 1 AND o.t <= o.cnt AND o.f <= o.t AND o.f > r.last),
         CASE WHEN o.f >= 1 AND o.t <= o.cnt AND o.f <= o.t AND o.f > r.last THEN o.t ELSE r.last END
  FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1)
SELECT conv_id, turn, f AS "from", t AS "to", kept FROM r
""")
def outline_sanitize(spark, d):
    per = _spans(spark, d).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "from", "to"))).alias("spans"), F.max("cnt").alias("cnt"))
    return per.select("conv_id", F.explode(tr.folded_outline(F.col("spans"), F.col("cnt"))).alias("x")).select("conv_id", "x.span.turn", "x.span.from", "x.span.to", "x.kept")


def _bins_sql(blocks, chars):
    return f"""
WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
r AS (
  SELECT conv_id, turn, k, 1 AS bin, 1 AS m, n AS c FROM o WHERE k = 1
  UNION ALL
  SELECT o.conv_id, o.turn, o.k, CASE WHEN r.m >= {blocks} OR r.c + o.n > {chars} THEN r.bin + 1 ELSE r.bin END,
    CASE WHEN r.m >= {blocks} OR r.c + o.n > {chars} THEN 1 ELSE r.m + 1 END, CASE WHEN r.m >= {blocks} OR r.c + o.n > {chars} THEN o.n ELSE r.c + o.n END
  FROM r JOIN o ON o.conv_id = r.conv_id AND o.k = r.k + 1)
SELECT conv_id, turn, bin FROM r"""


@query("transcript_greedy_bins", _bins_sql(3, 600))
def bins(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("b"))
    binned = F.arrays_zip(F.col("b.turn").alias("turn"), tr.greedy_bins(F.col("b.n"), 3, 600).alias("bin"))
    return c.select("conv_id", F.explode(binned).alias("x")).select("conv_id", F.col("x.turn").alias("turn"), F.col("x.bin").alias("bin"))


_STITCH_SQL = """
o AS (SELECT user_id, event_id, (epoch_us(ts) // 1000) AS s, (epoch_us(ts) // 1000) + CAST(floor(value) AS BIGINT) * 60000 AS f, CAST(event_id % 4 AS INTEGER) AS page, event_type <> 'error' AS j,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"""


@query("transcript_stitch_blocks", f"""
WITH RECURSIVE {_STITCH_SQL},
r AS (
  SELECT user_id, event_id, k, 1 AS g, page, f AS fin, j FROM o WHERE k = 1
  UNION ALL
  SELECT o.user_id, o.event_id, o.k,
    CASE WHEN r.page <> o.page AND r.j AND o.j AND o.s - r.fin <= 3600000 THEN r.g ELSE r.g + 1 END, o.page,
    CASE WHEN r.page <> o.page AND r.j AND o.j AND o.s - r.fin <= 3600000 THEN greatest(r.fin, o.f) ELSE o.f END,
    CASE WHEN r.page <> o.page AND r.j AND o.j AND o.s - r.fin <= 3600000 THEN r.j ELSE o.j END
  FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1)
SELECT user_id, event_id, g AS block FROM r
""")
def stitch(spark, d):
    e = table(spark, d, "events").withColumn("s", F.unix_millis(F.col("ts").cast("timestamp")))
    per = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("s", "event_id", (F.col("s") + F.floor("value") * 60000).alias("f"), (F.col("event_id") % 4).cast("int").alias("page"), (F.col("event_type") != "error").alias("j")))).alias("b"))
    blocks = F.transform("b", lambda x, i: F.struct((i + 1).alias("from"), (i + 1).alias("to"), x["page"].alias("first_page"), x["page"].alias("last_page"), x["s"].alias("start_ms"), x["f"].alias("end_ms"), x["j"].alias("joinable")))
    z = F.arrays_zip(F.col("b.event_id").alias("event_id"), tr.stitched(blocks, 3_600_000).alias("block"))
    return per.select("user_id", F.explode(z).alias("x")).select("user_id", F.col("x.event_id").alias("event_id"), F.col("x.block").alias("block"))


@query("transcript_tag_merge", """
SELECT c.conv_id, c.turn, coalesce(CASE WHEN l.toxic = 1 THEN 'side' END, c.role) AS role, coalesce(CASE WHEN l.quality = 0 THEN 'short' END, c.text) AS summary
FROM conversations c LEFT JOIN labels l ON c.conv_id = l.doc_id
""")
def tag_merge(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", F.col("text").alias("summary"))
    t = table(spark, d, "labels").select(F.col("doc_id").alias("conv_id"), F.when(F.col("toxic") == 1, "side").alias("role"), F.when(F.col("quality") == 0, "short").alias("summary"))
    return tr.merge_tags(c, t, ["conv_id"], ["role", "summary"])


@query("transcript_edit_guard", r"""
WITH c AS (SELECT conv_id, turn, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS a FROM conversations),
p AS (SELECT conv_id, turn, a, lead(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM c),
q AS (SELECT conv_id, turn, a, b, least(80, greatest(1, CAST(floor(length(a) * 0.8) AS INTEGER))) AS lim, levenshtein(a, b) AS dist FROM p WHERE b IS NOT NULL)
SELECT conv_id, turn, CASE WHEN dist <= lim THEN b ELSE a END AS text, CASE WHEN dist <= lim THEN dist ELSE 0 END AS distance, dist > lim AS rejected FROM q
""")
def edit_guard(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[^A-Za-z ]", "").alias("a"))
    c = c.withColumn("b", F.lead("a").over(W.partitionBy("conv_id").orderBy("turn"))).filter("b IS NOT NULL")
    return c.select("conv_id", "turn", text.guarded_edit(F.col("a"), F.col("b")).alias("g")).select("conv_id", "turn", "g.*")


@query("transcript_glossary", r"""
WITH t AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[^\x{3400}-\x{9fff}A-Za-z0-9]+')) AS term FROM documents)
SELECT term, count(*) AS n, count(DISTINCT doc_id) AS pages FROM t
WHERE length(term) BETWEEN 2 AND 32 AND NOT regexp_matches(term, '^[0-9]+$') AND term NOT IN ('the', 'of', 'and') GROUP BY term HAVING count(*) >= 2
""")
def glossary(spark, d):
    return tr.glossary(table(spark, d, "documents"), "text", "doc_id", 2, ("the", "of", "and"))


@query("transcript_page_gate", """
SELECT page_id, length(trim(regexp_replace(html, '<[^>]*>', '', 'g'))) < 200 AND (strpos(html, 'class="ad"') > 0 OR strpos(html, 'cookie') > 0) AS gated FROM pages
""")
def page_gate(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", tr.page_gate(F.regexp_replace("html", "<[^>]*>", ""), F.col("html"), ('class="ad"', "cookie")).alias("gated"))


@query("transcript_lossless", """
SELECT user_id AS lesson, count(*) AS lines, count(*) AS kept FROM events WHERE event_type <> 'view' GROUP BY user_id
""")
def lossless(spark, d):
    """Every line is kept: assigned plus unassigned lines are the input lines."""
    slides, lines = _timed(spark, d)
    out = tr.assign_lines(slides, lines).groupBy("lesson").agg(F.count(F.lit(1)).alias("kept"))
    return lines.groupBy("lesson").agg(F.count(F.lit(1)).alias("lines")).join(out, "lesson")


@query("transcript_clock_labels", """
SELECT l_orderkey, l_linenumber, (CASE WHEN m < 10 THEN '0' ELSE '' END) || CAST(m AS VARCHAR) || ':' || (CASE WHEN s % 60 < 10 THEN '0' ELSE '' END) || CAST(s % 60 AS VARCHAR) AS label
FROM (SELECT *, s // 60 AS m FROM (SELECT l_orderkey, l_linenumber, greatest(0, CAST(floor((l_extendedprice * 1000 - 2000000) / 1000) AS BIGINT)) AS s FROM lineitem))
""")
def clock_labels(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", clock.minutes_seconds(F.col("l_extendedprice") * 1000 - 2000000).alias("label"))


@query("transcript_input_violations", """
SELECT count(*) AS rows, sum(CASE WHEN value < 0 THEN 1 ELSE 0 END) AS bad_value, count(*) - count(DISTINCT event_id) AS repeated_ids, sum(CASE WHEN ts IS NULL THEN 1 ELSE 0 END) AS no_time FROM events
""")
def violations(spark, d):
    return table(spark, d, "events").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("value") < 0).alias("bad_value"),
        (F.count(F.lit(1)) - F.countDistinct("event_id")).alias("repeated_ids"), F.count_if(F.col("ts").isNull()).alias("no_time"),
    )
