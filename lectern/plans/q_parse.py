"""Queries of the lesson parser as a whole: event streams are lessons with answers of every kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import lesson_parse as lp
from lectern.plans.q_transcript import _TIMED_SQL, _timed
from lectern.plans.registry import query
from lectern.session import table


def _lesson(spark, d):
    """Odd pages answer in two blocks, every fifth in blocks that leave a gap, others with corrected lines only."""
    slides, lines = _timed(spark, d)
    words = table(spark, d, "events").select("event_id", F.concat(F.col("event_type"), F.lit(" at value "), F.floor("value").cast("string")).alias("text"))
    lines = lines.join(words, "event_id").select("lesson", F.col("event_id").alias("line"), "start_ms", (F.col("start_ms") + 5000).alias("end_ms"), "text")
    p = F.col("page")
    raw = F.when(p % 5 == 0, "块 1\n块 3-4").when(p % 2 == 1, "1. click at valve 7\n块 1 衔接：转到\n块 2-3").otherwise("2. 正文：something else altogether here 衔接：so")
    return slides, lines, slides.select("lesson", "page", raw.alias("raw"))


_PARSE = f"""
{_TIMED_SQL},
lp AS (SELECT l.event_id, min(b.page) AS page FROM lines l JOIN b ON b.lesson = l.lesson AND (b.f IS NULL OR l.start_ms < greatest(coalesce(b.s, -1), b.f)) GROUP BY l.event_id),
lx AS (SELECT l.lesson, l.event_id AS line, l.start_ms, l.start_ms + 5000 AS end_ms, lp.page, event_type || ' at value ' || CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS raw FROM lines l JOIN e ON l.event_id = e.event_id LEFT JOIN lp ON l.event_id = lp.event_id),
s0 AS (SELECT *, row_number() OVER (PARTITION BY lesson, page ORDER BY start_ms, line) AS n, row_number() OVER (PARTITION BY lesson ORDER BY page, start_ms, line) AS number, count(*) OVER (PARTITION BY lesson, page) AS cnt FROM lx WHERE page IS NOT NULL),
s1 AS (SELECT *, CASE WHEN page % 5 = 0 THEN NULL WHEN page % 2 = 1 AND n = 1 THEN 'click at valve 7' WHEN page % 2 = 0 AND n = 2 THEN 'something else altogether here' END AS att FROM s0),
s2 AS (SELECT *, levenshtein(replace(raw, ' ', ''), replace(att, ' ', '')) AS dist, least(80, greatest(1, CAST(floor(length(replace(raw, ' ', '')) * 0.8) AS INTEGER))) AS lim FROM s1),
s3 AS (SELECT *, att IS NOT NULL AND dist > lim AS rejected FROM s2),
pg AS (SELECT lesson, page, min(number) AS first, min(cnt) AS cnt, bool_or(rejected) AS rej FROM s3 GROUP BY lesson, page),
dr AS (SELECT lesson, page, first, cnt, page % 5 <> 0 AND page % 2 = 1 AND cnt = 3 AS two, NOT (page % 5 <> 0 AND (page % 2 = 0 OR cnt = 3)) AS bad, rej FROM pg),
bk AS (SELECT lesson, page, first AS f, first AS t, true AS opens FROM dr WHERE two UNION ALL SELECT lesson, page, first + 1, first + 2, false FROM dr WHERE two UNION ALL SELECT lesson, page, first, first + cnt - 1, false FROM dr WHERE NOT two),
bt AS (SELECT bk.lesson, bk.page, f, t, opens, min(s3.start_ms) AS s, max(s3.end_ms) AS fin FROM bk JOIN s3 ON bk.lesson = s3.lesson AND s3.number BETWEEN f AND t GROUP BY ALL),
bo AS (SELECT *, row_number() OVER (PARTITION BY lesson ORDER BY f) AS k FROM bt),
"""
_FOLD = """
r AS (
  SELECT lesson, k, 1 AS g, page, f, t, s, fin AS own, fin FROM bo WHERE k = 1
  UNION ALL
  SELECT bo.lesson, bo.k, CASE WHEN r.page <> bo.page AND NOT bo.opens AND bo.s - r.fin <= 15000 THEN r.g ELSE r.g + 1 END, bo.page, bo.f, bo.t, bo.s, bo.fin,
    CASE WHEN r.page <> bo.page AND NOT bo.opens AND bo.s - r.fin <= 15000 THEN greatest(r.fin, bo.fin) ELSE bo.fin END
  FROM r JOIN bo ON bo.lesson = r.lesson AND bo.k = r.k + 1),
g AS (SELECT lesson, g AS block, min(f) AS "from", max(t) AS "to", arg_min(page, f) AS first_page, arg_max(page, f) AS last_page, arg_min(s, f) AS start_ms, max(own) AS end_ms FROM r GROUP BY lesson, g)"""


@query("parse_lesson_sentences", f"WITH {_PARSE.rstrip().rstrip(',')} SELECT lesson, number, page, line, CASE WHEN att IS NOT NULL AND NOT rejected THEN att ELSE raw END AS text, CASE WHEN att IS NOT NULL AND NOT rejected THEN dist ELSE 0 END AS distance, rejected FROM s3")
def parse_sentences(spark, d):
    return lp.parse(*_lesson(spark, d))[0]


@query("parse_lesson_blocks", f"WITH RECURSIVE {_PARSE} {_FOLD} SELECT * FROM g")
def parse_blocks(spark, d):
    return lp.parse(*_lesson(spark, d))[1]


@query("parse_lesson", f"""
WITH RECURSIVE {_PARSE} {_FOLD}, c AS (SELECT lesson, count(*) AS lines, count(page) AS sentences FROM lx GROUP BY lesson),
fp AS (SELECT lesson, list(page ORDER BY page) FILTER (bad OR rej) AS failed_pages FROM dr GROUP BY lesson), n AS (SELECT lesson, count(*) AS blocks, sum("to" - "from" + 1) AS inb FROM g GROUP BY lesson)
SELECT c.lesson, lines, sentences, coalesce(blocks, 0) AS blocks, CASE WHEN fp.lesson IS NULL THEN NULL ELSE coalesce(failed_pages, []) END AS failed_pages, coalesce(inb, 0) = sentences AS lossless, sentences < lines OR coalesce(len(failed_pages), 0) > 0 AS partial
FROM c LEFT JOIN n ON c.lesson = n.lesson LEFT JOIN fp ON c.lesson = fp.lesson
""")
def parse_lesson(spark, d):
    """Lines in, lines out: sentences, blocks and failed pages of each lesson."""
    return lp.parse(*_lesson(spark, d))[2]
