"""Builders, labels and decisions on records: every part takes one of the samples, whose results are stated beside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import labels as lb
from lectern.functions import protocol as pr
from lectern.plans.registry import query
from lectern.session import dealt, table


def _quoted(x) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)


def _expected(names: str, samples: tuple, types: str = "") -> str:
    """DuckDB text: each part with what is stated for its sample."""
    rows = ", ".join("(" + ", ".join(map(_quoted, (i, *s[-1]))) + ")" for i, s in enumerate(samples))
    cast = dict(x.split(":") for x in types.split()) if types else {}
    columns = ", ".join(f"CAST(e.{n} AS {cast[n]}) AS {n}" if n in cast else f"e.{n}" for n in names.split())
    return f"SELECT p_partkey, {columns} FROM part JOIN (VALUES {rows}) e(i, {', '.join(names.split())}) ON p_partkey % {len(samples)} = e.i"


def _sampled(spark, d, samples: tuple, schema: str):
    rows = spark.createDataFrame([(i, *s[:-1]) for i, s in enumerate(samples)], f"i int, {schema}")
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % len(samples)).cast("int").alias("i"))
    return dealt(parts, "p_partkey").join(F.broadcast(rows), "i")


LINKS = (
    ("c1", "s2", 65, 3, "a1", None, ("c1/s2", "/note?course=c1&section=s2", "[01:05](zy://section/c1/s2?t=65)", "[第 3 页](zy://section/c1/s2?page=3)", "![插图](zy-asset://a1)", "/courses/c1/section/s2?page=3&t=65")),
    ("c", "s", -4, 0, "x", "", ("c/s", "/note?course=c&section=s", "[00:00](zy://section/c/s?t=-4)", "[第 0 页](zy://section/c/s?page=0)", "![](zy-asset://x)", "/courses/c/section/s")),
    ("课", "节", 6000, 12, "i", "图", ("课/节", "/note?course=课&section=节", "[100:00](zy://section/课/节?t=6000)", "[第 12 页](zy://section/课/节?page=12)", "![图](zy-asset://i)", "/courses/课/section/节?page=12&t=6000")),
    ("c", "s", 0, 1, "i", "a", ("c/s", "/note?course=c&section=s", "[00:00](zy://section/c/s?t=0)", "[第 1 页](zy://section/c/s?page=1)", "![a](zy-asset://i)", "/courses/c/section/s?page=1&t=0")),
)


@query("notes_link_builders", _expected("key route time_link page_link asset_link player", LINKS))
def link_builders(spark, d):
    c, s, at, page = (F.col(x) for x in ("course", "section", "at", "page"))
    return _sampled(spark, d, LINKS, "course string, section string, at int, page int, asset string, alt string").select(
        "p_partkey", lb.note_key(c, s).alias("key"), lb.note_route(c, s).alias("route"), lb.time_link(c, s, at).alias("time_link"), lb.page_link(c, s, page).alias("page_link"),
        lb.asset_link(F.col("asset"), F.col("alt")).alias("asset_link"), lb.player_route(c, s, page, at).alias("player"),
    )


MEDIA_HOST = "media.example.org"
NOW = 1_700_000_000_000  # 2023-11-14 22:13:20 in UTC, the 15th in China
IDS = (
    ("sec", 3, "r1", "http://media.example.org/a?b=http:", NOW - 30_000, " \n", ("sec#b3@r1", "https://media.example.org/a?b=http:", "刚刚", False)),
    (None, 0, None, "http://other.cn/media.example.org", NOW - 59 * 60_000, "x", ("#b0@", "http://other.cn/media.example.org", "59 分钟前", True)),
    ("s", 1, "", "HTTP://media.example.org:80", NOW - 23 * 3_600_000, None, ("s#b1@", "https://media.example.org:80", "23 小时前", False)),
    ("s", 1, "r", "https://media.example.org/x", NOW - 6 * 86_400_000, " a ", ("s#b1@r", "https://media.example.org/x", "6 天前", True)),
    ("s", 2, "r", "ftp://x", NOW - 7 * 86_400_000, "", ("s#b2@r", "ftp://x", "11月8日", False)),
    ("s", 2, "r", "x", 0, "\t", ("s#b2@r", "x", "", False)),
)


@query("labels_ids_urls_ages", _expected("material url age content", IDS))
def ids_urls_ages(spark, d):
    x = _sampled(spark, d, IDS, "section string, block int, revision string, url string, at long, body string")
    return x.select(
        "p_partkey", lb.material_id(F.col("section"), F.col("block"), F.col("revision")).alias("material"), lb.resource_url(F.col("url"), MEDIA_HOST).alias("url"),
        lb.relative_label(F.col("at"), F.lit(NOW)).alias("age"), lb.has_content(F.col("body")).alias("content"),
    )


KINDS = (
    ("讲解", " 小 标题。", "elaboration", "some text", "no rubric here", ("elaboration", "小 标题", "rubric")),
    ("定理", "定义", "definition", "", "Give a Scoring Guide", ("definition", "", "scoring guide")),
    ("example", "牛顿定律", "example", "牛顿定律。再说", "compare the two", ("example", "", None)),
    (" 实验 ", "一" * 21, "procedure", "x", "满分十分", ("procedure", "", "满分")),
    ("other", "what? 是。否", "note", "x", None, (None, "", None)),
    (None, "例题", "note", "x", "", (None, "例题", None)),
)


@query("labels_kinds_titles_rubrics", _expected("kind subtitle rubric", KINDS))
def kinds(spark, d):
    x = _sampled(spark, d, KINDS, "raw string, title string, own string, body string, instruction string")
    return x.select("p_partkey", lb.block_kind(F.col("raw")).alias("kind"), lb.subtitle(F.col("title"), F.col("own"), F.col("body")).alias("subtitle"), lb.rubric_phrase(F.col("instruction")).alias("rubric"))


ATTEMPTS = (
    ("a1", "correct", "again", "2024-01-02T03:04:05Z", "ok", "ok", (None, True, None, "again")),
    (" ", "correct", None, "2024-01-02T03:04:05Z", "noFile", "ok", ("no id", True, None, None)),
    ("a2", "maybe", None, "2024-01-02", "corrupt", "ioError", ("unknown verdict", False, "repair", None)),
    ("a3", "unknown", "soso", "2024-01-02", "ioError", "ok", ("unknown recall", False, "retry", "soso")),
    ("a4", "incorrect", "easy", "tomorrow", "pathBlocked", "ioError", ("bad time", False, "move", "easy")),
    (None, None, None, None, None, "ok", ("no id", False, None, None)),
)


@query("quiz_attempt_decoding", _expected("problem writable remedy rating", ATTEMPTS))
def attempts(spark, d):
    """Rejects with their reason; what the store says; the rating that schedules is the learner's own."""
    x = _sampled(spark, d, ATTEMPTS, "ident string, auto string, recall string, at string, items string, tries string")
    return x.select(
        "p_partkey", lb.attempt_problem(F.col("ident"), F.col("auto"), F.col("recall"), F.col("at")).alias("problem"), lb.store_writable(F.col("items"), F.col("tries")).alias("writable"),
        lb.store_remedy(F.col("items"), F.col("tries")).alias("remedy"), F.col("recall").alias("rating"),
    )


ANCHORS = (
    (3, 7, 61.0, 3.0, 7.0, 61.5, ("",)),
    (3, 7, 61.0, 4.0, 8.0, 62.0, ("block|page|time",)),
    (3, 7, 61.0, None, None, None, ("",)),
    (3, 7, 61.0, 3.9, 6.9, 60.4, ("page|time",)),
)


@query("quiz_anchor_claims", _expected("warnings", ANCHORS))
def anchor_claims(spark, d):
    x = _sampled(spark, d, ANCHORS, "block int, page int, at double, claimed_block double, claimed_page double, claimed_at double")
    return x.select("p_partkey", F.array_join(lb.anchor_warnings(*[F.col(c) for c in ("block", "page", "at", "claimed_block", "claimed_page", "claimed_at")]), "|").alias("warnings"))


WRITTEN = (
    ("嗯，同学们我们来看  这个定理。，对吧\n右上角：页眉\n\n结论成立，，很好", "Title one\n12 / 3\nTitle one\n**Index**", ("这个定理。\n结论成立，很好", "Title one|Index")),
    ("呃啊", "共享\n$x$", ("", "")),
    ("plain text\r\nsecond line", "a b\nalpha beta\ngamma", ("plain text\nsecond line", "alpha beta|gamma")),
)


@query("text_written_tidied", _expected("tidy clues", WRITTEN))
def written(spark, d):
    x = _sampled(spark, d, WRITTEN, "raw string, slide string")
    return x.select("p_partkey", lb.tidy_written(F.col("raw")).alias("tidy"), F.array_join(lb.slide_clues(F.split("slide", "\n")), "|").alias("clues"))


MIXES = (
    ("## 页面文字\nWords\n## 页面画面与图形\nA picture\n## 逐块标注\n1. [00:05] 正文：Better 衔接：so\n2. <x> same\n块 1 - 2 衔接：then\n块3", 3, ("Words", "A picture", "1:Better:so|2:same:", "1-2:then|3-3:")),
    ("1. only text\n2. 衔接：bridge", 2, ("", "", "1:only text:|2::bridge", "1-2:bridge")),
    ("```md\n# 逐句标注\n1、a\n块 1\n块 2至2\n```", 2, ("", "", "1:a:", "1-1:|2-2:")),
    ("", 0, ("", "", "", "")),
)


@query("protocol_page_answers", _expected("page_text page_visual edits drafts", MIXES))
def page_answers(spark, d):
    """Transcriptions, corrected lines with bridges, and the blocks of a page."""
    x = _sampled(spark, d, MIXES, "raw string, n int").withColumns({"t": pr.transcription(F.col("raw")), "e": pr.clean_lines(F.col("raw"))})
    bridges = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col("n"))), lambda k: F.coalesce(F.get(F.filter("e", lambda r: r["n"] == k), F.lit(0))["bridge"], F.lit("")))
    x = x.withColumn("d", pr.block_drafts(F.col("raw"), F.col("n"), bridges))
    edits = F.transform("e", lambda r: F.concat(r["n"].cast("string"), F.lit(":"), F.coalesce(r["text"], F.lit("")), F.lit(":"), F.coalesce(r["bridge"], F.lit(""))))
    drafts = F.transform("d", lambda r: F.concat(r["from"].cast("string"), F.lit("-"), r["to"].cast("string"), F.lit(":"), r["bridge"]))
    return x.select("p_partkey", F.col("t.page_text").alias("page_text"), F.col("t.page_visual").alias("page_visual"), F.array_join(edits, "|").alias("edits"), F.array_join(drafts, "|").alias("drafts"))


FORMULAS = (
    (r"Let $\theta\,d x_{i}^2$ be “ok”。", 'Letθdxi2be"ok".'),
    ("ＡＢ\u200b１２ − ½、", "AB12-1/2,"),
    (r"$$\mathrm{\mathbf{v}} \leq \sin x$$ and \(\unknown{y}\)", r"v≤sinxand\unknown{y}"),
    ("no formula at 5$", "noformulaat5$"),
    (r"\[a_1 \times b^{n}\]", "a1×bn"),
)


@query("protocol_correction_text", _expected("compared", tuple((r, (e,)) for r, e in FORMULAS)))
def correction_text(spark, d):
    x = _sampled(spark, d, tuple((r, (e,)) for r, e in FORMULAS), "raw string")
    return x.select("p_partkey", pr.correction_text(F.col("raw")).alias("compared"))


@query("quiz_queues", """
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'accepted' WHEN 'O' THEN 'proposed' END AS queue FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority = '1-URGENT'
""")
def queues(spark, d):
    """Review takes accepted items only, pending the proposed ones; here of one section in any course."""
    status = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "proposed").otherwise("discarded")
    items = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("section"), F.lit("c").alias("course"), status.alias("status"))
    section = items.filter((F.col("section") == "1-URGENT") & (F.lit(None).isNull() | (F.col("course") == F.lit(None).cast("string"))))
    return section.filter(F.col("status").isin("accepted", "proposed")).select("o_orderkey", F.col("status").alias("queue"))


@query("quiz_record_attempts", """
SELECT event_id, coalesce(CAST(o_custkey AS VARCHAR), CASE WHEN event_type = 'click' THEN 'c' END) AS course, CASE WHEN o_orderkey IS NULL AND event_type <> 'click' THEN 'no item and no anchor' END AS reason
FROM events LEFT JOIN orders ON o_orderkey = user_id
""")
def record_attempts(spark, d):
    """An attempt takes its item's anchor before the caller's; with neither it is a reject."""
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("user_id"), F.col("o_custkey").cast("string").alias("own"))
    x = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_type") == "click", "c").alias("claimed")).join(items, "user_id", "left")
    return x.select("event_id", F.coalesce("own", "claimed").alias("course"), F.when(F.col("own").isNull() & F.col("claimed").isNull(), "no item and no anchor").alias("reason"))


@query("sets_batch_statuses", """
WITH ids AS (SELECT DISTINCT l_partkey AS id FROM lineitem ORDER BY id LIMIT 200)
SELECT id, p_partkey IS NOT NULL AS known, p_size AS size FROM ids LEFT JOIN part ON id = p_partkey
""")
def batch_statuses(spark, d):
    """At most 200 asked ids, each with what is known of it; the limit is the feature."""
    ids = table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")).distinct().orderBy("id").limit(200)
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit(True).alias("known"), F.col("p_size").alias("size"))
    return ids.join(p, "id", "left").select("id", F.coalesce("known", F.lit(False)).alias("known"), "size")


@query("sets_failed_pages", """
SELECT user_id, list_sort(list_distinct(list(CAST(floor(value) AS BIGINT)))) AS pages FROM events WHERE event_type = 'error' GROUP BY user_id
""")
def failed_pages(spark, d):
    e = table(spark, d, "events").filter("event_type = 'error'")
    return e.groupBy("user_id").agg(F.array_sort(F.collect_set(F.floor("value"))).alias("pages"))


@query("ingest_lesson_flags", """
WITH s AS (SELECT o_custkey AS lesson, count(*) AS slides FROM orders GROUP BY o_custkey), t AS (SELECT l_suppkey AS lesson, count(*) AS lines FROM lineitem GROUP BY l_suppkey)
SELECT c_custkey AS lesson, coalesce(slides, 0) AS slides, coalesce(lines, 0) AS lines, coalesce(lines, 0) > 50 AND coalesce(slides, 0) <= 2 AS few_slides FROM customer LEFT JOIN s ON c_custkey = s.lesson LEFT JOIN t ON c_custkey = t.lesson
""")
def lesson_flags(spark, d):
    """Slides and lines of each lesson; many lines over hardly any slide are flagged."""
    s = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("lesson")).agg(F.count(F.lit(1)).alias("slides"))
    t = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("lesson")).agg(F.count(F.lit(1)).alias("lines"))
    x = table(spark, d, "customer").select(F.col("c_custkey").alias("lesson")).join(s, "lesson", "left").join(t, "lesson", "left").fillna(0, ["slides", "lines"])
    return x.withColumn("few_slides", (F.col("lines") > 50) & (F.col("slides") <= 2))
