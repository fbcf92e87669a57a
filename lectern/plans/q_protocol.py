"""Protocol, admission and lookup queries."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import protocol as pr
from lectern.functions import text
from lectern.operators import quality as ql
from lectern.plans.registry import query
from lectern.session import table


#: Fixed value: characters of a record's plain text, beyond which a notice follows.
PLAIN_LIMIT = 30_000


def _sheet(spark, d):
    """A model output of each document: headings around its whole text, one heading twice."""
    first = F.regexp_replace("text", r"[#`\n]", " ")
    raw = F.concat(F.lit("```md\n# title\n"), first, F.lit("\n## body\nold\n## terms\n- a\n## body\n"), F.col("lang"), F.lit("\nsecond\n```"))
    return table(spark, d, "documents").select("doc_id", "lang", raw.alias("raw"))


@query("protocol_sections", r"""SELECT doc_id, trim(regexp_replace(text, '[#`\n]', ' ', 'g')) AS title, lang || chr(10) || 'second' AS body, '- a' AS terms, 3 AS n FROM documents""")
def sections(spark, d):
    s = _sheet(spark, d).select("doc_id", pr.sections(F.col("raw")).alias("s"))
    return s.select("doc_id", F.col("s")["title"].alias("title"), F.col("s")["body"].alias("body"), F.col("s")["terms"].alias("terms"), F.size("s").alias("n"))


@query("protocol_fields", "SELECT conv_id, turn, trim(text) AS body, CASE WHEN turn % 2 = 0 THEN role END AS bridge FROM conversations")
def fields(spark, d):
    raw = F.concat(F.lit("正文： "), F.col("text"), F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" 衔接: "), F.col("role"))).otherwise(F.lit("")))
    return table(spark, d, "conversations").select("conv_id", "turn", pr.field(raw, "正文").alias("body"), pr.field(raw, "衔接").alias("bridge"))


@query("protocol_numbered_lines", """
SELECT l_orderkey, CAST(l_linenumber AS INTEGER) AS n, l_linestatus AS text FROM (SELECT l_orderkey, l_linenumber, l_linestatus, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_linestatus DESC) AS k FROM lineitem) WHERE k = 1
""")
def numbered(spark, d):
    line = F.struct("l_partkey", "l_suppkey", "l_linestatus", F.concat(F.col("l_linenumber").cast("string"), F.lit(". "), F.col("l_linestatus")).alias("t"))
    raw = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("raw"))
    return raw.select("l_orderkey", F.explode(pr.numbered_lines(F.col("raw"))).alias("x")).select("l_orderkey", "x.n", "x.text")


@query("protocol_roles", """SELECT event_id, CASE event_type WHEN 'view' THEN '主线' WHEN 'click' THEN '主线' WHEN 'error' THEN '支线' END AS role FROM events""")
def roles(spark, d):
    raw = F.when(F.col("event_type") == "view", " Main ").when(F.col("event_type") == "click", "这是主线").when(F.col("event_type") == "error", "旁支").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", pr.role(raw).alias("role"))


@query("protocol_tags", """
SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 2 END AS tags, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS spine, o_orderkey % 5 <> 0 AND o_orderkey % 3 <> 0 AS complete FROM orders
""")
def tags(spark, d):
    second = F.when(F.col("o_orderkey") % 3 == 0, F.lit("1")).otherwise(F.lit("2"))
    body = F.concat(F.lit('Here: {"tags":[{"index":1,"role":"main","facets":["a"],"summary":"x"},{"index":'), second, F.lit(',"role":"side","facets":[],"summary":"y"}],"spine":"'), F.col("o_orderpriority"), F.lit('"} done'))
    raw = F.when(F.col("o_orderkey") % 5 == 0, F.lit("no object")).otherwise(body)
    t = table(spark, d, "orders").select("o_orderkey", pr.loose_json(raw, pr.TAGS).alias("j"))
    return t.select("o_orderkey", F.size("j.tags").alias("tags").cast("int"), F.col("j.spine").alias("spine"), pr.tags_complete(F.col("j.tags"), F.lit(2)).alias("complete")).withColumn("tags", F.when(F.col("tags") >= 0, F.col("tags")))


@query("protocol_split_pages", "SELECT p_partkey, unnest(CASE p_partkey % 3 WHEN 0 THEN [] WHEN 1 THEN [1, 3] ELSE [3] END) AS page FROM part")
def split_pages(spark, d):
    """Ids 1 to 3 are asked for: a foreign id voids the answer, a repeated one drops out."""
    k = F.col("p_partkey") % 3
    raw = F.concat(F.lit("=== page 1 ===\nfirst\n"), F.when(k == 0, "=== page 9 ===\nforeign\n").when(k == 2, "=== page 1 ===\nagain\n").otherwise(""), F.lit("=== page 3 ===\nthird"))
    x = table(spark, d, "part").select("p_partkey", F.explode(pr.split_pages(raw, F.array(F.lit(1), F.lit(2), F.lit(3)))).alias("x"))
    return x.select("p_partkey", "x.page")


@query("protocol_comparison_text", r"SELECT doc_id, sha256(regexp_replace(text, '\s+', '', 'g')) AS digest FROM documents")
def comparison(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(pr.comparison_text(F.col("text")), 256).alias("digest"))


@query("protocol_marker_counts", r"""
SELECT doc_id, len(regexp_extract_all(text, '(?m)^The')) AS the_lines, len(regexp_extract_all(text, '(?m)\.$')) AS closed_lines FROM documents
""")
def marker_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit("(?m)^The")).alias("the_lines"), F.regexp_count("text", F.lit(r"(?m)\.$")).alias("closed_lines"))


@query("protocol_plain_text", """
WITH t AS (SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS s FROM conversations GROUP BY conv_id)
SELECT conv_id, sha256(CASE WHEN length(s) > 30000 THEN substr(s, 1, 30000) || '…' ELSE s END) AS digest, length(s) > 30000 AS cut FROM t
""")
def plain_text(spark, d):
    """A record flattened to text in order, cut with a notice beyond its limit."""
    rows = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("t"))))
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["t"]), "\n").alias("s"))
    cut = F.length("s") > PLAIN_LIMIT
    return t.select("conv_id", F.sha2(F.when(cut, F.concat(F.substring("s", 1, PLAIN_LIMIT), F.lit("…"))).otherwise(F.col("s")), 256).alias("digest"), cut.alias("cut"))


@query("admission_evidence", r"""
WITH q AS (SELECT item_id, regexp_replace(lower(text), '\s+', '', 'g') AS q FROM benchmark), t AS (SELECT doc_id, regexp_replace(lower(text), '\s+', '', 'g') AS t FROM documents)
SELECT item_id, count(*) AS documents, min(doc_id) AS first_doc FROM q JOIN t ON strpos(t, q) > 0 WHERE length(q) >= 8 GROUP BY item_id
""")
def evidence(spark, d):
    """Whole quotes of eight characters or more found in a transcript, both without white space."""
    quotes = table(spark, d, "benchmark").select("item_id", "text")
    hits = ql.quoted_in(quotes, table(spark, d, "documents").select("doc_id", "text"), "item_id", "doc_id")
    return hits.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc"))


@query("admission_equal_distractors", """
WITH o AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INTEGER) AS q FROM lineitem)
SELECT a.l_orderkey, count(*) AS equal_pairs FROM o a JOIN o b ON a.l_orderkey = b.l_orderkey AND a.q = b.q AND (a.l_linenumber, a.l_partkey) < (b.l_linenumber, b.l_partkey) GROUP BY a.l_orderkey
""")
def equal_distractors(spark, d):
    """Pairs of an item's options with the same value: counted by value, not by comparing all pairs."""
    o = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("int").alias("q")).distinct()
    n = o.groupBy("l_orderkey", "q").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return n.groupBy("l_orderkey").agg(F.sum(F.expr("n * (n - 1) div 2")).alias("equal_pairs"))


@query("admission_common_run", """
SELECT p_partkey, list_has_any(list_transform(range(1, length(p_type) - 2), lambda i: substr(p_type, i, 4)), list_transform(range(1, length(p_name) - 2), lambda i: substr(p_name, i, 4))) AS traced
FROM (SELECT p_partkey, p_name || ' ' || substr(p_type, 1, CAST(p_partkey % 6 AS INTEGER)) AS p_name, p_type FROM part)
""")
def common_run(spark, d):
    name = F.concat(F.col("p_name"), F.lit(" "), F.expr("substr(p_type, 1, cast(p_partkey % 6 as int))"))
    return table(spark, d, "part").select("p_partkey", pr.common_run(name, F.col("p_type"), 4).alias("traced"))


@query("admission_first_rule", """
SELECT p_partkey, CASE WHEN length(p_name) < 8 THEN 'tooShort' WHEN p_size > 40 THEN 'tooLarge' WHEN strpos(p_type, 'ANODIZED') > 0 THEN 'banned' END AS rule FROM part
""")
def first_rule(spark, d):
    """The first failing rule is named, null where all pass."""
    rule = F.when(F.length("p_name") < 8, "tooShort").when(F.col("p_size") > 40, "tooLarge").when(F.contains("p_type", F.lit("ANODIZED")), "banned")
    return table(spark, d, "part").select("p_partkey", rule.alias("rule"))


@query("admission_anchor", """
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o_orderstatus = 'P' OR o_orderkey IS NULL THEN 'undecided' WHEN l_linenumber = 1 AND abs(l_tax - 0.02) <= 0.001 THEN 'pass' ELSE 'fail' END AS verdict FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
""")
def anchor(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") != "P", F.lit(1)).alias("page"))
    x = table(spark, d, "lineitem").join(o, "l_orderkey", "left")
    return x.select("l_orderkey", "l_linenumber", "l_partkey", ql.anchor_backlink(F.col("l_linenumber"), F.col("l_tax"), F.col("page"), F.lit(0.02)).alias("verdict"))


@query("lookup_asset_owner", """
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s+href="([^"]*)"', 1)) AS asset FROM pages) SELECT asset, min(page_id) AS owner, count(*) AS uses FROM l GROUP BY asset
""".replace("\\\\", "\\"))
def asset_owner(spark, d):
    x = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a\s+href="([^"]*)"'), F.lit(1))).alias("asset"))
    return x.groupBy("asset").agg(F.min("page_id").alias("owner"), F.count(F.lit(1)).alias("uses"))


@query("lookup_course_filter", "SELECT c_custkey FROM customer WHERE strpos(lower(concat_ws(' ', c_name, c_mktsegment)), 'build') > 0")
def course_filter(spark, d):
    return table(spark, d, "customer").filter(F.contains(F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")), F.lit("build"))).select("c_custkey")


@query("lookup_sole_match", """
SELECT n_regionkey, CASE WHEN sum(CASE WHEN n_name LIKE '%A' THEN 1 ELSE 0 END) = 1 THEN max(CASE WHEN n_name LIKE '%A' THEN n_name END) WHEN count(*) = 1 THEN max(n_name) END AS picked FROM nation GROUP BY n_regionkey
""")
def sole_match(spark, d):
    """Exactly one title match, else the sole row, else none."""
    hit = F.col("n_name").endswith("A")
    picked = F.when(F.count_if(hit) == 1, F.max(F.when(hit, F.col("n_name")))).when(F.count(F.lit(1)) == 1, F.max("n_name"))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(picked.alias("picked"))


@query("lookup_facet_options", """
WITH s AS (SELECT event_type AS name, min(event_id) AS first FROM events GROUP BY event_type)
SELECT 'view' AS name, -1 AS first UNION ALL SELECT name, first FROM s WHERE name <> 'view'
""")
def facet_options(spark, d):
    """Built-in options first, then others as first seen."""
    seen = table(spark, d, "events").groupBy(F.col("event_type").alias("name")).agg(F.min("event_id").alias("first"))
    return spark.range(1).select(F.lit("view").alias("name"), F.lit(-1).cast("long").alias("first")).unionByName(seen.filter("name <> 'view'"))


@query("lookup_playable", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE coalesce(CASE l_returnflag WHEN 'R' THEN false WHEN 'A' THEN true END, true)")
def playable(spark, d):
    """Kept unless explicitly false; unknown is kept."""
    flag = F.when(F.col("l_returnflag") == "R", False).when(F.col("l_returnflag") == "A", True)
    return table(spark, d, "lineitem").filter(F.coalesce(flag, F.lit(True))).select("l_orderkey", "l_linenumber", "l_partkey")


@query("lookup_sentence_slices", """
WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, text FROM conversations), d AS (SELECT DISTINCT conv_id, x AS lo, x + 1 AS hi FROM s, (VALUES (1), (3)) v(x))
SELECT d.conv_id, lo, count(*) AS sentences, sum(length(text)) AS characters FROM d JOIN s ON s.conv_id = d.conv_id AND k BETWEEN lo AND hi GROUP BY d.conv_id, lo
""")
def sentence_slices(spark, d):
    """Drafts take their sentences by ordinal range."""
    per = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").alias("n")))).alias("s"))
    cut = per.select("conv_id", F.explode(F.array(F.lit(1), F.lit(3))).alias("lo"), "s").withColumn("p", F.slice("s", F.col("lo"), F.lit(2))).filter("size(p) > 0")
    return cut.select("conv_id", "lo", F.size("p").cast("long").alias("sentences"), F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("characters"))


@query("lookup_option_keys", r"SELECT p_partkey, lower(regexp_replace(p_type, '\s+', '', 'g')) AS k FROM part")
def option_keys(spark, d):
    raw = F.concat(F.lit("B. "), F.col("p_type"), F.lit("。"))
    return table(spark, d, "part").select("p_partkey", text.option_key(raw).alias("k"))


@query("lookup_first_slide_of_hit", """
WITH p AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, floor(value / 10) AS page FROM events WHERE event_type = 'view'),
h AS (SELECT DISTINCT user_id, floor(value / 10) AS page FROM events WHERE event_type = 'purchase')
SELECT h.user_id, h.page, min(p.pos) AS first_position FROM h LEFT JOIN p ON p.user_id = h.user_id AND p.page = h.page GROUP BY h.user_id, h.page
""")
def first_slide(spark, d):
    e = table(spark, d, "events").withColumn("page", F.floor(F.col("value") / 10))
    pos = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    first = e.filter("event_type = 'view'").withColumn("pos", pos).groupBy("user_id", "page").agg(F.min("pos").cast("long").alias("first_position"))
    return e.filter("event_type = 'purchase'").select("user_id", "page").distinct().join(first, ["user_id", "page"], "left")


@query("admission_longest_run", r"""
WITH t AS (SELECT conv_id, turn, regexp_replace(lower(text), '\s+', '', 'g') AS k FROM conversations),
p AS (SELECT conv_id, turn, left(k, 60) AS a, lead(k) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM t),
i AS (SELECT conv_id, turn, a, b, unnest(range(1, length(a) + 1)) AS i FROM p WHERE b IS NOT NULL),
l AS (SELECT conv_id, turn, a, b, i, unnest(range(1, length(a) - i + 2)) AS n FROM i),
m AS (SELECT conv_id, turn, a, b, i, n, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, i) AS r FROM l WHERE contains(b, substr(a, i, n)))
SELECT p.conv_id, p.turn, coalesce(n, 0) AS length, coalesce(i - 1, -1) AS start, coalesce(strpos(p.b, substr(p.a, i, n)) - 1, -1) AS at FROM p LEFT JOIN m ON m.conv_id = p.conv_id AND m.turn = p.turn AND r = 1 WHERE p.b IS NOT NULL
""")
def longest_run(spark, d):
    """The longest run that the beginning of each turn shares with the whole next turn, and where it stands in both."""
    from lectern.functions.runs import common_run
    from lectern.functions.text import stem_key

    w = W.partitionBy("conv_id").orderBy("turn")
    x = table(spark, d, "conversations").select("conv_id", "turn", stem_key(F.col("text")).alias("k")).withColumn("b", F.lead("k").over(w)).filter("b IS NOT NULL")
    return x.select("conv_id", "turn", common_run(F.substr("k", F.lit(1), F.lit(60)), F.col("b")).alias("r")).select("conv_id", "turn", "r.length", "r.start", "r.at")
