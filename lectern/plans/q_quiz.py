"""Quiz queries: an order is an item, its lines are options; parts give texts with numbers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import rational, text
from lectern.operators import analytics as an
from lectern.operators import quality as ql
from lectern.plans.registry import query
from lectern.session import table


def _items(spark, d):
    """quiz, answer, options(label, text): the options are the quantities of an order's lines."""
    li = table(spark, d, "lineitem")
    opt = F.struct(F.char(64 + F.col("l_linenumber")).alias("label"), F.concat(F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_returnflag") == "R", " kg").otherwise("")).alias("text"))
    return li.groupBy(F.col("l_orderkey").alias("quiz")).agg(F.array_sort(F.collect_list(opt)).alias("options"))


_ITEMS = """
op AS (SELECT l_orderkey AS quiz, l_linenumber AS k, chr(CAST(64 + l_linenumber AS INTEGER)) AS label, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || CASE WHEN l_returnflag = 'R' THEN ' kg' ELSE '' END AS txt,
         CAST(l_quantity AS INTEGER) AS num, CASE WHEN l_returnflag = 'R' THEN 'kg' ELSE '' END AS unit FROM lineitem),
it AS (SELECT quiz, count(*) AS n, list(txt ORDER BY label) AS texts, list(length(txt) ORDER BY length(txt)) AS lens,
         count(DISTINCT replace(txt, ' ', '')) AS keys, count(DISTINCT label) AS labels, count(DISTINCT CASE WHEN unit <> '' THEN unit END) AS units FROM op GROUP BY quiz)"""


@query("quiz_option_count", f"WITH {_ITEMS} SELECT quiz, CASE WHEN n BETWEEN 3 AND 6 THEN 'pass' ELSE 'fail' END AS verdict FROM it")
def option_count(spark, d):
    return _items(spark, d).select("quiz", ql.option_count(F.col("options")).alias("verdict"))


@query("quiz_duplicate_options", f"WITH {_ITEMS} SELECT quiz, CASE WHEN keys = n THEN 'pass' ELSE 'fail' END AS verdict FROM it")
def duplicate_options(spark, d):
    return _items(spark, d).select("quiz", ql.duplicate_options(F.col("options")).alias("verdict"))


@query("quiz_single_correct", f"WITH {_ITEMS}, f AS (SELECT quiz, arg_min(num, txt) AS num FROM op WHERE k = 1 GROUP BY quiz) SELECT o.quiz, CASE WHEN sum(CASE WHEN o.num = f.num THEN 1 ELSE 0 END) = 1 THEN 'pass' ELSE 'fail' END AS verdict FROM op o JOIN f ON o.quiz = f.quiz GROUP BY o.quiz")
def single_correct(spark, d):
    items = _items(spark, d).withColumn("first", F.filter("options", lambda o: o["label"] == "A")).filter("size(first) > 0")
    return items.select("quiz", ql.single_correct(F.col("options"), F.regexp_replace(F.col("first")[0]["text"], " kg", ".0")).alias("verdict"))


@query("quiz_length_spread", f"WITH {_ITEMS} SELECT quiz, CASE WHEN n < 2 OR (lens[-1] <= 3 * lens[1] AND lens[-1] <= 2.5 * lens[CAST(floor(n / 2) AS INTEGER) + 1]) THEN 'pass' ELSE 'fail' END AS verdict FROM it")
def length_spread(spark, d):
    return _items(spark, d).select("quiz", ql.length_spread(F.col("options")).alias("verdict"))


@query("quiz_unit_consistency", f"WITH {_ITEMS} SELECT quiz, CASE WHEN units <= 1 THEN 'pass' ELSE 'fail' END AS verdict FROM it")
def unit_consistency(spark, d):
    return _items(spark, d).select("quiz", ql.unit_consistency(F.col("options")).alias("verdict"))


@query("quiz_schema_violations", f"""
WITH {_ITEMS}, o AS (SELECT o_orderkey, o_orderpriority, o_custkey % 7 AS page FROM orders)
SELECT o_orderkey AS quiz, concat_ws('|', CASE WHEN substr(o_orderpriority, 3) = 'LOW' OR page = 2 THEN 'empty stem' END, CASE WHEN page = 0 THEN 'bad page' END, CASE WHEN n < 2 THEN 'too few options' END, CASE WHEN labels <> n THEN 'repeated labels' END) AS violations
FROM o JOIN it ON o_orderkey = quiz
""")
def schema_violations(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("quiz"), F.expr("substr(o_orderpriority, 3)").alias("p"), (F.col("o_custkey") % 7).alias("page"))
    x = o.join(_items(spark, d), "quiz").withColumn("stem", F.when((F.col("p") == "LOW") | (F.col("page") == 2), " ").otherwise(F.col("p")))
    return x.select("quiz", F.array_join(ql.schema_violations(F.col("stem"), F.lit("A"), F.col("page"), F.col("options")), "|").alias("violations"))


@query("quiz_check_report", f"""
WITH {_ITEMS}, c AS (
 SELECT quiz, 'optionCount' AS c, CASE WHEN n BETWEEN 3 AND 6 THEN 'pass' ELSE 'fail' END AS v FROM it
 UNION ALL SELECT quiz, 'duplicateOptions', CASE WHEN keys = n THEN 'pass' ELSE 'fail' END FROM it
 UNION ALL SELECT quiz, 'unit', CASE WHEN units <= 1 THEN 'pass' ELSE 'fail' END FROM it
 UNION ALL SELECT it.quiz, 'anchor', CASE WHEN o_orderstatus = 'P' THEN 'undecided' ELSE 'pass' END FROM it JOIN orders ON quiz = o_orderkey)
SELECT quiz, bool_and(v = 'pass') AS all_pass, bool_or(v = 'fail') AS any_fail, bool_or(v = 'undecided') AS any_undecided, coalesce(string_agg(CASE WHEN v = 'fail' THEN c END, '|' ORDER BY c), '') AS failed FROM c GROUP BY quiz
""")
def check_report(spark, d):
    o = F.col("options")
    x = _items(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("quiz"), "o_orderstatus"), "quiz")
    missing = F.when(F.col("o_orderstatus") != "P", F.lit(1))
    checks = [("optionCount", ql.option_count(o)), ("duplicateOptions", ql.duplicate_options(o)), ("unit", ql.unit_consistency(o)), ("anchor", ql.anchor_backlink(F.lit(1), F.lit(0.0), missing, F.lit(0.0)))]
    each = x.select("quiz", F.explode(F.array(*[F.struct(F.lit(n).alias("check"), v.alias("verdict")) for n, v in checks])).alias("c")).select("quiz", "c.*")
    return ql.report(each, "quiz")


@query("quiz_pipeline_status", f"""
WITH {_ITEMS} SELECT quiz, CASE WHEN keys <> n THEN 'dropped' WHEN o_orderstatus = 'P' THEN 'human' WHEN o_orderpriority = '5-LOW' THEN 'dropped' WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'human' ELSE 'proposed' END AS status
FROM it JOIN orders ON quiz = o_orderkey
""")
def pipeline_status(spark, d):
    x = _items(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("quiz"), "o_orderstatus", "o_orderpriority"), "quiz")
    answerable = F.when(F.col("o_orderstatus") != "P", "pass")
    judge = F.when(F.col("o_orderpriority") == "5-LOW", "fail").when(F.col("o_orderpriority") != "4-NOT SPECIFIED", "pass")
    return x.select("quiz", ql.pipeline_status(ql.duplicate_options(F.col("options")), answerable, judge).alias("status"))


@query("quiz_rational_pairs", """
WITH c AS (SELECT DISTINCT l_quantity AS q, l_discount AS r FROM lineitem)
SELECT CAST(CAST(q AS INTEGER) AS VARCHAR) || '/100' AS a, CAST(CAST(round(r * 100) AS INTEGER) AS VARCHAR) || '%' AS b, CAST(q AS INTEGER) = CAST(round(r * 100) AS INTEGER) AS same FROM c
""")
def rational_pairs(spark, d):
    li = table(spark, d, "lineitem").select(F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("/100")).alias("a"), F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%")).alias("b")).distinct()
    return li.select("a", "b", rational.equivalent(rational.parse_rational(F.col("a")), rational.parse_rational(F.col("b"))).alias("same"))


@query("quiz_parse_prices", """
SELECT p_partkey, CAST(round(p_retailprice * 100) AS BIGINT) AS cents FROM part
""")
def parse_prices(spark, d):
    """Two-decimal prices parsed exactly, as whole cents."""
    v = rational.parse_rational(F.format_number("p_retailprice", 2))
    return table(spark, d, "part").select("p_partkey", (v["num"] * 100 / v["den"]).cast("long").alias("cents"))


@query("quiz_stem_dedupe", r"""
WITH s AS (SELECT doc_id, lower(regexp_replace(text, '\s+', '', 'g')) AS k FROM documents), r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS n FROM s),
e AS (SELECT DISTINCT k FROM s WHERE doc_id % 10 = 0)
SELECT r.doc_id, CASE WHEN e.k IS NOT NULL THEN 'existing' WHEN n > 1 THEN 'batch' END AS duplicate_of FROM r LEFT JOIN e ON r.k = e.k
""")
def stem_dedupe(spark, d):
    docs = table(spark, d, "documents").select("doc_id", text.stem_key(F.col("text")).alias("k"))
    existing = docs.filter("doc_id % 10 = 0").select(F.col("k").alias("key"))
    return an.first_seen(docs, F.col("k"), ["doc_id"], existing).select("doc_id", "duplicate_of")


@query("quiz_tail_limit", """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n, count(*) OVER (PARTITION BY user_id) AS c FROM events)
SELECT user_id, event_id, c > 60 AS truncated FROM r WHERE n <= 60
""")
def tail_limit(spark, d):
    """The newest 60 items of each group, with the truncation reported."""
    e = table(spark, d, "events")
    r = e.withColumns({"n": F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))), "c": F.count(F.lit(1)).over(W.partitionBy("user_id"))})
    return r.filter("n <= 60").select("user_id", "event_id", (F.col("c") > 60).alias("truncated"))


@query("quiz_blank_counts", """
SELECT p_partkey, greatest(CAST((length(s) - length(replace(s, '____', ''))) / 4 AS INTEGER), CAST((length(s) - length(replace(s, '()', ''))) / 2 AS INTEGER)) AS blanks,
  CASE WHEN greatest(CAST((length(s) - length(replace(s, '____', ''))) / 4 AS INTEGER), CAST((length(s) - length(replace(s, '()', ''))) / 2 AS INTEGER)) >= 1 THEN 'pass' ELSE 'fail' END AS marked
FROM (SELECT p_partkey, replace(replace(p_name, 'a', '____'), 'e', '()') AS s FROM part)
""")
def blank_counts(spark, d):
    stem = F.replace(F.replace("p_name", F.lit("a"), F.lit("____")), F.lit("e"), F.lit("()"))
    return table(spark, d, "part").select("p_partkey", text.blank_count(stem).alias("blanks"), ql.blank_marker(stem).alias("marked"))


@query("quiz_answer_in_source", r"""
SELECT b.item_id, d.doc_id, CASE WHEN d.lang = 'es' THEN 'undecided' WHEN strpos(lower(regexp_replace(d.text, '\s+', '', 'g')), lower(regexp_replace(b.text, '\s+', '', 'g'))) > 0 THEN 'pass' ELSE 'fail' END AS verdict
FROM benchmark b JOIN documents d ON d.doc_id = b.item_id
""")
def answer_in_source(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("lang") != "es", F.col("text")).alias("source"))
    bench = table(spark, d, "benchmark").select("item_id", F.col("text").alias("answer"))
    x = docs.join(bench, F.col("doc_id") == F.col("item_id"))  # an item's source is the document of its number
    return x.select("item_id", "doc_id", ql.answer_in_source(F.col("answer"), F.col("source")).alias("verdict"))


@query("quiz_refusals", """
SELECT o_orderkey, concat_ws('|', CASE WHEN o_totalprice < 20000 THEN 'tooSmall' END, CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_orderpriority = '5-LOW' THEN 'lowPriority' END) AS reasons FROM orders
""")
def refusals(spark, d):
    """All reasons of a refusal together, in a fixed order."""
    reasons = F.array_compact(F.array(F.when(F.col("o_totalprice") < 20000, "tooSmall"), F.when(F.col("o_orderstatus") == "P", "pending"), F.when(F.col("o_orderpriority") == "5-LOW", "lowPriority")))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(reasons, "|").alias("reasons"))


def _attempts(spark, d):
    """Events as attempts: purchases are right, errors wrong, others unknown; some users rate themselves."""
    auto = F.when(F.col("event_type") == "purchase", "correct").when(F.col("event_type") == "error", "incorrect").otherwise("unknown")
    recall = F.when(F.col("event_id") % 5 == 0, "again").when(F.col("event_id") % 7 == 0, "good")
    e = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 211).alias("quiz"), auto.alias("auto"), recall.alias("recall"))
    return e.withColumn("wrong", an.counts_as_wrong(F.col("recall"), F.col("auto")))


_ATT = """
att AS (SELECT event_id, user_id, ts, event_id % 211 AS quiz, CASE event_type WHEN 'purchase' THEN 'correct' WHEN 'error' THEN 'incorrect' ELSE 'unknown' END AS auto,
   CASE WHEN event_id % 5 = 0 THEN 'again' WHEN event_id % 7 = 0 THEN 'good' END AS recall FROM events),
w AS (SELECT *, CASE WHEN recall IS NOT NULL THEN recall = 'again' ELSE auto = 'incorrect' END AS wrong FROM att)"""


@query("analytics_wrong_flags", f"WITH {_ATT} SELECT event_id, wrong, CASE WHEN recall IS NOT NULL AND auto <> 'unknown' THEN (auto = 'correct') = (recall <> 'again') END AS agrees FROM w")
def wrong_flags(spark, d):
    return _attempts(spark, d).select("event_id", "wrong", an.agreement(F.col("recall"), F.col("auto")).alias("agrees"))


@query("analytics_attribution", f"""
WITH {_ATT}, p AS (SELECT DISTINCT CAST(quiz AS BIGINT) AS quiz, point FROM (SELECT unnest(range(0, 230)) AS quiz), (VALUES (0), (1)) v(o), LATERAL (SELECT CAST((quiz * (o + 1)) % 37 AS BIGINT) AS point)),
j AS (SELECT p.point, w.* FROM w JOIN p ON w.quiz = p.quiz),
g AS (SELECT point, count(*) AS attempts, sum(CASE WHEN wrong THEN 1 ELSE 0 END) AS wrong FROM j GROUP BY point),
l AS (SELECT point, event_id, row_number() OVER (PARTITION BY point ORDER BY ts DESC, event_id DESC) AS n FROM j WHERE wrong)
SELECT q.point, coalesce(attempts, 0) AS attempts, coalesce(wrong, 0) AS wrong, l.event_id AS last_wrong FROM (SELECT DISTINCT point FROM p) q LEFT JOIN g ON q.point = g.point LEFT JOIN l ON q.point = l.point AND l.n = 1
""")
def attribution(spark, d):
    points = spark.range(230).select(F.col("id").alias("quiz"), F.explode(F.array_distinct(F.array(F.col("id") % 37, F.col("id") * 2 % 37))).alias("point"))
    return an.attribution(_attempts(spark, d), points, "quiz", "point", "ts", "event_id")


@query("analytics_mastery", f"""
WITH {_ATT}, r AS (SELECT user_id, quiz % 10 AS point, wrong, row_number() OVER (PARTITION BY user_id, quiz % 10 ORDER BY ts DESC, event_id DESC) AS n FROM w)
SELECT user_id, point, count(*) AS attempts, sum(CASE WHEN wrong THEN 1 ELSE 0 END) AS wrong, string_agg(CASE WHEN n <= 5 THEN CASE WHEN wrong THEN 'W' ELSE 'R' END END, '' ORDER BY n) AS newest,
 CASE WHEN count(*) < 3 THEN 'insufficient' WHEN sum(CASE WHEN wrong AND n <= 3 THEN 1 ELSE 0 END) = 3 THEN 'allWrong' WHEN sum(CASE WHEN wrong AND n <= 3 THEN 1 ELSE 0 END) = 0 THEN 'allRight' ELSE 'mixed' END AS label
FROM r GROUP BY user_id, point
""")
def mastery(spark, d):
    a = _attempts(spark, d).withColumn("point", F.col("quiz") % 10)
    return an.mastery(a, ["user_id", "point"], "ts", "event_id")


@query("analytics_rate_ledger", """
WITH e AS (SELECT CAST(ts + INTERVAL 8 HOUR AS DATE) AS day, user_id AS course, event_type AS section FROM events)
SELECT 'day' AS kind, day, NULL AS course, NULL AS section, count(*) AS n, greatest(0, 20 - count(*)) AS remaining, count(*) < 20 AS allowed FROM e GROUP BY day
UNION ALL SELECT 'section', NULL, course, section, count(*), greatest(0, 30 - count(*)), count(*) < 30 FROM e GROUP BY course, section
""")
def rate_ledger(spark, d):
    e = table(spark, d, "events")
    return an.rate_ledger(e.select(F.to_date(F.col("ts") + F.expr("INTERVAL 8 HOUR")).alias("day"), F.col("user_id").alias("course"), F.col("event_type").alias("section")), "day", "course", "section")


@query("analytics_backlog", """
SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS new_items, sum(CASE WHEN o_orderstatus = 'F' AND o_orderdate <= TIMESTAMP '1997-01-01' THEN 1 ELSE 0 END) AS due_items FROM orders GROUP BY o_orderpriority
""")
def backlog(spark, d):
    due = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return an.backlog(table(spark, d, "orders"), F.col("o_orderstatus") == "O", due, F.expr("TIMESTAMP_NTZ '1997-01-01 00:00:00'"), ["o_orderpriority"])


@query("analytics_wilson", f"""
WITH {_ATT}, g AS (SELECT user_id, count(*) AS n, sum(CASE WHEN wrong THEN 1.0 ELSE 0.0 END) AS s FROM w GROUP BY user_id), p AS (SELECT *, CAST(s AS DOUBLE) / n AS p FROM g)
SELECT user_id, n, greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)) AS low, least(1, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)) AS high FROM p
""")
def wilson(spark, d):
    g = _attempts(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("wrong").alias("s"))
    low, high = an.wilson(F.col("s"), F.col("n"))
    return g.select("user_id", "n", low.alias("low"), high.alias("high"))


@query("analytics_ratio_text", f"WITH {_ATT} SELECT user_id, quiz, CASE WHEN count(*) < 5 THEN CAST(sum(CASE WHEN wrong THEN 1 ELSE 0 END) AS VARCHAR) || '/' || CAST(count(*) AS VARCHAR) ELSE 'interval' END AS label FROM w GROUP BY user_id, quiz")
def ratio_text(spark, d):
    """Under five attempts only the raw count is given."""
    n, s = F.count(F.lit(1)), F.count_if("wrong")
    return _attempts(spark, d).groupBy("user_id", "quiz").agg(F.when(n < 5, F.concat(s.cast("string"), F.lit("/"), n.cast("string"))).otherwise("interval").alias("label"))


@query("analytics_density", """
SELECT o_custkey, count(*) AS cards, CASE WHEN o_custkey % 9 < 1 THEN 'noPages' WHEN count(*) / (o_custkey % 9) < 1.5 THEN 'sparse' WHEN count(*) / (o_custkey % 9) > 2.5 THEN 'dense' ELSE 'fine' END AS advice FROM orders GROUP BY o_custkey
""")
def density(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("cards"))
    return g.withColumn("advice", an.density_advice(F.col("cards"), F.col("o_custkey") % 9))


@query("text_filler_guard", r"""
WITH s AS (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations),
h AS (SELECT conv_id, turn, CAST((length(text) - length(replace(text, 'the', ''))) / 3 + (length(text) - length(replace(text, 'on', ''))) / 2 AS INTEGER) AS a,
  CAST((length(r) - length(replace(r, 'the', ''))) / 3 + (length(r) - length(replace(r, 'on', ''))) / 2 AS INTEGER) AS b FROM s WHERE r IS NOT NULL)
SELECT conv_id, turn, a AS source_hits, b AS kept_hits, a > 0 AND b > a * 0.34 AS flagged FROM h
""")
def filler_guard(spark, d):
    words = ("the", "on")
    s = table(spark, d, "conversations").withColumn("r", F.lead("text").over(W.partitionBy("conv_id").orderBy("turn"))).filter("r IS NOT NULL")
    s = s.select("conv_id", "turn", text.filler_hits(F.col("text"), words).alias("source_hits"), text.filler_hits(F.col("r"), words).alias("kept_hits"))
    return s.withColumn("flagged", (F.col("source_hits") > 0) & (F.col("kept_hits") > F.col("source_hits") * text.MAX_FILLER_KEPT))


@query("text_length_guards", r"""
WITH n AS (SELECT conv_id, turn, length(regexp_replace(text, '[\x00-\x40\x5B-\x60\x7B-\x7F\x{2000}-\x{206F}\x{3000}-\x{303F}\x{FF00}-\x{FFEF}]', '', 'g')) AS c, length(trim(text)) AS t FROM conversations),
p AS (SELECT conv_id, turn, c AS src, lead(c) OVER (PARTITION BY conv_id ORDER BY turn) AS dst, lead(t) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM n)
SELECT conv_id, turn, CASE WHEN t = 0 THEN 'empty' WHEN src > 0 AND dst > ceil(src * 1.6) + 60 THEN 'tooLong' WHEN src > 0 AND dst > 0 AND dst / src < 0.3 THEN 'shrunk' ELSE 'fine' END AS verdict,
  t = 0 OR (src >= 200 AND dst <= 20) AS broken FROM p WHERE dst IS NOT NULL
""")
def length_guards(spark, d):
    c = table(spark, d, "conversations")
    w = W.partitionBy("conv_id").orderBy("turn")
    x = c.select("conv_id", "turn", text.content_characters(F.col("text")).alias("src"), F.length(F.trim("text")).alias("t"))
    x = x.withColumns({"dst": F.lead("src").over(w), "t": F.lead("t").over(w)}).filter("dst IS NOT NULL")
    s, t = F.col("src"), F.col("dst")
    v = F.when(F.col("t") == 0, "empty").when((s > 0) & (t > F.ceil(s * text.LENGTH_RATIO) + text.LENGTH_SLACK), "tooLong").when((s > 0) & (t > 0) & (t / s < text.MIN_KEPT), "shrunk").otherwise("fine")
    return x.select("conv_id", "turn", v.alias("verdict"), ((F.col("t") == 0) | ((s >= 200) & (t <= 20))).alias("broken"))


@query("text_register", r"""
WITH s AS (SELECT conv_id, turn, trim(text) AS t, regexp_replace(regexp_replace(text, '\s+', '', 'g'), '[，。！？、；：,.!?;]', '', 'g') AS k FROM conversations),
p AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM s)
SELECT conv_id, turn, CASE WHEN t = '' THEN 'failed' WHEN (k = b AND k <> '') OR strpos(t, 'ou ') > 0 OR right(t, 1) = ',' THEN 'draft' ELSE 'written' END AS register,
 CASE WHEN t = '' THEN 'empty' ELSE concat_ws('|', CASE WHEN k = b AND k <> '' THEN 'same' END, CASE WHEN strpos(t, 'ou ') > 0 THEN 'mark' END, CASE WHEN right(t, 1) = ',' THEN 'incomplete' END) END AS notes FROM p
""")
def register(spark, d):
    """Written, draft or failed, with every reason named."""
    t = F.trim("text")
    s = table(spark, d, "conversations").select("conv_id", "turn", t.alias("t"), text.normal_lecture_text(F.col("text")).alias("k"))
    s = s.withColumn("b", F.lag("k").over(W.partitionBy("conv_id").orderBy("turn")))
    same = F.coalesce((F.col("k") == F.col("b")) & (F.col("k") != ""), F.lit(False))
    notes = F.array_compact(F.array(F.when(same, "same"), F.when(F.col("t").contains("ou "), "mark"), F.when(F.col("t").endswith(","), "incomplete")))
    reg = F.when(F.col("t") == "", "failed").when(F.size(notes) > 0, "draft").otherwise("written")
    return s.select("conv_id", "turn", reg.alias("register"), F.when(F.col("t") == "", "empty").otherwise(F.array_join(notes, "|")).alias("notes"))
