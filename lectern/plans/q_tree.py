"""Queries of the knowledge tree as a whole: documents are pages, their sources are decks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions import slide_text as st
from lectern.operators import lecture_tree as lt
from lectern.plans.registry import query
from lectern.session import table

#: Lines of every kind that slide pictures show; a part's name goes where the sample has a brace.
SAMPLES = (
    "{}", "**{}**", "标题：☞ **Solution 2: {}**", "1. {}", "右上角（红色）：{}", "$k_1$", "$$E = mc^2$$", "12 / 106", "13:22", "2026/9/15", "窗口标题栏：{}.xlsx - Excel", "共享",
    "共享内存是多个进程之间共同使用的一段内存 {}", "幻灯片正文中央：", "节点 a 内文字为 {}", "蓝色箭头 {}", "（无可见文字）", "{} and", "{}的", "while {}", "{}。", "Discussion 4:", "{}：",
    "| {} | b |", "|---|---|", "```python", "train_test_split {}", "_Relevance_ {}......", "Chapter 3 {}", "第 二 章 {}", "x", "从 a 引出 {}", "微信 {}", "[a-zA-Z] 5", "a_1 + b_2 = c",
)


def _samples(spark, d):
    picked = F.element_at(F.array(*map(F.lit, SAMPLES)), (F.col("p_partkey") % len(SAMPLES) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.replace(picked, F.lit("{}"), F.col("p_name")).alias("raw"))


_SAMPLES_SQL = f"s AS (SELECT p_partkey, replace([{', '.join(st._quoted(x) for x in SAMPLES)}][CAST(p_partkey % {len(SAMPLES)} + 1 AS INTEGER)], '{{}}', p_name) AS raw FROM part)"


@query("tree_line_kinds", f"""
WITH {_SAMPLES_SQL}, c AS (SELECT p_partkey, raw, {st.clean_line_sql('raw')} AS line FROM s)
SELECT p_partkey, line, {st.is_noise_sql('line')} AS noise, {st.notation_only_sql('line')} AS notation, {st._sql_any('trim(line)', st.DIAGRAM_NOTES)} AS diagram, {st.app_window_sql('raw')} AS app_window,
  {st.rejected_as_title_sql('line')} AS rejected, {st.looks_like_divider_sql('line')} AS divider, CASE WHEN {st.is_noise_sql('line')} THEN '' ELSE line END AS heading FROM c
""")
def line_kinds(spark, d):
    s = _samples(spark, d).withColumn("line", st.clean_line(F.col("raw")))
    line = F.col("line")
    return s.select(
        "p_partkey", "line", st.is_noise(line).alias("noise"), st.notation_only(line).alias("notation"), st.diagram_note(line).alias("diagram"), st.app_window(F.col("raw")).alias("app_window"),
        st.rejected_as_title(line).alias("rejected"), st.looks_like_divider(line).alias("divider"), st.tidy_heading(F.col("raw")).alias("heading"),
    )


def _lecture(spark, d):
    """Slides with a block each, some on a neighbouring page and some beyond the deck, and an outline of overlapping segments of some twenty blocks."""
    deck = F.coalesce("source", F.lit(""))
    page = F.row_number().over(W.partitionBy("deck").orderBy("doc_id"))
    slides = table(spark, d, "documents").withColumn("deck", deck).withColumn("page", page).select("deck", "page", "text", "n_chars")
    blocks = slides.select("deck", F.col("page").alias("block"), (F.col("page") + F.col("n_chars") % 3 - 1 + F.when(F.col("page") % 50 == 0, 100_000).otherwise(0)).alias("page"))
    i = F.floor(F.col("page") / 20).cast("int")
    outline = slides.select("deck", i.alias("segment")).distinct()
    s = F.col("segment")
    outline = outline.select("deck", "segment", F.concat(F.lit("part "), s.cast("string")).alias("title"), (s * 20 + 1).alias("from"), (s * 20 + 20 + (s % 2) * 3).alias("to"))
    return slides.drop("n_chars"), blocks, outline


_UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
_TREE = f"""
slides AS (SELECT coalesce(source, '') AS deck, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY doc_id) AS page, text, n_chars FROM documents),
raw AS (SELECT deck, page, unnest(ls) AS raw, generate_subscripts(ls, 1) AS o FROM (SELECT deck, page, string_split(coalesce(text, ''), chr(10)) AS ls FROM slides)),
cl AS (SELECT deck, page, o, {st.clean_line_sql('raw')} AS line FROM raw),
l AS (SELECT deck, page, line, row_number() OVER (PARTITION BY deck, page ORDER BY o) AS ord, {st.is_noise_sql('line')} AS noise FROM cl WHERE line <> ''),
fu AS (SELECT deck, page, arg_min(line, ord) AS plain FROM l WHERE NOT noise GROUP BY deck, page),
o AS (SELECT DISTINCT l.deck, l.page, l.line, l.line = fu.plain AS is_first FROM l LEFT JOIN fu ON l.deck = fu.deck AND l.page = fu.page),
sp AS (SELECT deck, line, count(*) AS pages, sum(CASE WHEN is_first THEN 1 ELSE 0 END) AS firsts, min(page) AS lo, max(page) AS hi FROM o GROUP BY deck, line),
n AS (SELECT deck, count(*) AS deck_pages FROM slides GROUP BY deck),
hd AS (SELECT sp.deck, line, pages, pages >= {lt.HEADER_MIN_PAGES} AND firsts / pages >= {lt.HEADER_FIRST_RATIO} AND (pages >= deck_pages * {lt.HEADER_PAGE_RATIO} OR (hi - lo + 1 >= {lt.HEADER_SPAN} AND pages / (hi - lo + 1) >= {lt.HEADER_DENSITY})) AS is_header FROM sp JOIN n ON sp.deck = n.deck),
m AS (SELECT l.*, hd.pages, hd.is_header FROM l JOIN hd ON l.deck = hd.deck AND l.line = hd.line),
tops AS (SELECT deck, page, bool_or(is_header) AS header, arg_min(line, ord) AS top FROM m GROUP BY deck, page),
u AS (SELECT *, first_value(line) OVER (PARTITION BY deck, page ORDER BY ord) AS cand FROM m WHERE NOT is_header AND NOT noise),
us AS (SELECT deck, page, min(cand) AS cand, arg_min(pages, ord) AS cand_pages, count(*) AS usable, count_if(line <> cand AND NOT contains(line, '|')) AS others,
         count_if(line <> cand AND NOT contains(line, '|') AND length(line) <= {st.SHORT_LINE}) AS shorts FROM u GROUP BY deck, page),
p0 AS (SELECT s.deck, s.page, coalesce(header, false) AS header, top, {st.app_window_sql('top')} AS win, plain, coalesce(usable, 0) AS usable, cand, cand_pages, others, shorts
       FROM slides s LEFT JOIN tops ON s.deck = tops.deck AND s.page = tops.page LEFT JOIN fu ON s.deck = fu.deck AND s.page = fu.page LEFT JOIN us ON s.deck = us.deck AND s.page = us.page),
p1 AS (SELECT *, coalesce(NOT win AND usable > 0 AND NOT {st.rejected_as_title_sql('cand')} AND (cand_pages >= 2 OR regexp_matches(cand, '{st.TITLE_BEGIN}') OR (length(cand) <= {st.SHORT_LINE} AND (others = 0 OR shorts = 0))), false) AS titled FROM p0),
p2 AS (SELECT deck, page, header, win, plain, CASE WHEN titled THEN cand ELSE '' END AS head, CASE WHEN win THEN 0 ELSE usable - CAST(titled AS INTEGER) END AS body, (win OR usable = 0) AND top IS NOT NULL AS shell FROM p1),
p3 AS (SELECT *, max(CAST(head <> '' AS INTEGER)) OVER (PARTITION BY deck ORDER BY page {_UP}) = 0 AND NOT win AND NOT header AND plain IS NOT NULL AS open FROM p2),
cv AS (SELECT deck, min(page) AS page, arg_min(plain, page) AS cover FROM p3 WHERE open GROUP BY deck),
c2 AS (SELECT * FROM cv WHERE NOT {st.rejected_as_title_sql('cover')} AND NOT EXISTS (SELECT 1 FROM p2 WHERE p2.deck = cv.deck AND p2.head = cv.cover)),
hp AS (SELECT p2.deck, p2.page, coalesce(cover, head) AS head, body - CAST(cover IS NOT NULL AS INTEGER) AS body, win, header, shell FROM p2 LEFT JOIN c2 ON p2.deck = c2.deck AND p2.page = c2.page),
t1 AS (SELECT *, coalesce(last_value(CASE WHEN head <> '' THEN head WHEN win THEN '' END IGNORE NULLS) OVER (PARTITION BY deck ORDER BY page {_UP}), '') AS title FROM hp),
t2 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY deck ORDER BY page) = 1 OR title <> lag(title) OVER (PARTITION BY deck ORDER BY page) THEN 1 ELSE 0 END AS new FROM t1),
t3 AS (SELECT *, sum(new) OVER (PARTITION BY deck ORDER BY page {_UP}) AS topic FROM t2),
tp AS (SELECT deck, topic, title, min(page) AS from_page, max(page) AS to_page, sum(body) AS lines FROM t3 GROUP BY deck, topic, title),
bl AS (SELECT deck, page AS block, page + n_chars % 3 - 1 + CASE WHEN page % 50 = 0 THEN 100000 ELSE 0 END AS page FROM slides),
gp AS (SELECT b.deck, b.block, b.page, topic, greatest(from_page - page, page - to_page, 0) AS gap FROM bl b JOIN tp ON b.deck = tp.deck),
pl AS (SELECT deck, block, page, topic, gap > 0 AS orphan FROM (SELECT *, row_number() OVER (PARTITION BY deck, block ORDER BY gap, topic) AS k FROM gp) WHERE k = 1),
ol AS (SELECT DISTINCT deck, page // 20 AS segment FROM slides),
cb AS (SELECT deck, block, max(segment) AS segment FROM (SELECT deck, segment, unnest(range(segment * 20 + 1, segment * 20 + 21 + (segment % 2) * 3)) AS block FROM ol) GROUP BY deck, block),
dv AS (SELECT DISTINCT deck FROM tp WHERE {st.looks_like_divider_sql('title')}),
vt AS (SELECT pl.deck, topic, segment, count(*) AS n, min(CASE WHEN orphan THEN 1000000000000 ELSE 0 END + page * 1000000 + pl.block) AS f FROM pl JOIN cb ON pl.deck = cb.deck AND pl.block = cb.block
       WHERE pl.deck NOT IN (SELECT deck FROM dv) GROUP BY pl.deck, topic, segment),
wn AS (SELECT deck, topic, segment FROM (SELECT *, row_number() OVER (PARTITION BY deck, topic ORDER BY n DESC, f) AS k FROM vt) WHERE k = 1),
fl AS (SELECT tp.*, coalesce(c.n, 0) AS blocks, wn.segment, {st.looks_like_divider_sql('title')} AS divider FROM tp LEFT JOIN (SELECT deck, topic, count(*) AS n FROM pl GROUP BY deck, topic) c ON tp.deck = c.deck AND tp.topic = c.topic
       LEFT JOIN wn ON tp.deck = wn.deck AND tp.topic = wn.topic),
f2 AS (SELECT *, divider OR coalesce(segment <> last_value(segment IGNORE NULLS) OVER (PARTITION BY deck ORDER BY topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), segment IS NOT NULL) AS begins FROM fl),
f3 AS (SELECT deck, topic, title, from_page, to_page, lines, blocks,
         sum(CAST(begins AS INTEGER)) OVER (PARTITION BY deck ORDER BY topic {_UP}) + CASE WHEN first_value(begins) OVER (PARTITION BY deck ORDER BY topic {_UP}) THEN 0 ELSE 1 END AS chapter,
         coalesce(last_value(CASE WHEN divider THEN title WHEN begins THEN 'part ' || CAST(segment AS VARCHAR) END IGNORE NULLS) OVER (PARTITION BY deck ORDER BY topic {_UP}), '') AS chapter_title FROM f2)"""


@query("tree_build", f"WITH {_TREE} SELECT deck, topic, title, from_page, to_page, lines, blocks, chapter, chapter_title FROM f3")
def tree_build(spark, d):
    """Every topic of every deck with its chapter."""
    return lt.build_tree(*_lecture(spark, d))[0]


@query("tree_build_blocks", f"WITH {_TREE} SELECT deck, block, page, topic, orphan FROM pl")
def tree_blocks(spark, d):
    """Every block with the one topic that holds it."""
    return lt.build_tree(*_lecture(spark, d))[1]


@query("tree_build_decks", f"""
WITH {_TREE}, h AS (SELECT deck, count(*) AS pages, count_if(header) AS header_pages, count_if(shell) AS shell_pages FROM hp GROUP BY deck),
s AS (SELECT deck, count(*) AS topics, count_if(blocks > 0) AS covered_topics, max(chapter) AS chapters, sum(blocks) AS blocks FROM f3 GROUP BY deck)
SELECT h.*, topics, covered_topics, chapters, blocks,
  CASE WHEN header_pages / pages >= 0.3 AND shell_pages / pages >= 0.25 THEN 'shellHeavy' WHEN header_pages / pages >= 0.3 THEN 'header' ELSE 'plain' END AS template FROM h JOIN s ON h.deck = s.deck
""")
def tree_decks(spark, d):
    return lt.build_tree(*_lecture(spark, d))[2]
