"""Queries of written lectures: conversations are lessons, their turns blocks, and answers of every shape are made of the same words."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions import slide_text as st
from lectern.functions import text as tx
from lectern.functions import variants as va
from lectern.functions.labels import STRIP_WORDS, VISION_BEGIN
from lectern.operators import lecture_write as lw
from lectern.plans.registry import query
from lectern.session import table

_Q = st._quoted
BARE = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

# --- answers about documents: one topic per document, in one of the shapes an answer may take


def _shapes(spark, d):
    """doc_id and an answer that says the document's lines, in a shape that follows from the id."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda s: F.trim(s) != "")
    n, c = F.col("doc_id"), F.lit("chapters")
    listed = F.transform(lines, lambda s, i: F.struct(i.cast("string").alias("label"), s.alias("text")))

    def chapters(topic):
        return F.to_json(F.struct(F.array(F.struct(F.lit(1).alias("c"), F.array(topic).alias("topics"))).alias("chapters")))

    standard = chapters(F.struct(n.alias("t"), listed.alias("passages")))
    shapes = [
        standard, chapters(F.struct(n.alias("i"), lines.alias("paragraphs"))), F.concat(F.lit("```json\n"), standard, F.lit("\n```")), F.concat(F.lit('{"result": '), standard, F.lit("}")),
        F.regexp_extract(standard, r"(?s)^\{\"chapters\":(.*)\}$", 1), chapters(F.struct(n.cast("string").alias("t"), listed.alias("passages"))),
        F.to_json(F.struct(n.alias("t"), F.transform(lines, lambda s: F.struct(F.lit("定义").alias("kind"), s.alias("body"))).alias("slots"))), F.coalesce("text", F.lit("")),
        F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1), chapters(F.struct(n.alias("t"), F.coalesce("text", F.lit("")).alias("body"))), F.replace(standard, F.concat(F.lit('"'), c, F.lit('"')), F.lit('"parts"')),
        F.to_json(F.struct(n.alias("t"), F.transform(lines, lambda s: F.struct(F.lit("odd").alias("kind"), s.alias("text"))).alias("slots"))),
    ]
    pick = F.pmod(n, F.lit(len(shapes)))
    answer = F.lit(None).cast("string")
    for i, s in enumerate(shapes):
        answer = F.when(pick == i, s).otherwise(answer)
    return table(spark, d, "documents").select("doc_id", answer.alias("raw"))


_ANSWERED = rf"""
x AS (SELECT doc_id, doc_id % 12 AS k, coalesce(text, '') AS text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: trim(s) <> '') AS ls FROM documents),
p AS (SELECT doc_id, k, CASE WHEN k = 9 THEN [{BARE.format('text')}] ELSE list_filter(list_transform(ls, lambda s: {BARE.format('s')}), lambda s: s <> '') END AS ps, text FROM x),
r AS (SELECT doc_id, k, CASE WHEN k = 9 AND ps[1] = '' THEN [] ELSE ps END AS ps, text FROM p),
j AS (SELECT doc_id, k, ps, CASE WHEN k IN (7) THEN CASE WHEN {BARE.format('text')} = '' THEN 'EMPTY' ELSE 'NOT_JSON' END WHEN k = 8 THEN 'NOT_OBJECT' WHEN k = 10 THEN 'NO_CHAPTERS' WHEN k = 5 THEN 'TOPIC_NUMBER'
  WHEN k = 11 THEN CASE WHEN len(ps) = 0 THEN 'NO_BODY' ELSE 'BLOCK_KIND' END WHEN len(ps) = 0 THEN 'NO_BODY' END AS problem FROM r)"""


@query("answers_topics", f"WITH {_ANSWERED} SELECT doc_id, CAST(1 AS BIGINT) AS chapter, doc_id AS topic, len(ps) AS passages, sha256(array_to_string(ps, chr(10))) AS digest FROM j WHERE problem IS NULL")
def answers_topics(spark, d):
    """What answers of every shape say about their topic."""
    read = _shapes(spark, d).select("doc_id", F.explode(va.written_answer(F.col("raw"))["topics"]).alias("t"))
    words = F.array_join(F.transform("t.passages", lambda p: p["text"]), "\n")
    return read.select("doc_id", "t.chapter", "t.topic", F.size("t.passages").cast("long").alias("passages"), F.sha2(words, 256).alias("digest"))


@query("answers_refused", f"WITH {_ANSWERED} SELECT doc_id, problem FROM j WHERE problem IS NOT NULL")
def answers_refused(spark, d):
    """Answers that can't be read, with the reason."""
    return _shapes(spark, d).select("doc_id", va.written_answer(F.col("raw"))["problem"].alias("problem")).filter("problem IS NOT NULL")


# --- lectures


def _lecture(spark, d):
    """Topics, blocks and answers of the conversations: three topics a chapter, two turns a topic; some turns say nothing, some topics have no turn."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    place = {"chapter": (F.floor(F.col("turn") / 6) + 1).cast("int"), "topic": (F.floor(F.col("turn") / 2) % 3 + 1).cast("int")}
    mute, short = (F.col("conv_id") + F.col("turn")) % 11 == 0, F.col("role") == "system"
    blocks = turns.withColumns(place).select(
        F.col("conv_id").alias("deck"), "chapter", "topic", F.col("turn").alias("block"), (F.col("turn") + 1).cast("int").alias("page"), (F.col("turn") * 1500).cast("long").alias("start_ms"),
        F.when(~mute & ~short, F.col("text")).otherwise("").alias("text"), F.when(~mute, F.col("text")).otherwise(" ").alias("summary"),
    )
    first = F.min("page")
    topics = blocks.groupBy("deck", "chapter", "topic").agg(first.alias("from_page"), F.max("page").alias("to_page")).withColumn("title", F.concat(F.lit("topic "), F.col("topic").cast("string")))
    extra = blocks.select("deck").distinct().select("deck", F.lit(9).alias("chapter"), F.lit(1).alias("topic"), F.lit(99).alias("from_page"), F.lit(99).alias("to_page"), F.lit("not taught").alias("title"))
    return topics.unionByName(extra), blocks


PART_TOPICS, PART_CHARS = 2, 1500


def _answers(spark, d):
    """Each request's answer, made of its drafts: as they are, three times, an echo, a beginning, nothing, twice, with an end, or of another topic."""
    topics, blocks = _lecture(spark, d)
    bodies = lw.draft_bodies(topics, blocks)
    said = bodies.filter("text <> ''").join(lw.parts_of(bodies, PART_TOPICS, PART_CHARS), lw.TOPIC).select(*lw.TOPIC, "part", "text")
    k, t, n = F.pmod(F.col("deck") + 3 * F.col("chapter") + F.col("topic"), F.lit(8)), F.col("text"), F.col("topic")

    def entry(words, number=n):
        return F.struct(number.cast("int").alias("t"), F.array(F.struct(F.lit("L").alias("label"), words.alias("text"))).alias("passages"))

    full = entry(F.concat(t, F.lit(" End.")))
    entries = (
        F.when(k == 0, F.array(entry(t))).when(k == 1, F.array(entry(F.concat(t, F.lit("\n"), t, F.lit("\n"), t)))).when(k == 2, F.array(entry(F.lit("类型：教学安排"))))
        .when(k == 3, F.array(entry(F.substr(t, F.lit(1), F.floor(F.length(t) / 5).cast("int") + 1)))).when(k == 4, F.slice(F.array(full), 1, 0)).when(k == 5, F.array(full, entry(t)))
        .when(k == 6, F.array(full)).otherwise(F.array(full, entry(t, n + 100)))
    )
    per = said.groupBy("deck", "part").agg(F.array_sort(F.collect_list(F.struct("chapter", "topic", entries.alias("e")))).alias("all"))
    chapters = F.transform("all", lambda x: F.struct(x["chapter"].alias("c"), x["e"].alias("topics")))
    raw = F.to_json(F.struct(chapters.alias("chapters")))
    m = F.col("deck") % 7
    good = F.when(m == 2, F.concat(F.lit("```json\n"), raw, F.lit("\n```"))).when(m == 3, F.concat(F.lit('{"result": '), raw, F.lit("}"))).otherwise(raw)
    rows = per.select("deck", "part", F.lit(2).alias("attempt"), good.alias("raw")).filter("deck % 7 <> 1")
    return rows.unionByName(per.filter("deck % 7 IN (0, 5)").select("deck", "part", F.lit(1).alias("attempt"), F.lit("no answer in this form").alias("raw"))).filter("NOT (deck % 7 = 5 AND attempt = 2)")


def _tidy_sql(col: str) -> str:
    out = f"replace({col}, chr(13) || chr(10), chr(10))"
    for w in STRIP_WORDS:
        out = f"replace({out}, {_Q(w)}, '')"
    line = "x"
    for pattern, to in ((r"^[ ]+|[ ]+$", ""), (r"[ \t]{2,}", " "), (r"^[，、；：\s]+", ""), (r"([，、；])[，、；]+", r"\1"), ("([。！？])[，、；]+", r"\1"), (r"^[ ]+|[ ]+$", "")):
        line = f"regexp_replace({line}, {_Q(pattern)}, {_Q(to)}, 'g')"
    cleaned = f"list_transform(list_transform(string_split({out}, chr(10)), lambda x: {line}), lambda y: {{'t': y, 'c': {st.clean_line_sql('y')}}})"
    kept = f"list_filter({cleaned}, lambda z: z.t <> '' AND z.c <> '' AND NOT {st.is_noise_sql('z.c')} AND NOT regexp_matches(z.t, '{VISION_BEGIN}'))"
    return f"array_to_string(list_transform({kept}, lambda z: z.t), chr(10))"


def _hits_sql(col: str) -> str:
    return "(" + " + ".join(f"(length({col}) - length(replace({col}, {_Q(w)}, ''))) // {len(w)}" for w in lw.FILLERS) + ")"


def _content_sql(col: str) -> str:
    return rf"length(regexp_replace({col}, '[\x00-\x40\x5B-\x60\x7B-\x7F\x{{2000}}-\x{{206F}}\x{{3000}}-\x{{303F}}\x{{FF00}}-\x{{FFEF}}]', '', 'g'))"


def _normal_sql(col: str) -> str:
    return rf"regexp_replace(regexp_replace({col}, '\s+', '', 'g'), '[，。！？、；：,.!?;]', '', 'g')"


_BODIES = rf"""
t AS (SELECT conv_id AS deck, turn // 6 + 1 AS chapter, (turn // 2) % 3 + 1 AS topic, turn, CASE WHEN (conv_id + turn) % 11 = 0 THEN '' ELSE {BARE.format('text')} END AS words FROM conversations),
b AS (SELECT deck, chapter, topic, coalesce(string_agg(words, chr(10) || chr(10) ORDER BY turn) FILTER (words <> ''), '') AS text, list(turn ORDER BY turn) AS blocks, min(turn) AS f, max(turn) AS l, count_if(words = '') AS silent FROM t GROUP BY ALL)"""
_PARTS = rf"""
o AS (SELECT deck, chapter, topic, length(text) AS size, row_number() OVER (PARTITION BY deck ORDER BY chapter, topic) AS i FROM b WHERE text <> ''),
g AS (SELECT deck, i, 1 AS part, 1 AS n, size AS c FROM o WHERE i = 1
  UNION ALL SELECT g.deck, o.i, CASE WHEN g.n >= {PART_TOPICS} OR g.c + o.size > {PART_CHARS} THEN g.part + 1 ELSE g.part END, CASE WHEN g.n >= {PART_TOPICS} OR g.c + o.size > {PART_CHARS} THEN 1 ELSE g.n + 1 END,
    CASE WHEN g.n >= {PART_TOPICS} OR g.c + o.size > {PART_CHARS} THEN o.size ELSE g.c + o.size END FROM g JOIN o ON o.deck = g.deck AND o.i = g.i + 1)"""
_MET = rf"""
u AS (SELECT b.*, g.part, (b.deck + 3 * b.chapter + b.topic) % 8 AS k FROM b JOIN o ON b.deck = o.deck AND b.chapter = o.chapter AND b.topic = o.topic JOIN g ON g.deck = o.deck AND g.i = o.i),
rd AS (SELECT deck, part, deck % 7 NOT IN (1, 5) AND bool_or(k <> 4) AS readable FROM u GROUP BY deck, part),
a AS (SELECT u.*, readable, CASE k WHEN 0 THEN text WHEN 1 THEN text || chr(10) || text || chr(10) || text WHEN 2 THEN '类型：教学安排' WHEN 3 THEN left(text, length(text) // 5 + 1) WHEN 4 THEN NULL ELSE text || ' End.' END AS said FROM u JOIN rd ON u.deck = rd.deck AND u.part = rd.part),
a1 AS (SELECT *, CASE WHEN readable THEN {BARE.format('said')} END AS w FROM a),
a2 AS (SELECT *, {BARE.format(_tidy_sql('w'))} AS tidy FROM a1),
a3 AS (SELECT *, CASE WHEN tidy <> '' THEN tidy ELSE w END AS body FROM a2),
a4 AS (SELECT *, {_content_sql('text')} AS n, {_content_sql('body')} AS m, {_hits_sql('text')} AS hs, {_hits_sql('body')} AS hd FROM a3),
a5 AS (SELECT *, CASE WHEN body IS NULL THEN NULL WHEN body = '' THEN 'EMPTY' WHEN n > 0 AND m > ceil(n * 1.6) + 60 THEN 'TOO_LONG'
    WHEN ({' OR '.join(f"contains(body, {_Q(w)})" for w in lw.ECHOES)}) AND length(body) <= 40 OR n >= 200 AND m <= 20 THEN 'BROKEN' END AS refused,
  list_filter([CASE WHEN {_normal_sql('text')} = {_normal_sql('body')} AND {_normal_sql('text')} <> '' THEN 'SAME' END, {', '.join(f"CASE WHEN contains(body, {_Q(w)}) THEN 'ADDRESS:{w}' END" for w in lw.ADDRESSES)},
    CASE WHEN contains('{lw.CUT_ENDS}', right(body, 1)) THEN 'CUT' END], lambda x: x IS NOT NULL) AS held,
  CASE WHEN hs > 0 AND hd > hs * 0.34 THEN 'FILLER' END AS filler, CASE WHEN n > 0 AND m > 0 AND m / n < 0.3 THEN 'SHRUNK' END AS shrunk FROM a4),
a6 AS (SELECT *, body IS NOT NULL AND refused IS NULL AS taken, list_concat(held, list_filter([filler, shrunk], lambda x: x IS NOT NULL)) AS notes FROM a5)"""


@query("lecture_parts", f"WITH RECURSIVE {_BODIES}, {_PARTS} SELECT o.deck, chapter, topic, part, size FROM o JOIN g ON o.deck = g.deck AND o.i = g.i")
def lecture_parts(spark, d):
    """Which request each draft goes out with."""
    bodies = lw.draft_bodies(*_lecture(spark, d))
    return bodies.join(lw.parts_of(bodies, PART_TOPICS, PART_CHARS), lw.TOPIC).select(*lw.TOPIC, "part", F.length("text").alias("size"))


@query("lecture_assembled", f"""
WITH RECURSIVE {_BODIES}, {_PARTS}, {_MET}
SELECT deck, chapter, topic, dense_rank() OVER (PARTITION BY deck ORDER BY chapter) AS chapter_no, CASE WHEN chapter = 2 THEN 'chapter 2' ELSE '第 ' || dense_rank() OVER (PARTITION BY deck ORDER BY chapter) || ' 部分' END AS chapter_title,
  array_to_string(blocks, ',') AS blocks, CASE WHEN taken THEN (CASE WHEN len(held) = 0 AND filler IS NULL THEN 'written' ELSE 'draft' END) ELSE 'failed' END AS register, CASE WHEN taken THEN array_to_string(notes, '|') ELSE '' END AS notes,
  sha256(CASE WHEN taken THEN body ELSE text END) AS digest, f + 1 AS anchor_page, f * 1500 // 1000 AS anchor_sec FROM a6
""")
def lecture_assembled(spark, d):
    """Every draft as it ends up: written, a draft still, or left as it was."""
    topics, blocks = _lecture(spark, d)
    lecture = lw.assemble(topics, blocks, _answers(spark, d), PART_TOPICS, PART_CHARS)[0]
    names = topics.select("deck", "chapter").distinct().withColumn("chapter_title", F.when(F.col("chapter") == 2, " chapter 2 ").otherwise(" "))
    words = F.array_join(F.transform("passages", lambda p: p["text"]), "\n\n")
    return lw.titled_chapters(lecture, names).select(
        "deck", "chapter", "topic", "chapter_no", "chapter_title", F.array_join("blocks", ",").alias("blocks"), "register", F.array_join("notes", "|").alias("notes"), F.sha2(words, 256).alias("digest"), "anchor_page", "anchor_sec"
    )


@query("lecture_failures", f"""
WITH RECURSIVE {_BODIES}, {_PARTS}, {_MET}
SELECT deck, part, NULL AS chapter, NULL AS topic, CASE deck % 7 WHEN 1 THEN 'NO_ANSWER' WHEN 5 THEN 'NOT_JSON' ELSE 'NO_TOPIC' END AS code FROM rd WHERE NOT readable
UNION ALL SELECT deck, part, chapter, topic, 'REPEATED' FROM a6 WHERE readable AND k = 5
UNION ALL SELECT deck, part, chapter, topic + 100, 'FOREIGN' FROM a6 WHERE readable AND k = 7
UNION ALL SELECT deck, part, chapter, topic, unnest(CASE WHEN taken THEN notes ELSE [coalesce(refused, 'NOT_RETURNED')] END) FROM a6 WHERE readable
""")
def lecture_failures(spark, d):
    """Every request and topic that was not taken as it came, with its code."""
    topics, blocks = _lecture(spark, d)
    return lw.assemble(topics, blocks, _answers(spark, d), PART_TOPICS, PART_CHARS)[1]


@query("lecture_warnings", f"""
WITH {_BODIES} SELECT deck, 'NO_BLOCKS' AS code, 1 AS n FROM b GROUP BY deck
UNION ALL SELECT deck, 'NO_TEXT', count(*) FROM b WHERE text = '' GROUP BY deck UNION ALL SELECT deck, 'SILENT_BLOCK', sum(silent) FROM b GROUP BY deck HAVING sum(silent) > 0
""")
def lecture_warnings(spark, d):
    """What had nothing to write from."""
    topics, blocks = _lecture(spark, d)
    return lw.assemble(topics, blocks, _answers(spark, d), PART_TOPICS, PART_CHARS)[2]
