"""Queries of lectures as text: every document is a lecture whose lines are its units, written, read back and edited."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.operators import lecture_text as lt
from lectern.plans.registry import query
from lectern.session import table

KINDS = ("elaboration", "definition", "procedure", "note", "example")


def _lectures(spark, d):
    """Topics, decks and sources of the documents: a unit per line, two a topic, three topics a chapter; a unit rests on the source of its number."""
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lt.body), lambda s: s != "")
    # an outer explode: an inner one would first filter by its array, and compute that twice
    flat = table(spark, d, "documents").select(F.col("doc_id").alias("deck"), F.posexplode_outer(lines).alias("k", "line")).filter("k IS NOT NULL").repartition("deck")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("k") % len(KINDS) + 1).cast("int"))
    empty, number = F.lit(""), (F.col("k") + 1).cast("int")
    example = kind == "example"
    block = F.struct(
        "k", kind.alias("kind"), F.concat(F.lit("unit "), number.cast("string")).alias("title"), F.when(example, empty).otherwise(F.col("line")).alias("text"), F.when(example, F.col("line")).otherwise(empty).alias("stem"),
        F.when(example, F.concat(F.lit(lt.SOLUTION + "\n"), "line")).otherwise(empty).alias("solution"), F.array(number).alias("sources"),
    )
    place = flat.select("deck", (F.floor(F.col("k") / 6) + 1).cast("int").alias("chapter"), (F.floor(F.col("k") / 2) % 3 + 1).cast("int").alias("topic"), block.alias("b"))
    topics = place.groupBy("deck", "chapter", "topic").agg(F.array_sort(F.collect_list("b")).alias("blocks")).select(
        "deck", "chapter", F.concat(F.lit("part|"), F.col("chapter").cast("string")).alias("chapter_title"), "topic", F.lit("").alias("title"), F.flatten(F.transform("blocks", lambda b: b["sources"])).alias("sources"), "blocks"
    )
    sources = flat.select("deck", number.alias("source"), (number + 3).alias("page"), (number * 1000).cast("long").alias("start_ms"), F.lit("s\nx").alias("summary"))
    decks = table(spark, d, "documents").select(F.col("doc_id").alias("deck"), F.lit("a | title").alias("title"), F.lit("[]").alias("outline"))
    return lt.review_units(topics), decks, sources


_LINES = r"""
ls AS (SELECT doc_id AS deck, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: regexp_replace(replace(s, chr(13), chr(10)), '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ls FROM documents),
n AS (SELECT deck, ls, len(ls) AS n, deck % 9 AS e FROM ls)"""


@query("lecture_text_round_trip", f"""
WITH {_LINES} SELECT deck, n AS units, sha256(array_to_string(list_transform(range(1, n + 1), lambda k:
  'c' || ((k - 1) // 6 + 1) || 't' || (((k - 1) // 2) % 3 + 1) || 'b' || ((k - 1) % 2 + 1) || '|' || ['elaboration', 'definition', 'procedure', 'note', 'example'][(k - 1) % 5 + 1] || '|unit ' || k || '|' || k || '|' || ls[k]
  || CASE WHEN k % 5 = 0 THEN '|>>> SOLUTION' || chr(10) || ls[k] ELSE '|' END), chr(10))) AS digest FROM n
""")
def round_trip(spark, d):
    """Every unit of every lecture, written as text and read back."""
    read = lt.write_lecture(*_lectures(spark, d)).select("deck", lt.read_lecture(F.col("text")).alias("x"))
    blocks = F.flatten(F.transform("x.topics", lambda t: t["blocks"]))
    said = F.transform(blocks, lambda b: F.concat_ws("|", F.array_join(b["refs"], ","), b["kind"], b["title"], F.array_join(b["sources"].cast("array<string>"), ","), b["text"], b["solution"]))
    return read.select("deck", F.size(blocks).cast("long").alias("units"), F.sha2(F.array_join(said, "\n"), 256).alias("digest"))


def _edited(spark, d):
    units, decks, sources = _lectures(spark, d)
    text, e = F.col("text"), F.col("deck") % 9

    def once(a, b):
        at = F.instr(text, a)
        return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.lit(b), F.substr(text, at + len(a)))).otherwise(text)

    edit = (
        F.when(e == 1, once("ref=c1t1b1 ", "ref=c9t999b9 ")).when(e == 2, once("src=1\n", "src=999999\n")).when(e == 3, F.replace(text, F.lit("#!section "), F.lit("#!section x"))).when(e == 4, once(">>> BLOCK 讲解", ">>> BLOCK 怪"))
        .when(e == 5, F.concat(text, F.lit("\n"), F.substr(text, F.instr(text, "##!topic ")))).when(e == 6, once("##!topic 1 1 |", "##!topic one |")).when(e == 7, once("src=1\n", "src=2\n"))
        .when(e == 8, F.concat(text, F.lit("\n##!topic 99 1 | empty | 章=x\n"))).otherwise(text)
    )
    return lt.write_lecture(units, decks, sources).select("deck", edit.alias("text")), units, sources


@query("lecture_text_problems", f"""
WITH {_LINES}, t AS (SELECT *, (n + 1) // 2 AS topics, (n + 5) // 6 AS chapters FROM n)
SELECT deck, 'NO_TOPIC' AS code, 1 AS n FROM t WHERE n = 0 AND e NOT IN (8)
UNION ALL SELECT deck, 'SECTION', 1 FROM t WHERE e = 3
UNION ALL SELECT deck, unnest(['REF_UNKNOWN', 'UNIT_LOST']), 1 FROM t WHERE e = 1 AND n > 0
UNION ALL SELECT deck, unnest(['SRC_UNKNOWN', 'SOURCE_LOST']), 1 FROM t WHERE e = 2 AND n > 0
UNION ALL SELECT deck, 'BLOCK_KIND', 1 FROM t WHERE e = 4 AND n > 0
UNION ALL SELECT deck, 'TOPIC_REPEATED', topics FROM t WHERE e = 5 AND n > 0
UNION ALL SELECT deck, 'CHAPTER_SPLIT', chapters FROM t WHERE e = 5 AND chapters > 1
UNION ALL SELECT deck, 'TOPIC_FORMAT', 1 FROM t WHERE e = 6 AND n > 0
UNION ALL SELECT deck, CASE WHEN n > 1 THEN 'SRC_OUTSIDE' ELSE 'SRC_UNKNOWN' END, 1 FROM t WHERE e = 7 AND n > 0
UNION ALL SELECT deck, 'SOURCE_LOST', 1 FROM t WHERE e = 7 AND n > 0
UNION ALL SELECT deck, 'EMPTY_TOPIC', 1 FROM t WHERE e = 8
""")
def problems(spark, d):
    """What keeps edited lectures from being taken over: invented references, sources beyond their units, lost units and broken marks."""
    return lt.merge_lecture(*_edited(spark, d))[1]


@query("lecture_text_merged", f"""
WITH {_LINES}, k AS (SELECT deck, unnest(range(1, n + 1)) AS k, ls FROM n WHERE e = 0)
SELECT deck, (k - 1) // 6 + 1 AS chapter_no, 'part ' || ((k - 1) // 6 + 1) AS chapter_title, ((k - 1) // 2) % 3 + 1 AS topic_no, (k - 1) % 2 + 1 AS block_no, k + 3 AS from_page, k * 1000 AS start_ms, k AS first_source, sha256(ls[k]) AS digest FROM k
""")
def merged(spark, d):
    """The blocks of lectures that were taken over, with the places of their sources."""
    out = lt.merge_lecture(*_edited(spark, d))[0]
    return out.select("deck", "chapter_no", "chapter_title", "topic_no", "block_no", "from_page", "start_ms", "first_source", F.sha2(F.concat("text", "stem"), 256).alias("digest"))
