"""Layered literal search: filters first, then one literal; no tokens, no ranking.

A hit is (layer, key, place, text, start, preview). Each layer keeps its first ``limit`` hits and reports
how many it left out; the total is limited after that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import find_literal, preview

LIMIT = 40


def layer(df: DataFrame, name: str, key: Column, at: Column, text: Column) -> DataFrame:
    return df.select(F.lit(name).alias("layer"), key.cast("string").alias("key"), at.cast("long").alias("place"), text.alias("text"))


def literal_hits(fragments: DataFrame, needle: str, ignore_case: bool = True) -> DataFrame:
    """Fragments that hold the needle, with its 0-based position and a preview; an empty needle hits nothing."""
    if not needle:
        return fragments.filter(F.lit(False)).withColumns({"start": F.lit(0), "preview": F.lit("")})
    at = find_literal(F.col("text"), F.lit(needle)) if ignore_case else F.instr("text", F.lit(needle)) - 1
    hits = fragments.withColumn("start", at).filter("start >= 0")
    return hits.withColumn("preview", preview(F.col("text"), F.col("start"), F.lit(len(needle))))


def limited(hits: DataFrame, order: dict[str, int], limit: int = LIMIT, total: int = LIMIT) -> DataFrame:
    """First ``limit`` hits of each layer, then the first ``total`` of all; adds found (per layer, before limits)."""
    rank = F.lit(None).cast("int")
    for name, i in order.items():
        rank = F.when(F.col("layer") == name, i).otherwise(rank)
    found = hits.groupBy("layer").agg(F.count(F.lit(1)).alias("found"))
    first = hits.withColumn("_rank", rank).withColumn("_n", F.row_number().over(W.partitionBy("layer").orderBy("key", "place"))).filter(F.col("_n") <= limit)
    return first.orderBy("_rank", "key", "place").limit(total).join(F.broadcast(found), "layer").drop("_rank", "_n")


def catalog(blocks: DataFrame, facets: str, role: str) -> DataFrame:
    """Counts of blocks by role and by distinct facet: kind, name, n."""
    by_facet = blocks.select(F.explode(F.array_distinct(facets)).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit("facet").alias("kind"), "name", "n")
    by_role = blocks.groupBy(F.col(role).alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("role").alias("kind"), "name", "n")
    return by_facet.unionByName(by_role)


# layered search of lessons with modes --------------------------------------------------------------

#: Search modes, the first being the one that filters by tags; the default takes titles and bodies.
TAG_FILTER, TITLE_ONLY, TITLE_BODY = "tagFilter", "titleOnly", "titleBody"
#: Layers by id with their source, whether anything supplies them, and whether a search takes them unasked.
LAYERS = (
    ("final", "finalDoc", True, True),
    ("teacher", "finalDoc", True, True),
    ("outline", "finalDoc", True, True),
    ("pageText", "finalDoc", True, True),
    ("pageVisual", "finalDoc", True, True),
    ("glossary", "finalDoc", True, True),
    ("lecture", "reference", True, True),
    ("teacherExplanation", "finalDoc", False, False),
    ("reference", "reference", False, False),
    ("rag", "rag", False, False),
    ("extra", "extra", False, False),
)
DEFAULT_LAYERS = tuple(x[0] for x in LAYERS if x[2] and x[3])
HIT = "lesson long, layer string, branch int, at array<bigint>, page long, text string, start int"


def mode_of(name: str | None) -> str:
    """A known mode, else the default."""
    return name if name in (TAG_FILTER, TITLE_ONLY, TITLE_BODY) else TITLE_BODY


def layer_signature(layers: Column) -> Column:
    """The same text for the same set of layers."""
    return F.array_join(F.array_sort(F.array_distinct(layers)), "+")


def layer_table(spark) -> DataFrame:
    return spark.createDataFrame(LAYERS, "id string, source string, available boolean, unasked boolean")


def layers_named(asked: DataFrame, spark) -> DataFrame:
    """``asked`` (id) with its registry row; an unknown id keeps itself as label and has no row."""
    known = layer_table(spark)
    return asked.join(F.broadcast(known), "id", "left").withColumn("known", F.col("source").isNotNull())


def search_lessons(
    blocks: DataFrame, sentences: DataFrame, pages: DataFrame, spines: DataFrame, terms: DataFrame, topics: DataFrame, query: str = "", mode: str = TITLE_BODY,
    role: str = "", facets: tuple[str, ...] = (), layers: tuple[str, ...] = DEFAULT_LAYERS, limit: int = LIMIT,
) -> DataFrame:
    """Hits of every lesson: lesson, layer, branch, at (its place inside the branch), page, text, start, and the counts of its layer and lesson.

    ``blocks``: lesson, block, page, role, facets, summary; ``sentences``: lesson, block, ord, page, text; ``pages``: lesson, page,
    page_text, page_visual, failed, gated; ``spines``: lesson, text; ``terms``: lesson, ord, term, page; ``topics``: lesson, topic, page, title, bodies (array).

    Role and facets (any of them) filter in the tag mode only, before texts are looked at, and leave out the
    layers that have no tags. Without query and filter nothing is found; with a filter alone each block that passes is a hit. A block's summary counts where none of
    its sentences hits; the title mode takes summaries and titles only. Failed pages are left out, of pages that are pictures of programs the visual text.
    Each branch keeps its first ``limit`` hits of a lesson, and the lesson its first ``limit`` of these; ``omitted`` tells how many it left out.
    """
    mode, needle, want = mode_of(mode), query.strip().lower(), set(layers)
    tags = mode == TAG_FILTER
    facets, role = (tuple(x.strip() for x in facets if x.strip()), role.strip()) if tags else ((), "")
    filtered = bool(facets or role)
    session = blocks.sparkSession
    none = session.createDataFrame([], HIT)
    if not needle and not filtered:
        return _counted_hits(none, limit)
    found = [none]

    def hits(rows: DataFrame, name: str, branch: int, at: list[Column], page: Column, text: Column) -> DataFrame:
        start = find_literal(text, F.lit(needle)) if needle else F.lit(0)
        x = rows.select(F.col("lesson").cast("long").alias("lesson"), F.lit(name).alias("layer"), F.lit(branch).alias("branch"), F.array(*[a.cast("long") for a in at]).alias("at"), page.cast("long").alias("page"), text.alias("text"), start.cast("int").alias("start"))
        return x.filter("start >= 0")

    passing = blocks
    if role:
        passing = passing.filter(F.col("role") == role)
    if facets:
        passing = passing.filter(F.arrays_overlap("facets", F.array(*map(F.lit, facets))))
    place = [F.col("block"), F.lit(1), F.lit(0)]
    summaries = hits(passing, "final", 1, place, F.col("page"), F.col("summary"))
    if not needle:
        found += [summaries.withColumn("start", F.lit(None).cast("int"))] if "final" in want else []
    elif mode == TITLE_ONLY:
        found += [summaries] if "final" in want else []
    else:
        said = sentences.join(passing.select("lesson", "block", F.col("page").alias("block_page")), ["lesson", "block"])
        told = hits(said, "teacher", 1, [F.col("block"), F.lit(0), F.col("ord")], F.coalesce("page", "block_page"), F.col("text"))
        if "teacher" in want:
            found.append(told)
            heard = told.select("lesson", F.element_at("at", 1).alias("_b")).distinct()
            summaries = summaries.withColumn("_b", F.element_at("at", 1)).join(heard, ["lesson", "_b"], "left_anti").select(*none.columns)
        found += [summaries] if "final" in want else []
    if needle and not filtered:
        none_page = F.lit(None)
        if "outline" in want:
            found.append(hits(spines, "outline", 2, [F.lit(-1), F.lit(0), F.lit(0)], none_page, F.trim("text")))
        whole = pages.filter("NOT failed")
        for i, (name, column, rows) in enumerate((("pageText", "page_text", whole), ("pageVisual", "page_visual", whole.filter("NOT gated")))):
            if name in want and mode != TITLE_ONLY:
                found.append(hits(rows, name, 2, [F.col("page"), F.lit(i), F.lit(0)], F.col("page"), F.trim(column)))
        if "glossary" in want:
            found.append(hits(terms, "glossary", 3, [F.col("ord"), F.lit(0), F.lit(0)], F.col("page"), F.col("term")))
        if "lecture" in want:
            found.append(hits(topics, "lecture", 4, [F.col("topic"), F.lit(0), F.lit(0)], F.col("page"), F.trim("title")))
            if mode != TITLE_ONLY:
                bodies = topics.select("lesson", "topic", "page", F.posexplode("bodies").alias("i", "body"))
                found.append(hits(bodies, "lecture", 4, [F.col("topic"), F.lit(1), F.col("i")], F.col("page"), F.col("body")))
    return _counted_hits(reduce(DataFrame.unionByName, found), limit)


def _counted_hits(hits: DataFrame, limit: int) -> DataFrame:
    branch, lesson = W.partitionBy("lesson", "branch").orderBy("at"), W.partitionBy("lesson").orderBy("branch", "at")
    kept = hits.withColumn("_k", F.row_number().over(branch)).filter(F.col("_k") <= limit)
    n = F.count(F.lit(1))
    kept = kept.withColumns({"in_layer": n.over(W.partitionBy("lesson", "layer")), "omitted": F.greatest(F.lit(0), n.over(W.partitionBy("lesson")) - limit), "_n": F.row_number().over(lesson)})
    return kept.filter(F.col("_n") <= limit).drop("_k", "_n")
