"""A lesson from slides, timed lines and page answers: sentences, blocks and what failed, with no line lost.

Lines go to slides by anchors; each page's answer corrects its lines within the edit limit and cuts them in
blocks; an answer that does not cover its page in turn is set aside and the page is one block; blocks on neighbouring pages
are stitched. Lines without a page stay beside the sentences, uncorrected: together they are the input lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import protocol as pr
from lectern.functions.text import MAX_EDIT_RATIO, MAX_EDITS
from lectern.operators import transcript as tr

#: Fixed value: a bridge that leads elsewhere keeps a block apart from the one before it.
TURNS_AWAY = "转到|进入|离开"


def covered(drafts: Column, count: Column) -> Column:
    """Whether blocks cover 1..count in turn."""
    ends = F.aggregate(drafts, F.lit(0), lambda last, d: F.when((last >= 0) & (d["from"] == last + 1) & (d["to"] >= d["from"]) & (d["to"] <= count), d["to"]).otherwise(F.lit(-1)))
    return ends == count


def corrected(lines: DataFrame) -> DataFrame:
    """``lines`` with text, distance and rejected in place of ``attempt``: an edit past its limit, formats aside, is refused."""
    x = lines.withColumns({"_a": pr.correction_text(F.col("text")), "_b": pr.correction_text(F.col("attempt"))})
    limit = F.least(F.lit(MAX_EDITS), F.greatest(F.lit(1), F.floor(F.length("_a") * MAX_EDIT_RATIO))).cast("int")
    x = x.withColumn("_d", F.when(F.abs(F.length("_a") - F.length("_b")) > limit, -1).otherwise(F.levenshtein("_a", "_b", MAX_EDITS)))
    fine = (F.col("_d") >= 0) & (F.col("_d") <= limit)
    x = x.withColumns({"rejected": F.col("attempt").isNotNull() & ~F.coalesce(fine, F.lit(False)), "distance": F.when(F.col("attempt").isNotNull() & fine, F.col("_d")).otherwise(0)})
    return x.withColumn("text", F.when(F.col("attempt").isNotNull() & ~F.col("rejected"), F.col("attempt")).otherwise(F.col("text"))).drop("_a", "_b", "_d", "attempt")


def parse(slides: DataFrame, lines: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sentences, blocks, one row per lesson).

    ``slides``: lesson, page, anchor_ms; ``lines``: lesson, line, start_ms, end_ms, text; ``answers``: lesson, page, raw, where
    a page without an answer is one block. A page's lines, and a lesson's blocks, are folded as one array.
    """
    placed = tr.assign_lines(slides, lines)
    page = W.partitionBy("lesson", "page").orderBy("start_ms", "line")
    placed = placed.withColumn("n", F.when(F.col("page").isNotNull(), F.row_number().over(page)))
    edits = answers.select("lesson", "page", F.explode(pr.clean_lines(F.col("raw"))).alias("e")).select("lesson", "page", "e.n", F.col("e.text").alias("attempt"), "e.bridge")
    whole = corrected(placed.join(edits, ["lesson", "page", "n"], "left"))
    sentences = whole.filter("page IS NOT NULL").withColumn("number", F.row_number().over(W.partitionBy("lesson").orderBy("page", "n")))

    pages = sentences.groupBy("lesson", "page").agg(
        F.count(F.lit(1)).cast("int").alias("count"), F.min("number").alias("first"), F.some("rejected").alias("any_rejected"),
        F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("bridge", F.lit("")).alias("bridge")))), lambda x: x["bridge"]).alias("bridges"),
    )
    pages = pages.join(answers, ["lesson", "page"], "left").withColumn("asked", pr.block_drafts(F.coalesce("raw", F.lit("")), F.col("count"), F.col("bridges")))
    pages = pages.withColumn("fine", covered(F.col("asked"), F.col("count")))
    drafts = F.when(F.col("fine"), F.col("asked")).otherwise(pr.block_drafts(F.lit(""), F.col("count"), F.col("bridges")))
    pages = pages.withColumn("drafts", drafts).withColumn("failure", F.when(~F.col("fine"), "BLOCK_COVERAGE").when(F.col("any_rejected"), "MIX_INCOMPLETE"))

    cut = pages.select("lesson", "page", "first", F.explode("drafts").alias("d"))
    cut = cut.select("lesson", "page", (F.col("first") + F.col("d.from") - 1).alias("from"), (F.col("first") + F.col("d.to") - 1).alias("to"), F.col("d.bridge").alias("bridge"))
    # the block of a sentence is the last that begins up to it: one sort, no range join
    starts = cut.select("lesson", F.col("from").alias("number"), F.lit(0).alias("kind"), "from", "to", "page", "bridge", F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"))
    spoken = sentences.select("lesson", "number", F.lit(1).alias("kind"), *[F.lit(None).cast(cut.schema[c].dataType).alias(c) for c in ("from", "to", "page", "bridge")], F.col("start_ms").cast("long"), F.col("end_ms").cast("long"))
    up = W.partitionBy("lesson").orderBy("number", "kind").rowsBetween(W.unboundedPreceding, 0)
    filled = starts.unionByName(spoken).withColumns({c: F.last(c, ignorenulls=True).over(up) for c in ("from", "to", "page", "bridge")}).filter("kind = 1")
    blocks = filled.groupBy("lesson", "from", "to", "page", "bridge").agg(F.min_by("start_ms", "number").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    entry = F.struct(
        F.col("from").cast("int").alias("from"), F.col("to").cast("int").alias("to"), F.col("page").cast("int").alias("first_page"), F.col("page").cast("int").alias("last_page"),
        "start_ms", "end_ms", F.lit(True).alias("joinable"), F.col("bridge").rlike(TURNS_AWAY).alias("opens"),
    )
    per = blocks.groupBy("lesson").agg(F.array_sort(F.collect_list(entry)).alias("b"))
    zipped = F.arrays_zip(F.col("b").alias("b"), tr.stitched(F.col("b"), opens=True).alias("block"))
    flat = per.select("lesson", F.explode(zipped).alias("x")).select("lesson", F.col("x.block").alias("block"), "x.b.*")
    stitched = flat.groupBy("lesson", "block").agg(
        F.min("from").alias("from"), F.max("to").alias("to"), F.min_by("first_page", "from").alias("first_page"), F.max_by("last_page", "from").alias("last_page"),
        F.min_by("start_ms", "from").alias("start_ms"), F.max("end_ms").alias("end_ms"),
    )

    failed = pages.groupBy("lesson").agg(F.array_sort(F.collect_set(F.when(F.col("failure").isNotNull(), F.col("page")))).alias("failed_pages"))
    counts = whole.groupBy("lesson").agg(F.count(F.lit(1)).alias("lines"), F.count("page").alias("sentences"))
    spans = stitched.groupBy("lesson").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("to") - F.col("from") + 1).alias("in_blocks"))
    status = counts.join(spans, "lesson", "left").join(failed, "lesson", "left").fillna(0, ["blocks", "in_blocks"])
    status = status.withColumns({"lossless": F.col("in_blocks") == F.col("sentences"), "partial": (F.col("sentences") < F.col("lines")) | (F.size(F.coalesce("failed_pages", F.array().cast("array<int>"))) > 0)})
    return sentences.select("lesson", "number", "page", "line", "text", "distance", "rejected"), stitched, status.drop("in_blocks")
