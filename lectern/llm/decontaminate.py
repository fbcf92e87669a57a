"""Benchmark decontamination by SimHash over item-sized windows.

Windows. For a benchmark item of n words, the windows of a text are its runs of n words. A window that
shares no shingle with the item has similarity 0, so the shingles that text and item share (found by an
equi-join, with their positions) say where windows matter. Each of them counts for the windows that cover it,
from one start to another; a running sum over these starts gives what every window of the text has in common with
the item, and the fullest window of each text and item is the one to judge. No window is ever built but that one.

Index. The SimHash of that window is compared with the item's by a multi-index: 64 bits are cut in RADIUS + 1
blocks, and two fingerprints within RADIUS agree in one block at least, so an equi-join on (item, block,
value) finds every such pair. RADIUS is 7: with blocks of 8 bits one unlike pair in thirty-two agrees somewhere.

Check. A candidate is verified by exact weighted Jaccard similarity of five-word shingles, a shingle's
weight being how often it occurs. At the similarity limit two windows differ in some 11 bits of 64 (standard
deviation about 3), so no radius that blocks can serve is certain. The exact way for pairs beyond
the radius is the same check without the index; ``found_by`` tells which way found a row. All of it runs as DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import WS, ascii_lower, durable, table

WIDTH = 5
RADIUS = 7
MIN_SIMILARITY = 0.75


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), WS + "+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def shingles(hashes: Column, width: int) -> Column:
    """Hashes of all windows of ``width`` words, in order; ``hashes`` is evaluated once."""
    return F.transform(
        F.array(hashes),
        lambda w: F.when(
            F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.size(w) - width), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        ).otherwise(F.array().cast("array<bigint>")),
    )[0]


def simhash(hashes: Column, lane_bits: int = 16) -> Column:
    """64-bit SimHash: bit b is set when most elements have it. Counters share long lanes, ``64 / lane_bits`` to each."""
    lanes = 64 // lane_bits
    mask = sum(1 << (lane_bits * i) for i in range(lanes))
    ones = F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask)
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{k}") for k in range(lane_bits)])
    sums = F.aggregate(
        hashes, zero, lambda acc, h: F.struct(*[(acc[f"c{k}"] + F.shiftrightunsigned(h, k).bitwiseAND(ones)).alias(f"c{k}") for k in range(lane_bits)])
    )
    n = F.size(hashes)
    full = F.lit((1 << lane_bits) - 1).cast("long")

    def bits(acc: Column) -> Column:
        out = F.lit(0).cast("long")
        for k in range(lane_bits):
            for i in range(lanes):
                set_ = F.shiftrightunsigned(acc[f"c{k}"], lane_bits * i).bitwiseAND(full) * 2 > n
                bit = 1 << (lane_bits * i + k)
                out = out.bitwiseOR(F.when(set_, F.lit(bit - (1 << 64) if bit >= 1 << 63 else bit).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return F.transform(F.array(sums), bits)[0]


def blocks(fingerprint: Column, radius: int) -> Column:
    """The radius + 1 blocks of a fingerprint, as an array of values."""
    n = radius + 1
    sizes = [64 // n + (1 if i < 64 % n else 0) for i in range(n)]
    out, at = [], 0
    for s in sizes:
        out.append(F.shiftrightunsigned(fingerprint, at).bitwiseAND(F.lit((1 << s) - 1).cast("long")))
        at += s
    return F.array(*out)


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    radius: int = RADIUS, min_similarity: float = MIN_SIMILARITY,
) -> DataFrame:
    """One row per document and item that some window of it resembles: id, item id, start, n_words, similarity, found_by.

    ``start`` is the first word (from 0) of the most similar window, the earliest of equals; ``found_by`` is
    fingerprint where that window's fingerprint lies within the radius, else count. An item
    or document without words resembles nothing; an item of fewer than five words is one shingle. A
    document shorter than an item is one window. Rows of a repeated id are judged each by its own text, and the
    most similar one is told; a row without an id is skipped, since no result could name it. Repeated
    items are judged alike; rows of one item id with different texts are items of their own, of which the most similar one is told. Empty tables give no rows.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "16MB")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    bench = items.select(F.col(item_col).alias("item"), F.xxhash64(F.col(item_text_col)).alias("version"), word_hashes(F.col(item_text_col)).alias("w"))
    bench = bench.filter("item IS NOT NULL AND size(w) > 0").dropDuplicates(["item", "version"])
    bench = durable(bench.withColumn("n", F.size("w")), "bench-words")
    found: DataFrame | None = None
    widths = sorted(r[0] for r in bench.select(F.least("n", F.lit(WIDTH))).distinct().collect())  # at most five numbers
    longest = bench.agg(F.max("n")).first()[0] or 0
    lane_bits = 16 if longest < 1 << 15 else 32
    for width in widths:
        own = bench.filter(F.least("n", F.lit(WIDTH)) == width).select("item", "version", "n", shingles(F.col("w"), width).alias("hs"))
        own = durable(own.withColumn("fp", simhash(F.col("hs"), lane_bits)), "bench-items")
        one = _matches(texts, own, width, radius, min_similarity, lane_bits)
        found = one if found is None else found.unionByName(one)
    if found is None:
        found = texts.select("id").limit(0).join(items.select(F.col(item_col).alias("item")).limit(0), F.lit(False)).select(
            "id", "item", F.lit(0).alias("start"), F.lit(0).alias("n_words"), F.lit(0.0).alias("similarity"), F.lit("").alias("found_by")
        )
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "start", "n_words", "similarity", "found_by")


def fullest_windows(texts: DataFrame, own: DataFrame, width: int) -> DataFrame:
    """The window of each text and item that has most in common with the item: id, row, item, version, n, m, span, start, common.

    ``texts``: id, row, text; ``own``: item, version, n, hs. ``m`` and ``span`` are the numbers of shingles of the item and of the window.
    Common shingles count as often as both sides have them: the k-th occurrence in a text counts for
    windows that start behind the one as many occurrences before it as the item has in all.
    """
    pair = ["id", "row", "item", "version"]
    grams = own.select("item", "version", "n", F.size("hs").alias("m"), F.explode("hs").alias("h")).groupBy("item", "version", "n", "m", "h").agg(F.count(F.lit(1)).alias("times"))
    seen = texts.select("id", "row", shingles(word_hashes(F.col("text")), width).alias("sh")).select("id", "row", F.size("sh").alias("total"), F.posexplode("sh").alias("pos", "h"))
    hits = seen.join(grams, "h").repartition(*pair).distinct()  # what follows needs no other shuffle; a key has the hits of one text
    same = W.partitionBy(*pair, "h")
    hits = hits.withColumn("k", F.row_number().over(same.orderBy("pos")))
    hits = hits.withColumn("past", F.lag("pos").over(W.partitionBy(*pair, "h", F.pmod("k", "times")).orderBy("k"))).withColumn("span", F.least("m", "total"))
    first = F.greatest(F.lit(0), F.coalesce(F.col("past") + 1, F.lit(0)), F.col("pos") - F.col("span") + 1)
    last = F.least(F.col("pos"), F.col("total") - F.col("span"))
    steps = hits.filter(first <= last).select(*pair, "n", "m", "span", F.explode(F.array(F.struct(first.alias("start"), F.lit(1).alias("step")), F.struct((last + 1).alias("start"), F.lit(-1).alias("step")))).alias("e"))
    steps = steps.groupBy(*pair, "n", "m", "span", "e.start").agg(F.sum("e.step").alias("step"))
    common = steps.withColumn("common", F.sum("step").over(W.partitionBy(*pair).orderBy("start").rowsBetween(W.unboundedPreceding, 0)))
    best = common.groupBy(*pair, "n", "m", "span").agg(F.max(F.struct("common", (-F.col("start")).alias("s"))).alias("b"))
    return best.select(*pair, "n", "m", "span", (-F.col("b.s")).alias("start"), F.col("b.common").alias("common"))


def _matches(texts: DataFrame, own: DataFrame, width: int, radius: int, min_similarity: float, lane_bits: int) -> DataFrame:
    pair = ["id", "row", "item", "version"]
    windows = durable(fullest_windows(texts, own, width), "bench-windows")
    read = texts.join(windows.select("id", "row").distinct(), ["id", "row"], "left_semi").dropDuplicates(["id", "row"])
    read = read.select("id", "row", shingles(word_hashes(F.col("text")), width).alias("sh")).join(windows, ["id", "row"])
    prints = read.select(*pair, simhash(F.slice("sh", F.col("start") + 1, F.col("span")), lane_bits).alias("fp"))

    index = own.select("item", "version", F.col("fp").alias("item_fp"), F.posexplode(blocks(F.col("fp"), radius)).alias("block", "value"))
    probe = prints.select(*pair, "fp", F.posexplode(blocks(F.col("fp"), radius)).alias("block", "value"))
    within = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius
    candidates = probe.join(index, ["item", "version", "block", "value"]).filter(within).select(*pair).distinct()

    similarity = F.col("common") / (F.col("span") + F.col("m") - F.col("common"))
    scored = windows.withColumn("similarity", similarity).filter(F.col("similarity") >= min_similarity)
    scored = scored.join(candidates.withColumn("candidate", F.lit(True)), pair, "left")
    way = F.when(F.col("candidate"), F.lit("fingerprint")).otherwise(F.lit("count"))
    best = scored.groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), "n", way.alias("way"))).alias("b"))
    return best.select("id", "item", (-F.col("b.s")).alias("start"), F.col("b.n").alias("n_words"), F.col("b.similarity").alias("similarity"), F.col("b.way").alias("found_by"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontaminate": op7_decontaminate}
ORACLE: dict = {}
