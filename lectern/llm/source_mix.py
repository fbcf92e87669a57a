"""Mixing sources to target weights by pivotal dependent rounding.

A source's rate is its target over its size; every document of the source starts with that many
copies in expectation. Whole copies are certain. The fractional parts are rounded by pivotal steps:
two documents meet, and word mass moves from one to the other, in a random direction whose odds keep
each expectation, until one of them has a whole number of copies; the other carries the residue on.
Mass is kept in every step, so a source's taken words differ from its target by the last residue only.

The steps run as a reduction tree. Documents are dealt by hash into blocks of bounded expected size;
a fold inside each block leaves at most one residue, and residues meet in blocks again until each
source has one. No task sees more than a block at once, whatever a source's size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.llm.common import WORD, durable, table, unit_hash

BLOCK = 96
_ITEM = "struct<id:bigint,size:bigint,p:double>"
_EPS = 1e-9


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    Sources in code point order, null last, take the weights in turn; ``share`` of all sizes is dealt
    by weight, a target stops at ``cap`` times its source's size and the excess goes to the others.
    """
    spark = sizes.sparkSession
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # ranks without a global sort in one task: range partitions, numbered inside, offset by the partitions before
    ranged = durable(
        per.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()),
        "mix-sources",
    )
    part, row = F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("row")
    counts = sorted((r["part"], r["count"]) for r in ranged.groupBy(part).count().collect())  # a row per range partition
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    if not offsets:
        return ranged.select("source", "source_size", F.lit(0).alias("weight"), F.lit(0.0).alias("target"))
    before = spark.createDataFrame(offsets, "part long, before long")
    turn = F.pmod(F.col("row") + F.col("before"), F.lit(len(weights))).cast("int")
    ranked = ranged.select("source", "source_size", part, row).join(before, "part").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    ranked = durable(ranked.select("source", "source_size", "weight"), "mix-ranked")

    # the level of a water filling: sources below their cap share what the capped ones leave
    mass = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) >= F.lit(cap) * F.col("source_size")
        n, held, free = ranked.agg(F.count_if(over), F.sum(F.when(over, F.col("source_size"))), F.sum(F.when(~over, F.col("weight")))).first()
        if n == capped or not free:
            break
        capped, level = n, (share * mass - cap * (held or 0)) / free
    over = F.col("weight") * F.lit(level) >= F.lit(cap) * F.col("source_size")
    return ranked.withColumn("target", F.when(over, F.lit(cap) * F.col("source_size")).otherwise(F.col("weight") * F.lit(level)))


def _fold(items: str, seed: int) -> str:
    """SQL that folds an array of items: the state is the open residue ``c`` and what is decided, ``out``."""
    step = f"""
      CASE WHEN acc.c IS NULL THEN named_struct('c', x, 'out', acc.out)
      ELSE transform(array(named_struct(
          'up', least(acc.c.size * (1 - acc.c.p), x.size * x.p),
          'down', least(acc.c.size * acc.c.p, x.size * (1 - x.p)),
          'u', shiftrightunsigned(xxhash64(acc.c.id, x.id, {seed}L), 11) / {float(1 << 53)!r}D)),
        m -> transform(array(IF(m.u * (m.up + m.down) < m.down,
            named_struct('p', acc.c.p + m.up / acc.c.size, 'q', x.p - m.up / x.size),
            named_struct('p', acc.c.p - m.down / acc.c.size, 'q', x.p + m.down / x.size))),
          n -> CASE
            WHEN n.p <= {_EPS}D OR n.p >= 1 - {_EPS}D THEN named_struct(
              'c', IF(n.q <= {_EPS}D OR n.q >= 1 - {_EPS}D, CAST(NULL AS {_ITEM}), named_struct('id', x.id, 'size', x.size, 'p', n.q)),
              'out', concat(acc.out, array(named_struct('id', acc.c.id, 'size', acc.c.size, 'more', CAST(round(n.p) AS INT))),
                IF(n.q <= {_EPS}D OR n.q >= 1 - {_EPS}D, array(named_struct('id', x.id, 'size', x.size, 'more', CAST(round(n.q) AS INT))),
                   CAST(array() AS array<struct<id:bigint,size:bigint,more:int>>))))
            ELSE named_struct(
              'c', named_struct('id', acc.c.id, 'size', acc.c.size, 'p', n.p),
              'out', concat(acc.out, array(named_struct('id', x.id, 'size', x.size, 'more', CAST(round(n.q) AS INT))))) END)[0])[0]
      END"""
    return f"aggregate({items}, named_struct('c', CAST(NULL AS {_ITEM}), 'out', CAST(array() AS array<struct<id:bigint,size:bigint,more:int>>)), (acc, x) -> {step})"


def rounded(parts: DataFrame, seed: int) -> DataFrame:
    """``parts``: source, id, size, p in (0, 1), rows (of the source). Returns source, id, size, more (0 or 1)."""
    spare = F.greatest(F.lit(1), F.ceil(F.col("rows") / F.lit(float(BLOCK)))).cast("long")
    level = parts.select("source", spare.alias("blocks"), F.pmod(F.xxhash64("id", "size", F.lit(seed)), spare).alias("block"), "id", "size", "p")
    decided: list[DataFrame] = []
    while True:
        folded = (
            level.groupBy("source", "blocks", "block")
            .agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("id", F.lit(seed + 1)).alias("h"), "id", "size", "p"))).alias("items"))
            .select("source", "blocks", "block", F.expr(_fold(f"transform(items, i -> CAST(named_struct('id', i.id, 'size', i.size, 'p', i.p) AS {_ITEM}))", seed)).alias("f"))
        )
        folded = durable(folded, "mix-level")
        decided.append(folded.select("source", F.explode("f.out").alias("o")).select("source", "o.id", "o.size", "o.more"))
        left = folded.filter("f.c IS NOT NULL").select("source", "blocks", "block", "f.c.id", "f.c.size", "f.c.p")
        if left.filter("blocks > 1").isEmpty():
            break
        up = F.greatest(F.lit(1), F.ceil(F.col("blocks") / F.lit(float(BLOCK)))).cast("long")
        level = left.select("source", up.alias("blocks"), F.pmod("block", up).alias("block"), "id", "size", "p")
    last = left.select("source", "id", "size", (unit_hash(F.col("id"), F.lit(seed + 2)) < F.col("p")).cast("int").alias("more"))
    for d in decided:
        last = last.unionByName(d)
    return last


def _dealt(bundles: DataFrame, more: DataFrame, rated: DataFrame) -> DataFrame:
    """source, id, size, more (0 or 1) of each row: the rows of a bundle are numbered, and the first ones have one more."""
    bundle = ("source", "id", "size")

    def same(x: DataFrame, y: DataFrame, *also: str):
        return reduce(lambda a, b: a & b, [x[c].eqNullSafe(y[c]) for c in (*bundle, *also)])

    several = bundles.filter("m > 1").select(*bundle, "whole")
    if several.isEmpty():
        return more
    several = durable(several.join(more, same(several, more)).select(*[several[c] for c in bundle], (F.col("whole") + F.col("more")).alias("taken")), "mix-several")
    ones = bundles.filter("m = 1").select(*bundle)
    ones = more.join(ones, same(more, ones), "left_semi")
    # numbered without a whole bundle in one task: by the tasks that wrote them, then inside each
    rows = rated.join(several, same(rated, several), "left_semi").select(*bundle, "part")
    before = F.sum("n").over(Window.partitionBy(*bundle).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = rows.groupBy(*bundle, "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(before, F.lit(0)))
    starts = starts.join(several, same(starts, several)).select(*[starts[c] for c in (*bundle, "part")], "before", "taken")
    inside = rows.withColumn("number", F.row_number().over(Window.partitionBy(*bundle, "part").orderBy(F.lit(1))))
    numbered = inside.join(starts, same(inside, starts, "part"))
    return ones.unionByName(numbered.select(*[inside[c] for c in bundle], (F.col("before") + F.col("number") <= F.col("taken")).cast("int").alias("more")))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 17
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, copies, taken.

    ``size`` is the text's number of words, ``copies`` what the mix takes of the row and ``taken`` the
    words that makes. A null text has size 0 and takes nothing; a null source is a source of its own,
    ranked last; a null id is an id like any other. Rows of one source, id and size are rounded together, as
    a bundle of which so many are taken once more; which of them, they being alike, is left open. With no
    words at all, or no rows, every target is 0. Decisions depend on ids, sizes and ``seed`` only, so
    that reruns agree.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    sizes = durable(docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), size.alias("size")).withColumn("part", F.spark_partition_id()), "mix-sizes")
    targets = source_targets(sizes, weights, share, cap)
    targets = targets.join(sizes.filter("size > 0").groupBy(F.col("source").alias("s")).agg(F.count(F.lit(1)).alias("rows")), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    targets = durable(targets, "mix-targets")
    t = targets.select(F.col("source").alias("s"), "source_size", "target", "rows")
    rated = sizes.join(t, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    sure = F.floor("rate").cast("int")
    part = F.col("rate") - F.floor("rate")
    exact = (part <= _EPS) | (part >= 1 - _EPS)
    rated = rated.withColumns({"sure": F.when(exact, F.round("rate").cast("int")).otherwise(sure), "p": part, "exact": exact})
    bundles = rated.filter("NOT exact").groupBy("source", "id", "size", "p", "rows").agg(F.count(F.lit(1)).alias("m"))
    whole = F.floor(F.col("m") * F.col("p") + _EPS)
    bundles = durable(bundles.withColumn("whole", whole.cast("long")).withColumn("p", F.col("m") * F.col("p") - whole), "mix-bundles")
    open_ = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
    more = rounded(bundles.filter(open_).select("source", "id", "size", "p", "rows"), seed).select("source", "id", "size", "more")
    more = more.unionByName(bundles.filter(~open_).select("source", "id", "size", F.lit(0).alias("more")))
    rows = _dealt(bundles, more, rated)
    rows = rows.unionByName(rated.filter("exact").select("source", "id", "size", F.lit(0).alias("more")))
    base = t.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    whole = F.when((F.col("rate") - F.floor("rate") >= 1 - _EPS) & (F.col("size") > 0), F.round("rate")).otherwise(F.floor("rate"))
    copies = F.when(F.col("size") > 0, whole.cast("int") + F.col("more")).otherwise(F.lit(0))
    out = rows.join(base, F.col("source").eqNullSafe(F.col("s"))).withColumn("copies", copies)
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


QUERIES = {"op2_source_mix": op2_source_mix}
ORACLE: dict = {}
