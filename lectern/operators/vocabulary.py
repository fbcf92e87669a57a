"""A vocabulary that grows with its lessons: each facet is known, an alias, part of a seed's name, proposed as new, or refused.

A decision sees what earlier lessons added. That asks for no loop over lessons: a name counts as added from the first
place where it is proposed, so the rule for every row is a comparison of its place with that of its name's first
proposal: one aggregate and one join. A batch and a stream of the same lessons in order come to the same vocabulary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.variants import bare

#: Names that are always there, in order, and how a new one is proposed. Marks are taken whole (``++``): a mark of
#: proposal is never itself the name that is proposed.
SEED = ("法则", "概念", "案例", "例题", "公式", "定理", "实验", "故事", "思想", "作业", "教学安排")
PROPOSAL = r"^(?:新增\s*[:：]\s*)++(\S[\s\S]*)$"


def _contained(value: Column, seed: tuple[str, ...]) -> Column:
    """The first name of the seed that the value holds."""
    return F.coalesce(*[F.when(value.contains(s), s) for s in seed])


def decide(facets: DataFrame, seed: tuple[str, ...] = SEED, known: DataFrame | None = None) -> DataFrame:
    """``facets`` with ``name`` (null where refused) and ``decision``: seed, known, alias, part, added, again, refused.

    ``facets``: vocabulary (whose it is), place (an ordered value or struct, different for each row) and value, with other columns kept.
    ``known``: vocabulary, name, aliases of terms from before. ``added`` is the row that adds its name; a later proposal of the same
    name is ``again``. A doubled mark of proposal is one. Null and blank values are refused. An alias that several names have stands for
    the smallest.
    """
    value = bare(F.col("value"))
    rows = facets.withColumn("_v", value).withColumn("_new", F.regexp_extract("_v", PROPOSAL, 1))
    rows = rows.withColumns({"_part": _contained(F.col("_v"), seed), "_new": F.when((F.col("_new") != "") & _contained(F.col("_v"), seed).isNull(), bare("_new"))})
    rows = rows.withColumn("_key", F.coalesce("_new", "_v"))
    if known is None:
        rows = rows.withColumns({"_known": F.lit(None).cast("string"), "_alias": F.lit(None).cast("string")})
    else:
        names = known.select("vocabulary", F.col("name").alias("_key"), F.col("name").alias("_known")).distinct()
        aliases = known.select("vocabulary", F.explode("aliases").alias("_v"), "name").groupBy("vocabulary", "_v").agg(F.min("name").alias("_alias"))
        rows = rows.join(names, ["vocabulary", "_key"], "left").join(aliases, ["vocabulary", "_v"], "left")
    first = rows.filter("_new IS NOT NULL AND _known IS NULL AND _alias IS NULL").groupBy("vocabulary", "_key").agg(F.min("place").alias("_first"))
    rows = rows.join(first, ["vocabulary", "_key"], "left")
    proposed, v = F.col("_new").isNotNull(), F.col("_v")
    decision = (
        F.when(v == "", "refused").when(v.isin(*seed), "seed").when(F.col("_known").isNotNull() & ~proposed, "known").when(F.col("_alias").isNotNull(), "alias").when(F.col("_part").isNotNull(), "part")
        .when(proposed & F.col("_known").isNotNull(), "again").when(proposed & (F.col("place") == F.col("_first")), "added").when(proposed, "again").when(F.col("place") > F.col("_first"), "known").otherwise("refused")
    )
    rows = rows.withColumn("decision", decision)
    d = F.col("decision")
    name = F.when(d == "seed", v).when(d == "alias", F.col("_alias")).when(d == "part", F.col("_part")).when(d != "refused", F.col("_key"))
    return rows.withColumn("name", name).drop("_v", "_new", "_part", "_key", "_known", "_alias", "_first")


def added_terms(decided: DataFrame) -> DataFrame:
    """vocabulary, name, aliases (none), place of the terms that were added."""
    return decided.filter("decision = 'added'").select("vocabulary", "name", F.array().cast("array<string>").alias("aliases"), "place")


def tag_facets(decided: DataFrame, *block: str) -> DataFrame:
    """One row per block: ``facets`` in order, each once, null where all were refused, and the refused values."""
    per = decided.groupBy(*block).agg(F.array_sort(F.collect_list(F.struct("place", "name", "value"))).alias("all"))  # one block
    names = F.array_distinct(F.array_compact(F.transform("all", lambda x: x["name"])))
    refused = F.transform(F.filter("all", lambda x: x["name"].isNull()), lambda x: x["value"])
    return per.select(*block, F.when((F.size(names) > 0) | (F.size(refused) == 0), names).alias("facets"), refused.alias("refused"))


class VocabularyTable:
    """Terms of growing vocabularies in a folder: one part per batch, which a batch that runs again writes again.

    A batch knows what earlier batches added and nothing of its own, so that a retry after a failure decides the same.
    """

    SCHEMA = "vocabulary string, name string, aliases array<string>, place {}"

    def __init__(self, spark: SparkSession, path: str, place: str):
        self.spark, self.path, self.schema = spark, path, self.SCHEMA.format(place)

    def terms(self, before: int | None = None) -> DataFrame:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return self.spark.createDataFrame([], self.schema)
        parts = self.spark.read.schema(self.schema + ", batch long").parquet(self.path)
        return (parts if before is None else parts.filter(F.col("batch") < before)).drop("batch")

    def grow(self, facets: DataFrame, batch: int, seed: tuple[str, ...] = SEED) -> DataFrame:
        """Decide one batch and keep what it adds; for ``foreachBatch``."""
        decided = decide(facets, seed, self.terms(batch))
        added_terms(decided).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        return decide(facets, seed, self.terms(batch))


def stored_terms(raw: DataFrame, seed: tuple[str, ...] = SEED) -> DataFrame:
    """``raw`` (vocabulary, stored: JSON text of any shape) as rows vocabulary, name, aliases; see ``variants.vocabulary``."""
    from lectern.functions.variants import vocabulary

    read = raw.select("vocabulary", vocabulary(F.col("stored"), seed).alias("x"))
    return read.select("vocabulary", F.explode("x.terms").alias("t")).select("vocabulary", "t.name", "t.aliases")

