"""Study analytics over an append-only attempt log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PER_DAY, PER_SECTION = 20, 30
Z95 = 1.96
DENSITY_LOW, DENSITY_HIGH = 1.5, 2.5


def counts_as_wrong(recall: Column, auto: Column) -> Column:
    """A self-rating decides; without one only a definite automatic verdict is wrong."""
    return F.when(recall.isNotNull(), recall == "again").otherwise(F.coalesce(auto == "incorrect", F.lit(False)))


def agreement(recall: Column, auto: Column) -> Column:
    """Whether automatic verdict and self-rating agree; null where one of them does not say."""
    return F.when(recall.isNotNull() & (auto != "unknown"), (auto == "correct") == (recall != "again"))


def attribution(attempts: DataFrame, points: DataFrame, quiz: str, point: str, at: str, seq: str, wrong: str = "wrong") -> DataFrame:
    """Per point: attempts, wrong ones and the last wrong attempt; points without attempts are listed too.

    Attempts of items that are gone are left out (inner join); an item with several points counts for each.
    """
    joined = attempts.join(points.select(quiz, point), quiz)
    per = joined.groupBy(point).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(wrong).alias("wrong"), F.max(F.when(F.col(wrong), F.struct(at, seq))).alias("_last")
    )
    zero = F.lit(0)
    return points.select(point).distinct().join(per, point, "left").select(
        point, F.coalesce("attempts", zero).alias("attempts"), F.coalesce("wrong", zero).alias("wrong"), F.col(f"_last.{seq}").alias("last_wrong")
    )


def mastery(attempts: DataFrame, group: list[str], at: str, seq: str, wrong: str = "wrong") -> DataFrame:
    """Newest five flags and a label from the newest three: too few, all wrong, all right or mixed."""
    w = W.partitionBy(*group).orderBy(F.col(at).desc(), F.col(seq).desc())
    ranked = attempts.withColumn("_r", F.row_number().over(w))
    per = ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(wrong).alias("wrong"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= 5, F.struct("_r", wrong)))), lambda x: F.when(x[wrong], "W").otherwise("R")), "").alias("newest"),
        F.count_if(F.col(wrong) & (F.col("_r") <= 3)).alias("_w3"),
    )
    label = F.when(F.col("attempts") < 3, "insufficient").when(F.col("_w3") == 3, "allWrong").when(F.col("_w3") == 0, "allRight").otherwise("mixed")
    return per.withColumn("label", label).drop("_w3")


def rate_ledger(log: DataFrame, day: str, course: str, section: str) -> DataFrame:
    """Counts by day and by course and section in one pass, with what is left and whether more is allowed."""
    g = log.groupingSets([[F.col(day)], [F.col(course), F.col(section)]], F.col(day), F.col(course), F.col(section)).agg(F.count(F.lit(1)).alias("n"), F.grouping(F.col(day)).alias("_g"))
    cap = F.when(F.col("_g") == 0, PER_DAY).otherwise(PER_SECTION)
    left = F.greatest(F.lit(0), cap - F.col("n"))
    return g.select(F.when(F.col("_g") == 0, "day").otherwise("section").alias("kind"), day, course, section, "n", left.alias("remaining"), (left > 0).alias("allowed"))


def backlog(items: DataFrame, is_new: Column, due: Column, now: Column, group: list[str]) -> DataFrame:
    """New and due items, never added up; an item without a due date that is not new is neither."""
    return items.groupBy(*group).agg(F.count_if(is_new).alias("new_items"), F.count_if(~is_new & (due <= now)).alias("due_items"))


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """95 % score interval; null for n of 0, clamped to 0 and 1."""
    p = successes / n
    centre, half = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    low, high = (centre - half) / (1 + z * z / n), (centre + half) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), low)), F.when(n > 0, F.least(F.lit(1.0), high))


def density_advice(cards: Column, pages: Column) -> Column:
    ratio = cards / pages
    return F.when(pages.isNull() | (pages < 1), "noPages").when(ratio < DENSITY_LOW, "sparse").when(ratio > DENSITY_HIGH, "dense").otherwise("fine")


def first_seen(batch: DataFrame, key: Column, ordinal: list[str], existing: DataFrame | None = None) -> DataFrame:
    """Rows with ``duplicate_of``: 'existing', 'batch' or null for those to keep. Nothing is dropped silently."""
    rn = F.row_number().over(W.partitionBy("_key").orderBy(*ordinal))
    x = batch.withColumn("_key", key).withColumn("_n", rn)
    if existing is None:
        return x.withColumn("duplicate_of", F.when(F.col("_n") > 1, "batch")).drop("_key", "_n")
    known = existing.select(F.col("key").alias("_key"), F.lit(1).alias("_known")).distinct()
    return x.join(known, "_key", "left").withColumn("duplicate_of", F.when(F.col("_known") == 1, "existing").when(F.col("_n") > 1, "batch")).drop("_key", "_n", "_known")
