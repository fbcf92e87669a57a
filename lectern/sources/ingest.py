"""Ingest of paged API rows: first arrivals, renumbering, completeness, strict decoding with rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_arrivals(rows: DataFrame, key: list[str], arrival: list[str]) -> DataFrame:
    """The first row of each key in order of arrival."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*arrival))).filter("_n = 1").drop("_n")


def renumbered(rows: DataFrame, group: list[str], key: list[str], arrival: list[str], name: str = "page") -> DataFrame:
    """First arrivals, numbered from 1 inside each group in order of arrival."""
    kept = first_arrivals(rows, group + key, arrival)
    return kept.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*arrival)))


def completeness(rows: DataFrame, group: list[str], key: Column, total: Column) -> DataFrame:
    """received, total and complete (null where no total is known) of each group."""
    g = rows.groupBy(*group).agg(F.countDistinct(key).alias("received"), F.max(total).alias("total"))
    return g.withColumn("complete", F.col("received") >= F.col("total"))


def total_of(*aliases: Column) -> Column:
    """The first alias that is a usable number."""
    return F.coalesce(*[a.try_cast("long") for a in aliases])


def decoded(rows: DataFrame, json: str, schema: str, required: list[str], ordinal: str) -> tuple[DataFrame, DataFrame]:
    """(decoded rows, rejects with the path of what is missing)."""
    x = rows.withColumn("_j", F.from_json(json, schema))
    bad = F.array_compact(F.array(*[F.when(F.col(f"_j.{f}").isNull(), F.lit(f)) for f in required]))
    x = x.withColumn("missing", F.array_join(bad, "|"))
    return x.filter("missing = ''").select(*rows.columns, "_j.*"), x.filter("missing <> ''").select(ordinal, "missing")


def schedule_days(rows: DataFrame, day: Column, start: str, fields: list[str]) -> DataFrame:
    """One row per day with its entries sorted by start."""
    entry = F.struct(start, *[f for f in fields if f != start])
    return rows.groupBy(day.alias("day")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
