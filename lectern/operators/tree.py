"""Knowledge-tree operators: header statistics, titles, ranges, votes and runs over pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEADER_RATIO, SHELL_RATIO = 0.3, 0.25


def line_frequency(lines: DataFrame, line: str = "line", page: str = "page") -> DataFrame:
    """Number of distinct pages of each line."""
    return lines.groupBy(line).agg(F.countDistinct(page).alias("pages"))


def header_statistics(lines: DataFrame, line: str = "line", page: str = "page", ordinal: str = "ord") -> DataFrame:
    """Per line on two pages or more: pages, share of pages where it comes first, span and density in the span."""
    per_page = lines.groupBy(line, page).agg(F.min(ordinal).alias("o"))
    stats = per_page.groupBy(line).agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("o") == 1).alias("firsts"), F.min(page).alias("lo"), F.max(page).alias("hi"))
    span = F.col("hi") - F.col("lo") + 1
    return stats.filter("pages >= 2").select(line, "pages", (F.col("firsts") / F.col("pages")).alias("first_ratio"), span.alias("span"), (F.col("pages") / span).alias("density"))


def template_class(pages: Column, header_pages: Column, shell_pages: Column) -> Column:
    header = (pages > 0) & (header_pages / pages >= HEADER_RATIO)
    return F.when(header & (shell_pages / pages >= SHELL_RATIO), "shellHeavy").when(header, "header").otherwise("plain")


def attach_by_interval(points: DataFrame, ranges: DataFrame, on: list[str], point: str, lo: str, hi: str) -> DataFrame:
    """Points with every range of their group that holds them."""
    return points.join(ranges, on).filter(F.col(point).between(F.col(lo), F.col(hi)))


def attach_nearest(points: DataFrame, ranges: DataFrame, group: list[str], ident: str, point: str, lo: str, hi: str, ordinal: str) -> DataFrame:
    """Each point with the range of its group at the smallest gap, the first of equals (pages are 1 to a few hundred)."""
    gap = F.greatest(F.col(lo) - F.col(point), F.col(point) - F.col(hi), F.lit(0))
    pairs = points.join(ranges, group).withColumn("gap", gap)
    best = pairs.groupBy(*group, ident).agg(F.min(F.struct("gap", ordinal)).alias("b"))
    return best.select(*group, ident, F.col("b.gap").alias("gap"), F.col(f"b.{ordinal}").alias(ordinal))


def majority_vote(votes: DataFrame, group: list[str], value: str, ordinal: str) -> DataFrame:
    """The most frequent value of each group; of equals the one seen first."""
    counted = votes.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"), F.min(ordinal).alias("first"))
    best = counted.groupBy(*group).agg(F.min(F.struct((-F.col("n")).alias("m"), "first", F.col(value).alias("v"))).alias("b"))
    return best.select(*group, F.col("b.v").alias(value), (-F.col("b.m")).alias("n"))


def merged_runs(pages: DataFrame, group: str, page: str, title: str) -> DataFrame:
    """Runs of consecutive pages with one title; a page without a title continues the run before it."""
    w = W.partitionBy(group).orderBy(page)
    named = F.last(title, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    run = pages.withColumn("_t", named)
    new = F.coalesce(F.lag("_t").over(w), F.lit("")) != F.coalesce("_t", F.lit(""))
    run = run.withColumn("_r", F.sum(F.when(new | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return run.groupBy(group, F.col("_r").alias("run")).agg(F.min(page).alias("from_page"), F.max(page).alias("to_page"), F.max("_t").alias(title))


def chapter_numbers(topics: DataFrame, group: str, ordinal: str, divider: Column, segment: str) -> DataFrame:
    """A chapter starts at a divider title or where the segment differs from the last known one."""
    w = W.partitionBy(group).orderBy(ordinal)
    before = F.last(segment, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    new = divider | F.coalesce(F.col(segment) != before, F.lit(False)) | (F.row_number().over(w) == 1)
    return topics.withColumn("_new", new.cast("int")).withColumn("chapter", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_new")


def expanded_outline(spans: DataFrame, group: list[str], lo: str, hi: str, ordinal: str) -> DataFrame:
    """Block by block, the span that covers it; a later span wins."""
    blocks = spans.filter(F.col(lo) <= F.col(hi)).select(*group, ordinal, F.explode(F.sequence(lo, hi)).alias("block"))
    return blocks.groupBy(*group, "block").agg(F.max(ordinal).alias(ordinal))
