"""Notes: inline links with offsets, link addresses, export names and the lineage merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINK = r"\[([^\]\[]*)\]\(([^()\s]*)\)"
HREF = r'<a\s+href="([^"]*)"[^>]*>([^<]*)</a>'


def links(text: Column, pattern: str = HREF) -> Column:
    """array<struct(target, label)> of all links in order."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("target"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("label"))


def linked(df: DataFrame, key: str, text: str, pattern: str = HREF) -> DataFrame:
    """One row per link: key, ord (from 0), target, label."""
    return df.select(key, F.posexplode(links(F.col(text), pattern)).alias("ord", "l")).select(key, "ord", "l.target", "l.label")


def without_links(text: Column, pattern: str = HREF) -> Column:
    """Links replaced by their labels."""
    return F.regexp_replace(text, pattern, "$2")


def query_value(url: Column, name: str) -> Column:
    """A query parameter; of repeated ones the last wins, an absent one is null."""
    found = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit(rf"(?:^|&){name}=([^&]*)"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def lineage_merge(refs: DataFrame, allowed: DataFrame, required: DataFrame) -> DataFrame:
    """Problems of a reorganisation: unit, source, problem. Empty when every reference exists and nothing is lost.

    ``refs``: unit, source; ``allowed`` and ``required``: source.
    """
    unknown = refs.join(allowed.select("source").distinct(), "source", "left_anti").select("unit", "source", F.lit("unknown source").alias("problem"))
    lost = required.select("source").distinct().join(refs.select("source").distinct(), "source", "left_anti")
    return unknown.unionByName(lost.select(F.lit(None).cast(dict(refs.dtypes)["unit"]).alias("unit"), "source", F.lit("not covered").alias("problem")))
