"""Structured Streaming front end of the attempt log (an extension beside the batch operators).

Both functions take a streaming (or batch) DataFrame with ``at timestamp``; a watermark bounds the
state, and rows later than that are dropped by Spark, which the batch ledger then accounts for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATENESS = "2 days"


def hourly_ledger(attempts: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Attempts and wrong ones by section and hour."""
    hour = F.window("at", "1 hour")
    counted = attempts.withWatermark("at", lateness).groupBy(hour, "section").agg(F.count(F.lit(1)).alias("n"), F.count_if("wrong").alias("wrong"))
    return counted.select(F.col("window.start").alias("hour"), "section", "n", "wrong")


def study_sessions(attempts: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Runs of a user's attempts with no pause longer than ``gap``."""
    s = attempts.withWatermark("at", lateness).groupBy(F.session_window("at", gap), "user").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
