"""Session and table helpers shared by every part of the library."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lectern")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table by name; ``sf_dir`` may be any path Spark can read."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out to four tasks a core: for tables of few bytes a row in one file, which else are one task, and much work behind each row."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)
