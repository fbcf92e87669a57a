"""Keyed document store on Parquet: validated upsert, lookup, removal, prefix listing, snapshots.

One writer per table. A write goes to a new folder that readers switch to by name, so a failed write
leaves the table as it was; rejected rows are returned with a reason, never dropped silently.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

KEY = ("account", "course", "sub")
ID_PART = r"^[^:\s]{1,200}$"


def record_key(*parts: Column) -> Column:
    return F.concat_ws(":", *parts)


def valid_part(part: Column) -> Column:
    """An identity part: no colon, no white space, 1 to 200 characters."""
    return F.coalesce(part.rlike(ID_PART), F.lit(False))


def validated(rows: DataFrame, key: tuple[str, ...] = KEY, stored_key: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects with ``reason``): bad identity parts, and stored keys that do not fit them."""
    reason = F.lit(None).cast("string")
    if stored_key:
        reason = F.when(F.col(stored_key) != record_key(*map(F.col, key)), "key does not fit the record").otherwise(reason)
    for k in reversed(key):
        reason = F.when(~valid_part(F.col(k)), f"bad {k}").otherwise(reason)
    marked = rows.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def upsert(current: DataFrame, incoming: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Current rows with incoming ones in their place; of several incoming rows with one key the last wins. Adds ``replaced``."""
    a = current.withColumn("_src", F.lit(0))
    b = incoming.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*[F.col(o).desc() for o in order]))).filter("_n = 1").drop("_n")
    both = a.unionByName(b.withColumn("_src", F.lit(1)))
    w = W.partitionBy(*key)
    both = both.withColumns({"_top": F.max("_src").over(w), "_old": F.min("_src").over(w)})
    return both.filter("_src = _top").withColumn("replaced", (F.col("_src") == 1) & (F.col("_old") == 0)).drop("_src", "_top", "_old")


def remove(current: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    return current.join(keys.select(*key).distinct(), key, "left_anti")


class DocumentTable:
    """A table folder: a folder of files for each value of the first key part, and a log of which are live.

    Readers follow the log, so a write that failed leaves the table as it was, and any session can open the
    table by its path. A write rewrites the parts that it touches only; a part is named by a hash of its value, so
    that values never pass through folder names: '007' stays '007'. The log has a row for each part and write.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: tuple[str, ...] = KEY, parts: int = 64):
        self.spark, self.path, self.schema, self.key, self.parts = spark, path, schema, key, parts

    def _log(self) -> dict[int, str]:
        """The live folder of each part: PARTS small rows at most are live."""
        rows = folder_rows(self.spark, f"{self.path}/log", _LOG).groupBy("part").agg(F.max(F.struct("seq", "folder")).alias("m")).collect() if self._exists() else []
        return {r["part"]: r["m"]["folder"] for r in rows}

    def _exists(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/log")
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(self.key[0]), F.lit(self.parts)).cast("int")

    def _write(self, rows: DataFrame, touched: list[int]) -> None:
        """Replace the touched parts by ``rows``, then say so in the log, in one file."""
        version = f"v-{uuid.uuid4().hex}"
        rows.withColumn("_part", self._part()).repartition("_part").write.partitionBy("_part").parquet(f"{self.path}/{version}")
        seq = (folder_rows(self.spark, f"{self.path}/log", _LOG).agg(F.max("seq")).first()[0] if self._exists() else 0) + 1
        said = [(seq, p, f"{version}/_part={p}") for p in touched]
        self.spark.createDataFrame(said, _LOG).coalesce(1).write.mode("append").json(f"{self.path}/log")

    def _read(self, parts: list[int] | None = None) -> DataFrame:
        live = [f for p, f in self._log().items() if parts is None or p in parts]
        there = [f"{self.path}/{f}" for f in live if self._has(f)]
        return self.spark.read.schema(self.schema).parquet(*there) if there else self.spark.createDataFrame([], self.schema)

    def _has(self, folder: str) -> bool:
        """A part whose last row was removed has no folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self._part().alias("p")).distinct().collect())  # PARTS numbers at most

    def put(self, rows: DataFrame, order: list[str]) -> DataFrame:
        """Upserts the valid rows and returns the rejects."""
        good, bad = validated(rows, self.key)
        if touched := self._touched(good):
            current = self._read(touched)
            self._write(upsert(current, good.select(current.columns), list(self.key), order).drop("replaced"), touched)
        return bad

    def read(self) -> DataFrame:
        return self._read()

    def get(self, **key: str) -> DataFrame:
        """Rows by key parts; where the first part is named, only its files are read."""
        parts = None
        if self.key[0] in key:
            named = self.spark.range(1).select(F.lit(key[self.key[0]]).alias(self.key[0]))
            parts = self._touched(named)
        found = self._read(parts)
        for k, v in key.items():
            found = found.filter(F.col(k) == v)
        return found

    def remove(self, keys: DataFrame) -> None:
        if touched := self._touched(keys):
            self._write(remove(self._read(touched), keys, list(self.key)), touched)


_LOG = "seq long, part int, folder string"


def folder_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def snapshot(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").json(path)


def load_snapshot(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejected lines): a line that is no object, or has any field of another type, is reported and skipped.

    Null and missing fields are fine.
    """
    struct = DataType.fromDDL(schema)
    both = f"{schema}, _wrong string"
    lines = spark.read.text(path).withColumn("row", F.from_json("value", both, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_wrong"}))
    fine = F.col("row").isNotNull() & F.col("row._wrong").isNull() & F.trim("value").startswith("{")
    return lines.filter(fine).select(*[f"row.{f.name}" for f in struct.fields]), lines.filter(~F.coalesce(fine, F.lit(False))).select("value")
