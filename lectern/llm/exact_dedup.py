"""Exact de-duplication over a log-structured merge index of text digests.

Rows pass in FLUSHES batches, each a memtable: its rows are summed by digest, the digests that earlier runs hold
are looked up, and what was summed is flushed as a run, that is Parquet files sorted by digest, with a
filter beside it. A filter is a table of bitmaps: bit h(digest) of some sixteen for each row, in pieces of 32,768
bits; a digest whose bit is not set is not in the run, so only those that pass are joined with the run itself.
Compaction merges runs into one, keeping the smallest identifier of the longest text and the group's
size: digests that several runs hold are summed again, all others are copied. A log in the index's folder says
which runs are live; it is all that another session needs to open the index again.

Digests that more than one
row shares are hits, and hits receive byte verification: their normalised texts are grouped
by (digest, text), so that one digest over two different texts would be found and split.

Only digests and counts are shuffled in the main path; verification shuffles each distinct text of a
hit once per task (map-side combine), never every copy, so a group with a third of all rows stays small.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import WS, durable, ids_beside, shared_dir, table, tidy_shuffles

#: Batches in which a table passes through the index.
FLUSHES = 4
_LOG = "seq long, run string, level int, bits long, live boolean"


def normalised(text: Column) -> Column:
    """The text without its white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WS + "+", "")


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def digested(rows: DataFrame) -> DataFrame:
    """``rows``: id, text. Returns id, chars (code points of the original text), norm, digest."""
    chars = F.length(F.coalesce("text", F.lit(""))).cast("long")
    return rows.select("id", chars.alias("chars"), normalised(F.col("text")).alias("norm")).withColumn("digest", digest_of(F.col("norm")))


def _winner(chars: Column, ident: Column) -> Column:
    """Orders a group: most code points first, then smallest id; a null id comes last."""
    return F.struct((-chars).alias("c"), ident.isNull().alias("z"), ident.alias("id"))


def _merged(entries: DataFrame) -> DataFrame:
    """One row per digest: its winner, id and chars, and the number n of rows."""
    summed = entries.groupBy("digest").agg(F.min(_winner(F.col("chars"), F.col("id"))).alias("w"), F.sum("n").alias("n"))
    return summed.select("digest", F.col("w.id").alias("id"), (-F.col("w.c")).alias("chars"), "n")


def _bit(bits: int) -> Column:
    """The bit, from 1, that a digest sets."""
    return F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1


class DigestIndex:
    """A merge index in a folder that all executors share; an index that lies there already is opened.

    ``flush`` adds a batch as a run, ``probe`` tells which digests are known, ``compact`` merges every
    run into one. A run counts once the log names it, and each has a folder of its own: a flush that failed leaves
    a folder that nobody reads, and can be tried again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}"
        self.log = f"{self.path}/log"

    def runs(self) -> list[Row]:
        """The live runs, oldest first: one small row each."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.log)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return []
        rows = self.spark.read.schema(_LOG).json(self.log).groupBy("seq", "run", "level", "bits").agg(F.min("live").alias("live")).collect()
        return sorted(r for r in rows if r["live"])

    def _tell(self, rows: list[tuple]) -> None:
        """One file of the log: what it says holds at once or not at all."""
        self.spark.createDataFrame(rows, _LOG).coalesce(1).write.mode("append").json(self.log)

    def _run(self, run: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{run}")

    def _write(self, summed: DataFrame) -> tuple[str, int]:
        """Write a run and its filter; returns its name and the filter's number of bits."""
        run = f"run-{uuid.uuid4().hex}"
        with tidy_shuffles(self.spark):
            summed.sortWithinPartitions("digest").write.parquet(f"{self.path}/{run}")
            bits = max(1 << 15, 1 << (16 * self._run(run).count()).bit_length())
            at = _bit(bits)
            pieces = self._run(run).groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))
            pieces.write.parquet(f"{self.path}/{run}-filter")
        return run, bits

    def flush(self, entries: DataFrame) -> DataFrame:
        """Add a batch (digest binary, id, chars); returns the digests of it that earlier runs hold."""
        batch = entries.select("digest", "id", "chars", F.lit(1).cast("long").alias("n"))
        live = self.runs()
        run, bits = self._write(_merged(batch))
        known = durable(self.probe(self._run(run), live), "digest-known")
        self._tell([(max((r["seq"] for r in live), default=0) + 1, run, 0, bits, True)])
        return known

    def probe(self, batch: DataFrame, runs: list[Row] | None = None) -> DataFrame:
        """The distinct digests of ``batch`` that some run holds: by its filter first, then by the run."""
        asked = batch.select("digest").distinct()
        found = asked.filter(F.lit(False))
        for r in self.runs() if runs is None else runs:
            at = _bit(r["bits"])
            pieces = self.spark.read.parquet(f"{self.path}/{r['run']}-filter")
            placed = asked.select("digest", F.bitmap_bucket_number(at).alias("piece"), F.bitmap_bit_position(at).alias("bit")).join(pieces, "piece")
            byte = F.conv(F.hex(F.substr("bitmap", F.floor(F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
            passed = placed.filter(F.getbit(byte.cast("long"), F.pmod("bit", F.lit(8)).cast("int")) == 1).select("digest")
            found = found.unionByName(passed.join(self._run(r["run"]).select("digest"), "digest", "left_semi"))
        return found.distinct()

    def compact(self, known: DataFrame | None = None) -> DataFrame:
        """Merge all runs into one and return it: digest, id, chars, n. ``known``: the digests that several runs hold, where that is known."""
        live = self.runs()
        everything = reduce(DataFrame.unionByName, [self._run(r["run"]) for r in live])
        if known is None:
            merged = _merged(everything)
        else:
            merged = _merged(everything.join(known, "digest", "left_semi")).unionByName(everything.join(known, "digest", "left_anti"))
        run, bits = self._write(merged)
        seq = max(r["seq"] for r in live) + 1
        self._tell([(seq, run, max(r["level"] for r in live) + 1, bits, True), *((r["seq"], r["run"], r["level"], r["bits"], False) for r in live)])
        return self._run(run)


def distinct_forms(texts: DataFrame, digests: DataFrame) -> DataFrame:
    """One row per different text of the given digests: digest, norm, its winner w and its row count n."""
    return (
        texts.join(digests, "digest", "left_semi")
        .groupBy("digest", "norm")
        .agg(F.min(_winner(F.col("chars"), F.col("id"))).alias("w"), F.count(F.lit(1)).alias("n"))
    )


def clashing_digests(docs: DataFrame, entries: DataFrame, level: DataFrame) -> DataFrame:
    """Byte verification of the hits: digests that stand for more than one text (none is expected).

    Hits are found by id, so that the other texts are neither normalised again nor moved: their ids go
    to every task where they are few, and into Spark's runtime Bloom filter otherwise.
    """
    hits = entries.join(level.filter("group_size > 1").select("digest", "group_size"), "digest").select("id", "group_size")
    hits = durable(hits, "digest-hits").filter("group_size > 1").select("id")
    rows = docs.filter("id IS NOT NULL").join(ids_beside(hits), "id", "left_semi").unionByName(docs.filter("id IS NULL"))
    forms = digested(rows).groupBy("digest", "norm").agg(F.lit(1).alias("one"))
    return forms.groupBy("digest").agg(F.count(F.lit(1)).alias("forms")).filter("forms > 1").select("digest")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space. The row with the most code points in its
    original text stays, then the smallest id. Nulls: a null text is empty, a null id comes after
    every other. Repeated rows with the same id all count in ``group_size`` and are all ``kept`` when
    their id wins; an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "16MB")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = digested(rows)
    entries = durable(texts.drop("norm").withColumn("batch", F.pmod(F.spark_partition_id(), F.lit(FLUSHES))), "digest-entries")
    index = DigestIndex(spark)
    known = [index.flush(entries.filter(F.col("batch") == i)) for i in range(FLUSHES)]
    level = index.compact(reduce(DataFrame.unionByName, known).distinct())
    level = level.select("digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    entries = entries.drop("batch")

    clashes = durable(clashing_digests(rows, entries, level), "digest-clashes")
    owners = level
    if clashes.isEmpty():
        joined = entries.join(owners, "digest")
    else:  # those rows are told apart by their text
        forms = distinct_forms(texts, clashes).select("digest", "norm", F.col("w.id").alias("keep_id"), F.col("n").alias("group_size"))
        split = texts.join(forms, ["digest", "norm"])
        whole = entries.join(clashes, "digest", "left_anti").join(owners, "digest")
        columns = ["digest", "id", "keep_id", "group_size"]
        joined = whole.select(columns).unionByName(split.select(columns))
    return joined.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""
QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLE = {"op4_exact_dedup": SQL}
