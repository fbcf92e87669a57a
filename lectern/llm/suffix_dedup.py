"""Repeated passages by sparse suffix arrays.

Suffixes are kept at content-selected positions only: of every WINDOW consecutive GRAM-word sequences
of a text, the one with the smallest hash. Every run of MIN_WORDS words holds such a position, and equal
runs hold the same ones, about one suffix in twenty words. Suffixes whose first GRAM words occur once
in the corpus drop out by a count.

The rest are found in two ways. Suffixes whose first GRAM words occur up to FEW times are dealt by the hash
of these words and sorted by their words inside each partition, so that all suffixes that begin alike are
neighbours there, and each is compared with those after it. Matches are extended to the right and to the left; a match
of MIN_WORDS words or more marks its run of words in both texts. Where more suffixes begin alike, comparing all
would be quadratic, so there every window of MIN_WORDS words that covers the suffix's first GRAM
words is named by a hash, and a window whose hash occurs at two places is marked. The same holds for a run of one
repeated sequence, which meets itself. A repeated window holds
one of the two kinds of suffix in both places, so none is missed. Marked runs of a text are merged. Words
compare by 32-bit hashes, windows by 64-bit ones; a match needs at least MIN_WORDS words and a 64-bit hash
of the first GRAM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm import shingles
from lectern.llm.common import durable, table
from lectern.llm.ngram_join import bounded_batches

MIN_WORDS, GRAM = 50, 10
WINDOW = MIN_WORDS - GRAM + 1
#: So many suffixes that begin alike are compared with one another: FEW * (FEW - 1) / 2 comparisons at most.
FEW = 9
_SUFFIX = "g long, right binary, left binary, id long, pos int"
_GRAM_KEYS = shingles.mix(np.arange(1, GRAM + 1, dtype=np.uint64)) | np.uint64(1)


def _gram_hashes(w: np.ndarray) -> np.ndarray:
    n = len(w) - GRAM + 1
    out = w[:n] * _GRAM_KEYS[0]
    for i in range(1, GRAM):
        out += w[i : i + n] * _GRAM_KEYS[i]
    return shingles.mix(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width``, from running minima of blocks."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def selected(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of a text's suffixes, the hashes of their first GRAM words and how often each counts; none under MIN_WORDS words.

    In a run of one repeated word only its first position competes; where a whole window lies in such
    a run, every WINDOW-th position of the run is taken. A position inside a run, or at its head, stands for more
    than FEW that begin alike.
    """
    if len(w) < MIN_WORDS:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    g = _gram_hashes(w)
    top = np.iinfo(np.uint64).max
    again = np.concatenate([[False], g[1:] == g[:-1]])
    key = np.where(again, top, g)
    low = _sliding_min(key, WINDOW)
    reach = np.full(len(g) + WINDOW - 1, 0, np.uint64)  # for each position the largest minimum of its windows
    reach[WINDOW - 1 : WINDOW - 1 + len(low)] = low
    largest = ~_sliding_min(~reach, WINDOW)
    take = (key == largest[: len(g)]) & ~again
    if (low == top).any():
        begin = np.maximum.accumulate(np.where(again, 0, np.arange(len(g))))
        take |= again & ((np.arange(len(g)) - begin) % WINDOW == 0)
    at = np.flatnonzero(take)
    run = again | np.concatenate([again[1:], [False]])
    return at, g[at], np.where(run[at], FEW + 1, 1).astype(np.int32)


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) in; (g, id, pos, times) of every selected suffix out."""
    for batch in batches:
        for lo in range(0, len(batch), 512):
            part = batch.slice(lo, 512)
            w, at = shingles.words(part.column(1))
            found = [selected(w[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            pos, g, times = (np.concatenate(x) for x in zip(*found, strict=True))
            ids = np.repeat(np.array(part.column(0).to_pylist(), np.int64), [len(x[0]) for x in found])
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ids), pa.array(pos.astype(np.int32)), pa.array(times)], ["g", "id", "pos", "times"])


def _windows(w: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of all windows of MIN_WORDS words that cover the GRAM words at some anchor."""
    n = len(w) - MIN_WORDS + 1
    edge = np.zeros(len(w) + 1, np.int64)
    np.add.at(edge, np.maximum(anchors - WINDOW + 1, 0), 1)
    np.add.at(edge, anchors + 1, -1)
    start = np.flatnonzero(np.cumsum(edge)[:n] > 0)
    g = _gram_hashes(w)
    h = np.zeros(len(start), np.uint64)
    for i in range(0, MIN_WORDS, GRAM):
        h += g[start + i] * _GRAM_KEYS[i // GRAM]
    return start, shingles.mix(h).view(np.int64)


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, positions, text, positions of frequent starts) in; suffix rows out: MIN_WORDS words to the right, and to the left in reverse.

    For frequent starts the windows around them come instead, with the window's hash and place and no words.

    Words are big-endian 32-bit hashes, so that bytes sort like words; a text's end is padded with
    numbers that no other place shares.
    """
    for batch in batches:
        for lo in range(0, len(batch), 128):
            part = batch.slice(lo, 128)
            w, at = shingles.words(part.column(2))
            ids, rows, frequent = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(3).to_pylist()
            for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
                own = w[a:b]
                if len(own) < MIN_WORDS:
                    continue
                there, g, _ = selected(own)
                covering = _windows(own, there[np.isin(there, np.array(frequent[i], np.int64))])
                for k in range(0, len(covering[0]), 1 << 16):
                    start, h = (x[k : k + (1 << 16)] for x in covering)
                    none = pa.nulls(len(h), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(h), none, none, pa.array(np.full(len(h), ids[i])), pa.array(start.astype(np.int32))], ["g", "right", "left", "id", "pos"])
                keep = np.isin(there, np.array(rows[i], np.int64))
                there, g = there[keep], g[keep]
                short = (own >> np.uint64(32)).astype(">u4")
                end = shingles.mix(np.arange(2 * MIN_WORDS, dtype=np.uint64) + np.uint64(ids[i] % (1 << 62)) * np.uint64(2 * MIN_WORDS)).astype(np.uint32).astype(">u4")
                padded = np.concatenate([end[:MIN_WORDS], short, end[MIN_WORDS:]])
                views = np.lib.stride_tricks.sliding_window_view(padded, MIN_WORDS)
                for k in range(0, len(there), 4096):
                    p = there[k : k + 4096]
                    right, left = np.ascontiguousarray(views[p + MIN_WORDS]), np.ascontiguousarray(views[p][:, ::-1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(g[k : k + 4096].view(np.int64)), _binary(right), _binary(left), pa.array(np.full(len(p), ids[i])), pa.array(p.astype(np.int32))],
                        ["g", "right", "left", "id", "pos"],
                    )


def _binary(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _matrix(column: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], ">u4")[offsets[0] // 4 : offsets[-1] // 4].reshape(len(column), MIN_WORDS)


def _equal_words(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    differ = x != y
    return np.where(differ.any(axis=1), differ.argmax(axis=1), MIN_WORDS)


class _Rows:
    """Suffix rows as arrays; right and left words as matrices."""

    def __init__(self, g, right, left, ident, pos):
        self.g, self.right, self.left, self.id, self.pos = g, right, left, ident, pos

    @classmethod
    def of(cls, b: pa.RecordBatch) -> _Rows:
        return cls(b.column(0).to_numpy(), _matrix(b.column(1)), _matrix(b.column(2)), b.column(3).to_numpy(), b.column(4).to_numpy())

    def take(self, at) -> _Rows:
        return _Rows(self.g[at], self.right[at], self.left[at], self.id[at], self.pos[at])

    def __add__(self, other: _Rows) -> _Rows:
        pairs = zip((self.g, self.right, self.left, self.id, self.pos), (other.g, other.right, other.left, other.id, other.pos), strict=True)
        return _Rows(*(np.concatenate(p) for p in pairs))

    def spans(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(id, start, end) of both sides of every match between rows of one g, of which there are FEW at most."""
        for t in range(1, min(FEW, len(self.g))):
            at = np.flatnonzero(self.g[:-t] == self.g[t:])
            for lo in range(0, len(at), 1 << 13):
                i = at[lo : lo + (1 << 13)]
                j = i + t
                r, l = _equal_words(self.right[i], self.right[j]), _equal_words(self.left[i], self.left[j])  # noqa: E741
                far = (r + l >= MIN_WORDS) & ~((self.id[i] == self.id[j]) & (self.pos[i] == self.pos[j]))
                i, j, r, l = i[far], j[far], r[far], l[far]  # noqa: E741
                for k in (i, j):
                    yield self.id[k], self.pos[k] - l, self.pos[k] + r


def _span_batch(found: list) -> pa.RecordBatch:
    ident, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    rows = np.unique(np.stack([ident, start, end]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1].astype(np.int32)), pa.array(rows[2].astype(np.int32))], ["id", "start", "end"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffix rows in; spans out. The last rows of a batch wait for the next one, since a g may go on there."""
    held: _Rows | None = None
    for batch in batches:
        if not len(batch):
            continue
        whole = _Rows.of(batch) if held is None else held + _Rows.of(batch)
        found = [f for f in whole.spans() if len(f[0])]
        if found:
            yield _span_batch(found)
        held = whole.take(slice(max(0, len(whole.g) - FEW), None))


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per maximal repeated run of words: id, start_word, end_word (exclusive), n_words.

    A run is repeated when it joins matches of MIN_WORDS words or more that occur elsewhere too, in
    another text or the same. Words ignore the case of A-Z. A null, empty or shorter text has none; a
    row without an id is skipped, since no result could name it; rows with one id and different texts
    give the runs of both. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "16MB")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id IS NOT NULL AND text IS NOT NULL")
    sparse = durable(texts.mapInArrow(_positions, "g long, id long, pos int, times int"), "suffix-positions")
    # written first, so that the join shuffles both sides by itself and Spark can split the partition of a very common start
    common = durable(sparse.groupBy("g").agg(F.sum("times").alias("n")).filter("n > 1"), "suffix-common")
    few, many = F.when(F.col("n") <= FEW, F.col("pos")), F.when(F.col("n") > FEW, F.col("pos"))
    wanted = sparse.join(common, "g").groupBy("id").agg(F.collect_set(few).alias("at"), F.collect_set(many).alias("frequent"), F.count(F.lit(1)).alias("n"))  # at most the positions of one text
    wanted = durable(wanted, "suffix-wanted")
    found = texts.join(wanted.filter("n > 0").select("id", "at", "frequent"), "id").select("id", "at", "text", "frequent").mapInArrow(_contexts, _SUFFIX)
    found = durable(found, "suffix-rows")
    suffixes, windows = found.filter("right IS NOT NULL"), found.filter("right IS NULL").select("g", "id", F.col("pos").alias("start"))
    place = F.struct("id", "start")
    twice = durable(windows.groupBy("g").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("g"), "suffix-windows")
    covered = windows.join(twice, "g").select("id", "start", (F.col("start") + MIN_WORDS).alias("end"))
    order = ["g", "right", "left", "id", "pos"]
    alike = suffixes.repartition("g").sortWithinPartitions(*order).select(order)  # up to FEW rows a g: no partition is much larger than others
    spans = alike.mapInArrow(_compared, "id long, start int, end int").unionByName(covered)
    before = W.partitionBy("id").orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1)
    marked = spans.groupBy("id", "start").agg(F.max("end").alias("end")).withColumn("fresh", (F.col("start") > F.coalesce(F.max("end").over(before), F.lit(-1))).cast("int"))
    runs = marked.withColumn("run", F.sum("fresh").over(W.partitionBy("id").orderBy("start", "end").rowsBetween(W.unboundedPreceding, 0)))
    merged = runs.groupBy("id", "run").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"))
    return merged.select(F.col("id").alias(id_col), "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLE: dict = {}
