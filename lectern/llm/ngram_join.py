"""N-gram Jaccard join with signature trees.

The join links two documents when their sets of five-word shingles have a Jaccard similarity of 0.75
or more; it is exact on 64-bit shingle hashes. Equal sets are one node from the start.

Routing. Similar sets share many of their smallest hashes, so a sample of each set (its smallest
hashes, about a third) meets others' by shingle. Shingles that one set alone holds drop out. Of the
others a set keeps the rarest ones, as many as the prefix bound demands; a set that shares too few,
such as one with a common passage inside its own text, keeps none and is done. What remains are
buckets: a shingle with the sets that keep it.

Stars. Each set is compared with the sets that lead most of its buckets, the one that shares most and a
random one; found links are contracted.

Trees. Buckets that still hold sets of different components get signature trees: leaves are sets with
their token bitmaps, inner nodes OR-combine the bitmaps of up to eight children and hold the range of
their sizes. A dual traversal starts at pairs of roots and prunes a pair when the sizes exclude 0.75,
when the common bits (plus the collisions inside a bitmap) bound the overlap below what 0.75 needs,
or when all below is one component. A pair of sets that is known to share an earlier bucket is left to
that one; the other surviving pairs are compared exactly. A bucket larger
than ``BUCKET_BLOCK`` is cut in blocks and every pair of blocks is a task's worth of work of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import shingles
from lectern.llm.common import durable, table
from lectern.llm.components import components

BUCKET_BLOCK = 4096
#: Document frequencies are exact up to this and equal beyond; only their order matters.
MAX_FREQUENCY = 50_000
#: Of a set's buckets the first few by hash travel with it, to tell pairs that meet in several buckets.
_FIRST = 4
_FANOUT = 8
#: In buckets up to this size all leaves hang on the root, and many buckets are compared at once.
_SMALL = 16
_PAIR_BYTES = 1 << 23


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Arrow batches that fit a small Python worker, whatever the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def _required(n: int) -> int:
    """Shared hashes demanded of the samples of two linked sets, at least one of which has n elements."""
    return -(-3 * n // 4) // 12 + 1


def _sample_size(n: int) -> int:
    return min(n, n - -(-3 * n // 4) + n // 12 + 1)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, names = [], []
        for s in shingles.shingle_sets(batch.column(1)):
            sizes.append(len(s))
            names.append(shingles.set_id(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(names, pa.int64())], ["id", "key", "n", "sid"])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[int] = set()
    for batch in batches:
        parts, names, total = [], [], 0

        def flush(parts=parts, names=names):
            lengths = [len(p) for p in parts]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.repeat(np.array(names, np.int64), lengths))], ["h", "sid"]
            )

        for s in shingles.shingle_sets(batch.column(0)):
            if not len(s) or (name := shingles.set_id(s)) in seen:
                continue
            if len(seen) < 1_000_000:  # copies met again only cost rows that the next step drops
                seen.add(name)
            parts.append(s[: _sample_size(len(s))])
            names.append(name)
            total += len(parts[-1])
            if total > 1 << 17:
                yield flush()
                parts.clear()
                names.clear()
                total = 0
        if parts:
            yield flush()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (h, sid): the distinct rows whose h several sets hold, with their frequency."""

    def told(h: np.ndarray, sid: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(sid), pa.array(f)], ["h", "sid", "df"])

    held_h, held_s, full = np.zeros(0, np.int64), np.zeros(0, np.int64), False  # the last shingle so far
    for batch in batches:
        h, sid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(h):
            continue
        if full:  # the frequency of this shingle is beyond the limit: pass its rows on
            same = int(np.searchsorted(h != held_h[0], True))
            if same:
                s = np.unique(sid[:same])
                s = s[s != held_s[-1]]
                if len(s):
                    yield told(np.full(len(s), held_h[0]), s, np.full(len(s), MAX_FREQUENCY))
                    held_s = s[-1:]
                h, sid = h[same:], sid[same:]
                if not len(h):
                    continue
            full, held_h, held_s = False, held_h[:0], held_s[:0]
        h, sid = np.concatenate([held_h, h]), np.concatenate([held_s, sid])
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])
        h, sid = h[new], sid[new]
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        last = first[-1]
        held_h, held_s = h[last:], sid[last:]
        if last:
            f = np.repeat(np.diff(first), np.diff(first))
            keep = f > 1
            if keep.any():
                yield told(h[:last][keep], sid[:last][keep], np.minimum(f[keep], MAX_FREQUENCY))
        if len(held_h) >= MAX_FREQUENCY:
            yield told(held_h, held_s, np.full(len(held_h), MAX_FREQUENCY))
            held_h, held_s, full = held_h[-1:], held_s[-1:], True
    if not full and len(held_h) > 1:
        yield told(held_h, held_s, np.full(len(held_h), min(len(held_h), MAX_FREQUENCY)))


def _bitmap(s: np.ndarray) -> bytes:
    """The set's token bitmap: a power of two of bits, at least four for each element."""
    bits = max(64, 1 << (4 * len(s) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sid, n, bitmap, the sorted set itself and the first buckets (passed on) of each text; a repeated row counts once in a task."""
    told: set[int] = set()
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for sid, low, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingles.shingle_sets(batch.column(1)), strict=True):
            if sid in told:
                continue
            if len(told) < 1_000_000:
                told.add(sid)
            rows.append((sid, len(s), _bitmap(s), s.tobytes(), low))
            size += len(rows[-1][3])
            if size > 1 << 22:
                yield _profile_batch(rows)
                rows, size = [], 0
        if rows:
            yield _profile_batch(rows)


def _profile_batch(rows: list[tuple]) -> pa.RecordBatch:
    sid, n, bits, items, low = zip(*rows, strict=True)
    arrays = [pa.array(sid, pa.int64()), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(items, pa.binary()), pa.array(low, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, ["sid", "n", "bits", "items", "low"])


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, items_a, items_b), those that are linked."""
    for batch in batches:
        keep = []
        xs, ys = batch.column(2), batch.column(3)
        for i in range(len(batch)):
            x, y = np.frombuffer(xs[i].as_buffer(), np.uint64), np.frombuffer(ys[i].as_buffer(), np.uint64)
            keep.append(4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)) and 7 * _overlap(x, y) >= 3 * (len(x) + len(y)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


class _Tree:
    """A signature tree over sets of one bitmap width, in the order given."""

    def __init__(self, bits: np.ndarray, n: np.ndarray, comp: np.ndarray):
        slack = n - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, n, n, slack, comp, comp)]
        while len(self.levels[-1][0]) > 1:
            b, lo, hi, s, c_lo, c_hi = self.levels[-1]
            at = np.arange(0, len(b), _FANOUT)
            self.levels.append((
                np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at),
                np.maximum.reduceat(s, at), np.minimum.reduceat(c_lo, at), np.maximum.reduceat(c_hi, at),
            ))

    def level(self, k: int):
        return self.levels[min(k, len(self.levels) - 1)]

    def children(self, k: int, i: np.ndarray) -> np.ndarray:
        """At each step the root stands for itself while the other tree is deeper."""
        if k >= len(self.levels):
            return np.where(np.arange(_FANOUT) == 0, i[:, None], -1)
        c = i[:, None] * _FANOUT + np.arange(_FANOUT)
        return np.where(c < len(self.levels[k - 1][0]), c, -1)


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] | bits[:, half:]
    return bits


def _possible(x: _Tree, y: _Tree, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which node pairs of level k may hold a link between different components."""
    bx, lx, hx, sx, cx, dx = x.level(k)
    by, ly, hy, sy, cy, dy = y.level(k)
    keep = (4 * hx[i] >= 3 * ly[j]) & (4 * hy[j] >= 3 * lx[i]) & ~((cx[i] == dx[i]) & (cy[j] == dy[j]) & (cx[i] == cy[j]))
    at = np.flatnonzero(keep)
    for lo in range(0, len(at), step := max(1, _PAIR_BYTES // (8 * bx.shape[1]))):
        p = at[lo : lo + step]
        common = np.bitwise_count(bx[i[p]] & by[j[p]]).sum(axis=1, dtype=np.int64) + np.minimum(sx[i[p]], sy[j[p]])
        keep[p] = 7 * common >= 3 * (lx[i[p]] + ly[j[p]])
    return keep


def _traverse(x: _Tree, y: _Tree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Dual traversal; pairs of leaves that are left. With x is y, each pair once."""
    stack = [(max(len(x.levels), len(y.levels)) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, i, j = stack.pop()
        keep = _possible(x, y, k, i, j)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if k == 0:
            yield i, j
            continue
        for lo in range(0, len(i), 4096):
            ci = np.repeat(x.children(k, i[lo : lo + 4096]), _FANOUT, axis=1).ravel()
            cj = np.tile(y.children(k, j[lo : lo + 4096]), (1, _FANOUT)).ravel()
            ok = (ci >= 0) & (cj >= 0)
            if x is y:
                ok &= ci <= cj if k > 1 else ci < cj
            if ok.any():
                stack.append((k - 1, ci[ok], cj[ok]))


def _bucket_pairs(comp: np.ndarray, n: np.ndarray, bits: list[bytes], side: np.ndarray, split: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate row pairs of one bucket or pair of blocks, by trees for each bitmap width."""
    widths = np.array([len(b) // 8 for b in bits])
    groups = {}
    for w in np.unique(widths):
        for s in np.unique(side):
            at = np.flatnonzero((widths == w) & (side == s))
            if len(at):
                at = at[np.lexsort((n[at], comp[at]))]
                rows = np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), w)
                groups[w, s] = at, rows
    for (w, s), (at, rows) in groups.items():
        for (v, t), (other, more) in groups.items():
            if v not in (w, 2 * w) or split and s == t or v == w and t < s:
                continue
            x = _Tree(rows, n[at], comp[at])
            y = x if (v, t) == (w, s) else _Tree(_folded(more, w), n[other], comp[other])
            for i, j in _traverse(x, y):
                yield at[i], other[j]


def _matrices(bits: list[bytes], at: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), -1)


def _bounded(i: np.ndarray, j: np.ndarray, n: np.ndarray, bits: list[bytes]) -> np.ndarray:
    """Which row pairs pass the bounds of size and common bits."""
    keep = (4 * n[i] >= 3 * n[j]) & (4 * n[j] >= 3 * n[i])
    width = np.array([len(b) // 8 for b in bits])
    low = np.minimum(width[i], width[j])
    for w in np.unique(low[keep]):
        pairs = np.flatnonzero(keep & (low == w))
        used = np.unique(np.concatenate([i[pairs], j[pairs]]))
        row, rows = np.zeros(len(n), np.int64), np.zeros((len(used), w), np.uint64)
        row[used] = np.arange(len(used))
        slack = np.zeros(len(used), np.int64)
        for v in np.unique(width[used]):
            own = np.flatnonzero(width[used] == v)
            rows[own] = _folded(_matrices(bits, used[own]), w)
        slack = n[used] - np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
        for lo in range(0, len(pairs), step := max(1, _PAIR_BYTES // (8 * int(w)))):
            p = pairs[lo : lo + step]
            x, y = row[i[p]], row[j[p]]
            common = np.bitwise_count(rows[x] & rows[y]).sum(axis=1, dtype=np.int64) + np.minimum(slack[x], slack[y])
            keep[p] = 7 * common >= 3 * (n[i[p]] + n[j[p]])
    return keep


def _low_matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The first buckets of each row, short lists filled with numbers that no two rows share."""
    flat = column.combine_chunks()
    offsets = flat.offsets.to_numpy()
    size = np.diff(offsets)
    out = np.tile(np.arange(_FIRST, dtype=np.int64), (len(size), 1)) + np.arange(len(size))[:, None] * _FIRST + np.iinfo(np.int64).min
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(offsets[:-1] - offsets[0], size)] = flat.values.to_numpy()[offsets[0] : offsets[-1]]
    return out


def _met_before(low: np.ndarray, h: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which row pairs share one of their first buckets that comes before this bucket, h."""
    out = np.zeros(len(i), bool)
    for x in range(_FIRST):
        a = low[i, x]
        early = a < h[i]
        for y in range(_FIRST):
            out |= early & (a == low[j, y])
    return out


def _tree_candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket (h, i, j): h, i, j, side, sid, comp, n, bits, low. Yields candidate pairs a, b."""
    held: list[pa.RecordBatch] = []
    found: list[np.ndarray] = []

    def add(a: np.ndarray, b: np.ndarray) -> None:
        found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1))

    def run(t: pa.Table, cuts: np.ndarray) -> None:
        """All buckets of ``t``; bucket k is rows cuts[k] to cuts[k + 1]."""
        col = {c: t[c].to_numpy() for c in ("h", "i", "j", "side", "sid", "comp", "n")}
        low = _low_matrix(t["low"])
        size = np.diff(cuts)
        split = col["i"][cuts[:-1]] != col["j"][cuts[:-1]]
        small = (size <= _SMALL) & ~split
        end = np.repeat(np.where(small, cuts[1:], 0), size)
        at = np.arange(t.num_rows)
        pairs = [(k := np.flatnonzero(at + d < end), k + d) for d in range(1, _SMALL)]
        i, j = (np.concatenate(x) for x in zip(*pairs, strict=True))
        fresh = col["comp"][i] != col["comp"][j]
        i, j = i[fresh], j[fresh]
        fresh = ~_met_before(low, col["h"], i, j)
        i, j = i[fresh], j[fresh]
        if len(i):
            bits = t["bits"].to_pylist()
            keep = _bounded(i, j, col["n"], bits)
            add(col["sid"][i[keep]], col["sid"][j[keep]])
        for k in np.flatnonzero(~small):
            lo, hi = cuts[k], cuts[k + 1]
            part = {c: v[lo:hi] for c, v in col.items()}
            for i, j in _bucket_pairs(part["comp"], part["n"], t["bits"].slice(lo, hi - lo).to_pylist(), part["side"], split[k]):
                fresh = ~_met_before(low[lo:hi], part["h"], i, j)
                add(part["sid"][i[fresh]], part["sid"][j[fresh]])

    def told() -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found), axis=0)
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    for batch in batches:
        t = pa.Table.from_batches([*held, batch]).combine_chunks()
        key = np.stack([t[c].to_numpy() for c in ("h", "i", "j")])
        cuts = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1]
        if len(cuts) > 1:
            run(t.slice(0, cuts[-1]), cuts)
        held = t.slice(cuts[-1]).to_batches()
        if sum(map(len, found)) > 1 << 18:
            yield told()
    if held:
        t = pa.Table.from_batches(held)
        run(t, np.array([0, t.num_rows]))
    if found:
        yield told()


def _screened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs a, b, n, m, x, y (sizes and bitmaps), those whose bitmaps allow a link."""
    for batch in batches:
        k = len(batch)
        n = np.concatenate([batch.column(2).to_numpy(), batch.column(3).to_numpy()])
        keep = _bounded(np.arange(k), np.arange(k) + k, n, batch.column(4).to_pylist() + batch.column(5).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))


def _screen(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs that the bitmaps allow, before whole sets move."""
    return (
        pairs.join(sets.select(F.col("sid").alias("a"), "n", F.col("bits").alias("x")), "a")
        .join(sets.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b")
        .select("a", "b", "n", "m", "x", "y")
        .mapInArrow(_screened, "a long, b long")
    )


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Linked pairs, by their whole sets."""
    items = sets.select("sid", "items")
    return (
        pairs.join(items.select(F.col("sid").alias("a"), F.col("items").alias("x")), "a")
        .join(items.select(F.col("sid").alias("b"), F.col("items").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(_verified, "a long, b long")
    )


def _led(buckets: DataFrame) -> DataFrame:
    """Each set with the two leaders of most of its buckets. ``buckets``: h, sid, rank."""
    lead = buckets.groupBy("h").agg(F.max(F.struct("rank", "sid")).alias("most"), F.min(F.struct(F.xxhash64("sid").alias("r"), "sid")).alias("any"), F.count(F.lit(1)).alias("size"))
    lead = lead.filter("size > 1").select("h", F.array("most.sid", "any.sid").alias("leaders"))
    votes = buckets.join(lead, "h").select(F.col("sid").alias("a"), F.posexplode("leaders").alias("k", "b")).filter("a <> b").groupBy("a", "k", "b").count()
    best = votes.groupBy("a", "k").agg(F.max(F.struct("count", "b")).alias("m"))
    return best.select(F.least("a", "m.b").alias("a"), F.greatest("a", "m.b").alias("b")).distinct()


def _placed(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """Buckets with the component of each set so far, its own name where it has no link."""
    return buckets.join(found.select(F.col("node").alias("sid"), "root"), "sid", "left").select("h", "sid", F.coalesce("root", "sid").alias("comp"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the smallest id that links reach).

    A null text, or one without words, has no shingles and links with nothing; with fewer than five
    words the whole sequence is the one shingle. Repeated rows and rows of equal sets are in one
    component. A null id never names a component unless all its ids are null; rows without an id link like
    all others. Sets are told apart by a 64-bit name, and shingles by 64-bit hashes. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # texts are found again by a name of the row, since an id may be null or repeated
    texts = texts.withColumn("key", F.xxhash64("id", "text"))
    named = durable(texts.select("id", "text", "key").mapInArrow(_named, "id long, key long, n long, sid long"), "ngram-docs")

    rows = texts.select("text").mapInArrow(_sampled, "h long, sid long")
    shared = rows.repartition("h").sortWithinPartitions("h", "sid").mapInArrow(_shared, "h long, sid long, df long")
    sets_n = named.filter("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.min("id").alias("id"), F.min("key").alias("key"))
    per_set = shared.groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("held"))  # at most a third of one set
    required = F.floor(F.ceil(3 * F.col("n") / 4) / 12).cast("int") + 1
    kept = per_set.join(sets_n, "sid").withColumn("more", F.size("held") - required + 1).filter("more > 0")
    hs = F.array_sort(F.transform(F.slice("held", F.lit(1), F.col("more")), lambda e: e["h"]))
    kept = durable(kept.select("sid", "n", "key", F.size("held").alias("rank"), hs.alias("hs")), "ngram-kept")
    buckets = kept.select(F.explode("hs").alias("h"), "sid", "rank")

    met = buckets.join(buckets.groupBy("h").count().filter("count > 1").select("h"), "h", "left_semi").select("sid").distinct()
    wanted = durable(kept.join(met, "sid").select("sid", "n", "key", F.slice("hs", 1, _FIRST).alias("low")), "ngram-wanted")
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "16MB")
    sets = texts.select("key", "text").join(wanted.filter("n >= 1").select("sid", "key", "low"), "key").select("sid", "text", "low")
    sets = durable(sets.mapInArrow(_profiles, "sid long, n long, bits binary, items binary, low array<bigint>"), "ngram-sets")
    if not sets.groupBy("sid").count().filter("count > 1").isEmpty():  # repeated rows, met by several tasks
        sets = durable(sets.groupBy("sid").agg(*[F.any_value(c).alias(c) for c in ("n", "bits", "items", "low")]), "ngram-sets-once")

    links = durable(_verify(_screen(_led(buckets), sets), sets), "ngram-stars")
    found = components(links)

    # trees: buckets that hold several components
    placed = _placed(buckets, found)
    mixed = placed.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).filter("lo <> hi")
    blocks = F.ceil(F.col("size") / BUCKET_BLOCK).cast("int")
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    placed = (
        placed.join(mixed.select("h", blocks.alias("blocks")), "h").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "sid", "comp")
        .join(sets.select("sid", "n", "bits", "low"), "sid").select("h", "i", "j", "side", "sid", "comp", "n", "bits", "low")
    )
    pairs = placed.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(_tree_candidates, "a long, b long").distinct()
    more = durable(_verify(pairs, sets), "ngram-links")
    found = components(links.unionByName(more))

    roots = sets_n.join(found.select(F.col("node").alias("sid"), "root"), "sid", "left").select("sid", "id", F.coalesce("root", "sid").alias("root"))
    low = roots.groupBy("root").agg(F.min("id").alias("component_id"))
    answer = roots.join(low, "root").select("sid", "component_id")
    return named.join(answer, "sid", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


QUERIES = {"op1_ngram_join": op1_ngram_join}
ORACLE: dict = {}
