"""Quality classifier: perplexity under interpolated modified Kneser-Ney word bigrams, scored by count joins.

The model of a language is trained on its trusted text, that is text whose label says good quality and
not toxic. Words are named by 40-bit hashes that hold the language too. Bigram counts are summed in
shards of their key; continuation counts, discounts and back-off weights are aggregates and joins over
them, and no table of the model reaches the driver or a task whole.

The log-probability of a text is a sum of one weight for each of its words and pairs of words: a
pair's weight is its log-probability less what its absence would give (the back-off weight of the first
word, and the second word's own), and a word's is the logarithm of its own probability and of its back-off
weight. So a text's distinct words and pairs meet their weights by key and are summed by
row; what the model does not hold adds 0, or for a word the cost of an unknown one.

The weights of the most frequent words and pairs, HEAD of them at most, go to every task, which settles most of
a text at once. The rest, most of the model, lies in shards: a table bucketed by key, which the other pairs of the texts are
shuffled to. Counts, weights and texts go through in SLICES parts, so that the files of one are gone before the next
comes: the disk then holds about one copy of the model and a part of the keys of the texts.

One in HELD_OUT trusted documents is not trained on. Their perplexities, which are not lowered by having
been seen, give each language its upper limit; the lower one comes from all trusted documents.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lectern.llm import shingles
from lectern.llm.common import WORD, durable, ids_beside, release, remove, shared_dir, table, tidy_shuffles, unit_hash
from lectern.llm.ngram_join import bounded_batches
from lectern.llm.shingles import text_bytes

POOLED = "*"
#: Share of a language's trusted documents that lies below the lower limit, and beyond the upper one where no label says bad quality.
TAIL = 0.002
#: Shares beyond the upper limit from which the labels choose.
TAILS = (TAIL, 0.005, 0.01, 0.02, 0.05)
#: So many documents weigh as much for a language's own limits as the pooled spread does.
SHRINK = 20
#: One in so many trusted documents is kept from training, to set the limits.
HELD_OUT = 5
#: So many weights at most go to every task (some 25 MB); all others are joined.
HEAD = 1 << 20
#: Parts in which counts, weights and texts pass.
SLICES = 5
#: So many texts are hashed at once, and so many bytes of text reach a task at once: so a task holds some tens of MB beside the head.
PIECE = 128
BATCH_BYTES = 2 << 20
#: A task sums some so many pairs, and gives out so many rows at once.
SUMMED = 1 << 18
ROWS = 1 << 16
_ID_BITS = 40
_MARKS = shingles.mix(np.array([1, 2], np.uint64))  # START and END among the words
_KEYS = shingles.mix(np.arange(1, 3, dtype=np.uint64)) | np.uint64(1)


def _sequences(column: pa.Array, langs: list, texts: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For so many texts at a time: which of them have words, the symbols of these in turn, and where each text begins and ends.

    Symbols are the words' hashes mixed with their language's, between a START and an END for each text.
    """
    salts = {x: int.from_bytes(hashlib.blake2b((x or "").encode(), digest_size=8).digest(), "big") for x in set(langs)}
    salt = np.array([salts[x] for x in langs], np.uint64)
    for lo in range(0, len(column), texts):
        data, offsets = text_bytes(column.slice(lo, texts))
        starts, _, w = shingles.word_spans(data, offsets, shingles.PLAIN)
        n = np.diff(np.searchsorted(starts, offsets))
        own = np.flatnonzero(n)
        if not len(own):
            continue
        sizes = n[own] + 2
        ends = np.cumsum(sizes)
        begins = ends - sizes
        word = np.ones(ends[-1], bool)
        word[begins] = word[ends - 1] = False
        x = np.empty(ends[-1], np.uint64)
        x[begins], x[ends - 1], x[word] = _MARKS[0], _MARKS[1], w
        yield own + lo, shingles.mix(x ^ np.repeat(salt[own + lo], sizes)) >> np.uint64(64 - _ID_BITS), begins, ends


def _key(*words: np.ndarray) -> np.ndarray:
    out = words[0] * _KEYS[0]
    for k, w in zip(_KEYS[1:], words[1:], strict=False):
        out = out + w * k
    return shingles.mix(out + np.uint64(len(words)))


def _pairs(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """For some PIECE texts at a time: the pairs whose second word falls to a slice, and the language of each by its number in a list."""
    for batch in batches:
        langs = batch.column(0).to_pylist()
        names, codes = np.unique(np.array(langs, object), return_inverse=True)
        for own, x, _, ends in _sequences(batch.column(1), langs, PIECE):
            mine = x[1:] % np.uint64(SLICES) == part
            mine[ends[:-1] - 1] = False  # an END and the START behind it
            at = np.flatnonzero(mine)
            yield np.stack([x[at], x[at + 1]]), codes[own][np.searchsorted(ends, at, "right")].astype(np.int32), names.tolist()


def _bigrams(part: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(lang, text) in; (lang, b, c, n) of the pairs whose second word falls to a slice out, summed within some SUMMED pairs."""

    def summed(found: list[tuple[np.ndarray, np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
        pairs = np.concatenate([p for p, _ in found], axis=1)
        _, first, n = np.unique(_key(*pairs), return_index=True, return_counts=True)  # words hold their language
        lang = np.concatenate([c for _, c in found])[first]
        for lo in range(0, len(first), ROWS):
            here = slice(lo, lo + ROWS)
            own = pa.DictionaryArray.from_arrays(pa.array(lang[here]), pa.array(names, pa.string())).dictionary_decode()
            yield pa.RecordBatch.from_arrays([own, *(pa.array(c) for c in pairs[:, first[here]].view(np.int64)), pa.array(n[here].astype(np.int32))], ["lang", "b", "c", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, int] = {}
        found, held = [], 0
        for pairs, codes, names in _pairs(batches, part):
            found.append((pairs, np.array([numbers.setdefault(x, len(numbers)) for x in names], np.int32)[codes]))
            held += len(codes)
            if held >= SUMMED:
                yield from summed(found, list(numbers))
                found, held, numbers = [], 0, {}
        if held:
            yield from summed(found, list(numbers))

    return run


class _Head:
    """The most frequent weights as arrays sorted by key, with the place where the keys of each leading bits begin."""

    def __init__(self, rows: pa.Table):
        k = rows["k"].to_numpy().view(np.uint64)
        order = np.argsort(k)
        self.k, self.v, self.u = k[order], rows["v"].to_numpy()[order], rows["u"].to_numpy()[order].astype(np.int8)
        self.bits = max(1, min(21, 2 + len(k).bit_length()))
        counts = np.bincount((self.k >> np.uint64(64 - self.bits)).astype(np.int64), minlength=1 << self.bits)
        self.begin = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)

    def places(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, and whether it is there. Keys are hashes, so few share their leading bits."""
        lead = (k >> np.uint64(64 - self.bits)).astype(np.int64)
        at, ends = self.begin[lead], self.begin[lead + 1]
        there = np.zeros(len(k), bool)
        left = np.flatnonzero(at < ends)
        while len(left):
            hit = self.k[at[left]] == k[left]
            there[left[hit]] = True
            left = left[~hit]
            at[left] += 1
            left = left[at[left] < ends[left]]
        return at, there


def _keys_of(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all symbols, then of all pairs within a text, with the place of the (first) symbol of each."""
    pair = np.ones(len(x) - 1, bool)
    pair[ends[:-1] - 1] = False
    at = np.flatnonzero(pair)
    return np.concatenate([_key(x), _key(x[at], x[at + 1])]), np.concatenate([np.arange(len(x)), at])


def _heads(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, lang, row, model, text) in; in place of the text the number of words and the end, and the sums over the head out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: _Head = sent.value
        for batch in batches:
            langs = batch.column(3).to_pylist()
            symbols, s, known = np.zeros(len(batch), np.int64), np.zeros(len(batch)), np.zeros(len(batch), np.int64)
            for own, x, begins, ends in _sequences(batch.column(4), langs, PIECE):
                keys, where = _keys_of(x, ends)
                at, there = head.places(keys)
                at, text = at[there], np.searchsorted(ends, where[there], "right")
                symbols[own] = ends - begins - 1
                s[own] = np.bincount(text, head.v[at], len(own))
                known[own] = np.bincount(text, head.u[at], len(own)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(symbols), pa.array(s), pa.array(known)], ["id", "lang", "row", "model", "symbols", "s0", "known0"])

    return run


def _tails(sent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(row, model, text) in; (k, row, n) of each text's distinct words and pairs that the head does not hold out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: _Head = sent.value
        for batch in batches:
            rows = batch.column(0).to_numpy()
            for own, x, _, ends in _sequences(batch.column(2), batch.column(1).to_pylist(), PIECE):
                keys, where = _keys_of(x, ends)
                away = ~head.places(keys)[1]
                keys, where = keys[away], where[away]
                text = np.searchsorted(ends, where, "right").astype(np.uint16)
                order = np.argsort(keys)
                order = order[np.argsort(text[order], kind="stable")]  # by text, then key
                keys, text = keys[order], text[order]
                fresh = np.ones(len(keys), bool)
                fresh[1:] = (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(fresh)
                n = np.diff(first, append=len(keys)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys[first].view(np.int64)), pa.array(rows[own][text[first]]), pa.array(n)], ["k", "row", "n"])

    return run


def _keyed(df: DataFrame, words: list[str]) -> DataFrame:
    """(k, v, u, f) from rows of words with their weight v, u, which is 1 for a known word, and the class f of their count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [c.to_numpy().view(np.uint64) for c in batch.columns[: len(words)]]
            yield pa.RecordBatch.from_arrays([pa.array(_key(*cols).view(np.int64)), *batch.columns[len(words) :]], ["k", "v", "u", "f"])

    return df.select(*words, "v", "u", "f").mapInArrow(run, "k long, v double, u int, f int")


def _class(n: Column) -> Column:
    """Counts in classes that grow by an eighth of a doubling: a few hundred of them."""
    return F.floor(F.log2(n) * 8).cast("int")


def _with_discounts(counts: DataFrame, rows: DataFrame) -> DataFrame:
    """``counts`` with the discount d of each row."""
    d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    return counts.join(rows, "lang").withColumn("d", d).drop("d1", "d2", "d3")


def _discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts d1, d2 and d3 (of counts of 1, 2 and 3 or more), a row for each language."""
    cc = counts.groupBy("lang").agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)])
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))

    def discount(k: int) -> Column:
        below, above = F.col(f"n{k}"), F.col(f"n{k + 1}")
        return F.when(below > 0, F.greatest(F.lit(0.05), F.least(F.lit(k - 0.05), k - (k + 1) * y * above / below))).otherwise(F.lit(k * 0.6))

    return durable(cc.select("lang", *[discount(k).alias(f"d{k}") for k in (1, 2, 3)]), "lm-discounts")


class WordModel:
    """The weights of ``trusted`` (lang, text): ``sent``, a broadcast of the head, the bucketed table of the rest, and ``unknown`` (lang, unknown)."""

    def __init__(self, trusted: DataFrame):
        spark = trusted.sparkSession
        self.spark = spark
        counted = "lang string, b long, c long, n int"
        parts = [
            durable(trusted.mapInArrow(_bigrams(i), counted).groupBy("lang", "b", "c").agg(F.sum("n").cast("int").alias("n")).sortWithinPartitions("b", "c"), "lm-pairs", compression="zstd")
            for i in range(SLICES)
        ]
        two = reduce(DataFrame.unionByName, parts)
        one = durable(two.groupBy("lang", "c").agg(F.count(F.lit(1)).alias("n")), "lm-words")  # continuation counts: contexts to the left
        d1, d2 = _discounts(one), _discounts(two)
        rated = _with_discounts(one, d1)
        whole = rated.groupBy("lang").agg(F.sum("n").cast("double").alias("total"), F.sum("d").alias("taken"), F.count(F.lit(1)).alias("types"))
        bases = durable(whole.select("lang", "total", (F.col("taken") / F.col("total") / (F.col("types") + 1)).alias("base")), "lm-unknown")
        self.unknown = bases.select("lang", (-F.log("base")).alias("unknown"))
        p1 = durable(rated.join(bases, "lang").select("c", ((F.col("n") - F.col("d")) / F.col("total") + F.col("base")).alias("p1")), "lm-p1")
        back = durable(_with_discounts(two, d2).groupBy("b").agg(F.sum("n").alias("total"), F.sum("d").alias("taken")), "lm-back")
        release(one)

        words = p1.select(F.col("c").alias("w"), F.log("p1").alias("v"), F.lit(1).alias("u"), F.lit(1).cast("long").alias("f"))
        words = words.unionByName(back.select(F.col("b").alias("w"), F.log(F.col("taken") / F.col("total")).alias("v"), F.lit(0).alias("u"), F.col("total").alias("f")))
        words = words.groupBy("w").agg(F.sum("v").alias("v"), F.max("u").alias("u"), _class(F.max("f")).alias("f"))
        sizes = two.groupBy(_class(F.col("n")).alias("f")).count().unionByName(words.groupBy("f").count())
        least, held = 0, 0
        for r in sizes.groupBy("f").agg(F.sum("count").alias("n")).orderBy(F.desc("f")).collect():  # one row a class
            held += r["n"]
            if held > HEAD:
                least = r["f"] + 1
                break

        name = f"lm_weights_{uuid.uuid4().hex}"
        self.name, self.folder = name, f"{shared_dir(spark)}/{name}"
        shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
        heads: list[pa.Table] = []
        for i, part in enumerate([None, *parts]):
            if part is None:
                each = _keyed(words, ["w"])
            else:
                share = (F.col("n") - F.col("d")) / (F.col("taken") * F.col("p1"))
                each = _with_discounts(part, d2).join(back, "b").join(p1, "c").select("b", "c", F.log1p(share).alias("v"), F.lit(0).alias("u"), _class(F.col("n")).alias("f"))
                each = _keyed(each, ["b", "c"])
            each = durable(each, "lm-slice", compression="zstd")
            if i:
                release(part)
            heads.append(each.filter(F.col("f") >= least).select("k", "v", "u").toArrow())  # HEAD rows at most in all
            with tidy_shuffles(spark):
                rest = each.filter(F.col("f") < least).select("k", "v", F.col("u").cast("boolean").alias("u")).repartition(shards, "k")
                rest.write.bucketBy(shards, "k").mode("append").option("path", self.folder).option("compression", "zstd").saveAsTable(name)
            release(each)
        release(p1, back, d1, d2)
        self.sent = spark.sparkContext.broadcast(_Head(pa.concat_tables(heads)))
        self.has_rest = not spark.table(name).isEmpty()

    def drop(self) -> None:
        """Delete the table; what was scored by it has been written."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove(self.spark, self.folder)
        self.sent.unpersist()


def score(texts: DataFrame, model: WordModel) -> DataFrame:
    """id, lang, row, symbols (words and the end), nll of each text; ``texts``: id, lang, row, model, text.

    Equal rows share a ``row``, so their joined sums are of all of them and are divided by their number.
    """
    kinds = "id long, lang string, row long, model string, symbols long, s0 double, known0 long"
    sizes = durable(texts.select("id", "lang", "row", "model", "text").mapInArrow(_heads(model.sent), kinds), "lm-sizes")
    parts = []
    for i in range(SLICES if model.has_rest else 0):
        some = texts.filter("model IS NOT NULL").filter(F.pmod("row", F.lit(SLICES)) == i).select("row", "model", "text")
        met = some.mapInArrow(_tails(model.sent), "k long, row long, n int").join(texts.sparkSession.table(model.name), "k")
        sums = met.groupBy("row").agg(F.sum(F.col("n") * F.col("v")).alias("s"), F.sum(F.when(F.col("u"), F.col("n")).otherwise(F.lit(0))).alias("known"))
        parts.append(durable(sums, "lm-sums"))
    out = sizes.join(model.unknown.withColumnRenamed("lang", "model"), "model", "left")
    s, known = F.col("s0"), F.col("known0").cast("double")
    if parts:
        times = sizes.groupBy("row").agg(F.count(F.lit(1)).alias("times"))
        each = reduce(DataFrame.unionByName, parts).join(times, "row").select("row", (F.col("s") / F.col("times")).alias("s"), (F.col("known") / F.col("times")).alias("known"))
        out = out.join(each, "row", "left")
        s, known = s + F.coalesce("s", F.lit(0.0)), known + F.coalesce("known", F.lit(0.0))
    return out.select("id", "lang", "row", "symbols", ((F.col("symbols") - known) * F.col("unknown") - s).alias("nll"))


def _shrunk(quantiles: DataFrame, pooled: Row, tails: int) -> DataFrame:
    """lang, l and hs (limits by tail) of each language with held-out documents.

    A limit's distance from the language's own median is the mean, in logarithms, of its own distance by
    its number of documents and of the pooled one by SHRINK; it never cuts off what its own quantile keeps.
    """

    def limit(own: Column, middle: Column, n: Column, spread: float) -> Column:
        return F.exp(F.log(middle) + (n * F.log(own / middle) + SHRINK * F.lit(spread)) / (n + SHRINK))

    low, below = F.col("below")[0], limit(F.col("below")[0], F.col("below")[1], F.col("n"), math.log(pooled["below"][0] / pooled["below"][1]))
    hs = [
        F.greatest(F.col("above")[i], limit(F.col("above")[i], F.col("above")[0], F.col("held"), math.log(pooled["above"][i] / pooled["above"][0])))
        for i in range(1, tails + 1)
    ]
    return durable(quantiles.filter("held > 0").select("lang", F.least(low, below).alias("l"), F.array(*hs).alias("hs")), "lm-limits")


def row_name(ident: Column, lang: Column, text: Column) -> Column:
    """The 64-bit name under which ``classify`` judges a row; equal rows share it."""
    return F.xxhash64(ident.cast("long"), lang.cast("string"), text.cast("string"))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", tail: float | None = None
) -> DataFrame:
    """One row per input row: id, lang, row (``row_name``), symbols, perplexity, low, high, accepted.

    ``labels``: id, quality, toxic. A document is accepted when its perplexity lies within its
    language's quantiles ``tail`` over trusted documents and 1 - ``tail`` over held-out ones; where no
    ``tail`` is given, the lower one is TAIL, and the upper one that of TAILS which keeps the largest
    share of held-out documents less the share of documents of bad quality, none of which are trained on. A text
    without words (null, empty or blank) has no perplexity and is rejected. Every language has its own
    model and limits, the latter shrunk (``_shrunk``); a null language takes the model of all trusted
    text and its limits. Documents with a text are accepted where nothing is trusted, or nothing held
    out, in their language; their perplexity is by the model of all trusted text where theirs has none. Null or contradictory labels count as trusted when
    some row of the id says good and none says bad. Repeated rows are judged alike.
    """
    spark = docs.sparkSession
    bounded_batches(spark, BATCH_BYTES)
    spark.conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "16MB")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    trusted = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(good).alias("good"), F.max(F.coalesce(bad, F.lit(False))).alias("bad"))
    # a document on its own is trained on; held out is a fixed share by the id's hash
    trusted = durable(trusted.filter("good AND NOT bad AND id IS NOT NULL").select("id", (unit_hash(F.col("id")) * HELD_OUT < 1).alias("held")), "lm-trusted")

    trained = texts.join(ids_beside(trusted.filter("NOT held").select("id")), "id").select("lang", "text")
    langs = durable(trained.filter(F.col("lang").isNotNull() & F.col("text").rlike(WORD)).select("lang").distinct(), "lm-langs")
    named = texts.join(langs.withColumnRenamed("lang", "own"), F.col("lang") == F.col("own"), "left")
    named = named.select("id", "lang", row_name(F.col("id"), F.col("lang"), F.col("text")).alias("row"), F.coalesce("own", F.lit(POOLED)).alias("model"), "text")
    if named.filter(F.col("model") == POOLED).limit(1).count():
        trained = trained.filter("lang IS NOT NULL").unionByName(trained.withColumn("lang", F.lit(POOLED)))
    model = WordModel(trained)
    scored = durable(score(named, model), "lm-scores")
    model.drop()
    scored = scored.withColumn("perplexity", F.when(F.col("symbols") > 0, F.exp(F.col("nll") / F.col("symbols"))))

    seen = scored.filter("perplexity IS NOT NULL").join(trusted, "id")
    unseen = F.when(F.col("held"), F.col("perplexity"))
    tails = TAILS if tail is None else (tail,)
    limits = [
        F.percentile_approx("perplexity", [TAIL if tail is None else tail, 0.5], 10_000).alias("below"),
        F.percentile_approx(unseen, [0.5, *[1 - t for t in tails]], 10_000).alias("above"),
        F.count(F.lit(1)).alias("n"),
        F.count(unseen).alias("held"),
    ]
    pooled = seen.agg(*limits).first()
    by_lang = _shrunk(durable(seen.filter("lang IS NOT NULL").groupBy("lang").agg(*limits), "lm-quantiles"), pooled, len(tails)) if pooled["above"] else None
    if by_lang is None:
        by_lang = spark.createDataFrame([], "lang string, l double, hs array<double>")
    pooled_highs = F.lit(pooled["above"][1:] if pooled["above"] else None).cast("array<double>")
    highs = F.when(F.col("lang").isNull(), pooled_highs).otherwise(F.col("hs"))
    best = 0
    if len(tails) > 1 and pooled["above"]:
        poor = labels.filter("quality = 0").select(F.col(id_col).cast("long").alias("id"), F.lit(True).alias("poor")).distinct()
        told = seen.filter("held").select("lang", "perplexity", F.lit(False).alias("poor")).unionByName(
            scored.filter("perplexity IS NOT NULL").join(poor, "id").select("lang", "perplexity", "poor")
        )
        told = told.join(by_lang, "lang", "left").select("poor", *[(F.col("perplexity") <= highs[i]).cast("int").alias(f"t{i}") for i in range(len(tails))])
        shares = {r["poor"]: r for r in told.groupBy("poor").agg(*[F.avg(f"t{i}").alias(f"t{i}") for i in range(len(tails))]).collect()}
        if True in shares and False in shares:
            best = max(range(len(tails)), key=lambda i: ((shares[False][f"t{i}"] or 0) - (shares[True][f"t{i}"] or 0), -i))
    low = F.when(F.col("lang").isNull(), F.lit(pooled["below"][0] if pooled["above"] else None).cast("double")).otherwise(F.col("l"))
    out = scored.join(by_lang, "lang", "left").select("id", "lang", "row", "symbols", "perplexity", low.alias("low"), highs[best].alias("high"))
    within = F.coalesce(F.col("perplexity").between(F.col("low"), F.col("high")), F.col("high").isNull() & (F.col("symbols") > 0))
    return out.withColumn("accepted", within).withColumnRenamed("id", id_col)


def op8_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_quality_lm": op8_quality_lm}
ORACLE: dict = {}
