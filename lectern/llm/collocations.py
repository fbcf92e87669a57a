"""Phrase collocations by hashed bucket counts and Apriori pruning.

Pass 1 counts words and, on the side, adds every pair of neighbours to a table of small counters by hash.
Pass 2 counts exactly those pairs whose words are both frequent and whose counter reached the minimum, and
adds triples of surviving pairs to counters in turn; pass 3 counts the triples that are left. Frequent words
and pairs go to tasks as bitmaps by hash, as do the counters: each has a fixed number of bits, whatever the
corpus, and prunes only, since every phrase that gets through is counted exactly, by its text.

A task reads its texts in a stream of small Arrow batches, gives words local numbers and counts pairs and
triples of numbers; partial counts leave the task whenever its vocabulary is full, so its memory is bounded.
Counters leave it in blocks, as places and counts where few are set, and are added up block by block in a
stream. Scores, parts and containment are joins and exact decimal arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import LOWER, UPPER, durable, release, settings, table
from lectern.llm.shingles import mix

#: Counters by hash and the bits of each bitmap: 2^26 bits are 8 MB.
BITS = 26
#: Counters of one block; a block is one row of the table of partial counters.
BLOCK = 1 << 16
#: Counters stop here; a minimum count has to be lower.
FULL = 255
#: Distinct words, and distinct pairs or triples, that a task holds before it gives out what it counted.
WORDS, PHRASES = 1 << 18, 1 << 20
#: Rows of a batch of partial counts.
ROWS = 1 << 16
#: Bytes read at once; a longer text is cut between pieces.
CHUNK = 1 << 20
#: Salts of a language's phrases in the first of two rounds that choose the best.
SALTS = 64

_BREAKS = bytes.maketrans(UPPER.encode() + b"\t.,;:!?\x0b\x0c\r", LOWER.encode() + b" " + b"\n" * 9)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
PARTIAL = "lang string, phrase string, block int, n long, cells binary"


class Bitmap:
    """A set of hashes by their first bits; it may hold more than was put in, never less."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.shift = np.uint64(64 - bits)
        self.data = np.zeros(max(1, (1 << bits) // 8), np.uint8) if words is None else words

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.data[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _by_block(at: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of sorted places that lie in one block."""
    cut = np.flatnonzero(np.diff(at // BLOCK, prepend=-1)).tolist()
    return list(zip(cut, [*cut[1:], len(at)])) if cut else []


class Cells:
    """Counters by hash, kept in a task; blocks come into being when they are used."""

    def __init__(self, bits: int):
        self.shift, self.blocks = np.uint64(64 - bits), {}

    def add(self, hashes: np.ndarray) -> None:
        at, n = np.unique((hashes >> self.shift).astype(np.int64), return_counts=True)
        for lo, hi in _by_block(at):
            cells = self.blocks.setdefault(int(at[lo]) // BLOCK, np.zeros(BLOCK, np.uint8))
            where = at[lo:hi] % BLOCK
            cells[where] = np.minimum(cells[where] + np.minimum(n[lo:hi], FULL), FULL)

    def rows(self) -> Iterator[tuple[int, bytes]]:
        for block, cells in sorted(self.blocks.items()):
            where = np.flatnonzero(cells)
            if 3 * len(where) < BLOCK:
                yield block, where.astype("<u2").tobytes() + cells[where].tobytes()
            else:
                yield block, cells.tobytes()


def add_cells(into: np.ndarray, row: bytes) -> None:
    """Add a block as ``Cells.rows`` writes it."""
    if len(row) == BLOCK:
        np.copyto(into, np.minimum(into.astype(np.uint16) + np.frombuffer(row, np.uint8), FULL).astype(np.uint8))
    else:
        n = len(row) // 3
        where = np.frombuffer(row, "<u2", n)
        into[where] = np.minimum(into[where].astype(np.uint16) + np.frombuffer(row, np.uint8, n, 2 * n), FULL)


class _Vocabulary(dict):
    """Local numbers of words, given as they come; 0 is a break between pieces, 1 the empty word."""

    def __init__(self):
        super().__init__({b"\n": 0, b"": 1})
        self.words = [b"\n", b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        self.words.append(word)
        return n


class _Counts:
    """Counts of pairs or triples of local numbers: sorted rows that are merged when they grow."""

    def __init__(self):
        self.parts, self.size, self.merged = [], 0, 0

    def add(self, keys: np.ndarray) -> None:
        if len(keys):
            self.parts.append(_distinct(keys, np.ones(len(keys), np.int64)))
            self.size += len(self.parts[-1][1])
            if self.size > 2 * self.merged + PHRASES // 4:
                self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            self.parts = [_distinct(np.concatenate([k for k, _ in self.parts]), np.concatenate([n for _, n in self.parts]))]
        self.size = self.merged = len(self.parts[0][1]) if self.parts else 0
        return self.parts[0] if self.parts else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64))


def _distinct(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of up to three numbers, with their summed counts; numbers below 2^21 fit in one 64-bit key."""
    if keys.max(initial=0) < 1 << 21:
        packed = keys[:, 0]
        for k in range(1, keys.shape[1]):
            packed = packed << 21 | keys[:, k]
        order = np.argsort(packed, kind="stable")
        first = np.flatnonzero(np.diff(packed[order], prepend=-1))
    else:
        order = np.lexsort(keys.T)
        first = np.flatnonzero(np.concatenate([[True], (keys[order[1:]] != keys[order[:-1]]).any(1)]))
    return keys[order[first]], np.add.reduceat(n[order], first) if len(first) else n[:0]


class _Task:
    """One task's counting. ``words`` is the pass: 1, 2 or 3 words are counted exactly, one more by hash."""

    def __init__(self, words: int, bits: int, frequent: Bitmap | None, cells: Bitmap | None, longest: int):
        self.words, self.frequent, self.pruned = words, frequent, cells
        self.next = Cells(bits) if words < longest else None
        self.clear()

    def clear(self) -> None:
        self.vocabulary, self.hashes = _Vocabulary(), np.zeros(2, np.uint64)
        self.single: dict[str, np.ndarray] = {}
        self.phrases: dict[str, _Counts] = {}

    def full(self) -> bool:
        return len(self.vocabulary) > WORDS or sum(c.size for c in self.phrases.values()) > PHRASES

    def read(self, lang: str, texts: bytes) -> None:
        """Texts without capitals and with line ends for all breaks, as ``_chunks`` makes them."""
        raw = texts.replace(b"\n", b" \n ")
        ids = np.fromiter(map(self.vocabulary.__getitem__, raw.split(b" ")), np.int64)
        ids = np.concatenate([[0], ids[ids != 1], [0]])
        new = self.vocabulary.words[len(self.hashes) :]
        if new:
            self.hashes = np.concatenate([self.hashes, np.fromiter((_hash(w) for w in new), np.uint64, len(new))])
        base = _hash(b"\x00" + lang.encode())
        if self.words == 1:
            n = np.bincount(ids, minlength=len(self.vocabulary))
            n[:2] = 0
            seen = self.single.get(lang, n[:0])
            n[: len(seen)] += seen
            self.single[lang] = n
        h = self.hashes[ids]
        real = ids > 0
        pair = real[:-1] & real[1:]
        if self.words == 1:
            self.next.add(_pair_hash(base, h[:-1][pair], h[1:][pair]))
            return
        if self.words == 2:
            good = self.frequent.holds(mix(self.hashes ^ np.uint64(base)))[ids] & real
            pair &= good[:-1] & good[1:]
            at = np.flatnonzero(pair)
            pair[at] = self.pruned.holds(_pair_hash(base, h[at], h[at + 1]))
            at = np.flatnonzero(pair)
            self.phrases.setdefault(lang, _Counts()).add(np.stack([ids[at], ids[at + 1]], 1))
        else:
            at = np.flatnonzero(pair)
            pair[at] = self.frequent.holds(_pair_hash(base, h[at], h[at + 1]))
        at = np.flatnonzero(pair[:-1] & pair[1:])
        three = _triple_hash(base, h[at], h[at + 1], h[at + 2])
        if self.words == 2:
            if self.next is not None:
                self.next.add(three)
            return
        at = at[self.pruned.holds(three)]
        self.phrases.setdefault(lang, _Counts()).add(np.stack([ids[at], ids[at + 1], ids[at + 2]], 1))

    def counted(self) -> Iterator[pa.RecordBatch]:
        """What was counted so far; the task starts anew."""
        words = pa.array(self.vocabulary.words, pa.binary())
        for lang, n in self.single.items():
            at = np.flatnonzero(n)
            for lo in range(0, len(at), ROWS):
                part = at[lo : lo + ROWS]
                yield _batch(lang, words.take(pa.array(part)), n[part])
        for lang in list(self.phrases):
            keys, n = self.phrases.pop(lang).merge()
            for lo in range(0, len(n), ROWS):
                parts = [words.take(pa.array(column)) for column in keys[lo : lo + ROWS].T]
                yield _batch(lang, pc.binary_join_element_wise(*parts, b" "), n[lo : lo + ROWS])
        self.clear()

    def cells(self) -> Iterator[pa.RecordBatch]:
        for block, row in self.next.rows() if self.next is not None else ():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([block], pa.int32()), pa.nulls(1, pa.int64()), pa.array([row], pa.binary())], names=["lang", "phrase", "block", "n", "cells"])


def _chunks(texts: pa.Array) -> Iterator[bytes]:
    """Texts joined by a break, some CHUNK bytes at once."""
    part, size = [], 0
    for text in texts:
        text = text.as_py().translate(_BREAKS)
        at = 0
        while len(text) - at > CHUNK:
            cut = text.rfind(b"\n", at, at + CHUNK)
            cut = cut if cut >= 0 else text.find(b"\n", at + CHUNK)
            if cut < 0:
                break
            yield text[at:cut]
            at = cut + 1
        part.append(text[at:])
        size += len(part[-1])
        if size > CHUNK:
            yield b"\n".join(part)
            part, size = [], 0
    if part:
        yield b"\n".join(part)


def _batch(lang: str, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    k = len(phrases)
    return pa.RecordBatch.from_arrays([pa.array([lang] * k, pa.string()), phrases.cast(pa.string()), pa.nulls(k, pa.int32()), pa.array(n, pa.int64()), pa.nulls(k, pa.binary())], names=["lang", "phrase", "block", "n", "cells"])


def _hash(word: bytes) -> int:
    """64 bits of a word; the same in every task."""
    return xxhash.xxh3_64_intdigest(word)


def _pair_hash(base: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _ODD[0] + mix(b * _ODD[1] + np.uint64(base)))


def _triple_hash(base: int, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return mix(a * _ODD[2] + _pair_hash(base, b, c))


def phrase_hash(lang: str, phrase: bytes) -> int:
    """The hash by which tasks look up a frequent word or pair."""
    words = np.array([_hash(w) for w in phrase.split(b" ")], np.uint64)
    base = _hash(b"\x00" + lang.encode())
    h = mix(words ^ np.uint64(base)) if len(words) == 1 else _pair_hash(base, words[:1], words[1:])
    return int(h[0])


def _pass(texts: DataFrame, words: int, bits: int, frequent: Bitmap | None, cells: Bitmap | None, longest: int) -> DataFrame:
    """The table of partial counts of one reading of all texts."""
    sent = texts.sparkSession.sparkContext.broadcast((frequent, cells))  # two bitmaps of 2^bits bits at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task(words, bits, *sent.value, longest)
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                for part in _chunks(batch.column(1).filter(pa.array([x == lang for x in langs])).cast(pa.binary())):
                    task.read(lang, part)
                    if task.full():
                        yield from task.counted()
        yield from task.counted()
        yield from task.cells()

    spark = texts.sparkSession
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2000", spark__sql__execution__arrow__maxBytesPerBatch=str(4 << 20)):
        return durable(texts.mapInArrow(run, PARTIAL), f"phrases-{words}", compression="zstd")


def _bitmap(rows: DataFrame, bits: int) -> Bitmap:
    """Put together the bitmap's blocks (block, bits): 2^bits bits in all, whatever the corpus."""
    out = Bitmap(bits)
    size = min(BLOCK, 1 << bits) // 8
    for r in rows.toLocalIterator():
        at = r["block"] * size
        out.data[at : at + size] |= np.frombuffer(r["cells"], np.uint8)
    return out


def _full_cells(partial: DataFrame, bits: int, least: int) -> Bitmap:
    """The counters that reach ``least``, added up over all tasks.

    Rows of a block are added in a stream, never collected: within the tasks that read them, then by block and salt,
    then by block. Sums that stop at FULL don't depend on their order.
    """

    def added(batches: Iterator[pa.RecordBatch], last: bool = False) -> Iterator[pa.RecordBatch]:
        sums = Cells(bits)
        for batch in batches:
            for block, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                add_cells(sums.blocks.setdefault(block, np.zeros(BLOCK, np.uint8)), row.as_py())
        found = sums.rows() if not last else ((b, np.packbits(c >= least, bitorder="little")[: min(BLOCK, 1 << bits) // 8].tobytes()) for b, c in sums.blocks.items())
        for block, row in found:
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([row], pa.binary())], names=["block", "cells"])

    schema = "block int, cells binary"
    salt = F.pmod(F.xxhash64("cells"), F.lit(SALTS))
    with settings(partial.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="64"):
        rows = partial.filter("block IS NOT NULL").select("block", "cells").mapInArrow(added, schema)
        rows = rows.repartition("block", salt).mapInArrow(added, schema)
        full = durable(rows.repartition("block").mapInArrow(lambda b: added(b, True), schema), "full-cells")
    out = _bitmap(full, bits)
    release(full)
    return out


def _named(counts: DataFrame, bits: int) -> Bitmap:
    """A bitmap of the phrases of a table of frequent ones; its bits are joined within tasks, then by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: list[np.ndarray] = []
        held = 0

        def out():
            at = np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)
            for lo, hi in _by_block(at):
                cells = np.zeros(BLOCK, np.uint8)
                cells[at[lo:hi] % BLOCK] = FULL
                where = np.flatnonzero(cells)
                row = where.astype("<u2").tobytes() + cells[where].tobytes() if 3 * len(where) < BLOCK else cells.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([int(at[lo]) // BLOCK], pa.int32()), pa.array([row], pa.binary())], names=["block", "cells"])

        for batch in batches:
            found = [phrase_hash(lang, phrase.encode()) for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            places.append((np.array(found, np.uint64) >> np.uint64(64 - bits)).astype(np.int64))
            held += len(found)
            if held > 1 << 22:
                yield from out()
                places, held = [], 0
        yield from out()

    rows = counts.select("lang", "phrase").mapInArrow(run, "block int, cells binary")
    return _full_cells(rows, bits, FULL)


def _counted(partial: DataFrame) -> DataFrame:
    return partial.filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (l r)), exactly for counts below 10^15; at most 10^6, since neither part is rarer than the phrase."""
    wide = [c.cast("decimal(15,0)") for c in (a, left, right)]
    return F.call_function("div", wide[0] * wide[0] * F.lit(1_000_000).cast("decimal(7,0)"), wide[1] * wide[2]).cast("long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", least: int = 10, top: int = 2000, bits: int = BITS) -> DataFrame:
    """The best phrases of two or three words of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase that occurs ``least`` times (at most 255) or more is scored at its weakest cut, and dropped if a longer
    one holds it at least half as often; ``n`` is the language's number of words. A null text counts as empty, a null
    language as ``und``; without ``lang_col`` all rows are of one language. Repeated rows count each time; ties in
    score go by frequency, then by the phrase's bytes. An empty table gives no rows. Whole texts of any length are
    read; other columns are ignored.
    """
    if not 1 <= least < FULL:
        raise ValueError(f"least must lie between 1 and {FULL - 1}")
    lang = F.coalesce(docs[lang_col].cast("string"), F.lit("und")) if lang_col else F.lit("und")
    texts = docs.select(lang.alias("lang"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    partial = _pass(texts, 1, bits, None, None, 3)
    words = durable(_counted(partial), "word-counts")
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    pairs_full = _full_cells(partial, bits, least)
    frequent_words = _named(words.filter(F.col("f") >= least), bits)
    release(partial)
    partial = _pass(texts, 2, bits, frequent_words, pairs_full, 3)
    pairs = durable(_counted(partial).filter(F.col("f") >= least), "pair-counts")
    triples_full = _full_cells(partial, bits, least)
    frequent_pairs = _named(pairs, bits)
    release(partial)
    partial = _pass(texts, 3, bits, frequent_pairs, triples_full, 3)
    triples = durable(_counted(partial).filter(F.col("f") >= least), "triple-counts")
    release(partial)

    cut = F.split("phrase", " ")
    one = words.filter(F.col("f") >= least)
    two = pairs.select("lang", "phrase", F.col("f").alias("a"), cut[0].alias("first"), cut[1].alias("last"))
    two = two.join(one.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    two = durable(two.join(one.select("lang", F.col("phrase").alias("last"), F.col("f").alias("r")), ["lang", "last"]).select("lang", "phrase", "a", "l", "r"), "pair-parts")
    three = triples.select("lang", "phrase", F.col("f").alias("a"), F.concat_ws(" ", cut[0], cut[1]).alias("head"), F.concat_ws(" ", cut[1], cut[2]).alias("tail"))
    held = three.select("lang", F.explode(F.array_distinct(F.array("head", "tail"))).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = two.join(held, ["lang", "phrase"], "left").filter((F.col("longer").isNull()) | (2 * F.col("longer") < F.col("a")))
    heads = two.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l2"), F.col("l").alias("l1"))
    tails = two.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r1"), F.col("r").alias("r2"))
    three = three.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
    at1, at2 = _score(F.col("a"), F.col("l1"), F.col("r1")), _score(F.col("a"), F.col("l2"), F.col("r2"))
    best = F.when(at2 < at1, F.struct(F.col("l2").alias("l"), F.col("r2").alias("r"), at2.alias("score"))).otherwise(F.struct(F.col("l1").alias("l"), F.col("r1").alias("r"), at1.alias("score")))
    three = three.select("lang", "phrase", "a", best.alias("best")).select("lang", "phrase", "a", "best.*")
    scored = kept.select("lang", "phrase", "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score")).unionByName(three)

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    out = durable(ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), "collocations")
    release(words, pairs, triples, two)
    return out


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), w AS (
  SELECT lang, row_number() OVER () AS p, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces
), t AS (
  SELECT lang, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w
), n AS (
  SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM t WINDOW o AS (PARTITION BY p ORDER BY i)
), grams AS (
  SELECT lang, 1 AS k, w AS phrase FROM n
  UNION ALL SELECT lang, 2, w || ' ' || w2 FROM n WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM n WHERE w3 IS NOT NULL
), f AS (
  SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL
), cand AS (
  SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 10
), cuts AS (
  SELECT c.lang, c.phrase, c.a, j.j, x.a AS l, y.a AS r,
         CAST(CAST(1000000 AS HUGEINT) * c.a * c.a // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM cand c JOIN (VALUES (1), (2)) j(j) ON j.j < c.k
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:j.j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[j.j + 1:], ' ')
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) AS rn FROM cuts
), longer AS (
  SELECT lang, p AS phrase, max(a) AS m FROM (
    SELECT lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS p FROM cand WHERE k = 3
  ) GROUP BY ALL
), ranked AS (
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank, b.phrase, b.a, l, r, score
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase
  WHERE rn = 1 AND (m IS NULL OR 100 * m < 50 * b.a)
)
SELECT r.lang, rank, phrase, a, l, r, n, score
FROM ranked r JOIN (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang) t ON t.lang = r.lang
WHERE rank <= 2000
"""

QUERIES = {"op12_collocations": op12_collocations}
ORACLE = {"op12_collocations": SQL}
