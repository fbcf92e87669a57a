"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a word with the space before it. The model is a public vocabulary of byte pieces whose
probabilities follow their rank by the Zipf-Mandelbrot law; a pre-token's tokens are its most probable
segmentation (of equals, the one of fewest tokens). A task takes the distinct pre-tokens of its texts,
inserts them in a trie and computes the forward score of each node once, so that words share the work
of their common prefixes; the counts stored at terminal nodes are then added up for each text. The trie
is built level by level in arrays. Tasks are independent: nothing is shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lectern.llm.common import table
from lectern.llm.ngram_join import bounded_batches
from lectern.llm.shingles import PLAIN, text_bytes, word_spans

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_MANDELBROT = 2.7
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Distinct pre-tokens inserted in one trie, and those whose counts a task remembers.
TRIE_WORDS, MEMORY_WORDS = 1 << 14, 1 << 20
#: Longer pre-tokens share no trie with others: each is scored along its own path, which is a trie of one word.
TRIE_BYTES, PATH_BYTES = 512, 1 << 16


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    """Pieces and ranks of a rank file (base64 piece, rank); every single byte must be a piece."""
    with open(path, "rb") as f:
        return {base64.b64decode(p): int(r) for p, r in (line.split() for line in f if line.strip())}


def piece_scores(vocabulary: dict[bytes, int]) -> dict[bytes, float]:
    """Log-probabilities by rank."""
    weights = {p: 1.0 / (r + _MANDELBROT) for p, r in vocabulary.items()}
    total = sum(sorted(weights.values()))
    return {p: float(np.log(w / total)) for p, w in weights.items()}


class Pieces:
    """The vocabulary as sorted hash arrays by length: only these are sent to tasks."""

    def __init__(self, scores: dict[bytes, float]):
        by_length: dict[int, list[tuple[int, float]]] = {}
        for piece, score in scores.items():
            h = 0
            for b in piece:
                h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
            by_length.setdefault(len(piece), []).append((h, score))
        self.longest = max(by_length)
        self.tables = {}
        for n, rows in by_length.items():
            rows.sort()
            self.tables[n] = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows])

    def scores(self, hashes: np.ndarray, length: int) -> np.ndarray:
        """Scores of strings of one length by hash; minus infinity for those that are no piece."""
        if length not in self.tables:
            return np.full(len(hashes), -np.inf)
        keys, values = self.tables[length]
        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return np.where(keys[at] == hashes, values[at], -np.inf)


def trie_counts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, pieces: Pieces) -> np.ndarray:
    """Numbers of tokens of the pre-tokens `` `` + data[start:end], by one pass down their trie.

    A node keeps, for each distance up to the longest piece, the hash of the bytes below that ancestor
    and the ancestor's best score and number of tokens.
    """
    lengths = ends - starts + 1
    out = np.zeros(len(starts), np.int64)
    active, node = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    width = 1
    hashes = np.zeros((1, 1), np.uint64)
    score, count = np.zeros((1, 1)), np.zeros((1, 1), np.int64)  # of the ancestors at distance 1, 2, ...
    for depth in range(1, int(lengths.max(initial=0)) + 1):
        byte = np.full(len(active), 32, np.int64) if depth == 1 else data[starts[active] + depth - 2].astype(np.int64)
        keys, node = np.unique(node * 256 + byte, return_inverse=True)  # this level's nodes: parent and byte
        parent, step = keys >> 8, (keys & 255).astype(np.uint64)[:, None] + np.uint64(1)
        width = min(depth, pieces.longest)
        below = np.zeros((len(keys), width), np.uint64)
        below[:, 1:] = hashes[parent, : width - 1]
        below = below * _BASE + step
        s, c = score[parent, :width], count[parent, :width]
        best, tokens = np.full(len(keys), -np.inf), np.zeros(len(keys), np.int64)
        for k in range(width):
            total, n = s[:, k] + pieces.scores(below[:, k], k + 1), c[:, k] + 1
            better = (total > best) | (total == best) & (n < tokens)
            best[better], tokens[better] = total[better], n[better]
        done = lengths[active] == depth
        out[active[done]] = tokens[node[done]]
        active, node = active[~done], node[~done]
        hashes = below
        score, count = np.concatenate([best[:, None], s], axis=1), np.concatenate([tokens[:, None], c], axis=1)
    return out


def path_count(word: np.ndarray, pieces: Pieces) -> int:
    """Number of tokens of one long pre-token (bytes), by the same forward scores along its single path.

    The pieces that end at each byte are found by hash in stretches of PATH_BYTES; only those are tried, so the
    work is the number of pieces that occur, whatever the word's length.
    """
    best, tokens = [0.0], [0]  # of the prefixes that a piece can still start at
    base = 0  # the length of the first of them
    for lo in range(0, len(word), PATH_BYTES):
        hi = min(len(word), lo + PATH_BYTES)
        begin = max(0, lo - pieces.longest + 1)
        stretch = word[begin:hi].astype(np.uint64) + np.uint64(1)
        ends, lengths, scores = [], [], []
        hashes = np.zeros(len(stretch) + 1, np.uint64)
        for n in range(1, min(pieces.longest, len(stretch)) + 1):
            hashes = hashes[:-1] * _BASE + stretch[n - 1 :]  # of the n bytes from each place on
            if n not in pieces.tables:
                continue
            value = pieces.scores(hashes, n)
            at = np.flatnonzero(np.isfinite(value) & (np.arange(len(value)) + begin + n > lo))
            ends.append(at + begin + n)
            lengths.append(np.full(len(at), n))
            scores.append(value[at])
        ends, lengths, scores = (np.concatenate(x) for x in (ends, lengths, scores))
        order = np.lexsort((lengths, ends))
        ends, lengths, scores = ends[order].tolist(), lengths[order].tolist(), scores[order].tolist()
        k = 0
        for end in range(lo + 1, hi + 1):
            top, count = -np.inf, 0
            while k < len(ends) and ends[k] == end:
                back = end - lengths[k] - base
                total, n = best[back] + scores[k], tokens[back] + 1
                if total > top or total == top and n < count:
                    top, count = total, n
                k += 1
            best.append(top)
            tokens.append(count)
        cut = max(0, len(best) - pieces.longest - 1)
        best, tokens, base = best[cut:], tokens[cut:], base + cut
    return tokens[-1]


class _Counter:
    """Token counts of words by hash, remembered within a task up to a bound."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        values = np.zeros(len(keys), np.int64)
        values[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            size = ends[first[new]] - starts[first[new]]
            for i in new[size >= TRIE_BYTES]:
                word = data[starts[first[i]] : ends[first[i]]]
                values[i] = path_count(np.concatenate([np.array([32], word.dtype), word]), self.pieces)
            order = new[np.argsort(size, kind="stable")][: int((size < TRIE_BYTES).sum())]  # words of like length share a trie
            for lo in range(0, len(order), TRIE_WORDS):
                part = order[lo : lo + TRIE_WORDS]
                values[part] = trie_counts(data, starts[first[part]], ends[first[part]], self.pieces)
            if len(self.keys) + len(new) > MEMORY_WORDS:
                self.keys, self.values = self.keys[:0], self.values[:0]
            merged = np.concatenate([self.keys, keys[new]])
            order = np.argsort(merged)
            self.keys, self.values = merged[order], np.concatenate([self.values, values[new]])[order]
        return values[back]


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row: id, n_words, n_tokens.

    A null or empty text has no tokens. White space itself makes no token but for the space in front
    of each word. Repeated rows and null ids give rows like any other; an empty table gives none.
    Words are told apart by a 64-bit hash. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    sent = spark.sparkContext.broadcast(Pieces(piece_scores(read_vocabulary(vocabulary))))  # the vocabulary's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(sent.value)
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                data, offsets = text_bytes(part.column(1))
                starts, ends, hashes = word_spans(data, offsets, PLAIN)
                sums = np.concatenate([[0], np.cumsum(counter.counts(data, starts, ends, hashes))])
                at = np.searchsorted(starts, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(at)), pa.array(np.diff(sums[at]))], ["id", "n_words", "n_tokens"])

    out = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "id long, n_words long, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op3_token_count": op3_token_count}
ORACLE: dict = {}
