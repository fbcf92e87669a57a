"""Word and shingle hashes of Arrow text columns, computed over whole byte buffers with numpy.

Words are runs of bytes outside the contract's white space; A-Z is lower-cased. UTF-8 keeps those
bytes out of longer characters, so bytes are enough. A word's hash is a polynomial in a fixed odd
base, taken from prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once; a longer text is cut at white space, a longer word is taken whole.
PIECE = 1 << 20
WIDTH = 5

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
PLAIN = np.arange(1, 257, dtype=np.uint64)
FOLDED = PLAIN.copy()
FOLDED[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_KEYS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_tables: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(max(n, PIECE) + 1, base, np.uint64)
            out[0] = 1
            _tables[name] = np.cumprod(out, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def _hash_piece(data: np.ndarray, breaks: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words in ``data``; ``breaks`` are offsets where a new text begins."""
    inside = ~_SEPARATOR[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[breaks] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    real = inside[starts]
    starts, ends = starts[real], ends[real]
    up, down = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return starts, ends, mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; a null is empty."""
    if column.null_count:
        column = column.fill_null("")
    large = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, values: np.ndarray = FOLDED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of all words; bytes count as ``values`` says, so FOLDED ignores the case of A-Z."""
    found, lo = [], 0
    while lo < len(data):
        hi = min(len(data), lo + PIECE)
        if hi < len(data):  # cut behind white space or where a text ends
            cut = np.flatnonzero(_SEPARATOR[data[lo:hi]])
            text = offsets[(offsets > lo) & (offsets <= hi)]
            if len(cut) or len(text):
                hi = int(max(lo + cut[-1] + 1 if len(cut) else 0, text[-1] if len(text) else 0))
            else:
                more = np.flatnonzero(_SEPARATOR[data[hi:]])
                later = offsets[offsets > hi]
                hi = int(min(hi + more[0] if len(more) else len(data), later[0] if len(later) else len(data)))
        starts, ends, hashes = _hash_piece(data[lo:hi], offsets[(offsets > lo) & (offsets < hi)] - lo, values)
        found.append((starts + lo, ends + lo, hashes))
        lo = hi
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts in turn, and the offsets of each text's words among them."""
    data, offsets = text_bytes(column)
    starts, _, hashes = word_spans(data, offsets)
    return hashes, np.searchsorted(starts, offsets)


def sequence_hash(w: np.ndarray) -> np.ndarray:
    """The one hash of a text of fewer than WIDTH words."""
    return mix((w * _KEYS[: len(w)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(w)))


def shingle_hashes(w: np.ndarray) -> np.ndarray:
    """Hashes of all WIDTH-word windows of a sequence of word hashes, in order."""
    n = len(w) - WIDTH + 1
    out = w[:n] * _KEYS[0]
    for i in range(1, WIDTH):
        out += w[i : i + n] * _KEYS[i]
    return mix(out)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes: empty without words, one when it is short."""
    w, at = words(column)
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= WIDTH:
            s = np.sort(shingle_hashes(w[lo:hi]))
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            yield s[keep]
        elif hi > lo:
            yield sequence_hash(w[lo:hi])
        else:
            yield w[:0]


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of a set; equal sets have equal names."""
    return int((mix(s + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) + np.uint64(len(s))).astype(np.int64))
