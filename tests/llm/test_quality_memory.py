"""What a task of the language model holds follows neither the length of its partition nor that of a batch."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from lectern.llm import quality_lm


def texts(n: int, words: int) -> list[str]:
    rng = np.random.default_rng(7)
    return [" ".join(f"w{k}" for k in rng.integers(0, 3000, words)) for _ in range(n)]


def batch(rows: list[str], langs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.string())], ["lang", "text"])


def peak(run) -> float:
    """MB that a task holds at most while its rows are taken one batch at a time."""
    tracemalloc.start()
    for _ in run:
        pass
    most = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return most


def test_pairs_are_summed_in_bounded_memory():
    rows = texts(2000, 600)
    assert peak(quality_lm._bigrams(0)(iter([batch(rows, ["en"] * len(rows))]))) < 40


def test_keys_are_looked_up_in_bounded_memory():
    rows = texts(1000, 1200)
    none = quality_lm._Head(pa.table({"k": pa.array([1], pa.int64()), "v": pa.array([0.0]), "u": pa.array([0], pa.int32())}))
    given = pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(["en"] * len(rows)), pa.array(rows)], ["row", "model", "text"])
    assert peak(quality_lm._tails(type("Sent", (), {"value": none}))(iter([given]))) < 55


def test_pairs_of_several_batches_have_the_sums_of_all(monkeypatch):
    monkeypatch.setattr(quality_lm, "SUMMED", 500)
    monkeypatch.setattr(quality_lm, "ROWS", 64)
    rows, langs = texts(300, 20), [("en", "fr", "de", "*")[i % 4] for i in range(300)]
    rows[5], rows[17], rows[40] = "", None, " \t\n"
    cuts = [0, 1, 130, 131, 300]
    found, batches = Counter(), 0
    for part in range(quality_lm.SLICES):
        for b in quality_lm._bigrams(part)(batch(rows[lo:hi], langs[lo:hi]) for lo, hi in zip(cuts, cuts[1:], strict=False)):
            assert len(b) <= 64
            batches += 1
            for lang, x, y, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found[lang, x, y] += n
    assert batches > quality_lm.SLICES
    wanted = Counter()
    for text, lang in zip(rows, langs, strict=True):
        for _, x, _, _ in quality_lm._sequences(pa.array([text], pa.string()), [lang], 1):
            wanted.update((lang, int(a), int(b)) for a, b in zip(x[:-1], x[1:], strict=True))
    assert found == wanted
