"""Repeated passages whose suffixes begin with words that very many texts share."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from lectern.llm import shingles, suffix_dedup


def vocabulary_of(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n)]


def test_partners_are_found_among_very_many_alike(spark):
    """Pairs share 12 own words and a run of 44 that all texts hold; their suffix starts deep in that run."""
    rng = random.Random(1)
    vocab = vocabulary_of(rng, 5000)
    while True:  # a run whose smallest gram lies deep inside, and is small
        common = [rng.choice(vocab) for _ in range(44)]
        g = suffix_dedup._gram_hashes(shingles.words(pa.array([" ".join(common)]))[0])
        if g.argmin() > 24 and g.min() < np.uint64(1 << 57):
            break
    rows, want = [], set()
    for i in range(150):
        own = [rng.choice(vocab) for _ in range(12)]
        for k in range(2):
            head, tail = ([rng.choice(vocab) for _ in range(15)] for _ in range(2))
            rows.append((2 * i + k, " ".join(head + own + common + tail)))
            want.add((2 * i + k, 15, 71))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r.doc_id, r.start_word, r.end_word) for r in suffix_dedup.repeated_passages(docs).collect()}
    assert got == want


def test_one_row_twice_is_no_repeat(spark):
    rng = random.Random(2)
    vocab = vocabulary_of(rng, 5000)
    common = [rng.choice(vocab) for _ in range(30)]
    rows = [(i, " ".join([*(rng.choice(vocab) for _ in range(40)), *common, *(rng.choice(vocab) for _ in range(40))])) for i in range(40)]
    assert suffix_dedup.repeated_passages(spark.createDataFrame([*rows, rows[0]], "doc_id long, text string")).count() == 0
