"""Shared runs against trying every pair of places, and traces on stated options."""

from __future__ import annotations

import random
import time

from pyspark.sql import functions as F

from lectern.functions import runs


def brute(a, b):
    best = (0, -1, -1)
    for i in range(len(a)):
        for j in range(i + 1, len(a) + 1):
            if j - i > best[0] and a[i:j] in b:
                best = (j - i, i, b.find(a[i:j]))
    return best


def test_longest_run():
    rng = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abé😀"[: rng.randrange(2, 5)]) for _ in range(rng.randrange(0, 14))) for _ in range(2))
        assert runs.longest_run(a, b) == brute(a, b), (a, b)
    began = time.time()
    assert runs.longest_run("a" * 3000 + "b", "a" * 20_000)[0] == 3000
    assert time.time() - began < 20


def test_traces(spark):
    rows = [("A. 摩擦系数为零。", "若摩擦系数为零，则"), ("the whole thing", "whole"), ("friction", "fraction of it"), ("abc", "xyz"), ("为零", "零为"), ("系数大", "摩擦系数"), ("", "x"), (None, None), ("0.5", "5")]
    df = spark.createDataFrame(rows, "o string, s string")
    df = df.select(runs.trace_key(F.col("o")).alias("o"), runs.trace_key(F.col("s")).alias("s"))
    got = df.select(F.col("o"), F.col("s"), runs.common_run("o", "s").alias("r")).select(runs.trace(F.col("o"), F.col("s"), F.col("r")).alias("t"), "r.length")
    assert [(r.t, r.length) for r in got.collect()] == [("within", 6), ("contains", 5), ("run", 5), (None, 0), (None, 1), ("run", 2), (None, 0), (None, 0), ("contains", 1)]
