"""Centroid clustering against plain exact k-means, and its bounds against full scans."""

from __future__ import annotations

import hashlib
import math
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import centroids as cen

SCHEMA = "vec_id long, embedding array<float>, label int, vec string, cluster string, n int"


def brute(rows, clusters=8, rounds=10, size=64, seed=3):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:clusters]
    c = [v for _, v in first]

    def assign():
        out = []
        for _, v in kept:
            out.append(min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), k) for k, m in enumerate(c)))
        return out

    for _ in range(rounds):
        got = assign()
        for k in range(len(c)):
            own = [v for (_, v), (_, g) in zip(kept, got, strict=True) if g == k]
            if own:
                c[k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    got = assign()
    per = [sum(d for d, g in got if g == k) for k in range(len(c))]
    name = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return sorted(((i, k, d, per[k], sum(per), name[k]) for (i, _), (d, k) in zip(kept, got, strict=True)), key=str)


def vectors(rng, n, size=64, spread=0.3):
    middle = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(12)]
    return [(i, [m + rng.gauss(0, spread) for m in rng.choice(middle)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", "y", 3) for i, v in rows], SCHEMA).repartition(4)


def run(spark, tmp_path, rows):
    path = str(tmp_path / f"{random.random()}")
    frame(spark, rows).write.parquet(f"{path}/embeddings.parquet")
    got = cen.op13_centroids(spark, path)
    assert got.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint", "int", "bigint", "bigint", "bigint", "string"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_against_plain_kmeans(spark, tmp_path):
    rng = random.Random(4)
    rows = vectors(rng, 150)
    odd = [(900, None), (901, []), (902, [0.5] * 63), (903, [0.5] * 65), (904, [0.5] * 63 + [None]), (905, [0.5] * 63 + [math.nan]), (906, [0.5] * 63 + [math.inf]), (907, [-math.inf] + [0.5] * 63)]
    rows += odd + [(5, rows[5][1]), (5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, rows[8][1]), (908, [0.0] * 64), (909, [-0.0001] * 64)]
    assert run(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 3, 8])
def test_few_vectors(spark, tmp_path, n):
    rows = vectors(random.Random(n), n)
    assert run(spark, tmp_path, rows) == brute(rows)


def test_equal_vectors_and_ties(spark, tmp_path):
    rows = [(i, [0.5] * 64) for i in range(20)]  # all centroids are equal: the smallest number takes all
    got = run(spark, tmp_path, rows)
    assert got == brute(rows) and {g[1] for g in got} == {0}
    rng = random.Random(8)
    rows = [(i, [rng.choice([-1.0, 1.0]) if j < 3 else 0.0 for j in range(64)]) for i in range(60)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_huge_components(spark):
    rows = [(i, [3e38 * (-1) ** i] * 64) for i in range(4)] + [(9, [0.0] * 64)]
    found, centres, sums = cen.cluster_vectors(frame(spark, rows), clusters=2)
    assert found.count() == 5 and sum(n for n, _, _ in sums.values()) == 5
    assert all(abs(x) <= cen.largest(64) for c in centres for x in c) and found.filter("distance < 0").count() == 0


@pytest.mark.parametrize("groups", [1, 2, 5, 20])
def test_bounds_hold_and_prune(groups):
    rng = np.random.default_rng(groups)
    middle = rng.integers(-900, 900, (20, 16))
    v = (middle[rng.integers(0, 20, 3000)] + rng.integers(-150, 150, (3000, 16))).astype(np.int64)
    c = v[:20].copy()
    members = cen.grouped(c, groups)
    assert sorted(np.concatenate(members).tolist()) == list(range(20))
    cluster, upper, lower = np.zeros(3000, np.int64), np.zeros(3000), np.zeros((3000, len(members)))
    moved, computed = None, []
    for _ in range(12):
        computed.append(cen.nearest(v, cluster, upper, lower, c, members, moved))
        full = cen.squared(v, c)
        assert (cluster == full.argmin(1)).all()  # argmin takes the smaller number of equals
        assert (upper >= np.sqrt(full[np.arange(3000), cluster])).all()
        for g, m in enumerate(members):
            other = np.where(m == cluster[:, None], np.inf, np.sqrt(full[:, m].astype(float)))
            assert (lower[:, g] <= other.min(1)).all()
        after = np.stack([v[cluster == k].sum(0) // max(1, (cluster == k).sum()) if (cluster == k).any() else c[k] for k in range(20)])
        moved = np.sqrt(((after - c) ** 2).sum(1))
        c = after
    assert computed[0] == 60_000 and computed[-1] < 12_000  # most vectors are never looked at again


def test_sql(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in cen.op13_centroids(spark, sf).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(con.execute(cen.ORACLE["op13_centroids"]).fetchall()) == got
    rows = vectors(random.Random(2), 40) + [(3, None), (7, [1.0] * 5), (None, [0.25] * 64), (8, [math.nan] * 64), (9, [None] * 64)]
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))}))
    assert sorted(con.execute(cen.ORACLE["op13_centroids"]).fetchall(), key=str) == run(spark, tmp_path, rows)
