"""Centroid clustering in exact integers, with the bounds of grouped centroids.

Centroids are put into groups once. A vector keeps its cluster, an upper bound of the distance to its
centroid and one lower bound per group of the distance to all other centroids of that group. Before each
round bounds are loosened by how far centroids moved; a vector whose upper bound stays below all lower ones
keeps its cluster unseen, a group whose bound stays above the upper one is passed over, and the centroids
of what is left are compared exactly. Distances are compared as 64-bit integers and ties go to the smaller
number; bounds are widened by more than their rounding, so they prune only what can't win or tie.

One round is one pass: each task reads vectors with their bounds, writes both back with the new cluster and
adds its own sums per cluster at the end. Sums are merged by aggregates, so that the driver sees one row per
cluster. Each round's table is written to the shared folder; the one before it is deleted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import durable, release, settings, table

_WIDER = 1e-9
STATE = "id {}, vec binary, cluster int, upper double, lower array<double>, distance long, n long, total array<decimal(38,0)>, spread decimal(38,0)"


def largest(size: int) -> int:
    """Components are set to this at most (2^27 for 64 components), so that a squared distance fits in 64 bits."""
    return math.isqrt((1 << 62) // size) // 2


_WIDE = pa.decimal128(38, 0)
_NAMES = ["id", "vec", "cluster", "upper", "lower", "distance", "n", "total", "spread"]


def bounded(x: Column, scale: int, most: int) -> Column:
    """floor(scale * x); bounded before it becomes an integer, for the floor of a huge number would not fit."""
    return F.floor(F.greatest(F.least(x.cast("double") * F.lit(float(scale)), F.lit(float(most))), F.lit(float(-most)))).cast("int")


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has ``size`` components, none of them null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == size) & fine, F.lit(False))


def grouped(centroids: np.ndarray, groups: int) -> list[np.ndarray]:
    """Numbers of the centroids of each group: a few rounds of the same clustering over the centroids themselves, once."""
    k = len(centroids)
    groups = max(1, min(groups, k))
    c = centroids.astype(float)
    at = c[np.linspace(0, k - 1, groups).astype(int)]
    for _ in range(5):
        own = ((c[:, None] - at) ** 2).sum(2).argmin(1)
        at = np.stack([c[own == g].mean(0) if (own == g).any() else at[g] for g in range(groups)])
    return [np.flatnonzero(own == g) for g in range(groups) if (own == g).any()]


def squared(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, one column per centroid."""
    out = np.empty((len(vectors), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        d = vectors - c
        out[:, k] = np.einsum("ij,ij->i", d, d)
    return out


def nearest(vectors: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, groups: list[np.ndarray], moved: np.ndarray | None) -> int:
    """Move each vector to its nearest centroid, in place; bounds come loosened and leave tight. Returns the distances computed.

    ``moved``: how far each centroid moved since the bounds were made; None: there are none yet.
    """
    if moved is None:
        todo = np.arange(len(vectors))
        best = np.full(len(vectors), np.iinfo(np.int64).max)
        cluster[:] = len(centroids)
        passed = np.zeros((len(vectors), len(groups)), bool)
        computed = 0
    else:
        upper += moved[cluster] * (1 + _WIDER)
        for g, members in enumerate(groups):
            lower[:, g] -= moved[members].max() * (1 + _WIDER)
        todo = np.flatnonzero(lower.min(1) <= upper)  # the global filter
        if not len(todo):
            return 0
        d = vectors[todo] - centroids[cluster[todo]]
        best = np.einsum("ij,ij->i", d, d)
        upper[todo] = np.sqrt(best.astype(float)) * (1 + _WIDER)
        passed = lower[todo] > upper[todo, None]  # the group filter
        computed = len(todo)
    before = cluster[todo].copy()
    winner, shortest = before.copy(), best.copy()
    seen = {}
    for g, members in enumerate(groups):
        rows = np.flatnonzero(~passed[:, g])
        if not len(rows):
            continue
        dist = squared(vectors[todo[rows]], centroids[members])
        computed += dist.size
        seen[g] = rows, dist
        for j, k in enumerate(members):
            better = (dist[:, j] < shortest[rows]) | (dist[:, j] == shortest[rows]) & (k < winner[rows])
            winner[rows[better]], shortest[rows[better]] = k, dist[better, j]
    for g, (rows, dist) in seen.items():
        others = np.where(groups[g] == winner[rows, None], np.inf, np.sqrt(dist.astype(float)) * (1 - _WIDER))
        lower[todo[rows], g] = others.min(1)
    if moved is not None:  # the centroid left behind belongs to its group's bound now, where that group was passed over
        gone = np.flatnonzero(winner != before)
        if len(gone):
            group_of = np.empty(len(centroids), int)
            for g, members in enumerate(groups):
                group_of[members] = g
            g = group_of[before[gone]]
            lower[todo[gone], g] = np.minimum(lower[todo[gone], g], np.sqrt(best[gone].astype(float)) * (1 - _WIDER))
    cluster[todo] = winner
    upper[todo] = np.sqrt(shortest.astype(float)) * (1 + _WIDER)
    return computed


def _round(state: DataFrame, kind: str, centroids: np.ndarray, groups: list[np.ndarray], moved: np.ndarray | None, last: bool) -> DataFrame:
    """One pass over all vectors; rows without a vector hold a task's sums per cluster."""
    sent = state.sparkSession.sparkContext.broadcast((centroids, groups, moved))  # clusters times components

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, groups, moved = sent.value
        size = centroids.shape[1]
        n, total, spread = np.zeros(len(centroids), np.int64), [[0] * size for _ in centroids], [0] * len(centroids)
        types = None
        for batch in batches:
            rows = len(batch)
            types = batch.column(0).type
            if not rows:
                continue
            vectors = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<i4").reshape(rows, size).astype(np.int64)
            cluster = np.zeros(rows, np.int64)
            upper, lower = np.zeros(rows), np.zeros((rows, len(groups)))
            if moved is not None:
                cluster = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                upper = batch.column(3).to_numpy(zero_copy_only=False).copy()
                lower = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(rows, len(groups)).copy()
            nearest(vectors, cluster, upper, lower, centroids, groups, moved)
            distance = None
            if last:
                d = vectors - centroids[cluster]
                distance = np.einsum("ij,ij->i", d, d)
            for k in np.unique(cluster):
                own = cluster == k
                n[k] += own.sum()
                total[k] = [a + b for a, b in zip(total[k], vectors[own].sum(0).tolist(), strict=True)]
                if last:
                    spread[k] += sum(distance[own].tolist())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * len(groups), pa.int32()), pa.array(lower.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(upper), lists, pa.array(distance, pa.int64()) if last else pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.int64()), pa.nulls(rows, pa.list_(_WIDE)), pa.nulls(rows, _WIDE)],
                names=_NAMES,
            )
        at = np.flatnonzero(n).tolist()
        if at:
            r = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(r, types), pa.nulls(r, pa.binary()), pa.array(at, pa.int32()), pa.nulls(r, pa.float64()), pa.nulls(r, pa.list_(pa.float64())), pa.nulls(r, pa.int64()), pa.array(n[at], pa.int64()), pa.array([[Decimal(x) for x in total[k]] for k in at], pa.list_(_WIDE)), pa.array([Decimal(spread[k]) for k in at], _WIDE)],
                names=_NAMES,
            )

    with settings(state.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="10000"):
        return durable(state.mapInArrow(run, STATE.format(kind)), "vectors")


def _sums(state: DataFrame, size: int) -> dict[int, tuple[int, list[int], int]]:
    """By cluster: number, sums by component, sum of distances; one row per cluster reaches the driver."""
    parts = state.filter("n IS NOT NULL").groupBy("cluster")
    rows = parts.agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(size)]).alias("total"), F.sum("spread").alias("spread"))
    return {r["cluster"]: (int(r["n"]), [int(x) for x in r["total"]], int(r["spread"])) for r in rows.collect()}


def cluster_vectors(
    vectors: DataFrame, clusters: int = 8, rounds: int = 10, groups: int = 3, size: int = 64, seed: int = 3, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding"
) -> tuple[DataFrame, list[list[int]], dict[int, tuple[int, list[int], int]]]:
    """Vectors with cluster and squared distance, the final centroids, and by cluster its number, sums and inertia.

    Vectors of another size or with a component that is null or not finite are left out (a null vector too). First
    centroids are the vectors with the smallest SHA-256 of ``seed:id``; of one id, the vector with the smallest
    components goes first, and a null id counts as the empty string. Fewer vectors than clusters make as many
    clusters; an empty table makes none. Repeated rows count each time, ties go to the smaller number, an empty
    cluster keeps its centroid. Components beyond ``largest(size)`` after scaling are set to it. Other columns are ignored.
    """
    given = vectors.filter(usable(vectors[vec_col], size)).select(vectors[id_col].alias("id"), vectors[vec_col].alias("v"))
    kind = dict(given.dtypes)["id"]
    most = largest(size)
    as_ints = given.withColumn("v", F.transform("v", lambda x: bounded(x, scale, most)))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = as_ints.withColumn("key", key).orderBy("key", "v").limit(clusters).select("key", "v").collect()
    centroids = np.array([r["v"] for r in sorted(first, key=lambda r: (r["key"], r["v"]))], np.int64).reshape(len(first), size)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(len(batch), size)
            rows = len(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v.tobytes() for v in flat], pa.binary()), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.float64()), pa.nulls(rows, pa.list_(pa.float64())), *[pa.nulls(rows, pa.int64())] * 2, pa.nulls(rows, pa.list_(_WIDE)), pa.nulls(rows, _WIDE)],
                names=_NAMES,
            )

    state = as_ints.mapInArrow(packed, STATE.format(kind))
    if not len(centroids):
        return state.select("id", "cluster", "distance").withColumnRenamed("id", id_col), [], {}
    members = grouped(centroids, groups)
    moved, written, left = None, None, rounds
    while True:
        now = _round(state, kind, centroids, members, moved, left == 0)
        if written is not None:
            release(written)
        written, state = now, now.filter("vec IS NOT NULL")
        sums = _sums(now, size)
        if left == 0:
            break
        after = np.array([[t // sums[k][0] for t in sums[k][1]] if k in sums else centroids[k].tolist() for k in range(len(centroids))], np.int64)
        moved = np.sqrt(((after - centroids).astype(float) ** 2).sum(1))
        left = left - 1 if (after != centroids).any() else 0  # where nothing moves the rounds left change nothing
        centroids = after
    return state.select("id", "cluster", "distance").withColumnRenamed("id", id_col), centroids.tolist(), sums


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids, sums = cluster_vectors(table(spark, sf_dir, "embeddings"))
    inertia = sum(s for _, _, s in sums.values())
    names = [F.struct(F.lit(sums[k][2] if k in sums else 0).cast("long").alias("cluster_inertia"), F.sha2(F.lit(",".join(map(str, c))), 256).alias("centroid_sha256")) for k, c in enumerate(centroids)]
    own = F.array(*names)[F.col("cluster")] if names else F.lit(None).cast("struct<cluster_inertia: bigint, centroid_sha256: string>")
    out = found.withColumn("own", own)
    return out.select("vec_id", "cluster", "distance", "own.cluster_inertia", F.lit(inertia).cast("long").alias("inertia"), "own.centroid_sha256")


def _sql(clusters: int = 8, rounds: int = 10) -> str:
    size, chain = 64, []
    prev = "c0"
    for r in range(1, rounds + 2):
        chain.append(f"""d{r} AS MATERIALIZED (
  SELECT v.rn, c.k, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN {prev} c ON c.i = v.i GROUP BY ALL
), a{r} AS MATERIALIZED (
  SELECT rn, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{r} GROUP BY rn
)""")
        if r <= rounds:
            chain.append(f"""m{r} AS MATERIALIZED (
  SELECT a.k, v.i, sum(v.x) AS s, count(*) AS n FROM a{r} a JOIN v ON v.rn = a.rn GROUP BY ALL
), c{r} AS MATERIALIZED (
  SELECT c.k, c.i, CASE WHEN n IS NULL THEN c.x ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS x
  FROM {prev} c LEFT JOIN m{r} m ON m.k = c.k AND m.i = c.i
)""")
            prev = f"c{r}"
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS e
  FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), v AS MATERIALIZED (
  SELECT rn, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM kept
), firsts AS (
  SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), e) - 1 AS k, e FROM kept
), c0 AS MATERIALIZED (
  SELECT k, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM firsts WHERE k < {clusters}
), {", ".join(chain)},
names AS (
  SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM {prev} GROUP BY k
), sums AS (
  SELECT k, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{rounds + 1} GROUP BY k
)
SELECT kept.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, cluster_inertia,
       (SELECT CAST(sum(d) AS BIGINT) FROM a{rounds + 1}) AS inertia, centroid_sha256
FROM a{rounds + 1} a JOIN kept ON kept.rn = a.rn JOIN names ON names.k = a.k JOIN sums ON sums.k = a.k
"""


QUERIES = {"op13_centroids": op13_centroids}
ORACLE = {"op13_centroids": _sql()}
