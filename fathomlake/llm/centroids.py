"""Clusters of embeddings around centroids, in whole numbers, with Elkan's bounds.

Every vector carries its cluster, an upper bound of the distance to its centroid and a lower bound of the distance to
each of the k centroids, in a table that is written anew each round. When centroids move, the bounds move by as much.
A centroid is passed over if its lower bound, or half its distance from the vector's own centroid, is more than the
upper bound. Upper bounds are rounded up, lower bounds and half distances down, and only what is strictly more is passed
over, so a tie is always computed; what is computed is the exact squared distance in whole numbers.

Vectors never move: rounds are scans. What comes together are k sums a task, added by Spark, and k centroids on the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Components are held within this, so that squared distances fit 64 bits; it is reached by numbers beyond two million only.
MOST = 2**27
STATE = "v array<long>, cluster int, upper float, lower array<float>"


def whole_vectors(embeddings: DataFrame, size: int = 64) -> DataFrame:
    """(vec_id, v): rows with exactly `size` components, none null or non-finite, each as floor(64 * x) within +-2^27."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(e, lambda x: F.floor(F.least(F.greatest(x.cast("double") * 64, F.lit(float(-MOST))), F.lit(float(MOST)))).cast("long"))
    return embeddings.where(e.isNotNull() & (F.size(e) == size) & finite).select("vec_id", whole.alias("v"))


def seeds(vectors: DataFrame, k: int) -> np.ndarray:
    """The k vectors with the smallest SHA-256 of `1:<vec_id>`, in that order; repeated ids by their components, a null id as an empty one."""
    key = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    return np.array([r.v for r in vectors.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()], dtype=np.int64)


def _up(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats that are no smaller."""
    x = np.nextafter(x, np.inf)
    f = x.astype(np.float32)
    return np.where(f < x, np.nextafter(f, np.float32(np.inf)), f)


def _down(x: np.ndarray) -> np.ndarray:
    """As 32-bit floats that are no larger, and not below zero."""
    x = np.nextafter(x, -np.inf)
    f = x.astype(np.float32)
    return np.maximum(np.where(f > x, np.nextafter(f, np.float32(-np.inf)), f), np.float32(0))


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return np.einsum("...i,...i->...", d, d)


class Bounds(NamedTuple):
    cluster: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def moved(b: Bounds, before: np.ndarray, after: np.ndarray) -> Bounds:
    """Bounds that hold for centroids that have moved."""
    shift = np.nextafter(np.sqrt(_squared(before, after).astype(np.float64)), np.inf)
    return Bounds(b.cluster, _up(b.upper.astype(np.float64) + shift[b.cluster]), _down(b.lower.astype(np.float64) - shift))


def assigned(v: np.ndarray, centroids: np.ndarray, b: Bounds | None) -> tuple[Bounds, int]:
    """(bounds with the nearest centroid of every vector, ties to the smaller number; distances computed)."""
    n, k = len(v), len(centroids)
    if b is None:
        d2 = np.stack([_squared(v, c) for c in centroids], axis=1)
        cluster = d2.argmin(axis=1).astype(np.int32)
        root = np.sqrt(d2.astype(np.float64))
        return Bounds(cluster, _up(root[np.arange(n), cluster]), _down(root)), n * k
    half = _down(0.5 * np.sqrt(_squared(centroids[:, None], centroids[None]).astype(np.float64)))
    np.fill_diagonal(half, np.inf)
    cluster, upper, lower = b.cluster.copy(), b.upper.copy(), b.lower.copy()
    rows = np.flatnonzero(~(half.min(axis=1)[cluster] > upper))
    own, computed = v[rows], len(rows)
    best = _squared(own, centroids[cluster[rows]])
    root = np.sqrt(best.astype(np.float64))
    now, u, low = cluster[rows], _up(root), lower[rows]
    low[np.arange(len(rows)), now] = _down(root)
    for j in range(k):
        at = np.flatnonzero((now != j) & ~(low[:, j] > u) & ~(half[now, j] > u))
        if len(at):
            computed += len(at)
            d2 = _squared(own[at], centroids[j])
            root = np.sqrt(d2.astype(np.float64))
            low[at, j] = _down(root)
            nearer = (d2 < best[at]) | (d2 == best[at]) & (j < now[at])
            to = at[nearer]
            best[to], now[to], u[to] = d2[nearer], j, _up(root[nearer])
    cluster[rows], upper[rows], lower[rows] = now, u, low
    return Bounds(cluster, upper, lower), computed


def _matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _lists(m: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = m.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(m.ravel(), kind))


def _round(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None, last: bool) -> DataFrame:
    """One assignment of all vectors; `before` is where the centroids stood when the bounds were made, if there are any."""
    width = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), width, np.int64)
            b = None
            if before is not None:
                held = Bounds(batch.column("cluster").to_numpy().astype(np.int32), batch.column("upper").to_numpy(), _matrix(batch.column("lower"), len(centroids), np.float32))
                b = moved(held, before, centroids)
            b, _ = assigned(v, centroids, b)
            if last:
                out = [pa.array(b.cluster, pa.int32()), pa.array(_squared(v, centroids[b.cluster]), pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *out], names=["vec_id", "cluster", "distance"])
            else:
                out = [batch.column("v"), pa.array(b.cluster, pa.int32()), pa.array(b.upper, pa.float32()), _lists(b.lower, pa.float32())]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *out], names=["vec_id", "v", "cluster", "upper", "lower"])

    kind = state.schema["vec_id"].dataType.simpleString()
    return state.mapInArrow(run, f"vec_id {kind}, " + ("cluster int, distance long" if last else STATE))


def _means(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Componentwise floor of exact means; a centroid without vectors stays. Each task gives k rows of sums."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            v, cluster = _matrix(batch.column("v"), width, np.int64), batch.column("cluster").to_numpy()
            n += np.bincount(cluster, minlength=k)
            for j in np.unique(cluster):
                sums[j] += v[cluster == j].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(n), _lists(sums, pa.int64())], names=["cluster", "n", "sums"])

    def total(c: Column) -> Column:
        return F.sum(c.cast("decimal(20,0)"))

    parts = state.select("v", "cluster").mapInArrow(run, "cluster int, n long, sums array<long>")
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[total(F.col("sums")[i]) for i in range(width)]).alias("sums")).collect()
    out = centroids.copy()
    for r in rows:
        if r.n:
            out[r.cluster] = [int(s) // r.n for s in r.sums]
    return out


def cluster(embeddings: DataFrame, k: int = 16, rounds: int = 3, size: int = 64) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every kept row of embeddings (vec_id, embedding).

    Rows with a null, a short, a long or a non-finite vector are not kept; repeated rows and ids are kept each, a null
    id stays null, more columns are left out. With fewer than k vectors there are as many centroids; without any the
    result is empty. A component beyond two million in size counts as two million (2^27 / 64).
    """
    spark = embeddings.sparkSession
    vectors = whole_vectors(embeddings, size)
    kind = embeddings.schema["vec_id"].dataType.simpleString()
    centroids, before, state = seeds(vectors, k), None, vectors
    if not len(centroids):
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        state = saved(_round(state, centroids, before, last=False), "clusters")
        before, centroids = centroids, _means(state, centroids)
    placed = saved(_round(state, centroids, before, last=True), "clustered")
    sums = {r.cluster: int(r.d) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    rows = [(j, sums.get(j, 0), sum(sums.values()), hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for j, c in enumerate(centroids)]
    return placed.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def oracle_sql(k: int = 16, rounds: int = 3, size: int = 64) -> str:
    """DuckDB SQL: every round computes all distances."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS (
  SELECT r, vec_id, v, min(d * {k} + cluster) AS best
  FROM (SELECT r, vec_id, v, cluster, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{i})
  GROUP BY r, vec_id, v
)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS (
  SELECT c.cluster, coalesce(m.mean, c.c) AS c
  FROM c{i} c LEFT JOIN (
    SELECT cluster, list(x ORDER BY i) AS mean
    FROM (SELECT best % {k} AS cluster, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS x FROM a{i}, range(1, {size + 1}) t(i) GROUP BY 1, 2) GROUP BY cluster
  ) m USING (cluster)
)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}
), c0 AS (
  SELECT cluster, c FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS cluster, v AS c FROM kept) WHERE cluster < {k}
), {", ".join(steps)}, placed AS (
  SELECT vec_id, (best % {k})::INT AS cluster, best // {k} AS distance FROM a{rounds}
)
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia, sum(distance) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM placed JOIN c{rounds} USING (cluster)
"""
