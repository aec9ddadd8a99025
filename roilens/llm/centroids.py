"""Centroid clustering with equal-average equal-variance search, in exact integers.

A vector of ``dims`` components becomes integers ``floor(scale * x)``. The first
centroids are the ``clusters`` vectors whose ids hash smallest. Each round
assigns every vector to its nearest centroid (squared Euclidean distance, ties
to the smaller number) and replaces each centroid that has vectors by their
componentwise floor of the mean.

Search. With ``S`` the sum of the components and ``V`` the norm of the deviations
from their mean, two vectors are at least ``(Sx - Sc)^2 / dims + (Vx - Vc)^2``
apart, and so at least the first term alone. Centroids are sorted by ``S``; a
vector starts at the centroid nearest to its own mean and scans outward on both
sides. A side ends at the first centroid whose mean alone is too far, a single
centroid is passed over if mean and deviation together are; only for the others
is the distance summed. Bounds are in floating point with a margin, so they
never reject a centroid that could win or tie; distances are exact integers.

One round is one pass over the table: tasks search their vectors and give one
row of sums for each cluster, which Spark adds up. The driver holds only the
centroids (``clusters`` by ``dims`` numbers).

Defined results: a null vector, one of another length, or one with a null, NaN
or infinite component takes no part and gets no row; a null id hashes as the
empty text; repeated rows each take part, and if they tie for a first centroid
each counts (equal ids are ordered by their components); with fewer vectors than
``clusters`` there are so many centroids; a cluster that loses all its vectors
keeps its centroid; an empty table gives an empty result; columns other than id
and vector are not read. Components are integers of any size (Python integers
beyond ``small``); a distance that no long holds is null and not part of the
inertias, an inertia that no long holds is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

CLUSTERS, ROUNDS, DIMS, SCALE, SEED = 16, 3, 64, 64, "1"
MARGIN = 1e-9
ROWS_AT_ONCE = 8192


def usable(vector: Column, dims: int) -> Column:
    """Exactly ``dims`` components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def small(dims: int) -> int:
    """Components below this in size are summed as 64-bit integers: every square of a sum fits."""
    return (1 << 30) // dims


def quantise(vectors: pd.Series, scale: int) -> np.ndarray:
    """floor(scale * x) of a batch of vectors: 64-bit integers, or Python's where one is large."""
    x = np.floor(scale * np.stack([np.asarray(v, np.float64) for v in vectors]))
    if np.abs(x).max(initial=0) < small(x.shape[1]):
        return x.astype(np.int64)
    return np.array([[int(c) for c in row] for row in x], object)


def _features(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and deviation norm."""
    s = x.sum(axis=1)
    spread = (x * x).sum(axis=1) * x.shape[1] - s * s  # dims times the squared deviation, exact
    return s, np.sqrt(spread.astype(np.float64) / x.shape[1])


def search(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of every row of x the number of the nearest centroid and its squared distance; and how many distances were summed."""
    if centroids.dtype == object or x.dtype == object:
        x, centroids = x.astype(object), centroids.astype(object)
    k, dims = centroids.shape
    number = np.argsort(centroids.sum(axis=1), kind="stable")
    c = centroids[number]
    (sx, vx), (sc, vc) = _features(x), _features(c)
    rows = np.arange(len(x))
    best, cluster, summed = np.zeros(len(x), x.dtype), np.full(len(x), k), 0

    def measure(at: np.ndarray, r: np.ndarray) -> None:
        nonlocal summed
        d = x[r] - c[at]
        d = (d * d).sum(axis=1)
        summed += len(r)
        first = cluster[r] == k
        better = first | (d < best[r]) | ((d == best[r]) & (number[at] < cluster[r]))
        best[r[better]], cluster[r[better]] = d[better], number[at[better]]

    start = np.searchsorted(sc, sx)
    left = np.clip(start - 1, 0, k - 1)
    start = np.clip(start, 0, k - 1)
    start = np.where(np.abs(sc[left] - sx) <= np.abs(sc[start] - sx), left, start)
    measure(start, rows)
    low, high = start - 1, start + 1
    for _ in range(k - 1):
        for side, step in ((low, -1), (high, 1)):
            r = rows[(side >= 0) & (side < k)]
            if not len(r):
                continue
            at = side[r]
            limit = best[r].astype(np.float64) * (1 + MARGIN) + MARGIN
            mean = (sx[r] - sc[at]).astype(np.float64) ** 2 / dims
            far = mean > limit
            side[r[far]] = -1 if step < 0 else k  # all further ones are further in the mean
            near = ~far & (mean + np.maximum(np.abs(vx[r] - vc[at]) - MARGIN * (vx[r] + vc[at]), 0) ** 2 <= limit)
            measure(at[near], r[near])
            side[r[~far]] += step
    return cluster, best, summed


def _batches(vectors: Iterable[pd.Series]) -> Iterator[pd.Series]:
    for batch in vectors:
        for at in range(0, len(batch), ROWS_AT_ONCE):
            yield batch.iloc[at:at + ROWS_AT_ONCE]


def first_centroids(vectors: DataFrame, clusters: int, scale: int, seed: str) -> np.ndarray:
    """The vectors whose sha256 of ``seed:id`` is smallest, in the order of the hash."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    top = vectors.withColumn("h", F.sha2(named, 256)).orderBy("h", "vector").limit(clusters).toPandas()
    return quantise(top["vector"], scale) if len(top) else np.zeros((0, 0), np.int64)


def update(vectors: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """The next centroids: exact floors of the means of the assigned vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(centroids)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = shared.value
        total, count = np.zeros(now.shape, object), np.zeros(len(now), np.int64)
        for part in _batches(b["vector"] for b in batches):
            x = quantise(part, scale)
            cluster, _, _ = search(x, now)
            for g in np.unique(cluster):
                total[g] += x[cluster == g].sum(axis=0).astype(object)
                count[g] += (cluster == g).sum()
        used = np.flatnonzero(count)
        yield pd.DataFrame({"cluster": np.repeat(used, now.shape[1]), "dim": np.tile(np.arange(now.shape[1]), len(used)),
                            "rows": np.repeat(count[used], now.shape[1]), "total": np.array([str(t) for g in used for t in total[g]], object)})

    kind = "cluster int, dim int, rows long, total string"
    found = vectors.select("vector").mapInPandas(sums, kind).groupBy("cluster", "dim").agg(
        F.sum("rows").alias("rows"), F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")).toPandas()
    new = centroids.astype(object)
    for r in found.itertuples():  # clusters x dims rows
        new[r.cluster, r.dim] = int(r.total) // r.rows
    return new.astype(np.int64) if np.abs(new).max(initial=0) < small(new.shape[1]) else new


def cluster(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = CLUSTERS,
            rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    vectors = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    vectors = vectors.where(usable(F.col("vector"), dims))
    now = first_centroids(vectors, clusters, scale, seed)
    for _ in range(rounds if len(now) else 0):
        now = update(vectors, now, scale)
    shared = vectors.sparkSession.sparkContext.broadcast(now)

    @F.pandas_udf("cluster int, distance long")
    def assign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [search(quantise(part, scale), shared.value)[:2] for part in _batches([batch])]
            yield pd.DataFrame({"cluster": np.concatenate([f[0] for f in found] or [np.zeros(0, np.int64)]),
                                "distance": [int(d) if d < 1 << 63 else None for f in found for d in f[1]]}, dtype=object)

    assigned = stored(vectors.select("id", assign("vector").alias("a")).select("id", "a.*"), "centroids")
    names = vectors.sparkSession.createDataFrame(
        [(g, hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest()) for g, c in enumerate(now)],
        "cluster int, centroid_sha256 string")
    total = F.sum(F.col("distance").cast("decimal(20,0)")).try_cast("long")
    of_cluster = assigned.groupBy("cluster").agg(total.alias("cluster_inertia"))
    of_all = assigned.agg(total).scalar()
    few = F.broadcast(names.join(of_cluster, "cluster"))  # ``clusters`` rows at most
    return assigned.join(few, "cluster").select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia",
                                                of_all.alias("inertia"), "centroid_sha256")
