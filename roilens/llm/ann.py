"""Nearest neighbours by shifted space-filling curves.

Vectors are scaled to length one and projected to a few dimensions, once for
each of ``CURVES`` random projections; a projected point, moved by the curve's
own shift, gets a place on a Hilbert curve over a fine grid. For each curve the
rows are range-partitioned by that key into blocks of nearly equal size (the cut
points are approximate quantiles; a hash of the vector breaks ties, so many
equal keys spread over several blocks). A query looks through the window of
blocks around its own key on every curve; windows hold a fixed share ``WINDOW``
of the rows, moved inwards at the curve's ends, so recall does not depend on the
number of rows. Each block returns its best candidates by the exact cosine in
double precision; the windows' candidates merge and the best ``k`` stay.

Equal vectors are searched once: a class is named by its smallest id and holds
its ``k + 1`` smallest ids, more of which no answer can need.

The share is as large as it is because vectors without cluster structure have
neighbours hardly nearer in any projection than other rows: recall then is about
``1 - (1 - WINDOW) ** CURVES``. Clustered vectors reach the same recall with a
far smaller share; both are parameters. A block is planned to hold ``4 * (k + 1)``
rows at least, so a table with fewer than twice as many is searched whole.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components, or whose length is not the commonest one (ties: the longer), take no
part, nor do rows without an id; a row that is repeated whole counts once; equal
scores go to the smaller id; a query without candidates has no rows; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

CURVES, DIMS, BITS, WINDOW = 4, 4, 5, 0.4
BLOCK_ROWS, LEAST_BLOCKS, QUERY_ROWS, SEED = 8192, 16, 16384, 3
TIE_BITS = 62 - DIMS * BITS


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of integer coordinates below ``2 ** bits``.

    Walks the cube from its largest halving to its smallest: the coordinates' bits at a level,
    seen in the frame of the current sub-cube, are a Gray code of the sub-cube's rank; the frame
    (an entry corner and a direction) then turns into that of the sub-cube."""
    rows, dims = cells.shape
    entry, turn = np.zeros(rows, dtype=np.int64), np.zeros(rows, dtype=np.int64)
    key, low = np.zeros(rows, dtype=np.int64), (1 << dims) - 1

    def rotate(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        return ((x >> by) | (x << (dims - by))) & low

    for level in range(bits - 1, -1, -1):
        corner = np.zeros(rows, dtype=np.int64)
        for d in range(dims):
            corner |= ((cells[:, d].astype(np.int64) >> level) & 1) << d
        gray = rotate(corner ^ entry, (turn + 1) % dims)
        rank = gray.copy()
        for s in (1, 2, 4, 8, 16, 32):
            if s < dims:
                rank ^= rank >> s
        key = (key << dims) | rank
        even = np.maximum((rank - 1) // 2 * 2, 0)  # entry corner of a sub-cube: Gray code of the even number before it
        corner_in = np.where(rank == 0, 0, even ^ (even >> 1))
        flips = np.where(rank % 2 == 0, rank - 1, rank)  # its direction: how many low bits of that number are set
        ones = np.zeros(rows, dtype=np.int64)
        run = flips.copy()
        for d in range(dims):
            ones += (run & 1) * (ones == d)
            run >>= 1
        direction = np.where(rank == 0, 0, ones % dims)
        entry = entry ^ rotate(corner_in, (dims - (turn + 1) % dims) % dims)
        turn = (turn + direction + 1) % dims
    return key


def projections(dim: int, curves: int, dims: int = DIMS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((curves, dim, dims)), rng.random((curves, dims))


def keys(unit: np.ndarray, projection: np.ndarray, shift: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of unit vectors: each projected coordinate goes through a logistic curve that spreads
    a normal one evenly, and the shifted grid covers twice its range."""
    even = 1 / (1 + np.exp(-1.702 * (unit @ projection)))
    return hilbert(np.minimum(((even + shift) / 2 * (1 << bits)).astype(np.int64), (1 << bits) - 1), bits)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; the same whichever block a pair meets in."""
    a, b = a.astype(np.float64), b.astype(np.float64)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def best_in_block(queries: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """The ``k`` best rows of each query, ties at the last place included."""
    out = []
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    step = max(1, (1 << 23) // max(1, len(rows)))
    for i in range(0, len(queries), step):
        some = queries[i:i + step]
        near = (some / np.linalg.norm(some, axis=1, keepdims=True)) @ unit.T
        if len(rows) > k:
            least = np.partition(near, len(rows) - k, axis=1)[:, len(rows) - k]
            q, r = np.nonzero(near >= least[:, None] - 1e-9)
        else:
            q, r = np.divmod(np.arange(near.size), len(rows))
        out.append(pd.DataFrame({"query": q_ids[i:i + step][q], "near": ids[r], "score": cosines(some[q], rows[r])}))
    return pd.concat(out) if out else pd.DataFrame({"query": [], "near": [], "score": []})


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
            curves: int = CURVES, window: float = WINDOW, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, id, score): for each row that ``is_query`` marks its ``k`` nearest found."""
    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    valid = vectors.where(F.col(id_col).isNotNull() & sound & F.exists(vector, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("id"), vector.alias("v"), is_query.alias("asks"))
    dim = valid.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dim = dim[0]["n"] if dim else 0
    valid = valid.where(F.size("v") == dim).groupBy("id", "v").agg(F.max("asks").alias("asks"))
    # k + 1 smallest ids of each class; the limit works before the shuffle, so a hot vector does not meet in one task
    ranked = valid.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("at") <= k + 1)
    classes = cut(ranked.groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("ids")))
    asking = cut(valid.where("asks").select("id", "v").join(classes.select("v", "rep"), "v").select("id", "rep"))
    n, q = classes.count(), asking.select("rep").distinct().count()
    # a window holds k + 1 rows at least, so that a small table gives all its candidates
    blocks = max(1, min(max(LEAST_BLOCKS, -(-n // block_rows)), n // (4 * (k + 1))))
    reach = max(1, int(np.ceil(window * blocks)))
    salts = max(1, -(-int(q * window) // QUERY_ROWS))
    projection, shift = projections(dim, curves)

    def curve_keys(part: pd.DataFrame) -> list[np.ndarray]:
        x = np.array(part["v"].tolist(), dtype=np.float64).reshape(len(part), dim)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        tie = part["tie"].to_numpy() & ((1 << TIE_BITS) - 1)
        return [(keys(unit * np.sqrt(dim), projection[c] / np.sqrt(dim), shift[c]) << TIE_BITS) | tie for c in range(curves)]

    def keyed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for c, key in enumerate(curve_keys(part)):
                yield pd.DataFrame({"curve": c, "key": key})

    points = classes.join(asking.select("rep").distinct().withColumn("asks", F.lit(True)), "rep", "left").select(
        "rep", "v", F.coalesce("asks", F.lit(False)).alias("asks"), F.xxhash64("v").alias("tie"))
    points = cut(points)
    shares = [i / blocks for i in range(1, blocks)]
    cuts = {c: np.zeros(0) for c in range(curves)}
    if blocks > 1:
        cuts |= {r["curve"]: np.array(r["at"]) for r in points.mapInPandas(keyed, "curve int, key long").groupBy("curve").agg(
            F.percentile_approx("key", shares, F.lit(50 * blocks)).alias("at")).collect()}  # curves * blocks numbers

    def dealt(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            asks, tie = part["asks"].to_numpy(dtype=bool), part["tie"].to_numpy()
            for c, key in enumerate(curve_keys(part)):
                block = np.searchsorted(cuts[c], key, side="left")
                first = np.clip(block - reach // 2, 0, blocks - reach)
                for s in range(salts):  # rows meet every share of the queries
                    yield pd.DataFrame({"curve": c, "block": block, "salt": s, "asks": False, "rep": part["rep"], "v": part["v"]})
                for b in range(reach):
                    yield pd.DataFrame({"curve": c, "block": first[asks] + b, "salt": (tie[asks] >> 8) % salts, "asks": True,
                                        "rep": part["rep"][asks], "v": part["v"][asks]})

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        asks = part["asks"].to_numpy(dtype=bool)
        x, ids = np.array(part["v"].tolist(), dtype=np.float64).reshape(len(part), dim), part["rep"].to_numpy()
        return best_in_block(x[asks], ids[asks], x[~asks], ids[~asks], k + 1) if asks.any() and not asks.all() else \
            pd.DataFrame({"query": [], "near": [], "score": []})

    found = points.mapInPandas(dealt, "curve int, block long, salt long, asks boolean, rep long, v array<double>")
    found = found.groupBy("curve", "block", "salt").applyInPandas(meet, "query long, near long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "near")
    merged = found.distinct().withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    merged = cut(merged.select("query", "near", "score"))
    members = merged.join(classes.select(F.col("rep").alias("near"), "ids"), "near").select("query", "score", F.explode("ids").alias("id"))
    answers = members.join(asking.select(F.col("rep").alias("query"), F.col("id").alias("query_id")), "query").where("id <> query_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return answers.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(id_col), "score")
