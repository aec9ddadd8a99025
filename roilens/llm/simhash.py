"""SimHash near-duplicates with a vantage-point tree over the fingerprints.

Every text gets a 64-bit SimHash over its word shingles. Distinct fingerprints
are dealt to the leaves of a vantage-point tree: at a node with vantage point
``v`` and radius ``m`` a fingerprint ``x`` is at home inside if
``hamming(x, v) <= m`` and outside otherwise. By the triangle inequality two
fingerprints at most ``r`` bits apart differ by at most ``r`` in their distance
to ``v``, so only an inside point with distance over ``m - r`` can have a
partner outside: it also visits the outside subtree as a query, and a query
prunes each branch that the bound rules out. Each pair within ``r`` bits
therefore meets in the leaf at which one of the two is at home, and the links
found are exact. A leaf compares distances only within the shells that a local
vantage point leaves open, in blocks of bounded size, and emits a spanning
forest of its links instead of all pairs. Components come from rounds of large
and small stars, each cut by a checkpoint.

The tree is fitted on a bounded sample of distinct fingerprints
(``SAMPLE_PER_LEAF`` for each leaf, ``2 ** MAX_DEPTH`` leaves at most); every
fingerprint is placed and every boundary searched, so the sample only decides
how even the leaves are.

Defined results: a null or word-free text has fingerprint zero and links like
any other; a null id takes part, but a component's id is its smallest id that is
not null (null if it has none); repeated rows are each returned; an empty table
gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
LEAF_ROWS = 2048
SAMPLE_PER_LEAF = 16
MAX_DEPTH = 12
HOME_ROWS, VISIT_ROWS, ROUTED_AT_ONCE = 1 << 14, 1 << 20, 1024
BLOCK_PAIRS = 1 << 22
SHINGLES_AT_ONCE = 1 << 17


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """The unsigned SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i:i + shingle]), seed=SEED)
                         for i in range(at, min(n, at + SHINGLES_AT_ONCE))), dtype=">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(id, text_xxh, fp): the fingerprint as a signed long, and a hash of the whole text."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(t, shingle) for t in texts), dtype=np.uint64, count=len(texts))
        return pd.Series(found.view(np.int64))

    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_xxh"), simhash(text).alias("fp"))


def fit_tree(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a complete tree, heap order (node i has 2i and 2i+1)."""
    points, radii = np.zeros(1 << depth, dtype=np.uint64), np.zeros(1 << depth, dtype=np.int64)
    held = {1: sample}
    for node in range(1, 1 << depth):
        own = held.pop(node)
        if len(own):
            tried = own[np.linspace(0, len(own) - 1, min(8, len(own))).astype(int)]
            far = [np.bitwise_count(own ^ v).astype(np.int64) for v in tried]
            best = int(np.argmax([d.std() for d in far]))
            points[node], radii[node] = tried[best], int(np.median(far[best]))
            inside = far[best] <= radii[node]
            held[2 * node], held[2 * node + 1] = own[inside], own[~inside]
        else:
            held[2 * node] = held[2 * node + 1] = own
    return points, radii


def route(fp: np.ndarray, points: np.ndarray, radii: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """For each visit: row of ``fp``, leaf, and whether the row is at home there."""
    at = np.arange(len(fp))
    node, home = np.ones(len(fp), dtype=np.int64), np.ones(len(fp), dtype=bool)
    for _ in range(int(len(points)).bit_length() - 1):
        d = np.bitwise_count(fp[at] ^ points[node]).astype(np.int64)
        m = radii[node]
        goes_in = np.where(home, d <= m, d - bits <= m)
        goes_out = d + bits > m  # at home outside, or a query whose partners may lie there
        at = np.concatenate([at[goes_in], at[goes_out]])
        home = np.concatenate([home[goes_in], home[goes_out] & (d[goes_out] > m[goes_out])])
        node = np.concatenate([2 * node[goes_in], 2 * node[goes_out] + 1])
    return at, node, home


def deal(fp: np.ndarray, leaf: np.ndarray, home: np.ndarray, blocks: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each row of a task's input: place in ``fp``, block, share, and whether it is at home there. A home row
    stands in its own block for every share, and visits the leaf's other blocks in its own share."""
    def own(parts: np.ndarray, mix: int) -> np.ndarray:
        return ((fp * np.uint64(mix)) >> np.uint64(33)).astype(np.int64) % parts

    def each(rows: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(rows, copies), np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)

    block, share = own(blocks[leaf], 0x9E3779B97F4A7C15), own(shares[leaf], 0xD6E8FEB86659FD93)
    at_home = np.flatnonzero(home)
    h_at, h_share = each(at_home, shares[leaf[at_home]])
    v_at, v_block = each(np.arange(len(fp)), blocks[leaf])
    visits = ~(home[v_at] & (v_block == block[v_at]))
    v_at, v_block = v_at[visits], v_block[visits]
    return (np.concatenate([h_at, v_at]), np.concatenate([block[h_at], v_block]), np.concatenate([h_share, share[v_at]]),
            np.arange(len(h_at) + len(v_at)) < len(h_at))


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining a[i] with b[i]: each row gets the smallest row it reaches."""
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (label[label] != label).any():
            label = label[label]
        if (label == before).all():
            return label


def leaf_links(fp: np.ndarray, home: np.ndarray, bits: int) -> np.ndarray:
    """For rows of one leaf: the smallest row that each is linked to through the leaf's pairs."""
    label = np.arange(len(fp))
    own = np.flatnonzero(home)
    if not len(own):
        return label
    vantage = fp[own[0]]
    d = np.bitwise_count(fp ^ vantage).astype(np.int64)
    own = own[np.argsort(d[own], kind="stable")]
    d_own, fp_own = d[own], fp[own]
    for shell in np.unique(d):
        rows = np.flatnonzero(d == shell)
        lo, hi = np.searchsorted(d_own, [shell - bits, shell + bits + 1])
        if lo == hi:
            continue
        step = max(1, BLOCK_PAIRS // (hi - lo))
        for i in range(0, len(rows), step):
            some = rows[i:i + step]
            a, b = np.nonzero(np.bitwise_count(fp[some, None] ^ fp_own[None, lo:hi]) <= bits)
            a, b = some[a], own[lo:hi][b]
            differ = a != b
            if differ.any():
                label = _forest(label, a[differ], b[differ])
    return label


def fingerprint_links(distinct: DataFrame, bits: int = MAX_BITS, leaf_rows: int = LEAF_ROWS, home_rows: int = HOME_ROWS,
                      visit_rows: int = VISIT_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` whose components are those of all
    pairs at most ``bits`` apart."""
    spark = distinct.sparkSession
    n = distinct.count()
    depth = int(min(MAX_DEPTH, max(0, np.ceil(np.log2(max(1, n) / leaf_rows)))))
    taken = distinct.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE_PER_LEAF << depth).toPandas()
    points, radii = fit_tree(taken["fp"].to_numpy(dtype=np.int64).view(np.uint64), depth)
    tree = spark.sparkContext.broadcast((points, radii))  # 16 bytes for each of at most 2 ** MAX_DEPTH nodes

    def routed(parts: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, ...]]:
        for part in parts:
            fp = part["fp"].to_numpy(dtype=np.int64).view(np.uint64)
            for i in range(0, len(fp), ROUTED_AT_ONCE):
                some = fp[i:i + ROUTED_AT_ONCE]
                at, leaf, home = route(some, *tree.value, bits)
                yield some[at], leaf, home

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros((2, 2 << depth), dtype=np.int64)
        for _, leaf, home in routed(parts):
            held[0] += np.bincount(leaf[home], minlength=2 << depth)
            held[1] += np.bincount(leaf, minlength=2 << depth)
        seen = np.flatnonzero(held[1])
        yield pd.DataFrame({"leaf": seen, "homes": held[0, seen], "visits": held[1, seen]})

    counts = distinct.select("fp").mapInPandas(count, "leaf long, homes long, visits long").groupBy("leaf").agg(
        F.sum("homes").alias("homes"), F.sum("visits").alias("visits")).toPandas()  # a row for each leaf
    blocks, shares = np.ones(2 << depth, dtype=np.int64), np.ones(2 << depth, dtype=np.int64)
    at_leaf = counts["leaf"].to_numpy(dtype=np.int64)
    blocks[at_leaf] = np.maximum(1, -(-counts["homes"].to_numpy(dtype=np.int64) // home_rows))
    shares[at_leaf] = np.maximum(1, -(-counts["visits"].to_numpy(dtype=np.int64) // visit_rows))

    def visits(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for fp, leaf, home in routed(parts):
            at, block, share, is_home = deal(fp, leaf, home, blocks, shares)
            yield pd.DataFrame({"leaf": leaf[at], "block": block, "share": share, "fp": fp[at].view(np.int64), "home": is_home})

    def links(part: pd.DataFrame) -> pd.DataFrame:
        fp = part["fp"].to_numpy(dtype=np.int64)
        label = leaf_links(fp.view(np.uint64), part["home"].to_numpy(dtype=bool), bits)
        tied = label != np.arange(len(fp))
        return pd.DataFrame({"a": fp[tied], "b": fp[label[tied]]})

    dealt = distinct.select("fp").mapInPandas(visits, "leaf long, block long, share long, fp long, home boolean")
    return dealt.groupBy("leaf", "block", "share").applyInPandas(links, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: the id, fingerprint (hex), component_id (smallest id reachable),
    root (a fingerprint that names the component) and text_xxh (xxhash64 of the text)."""
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    linked = components(fingerprint_links(distinct.select("fp"), bits))
    named = distinct.join(linked, distinct.fp == linked.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut(named.join(roots, "root").select("fp", "root", "component_id"))
    return prints.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.lower(F.lpad(F.hex("root"), 16, "0")).alias("root"), "text_xxh")
