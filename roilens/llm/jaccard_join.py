"""N-gram Jaccard join by grouped prefixes: which documents share enough of their word shingles.

A document's set holds the 64-bit hashes of its distinct shingles of ``words``
words (with fewer words the whole sequence is one shingle); A-Z are lower-cased
and words are runs without ASCII white space. Two sets link if
``den * intersection >= num * union``.

1. *Order.* All shingles stand in one order: those that at least one in
   ``HOT_SHARE`` documents of some input split hold come last, all others by
   hash. The order is a fixed table, so it decides only the work, not the links.
2. *Prefix.* Two linked sets have ``c = ceil(num * n / den)`` shingles in common
   (``n`` the larger size), so among the first ``n - c + l`` of each in this
   order at least ``l`` are common, for every ``l``. A prefix has
   ``k = n - c + 1`` shingles and half as many more, which asks for
   ``l = k // 2 + 1`` common ones.
3. *Class and group.* Documents with equal sets are one class; classes with
   equal size and equal prefix are one group. From here on a third of all rows
   that are copies are one row.
4. *Group filter.* Groups are listed by prefix shingle (one shuffle of a seventh
   of the shingles). A group with fewer than ``l`` listed shingles that another
   group lists too has no partner and goes.
5. *Expand and verify.* Within a list, a pair is a candidate only if the sizes
   allow it and the parity sketches of both sets (1,024 bits, each shingle flips
   one) differ in no more bits than linked sets may differ in shingles, which
   drops no link. First each list proposes a spanning forest of its candidates,
   the nearest first, between groups (represented by one class) and, inside a
   group, between its classes; proposals are verified on the whole sets. Then
   every candidate pair of classes that the verified links leave in different
   components is verified. Links inside a component cannot change it, so no list
   has to emit all its pairs, and the components are exact.

Lists longer than ``BLOCK`` are dealt to several tasks: in the first round by
salt, in the second as pairs of blocks. Nothing is capped.

Defined results: a null, empty or word-free text has an empty set, size 0, no
link and itself as component; a null id takes part, but a component's id is its
smallest id that is not null (null if it has none); repeated rows are each
returned; an empty table gives an empty result; a very long text is read whole,
in one pass; columns other than the id and the text are not read. Shingles are
compared by 64-bit hash, classes by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .graph import components

WORDS, NUM, DEN = 4, 85, 100
#: A shingle in one of so many documents of a split is ordered last; the most frequent ``HOT_MOST`` of them are (the
#: table is broadcast: 4 MB at most).
HOT_SHARE, HOT_MOST = 1024, 1 << 19
SKETCH_BITS = 1024
BLOCK = 4096
#: Keys of 8 bytes that may be broadcast at most (counted first).
BROADCAST_KEYS = 1 << 20
#: Bounds of one Python task's working memory: remembered words, shingles counted at once, pairs compared at once.
CACHED_WORDS, COUNTED_AT_ONCE, PAIRS_AT_ONCE = 1 << 20, 1 << 21, 1 << 17

_MUL = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _Hashes(dict):
    """Word hashes, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MUL[3]
    h = (h ^ (h >> np.uint64(29))) * _MUL[1]
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, words: int = WORDS, hashes: dict | None = None) -> np.ndarray:
    """The sorted distinct shingle hashes of one text."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.zeros(0, np.uint64)
    hashes = _Hashes() if hashes is None else hashes
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    span = min(words, len(w))
    h = _mix(np.full(len(w) - span + 1, span, np.uint64) * _MUL[2])
    for i in range(span):
        h = _mix(h * _MUL[0] + w[i:len(w) - span + 1 + i])
    return np.unique(h)


def _ceil(a: np.ndarray | int, num: int, den: int):
    return -(-a * num // den)


def _kept(n, num: int, den: int):
    """Length of the plain prefix of a set of n shingles."""
    return n - _ceil(n, num, den) + 1


def _common(n, num: int, den: int):
    """Shingles that the longer prefixes of two linked sets share at least, n the size of the smaller one."""
    return _kept(n, num, den) // 2 + 1


def frequent(docs: DataFrame, words: int = WORDS) -> np.ndarray:
    """Sorted hashes of the shingles that the order puts last (counted over all documents, split by split)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, parts, size, rows = _Hashes(), [], 0, 0
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merge():
            nonlocal values, counts, parts, size
            v, c = np.unique(np.concatenate(parts), return_counts=True)
            twice = c > 1  # a shingle that is hot in this split repeats among millions
            v, c = np.concatenate([values, v[twice]]), np.concatenate([counts, c[twice]])
            values, at = np.unique(v, return_inverse=True)
            counts, parts, size = np.bincount(at, c, len(values)).astype(np.int64), [], 0

        for batch in batches:
            for text in batch["text"]:
                parts.append(shingle_set(text, words, hashes))
                size, rows = size + len(parts[-1]), rows + 1
                if size >= COUNTED_AT_ONCE:
                    merge()
        if parts:
            merge()
        hot = counts >= max(3, rows / HOT_SHARE)
        yield pd.DataFrame({"token": values[hot].view(np.int64), "n": counts[hot]})

    found = docs.select("text").mapInPandas(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "token").limit(HOT_MOST).select("token").toPandas()
    return np.sort(top["token"].to_numpy(np.int64).view(np.uint64))


def _digest(docs: DataFrame, hot: np.ndarray, words: int, num: int, den: int) -> DataFrame:
    """One row a document: its id, set size, class, group, prefix (in order) and sketch."""
    last = docs.sparkSession.sparkContext.broadcast(hot)

    @F.pandas_udf("n long, class binary, grp long, prefix array<long>, sketch binary")
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        hashes, hot = _Hashes(), last.value
        for texts in batches:
            rows = []
            for text in texts:
                s = shingle_set(text, words, hashes)
                n = len(s)
                if not n:
                    rows.append((0, None, 0, None, None))
                    continue
                in_order = s
                if len(hot):
                    late = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s
                    in_order = np.concatenate([s[~late], s[late]])
                prefix = in_order[:min(n, _kept(n, num, den) + _common(n, num, den) - 1)]
                flips = np.bincount((s >> np.uint64(7)).astype(np.int64) & (SKETCH_BITS - 1), minlength=SKETCH_BITS)
                rows.append((n, hashlib.blake2b(s.tobytes(), digest_size=16).digest(),
                             xxhash.xxh64_intdigest(prefix.tobytes(), seed=n) - (1 << 63),
                             prefix.view(np.int64), np.packbits(flips.astype(np.uint8) & 1).tobytes()))
            yield pd.DataFrame(rows, columns=["n", "class", "grp", "prefix", "sketch"])

    return docs.select("doc_id", "text_xxh", digest("text").alias("d")).select("doc_id", "text_xxh", "d.*")


def _allowed(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles in which linked sets of sizes a and b may differ; below 0 if sizes alone forbid a link."""
    return np.where(np.maximum(a, b) * num <= np.minimum(a, b) * den, a + b - 2 * _ceil(a + b, num, num + den), -1)


def _lists(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Whole lists, many at a time: the last list of a batch waits for the next batch."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(batch):
            continue
        same = np.ones(len(batch), bool)
        for c in key:
            same &= (batch[c] == batch[c].iloc[-1]).to_numpy()
        cut = len(batch) if same.all() else len(batch) - np.argmin(same[::-1])
        cut = 0 if same.all() else cut
        if cut:
            yield batch.iloc[:cut].reset_index(drop=True)
        rest = batch.iloc[cut:]
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True)


def _near(rows: pd.DataFrame, key: list[str], num: int, den: int, apart: str | None, sides: bool):
    """Candidate pairs of the lists in ``rows`` (sorted by key): arrays of positions i < j and the sketches' distance,
    in pieces of bounded size that never divide the pairs of one position."""
    n = rows["n"].to_numpy(np.int64)
    bits = np.frombuffer(b"".join(rows["sketch"]), np.uint64).reshape(len(rows), -1)
    change = np.zeros(len(rows), bool)
    for c in key:
        v = rows[c].to_numpy()
        change[1:] |= v[1:] != v[:-1]
    start = np.flatnonzero(np.r_[True, change[1:]])
    end = np.repeat(np.r_[start[1:], len(rows)], np.diff(np.r_[start, len(rows)]))
    after = end - np.arange(len(rows)) - 1
    other = rows[apart].to_numpy() if apart else None
    side = rows["side"].to_numpy() if sides else None
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(np.cumsum(after[at:]), PAIRS_AT_ONCE)) + at)
        i = np.repeat(np.arange(at, to), after[at:to])
        first = np.cumsum(after[at:to]) - after[at:to]
        j = i + 1 + np.arange(len(i)) - np.repeat(first, after[at:to])
        most = _allowed(n[i], n[j], num, den)
        keep = most >= 0
        if other is not None:
            keep &= other[i] != other[j]
        if side is not None:  # of two blocks only pairs across them, of a block with itself all
            keep &= (side[i] != side[j]) | (side[i] == 2)
        i, j, most = i[keep], j[keep], most[keep]
        d = np.concatenate([np.bitwise_count(bits[i[p:p + 65536]] ^ bits[j[p:p + 65536]]).sum(axis=1, dtype=np.int64)
                            for p in range(0, len(i), 65536)] or [np.zeros(0, np.int64)])
        keep = d <= most
        yield i[keep], j[keep], d[keep]
        at = to


def _forest(size: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Positions (in i, j) of a spanning forest of least distance: each round every part takes its nearest pair."""
    e = np.argsort(d, kind="stable")  # ties by position, so no two pairs are equally near and no cycle is closed
    i, j, part, kept = i[e], j[e], np.arange(size), [np.zeros(0, np.int64)]
    while True:
        a, b = part[i], part[j]
        m = a != b
        i, j, e, a, b = i[m], j[m], e[m], a[m], b[m]
        if not len(i):
            return np.concatenate(kept)
        nearest = np.full((2, size), len(i))
        back = np.arange(len(i))[::-1]  # of repeated indices the last one, the nearest pair, stays
        nearest[0, a[::-1]], nearest[1, b[::-1]] = back, back
        nearest = nearest.min(axis=0)
        c = np.flatnonzero(nearest < len(i))
        p = nearest[c]
        kept.append(e[np.unique(p)])
        to = np.arange(size)
        to[c] = a[p] + b[p] - c
        both = c[(to[to[c]] == c) & (c < to[c])]
        to[both] = both
        while (to != to[to]).any():
            to = to[to]
        part = to[part]


def _pairs(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _propose(lists: DataFrame, num: int, den: int) -> DataFrame:
    """A spanning forest of the candidates of every list (token, salt): pairs of classes."""

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _lists(batches, ["token", "salt"]):
            i, j, d = (np.zeros(0, np.int64) for _ in range(3))
            for more in _near(rows, ["token", "salt"], num, den, None, False):
                i, j, d = (np.concatenate(x) for x in zip((i, j, d), more))
                f = _forest(len(rows), i, j, d)  # of each list
                i, j, d = i[f], j[f], d[f]
            c = rows["class"].to_numpy()
            yield _pairs(c[i], c[j])

    dealt = lists.repartition("token", "salt").sortWithinPartitions("token", "salt")
    return dealt.mapInPandas(propose, "a binary, b binary").distinct()


def _remaining(lists: DataFrame, num: int, den: int) -> DataFrame:
    """All candidates of every list (token, low, high) whose classes are in different components."""

    def enumerate_(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _lists(batches, ["token", "low", "high"]):
            c = rows["class"].to_numpy()
            for i, j, _ in _near(rows, ["token", "low", "high"], num, den, "root", True):
                if len(i):
                    yield _pairs(c[i], c[j])

    dealt = lists.repartition("token", "low", "high").sortWithinPartitions("token", "low", "high")
    return dealt.mapInPandas(enumerate_, "a binary, b binary").distinct()


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs whose whole sets are similar enough."""
    a, b = (sets.select(F.col("class").alias(c), F.col("shingles").alias(f"set_{c}")) for c in "ab")
    both = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    all_ = F.size("set_a") + F.size("set_b") - F.col("both")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "set_a", "set_b", both.alias("both")).where(
        den * F.col("both") >= num * all_).select("a", "b")


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(class, shingles) of the wanted classes, made again from one text of each."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for batch in batches:
            sets = [shingle_set(t, words, hashes) for t in batch["text"]]
            yield pd.DataFrame({"class": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets],
                                "shingles": [s.view(np.int64) for s in sets]})

    keys = stored(wanted.select("text_xxh").distinct(), "jaccard-wanted")
    # few keys go to the texts; many would not fit, so then the texts go to the keys
    texts = docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, "text_xxh", "left_semi")
    one = texts.groupBy("text_xxh").agg(F.min("text").alias("text"))
    return one.mapInPandas(make, "class binary, shingles array<long>").dropDuplicates(["class"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (the 128-bit class of the set as hex, null if it is empty)."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_xxh"))
    digest = stored(_digest(docs, frequent(docs, words), words, num, den), "jaccard-digest")
    classes = stored(digest.where("n > 0").groupBy("class").agg(
        F.first("n").alias("n"), F.first("grp").alias("grp"), F.min("text_xxh").alias("text_xxh"),
        F.min("doc_id").alias("least"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch")),
        "jaccard-classes")

    smallest = F.ceil(F.col("n") * num / F.lit(den))  # size of the smallest set that can link
    groups = classes.groupBy("grp").agg(F.first("n").alias("n"), F.min("class").alias("class"),
                                        F.count("*").alias("members"), F.first("prefix").alias("prefix"))
    listed = groups.select("grp", "n", F.posexplode("prefix").alias("at", "token")).select(
        "token", "grp", (F.col("at") <= F.col("n") - smallest).alias("plain"))
    by_token = Window.partitionBy("token")
    shared = stored(listed.withColumn("others", F.count("*").over(by_token)).where("others > 1").drop("others"),
                    "jaccard-lists")
    least = F.floor((smallest - F.ceil(smallest * num / F.lit(den)) + 1) / 2) + 1
    alive = shared.groupBy("grp").agg(F.count("*").alias("shared")).join(groups.select("grp", "n"), "grp").where(
        F.col("shared") >= least).select("grp")
    lists = stored(shared.where("plain").select("token", "grp").join(alive, "grp").unionByName(
        groups.where("members > 1").select(F.xxhash64("grp", F.lit("group")).alias("token"), "grp")), "jaccard-alive")
    sets = stored(_sets(docs, classes.join(lists.select("grp").distinct(), "grp", "left_semi"), words), "jaccard-sets")

    # first round: a forest of each list over groups, each by one class, and a star inside each group
    by_group = groups.select("grp", "n", "class").join(classes.select("class", "sketch"), "class")
    rows = lists.join(by_group, "grp").withColumn("listed", F.count("*").over(by_token)).where("listed > 1")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("class"), F.ceil(F.col("listed") / BLOCK)).cast("int"))
    stars = classes.select("class", "grp").join(
        groups.where("members > 1").select("grp", F.col("class").alias("head")), "grp").where("class <> head").select(
        F.col("head").alias("a"), F.col("class").alias("b"))
    proposed = _propose(salted.select("token", "salt", "n", "class", "sketch"), num, den).unionByName(stars).distinct()
    links = stored(_verified(proposed, sets, num, den), "jaccard-links")
    roots = components(links).withColumnRenamed("node", "class")

    # second round: what is still apart
    placed = classes.select("class", "grp", "n", "sketch").join(roots, "class", "left").withColumn(
        "root", F.coalesce("root", "class"))
    narrow = lists.join(placed.select("class", "grp", "root"), "grp").withColumns(
        {"first": F.min("root").over(by_token), "last": F.max("root").over(by_token), "listed": F.count("*").over(by_token)})
    apart = narrow.where("first <> last").select("token", "class", "root", F.ceil(F.col("listed") / BLOCK).cast("int").alias("blocks"))
    apart = apart.withColumn("block", F.pmod(F.xxhash64("class"), "blocks").cast("int")).withColumn(
        "with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    apart = apart.select("token", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "class",
                         "root", F.when(F.col("block") == F.col("with"), 2).when(F.col("block") < F.col("with"), 0).otherwise(1).alias("side"))
    left = _remaining(apart.join(placed.select("class", "n", "sketch"), "class"), num, den)
    more = stored(_verified(left, sets, num, den), "jaccard-links")
    roots = components(links.unionByName(more)).withColumnRenamed("node", "class")

    named = classes.select("class", "least").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    least_id = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(least_id, "root").select("class", "component_id")
    out = digest.select("doc_id", "n", "class").join(of_class, "class", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      F.lower(F.hex("class")).alias("class_id"))
