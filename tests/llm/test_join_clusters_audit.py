"""Operators 11 to 13 against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF0001

from roilens.llm import centroids, divergence, jaccard_join

LONG = "die und der " * 40_000
DOCS = "doc_id long, text string, lang string, source string, n int, grp string, token int"


def rows(spark, texts):
    """Documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", "a", 1, "x", 2) for i, t in texts], DOCS)


# ---------------------------------------------------------------- 11

def shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def joined(texts, num=85, den=100):
    """(doc_id, size, least id of the component) by comparing every pair."""
    sets, root = [shingles(t) for _, t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and den * both >= num * (len(sets[x]) + len(sets[y]) - both):
                root[find(x)] = find(y)
    ids = defaultdict(list)
    for x, (i, _) in enumerate(texts):
        ids[find(x)].append(i)
    least = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return Counter((i, len(sets[x]), least[find(x)]) for x, (i, _) in enumerate(texts))


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def test_join_equals_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    bases = [[rng.choice(words) for _ in range(rng.choice([2, 9, 30, 80, 200]))] for _ in range(25)]
    passage = [rng.choice(words) for _ in range(20)]
    texts = []
    for i in range(420):
        w = list(bases[min(int(rng.expovariate(0.25)), 24)])  # one base has a fifth of the rows
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            at = rng.randrange(max(len(w), 1))
            w[at:at + 1] = rng.choice([[], [rng.choice(words)], [*w[at:at + 1], rng.choice(words)]])
        if rng.random() < 0.3:
            w += passage
        texts.append((1000 - i, " ".join(w)))
    for num in (85, 60):
        assert found(jaccard_join.near_duplicates(rows(spark, texts).repartition(3), num=num)) == joined(texts, num)


def test_join_of_long_lists_in_blocks(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    monkeypatch.setattr(jaccard_join, "PAIRS_AT_ONCE", 50)
    assert found(jaccard_join.near_duplicates(rows(spark, texts))) == joined(texts)


def test_join_edges(spark):
    big = 2**60 + 1
    texts = [(1, None), (2, ""), (3, " \t\n"), (big, "One two"), (big, "one\ttwo"), (None, "ONE two"), (5, LONG),
             (6, LONG + "ende"), (7, LONG), (8, "a b c d e f"), (8, "a b c d e f"), (None, "alone here"), (9, "a b c d e g")]
    out = jaccard_join.near_duplicates(rows(spark, texts))
    assert found(out) == joined(texts)
    assert {r.class_id for r in out.collect() if r.doc_id in (1, 2, 3)} == {None}
    none = jaccard_join.near_duplicates(rows(spark, texts).limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "n_shingles", "component_id", "class_id"]


def test_prefixes_share_what_the_filter_asks_for():
    for n in range(1, 400):
        kept = jaccard_join._kept(n, 85, 100)
        assert kept + jaccard_join._common(n, 85, 100) - 1 <= max(n, 1) and kept == n - (85 * n + 99) // 100 + 1


# ---------------------------------------------------------------- 12

def clustered(vectors, k=16, rounds=3):
    """Every vector against every centroid in Python's integers."""
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in vectors
            if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    now = [v for _, v in first]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), g) for g, c in enumerate(now))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        now = [[sum(x) // len(members[g]) for x in zip(*members[g])] if members[g] else c for g, c in enumerate(now)]
    placed = [(i, *nearest(v)) for i, v in kept]
    inertia = Counter()
    for _, d, g in placed:
        inertia[g] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return Counter((i, g, d, inertia[g], sum(inertia.values()), name[g]) for i, d, g in placed)


def assigned(df):
    return Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in df.collect())


def vectors(spark, data):
    return spark.createDataFrame([(i, v, 7, "x") for i, v in data], "vec_id long, embedding array<float>, cluster int, id string")


def test_clusters_equal_brute_force(spark):
    data = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF0001}/embeddings.parquet").collect()]
    assert assigned(centroids.cluster(vectors(spark, data).repartition(3))) == clustered(data)


def test_cluster_edges(spark):
    rng = np.random.default_rng(3)
    one = [0.25] * 64
    data = [(i, [float(x) for x in np.float32(rng.integers(-3, 4, 64) / 4)]) for i in range(40)] + [
        (50, None), (51, []), (52, one[:63]), (53, one + [1.0]), (54, one[:63] + [float("nan")]), (55, one[:63] + [None]),
        (56, one[:63] + [float("inf")]), (2**60 + 1, one), (2**60 + 1, one), (None, one), (58, [0.0] * 64), (59, [-0.001] * 64)]
    assert assigned(centroids.cluster(vectors(spark, data))) == clustered(data)
    few = data[:5]
    assert assigned(centroids.cluster(vectors(spark, few))) == clustered(few)
    assert centroids.cluster(vectors(spark, data[40:47])).count() == 0 and centroids.cluster(vectors(spark, [(1, one)]).limit(0)).count() == 0
    large = [(i, [float(np.float32(x)) for x in rng.normal(size=64) * 2.0**19]) for i in range(30)]
    assert assigned(centroids.cluster(vectors(spark, large))) == clustered(large)


@pytest.mark.parametrize("kind", ["small", "tied", "large"])
def test_search_is_exact_and_rejects(kind):
    rng = np.random.default_rng(7)
    if kind == "small":  # components with a common level, as the mean and deviation bounds like them
        x = (rng.normal(size=(900, 16)) * 8 + rng.normal(size=(900, 1)) * 40).astype(np.int64)
        c = (rng.normal(size=(24, 16)) * 8 + rng.normal(size=(24, 1)) * 40).astype(np.int64)
    elif kind == "tied":
        x, c = rng.integers(-1, 2, (300, 4)), np.repeat(rng.integers(-1, 2, (6, 4)), 3, 0)
    else:
        x, c = (np.array([[int(v) << 60 for v in r] for r in rng.integers(-99, 99, (40, 8))], object) for _ in "ab")
        x, c = x + 1, c[:9]
    number, best, summed = centroids.search(x, c)
    d = ((x[:, None].astype(object) - c[None].astype(object)) ** 2).sum(axis=2)
    want = [min((v, g) for g, v in enumerate(r)) for r in d]
    assert [(b, g) for b, g in zip(best, number)] == want
    if kind == "small":
        assert summed < 0.5 * d.size


# ---------------------------------------------------------------- 13

def audited(data, least=3, unit=10**9):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in term.findall(text or "")])
            for text, lang, source in data]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in held.items() if n >= least)
        count = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, found in mine:
            count[s].update(t for t in found if held[t] >= least)
        whole = sum(count.values(), Counter())

        def shares(c):
            total = sum(c.values())
            return {t: 1 + unit * (c[t] + 1) // (total + len(kept)) for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in count.items()}
        for s in count:
            pairs = [(-sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept), o.encode(), o) for o in count if o != s]
            out += [(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(sorted(pairs))]
            top = [(-((p[s][t] - q[t]) ** 2 // q[t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(sorted(top)[:200])]
    return Counter(out)


def audit(spark, data):
    df = spark.createDataFrame([(i, *r, 3, "x") for i, r in enumerate(data)],
                               "doc_id long, text string, lang string, source string, rank int, item string")
    return Counter(tuple(r) for r in divergence.audit(df.repartition(2)).collect())


def test_audit_equals_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefghijklmnopqrstuvwxyzéß" for b in ("o", "É", "x", "yz")]
    data = [(" ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(1, 60))),
             rng.choice(["en", "de"]), f"s{min(int(rng.expovariate(0.3)), 12)}") for _ in range(300)]
    assert audit(spark, data) == audited(data)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 7)
    monkeypatch.setattr(divergence, "STATES_AT_ONCE", 40)
    monkeypatch.setattr(divergence, "COUNTS_AT_ONCE", 20)
    assert audit(spark, data) == audited(data)


def test_audit_edges(spark):
    data = [(None, None, None), ("", "", ""), ("Alpha ALPHA beta-beta 1x2", "en", "a"), ("alpha Beta", "en", "b"),
            ("alpha beta gamma", "en", "b"), ("12 34 _", "en", "c"), (None, "en", None), ("one", "fr", "z"),
            ("Ünder übER été", "de", "x"), ("Ünder übER été", "de", "x"), ("Ünder übER été", "de", "y"), (LONG, "de", "y"),
            (LONG, "de", "x"), ("der", "de", "x")]
    assert audit(spark, data) == audited(data)
    empty = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(empty).count() == 0


def test_tree_prices_zeros_analytically():
    rng = np.random.default_rng(2)
    for rows_, cols in ((1, 5), (2, 1), (5, 40), (20, 300)):
        dense = rng.poisson(0.2, (rows_, cols)) * rng.integers(1, 9, (rows_, cols))
        dense[0, 0] = 3
        r, c = np.nonzero(dense)
        totals = dense.sum(axis=1) + 5
        p = divergence.share(dense, totals[:, None], cols + 3)
        want = np.array([[int(divergence.price(a, b).sum()) if i != j else 0 for j, b in enumerate(p)] for i, a in enumerate(p)])
        assert (divergence.tree_sums(r, c, dense[r, c], rows_, cols, totals, cols + 3) == want).all()
