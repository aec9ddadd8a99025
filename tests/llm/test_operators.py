"""Each operator against a brute-force version, an exact round trip or held-out accuracy, and its edge cases:
nulls in any column, empty and very long texts, ties and repeated rows, empty tables, clashing extra columns."""

import zlib

import numpy as np
import pandas as pd
import pytest
from conftest import SF0001, SF001
from pyspark.sql import functions as F

from roilens.llm import ann, decontaminate, langid, licences, lm_scores, sentencepiece_codec, sharding, simhash, toxicity, url_filters
from roilens.llm.common import id_remainder

LONG = "die und der " * 40_000
ROWS = [(1, "The cat sat on the mat and looked at the dog."), (2, None), (3, ""), (4, "%%% 123 ***"), (None, "A text without an id, all alone."),
        (5, LONG), (6, "The cat sat on the mat and looked at the dog."), (6, "The cat sat on the mat and looked at the dog.")]


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with all edge cases and columns whose names clash with those of the results."""
    df = spark.createDataFrame([(*r, "x", -1, "y") for r in ROWS], "doc_id long, text string, score string, shard int, fp string")
    return df.withColumnRenamed("fp", "fingerprint")


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet").cache()


def test_sharding_law_slots_and_edges(odd, none, docs):
    got = sharding.shard(docs).toPandas()
    moved = got[got["shard"] != got["grown_shard"]]
    assert set(moved["grown_shard"]) == {24} and 0 < len(moved) < len(got) / 12
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(zlib.crc32(text[r.doc_id].encode()) == r.text_crc32 and len(text[r.doc_id].encode()) + 8 == r.size for r in got.itertuples())
    rows = sharding.shard(odd).collect()
    assert len(rows) == len(ROWS) and {r["size"] for r in rows if r.doc_id in (2, 3)} == {8}
    assert len({r["shard"] for r in rows if r.doc_id == 6}) == 1 and len({(r["shard"], r.slot) for r in rows}) == len(rows)
    assert next(r.text_crc32 for r in rows if r.doc_id == 2) is None
    assert sharding.shard(none).count() == 0


def test_sharding_weight_change_stays_in_its_subtree(docs):
    before = sharding.topology(24)
    after = [(g, r, s, 2.0 if s == 0 else w) for g, r, s, w in before]
    both = sharding.place(sharding.place(docs.select("doc_id"), F.col("doc_id"), before, "a"), F.col("doc_id"), after, "b")
    moved = both.where("a <> b").collect()
    assert moved and all(r.b // 8 == 0 for r in moved)  # into the region that gained
    inside = [r for r in moved if r.a // 4 == 0]
    assert all(r.b == 0 for r in inside)  # within the rack only into the shard that gained


def test_hilbert_curve_is_continuous():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.indices((1 << bits,) * dims).reshape(dims, -1).T
        key = ann.hilbert(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_nearest_recall_and_edges(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    got = ann.nearest(e, F.col("vec_id") % 50 == 0).toPandas()
    p = e.toPandas()
    x = np.array(p["embedding"].tolist(), dtype=np.float64)
    unit, hit = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    queries = np.flatnonzero(p["vec_id"] % 50 == 0)
    for i in queries:
        s = unit @ unit[i]
        s[i] = -9
        hit += len(set(p["vec_id"].iloc[np.lexsort((p["vec_id"], -s))[:5]]) & set(got[got.query_id == p.vec_id[i]].vec_id))
    assert hit >= 0.9 * 5 * len(queries) and len(got) == 5 * len(queries)
    odd = spark.createDataFrame([(0, [1.0, 0.0]), (3, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [None, 1.0]),
                                 (7, [float("nan"), 1.0]), (8, [0.0, 1.0]), (None, [1.0, 1.0]), (9, [1.0])], "vec_id long, embedding array<float>")
    rows = ann.nearest(odd, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(2, 1.0), (3, 1.0), (8, 0.0)]
    assert ann.nearest(odd.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.mark.parametrize("n", [2, 5, 6, 7, 30, 47])
def test_nearest_in_a_small_table_is_whole(spark, n):
    x = np.random.default_rng(n).standard_normal((n, 12))
    e = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(e, F.lit(True)).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = unit @ unit.T - 9 * np.eye(n)
    for i in range(n):
        want = np.argsort(-s[i], kind="stable")[:min(5, n - 1)].tolist()
        assert got[got.query_id == i].sort_values("rank")["vec_id"].tolist() == want


def brute_components(prints, ids, bits=3):
    u, inv = np.unique(np.array(prints, dtype=np.uint64), return_inverse=True)
    label = np.arange(len(u))
    a, b = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= bits)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        if (new == label).all():
            break
        label = new
    least = {}
    for i, k in zip(ids, label[inv], strict=True):
        least[k] = min(i, least.get(k, i))
    return [least[k] for k in label[inv]]


def test_simhash_components_equal_brute_force(docs):
    got = simhash.near_duplicates(docs).toPandas()
    text = {r.doc_id: r.text for r in docs.collect()}
    prints = [simhash.fingerprint(text[i]) for i in got["doc_id"]]
    assert [f"{p:016x}" for p in prints] == got["fingerprint"].tolist()
    assert brute_components(prints, got["doc_id"]) == got["component_id"].tolist()


def test_simhash_tree_finds_all_links():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = base[:150] ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150, dtype=np.uint64))
    fp = np.unique(np.concatenate([base, near]))
    points, radii = simhash.fit_tree(fp[::3], 5)
    at, leaf, home = simhash.route(fp, points, radii, 3)
    assert home.sum() == len(fp)
    met = set()
    for k in np.unique(leaf):
        own, q = at[(leaf == k) & home], at[leaf == k]
        met |= {tuple(sorted((i, j))) for i in q for j in own if i != j}
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    assert {(i, j) for i, j in zip(a, b, strict=True) if i < j} <= met


def test_simhash_crowded_leaf_is_dealt_without_loss(spark):
    rng = np.random.default_rng(5)
    fp = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = fp[:300] ^ (np.uint64(1) << rng.integers(0, 63, 300).astype(np.uint64)) ^ np.uint64(1 << 63)
    fp = np.unique(np.concatenate([fp, near, near[:150] ^ np.uint64(7)]))
    known = spark.createDataFrame(pd.DataFrame({"fp": fp.view(np.int64)}))
    a, b = np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3)
    want = simhash._forest(np.arange(len(fp)), a, b)
    for limits in ({}, {"leaf_rows": 100}, {"leaf_rows": 400, "home_rows": 30, "visit_rows": 50}, {"leaf_rows": 10_000, "home_rows": 100, "visit_rows": 200}):
        links = simhash.fingerprint_links(known, 3, **limits).toPandas()
        got = simhash._forest(np.arange(len(fp)), *(np.searchsorted(fp, links[c].to_numpy(dtype=np.int64).view(np.uint64)) for c in "ab"))
        assert (got == want).all()


def test_simhash_deal_bounds_groups_and_lets_all_pairs_meet():
    fp = np.random.default_rng(6).integers(0, 1 << 63, 500, dtype=np.uint64)
    home = np.arange(500) < 200
    blocks, shares = np.full(1, 5), np.full(1, 7)
    at, block, share, is_home = simhash.deal(fp, np.zeros(500, dtype=np.int64), home, blocks, shares)
    group = block * 7 + share
    assert np.bincount(group[is_home]).max() < 80 and np.bincount(group[~is_home]).max() < 150
    met = set()
    for g in np.unique(group):
        here, homes = at[group == g], at[(group == g) & is_home]
        met |= {(int(x), int(y)) for x in here for y in homes}
    assert {(x, y) for x in range(500) for y in range(200)} <= met


def test_simhash_edges(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS) and by[2].fingerprint == "0" * 16 and by[3].component_id == by[2].component_id == 2
    assert by[6].component_id == 1 and by[None].component_id is None
    assert simhash.near_duplicates(none).count() == 0


URLS = [(1, "https://a.Example.org/es/1"), (2, "http://example.org/en/12?x=1"), (3, "http://x.com/fr/"), (4, "http://x.com/de/1"), (5, None), (6, "nothing"),
        (7, "http://notexample.org/es/"), (8, "https://spam.net/de/9"), (8, "https://spam.net/de/9"), (None, "http://q.net/")]
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def test_url_filters(spark):
    pages = spark.createDataFrame([(*u, "v") for u in URLS], "page_id long, url string, verdict string")
    labelled = spark.createDataFrame([(f"https://spam.net/de/{i}", True) for i in range(60)] + [(f"http://fine.net/en/{i}", False) for i in range(60)]
                                     + [(None, True), ("http://x.net/", None)], "url string, blocked boolean")
    rows = url_filters.filter_urls(pages, labelled, RULES).collect()
    by = {r.page_id: r for r in rows}
    assert len(rows) == len(URLS)
    assert [(by[i].rule, by[i].verdict) for i in (1, 2, 3, 4, 7)] == [
        ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"), ("org/", "allow")]
    assert (by[1].host, by[1].path, by[5].host, by[6].path) == ("a.example.org", "/es/1", "", "")
    assert by[8].verdict == "block" and by[8].mined and by[5].verdict == by[None].verdict == "allow"
    assert {r.verdict for r in url_filters.filter_urls(pages, labelled.limit(0), RULES).where("rule is null").collect()} == {"allow"}
    assert url_filters.filter_urls(pages.limit(0), labelled, RULES).count() == 0


def test_mined_rules_reach_support_and_confidence(spark):
    urls = [(f"http://h{i % 7}.net/{'de' if i % 2 else 'en'}/{i}", bool(i % 2) and i % 10 != 1) for i in range(400)]
    rules = url_filters.mine(spark.createDataFrame(urls, "url string, blocked boolean"))[0].collect()
    have = [(set(t), b) for t, b in zip([r[0] for r in spark.createDataFrame(urls, "url string, b boolean").select(url_filters.tokens(F.col("url"))).collect()],
                                        [b for _, b in urls], strict=True)]
    assert rules
    for r in rules:
        hit = [b for t, b in have if set(r.tokens) <= t]
        good = sum(b == (r.verdict == "block") for b in hit)
        assert good >= url_filters.MIN_ROWS and abs(good / len(hit) - r.confidence) < 1e-9 and r.confidence >= url_filters.MIN_CONFIDENCE


def test_mined_rules_of_many_tokens(spark):
    # blocked only where all four names meet: any three of them are allowed as often
    names = ["a", "b", "c", "d"]
    sets = [names] * 150 + [[n for n in names if n != gone] for gone in names for _ in range(80)]
    urls = [(f"http://h{i}.net/?" + "&".join(f"{n}=1" for n in s), len(s) == 4) for i, s in enumerate(sets)]
    rules = url_filters.mine(spark.createDataFrame(urls, "url string, blocked boolean"))[0].collect()
    assert ["arg:a", "arg:b", "arg:c", "arg:d"] in [list(r.tokens) for r in rules if r.verdict == "block"]
    pages = spark.createDataFrame([(1, "http://new.net/?a=1&b=2&c=3&d=4"), (2, "http://new.net/?a=1&b=2&c=3")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_filters.filter_urls(pages, spark.createDataFrame(urls, "url string, blocked boolean"), []).collect()}
    assert got == {1: "block", 2: "allow"}


def test_copies_of_a_long_url_end(spark):
    long = "http://tracker.net/" + "/".join(f"step{i}" for i in range(60)) + "?"
    urls = [(long + f"u={i}", True) for i in range(1000)] + [(f"http://fine.net/en/{i}", False) for i in range(1000)]
    pages = spark.createDataFrame([(1, long), (2, "http://tracker.net/other"), (3, "http://fine.net/en/7"), (4, "http://new.org/")],
                                  "page_id long, url string")
    got = {r.page_id: (r.verdict, r.mined) for r in url_filters.filter_urls(pages, spark.createDataFrame(urls, "url string, blocked boolean"), []).collect()}
    assert [got[i][0] for i in (1, 2, 3, 4)] == ["block", "block", "allow", "allow"] and got[4][1] is None


def test_verdicts_equal_a_brute_force_miner(spark):
    from itertools import combinations
    rng = np.random.default_rng(11)
    urls = []
    for _ in range(160):
        host, words = rng.choice(["a.net", "b.net", "c.org"]), [w for w in ("x", "y", "z") if rng.random() < 0.5]
        urls.append((f"http://{host}/{'/'.join(words)}", bool(rng.random() < (0.95 if "x" in words and host != "c.org" else 0.1))))
    df = spark.createDataFrame(urls, "url string, blocked boolean")
    have = [frozenset(r[0]) for r in df.select(url_filters.tokens(F.col("url"))).collect()]
    support = max(url_filters.MIN_SUPPORT * len(urls), url_filters.MIN_ROWS)
    rules = {}
    for t in set(have):
        for size in range(1, len(t) + 1):
            for s in combinations(sorted(t), size):
                hit = [b for h, (_, b) in zip(have, urls) if set(s) <= h]
                for verdict, n in (("block", sum(hit)), ("allow", len(hit) - sum(hit))):
                    if n >= support and n / len(hit) >= url_filters.MIN_CONFIDENCE:
                        rules[frozenset(s), verdict] = n / len(hit)
    kept = {(s, v): c for (s, v), c in rules.items() if not any(o < s and w == v and d >= c for (o, w), d in rules.items())}
    want = {}
    for t, (u, _) in zip(have, urls):
        best = max(((c, len(s), v) for (s, v), c in kept.items() if s <= t), default=(0, 0, "allow"))
        want[u] = best[2]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(want)], "page_id long, url string")
    got = {u: r.verdict for r in url_filters.filter_urls(pages, df, []).collect() for u in [list(want)[r.page_id]]}
    assert got == want and len(set(want.values())) == 2


INSULTS = ("idiot", "moron", "scum")


def test_toxicity_learns_and_edges(spark, odd, none):
    rng = np.random.default_rng(2)
    clean = [" ".join(rng.choice(list("abcdefgh"), 40)) for _ in range(300)]
    toxic = [" ".join(np.insert(rng.choice(list("abcdefgh"), 40).astype("<U9"), 20, rng.choice(INSULTS))) for _ in range(150)]
    model = toxicity.train(clean[:250] + toxic[:120], [0] * 250 + [1] * 120)
    held = toxicity.score(model, clean[250:] + toxic[120:])
    assert (held[:50] < 0.3).mean() > 0.9 and (held[50:] >= 0.3).mean() > 0.9
    late = toxicity.score(model, ["a b c " * 30_000 + " idiot", "a b c " * 30_000])
    assert late[0] >= 0.3 > late[1]  # whole texts are scored
    rows = toxicity.rate(odd, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows) and [r.score for r in rows if r.doc_id in (2, 3)] == [0.0, 0.0]
    assert len({r.score for r in rows if r.doc_id in (1, 6)}) == 1
    assert toxicity.rate(none, model).count() == 0
    assert toxicity.score(toxicity.train([], []), ["a", None]).tolist() == [0.0, 0.0]


def test_toxicity_reads_whole_runs_without_spaces():
    rng = np.random.default_rng(3)
    run = lambda: "".join(rng.choice(list("山水花鳥風月雪雨木石"), 120))
    clean = [run() for _ in range(300)]
    toxic = [(t := run())[:60] + "馬鹿野郎死" + t[60:] for _ in range(150)]
    for word in (clean[0], "x" * 64, "x" * 65, "aé漢😀" * 50, "é" * 33):
        parts = toxicity.pieces(word)
        assert all(len(p.encode()) <= toxicity.WORD_BYTES for p in parts)
        assert {word[i:i + 8] for i in range(len(word) - 7)} == {p[i:i + 8] for p in parts for i in range(len(p) - 7)}
    model = toxicity.train(clean[:250] + toxic[:120], [0] * 250 + [1] * 120)
    held = toxicity.score(model, clean[250:] + toxic[120:])
    assert (held[:50] < 0.3).mean() > 0.9 and (held[50:] >= 0.3).mean() > 0.9
    assert toxicity.tokenize("ab " + "c" * 64 + " d") == ["ab", "c" * 64, "d"]


def test_toxicity_gradients_match_differences():
    rng = np.random.default_rng(0)
    m = toxicity.Model({"a": 1, "b": 2}, toxicity._start(2, rng))
    words, rows = ["a", "b", "c"], np.where(rng.random((4, toxicity.WINDOW)) < 0.2, -1, rng.integers(0, 3, (4, toxicity.WINDOW)))
    rows[:, 0], y, drop = 0, np.array([1, 0, 1, 0], dtype=np.float32), np.zeros(3, dtype=bool)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}

    def loss():
        x = toxicity.inputs(m, words)[0]
        at = np.maximum(rows.T, 0)
        z = toxicity.network(m.w, (x @ m.w["xf"] + m.w["bf"])[at], (x @ m.w["xb"] + m.w["bb"])[at], rows.T >= 0)[0]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g = toxicity.gradients(m, words, rows, y, drop)
    for k in ("uf", "ub", "cf", "xf", "wa", "va", "out", "words"):
        i = np.unravel_index(int(np.abs(g[k]).argmax()), g[k].shape)
        m.w[k][i] += 1e-3
        up = loss()
        m.w[k][i] -= 2e-3
        down = loss()
        m.w[k][i] += 1e-3
        assert (up - down) / 2e-3 == pytest.approx(float(g[k][i]), rel=0.05, abs=2e-4), k


def test_language_held_out_accuracy_and_edges(docs, odd, none):
    model = langid.fit(docs.where(id_remainder(F.col("doc_id"), 3) != 1))
    got = langid.identify(docs, model).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[[zlib.crc32(str(i).encode()) % 3 == 1 for i in got["doc_id"]]]
    assert (held["lang_pred"] == held["lang"]).mean() > 0.97
    rows = langid.identify(odd, model).collect()
    assert [(r.lang_pred, r.score) for r in rows if r.doc_id in (2, 3, 4)] == [("und", 0.0)] * 3
    assert next(r.lang_pred for r in rows if r.doc_id == 5) == langid.predict(model, ["die und der " * 400])[0][0]
    assert langid.identify(none, model).count() == 0
    assert langid.predict(langid.train([], []), ["some text"]) == (["und"], [0.0])


def test_sentencepiece_parity_and_round_trip(docs, odd, none):
    with open(sentencepiece_codec.MODEL, "rb") as f:
        codec = sentencepiece_codec.Codec(f.read())
    texts = [r.text for r in docs.limit(200).collect()] + ["", "  a  b ", "x\n\n\t y ", "日本語 😀 é", "<s> <0x0A>", "a" * 3000, "▁ ▁▁x", LONG]
    ids, same = codec.encode_verified(texts)
    assert all(same) and all(codec.verify(texts, ids))
    whole = codec.fast.encode_batch(texts, add_special_tokens=False)
    assert all(x.tolist() == e.ids for x, e in zip(ids, whole, strict=True))
    back = codec.decode(ids)
    assert back == [codec.text_of(x) for x in ids] and all(b == t for b, t in zip(back, texts, strict=True) if "▁" not in t)
    rows = sentencepiece_codec.encode(odd).collect()
    assert len(rows) == len(ROWS) and [r.ids for r in rows if r.doc_id in (2, 3)] == [None, []]
    assert all(r.parity and r.round_trip for r in rows if r.ids is not None)
    again = sentencepiece_codec.decode(sentencepiece_codec.encode(odd)).collect()
    assert sorted(map(str, [r.text for r in again])) == sorted(map(str, [t for _, t in ROWS]))
    assert sentencepiece_codec.encode(none).count() == 0


def test_unigram_models_are_rebuilt():
    def field(number, wire, data):
        return bytes([number << 3 | wire]) + data

    def piece(text, score, kind):
        body = field(1, 2, bytes([len(text.encode())]) + text.encode()) + field(2, 5, np.float32(score).tobytes()) + field(3, 0, bytes([kind]))
        return field(1, 2, bytes([len(body)]) + body)

    vocab = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -2, 1), ("a", -3, 1), ("b", -3.5, 1), ("▁ab", -2.5, 1), ("ab", -4, 1)]
    trainer, normal = field(3, 0, b"\x01"), field(1, 2, b"\x08identity")
    data = b"".join(piece(*p) for p in vocab) + field(2, 2, bytes([len(trainer)]) + trainer) + field(3, 2, bytes([len(normal)]) + normal)
    codec = sentencepiece_codec.Codec(data)
    texts = ["ab ba", "aab", "b  a b", ""]
    ids, same = codec.encode_verified(texts)
    assert codec.spec.kind == sentencepiece_codec.UNIGRAM and all(same) and all(codec.verify(texts, ids))


ITEM = "On Monday Alice has 12 apples and Bob gives Alice 30 km of rope, how many apples are left over for her?"


def test_decontamination_templates_slots_and_edges(spark, odd, none):
    texts = [(1, "Before it. " + ITEM + " After."), (2, ITEM.replace("Alice", "Carol").replace("12", "7").replace("km", "miles")),
             (3, ITEM.replace("Alice", "Carol", 1)), (4, "We had 12 apples and some rope."), (5, None), (6, ""), (None, ITEM), (7, "word " * 50_000 + ITEM),
             (8, ITEM), (8, ITEM)]
    docs = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(0, ITEM), (0, ITEM), (1, None), (2, "too short"), (3, "")], "item_id long, text string")
    rows = decontaminate.contaminated(docs, bench).collect()
    assert sorted((str(r.doc_id), r.item_id, r.exact) for r in rows) == [("1", 0, True), ("2", 0, False), ("7", 0, True), ("8", 0, True), ("None", 0, True)]
    assert sorted(str(r.doc_id) for r in decontaminate.clean(docs, bench).collect()) == ["3", "4", "5", "6"]
    assert decontaminate.contaminated(docs.limit(0), bench).count() == decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_chains_shifted_pieces(spark):
    words, short = ITEM.split(), "Please tell Alice now how many red apples Bob could possibly carry home before 12 hours passed today."
    near = [" ".join(words[:11] + ["really"] + words[11:]), " ".join(words[:10] + words[11:]), ITEM.replace("Alice", "Mary Ann"),
            ITEM.replace("12", "12 000"), short.replace("Bob", "Jean Luc"),
            " ".join(words[:11]) + " so and so and so it went on for very long " + " ".join(words[11:14])]
    docs = spark.createDataFrame([(i, f"Then it went on. {t} It ended there.") for i, t in enumerate(near)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, ITEM), (1, short)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 1)]


def test_decontamination_types_tokens_whatever_else_the_text_holds(spark):
    item = "Which organelle makes most of the energy of a cell? A) Nucleus B) Mitochondrion C) Golgi apparatus D) Ribosome of Palade"
    first = "Alice reads and writes while her brother Tom sleeps all day long in the garden of Alice and of Tom."
    texts = [item + " The nucleus and the mitochondrion, golgi, ribosome, palade, apparatus.", item.lower(), item.upper(),
             "We met Alice there. " + first, first.lower(), first.replace("Alice", "Carol") + " They met Carol and said tom twice."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, first)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 1), (5, 1)}


def test_decontamination_judges_rows(spark):
    words = ITEM.split()
    pieces = [" ".join(words[:10]), "or so " * 4 + " ".join(words[10:])]
    texts = [(None, ITEM), (None, "clean text without an id"), (None, "another clean text"), (None, None), (5, ITEM), (5, "clean text of a repeated id"), (5, ITEM),
             (6, ITEM.replace("Alice", "Carol")), (6, ITEM), (9, pieces[0]), (9, pieces[1]), (1 << 60, ITEM), ((1 << 60) + 1, "clean")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    bench = spark.createDataFrame([(0, ITEM)], "item_id long, text string")
    kept = sorted((str(r.doc_id), str(r.text)) for r in decontaminate.clean(docs, bench).collect())
    bad = {ITEM, ITEM.replace("Alice", "Carol")}
    assert kept == sorted((str(i), str(t)) for i, t in texts if t not in bad)
    rows = {r.doc_id: r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(rows) == {None, 5, 6, 1 << 60} and all(r.exact for r in rows.values())


def test_decontamination_finds_every_whole_item(spark, docs):
    bench = spark.read.parquet(f"{SF001}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert {(d.doc_id, i) for d in docs.collect() for i, t in items if t in d.text} <= got


def test_long_texts_are_scanned_in_pieces(monkeypatch):
    text = "One two Three, 4.5 km! " * 50
    whole = decontaminate.scan(text)
    monkeypatch.setattr(decontaminate, "CHARS_AT_ONCE", 64)
    assert all((a == b).all() for a, b in zip(whole, decontaminate.scan(text), strict=True))


def test_licences(spark, docs, odd, none):
    found = {r.doc_id: r for r in licences.scan(docs).collect()}
    for r in docs.collect():
        for line, family in (("Released under the MIT License.", "mit"), ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
                             ("Licensed under the Apache License, Version 2.0.", "apache-2.0"),
                             ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0")):
            if line in r.text.split("\n"):
                assert family in (found[r.doc_id].families or ""), (r.doc_id, family)
    plain = [r.doc_id for r in docs.collect() if not any(w in r.text.lower() for w in ("licen", "rights", "released"))]
    assert np.mean([found[i].families is not None for i in plain]) < 0.01
    rows = licences.scan(odd).collect()
    assert len(rows) == len(ROWS) and all(r.n_known == 0 for r in rows if r.doc_id in (2, 3, 4))
    assert licences.scan(none).count() == 0


def test_licences_wrapped_identified_and_by_row(spark, docs):
    plain = [r.text for r in docs.collect() if not any(w in r.text.lower() for w in ("licen", "rights", "released"))]
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the\nfollowing conditions are met."
    gpl = "You can redistribute it and modify it under the terms of the GNU General\nPublic License, either version 3 of the License,\nor any later version."
    long = (plain[0] + "\n") * 40
    texts = [(1, bsd), (2, plain[1] + "\n" + gpl + "\n" + plain[2]), (3, "SPDX-License-Identifier: MIT\n\nint main() { return 0; }"),
             (4, "SPDX-License-Identifier: Apache-2.0"), (None, "Released under the MIT License."), (None, plain[3]), (5, plain[4]),
             (5, "Licensed under the Apache License, Version 2.0."), (5, plain[4]), (6, long + gpl + "\n" + long), (7, None), (8, "")]
    base = docs.select("doc_id", "text").where(~F.col("text").rlike("(?i)licen|rights|released"))
    mine = spark.createDataFrame([(None if i is None else i + 10**9, t) for i, t in texts], "doc_id long, text string")
    got = licences.scan(base.unionByName(mine)).where("doc_id is null or doc_id > 1000000000").collect()
    at = lambda i: sorted((r.families or "") for r in got if r.doc_id == (None if i is None else i + 10**9))
    assert at(1) == ["bsd-3-clause"] and at(2) == ["gpl-3.0"] and at(3) == ["mit"] and at(4) == ["apache-2.0"]
    assert at(None) == ["", "mit"] and at(5) == ["", "", "apache-2.0"] and at(6) == ["gpl-3.0"] and at(7) == [""] and at(8) == [""]
    assert len(got) == len(texts)


def test_licence_model_is_fit_on_every_piece(spark, docs, monkeypatch):
    seen, fit = [], licences.LogisticRegression.fit
    monkeypatch.setattr(licences.LogisticRegression, "fit", lambda self, df: seen.append(df.select("label", "weight").toPandas()) or fit(self, df))
    many = docs.select("doc_id", "text").crossJoin(spark.range(4)).select(F.col("doc_id") + F.col("id") * 10**6, "text").toDF("doc_id", "text")
    held = F.filter(licences.pairs(F.col("words")), lambda p: p.isin(licences.VOCABULARY)).alias("grams")
    pieces = licences.paragraphs(many, "doc_id", "text").select("id", "key", "at", held).localCheckpoint()
    assert pieces.count() > 4000  # at most 2,000 were drawn before
    model, names, least = licences.fit(pieces)
    plain = pieces.where(F.greatest(*[licences.contained(F.col("grams"), t) for _, t in licences.notices()]) < 0.5)
    mine = licences.likelihoods(model, plain.where(F.pmod(F.xxhash64("id", "key", "at"), F.lit(2)) == 1))
    like = [round(1 - r.p[names.index("none")], 6) for r in mine.collect()]
    assert least == pytest.approx(max(0.5, np.percentile(like, 100 - 100 * licences.FALSE_SHARE)), abs=1e-6)
    weight = seen[0].groupby("label")["weight"].sum()
    assert weight[names.index("none")] == pytest.approx(licences.ORDINARY)
    assert weight[names.index("mit")] == pytest.approx(len(licences.NOTICES["mit"]) * licences.MIXED * 1.25)


def test_lm_scores_equal_brute_force(spark, odd, none):
    texts = [(1, "a b a b c"), (2, "a b"), (3, "c c d"), (4, None), (5, ""), (5, "b a"), (None, "a a")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    good = spark.createDataFrame([(1,), (1,), (None,), (9,)], "doc_id long")
    rows = lm_scores.cross_entropy_difference(docs, good).collect()
    vocabulary = {w: i + 1 for i, w in enumerate("abcd")}
    n = len(vocabulary) + 1  # and one unseen word, number 0
    counts = np.zeros((2, n + 1, n))
    for i, t in texts:
        ids = [n, *[vocabulary[w] for w in (t or "").split()]]
        for h, w in zip(ids, ids[1:], strict=False):
            counts[0 if i == 1 else 1, h, w] += 1
    tables = [lm_scores.losses(c) for c in counts]
    assert np.allclose(np.exp(-tables[0]).sum(axis=1), 1)
    for r, (_, t) in zip(sorted(rows, key=lambda r: (str(r.doc_id), r.n_words)), sorted(texts, key=lambda t: (str(t[0]), len(t[1] or ""))), strict=True):
        ids = [n, *[vocabulary[w] for w in (t or "").split()]]
        want = [sum(x[h, w] for h, w in zip(ids, ids[1:], strict=False)) / max(1, len(ids) - 1) for x in tables]
        assert (r.n_words, r.target_loss, r.score) == (len(ids) - 1, pytest.approx(want[0], abs=1e-5), pytest.approx(want[0] - want[1], abs=1e-5))
    assert lm_scores.cross_entropy_difference(odd, good).count() == len(ROWS)
    assert lm_scores.cross_entropy_difference(none, good).count() == 0


@pytest.mark.parametrize(("hot", "bits"), [(4, 64), (50, 1 << 12), (lm_scores.HOT, lm_scores.FILTER)])
def test_lm_scores_know_every_word(spark, hot, bits):
    rng = np.random.default_rng(5)
    texts = [(i, " ".join(["the", *(f"w{j}" for j in rng.zipf(1.2, 60) % 5000), f"only{i}", f"x{i}y", "the"])) for i in range(120)]
    texts += [(500, "the same text but for alpha"), (501, "the same text but for omega"), (1, "alpha alpha once"), (None, None), (None, "omega")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    rows = lm_scores.cross_entropy_difference(docs, spark.createDataFrame([(i,) for i in range(0, 120, 3)] + [(1,)], "doc_id long"), hot=hot,
                                              filter_bits=bits).collect()
    marked = {1, *range(0, 120, 3)}
    words = {w for _, t in texts for w in (t or "").split()}
    v = len(words) + 1
    pair, single, before = ([{}, {}] for _ in range(3))
    for i, t in texts:
        side, ws = int(i not in marked), ["", *(t or "").split()]
        for h, w in zip(ws, ws[1:], strict=False):
            for held, k in ((pair, (h, w)), (single, w), (before, h)):
                held[side][k] = held[side].get(k, 0) + 1

    def loss(side, h, w):
        p = (single[side].get(w, 0) + 1) / (sum(single[side].values()) + v)
        return -np.log((pair[side].get((h, w), 0) + lm_scores.MU * p) / (before[side].get(h, 0) + lm_scores.MU))

    want = []
    for i, t in texts:
        ws = ["", *(t or "").split()]
        n = max(1, len(ws) - 1)
        want.append((str(i), len(ws) - 1, *(sum(loss(s, h, w) for h, w in zip(ws, ws[1:], strict=False)) / n for s in (0, 1))))
    got = sorted((str(r.doc_id), r.n_words, r.target_loss, r.background_loss) for r in rows)
    assert [g[:2] for g in got] == [x[:2] for x in sorted(want)] and np.allclose([g[2:] for g in got], [x[2:] for x in sorted(want)], atol=1e-9)
    by = {r.doc_id: r.score for r in rows}
    assert by[500] < by[501]  # a rare word of the target tells two texts apart


def test_lm_scores_by_small_batches_and_short_questions(spark):
    rng = np.random.default_rng(6)
    texts = [(i, " ".join(f"w{j}" for j in rng.integers(0, 3000, 400))) for i in range(60)] + [(60, "w1 " * 3000), (61, "..."), (62, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    good = spark.createDataFrame([(i,) for i in range(0, 63, 2)], "doc_id long")
    got, want = (sorted(map(tuple, lm_scores.cross_entropy_difference(docs, good, **how).collect()))
                 for how in ({"batch": 5000, "bucket": 500}, {}))
    assert len(got) == len(texts) and [g[:2] for g in got] == [w[:2] for w in want] and np.allclose(got, want, atol=1e-12)
    known = lm_scores.packed(docs.select(F.col("doc_id").alias("id"), "text")).withColumn("target", F.col("id") % 2 == 0)
    batches = lm_scores.batched(known, 1 << 20)
    asked = lm_scores.questions(batches, 1).agg(F.sum("n_pairs"), F.sum("n_words"), F.sum(F.length("body"))).first()
    assert asked[0] > 20_000 and asked[2] < 9 * (asked[0] + asked[1])  # a row of a pair took 14 bytes compressed
    totals = lm_scores.answers(lm_scores.questions(batches, 3)).agg(F.sum("all_t"), F.sum("all_b"), F.sum("types")).first()
    words = [w for i, t in texts for w in [(i % 2 == 0, w) for w in (t or "").replace(".", "").split()]]
    assert tuple(totals) == (sum(k for k, _ in words), sum(not k for k, _ in words), len({w for _, w in words}))


def test_lm_scores_batch_takes_little_memory(monkeypatch):
    import tracemalloc

    import pyarrow as pa
    texts = [" ".join(f"w{(i * 7919 + j * j) % 3001}" for j in range(20_000)).encode() for i in range(20)] + [b"%%%"]
    args = sum(map(len, texts)), list(map(len, texts)), pa.compress(b"".join(texts), "zstd", asbytes=True)
    tracemalloc.start()
    own = lm_scores.Batch(lm_scores.Words(), *args)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 75 * len(own.w)  # 95 bytes a word before, 45 after
    want, at = np.unique(own.pairs, return_inverse=True)
    n_pairs, numbers = own.pair_numbers()
    assert n_pairs == len(want) and numbers.tolist() == at.tolist()
    word, before, pairs = np.arange(own.size) + 1.0, np.arange(own.size) + 9.0, np.arange(n_pairs) % 9
    whole = own.losses(word, before, pairs, numbers, 10**6)
    monkeypatch.setattr(lm_scores, "SLICE", 1000)
    assert own.losses(word, before, pairs, numbers, 10**6).tolist() == whole.tolist()


def test_sharding_query_equals_its_sql(spark):
    import duckdb
    from roilens.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF0001}/documents.parquet'")
    want = con.sql(ORACLES["op1_sharding"]).df()
    got = QUERIES["op1_sharding"](spark, SF0001).toPandas()[list(want.columns)]
    key = ["doc_id", "slot"]
    assert got.sort_values(key).values.tolist() == want.sort_values(key).values.tolist()
