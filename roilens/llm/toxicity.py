"""Toxicity scores from a bidirectional gated recurrent network.

A text is lower-cased and cut into words (letters and digits; a run of more than
``WORD_BYTES`` bytes, as in scripts without spaces, into pieces of that size that
overlap by half and count as words, in training and scoring alike). A word enters
the network by two embeddings side by side: one of the word itself (words of the
training sample; all others share one row) and the mean over its hashed
character trigrams. Windows of ``WINDOW`` words that overlap by half run through
a forward and a backward gated recurrent unit; attention weights over both
units' states pool each window into one vector and a logistic unit scores it. A
text's logit is that of its highest window, put on a probability scale by a
logistic fit (which also sees the logarithm of the number of windows, as the
maximum of many grows).

The network is trained in numpy by Adam on a bounded sample: at most
``TRAIN_ROWS`` clean and toxic texts with at most ``TRAIN_CHARS`` characters (those whose key hash is smallest; longer texts are left out of the
training sample, not of the scoring). A label holds for a text, not for each of
its windows, so in each epoch a toxic text teaches by its highest window alone,
and a clean one by its highest and by one drawn at random.

Defined results: a null or word-free text scores 0; with no labelled row of one
of the classes every text scores the share of toxic labels (0 without labels);
repeated rows score alike; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_hash

WORDS = re.compile(r"[^\W_]+")
WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, TRIGRAMS, ATTENTION = 8, 8, 8, 4096, 8
TRAIN_ROWS, TRAIN_CHARS, EPOCHS, LEAST_STEPS, BATCH, LEAST_COUNT = (3600, 1200), 4000, 12, 400, 128, 4
WORDS_AT_ONCE, BLOCK, TYPES_AT_ONCE, WORD_BYTES = 1 << 17, 1024, 60_000, 64
THRESHOLD = 0.3
DECAY = 0.3


@dataclass
class Model:
    """Weights. ``w``: arrays by name; ``vocabulary``: word -> row (0: any other word)."""

    vocabulary: dict[str, int]
    w: dict[str, np.ndarray]
    scale: tuple[float, float, float] = (1.0, 0.0, 0.0)
    constant: float | None = None
    rows: dict[str, int] = field(default_factory=dict)
    table: np.ndarray | None = None
    done: int = 0


def pieces(word: str) -> list[str]:
    """A word in pieces of at most WORD_BYTES bytes that overlap by about half: any part of half that size is whole in one."""
    sizes = [len(c.encode("utf-8", "replace")) for c in word]
    ends = list(itertools.accumulate(sizes, initial=0))
    out, start = [], 0
    while True:
        stop = bisect.bisect_right(ends, ends[start] + WORD_BYTES) - 1
        out.append(word[start:stop])
        if stop == len(word):
            return out
        start = bisect.bisect_right(ends, ends[start] + WORD_BYTES // 2) - 1


def tokenize(text: str | None) -> list[str]:
    words = WORDS.findall(text.lower()) if text else []
    if max(map(len, words), default=0) * 4 <= WORD_BYTES:  # 4 bytes a character at most
        return words
    return [p for w in words for p in (pieces(w) if len(w) * 4 > WORD_BYTES else (w,))]


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of all words, and where each word's begin."""
    data = [b"^" + w.encode("utf-8", "replace") + b"$" for w in words]
    flat = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    counts = sizes - 2
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    at = np.arange(counts.sum()) + 2 * np.repeat(np.arange(len(data)), counts)
    return (flat[at] * 961 + flat[at + 1] * 31 + flat[at + 2]) * 2654435761 % (1 << 31) % TRIGRAMS, starts


def inputs(m: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, WORD_DIM + CHAR_DIM) input vectors; word rows, trigrams and their starts for training."""
    rows = np.array([m.vocabulary.get(w, 0) for w in words], dtype=np.int64)
    grams, starts = trigrams(words)
    chars = np.add.reduceat(m.w["chars"][grams], starts, axis=0)
    counts = np.diff(np.append(starts, len(grams)))
    return np.concatenate([m.w["words"][rows], chars / counts[:, None].astype(np.float32)], axis=1), rows, grams, starts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _unit(p: np.ndarray, live: np.ndarray, u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list]:
    """Gated recurrent unit over p (steps, rows, 3 * HIDDEN); states (steps, rows, HIDDEN)."""
    steps, rows, _ = p.shape
    h = np.zeros((rows, HIDDEN), dtype=np.float32)
    out, kept = np.empty((steps, rows, HIDDEN), dtype=np.float32), []
    for t in range(steps):
        hu = h @ u
        gates = _sigmoid(p[t, :, :2 * HIDDEN] + hu[:, :2 * HIDDEN])
        r, z = gates[:, :HIDDEN], gates[:, HIDDEN:]
        own = hu[:, 2 * HIDDEN:] + c
        n = np.tanh(p[t, :, 2 * HIDDEN:] + r * own)
        new = n + z * (h - n)
        new = np.where(live[t, :, None], new, h)
        kept.append((h, r, z, own, n))
        out[t] = h = new
    return out, kept


def _unit_back(d_out: np.ndarray, live: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of p, u and c."""
    steps, rows, _ = d_out.shape
    d_p = np.zeros((steps, rows, 3 * HIDDEN), dtype=np.float32)
    d_u, d_c, d_h = np.zeros_like(u), np.zeros(HIDDEN, dtype=np.float32), np.zeros((rows, HIDDEN), dtype=np.float32)
    for t in reversed(range(steps)):
        h, r, z, own, n = kept[t]
        d_new = d_out[t] + d_h
        on = live[t, :, None]
        d_n = np.where(on, d_new * (1 - z), 0) * (1 - n * n)
        d_z = np.where(on, d_new * (h - n), 0) * z * (1 - z)
        d_own = d_n * r
        d_r = d_n * own * r * (1 - r)
        d_hu = np.concatenate([d_r, d_z, d_own], axis=1)
        d_p[t] = np.concatenate([d_r, d_z, d_n], axis=1)
        d_u += h.T @ d_hu
        d_c += d_own.sum(axis=0)
        d_h = np.where(on, d_new * z, d_new) + d_hu @ u.T
    return d_p, d_u, d_c


def network(w: dict[str, np.ndarray], pf: np.ndarray, pb: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, dict]:
    """Logits of windows from their projected inputs (steps, rows, 3 * HIDDEN) in reading order."""
    forth, kept_f = _unit(pf, live, w["uf"], w["cf"])
    back, kept_b = _unit(pb[::-1], live[::-1], w["ub"], w["cb"])
    states = np.concatenate([forth, back[::-1]], axis=2)
    seen = np.tanh(states @ w["wa"] + w["ba"])
    score = np.where(live, seen @ w["va"], -1e9)
    share = np.exp(score - score.max(axis=0))
    share /= share.sum(axis=0)
    pooled = (states * share[:, :, None]).sum(axis=0)
    return pooled @ w["out"] + w["bias"][0], {"states": states, "seen": seen, "share": share, "pooled": pooled, "f": kept_f, "b": kept_b}


def project(m: Model, x: np.ndarray) -> np.ndarray:
    """Both units' input projections side by side."""
    return np.concatenate([x @ m.w["xf"] + m.w["bf"], x @ m.w["xb"] + m.w["bb"]], axis=1)


def window_starts(n: int) -> list[int]:
    """Starts of windows that overlap by WINDOW - STRIDE and cover all n words."""
    return list(range(0, max(1, n - (WINDOW - STRIDE)), STRIDE))


def window_rows(ids: list[int]) -> np.ndarray:
    """(windows, WINDOW) of word rows, -1 where there is none."""
    n = len(ids)
    starts = np.array(window_starts(n))
    padded = np.full(starts[-1] + WINDOW, -1, dtype=np.int64)
    padded[:n] = ids
    return padded[starts[:, None] + np.arange(WINDOW)]


def _run(p: np.ndarray, rows: np.ndarray, u: np.ndarray, c: np.ndarray, out: np.ndarray, order: range) -> None:
    """The unit without what training keeps: states for word rows (steps, rows), in place and in single precision.
    ``p`` and ``u`` have the gates' part negated, as the logistic function wants it."""
    h = np.zeros((rows.shape[1], HIDDEN), dtype=np.float32)
    u_gates, u_own = np.ascontiguousarray(u[:, :2 * HIDDEN]), np.ascontiguousarray(u[:, 2 * HIDDEN:])
    for t in order:
        at = rows[t]
        x = p[at]
        g = h @ u_gates
        g += x[:, :2 * HIDDEN]
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        own = h @ u_own
        own += c
        own *= g[:, :HIDDEN]
        own += x[:, 2 * HIDDEN:]
        np.tanh(own, out=own)
        new = h - own
        new *= g[:, HIDDEN:]
        new += own
        gone = at < 0
        if gone.any():
            new[gone] = h[gone]
        out[t] = h = new


def window_logits(m: Model, table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Logits of windows given as rows of ``table`` (see ``project``); as ``network``, but faster."""
    out = np.empty(len(rows), dtype=np.float64)
    sign = np.repeat(np.array([-1, 1], dtype=np.float32), [2 * HIDDEN, HIDDEN])
    pf, pb = np.ascontiguousarray(table[:, :3 * HIDDEN] * sign), np.ascontiguousarray(table[:, 3 * HIDDEN:] * sign)
    with np.errstate(over="ignore"):
        for i in range(0, len(rows), BLOCK):
            some = np.ascontiguousarray(rows[i:i + BLOCK].T)
            states = np.empty((2, *some.shape, HIDDEN), dtype=np.float32)
            _run(pf, some, m.w["uf"] * sign, m.w["cf"], states[0], range(WINDOW))
            _run(pb, some, m.w["ub"] * sign, m.w["cb"], states[1], range(WINDOW - 1, -1, -1))
            seen = states[0] @ m.w["wa"][:HIDDEN]
            seen += states[1] @ m.w["wa"][HIDDEN:]
            seen += m.w["ba"]
            share = np.tanh(seen, out=seen) @ m.w["va"]
            share[some < 0] = -np.inf
            share -= share.max(axis=0)
            np.exp(share, out=share)
            value = states[0] @ m.w["out"][:HIDDEN]
            value += states[1] @ m.w["out"][HIDDEN:]
            out[i:i + BLOCK] = (share * value).sum(axis=0) / share.sum(axis=0) + m.w["bias"][0]
    return out


def _start(vocabulary: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    x, h = WORD_DIM + CHAR_DIM, HIDDEN
    shapes = {"words": (vocabulary + 1, WORD_DIM), "chars": (TRIGRAMS, CHAR_DIM), "xf": (x, 3 * h), "xb": (x, 3 * h),
              "uf": (h, 3 * h), "ub": (h, 3 * h), "wa": (2 * h, ATTENTION), "va": (ATTENTION,), "out": (2 * h,)}
    spread = {"words": 0.3, "chars": 0.3}
    w = {k: (rng.standard_normal(s) * spread.get(k, s[0] ** -0.5)).astype(np.float32) for k, s in shapes.items()}
    return w | {k: np.zeros(n, np.float32) for k, n in {"bf": 3 * h, "bb": 3 * h, "cf": h, "cb": h, "ba": ATTENTION, "bias": 1}.items()}


def gradients(m: Model, words: list[str], rows: np.ndarray, y: np.ndarray, drop: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean logistic loss of windows ``rows`` (into ``words``); ``drop`` hides words' own rows."""
    w = m.w
    x, own, grams, starts = inputs(m, words)
    own = np.where(drop, 0, own)
    x[:, :WORD_DIM] = w["words"][own]
    some, live = rows.T, rows.T >= 0
    at = np.maximum(some, 0)
    pf, pb = (x @ w["xf"] + w["bf"])[at], (x @ w["xb"] + w["bb"])[at]
    logit, k = network(w, pf, pb, live)
    d = ((_sigmoid(logit) - y) / len(y)).astype(np.float32)
    g = {"out": k["pooled"].T @ d, "bias": np.array([d.sum()], dtype=np.float32)}
    d_pool = d[:, None] * w["out"]
    d_share = (k["states"] * d_pool).sum(axis=2)
    d_states = k["share"][:, :, None] * d_pool
    d_score = k["share"] * (d_share - (d_share * k["share"]).sum(axis=0))
    d_seen = d_score[:, :, None] * w["va"] * (1 - k["seen"] ** 2)
    g["va"] = (k["seen"] * d_score[:, :, None]).sum(axis=(0, 1))
    g["wa"] = np.einsum("trh,tra->ha", k["states"], d_seen, optimize=True)
    g["ba"] = d_seen.sum(axis=(0, 1))
    d_states = d_states + d_seen @ w["wa"].T
    d_pf, g["uf"], g["cf"] = _unit_back(d_states[:, :, :HIDDEN], live, w["uf"], k["f"])
    d_pb, g["ub"], g["cb"] = _unit_back(d_states[::-1, :, HIDDEN:], live[::-1], w["ub"], k["b"])
    d_pb = d_pb[::-1]
    d_word = {}
    for side, d_p in (("f", d_pf), ("b", d_pb)):  # a word's gradient is summed over its places first
        total = np.zeros((len(words), 3 * HIDDEN), dtype=np.float32)
        np.add.at(total, at[live], d_p[live])
        g[f"x{side}"], g[f"b{side}"], d_word[side] = x.T @ total, total.sum(axis=0), total @ w[f"x{side}"].T
    d_x = d_word["f"] + d_word["b"]
    g["words"], g["chars"] = np.zeros_like(w["words"]), np.zeros_like(w["chars"])
    np.add.at(g["words"], own, d_x[:, :WORD_DIM])
    counts = np.diff(np.append(starts, len(grams)))
    np.add.at(g["chars"], grams, np.repeat(d_x[:, WORD_DIM:] / counts[:, None].astype(np.float32), counts, axis=0))
    return g


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> Model:
    """Fit the network on labelled texts."""
    rng = np.random.default_rng(seed)
    y = np.array(labels, dtype=np.float32)
    held = [tokenize(t) for t in texts]
    keep = [i for i, ws in enumerate(held) if ws]
    held, y = [held[i] for i in keep], y[keep]
    if not len(y) or y.min() == y.max():
        return Model({}, _start(0, rng), constant=float(np.mean(labels)) if len(labels) else 0.0)
    types: dict[str, int] = {}
    seen: dict[str, int] = {}
    ids = []
    for ws in held:
        ids.append([types.setdefault(x, len(types)) for x in ws])
        for x in set(ws):
            seen[x] = seen.get(x, 0) + 1
    words = list(types)
    common = [x for x in words if seen[x] >= LEAST_COUNT]
    m = Model({x: i + 1 for i, x in enumerate(common)}, _start(len(common), rng))
    # a word's first input begins as the smoothed log odds of its texts being toxic: with few labels the first choice
    # of a highest window would otherwise be left to chance
    texts_with = np.zeros((len(common), 2))
    for ws, label in zip(held, y, strict=True):
        for x in set(ws) & m.vocabulary.keys():
            texts_with[m.vocabulary[x] - 1, int(label)] += 1
    odds = np.log((texts_with + 0.5) / (np.bincount(y.astype(int), minlength=2) + 1))
    m.w["words"][1:, 0] = np.clip(odds[:, 1] - odds[:, 0], -3, 3) / 2
    parts = [window_rows(x) for x in ids]
    rows, owner = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    first = np.concatenate([[0], np.cumsum([len(p) for p in parts])[:-1]])
    sizes = np.array([len(p) for p in parts])
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in m.w.items()}
    toxic, step = y > 0, 0
    epochs = max(epochs, min(4 * epochs, LEAST_STEPS * BATCH // (2 * len(parts))))  # few texts are read more often
    m.w["bias"][0] = -1.0

    def highest() -> tuple[np.ndarray, np.ndarray]:
        logit = window_logits(m, project(m, inputs(m, words)[0]), rows)
        order = np.lexsort((logit, owner))
        best = order[np.append(first[1:], len(rows)) - 1]
        return best, logit[best]

    for epoch in range(epochs):
        if epoch < 2:  # before it knows anything: any window of a text may be the one
            picks = np.concatenate([first + (rng.random(len(first)) * sizes).astype(int) for _ in range(3)])
        else:
            best, _ = highest()
            clean = np.flatnonzero(~toxic)
            picks = np.concatenate([best, best[toxic], first[clean] + (rng.random(len(clean)) * sizes[clean]).astype(int)])
        picks = rng.permutation(picks)
        for i in range(0, len(picks), BATCH):
            some = picks[i:i + BATCH]
            own, local = np.unique(rows[some], return_inverse=True)
            local = local.reshape(len(some), WINDOW) - int(own[0] < 0)
            own = own[own >= 0]
            g = gradients(m, [words[j] for j in own], local, y[owner[some]], rng.random(len(own)) < 0.15)
            step += 1
            rate = 0.01 if epoch < epochs - 4 else 0.003
            for k, v in g.items():
                a, b = state[k]
                v = np.clip(v, -1, 1)
                a += 0.1 * (v - a)
                b += 0.001 * (v * v - b)
                m.w[k] -= rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
            for k in ("words", "chars"):  # what is seen once should not be learned by heart
                m.w[k] *= 1 - DECAY * rate
    _, top = highest()
    m.scale = _calibrate(np.stack([top, np.log(sizes), np.ones(len(top))], axis=1), y)
    return m


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Logistic fit by Newton steps with a small ridge."""
    a = np.array([1.0, 0.0, 0.0])
    ridge = np.diag([0.02, 0.02, 1e-6]) * len(y)
    for _ in range(25):
        p = _sigmoid(x @ a)
        a = a - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(3),
                                x.T @ (p - y) + ridge @ (a - np.array([1.0, 0.0, 0.0])))
    return (max(float(a[0]), 1e-3), float(a[1]), float(a[2]))  # a higher window never lowers a score


class _Rows(dict):
    """Word -> row; a word that is asked for the first time gets the next row."""

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        return row


def score(m: Model, texts: list[str | None]) -> np.ndarray:
    """Probabilities of whole texts, all their windows counted."""
    out = np.zeros(len(texts))
    if m.constant is not None:
        return np.array([m.constant if tokenize(t) else 0.0 for t in texts])
    group: list[tuple[int, np.ndarray]] = []
    size = 0

    def finish() -> None:
        if not group:
            return
        done, wanted = m.done, len(m.rows)
        if wanted > len(m.table):
            m.table = np.concatenate([m.table[:done], np.zeros((wanted + wanted // 2 - done, 6 * HIDDEN), dtype=np.float32)])
        if wanted > done:
            m.table[done:wanted] = project(m, inputs(m, list(itertools.islice(m.rows, done, None)))[0])
        m.done = wanted
        logit = window_logits(m, m.table[:wanted], np.concatenate([x for _, x in group]))
        counts = np.array([len(x) for _, x in group])
        top = np.maximum.reduceat(logit, np.concatenate([[0], np.cumsum(counts)[:-1]]))
        a, b, c = m.scale
        out[[i for i, _ in group]] = _sigmoid(a * top + b * np.log(counts) + c)
        group.clear()

    for i, text in enumerate(texts):
        words = tokenize(text)
        if not words:
            continue
        if not group and (m.table is None or len(m.rows) > TYPES_AT_ONCE):  # what a worker knows by word stays bounded
            m.rows, m.table, m.done = _Rows(), np.zeros((0, 6 * HIDDEN), dtype=np.float32), 0
        group.append((i, window_rows(list(map(m.rows.__getitem__, words)))))
        size += len(words)
        if size >= WORDS_AT_ONCE:
            finish()
            size = 0
    finish()
    return out


def fit(labelled: DataFrame, key_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        rows: tuple[int, int] = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Train on a bounded sample of ``labelled``: at most ``rows[k]`` texts of label k, of at most ``chars``
    characters each, reach the driver."""
    known = labelled.where(F.col(label_col).isin(0, 1) & (F.char_length(text_col) <= chars))
    parts = [by_hash(known.where(F.col(label_col) == k), F.col(key_col), rows[k]) for k in (0, 1)]
    sample = parts[0].unionByName(parts[1]).select(
        F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.xxhash64(key_col).alias("h"))
    sample = sample.toPandas().sort_values(["h", "label", "text"], kind="stable")
    return train(sample["text"].tolist(), sample["label"].tolist())


def toxicity(spark: SparkSession, model: Model, text: Column) -> Column:
    """The score of a text column; the model is bounded by the sample and broadcast."""
    shared = spark.sparkContext.broadcast((model.vocabulary, model.w, model.scale, model.constant))

    @F.pandas_udf("double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for part in parts:
            yield pd.Series(score(own, list(part)))

    return judge(text)


def rate(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, score, predicted (1 if score >= THRESHOLD)."""
    found = docs.select(F.col(id_col), toxicity(docs.sparkSession, model, F.col(text_col)).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
