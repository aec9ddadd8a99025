"""Language identification by a byte convolutional network.

A text is lower-cased, runs of non-letters become one space, and its UTF-8 bytes
are cut into windows of ``WINDOW`` bytes (the last one is shorter and padded
with byte 0). Each byte has a small embedding; filters of widths 2 to 5 slide
over it, are rectified and max-pooled over the window, and a softmax layer gives
the language probabilities of the window. A text's probabilities are the means
over all its windows, weighted by their bytes. The network is trained in numpy
by Adam on a bounded sample: ``TRAIN_ROWS`` labelled rows (those whose key hash
is smallest), from each at most ``TRAIN_CHARS`` characters at a place that the
hash picks.

Defined results: a null text or one without letters is ``und`` with score 0; if
no labelled row has a language every text is ``und``; equal probabilities go to
the alphabetically first language; repeated rows are judged alike; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_hash

WINDOW, EMBEDDING, FILTERS, WIDTHS = 256, 8, 10, (2, 3, 4, 5)
TRAIN_ROWS, TRAIN_CHARS, EPOCHS, BATCH = 3000, 1024, 6, 64
WINDOWS_AT_ONCE = 32
UNKNOWN = "und"
NOT_LETTERS = regex.compile(r"\P{L}+")


@dataclass
class Model:
    """Weights; ``langs`` in alphabetical order."""

    langs: list[str]
    bytes_: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def letters(text: str | None) -> bytes:
    """The lower-cased text with runs of non-letters as one space; empty if it has no letter."""
    if not text:
        return b""
    return NOT_LETTERS.sub(" ", text.lower()).strip().encode("utf-8", "replace")


def windows(data: bytes) -> np.ndarray:
    """All of ``data`` in rows of WINDOW bytes."""
    rows = -(-len(data) // WINDOW)
    out = np.zeros(rows * WINDOW, dtype=np.uint8)
    out[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(rows, WINDOW)


def _patches(embedded: np.ndarray) -> np.ndarray:
    """(rows, WINDOW, widest, EMBEDDING): each byte with those that follow it, zeros past the end."""
    rows = len(embedded)
    padded = np.zeros((rows, WINDOW + WIDTHS[-1] - 1, EMBEDDING), dtype=np.float32)
    padded[:, :WINDOW] = embedded
    return np.lib.stride_tricks.sliding_window_view(padded, WIDTHS[-1], axis=1).transpose(0, 1, 3, 2)


def _mask() -> np.ndarray:
    """Which of the widest filter's places each filter uses."""
    mask = np.zeros((WIDTHS[-1], EMBEDDING, len(WIDTHS) * FILTERS), dtype=np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width, :, k * FILTERS:(k + 1) * FILTERS] = 1
    return mask.reshape(WIDTHS[-1] * EMBEDDING, -1)


def forward(m: Model, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Probabilities of the windows ``x``, and what training needs."""
    patches = _patches(m.bytes_[x]).reshape(-1, WIDTHS[-1] * EMBEDDING)
    conv = (patches @ m.filters).reshape(len(x), WINDOW, -1)
    top = conv.argmax(axis=1)
    pooled = np.maximum(np.take_along_axis(conv, top[:, None], axis=1)[:, 0] + m.bias, 0)
    logits = pooled @ m.out + m.out_bias
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True), pooled, top, patches


def probabilities(m: Model, x: np.ndarray) -> np.ndarray:
    """Probabilities of the windows ``x``, in blocks; training's bookkeeping is left out."""
    out = np.empty((len(x), len(m.langs)), dtype=np.float64)
    for i in range(0, len(x), WINDOWS_AT_ONCE):
        some = x[i:i + WINDOWS_AT_ONCE]
        conv = (_patches(m.bytes_[some]).reshape(-1, WIDTHS[-1] * EMBEDDING) @ m.filters).reshape(len(some), WINDOW, -1)
        logits = np.maximum(conv.max(axis=1) + m.bias, 0) @ m.out + m.out_bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        out[i:i + WINDOWS_AT_ONCE] = p / p.sum(axis=1, keepdims=True)
    return out


def train(texts: list[str], langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Fit the network on (text, language) pairs."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    code = {k: i for i, k in enumerate(names)}
    xs, ys = [], []
    for text, lang in zip(texts, langs, strict=True):
        w = windows(letters(text))
        xs.append(w)
        ys += [code[lang]] * len(w)
    x, y = (np.concatenate(xs) if xs else np.zeros((0, WINDOW), np.uint8)), np.array(ys, dtype=np.int64)
    scale = lambda *shape, by: (rng.standard_normal(shape) * by).astype(np.float32)
    wide, total, mask = WIDTHS[-1] * EMBEDDING, len(WIDTHS) * FILTERS, _mask()
    m = Model(names, scale(256, EMBEDDING, by=0.5), scale(wide, total, by=0.3) * mask, np.zeros(total, np.float32),
              scale(total, len(names), by=0.2), np.zeros(len(names), np.float32))
    m.bytes_[0] = 0
    state = {k: [np.zeros_like(getattr(m, k)), np.zeros_like(getattr(m, k))] for k in ("bytes_", "filters", "bias", "out", "out_bias")}
    step = 0
    for _ in range(epochs if len(names) > 1 else 0):
        order = rng.permutation(len(x))
        for i in range(0, len(order), BATCH):
            rows = order[i:i + BATCH]
            batch = x[rows].copy()
            for r in np.flatnonzero(rng.random(len(batch)) < 0.3):  # short texts must be known too
                batch[r, rng.integers(4, 64):] = 0
            p, pooled, top, patches = forward(m, batch)
            d = p.astype(np.float32)
            d[np.arange(len(d)), y[rows]] -= 1
            d /= len(d)
            g_out, g_out_bias = pooled.T @ d, d.sum(axis=0)
            d_pool = (d @ m.out.T) * (pooled > 0)
            at = (np.arange(len(batch))[:, None] * WINDOW + top)  # (rows, filters): the patch that won
            won = patches[at.ravel()].reshape(len(batch), total, wide)
            g_filters = np.einsum("bfw,bf->wf", won, d_pool) * mask
            d_patch = (d_pool[:, :, None] * m.filters.T[None]).reshape(-1, WIDTHS[-1], EMBEDDING)
            place = top.ravel()[:, None] + np.arange(WIDTHS[-1])
            inside = place < WINDOW
            row = np.repeat(np.arange(len(batch)), total)[:, None]
            used = batch[row, np.minimum(place, WINDOW - 1)]
            g_bytes = np.zeros_like(m.bytes_)
            np.add.at(g_bytes, used[inside], d_patch[inside])
            g_bytes[0] = 0
            step += 1
            for k, g in (("bytes_", g_bytes), ("filters", g_filters), ("bias", d_pool.sum(axis=0)), ("out", g_out), ("out_bias", g_out_bias)):
                a, b = state[k]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                getattr(m, k)[...] -= 0.004 * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.999 ** step)) + 1e-8)
    return m


def predict(m: Model, texts: Iterator[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text."""
    held = [letters(t) for t in texts]
    langs, scores = [UNKNOWN] * len(held), [0.0] * len(held)
    group, size = [], 0
    for i, data in enumerate(held):
        if data and m.langs:
            group.append(i)
            size += len(data)
        if group and (size >= 1 << 20 or i == len(held) - 1):
            parts = [windows(held[g]) for g in group]
            p = probabilities(m, np.concatenate(parts))
            at = 0
            for g, part in zip(group, parts, strict=True):
                weight = np.full(len(part), WINDOW, dtype=np.float64)
                weight[-1] = len(held[g]) - WINDOW * (len(part) - 1)
                mean = (p[at:at + len(part)] * weight[:, None]).sum(axis=0) / weight.sum()
                at += len(part)
                best = int(mean.argmax())
                langs[g], scores[g] = m.langs[best], float(min(1.0, max(0.0, mean[best])))
            group, size = [], 0
    return langs, scores


def fit(labelled: DataFrame, key_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Train on a bounded sample of ``labelled``: at most rows * chars characters reach the driver."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    text = F.col(text_col)
    start = F.pmod(F.xxhash64(F.col(key_col), F.lit(1)), F.greatest(F.char_length(text) - chars + 1, F.lit(1)).cast("long")) + 1
    taken = by_hash(known, F.col(key_col), rows).select(F.substring(text, start.cast("int"), F.lit(chars)).alias("text"),
                                                        F.col(lang_col).alias("lang"), F.xxhash64(key_col).alias("h"))
    sample = taken.orderBy("h", "text", "lang").toPandas()
    return train(sample["text"].tolist(), sample["lang"].tolist())


def language(spark: SparkSession, model: Model, text: Column) -> Column:
    """A struct (lang, score) of a text column; the model is a few kB and is broadcast."""
    shared = spark.sparkContext.broadcast((model.langs, model.bytes_, model.filters, model.bias, model.out, model.out_bias))

    @F.pandas_udf("lang string, score double")
    def judge(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = Model(*shared.value)
        for part in parts:
            langs, scores = predict(own, list(part))
            yield pd.DataFrame({"lang": langs, "score": scores})

    return judge(text)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score."""
    found = docs.select(F.col(id_col).alias("id"), language(docs.sparkSession, model, F.col(text_col)).alias("found"))
    return found.select(F.col("id").alias(id_col), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))
