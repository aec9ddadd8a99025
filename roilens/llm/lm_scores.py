"""Language-model scores by cross-entropy difference.

Two bigram models are counted over all documents: a target model over those that
are marked, and a background model over all others. They match in everything but
their counts: one vocabulary (all words of the corpus, however rare), one order,
one smoothing. A word's probability after its predecessor is
``(c(h, w) + MU * p(w)) / (c(h) + MU)`` with ``p(w) = (c(w) + 1) / (n + v)``, where
``v`` counts the corpus' words and one unseen word. A document's score is the mean
over its words of target loss minus background loss (natural logarithms): the
lower, the more it is like the target.

Texts are packed into batches of about ``batch`` bytes, which are written once. Each
batch asks for its distinct words and pairs, by 63-bit hashes with its own counts: the
hashes, sorted, are cut into buckets by their highest bits, and a bucket of a batch is
one row, whose hashes are stored as differences (about 6 bytes each). A bucket sums what
all batches ask in it and answers every batch with the totals in the order of its
question. A batch that has its answers scores its texts. So a word or pair crosses the
shuffle once a batch however often it occurs there, and no key gathers more than one
entry a batch. No word or pair is left out, and nothing that grows with the corpus
reaches the driver or is broadcast; buckets grow in number with the corpus, not in size.

Defined results: null and word-free texts have no words and score 0; without
marked documents (or without others) that model is the uniform one; rows with a
null mark are background; repeated rows are counted and scored each; an empty
table gives an empty result; very long texts are read whole (one is a batch of its
own); other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, shuffles_dropped

MU, FLUSH_WORDS, BATCH, BUCKET, LEAST_BITS = 100.0, 400_000, 12 << 20, 24 << 20, 5
SLICE = 1 << 18
HOT, FILTER = 1 << 20, 1 << 26  # bounds of earlier broadcasts; nothing is broadcast any more
WORDS = re.compile(r"[^\W_]+")
START = " "  # no word: the beginning of a text


class Words(dict):
    """Word -> its number here, in the order of appearance; START is number 0."""

    def __init__(self):
        super().__init__({START: 0})
        self.held, self.n = np.zeros(0, dtype=np.int64), 0

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n

    def numbers(self, text: str | None) -> np.ndarray:
        """Numbers of a text's words, after that of START."""
        words = WORDS.findall(text.lower()) if text else []
        out = np.zeros(len(words) + 1, dtype=np.int32)
        out[1:] = np.fromiter(map(self.__getitem__, words), dtype=np.int32, count=len(words))
        return out

    def keys(self) -> np.ndarray:
        """Hashes of the words by number; they are odd."""
        if len(self) > self.n:
            if len(self) > len(self.held):
                self.held = np.concatenate([self.held[:self.n], np.zeros(2 * len(self) - self.n, dtype=np.int64)])
            self.held[self.n:len(self)] = np.fromiter(map(word_hash, itertools.islice(self, self.n, None)), dtype=np.int64)
            self.n = len(self)
        return self.held[:self.n]


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True) | 1


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hashes of pairs by those of their words; they are even."""
    with np.errstate(over="ignore"):
        out = h.astype(np.uint64)
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
        out += w.astype(np.uint64, copy=False)
        out *= np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
        out &= ~np.uint64(1)
        return out


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and reread; the shuffles behind it go at once."""
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/lm-{uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def packed(texts: DataFrame) -> DataFrame:
    """(id, size, body): UTF-8 bytes of the texts, compressed, for a shuffle."""

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            raw = [x.encode("utf-8") for x in part["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([part["id"], pa.array(map(len, raw), pa.int64()), pa.array(
                [pa.compress(x, "zstd", asbytes=True) for x in raw], pa.binary())], names=["id", "size", "body"])

    return texts.where("text != ''").mapInArrow(pack, f"id {texts.schema['id'].dataType.simpleString()}, size long, body binary")


def batched(known: DataFrame, batch: int) -> DataFrame:
    """(batch, bytes, ids, sizes, targets, body) over (id, size, body, target): the texts of ``batch`` bytes or little more, or one
    that is longer, compressed together."""
    of_id = known.schema["id"].dataType.simpleString()

    def gather(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size, id_type = TaskContext.get().partitionId() << 32, [], 0, None

        def row() -> pa.RecordBatch:
            ids, raw, targets = zip(*held, strict=True)
            body = pa.compress(b"".join(raw), "zstd", asbytes=True)
            return pa.RecordBatch.from_arrays([
                pa.array([number], pa.int64()), pa.array([size], pa.int64()), pa.array([ids], pa.list_(id_type)),
                pa.array([[len(x) for x in raw]], pa.list_(pa.int64())), pa.array([targets], pa.list_(pa.bool_())), pa.array([body], pa.binary())],
                names=["batch", "bytes", "ids", "sizes", "targets", "body"])

        for part in parts:
            id_type = part.schema.field("id").type
            for i, n, body, target in zip(*(part[c].to_pylist() for c in ("id", "size", "body", "target")), strict=True):
                if held and size + n > batch:
                    yield row()
                    number, held, size = number + 1, [], 0
                held.append((i, pa.decompress(body, n, "zstd", asbytes=True), target))
                size += n
        if held:
            yield row()

    return known.select("id", "size", "body", "target").mapInArrow(
        gather, f"batch long, bytes long, ids array<{of_id}>, sizes array<long>, targets array<boolean>, body binary")


class Batch:
    """A batch's words and pairs: ``w`` after ``h`` (numbers), in text ``of``; the words that are met, by hash, and pairs' hashes."""

    def __init__(self, words: Words, size: int, sizes: list[int], body: bytes):
        raw, at, numbers = pa.decompress(body, size, "zstd", asbytes=True), 0, []
        for n in sizes:
            numbers.append(words.numbers(raw[at:at + n].decode("utf-8")))
            at += n
        del raw
        self.lengths = np.array([len(x) - 1 for x in numbers])
        all_ = np.concatenate(numbers)
        del numbers
        inner = all_ != 0  # every word follows a word or START
        self.w, self.h = all_[inner], all_[:-1][inner[1:]]
        del all_, inner
        self.of = np.repeat(np.arange(len(sizes), dtype=np.int32), self.lengths)
        keys = words.keys().view(np.uint64)
        self.size = len(keys)
        met = np.flatnonzero(np.bincount(self.w, minlength=self.size) + np.bincount(self.h, minlength=self.size))
        self.met = met[np.argsort(keys[met], kind="stable")]
        self.keys = keys[self.met]
        self.pairs = pair_hash(keys[self.h], keys[self.w])

    def counts(self, side: np.ndarray) -> list[np.ndarray]:
        """Of the words that are met, as words and as predecessors, where ``side`` (of each text) is set."""
        here = side[self.of]
        return [np.bincount(x[here], minlength=self.size)[self.met] for x in (self.w, self.h)]

    def pair_numbers(self) -> tuple[int, np.ndarray]:
        """How many pairs differ; each pair's number in the order of hashes. The hashes go."""
        order = np.argsort(self.pairs)
        pairs = self.pairs[order]
        del self.pairs
        rank = np.zeros(len(order), dtype=np.int32)
        np.cumsum(pairs[1:] != pairs[:-1], dtype=np.int32, out=rank[1:])
        del pairs
        at = np.empty_like(rank)
        at[order] = rank
        return int(rank[-1]) + 1 if len(rank) else 0, at

    def losses(self, word: np.ndarray, before: np.ndarray, of_pair: np.ndarray, at: np.ndarray, total: int) -> np.ndarray:
        """Each word's loss, from the counts of words, predecessors and pairs; a slice at a time, for memory."""
        out = np.empty(len(at))
        for i in range(0, len(at), SLICE):
            x = slice(i, i + SLICE)
            p = (word[self.w[x]] + 1) / total
            out[x] = -np.log((of_pair[at[x]] + MU * p) / (before[self.h[x]] + MU))
        return out


def pack_numbers(*held: np.ndarray) -> bytes:
    """Unsigned numbers, byte by byte: the higher bytes of small ones compress to nearly nothing."""
    return pa.compress(b"".join(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in held), "zstd", asbytes=True)


def unpack_numbers(body: bytes, *lengths: int) -> list[np.ndarray]:
    raw = np.frombuffer(pa.decompress(body, 8 * sum(lengths), "zstd"), dtype=np.uint8)
    ends = 8 * np.cumsum(lengths)
    return [np.ascontiguousarray(raw[end - 8 * n:end].reshape(8, n).T).view("<u8").ravel() for n, end in zip(lengths, ends, strict=True)]


def differences(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys, for a sum that gives them again."""
    return np.diff(keys, prepend=np.uint64(0))


MESSAGE = "bucket int, batch long, n_words int, n_pairs int, body binary"


def questions(batches: DataFrame, bits: int) -> DataFrame:
    """(bucket, batch, n_words, n_pairs, body): a batch's words (hash, t, b, ht, hb) and pairs (hash, t, b) in one of 2^bits buckets."""
    lower = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for part in parts:
            for number, size, sizes, targets, body in zip(*(part[c].to_pylist() for c in ("batch", "bytes", "sizes", "targets", "body")), strict=True):
                if len(words) > FLUSH_WORDS:
                    words = Words()
                own, target = Batch(words, size, sizes, body), np.array(targets)
                (t, ht), (b, hb) = own.counts(target), own.counts(~target)
                code = own.pairs
                code |= target[own.of]  # pairs are even
                code.sort()
                first = np.flatnonzero(np.concatenate([[True], code[1:] >> np.uint64(1) != code[:-1] >> np.uint64(1)])) if len(code) else np.zeros(0, int)
                pt = np.add.reduceat(code & np.uint64(1), first) if len(code) else code
                pb = np.diff(np.append(first, len(code))).astype(np.uint64) - pt
                pairs = code[first] & ~np.uint64(1)
                at, pair_at = (np.append(np.searchsorted(k, lower), len(k)) for k in (own.keys, pairs))
                out = []
                for i in range(1 << bits):
                    x, y = slice(at[i], at[i + 1]), slice(pair_at[i], pair_at[i + 1])
                    n_words, n_pairs = int(at[i + 1] - at[i]), int(pair_at[i + 1] - pair_at[i])
                    if n_words or n_pairs:
                        out.append((i, number, n_words, n_pairs, pack_numbers(differences(own.keys[x]), t[x], b[x], ht[x], hb[x],
                                                                              differences(pairs[y]) >> np.uint64(1), pt[y], pb[y])))
                if out:
                    yield message(out)

    return batches.select("batch", "bytes", "sizes", "targets", "body").mapInArrow(ask, MESSAGE)


def message(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                      names=["bucket", "batch", "n_words", "n_pairs", "body"])


def answers(asked: DataFrame) -> DataFrame:
    """The questions with the totals of all batches (words: t, b, ht, hb; pairs: t, b) as their body; in one row of a bucket its
    words' sums and number (all_t, all_b, types), else 0."""

    def total(keys: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        known, at = np.unique(keys, return_inverse=True)
        return known, at, [np.bincount(at, c, minlength=len(known)).astype(np.uint64) for c in counts]  # exact below 2^53

    def answer(bucket: pa.Table) -> pa.Table:
        sizes = [bucket["n_words"].to_pylist(), bucket["n_pairs"].to_pylist()]
        read = [unpack_numbers(body.as_py(), *[n] * 5, *[m] * 3) for n, m, body in zip(*sizes, bucket["body"], strict=True)]
        for x in read:
            x[0], x[5] = np.cumsum(x[0], dtype=np.uint64), np.cumsum(x[5], dtype=np.uint64)
        read = list(map(np.concatenate, zip(*read, strict=True)))
        _, at, of_words = total(*read[:5])
        _, pair_at, of_pairs = total(*read[5:])
        at, pair_at = (np.split(a, np.cumsum(n)[:-1]) for a, n in zip((at, pair_at), sizes, strict=True))
        bodies = [pack_numbers(*(c[x] for c in of_words), *(c[y] for c in of_pairs)) for x, y in zip(at, pair_at, strict=True)]
        out = bucket.select(["bucket", "batch", "n_words", "n_pairs"]).append_column("body", pa.array(bodies, pa.binary()))
        none = [0] * (len(bodies) - 1)
        for name, n in (("all_t", of_words[0].sum()), ("all_b", of_words[1].sum()), ("types", np.count_nonzero(of_words[0] + of_words[1]))):
            out = out.append_column(name, pa.array([int(n), *none], pa.int64()))
        return out

    return asked.groupBy("bucket").applyInArrow(answer, MESSAGE + ", all_t long, all_b long, types long")


def losses(counts: np.ndarray) -> np.ndarray:
    """Loss of each word after each predecessor, from counts (v + 1, v): the definition, for a small vocabulary."""
    single = counts.sum(axis=0)
    p = (single + 1) / (single.sum() + counts.shape[1])
    return -np.log((counts + MU * p) / (counts.sum(axis=1, keepdims=True) + MU))


def cross_entropy_difference(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                             target_id_col: str = "doc_id", hot: int = HOT, filter_bits: int = FILTER, batch: int = BATCH,
                             bucket: int = BUCKET) -> DataFrame:
    """One row per input row: id, n_words, target_loss, background_loss, score. ``targets`` has the ids of the
    marked documents. ``batch`` is the bytes of text in a batch, ``bucket`` the bytes of text for which there is one bucket
    (2^LEAST_BITS buckets at least); ``hot`` and ``filter_bits`` bounded broadcasts that are gone. None changes a result."""
    marked = targets.select(F.col(target_id_col).alias("marked_id")).where("marked_id is not null").distinct().hint("shuffle_hash")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = texts.schema["id"].dataType.simpleString()
    known = packed(texts).join(marked, F.col("id") == F.col("marked_id"), "left").select("id", "size", "body", F.col("marked_id").isNotNull().alias("target"))
    batches = written(batched(known, batch))
    size = batches.agg(F.sum("bytes")).first()[0] or 0
    replies = written(answers(questions(batches, max(LEAST_BITS, (size // bucket).bit_length()))))
    n = replies.agg(F.sum("all_t").alias("t"), F.sum("all_b").alias("b"), F.sum("types").alias("types")).first()
    v = (n["types"] or 0) + 1
    totals = [(n["t"] or 0) + v, (n["b"] or 0) + v]

    def score(texts: pa.Table, replies: pa.Table) -> pa.Table:
        row = {c: texts[c][0] for c in ("bytes", "ids", "sizes", "body")}
        own = Batch(Words(), row["bytes"].as_py(), row["sizes"].as_py(), row["body"].as_py())
        read = [unpack_numbers(body, *[n] * 4, *[m] * 2) for _, n, m, body in sorted(
            zip(*(replies[c].to_pylist() for c in ("bucket", "n_words", "n_pairs", "body")), strict=True))]
        mean, (n_pairs, at) = [], own.pair_numbers()
        for side, total in enumerate(totals):
            word, before = np.zeros((2, own.size))
            loss = np.zeros(0)
            if read:
                word[own.met], before[own.met], of_pair = (np.concatenate([x[i] for x in read]) for i in (side, 2 + side, 4 + side))
                assert len(of_pair) == n_pairs
                loss = own.losses(word, before, of_pair, at, total)
            mean.append(np.bincount(own.of, loss, minlength=len(own.lengths)) / np.maximum(own.lengths, 1))
        return pa.table([row["ids"].values, pa.array(own.lengths), *map(pa.array, mean)], names=["id", "n_words", "target_loss", "background_loss"])

    scored = batches.drop("targets").groupBy("batch").cogroup(
        replies.select("bucket", "batch", "n_words", "n_pairs", "body").groupBy("batch")).applyInArrow(
        score, f"id {id_type}, n_words long, target_loss double, background_loss double")
    wordless = texts.where("text is null or text = ''").select("id", F.lit(0).cast("long").alias("n_words"), F.lit(0.0).alias("target_loss"),
                                                              F.lit(0.0).alias("background_loss"))
    return scored.unionByName(wordless).select(F.col("id").alias(id_col), "n_words", "target_loss", "background_loss",
                                               (F.col("target_loss") - F.col("background_loss")).alias("score"))
