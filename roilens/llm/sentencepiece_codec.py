"""SentencePiece encoding and decoding on the tokenizers library.

The model file (a protobuf) is parsed here: pieces with scores and types, the
trainer's model type and byte fallback, and the normaliser's rules. From them a
tokenizers pipeline is rebuilt: the normaliser (character map, white space, the
metaspace marker and its dummy prefix), a unigram model with the pieces' scores
or a byte-pair model whose merges are read off the pieces' ranks, byte fallback
for characters without a piece, and the decoder. Texts are encoded in batches of
bounded size by several threads; where no piece of the model has a marker after
another character, pieces never span words, so a batch encodes each distinct
word once and joins a text's ids from its words'.

Parity is verified for every text: the ids of each of its words are compared
with those that the sentencepiece library gives (``Codec.verify`` compares whole
texts, at twice the time), and decoding must give the text back.

The model is read once on the driver and broadcast (a vocabulary file, some
hundred kB); its path is a parameter.

Defined results: a null text has null ids and counts and null checks; an empty
one has no ids and passes both; lone surrogates cannot be stored in UTF-8 and
are replaced before encoding; repeated rows are encoded alike; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
BATCH_CHARS, WORDS_AT_ONCE, KNOWN_WORDS, THREADS = 1 << 20, 8192, 300_000, 2


@dataclass
class Spec:
    """What the model file says."""

    pieces: list[tuple[str, float, int]]
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_mark: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields: varints, fixed 32 and 64 bits, and bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = varint()
        number, wire = tag >> 3, tag & 7
        if wire == 0:
            yield number, varint()
            continue
        if wire not in (1, 2, 5):
            raise ValueError(f"wire type {wire} of field {number}")
        size = varint() if wire == 2 else 8 if wire == 1 else 4
        yield number, data[at:at + size]
        at += size


def parse(data: bytes) -> Spec:
    """The parts of a SentencePiece model that encoding needs."""
    spec = Spec([])
    for number, value in fields(data):
        if number == 1:  # a piece
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            spec.pieces.append((piece, score, kind))
        elif number == 2:  # the trainer's settings
            for n, v in fields(value):
                if n == 3:
                    spec.kind = v
                elif n == 24:
                    spec.suffix_mark = bool(v)
                elif n == 35:
                    spec.byte_fallback = bool(v)
        elif number == 3:  # the normaliser's
            for n, v in fields(value):
                if n == 2:
                    spec.charsmap = v
                elif n == 3:
                    spec.dummy_prefix = bool(v)
                elif n == 4:
                    spec.squeeze = bool(v)
                elif n == 5:
                    spec.escape = bool(v)
    if spec.kind not in (UNIGRAM, BPE) or spec.suffix_mark or not spec.escape:
        raise ValueError("only unigram and byte-pair models with a leading metaspace marker can be rebuilt")
    return spec


def merges(spec: Spec) -> list[tuple[str, str]]:
    """Byte-pair merges: every way to make a piece of two others, the best pieces first."""
    score = {p: s for p, s, kind in spec.pieces if kind in (NORMAL, USER)}
    rank = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
    out = []
    for piece in sorted(score, key=lambda p: (-score[p], rank[p])):
        ways = [(piece[:i], piece[i:]) for i in range(1, len(piece)) if piece[:i] in score and piece[i:] in score]
        out += sorted(ways, key=lambda w: (rank[w[0]], rank[w[1]]))
    return out


def spans_words(spec: Spec) -> bool:
    """Whether a piece has a marker after another character, so that words cannot be encoded one by one."""
    return any(MARK in p.lstrip(MARK) for p, _, kind in spec.pieces if kind in (NORMAL, USER))


def build(spec: Spec):
    """The tokenizers pipeline."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    unknown = next((i for i, (_, _, kind) in enumerate(spec.pieces) if kind == UNKNOWN), None)
    if spec.kind == UNIGRAM:
        model = models.Unigram([(p, s) for p, s, _ in spec.pieces], unknown, spec.byte_fallback)
    else:
        model = models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, merges(spec), cache_capacity=0, fuse_unk=True,
                           unk_token=None if unknown is None else spec.pieces[unknown][0], byte_fallback=spec.byte_fallback)
    out = Tokenizer(model)
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if spec.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    out.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
    if not spans_words(spec):
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*|[^{MARK}]+"), "isolated")
    tail = [decoders.Strip(content=" ", left=1)] if spec.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return out


class _Rows(dict):
    """Word -> row; a word that is asked for the first time gets the next row."""

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        return row


class Codec:
    """A rebuilt model with batch encoding and decoding, and the library's own for verification."""

    def __init__(self, data: bytes, threads: int = THREADS, pipeline: str | None = None):
        """``pipeline``: what ``build`` made of the same model, as JSON."""
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        self.spec, self.threads = parse(data), threads
        self.pipeline = pipeline or build(self.spec).to_str()
        self.slow = sentencepiece.SentencePieceProcessor(model_proto=data)
        self.words = Tokenizer.from_str(self.pipeline)  # for words that are normalised and cut already
        self.words.normalizer = self.words.pre_tokenizer = None
        self.split = None if spans_words(self.spec) else re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
        self.bytes = np.array([bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else p.replace(MARK, " ").encode()
                               for p, _, kind in self.spec.pieces], dtype=object)
        self.is_byte = np.array([kind == BYTE for _, _, kind in self.spec.pieces])
        self.plain = not self.spec.charsmap and not self.spec.squeeze and self.spec.dummy_prefix
        self._forget()

    @functools.cached_property
    def fast(self):
        """The whole pipeline, for whole texts."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.pipeline)

    def _forget(self) -> None:
        self.rows, self.done = _Rows(), 0
        self.flat, self.at, self.same = [np.zeros(0, dtype=np.int32)], np.zeros(1, dtype=np.int64), np.zeros(0, dtype=bool)

    def _learn(self) -> None:
        """Encode the words that were met for the first time, by several threads, and the same words by the
        sentencepiece library."""
        new = list(itertools.islice(self.rows, self.done, None))
        self.done = len(self.rows)
        for i in range(0, len(new), WORDS_AT_ONCE):
            some = new[i:i + WORDS_AT_ONCE]
            runs = self.words.encode_batch([some[j:j + 256] for j in range(0, len(some), 256)], is_pretokenized=True,
                                           add_special_tokens=False)
            ids = np.fromiter(itertools.chain.from_iterable(r.ids for r in runs), dtype=np.int32)
            word = np.concatenate([256 * j + np.array(r.word_ids, dtype=np.int64) for j, r in enumerate(runs)])
            sizes = np.bincount(word, minlength=len(some))
            lead = int(self.spec.dummy_prefix)  # the library puts the first marker before the word itself
            theirs = self.slow.encode([w[lead:] for w in some], out_type=int, num_threads=self.threads)
            if lead and MARK in some:  # a last space, which the library drops from an empty text
                theirs[some.index(MARK)] = self.slow.encode("x ")[len(self.slow.encode("x")):]
            equal = np.array([len(x) for x in theirs]) == sizes
            if equal.all():
                both = np.fromiter(itertools.chain.from_iterable(theirs), dtype=np.int32) == ids
                equal = np.bincount(word[~both], minlength=len(some)) == 0
            else:
                start = np.cumsum(sizes) - sizes
                equal = np.array([x == ids[a:a + n].tolist() for x, a, n in zip(theirs, start, sizes, strict=True)])
            self.flat.append(ids)
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            self.same = np.concatenate([self.same, equal])
        self.flat = [np.concatenate(self.flat)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts."""
        return self.encode_verified(texts)[0]

    def encode_verified(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """Ids of whole texts, and whether the sentencepiece library gives the same.

        No piece spans two words, so each distinct word is encoded and verified once, and a text's ids are its words'
        ids in order; with a model that has pieces that do, whole texts are encoded and verified."""
        if self.split is None:
            ids = [np.array(e.ids, dtype=np.int32) for e in self.fast.encode_batch_fast(texts, add_special_tokens=False)]
            return ids, self.verify(texts, ids)
        if len(self.rows) > KNOWN_WORDS:  # what a worker knows by word stays bounded
            self._forget()
        words = [np.fromiter(map(self.rows.__getitem__, self.split(self.normalize(t))), dtype=np.int64) for t in texts]
        self._learn()
        out = []
        for rows in words:
            start, size = self.at[rows], self.at[rows + 1] - self.at[rows]
            before = np.cumsum(size) - size
            out.append(self.flat[0][np.repeat(start - before, size) + np.arange(size.sum())])
        return out, [bool(self.same[rows].all()) for rows in words]

    def normalize(self, text: str) -> str:
        if self.plain:
            return MARK + text.replace(" ", MARK) if text else ""
        return self.fast.normalizer.normalize_str(text)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The library's decoding."""
        return self.fast.decode_batch([x.tolist() for x in ids], skip_special_tokens=False)

    def text_of(self, ids: np.ndarray) -> str:
        """The same text joined from the pieces' bytes, for the check of every text."""
        out = b"".join(self.bytes[ids].tolist()).decode("utf-8", "replace")
        return out[1:] if self.spec.dummy_prefix and out.startswith(" ") else out

    def verify(self, texts: list[str], ids: list[np.ndarray]) -> list[bool]:
        """Whether the sentencepiece library gives the same ids."""
        out = []
        for text, own in zip(texts, ids, strict=True):
            theirs = self.slow.encode(text, out_type=int)
            out.append(len(theirs) == len(own) and bool((np.array(theirs, dtype=np.int32) == own).all()))
        return out


CODE_TYPES = {"ids": "array<int>", "n_tokens": "int", "n_bytes": "int", "round_trip": "boolean", "parity": "boolean"}


def code_batch(codec: Codec, texts: pa.Array) -> dict[str, pa.Array]:
    """The code columns of some texts."""
    given = [None if t is None else t.encode("utf-8", "replace").decode("utf-8") for t in texts.to_pylist()]
    known = [t for t in given if t is not None]
    ids, same = codec.encode_verified(known) if known else ([], [])
    is_null = np.array([t is None for t in given], dtype=bool)
    sizes = np.zeros(len(given), dtype=np.int64)
    sizes[~is_null] = [len(x) for x in ids]
    flat = np.concatenate([np.zeros(0, dtype=np.int32), *ids])
    ends = np.cumsum(sizes)
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32), mask=np.append(is_null, False))
    n_bytes = np.concatenate([[0], np.cumsum(codec.is_byte[flat])])
    back = np.zeros(len(given), dtype=bool)
    back[~is_null] = [codec.text_of(x) == t for x, t in zip(ids, known, strict=True)]
    parity = np.zeros(len(given), dtype=bool)
    parity[~is_null] = same
    return {"ids": pa.ListArray.from_arrays(offsets, pa.array(flat)), "n_tokens": pa.array(sizes.astype(np.int32), mask=is_null),
            "n_bytes": pa.array((n_bytes[ends] - n_bytes[ends - sizes]).astype(np.int32), mask=is_null),
            "round_trip": pa.array(back, mask=is_null), "parity": pa.array(parity, mask=is_null)}


def add_codes(docs: DataFrame, names: dict[str, str] | None = None, text_col: str = "text", model: str = MODEL,
              threads: int = THREADS) -> DataFrame:
    """``docs``, all columns kept, with its code columns: ids, n_tokens, n_bytes (byte pieces among them), round_trip, parity.
    ``names`` picks and renames them. Batches are worked off in slices of about BATCH_CHARS characters."""
    names = names or {c: fresh(docs, c) for c in CODE_TYPES}
    with open(model, "rb") as f:  # the model is a file beside the program, not a table
        raw = f.read()
    shared = docs.sparkSession.sparkContext.broadcast((raw, build(parse(raw)).to_str()))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shared.value[0], threads, shared.value[1])
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            first = 0
            while first < len(batch):
                start = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, start + BATCH_CHARS, side="right")))
                part = batch.slice(first, last - first)
                codes = code_batch(codec, part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, *[codes[c] for c in names]], [*part.schema.names, *names.values()])
                first = last

    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, T._parse_datatype_string(CODE_TYPES[c])) for c, n in names.items()]])
    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, threads: int = THREADS) -> DataFrame:
    """One row per input row: id, ids, n_tokens, n_bytes, round_trip, parity."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return add_codes(texts, {c: c for c in CODE_TYPES}, "text", model, threads).select(F.col("id").alias(id_col), *CODE_TYPES)


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(id, text) from (id, ids); null ids give a null text."""
    with open(model, "rb") as f:
        raw = f.read()
    data = coded.sparkSession.sparkContext.broadcast(raw)

    @F.pandas_udf("string")
    def back(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = Codec(data.value)
        for part in parts:
            yield pd.Series([None if x is None else codec.decode([np.asarray(x)])[0] for x in part], dtype=object)

    return coded.select(F.col(id_col), back(F.col(ids_col)).alias("text"))
