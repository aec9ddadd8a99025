"""The corpus pipeline: five stages over ``documents``, each calling one operator of ``roilens.llm``.

Each stage gets what its predecessor kept and returns the columns of documents
(the last one adds its codes). Models are trained on the labelled rows of the
source tables (bounded samples, see the operators); decisions are made for every
row of the stage's input.

Null and empty texts: toxicity scores them 0 and keeps them; the language stage
rejects them (they have no language); near-duplicates treats all texts without a
word as one group.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from roilens.llm import decontaminate, langid, queries, sentencepiece_codec, simhash, toxicity
from roilens.llm.common import fresh, id_remainder, table
from roilens.session import ensure_checkpoint_dir

#: A text's language must be at least this likely; below the share of one of four equal languages nothing is known.
LEAST_LANGUAGE_SCORE = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 1: documents that score toxicity.THRESHOLD or more go."""
    model = toxicity.fit(queries.toxicity_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))
    name = fresh(docs, "toxicity")
    scored = docs.withColumn(name, toxicity.toxicity(spark, model, F.col("text")))
    return scored.where(F.col(name) < toxicity.THRESHOLD).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 2: documents without letters, or in no known language, go."""
    model = langid.fit(table(spark, sf_dir, "documents").where(id_remainder(F.col("doc_id"), 3) != 1))
    name = fresh(docs, "language")
    judged = docs.withColumn(name, langid.language(spark, model, F.col("text")))
    kept = judged.where((F.col(name)["lang"] != langid.UNKNOWN) & (F.col(name)["score"] >= LEAST_LANGUAGE_SCORE))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 3: of each group of near-duplicates the document with the smallest id stays (a null id comes last, then the
    smallest hash of the text; of rows that repeat id and text one)."""
    found = simhash.near_duplicates(docs.select("doc_id", "text"))
    least = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("text_xxh"))).alias("k"))
    kept_id, kept_xxh, text_xxh, at = (fresh(docs, n) for n in ("kept_id", "kept_xxh", "text_xxh", "row_at"))
    keep = least.select(F.col("k.doc_id").alias(kept_id), F.col("k.text_xxh").alias(kept_xxh)).distinct()
    joined = docs.withColumn(text_xxh, F.xxhash64("text")).join(
        keep, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(text_xxh) == F.col(kept_xxh)), "left_semi")
    others = [c for c in ("lang", "source", "n_chars") if c in docs.columns]
    one = Window.partitionBy("doc_id", text_xxh).orderBy(*(others or ["doc_id"]))
    return joined.withColumn(at, F.row_number().over(one)).where(F.col(at) == 1).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 4: documents that hold a benchmark item, re-parameterised or not, go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stage 5: the kept documents with their token ids and checks."""
    return sentencepiece_codec.add_codes(docs, {c: fresh(docs, c) for c in ("ids", "n_tokens", "round_trip", "parity")})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("sentencepiece", encode),
]

#: SQL can express neither trained networks nor SimHash; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{i}-{name}")
            docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs
