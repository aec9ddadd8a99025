"""The pipeline's stages against the operators' own verdicts, and edge cases through all stages."""

import corpus_pipeline as P
import pytest
from conftest import SF0001
from pyspark.sql import functions as F

from roilens.llm import decontaminate, langid, simhash, toxicity
from roilens.llm.common import id_remainder
from roilens.llm.queries import toxicity_labels
from test_operators import brute_components


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF0001}/documents.parquet")


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages(spark, docs, tmp_path):
    names = [n for n, _ in P.STAGES]
    assert names == ["toxicity", "language", "near_duplicates", "decontamination", "sentencepiece"]
    kept = docs
    stage = dict(P.STAGES)
    model = toxicity.fit(toxicity_labels(docs, spark.read.parquet(f"{SF0001}/labels.parquet")))
    text = {r.doc_id: r.text for r in docs.collect()}
    order = sorted(text)
    scores = dict(zip(order, toxicity.score(model, [text[i] for i in order]), strict=True))
    out = stage["toxicity"](spark, kept, SF0001)
    assert out.columns == docs.columns and ids(out) == {i for i in order if scores[i] < 0.3}
    out.write.parquet(f"{tmp_path}/0")
    kept = spark.read.parquet(f"{tmp_path}/0")
    lang = langid.fit(docs.where(id_remainder(F.col("doc_id"), 3) != 1))
    here = sorted(ids(kept))
    judged = dict(zip(here, zip(*langid.predict(lang, [text[i] for i in here]), strict=True), strict=True))
    out = stage["language"](spark, kept, SF0001)
    assert out.columns == docs.columns and ids(out) == {i for i in here if judged[i][0] != "und" and judged[i][1] >= P.LEAST_LANGUAGE_SCORE}
    out.write.parquet(f"{tmp_path}/1")
    kept = spark.read.parquet(f"{tmp_path}/1")
    here = sorted(ids(kept))
    out = stage["near_duplicates"](spark, kept, SF0001)
    assert ids(out) == set(brute_components([simhash.fingerprint(text[i]) for i in here], here)) and out.count() == len(ids(out))
    out.write.parquet(f"{tmp_path}/2")
    kept = spark.read.parquet(f"{tmp_path}/2")
    bench = spark.read.parquet(f"{SF0001}/benchmark.parquet")
    out = stage["decontamination"](spark, kept, SF0001)
    assert ids(out) == ids(kept) - ids(decontaminate.contaminated(kept, bench)) and out.columns == docs.columns
    last = stage["sentencepiece"](spark, out, SF0001)
    assert last.columns == [*docs.columns, "ids", "n_tokens", "round_trip", "parity"] and last.where("not parity").count() == 0


def test_odd_rows_pass_all_stages(spark):
    rows = [(1, "the cat and the dog of the house", "en", "s", 1), (1, "the cat and the dog of the house", "en", "s", 1), (2, None, None, None, None),
            (3, "", "en", "s", 0), (None, "the long way of the river and the hills", None, None, None), (4, "the river " * 20_000, "en", "s", 9)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, toxicity string")
    for _, stage in P.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF0001).collect(), stage(spark, docs, SF0001).schema)
    left = sorted(str(r.doc_id) for r in docs.collect())
    assert "1" in left and left.count("1") == 1 and "2" not in left and "3" not in left
    for _, stage in P.STAGES:
        assert stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0), SF0001).count() == 0
