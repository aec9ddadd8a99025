"""A text shared by a third of the prompts: scored once, resolved map-side
through the bounded hot-text broadcast, never shuffled as one giant key."""

import re

from pyspark.sql import functions as F

from roilens.operators.governance import by_distinct_text, redact_frame, with_risk_deduped


def test_hot_text_split_from_the_shuffle(spark):
    n = 3000
    rows = [(f"p{i}", "hot mail a@b.com" if i % 3 == 0 else f"text {i} 10.0.0.{i % 250}") for i in range(n)]
    df = spark.createDataFrame(rows, "prompt_id string, prompt_text string").repartition(6)
    out = with_risk_deduped(df, hot_min_rows=100, max_hot=10)
    got = {r["prompt_id"]: r for r in out.collect()}
    assert len(got) == n
    assert got["p0"]["risk_score"] == 25.0 and got["p1"]["risk_score"] == 5.0
    assert got["p0"]["pii_types"] == ["REGEX:EMAIL"]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan  # hot texts resolved map-side
    # the same answer as the plain per-row scan
    from roilens.functions.risk import with_risk
    plain = {r["prompt_id"]: (r["risk_score"], r["pii_types"]) for r in with_risk(df).collect()}
    assert plain == {k: (v["risk_score"], v["pii_types"]) for k, v in got.items()}


def test_no_hot_text(spark):
    df = spark.createDataFrame([(f"p{i}", f"t{i}") for i in range(50)], "prompt_id string, prompt_text string")
    assert with_risk_deduped(df).count() == 50


def test_rows_shuffle_without_their_text(spark):
    texts = ["mail a@b.com", None, "", *[f"text {i}" for i in range(20)]]
    rows = [(f"p{i}", f"u{i % 7}", texts[i % len(texts)]) for i in range(600)]
    df = spark.createDataFrame(rows, "prompt_id string, user_id string, prompt_text string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = redact_frame(df)
        plan = out._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = [i for i in re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]", plan) if "prompt_id#" in i]
        assert moved and not any("prompt_text#" in i or "_t#" in i for i in moved)
        assert out.columns == df.columns
        got = {r["prompt_id"]: (r["user_id"], r["prompt_text"]) for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert got == {p: (u, "mail [EMAIL_REDACTED]" if t == "mail a@b.com" else t) for p, u, t in rows}


def test_hot_text_is_dealt_under_several_keys(spark):
    df = spark.createDataFrame([(i, "hot" if i % 2 else f"t{i}") for i in range(1000)], "id long, prompt_text string")
    out = by_distinct_text(df, "prompt_text", lambda d: d.withColumn("size", F.length("_t")), hot_min_rows=50, max_hot=5,
                           id_col="id", meanwhile=lambda rows: rows.withColumn("seven", F.col("id") % 7))
    assert out.columns == ["id", "prompt_text", "size", "seven"]
    assert {tuple(r) for r in out.collect()} == {(i, t, len(t), i % 7) for i, t in
                                                 ((i, "hot" if i % 2 else f"t{i}") for i in range(1000))}
    assert out.count() == 1000


def test_enriched_logs_meet_their_users_without_text(spark):
    from conftest import SF0001
    from roilens.operators.usage import enrich_usage
    from roilens.plans.inputs import Inputs
    i = Inputs(spark, SF0001)
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = i.logs_enriched()
        plan = out._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = [x for x in re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]", plan) if "user_id#" in x]
        assert moved and not any("prompt_text#" in x or " text#" in x for x in moved)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    stepwise = enrich_usage(i.logs(), i.users())
    assert out.columns == stepwise.columns
    assert out.exceptAll(stepwise).count() == 0 and out.count() == stepwise.count()


def test_export_handles_texts_in_one_pass_and_keeps_no_shuffles(spark, monkeypatch):
    import os
    from conftest import SF0001
    from roilens.operators import governance
    from roilens.plans import catalog
    from roilens.plans.inputs import Inputs
    passes, folders, whole, scratch = [], [], governance.by_distinct_text, catalog._scratch
    monkeypatch.setattr(governance, "by_distinct_text", lambda *a, **k: passes.append(1) or whole(*a, **k))
    monkeypatch.setattr(catalog, "_scratch", lambda *a: folders.append(scratch(*a)) or folders[0])
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    shuffles = lambda: {f for d in local for _, _, fs in os.walk(d) for f in fs if f.startswith("shuffle_")}
    before = shuffles()
    report = catalog.QUERIES["export_bundle"](spark, SF0001)
    left = shuffles() - before
    assert len(passes) == 1 and not left
    assert report.count() == 4
    logs = f"{folders[0]}/usage_logs_enriched.parquet"
    out, stepwise = spark.read.parquet(logs), redact_frame(Inputs(spark, SF0001).logs_enriched())
    assert out.columns == stepwise.columns
    assert out.exceptAll(stepwise).count() == 0 and out.count() == stepwise.count()
    assert any(f.endswith(".zstd.parquet") or ".zstd." in f for f in os.listdir(logs))
