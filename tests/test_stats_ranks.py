"""Distributed average ranks against a brute-force ranking."""

import random

from roilens.operators.stats import average_ranks


def _brute(values):
    s = sorted(values)
    out = {}
    for v in set(values):
        first = s.index(v) + 1
        cnt = s.count(v)
        out[v] = first + (cnt - 1) / 2
    return out


def test_average_ranks_with_ties_and_hot_value(spark):
    rnd = random.Random(7)
    vals = [float(rnd.randint(0, 300)) for _ in range(2000)] + [42.0] * 1000  # a third of the rows
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id long, x double").repartition(5)
    got = {r["id"]: r["rx"] for r in average_ranks(df, "x", "rx", buckets=16).collect()}
    exp = _brute(vals)
    assert all(abs(got[i] - exp[v]) < 1e-9 for i, v in enumerate(vals))


def test_exact_quantiles_match_brute_force(spark):
    import numpy as np
    from roilens.operators.stats import exact_quantiles

    rnd = random.Random(11)
    a = [float(rnd.randint(0, 40)) for _ in range(900)] + [3.0] * 450  # a third share one value
    b = [rnd.random() * 1000 for _ in range(1350)]
    df = spark.createDataFrame([(x, y if i % 7 else None) for i, (x, y) in enumerate(zip(a, b))],
                               "a double, b double").repartition(5)
    probs = [0.3, 0.4, 0.5, 0.6, 0.7, 0.9]
    got = exact_quantiles(df, {"a": probs, "b": probs}, buckets=16).first().asDict()
    bb = [y for i, y in enumerate(b) if i % 7]
    for i, p in enumerate(probs):
        assert got[f"a_q{i}"] == float(np.percentile(a, p * 100))
        assert abs(got[f"b_q{i}"] - float(np.percentile(bb, p * 100))) < 1e-9


def test_keyed_quantiles_with_a_million_distinct_values_and_null_keys(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from roilens.operators.stats import exact_quantiles

    df = spark.range(1_200_000).select(
        F.when(F.col("id") < 1_000_000, "hot").when(F.col("id") % 3 == 0, "b").alias("k"), F.lit("x").alias("k2"),
        F.when(F.col("id") < 1_000_000, F.xxhash64("id") / 1e12).otherwise(F.col("id") % 17).alias("v"),
        F.when(F.col("id") >= 1_100_000, F.col("id") % 5).alias("w"))
    got = {r["k"]: r for r in exact_quantiles(df, {"v": [0.0, 0.5, 0.9], "w": [0.5]}, ["k", "k2"]).collect()}
    data = df.toPandas()
    assert set(got) == {"hot", "b", None}
    for k in got:
        mine = data[data["k"].isna() if k is None else data["k"] == k]
        assert np.allclose([got[k][f"v_q{i}"] for i in range(3)], np.percentile(mine["v"], [0, 50, 90]), rtol=1e-12)
        w = mine["w"].dropna()
        assert got[k]["w_q0"] == (float(np.percentile(w, 50)) if len(w) else None)
    none = exact_quantiles(df.where("id is null") if "id" in df.columns else df.limit(0), {"v": [0.5]})
    assert [tuple(r) for r in none.collect()] == [(None,)]


def test_spearman_with_a_third_of_rows_on_one_value(spark):
    import numpy as np
    import pandas as pd
    from roilens.operators.stats import spearman

    rnd = random.Random(5)
    pairs = [(42.0 if i % 3 == 0 else float(rnd.randint(0, 200)), 7.0 if i % 4 == 0 else rnd.random()) for i in range(3000)]
    got = spearman(spark.createDataFrame(pairs, "x double, y double").repartition(4), "x", "y").first()
    p = pd.DataFrame(pairs)
    assert got["n"] == 3000 and got["spearman_rho"] == round(float(np.corrcoef(p[0].rank(), p[1].rank())[0, 1]), 4)
    assert spearman(spark.createDataFrame([(1.0, 2.0)], "x double, y double"), "x", "y").first()["spearman_rho"] == 0.0
    empty = spearman(spark.createDataFrame([], "x double, y double"), "x", "y").first()
    assert (empty["n"], empty["spearman_rho"], empty["spearman_p"]) == (0, 0.0, 1.0)


def test_means_keep_every_digit(spark):
    from roilens.functions.numeric import exact_mean

    df = spark.createDataFrame([(1.005,), (1.005,), (1.004,), (None,)], "x double")
    assert abs(df.agg(exact_mean("x").alias("m")).first()["m"] - (1.005 + 1.005 + 1.004) / 3) < 1e-15


def test_quantile_methods_agree_on_the_summary(spark):
    from conftest import SF0001
    from roilens.operators.licences import classify_users
    from roilens.plans.catalog import _summary

    s = _summary(spark, SF0001)
    dist = sorted((r["user_id"], r["category"]) for r in classify_users(s, "distributed").collect())
    builtin = sorted((r["user_id"], r["category"]) for r in classify_users(s, "builtin").collect())
    assert dist == builtin
    assert classify_users(s, "approx").count() == len(dist)
