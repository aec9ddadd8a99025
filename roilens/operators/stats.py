"""Statistics: ST1 Pearson, ST2 Spearman, ST3 OLS, ST4 p-values, ST5 spend
vs productivity, and the ranks and quantiles that other operators use.

Moments come from built-in aggregates (``corr``, ``regr_*``), one distributed
pass with map-side partials. Ranks and quantiles are found without a global
window and without a value map in one task: values are cut into ranges at
approximate quantiles, which stay in the plan (array-valued scalar subqueries,
or a sketch for each key), ranges are counted, and a running count inside a
range gives the exact rank. Nothing runs while a plan is built.

P-values are Column expressions (the incomplete beta function).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import params as P
from ..functions.numeric import round_dec


# ---------------------------------------------------------------- ST4

#: Steps of the continued fraction below; it converges in O(sqrt(max(a, b))) of them, and large degrees of freedom take
#: the normal expansion instead.
BETA_STEPS, LARGE_DF = 200, 5000.0

#: Stirling's correction to log(gamma) at 8 and beyond (1/12, -1/360, 1/1260, -1/1680, 1/1188), fixed values.
STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188)


def _log_gamma(x: Column) -> Column:
    """log(gamma(x)), x > 0: shifted by 8, then Stirling's series."""
    shift = F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(x + float(i))
    z = x + 8.0
    series = sum((F.lit(c) / F.pow(z, float(2 * i + 1)) for i, c in enumerate(STIRLING)), F.lit(0.0))
    return (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    """The incomplete beta function's continued fraction, evaluated from its far end."""
    def term(m):
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        return even, odd

    def step(acc, k):
        even, odd = term(F.lit(float(BETA_STEPS)) - k)
        return F.lit(1.0) + even / (F.lit(1.0) + odd / acc)

    # 1 / (1 + d1/(1 + d2/(1 + ...))) with d(2m) = even(m), d(2m+1) = odd(m)
    tail = F.aggregate(F.sequence(F.lit(0), F.lit(BETA_STEPS - 1)), F.lit(1.0), lambda acc, k: step(acc, k.cast("double")))
    _, first = term(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + first / tail)


def _beta_inc(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function."""
    front = F.exp(_log_gamma(a + b) - _log_gamma(a) - _log_gamma(b) + a * F.log(x) + b * F.log1p(-x))
    return (F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0))
            .when(x < (a + 1.0) / (a + b + 2.0), front * _beta_fraction(a, b, x) / a)
            .otherwise(F.lit(1.0) - front * _beta_fraction(b, a, F.lit(1.0) - x) / b))


def _normal_tail(z: Column) -> Column:
    """P(|Z| >= z) of the normal distribution: the incomplete gamma function of 1/2, as series or continued fraction."""
    x = z * z / 2.0
    near = F.aggregate(F.sequence(F.lit(1), F.lit(60)), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")),
                       lambda acc, k: F.struct((acc["t"] * x / (k + 0.5)).alias("t"),
                                               (acc["s"] + acc["t"] * x / (k + 0.5)).alias("s")), lambda acc: acc["s"])
    far = F.aggregate(F.sequence(F.lit(0), F.lit(59)), F.lit(0.0),
                      lambda acc, k: (F.lit(60.0) - k) * (F.lit(59.5) - k) / (x + 2.0 * (F.lit(60.0) - k) + 0.5 - acc))
    scale = F.exp(-x) / math.sqrt(math.pi)
    return F.when(x < 4.0, F.lit(1.0) - scale * F.sqrt(x) * 2.0 * near).otherwise(scale * F.sqrt(x) / (x + 0.5 - far))


def t_two_sided_p(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's t with ``df`` degrees of freedom, as a Column (NaN without any).

    The incomplete beta function by its continued fraction; beyond ``LARGE_DF`` the normal tail at the argument with the
    same tail up to 1/df^2, so the number of steps does not grow with the rows.
    """
    x = df / (df + t * t)
    squeezed = t * (1.0 - 1.0 / (4.0 * df)) / F.sqrt(1.0 + t * t / (2.0 * df))
    return (F.when(t.isNull() | df.isNull() | F.isnan(t) | (df <= 0), F.lit(float("nan")))
            .when(F.abs(t) == float("inf"), F.lit(0.0))
            .when(df > LARGE_DF, _normal_tail(F.abs(squeezed)))
            .otherwise(_beta_inc(df / 2.0, F.lit(0.5), x)))


def r_pvalue(r: Column, n: Column) -> Column:
    """Two-sided p-value of a correlation r on n pairs (t = r sqrt((n-2)/(1-r^2))); 1 below three pairs."""
    df = F.greatest(n - 2, F.lit(1)).cast("double")
    t = F.when(F.abs(r) >= 1.0, F.lit(float("inf"))).otherwise(r * F.sqrt(df / F.greatest(F.lit(1.0) - r * r, F.lit(1e-300))))
    return F.when(n < 3, F.lit(1.0)).otherwise(t_two_sided_p(t, df))


def interpretation(r: Column, p: Column) -> Column:
    """Wording of a correlation."""
    strength = (F.when(F.abs(r) >= P.STRONG_R, "Strong").when(F.abs(r) >= P.MODERATE_R, "Moderate")
                .otherwise("Weak"))
    direction = F.when(r > 0, "positive").otherwise("negative")
    return F.when(p >= P.SIGNIFICANCE_P, F.lit("Not statistically significant")).otherwise(
        F.format_string("%s %s correlation (r=%.2f, p=%.3f)", strength, direction, r, p))


# ---------------------------------------------------------------- ST1 / ST3

def _complete(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))


def _moments(pairs: DataFrame, keys: list[str]) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    aggs = [F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"),
            F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"),
            F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy")]
    return pairs.groupBy(*keys).agg(*aggs) if keys else pairs.agg(*aggs)


def _finish(m: DataFrame, keys: list[str]) -> DataFrame:
    n, r = F.col("n"), F.col("r")
    enough = n >= 3
    se = F.sqrt(F.greatest((1.0 - r * r), F.lit(0.0)) * F.col("syy") / F.col("sxx") / (n - 2))
    out = m.select(*keys, "n",
                   F.when(enough, r).otherwise(F.lit(0.0)).alias("_r"),
                   F.when(enough, F.col("slope")).otherwise(F.lit(0.0)).alias("_slope"),
                   F.when(enough, F.col("intercept")).otherwise(F.lit(0.0)).alias("_intercept"),
                   F.when(enough, F.coalesce(F.col("r2"), r * r)).otherwise(F.lit(0.0)).alias("_r2"),
                   F.when(enough & (F.col("sxx") > 0), se).alias("_se"))
    return out


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """ST1: r (4 dp), n, p (4 dp), significance and wording; n < 3 -> r 0, p 1."""
    m = _finish(_moments(_complete(df, x, y), []), [])
    p = r_pvalue(F.col("_r"), F.col("n"))
    return (m.select("n", F.col("_r").alias("r"), p.alias("p"))
            .select("n", round_dec("r", 4).alias("pearson_r"), round_dec("p", 4).alias("pearson_p"),
                    (F.col("p") < P.SIGNIFICANCE_P).alias("significant"),
                    F.when(F.col("n") < 3, F.lit("Insufficient data"))
                    .otherwise(interpretation(F.col("r"), F.col("p"))).alias("interpretation")))


def ols(df: DataFrame, x: str, y: str) -> DataFrame:
    """ST3: slope (6 dp), intercept (4), R^2 (4), p (4), std err (6), n."""
    m = _finish(_moments(_complete(df, x, y), []), [])
    p = r_pvalue(F.col("_r"), F.col("n"))
    return m.select(round_dec("_slope", 6).alias("slope"), round_dec("_intercept", 4).alias("intercept"),
                    round_dec("_r2", 4).alias("r_squared"), round_dec(p, 4).alias("p_value"),
                    round_dec("_se", 6).alias("std_err"),
                    F.when(F.col("n") >= 3, F.col("n")).otherwise(F.lit(0)).alias("n"))


def ols_predictions(df: DataFrame, x: str, y: str) -> DataFrame:
    """ST3: fitted values for every complete pair (a frame, not a driver list)."""
    pairs = _complete(df, x, y)
    fit = pairs.agg(F.struct(F.regr_slope("y", "x").alias("b1"), F.regr_intercept("y", "x").alias("b0"),
                             F.count(F.lit(1)).alias("n"))).scalar()
    ok = fit["n"] >= 3
    return pairs.select("x", "y", F.when(ok, fit["b1"] * F.col("x") + fit["b0"]).alias("predicted"))


# ---------------------------------------------------------------- cut points, ranks, quantiles

def bucket_count(df: DataFrame) -> int:
    """As many value ranges as the session has shuffle partitions (16 at least)."""
    return max(16, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _cuts(col: Column | str, buckets: int) -> Column:
    """``buckets - 1`` approximate quantiles as an aggregate, a sorted array. A value that fills a range of its own occurs
    twice or more in it."""
    return F.percentile_approx(col, [i / buckets for i in range(1, buckets)], 100 * buckets)


def _below(cuts: Column, x: Column, buckets: int) -> Column:
    """How many cut points are smaller than x: binary search in the sorted array (0 without cut points)."""
    steps = [1 << i for i in reversed(range(buckets.bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0),
                       lambda at, s: F.when(F.get(cuts, at + s - 1) < x, at + s).otherwise(at))


def with_average_ranks(rows: DataFrame, ranks: dict[str, str], weight: str, buckets: int | None = None) -> DataFrame:
    """``rows`` with the average (tie-averaged, 1-based) rank of each column of ``ranks`` under the given name, a row
    counting ``weight`` (> 0) times.

    Cut points and totals of the ranges are two scalar subqueries (an array and
    a map for each column), so nothing runs while the plan is built. A value
    that fills a range of its own is a range of its own: its rank follows from
    the totals, and its rows are dealt by a hash of the whole row. All others
    meet in one window for each range, which no single value fills. No row is
    joined with anything.
    """
    buckets = buckets or bucket_count(rows)
    w = F.col(weight)
    # cut points read the weight too, so that all uses of a grouped frame have the same columns and share its shuffle
    sketch = rows.agg(F.struct(*[_cuts(F.when(w > 0, F.col(c)), buckets).alias(c) for c in ranks])).scalar()
    placed = rows.withColumn("_sketch", sketch)  # a subquery is copied wherever it is written, so it is written once
    placed = placed.withColumns({f"_below_{c}": _below(F.col("_sketch")[c], F.col(c), buckets) for c in ranks})

    def own(c):
        cuts, at = F.col("_sketch")[c], F.col(f"_below_{c}")
        return F.coalesce((F.get(cuts, at) == F.col(c)) & (F.get(cuts, at + 1) == F.col(c)), F.lit(False))

    placed = placed.select(*rows.columns, *[own(c).alias(f"_own_{c}") for c in ranks], *[
        # the values between two cut points, or the upper cut point if that is a range of its own
        (2 * F.col(f"_below_{c}") + own(c).cast("int")).alias(f"_range_{c}") for c in ranks])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"_range_{c}").alias("r")) for c in ranks]))
    totals = placed.select(w.alias("w"), each.alias("k")).groupBy("k.c", "k.r").agg(F.sum("w").alias("n"))
    before = F.coalesce(F.sum("n").over(  # at most 2 x buckets rows a column
        Window.partitionBy("c").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = totals.select(F.concat("c", F.lit(":"), "r").alias("k"), F.struct("n", before.alias("before")).alias("v")).agg(
        F.map_from_entries(F.collect_list(F.struct("k", "v")))).scalar()
    out = placed.withColumn("_known", known).withColumns({f"_at_{c}": F.try_element_at(
        "_known", F.concat(F.lit(f"{c}:"), F.col(f"_range_{c}"))) for c in ranks}).drop("_known")
    for c, name in ranks.items():
        at, mine = F.col(f"_at_{c}"), F.col(f"_own_{c}")
        out = out.withColumn("_deal", F.when(mine, F.xxhash64(*rows.columns)).otherwise(F.lit(0)))
        window = Window.partitionBy(f"_range_{c}", "_deal")
        out = out.withColumn("_upto", F.sum(w).over(window.orderBy(c).rangeBetween(
            Window.unboundedPreceding, Window.currentRow))).withColumn(
            "_ties", F.sum(w).over(Window.partitionBy(f"_range_{c}", "_deal", c)))
        out = out.withColumn(name, at["before"] + F.when(mine, (at["n"] + 1) / 2.0).otherwise(
            F.col("_upto") - F.col("_ties") + (F.col("_ties") + 1) / 2.0))
    return out.select(*rows.columns, *ranks.values())


def average_ranks(df: DataFrame, col: str, out: str, buckets: int | None = None) -> DataFrame:
    """Average rank of ``col`` over the whole frame (see ``with_average_ranks``)."""
    return with_average_ranks(df.withColumn("_one", F.lit(1)), {col: out}, "_one", buckets).drop("_one")


def exact_quantiles(df: DataFrame, spec: dict[str, list[float]], keys: tuple[str, ...] | list[str] = (),
                    buckets: int | None = None) -> DataFrame:
    """Exact, linearly interpolated quantiles ``<col>_q<i>`` of several columns, for each key (a null key is one too) or
    overall, by rank selection: no task ever holds a group.

    1. Distinct (key, column, value) with their counts; copies of a value are one row from here on.
    2. Each (key, column) gets approximate cut points (a sketch of bounded size), each value its range among them.
    3. Ranges are counted; only those that hold a wanted rank stay (two for each quantile at most).
    4. Inside these a running count finds the values at ranks ``floor(h)`` and ``ceil(h)``, ``h = (n - 1) p``; the quantile
       is ``lo + (hi - lo) (h - floor h)``.

    Without keys there is one row; a key without values in any column has no row. Nulls are ignored.
    """
    buckets = buckets or bucket_count(df)
    names, probs = list(spec), sorted({p for ps in spec.values() for p in ps})
    stack = ", ".join(f"'{c}', cast(`{c}` as double)" for c in names)
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)  # in a struct, null keys join
    v = (df.select(group.alias("_g"), F.expr(f"stack({len(names)}, {stack}) as (_name, _x)"))
         .where(F.col("_x").isNotNull()).groupBy("_g", "_name", "_x").agg(F.count(F.lit(1)).alias("_c")))
    sketch = v.groupBy("_g", "_name").agg(_cuts("_x", buckets).alias("_cuts"), F.sum("_c").alias("_n"))
    v = v.join(sketch, ["_g", "_name"]).withColumn("_b", _below(F.col("_cuts"), F.col("_x"), buckets))
    h = [(F.col("_n") - 1).cast("double") * p for p in probs]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in h for f in (F.floor, F.ceil)]))
    totals = (v.groupBy("_g", "_name", "_b").agg(F.sum("_c").alias("_bt"), F.first("_n").alias("_n"))
              .withColumn("_off", F.coalesce(F.sum("_bt").over(  # as many rows as ranges
                  Window.partitionBy("_g", "_name").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    wanted = totals.where(F.exists(ranks, lambda r: (r >= F.col("_off")) & (r < F.col("_off") + F.col("_bt"))))
    inside = Window.partitionBy("_g", "_name", "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    found = v.select("_g", "_name", "_b", "_x", "_c").join(
        wanted.select("_g", "_name", "_b", "_off", "_n"), ["_g", "_name", "_b"]).withColumn(
        "_cum", F.col("_off") + F.sum("_c").over(inside))
    aggs = []
    for name in names:
        mine = F.col("_name") == name
        aggs.append(F.max(F.when(mine, F.col("_n"))).alias(f"_n_{name}"))
        for i, p in enumerate(spec[name]):
            at = (F.col("_n") - 1).cast("double") * float(p)
            aggs.append(F.min(F.when(mine & (F.col("_cum") > F.floor(at)), F.col("_x"))).alias(f"_lo_{name}_{i}"))
            aggs.append(F.min(F.when(mine & (F.col("_cum") > F.ceil(at)), F.col("_x"))).alias(f"_hi_{name}_{i}"))
    g = found.groupBy("_g").agg(*aggs) if keys else found.agg(*aggs)
    out = [F.col("_g")[k].alias(k) for k in keys]
    for name in names:
        for i, p in enumerate(spec[name]):
            at = (F.col(f"_n_{name}") - 1).cast("double") * float(p)
            lo, hi = F.col(f"_lo_{name}_{i}"), F.col(f"_hi_{name}_{i}")
            out.append((lo + (hi - lo) * (at - F.floor(at))).alias(f"{name}_q{i}"))
    return g.select(*out)


def add_quantiles(grouped: DataFrame, rows: DataFrame, keys: list[str], spec: dict[str, list[float]]) -> DataFrame:
    """``grouped`` (one row a key) with the quantiles of ``rows`` for each key, null where a key has no values."""
    q = exact_quantiles(rows, spec, keys)
    names = [F.col(c).alias(f"_k_{c}") if c in keys else F.col(c) for c in q.columns]
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return grouped.join(q.select(*names), same, "left").drop(*[f"_k_{k}" for k in keys])


# ---------------------------------------------------------------- ST2

def _rank_moments(pairs: DataFrame) -> DataFrame:
    """One row: n and rho over the complete pairs (x, y).

    Distinct pairs with their counts get both ranks by ``with_average_ranks``; rho is their correlation, weighted by the
    counts. Doubled ranks are integers with the mean n + 1, so all sums are exact and do not depend on row order.
    """
    distinct = pairs.groupBy("x", "y").agg(F.count(F.lit(1)).alias("w"))
    ranked = with_average_ranks(distinct, {"x": "rx", "y": "ry"}, "w")
    a, b, w = (2 * F.col("rx")).cast("decimal(13,0)"), (2 * F.col("ry")).cast("decimal(13,0)"), F.col("w").cast("decimal(12,0)")
    m = ranked.agg(F.sum("w").alias("n"), *[F.sum(x * y * w).cast("decimal(38,0)").alias(name)
                                            for name, x, y in (("ab", a, b), ("aa", a, a), ("bb", b, b))])
    n = F.col("n").cast("decimal(12,0)")

    def centred(name):
        return (F.col(name) - n * (n + 1).cast("decimal(13,0)") * (n + 1).cast("decimal(13,0)")).cast("double")

    return m.select(F.coalesce("n", F.lit(0)).alias("n"), F.try_divide(
        centred("ab"), F.sqrt(centred("aa")) * F.sqrt(centred("bb"))).alias("rho"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """ST2: rho (4 dp), p (4 dp), n, significance; n < 3 -> rho 0, p 1."""
    m = _rank_moments(_complete(df, x, y))
    rho = F.when(F.col("n") >= 3, F.col("rho")).otherwise(F.lit(0.0))
    m = m.select("n", rho.alias("rho")).withColumn("p", r_pvalue(F.col("rho"), F.col("n")))
    return m.select("n", round_dec("rho", 4).alias("spearman_rho"), round_dec("p", 4).alias("spearman_p"),
                    (F.col("p") < P.SIGNIFICANCE_P).alias("significant"))


# ---------------------------------------------------------------- ST5

RELATIONSHIPS = (
    ("cost_vs_hours_saved", "hours_saved_per_ticket"),
    ("cost_vs_efficiency", "pct_improvement"),
    ("cost_vs_tickets", "tickets_closed"),
    ("cost_vs_roi", "net_roi"),
)


def _long_pairs(summary: DataFrame) -> DataFrame:
    """Unpivot the four targets into (label, x, y) so one grouped pass does all."""
    stack = ", ".join(f"'{lbl}', cast({col} as double)" for lbl, col in RELATIONSHIPS)
    return (summary.select(F.col("total_cost").cast("double").alias("x"),
                           *[F.col(c) for _, c in RELATIONSHIPS])
            .select("x", F.expr(f"stack({len(RELATIONSHIPS)}, {stack}) as (label, y)"))
            .where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")))


def spend_vs_productivity(summary: DataFrame, with_p: bool = False) -> DataFrame:
    """ST5: spend vs four outcomes; Spearman for the first (hours saved) only.

    ``with_p=False`` gives the SQL-comparable measures; ``with_p=True`` adds
    p-values, significance and the wording.
    """
    from ..sources.tables import with_missing

    long = _long_pairs(with_missing(summary, ["total_cost", *[c for _, c in RELATIONSHIPS]]))  # S4: missing measures are 0
    m = _finish(_moments(long, ["label"]), ["label"])
    first = RELATIONSHIPS[0][0]
    sp = _rank_moments(long.where(F.col("label") == first).select("x", "y"))
    sp = sp.select(F.struct("rho", "n")).scalar()  # of one relationship only
    sn = F.col("_sp")["n"]
    j = m.withColumn("_sp", sp).withColumn("_rho", F.when((F.col("label") == first) & (sn > 0), F.when(
        sn >= 3, F.col("_sp")["rho"]).otherwise(F.lit(0.0)))).drop("_sp")
    rho = F.col("_rho")
    cols = ["label", "n",
            round_dec("_r", 4).alias("pearson_r"),
            round_dec(rho, 4).alias("spearman_rho"),
            round_dec("_slope", 6).alias("slope"),
            round_dec("_intercept", 4).alias("intercept"),
            round_dec("_r2", 4).alias("r_squared"),
            round_dec("_se", 6).alias("std_err")]
    out = j.select(*cols, "_r", rho.alias("_rho2"))
    if with_p:
        p = r_pvalue(F.col("_r"), F.col("n"))
        sp_p = F.when(F.col("_rho2").isNotNull(), r_pvalue(F.col("_rho2"), F.col("n")))
        out = (out.withColumn("_p", p)
               .withColumn("pearson_p", round_dec("_p", 4))
               .withColumn("spearman_p", round_dec(sp_p, 4))
               .withColumn("significant", F.col("_p") < P.SIGNIFICANCE_P)
               .withColumn("interpretation",
                           F.when(F.col("n") < 3, F.lit("Insufficient data"))
                           .otherwise(interpretation(F.col("_r"), F.col("_p"))))
               .drop("_p"))
    return out.drop("_r", "_rho2").orderBy("label")
