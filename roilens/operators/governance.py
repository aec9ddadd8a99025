"""Governance operators over text columns (G1-G10, S11) and the risk reports
(T2, T5, D12-D14).

The scan is pure Column arithmetic over ``rlike``/``contains``: it runs in
the JVM inside whole-stage code generation, with no Python worker. Each
distinct text is handled once (see ``by_distinct_text``); only
``scan_logs(dedupe=False)`` works row by row.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import params as P
from ..functions.numeric import exact_mean, exact_sum, round_dec
from ..functions.risk import keyword_hits, pii_hits, pseudonym, redact

RISK_COLUMNS = ("risk_score", "risk_level", "risk_flag", "pii_types")


def detect_pii(df: DataFrame, text_col: str = "prompt_text", unicode: bool = False) -> DataFrame:
    """G1: one boolean column ``has_<detector>`` per regex detector."""
    hits = pii_hits(F.col("_t"), unicode)
    return by_distinct_text(df, text_col, lambda d: d.select("*", *[h.alias(f"has_{n}") for n, h in hits.items()]))


def keyword_scan(df: DataFrame, text_col: str = "prompt_text") -> DataFrame:
    """Matched keywords (array, keyword order) and their count."""
    hits = keyword_hits(F.col("_t"))
    arr = F.array_compact(F.array(*[F.when(h, F.lit(k)) for k, h in hits.items()]))
    return by_distinct_text(df, text_col, lambda d: d.select("*", arr.alias("keywords")).select(
        "*", F.size("keywords").alias("keyword_count")))


def prompt_risk(df: DataFrame, text_col: str = "prompt_text", unicode: bool = False,
                entity_hook: "EntityHook | None" = None) -> DataFrame:
    """Add risk_score, pii_types, risk_level, risk_flag."""
    from ..functions.risk import with_risk

    if entity_hook is None:
        return with_risk_deduped(df, text_col, unicode=unicode)
    df = df.withColumn("_ents", entity_hook.labels(F.col(text_col)))
    out = with_risk(df, text_col, unicode, entity_score=entity_hook.score(F.col("_ents")),
                    entity_labels=entity_hook.type_labels(F.col("_ents")))
    return out.drop("_ents")


HOT_TEXT_MIN_ROWS = 100_000
MAX_HOT_TEXTS = 10_000


def by_distinct_text(df: DataFrame, text_col: str, derive: Callable[[DataFrame], DataFrame],
                     hot_min_rows: int = HOT_TEXT_MIN_ROWS, max_hot: int = MAX_HOT_TEXTS, id_col: str | None = None,
                     meanwhile: Callable[[DataFrame], DataFrame] | None = None, text_as: str = "_t") -> DataFrame:
    """``df`` and the columns that ``derive`` adds to the distinct texts (a frame with column ``_t``).

    Each distinct text is handled once. Texts are keyed by SHA-256; the rows
    take part in the join back without their text, which they get from the
    distinct texts again, so a shuffle carries a text once and not once a row.
    ``meanwhile`` is applied to the rows while they are without text (joins on
    other columns). The rows get column ``text_as`` of the derived texts as their
    text (itself, if not given). The aggregation that finds distinct texts drops copies
    map-side and its shuffle spreads the CPU-bound work over all tasks even
    when the input arrives in a few large files.

    A text of at least ``hot_min_rows`` rows is joined under several keys, one
    for every ``hot_min_rows`` rows, between which a hash deals its rows (of
    ``id_col``, or of all other columns). The rows learn of them by a broadcast
    of the ``max_hot`` most repeated ones (a top-k: at most ``max_hot`` rows);
    every other text is repeated at most ``total / max_hot`` times.
    """
    key = lambda text: F.coalesce(F.unhex(F.sha2(text, 256)), F.unhex(F.lit("")))  # noqa: E731 - null is a text like any other
    rows = df.withColumn("_k", key(F.col(text_col))).drop(text_col)
    rows = rows if meanwhile is None else meanwhile(rows)
    distinct = df.groupBy(F.col(text_col).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    derived = derive(distinct)
    added = [c for c in derived.columns if c not in ("_t", "_n", text_as)]
    parts = F.ceil(F.col("_n") / F.lit(hot_min_rows)).cast("int")
    hot = (distinct.where(F.col("_n") >= hot_min_rows).select(key(F.col("_t")).alias("_hk"), "_n")
           .orderBy(F.col("_n").desc(), "_hk").limit(max_hot).select("_hk", parts.alias("_parts")))
    # the count stays in use, so that all sides share one aggregation (and its exchange)
    known = derived.select(key(F.col("_t")).alias("_jk"), F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)).alias("_js"),
                           F.col(text_as).alias("_text"), *[F.col(c).alias("_d_" + c) for c in added])
    dealt = [F.col(c) for c in ([id_col] if id_col else rows.columns)]
    salt = F.coalesce(F.pmod(F.xxhash64(*dealt), F.col("_parts")).cast("int"), F.lit(0))
    keyed = rows.join(F.broadcast(hot), F.col("_k") == F.col("_hk"), "left").withColumn("_s", salt)
    joined = keyed.join(known, (F.col("_k") == F.col("_jk")) & (F.col("_s") == F.col("_js")), "left")
    own = [c for c in df.columns if c in rows.columns or c == text_col]
    more = [c for c in rows.columns if c not in own and c != "_k"]
    return joined.select(*[F.col("_text").alias(c) if c == text_col else F.col(c) for c in own],
                         *[F.col("_d_" + c).alias(c) for c in added], *more)


def with_risk_deduped(df: DataFrame, text_col: str = "prompt_text", types: bool = True,
                      unicode: bool = False, hot_min_rows: int = HOT_TEXT_MIN_ROWS,
                      max_hot: int = MAX_HOT_TEXTS, id_col: str | None = None,
                      meanwhile: Callable[[DataFrame], DataFrame] | None = None,
                      texts: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """``with_risk`` that scores each distinct text once (see ``by_distinct_text``). ``texts(frame, column)`` may change the
    distinct texts after they are scored, as ``redact_frame`` with ``distinct`` does: the rows get the changed ones."""
    from ..functions.risk import with_risk

    def derive(d: DataFrame) -> DataFrame:
        scored = with_risk(d, "_t", unicode, types=types)
        return scored if texts is None else texts(scored.withColumn("_changed", F.col("_t")), "_changed")

    return by_distinct_text(df, text_col, derive, hot_min_rows, max_hot, id_col, meanwhile, "_t" if texts is None else "_changed")


def scan_logs(logs: DataFrame, id_col: str = "prompt_id", text_col: str = "prompt_text",
              dedupe: bool = False, unicode: bool = False) -> DataFrame:
    """One result row per input row: id, risk_score, risk_level, risk_flag, pii_types."""
    base = logs.select(id_col, text_col)
    if dedupe:
        out = with_risk_deduped(base, text_col, True, unicode, id_col=id_col)
    else:
        from ..functions.risk import with_risk
        out = with_risk(base, text_col, unicode)
    return out.select(id_col, "risk_score", "risk_level", "risk_flag", "pii_types")


def apply_risk_update(logs: DataFrame, updates: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Keyed update of the risk columns (new value wins, else the old one).

    A left join on the primary key plus ``coalesce`` replaces the row-by-row
    UPDATE; the result is rewritten in one pass.
    """
    upd_cols = [c for c in ("risk_score", "risk_level", "risk_flag") if c in updates.columns]
    u = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in upd_cols])
    j = logs.join(u, key, "left")
    out = []
    for c in logs.columns:
        if c in upd_cols:
            out.append(F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    extra = [F.col(f"_new_{c}").alias(c) for c in upd_cols if c not in logs.columns]
    return j.select(*out, *extra)


def redact_frame(df: DataFrame, text_col: str = "prompt_text", user_col: str | None = None,
                 pseudonymise: bool = False, salt: str | None = None,
                 unicode: bool = False, distinct: bool = False) -> DataFrame:
    """Redact a text column; optionally pseudonymise a user column.
    Missing columns are ignored; the input DataFrame is immutable anyway.
    ``distinct``: no text is in several rows, so each row is redacted where it is."""
    out = df
    if text_col in df.columns and distinct:
        out = out.withColumn(text_col, redact(F.col(text_col), unicode))
    elif text_col in df.columns:  # each distinct text is redacted once
        out = by_distinct_text(out, text_col, lambda d: d.withColumn("_redacted", redact(F.col("_t"), unicode)))
        out = out.select(*[F.col("_redacted").alias(c) if c == text_col else F.col(c) for c in df.columns])
    if pseudonymise and user_col and user_col in df.columns:
        out = out.withColumn(user_col, pseudonym(F.col(user_col), salt))
    return out


def _chunks(text: str, size: int):
    """(offset, piece) covering the whole text; pieces end at whitespace when
    one exists within the next ``size`` characters."""
    start, n = 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            cut = max(text.rfind(" ", start, end), text.rfind("\n", start, end))
            if cut > start:
                end = cut + 1
        yield start, text[start:end]
        start = end


def _detect_chunked(detect, text: str, size: int) -> list:
    out = []
    for off, piece in _chunks(text, size):
        out.extend((label, a + off, b + off) for label, a, b in detect(piece))
    return out


class EntityHook:
    """G3/G8 optional hook: a user-supplied entity detector run as an iterator
    pandas UDF (the model is loaded once per Python worker, texts arrive in
    Arrow batches). Default off.

    ``factory()`` returns ``detect(text) -> list[(label, start, end)]``.
    The whole text is processed: it is handed to the detector in chunks of
    about ``ENTITY_TEXT_LIMIT`` characters (cut at whitespace), and spans are
    shifted back to positions in the full text.
    """

    LABELS = tuple(P.ENTITY_WEIGHTS)

    def __init__(self, factory: Callable[[], Callable[[str], list]]):
        self.factory = factory

    def _udf(self, with_spans: bool):
        factory = self.factory
        labels = self.LABELS
        rtype = (T.ArrayType(T.StructType([T.StructField("label", T.StringType()),
                                          T.StructField("start", T.IntegerType()),
                                          T.StructField("end", T.IntegerType())]))
                 if with_spans else T.ArrayType(T.StringType()))

        @F.pandas_udf(rtype)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            detect = factory()
            for s in batches:
                out = []
                for t in s:
                    if not isinstance(t, str) or not t:
                        out.append([])
                        continue
                    ents = _detect_chunked(detect, t, P.ENTITY_TEXT_LIMIT)
                    if with_spans:
                        out.append([{"label": a, "start": b, "end": c} for a, b, c in ents])
                    else:
                        seen = []
                        for a, _, _ in ents:
                            if a in labels and a not in seen:
                                seen.append(a)
                        out.append(seen)
                yield pd.Series(out)

        return run

    def labels(self, text: Column) -> Column:
        """First-seen distinct scored labels per text (array<string>)."""
        return self._udf(False)(text)

    def spans(self, text: Column) -> Column:
        return self._udf(True)(text)

    def score(self, labels: Column) -> Column:
        m = F.create_map(*[x for k, v in P.ENTITY_WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
        return F.aggregate(labels, F.lit(0), lambda acc, l: acc + F.coalesce(F.try_element_at(m, l), F.lit(0)))

    def type_labels(self, labels: Column) -> Column:
        return F.transform(labels, lambda l: F.concat(F.lit("NER:"), l))

    def redact_entities(self, df: DataFrame, text_col: str = "prompt_text") -> DataFrame:
        """After regex redaction, replace entity spans right to left."""
        tokens = F.create_map(*[x for k, v in P.REDACTION_TOKENS.items() if k.isupper()
                                for x in (F.lit(k), F.lit(v))])
        spans = F.sort_array(F.transform(self.spans(F.col(text_col)),
                                         lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                            s["label"].alias("label"))), asc=False)

        def step(acc, s):
            tok = F.coalesce(F.try_element_at(tokens, s["label"]),
                             F.concat(F.lit("["), s["label"], F.lit("_REDACTED]")))
            return F.concat(F.substring(acc, F.lit(1), s["start"]), tok, F.substr(acc, s["end"] + 1))

        red = F.aggregate(spans, F.col(text_col), step)
        return df.withColumn(text_col, F.when(F.col(text_col).isNull(), F.col(text_col)).otherwise(red))


def worst_prompts(logs: DataFrame, n: int = 25) -> DataFrame:
    """The n highest-risk prompts with a 100-character preview."""
    return (logs.where(F.col("risk_score") > 0)
            .select("prompt_id", "user_id", "department", "model_name", "timestamp", "risk_score", "risk_level",
                    F.concat(F.substring("prompt_text", 1, 100), F.lit("...")).alias("prompt_preview"))
            .orderBy(F.col("risk_score").desc(), "prompt_id").limit(n))


def incident_log(enriched: DataFrame, n: int = 20) -> DataFrame:
    """T5: top-n flagged prompts by score, 80-character preview (tie-break: prompt_id)."""
    return (enriched.where(F.col("risk_score") > 0)
            .orderBy(F.col("risk_score").desc(), "prompt_id").limit(n)
            .select("user_id", "department", "model_name", "risk_level",
                    round_dec(F.col("risk_score"), 1).alias("risk_score"),
                    F.concat(F.substring("prompt_text", 1, 80), F.lit("…")).alias("prompt_text"),
                    "timestamp"))


def risk_rollup(enriched: DataFrame) -> DataFrame:
    """Risk exposure root -> department -> level (ROLLUP, grouping_id marks the level)."""
    return (enriched.where(F.col("risk_score") > 0)
            .rollup("department", "risk_level")
            .agg(exact_sum("risk_score", 1).alias("total_risk"), F.grouping_id().alias("grouping_level")))


def corporate_risk(enriched: DataFrame) -> DataFrame:
    """Mean of positive risk scores, 1 dp, 0 when none."""
    s = F.col("risk_score")
    return enriched.agg(F.coalesce(round_dec(exact_mean(F.when(s > 0, s)), 1), F.lit(0.0))
                        .alias("corporate_risk_index"))


def pii_by_department(enriched: DataFrame) -> DataFrame:
    """Flagged prompts per department."""
    return (enriched.where((F.col("risk_flag") == 1) & F.col("department").isNotNull())
            .groupBy("department").agg(F.count("prompt_id").alias("pii_events"))
            .orderBy(F.col("pii_events").desc(), "department"))
