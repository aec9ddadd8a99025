"""Governance Column factories: G1 detectors, G2 keywords, G4 composite score,
G5 type labels, G7 redaction, G9 pseudonyms, P12 levels, P13 flag.

Everything is a built-in expression (``rlike``, ``contains``,
``regexp_replace``, ``sha2``) so the scan stays in the JVM inside whole-stage
code generation: no Python worker, no per-row serialisation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import params as P
from .numeric import _c, round_dec


def _pattern(name: str, unicode: bool) -> str:
    pat = dict(P.PII_PATTERNS)[name]
    return ("(?U)" + pat) if unicode else pat


# Exact necessary conditions for a detector to match: a cheap substring test
# skips the regex on texts that cannot match (no '@' -> no e-mail, ...).
_GUARDS: dict[str, tuple[str, ...]] = {
    "email": ("@",),
    "api_key": ("sk-", "pk-", "ghp-", "xox"),
    "url_with_cred": ("://",),
}


def pii_hits(text, unicode: bool = False) -> dict[str, Column]:
    """G1: one boolean per detector (presence, i.e. regex *find*; NULL -> false).

    ``unicode=True`` makes ``\\d``/``\\b``/``\\s`` Unicode-aware like Python's
    ``re``; the default keeps ASCII classes (same answers as RE2 engines).
    """
    t = _c(text)
    out = {}
    for name, _ in P.PII_PATTERNS:
        hit = t.rlike(_pattern(name, unicode))
        guard = _GUARDS.get(name)
        if guard:
            g = F.lit(False)
            for needle in guard:
                g = g | t.contains(needle)
            hit = F.when(g, hit).otherwise(F.lit(False))
        out[name] = F.coalesce(hit, F.lit(False))
    return out


def keyword_hits(text, lowered: Column | None = None) -> dict[str, Column]:
    """One boolean per sensitive keyword (lower-cased substring)."""
    low = lowered if lowered is not None else F.lower(_c(text))
    return {kw: F.coalesce(low.contains(kw), F.lit(False)) for kw in P.SENSITIVE_KEYWORDS}


def keyword_count(hits: dict[str, Column]) -> Column:
    return sum((h.cast("int") for h in hits.values()), F.lit(0))


def keyword_labels(hits: dict[str, Column]) -> Column:
    """Matched keywords in keyword order (array<string>)."""
    return F.array_compact(F.array(*[F.when(h, F.lit(kw)) for kw, h in hits.items()]))


def risk_level(score) -> Column:
    """Critical >= 75, High >= 50, Medium >= 25, else Low."""
    s = _c(score)
    expr = F.lit("Low")
    for name, threshold in reversed(P.RISK_LEVELS):
        expr = F.when(s >= threshold, F.lit(name)).otherwise(expr)
    return expr


def risk_flag(score) -> Column:
    """1 when score >= 25."""
    return (_c(score) >= P.RISK_FLAG_THRESHOLD).cast("int")


def _score_and_types(regex: dict[str, Column], kws: dict[str, Column], empty: Column,
                     entity_score: Column | None, entity_labels: Column | None) -> dict[str, Column]:
    n_kw = keyword_count(kws)
    score = sum((F.when(hit, F.lit(P.PII_WEIGHTS[name])).otherwise(F.lit(0))
                 for name, hit in regex.items()), F.lit(0))
    score = score + F.least(n_kw * P.KEYWORD_WEIGHT, F.lit(P.KEYWORD_CAP))
    if entity_score is not None:
        score = score + entity_score
    final = F.when(empty, F.lit(0.0)).otherwise(
        F.least(round_dec(score.cast("double"), 1), F.lit(100.0)))
    labels = [F.when(hit, F.lit("REGEX:" + name.upper())) for name, hit in regex.items()]
    kw_label = F.when(n_kw > 0, F.concat(F.lit("KEYWORD:"),
                                         F.array_join(keyword_labels(kws), ",")))
    parts = F.array(*labels, kw_label)
    if entity_labels is not None:
        parts = F.concat(entity_labels, parts)
    types = F.when(empty, F.array().cast("array<string>")).otherwise(F.array_compact(parts))
    return {"risk_score": final, "pii_types": types}


def with_risk(df: DataFrame, text_col: str = "prompt_text", unicode: bool = False,
              types: bool = True, entity_score: Column | None = None,
              entity_labels: Column | None = None) -> DataFrame:
    """Add risk_score (+ pii_types), risk_level and risk_flag.

    Three projections: detector hits become boolean columns first (each regex
    and substring test runs once per row, the text is lower-cased once), then
    score and labels are built from those columns, then level and flag from
    the score. The optimizer does not merge the steps back because the hit
    columns are referenced more than once and are not cheap.
    """
    t = F.col(text_col)
    low = df.select("*", F.lower(t).alias("_low"))
    rx = pii_hits(t, unicode)
    kw = keyword_hits(None, F.col("_low"))
    rx_names = {n: f"_rx_{i}" for i, n in enumerate(rx)}
    kw_names = {k: f"_kw_{i}" for i, k in enumerate(kw)}
    hits = low.select("*", *[rx[n].alias(c) for n, c in rx_names.items()],
                      *[kw[k].alias(c) for k, c in kw_names.items()],
                      (t.isNull() | (t == "")).alias("_empty"))
    cols = _score_and_types({n: F.col(c) for n, c in rx_names.items()},
                            {k: F.col(c) for k, c in kw_names.items()}, F.col("_empty"),
                            entity_score, entity_labels)
    sel = [cols["risk_score"].alias("risk_score")]
    if types:
        sel.append(cols["pii_types"].alias("pii_types"))
    out = hits.select(*df.columns, *sel)
    return out.withColumns({"risk_level": risk_level("risk_score"),
                            "risk_flag": risk_flag("risk_score")})


def redact(text, unicode: bool = False) -> Column:
    """Replace every detector match with its token, detectors in fixed order
    (e-mail first, so a credential URL loses its host to the e-mail rule)."""
    out = _c(text)
    for name, _ in P.PII_PATTERNS:
        out = F.regexp_replace(out, _pattern(name, unicode), P.REDACTION_TOKENS[name]
                               .replace("\\", "\\\\").replace("$", "\\$"))
    return out


def pseudonym(user_id, salt: str) -> Column:
    """``USR_`` + upper(first 12 hex chars of sha256(salt:user_id))."""
    if salt is None:
        raise ValueError("a pseudonymisation salt is required")
    h = F.sha2(F.concat_ws(":", F.lit(salt), _c(user_id).cast("string")), 256)
    return F.when(_c(user_id).isNull(), F.lit(None)).otherwise(
        F.concat(F.lit("USR_"), F.upper(F.substring(h, 1, 12))))
