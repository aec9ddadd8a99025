"""URL filters by association rules.

URLs are cut into typed tokens (host labels and their parts, the last two host
labels, path words, file ending, query names). FP-growth (Spark ML) mines
frequent token sets together with a label; the rules ``tokens => block`` and
``tokens => allow`` that reach ``min_support`` (a share of the labelled rows, and
``MIN_ROWS`` of them at least) and ``min_confidence`` are kept,
and a rule is pruned if a rule over fewer of its tokens is at least as
confident for the same label. Tokens that occur in exactly the same labelled rows
(as those of a long URL that repeats do) would make rules of all their subsets,
alike in support and confidence; they are mined as one item, named by the least
of them, and a URL has the item if it has any of them, which is what those rules
together say. Rules match through an inverted index: each rule
is posted under its rarest token, a URL looks up its own tokens, and a posting
holds if the URL has all of the rule's tokens. The most confident matching rule
decides (ties: more tokens, then block before allow); without one the default
verdict does. Hand-written rules (host, path) come before mined ones.

Defined results: a null URL or one without ``://`` has empty host and path, no
tokens and the default verdict; repeated rows are judged alike; with no labels
no rules are mined; an empty table gives an empty result; other columns are not
read (but for the id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE = 0.005, 25, 0.8
BLOCK, ALLOW = "label:block", "label:allow"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null URL or one without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(F.lit("")), F.when(has, path).otherwise(F.lit(""))


def tokens(url: Column) -> Column:
    """The set of a URL's typed tokens."""
    host, path = host_path(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    typed = lambda kind, words: F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(f"{kind}:"), w))
    parts = F.concat(
        typed("host", labels), typed("part", F.split(host, r"[.\-]")),
        F.when(host != "", F.array(F.concat(F.lit("end:"), F.substring_index(host, ".", -2)),
                                   F.concat(F.lit("top:"), F.substring_index(host, ".", -1)))).otherwise(F.array().cast("array<string>")),
        typed("path", F.split(F.lower(path), r"[/._\-]+")),
        typed("arg", F.transform(F.split(query, "&"), lambda a: F.substring_index(a, "=", 1))))
    return F.array_distinct(parts)


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rules (tokens, verdict, confidence, support) from (url, blocked boolean), their tokens being items, and the items
    (item, alike) with the tokens that each stands for."""
    baskets = labelled.where("blocked is not null").select(F.array_union(
        tokens(F.col("url")), F.array(F.when(F.col("blocked"), BLOCK).otherwise(F.lit(ALLOW)))).alias("items"))
    baskets = cut(baskets.withColumn("row", F.monotonically_increasing_id()))  # written, so it stays the same
    n = baskets.count()
    support = min(1.0, max(min_support, MIN_ROWS / max(1, n)))
    # tokens of the same rows: as many rows, and the same sums of the rows' hashes
    row = F.xxhash64("items").cast("decimal(38,0)")
    counted = baskets.select(F.explode("items").alias("token"), row.alias("h"), F.xxhash64("items", F.lit(1)).cast(
        "decimal(38,0)").alias("h2")).groupBy("token").agg(F.count("*").alias("n"), F.sum("h").alias("h"), F.sum("h2").alias("h2"))
    frequent = counted.where((F.col("n") >= support * n) & ~F.col("token").isin(BLOCK, ALLOW))
    items = cut(frequent.groupBy("n", "h", "h2").agg(F.array_sort(F.collect_list("token")).alias("alike")).select(
        F.element_at("alike", 1).alias("item"), "alike"))
    # only an item's name is looked for: its other tokens stand in the same rows
    words = baskets.select("row", "items", F.explode("items").alias("item"))
    words = words.join(items.select("item"), "item", "left_semi").groupBy("row").agg(
        F.collect_list("item").alias("names"), F.first("items").alias("items"))
    merged = cut(words.select(F.array_union("names", F.array_intersect("items", F.array(F.lit(BLOCK), F.lit(ALLOW)))).alias("items")))
    parts = int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # rows without a frequent token are not among the merged ones: the support is that of all rows all the same
    m = merged.count()
    share = min(1.0, support * n / max(1, m))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=min_confidence, numPartitions=parts).fit(merged)
    rules = model.associationRules.where(F.array_contains(F.lit([BLOCK, ALLOW]), F.col("consequent")[0])).select(
        F.array_sort("antecedent").alias("tokens"), F.substring_index(F.col("consequent")[0], ":", -1).alias("verdict"),
        "confidence", (F.col("support") * (m / max(1, n))).alias("support"))
    rules = cut(rules)
    # a rule loses to one with fewer of its tokens, the same verdict and no less confidence
    small = rules.select(F.col("tokens").alias("s_tokens"), F.col("verdict").alias("s_verdict"),
                         F.col("confidence").alias("s_confidence"), F.explode("tokens").alias("token"))
    small = small.where(F.col("token") == F.element_at("s_tokens", 1))
    wide = rules.withColumn("token", F.explode("tokens"))
    beaten = wide.join(small, (wide.token == small.token) & (wide.verdict == small.s_verdict) & (F.size("tokens") > F.size("s_tokens"))
                       & (F.col("s_confidence") >= F.col("confidence")) & (F.size(F.array_except("s_tokens", "tokens")) == 0),
                       "left_semi").select("tokens", "verdict")
    kept = cut(rules.join(beaten, ["tokens", "verdict"], "left_anti"))
    return kept, items.join(kept.select(F.explode("tokens").alias("item")).distinct(), "item", "left_semi")


def match(pages: DataFrame, rules: DataFrame, items: DataFrame) -> DataFrame:
    """(id, verdict, confidence, mined): the best mined rule of each id, for (id, url) with one row per id."""
    words = pages.select("id", F.explode(tokens(F.col("url"))).alias("token")).join(
        items.select("item", F.explode("alike").alias("token")), "token").groupBy("id").agg(F.collect_set("item").alias("have"))
    frequency = rules.select(F.explode("tokens").alias("token")).distinct().join(
        words.select(F.explode("have").alias("token")), "token").groupBy("token").agg(F.count("*").alias("n"))
    posted = rules.withColumn("token", F.explode("tokens")).join(frequency, "token").groupBy("tokens", "verdict", "confidence").agg(
        F.min(F.struct("n", "token"))["token"].alias("token"))
    looked_up = words.withColumn("token", F.explode("have")).join(posted, "token").where(F.size(F.array_except("tokens", "have")) == 0)
    best = looked_up.groupBy("id").agg(F.max(F.struct(
        F.col("confidence"), F.size("tokens").alias("n"), F.col("verdict"), F.col("tokens"))).alias("best"))
    return best.select("id", F.col("best.verdict").alias("verdict"), F.col("best.confidence").alias("confidence"),
                       F.concat_ws("+", "best.tokens").alias("mined"))


def hand_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting (verdict, host, path) rule, null if none fits.

    A rule fits its host and all subdomains if the path starts with the rule's path; lengths
    are those of host and path together (ties: the longer host, then the first listed)."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):  # the last that fits wins
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def filter_urls(pages: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str, str]], default: str = "allow",
                id_col: str = "page_id", url_col: str = "url", min_support: float = MIN_SUPPORT,
                min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, mined (the tokens of the mined rule
    that decided, else null) and its confidence. ``labelled`` is (url, blocked)."""
    url = F.col(url_col)
    host, path = host_path(url)
    rule, verdict = hand_rule(F.col("host"), F.col("path"), rules)
    judged = pages.select(F.col(id_col).alias("id"), url.alias("url"), host.alias("host"), path.alias("path")).withColumns(
        {"rule": rule, "ruled": verdict})
    # equal URLs are judged once, and no id needs to be unique
    open_urls = judged.where("rule is null and url is not null").select(F.col("url").alias("id"), "url").distinct()
    found = match(open_urls, *mine(labelled, min_support, min_confidence)).select(
        F.col("id").alias("url"), F.col("verdict").alias("mined_verdict"), "confidence", "mined")
    found = cut(found)  # a plain shuffle on either side lets adaptive execution split a hot URL
    out = judged.join(found, "url", "left")
    return out.select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("rule").isNull(), F.col("mined_verdict")), F.lit(default)).alias("verdict"),
        F.when(F.col("rule").isNull(), F.col("mined")).alias("mined"),
        F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"))
