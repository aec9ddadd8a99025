"""Licence scan: a trained paragraph classifier (DataFrame, SQL and Spark ML only).

Texts are cut into paragraphs at blank lines, so a notice wrapped at line ends
stays whole, and paragraphs of more than ``PIECE`` words into overlapping
pieces; a notice of at most ``OVERLAP`` words lies whole in one of them. A
piece's neighbouring word pairs that occur in a notice are counted, and a
multinomial logistic regression gives the probability of each licence family and
of ``none``. Nothing is drawn from a sample: every piece of the corpus that holds
no half notice is ordinary. By a hash, half of these train the model and the other
half calibrate the unknown class: a piece is licence-like only if ``1 - P(none)``
exceeds all but ``FALSE_SHARE`` of the calibration pieces (and one half). Pieces
with the same pairs are one example, weighted by their number, so that the
regression's work follows the distinct ones. It is trained on the families'
notices (``TEMPLATES``), each alone and set into every ordinary training piece,
against these pieces; weights make a notice set into pieces count ``MIXED``, a
notice alone a quarter of that, and all ordinary pieces ``ORDINARY`` at most. The
threshold is told to six decimals. A licence-like piece gets the family of
highest probability if a notice of that family has ``CONTAINED`` of its word
pairs in the piece, and any other family of probability ``ALSO`` or more that
has a whole notice there (texts under several licences); with neither, the
family ``unknown``. An unknown piece beside a known one of its paragraph holds
part of the same notice and is not counted.

Defined results: null and empty texts have no paragraphs; a document without
licence-like pieces has null families and zero counts; rows are judged by id and
text together, so another row with the same or a null id changes nothing, and
rows equal in both show the same findings; very long texts are scanned whole,
piece by piece; equal probabilities go to the alphabetically first family; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, stored

ORDINARY, FALSE_SHARE, CONTAINED, ALSO, MIXED = 1000, 0.002, 0.6, 0.05, 24
PIECE, OVERLAP = 128, 32
BLANK_LINE = r"(?:\r?\n|\r)[ \t]*(?:\r?\n|\r)"
NONE, UNKNOWN = "none", "unknown"

# Licence families and short public notices by which works name them.
TEMPLATES = {
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3.",
                 "This program is free software under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "bsd-3-clause": ["Licensed under the BSD 3-Clause License.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "You can redistribute it and modify it under the terms of the GNU General Public License; either version 2 of the License, or any later version."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "You can redistribute it and modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version."],
    "lgpl-3.0": ["Licensed under the GNU Lesser General Public License, version 3.",
                 "You can redistribute it and modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "mpl-2.0": ["Licensed under the Mozilla Public License, version 2.0.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "proprietary": ["All rights reserved.", "All rights reserved. No part of this work may be reproduced without written permission."],
}


# Identifiers by which files name a family (the word before them is "identifier").
IDENTIFIERS = {"agpl-3.0": "AGPL-3.0", "apache-2.0": "Apache-2.0", "bsd-3-clause": "BSD-3-Clause", "cc-by-4.0": "CC-BY-4.0",
               "cc-by-nc-4.0": "CC-BY-NC-4.0", "cc-by-sa-4.0": "CC-BY-SA-4.0", "cc0-1.0": "CC0-1.0", "gpl-2.0": "GPL-2.0",
               "gpl-3.0": "GPL-3.0", "lgpl-3.0": "LGPL-3.0", "mit": "MIT", "mpl-2.0": "MPL-2.0"}
NOTICES = {family: [*texts, *[f"Identifier: {IDENTIFIERS[family]}" for _ in texts[:1] if family in IDENTIFIERS]]
           for family, texts in TEMPLATES.items()}


def _pairs(text: str) -> list[str]:
    ws = "".join(c if c.isalnum() else " " for c in text.lower()).split()
    return [f"{a} {b}" for a, b in zip(ws, ws[1:])]


#: The features: word pairs of the notices.
VOCABULARY = sorted({p for texts in NOTICES.values() for t in texts for p in _pairs(t)})


def words(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def pairs(ws: Column) -> Column:
    """Neighbouring words, joined by a space."""
    return F.zip_with(ws, F.slice(ws, 2, F.greatest(F.size(ws), F.lit(1))),
                      lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, key, at, words): pieces of all paragraphs that have a word; ``key`` is a hash of the row's text, ``at`` numbers
    the pieces of a paragraph without a gap."""
    cut_up = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"),
                         F.posexplode(F.split(F.col(text_col), BLANK_LINE)).alias("paragraph", "body"))
    worded = cut_up.select("id", "key", "paragraph", words(F.col("body")).alias("all")).where(F.size("all") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - OVERLAP - 1, F.lit(0)), F.lit(PIECE - OVERLAP))
    pieces = worded.select("id", "key", "paragraph",
                           F.posexplode(F.transform(starts, lambda s: F.slice("all", s + 1, PIECE))).alias("piece", "words"))
    return pieces.select("id", "key", (F.col("paragraph") * F.lit(1 << 32) + F.col("piece")).alias("at"), "words")


def notices() -> list[tuple[str, Column]]:
    """Each family with the word pairs of each of its notices: few and fixed, so literals of the plan."""
    return [(family, F.array(*[F.lit(p) for p in _pairs(t)])) for family, texts in NOTICES.items() for t in texts]


def contained(grams: Column, notice: Column) -> Column:
    """Share of the notice's word pairs that the piece has."""
    own = F.array_distinct(notice)
    return F.size(F.array_intersect(own, grams)) / F.greatest(F.size(own), F.lit(1))


def features(df: DataFrame) -> DataFrame:
    return CountVectorizerModel.from_vocabulary(VOCABULARY, inputCol="grams", outputCol="features").transform(df)


def fit(pieces: DataFrame) -> tuple[LogisticRegressionModel, list[str], float]:
    """The classifier, its classes by number, and the least licence-likeness, from all ``pieces`` (id, key, at, grams)."""
    half = F.pmod(F.xxhash64("id", "key", "at"), F.lit(2)).alias("half")
    distinct = pieces.groupBy(F.array_sort("grams").alias("grams"), half).agg(F.count(F.lit(1)).alias("n"))
    # a notice of the corpus is no example of an ordinary piece
    ordinary = cut(distinct.where(F.greatest(*[contained(F.col("grams"), t) for _, t in notices()]) < 0.5))
    names = sorted([*TEMPLATES, NONE])
    number = lambda family: F.array_position(F.lit(names), family).cast("double") - 1
    train = ordinary.where("half = 0")
    total = train.agg(F.sum("n")).first()[0] or 0
    share = F.col("n") / F.lit(float(max(total, 1)))
    negatives = train.select(F.lit(NONE).alias("family"), "grams", (share * min(total, ORDINARY)).alias("weight"))
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("family"), t.alias("notice")) for f, t in notices()])).alias("t")
    mixed = train.select(share.alias("share"), "grams", each).select(
        "t.family", F.concat("grams", "t.notice").alias("grams"), (F.col("share") * min(total, MIXED)).alias("weight"))
    alone = pieces.sparkSession.range(1).select(each).select("t.family", F.col("t.notice").alias("grams"), F.lit(MIXED / 4).alias("weight"))
    examples = features(negatives.unionByName(mixed).unionByName(alone)).select(number(F.col("family")).alias("label"), "features", "weight")
    model = LogisticRegression(family="multinomial", regParam=1e-4, maxIter=40, weightCol="weight").fit(examples)
    return model, names, _least(model, names, ordinary.where("half = 1"))


def likelihoods(model: LogisticRegressionModel, lines: DataFrame) -> DataFrame:
    """``lines`` with column ``p``: the probabilities of the classes."""
    out = model.transform(features(lines).select(*lines.columns, "features"))
    return out.select(*lines.columns, vector_to_array("probability").alias("p"))


def _least(model: LogisticRegressionModel, names: list[str], calibration: DataFrame) -> float:
    like = F.round(1 - F.col("p")[names.index(NONE)], 6).alias("like")  # 10^6 values at most
    top = likelihoods(model, calibration.select("grams", "n")).select(like, "n").agg(F.percentile("like", F.lit(1 - FALSE_SHARE), F.col("n"))).first()[0]
    return max(0.5, top or 0.0)


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, at, families, probability, containment) of licence-like pieces; no families: the family unknown."""
    held = F.filter(pairs(F.col("words")), lambda p: p.isin(VOCABULARY)).alias("grams")
    pieces = stored(paragraphs(docs, id_col, text_col).select("id", "key", "at", held), "licence-pieces")
    model, names, least = fit(pieces)
    like = likelihoods(model, pieces).where(1 - F.col("p")[names.index(NONE)] > least)
    like = like.groupBy("id", "key", "at").agg(F.first("grams").alias("grams"), F.first("p").alias("p"))  # equal rows once
    shares = []
    for i, family in enumerate(names):  # the notices are fixed, so they are literals of the plan
        if family != NONE:
            one = [contained(F.col("grams"), t) for f, t in notices() if f == family]
            shares.append(F.struct(F.col("p")[i].alias("probability"), F.lit(-i).alias("order"), F.lit(family).alias("family"),
                                   (F.greatest(*one) if len(one) > 1 else one[0]).alias("containment")))
    judged = like.select("id", "key", "at", F.array(*shares).alias("known")).withColumn("best", F.array_max("known"))
    held = F.filter("known", lambda k: ((k.family == F.col("best.family")) & (k.containment >= CONTAINED))
                    | ((k.probability >= ALSO) & (k.containment >= 1)))
    return judged.select("id", "key", "at", F.transform(held, lambda k: k.family).alias("families"),
                         F.col("best.probability").alias("probability"), F.col("best.containment").alias("containment"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, families (sorted, comma-joined, null if none), n_known, n_unknown, probability (the highest)."""
    # a row's pieces in order: equal rows are one here, so a window holds the findings of a single text
    inside = Window.partitionBy("id", "key").orderBy("at")
    known = F.size("families") > 0
    beside = [F.coalesce((F.abs(step("at").over(inside) - F.col("at")) == 1) & (F.size(step("families").over(inside)) > 0), F.lit(False))
              for step in (F.lag, F.lead)]
    marked = findings(docs, id_col, text_col).withColumn("lost", ~known & ~(beside[0] | beside[1]))
    found = marked.groupBy("id", "key").agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("families")))), ",").alias("families"),
        F.count_if(known).alias("n_known"), F.count_if("lost").alias("n_unknown"), F.max("probability").alias("probability"))
    found = cut(found.withColumnsRenamed({"id": "found_id", "key": "found_key"}))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"))
    same = F.col("id").eqNullSafe(F.col("found_id")) & (F.col("key") == F.col("found_key"))
    return rows.join(found, same, "left").select(
        F.col("id").alias(id_col), F.when(F.col("families") != "", F.col("families")).alias("families"),
        F.coalesce("n_known", F.lit(0)).alias("n_known"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"), "probability")
