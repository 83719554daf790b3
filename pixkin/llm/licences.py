"""Licence scans: a trained paragraph classifier.

Paragraphs are lines, and a notice may run over several.  A multinomial logistic regression over hashed word 1- and 2-grams, trained
here on variations of short public notices and on ordinary paragraphs, gives each a licence family
or "unknown".  A prediction below the probability at which those on held-out templates (by models that
knew nothing of them) were right often enough counts as unknown (calibration), and so does one that no
template of its family confirms: the paragraph must hold most of a template's 2-grams, and most of
those that no other family's templates have.  Only DataFrame functions and MLlib's JVM stages
are used.

What is scored is every line by itself and every line joined with those that follow it, one more
each time, as far as the longest template and some words more reach.  A line without words ends a
block, and nothing is joined across it.  Hits of one family that share lines are one notice, the one
that confirms most of a template on the fewest lines; its first line is where it is found.  A hit
inside a better one of another family is part of that.  Texts and joined lines that can't confirm
any template (none of more than the 2-grams that may be missing) are left out before scoring, which
changes no result.

Defined results: a null or empty text has no paragraphs; a null doc_id is reported like any other;
repeated rows are reported once each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import random
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import written

#: Short notices by family.
TEMPLATES = {
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
        "GNU Affero General Public License, version 3",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc-by": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ],
    "cc-by-nc": [
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC 4.0.",
    ],
    "cc-by-sa": [
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU General Public License, version 3",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
        "GNU Lesser General Public License, version 3",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
        "SPDX-License-Identifier: MIT",
    ],
    "mit-or-apache-2.0": [
        "Licensed under either of Apache License, Version 2.0 or MIT license at your option.",
        "SPDX-License-Identifier: MIT OR Apache-2.0",
        "Dual licensed under MIT/Apache-2.0.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
}
#: Sentences with cue words that state no licence.
OTHERS = [
    "The driver lost their license after the accident.",
    "You need a license to fish in this lake.",
    "Permission to enter the building was refused.",
    "The apache helicopter landed near the village.",
    "She studied physics at MIT for four years.",
    "The public was not allowed to copy the painting.",
    "Copyright disputes between the two studios went on.",
    "The warranty covers the first two years of use.",
    "He wrote a version of the story that was never released.",
    "The GNU is a large antelope of southern Africa.",
]
UNKNOWN = "unknown"
FAMILIES = [*TEMPLATES, UNKNOWN]
CUES = r"(?i)\b(licen[sc]ed?|spdx|redistribut\w*|permission|copyright|creative commons|cc by|gpl|mozilla public)\b"
#: Bounds of the training set: variations of a template, and unlabelled paragraphs taken as unknown.
VARIATIONS = 40
MAX_PLAIN_PARAGRAPHS = 2000
FEATURES = 1 << 14
#: A prediction's least precision on held-out paragraphs, and a template's least share of 2-grams.
PRECISION = 0.99
CONFIRMED = 0.6
#: Parts that templates are held out in, one after the other.
FOLDS = 2
#: Words of the longest template and a few that a notice may have besides.
REACH = max(len(t.split()) for texts in TEMPLATES.values() for t in texts) + 8


def _varied(text: str, draw: random.Random) -> str:
    """Other white space, case, ends and an occasional lost or added word."""
    words = text.split()
    if len(words) > 5 and draw.random() < 0.5:
        words.pop(draw.randrange(len(words)))
    if draw.random() < 0.5:
        words.insert(0, draw.choice(["Note:", "All", "Content", "#", "//", "Text"]))
    if draw.random() < 0.3:
        words += draw.choice([["See", "LICENSE."], ["Enjoy."], ["2024"]])
    out = " ".join(words)
    return draw.choice([out, out.lower(), out.rstrip(".")])


def training_rows(spark: SparkSession, plain: DataFrame | None = None, seed: int = 7) -> DataFrame:
    """(text, label, fold), a template and its variations being in one fold.  plain: (text), ordinary paragraphs, of which at most MAX_PLAIN_PARAGRAPHS are used."""
    draw, rows = random.Random(seed), []
    for label, family in enumerate(FAMILIES):
        for i, text in enumerate(TEMPLATES.get(family, OTHERS)):
            rows += [(x, float(label), i % FOLDS) for x in [text, *(_varied(text, draw) for _ in range(VARIATIONS))]]
    out = spark.createDataFrame(rows, "text string, label double, fold int")
    if plain is not None:
        # those with the smallest hashes, so that the sample doesn't depend on how the table is laid out
        prose = plain.filter(~F.col("text").rlike(CUES)).select("text").distinct().orderBy(F.xxhash64("text"), "text").limit(MAX_PLAIN_PARAGRAPHS)
        out = out.unionByName(prose.select("text", F.lit(float(len(FAMILIES) - 1)).alias("label"), F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int").alias("fold")))
    return out


def _pipeline() -> Pipeline:
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[a-z0-9]+", gaps=False),
            NGram(n=2, inputCol="words", outputCol="pairs"),
            SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__"),
            HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True),
            LogisticRegression(maxIter=40, regParam=0.001, elasticNetParam=0.0, family="multinomial"),
        ]
    )


class LicenceModel:
    """A trained classifier and the probability from which its predictions count.  fold: templates
    that don't confirm, as they are held out."""

    def __init__(self, model: PipelineModel, threshold: float, fold: int | None = None):
        self.model, self.threshold, self.fold = model, threshold, fold

    @classmethod
    def held_out(cls, rows: DataFrame) -> DataFrame:
        """rows: (text, label, fold).  Each scored by a model of the other folds; adds good: whether the
        family is right."""
        parts = [cls(_pipeline().fit(rows.filter(F.col("fold") != k)), 0.0, k).scored(rows.filter(F.col("fold") == k)) for k in range(FOLDS)]
        right = F.col("family") == F.get(F.array(*[F.lit(f) for f in FAMILIES]), F.col("label").cast("int"))
        return reduce(DataFrame.unionByName, parts).withColumn("good", right)

    @classmethod
    def fit(cls, rows: DataFrame) -> LicenceModel:
        """rows: (text, label, fold); held out in turn to find the threshold."""
        # a few thousand rows, read by each model; what they are taken from is read once
        rows = written(rows.coalesce(1), "licence-training").coalesce(1)
        used = cls.held_out(rows).filter((F.col("family") != UNKNOWN) & F.col("confirmed"))
        # the least of a few steps at which the predictions kept are precise enough
        steps = [i / 20 for i in range(6, 20)]
        sums = [F.count_if(F.col("probability") >= t).alias(f"n{i}") for i, t in enumerate(steps)] + [F.count_if((F.col("probability") >= t) & F.col("good")).alias(f"g{i}") for i, t in enumerate(steps)]
        row = used.agg(*sums).first()
        threshold = next((t for i, t in enumerate(steps) if row[f"g{i}"] >= PRECISION * row[f"n{i}"]), steps[-1])
        return cls(_pipeline().fit(rows), threshold)

    def scored(self, paragraphs: DataFrame) -> DataFrame:
        """paragraphs: text and other columns.  Adds family, probability and whether it is confirmed."""
        rows = self.model.transform(paragraphs).withColumn("_p", vector_to_array("probability"))
        families = F.array(*[F.lit(f) for f in FAMILIES])
        best = F.array_max("_p")
        at = (F.array_position("_p", best) - 1).cast("int")
        held = lambda t: F.size(F.array_intersect("pairs", t)) / F.size(t)
        # a template counts with its own 2-grams only if it has most of them
        share = F.transform(F.get(_template_pairs(self.fold), at), lambda t: F.when((F.size(t["own"]) == 0) | (held(t["own"]) >= CONFIRMED), held(t["all"])).otherwise(F.lit(0.0)))
        rows = rows.withColumn("family", F.get(families, at)).withColumn("share", F.coalesce(F.array_max(share), F.lit(0.0)))
        return rows.select(*paragraphs.columns, "family", best.alias("probability"), "share", (F.col("share") >= CONFIRMED).alias("confirmed"))


def _pairs(template: str) -> list[str]:
    words = "".join(c if c.isalnum() else " " for c in template.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def _template_pairs(fold: int | None = None) -> Column:
    """The 2-grams of each template of each family, in the order of FAMILIES, and those of them that no
    other family has; without the templates of a fold."""
    kept = {f: [t for i, t in enumerate(texts) if i % FOLDS != fold] for f, texts in TEMPLATES.items()}

    def one(family: str, template: str) -> Column:
        others = {x for f, texts in TEMPLATES.items() if f != family for t in texts for x in _pairs(t)}
        words = lambda pairs: F.array(*map(F.lit, pairs)).cast("array<string>")
        return F.struct(words(_pairs(template)).alias("all"), words([x for x in _pairs(template) if x not in others]).alias("own"))

    return F.array(*[F.array(*[one(f, t) for t in kept.get(f, [])]).cast("array<struct<all:array<string>,own:array<string>>>") for f in FAMILIES])


def _needed() -> str:
    """Matches every lower-case text that can confirm a template: of each template's 2-grams the
    longest, one more than may be missing."""
    needed = set()
    for template in (t for texts in TEMPLATES.values() for t in texts):
        pairs = sorted(_pairs(template), key=lambda x: (-len(x), x))
        least = next(n for n in range(len(pairs) + 1) if n / len(pairs) >= CONFIRMED)
        needed.update(pairs[: len(pairs) - least + 1])
    return "(?<![a-z0-9])(?:" + "|".join(x.replace(" ", "[^a-z0-9]+") for x in sorted(needed)) + ")(?![a-z0-9])"


def _joined(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text).  What is scored: doc_id, _key, at and to (first and last line) and text."""
    words = F.transform(F.split("_lower", "\n"), lambda x: F.regexp_extract_all(x, F.lit("[a-z0-9]+"), F.lit(0)))
    able = docs.select("doc_id", F.xxhash64("text").alias("_key"), F.lower("text").alias("_lower")).filter(F.col("_lower").rlike(_needed()))
    lines = able.distinct().select("doc_id", "_key", words.alias("_lines")).select("doc_id", "_key", "_lines", F.posexplode("_lines").alias("at", "_own")).filter(F.size("_own") > 0)
    lines = lines.select("doc_id", "_key", "at", "_own", F.slice("_lines", F.col("at") + 2, F.lit(REACH)).alias("_next"))
    own, ahead = F.col("_own"), F.col("_next")
    tail = F.slice(own, F.greatest(F.size(own) - REACH, F.lit(0)) + 1, F.lit(REACH))

    def reached(k: Column) -> Column:  # a block goes on for k lines, and the last of them is needed
        some = F.forall(F.slice(ahead, F.lit(1), k), lambda x: F.size(x) > 0)
        return (k == 0) | (some & (F.size(F.flatten(F.slice(ahead, F.lit(1), k - 1))) < REACH))

    def joined(k: Column) -> Column:
        more = F.concat(tail, F.slice(F.flatten(F.slice(ahead, F.lit(1), k)), F.lit(1), F.lit(REACH)))
        return F.struct((F.col("at") + k).alias("to"), F.array_join(F.when(k == 0, own).otherwise(more), " ").alias("text"))

    steps = F.filter(F.sequence(F.lit(0), F.size(ahead)), lambda k: F.when(k == 0, F.lit(True)).otherwise(reached(k)))
    return lines.select("doc_id", "_key", "at", F.inline(F.transform(steps, joined))).filter(F.col("text").rlike(_needed()))


_NOTICES = "array<struct<miss:double,long:int,at:int,to:int,family:string>>"


def _notices(hits: Column) -> Column:
    """hits: structs of _NOTICES, best first.  One of those that share lines and family, and none
    inside a better one of another family; in the order of lines."""

    def step(a: Column, x: Column) -> Column:
        known = F.exists(a, lambda y: (y["family"] == x["family"]) & (y["at"] <= x["to"]) & (x["at"] <= y["to"]))
        return F.when(known, a).otherwise(F.concat(a, F.array(x)))

    def whole(a: Column) -> Column:
        inside = lambda x: F.exists(a, lambda y: (y["miss"] < x["miss"]) & (y["at"] <= x["at"]) & (x["to"] <= y["to"]))
        return F.array_sort(F.transform(F.filter(a, lambda x: ~inside(x)), lambda x: F.struct(x["at"].alias("at"), x["family"].alias("family"))))

    return F.aggregate(hits, F.array().cast(_NOTICES), step, whole)


def licence_report(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """docs: (doc_id, text).  Per row: doc_id, n_paragraphs, n_licences and what was found as
    paragraph:family, comma-joined."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    key = F.xxhash64("text").alias("_key")
    found = model.scored(_joined(docs)).filter((F.col("family") != UNKNOWN) & (F.col("probability") >= model.threshold) & F.col("confirmed"))
    hit = F.struct((1 - F.col("share")).alias("miss"), (F.col("to") - F.col("at")).alias("long"), "at", "to", "family")
    found = found.groupBy("doc_id", "_key").agg(F.array_sort(F.collect_list(hit)).cast(_NOTICES).alias("hits"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("_key").alias("_k"), _notices(F.col("hits")).alias("found"))
    rows = docs.select("doc_id", key, F.size(F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_paragraphs"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")), "left")
    return rows.select(
        "doc_id",
        "n_paragraphs",
        F.when(F.col("found").isNull(), 0).otherwise(F.size("found")).cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct(F.coalesce(F.col("found.family"), F.array().cast("array<string>")))), ",").alias("families"),
        F.array_join(F.transform(F.coalesce("found", F.array().cast("array<struct<at:int,family:string>>")), lambda x: F.concat_ws(":", x["at"], x["family"])), ",").alias("found"),
    )


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    plain = docs.select(F.explode(F.split("text", "\n")).alias("text")).filter("text <> ''")
    return licence_report(docs, LicenceModel.fit(training_rows(spark, plain)))
