"""Licence notices in paragraphs, with DataFrame functions and Spark ML only.

A multinomial logistic regression over hashed words and word pairs tells licence families from other
paragraphs. It is trained here: licence examples are runs of words of the notices below; examples of
other text are paragraphs of the corpus that share no word triple with a notice, a bounded sample
chosen by hash. Besides each whole paragraph, every stretch of it whose word triples are those of
notices is classified, so the words around a notice in a longer line do not outvote it. A stretch
without such a triple could not be confirmed as any family. Runs held out of the training calibrate how
sure a prediction must be: the limit of each family is a low percentile of the probability that its
held-out runs get. Predictions below it are of unknown licence. Held-out paragraphs of other text set how
probable some licence must be for a paragraph to count at all. A prediction is confirmed by comparing
the paragraph with the family's notices: the share of the paragraph's word triples found in one of
them, or of a notice's in the paragraph; a sure prediction that is not confirmed is unknown too.
"""

from __future__ import annotations

import re
from itertools import chain

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import whole_text
from labelloom.staging import stage

#: Short notices by licence family, fixed values.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE in the project root for license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ],
    "BSD": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "public domain": [
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0.",
    ],
}
FAMILIES = ["none", *NOTICES]
FEATURES, MOST_OTHER, ITERATIONS, PENALTY = 1 << 15, 10_000, 40, 1e-4
#: Least words of a training run, the part of runs held out (one in HELD_OUT), the percentile that sets a family's limit, and bounds on it.
LEAST_RUN, HELD_OUT, PERCENTILE, BOUNDS = 4, 4, 0.02, (0.3, 0.8)
#: Of held-out other paragraphs, the share that looks as probable a licence as one must be.
OTHER_PERCENTILE = 0.999
#: Share of word triples that confirms a prediction, in either direction.
CONFIRMED = 0.6
#: Stretches inside a paragraph: places of word triples of notices, at most so many words apart. Neighbours alone tell
#: notices that follow one another apart, the other joins what a changed word divides.
APART = (1, 8)
#: A stretch that does not hold ``CONFIRMED`` of a notice counts from so many words: fewer are common in other text.
LEAST_INSIDE = 8


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}.]+|[.](?![\\p{N}])"), lambda w: w != "")


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: inside a lambda, a variable is read, an expression evaluated again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _kept(value: Column, test) -> Column:
    """To be selected: the value, for the rows where it passes the test. It is worked out once; a filter on a column would be
    moved below the expression that makes the column, which is then evaluated in both places."""
    return F.explode(F.filter(F.array(value), test))


def _runs(found: Column, n: int) -> Column:
    """Runs of n words, joined. Fewer words have none."""

    def joined(f: Column) -> Column:
        last = F.size(f) - n + 1
        whole = F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(f, i, n), " "))
        return F.when(last > 0, whole).otherwise(F.array().cast("array<string>"))

    return _with(found, joined)


def grams(found: Column) -> Column:
    """Words and pairs of neighbouring words."""
    last = F.greatest(F.size(found) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(found, 1, last), F.slice(found, 2, last), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(found) > 1, F.concat(found, pairs)).otherwise(found)


def _featured(rows: DataFrame) -> DataFrame:
    """Add ``_features`` from ``_words``."""
    hashing = HashingTF(numFeatures=FEATURES, binary=True, inputCol="_grams", outputCol="_features")
    return hashing.transform(rows.withColumn("_grams", grams(F.col("_words")))).drop("_grams")


def notices(spark: SparkSession) -> DataFrame:
    """``family, label, notice, _words``: a row per notice."""
    rows = [(f, float(i), n, t) for i, f in enumerate(FAMILIES) if f != "none" for n, t in enumerate(NOTICES[f])]
    table = spark.createDataFrame(rows, "family string, label double, notice int, text string")
    return table.withColumn("_words", words(F.col("text"))).drop("text")


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, paragraph, _words``: the lines of each text that have a word, numbered from 0 among all its lines."""
    found = _kept(words(F.col("_line")), lambda w: F.size(w) > 0)
    return _lines(docs, id_col, text).select("doc_id", "paragraph", found.alias("_words"))


def _lines(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), F.posexplode(F.split(whole_text(docs, text), "\n", -1)).alias("paragraph", "_line"))


def count_paragraphs(docs: DataFrame, text: str = "text") -> int:
    """The number of rows of ``paragraphs``. A line has a word if it has a letter or digit, so words need not be cut for it."""
    line = F.explode(F.split(whole_text(docs, text), "\n", -1)).alias("_line")
    return docs.select(line).filter(F.lower("_line").rlike("[\\p{L}\\p{N}]")).count()


def stretches(found: Column) -> Column:
    """Runs of words, as arrays, between the first and last of word triples of notices that lie together; see ``APART``."""
    known = _triples()
    middles = sorted({t.split(" ")[1] for t in known})
    none = F.array().cast("array<array<string>>")

    def cut(both: Column) -> Column:
        at, all_words = both["at"], both["words"]

        def runs(apart: int) -> Column:
            first = F.filter(at, lambda a, j: (j == 0) | (a - F.get(at, j - 1) > apart))
            last = F.filter(at, lambda a, j: (j == F.size(at) - 1) | (F.get(at, j + 1) - a > apart))
            return F.zip_with(first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b")))

        pairs = F.array_distinct(F.concat(*map(runs, APART)))
        return F.transform(pairs, lambda p: F.slice(all_words, p["a"], p["b"] - p["a"] + 3))

    def search(all_words: Column) -> Column:
        triple = lambda i: F.concat_ws(" ", *[F.get(all_words, i + k) for k in (-1, 0, 1)])
        # most words stand in the middle of no such triple; only around the others one is put together
        at = F.filter(F.sequence(F.lit(1), F.size(all_words) - 2), lambda i: F.get(all_words, i).isin(middles) & triple(i).isin(known))
        return _with(F.struct(at.alias("at"), all_words.alias("words")), lambda both: F.when(F.size(both["at"]) > 0, cut(both)).otherwise(none))

    return F.when(F.size(found) > 2, _with(found, search)).otherwise(none)


def _triples() -> list[str]:
    out: set[str] = set()
    for text in chain.from_iterable(NOTICES.values()):
        found = [w for w in re.split(r"[^\w.]+|[.](?!\d)", text.lower()) if w]
        out |= {" ".join(found[i : i + 3]) for i in range(len(found) - 2)}
    return sorted(out)


class Scanner:
    """A fitted model, the limit of each family, and how probable any licence must be."""

    def __init__(self, model: LogisticRegressionModel, limits: list[float], least: float) -> None:
        self.model, self.limits, self.least = model, limits, least


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> Scanner:
    """Fit on runs of the notices and about ``MOST_OTHER`` other paragraphs of ``docs`` at most."""
    spark = docs.sparkSession
    known = notices(spark)
    n = F.size("_words")
    lengths = F.sequence(F.least(F.lit(LEAST_RUN), n), n)
    runs = known.select("label", "_words", n.alias("_whole"), F.explode(lengths).alias("_n"))
    runs = runs.select("label", "_whole", "_n", F.explode(_runs_of(F.col("_words"), F.col("_n"))).alias("_words"))
    # long notices have many runs: short ones, long ones and a share of the others, by hash, are enough
    keep = (F.col("_n") <= LEAST_RUN + 4) | (F.pmod(F.xxhash64("_words"), F.lit(16)) == 0)
    runs = runs.filter(keep | (F.col("_n") >= F.col("_whole") - 2))
    held = F.pmod(F.xxhash64(F.array_join("_words", " ")), F.lit(HELD_OUT)) == 0
    lines = paragraphs(docs, id_col, text)
    total = max(count_paragraphs(docs, text), 1)
    chosen = F.pmod(F.xxhash64("doc_id", "paragraph", "_words"), F.lit(10**12)) < int(min(1.0, MOST_OTHER / total) * 10**12)
    foreign = ~F.arrays_overlap(_runs(F.col("_words"), 3), F.array(*[F.lit(t) for t in _triples()]))
    other = lines.filter(chosen).filter(foreign).select(F.lit(0.0).alias("label"), "_words", held.alias("held"))
    rows = runs.select("label", "_words", held.alias("held")).unionByName(other)
    rows = stage(_featured(rows).select("label", "held", "_features"), "licence-training").coalesce(4)
    learner = LogisticRegression(
        featuresCol="_features", labelCol="label", family="multinomial", regParam=PENALTY, maxIter=ITERATIONS,
        rawPredictionCol="_raw", probabilityCol="_probability", predictionCol="_prediction",
    )
    model = learner.fit(rows.filter(~F.col("held")))
    sure = vector_to_array("_probability")
    graded = model.transform(rows.filter("held")).select("label", F.element_at(sure, F.col("label").cast("int") + 1).alias("p"))
    found = dict(graded.groupBy("label").agg(F.percentile("p", F.lit(PERCENTILE))).collect())  # a row per family
    other = graded.filter("label = 0").agg(F.percentile("p", F.lit(1 - OTHER_PERCENTILE))).first()[0]
    low, high = BOUNDS
    limits = [min(max(found.get(float(i), high), low), high) for i in range(len(FAMILIES))]
    return Scanner(model, limits, min(max(1 - other if other is not None else 0.5, 0.5), 0.95))


def _runs_of(found: Column, n: Column) -> Column:
    """All runs of n words as arrays."""
    return F.transform(F.sequence(F.lit(1), F.size(found) - n + 1), lambda i: F.slice(found, i, n))


def scanned(docs: DataFrame, scanner: Scanner | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per paragraph that looks like or holds a licence notice: ``doc_id, paragraph, family, guess, probability, overlap``.

    ``guess`` is the most probable family and ``family`` the same if the prediction is sure and confirmed, else
    ``unknown``. They are those of the whole paragraph or, where that is not confirmed, of its most probable confirmed
    stretch; of a paragraph that looks like none, of its most probable stretch. Ties go to the first family of the list.
    Null, empty and wordless texts have no paragraphs; repeated rows are scanned alike. Other columns are not read. An
    empty table gives an empty table.
    """
    spark = docs.sparkSession
    scanner = scanner or train(docs, id_col, text)
    rows = paragraphs(docs, id_col, text).withColumn("_row", F.monotonically_increasing_id())
    inside = F.transform(F.filter(stretches(F.col("_words")), lambda w: F.size(w) < F.size("_words")), lambda w: F.struct(F.lit(0).alias("whole"), w.alias("words")))
    parts = F.explode(F.concat(F.array(F.struct(F.lit(1).alias("whole"), F.col("_words").alias("words"))), inside)).alias("_part")
    rows = rows.select("_row", "doc_id", "paragraph", parts)
    rows = _featured(rows.select("_row", "doc_id", "paragraph", F.col("_part.whole").alias("_whole"), F.col("_part.words").alias("_words")))
    sure = vector_to_array("_probability")
    rows = scanner.model.transform(rows).select("_row", "_whole", "doc_id", "paragraph", "_words", sure.alias("_p"))
    licence = lambda p: (F.array_position(p, F.array_max(p)) > 1) & (1 - p[0] >= scanner.least)
    rows = rows.select("_row", "_whole", "doc_id", "paragraph", "_words", _kept(F.col("_p"), licence).alias("_p"))
    best = F.array_max("_p")
    rows = rows.withColumns({"probability": best, "_k": (F.array_position("_p", best) - 1).cast("int")})
    rows = rows.select("_row", "_whole", "doc_id", "paragraph", "_words", "probability", F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("_k") + 1).alias("guess"),
                       F.element_at(F.array(*map(F.lit, scanner.limits)), F.col("_k") + 1).alias("_limit"))
    # a row per family, fixed
    known = notices(spark).select(F.col("family").alias("guess"), _runs(F.col("_words"), 3).alias("_notice"))
    known = known.groupBy("guess").agg(F.collect_list("_notice").alias("_notices"))
    rows = rows.withColumn("_own", F.array_distinct(_runs(F.col("_words"), 3))).join(F.broadcast(known), "guess")
    share = lambda a, b: F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))
    overlap = F.array_max(F.transform("_notices", lambda notice: share(F.array_distinct(notice), F.col("_own"))))
    held = lambda notice: F.size(F.array_intersect(notice, "_own")) / F.size(F.array_distinct(notice))
    most = F.array_max(F.transform("_notices", held))
    rows = rows.withColumn("overlap", overlap).filter((F.col("_whole") == 1) | (F.size("_words") >= LEAST_INSIDE) | (most >= CONFIRMED))
    good = (F.col("probability") >= F.col("_limit")) & (F.col("overlap") >= CONFIRMED)
    best = F.max(F.struct(good.alias("good"), "_whole", "probability", (-F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("guess"))).alias("_first"), "guess", "overlap")).alias("_b")
    rows = rows.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("paragraph").alias("paragraph"), best)
    family = F.when(F.col("_b.good"), F.col("_b.guess")).otherwise("unknown").alias("family")
    return rows.select("doc_id", "paragraph", family, "_b.guess", "_b.probability", "_b.overlap")
