"""Licence scans: a trained paragraph classifier confirmed by comparison with templates.

A paragraph (a line of a text) is a set of word n-grams, n up to three, of those that occur in the
templates. A multinomial logistic regression with an L1 penalty, so with few weights, tells the
licence families and ``none`` apart. It is fitted on templates, templates with words around them,
parts of them (a wrapped text has a part a line), and at most ``OTHERS`` different paragraphs of the
corpus without three word pairs of any template, chosen by a hash. A quarter of the licence examples
is set aside and never fitted on.

A paragraph that is not ``none`` gets its family if three things hold, and is ``unknown`` otherwise:

* its probability reaches the threshold. That is set on the examples set aside and on examples of
  licences the model does not know: in each of ``FOLDS`` further fits a part of the families is left
  out whole, and what these fits say of them counts as wrong if it passes. The threshold is the
  least by which no more than ``MISTAKES`` of what passes is wrong;
* at least ``SHARE`` of the word pairs of its nearest template, or of its own, agree;
* it has a telling word pair, one that only templates of that family have, and more of these than of
  all other families' telling pairs.

Defined cases: null texts and lines without words have no licence; a paragraph needs at least one
template word of ``LONG`` letters or more; rows alike in key and text are reported once; an empty
table gives an empty result; other columns play no part, whatever their names.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duecourse.llm.common import row_id, stored

OTHERS = 3_000
MISTAKES = 0.02
FOLDS = 3
SHARE = 0.5
LONG = 6
#: Words of the parts of notices that examples are made of, as wrapped lines have them.
PARTS = (6, 8, 12)
NONE, UNKNOWN = "none", "unknown"

# Usual wordings of licence notices, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
    ),
    "Apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "BSD": (
        "Released under the BSD License.",
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC0": (
        "Licensed under CC0 1.0.",
        "This work has been dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU General Public License, version 2.",
        "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
    ),
    "LGPL": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "MPL": (
        "Released under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "Proprietary": (
        "All rights reserved.",
        "Copyright, all rights reserved. No part of this publication may be reproduced without permission.",
        "Unauthorized copying of this file is strictly prohibited. Proprietary and confidential.",
    ),
}

# Identifiers of licences, by family.
IDENTIFIERS: dict[str, tuple[str, ...]] = {
    "AGPL": ("AGPL-3.0-only", "AGPL-3.0-or-later"),
    "Apache": ("Apache-2.0",),
    "BSD": ("BSD-2-Clause", "BSD-3-Clause"),
    "CC-BY": ("CC-BY-4.0",),
    "CC-BY-NC": ("CC-BY-NC-4.0",),
    "CC-BY-SA": ("CC-BY-SA-4.0",),
    "CC0": ("CC0-1.0",),
    "GPL": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"),
    "LGPL": ("LGPL-2.1-only", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "MIT": ("MIT",),
    "MPL": ("MPL-2.0",),
}


def wordings() -> dict[str, tuple[str, ...]]:
    """The notices of each family and the lines that name its identifiers."""
    named = {f: tuple(f"SPDX-License-Identifier: {i}" for i in ids) for f, ids in IDENTIFIERS.items()}
    return {f: notices + named.get(f, ()) for f, notices in TEMPLATES.items()}


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(
        F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"), F.lit(0)
    )


def _grams(w: str, n: int) -> Column:
    """Word n-grams in order; none for fewer words."""
    if n == 1:
        return F.col(w)
    return F.when(
        F.size(w) >= n,
        F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))


def _all_grams(w: str) -> Column:
    return F.array_distinct(F.concat(_grams(w, 1), _grams(w, 2), _grams(w, 3)))


def templates(spark: SparkSession, texts: dict[str, tuple[str, ...]]) -> DataFrame:
    """``family, no, w``: the words of each template."""
    rows = F.array(*(
        F.struct(F.lit(family).alias("family"), F.lit(k).alias("no"), F.lit(t).alias("text"))
        for family, all_ in texts.items() for k, t in enumerate(all_)
    ))
    return spark.range(1).select(F.explode(rows).alias("t")).select("t.family", "t.no", tokens(F.col("t.text")).alias("w"))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``unknown, key, th`` (the row, as ``row_id`` names it), ``line_no, w``: the words of each line
    that has any."""
    return (
        docs.select(row_id(key, text).alias("doc"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
        .select("doc.unknown", "doc.key", "doc.th", "line_no", tokens(F.col("line")).alias("w")).filter(F.size("w") > 0)
    )


def _examples(known: DataFrame) -> DataFrame:
    """Templates whole, with words before or after them, without up to four words at an end, and
    every part of ``PARTS`` words."""
    extra = F.array(*(F.array(*(F.lit(x) for x in e.split())) for e in ("", "copyright 2020", "see notice", "www.example.com")))
    around = known.select("family", "w", F.explode(extra).alias("x")).select(
        "family", F.explode(F.array(F.concat("x", "w"), F.concat("w", "x"))).alias("w")
    )
    ends = (
        known.select("family", "w", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("k"))
        .filter(F.size("w") > F.col("k") + 3)
        .select("family", F.explode(F.array(
            F.slice("w", F.col("k") + 1, F.size("w")), F.slice("w", F.lit(1), F.size("w") - F.col("k"))
        )).alias("w"))
    )
    parts = (
        known.select("family", "w", F.explode(F.array(*map(F.lit, PARTS))).alias("n")).filter(F.size("w") > F.col("n"))
        .select("family", "w", "n", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1)).alias("k"))
        .select("family", F.slice("w", F.col("k"), F.col("n")).alias("w"))
    )
    # A part that templates of two families share tells neither.
    return (
        around.union(ends).union(parts).distinct()
        .groupBy("w").agg(F.min("family").alias("family"), F.count("*").alias("families"))
        .filter("families = 1").select("family", "w")
    )


def _other_paragraphs(docs: DataFrame, lines: DataFrame, pairs: Column, text: str) -> DataFrame:
    """``w``: about ``OTHERS`` different paragraphs at most that are no licences, by a hash of the
    words. The share that is taken follows from the number of lines, so no task orders them."""
    n = docs.agg(F.sum(F.regexp_count(text, F.lit("\n")) + 1)).first()[0] or 0
    share = int(2**30 * min(1.0, OTHERS / max(n, 1)))
    shared = F.size(F.array_intersect(_grams("w", 2), pairs))
    return lines.filter(F.pmod(F.xxhash64("w"), F.lit(2**30)) < share).filter(shared < 3).select("w").distinct()


def found(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, line_no, family, probability, similarity`` of every licence paragraph."""
    spark = docs.sparkSession
    known = stored(templates(spark, wordings()), "templates")
    # Templates are few and fixed, so what they hold is small, whatever the corpus.
    vocabulary = sorted(r[0] for r in known.select(F.explode(_all_grams("w"))).distinct().collect())
    owners = known.select("family", F.explode(_grams("w", 2)).alias("pair")).groupBy("pair").agg(
        F.min("family").alias("family"), F.countDistinct("family").alias("families")
    ).orderBy("pair").collect()
    pairs = F.array(*(F.lit(r["pair"]) for r in owners))
    telling = {f: F.array(*(F.lit(r["pair"]) for r in owners if r["families"] == 1 and r["family"] == f)) for f in TEMPLATES}
    every_telling = F.array(*(F.lit(r["pair"]) for r in owners if r["families"] == 1))
    long = [v for v in vocabulary if " " not in v and len(v) >= LONG]
    lines = paragraphs(docs, key, text)
    signal = F.arrays_overlap("w", F.array(*map(F.lit, long)))
    others = _other_paragraphs(docs, lines, pairs, text).select(F.lit(NONE).alias("family"), "w")
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, "grams", "features")
    vectors.setBinary(True).setMinTF(1.0)
    families = [*sorted(TEMPLATES), NONE]
    names = F.array(*map(F.lit, families))
    place = (F.array_position(names, F.col("family")) - 1).cast("int")
    examples = stored(
        vectors.transform(
            _examples(known).select("family", "w", F.lit(4.0).alias("weight"))
            .unionByName(others.withColumn("weight", F.lit(1.0)))
            .withColumn("grams", _all_grams("w"))
        ).select("family", "w", "features", "weight", place.cast("double").alias("label"), (place % FOLDS).alias("fold"),
                 ((F.pmod(F.xxhash64("w"), F.lit(4)) == 0) & (F.col("family") != NONE)).alias("aside"))
        .repartition(1),  # some thousand rows by parameter, gone through 40 times a fit
        "examples",
    )
    regression = LogisticRegression(
        family="multinomial", maxIter=40, regParam=0.002, elasticNetParam=0.5, weightCol="weight", standardization=False,
    )
    used = examples.filter(~F.col("aside"))
    # The class numbers stay those of all families: ``none`` is the last of them and always there.
    fit = regression.fit(used)

    def agreement(w: Column) -> Column:
        ours, theirs = _pairs_of(F.col("w")), _pairs_of(w)
        common = F.size(F.array_intersect(ours, theirs))
        return common / F.greatest(F.lit(1), F.least(F.size(ours), F.size(theirs)))

    of_family = stored(known.groupBy("family").agg(F.collect_list("w").alias("texts")).withColumnRenamed("family", "best"), "families")

    def compared(model, df: DataFrame, *keep: str) -> DataFrame:
        """``p, best, similarity, agrees`` of what is not ``none``. Probabilities are stored before
        they are used, so that each row goes through the model once."""
        p = stored(model.transform(df).select(*keep, "w", vector_to_array("probability").alias("all")), "predicted")
        best = F.element_at(names, F.array_position("all", F.array_max("all")).cast("int"))
        own = F.size(F.array_intersect(_pairs_of(F.col("w")), F.coalesce(*(
            F.when(F.col("best") == f, own_pairs) for f, own_pairs in telling.items()
        ))))
        any_ = F.size(F.array_intersect(_pairs_of(F.col("w")), every_telling))
        return (
            p.select(*keep, "w", F.array_max("all").alias("p"), best.alias("best")).filter(F.col("best") != NONE)
            .join(F.broadcast(of_family), "best", "left")
            .withColumn("similarity", F.array_max(F.transform("texts", agreement)))
            .withColumn("agrees", (F.col("similarity") >= SHARE) & (own > 0) & (2 * own > any_))
            .drop("texts")
        )

    judged = compared(fit, examples.filter("aside"), "family").select("p", "agrees", (F.col("best") != F.col("family")).alias("wrong"))
    for fold in range(FOLDS):
        left_out = (F.col("fold") == fold) & (F.col("family") != NONE)
        partly = regression.fit(used.filter(~left_out))
        judged = judged.unionByName(
            compared(partly, examples.filter(left_out), "family").select("p", "agrees", F.lit(True).alias("wrong"))
        )
    steps = F.explode(F.array(*(F.lit(k / 20) for k in range(6, 20))))
    passing = (
        judged.filter("agrees").select("p", F.col("wrong").cast("int").alias("wrong"), steps.alias("least"))
        .filter(F.col("p") >= F.col("least")).groupBy("least").agg(F.avg("wrong").alias("wrong"))
        .filter(F.col("wrong") <= MISTAKES)
    )
    least = passing.agg(F.min("least")).first()[0] or 0.95
    candidates = stored(lines.filter(signal), "candidates").dropDuplicates(["unknown", "key", "th", "line_no"])
    scored = compared(fit, vectors.transform(candidates.withColumn("grams", _all_grams("w"))), "unknown", "key", "th", "line_no")
    sure = (F.col("p") >= least) & F.col("agrees")
    return scored.select(
        F.struct("unknown", "key", "th").alias("doc"), "line_no", F.when(sure, F.col("best")).otherwise(UNKNOWN).alias("family"),
        F.col("p").alias("probability"), "similarity",
    )


def _pairs_of(w: Column) -> Column:
    return F.array_distinct(F.zip_with(
        F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.size(w)),
        lambda a, b: F.concat_ws(" ", a, b),
    ))
