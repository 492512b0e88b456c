"""License scan of paragraphs, in DataFrame functions throughout.

A paragraph (a line with a word) is a set of word bigrams, its ends included. A sparse
logistic regression over the bigrams of notice templates, trained here on the templates, on
shortened and damaged copies of them, and on paragraphs of the corpus as the unknown class,
gives each family a probability. The threshold below which a paragraph stays unknown is
calibrated on examples kept back from training; the share of its bigrams that the family's
templates hold confirms a prediction.

Scanning joins exploded bigrams with the table of weights, which has at most
``MAX_FEATURES`` rows and is broadcast; what meets no weight is gone before any shuffle.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyshop.llm.keys import keyed

# The wording of common license notices.
TEMPLATES = {
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'Unless required by applicable law or agreed to in writing, software distributed under the '
        'License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied.",
    ],
    "bsd": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions "
        "and the following disclaimer.",
        "Released under the BSD 3-Clause License.",
    ],
    "creative_commons": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 "
        "International License.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU Lesser General Public License, version 2.1.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        'associated documentation files (the "Software"), to deal in the Software without restriction',
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.",
    ],
    "mozilla": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) The Authors. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any "
        "means without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
    "public_domain": [
        "This is free and unencumbered software released into the public domain.",
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
    ],
}
UNKNOWN = "unknown"
MAX_FEATURES = 20_000
#: Expected number of corpus documents whose paragraphs train the unknown class.
FIT_DOCS = 300
COPIES = 24
LEAST_MATCH = 0.5
LEAST_PROBABILITY = 0.5
_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _bigrams(text: str) -> Column:
    """Distinct 64-bit bigram hashes of a paragraph, with its ends as words of their own."""
    words = f"concat(array('^'), regexp_extract_all(lower({text}), '{_WORDS}', 0), array('$'))"
    words = words.replace("\\", "\\\\")
    return F.expr(
        f"transform(array({words}), p -> array_distinct(transform(slice(p, 1, size(p) - 1),"
        " (w, i) -> xxhash64(w, p[i + 1]))))[0]"
    )


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, paragraph, features)`` for every line with a word."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("paragraph", "line"))
    return lines.where(F.lower("line").rlike(_WORDS)).select("id", "paragraph", "line").withColumn("features", _bigrams("line"))


@dataclass
class Model:
    """Per bigram its weight for each class and the families whose templates hold it."""

    families: list[str]
    features: list[int]
    weights: np.ndarray
    bias: np.ndarray
    held: np.ndarray
    threshold: float


def _damaged(rng: random.Random, text: str) -> str:
    words = text.split()
    if len(words) > 12 and rng.random() < 0.3:
        cut = rng.randrange(8, len(words))
        words = words[:cut] if rng.random() < 0.5 else words[-cut:]
    words = [w for w in words if rng.random() > 0.06]
    if rng.random() < 0.3:
        words = ["Copyright", "(c)", str(rng.randrange(1990, 2030)), "The", "Authors.", *words]
    return " ".join(words)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS,
        seed: int = 13) -> Model:
    """Train on the templates and on paragraphs of about ``fit_docs`` documents, a seeded share
    by id. Corpus paragraphs that mostly repeat a template are no examples of the unknown."""
    spark = docs.sparkSession
    rng = random.Random(seed)
    families = [UNKNOWN, *TEMPLATES]
    texts = [(f, t, 0) for f, ts in TEMPLATES.items() for t in ts]
    texts += [(f, _damaged(rng, t), i) for f, t, _ in list(texts) for i in range(1, COPIES + 1)]
    # words of templates out of order are no notice
    texts += [
        (UNKNOWN, " ".join(rng.sample(t.split(), len(t.split()))), i) for _, t, copy in list(texts) if copy == 0 for i in (1, 2)
    ]
    made = spark.createDataFrame(texts, "family string, line string, copy int")
    made = made.withColumn("features", _bigrams("line")).collect()
    held_by: dict[int, set[int]] = {}
    for r in made:
        if r.copy == 0:
            for f in r.features:
                held_by.setdefault(f, set()).add(families.index(r.family))
    share = min(1.0, fit_docs / max(1, docs.select(id_col).count()))
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 32)
    sample = paragraphs(docs.where(draw <= int(share * 0xFFFFFFFF)), id_col, text_col)
    examples = [(families.index(r.family), r.features) for r in made]
    for r in sample.select("features").collect():
        if sum(f in held_by for f in r.features) < LEAST_MATCH * len(r.features):
            examples.append((0, r.features))
    if len(held_by) > MAX_FEATURES:
        raise ValueError(f"templates have more than {MAX_FEATURES} bigrams")
    features = sorted(held_by)
    column = {f: i for i, f in enumerate(features)}
    x = np.zeros((len(examples), len(features)), np.float32)
    y = np.array([c for c, _ in examples])
    for i, (_, fs) in enumerate(examples):
        for f in fs:
            if f in column:
                x[i, column[f]] = 1 / np.sqrt(len(fs))
    kept_back = np.array([rng.random() < 0.3 for _ in examples])
    w, b = np.zeros((len(features), len(families))), np.zeros(len(families))
    xt, yt = x[~kept_back], np.eye(len(families))[y[~kept_back]]
    weight = 1 / np.maximum(1, yt.sum(0))[y[~kept_back]][:, None] / len(families)
    for _ in range(300):
        p = _softmax(xt @ w + b)
        g = (p - yt) * weight
        w -= 8.0 * (xt.T @ g + 1e-4 * w)
        b -= 8.0 * g.sum(0)
    # the examples kept back tell from which probability a notice is believed: where most of
    # them, notices and others weighing the same, come out right
    p, of = _softmax(x[kept_back] @ w + b), y[kept_back]
    notice, other = p[of > 0, of[of > 0]], p[of == 0, 1:].max(1)
    levels = np.linspace(LEAST_PROBABILITY, 0.99, 50)
    right = [(notice >= t).mean() + (other < t).mean() if len(notice) and len(other) else 0.0 for t in levels]
    threshold = float(levels[int(np.argmax(right))])
    held = np.zeros((len(features), len(families)), np.int64)
    for f, classes in held_by.items():
        if f in column:
            held[column[f], list(classes)] = 1
    return Model(families, features, w, b, held, threshold)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _table(spark: SparkSession, model: Model) -> DataFrame:
    rows = [
        (f, [float(v) for v in w], [int(v) for v in h])
        for f, w, h in zip(model.features, model.weights, model.held, strict=True)
    ]
    return spark.createDataFrame(rows, "feature long, w array<double>, h array<int>")


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_notices, families, notices)`` for every document.

    ``notices`` lists the paragraphs (by line number from 0) recognised as a license notice,
    with family, probability and template match, in order of lines; ``families`` are their
    distinct families by name. Null and empty texts, and texts without a notice, have none.
    Rows equal in id and text, rows with a null id, and different texts under one id each have
    the notices of their own text; empty tables give no rows; other columns are not read.
    """
    n = len(model.families)
    table = F.broadcast(_table(docs.sparkSession, model))
    rows, repeated = keyed(
        docs.select(F.col(id_col).alias("own"), F.col(text_col).cast("string").alias("text")), "own", ["text"], "key"
    )
    texts = rows.select("key", "text")
    matched = (
        paragraphs(texts.dropDuplicates(["key"]) if repeated else texts, "key", "text")
        .select("id", "paragraph", F.size("features").alias("n"), F.explode("features").alias("feature"))
        .join(table, "feature")
    )
    sums = matched.groupBy("id", "paragraph", "n").agg(
        F.array(*(F.sum(F.col("w")[i]) for i in range(n))).alias("w"),
        F.array(*(F.sum(F.col("h")[i]) for i in range(n))).alias("h"),
    )
    power = F.array(
        *(F.exp(F.lit(float(model.bias[i])) + F.col("w")[i] / F.sqrt("n")) for i in range(n))
    )
    total = F.aggregate("power", F.lit(0.0), lambda a, x: a + x)
    best = F.array_position("power", F.array_max("power")).cast("int") - 1
    names = F.array(*map(F.lit, model.families))
    found = (
        sums.withColumn("power", power)
        .withColumn("best", best)
        .select(
            "id", "paragraph", F.element_at(names, F.col("best") + 1).alias("family"),
            (F.array_max("power") / total).alias("probability"),
            (F.element_at("h", F.col("best") + 1) / F.col("n")).alias("match"),
        )
        .where((F.col("family") != UNKNOWN) & (F.col("probability") >= model.threshold) & (F.col("match") >= LEAST_MATCH))
    )
    listed = found.groupBy("id").agg(
        F.sort_array(F.collect_list(F.struct("paragraph", "family", "probability", "match"))).alias("notices")
    )
    return (
        rows.select("own", F.col("key").alias("id")).join(listed, "id", "left")
        .select(
            F.col("own").alias(id_col),
            F.coalesce(F.size("notices"), F.lit(0)).cast("long").alias("n_notices"),
            F.coalesce(F.array_sort(F.array_distinct("notices.family")), F.array().cast("array<string>")).alias("families"),
            "notices",
        )
        .withColumn("n_notices", F.greatest("n_notices", F.lit(0)))
    )
