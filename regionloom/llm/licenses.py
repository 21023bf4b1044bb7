"""Licence scan: a trained paragraph classifier with template comparison.

Training (driver, numpy, bounded): paragraphs of the licence families' notices,
as they are and with words dropped, against beginnings of paragraphs sampled from the corpus
as the unknown class.  Features are the 1- to 3-word grams of the notices that
are rare in the sample; a multinomial logistic regression with an L1 penalty
keeps few of them.  A temperature fitted on held-out paragraphs calibrates the
probabilities, so that the unknown class wins where evidence is thin.

Scan (DataFrame functions alone): a paragraph can leave the unknown class only
if its grams outweigh that class's lead, and grams without one of the model's
anchor words cannot, even all together.  So paragraphs without an anchor word
are unknown without being scored; the rest are classified once for each distinct
paragraph, by joining its grams to the weights (at most ``MOST_FEATURES`` rows).
A prediction stands if at least 0.8 of the paragraph's 5-word shingles are in
the family's notices, or if 0.8 of one notice's are in the paragraph and the
lines around it, up to a blank one: a notice may have words beside it, and may
be wrapped.

Defined cases: null and blank texts have no paragraphs and give no rows;
paragraphs with fewer than five words have one shingle; equal paragraphs get
equal verdicts wherever they are; repeated rows give repeated rows; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Notices of licence families, as projects carry them (fixed values).
NOTICES = {
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE in the project root for license information.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "This project is released under the Apache License 2.0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Licensed under the GNU GPL v3.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.",
    ],
    "agpl": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the 3-clause BSD License.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0.",
        "Released into the public domain under CC0.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
    ],
}
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *NOTICES]
MOST_FEATURES = 4000
SAMPLE_DOCS = 500
SAMPLE_PARAGRAPHS = 4000
#: Characters of a sampled paragraph at most; the scan reads whole texts.
SAMPLE_CHARS = 4000
COPIES = 12
SHINGLE = 5
SIMILARITY = 0.8
#: Characters on each side of a line that are compared with it: twice the longest notice, for what wrapping adds.
REACH = 2 * max(len(t) for texts in NOTICES.values() for t in texts)
REACH_LINES = 64
_RARE = 0.005
_SPLIT = r"[^\p{L}\p{N}./-]+"


def _tokens(paragraph: str) -> list[str]:
    """As ``tokens`` below does it: letters, digits and inner dots, strokes and slashes."""
    import regex

    return [w for w in (t.strip("./-") for t in regex.split(_SPLIT, paragraph.lower())) if w]


def tokens(paragraph: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(paragraph), _SPLIT), lambda t: F.btrim(t, F.lit("./-"))), lambda t: t != "")


def _grams(words: list[str], n: int) -> list[str]:
    return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]


def grams(words: Column, n: int) -> Column:
    """The n-word grams of an array of words; none if it is shorter."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))


def _features(words: list[str]) -> set[str]:
    return {g for n in (1, 2, 3) for g in _grams(words, n)}


def _block(lines: Column, at: Column) -> Column:
    """Line ``at`` (from 0) of an array with the lines around it, up to a blank one and within ``REACH``."""
    begin = F.greatest(at - REACH_LINES, F.lit(0))
    before = F.concat_ws("\n", F.slice(lines, begin + 1, at - begin), F.lit(""))
    after = F.concat_ws("\n", F.lit(""), F.slice(lines, at + 2, REACH_LINES))
    blank = r"(?<=\n)[^\S\n]*\n"
    near = F.substring(F.element_at(F.split(F.concat(F.lit("\n"), before), blank), -1), -REACH, REACH)
    return F.concat(near, F.element_at(lines, at + 1), F.substring(F.get(F.split(F.concat(after, F.lit("\n")), blank), F.lit(0)), 1, REACH))


@dataclass(frozen=True)
class Model:
    features: list[str]
    weights: np.ndarray  # features x families
    bias: np.ndarray
    temperature: float

    def anchors(self, common: dict[str, int]) -> list[str]:
        """Words of which a paragraph must have one to leave the unknown class.

        Each gram that speaks for a family is first held by its word that the
        sample has least.  Then words are let go, the most common first, as long
        as all grams that no word holds together cannot outweigh the unknown
        class's lead over any family.
        """
        evidence = np.maximum(self.weights[:, 1:] - self.weights[:, :1], 0)
        grams = [(set(f.split(" ")), e) for f, e in zip(self.features, evidence, strict=True) if e.any()]
        lead = self.bias[0] - self.bias[1:]
        often = lambda w: (common.get(w, 0), w)
        held = {min(words, key=often) for words, _ in grams}
        for word in sorted(held, key=often, reverse=True):
            rest = held - {word}
            free = sum((e for words, e in grams if not words & rest), np.zeros(len(lead)))
            if (free < lead).all():
                held = rest
        return sorted(held)


def fit(rows: list[set[str]], labels: np.ndarray, features: list[str], steps: int = 300, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Multinomial logistic regression by proximal gradient steps on sparse 0/1 rows."""
    place = {f: i for i, f in enumerate(features)}
    at = [sorted(place[f] for f in r if f in place) for r in rows]
    n = np.array([len(a) for a in at])
    flat, owner = np.array([i for a in at for i in a], np.int64), np.repeat(np.arange(len(rows)), n)
    w, b = np.zeros((len(features), len(FAMILIES))), np.zeros(len(FAMILIES))
    target = np.eye(len(FAMILIES))[labels]
    # classes count alike, whatever their rows
    weight = (1 / np.maximum(np.bincount(labels, minlength=len(FAMILIES)), 1))[labels]
    weight /= weight.sum()
    rate = 4.0
    for _ in range(steps):
        z = np.tile(b, (len(rows), 1))
        np.add.at(z, owner, w[flat])
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - target) * weight[:, None]
        gw = np.zeros_like(w)
        np.add.at(gw, flat, g[owner])
        w -= rate * gw
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
        b -= rate * g.sum(axis=0)
    # the unknown class starts ahead: no evidence is no licence
    b[0] = max(b[0], b[1:].max() + 1)
    return w, b


def train(docs: DataFrame, seed: int = 5) -> tuple[Model, dict[str, int]]:
    """The model, and how many sampled paragraphs have each word."""
    # ids are chosen before any text is moved; there are SAMPLE_DOCS of them at most
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(SAMPLE_DOCS)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    lines = sample.select(F.explode(F.split("text", "\n")).alias("line")).where(F.length(F.btrim("line")) > 0).select(F.substring("line", 1, SAMPLE_CHARS).alias("line")).distinct().orderBy(F.xxhash64("line", F.lit(seed)), "line").limit(SAMPLE_PARAGRAPHS)
    shingles = {g for texts in NOTICES.values() for t in texts for g in _grams(_tokens(t), SHINGLE)}
    unknown = [w for w in (_tokens(r.line) for r in lines.collect()) if not shingles.intersection(_grams(w, SHINGLE))]
    rng = np.random.default_rng(seed)
    rows, labels, held = [], [], []
    for k, (_, texts) in enumerate(NOTICES.items(), 1):
        for text in texts:
            words = _tokens(text)
            for copy in range(COPIES):
                drop = set(rng.choice(len(words), copy * len(words) // 60, replace=False).tolist()) if copy else set()
                rows.append([w for i, w in enumerate(words) if i not in drop])
                labels.append(k)
                held.append(copy % 4 == 3)
    for i, words in enumerate(unknown):
        rows.append(words)
        labels.append(0)
        held.append(i % 4 == 3)
    rows, labels, held = [_features(r) for r in rows], np.array(labels), np.array(held)
    common: dict[str, int] = {}
    for r, label in zip(rows, labels, strict=True):
        if not label:
            for f in r:
                common[f] = common.get(f, 0) + 1
    of_notices = {f for r, label in zip(rows, labels, strict=True) if label for f in r}
    rare = sorted(f for f in of_notices if common.get(f, 0) <= _RARE * max(len(unknown), 1))[:MOST_FEATURES]
    fitted = np.flatnonzero(~held)
    w, b = fit([rows[i] for i in fitted], labels[fitted], rare)
    kept = np.flatnonzero(np.abs(w).max(axis=1) > 0)
    features, w = [rare[i] for i in kept], w[kept]
    place = {f: i for i, f in enumerate(features)}
    z = np.array([b + sum((w[place[f]] for f in r if f in place), np.zeros(len(b))) for r in (rows[i] for i in np.flatnonzero(held))])
    truth = labels[held]

    def loss(t: float) -> float:
        s = z * t - (z * t).max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean())

    temperature = min((float(t) for t in np.geomspace(0.25, 4, 33)), key=loss)
    return Model(features, w, b, temperature), common


def scan(docs: DataFrame) -> DataFrame:
    """A row for each paragraph with a licence: doc_id, paragraph, text, family, probability, similarity, confirmed."""
    spark = docs.sparkSession
    model, common = train(docs)
    anchors = r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(re.escape(a) for a in model.anchors(common)) + r")(?![\p{L}\p{N}])"
    lines = docs.select("doc_id", "text").where(F.col("text").rlike(anchors)).select("doc_id", F.split("text", "\n").alias("lines"))
    each = F.transform("lines", lambda line, i: F.when(line.rlike(anchors), F.struct(i.alias("paragraph"), line.alias("line"), _block(F.col("lines"), i).alias("block"))))
    found = lines.select("doc_id", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.*")
    found = written(found, "licence-lines")
    words = found.select("line").distinct().select("line", tokens(F.col("line")).alias("words"))
    # both tables below are made from the model and the notices: a stated number of rows
    names = [f"w{k}" for k in range(len(FAMILIES))]
    weights = F.broadcast(spark.createDataFrame([(f, *row) for f, row in zip(model.features, model.weights.tolist(), strict=True)], "gram string, " + ", ".join(f"{n} double" for n in names)))
    parts = [(family, k, len(g), shingle) for family, texts in NOTICES.items() for k, t in enumerate(texts) for g in [set(_grams(_tokens(t), SHINGLE))] for shingle in sorted(g)]
    parts = F.broadcast(spark.createDataFrame(parts, "family string, notice int, n int, shingle string"))
    notices = {(family, g) for family, texts in NOTICES.items() for t in texts for w in [_tokens(t)] for g in _grams(w, min(SHINGLE, len(w)))}
    notices = F.broadcast(spark.createDataFrame(sorted(notices), "family string, shingle string"))
    each = words.select("line", F.explode(F.array_distinct(F.concat(*[grams(F.col("words"), n) for n in (1, 2, 3)]))).alias("gram"))
    sums = each.join(weights, "gram").groupBy("line").agg(*[F.sum(n).alias(n) for n in names])
    scores = F.array(*[(F.col(n) + F.lit(float(b))) * model.temperature for n, b in zip(names, model.bias, strict=True)])
    sums = sums.select("line", scores.alias("z")).withColumn("top", F.array_max("z"))
    odds = F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.col("top")))
    family = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.array_position("z", F.col("top")).cast("int"))
    judged = sums.select("line", family.alias("family"), (1 / odds).alias("probability")).where(F.col("family") != UNKNOWN)
    shingle = F.when(F.size("words") >= SHINGLE, grams(F.col("words"), SHINGLE)).otherwise(F.array(F.concat_ws(" ", "words")))
    compared = judged.join(words, "line").select("line", "family", F.explode(shingle).alias("shingle")).join(notices.withColumn("known", F.lit(1.0)), ["family", "shingle"], "left")
    similar = compared.groupBy("line").agg(F.avg(F.coalesce("known", F.lit(0.0))).alias("similarity"))
    around = judged.join(found.select("line", "block").distinct(), "line").select("line", "family", "block", tokens(F.col("block")).alias("words"))
    around = around.select("line", "family", "block", F.explode(F.array_distinct(grams(F.col("words"), SHINGLE))).alias("shingle")).join(parts, ["family", "shingle"])
    held = around.groupBy("line", "block", "notice", "n").agg((F.count("*") / F.col("n")).alias("held")).groupBy("line", "block").agg(F.max("held").alias("held"))
    verdict = found.select("line", "block").distinct().join(judged.join(similar, "line"), "line").join(held, ["line", "block"], "left")
    verdict = written(verdict.withColumn("similarity", F.greatest("similarity", "held")), "licence-verdicts")
    out = found.join(verdict, ["line", "block"]).select("doc_id", "paragraph", F.col("line").alias("text"), "family", "probability", "similarity")
    return out.withColumn("confirmed", F.col("similarity") >= SIMILARITY)
