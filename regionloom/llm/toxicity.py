"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; documents of the training fold,
whatever is known of them, are the unlabelled set.  A linear model over sparse
word features minimises the class-prior-corrected risk

    prior * R_p(+)  +  max(0, R_u(-) - prior * R_p(-))

with the logistic loss; where the second term falls below zero its gradient is
reversed, so a flexible model cannot push it down by memorising positives.  The
prior is the share of toxic ones among labelled training documents.

Features are a word and its first 4, 5 and 6 letters, each hashed to 64 bits
and counted once a document.  Those that positives have more often than the
unlabelled set (likelihood ratio), and often enough for at least ``PURITY`` of
their unlabelled documents to be positive at that prior, become the model: at
most ``MOST_FEATURES``.  Fitting reads at most ``MOST_POSITIVE`` and
``MOST_UNLABELLED`` whole texts: as many doc_ids are chosen by a hash, and of
each the one text with the least hash, however often the doc_id is repeated.
Every text is scored whole.

Defined cases: null and blank texts, like all texts without a feature, get the
score of the intercept; null doc_ids count as held out and are never learnt
from; a doc_id with several labels is toxic if one is; without positives no
feature is learnt and every score is near the floor; repeated rows and other
columns change nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

FOLDS = 5
MOST_POSITIVE = 6000
MOST_UNLABELLED = 18000
MOST_FEATURES = 4096
LEAST_RATIO = 20.0
PURITY = 0.7
PREFIXES = (4, 5, 6)
STEPS = 400
RATE = 0.1
DECAY = 1e-4
_EDGE = ".,;:!?*#$%&|\"'()[]{}<>-"
_KEPT = 1_000_000


def _features(word: str) -> tuple[int, ...]:
    import xxhash

    word = word.strip(_EDGE)
    if len(word) < 3 or not re.fullmatch(r"[^\W\d_]+", word):
        return ()
    parts = ["=" + word] + [word[:n] for n in PREFIXES if len(word) >= n]
    return tuple(xxhash.xxh64_intdigest(p.encode()) - (1 << 63) for p in parts)


def _words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


@dataclass(frozen=True)
class Model:
    features: tuple[int, ...]
    weights: tuple[float, ...]
    bias: float

    def score(self, texts: list[str | None], known: dict[str, tuple[int, ...]]) -> np.ndarray:
        place = {f: i for i, f in enumerate(self.features)}
        out = np.full(len(texts), self.bias)
        for i, text in enumerate(texts):
            words = _words(text)
            new = words.difference(known)
            if len(known) + len(new) > _KEPT:
                known.clear()
                new = words
            for w in new:
                known[w] = tuple(place[f] for f in _features(w) if f in place)
            hit = set().union(*filter(None, map(known.__getitem__, words)))
            out[i] += sum(self.weights[f] for f in sorted(hit))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], n_features: int, prior: float, times: tuple[list[int], list[int]] | None = None) -> tuple[np.ndarray, float]:
    """Weights and intercept from rows of feature numbers; ``times`` says how often each row counts."""

    def packed(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.array([len(r) for r in rows])

    (pf, pn), (uf, un) = packed(positive), packed(unlabelled)
    share = lambda c: np.asarray(c, np.float64) / np.sum(c)
    ps, us = (share(c) for c in times or ([1] * len(pn), [1] * len(un)))
    w, b = np.zeros(n_features), -1.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    value = lambda f, n: np.bincount(np.repeat(np.arange(len(n)), n), weights=w[f], minlength=len(n)) + b
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    grad = lambda f, n, g: np.append(np.bincount(f, weights=np.repeat(g, n), minlength=n_features), g.sum())
    for step in range(1, STEPS + 1):
        zp, zu = value(pf, pn), value(uf, un)
        negative = us @ np.logaddexp(0, zu) - prior * (ps @ np.logaddexp(0, zp))
        as_positive = grad(pf, pn, prior * (sigmoid(zp) - 1) * ps)
        as_negative = grad(uf, un, sigmoid(zu) * us) - grad(pf, pn, prior * sigmoid(zp) * ps)
        g = as_positive + as_negative if negative >= 0 else -as_negative
        g[:-1] += DECAY * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the training fold."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, toxic = marks.agg(F.count("*"), F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0))).first()
    prior = min(max((toxic or 0) / max(n, 1), 1e-3), 0.5)
    order = lambda d, most: d.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(most)
    positive = order(marks.where("toxic = 1").select("doc_id"), MOST_POSITIVE).withColumn("positive", F.lit(True))
    unlabelled = order(docs.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).select("doc_id").distinct(), MOST_UNLABELLED).withColumn("positive", F.lit(False))
    # both lists have a stated number of rows at most
    chosen = F.broadcast(written(positive.unionByName(unlabelled).select(F.col("doc_id").alias("id"), "positive"), "toxicity-chosen"))
    # one text of each: hashes are compared before any text is moved
    texts = docs.select("doc_id", "text", F.xxhash64("text", F.lit(3)).alias("hash"))
    least = texts.select("doc_id", "hash").join(chosen.select("id").distinct(), F.col("doc_id") == F.col("id"), "left_semi").groupBy("doc_id").agg(F.min("hash").alias("hash"))
    chosen = F.broadcast(written(chosen.join(least.withColumnRenamed("doc_id", "id"), "id"), "toxicity-rows"))

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, ...]] = {}
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                words = _words(text)
                known.update((w, _features(w)) for w in words.difference(known))
                rows.append(list(set().union(*map(known.__getitem__, words))))
                if len(known) > _KEPT:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("positive"), pa.array(rows, pa.list_(pa.int64()))], ["id", "positive", "features"])

    sample = texts.join(chosen, (F.col("doc_id") == F.col("id")) & (texts["hash"] == chosen["hash"])).select("id", "positive", "text")
    # rows equal in id and text are one: combined before the shuffle
    sample = sample.groupBy("id", "positive").agg(F.min("text").alias("text")).select(F.col("id").cast("long").alias("id"), "positive", "text")
    sample = written(sample.mapInArrow(featured, "id bigint, positive boolean, features array<bigint>"), "toxicity-sample")
    rows_p, rows_u = (sample.where("positive").count(), sample.where("not positive").count())
    if not rows_p or not rows_u:
        return Model((), (), float(np.log(1e-3)))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    expected = (a + b) / (rows_p + rows_u)
    term = lambda x, n: F.when(x > 0, x * F.ln(x / (expected * n))).otherwise(0.0)
    counts = sample.select("positive", F.explode("features").alias("feature")).groupBy("feature").agg(F.count_if("positive").alias("a"), F.count_if(~F.col("positive")).alias("b"))
    purity = prior * (a / rows_p) / ((b + 1) / rows_u)
    ratio = 2 * (term(a, rows_p) + term(b, rows_u))
    best = counts.where((a / rows_p > b / rows_u) & (ratio >= LEAST_RATIO) & (purity >= PURITY)).orderBy(ratio.desc(), "feature").limit(MOST_FEATURES).select("feature").collect()
    features = [r.feature for r in best]
    if not features:
        return Model((), (), float(np.log(1e-3)))
    place = {f: i for i, f in enumerate(features)}

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [sorted(place[f] for f in fs if f in place) for fs in batch.column("features").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(rows, pa.list_(pa.int32()))], ["positive", "f"])

    numbers = sample.select("positive", "features").mapInArrow(numbered, "positive boolean, f array<int>").groupBy("positive", "f").count().collect()
    numbers.sort(key=lambda r: (r.positive, tuple(r.f)))
    rows = {kind: [np.array(r.f, np.int64) for r in numbers if r.positive == kind] for kind in (True, False)}
    times = tuple([r["count"] for r in numbers if r.positive == kind] for kind in (True, False))
    w, bias = fit_nnpu(rows[True], rows[False], len(features), prior, times)
    return Model(tuple(features), tuple(w.tolist()), bias)


def scorer(model: Model):
    """A Column function: text -> score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, tuple[int, ...]] = {}
        for texts in batches:
            yield pd.Series(model.score([t if isinstance(t, str) else None for t in texts], known))

    return score


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = train(docs, labels)
    out = docs.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), scorer(model)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with their columns."""
    model = train(docs, labels)
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), scorer(model)(docs["text"]).alias("score"))
    return row.where("score < 0.5").select("row.*")
