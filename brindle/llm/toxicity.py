"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w x - cut_k) with one weight vector for all thresholds and ordered cuts; a text's severity is the
expected grade, the sum of these probabilities. Features are a text's words and their beginnings, present or not, so a toxic
passage counts the same in a long text. The model is fitted on a bounded sample of labelled rows; every text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear
from .shared import bounded_batches, packed

VIEW = linear.View(first=(4, 5, 6, 7))
#: The most labelled rows that a model is fitted on.
SAMPLE_ROWS = 8000
L1 = 3e-4


@dataclass
class Model:
    """``weights`` by feature, ordered ``cuts``, and the ``flag`` score at which a text counts as above grade 0."""

    weights: np.ndarray
    cuts: np.ndarray
    flag: float


def fit(docs: DataFrame, labels: DataFrame, grade: str = "toxic", rows: int = SAMPLE_ROWS, seed: int = 11, l1: float = L1) -> Model:
    """A model of ``labels.grade`` (0, 1, ... ; null rows stay out) on at most ``rows`` labelled documents of ``docs``.

    A fifth of the sample is held out to set ``flag``. A document labelled more than once has its most frequent grade, the
    smallest if tied. With no labelled row, or grade 0 only, no text is toxic; with no grade 0, all are. With fewer than 50
    labelled rows none is held out and ``flag`` is set on the rows that were fitted.
    """
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(grade).isNotNull()).select("doc_id", F.col(grade).cast("int").alias("_grade"))
    sample = linear.labelled_sample(docs, known, rows, seed, "_grade")
    got = sample.select("doc_id", "_grade", linear.features_of(F.col("text"), VIEW).alias("f")).orderBy("doc_id", "f").toArrow()
    y = got.column("_grade").to_numpy().astype(np.int64)
    feats = [np.asarray(x.values.to_numpy(zero_copy_only=False), np.int32) for x in got.column("f")]
    if not len(y) or y.max() == y.min():
        above_zero = len(y) > 0 and y[0] > 0
        return Model(np.zeros(1 << linear.BITS, np.float32), np.array([-5.0 if above_zero else 5.0]), -5.0 if above_zero else 5.0)
    kept = np.arange(len(y)) % 5 != 0 if len(y) >= 50 else np.ones(len(y), bool)
    train = [f for f, k in zip(feats, kept) if k]
    x = linear.Rows(train, linear.telling(train, y[kept]))
    w, cuts = linear.ordinal_fit(x, y[kept], int(y.max()) + 1, l1)
    weights = np.zeros(1 << linear.BITS, np.float32)
    weights[x.features] = w
    held = feats if kept.all() else [f for f, k in zip(feats, kept) if not k]
    truth = (y if kept.all() else y[~kept]) > 0
    scores = np.array([weights[f].sum() for f in held]) if held else np.zeros(0)
    flag = linear.best_cut(scores, truth) if truth.any() and not truth.all() else float(cuts[0])
    return Model(weights, cuts, max(flag, float(cuts[0]) - 3.0))


def above(score: Column, cut: float) -> Column:
    return 1 / (1 + F.exp(F.lit(float(cut)) - score))


def scored(docs: DataFrame, model: Model, *columns: Column) -> DataFrame:
    """``columns`` and ``score``, ``severity`` (expected grade), ``p_toxic`` = P(grade > 0) and ``toxic`` for each row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model.weights)
    one = docs.select(*columns, linear.score(F.col("text"), VIEW, held).alias("_score"))
    severity = sum((above(F.col("_score"), c) for c in model.cuts[1:]), above(F.col("_score"), model.cuts[0]))
    names = [F.col(f"`{c}`") for c in one.columns[:-1]]
    return one.select(*names, F.col("_score").alias("score"), severity.alias("severity"), above(F.col("_score"), model.cuts[0]).alias("p_toxic"), (F.col("_score") > model.flag).alias("toxic"))


def severities(docs: DataFrame, labels: DataFrame, grade: str = "toxic") -> DataFrame:
    """(doc_id, score, severity, p_toxic, toxic) for each row of ``docs`` (doc_id, text).

    Null and empty texts score zero; repeated rows score alike; texts of any length are read whole. An empty table gives none.
    """
    return scored(docs, fit(docs, labels, grade), F.col("doc_id"))


def drop_toxic(docs: DataFrame, labels: DataFrame, grade: str = "toxic") -> DataFrame:
    """``docs`` without the texts that the model calls toxic; all columns stay."""
    rows = packed(docs, F.col("text"))
    return scored(rows, fit(docs, labels, grade), F.col("row")).where(~F.col("toxic")).select("row.*")
