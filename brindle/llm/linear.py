"""Sparse text features and linear models of them, for the classifiers.

A text's features are the hashes of its words and of their first and last bytes, present or not. Models are fitted by
proximal gradient descent with an L1 penalty on a bounded sample on the driver; scoring touches whole texts on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import hash_sample

BITS = 20


@dataclass(frozen=True)
class View:
    """Which features a text has: whole words, their first and last n bytes, lower-cased or not, words ending at punctuation or not,
    and whether one word stands three times in a row."""

    whole: bool = True
    first: tuple[int, ...] = ()
    last: tuple[int, ...] = ()
    lower: bool = True
    punctuation: bool = True
    runs: bool = False

    def bytes_of(self, text: str | None) -> bytes:
        text = text or ""
        return (text.lower() if self.lower else text).encode("utf-8", "surrogatepass")


def hashed(texts: list[bytes], view: View) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every occurrence in a run of texts."""
    data = b" ".join(texts)
    separators = words.PUNCTUATION if view.punctuation else words._SEPARATOR
    docs, found = [], []
    begins = np.cumsum([0] + [len(t) + 1 for t in texts])
    for at, piece in words.pieces(data, separators):
        raw = np.frombuffer(piece, np.uint8)
        s, e = words.spans(raw, separators)
        sums = words.prefix(words._TABLE[raw])
        doc = np.searchsorted(begins, s + at, "right") - 1
        for tag, a, b, ok in [(1, s, e, None)] * view.whole + [(2 * n, s, s + n, e - s > n) for n in view.first] + [(2 * n + 1, e - n, e, e - s > n) for n in view.last]:
            a, b, d = (a, b, doc) if ok is None else (a[ok], b[ok], doc[ok])
            h = words.mix(words.between(sums, a, b) + np.uint64(tag * 0x9E3779B97F4A7C15 % (1 << 64)))
            docs.append(d)
            found.append((h >> np.uint64(64 - BITS)).astype(np.int64))
        if view.runs and len(s) > 2:
            h = words.between(sums, s, e)
            again = np.flatnonzero((h[2:] == h[1:-1]) & (h[2:] == h[:-2]) & (doc[2:] == doc[:-2]))
            docs.append(doc[again])
            found.append(np.zeros(len(again), np.int64))
    return np.concatenate(docs), np.concatenate(found)


def present(texts: list[bytes], view: View, among: np.ndarray | None = None, ordered: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs, sorted if ``ordered``; only features that ``among`` (a table of booleans) holds, if given."""
    doc, feature = hashed(texts, view)
    if among is not None:
        ok = among[feature]
        doc, feature = doc[ok], feature[ok]
    both = (doc << BITS) | feature
    both = np.unique(both) if ordered else pd.unique(both)
    return both >> BITS, both & ((1 << BITS) - 1)


def features_of(text: Column, view: View) -> Column:
    """The sorted distinct features of a text, for the bounded sample that a model is fitted on."""

    @F.pandas_udf("array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list = []
            for _, run in words.grouped(view.bytes_of(t) for t in texts):
                doc, feature = present(run, view)
                out += np.split(feature.astype(np.int32), np.searchsorted(doc, np.arange(1, len(run))))
            yield pd.Series(out)

    return of(text)


def score(text: Column, view: View, weights) -> Column:
    """The sum of the weights (a broadcast table by feature) of a text's features."""

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = weights.value
        among = w != 0
        for texts in batches:
            out = []
            for _, run in words.grouped(view.bytes_of(t) for t in texts):
                doc, feature = present(run, view, among)
                out.append(np.bincount(doc, weights=w[feature], minlength=len(run)))
            yield pd.Series(np.concatenate(out) if out else np.zeros(0))

    return of(text)


class Rows:
    """Rows of binary features as arrays of rows and columns, restricted to the features ``keep``."""

    def __init__(self, rows: list[np.ndarray], keep: np.ndarray):
        row, flat = _flat(rows)
        at = np.full(1 << BITS, -1, np.int32)
        at[keep] = np.arange(len(keep), dtype=np.int32)
        col = at[flat]
        self.features, self.n = keep, len(rows)
        self.row, self.col = row[col >= 0], col[col >= 0]

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, weights=g[self.row], minlength=len(self.features))


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.array([len(r) for r in rows], np.int64)
    return np.repeat(np.arange(len(rows), dtype=np.int32), counts), np.concatenate([np.zeros(0, np.int32), *rows])


def telling(rows: list[np.ndarray], grade: np.ndarray, least: int = 3, score: float = 2.5) -> np.ndarray:
    """Features of at least ``least`` rows whose mean grade lies ``score`` standard errors or more from the mean of all."""
    row, flat = _flat(rows)
    seen = np.bincount(flat, minlength=1 << BITS)
    off = np.bincount(flat, weights=(grade - grade.mean())[row], minlength=1 << BITS) if len(flat) else np.zeros(1 << BITS)
    return np.flatnonzero((seen >= least) & (np.abs(off) >= score * np.sqrt(np.maximum(seen, 1)) * max(grade.std(), 1e-9)))


def best_cut(scores: np.ndarray, truth: np.ndarray, beta: float = 0.5) -> float:
    """The score at which calling all at or above it positive gives the best F-beta (below 1, precision weighs more); halfway to the next score below."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(truth[order])
    f = (1 + beta**2) * hits / (np.arange(1, len(scores) + 1) + beta**2 * max(truth.sum(), 1))
    i = int(f.argmax())
    below = scores[order[i + 1]] if i + 1 < len(scores) else scores[order[i]] - 1
    return float((scores[order[i]] + below) / 2)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def cumulative(scores: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade > k) for each score and cut k."""
    return sigmoid(scores[:, None] - cuts[None, :])


def ordinal_fit(x: Rows, grade: np.ndarray, grades: int, l1: float, weight: np.ndarray | None = None, rounds: int = 150, offset: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered cuts of a cumulative-link model P(grade > k) = sigmoid(w x + offset - cut_k): one weight vector for all cuts.

    The L1-penalised mean likelihood is minimised by accelerated proximal steps with backtracking. Two grades give logistic
    regression. Cuts are a first one and positive gaps, so they stay in order.
    """
    n, k = x.n, grades - 1
    share = np.ones(n) / max(n, 1) if weight is None else weight / weight.sum()
    tail = np.array([max((share * (grade > j)).sum(), 1e-4) for j in range(k)])
    start = np.log((1 - np.minimum(tail, 1 - 1e-4)) / tail)
    shape = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 0.05))])
    inc = lambda t: np.concatenate([t[:1], t[:1] + np.cumsum(np.exp(t[1:]))])

    def loss(w, t):
        cuts = np.concatenate([[-np.inf], inc(t), [np.inf]])
        s = x.times(w) if offset is None else x.times(w) + offset
        hi, lo = sigmoid(cuts[grade + 1] - s), sigmoid(cuts[grade] - s)
        p = np.maximum(hi - lo, 1e-12)
        dhi, dlo = hi * (1 - hi), lo * (1 - lo)
        gs = share * (dhi - dlo) / p
        per = np.zeros(k + 2)
        np.add.at(per, grade + 1, -share * dhi / p)
        np.add.at(per, grade, share * dlo / p)
        gc = per[1:-1]
        gt = np.array([gc.sum(), *(gc[j:].sum() * np.exp(t[j]) for j in range(1, k))])
        return -(share * np.log(p)).sum(), x.back(gs), gt

    w, t = np.zeros(len(x.features)), shape
    vw, vt, momentum, step = w, t, 1.0, 1.0
    before = np.inf
    for _ in range(rounds):
        f, gw, gt = loss(vw, vt)
        while True:
            nw = vw - step * gw
            nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
            nt = vt - step * gt
            dw, dt = nw - vw, nt - vt
            new = loss(nw, nt)[0]
            if new <= f + gw @ dw + gt @ dt + ((dw @ dw) + (dt @ dt)) / (2 * step) + 1e-12 or step < 1e-6:
                break
            step /= 2
        total = new + l1 * np.abs(nw).sum()
        if total > before:
            momentum, vw, vt = 1.0, w, t
            before = np.inf
            continue
        if before - total < 1e-7:
            w, t = nw, nt
            break
        before, later = total, (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        vw, vt = nw + (momentum - 1) / later * (nw - w), nt + (momentum - 1) / later * (nt - t)
        w, t, momentum = nw, nt, later
        step *= 1.3
    return w, inc(t)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, seed: int, label: str, *extra: str) -> DataFrame:
    """At most ``rows`` labelled documents (doc_id, text, label, extra columns): the labels with the smallest hashed doc_id, joined to their documents.

    A document labelled more than once has its most frequent label, the smallest if tied. The labels kept are few by the bound,
    so they are broadcast and no text is moved.
    """
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.mode(label, True).alias(label))
    chosen = hash_sample(one, "doc_id", rows, seed)
    return docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", label, *extra)
