"""Quality by co-training: a text classifier and a page-metadata classifier teach each other, then score all documents together.

The text view has the words; the metadata view has language, source, length and layout (which shares of a page are capitals,
symbols, digits, line ends, letters beyond ASCII). Each view is a logistic model of the labelled sample and corpus statistics: how
often each of its features stands in the documents of which the *other* view is surest. Each round scores every document on the
executors with both views; the surest share of each class, by rank over all documents, are pseudo-labels, whose features are
counted there. Only sums by hashed feature come back, whose number is bounded by the hash. The next round fits each labelled model
anew on top of its statistics, so what a view calls rests on what the other one taught it.

A view is calibrated by a logistic regression of labels on its two parts, over labelled rows that took no part in fitting; other
such rows weigh the two views in one combination, which scores every document. Below FEW labelled rows nothing can be set aside:
there the columns of each row come from a fit without its fold, and all rows calibrate and weigh.

Fitting uses at most ``SAMPLE_ROWS`` labelled rows. Statistics, ranks and scores read every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import linear, words
from .shared import Stash, bounded_batches

TEXT = linear.View(first=(1, 2, 3), last=(1, 2, 3), lower=False, punctuation=False, runs=True)
#: The most labelled rows that a model is fitted on.
SAMPLE_ROWS = 5000
ROUNDS = 2
#: The share of each class, by its share of the labels, of which a view is surest and which it passes on.
SURE = 0.5
#: Bins of log-odds by which documents are ranked.
BINS, REACH = 256, 12.0
#: Labelled rows below which folds take the place of rows set aside, and their number.
FEW, FOLDS = 200, 5
#: Features in fewer confident calls say nothing; those whose shares differ by fewer standard errors neither.
LEAST, TELLING = 20, 4.0
L1 = 7e-4
_SIZE = 1 << linear.BITS
_NONE = np.zeros(_SIZE, np.float32)


@dataclass
class Part:
    """A view: weights of the labelled model, log-odds of the corpus statistics, and the calibration (intercept and one factor each)."""

    weights: np.ndarray = field(default_factory=lambda: _NONE)
    counted: np.ndarray = field(default_factory=lambda: _NONE)
    mix: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def columns(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """The two parts' scores of ``n`` rows of (row, feature) pairs; the statistics' one is a mean over telling features."""
        known = np.bincount(row, weights=self.weights[feature], minlength=n)
        odds = self.counted[feature]
        told = np.bincount(row, weights=odds, minlength=n) / (np.bincount(row, weights=odds != 0, minlength=n) + 4)
        return np.column_stack([known, told])

    def odds(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Calibrated log-odds."""
        return _line(self.columns(row, feature, n), self.mix)


@dataclass
class Model:
    """Both views, and the combination (intercept, text, metadata) of their calibrated log-odds."""

    text: Part
    meta: Part
    mix: np.ndarray


def _line(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return b[0] + np.clip(x, -20, 20) @ b[1:]


def metadata(docs_columns: list[str]) -> Column:
    """The metadata view as hashed features: language, source, their pair, and the length by powers of two; null is a value."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs_columns else F.lit("")
    size = F.floor(F.log2(1 + F.coalesce(F.length("text"), F.lit(0)))).cast("string")
    parts = [F.array(F.lit("lang"), of("lang")), F.array(F.lit("source"), of("source")), F.array(F.lit("both"), of("lang"), of("source")), F.array(F.lit("size"), size)]
    return F.array_sort(F.array_distinct(F.array(*[F.shiftrightunsigned(F.xxhash64(p), 64 - linear.BITS).cast("int") for p in parts])))


# The kinds of characters whose shares are a page's layout: capitals, digits, symbols, line ends, bytes beyond ASCII.
_KINDS = (range(0x41, 0x5B), range(0x30, 0x3A), [*range(0x21, 0x27), *range(0x28, 0x2C), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)], (0x0A,), range(0x80, 0x100))
#: Steps of a share: each halves it.
_STEPS = 12


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the layout of a run of texts: for each kind of character the order of magnitude of its share."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([0] + [len(t) for t in texts])
    size = np.maximum(np.diff(ends), 1)
    rows, found = [], []
    for k, kind in enumerate(_KINDS):
        table = np.zeros(256, np.uint8)
        table[list(kind)] = 1
        n = np.concatenate([[0], np.cumsum(table[raw], dtype=np.int64)])[ends]
        level = np.minimum(np.log2(np.maximum(np.diff(n), 2.0**-_STEPS * size) / size) + _STEPS, _STEPS)
        tag = (np.floor(level * 2) + 100 * (k + 1)).astype(np.uint64)
        rows.append(np.arange(len(texts)))
        found.append((words.mix(tag * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - linear.BITS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(found)


def _pairs(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate([np.zeros(0, np.int64), *lists]).astype(np.int64)


def _train(rows: list[np.ndarray], y: np.ndarray, least: int, offset: np.ndarray) -> np.ndarray:
    """The labelled model's weights by feature, on top of what ``offset`` says of each row."""
    table = np.zeros(_SIZE, np.float32)
    if len(y) and y.min() < y.max():
        x = linear.Rows(rows, linear.telling(rows, y, least, 2.5 if len(y) >= FEW else 1.5))  # few rows cannot give 2.5 standard errors
        table[x.features] = linear.ordinal_fit(x, y, 2, L1, rounds=80, offset=offset)[0]
    return table


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of y on a few columns of log-odds with a small ridge, by Newton steps. A column that would count against itself does not count."""
    use = np.ones(x.shape[1], bool)
    while True:
        z = np.column_stack([np.ones(len(x)), np.clip(x[:, use], -20, 20)])
        b = np.zeros(z.shape[1])
        for _ in range(30):
            p = linear.sigmoid(z @ b)
            grad = z.T @ (y - p) - 1e-1 * b
            b += np.linalg.solve((z.T * (p * (1 - p))) @ z + 1e-1 * np.eye(len(b)), grad)
        if (b[1:] >= 0).all():
            out = np.zeros(x.shape[1] + 1)
            out[np.concatenate([[True], use])] = b
            return out
        use[np.flatnonzero(use)[b[1:] < 0]] = False


def _batches(batches: Iterator[pa.RecordBatch], text: bool = True) -> Iterator[tuple[int, tuple | None, tuple]]:
    """(rows, text pairs, metadata pairs) for runs of rows of bounded size, of batches (text, m); without ``text`` no text pairs."""
    for batch in batches:
        meta = [np.asarray(m, np.int64) for m in batch.column("m").to_pylist()]
        for first, run in words.grouped(TEXT.bytes_of(t) for t in batch.column("text").to_pylist()):
            own, shape = _pairs(meta[first : first + len(run)]), layout(run)
            yield len(run), linear.present(run, TEXT, ordered=False) if text else None, (np.concatenate([own[0], shape[0]]), np.concatenate([own[1], shape[1]]))


def _bin(odds: np.ndarray) -> np.ndarray:
    """The bin of log-odds, from the lowest."""
    return np.clip(((odds + REACH) * (BINS / (2 * REACH))).astype(np.int64), 0, BINS - 1)


def surest(counts: np.ndarray, shares: tuple[float, float]) -> tuple[int, int]:
    """(bad up to this bin, good from this bin): the bins that hold at most the share ``shares`` (bad, good) of all documents at each end.

    Whole bins are taken, the outermost first and always one, but none that both ends would hold: a view that says nothing is sure of nothing.
    """
    up, down = np.cumsum(counts), np.cumsum(counts[::-1])[::-1]
    there = np.flatnonzero(counts)
    if len(there) < 2:
        return -1, len(counts)
    low, high = int(np.searchsorted(up, shares[0] * up[-1], "right")) - 1, len(counts) - int(np.searchsorted(down[::-1], shares[1] * up[-1], "right"))
    low, high = there[there <= max(low, there[0])][-1], there[there >= min(high, there[-1])][0]
    return (int(low), int(high)) if low < high else (-1, len(counts))


def _odds_table(feature: np.ndarray, bad: np.ndarray, good: np.ndarray, calls: tuple[int, int]) -> np.ndarray:
    """Log-odds by feature from the calls that hold it; features that do not tell have none."""
    table = np.zeros(_SIZE, np.float32)
    if min(calls) >= LEAST:
        shares = [(x + 0.5) / (n + 1) for x, n in zip((bad, good), calls)]
        error = np.sqrt(sum(s * (1 - s) / n for s, n in zip(shares, calls)))
        ok = (bad + good >= LEAST) & (np.abs(shares[1] - shares[0]) >= TELLING * error)
        table[feature[ok]] = (np.log(shares[1]) - np.log(shares[0]))[ok]
    return table


def statistics(docs: DataFrame, model: Model, shares: tuple[float, float], stash: Stash, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds by feature, of text and of metadata, from the documents of ``docs`` (text, m) of which the other view is surest.

    ``shares``: how much of all documents each class of calls takes (bad, good). The metadata view is ranked first, in a pass of its
    own; the second pass counts the text features of its calls, and the metadata features by bin of the text view, whose ranks
    are known when the sums are.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BINS, np.int64)
        for n, _, meta in _batches(batches, text=False):
            np.add.at(seen, _bin(held.value.meta.odds(*meta, n)), 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS, dtype=np.int32)), pa.array(seen)], ["bin", "n"])

    total = docs.mapInArrow(ranked, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").toArrow()
    low, high = surest(total.column("n").to_numpy() if total.num_rows else np.zeros(BINS), shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, seen, calls, by_bin = held.value, np.zeros((2, _SIZE), np.int32), np.zeros(2, np.int64), {}
        for n, text, meta in _batches(batches):
            teacher = _bin(m.meta.odds(*meta, n))
            for good, sure in ((0, teacher <= low), (1, teacher >= high)):
                calls[good] += sure.sum()
                np.add.at(seen[good], text[1][sure[text[0]]], 1)
            at = _bin(m.text.odds(*text, n))
            keys = np.concatenate([at[meta[0]] << (linear.BITS + 1) | meta[1] + 1, at << (linear.BITS + 1)])  # feature 0: the documents themselves
            for k, c in zip(*np.unique(keys, return_counts=True)):
                by_bin[int(k)] = by_bin.get(int(k), 0) + int(c)
        for good in (0, 1):
            at = np.flatnonzero(seen[good])
            yield _rows(0, good, np.append(at, -1), np.append(seen[good, at], calls[good]))
        keys = np.array(list(by_bin), np.int64)
        yield _rows(1, keys >> (linear.BITS + 1), (keys & ((1 << (linear.BITS + 1)) - 1)) - 1, np.array(list(by_bin.values()), np.int64))

    # Sums by hashed feature: at most 2 ** BITS rows a class or bin, whatever the corpus.
    sums = stash.keep(docs.mapInArrow(run, "view int, at int, feature int, n long").groupBy("view", "at", "feature").agg(F.sum("n").alias("n")), name)
    by_bin = np.zeros(BINS, np.int64)
    for r in sums.where("view = 1 and feature < 0").collect():
        by_bin[r["at"]] = r["n"]
    bad_to, good_from = surest(by_bin, shares)
    side = F.when(F.col("view") == 0, F.col("at")).when(F.col("at") <= bad_to, 0).when(F.col("at") >= good_from, 1)
    told = sums.withColumn("side", side).where("side is not null").groupBy("view", "feature").agg(F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("good"))
    got = told.where((F.col("bad") + F.col("good") >= LEAST) | (F.col("feature") < 0)).toArrow()
    view, feature, bad, good = (got.column(c).to_numpy() for c in ("view", "feature", "bad", "good"))
    out = []
    for v in (0, 1):
        at, all_ = (view == v) & (feature >= 0), (view == v) & (feature < 0)
        out.append(_odds_table(feature[at], bad[at], good[at], (int(bad[all_].sum()), int(good[all_].sum()))))
    held.destroy()
    stash.drop(name)
    return out[0], out[1]


def _rows(view: int, at, feature: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    i = lambda x: pa.array(np.broadcast_to(x, len(feature)).astype(np.int32))
    return pa.RecordBatch.from_arrays([i(view), i(at), i(feature), pa.array(n.astype(np.int64))], ["view", "at", "feature", "n"])


def _fitted(own: Part, rows: list[np.ndarray], y: np.ndarray, train: np.ndarray) -> np.ndarray:
    """Fit the labelled model of a view on the rows ``train``, on top of its statistics, and return the columns of all rows.

    The statistics' part counts as the calibration before said; before any, as it is.
    """
    told = own.columns(*_pairs(rows), len(rows))[:, 1]
    scale = own.mix[2] if own.mix.any() else 1.0
    own.weights = _train([r for r, ok in zip(rows, train) if ok], y[train], 3, scale * told[train])
    return own.columns(*_pairs(rows), len(rows))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, rounds: int = ROUNDS, seed: int = 5) -> Model:
    """Co-train on a bounded labelled sample and the statistics of all documents; ``rounds`` of 0 switches the exchange off.

    Null labels do not count; a document labelled more than once has its most frequent label, the smaller if tied. Without
    rows of both classes every document gets the labels' one class (a half without labels). With FEW labelled rows or more, 14
    of 20 fit the views, three calibrate each view, three weigh the views; below that features of less certainty are let in, each row is held out in one of FOLDS folds,
    all rows calibrate and weigh by what was found without them, and the models kept are fitted on all.
    """
    known = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    extra = [c for c in ("lang", "source") if c in docs.columns]
    sample = linear.labelled_sample(docs, known, rows, seed, "y", *extra)
    got = sample.select("y", "text", metadata(sample.columns).alias("m"), "doc_id").orderBy("doc_id", "text").toArrow()
    y = got.column("y").to_numpy().astype(np.int64)
    if not len(y) or y.min() == y.max():
        at = 0.0 if not len(y) else (5.0 if y[0] else -5.0)
        return Model(Part(), Part(), np.array([at, 0.0, 0.0]))
    lists: tuple[list, list] = ([], [])
    for batch in got.to_batches():
        for n, *both in _batches([batch]):
            for out, (row, feature) in zip(lists, both):
                order = np.argsort(row, kind="stable")
                out += [np.unique(f).astype(np.int32) for f in np.split(feature[order], np.searchsorted(row[order], np.arange(1, n)))]
    model = Model(Part(), Part(), np.array([0.0, 1.0, 1.0]))
    views = (model.text, model.meta)
    few = len(y) < FEW
    part = np.arange(len(y)) % FOLDS if few else np.digitize(np.arange(len(y)) % 20, (14, 17))
    shares = (SURE * float(1 - y.mean()), SURE * float(y.mean()))
    stash, all_docs = Stash(docs.sparkSession, "cotrain"), docs.select("text", metadata(docs.columns).alias("m"))
    for turn in range(rounds + 1):
        columns = []
        for own, x in zip(views, lists):
            if few:
                whole = np.zeros((len(y), 2))
                for k in range(FOLDS):
                    whole[part == k] = _fitted(own, x, y, part != k)[part == k]
                _fitted(own, x, y, np.ones(len(y), bool))
                own.mix = _logistic(whole, y)
            else:
                whole = _fitted(own, x, y, part == 0)
                own.mix = _logistic(whole[part == 1], y[part == 1])
            columns.append(_line(whole, own.mix))
        if turn < rounds:
            model.text.counted, model.meta.counted = statistics(all_docs, model, shares, stash, f"round{turn}")
    weigh = np.ones(len(y), bool) if few else part == 2
    model.mix = _logistic(np.column_stack(columns)[weigh], y[weigh])
    return model


def qualities(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """(doc_id, p_text, p_meta, quality, keep) for each row of ``docs`` (doc_id, text; lang and source where there).

    ``p_text`` and ``p_meta`` are the views' own calibrated probabilities, ``quality`` their combination, ``keep`` whether it
    is a half or more. Null and empty texts have no text feature and are scored by what is left; repeated rows are scored
    alike; texts of any length are read whole; other columns are ignored. An empty table gives none.
    """
    bounded_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label))

    @F.pandas_udf("p_text double, p_meta double, odds double")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        m = held.value
        for texts, metas in batches:
            rows = pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(list(metas), pa.list_(pa.int32()))], ["text", "m"])
            both = [np.column_stack([m.text.odds(*text, n), m.meta.odds(*meta, n)]) for n, text, meta in _batches([rows])] or [np.zeros((0, 2))]
            x = np.concatenate(both)
            yield pd.DataFrame({"p_text": linear.sigmoid(x[:, 0]), "p_meta": linear.sigmoid(x[:, 1]), "odds": _line(x, m.mix)})

    scored = docs.select("doc_id", judged(F.col("text"), metadata(docs.columns)).alias("j"))
    return scored.select("doc_id", "j.p_text", "j.p_meta", (1 / (1 + F.exp(-F.col("j.odds")))).alias("quality"), (F.col("j.odds") >= 0).alias("keep"))
