"""Repeated word windows across documents, found level by level: each level's windows are twice as long as the last's.

Level 0 looks at windows of half the wanted length. Not all of them: each window of full length names one of its half-length
windows, the one with the smallest hash (so equal windows name equal ones), and only those are compared. Two in 27 positions
are named for windows of 50 words. A half-length window that occurs in one text alone rules out every full-length window
that names it. Level 1 extends what is left to full length and compares those windows exactly, by 96 bits of hash; further
levels (``levels``) double again what repeats until nothing survives.

Copies of a whole text are one text at every level: only the text's smallest doc_id takes part, and a copy's windows all
start in that document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import Stash

WINDOW = 50


def named(h: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position of a run of texts: the hash that its ``n``-word window names, and whether the window lies in one text."""
    half = words.windows(h, n // 2, base=1)
    span = n - n // 2 + 1
    if len(half) < span:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    return least(half, span), words.whole(offsets, n)


def least(x: np.ndarray, span: int) -> np.ndarray:
    """The minimum over each ``span`` consecutive values, from running minima inside blocks of ``span``."""
    n = len(x) - span + 1
    padded = np.concatenate([x, np.full(-len(x) % span, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[span - 1 : span - 1 + n])


def _named_windows(n: int):
    """(id, key, text) batches to (anchor, key, id): the distinct hashes that each text's windows name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("k1").to_numpy(zero_copy_only=False), batch.column("doc_id")
            for first, texts in words.grouped(batch.column("text").to_pylist()):
                h, offsets = words.hashed(texts)
                m, ok = named(h, offsets, n)
                at = np.flatnonzero(ok)
                if not len(at):
                    continue
                doc = np.searchsorted(offsets, at, "right") - 1
                m = m[at]
                new = np.ones(len(at), bool)
                new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
                doc, m = doc[new], m[new]
                order = np.lexsort((m, doc))
                doc, m = doc[order], m[order]
                new = np.ones(len(m), bool)
                new[1:] = (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])
                doc, m = doc[new] + first, m[new]
                yield pa.record_batch({"anchor": m.view(np.int64), "k1": keys[doc], "doc_id": ids.take(pa.array(doc))})

    return run


def _full_windows(n: int):
    """(id, key, text, surviving anchors with whether this is their smallest document) batches to full-length windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = batch.column("k1").to_numpy(zero_copy_only=False), batch.column("doc_id").to_numpy(zero_copy_only=False)
            kept, first_in = batch.column("anchors"), batch.column("firsts")
            for first, texts in words.grouped(batch.column("text").to_pylist()):
                h, offsets = words.hashed(texts)
                m, ok = named(h, offsets, n)
                parts = []
                for i in range(len(texts)):
                    a = np.asarray(kept[first + i].values.to_numpy(zero_copy_only=False)).view(np.uint64)
                    low = np.asarray(first_in[first + i].values.to_numpy(zero_copy_only=False)).view(np.uint64)
                    lo, hi = int(offsets[i]), max(int(offsets[i]), int(offsets[i + 1]) - n + 1)
                    at = lo + np.flatnonzero(np.isin(m[lo:hi], a))
                    parts.append((np.full(len(at), first + i), at, ~np.isin(m[at], low)))
                doc, at, probe = map(np.concatenate, zip(*parts))
                if not len(at):
                    continue
                one = words.between(words.prefix(h, 1), at, at + n, 1)
                two = words.between(words.prefix(h, 2), at, at + n, 2)
                yield pa.record_batch({"h1": one.view(np.int64), "h2": (two >> np.uint64(32)).astype(np.uint32).view(np.int32), "doc_id": ids[doc], "k1": keys[doc], "pos": (at - offsets[doc - first]).astype(np.int32), "probe": probe})

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """Each row with two independent hashes of its text; null is the empty text."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.cast("binary").alias("text"))


def repeated_windows(docs: DataFrame, stash: Stash, n: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(first document of each text: k1, k2, rep), (windows that also start in a smaller document: doc_id, k1, pos)."""
    rows = _keyed(docs)
    reps = rows.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    kind = docs.schema["doc_id"].dataType.simpleString()
    named_rows = stash.keep(rows.where("doc_id is not null").select("doc_id", "k1", "text").mapInArrow(_named_windows(n), f"anchor long, k1 long, doc_id {kind}"), "named")
    again = named_rows.groupBy("anchor").agg(F.min("k1").alias("lo"), F.max("k1").alias("hi"), F.min("doc_id").alias("first")).where("lo <> hi").select("anchor", "first")
    again = stash.keep(again, "again")  # as a table of its own, so that both sides of the join are exchanges and a hot anchor is split
    held = named_rows.join(again, "anchor")
    of_text = held.groupBy("k1", "doc_id").agg(F.collect_set("anchor").alias("anchors"), F.collect_set(F.when(F.col("first") == F.col("doc_id"), F.col("anchor"))).alias("firsts"))
    cand = stash.keep(of_text.join(reps, (of_text["doc_id"] == reps["rep"]) & (of_text["k1"] == reps["k1"])).select(of_text["doc_id"], of_text["k1"], "anchors", "firsts"), "candidates")
    stash.drop("named")
    with_text = rows.select("doc_id", "k1", "text").join(cand, ["doc_id", "k1"]).select("doc_id", "k1", "text", "anchors", "firsts")
    full = stash.keep(with_text.mapInArrow(_full_windows(n), f"h1 long, h2 int, doc_id {kind}, k1 long, pos int, probe boolean"), "windows")
    least_of = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h1", "h2", "first")
    least_of = stash.keep(least_of, "least")  # likewise
    later = full.where("probe").join(least_of, ["h1", "h2"]).where("doc_id > first").select("doc_id", "k1", "pos")
    return reps, later


def _removed(n: int):
    """(doc_id, text, whether a smaller document has the whole text, window starts) batches to the digest of what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, copies, starts = batch.column("text").to_pylist(), batch.column("copy").to_pylist(), batch.column("starts")
            total, gone, sha, kept_text = [], [], [], []
            for i, text in enumerate(texts):
                own = text.split()
                drop = np.zeros(len(own) + 1, np.int32)
                if copies[i] and len(own) >= n:
                    drop[0] = 1
                elif starts[i].is_valid:
                    at = np.asarray(starts[i].values.to_numpy(zero_copy_only=False))
                    np.add.at(drop, at, 1)
                    np.add.at(drop, at + n, -1)
                out = np.cumsum(drop[:-1]) > 0
                kept = b" ".join(own if not out.any() else [own[j] for j in np.flatnonzero(~out).tolist()])
                total.append(len(own))
                gone.append(int(out.sum()))
                sha.append(hashlib.sha256(kept).hexdigest())
                kept_text.append(kept)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept": pa.array(kept_text, pa.binary()).cast(pa.string())})

    return run


def deduplicated(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept): each row of ``docs`` (doc_id, text) without what smaller documents have.

    A word goes if a window of ``n`` words covers it whose word sequence also starts in a document with a smaller doc_id.
    Null texts are empty. A row without doc_id loses nothing and takes nothing from others. Rows that repeat a doc_id are
    the same document: they take nothing from each other. An empty table gives none. Texts are read whole, some megabytes at
    a time, however long; other columns, whatever their names, are not read.
    """
    stash = Stash(docs.sparkSession, "substring")
    reps, later = repeated_windows(docs, stash, n)
    starts = later.groupBy("doc_id", "k1").agg(F.collect_set("pos").alias("starts"))
    firsts = reps.select(F.col("rep").alias("doc_id"), "k1")
    marks = stash.keep(firsts.join(starts, ["doc_id", "k1"], "left").select("doc_id", "k1", "starts"), "starts")
    stash.drop("windows")
    stash.drop("candidates")
    rows = _keyed(docs).select("doc_id", "k1", "text")
    found = marks.select(F.col("doc_id").alias("_id"), F.col("k1").alias("_k1"), "starts", F.lit(True).alias("is_first"))
    joined = rows.join(found, (F.col("doc_id") == F.col("_id")) & (F.col("k1") == F.col("_k1")), "left")
    copy = F.col("doc_id").isNotNull() & F.col("is_first").isNull()
    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "text", copy.alias("copy"), "starts").mapInArrow(_removed(n), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")


def levels(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """(doc_id, longest): for each document with a repeated window of ``n`` words, the longest n * 2**k at which one repeats.

    Doubles until no candidate survives: a window of twice the length is a candidate where both its halves repeat.
    """
    stash = Stash(docs.sparkSession, "levels")
    rows = _keyed(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for i, text in enumerate(batch.column("text").to_pylist()):
                w = words.windows(words.word_hashes(text), n, base=1)
                if len(w):
                    yield pa.record_batch({"doc_id": ids.take(pa.array([i] * len(w))), "pos": np.arange(len(w), dtype=np.int32), "h": w.view(np.int64)})

    now = rows.where("doc_id is not null").mapInArrow(windows, f"doc_id {kind}, pos int, h long")
    size, best = n, None
    while True:
        twice = now.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h")
        kept = stash.keep(now.join(twice, "h"), f"level{size}")
        if kept.isEmpty():
            return best if best is not None else kept.select("doc_id", F.lit(n).alias("longest")).distinct()
        level = kept.select("doc_id").distinct().withColumn("longest", F.lit(size))
        best = level if best is None else best.unionByName(level).groupBy("doc_id").agg(F.max("longest").alias("longest"))
        ahead = kept.select("doc_id", (F.col("pos") - size).alias("pos"), F.col("h").alias("h_next"))
        now = kept.join(ahead, ["doc_id", "pos"]).select("doc_id", "pos", F.xxhash64("h", "h_next").alias("h"))
        size *= 2
