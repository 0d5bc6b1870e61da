"""Links between texts whose word shingles are alike, found through SimHash fingerprints of samples of the shingles.

A fingerprint of all shingles moves by about ten bits at a Jaccard similarity of 0.8, out of reach of any selective grid. So
each text also gets fingerprints of samples: for each of some seeded orders, its few smallest shingles. Two texts of
similarity J have the same sample with a probability of about J ** size, independently for each order, and with it the same
fingerprint: cells are the points of these fingerprints. Short texts, whose samples would be all they have, take smaller ones.

All pairs of a cell that are not linked through others yet are compared, by the exact similarity of the whole shingle sets:

1. Each text of a cell meets the cell's center, the text with the smallest hash of its identity. The order of identities is
   the same in all cells, so that centers recur and a text has few different ones. The orders are taken in ``BATCHES``, with
   components in between: what is connected already is not asked again.
2. A cell whose other texts are still in different components then goes, with its texts, to tasks that compare all that is
   not connected: first by parity sketches (bit i is the parity of the shingles in bucket i, so that sketches differ in no
   more bits than the sets in shingles, and a pair whose sketches differ in more than the similarity allows is out), then by
   the sets. A task holds two blocks of a cell, of bounded size; a large cell is more pairs of blocks.

So each pair of a cell is connected, ruled out or verified, whatever the cell's size; links found are a spanning forest, not
all pairs. Only cells that stay in many components cost more than their size, in sketches compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .graph import components
from .shared import Stash

SIMILAR = 0.8
#: Orders and sample sizes; the share of pairs at a similarity of 0.8 that meet in no cell is below 0.001 for long texts.
TABLES, SAMPLE = 32, 7
SHORT_TABLES, SHORT_SAMPLE = 12, 2
#: Texts of this many shingles or more take the large samples; those of up to SHORT / SIMILAR take the small ones.
SHORT = 24
#: Every how many-th order is in the first batch; the others are in the second.
FIRST = 4
BATCHES = 2
#: Words of 64 bits of a parity sketch.
PARITY = 8
#: Shingles of a block of a cell, unless one text alone has more.
BLOCK = 1 << 19
#: Pairs of texts that a task holds at a time.
BATCH = 500
_RNG = np.random.default_rng(20240301)
_TURN, _SPIN = (_RNG.integers(0, 1 << 63, (2, TABLES + SHORT_TABLES), dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def shingle_set(text: bytes | None, n: int) -> np.ndarray:
    """The distinct shingles of a text, as hashes, sorted. A-Z are lower-cased; fewer than ``n`` words are one shingle."""
    h = words.word_hashes((text or b"").lower())
    return np.unique(words.windows(h, min(n, len(h)))) if len(h) else h


def sampled(shingles: np.ndarray, tables: range, size: int) -> np.ndarray:
    """The fingerprint of each table's sample: bits set in over half of its hashes."""
    out, step = [], max(1, (1 << 18) // len(shingles))
    for i in range(tables.start, tables.stop, step):
        t = slice(i, min(i + step, tables.stop))
        order = (shingles[None, :] ^ _TURN[t, None]) * _SPIN[t, None]
        at = np.argpartition(order, size - 1, axis=1)[:, :size] if len(shingles) > size else np.tile(np.arange(len(shingles)), (len(order), 1))
        bits = np.unpackbits(np.ascontiguousarray(shingles[at]).view(np.uint8).reshape(*at.shape, 8), axis=2, bitorder="little")
        ones = bits.sum(axis=1, dtype=np.int32) * 2 > at.shape[1]
        out.append(np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel())
    return np.concatenate(out)


def sketch(shingles: np.ndarray, similar: float = SIMILAR) -> np.ndarray:
    """A text's fingerprints: of the small samples, of the large ones, or of both; none without shingles."""
    short = sampled(shingles, range(SHORT_TABLES), SHORT_SAMPLE) if 0 < len(shingles) <= SHORT / similar else shingles[:0]
    return np.concatenate([short, sampled(shingles, range(SHORT_TABLES, SHORT_TABLES + TABLES), SAMPLE)]) if len(shingles) >= SHORT else short


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def parity(shingles: np.ndarray) -> np.ndarray:
    """The parity sketch: bit i is set if an odd number of shingles falls to bucket i."""
    of = np.bincount(((shingles * _TURN[0]) >> np.uint64(40)).astype(np.int64) % (64 * PARITY), minlength=64 * PARITY)
    return np.packbits((of & 1).astype(bool), bitorder="little").view(np.uint64)


def forest(sets: list[np.ndarray], roots: np.ndarray, left: np.ndarray, right: np.ndarray, similar: float = SIMILAR) -> list[tuple[int, int]]:
    """Pairs of similar sets, one of ``left`` and one of ``right`` (booleans), that connect all such sets of different ``roots``."""
    size, marks, root = np.array([len(s) for s in sets]), np.stack([parity(s) for s in sets]), np.unique(roots, return_inverse=True)[1]
    out = []
    for i in np.flatnonzero(left):
        bits = np.bitwise_count(marks ^ marks[i]).sum(axis=1, dtype=np.int64)
        may = right & (root != root[i]) & (np.minimum(size, size[i]) >= np.maximum(size, size[i]) * similar - 1e-6)
        may &= bits <= (size + size[i]) * (1 - similar) / (1 + similar) + 1e-6
        for j in np.flatnonzero(may):
            if root[j] != root[i] and similarity(sets[i], sets[j]) >= similar:
                root[root == root[j]] = root[i]
                out.append((int(i), int(j)))
    return out


def _verify(n: int, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for i, (k, a, b) in enumerate(zip(batch.column("c"), batch.column("text_c"), batch.column("text_k"))):
                if last[0] != k.as_py():  # runs of pairs share a center
                    last = (k.as_py(), shingle_set(a.as_py(), n))
                if similarity(last[1], shingle_set(b.as_py(), n)) >= similar:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return run


def _compare(n: int, similar: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fp, i, j = rows["fp"].to_numpy(), rows["i"].iloc[0], rows["j"].iloc[0]
        own = rows["block"].to_numpy()
        got = forest([shingle_set(t, n) for t in rows["text"]], rows["root"].to_numpy(), own == i, own == j, similar)
        return pd.DataFrame({"a": [fp[x] for x, _ in got], "b": [fp[y] for _, y in got]}, dtype="int64")

    return run


def links(docs: DataFrame, rows: DataFrame, near: DataFrame, stash: Stash, n: int, similar: float = SIMILAR, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between fingerprints of texts of ``docs`` (doc_id, text) whose shingle sets have a similarity of ``similar`` or more.

    ``rows`` has doc_id, text_key, fp and sketch of each, ``near`` the edges known before. The result and ``near`` together
    connect all such texts that share a cell. Each different text takes part once; texts without words do not.
    """
    one = F.xxhash64("doc_id")
    each = rows.where("sketch.n > 0").groupBy(F.col("text_key").alias("k"), "fp").agg(F.min(one).alias("w"), F.first("sketch").alias("sketch"))
    cells = each.select("k", "fp", "w", F.col("sketch.n").alias("n"), F.size("sketch.cells").alias("cells"), F.posexplode("sketch.cells").alias("pos", "s"))
    cells = cells.select("k", "fp", "w", "n", F.when(F.col("cells") == TABLES, F.col("pos") + SHORT_TABLES).otherwise(F.col("pos")).alias("t"), "s")
    shared = stash.keep(cells.groupBy("t", "s").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("t", "s"), "shared")
    live = stash.keep(cells.join(shared, ["t", "s"]), "cells")
    want = live.groupBy("k", "w").agg(F.lit(1).alias("one")).select("k", "w")
    whole = docs.select(F.xxhash64("text").alias("k"), one.alias("w"), F.col("text").cast("binary").alias("text"))
    texts = stash.keep(whole.join(want, ["k", "w"]).groupBy("k").agg(F.first("text").alias("text")), "texts")
    center = F.struct(F.xxhash64(F.lit(1), "k").alias("h"), "k", "fp", "root")
    edges = near.select("a", "b")

    def rooted(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """The edges as stars, and live cells with their components (at first, each fingerprint is one)."""
        if turn == 0:
            return edges, live.withColumn("root", F.col("fp"))
        stars = stash.keep(components(edges, Stash(stash.spark, "alike")), f"roots{turn}")
        return stars.select(F.col("node").alias("a"), F.col("root").alias("b")), live.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))

    for turn in range(BATCHES):
        edges, placed = rooted(edges, turn)
        mine = placed.where((F.pmod(F.col("t"), F.lit(FIRST)) == 0) if turn == 0 else (F.pmod(F.col("t"), F.lit(FIRST)) > 0)).drop("w", "n")
        mine = stash.keep(mine, f"placed{turn}")
        met = mine.groupBy("t", "s").agg(F.min(center).alias("c"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
        met = stash.keep(met.select("t", "s", F.col("c.k").alias("c"), F.col("c.fp").alias("fp_c"), F.col("c.root").alias("root_c")), f"centers{turn}")
        pairs = mine.join(met, ["t", "s"]).where("root <> root_c").groupBy("c", "k").agg(F.first("fp_c").alias("a"), F.first("fp").alias("b"))
        asked = stash.keep(pairs, f"asked{turn}")
        told = asked.join(texts.withColumnRenamed("text", "text_k"), "k").join(texts.select(F.col("k").alias("c"), F.col("text").alias("text_c")), "c")
        true = stash.keep(told.select("c", "a", "b", "text_c", "text_k").mapInArrow(_verify(n, similar), "a long, b long"), f"true{turn}", BATCH)
        edges = edges.unionByName(true)

    edges, placed = rooted(edges, BATCHES)
    placed = stash.keep(placed.drop("w"), "placed")
    heads = placed.groupBy("t", "s").agg(F.min(F.struct(F.xxhash64(F.lit(1), "k").alias("h"), "k")).alias("c"))
    others = placed.join(stash.keep(heads.select("t", "s", F.col("c.k").alias("c")), "heads"), ["t", "s"]).where("k <> c").drop("c")
    open_cells = others.groupBy("t", "s").agg(F.sum(F.col("n") + 64).alias("weight"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    parts = stash.keep(open_cells.select("t", "s", F.ceil(F.col("weight") / block).cast("int").alias("parts")), "open")
    cut = others.join(parts, ["t", "s"]).withColumn("block", F.pmod(F.xxhash64(F.lit(2), "k"), F.col("parts")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    dealt = stash.keep(dealt.select("t", "s", "i", "j", "block", "k", "fp", "root"), "dealt")
    held = dealt.join(texts, "k").groupBy("t", "s", "i", "j").applyInPandas(_compare(n, similar), "a long, b long")
    return edges.unionByName(stash.keep(held, "rest"))
