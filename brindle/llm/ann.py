"""Nearest neighbours by randomly rotated one-bit codes.

Index. Every vector is taken relative to the nearest of a few centroids, rotated by a seeded random orthogonal matrix and
kept as one sign bit a dimension, with two correction scalars: its distance to the centroid and the inner product of its
direction with its code. A query's inner product with a vector is estimated from the packed bits and these scalars; the
estimate's error is bounded by EPSILON * sqrt((1 - c**2) / c**2 / (D - 1)), c the second scalar, except with a probability
that falls off like exp(-EPSILON**2 / 2).

Search. Rows are dealt to blocks of bounded size, queries too, and each pair of blocks meets in one task. There a
query's most promising rows by estimate are measured; vectors whose lower bound does not exceed the k-th of these distances
are reranked by exact distance in double precision. The k best of each block are merged. No bucket is capped or skipped.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stash, hash_sample

K = 10
#: Standard errors in an estimate's bound.
EPSILON = 3.0
#: Rows measured first to get a limit, or twice k if that is more.
FIRST = 32
#: Rows and queries of a block. Each row is sent once for each block of queries, each query once for each block of rows: with
#: equal blocks the two are balanced, and N rows with N / 100 queries send 2 * N * N / 100 / 16384 vectors.
BLOCK_ROWS = 16384
BLOCK_QUERIES = 16384
#: The most vectors that the centroids are fitted on, and how many centroids.
SAMPLE_ROWS = 4096
CENTROIDS = 16


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """Rows (id, v: array of floats as they are, or of doubles) that take part, and their dimension.

    Null ids and vectors, vectors that are zero or hold null or non-finite numbers, and vectors of another length than the
    most frequent one (the larger, if tied) are left out.
    """
    kind = vectors.schema[vector_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(kind if kind == "array<float>" else "array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).first()
    dim = size["n"] if size else 0
    return rows.where(F.size("v") == dim), dim


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(sample: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """k-means on a sample; fewer centroids if it holds fewer distinct vectors."""
    distinct = np.unique(sample, axis=0)
    at = distinct[np.random.default_rng(seed).permutation(len(distinct))[: max(1, min(k, len(distinct)))]]
    for _ in range(rounds):
        own = nearest(sample, at)
        at = np.array([sample[own == i].mean(axis=0) if (own == i).any() else at[i] for i in range(len(at))])
    return at


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(axis=1)[None, :] - 2 * x @ centers.T).argmin(axis=1)


@dataclass
class Codes:
    """What estimates need: packed bits, the centroid, the distance to it, and the code's inner product with the direction."""

    bits: np.ndarray
    own: np.ndarray
    norm: np.ndarray
    inner: np.ndarray


def encode(x: np.ndarray, centers: np.ndarray, turn: np.ndarray) -> Codes:
    own = nearest(x, centers)
    left = x - centers[own]
    norm = np.sqrt((left**2).sum(axis=1))
    o = (left / np.where(norm > 0, norm, 1)[:, None]) @ turn
    inner = np.abs(o).sum(axis=1) / math.sqrt(x.shape[1])
    return Codes(np.packbits(o > 0, axis=1), own.astype(np.int32), norm, np.where(norm > 0, inner, 1.0))


def bounds(codes: Codes, queries: np.ndarray, centers: np.ndarray, turn: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimates and lower bounds of the squared distances, queries by rows."""
    dim = queries.shape[1]
    signs = (np.unpackbits(codes.bits, axis=1, count=dim).astype(np.float32) * 2 - 1) / np.float32(math.sqrt(dim))
    middle, lower = np.empty((len(queries), len(codes.own))), np.empty((len(queries), len(codes.own)))
    spread = epsilon * np.sqrt(np.maximum(1 - codes.inner**2, 0) / codes.inner**2 / max(dim - 1, 1))
    for c in np.unique(codes.own):
        at = np.flatnonzero(codes.own == c)
        left = queries - centers[c]
        qn = np.sqrt((left**2).sum(axis=1))
        q = ((left / np.where(qn > 0, qn, 1)[:, None]) @ turn).astype(np.float32)
        estimate = (q @ signs[at].T).astype(float) / codes.inner[at]
        base = qn[:, None] ** 2 + codes.norm[at] ** 2
        both = 2 * qn[:, None] * codes.norm[at]
        slack = 1e-6 * (base + both) + 1e-12  # single precision in the estimate
        middle[:, at] = base - both * estimate
        lower[:, at] = base - both * np.minimum(estimate + spread[at], 1) - slack
    return middle, lower


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, in some order of summation."""
    left = a - b
    return np.einsum("ij,ij->i", left, left)


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, summed dimension by dimension in order."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += (a[:, j] - b[:, j]) ** 2
    return np.sqrt(total)


def best(ids: np.ndarray, x: np.ndarray, codes: Codes, query_ids: np.ndarray, queries: np.ndarray, centers: np.ndarray, turn: np.ndarray, k: int, epsilon: float) -> pd.DataFrame:
    """The k nearest rows of a block for each query of a block: (query_id, vec_id, score).

    The rows with the smallest estimates are measured first; their k-th distance is the limit that the others' lower bounds
    are held against.
    """
    out = []
    step = max(1, (1 << 20) // max(len(ids), 1))
    first = max(FIRST, 2 * k)
    for i in range(0, len(queries), step):
        qi, q = query_ids[i : i + step], queries[i : i + step]
        middle, lower = bounds(codes, q, centers, turn, epsilon)
        self = qi[:, None] == ids[None, :]
        middle[self] = lower[self] = np.inf
        limit = np.full(len(q), np.inf)
        if len(ids) > first:
            front = np.argpartition(middle, first - 1, axis=1)[:, :first]
            d = squared(np.repeat(q, first, axis=0), x[front.ravel()]).reshape(len(q), first)
            d[np.take_along_axis(self, front, axis=1)] = np.inf
            limit = np.partition(d, k - 1, axis=1)[:, k - 1] * (1 + 1e-9)
        a, b = np.nonzero((lower <= limit[:, None]) & ~self)
        for j in range(0, len(a), 1 << 16):
            s = slice(j, j + (1 << 16))
            near = squared(q[a[s]], x[b[s]]) <= limit[a[s]]
            pa, pb = a[s][near], b[s][near]
            out.append(pd.DataFrame({"query_id": qi[pa], "vec_id": ids[pb], "score": exact(q[pa], x[pb])}))
    if not out:
        return pd.DataFrame({"query_id": query_ids[:0], "vec_id": ids[:0], "score": np.zeros(0)})
    found = pd.concat(out)
    found = found.iloc[np.lexsort((found["vec_id"], found["score"], found["query_id"]))]
    return found.groupby("query_id", sort=False).head(k)


def _distinct(ids: np.ndarray, *arrays: np.ndarray) -> list[np.ndarray]:
    """One row for each id: the smallest vector, in order of components, where an id repeats."""
    order = np.lexsort((*arrays[0].T[::-1], ids))
    ids = ids[order]
    first = np.ones(len(ids), bool)
    first[1:] = ids[1:] != ids[:-1]
    return [ids[first], *(a[order][first] for a in arrays)]


def build(rows: DataFrame, dim: int, stash: Stash, seed: int = 3) -> tuple[DataFrame, np.ndarray, int]:
    """The index of every row (id, v, block, bits, own, norm, inner), written to the shared folder; centroids; number of blocks."""
    sample = hash_sample(rows, "id", SAMPLE_ROWS, seed).toArrow().column("v")
    centers = centroids(np.array(sample.to_pylist(), float).reshape(-1, dim), CENTROIDS, seed)
    blocks = max(1, math.ceil(rows.count() / BLOCK_ROWS))

    def run(batches):
        turn = rotation(dim, seed)
        for p in batches:
            codes = encode(np.stack(p["v"].to_numpy()).astype(float), centers, turn)
            yield p.assign(bits=[b.tobytes() for b in codes.bits], own=codes.own, norm=codes.norm, inner=codes.inner)

    kind = rows.schema["id"].dataType.simpleString()
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    made = dealt.mapInPandas(run, f"id {kind}, v {rows.schema['v'].dataType.simpleString()}, block int, bits binary, own int, norm double, inner double")
    return stash.keep(made, "index"), centers, blocks


def search(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = K, epsilon: float = EPSILON, seed: int = 3) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows of each row whose id is divisible by ``every``.

    Nearness is Euclidean distance, ties go to the smaller id. Where an id repeats, its smallest vector counts. Fewer
    candidates than k are all returned; an empty table gives none. Rows are dealt to blocks by hash of their id, so a table
    that repeats one id in very many rows puts those in one block; other columns are not read.
    """
    rows, dim = usable(vectors, id_col, vector_col)
    kind = rows.schema["id"].dataType.simpleString()
    result = f"query_id {kind}, vec_id {kind}, score double"
    if not dim:
        return vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    index, centers, blocks = build(rows, dim, Stash(vectors.sparkSession, "ann"), seed)
    asked = index.where(F.col("id") % every == 0).select("id", "v")
    query_blocks = max(1, math.ceil(asked.count() / BLOCK_QUERIES))
    asked = asked.withColumn("asked", F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(query_blocks)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = index.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))

    def pair(queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(own):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        turn = rotation(dim, seed)
        qi, q = _distinct(queries["id"].to_numpy(), np.stack(queries["v"].to_numpy()).astype(float))
        x = np.stack(own["v"].to_numpy()).astype(float)
        bits = np.frombuffer(b"".join(own["bits"]), np.uint8).reshape(len(own), -1)
        ids, x, bits, c, norm, inner = _distinct(own["id"].to_numpy(), x, bits, own["own"].to_numpy(), own["norm"].to_numpy(), own["inner"].to_numpy())
        return best(ids, x, Codes(bits, c, norm, inner), qi, q, centers, turn, k, epsilon)

    near = asked.groupBy("block", "asked").cogroup(held.groupBy("block", "asked")).applyInPandas(pair, result)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
