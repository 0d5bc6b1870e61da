"""Near-duplicates by SimHash: fingerprints of word shingles, linked through a segment-popcount embedding.

Method. The 64 bits are cut into 32 segments of two; a fingerprint maps to the vector of its segments' bit counts, written
in unary (counts 0, 1, 2 as 00, 01, 11), so the Manhattan distance of two vectors is ``bit_count(xor)`` and never exceeds the
fingerprints' own distance. The vector's coordinates are dealt to ``GROUPS`` groups. Vectors at distance k or less agree on
at least ``GROUPS - k`` groups, so a grid whose cells fix that many groups (one grid for each choice of groups) brings every
pair within reach together. In a cell the range condition on the vectors comes first, then the exact one on the fingerprints.

A cell of more than ``CELL`` fingerprints is not paired up: its fingerprints are linked through the points one bit away.
Two fingerprints at distance 2 or less share such a point, and a point has at most 65 fingerprints around it, so this is
exact and grows in proportion to the cell.

Two bits reach copies that are all but exact. ``classes(..., similar=0.8)``, which the pipeline's stage uses, also links texts
whose shingle sets are that similar, found through fingerprints of samples (``alike``) and verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import alike
from .graph import components
from .shared import Stash, packed

REACH = 2
GROUPS = 5
CELL = 24
#: Texts that a task holds at a time.
BATCH = 1000
SEED = 42
_CHUNK = 1 << 16
_LOW = 0x5555555555555555


def text_fingerprint(text: bytes | None, shingle: int = 3, seed: int = SEED) -> int:
    """The fingerprint of one text as an unsigned number. A-Z are lower-cased; null and wordless texts give zero."""
    norm = b" ".join((text or b"").lower().split())
    if not norm:
        return 0
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 0x20)
    n = max(1, len(gaps) + 2 - shingle)
    digest = xxhash.xxh64_intdigest
    if n == 1 and len(gaps) + 1 <= shingle:
        return digest(norm, seed)
    starts, ends = [0, *(gaps[: n - 1] + 1).tolist()], [*gaps[shingle - 1 :].tolist(), len(norm)]
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        h = np.fromiter((digest(norm[a:b], seed) for a, b in zip(starts[i : i + _CHUNK], ends[i : i + _CHUNK])), np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of a text column as a (signed) long."""

    @F.pandas_udf(LongType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([text_fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    return of(text.cast("binary"))


def marks(text: Column, shingle: int, similar: float) -> Column:
    """(fp, n: number of distinct shingles, cells: fingerprints of samples of them) of a text column."""

    @F.pandas_udf("fp long, n int, cells array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            fp, n, cells = [], [], []
            for t in texts:
                own = alike.shingle_set(t, shingle)
                fp.append(text_fingerprint(t, shingle))
                n.append(len(own))
                cells.append(alike.sketch(own, similar).view(np.int64))
            yield pd.DataFrame({"fp": np.array(fp, np.uint64).view(np.int64), "n": np.array(n, np.int32), "cells": pd.Series(cells, dtype=object)})

    return of(text.cast("binary"))


def embed(fp: Column) -> Column:
    """The vector of two-bit segments' counts, in unary."""
    low, high = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW))
    return low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grids(reach: int = REACH, groups: int = GROUPS) -> list[int]:
    """A mask for each choice of groups that a cell fixes."""
    own = [sum(3 << (2 * s) for s in range(32) if s * groups // 32 == g) for g in range(groups)]
    return [_signed(sum(own[g] for g in kept)) for kept in combinations(range(groups), groups - reach)]


def links(fps: DataFrame, reach: int = REACH, groups: int = GROUPS, cell: int = CELL) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints of ``fps`` (fp, e: its embedding) that connect all those within ``reach`` bits."""
    assert reach == 2, "crowded cells are linked through points one bit away, which is exact for a reach of 2"
    cells = fps.select("fp", "e", F.posexplode(F.array(*[F.col("e").bitwiseAND(F.lit(m)) for m in grids(reach, groups)])).alias("grid", "at"))
    sizes = cells.groupBy("grid", "at").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    near = lambda x, y: F.bit_count(x.bitwiseXOR(y)) <= reach
    of_two = sizes.where("n = 2").where(near(embed(F.col("a")), embed(F.col("b")))).where(near(F.col("a"), F.col("b"))).select("a", "b")
    some = cells.join(sizes.where(F.col("n").between(3, cell)).select("grid", "at"), ["grid", "at"])
    x, y = (some.select("grid", "at", F.col("fp").alias(k), F.col("e").alias(f"e{k}")) for k in "ab")
    paired = x.join(y, ["grid", "at"]).where((F.col("a") < F.col("b")) & near(F.col("ea"), F.col("eb")) & near(F.col("a"), F.col("b"))).select("a", "b")
    crowded = cells.join(sizes.where(F.col("n") > cell).select("grid", "at"), ["grid", "at"], "left_semi").select("fp").distinct()
    one_off = crowded.select("fp", F.explode(F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)])).alias("point"))
    round_point = one_off.groupBy("point").agg(F.collect_set("fp").alias("near")).where(F.size("near") > 1)
    through = round_point.select(F.array_min("near").alias("a"), F.explode("near").alias("b")).where("a <> b")
    return of_two.unionByName(paired).unionByName(through).distinct()


def classes(docs: DataFrame, shingle: int = 3, similar: float | None = None) -> DataFrame:
    """(doc_id, text_key, fp, component_id, keeper): a row for each row of ``docs`` (doc_id, text; others are ignored).

    ``component_id`` is the smallest doc_id reachable over links of two bits or fewer, null if the class has none;
    ``keeper`` is the (doc_id, text_key) that stands for the class: smallest doc_id, nulls last, then smallest text hash.
    With ``similar``, texts whose shingle sets have that Jaccard similarity or more are linked too.
    Null and wordless texts share fingerprint zero and so link. Repeated rows are classed alike. An empty table gives none.
    Texts of any length are read whole.
    """
    stash = Stash(docs.sparkSession, "simhash")
    if similar is None:
        made = docs.select("doc_id", F.xxhash64("text").alias("text_key"), fingerprint(F.col("text"), shingle).alias("fp"))
    else:
        made = docs.select("doc_id", F.xxhash64("text").alias("text_key"), marks(F.col("text"), shingle, similar).alias("m"))
        made = made.select("doc_id", "text_key", "m.fp", F.struct("m.n", "m.cells").alias("sketch"))
    rows = stash.keep(made, "rows", BATCH)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("text_key").alias("text_key")))
    each = stash.keep(rows.groupBy("fp").agg(first.alias("first")), "fps")
    edges = links(each.select("fp", embed(F.col("fp")).alias("e")))
    if similar is not None:
        edges = alike.links(docs, rows, stash.keep(edges, "near"), stash, shingle, similar)
    edges = stash.keep(edges, "links")
    rooted = stash.keep(components(edges, stash), "rooted")
    grouped = stash.keep(each.join(rooted.withColumnRenamed("node", "fp"), "fp"), "grouped")
    least = stash.keep(grouped.groupBy("root").agg(F.min("first").alias("keeper")), "keepers")
    of_fp = stash.keep(grouped.join(least, "root").select("fp", "keeper"), "classes")  # both sides are tables: a hot root's join can be split
    placed = rows.join(each, "fp").join(of_fp, "fp", "left").withColumn("keeper", F.coalesce("keeper", "first"))
    return placed.select("doc_id", "text_key", "fp", F.col("keeper.doc_id").alias("component_id"), F.struct("keeper.doc_id", "keeper.text_key").alias("keeper"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, similar: float = alike.SIMILAR) -> DataFrame:
    """The documents that stand for their class, one row each, with all their columns.

    ``shingle`` is five words and ``similar`` 0.8 by default. Rows that repeat both doc_id and text count as copies of one another.
    """
    made = classes(docs, shingle, similar)
    keep = made.where(F.col("doc_id").eqNullSafe(F.col("keeper.doc_id")) & (F.col("text_key") == F.col("keeper.text_key"))).select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).distinct()
    rows = packed(docs, F.col("doc_id"), F.xxhash64("text").alias("text_key"))
    kept = rows.join(keep, rows["doc_id"].eqNullSafe(keep["_id"]) & (rows["text_key"] == keep["_key"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "text_key"]).select("row.*")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
