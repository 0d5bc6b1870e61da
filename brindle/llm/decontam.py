"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

A short item inside a long document has a tiny Jaccard similarity, so documents are not sketched; items are. Those of about
the same number of shingles form a partition, and each keeps the bottom-k MinHash of its shingles, k by its partition. If a
share t of an item's n shingles occurs in a document, at most n - ceil(t n) are missing, in the sketch as elsewhere: k is that
number for the partition's largest size and ``MORE`` besides, and an item is a candidate where no more of its sketch is missing.

Search. The sketches are held by the tasks in blocks of a bounded number of hashes, one pass over the documents a block; the
windows of a text probe each partition of the block. Candidate documents are written to the shared folder. Only they meet the
texts of their candidate items, in a join, and the item's distinct shingles are counted in the document word for word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .shared import Stash, fits, packed

SHINGLE = 5
CONTAINED = 0.8
#: Hashes of a sketch beyond those that may be missing: the fewest that a candidate has.
MORE = 4
#: The most sketch hashes of a block, unless one item alone has more.
BLOCK_HASHES = 1_000_000
_BITS = 20


def normal(text: str | None) -> bytes:
    """Lower-cased, in UTF-8; words then end at white space and ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "surrogatepass")


def missing(n: int, contained: float = CONTAINED) -> int:
    """The most shingles of ``n`` that a document may lack."""
    return n - math.ceil(contained * n)


def partition(n: int) -> int:
    """The size partition of an item of ``n`` shingles: by powers of two."""
    return int(n).bit_length()


def sketch_size(n: int, contained: float = CONTAINED) -> int:
    """The k of an item of ``n`` shingles: what the largest size of its partition may lack, and ``MORE``."""
    return min(n, missing((1 << partition(n)) - 1, contained) + MORE)


@dataclass
class Part:
    """A size partition's sketches: sorted hashes of shingles of ``length`` words, and the item each belongs to."""

    length: int
    hashes: np.ndarray
    items: np.ndarray


@dataclass
class Block:
    """Sketches of a block by size partition, the hashes that an item needs at least, and a table of hash prefixes by length."""

    parts: list[Part]
    need: np.ndarray
    tables: dict[int, np.ndarray]


def hashes(text: bytes, n: int) -> tuple[np.ndarray, int]:
    """The distinct shingle hashes of a text and its shingles' length; a text of fewer than ``n`` words has one, of all of them."""
    h = words.located(text, words.PUNCTUATION)[0]
    n = min(n, len(h))
    return (np.unique(words.windows(h, n)) if n else h), n


def block(rows: list[tuple[int, int, np.ndarray]], contained: float = CONTAINED) -> Block:
    """A block of items (number of shingles, length of a shingle, sketch)."""
    by: dict[tuple[int, int], list[int]] = {}
    for i, (n, length, _) in enumerate(rows):
        by.setdefault((partition(n), length), []).append(i)
    parts, tables = [], {}
    for (_, length), own in sorted(by.items()):
        flat = np.concatenate([rows[i][2] for i in own])
        order = np.argsort(flat, kind="stable")
        parts.append(Part(length, flat[order], np.repeat(own, [len(rows[i][2]) for i in own])[order]))
        tables.setdefault(length, np.zeros(1 << _BITS, bool))[(flat >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return Block(parts, np.array([len(s) - missing(n, contained) for n, _, s in rows], np.int64), tables)


def probe(texts: list[bytes], b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, item) of the candidates: the items of which a text's windows meet enough of the sketch."""
    _, h, _, _, offsets = words.located_all(texts, words.PUNCTUATION)
    docs, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for length, table in b.tables.items():
        w = words.windows(h, length)
        at = np.flatnonzero(table[(w >> np.uint64(64 - _BITS)).astype(np.int64)] & words.whole(offsets, length)) if len(w) else np.zeros(0, np.int64)
        own = np.unique(np.stack([(np.searchsorted(offsets, at, "right") - 1).astype(np.uint64), w[at]]), axis=1) if len(at) else np.zeros((2, 0), np.uint64)
        for part in (p for p in b.parts if p.length == length):
            lo, hi = np.searchsorted(part.hashes, own[1], "left"), np.searchsorted(part.hashes, own[1], "right")
            met = np.flatnonzero(hi > lo)
            times = hi[met] - lo[met]
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            docs.append(np.repeat(own[0][met].astype(np.int64), times))
            items.append(part.items[np.repeat(lo[met], times) + step])
    both, count = np.unique(np.stack([np.concatenate(docs), np.concatenate(items)]), axis=1, return_counts=True)
    ok = count >= b.need[both[1]]
    return both[0][ok], both[1][ok]


def candidates(text: Column, held) -> Column:
    """Positions in a broadcast block of the items that a text column may contain."""

    @F.pandas_udf("array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list = []
            for _, run in words.grouped(normal(t) for t in texts):
                doc, item = probe(run, held.value)
                out += np.split(item.astype(np.int32), np.searchsorted(doc, np.arange(1, len(run))))
            yield pd.Series(out, dtype=object)

    return of(text)


@lru_cache(64)
def _shingles(text: bytes, n: int) -> tuple[int, dict[int, tuple[bytes, ...]]]:
    """The length of an item's shingles, and the distinct ones by hash."""
    h, s, e = words.located(text, words.PUNCTUATION)
    n = min(n, len(h))
    own = [text[a:b] for a, b in zip(s.tolist(), e.tolist())]
    return n, {int(x): tuple(own[i : i + n]) for i, x in enumerate(words.windows(h, n).tolist())} if n else {}


def shared(text: bytes, item: bytes, n: int = SHINGLE) -> int:
    """How many of an item's distinct shingles a text has, compared word for word."""
    length, want = _shingles(item, n)
    if not length:
        return 0
    h, s, e = words.located(text, words.PUNCTUATION)
    w = words.windows(h, length)
    found = set()
    for i in np.flatnonzero(np.isin(w, np.fromiter(want, np.uint64, len(want)))).tolist():
        if all(text[x:y] == z for x, y, z in zip(s[i : i + length].tolist(), e[i : i + length].tolist(), want[int(w[i])])):
            found.add(int(w[i]))
    return len(found)


def _counted(text: Column, item: Column, n: int) -> Column:
    @F.pandas_udf("int")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, items in batches:
            yield pd.Series([shared(normal(t), normal(i), n) for t, i in zip(texts, items)], dtype="int32")

    return of(text, item)


def sketched(items: DataFrame, n: int, contained: float) -> DataFrame:
    """(item_key, item_id, item_text, shingles, length, sketch) of each different item with a word."""

    @F.pandas_udf("shingles int, length int, sketch array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            made = [hashes(normal(t), n) for t in texts]
            small = [h[: sketch_size(len(h), contained)].view(np.int64) for h, _ in made]  # hashes are sorted: the smallest come first
            yield pd.DataFrame({"shingles": np.array([len(h) for h, _ in made], np.int32), "length": np.array([x for _, x in made], np.int32), "sketch": pd.Series(small, dtype=object)})

    one = items.select("item_id", F.col("text").alias("item_text")).distinct()
    made = one.select(F.xxhash64(F.col("item_id").cast("string"), "item_text").alias("item_key"), "item_id", "item_text", of(F.col("item_text")).alias("s"))
    return made.select("item_key", "item_id", "item_text", "s.*").where("shingles > 0")


def verified(docs: DataFrame, items: DataFrame, n: int = SHINGLE, contained: float = CONTAINED) -> DataFrame:
    """(row, text, item_id, shared, shingles) for each row of ``docs`` (row, text) and each item at ``contained`` or more."""
    spark, stash = docs.sparkSession, Stash(docs.sparkSession, "decontam")
    items = stash.keep(sketched(items, n, contained), "items")
    total = items.agg(F.sum(F.size("sketch"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_HASHES))
    found = None
    for i in range(blocks):
        own = items.where(F.pmod(F.xxhash64(F.lit(1), "item_key"), F.lit(blocks)) == i).select("item_key", "shingles", "length", "sketch").orderBy("item_key")
        got = own.toArrow()  # bounded by BLOCK_HASHES
        keys = got.column("item_key").to_numpy()
        rows = [(a, b, np.asarray(s.values.to_numpy(zero_copy_only=False)).view(np.uint64)) for a, b, s in zip(got.column("shingles").to_pylist(), got.column("length").to_pylist(), got.column("sketch"))]
        held = spark.sparkContext.broadcast(block(rows, contained))
        named = spark.createDataFrame(pd.DataFrame({"at": np.arange(len(keys), dtype=np.int32), "item_key": keys.astype(np.int64)}), "at int, item_key long")
        may = docs.select("row", "text", candidates(F.col("text"), held).alias("found")).where(F.size("found") > 0)
        may = may.select("row", "text", F.explode("found").alias("at")).join(named, "at").drop("at")
        may = stash.keep(may, f"candidates{i}")  # one pass a block; the block is let go before the next
        held.destroy()
        found = may if found is None else found.unionByName(may)
    told = found.join(items.select("item_key", "item_id", "item_text", "shingles"), "item_key")
    told = told.select("row", "text", "item_id", "shingles", _counted(F.col("text"), F.col("item_text"), n).alias("shared"))
    return told.where(F.col("shared") >= F.ceil(F.lit(contained) * F.col("shingles") - 1e-9))


def contaminations(docs: DataFrame, items: DataFrame, n: int = SHINGLE, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of each document and item at ``contained`` or more.

    Null and wordless texts and items take no part. Repeated rows of ``docs`` give repeated results, repeated items do not.
    Texts of any length are read whole; other columns are ignored. Empty tables give none.
    """
    found = verified(docs.select(F.struct("doc_id").alias("row"), "text"), items, n, contained)
    return found.select("row.doc_id", "item_id", "shared", F.col("shingles").alias("item_shingles"), (F.col("shared") / F.col("shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, n: int = SHINGLE, contained: float = CONTAINED) -> DataFrame:
    """``docs`` without the documents that contain an item; all columns stay, whatever their names. Null texts are kept.

    What a text contains does not depend on its row: the texts that go are named by their hashes, and rows are held against these.
    """
    key = F.sha2(F.col("text"), 256)
    found = verified(docs.select(F.lit(0).alias("row"), "text"), items, n, contained)
    bad = Stash(docs.sparkSession, "decontam").keep(found.select(key.alias("bad")).distinct(), "bad")
    rows = packed(docs, key.alias("key"))
    bad = F.broadcast(bad) if fits(bad) else bad
    return rows.join(bad, F.col("key") == F.col("bad"), "left_anti").select("row.*")
