"""Importance resampling towards a target distribution over hashed word runs, with DataFrame functions only.

Both corpora are counts over a fixed number of buckets, into which runs of words are hashed. A bucket's gain is the log ratio
of its smoothed shares; a document's weight is the mean gain of its runs. Gumbel noise from a hash of the document's id turns
the largest scores into a draw without replacement in proportion to exp(weight / 1000).

Runs are exploded and hashed once and written as (row, bucket): both the counts and the sums read that narrow table. Counts are
aggregated before they are shuffled, the gain table has a fixed number of rows, a document's sum is partly formed in the task
that holds its runs. Ranks come from a range sort: the place within a partition plus the sizes of the partitions before it.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import Stash

#: Whatever is not a digit, a lower-case ASCII letter or beyond ASCII ends a word.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rows of a partition are numbered in the low bits of a monotonically increasing id.
_PLACE = (1 << 33) - 1


def words(text: Column) -> Column:
    """The words of a text, A-Z in lower case and no other letter changed; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, BREAK), "")


def runs(tokens: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` consecutive words, each joined by one space."""
    last, out = tokens, [tokens]
    for k in range(2, longest + 1):
        n = F.greatest(F.size(tokens) - (k - 1), F.lit(0))
        last = F.zip_with(F.slice(last, F.lit(1), n), F.slice(tokens, F.lit(k), n), lambda a, b: F.concat(a, F.lit(" "), b))
        out.append(last)
    return F.concat(*out)


def features(docs: DataFrame, longest: int, buckets: int, *keep: Column) -> DataFrame:
    """A row for each run of each text: what ``keep`` names, n_words, n_features, bucket (null in the one row of a text without words)."""
    split = docs.select(*keep, words(F.col("text")).alias("_words"))
    kept = [F.col(c) for c in split.columns[:-1]]
    made = split.select(*kept, F.size("_words").cast("bigint").alias("n_words"), runs(F.col("_words"), longest).alias("_runs"))
    each = made.select(*kept, "n_words", F.size("_runs").cast("bigint").alias("n_features"), F.explode_outer("_runs").alias("_run"))
    return each.select(*kept, "n_words", "n_features", F.pmod(F.crc32(F.col("_run").cast("binary")), F.lit(buckets)).cast("int").alias("bucket"))


def counts(features: DataFrame, name: str) -> DataFrame:
    return features.where(F.col("bucket").isNotNull()).groupBy("bucket").agg(F.count("*").alias(name))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket, from the counts (bucket, s) and (bucket, t): a table of ``buckets`` rows."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(F.broadcast(source), "bucket", "left").join(F.broadcast(target), "bucket", "left").fillna(0, ["s", "t"])
    totals = both.agg(F.sum("s").alias("_s"), F.sum("t").alias("_t"))
    d = lambda c, plus: F.col(c).cast("double") + F.lit(float(plus))
    ratio = d("t", 1) * d("_s", buckets) / (d("s", 1) * d("_t", buckets))
    return both.crossJoin(F.broadcast(totals)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))  # one row of totals


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a hash of the seed and the id (null: no characters)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("bigint")
    u = (h + F.lit(0.5)) / F.lit(float(1 << 32))
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def ranked(rows: DataFrame, order: list[Column], stash: Stash, rank: str = "rank") -> DataFrame:
    """``rows`` with the place of each in ``order``, from 1. ``order`` must tell all rows apart, so that no range is one hot key."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(_PLACE).alias("_at"))
    placed = stash.keep(placed, "sorted")
    sizes = placed.groupBy("_part").agg((F.max("_at") + 1).alias("n"))
    # One row a partition of the sort: as many rows as the session has shuffle partitions.
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_part").withColumn(rank, (F.col("_before") + F.col("_at") + 1).cast("bigint")).drop("_part", "_at", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) as (doc_id, n_features, weight, score, rank), all bigint.

    ``target`` (text) is the corpus to be resembled. Of the N rows with ``least_words`` words or more, the
    floor(percent * N / 100) highest scores are drawn, ties to the smaller doc_id, and ranked from 1; the others' rank is null.

    Null and empty texts have no features, weight 0 and no rank. Each of several rows with one doc_id is a row of its own with
    the same noise; rows equal in score and doc_id are ranked one after the other. A null doc_id hashes as no characters and
    comes last among ties. An empty ``docs`` gives no row, an empty ``target`` counts of zero. Texts are read whole, however
    long. Other columns, whatever their names, are neither read nor returned.
    """
    stash = Stash(docs.sparkSession, "resample")
    made = stash.keep(features(docs, longest, buckets, F.monotonically_increasing_id().alias("row"), F.col("doc_id")), "features")
    table = stash.keep(gains(counts(made, "s"), counts(features(target, longest, buckets), "t"), buckets), "gains")
    sums = made.join(F.broadcast(table), "bucket", "left").groupBy("row", "doc_id", "n_words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("sum"))
    n = F.greatest("n_features", F.lit(1))
    weight = ((F.col("sum") - F.pmod(F.col("sum"), n)) / n).cast("bigint")
    scored = sums.select("row", "doc_id", "n_words", "n_features", weight.alias("weight"), (weight + noise(F.col("doc_id"), seed)).alias("score"))
    scored = stash.keep(scored, "scored")
    stash.drop("features")
    able = F.col("n_words") >= least_words
    drawn = percent * scored.where(able).count() // 100
    places = ranked(scored.where(able), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")], stash)
    columns = ["doc_id", "n_features", "weight", "score"]
    inside = places.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    return inside.unionByName(scored.where(~able).select(*columns, F.lit(None).cast("bigint").alias("rank")))
