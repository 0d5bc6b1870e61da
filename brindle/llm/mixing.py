"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

Each source has a target share of the mixture; its rate is the mean number of copies of a document that gives that share.
A document's count is the inverse of the Poisson distribution with that mean at a number in [0, 1) hashed from the seed and
its id, so counts are independent of layout, order and the other rows, and the expected mixture has the target weights.
Copies are then put in an order hashed from seed, id and copy: a global shuffle as one range exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Stash, join_small, let, packed, unit

#: Means beyond this are split into equal parts whose counts add up, so that exp(-mean) keeps full precision.
PART = 256.0


def cumulative(mean: Column) -> Column:
    """P(N <= k) for k = 0, 1, ... until the rest is below what a 52-bit number can tell from one."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30)
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1).cast("bigint"), last), start, step)["cdf"]


def rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, total: float | None = None) -> DataFrame:
    """(source, units, weight, rate, parts, cdf) for each source of ``docs`` (source, text); null is a source like any other.

    ``units`` is the source's characters over all documents. ``weights`` gives target shares by source (others get 0; shares
    are scaled to sum to one over the sources there); without it a share is proportional to units ** ``power``. ``total`` is
    the mixture's size in characters, by default that of ``docs``. A source without text has rate 0.
    """
    units = docs.groupBy("source").agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("units"))
    if weights is None:
        raw = F.pow("units", F.lit(power))
    else:
        raw = F.lit(0.0)
        for name, w in weights.items():
            raw = F.when(F.col("source") == name, F.lit(float(w))).otherwise(raw)
    units = units.withColumn("raw", F.when(F.col("units") > 0, raw).otherwise(0.0))
    sums = units.agg(F.sum("raw").alias("of"), F.sum("units").alias("all"))
    each = units.crossJoin(F.broadcast(sums))  # one row of totals
    share = F.try_divide("raw", "of")
    size = F.col("all") if total is None else F.lit(float(total))
    rate = F.when(F.col("units") > 0, F.coalesce(size * share / F.col("units"), F.lit(0.0))).otherwise(0.0)
    out = each.select("source", "units", F.coalesce(share, F.lit(0.0)).alias("weight"), rate.alias("rate")).withColumn("parts", F.greatest(F.ceil(F.col("rate") / PART), F.lit(1)).cast("int"))
    return out.withColumn("cdf", cumulative(F.col("rate") / F.col("parts")))


def identity(doc_id: Column, text: Column) -> Column:
    """What stands for a row in hashes: its doc_id, or its text's digest where that is null."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))


def poisson(cdf: Column, parts: Column, seed: int, who: Column) -> Column:
    """The count: over the parts, how many values of the cumulative distribution are at or below the hashed number."""

    def part(i: Column) -> Column:
        return let(unit(F.lit("count"), F.lit(seed), who, i.cast("string")), lambda u: F.size(F.filter(cdf, lambda c: c <= u)))

    return F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda acc, i: acc + part(i))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, total: float | None = None, seed: int = 7) -> DataFrame:
    """``docs`` replicated to the target weights and globally shuffled, with ``copy`` (from 1) and ``shuffle_key`` added.

    Columns that already bear those two names are replaced. Rows with equal doc_id get equal counts; rows without one count
    by their text. Rows with null or empty text belong to their source and are repeated like its others. An empty table
    gives an empty one. Texts of any length count whole towards their source and are copied whole.
    """
    table = Stash(docs.sparkSession, "mixing").keep(rates(docs, weights, power, total).select(F.col("source").alias("_source"), "cdf", "parts"), "rates")
    rows = packed(docs, F.col("source"), identity(F.col("doc_id"), F.col("text")).alias("who"))
    counted = join_small(rows, table, "_source", by="source").select("row", "who", poisson(F.col("cdf"), F.col("parts"), seed, F.col("who")).alias("n"))
    copies = counted.where("n > 0").select("row", "who", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    key = (unit(F.lit("order"), F.lit(seed), F.col("who"), F.col("copy").cast("string")) * F.lit(float(2**52))).cast("bigint")
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("copy", "shuffle_key")]
    # Keys are uniform by making, so a key's range, and with it its partition, follows from the key: no pass to sample bounds.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = copies.withColumn("shuffle_key", key).repartitionById(n, F.floor(F.col("shuffle_key") / F.lit(float(2**52)) * n).cast("int"))
    return dealt.sortWithinPartitions("shuffle_key", "who", "copy").select(*kept, "copy", "shuffle_key")
