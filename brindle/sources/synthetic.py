"""Synthetic panels with known truth: each series is drawn in its own task from a seed of its own."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def levels(spark: SparkSession, series: int, first: str, last: str, seed: int, gap: float = 0.0015) -> DataFrame:
    """(series_id, date, level): one common factor, t-distributed noise, ragged starts and random gaps on business days."""
    days = pd.bdate_range(first, last)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i = int(key[0])
        common = np.random.default_rng(seed).standard_normal(len(days)) * 0.006
        rng = np.random.default_rng([seed, i + 1])
        noise = rng.standard_t(6, len(days)) * 0.008
        r = rng.uniform(0.5, 1.5) * common + noise
        level = 100 * np.cumprod(1 + r)
        at = (np.arange(len(days)) >= rng.integers(0, len(days) // 3)) & (rng.random(len(days)) >= gap)
        return pd.DataFrame({"series_id": f"X{i:04d}", "date": days[at].date, "level": level[at]})

    return spark.range(series).groupBy("id").applyInPandas(run, "series_id string, date date, level double")


def vintages(spark: SparkSession, series: int, months: int, seed: int, revised: float = 0.4) -> DataFrame:
    """(series_id, period_end, knowledge_date, value): monthly periods known after a lag, some revised a month later."""
    ends = pd.date_range("2001-01-31", periods=months, freq="ME")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i = int(key[0])
        rng = np.random.default_rng([seed, i])
        value, lag = np.cumsum(rng.standard_normal(months)), rng.integers(5, 40, months)
        one = pd.DataFrame({"series_id": f"V{i:04d}", "period_end": ends.date, "knowledge_date": (ends + pd.to_timedelta(lag, "D")).date, "value": value})
        again = rng.random(months) < revised
        two = one[again].assign(knowledge_date=(ends[again] + pd.to_timedelta(lag[again] + 30, "D")).date, value=value[again] + rng.normal(0, 0.1, again.sum()))
        return pd.concat([one, two])

    return spark.range(series).groupBy("id").applyInPandas(run, "series_id string, period_end date, knowledge_date date, value double")


def analytics(spark: SparkSession, series: int, first: str, last: str, seed: int) -> DataFrame:
    """(series_id, field, date, value): daily random walks of a spread, a yield and a duration, each kept above a floor."""
    days = pd.bdate_range(first, last)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        i = int(key[0])
        parts = []
        for j, (name, start, step, floor) in enumerate((("oas", 1.5, 0.03, 0.05), ("ytw", 4.0, 0.05, 0.0), ("oad", 5.0, 0.01, 0.1))):
            rng = np.random.default_rng([seed, i, j])
            walk = np.maximum(start * rng.uniform(0.5, 1.5) + np.cumsum(rng.standard_normal(len(days)) * step), floor)
            parts.append(pd.DataFrame({"series_id": f"X{i:04d}", "field": name, "date": days.date, "value": walk}))
        return pd.concat(parts)

    return spark.range(series).groupBy("id").applyInPandas(run, "series_id string, field string, date date, value double")


def benchmark(returns: DataFrame, legs: dict[str, float], base: float = 100.0) -> DataFrame:
    """(date, level): a benchmark of fixed leg weights, compounded from ``base`` over the dates on which all legs have a return."""
    w = F.create_map(*[F.lit(x) for leg in legs.items() for x in leg])
    days = returns.where(F.col("series_id").isin(list(legs)) & F.col("ret").isNotNull()).groupBy("date").agg(F.sum(w[F.col("series_id")] * F.col("ret")).alias("ret"), F.count("*").alias("n")).where(F.col("n") == len(legs))
    return days.select("date", (base * F.product(1 + F.col("ret")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))).alias("level"))  # one row a day


def planted_benchmark(net: DataFrame, ir: float, risk: float, seed: int, per_year: float = 52.0) -> DataFrame:
    """(date, net, active, bench): a benchmark that makes a path's (date, net) active return have exactly ``ir`` over ``risk`` a year.

    Noise by date hash is standardised with the moments of all dates, so the ratio holds exactly.
    """
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "date"), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    drawn = net.withColumn("e", F.sqrt(-2 * F.log(u(1))) * F.cos(2 * float(np.pi) * u(2)))
    one = drawn.agg(F.avg("e").alias("m"), F.stddev_samp("e").alias("s"))
    active = risk / float(np.sqrt(per_year)) * ((F.col("e") - F.col("m")) / F.col("s") + ir / float(np.sqrt(per_year)))
    return drawn.crossJoin(F.broadcast(one)).select("date", "net", active.alias("active")).withColumn("bench", F.col("net") - F.col("active"))  # one row of moments


def planted_scores(truth: DataFrame, ic: float, seed: int, decay: float = 0.9, by_column: bool = False) -> DataFrame:
    """Scores that correlate with a standardised truth (series_id, date, z) at ``ic``: the truth plus orthogonal AR(1) noise.

    Noise is drawn series by series; its part along the truth is taken out with sums over the whole panel, or, ``by_column``,
    over each series, which then has the correlation by itself; series without spread are left out.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        rng = np.random.default_rng([seed, abs(hash_of(str(key[0])))])
        e = rng.standard_normal(len(rows)) * np.sqrt(1 - decay**2)
        x = np.empty(len(rows))
        x[0] = rng.standard_normal()
        for t in range(1, len(rows)):
            x[t] = decay * x[t - 1] + e[t]
        return rows.assign(noise=x)[["series_id", "date", "z", "noise"]]

    drawn = truth.groupBy("series_id").applyInPandas(run, "series_id string, date date, z double, noise double")
    if by_column:
        w = Window.partitionBy("series_id")
        z, x = F.col("z") - F.avg("z").over(w), F.col("noise") - F.avg("noise").over(w)
        left = drawn.withColumn("zz", z).withColumn("xx", x).withColumn("left", F.col("xx") - F.try_divide(F.sum(F.col("xx") * F.col("zz")).over(w), F.sum(F.col("zz") * F.col("zz")).over(w)) * F.col("zz"))
        score = ic * F.try_divide("zz", F.stddev_pop("zz").over(w)) + float(np.sqrt(1 - ic**2)) * F.try_divide("left", F.stddev_pop("left").over(w))
        return left.select("series_id", "date", score.alias("score")).where("score is not null")
    one = drawn.agg(F.avg("z").alias("mz"), F.avg("noise").alias("mn"), F.covar_pop("z", "noise").alias("c"), F.var_pop("z").alias("v"))
    left = drawn.crossJoin(F.broadcast(one)).withColumn("left", F.col("noise") - F.col("mn") - F.col("c") / F.col("v") * (F.col("z") - F.col("mz")))  # one row of moments
    sd = left.agg(F.stddev_pop("left").alias("s"), F.stddev_pop("z").alias("sz"))
    return left.crossJoin(F.broadcast(sd)).select("series_id", "date", (ic * (F.col("z") - F.col("mz")) / F.col("sz") + float(np.sqrt(1 - ic**2)) * F.col("left") / F.col("s")).alias("score"))  # one row of moments


def hash_of(text: str) -> int:
    """A small number from a text, the same in every process."""
    import zlib

    return zlib.crc32(text.encode())


def simulated_maxima(spark: SparkSession, paths: int, years: int, weeks: int, seed: int) -> DataFrame:
    """(path, worst_bias, drawdown): per simulated path of weekly noise the largest yearly deviation and the deepest fall."""

    def run(batches):
        for p in batches:
            out = []
            for i in p["id"]:
                z = np.random.default_rng([seed, int(i)]).standard_normal((years, weeks))
                wealth = np.cumprod(1 + z.ravel() * 0.06 / np.sqrt(52))
                out.append((int(i), float(z.std(axis=1, ddof=1).max()), float((1 - wealth / np.maximum.accumulate(wealth)).max())))
            yield pd.DataFrame(out, columns=["path", "worst_bias", "drawdown"])

    return spark.range(paths).mapInPandas(run, "path long, worst_bias double, drawdown double")


def drawdown_paths(spark: SparkSession, paths: int, weeks: int, risk: float, seed: int) -> DataFrame:
    """(path, per_risk): the deepest fall of each simulated path of weekly active returns without drift, per unit of annual risk."""
    from ..functions.scalars import normal

    e = normal(seed, F.col("path").cast("string"), F.col("week").cast("string")) * (risk / float(np.sqrt(52)))
    steps = spark.range(paths).select(F.col("id").alias("path"), F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))).alias("week")).withColumn("e", e)
    w = Window.partitionBy("path").orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    wealth = steps.withColumn("wealth", F.product(1 + F.col("e")).over(w))
    return wealth.withColumn("fall", 1 - F.col("wealth") / F.max("wealth").over(w)).groupBy("path").agg((F.max("fall") / risk).alias("per_risk"))
