"""Statistics along time: rolling, expanding and forward windows over long tables, with full-window guards.

All windows of one operator share a partitioning and an order, so they cost one exchange and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import clip
from .panel import of_series


def trailing(n: int) -> WindowSpec:
    """The last n rows of a series, the current one included."""
    return of_series().rowsBetween(1 - n, 0)


def full(value: Column, x: Column, n: int, w: WindowSpec) -> Column:
    """A window value where all n rows of x are there."""
    return F.when(F.count(x).over(w) == n, value)


def active_returns(weekly: DataFrame, bench: DataFrame) -> DataFrame:
    return weekly.join(bench, "date").select("series_id", "date", (F.col("ret") - F.col("bench")).alias("active"))


def tracking_error(active: DataFrame, n: int = 156, per_year: int = 52) -> DataFrame:
    """Annualised sample deviation of each full trailing window."""
    w = trailing(n)
    return active.select("series_id", "date", full(F.stddev_samp("active").over(w) * F.sqrt(F.lit(per_year)), F.col("active"), n, w).alias("te"))


def drawdown(active: DataFrame) -> DataFrame:
    """Cumulative product and its fall from its running maximum; the maximum starts with the first product."""
    up_to = of_series().rowsBetween(Window.unboundedPreceding, 0)
    grown = active.select("series_id", "date", F.product(1 + F.col("active")).over(up_to).alias("wealth"))
    return grown.select("series_id", "date", "wealth", (F.col("wealth") / F.max("wealth").over(up_to) - 1).alias("drawdown"))


def risk_path(active: DataFrame, n: int = 156, per_year: int = 52) -> DataFrame:
    """``active`` (series_id, date, active) with ``te`` and ``drawdown`` of the same rows: one exchange and one sort for all windows."""
    w, up_to = trailing(n), of_series().rowsBetween(Window.unboundedPreceding, 0)
    grown = active.withColumn("te", full(F.stddev_samp("active").over(w) * F.sqrt(F.lit(per_year)), F.col("active"), n, w)).withColumn("_wealth", F.product(1 + F.col("active")).over(up_to))
    return grown.withColumn("drawdown", F.col("_wealth") / F.max("_wealth").over(up_to) - 1).drop("_wealth")


def information_ratio(x: Column, per_year: int = 52) -> Column:
    """Mean over deviation, annualised; null for fewer than two values or no spread."""
    sd = F.stddev_samp(x)
    return F.when((F.count(x) >= 2) & (sd >= 1e-12), F.avg(x) * per_year / (sd * F.sqrt(F.lit(per_year))))


def standardised(scores: DataFrame, burn_in: int = 52, cap: float = 3.0) -> DataFrame:
    """Expanding z-score including the current row, clipped; exactly 0 during burn-in, without spread, or without a score."""
    w = of_series().rowsBetween(Window.unboundedPreceding, 0)
    s = F.col("score")
    sd = F.stddev_samp(s).over(w)
    ok = (F.count(s).over(w) >= burn_in) & (sd > 0) & s.isNotNull()
    return scores.select("series_id", "date", F.when(ok, clip((s - F.avg(s).over(w)) / sd, -cap, cap)).otherwise(0.0).alias("z"))


def cross_sectional(z: DataFrame, scale: Column) -> DataFrame:
    """scale * (z - mean of the date's series); 0 for a single series or a missing z."""
    w = Window.partitionBy("date")
    view = F.when(F.count("z").over(w) > 1, scale * (F.col("z") - F.avg("z").over(w))).otherwise(0.0)
    return z.select("series_id", "date", F.coalesce(view, F.lit(0.0)).alias("view"))


def rolling_sigma(df: DataFrame, n: int, population: bool) -> DataFrame:
    """Deviation of each full trailing window of ``ret``, with divisor n (population) or n - 1."""
    w = trailing(n)
    sd = F.stddev_pop("ret") if population else F.stddev_samp("ret")
    return df.select("series_id", "date", full(sd.over(w), F.col("ret"), n, w).alias("sigma"))


def forward_active(df: DataFrame, k: int) -> DataFrame:
    """Compounded return of the next k rows less the benchmark's; null unless both windows are full. df: ret, bench."""
    w = of_series().rowsBetween(1, k)
    grown = lambda c: full(F.expm1(F.sum(F.log1p(c)).over(w)), F.col(c), k, w)
    return df.select("series_id", "date", (grown("ret") - grown("bench")).alias("fwd"))


def forward_sum(df: DataFrame, k: int) -> DataFrame:
    w = of_series().rowsBetween(1, k)
    return df.select("series_id", "date", full(F.sum("ret").over(w), F.col("ret"), k, w).alias("fwd"))


def rolling_sum(df: DataFrame, value: str, n: int) -> DataFrame:
    w = trailing(n)
    return df.select("series_id", "date", full(F.sum(value).over(w), F.col(value), n, w).alias("total"))


def prefilled_sum(df: DataFrame, value: str, n: int, fill: float) -> DataFrame:
    """Sum of the last n - 1 rows, each missing one counted as ``fill``."""
    w = of_series().rowsBetween(2 - n, 0)
    return df.select("series_id", "date", (F.coalesce(F.sum(value).over(w), F.lit(0.0)) + (n - 1 - F.count(value).over(w)) * fill).alias("total"))


def valid_windows(df: DataFrame, n: int, least: int) -> DataFrame:
    """Whether the (possibly shorter) trailing window holds ``least`` values."""
    c = F.count("ret").over(trailing(n))
    return df.select("series_id", "date", c.alias("n"), (c >= least).alias("ok"))


def robust_scale(df: DataFrame, n: int) -> DataFrame:
    """1.4826 times the median absolute deviation from the median of the trailing window, partial windows allowed."""
    w = trailing(n)
    held = df.select("series_id", "date", F.percentile("ret", F.lit(0.5)).over(w).alias("m"), F.collect_list("ret").over(w).alias("xs"))
    far = F.array_sort(F.transform("xs", lambda x: F.abs(x - F.col("m"))))
    k = F.size(far)
    mid = (F.get(far, ((k - 1) / 2).cast("int")) + F.get(far, (k / 2).cast("int"))) / 2
    return held.select("series_id", "date", (1.4826 * mid).alias("scale"))


def rolling_corr(df: DataFrame, a: str, b: str, n: int) -> DataFrame:
    w = trailing(n)
    both = F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), 1)
    return df.select("series_id", "date", full(F.corr(a, b).over(w), both, n, w).alias("corr"))


def ewma_weights(df: DataFrame, halflife: float) -> DataFrame:
    """0.5 ** (age / halflife), scaled to sum to one in each series; the newest row has age 0."""
    age = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("date"))) - 1
    raw = df.select("series_id", "date", F.pow(F.lit(0.5), age / halflife).alias("raw"))
    return raw.select("series_id", "date", (F.col("raw") / F.sum("raw").over(Window.partitionBy("series_id"))).alias("weight"))


def average_rank(value: Column, within: list[str]) -> Column:
    """Ranks with ties at their mean."""
    w = Window.partitionBy(*within)
    return F.rank().over(w.orderBy(value)) + (F.count("*").over(Window.partitionBy(*within, value)) - 1) / 2


def realised_ic(scores: DataFrame, least: int = 5) -> DataFrame:
    """Pooled Pearson, and the means over dates of within-date Pearson and rank correlation (dates of ``least`` pairs with spread)."""
    pairs = scores.where("score is not null and fwd is not null")
    ranked = pairs.select("date", "score", "fwd", average_rank(F.col("score"), ["date"]).alias("rs"), average_rank(F.col("fwd"), ["date"]).alias("rf"))
    spread = (F.stddev_pop("score") > 1e-12) & (F.stddev_pop("fwd") > 1e-12)
    daily = ranked.groupBy("date").agg(F.when((F.count("*") >= least) & spread, F.struct(F.corr("score", "fwd").alias("p"), F.corr("rs", "rf").alias("s"))).alias("c"))
    return pairs.agg(F.corr("score", "fwd").alias("pooled")).crossJoin(daily.agg(F.avg("c.p").alias("per_date"), F.avg("c.s").alias("rank_ic"), F.count("c").alias("dates")))  # one row each
