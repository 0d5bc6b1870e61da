"""How well stored loadings predict, how steady they are, and small report frames. Long tables in, long tables out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import huber
from .windows import average_rank


def predictions(loadings: DataFrame, panel: DataFrame, factors: list[str]) -> DataFrame:
    """(instrument, date, ret, p, contributions: map of factor to its part of p): last week's loadings times this week's factors.

    Only weeks on which all factors have a loading the week before, and a return.
    """
    long = panel.unpivot(["instrument", "date", "ret"], factors, "factor", "f")
    w = Window.partitionBy("instrument", "factor").orderBy("date")
    lagged = long.join(loadings.select("instrument", "date", "factor", "loading"), ["instrument", "date", "factor"], "left").withColumn("was", F.lag("loading").over(w))
    parts = F.map_from_entries(F.array_sort(F.collect_list(F.struct("factor", F.col("was") * F.col("f")))))
    per = lagged.where("was is not null and f is not null").groupBy("instrument", "date").agg(F.first("ret").alias("ret"), F.sum(F.col("was") * F.col("f")).alias("p"), F.count("*").alias("n"), parts.alias("contributions"))
    return per.where((F.col("n") == len(factors)) & F.col("ret").isNotNull()).drop("n")


def skill(scored: DataFrame, by: list[str], scale: Column | None = None) -> DataFrame:
    """Per group n, out-of-sample r2 and Huber skill against a loading of zero, and the correlation of p and ret; null where undefined."""
    s = F.lit(1.0) if scale is None else scale
    left, none = huber((F.col("ret") - F.col("p")) / s), huber(F.col("ret") / s)
    e = F.col("ret") - F.col("p")
    return scored.groupBy(*by).agg(F.count("*").alias("n"), (1 - F.try_divide(F.sum(e * e), F.sum(F.col("ret") * F.col("ret")))).alias("r2"), (1 - F.try_divide(F.sum(left), F.sum(none))).alias("huber_skill"), F.corr("p", "ret").alias("corr"))


def factor_shares(scored: DataFrame, by: list[str]) -> DataFrame:
    """Each factor's share of the predicted variation: sum of p times its part over the sum of p squared."""
    # The sum of p squared goes along as a part without a name, so what made ``scored`` runs once.
    whole = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.col("p").alias("value")))
    parts = F.concat(F.coalesce(F.map_entries("contributions"), F.slice(whole, 1, 0)), whole)
    sums = scored.select(*by, "p", F.inline(parts).alias("factor", "c")).groupBy(*by, "factor").agg(F.sum(F.col("p") * F.col("c")).alias("_num"))
    total = F.max(F.when(F.col("factor").isNull(), F.col("_num"))).over(Window.partitionBy(*by))  # a row a factor
    return sums.withColumn("_den", total).where("factor is not null").select(*by, "factor", F.try_divide("_num", "_den").alias("share"))


def rank_correlations(scored: DataFrame, least: int = 5) -> DataFrame:
    """(date, rho, n): per date the correlation over instruments of the average ranks of p and ret, with ``least`` of them."""
    ranked = scored.select("date", average_rank(F.col("p"), ["date"]).alias("a"), average_rank(F.col("ret"), ["date"]).alias("b"))
    return ranked.groupBy("date").agg(F.corr("a", "b").alias("rho"), F.count("*").alias("n")).where((F.col("n") >= least) & F.col("rho").isNotNull() & ~F.isnan("rho"))


def quartiles(x: str) -> list[Column]:
    """n, q1, median, q3 of a column; nulls do not count."""
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return [F.count(x).alias("n"), q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3")]


def stability(paths: DataFrame, first: str, lags: dict[str, int]) -> DataFrame:
    """(estimator, factor, label, change, ratio): mean absolute change of loadings over a lag of rows, and over that of ``first``.

    paths: estimator, instrument, date, factor, loading. Only cells (instrument, date) at which every estimator has every
    factor, now and a lag of rows of the instrument's own before.
    """
    full = paths.select("estimator").distinct().count() * paths.select("factor").distinct().count()  # a handful each
    common = paths.groupBy("instrument", "date").count().where(F.col("count") == full).select("instrument", "date")
    own = paths.join(common, ["instrument", "date"], "left_semi")
    w = Window.partitionBy("estimator", "instrument", "factor").orderBy("date")
    moved = own.select("estimator", "factor", *[F.abs(F.col("loading") - F.lag("loading", n).over(w)).alias(k) for k, n in lags.items()])
    long = moved.unpivot(["estimator", "factor"], list(lags), "label", "change").groupBy("estimator", "factor", "label").agg(F.avg("change").alias("change"))
    base = long.where(F.col("estimator") == first).select("factor", "label", F.col("change").alias("_base"))
    return long.join(base, ["factor", "label"]).select("estimator", "factor", "label", "change", F.try_divide("change", "_base").alias("ratio"))


def column_mean_corr(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The mean over series of each one's correlation over the dates both have, more than two of them, both with spread."""
    both = a.select("series_id", "date", *by, F.col("x")).join(b.select("series_id", "date", F.col("y")), ["series_id", "date"]).where("x is not null and y is not null")
    per = both.groupBy("series_id", *by).agg(F.corr("x", "y").alias("c"), F.count("*").alias("n"), F.stddev_samp("x").alias("sx"), F.stddev_samp("y").alias("sy")).where("n > 2 and sx > 0 and sy > 0")
    return per.groupBy(*by).agg(F.avg("c").alias("corr"), F.count("*").alias("series")) if by else per.agg(F.avg("c").alias("corr"), F.count("*").alias("series"))


def twins(rows: DataFrame, keys: list[str], value: str, one: str, other: str) -> DataFrame:
    """Two tags' means of a value side by side, by keys that both have."""
    of = lambda tag: rows.where(F.col("tag") == tag).groupBy(*keys).agg(F.avg(value).alias(tag))
    return of(one).join(of(other), keys)


def largest(rows: DataFrame, by: list[str], name: str, value: str) -> DataFrame:
    """Per group the name with the largest absolute value, the first by name if tied; groups without a finite value are out."""
    size = F.abs(F.col(value))
    ok = rows.where(size.isNotNull() & ~F.isnan(size) & (size < float("inf")))
    return ok.groupBy(*by).agg(F.min_by(name, F.struct((-size).alias("s"), F.col(name).alias("n"))).alias(name), F.max(size).alias("size"))


def restart_stability(agreement: DataFrame, least: float = 0.9) -> DataFrame:
    """(n_fits, lowest_median, lowest_worst, middle_median, below) of ``loadings.restart_agreement``: did the regimes hold across restarts?

    ``below`` counts the weeks on which some restart agrees with the best one on less than ``least`` of the weeks.
    """
    return agreement.agg(F.count("*").alias("n_fits"), F.median("lowest").alias("lowest_median"), F.min("lowest").alias("lowest_worst"), F.median("middle").alias("middle_median"), F.count_if(F.col("lowest") < least).alias("below"))
