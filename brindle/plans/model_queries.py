"""Queries of estimators, solvers, planted signals and simulations, which SQL cannot express."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import loadings, windows
from ..sources import hosted as h
from ..sources import synthetic
from .registry import query

FACTORS = ["market", "tilt"]


def panel(spark, sf):
    """Weekly returns of every series with two factors: the cross-section's mean and a region's lead over it."""
    w = h.weekly(spark, sf)
    m = h.meta(spark, sf)
    f = w.join(m, "series_id").groupBy("date").agg(F.avg("ret").alias("market"), (F.avg(F.when(F.col("region") == "ASIA", F.col("ret"))) - F.avg("ret")).alias("tilt")).where("tilt is not null")  # one row a week
    return w.join(F.broadcast(f), "date").select(F.col("series_id").alias("instrument"), "date", "ret", *FACTORS)


def _method(name: str, method: str):
    @query(name)
    def run(spark, sf):
        return loadings.estimated(panel(spark, sf), FACTORS, method)

    return run


def ols(spark, sf):
    return loadings.estimated(panel(spark, sf), FACTORS, "ols")


_method("k32_huber_m", "huber")
_method("k34_regime_conditional", "regime")
_method("k35_discount_filter", "discount")
_method("k36_reverting_filter", "reverting")


@query("k33_peer_prior")
def peer_prior(spark, sf):
    own = F.when(F.col("market") == "", F.col("series_id")).otherwise(F.col("market"))  # no market, no peers
    peers = h.meta(spark, sf).select(F.col("series_id").alias("instrument"), own.alias("class"))
    return loadings.with_peer_prior(loadings.estimated(panel(spark, sf), FACTORS, "ols", covariance=True), peers)


def losses(spark, sf):
    made = loadings.predicted(panel(spark, sf), FACTORS, "ols").select("instrument", scalars.huber(F.col("ret") - F.col("p")).alias("loss"))
    return made.groupBy("instrument").agg(F.avg("loss").alias("loss"), F.count("*").alias("n"))


@query("a32_synthetic_levels")
def levels(spark, sf):
    return synthetic.levels(spark, 20, "1999-01-04", "2001-12-31", 1).groupBy("series_id").agg(F.count("*").alias("n"), F.min("date").alias("first"))


@query("a34_synthetic_vintages")
def vintages(spark, sf):
    return synthetic.vintages(spark, 10, 60, 2).groupBy("series_id").agg(F.count("*").alias("n"), F.count_distinct("period_end").alias("periods"))


@query("k62_bias_map")
def bias_map(spark, sf):
    q = F.array(*[F.lit(x) for x in (0.5, 0.9, 0.95, 0.99)])
    return synthetic.simulated_maxima(spark, 2000, 10, 52, 3).agg(F.percentile("worst_bias", q).alias("worst_bias"), F.percentile("drawdown", q).alias("drawdown"))


@query("k37_no_lookahead", "SELECT m AS method, 0::BIGINT AS moved FROM (VALUES ('ols'), ('huber'), ('discount'), ('reverting')) t(m)")
def no_lookahead(spark, sf):
    """Loadings of the weeks before 1998 from all weeks and from those weeks alone: cells that differ, by estimator."""
    p = panel(spark, sf)
    return loadings.moved_by_the_future(p, FACTORS, ["ols", "huber", "discount", "reverting"], "1998-01-01")


@query("e39_rank_agreement")
def agreement(spark, sf):
    """Median over weeks of the rank correlation of loadings by two estimators."""
    a = loadings.estimated(panel(spark, sf), FACTORS, "huber").where("factor = 'market'").select("instrument", "date", F.col("loading").alias("x"))
    b = ols(spark, sf).where("factor = 'market'").select("instrument", "date", F.col("loading").alias("y"))
    j = a.join(b, ["instrument", "date"])
    r = j.select("date", windows.average_rank(F.col("x"), ["date"]).alias("x"), windows.average_rank(F.col("y"), ["date"]).alias("y"))
    return r.groupBy("date").agg(F.corr("x", "y").alias("c"), F.count("*").alias("n")).where("n >= 5").agg(F.median("c").alias("agreement"), F.count("*").alias("weeks"))
