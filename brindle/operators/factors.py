"""Six weekly factors from raw series: returns, differences, spreads, on one calendar, gaps left as gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .panel import of_series, weekly_levels


def changes(levels: DataFrame, calendar: DataFrame, log: bool) -> DataFrame:
    """(series_id, date, x): difference or log change of the last observation of each week; null if either week lacks one."""
    g = weekly_levels(levels, calendar)
    was = F.lag("level").over(of_series())
    return g.select("series_id", "date", (F.log(F.col("level") / was) if log else F.col("level") - was).alias("x"))


def credit_unit(levels: DataFrame) -> DataFrame:
    """Per series 1 if its median is in basis points (20 or more), else 100 to turn percent into them."""
    return levels.groupBy("series_id").agg(F.when(F.median("level") >= 20, 1.0).otherwise(100.0).alias("scale"))


def frame(levels: DataFrame, calendar: DataFrame, roles: dict[str, str]) -> DataFrame:
    """One column a factor. ``roles``: series_id by factor, of equity, real_yield, breakeven, credit, dollar, commodities.

    Equity, dollar and commodities are log changes, the others differences; credit is in basis points.
    """
    logs = [roles[k] for k in ("equity", "dollar", "commodities")]
    rates = [roles[k] for k in ("real_yield", "breakeven", "credit")]
    scale = credit_unit(levels.where(F.col("series_id") == roles["credit"]))
    a = changes(levels.where(F.col("series_id").isin(logs)), calendar, True)
    b = changes(levels.where(F.col("series_id").isin(rates)), calendar, False).join(F.broadcast(scale), "series_id", "left").withColumn("x", F.col("x") * F.coalesce("scale", F.lit(1.0))).drop("scale")  # one series
    wide = a.unionByName(b).groupBy("date").pivot("series_id", sorted(set(roles.values()))).agg(F.max("x"))
    return wide.select("date", *[F.col(f"`{s}`").alias(k) for k, s in roles.items()])
