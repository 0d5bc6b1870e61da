"""Frames of a report over a table of cell rows: pivots, summaries, thresholds as data, and the arithmetic of an acceptance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stats import ols


def readings(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(ic, horizon, one mean a column) of the base cells."""
    return rows.where("tag = 'base'").groupBy("ic", "horizon").agg(*[F.avg(c).alias(c) for c in columns])


def pivot(rows: DataFrame, column: str, horizons: list[int], tag: str = "base") -> DataFrame:
    """(ic, one mean a horizon) of ``column`` over the cells of one tag."""
    return rows.where(F.col("tag") == tag).groupBy("ic").pivot("horizon", horizons).agg(F.avg(column))


def calibration(rows: DataFrame) -> DataFrame:
    """One row over the base cells: medians and extremes of the bias statistics, the left tail and the realised risk, and the year that was worst most often (the earliest if tied) with its share."""
    base = rows.where("tag = 'base'")
    q = lambda c, at: F.percentile(c, at)
    told = base.agg(
        F.median("bias_band").alias("bias_band_median"), F.median("bias_stat").alias("bias_stat_median"), F.median("bias_worst_annual").alias("bias_worst_annual_median"), F.max("bias_worst_annual").alias("bias_worst_annual_max"),
        F.median("left_tail_L").alias("left_tail_L_median"), q("left_tail_L", 0.05).alias("left_tail_L_p05"), q("left_tail_L", 0.95).alias("left_tail_L_p95"), F.max("left_tail_L").alias("left_tail_L_max"),
        F.median("te_p95").alias("te_p95_median"), F.max("te_p95").alias("te_p95_max"), F.count("bias_worst_year").alias("_years"), F.count("*").alias("n_cells"),
    )
    years = base.where("bias_worst_year is not null").groupBy("bias_worst_year").agg(F.count("*").alias("n"))  # one row a year
    mode = years.agg(F.max_by("bias_worst_year", F.struct("n", (-F.col("bias_worst_year")).alias("y"))).alias("bias_worst_year_mode"), F.max("n").alias("_n"))
    return told.crossJoin(F.broadcast(mode)).withColumn("bias_worst_year_share", F.try_divide("_n", "_years")).drop("_n", "_years")  # one row each


def against(rows: DataFrame, column: str, tags: tuple[str, str]) -> DataFrame:
    """(horizon, <first tag>, <second tag>): means of ``column`` by horizon for two tags side by side, where both have cells."""
    mean = lambda t: F.avg(F.when(F.col("tag") == t, F.col(column))).alias(t)
    there = [F.count_if(F.col("tag") == t) > 0 for t in tags]
    out = rows.groupBy("horizon").agg(*[mean(t) for t in tags], (there[0] & there[1]).alias("_both"))
    return out.where("_both").drop("_both")


def highlighted(rows: DataFrame, unjudged: str = "frictionless") -> DataFrame:
    """(n_cells, n_highlighted) of the cells that are judged; the highlight reports and gates nothing."""
    return rows.where(F.col("tag") != unjudged).agg(F.count("*").alias("n_cells"), F.count_if(F.coalesce("turnover_highlight", F.lit(False))).alias("n_highlighted"))


def stress(rows: DataFrame, tag: str, horizon: int) -> DataFrame:
    """The stressed cells and the base cells they are measured against, at one horizon: over several, a part of any effect would be the mix of horizons."""
    return rows.where(F.col("tag").isin("base", tag) & (F.col("horizon") == horizon))


def flagged(rows: DataFrame, key: str, thresholds: DataFrame) -> DataFrame:
    """(key, flags, passed): for each row a map of threshold name to whether it held. thresholds: name, column, at_most, bound, kept as data.

    A null value meets no threshold; of several rows of one key all have to hold. ``passed``: all held.
    """
    columns = [r[0] for r in thresholds.select("column").distinct().collect()]  # a handful, written by hand
    long = rows.select(key, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([key], columns, "column", "value")
    held = F.when(F.col("at_most"), F.col("value") <= F.col("bound")).otherwise(F.col("value") >= F.col("bound"))
    each = long.join(F.broadcast(thresholds), "column").withColumn("held", F.coalesce(held, F.lit(False))).groupBy(key, "name").agg(F.bool_and("held").alias("held"))
    return each.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "held")))).alias("flags"), F.bool_and("held").alias("passed"))


def with_excess(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Live rows (``baseline`` false) with ``net_ir_excess`` over their twin of the same keys; rows without a twin, and twins, have none."""
    twin = rows.where("baseline").groupBy(*keys).agg(F.min("net_ir").alias("_twin"))
    return rows.join(twin, keys, "left").withColumn("net_ir_excess", F.when(~F.col("baseline"), F.col("net_ir") - F.col("_twin"))).drop("_twin")


def per_ic(rows: DataFrame) -> DataFrame:
    """(ic, quantity, n, mean, sd, min, max): net ratio, its excess and the realised correlation of live pairs, and the latter of twins."""
    pair = F.col("net_ir_excess").isNotNull()
    named = {"net_ir": F.when(pair, F.col("net_ir")), "net_ir_excess": F.col("net_ir_excess"), "realised_ic_live": F.when(pair, F.col("realised_ic")), "realised_ic_twin": F.when(F.col("baseline"), F.col("realised_ic"))}
    long = rows.select("ic", *[c.alias(k) for k, c in named.items()]).unpivot(["ic"], list(named), "quantity", "x")
    x = F.col("x")
    return long.groupBy("ic", "quantity").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.min(x).alias("min"), F.max(x).alias("max"))


def acceptance(rows: DataFrame, target: float, high_ic: float, least_t: float = 2.0, least_gap: float = 0.1, most_share: float = 0.1) -> DataFrame:
    """One row, one pass: slope of the excess on the planted ic over live pairs with its error and t, the gap between the means at ``high_ic`` and at none,
    how many pairs without signal reach the target with an excess, the share of twins that do, whether all passed the look-ahead, and what is met."""
    e, pair = F.col("net_ir_excess"), F.col("net_ir_excess").isNotNull()
    df = rows.withColumn("_ic", F.when(pair, F.col("ic")))
    none = pair & (F.col("ic") == 0)
    slope = [c.alias(n) for c, n in zip(ols("_ic", "net_ir_excess"), ("slope", "se", "t", "n_pairs"))]
    out = df.agg(
        F.count("*").alias("n_runs"), *slope, (F.avg(F.when(F.col("ic") == high_ic, e)) - F.avg(F.when(F.col("ic") == 0, e))).alias("gap"),
        F.count_if(none).alias("b1_n"), F.count_if(none & (F.col("net_ir") >= target) & (e > 0)).alias("b1_count"),
        F.avg(F.when(F.col("baseline"), (F.col("net_ir") >= target).cast("int"))).alias("twin_share"), F.bool_and("lookahead_passed").alias("lookahead_all"),
    )
    out = out.withColumn("b1_share", F.try_divide("b1_count", "b1_n"))
    met = lambda c: F.coalesce(c, F.lit(False))
    return out.select("*", met((F.col("t") >= least_t) & (F.col("gap") >= least_gap)).alias("a2_met"), met(F.col("b1_share") <= most_share).alias("b1_met"))
