"""From views to alphas: cells on an axis times the view of the date, of a group or of regions, under a scope's mask.

What has no cell, no view or no place in the scope has an alpha of exactly zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _masked(alpha: Column) -> Column:
    ok = (F.coalesce("mask", F.lit(0.0)) > 0) & alpha.isNotNull() & ~F.isnan(alpha)
    return F.when(ok, alpha * F.col("mask")).otherwise(0.0).alias("alpha")


def directional(frame: DataFrame, views: DataFrame) -> DataFrame:
    """(date, series_id, alpha): one view a date for all. frame: date, series_id, x, mask; views: date, v."""
    return frame.join(F.broadcast(views.select("date", "v")), "date", "left").select("date", "series_id", _masked(F.col("x") * F.col("v")))  # one row a date


def by_group(frame: DataFrame, views: DataFrame) -> DataFrame:
    """(date, series_id, alpha): each group has a view. frame: date, series_id, x, mask, group (null: none); views: date, group, v."""
    return frame.join(views.select("date", "group", "v"), ["date", "group"], "left").select("date", "series_id", _masked(F.col("x") * F.col("v")))


def by_region(frame: DataFrame, cells: DataFrame, views: DataFrame) -> DataFrame:
    """(date, series_id, alpha): the sum over regions of an instrument's cell times the region's view; a missing one adds nothing.

    frame: date, series_id, mask; cells: series_id, region, x; views: date, region, v.
    """
    frame = frame.select("date", "series_id", "mask")
    parts = frame.join(cells.select("series_id", "region", "x"), "series_id").join(views.select("date", "region", "v"), ["date", "region"])
    total = parts.groupBy("date", "series_id").agg(F.sum(F.col("x") * F.col("v")).alias("_a"))
    return frame.join(total, ["date", "series_id"], "left").select("date", "series_id", _masked(F.col("_a")))


def groups(frame: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """``frame`` with ``group``: by one label, or one refined by a second; a blank first label, a second one of ``all`` and a mask of zero form none.

    Without labels each instrument with a cell is a group of its own.
    """
    if len(labels) > 2:
        raise ValueError("a group is one label, or one refined by a second")
    if not labels:
        key, forms = F.col("series_id"), F.col("x").isNotNull()
    else:
        first = F.coalesce(F.col(labels[0]), F.lit(""))
        key, forms = first, first != ""
        if len(labels) == 2:
            second = F.coalesce(F.col(labels[1]), F.lit(""))
            key, forms = F.when(second == "", first).otherwise(F.concat(first, F.lit("/"), second)), forms & (second != "all")
    return frame.withColumn("group", F.when(forms & (F.col("mask") > 0), key))
