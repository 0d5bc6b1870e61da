"""Portfolios as long (date, series_id, w) tables: costs, drift, exposures and the walk-forward loop."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Half-spread and annual drag in basis points by cost bucket; a missing bucket costs like the dearest.
HALF_SPREAD = {"low": 5.0, "mid": 10.0, "high": 20.0}
ANNUAL_DRAG = {"low": 5.0, "mid": 15.0, "high": 35.0}


def bps(bucket: Column, table: dict[str, float]) -> Column:
    out = F.lit(max(table.values()))
    for k, v in table.items():
        out = F.when(bucket == k, F.lit(v)).otherwise(out)
    return out / 1e4


def drifted(book: DataFrame) -> DataFrame:
    """w (1 + r) over its sum in each date, null returns as zero; a book whose sum is not positive stays. book: date, series_id, w, ret."""
    grown = F.col("w") * (1 + F.coalesce("ret", F.lit(0.0)))
    total = F.sum(grown).over(Window.partitionBy("date"))
    return book.select("date", "series_id", F.when(total > 0, grown / total).otherwise(F.col("w")).alias("w"))


def portfolio_return(book: DataFrame) -> DataFrame:
    return book.groupBy("date").agg(F.sum(F.col("w") * F.coalesce("ret", F.lit(0.0))).alias("ret"))


def trades(target: DataFrame, held: DataFrame) -> DataFrame:
    """(date, series_id, w, before, traded) over the union of both books, absent as zero."""
    a, b = target.select("date", "series_id", F.col("w").alias("_a")), held.select("date", "series_id", F.col("w").alias("_b"))
    j = a.join(b, ["date", "series_id"], "full").select("date", "series_id", F.coalesce("_a", F.lit(0.0)).alias("w"), F.coalesce("_b", F.lit(0.0)).alias("before"))
    return j.withColumn("traded", F.abs(F.col("w") - F.col("before")))


def rebalance_costs(traded: DataFrame, buckets: DataFrame, per_year: int = 52) -> DataFrame:
    """Per date turnover and cost: traded weight times half-spread plus held weight times a period's drag."""
    j = traded.join(buckets.select("series_id", "bucket"), "series_id", "left")
    cost = F.col("traded") * bps(F.col("bucket"), HALF_SPREAD) + F.abs("w") * bps(F.col("bucket"), ANNUAL_DRAG) / per_year
    return j.groupBy("date").agg(F.sum("traded").alias("turnover"), F.sum(cost).alias("cost"))


def next_book(weights: DataFrame) -> DataFrame:
    """Each date's book as the one held into the following date."""
    dates = weights.select("date").distinct().withColumn("next", F.lead("date").over(Window.orderBy("date")))  # one row a date
    return weights.join(F.broadcast(dates), "date").where("next is not null").select(F.col("next").alias("date"), "series_id", "w")


def active_exposure(active: DataFrame, exposures: DataFrame) -> DataFrame:
    """Sum over series of active weight times exposure, per date and factor; absent exposures count zero."""
    return active.join(exposures, "series_id").groupBy("date", "factor").agg(F.sum(F.col("w") * F.col("x")).alias("exposure"))


def polished(book: DataFrame, cash: str, cap: float) -> DataFrame:
    """The book with negative weights at zero, cash at most ``cap`` and the rest scaled so that all sums to one. Without a positive weight there are no shares: nan, cash ``cap``."""
    w = Window.partitionBy("date")
    positive = F.greatest("w", F.lit(0.0))
    total = F.sum(positive).over(w)
    share = F.when(total == 0, float("nan")).otherwise(positive / total)
    step = book.withColumn("w", share).withColumn("c", F.sum(F.when(F.col("series_id") == cash, F.col("w")).otherwise(0.0)).over(Window.partitionBy("date")))
    step = step.withColumn("c", F.sum(F.when(F.col("series_id") == cash, F.col("w")).otherwise(0.0)).over(w))
    held = F.least("c", F.lit(cap))
    return step.select("date", "series_id", F.when(F.col("series_id") == cash, held).otherwise(F.col("w") * F.try_divide(1 - held, 1 - F.col("c"))).alias("w"))


def top_positions(book: DataFrame, most: int) -> DataFrame:
    """The ``most`` largest weights of each date, ties by id."""
    w = Window.partitionBy("date").orderBy(F.desc("w"), "series_id")
    return book.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def variance_shares(exposure: DataFrame, covariance: DataFrame) -> DataFrame:
    """Euler shares x_k (F x)_k / x'Fx per date and factor. exposure: date, factor, exposure; covariance: a, b, cov."""
    other = exposure.select(F.col("date").alias("_d"), F.col("factor").alias("b"), F.col("exposure").alias("y"))
    part = exposure.join(covariance, exposure["factor"] == covariance["a"]).join(other, ["b"]).where("date = _d").groupBy("date", "factor").agg(F.sum(F.col("exposure") * F.col("cov") * F.col("y")).alias("part"))
    return part.select("date", "factor", F.try_divide("part", F.sum("part").over(Window.partitionBy("date"))).alias("share"))


WeightRule = Callable[[pd.Timestamp, pd.Series], pd.Series]


def walk_forward(panel: DataFrame, rule: WeightRule, weekday: int = 4, per_year: int = 52) -> DataFrame:
    """One path per run: earn on the old book, drift it, ask the rule, charge from the drifted book, hold.

    panel: run_id, date, series_id, ret, half_spread, drag. The first book is free and gives no row.
    ``rule(date, last week's returns)`` returns weights by series and sees nothing of the path, so a period between two
    rebalances stands for itself: a task holds its days and the four before each end, not a run's calendar.
    """
    days = panel.groupBy("run_id", "date").agg(F.lit(1).alias("_one")).drop("_one")
    order = Window.partitionBy("run_id").orderBy("date")  # a run's calendar
    placed = days.withColumn("at", F.row_number().over(order)).withColumn("end", F.weekday("date") == weekday)
    ends = placed.where("end").select("run_id", F.col("date").alias("to"), F.col("at").alias("last")).withColumn("first", F.lag("last").over(Window.partitionBy("run_id").orderBy("last"))).where("first is not null")
    # days that a period reads: from four before its start on, which is when the book it holds was asked for
    near = ends.withColumn("at", F.explode(F.sequence(F.greatest(F.lit(1), F.col("first") - 4), "last")))
    reads = placed.select("run_id", "at", "date").join(near, ["run_id", "at"]).select("run_id", "date", "at", "first", "last", "to")
    rows = panel.join(reads, ["run_id", "date"]).select("run_id", "to", "date", "at", "first", "last", "series_id", "ret")
    roster = panel.groupBy("run_id", "series_id").agg(F.first("half_spread", True).alias("half_spread"), F.first("drag", True).alias("drag"))
    each = roster.join(ends.select("run_id", "to"), "run_id").select(F.col("run_id").alias("run"), F.col("to").alias("until"), F.col("series_id").alias("series"), F.col("half_spread").alias("half"), F.col("drag").alias("yearly"))  # a series without a row in a period is held all the same

    def run(key: tuple, read: pd.DataFrame, all_series: pd.DataFrame) -> pd.DataFrame:
        known = all_series.set_index("series").sort_index()
        wide = read.pivot(index="at", columns="series_id", values="ret").sort_index().reindex(columns=known.index).fillna(0.0)
        first, last = int(read["first"].iloc[0]), int(read["last"].iloc[0])
        date_at = read.groupby("at")["date"].first()

        def book_at(e: int) -> np.ndarray:
            week = pd.Series(np.prod(1 + wide.loc[max(1, e - 4) : e].to_numpy(), axis=0) - 1, known.index)
            return rule(pd.Timestamp(date_at[e]), week).reindex(known.index).fillna(0.0).to_numpy()

        gross, moved, target = 1.0, book_at(first), book_at(last)
        for day in wide.loc[first + 1 : last].to_numpy():
            gross *= 1 + float(moved @ day)
            grown = moved * (1 + day)
            moved = grown / grown.sum() if grown.sum() > 0 else moved
        traded = np.abs(target - moved)
        cost = float(traded @ known["half"].to_numpy() + np.abs(target) @ known["yearly"].to_numpy() / per_year)
        return pd.DataFrame([(key[0], key[1], gross - 1, gross - 1 - cost, float(traded.sum()), cost)], columns=["run_id", "date", "gross", "net", "turnover", "cost"])

    schema = f"run_id {panel.schema['run_id'].dataType.simpleString()}, date date, gross double, net double, turnover double, cost double"
    return rows.groupBy("run_id", "to").cogroup(each.groupBy("run", "until")).applyInPandas(run, schema)


def averaged_over_days(panel: DataFrame, rule: WeightRule, weekdays: tuple[int, ...] = (1, 2, 4), per_year: int = 52) -> DataFrame:
    """(run_id, date, gross, net, turnover, cost, paths): paths that trade on each weekday, averaged over the union of their dates."""
    paths = None
    for day in weekdays:
        one = walk_forward(panel, rule, day, per_year)
        paths = one if paths is None else paths.unionByName(one)
    return paths.groupBy("run_id", "date").agg(*[F.avg(c).alias(c) for c in ("gross", "net", "turnover", "cost")], F.count("*").alias("paths"))


def exposures_at(exposures: DataFrame, books: DataFrame) -> DataFrame:
    """(date, instrument, factor, x): the exposures of each book's own week, for the instruments it holds. A join on the week, no rule called."""
    held = books.select("date", F.col("series_id").alias("instrument")).distinct()
    return exposures.join(held, ["date", "instrument"]).select("date", "instrument", "factor", "x")
