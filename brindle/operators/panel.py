"""Levels to returns: cleaning, calendars, currency, splices, gaps and periods of long (series_id, date, level) tables.

Missing values are null or absent rows and are never filled. A return is against the series' own prior observation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import to_missing


def of_series() -> WindowSpec:
    """Rows of a series in order of date."""
    return Window.partitionBy("series_id").orderBy("date")


def cleaned(raw: DataFrame) -> DataFrame:
    """Text ``raw`` to ``level``: vendor markers and non-numbers to null."""
    return raw.withColumn("level", to_missing(F.col("raw"))).drop("raw")


def business_days(df: DataFrame, holidays: DataFrame | None = None) -> DataFrame:
    """Rows on Monday to Friday that are not in ``holidays`` (date)."""
    kept = df.where(F.weekday("date") < 5)
    return kept if holidays is None else kept.join(holidays, "date", "left_anti")


def forward_fills(before: DataFrame, after: DataFrame) -> DataFrame:
    """Cells that were null before and hold a value after: must be empty."""
    return before.alias("b").join(after.alias("a"), ["series_id", "date"]).where("b.level is null and a.level is not null").select("series_id", "date")


def truncated(levels: DataFrame, meta: DataFrame) -> DataFrame:
    """Levels with those before the series' ``start`` set to null; a series without meta is refused."""
    unknown = levels.select("series_id").distinct().join(meta, "series_id", "left_anti")
    if not unknown.isEmpty():
        raise ValueError("series without metadata: " + ", ".join(r[0] for r in unknown.limit(5).collect()))
    return levels.join(meta.select("series_id", "start"), "series_id").select("series_id", "date", F.when(F.col("date") >= F.col("start"), F.col("level")).alias("level"))


def frequency_breaches(used: DataFrame, meta: DataFrame) -> DataFrame:
    """Contributions (series_id, date) dated before the series' start, or of an unknown series."""
    return used.join(meta.select("series_id", "start"), "series_id", "left").where(F.col("start").isNull() | (F.col("date") < F.col("start"))).select("series_id", "date")


def before_holdout(df: DataFrame, cut: str, column: str = "date") -> DataFrame:
    """The table itself if no row is dated on or after ``cut``; else an error."""
    if not df.where(F.col(column) >= F.lit(cut).cast("date")).isEmpty():
        raise ValueError(f"rows dated {cut} or later")
    return df


def clipped(df: DataFrame, first: str, last: str) -> DataFrame:
    return df.where(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def returns_from_prior_observation(levels: DataFrame) -> DataFrame:
    """level / own previous observed level - 1 where a level is printed; null for a series' first."""
    seen = levels.where("level is not null")
    return seen.select("series_id", "date", (F.try_divide("level", F.lag("level").over(of_series())) - 1).alias("ret"))


def spanned_days(levels: DataFrame) -> DataFrame:
    """Calendar days since the series' own previous observation."""
    return levels.where("level is not null").select("series_id", "date", F.datediff("date", F.lag("date").over(of_series())).alias("days"))


def overlapping_returns(returns: DataFrame, k: int = 2) -> DataFrame:
    """The compounded return of each k consecutive rows; null unless all k are there."""
    w = of_series().rowsBetween(1 - k, 0)
    return returns.select("series_id", "date", F.when(F.count("ret").over(w) == k, F.product(1 + F.col("ret")).over(w) - 1).alias("ret"))


def true_daily_starts(levels: DataFrame, gaps: int = 20, most: int = 5) -> DataFrame:
    """Per series the first date whose next ``gaps`` gaps between observations are at most ``most`` days; absent if there is none."""
    w = of_series().rowsBetween(1, gaps)
    gap = spanned_days(levels).withColumn("wide", (F.col("days") > most).cast("int"))
    ok = gap.select("series_id", "date", F.sum("wide").over(w).alias("wide"), F.count("days").over(w).alias("n"))
    return ok.where((F.col("n") == gaps) & (F.col("wide") == 0)).groupBy("series_id").agg(F.min("date").alias("start"))


def to_fridays(levels: DataFrame, cut: str | None = None) -> DataFrame:
    """The last observation of each Monday-to-Friday week, dated that Friday; weeks whose Friday is at or after ``cut`` go whole."""
    seen = levels.where("level is not null")
    if cut is not None:
        seen = seen.where(F.col("date") < F.lit(cut).cast("date"))
    friday = F.date_add("date", 4 - F.weekday("date"))
    out = seen.groupBy("series_id", friday.alias("date")).agg(F.max_by("level", F.col("date")).alias("level"))
    return out if cut is None else out.where(F.col("date") < F.lit(cut).cast("date"))


def stale_dropped(weekly: DataFrame, run: int = 6, step: int = 7) -> DataFrame:
    """Rows without the repeats of runs of ``run`` or more equal values exactly ``step`` days apart; a run's first row stays."""
    same = F.coalesce((F.col("level") == F.lag("level").over(of_series())) & (F.datediff("date", F.lag("date").over(of_series())) == step), F.lit(False))
    marked = weekly.withColumn("same", same).withColumn("island", F.sum(F.when(F.col("same"), 0).otherwise(1)).over(of_series()))
    sized = marked.withColumn("n", F.count("*").over(Window.partitionBy("series_id", "island")))
    return sized.where(~(F.col("same") & (F.col("n") >= run))).select("series_id", "date", "level")


def change_points(vintages: DataFrame) -> DataFrame:
    """Vintages without those that repeat the series' previous (period_end, value, grading) in order of knowledge_date."""
    w = Window.partitionBy("series_id").orderBy("knowledge_date", "period_end")
    now = F.struct("period_end", "value", "grading")
    return vintages.withColumn("_was", F.lag(now).over(w)).where(~now.eqNullSafe(F.col("_was"))).drop("_was")


def seam(levels: DataFrame, target: str, source: str) -> Row:
    """Where a splice meets: rows of either series, how many gaps of ``target`` the source fills, the first of them, the first common date and the scale there."""
    of = lambda name: F.max(F.when(F.col("series_id") == name, F.col("level")))
    has = lambda name: F.bool_or(F.col("series_id") == name)
    pair = levels.where(F.col("series_id").isin(target, source)).groupBy("date").agg(of(target).alias("t"), of(source).alias("s"), has(target).alias("has_t"), has(source).alias("has_s"))
    both, gap = F.col("t").isNotNull() & F.col("s").isNotNull(), F.col("t").isNull() & F.col("s").isNotNull()
    scale = F.min_by(F.col("t") / F.nullif("s", F.lit(0.0)), F.when(both, F.col("date")))
    return pair.agg(
        F.coalesce(F.bool_or("has_t"), F.lit(False)).alias("has_target"), F.coalesce(F.bool_or("has_s"), F.lit(False)).alias("has_source"), F.count_if(gap).alias("taken"),
        F.min(F.when(gap, F.col("date"))).alias("splice_date"), F.min(F.when(both, F.col("date"))).alias("seam_date"), scale.alias("scale"),
    ).first()


def spliced(levels: DataFrame, target: str, source: str, at: Row | None = None) -> DataFrame:
    """``levels`` with the gaps of ``target`` filled from ``source``, scaled to meet at their first common date; ``at``: ``seam`` where it is known.

    No common date, or a zero level of the source there, is refused.
    """
    at = at or seam(levels, target, source)
    if at["scale"] is None:
        raise ValueError(f"{target} and {source} have no date to splice at")
    pair = levels.where(F.col("series_id").isin(target, source) & F.col("level").isNotNull()).groupBy("date").agg(F.max(F.when(F.col("series_id") == target, F.col("level"))).alias("t"), F.max(F.when(F.col("series_id") == source, F.col("level"))).alias("s"))
    filled = pair.select(F.lit(target).alias("series_id"), "date", F.coalesce("t", F.col("s") * F.lit(at["scale"])).alias("level"))
    return levels.where(F.col("series_id") != target).select("series_id", "date", "level").unionByName(filled)


def converted(levels: DataFrame, currency: DataFrame, rates: DataFrame, multiply: bool = True) -> DataFrame:
    """Levels in the base currency by the same day's rate; no rate gives null, never an older one."""
    j = levels.join(currency.select("series_id", "currency"), "series_id").join(rates, ["currency", "date"], "left")
    return j.select("series_id", "date", (F.col("level") * F.col("rate") if multiply else F.try_divide("level", "rate")).alias("level"))


def dates_without_rate(levels: DataFrame, currency: DataFrame, rates: DataFrame) -> DataFrame:
    """(currency, date) with a level and no rate, inside the rates' own range."""
    need = levels.join(currency.select("series_id", "currency"), "series_id").select("currency", "date").distinct()
    span = rates.groupBy("currency").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return need.join(rates, ["currency", "date"], "left_anti").join(span, "currency").where(F.col("date").between(F.col("lo"), F.col("hi"))).select("currency", "date")


def weekly_calendar(dated: DataFrame, weekday: int = 5) -> DataFrame:
    """Every date of an ISO weekday from the week of the table's first date to its last date."""
    ends = dated.agg(F.min("date").alias("f"), F.max("date").alias("l"))
    first = F.date_add("f", weekday - 1 - F.weekday("f"))
    return ends.select(F.explode(F.sequence(first, F.col("l"), F.expr("interval 7 days"))).alias("date"))


def rebalance_dates(panel_dates: DataFrame, weekday: int = 5) -> DataFrame:
    """For each nominal weekday in the panel's range the last panel date at or before it, without repeats."""
    days = panel_dates.select("date").distinct()
    ends = days.agg(F.min("date").alias("f"), F.max("date").alias("l"))
    first = F.date_add("f", F.pmod(F.lit(weekday - 1) - F.weekday("f"), F.lit(7)))
    nominal = ends.where(F.col("l") >= first).select(F.explode(F.sequence(first, F.col("l"), F.expr("interval 7 days"))).alias("date"))
    both = days.withColumn("real", F.col("date")).unionByName(nominal.withColumn("real", F.lit(None).cast("date")))
    per = both.groupBy("date").agg(F.max("real").alias("real"), F.bool_or(F.col("real").isNull()).alias("nominal"))
    back = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # one row a calendar day
    return per.withColumn("at", F.last("real", True).over(back)).where("nominal").select(F.col("at").alias("date")).distinct()


def in_periods(df: DataFrame, ends: DataFrame, period: str = "end") -> DataFrame:
    """Rows with the weekly period end whose week they fall in, as ``period``. No row is copied or sent: the calendar's days, seven an end, go to all tasks."""
    days = ends.select(F.col("date").alias(period)).select(period, F.explode(F.sequence(F.date_sub(period, 6), F.col(period))).alias("date"))
    return df.join(F.broadcast(days), "date")


def period_returns(returns: DataFrame, period_ends: DataFrame, empty: float | None = None) -> DataFrame:
    """Compounded returns over (previous end, end] for weekly period ends; null days count zero.

    A period without an observation is absent, or ``empty`` for every series if given (as for one book's path).
    """
    out = in_periods(returns, period_ends).groupBy("series_id", F.col("end").alias("date")).agg(F.when(F.count("ret") > 0, F.product(1 + F.coalesce("ret", F.lit(0.0))) - 1).alias("ret"))
    if empty is None:
        return out
    grid = returns.select("series_id").distinct().crossJoin(F.broadcast(period_ends.select("date")))  # one row a week
    return grid.join(out, ["series_id", "date"], "left").withColumn("ret", F.coalesce("ret", F.lit(empty)))


def weekly_levels(levels: DataFrame, calendar: DataFrame) -> DataFrame:
    """The last observation of each bucket (previous calendar date, date], on every calendar date, null where there is none."""
    last = in_periods(levels.where("level is not null"), calendar).groupBy("series_id", F.col("end").alias("date")).agg(F.max_by("level", F.col("date")).alias("level"))
    grid = levels.select("series_id").distinct().crossJoin(F.broadcast(calendar.select("date")))  # one row a week
    return grid.join(last, ["series_id", "date"], "left")


def bucketed_last(fields: DataFrame, calendar: DataFrame) -> DataFrame:
    """(series_id, date, one column a field): last value inside each own week, a row if any field is there, never carried."""
    names = [c for c in fields.columns if c not in ("series_id", "date")]
    last = in_periods(fields, calendar).groupBy("series_id", F.col("end").alias("day")).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in names])
    return last.where(F.coalesce(*[F.col(c).cast("string") for c in names]).isNotNull()).withColumnRenamed("day", "date")
