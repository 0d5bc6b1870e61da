"""Queries of small pieces: scalar expressions, frames, loads by field, ranks, streams, exposures by week."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import asof, book, panel, stats, store, windows
from ..sources import hosted as h
from ..sources import loaders, readers, synthetic
from .ladder_queries import _OLS
from .loader_queries import _FIELDS, fields
from .model_queries import ols
from .registry import query
from .report_queries import overview
from .stat_queries import _NULLS, draws


def orders(spark, sf):
    return h.table(spark, sf, "orders")


@query("a16_tiers", "SELECT o_orderkey, CASE WHEN d <= DATE '2001-12-31' THEN 'backbone' WHEN d <= DATE '2009-12-31' THEN 'second' ELSE 'tradable_only' END AS tier FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) + (o_custkey % 5 * 1500)::INT AS d FROM orders)")
def tiers(spark, sf):
    return orders(spark, sf).select("o_orderkey", scalars.tier(F.date_add(F.to_date("o_orderdate"), (F.col("o_custkey") % 5 * 1500).cast("int"))).alias("tier"))


@query("a20_weekly_and_daily", """
WITH f AS (SELECT series_id, date + (5 - isodow(date))::INT AS date, max_by(floor(level / 700), date) AS level FROM levels WHERE date < DATE '1998-06-01' GROUP BY 1, 2 HAVING min(date + (5 - isodow(date))::INT) < DATE '1998-06-01'),
s AS (SELECT *, coalesce(level = lag(level) OVER w AND date - lag(date) OVER w = 7, false) AS same FROM f WINDOW w AS (PARTITION BY series_id ORDER BY date)),
i AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY series_id ORDER BY date) AS island FROM s), n AS (SELECT *, count(*) OVER (PARTITION BY series_id, island) AS n FROM i)
SELECT series_id, date, level::DOUBLE AS level FROM n WHERE NOT (same AND n >= 3)""")
def both(spark, sf):
    lv = h.levels(spark, sf).withColumn("level", F.floor(F.col("level") / 700).cast("double"))
    weekly = F.col("series_id").endswith("1")
    return loaders.weekly_from_both(lv.where(weekly), lv.where(~weekly), "1998-06-01", 3)


@query("a24_field_starts", f"""
WITH {_FIELDS}, g AS (SELECT series_id, field, date, date - lag(date) OVER (PARTITION BY series_id, field ORDER BY date) AS days FROM f WHERE date < DATE '1998-06-01'),
k AS (SELECT series_id, field, date, count(days) OVER w AS n, count(*) FILTER (days > 11) OVER w AS wide FROM g WINDOW w AS (PARTITION BY series_id, field ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING))
SELECT series_id, field, min(date) AS start FROM k WHERE n = 20 AND wide = 0 GROUP BY 1, 2""")
def starts(spark, sf):
    a, b, *_ = fields(spark, sf)
    return loaders.field_starts(loaders.merged_analytics(a, b), "1998-06-01", 20, 11)


@query("b17_vintage_frame", "SELECT event_type || '_X' AS series_id, d - (event_id % 40)::INT AS period_end, d AS knowledge_date, r(value) AS value, r(1 + event_id % 4) AS grading, r(event_id % 40) AS eop_lag FROM (SELECT *, CAST(ts AS DATE) AS d FROM events) WHERE event_id % 7 <> 0 AND value IS NOT NULL AND 1 + event_id % 4 < 3")
def vintage_frame(spark, sf):
    e, k = h.table(spark, sf, "events"), F.col("event_id")
    pull = e.select(F.to_date("ts").alias("real_date"), F.col("event_type").alias("cid"), F.lit("X").alias("xcat"), F.when(k % 7 != 0, F.col("value")).alias("value"), (1 + k % 4).cast("double").alias("grading"), (k % 40).cast("double").alias("eop_lag"))
    return readers.vintage_frame(pull)[0]


@query("b23_true_daily", """
WITH g AS MATERIALIZED (SELECT series_id, date, level, date - lag(date) OVER (PARTITION BY series_id ORDER BY date) AS days FROM levels),
k AS MATERIALIZED (SELECT series_id, date, level, count(days) OVER w AS n, count(*) FILTER (days > 11) OVER w AS wide FROM g WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)),
s AS (SELECT *, min(CASE WHEN n = 20 AND wide = 0 THEN date END) OVER (PARTITION BY series_id) AS start FROM k)
SELECT series_id, date, CASE WHEN date >= start THEN r(level) END AS level FROM s WHERE start IS NOT NULL""")
def true_daily(spark, sf):
    lv = h.levels(spark, sf)
    s = panel.true_daily_starts(lv, 20, 11)
    return panel.truncated(lv.join(s.select("series_id"), "series_id", "left_semi"), s)


@query("c7_excess_by_cell", """
WITH o AS (SELECT r.run_id, ts, status, family, nullif(hypothesis, 3) AS prior, value AS ir FROM runs r JOIN metrics m ON m.run_id = r.run_id AND m.name = 'net_ir'),
b AS (SELECT family, prior, ir AS base, row_number() OVER (PARTITION BY family, prior ORDER BY ts, run_id) AS k FROM o WHERE status = 'O')
SELECT run_id, CASE WHEN status = 'F' THEN r(ir - base) END AS excess FROM (SELECT o.run_id, status, ir, base FROM o LEFT JOIN b ON k = 1 AND o.family = b.family AND o.prior IS NOT DISTINCT FROM b.prior)""")
def excess(spark, sf):
    """Live rows less the first baseline of their cell; baseline rows have none."""
    o = overview(spark, sf).where("net_ir is not null").withColumn("prior", F.nullif("hypothesis", F.lit(3)))
    out = store.excess_over_baseline(o, o.where("status = 'O'"), ["family", "prior"], "net_ir")
    return out.select("run_id", F.when(F.col("status") == "F", F.col("excess")).alias("excess"))


@query("e8_last_versions", "SELECT series_id, period_end, r(value) AS value FROM (SELECT *, row_number() OVER (PARTITION BY series_id, period_end ORDER BY knowledge_date DESC) AS k FROM vintages WHERE value IS NOT NULL AND knowledge_date <= DATE '2099-01-01') WHERE k = 1")
def last_versions(spark, sf):
    return asof.as_of(h.vintages(spark, sf), "2099-01-01")


@query("e42_live_rank", f"WITH {_NULLS} SELECT test, 1 + count(*) FILTER (t0 > t) AS rank FROM n JOIN t USING (test) GROUP BY 1")
def live_rank(spark, sf):
    return stats.live_rank(*draws(spark, sf))


@query("e50_frames", """
SELECT series_id, date, r(CASE WHEN count(ret) OVER t = 13 THEN avg(ret) OVER t END) AS trailing, r(avg(ret) OVER e) AS expanding, r(CASE WHEN count(ret) OVER f = 4 THEN sum(ret) OVER f END) AS forward FROM weekly
WINDOW t AS (PARTITION BY series_id ORDER BY date ROWS 12 PRECEDING), e AS (PARTITION BY series_id ORDER BY date ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)""")
def frames(spark, sf):
    """Trailing, expanding and forward frames of one partitioning and order: one exchange, one sort."""
    t, x = windows.trailing(13), F.col("ret")
    e, f = panel.of_series().rowsBetween(Window.unboundedPreceding, 0), panel.of_series().rowsBetween(1, 4)
    return h.weekly(spark, sf).select("series_id", "date", windows.full(F.avg(x).over(t), x, 13, t).alias("trailing"), F.avg(x).over(e).alias("expanding"), windows.full(F.sum(x).over(f), x, 4, f).alias("forward"))


@query("g8_grid_size", "SELECT count(DISTINCT currency) * count(DISTINCT nation) AS size FROM meta")
def grid_size(spark, sf):
    return h.meta(spark, sf).agg((F.count_distinct("currency") * F.count_distinct("nation")).alias("size"))


@query("h8_day_arithmetic", "SELECT o_orderkey, d - (o_custkey % 30)::INT AS period_end, d + 7 * (o_custkey % 52)::INT AS horizon_end, (DATE '1998-12-31' - d)::INT AS days_left, d + 7 * (o_custkey % 52)::INT < DATE '1998-06-01' AS before_cut FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)")
def days(spark, sf):
    d, k = F.to_date("o_orderdate"), F.col("o_custkey")
    end = F.date_add(d, (7 * (k % 52)).cast("int"))
    return orders(spark, sf).select("o_orderkey", F.date_sub(d, (k % 30).cast("int")).alias("period_end"), end.alias("horizon_end"), F.datediff(F.lit("1998-12-31").cast("date"), d).alias("days_left"), (end < F.lit("1998-06-01").cast("date")).alias("before_cut"))


@query("h12_clip", "SELECT o_orderkey, r(least(greatest(o_totalprice / 100000 - 1, -0.5::DOUBLE), 1.0::DOUBLE)) AS x FROM orders")
def clipped(spark, sf):
    return orders(spark, sf).select("o_orderkey", scalars.clip(F.col("o_totalprice") / 100000 - 1, -0.5, 1.0).alias("x"))


@query("h13_horizon", "SELECT o_orderkey, floor(sqrt((o_custkey % 13 + 1) * (o_custkey % 13 + 1 + o_orderkey % 52)) + 0.5)::INT AS h FROM orders")
def horizon(spark, sf):
    low = F.col("o_custkey") % 13 + 1
    return orders(spark, sf).select("o_orderkey", scalars.horizon(low, low + F.col("o_orderkey") % 52).alias("h"))


@query("h18_max_probability", "WITH p AS (SELECT o_orderkey, [o_custkey % 7 + 1, o_orderkey % 5 + 1]::DOUBLE[] AS c FROM orders) SELECT o_orderkey, r(round((list_max(c) / list_sum(c) - 0.5) / 0.5, 12)) AS conviction FROM p")
def top(spark, sf):
    c = F.array((F.col("o_custkey") % 7 + 1).cast("double"), (F.col("o_orderkey") % 5 + 1).cast("double"))
    return orders(spark, sf).select("o_orderkey", F.round(scalars.max_probability_conviction(scalars.normalised(c)), 12).alias("conviction"))


@query("h23_normalised", "SELECT o_orderkey, CASE WHEN list_min(c) >= 0 AND list_sum(c) > 0 THEN r(c[1] / list_sum(c)) END AS p1, CASE WHEN list_min(c) >= 0 AND list_sum(c) > 0 THEN r(c[2] / list_sum(c)) END AS p2 FROM (SELECT o_orderkey, [o_custkey % 4, o_orderkey % 5 - 1]::DOUBLE[] AS c FROM orders)")
def clean(spark, sf):
    p = scalars.normalised(F.array((F.col("o_custkey") % 4).cast("double"), (F.col("o_orderkey") % 5 - 1).cast("double")))
    return orders(spark, sf).select("o_orderkey", p.alias("p")).select("o_orderkey", F.col("p")[0].alias("p1"), F.col("p")[1].alias("p2"))


@query("j2_exposures_by_week", f"WITH {_OLS}, h AS (SELECT DISTINCT date, series_id FROM weights) SELECT date, instrument, 'market' AS factor, r(b1) AS x FROM be JOIN h USING (date) WHERE h.series_id = instrument UNION ALL SELECT date, instrument, 'tilt', r(b2) FROM be JOIN h USING (date) WHERE h.series_id = instrument")
def exposures(spark, sf):
    return book.exposures_at(ols(spark, sf).withColumnRenamed("loading", "x"), h.weights(spark, sf))


@query("k6_rebalance_days")
def rebalance_days(spark, sf):
    """A path that trades on Tuesdays, one on Wednesdays and one on Fridays, averaged, by region."""
    m = h.meta(spark, sf).select("series_id", F.col("region").alias("run_id"), book.bps(F.col("bucket"), book.HALF_SPREAD).alias("half_spread"), book.bps(F.col("bucket"), book.ANNUAL_DRAG).alias("drag"))

    def rule(date, week):
        score = week.rank(ascending=True)
        return score / score.sum()

    return book.averaged_over_days(h.returns(spark, sf).join(m, "series_id").select("run_id", "date", "series_id", "ret", "half_spread", "drag"), rule)


@query("k9_created_quadratic", "SELECT l_orderkey, l_linenumber, r(0.01 * (pow(greatest(0, b + x), 2) - pow(greatest(0, b), 2))) AS cost, r(0.004::DOUBLE * greatest(0, l_quantity / 50 - 0.75) / 0.75 / 52) AS penalty FROM (SELECT *, l_quantity / 25 - 1 AS b, l_discount * 10 AS x FROM lineitem)")
def created(spark, sf):
    b, x = F.col("l_quantity") / 25 - 1, F.col("l_discount") * 10
    return h.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", scalars.created_quadratic(b, x, 0.01).alias("cost"), scalars.turnover_penalty(F.col("l_quantity") / 50).alias("penalty"))


@query("k10_te_coefficient", "SELECT o_orderkey, r(8.0::DOUBLE + (2.0 - 8.0)::DOUBLE * least(greatest(o_totalprice / 300000, 0), 1)) AS coefficient FROM orders")
def te_coefficient(spark, sf):
    return orders(spark, sf).select("o_orderkey", scalars.te_coefficient(F.col("o_totalprice") / 300000, 2.0, 8.0).alias("coefficient"))


@query("k41_streams", "SELECT label, i::BIGINT AS i, r(('0x' || substr(md5('11|' || label || '|' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE) AS u FROM range(500) t(i), (VALUES ('baseline'), ('shuffle'), ('span')) v(label)")
def streams(spark, sf):
    return stats.streams(spark, ["baseline", "shuffle", "span"], 500, 11)


@query("k63_drawdown_per_risk", """
WITH e AS (SELECT path, week, sqrt(-2 * ln(1 - ('0x' || substr(md5('5|' || path || '|' || week || '|1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)) * cos(2 * 3.141592653589793::DOUBLE * (('0x' || substr(md5('5|' || path || '|' || week || '|2'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)) * (0.03::DOUBLE / sqrt(52)) AS e FROM range(400) a(path), range(156) b(week)),
w AS (SELECT path, week, product(1 + e) OVER (PARTITION BY path ORDER BY week) AS w FROM e),
d AS (SELECT path, max(f) / 0.03 AS x FROM (SELECT path, 1 - w / max(w) OVER (PARTITION BY path ORDER BY week) AS f FROM w) GROUP BY 1)
SELECT r(quantile_cont(x, 0.5)) AS p50, r(quantile_cont(x, 0.9)) AS p90, r(quantile_cont(x, 0.99)) AS p99, count(*) AS paths FROM d""")
def drawdowns(spark, sf):
    d = synthetic.drawdown_paths(spark, 400, 156, 0.03, 5)
    return d.agg(*[F.percentile("per_risk", q).alias(n) for q, n in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99"))], F.count("*").alias("paths"))
