"""Queries of aggregates, tests, books and covariances."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import book, covariance, stats, windows
from ..sources import hosted as h
from .registry import query
from .window_queries import _ACTIVE, _W, active


@query("d3_benchmark_weekly", "SELECT date, CASE WHEN count(ret) = 3 THEN r(sum(CASE series_id WHEN 'S1' THEN 0.5 WHEN 'S2' THEN 0.3 ELSE 0.2 END * ret)) END AS bench FROM weekly WHERE series_id IN ('S1', 'S2', 'S3') GROUP BY 1")
def legs(spark, sf):
    w = F.when(F.col("series_id") == "S1", 0.5).when(F.col("series_id") == "S2", 0.3).otherwise(0.2)
    return h.weekly(spark, sf).where("series_id in ('S1', 'S2', 'S3')").groupBy("date").agg(F.when(F.count("ret") == 3, F.sum(w * F.col("ret"))).alias("bench"))


@query("d4_group_return", "SELECT region, date, r(avg(ret)) AS ret, r(avg(ret) - any_value(bench)) AS relative FROM weekly JOIN meta USING (series_id) JOIN bench USING (date) GROUP BY 1, 2")
def groups(spark, sf):
    j = h.weekly(spark, sf).join(h.meta(spark, sf), "series_id").join(h.bench(spark, sf), "date")
    return j.groupBy("region", "date").agg(F.avg("ret").alias("ret"), (F.avg("ret") - F.first("bench")).alias("relative"))


_TE = f"t AS (SELECT *, CASE WHEN count(active) OVER w = 26 THEN stddev_samp(active) OVER w * sqrt(52) END AS te FROM a WINDOW w AS {_W} ROWS 25 PRECEDING)), z AS (SELECT series_id, date, active / (before / sqrt(52)) AS z FROM (SELECT *, lag(te) OVER {_W}) AS before FROM t) WHERE before > 1e-12)"


def z(spark, sf):
    a = active(spark, sf)
    return stats.calibrated_z(a, windows.tracking_error(a, 26))


@query("d6_annual_bias", f"WITH {_ACTIVE}, {_TE} SELECT series_id, year(date)::INT AS year, r(stddev_samp(z)) AS bias, count(z) AS n FROM z GROUP BY 1, 2 HAVING count(z) >= 40")
def bias(spark, sf):
    return stats.annual_bias(z(spark, sf))


@query("d7_worst_year", f"WITH {_ACTIVE}, {_TE}, b AS (SELECT series_id, year(date)::INT AS year, stddev_samp(z) AS bias FROM z GROUP BY 1, 2 HAVING count(z) >= 40) SELECT series_id, year, r(bias) AS bias FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY bias DESC, year) AS k FROM b) WHERE k = 1")
def worst(spark, sf):
    return stats.worst_year(stats.annual_bias(z(spark, sf)))


@query("d8_risk_calibration", f"WITH {_ACTIVE}, {_TE} SELECT series_id, r(stddev_samp(z)) AS sd, r(quantile_cont(z, 0.05)) AS q05, r(1.96 / sqrt(2 * count(z))) AS band FROM z GROUP BY 1")
def calibration(spark, sf):
    return z(spark, sf).groupBy("series_id").agg(F.stddev_samp("z").alias("sd"), F.percentile("z", 0.05).alias("q05"), (1.96 / F.sqrt(2 * F.count("z"))).alias("band"))


@query("d9_information_ratio", f"WITH {_ACTIVE} SELECT series_id, CASE WHEN count(active) >= 2 AND stddev_samp(active) >= 1e-12 THEN r(avg(active) * 52 / (stddev_samp(active) * sqrt(52))) END AS ir FROM a GROUP BY 1")
def ir(spark, sf):
    return active(spark, sf).groupBy("series_id").agg(windows.information_ratio(F.col("active")).alias("ir"))


_TRADES = """d AS (SELECT date, lead(date) OVER (ORDER BY date) AS nxt FROM (SELECT DISTINCT date FROM weights)), held AS (SELECT nxt AS date, series_id, w AS b FROM weights JOIN d USING (date) WHERE nxt IS NOT NULL),
tr AS (SELECT date, series_id, coalesce(w, 0) AS w, coalesce(b, 0) AS before, abs(coalesce(w, 0) - coalesce(b, 0)) AS traded FROM weights FULL JOIN held USING (date, series_id))"""


def trades(spark, sf):
    w = h.weights(spark, sf)
    return book.trades(w, book.next_book(w))


@query("c29_turnover", f"WITH {_TRADES} SELECT date, r(sum(traded)) AS turnover, count(*) FILTER (w > 0) AS positions FROM tr GROUP BY 1")
def turnover(spark, sf):
    return trades(spark, sf).groupBy("date").agg(F.sum("traded").alias("turnover"), F.count_if(F.col("w") > 0).alias("positions"))


@query("k4_rebalance_costs", f"""
WITH {_TRADES} SELECT date, r(sum(traded)) AS turnover, r(sum(traded * CASE bucket WHEN 'low' THEN 5 WHEN 'mid' THEN 10 ELSE 20 END / 1e4 + abs(w) * CASE bucket WHEN 'low' THEN 5 WHEN 'mid' THEN 15 ELSE 35 END / 1e4 / 52)) AS cost
FROM tr LEFT JOIN meta USING (series_id) GROUP BY 1""")
def costs(spark, sf):
    return book.rebalance_costs(trades(spark, sf), h.meta(spark, sf))


@query("d11_annual_turnover", f"WITH {_TRADES}, t AS (SELECT date, sum(traded) AS t FROM tr GROUP BY 1) SELECT r(avg(t) * 52) AS annual, r(avg(t) * 26) AS one_way, count(*) AS n FROM t")
def annual(spark, sf):
    t = trades(spark, sf).groupBy("date").agg(F.sum("traded").alias("t"))
    return t.agg((F.avg("t") * 52).alias("annual"), (F.avg("t") * 26).alias("one_way"), F.count("*").alias("n"))


@query("k2_drifted", "WITH g AS (SELECT w.date, w.series_id, w.w, w.w * (1 + coalesce(ret, 0)) AS g FROM weights w LEFT JOIN weekly USING (date, series_id)) SELECT date, series_id, r(CASE WHEN sum(g) OVER d > 0 THEN g / sum(g) OVER d ELSE w END) AS w FROM g WINDOW d AS (PARTITION BY date)")
def drifted(spark, sf):
    return book.drifted(h.weights(spark, sf).join(h.weekly(spark, sf), ["date", "series_id"], "left"))


@query("k3_portfolio_return", "SELECT date, r(sum(w * coalesce(ret, 0))) AS ret FROM weights LEFT JOIN weekly USING (date, series_id) GROUP BY 1")
def portfolio(spark, sf):
    return book.portfolio_return(h.weights(spark, sf).join(h.weekly(spark, sf), ["date", "series_id"], "left"))


@query("k5_cost_bps", "SELECT series_id, r(CASE bucket WHEN 'low' THEN 5 WHEN 'mid' THEN 10 ELSE 20 END / 1e4) AS half, r(CASE bucket WHEN 'low' THEN 5 WHEN 'mid' THEN 15 ELSE 35 END / 1e4) AS drag FROM meta")
def cost_bps(spark, sf):
    return h.meta(spark, sf).select("series_id", book.bps(F.col("bucket"), book.HALF_SPREAD).alias("half"), book.bps(F.col("bucket"), book.ANNUAL_DRAG).alias("drag"))


@query("k6_averaged_paths", "SELECT o.date, r(avg(ret)) AS ret, count(*) AS n FROM (SELECT date, ret, isodow(date) AS d FROM returns WHERE isodow(date) IN (2, 3, 5) AND ret IS NOT NULL) o GROUP BY 1")
def averaged(spark, sf):
    days = [h.returns(spark, sf).where((F.weekday("date") == d) & F.col("ret").isNotNull()) for d in (1, 2, 4)]
    return days[0].unionByName(days[1]).unionByName(days[2]).groupBy("date").agg(F.avg("ret").alias("ret"), F.count("*").alias("n"))


@query("k21_polished", """
WITH p AS (SELECT date, series_id, greatest(w - 0.003, 0) / sum(greatest(w - 0.003, 0)) OVER (PARTITION BY date) AS w FROM weights), c AS (SELECT *, sum(CASE WHEN series_id = 'S1' THEN w ELSE 0 END) OVER (PARTITION BY date) AS c FROM p)
SELECT date, series_id, r(CASE WHEN series_id = 'S1' THEN least(c, 0.01) WHEN 1 - c <> 0 THEN w * (1 - least(c, 0.01)) / (1 - c) END) AS w FROM c""")
def polished(spark, sf):
    return book.polished(h.weights(spark, sf).withColumn("w", F.col("w") - 0.003), "S1", 0.01)


@query("f4_top_positions", "SELECT date, series_id, r(w) AS w FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY w DESC, series_id) AS k FROM weights) WHERE k <= 5")
def top(spark, sf):
    return book.top_positions(h.weights(spark, sf), 5)


_EXPOSURE = "x AS (SELECT series_id, 'size' AS factor, length(nation)::DOUBLE AS x FROM meta UNION ALL SELECT series_id, 'hedge', hedged::INT::DOUBLE FROM meta), e AS (SELECT date, factor, sum(w * x) AS exposure FROM weights JOIN x USING (series_id) GROUP BY 1, 2)"


def exposure(spark, sf):
    x = h.meta(spark, sf).select("series_id", F.length("nation").cast("double").alias("size"), F.col("hedged").cast("int").cast("double").alias("hedge")).unpivot("series_id", ["size", "hedge"], "factor", "x")
    return book.active_exposure(h.weights(spark, sf), x)


@query("c30_active_exposure", f"WITH {_EXPOSURE} SELECT date, factor, r(exposure) AS exposure FROM e")
def exposures(spark, sf):
    return exposure(spark, sf)


@query("k27_variance_shares", f"""
WITH {_EXPOSURE}, f AS (SELECT * FROM (VALUES ('size', 'size', 0.04::DOUBLE), ('size', 'hedge', 0.01::DOUBLE), ('hedge', 'size', 0.01::DOUBLE), ('hedge', 'hedge', 0.09::DOUBLE)) AS v(a, b, cov)),
p AS (SELECT x.date, x.factor, sum(x.exposure * cov * y.exposure) AS part FROM e x JOIN f ON a = x.factor JOIN e y ON y.factor = b AND y.date = x.date GROUP BY 1, 2)
SELECT date, factor, CASE WHEN sum(part) OVER d <> 0 THEN r(part / sum(part) OVER d) END AS share FROM p WINDOW d AS (PARTITION BY date)""")
def shares(spark, sf):
    f = spark.createDataFrame([("size", "size", 0.04), ("size", "hedge", 0.01), ("hedge", "size", 0.01), ("hedge", "hedge", 0.09)], "a string, b string, cov double")
    return book.variance_shares(exposure(spark, sf), f)


@query("d13_positions", "SELECT date, count(*) FILTER (abs(w) > 0.01) AS n FROM weights GROUP BY 1")
def positions(spark, sf):
    return h.weights(spark, sf).groupBy("date").agg(F.count_if(F.abs("w") > 0.01).alias("n"))


@query("d14_breadth", "SELECT region, r(sum(score * fwd) / sum(score * score)) AS slope, r(pow(sum(score * fwd) / sum(score * score), 2)) AS breadth FROM scores JOIN meta USING (series_id) WHERE fwd IS NOT NULL GROUP BY 1")
def breadth(spark, sf):
    slope = stats.slope_through_origin(F.col("score"), F.col("fwd"))
    j = h.scores(spark, sf).where("fwd is not null").join(h.meta(spark, sf), "series_id")
    return j.groupBy("region").agg(slope.alias("slope"), F.pow(slope, 2).alias("breadth"))


@query("d16_required_ic", """
WITH g AS (SELECT l_linenumber AS horizon, l_discount AS ic, avg(l_quantity + l_discount * 10) AS mean FROM lineitem GROUP BY 1, 2),
s AS (SELECT *, lead(mean) OVER w AS nx, lead(ic) OVER w AS nic FROM g WINDOW w AS (PARTITION BY horizon ORDER BY ic)),
c AS (SELECT *, CASE WHEN mean < 26 AND nx >= 26 THEN ic + (26 - mean) / (nx - mean) * (nic - ic) END AS hit FROM s)
SELECT horizon, r(CASE WHEN max(mean) < 26 THEN max(ic) WHEN min(mean) >= 26 THEN min(ic) ELSE arg_min(hit, ic) FILTER (hit IS NOT NULL) END) AS ic,
CASE WHEN max(mean) < 26 THEN 'above' WHEN min(mean) >= 26 THEN 'below' WHEN count(hit) > 0 THEN 'inside' ELSE 'not monotone' END AS how FROM c GROUP BY 1""")
def required(spark, sf):
    g = h.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("horizon"), F.col("l_discount").alias("ic")).agg(F.avg(F.col("l_quantity") + F.col("l_discount") * 10).alias("mean"))
    return stats.required(g, 26.0)


@query("d18_summary_by_cell", "SELECT l_linenumber AS cell, count(*) AS n, r(avg(l_discount)) AS mean, r(min(l_discount)) AS low, r(max(l_discount)) AS high, r(avg((l_discount > 0.05)::INT)) AS share, bool_and(l_quantity > 0) AS all_positive FROM lineitem GROUP BY 1")
def summary(spark, sf):
    x = F.col("l_discount")
    return h.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("cell")).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg((x > 0.05).cast("int")).alias("share"), F.bool_and(F.col("l_quantity") > 0).alias("all_positive"))


@query("d17_value_counts", "SELECT string_agg(f || ':' || n, ';' ORDER BY n DESC, f) AS counts FROM (SELECT o_orderpriority AS f, count(*) AS n FROM orders GROUP BY 1)")
def value_counts(spark, sf):
    n = h.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("f")).agg(F.count("*").alias("n"))
    s = n.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "f", "n"))).alias("x"))  # one entry a distinct value
    return s.select(F.array_join(F.transform("x", lambda e: F.concat_ws(":", e["f"], e["n"])), ";").alias("counts"))


@query("d19_medians", "SELECT l_returnflag AS flag, r(median(l_quantity)) AS quantity, r(median(l_extendedprice)) AS price, r(quantile_cont(l_discount, 0.25)) AS q25, r(quantile_cont(l_discount, 0.75)) AS q75 FROM lineitem GROUP BY 1")
def medians(spark, sf):
    return h.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.median("l_quantity").alias("quantity"), F.median("l_extendedprice").alias("price"), F.percentile("l_discount", 0.25).alias("q25"), F.percentile("l_discount", 0.75).alias("q75"))


@query("d21_pivots", "SELECT l_linenumber AS line, r(avg(l_discount) FILTER (l_returnflag = 'A')) AS a, r(avg(l_discount) FILTER (l_returnflag = 'N')) AS n, r(avg(l_discount) FILTER (l_returnflag = 'R')) AS r0 FROM lineitem GROUP BY 1")
def pivots(spark, sf):
    p = h.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("line")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("l_discount"))
    return p.select("line", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r0"))


@query("d26_ols", "SELECT l_returnflag AS flag, r(regr_slope(l_extendedprice, l_quantity)) AS slope, r(sqrt((regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / (regr_count(l_extendedprice, l_quantity) - 2) / regr_sxx(l_extendedprice, l_quantity))) AS se, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem GROUP BY 1")
def ols(spark, sf):
    return h.table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(*stats.ols("l_quantity", "l_extendedprice")).drop("t")


@query("d27_ratio_quantiles", "SELECT series_id, r(quantile_cont(q, 0.1)) AS p10, r(median(q)) AS p50, r(quantile_cont(q, 0.9)) AS p90 FROM (SELECT series_id, level / rate AS q FROM levels JOIN meta USING (series_id) JOIN fx USING (currency, date) WHERE rate > 0.55) GROUP BY 1")
def ratios(spark, sf):
    j = h.levels(spark, sf).join(h.meta(spark, sf), "series_id").join(h.fx(spark, sf).where("rate > 0.55"), ["currency", "date"])
    q = F.percentile(F.col("level") / F.col("rate"), F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9)))
    return j.groupBy("series_id").agg(q.alias("q")).select("series_id", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p90"))


@query("d28_ratio_by_period", "SELECT series_id, r(median(level) FILTER (year(date) < 1997)) AS early, r(median(level) FILTER (year(date) BETWEEN 1997 AND 1998)) AS middle, r(median(level) FILTER (year(date) > 1998)) AS late FROM levels GROUP BY 1")
def by_period(spark, sf):
    bucket = F.when(F.year("date") < 1997, "early").when(F.year("date") <= 1998, "middle").otherwise("late")
    return h.levels(spark, sf).withColumn("b", bucket).groupBy("series_id").pivot("b", ["early", "middle", "late"]).agg(F.median("level"))


@query("d29_coverage_gaps", "SELECT series_id, min(date) AS first, max(date) AS last, (SELECT count(*) FROM fridays f WHERE f.date BETWEEN min(w.date) AND max(w.date)) - count(*) AS gaps FROM weekly w GROUP BY 1")
def gaps(spark, sf):
    n = h.weekly(spark, sf).groupBy("series_id").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("*").alias("n"))
    return n.select("series_id", "first", "last", (F.floor(F.datediff("last", "first") / 7) + 1 - F.col("n")).alias("gaps"))


@query("d31_vintage_coverage", "WITH g AS (SELECT *, knowledge_date - lag(knowledge_date) OVER (PARTITION BY series_id ORDER BY knowledge_date, period_end) AS gap FROM vintages) SELECT series_id, min(knowledge_date) AS first, max(knowledge_date) AS last, count(*) AS n, count(DISTINCT period_end) AS periods, max(gap)::INT AS widest FROM g GROUP BY 1")
def vintage_coverage(spark, sf):
    w = Window.partitionBy("series_id").orderBy("knowledge_date", "period_end")
    g = h.vintages(spark, sf).withColumn("gap", F.datediff("knowledge_date", F.lag("knowledge_date").over(w)))
    return g.groupBy("series_id").agg(F.min("knowledge_date").alias("first"), F.max("knowledge_date").alias("last"), F.count("*").alias("n"), F.count_distinct("period_end").alias("periods"), F.max("gap").alias("widest"))


@query("d33_mean_of_means", "SELECT region, r(avg(m)) AS mean, r(avg(n)) AS members FROM (SELECT region, date, avg(ret) AS m, count(DISTINCT series_id) AS n FROM weekly JOIN meta USING (series_id) GROUP BY 1, 2) GROUP BY 1")
def mean_of_means(spark, sf):
    w = h.weekly(spark, sf).join(h.meta(spark, sf), "series_id").groupBy("region", "date").agg(F.avg("ret").alias("m"), F.count_distinct("series_id").alias("n"))
    return w.groupBy("region").agg(F.avg("m").alias("mean"), F.avg("n").alias("members"))


@query("d35_stress_slices", """
WITH b AS (SELECT date, bench, ntile(2) OVER (ORDER BY date) AS half FROM bench WHERE bench IS NOT NULL), q AS (SELECT quantile_cont(abs(bench), 0.9) AS q FROM b)
SELECT half::INT AS half, r(avg(bench) FILTER (abs(bench) >= q)) AS stress, r(avg(bench)) AS all_weeks, count(*) FILTER (abs(bench) >= q) AS n FROM b, q GROUP BY 1""")
def slices(spark, sf):
    b = h.bench(spark, sf).where("bench is not null").withColumn("half", F.ntile(2).over(Window.orderBy("date")))  # one row a week
    q = b.agg(F.percentile(F.abs("bench"), 0.9).alias("q"))
    hit = F.abs("bench") >= F.col("q")
    return b.crossJoin(F.broadcast(q)).groupBy("half").agg(F.avg(F.when(hit, F.col("bench"))).alias("stress"), F.avg("bench").alias("all_weeks"), F.count_if(hit).alias("n"))  # one row of q


@query("d36_skill", "SELECT series_id, r(1 - sum((fwd - score) * (fwd - score)) / sum(fwd * fwd)) AS r2 FROM scores WHERE fwd IS NOT NULL GROUP BY 1")
def skill(spark, sf):
    e = F.col("fwd") - F.col("score")
    return h.scores(spark, sf).where("fwd is not null").groupBy("series_id").agg((1 - F.sum(e * e) / F.sum(F.col("fwd") * F.col("fwd"))).alias("r2"))


@query("d38_grouping_sets", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, r(avg(l_discount)) AS mean FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), (l_linestatus), ())")
def grouping_sets(spark, sf):
    li = h.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_discount")
    return li.cube("flag", "status").agg(F.count("*").alias("n"), F.avg("l_discount").alias("mean"))


@query("d40_factor_attribution", f"WITH {_EXPOSURE}, l AS (SELECT factor, date, exposure, lead(exposure) OVER (PARTITION BY factor ORDER BY date) AS nx FROM e) SELECT factor, r(avg(exposure)) AS mean, r(avg(exposure * nx) * 52) AS contribution FROM l GROUP BY 1")
def attribution(spark, sf):
    nx = F.lead("exposure").over(Window.partitionBy("factor").orderBy("date"))
    return exposure(spark, sf).withColumn("nx", nx).groupBy("factor").agg(F.avg("exposure").alias("mean"), (F.avg(F.col("exposure") * F.col("nx")) * 52).alias("contribution"))


@query("d41_largest_weight", "SELECT date, arg_max(series_id, k) AS series_id, r(max(w) * 1e4) AS bp FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY w, series_id DESC) AS k FROM weights) GROUP BY 1")
def largest(spark, sf):
    return h.weights(spark, sf).groupBy("date").agg(F.min_by("series_id", F.struct((-F.col("w")).alias("k"), "series_id")).alias("series_id"), (F.max("w") * 1e4).alias("bp"))


@query("d42_truth_decomposition", "WITH d AS (SELECT fwd, avg(fwd) OVER (PARTITION BY date) AS m FROM scores WHERE fwd IS NOT NULL) SELECT r(var_pop(m)) AS common, r(var_pop(fwd - m)) AS residual, count(*) AS n FROM d")
def decomposition(spark, sf):
    d = h.scores(spark, sf).where("fwd is not null").withColumn("m", F.avg("fwd").over(Window.partitionBy("date")))
    return d.agg(F.var_pop("m").alias("common"), F.var_pop(F.col("fwd") - F.col("m")).alias("residual"), F.count("*").alias("n"))


@query("d47_budget_ledger", "SELECT run_id, family, r(spent / 100.0::DOUBLE) AS spent, spent > 2e8 AS over FROM (SELECT run_id, family, sum(round(cost * 100)::BIGINT) OVER (PARTITION BY family ORDER BY ts, run_id) AS spent FROM runs)")
def ledger(spark, sf):
    s = F.sum(F.round(F.col("cost") * 100).cast("bigint")).over(Window.partitionBy("family").orderBy("ts", "run_id").rowsBetween(Window.unboundedPreceding, 0))
    return h.runs(spark, sf).select("run_id", "family", (s / 100.0).alias("spent"), (s > 2e8).alias("over"))


@query("k43_holm", "WITH s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1) * p AS x, row_number() OVER (ORDER BY p, test) AS k FROM pvals) SELECT test, r(p) AS p, r(least(max(x) OVER (ORDER BY k), 1)) AS holm FROM s")
def holm(spark, sf):
    return stats.holm(h.pvals(spark, sf))


@query("k44_benjamini_hochberg", "WITH s AS (SELECT *, count(*) OVER () * p / row_number() OVER (ORDER BY p, test) AS x, row_number() OVER (ORDER BY p, test) AS k FROM pvals) SELECT test, r(p) AS p, r(least(min(x) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1)) AS bh FROM s")
def bh(spark, sf):
    return stats.step_up(h.pvals(spark, sf), "bh")


@query("k44_benjamini_yekutieli", "WITH s AS (SELECT *, list_sum(list_transform(generate_series(1, count(*) OVER ()), lambda i: 1.0::DOUBLE / i)) * count(*) OVER () * p / row_number() OVER (ORDER BY p, test) AS x, row_number() OVER (ORDER BY p, test) AS k FROM pvals) SELECT test, r(p) AS p, r(least(min(x) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1)) AS by_p FROM s")
def by(spark, sf):
    return stats.step_up(h.pvals(spark, sf), "by_p", dependent=True)


_NULLS = "t AS (SELECT l_suppkey AS test, max(l_discount * l_quantity) AS t FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), n AS (SELECT o_custkey % 200 AS draw, l_suppkey AS test, max(l_discount * l_quantity) AS t0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber > 1 GROUP BY 1, 2)"


def draws(spark, sf):
    li = h.table(spark, sf, "lineitem")
    x = F.max(F.col("l_discount") * F.col("l_quantity"))
    t = li.where("l_linenumber = 1").groupBy(F.col("l_suppkey").alias("test")).agg(x.alias("t"))
    n = li.where("l_linenumber > 1").join(h.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy((F.col("o_custkey") % 200).alias("draw"), F.col("l_suppkey").alias("test")).agg(x.alias("t0"))
    return t, n


@query("k42_marginal_p", f"WITH {_NULLS} SELECT test, r((1 + count(*) FILTER (t0 >= t)) / (1 + count(*))) AS p FROM n JOIN t USING (test) GROUP BY test")
def marginal(spark, sf):
    return stats.marginal_p(*draws(spark, sf))


@query("k45_standardised_columns", f"WITH {_NULLS}, p AS (SELECT test, avg(x) AS m, stddev_samp(x) AS s FROM (SELECT test, t AS x FROM t UNION ALL SELECT test, t0 FROM n) GROUP BY 1) SELECT test, r((t - m) / s) AS t FROM t JOIN p USING (test)")
def standardised(spark, sf):
    return stats.standardised_columns(*draws(spark, sf))[0]


@query("k47_generalised_stepdown")
def generalised(spark, sf):
    t, n = stats.standardised_columns(*draws(spark, sf))
    family = (F.col("test") % 4).alias("family")
    return stats.gfwer(t.select(family, "test", "t"), n.select(family, "draw", "test", "t0"))


@query("k11_cross_region_covariance", """
WITH d AS (SELECT r.series_id, r.date, r.ret, m.region FROM returns r JOIN meta m USING (series_id)),
o AS (SELECT series_id, date, region, CASE WHEN count(ret) OVER w = 2 THEN product(1 + ret) OVER w - 1 END AS ret FROM d WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 1 PRECEDING)),
p AS (SELECT a.series_id AS a, b.series_id AS b, covar_samp(a.ret, b.ret) AS cov, count(*) AS n FROM d a JOIN d b ON a.date = b.date AND a.series_id <= b.series_id AND a.region = b.region WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2),
x AS (SELECT a.series_id AS a, b.series_id AS b, covar_samp(a.ret, b.ret) / 2 AS cov, count(*) AS n FROM o a JOIN o b ON a.date = b.date AND a.series_id < b.series_id AND a.region <> b.region WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2)
SELECT a, b, r(cov) AS cov, n FROM p WHERE n >= 60 UNION ALL SELECT a, b, r(cov), n FROM x WHERE n >= 60""")
def cross_region(spark, sf):
    return covariance.cross_region(h.returns(spark, sf), h.meta(spark, sf))


@query("k12_cross_region_pairs", "SELECT a.series_id AS a, b.series_id AS b FROM meta a JOIN meta b ON a.series_id < b.series_id AND a.region <> b.region")
def pairs(spark, sf):
    return covariance.cross_region_pairs(h.meta(spark, sf))


@query("k28_factor_covariance", """
WITH f AS (SELECT region, date, avg(ret) AS ret FROM weekly JOIN meta USING (series_id) GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY date DESC) AS k FROM f WHERE ret IS NOT NULL)
SELECT a.region AS a, b.region AS b, r(covar_pop(a.ret, b.ret)) AS cov FROM k a JOIN k b USING (date) WHERE a.k <= 156 AND b.k <= 156 GROUP BY 1, 2""")
def factor_covariance(spark, sf):
    f = h.weekly(spark, sf).join(h.meta(spark, sf), "series_id").groupBy(F.col("region").alias("factor"), "date").agg(F.avg("ret").alias("ret")).where("ret is not null")
    return covariance.trailing_pairs(f, 156)


@query("k18_effective_bets")
def bets(spark, sf):
    m = h.meta(spark, sf).select("series_id", F.col("region").alias("universe"))
    return covariance.shrunk_bets(h.weekly(spark, sf).join(m, "series_id"), present=0.5)


@query("k1_walk_forward")
def walk_forward(spark, sf):
    m = h.meta(spark, sf).select("series_id", F.col("region").alias("run_id"), book.bps(F.col("bucket"), book.HALF_SPREAD).alias("half_spread"), book.bps(F.col("bucket"), book.ANNUAL_DRAG).alias("drag"))

    def rule(date, week):
        score = week.rank(ascending=True)
        return score / score.sum()

    return book.walk_forward(h.returns(spark, sf).join(m, "series_id").select("run_id", "date", "series_id", "ret", "half_spread", "drag"), rule)
