"""Queries of windows along time, as-of reads and cross-sections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import asof, windows
from ..sources import hosted as h
from .registry import query

_W = "(PARTITION BY series_id ORDER BY date"


@query("e10_standardised", f"""
WITH s AS (SELECT *, count(score) OVER w AS n, avg(score) OVER w AS m, stddev_samp(score) OVER w AS sd FROM scores WINDOW w AS {_W} ROWS UNBOUNDED PRECEDING))
SELECT series_id, date, CASE WHEN n >= 20 AND sd > 0 AND score IS NOT NULL THEN r(least(greatest((score - m) / sd, -1.5), 1.5)) ELSE r(0.0) END AS z FROM s""")
def standardised(spark, sf):
    return windows.standardised(h.scores(spark, sf), 20, 1.5)


@query("e12_cross_sectional_views", """
SELECT series_id, date, CASE WHEN count(score) OVER d > 1 AND score IS NOT NULL THEN r(0.05 * (score - avg(score) OVER d)) ELSE r(0.0) END AS view FROM scores WINDOW d AS (PARTITION BY date)""")
def views(spark, sf):
    return windows.cross_sectional(h.scores(spark, sf).withColumnRenamed("score", "z"), F.lit(0.05))


@query("e13_sigma_population", f"SELECT series_id, date, CASE WHEN count(ret) OVER w = 26 THEN r(stddev_pop(ret) OVER w) END AS sigma FROM weekly WINDOW w AS {_W} ROWS 25 PRECEDING)")
def sigma_pop(spark, sf):
    return windows.rolling_sigma(h.weekly(spark, sf), 26, True)


@query("e14_trailing_volatility", f"SELECT series_id, date, CASE WHEN count(ret) OVER w = 26 THEN r(stddev_samp(ret) OVER w) END AS sigma FROM weekly WINDOW w AS {_W} ROWS 25 PRECEDING)")
def sigma_samp(spark, sf):
    return windows.rolling_sigma(h.weekly(spark, sf), 26, False)


_ACTIVE = "a AS (SELECT w.series_id, w.date, w.ret - b.bench AS active FROM weekly w JOIN bench b USING (date) WHERE w.ret IS NOT NULL)"


def active(spark, sf):
    return windows.active_returns(h.weekly(spark, sf).where("ret is not null"), h.bench(spark, sf))


@query("e15_tracking_error", f"WITH {_ACTIVE} SELECT series_id, date, CASE WHEN count(active) OVER w = 52 THEN r(stddev_samp(active) OVER w * sqrt(52)) END AS te FROM a WINDOW w AS {_W} ROWS 51 PRECEDING)")
def tracking(spark, sf):
    return windows.tracking_error(active(spark, sf), 52)


@query("e16_forward_active", f"""
WITH x AS (SELECT series_id, date, ret, bench FROM weekly JOIN bench USING (date) WHERE ret > -0.95)
SELECT series_id, date, CASE WHEN count(ret) OVER w = 4 AND count(bench) OVER w = 4 THEN r(exp(sum(ln(1 + ret)) OVER w) - exp(sum(ln(1 + bench)) OVER w)) END AS fwd FROM x WINDOW w AS {_W} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)""")
def forward(spark, sf):
    x = h.weekly(spark, sf).where("ret > -0.95").join(h.bench(spark, sf), "date").select("series_id", "date", "ret", "bench")
    return windows.forward_active(x, 4)


@query("e17_forward_sum", f"SELECT series_id, date, CASE WHEN count(ret) OVER w = 4 THEN r(sum(ret) OVER w) END AS fwd FROM weekly WINDOW w AS {_W} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING)")
def forward_sum(spark, sf):
    return windows.forward_sum(h.weekly(spark, sf), 4)


@query("e18_drawdown", f"""
WITH {_ACTIVE}, g AS (SELECT series_id, date, product(1 + active / 100) OVER {_W}) AS wealth FROM a)
SELECT series_id, date, r(wealth) AS wealth, r(wealth / max(wealth) OVER {_W}) - 1) AS drawdown FROM g""")
def drawdown(spark, sf):
    return windows.drawdown(active(spark, sf).withColumn("active", F.col("active") / 100))


@query("e19_turnover_quantile", f"""
WITH t AS (SELECT series_id, date, CASE WHEN count(w) OVER x = 26 THEN sum(w) OVER x END AS total FROM weights WINDOW x AS {_W} ROWS 25 PRECEDING))
SELECT series_id, r(quantile_cont(total, 0.95)) AS q95, r(max(total)) AS top FROM t GROUP BY 1""")
def turnover_quantile(spark, sf):
    t = windows.rolling_sum(h.weights(spark, sf), "w", 26)
    return t.groupBy("series_id").agg(F.percentile("total", 0.95).alias("q95"), F.max("total").alias("top"))


@query("e20_trailing_turnover", f"SELECT series_id, date, r(avg(w) OVER {_W} ROWS 51 PRECEDING) * 52) AS annual FROM weights")
def trailing_turnover(spark, sf):
    return h.weights(spark, sf).select("series_id", "date", (F.avg("w").over(windows.trailing(52)) * 52).alias("annual"))


@query("e21_prefilled_turnover", f"SELECT series_id, date, r(coalesce(sum(w) OVER x, 0) + (51 - count(w) OVER x) / 52.0::DOUBLE) AS total FROM weights WINDOW x AS {_W} ROWS 50 PRECEDING)")
def prefilled(spark, sf):
    return windows.prefilled_sum(h.weights(spark, sf), "w", 52, 1.0 / 52)


@query("e22_first_full_window", f"""
WITH c AS (SELECT date, count(*) FILTER (ret IS NOT NULL) >= 70 AS ok FROM weekly GROUP BY 1),
k AS (SELECT date, sum(ok::INT) OVER (ORDER BY date ROWS 12 PRECEDING) AS n FROM c) SELECT min(date) AS first FROM k WHERE n >= 13""")
def first_full(spark, sf):
    c = h.weekly(spark, sf).groupBy("date").agg((F.count("ret") >= 70).cast("int").alias("ok"))
    k = c.withColumn("n", F.sum("ok").over(Window.orderBy("date").rowsBetween(-12, 0)))  # one row a week
    return k.where("n >= 13").agg(F.min("date").alias("first"))


@query("e23_valid_windows", f"SELECT series_id, date, count(ret) OVER w AS n, count(ret) OVER w >= 104 AS ok FROM weekly WINDOW w AS {_W} ROWS 155 PRECEDING)")
def valid(spark, sf):
    return windows.valid_windows(h.weekly(spark, sf), 156, 104)


@query("e24_robust_scale", f"""
WITH w AS (SELECT series_id, date, list(ret) FILTER (ret IS NOT NULL) OVER {_W} ROWS 12 PRECEDING) AS xs FROM weekly),
m AS (SELECT *, list_median(xs) AS m FROM w) SELECT series_id, date, r(1.4826 * list_median(list_transform(xs, lambda x: abs(x - m)))) AS scale FROM m""")
def robust(spark, sf):
    return windows.robust_scale(h.weekly(spark, sf), 13)


@query("e25_explained_share", f"""
WITH x AS (SELECT w.series_id, w.date, ret AS y, bench AS f FROM weekly w JOIN bench USING (date) WHERE ret IS NOT NULL),
b AS (SELECT *, CASE WHEN count(y) OVER w >= 26 THEN sum(y * f) OVER w / sum(f * f) OVER w END AS beta FROM x WINDOW w AS {_W} ROWS 51 PRECEDING)),
p AS (SELECT series_id, date, y, lag(beta) OVER {_W}) * f AS p FROM b),
v AS (SELECT series_id, date, CASE WHEN p IS NOT NULL THEN y END AS y, p FROM p)
SELECT series_id, date, CASE WHEN count(y) OVER w >= 26 THEN r(1 - sum((y - p) * (y - p)) OVER w / sum(y * y) OVER w) END AS share FROM v WINDOW w AS {_W} ROWS 51 PRECEDING)""")
def explained(spark, sf):
    x = h.weekly(spark, sf).where("ret is not null").join(h.bench(spark, sf), "date").select("series_id", "date", F.col("ret").alias("y"), F.col("bench").alias("f"))
    w = windows.trailing(52)
    beta = F.when(F.count("y").over(w) >= 26, F.sum(F.col("y") * F.col("f")).over(w) / F.sum(F.col("f") * F.col("f")).over(w))
    p = x.withColumn("beta", beta).withColumn("p", F.lag("beta").over(windows.of_series()) * F.col("f")).withColumn("y", F.when(F.col("p").isNotNull(), F.col("y")))
    left = F.col("y") - F.col("p")
    return p.select("series_id", "date", F.when(F.count("y").over(w) >= 26, 1 - F.sum(left * left).over(w) / F.sum(F.col("y") * F.col("y")).over(w)).alias("share"))


@query("e27_level_changes", """
WITH b AS (SELECT l.series_id, f.date AS d, max_by(l.level, l.date) AS level FROM levels l JOIN fridays f ON l.date <= f.date AND l.date > f.date - 7 GROUP BY 1, 2),
g AS (SELECT s.series_id, f.date, b.level FROM (SELECT DISTINCT series_id FROM levels) s CROSS JOIN fridays f LEFT JOIN b ON b.series_id = s.series_id AND b.d = f.date)
SELECT series_id, date, r(level - lag(level) OVER o) AS change, r(ln(level / lag(level) OVER o)) AS log_change FROM g WINDOW o AS (PARTITION BY series_id ORDER BY date)""")
def level_changes(spark, sf):
    from ..operators.panel import weekly_levels

    g = weekly_levels(h.levels(spark, sf), h.fridays(spark, sf))
    was = F.lag("level").over(windows.of_series())
    return g.select("series_id", "date", (F.col("level") - was).alias("change"), F.log(F.col("level") / was).alias("log_change"))


@query("e29_volatility_scalar", """
WITH a AS (SELECT series_id, ret, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) - 1 AS age FROM weekly WHERE ret IS NOT NULL)
SELECT series_id, r(sqrt(sum(pow(0.5, age / 26.0::DOUBLE) * ret * ret) / sum(pow(0.5, age / 26.0::DOUBLE)) / avg(ret * ret))) AS scalar FROM a WHERE age < 156 GROUP BY 1""")
def scalar(spark, sf):
    age = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("date"))) - 1
    a = h.weekly(spark, sf).where("ret is not null").withColumn("age", age).where("age < 156")
    k, v = F.pow(F.lit(0.5), F.col("age") / 26.0), F.col("ret") * F.col("ret")
    return a.groupBy("series_id").agg(F.sqrt(F.sum(k * v) / F.sum(k) / F.avg(v)).alias("scalar"))


@query("e30_ewma_weights", "WITH a AS (SELECT series_id, date, pow(0.5, (row_number() OVER (PARTITION BY series_id ORDER BY date DESC) - 1) / 26.0::DOUBLE) AS raw FROM weekly) SELECT series_id, date, r(raw / sum(raw) OVER (PARTITION BY series_id)) AS weight FROM a")
def ewma(spark, sf):
    return windows.ewma_weights(h.weekly(spark, sf), 26.0)


@query("e31_rolling_corr", f"""
WITH x AS (SELECT w.series_id, w.date, ret, bench FROM weekly w JOIN bench USING (date) WHERE ret IS NOT NULL)
SELECT series_id, date, CASE WHEN count(ret) OVER w = 52 THEN r(corr(ret, bench) OVER w) END AS corr FROM x WINDOW w AS {_W} ROWS 51 PRECEDING)""")
def rolling_corr(spark, sf):
    x = h.weekly(spark, sf).where("ret is not null").join(h.bench(spark, sf), "date")
    return windows.rolling_corr(x, "ret", "bench", 52)


@query("e33_mean_abs_change", """
WITH c AS (SELECT series_id, abs(w - lag(w, 4) OVER (PARTITION BY series_id ORDER BY date)) AS c FROM weights) SELECT r(avg(m)) AS change FROM (SELECT series_id, avg(c) AS m FROM c GROUP BY 1)""")
def abs_change(spark, sf):
    c = h.weights(spark, sf).select("series_id", F.abs(F.col("w") - F.lag("w", 4).over(windows.of_series())).alias("c"))
    return c.groupBy("series_id").agg(F.avg("c").alias("m")).agg(F.avg("m").alias("change"))


@query("e34_autocorrelation", "SELECT series_id, r(corr(ret, was)) AS auto FROM (SELECT series_id, ret, lag(ret, 1) OVER (PARTITION BY series_id ORDER BY date) AS was FROM weekly) GROUP BY 1")
def autocorr(spark, sf):
    lagged = h.weekly(spark, sf).withColumn("was", F.lag("ret", 1).over(windows.of_series()))
    return lagged.groupBy("series_id").agg(F.corr("ret", "was").alias("auto"))


@query("e36_realised_ic", """
WITH p AS (SELECT date, score, fwd FROM scores WHERE score IS NOT NULL AND fwd IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0::DOUBLE AS rs, rank() OVER (PARTITION BY date ORDER BY fwd) + (count(*) OVER (PARTITION BY date, fwd) - 1) / 2.0::DOUBLE AS rf FROM p),
d AS (SELECT date, corr(score, fwd) AS c, corr(rs, rf) AS s FROM k GROUP BY 1 HAVING count(*) >= 5 AND stddev_pop(score) > 1e-12 AND stddev_pop(fwd) > 1e-12)
SELECT (SELECT r(corr(score, fwd)) FROM p) AS pooled, r(avg(c)) AS per_date, r(avg(s)) AS rank_ic, count(*) AS dates FROM d""")
def ic(spark, sf):
    return windows.realised_ic(h.scores(spark, sf))


@query("e40_standardised_truth", """
WITH d AS (SELECT series_id, date, fwd - avg(fwd) OVER (PARTITION BY date) AS x FROM scores WHERE fwd IS NOT NULL)
SELECT series_id, date, r(round((x - (SELECT avg(x) FROM d)) / (SELECT stddev_pop(x) FROM d), 12)) AS z FROM d""")
def truth(spark, sf):
    d = h.scores(spark, sf).where("fwd is not null").withColumn("x", F.col("fwd") - F.avg("fwd").over(Window.partitionBy("date")))
    of = d.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return d.crossJoin(F.broadcast(of)).select("series_id", "date", F.round((F.col("x") - F.col("m")) / F.col("s"), 12).alias("z"))  # one row of moments


@query("e41_transfer", "SELECT r(avg(c)) AS transfer FROM (SELECT date, corr(w, score) AS c FROM weights JOIN scores USING (date, series_id) GROUP BY 1)")
def transfer(spark, sf):
    j = h.weights(spark, sf).join(h.scores(spark, sf), ["date", "series_id"])
    return j.groupBy("date").agg(F.corr("w", "score").alias("c")).agg(F.avg("c").alias("transfer"))


@query("e43_first_trade", "SELECT series_id, min(date) AS first, r(arg_min(w, date)) AS w FROM weights WHERE w > 0.02 GROUP BY 1")
def first_trade(spark, sf):
    return h.weights(spark, sf).where("w > 0.02").groupBy("series_id").agg(F.min("date").alias("first"), F.min_by("w", "date").alias("w"))


@query("e46_subsampled_changes", """
WITH f AS (SELECT currency, date, rate, row_number() OVER (PARTITION BY currency ORDER BY date) AS k FROM fx WHERE isodow(date) = 5)
SELECT currency, r(corr(d1, l1)) AS auto, r(stddev_samp(d4)) AS sd4, count(*) FILTER (k % 4 = 0) AS every4 FROM (SELECT *, lag(d1) OVER (PARTITION BY currency ORDER BY date) AS l1 FROM (
SELECT *, ln(rate / lag(rate) OVER w) AS d1, ln(rate / lag(rate, 4) OVER w) AS d4 FROM f WINDOW w AS (PARTITION BY currency ORDER BY date))) GROUP BY 1""")
def subsampled(spark, sf):
    w = Window.partitionBy("currency").orderBy("date")
    f = h.fx(spark, sf).where(F.weekday("date") == 4).withColumn("k", F.row_number().over(w)).withColumn("d1", F.log(F.col("rate") / F.lag("rate").over(w))).withColumn("d4", F.log(F.col("rate") / F.lag("rate", 4).over(w)))
    return f.withColumn("l1", F.lag("d1").over(w)).groupBy("currency").agg(F.corr("d1", "l1").alias("auto"), F.stddev_samp("d4").alias("sd4"), F.count_if(F.col("k") % 4 == 0).alias("every4"))


@query("c17_as_of", "SELECT series_id, period_end, r(arg_max(value, knowledge_date)) AS value FROM vintages WHERE knowledge_date <= DATE '2024-01-20' AND value IS NOT NULL GROUP BY 1, 2")
def as_of(spark, sf):
    return asof.as_of(h.vintages(spark, sf), "2024-01-20")


@query("c18_latest_as_of", "WITH a AS (SELECT series_id, period_end, arg_max(value, knowledge_date) AS value FROM vintages WHERE knowledge_date <= DATE '2024-01-20' GROUP BY 1, 2) SELECT series_id, max(period_end) AS period_end, r(arg_max(value, period_end)) AS value FROM a GROUP BY 1")
def latest(spark, sf):
    return asof.latest_as_of(h.vintages(spark, sf), "2024-01-20")


@query("c19_usage_log", "SELECT series_id, period_end, knowledge_date, DATE '2024-01-20' AS used_on_date FROM vintages WHERE knowledge_date <= DATE '2024-01-20'")
def usage(spark, sf):
    return asof.usage_log(h.vintages(spark, sf), "2024-01-20")


@query("c19_as_of_many_dates", """
WITH d AS (SELECT CAST(unnest(generate_series(DATE '2024-01-05', DATE '2024-02-02', INTERVAL 7 DAY)) AS DATE) AS date),
k AS (SELECT s.series_id, d.date, v.period_end, v.value, row_number() OVER (PARTITION BY s.series_id, d.date ORDER BY v.period_end DESC, v.knowledge_date DESC) AS k
      FROM (SELECT DISTINCT series_id FROM vintages) s CROSS JOIN d LEFT JOIN vintages v ON v.series_id = s.series_id AND v.knowledge_date <= d.date)
SELECT series_id, date, period_end, r(value) AS value FROM k WHERE k = 1""")
def many(spark, sf):
    dates = spark.sql("select explode(sequence(date'2024-01-05', date'2024-02-02', interval 7 days)) as date")
    return asof.as_of_many(h.vintages(spark, sf), dates)


@query("c20_as_of_tolerance", """
WITH k AS (SELECT series_id, date, level FROM levels WHERE day(date) % 5 = 0)
SELECT w.series_id, w.date, CASE WHEN w.date - k.date <= 6 THEN k.date END AS at, CASE WHEN w.date - k.date <= 6 THEN r(k.level) END AS value FROM weights w ASOF LEFT JOIN k ON w.series_id = k.series_id AND w.date >= k.date""")
def tolerance(spark, sf):
    right = h.levels(spark, sf).where(F.dayofmonth("date") % 5 == 0).withColumnRenamed("level", "value")
    return asof.nearest_before(h.weights(spark, sf), right, "series_id", 6)


@query("k65_lookahead", """
SELECT series_id, count(*) AS breaches FROM (SELECT series_id, knowledge_date, period_end + 20 AS used_on_date, CASE WHEN day(period_end) % 9 <> 0 THEN period_end END AS fitted_through FROM vintages)
WHERE used_on_date < knowledge_date OR NOT coalesce(fitted_through <= used_on_date, false) GROUP BY 1""")
def lookahead(spark, sf):
    v = h.vintages(spark, sf).select("series_id", "knowledge_date", F.date_add("period_end", 20).alias("used_on_date"), F.when(F.dayofmonth("period_end") % 9 != 0, F.col("period_end")).alias("fitted_through"))
    return asof.lookahead_breaches(v).groupBy("series_id").agg(F.count("*").alias("breaches"))
