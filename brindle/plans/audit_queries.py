"""Queries of audits: predicates on metadata, paired comparisons, correlations, attribution and vetoes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import book, factors, lifecycle, panel, rule, stats, vetoes, windows
from ..operators.lineage import cut
from ..sources import hosted as h
from .registry import query
from .stat_queries import _EXPOSURE, exposure
from .window_queries import _ACTIVE, _W, active


@query("b8_development_window", "SELECT date, count(*) AS n FROM levels WHERE date >= DATE '1996-01-05' AND date <= DATE '1999-12-27' GROUP BY 1")
def window(spark, sf):
    return panel.clipped(h.levels(spark, sf), "1996-01-05", "1999-12-27").groupBy("date").agg(F.count("*").alias("n"))


@query("b12_region_universe", "SELECT region, list_sort(list(series_id)) AS members FROM meta WHERE NOT hedged GROUP BY 1")
def universe(spark, sf):
    return h.meta(spark, sf).where("not hedged").groupBy("region").agg(F.array_sort(F.collect_list("series_id")).alias("members"))


@query("b15_meta_rows", "SELECT * FROM meta")
def meta_rows(spark, sf):
    return h.meta(spark, sf).orderBy("series_id")


@query("b20_dropped_fields", "SELECT series_id, field, r(value) AS value FROM (SELECT series_id, tier, max(level) AS oas, min(level) AS oad FROM levels JOIN meta USING (series_id) GROUP BY 1, 2) UNPIVOT (value FOR field IN (oas, oad)) WHERE NOT (tier = 'second' AND field = 'oas')")
def dropped(spark, sf):
    x = h.levels(spark, sf).join(h.meta(spark, sf), "series_id").groupBy("series_id", "tier").agg(F.max("level").alias("oas"), F.min("level").alias("oad"))
    return x.unpivot(["series_id", "tier"], ["oas", "oad"], "field", "value").where("not (tier = 'second' and field = 'oas')").drop("tier")


@query("b21_point_ids", "SELECT p_partkey, CASE WHEN strpos(p_type, ' ') > 0 THEN p_brand || '|' || substr(p_type, strpos(p_type, ' ') + 1) END AS point FROM part")
def points(spark, sf):
    _, rest = scalars.split_first(F.col("p_type"), " ")
    return h.table(spark, sf, "part").select("p_partkey", F.concat(F.col("p_brand"), F.lit("|"), rest).alias("point"))


@query("b31_selected_instruments", "SELECT series_id FROM meta WHERE NOT hedged AND tier IN ('backbone', 'second') AND bucket IS NOT NULL")
def selected(spark, sf):
    return h.meta(spark, sf).where("not hedged and bucket is not null").where(F.col("tier").isin("backbone", "second")).select("series_id")


@query("b34_without_validation", "SELECT run_id FROM runs WHERE status <> 'P'")
def without_validation(spark, sf):
    return h.runs(spark, sf).where("status <> 'P'").select("run_id")


@query("c4_pivoted_with_measured", "SELECT s.series_id, s.date, r(max(s.q) FILTER (s.f = 'w')) AS w, r(max(s.q) FILTER (s.f = 's')) AS s, r(any_value(k.ret)) AS measured FROM (SELECT series_id, date, 'w' AS f, w AS q FROM weights UNION ALL SELECT series_id, date, 's', score FROM scores) s LEFT JOIN weekly k USING (series_id, date) GROUP BY 1, 2")
def pivoted(spark, sf):
    long = h.weights(spark, sf).select("series_id", "date", F.lit("w").alias("f"), F.col("w").alias("q")).unionByName(h.scores(spark, sf).select("series_id", "date", F.lit("s").alias("f"), F.col("score").alias("q")))
    return long.groupBy("series_id", "date").pivot("f", ["w", "s"]).agg(F.max("q")).join(h.weekly(spark, sf).withColumnRenamed("ret", "measured"), ["series_id", "date"], "left")


@query("c12_medians_side_by_side", "SELECT series_id, r(a) AS a, r(b) AS b FROM (SELECT series_id, median(level) AS a FROM levels GROUP BY 1) JOIN (SELECT series_id, median(w) AS b FROM weights GROUP BY 1) USING (series_id)")
def side_by_side(spark, sf):
    a = h.levels(spark, sf).groupBy("series_id").agg(F.median("level").alias("a"))
    return a.join(h.weights(spark, sf).groupBy("series_id").agg(F.median("w").alias("b")), "series_id")


@query("c14_bucket_precedence", "SELECT m.series_id, coalesce(o.bucket, m.bucket, 'high') AS bucket FROM meta m LEFT JOIN (SELECT series_id, 'low' AS bucket FROM meta WHERE market = 'M3') o USING (series_id)")
def precedence(spark, sf):
    m = h.meta(spark, sf)
    o = m.where("market = 'M3'").select("series_id", F.lit("low").alias("override"))
    return m.join(o, "series_id", "left").select("series_id", F.coalesce("override", "bucket", F.lit("high")).alias("bucket"))


@query("c22_period_of_day", "SELECT r.series_id, r.date, f.date AS period FROM returns r JOIN fridays f ON r.date <= f.date AND r.date > f.date - 7")
def period_of_day(spark, sf):
    return panel.in_periods(h.returns(spark, sf), h.fridays(spark, sf), "period").select("series_id", "date", "period")


@query("c32_semi_and_anti", "SELECT series_id, series_id IN (SELECT series_id FROM weights WHERE w > 0.03) AS held FROM meta")
def semi_anti(spark, sf):
    m, big = h.meta(spark, sf).select("series_id"), h.weights(spark, sf).where("w > 0.03")
    return m.join(big, "series_id", "left_semi").withColumn("held", F.lit(True)).unionByName(m.join(big, "series_id", "left_anti").withColumn("held", F.lit(False)))


@query("d5_relative_factor", "SELECT region, date, r(avg(ret) - any_value(b.bench)) AS rel FROM weekly JOIN meta USING (series_id) JOIN bench b USING (date) WHERE market <> '' GROUP BY 1, 2")
def relative(spark, sf):
    j = h.weekly(spark, sf).join(h.meta(spark, sf).where("market <> ''"), "series_id").join(h.bench(spark, sf), "date")
    return j.groupBy("region", "date").agg((F.avg("ret") - F.first("bench")).alias("rel"))


@query("d12_path_summary", f"WITH {_ACTIVE} SELECT series_id, count(*) AS n, r(avg(active) * 52) AS mean, r(stddev_samp(active) * sqrt(52)) AS te, r(min(active)) AS worst, r(max(active)) AS best, r(avg((active > 0)::INT)) AS hit FROM a GROUP BY 1")
def path_summary(spark, sf):
    x = F.col("active")
    return active(spark, sf).groupBy("series_id").agg(F.count("*").alias("n"), (F.avg(x) * 52).alias("mean"), (F.stddev_samp(x) * F.sqrt(F.lit(52))).alias("te"), F.min(x).alias("worst"), F.max(x).alias("best"), F.avg((x > 0).cast("int")).alias("hit"))


@query("d25_sign_shares", "WITH c AS (SELECT l_linenumber AS cell, l_suppkey AS f, avg(l_discount - 0.05) AS c FROM lineitem GROUP BY 1, 2), m AS (SELECT *, avg(c) OVER (PARTITION BY cell) AS m FROM c) SELECT cell, r(any_value(m)) AS mean, count(*) FILTER (sign(c) = sign(m)) AS same, r(avg((c > 0)::INT)) AS share FROM m GROUP BY 1")
def sign_shares(spark, sf):
    c = h.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("cell"), "l_suppkey").agg(F.avg(F.col("l_discount") - 0.05).alias("c"))
    m = c.withColumn("m", F.avg("c").over(Window.partitionBy("cell")))
    return m.groupBy("cell").agg(F.first("m").alias("mean"), F.count_if(F.signum("c") == F.signum("m")).alias("same"), F.avg((F.col("c") > 0).cast("int")).alias("share"))


@query("d30_duration_times_spread", "SELECT l.series_id, r(median(l.level / b.level)) AS ratio FROM levels l JOIN levels b ON b.date = l.date AND b.series_id = 'S1' GROUP BY 1")
def times_spread(spark, sf):
    x = h.levels(spark, sf)
    b = x.where("series_id = 'S1'").select("date", F.col("level").alias("base"))
    return x.join(b, "date").groupBy("series_id").agg(F.median(F.col("level") / F.col("base")).alias("ratio"))


@query("d32_weekly_coverage", "SELECT series_id, min(date) AS first, max(date) AS last, ((max(date) - min(date)) / 7 + 1 - count(*))::BIGINT AS missing FROM weights GROUP BY 1".replace("(max(date) - min(date)) / 7", "(max(date) - min(date)) // 7"))
def weekly_coverage(spark, sf):
    return h.weights(spark, sf).groupBy("series_id").agg(F.min("date").alias("first"), F.max("date").alias("last"), (F.floor(F.datediff(F.max("date"), F.min("date")) / 7) + 1 - F.count("*")).alias("missing"))


@query("d34_weekly_differentials", "SELECT date, r(avg(score - fwd)) AS diff, count(*) AS n FROM scores WHERE fwd IS NOT NULL GROUP BY 1")
def differentials(spark, sf):
    return h.scores(spark, sf).where("fwd is not null").groupBy("date").agg(F.avg(F.col("score") - F.col("fwd")).alias("diff"), F.count("*").alias("n"))


@query("d43_path_report", f"WITH {_ACTIVE}, t AS (SELECT *, CASE WHEN count(active) OVER w = 26 THEN stddev_samp(active) OVER w * sqrt(52) END AS te FROM a WINDOW w AS {_W} ROWS 25 PRECEDING)) SELECT series_id, r(quantile_cont(te, 0.9) FILTER (year(date) <> 1998)) AS q90, arg_max(date, te) AS peak, r(max(te)) AS top FROM t WHERE te IS NOT NULL GROUP BY 1")
def path_report(spark, sf):
    t = windows.tracking_error(active(spark, sf), 26).where("te is not null")
    return t.groupBy("series_id").agg(F.percentile(F.when(F.year("date") != 1998, F.col("te")), 0.9).alias("q90"), F.max_by("date", "te").alias("peak"), F.max("te").alias("top"))


@query("d48_distinct", "SELECT count(DISTINCT p_brand) AS brands, count(DISTINCT p_type) AS types, (SELECT count(*) FROM (SELECT DISTINCT p_brand, p_type FROM part)) AS pairs FROM part")
def distinct(spark, sf):
    return h.table(spark, sf, "part").agg(F.count_distinct("p_brand").alias("brands"), F.count_distinct("p_type").alias("types"), F.count_distinct("p_brand", "p_type").alias("pairs"))


@query("d49_all_and_any", "SELECT series_id, bool_and(level > 900) AS all_high, bool_or(level > 2000) AS any_high FROM levels GROUP BY 1")
def all_any(spark, sf):
    return h.levels(spark, sf).groupBy("series_id").agg(F.bool_and(F.col("level") > 900).alias("all_high"), F.bool_or(F.col("level") > 2000).alias("any_high"))


@query("e11_view_scale", f"WITH s AS (SELECT series_id, date, CASE WHEN count(ret) OVER w = 26 THEN stddev_pop(ret) OVER w END AS sigma FROM weekly WINDOW w AS {_W} ROWS 25 PRECEDING)) SELECT series_id, date, r(0.05 * sigma * (score - 25) / 10 / sqrt(7)) AS view FROM s JOIN scores USING (series_id, date)")
def view_scale(spark, sf):
    j = windows.rolling_sigma(h.weekly(spark, sf), 26, True).join(h.scores(spark, sf), ["series_id", "date"])
    return j.select("series_id", "date", scalars.view_scale(0.05, F.col("sigma"), (F.col("score") - 25) / 10, F.lit(7.0)).alias("view"))


@query("e26_full_sample_share", "SELECT series_id, r(1 - sum((ret - bench) * (ret - bench)) / sum(ret * ret)) AS share FROM weekly JOIN bench USING (date) WHERE ret IS NOT NULL GROUP BY 1")
def full_share(spark, sf):
    e = F.col("ret") - F.col("bench")
    return h.weekly(spark, sf).where("ret is not null").join(h.bench(spark, sf), "date").groupBy("series_id").agg((1 - F.sum(e * e) / F.sum(F.col("ret") * F.col("ret"))).alias("share"))


@query("e28_log_change", "SELECT currency, date, r(ln(rate / lag(rate) OVER (PARTITION BY currency ORDER BY date))) AS x FROM fx")
def log_change(spark, sf):
    return h.fx(spark, sf).select("currency", "date", F.log(F.col("rate") / F.lag("rate").over(Window.partitionBy("currency").orderBy("date"))).alias("x"))


@query("e32_factor_correlations", """
WITH f AS (SELECT region, date, avg(ret) AS x FROM weekly JOIN meta USING (series_id) WHERE ret IS NOT NULL GROUP BY 1, 2), p AS (SELECT a.region AS a, b.region AS b, a.date, a.x, b.x AS y FROM f a JOIN f b ON a.date = b.date AND a.region < b.region),
k AS (SELECT *, CASE WHEN count(*) OVER w = 52 THEN corr(x, y) OVER w END AS c FROM p WINDOW w AS (PARTITION BY a, b ORDER BY date ROWS 51 PRECEDING)) SELECT a, b, r(corr(x, y)) AS whole, r(min(c)) AS low, r(max(c)) AS high FROM k GROUP BY 1, 2""")
def correlations(spark, sf):
    f = h.weekly(spark, sf).where("ret is not null").join(h.meta(spark, sf), "series_id").groupBy("region", "date").agg(F.avg("ret").alias("x"))
    p = f.withColumnRenamed("region", "a").join(f.select(F.col("region").alias("b"), "date", F.col("x").alias("y")), "date").where("a < b")
    w = Window.partitionBy("a", "b").orderBy("date").rowsBetween(-51, 0)
    k = p.withColumn("c", F.when(F.count("*").over(w) == 52, F.corr("x", "y").over(w)))
    return k.groupBy("a", "b").agg(F.corr("x", "y").alias("whole"), F.min("c").alias("low"), F.max("c").alias("high"))


@query("e35_per_date_pearson", "WITH d AS (SELECT date, score - avg(score) OVER d AS x, fwd - avg(fwd) OVER d AS y FROM scores WINDOW d AS (PARTITION BY date)), c AS (SELECT date, corr(x, y) AS c FROM d WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1 HAVING count(*) >= 5 AND stddev_pop(x) > 1e-12 AND stddev_pop(y) > 1e-12) SELECT r(avg(c)) AS mean, count(*) AS dates FROM c")
def per_date(spark, sf):
    w = Window.partitionBy("date")
    d = h.scores(spark, sf).select("date", (F.col("score") - F.avg("score").over(w)).alias("x"), (F.col("fwd") - F.avg("fwd").over(w)).alias("y")).where("x is not null and y is not null")
    c = d.groupBy("date").agg(F.corr("x", "y").alias("c"), F.count("*").alias("n"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy")).where("n >= 5 and sx > 1e-12 and sy > 1e-12")
    return c.agg(F.avg("c").alias("mean"), F.count("*").alias("dates"))


@query("e37_per_series_ic", "SELECT r(avg(c)) AS mean, count(c) AS n FROM (SELECT series_id, CASE WHEN count(*) >= 3 THEN corr(score, fwd) END AS c FROM scores WHERE fwd IS NOT NULL GROUP BY 1)")
def per_series(spark, sf):
    c = h.scores(spark, sf).where("fwd is not null").groupBy("series_id").agg(F.when(F.count("*") >= 3, F.corr("score", "fwd")).alias("c"))
    return c.agg(F.avg("c").alias("mean"), F.count("c").alias("n"))


@query("e44_next_week", "SELECT series_id, date, r(lead(ret) OVER o) AS next, lead(date) OVER o AS next_date FROM weekly WINDOW o AS (PARTITION BY series_id ORDER BY date)")
def next_week(spark, sf):
    w = windows.of_series()
    return h.weekly(spark, sf).select("series_id", "date", F.lead("ret").over(w).alias("next"), F.lead("date").over(w).alias("next_date"))


@query("e45_lagged_risk", f"WITH {_ACTIVE}, t AS (SELECT *, CASE WHEN count(active) OVER w = 26 THEN stddev_samp(active) OVER w * sqrt(52) END AS te FROM a WINDOW w AS {_W} ROWS 25 PRECEDING)) SELECT series_id, date, r(lag(te, 1) OVER {_W})) AS before FROM t")
def lagged(spark, sf):
    return windows.tracking_error(active(spark, sf), 26).select("series_id", "date", F.lag("te", 1).over(windows.of_series()).alias("before"))


@query("e47_shifted_mean", f"SELECT series_id, date, r(avg(ret) OVER {_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)) AS mean FROM weekly")
def shifted(spark, sf):
    return h.weekly(spark, sf).select("series_id", "date", F.avg("ret").over(windows.of_series().rowsBetween(-4, -1)).alias("mean"))


@query("e48_rolling_excess", f"WITH {_ACTIVE} SELECT series_id, date, CASE WHEN count(active) OVER w = 52 THEN r(sum(active) OVER w) END AS total FROM a WINDOW w AS {_W} ROWS 51 PRECEDING)")
def rolling_excess(spark, sf):
    return windows.rolling_sum(active(spark, sf), "active", 52)


@query("e49_ewm_mean", "WITH a AS (SELECT series_id, w, row_number() OVER (PARTITION BY series_id ORDER BY date DESC) - 1 AS age FROM weights) SELECT series_id, r(sum(w * pow(0.9, age)) / sum(pow(0.9, age))) AS mean FROM a GROUP BY 1")
def ewm(spark, sf):
    age = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc("date"))) - 1
    a = h.weights(spark, sf).withColumn("k", F.pow(F.lit(0.9), age))
    return a.groupBy("series_id").agg((F.sum(F.col("w") * F.col("k")) / F.sum("k")).alias("mean"))


@query("g5_distinct_usage", "SELECT DISTINCT series_id, period_end FROM (SELECT series_id, period_end FROM vintages WHERE grading = 1 UNION ALL SELECT series_id, period_end FROM vintages WHERE grading < 3)")
def distinct_usage(spark, sf):
    v = h.vintages(spark, sf)
    return v.where("grading = 1").select("series_id", "period_end").unionByName(v.where("grading < 3").select("series_id", "period_end")).dropDuplicates()


@query("h5_cell_keys", "SELECT l_orderkey, l_linenumber, l_partkey, concat_ws('/', l_returnflag, l_linestatus, printf('%.2f', l_discount)) AS key FROM lineitem")
def cell_keys(spark, sf):
    return h.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat_ws("/", "l_returnflag", "l_linestatus", F.format_string("%.2f", "l_discount")).alias("key"))


@query("h3_text_functions", "SELECT p_partkey, upper(trim(p_brand)) AS up, lower(p_name) AS low, starts_with(p_type, 'PROMO') AS promo, ends_with(p_type, 'BRASS') AS brass, contains(p_name, 'a') AS has_a, replace(p_type, ' ', '_') AS under FROM part")
def texts(spark, sf):
    return h.table(spark, sf, "part").select("p_partkey", F.upper(F.trim("p_brand")).alias("up"), F.lower("p_name").alias("low"), F.col("p_type").startswith("PROMO").alias("promo"), F.col("p_type").endswith("BRASS").alias("brass"), F.col("p_name").contains("a").alias("has_a"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("under"))


@query("h10_formatted_dates", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, strftime(o_orderdate, '%Y%m%d') AS compact, strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders")
def formatted(spark, sf):
    d = F.col("o_orderdate")
    return h.table(spark, sf, "orders").select(F.to_date(d).alias("d"), F.date_format(d, "yyyyMMdd").alias("compact"), F.date_format(d, "yyyy-MM-dd").alias("iso")).distinct()


@query("h11_math_functions", "SELECT p_partkey, r(ln(1 + p_size)) AS log1p, r(exp(p_size / 50.0::DOUBLE) - 1) AS expm1, r(sqrt(p_retailprice)) AS root, sign(p_size - 25)::INT AS sign, floor(p_retailprice / 7)::BIGINT AS floor, r(least(greatest(p_size, 5), 40)) AS clipped FROM part")
def maths(spark, sf):
    s, price = F.col("p_size"), F.col("p_retailprice")
    return h.table(spark, sf, "part").select("p_partkey", F.log1p(s.cast("double")).alias("log1p"), F.expm1(s / 50.0).alias("expm1"), F.sqrt(price).alias("root"), F.signum(s - 25).cast("int").alias("sign"), F.floor(price / 7).alias("floor"), scalars.clip(s.cast("double"), 5.0, 40.0).alias("clipped"))


@query("h16_tolerant_compare", "SELECT date, series_id, w <= 0.012 * (1 + 1e-9) AS within FROM weights")
def tolerant(spark, sf):
    return h.weights(spark, sf).select("date", "series_id", scalars.within(F.col("w"), F.lit(0.012)).alias("within"))


@query("h19_dispersion_conviction", "SELECT date, r(least(greatest(stddev_samp(score) / 20, 0), 1)) AS conviction FROM scores GROUP BY 1")
def dispersion(spark, sf):
    return h.scores(spark, sf).groupBy("date").agg(scalars.clip(F.stddev_samp("score") / 20, 0.0, 1.0).alias("conviction"))


@query("h21_combined_forms", "SELECT date, series_id, r(a * b) AS product, r(sqrt(a * b)) AS geometric, r(least(a, b)) AS least, r(0.3 * a + 0.7 * b) AS weighted FROM (SELECT date, series_id, w AS a, score / 50 AS b FROM weights JOIN scores USING (date, series_id))")
def forms(spark, sf):
    j = h.weights(spark, sf).join(h.scores(spark, sf), ["date", "series_id"])
    a, b = F.col("w"), F.col("score") / 50
    c = scalars.combined_conviction
    return j.select("date", "series_id", c(a, b, "product").alias("product"), c(a, b, "geometric").alias("geometric"), c(a, b, "min").alias("least"), c(a, b, "weighted", 0.3).alias("weighted"))


@query("h22_collinearity", "WITH k AS (SELECT w, score, rank() OVER (PARTITION BY date ORDER BY w) + (count(*) OVER (PARTITION BY date, w) - 1) / 2.0::DOUBLE AS rw, rank() OVER (PARTITION BY date ORDER BY score) + (count(*) OVER (PARTITION BY date, score) - 1) / 2.0::DOUBLE AS rs FROM weights JOIN scores USING (date, series_id)) SELECT r(corr(w, score)) AS pearson, r(corr(rw, rs)) AS spearman, r(pow(corr(w, score), 2)) AS r2 FROM k")
def collinearity(spark, sf):
    j = h.weights(spark, sf).join(h.scores(spark, sf), ["date", "series_id"])
    k = j.select("w", "score", windows.average_rank(F.col("w"), ["date"]).alias("rw"), windows.average_rank(F.col("score"), ["date"]).alias("rs"))
    return k.agg(F.corr("w", "score").alias("pearson"), F.corr("rw", "rs").alias("spearman"), F.pow(F.corr("w", "score"), 2).alias("r2"))


@query("h25_verdict_maps", "SELECT run_id, count(*) AS n, bool_or(veto = 'v1' AND passed) AS v1 FROM verdicts GROUP BY 1")
def maps(spark, sf):
    m = h.verdicts(spark, sf).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("veto", "passed"))).alias("m"))
    return m.select("run_id", F.size("m").cast("bigint").alias("n"), F.coalesce(F.try_element_at("m", F.lit("v1")), F.lit(False)).alias("v1"))


@query("h28_where_and_fill", "SELECT series_id, date, r(coalesce(CASE WHEN ret > -0.5 THEN ret END, 0)) AS ret FROM weekly")
def where_fill(spark, sf):
    return h.weekly(spark, sf).select("series_id", "date", F.coalesce(F.when(F.col("ret") > -0.5, F.col("ret")), F.lit(0.0)).alias("ret"))


@query("k25_alpha_from_views", f"WITH {_EXPOSURE}, v AS (SELECT date, factor, 0.01 * exposure AS v FROM e) SELECT w.date, w.series_id, r(coalesce(sum(x.x * v.v), 0) * (m.market <> '')::INT) AS alpha FROM weights w JOIN meta m USING (series_id) LEFT JOIN x USING (series_id) LEFT JOIN v ON v.date = w.date AND v.factor = x.factor GROUP BY w.date, w.series_id, m.market")
def alpha(spark, sf):
    m = h.meta(spark, sf)
    x = m.select("series_id", F.length("nation").cast("double").alias("size"), F.col("hedged").cast("int").cast("double").alias("hedge")).unpivot("series_id", ["size", "hedge"], "factor", "x")
    v = exposure(spark, sf).select("date", "factor", (0.01 * F.col("exposure")).alias("v"))
    j = h.weights(spark, sf).join(m.select("series_id", "market"), "series_id").join(x, "series_id", "left").join(v, ["date", "factor"], "left")
    return j.groupBy("date", "series_id", "market").agg(F.coalesce(F.sum(F.col("x") * F.col("v")), F.lit(0.0)).alias("a")).select("date", "series_id", F.when(F.col("market") != "", F.col("a")).otherwise(0.0).alias("alpha"))


@query("k26_active_weights", "SELECT coalesce(a.date, b.date) AS date, coalesce(a.series_id, b.series_id) AS series_id, r(coalesce(a.w, 0) - coalesce(b.w, 0)) AS active FROM (SELECT * FROM weights WHERE series_id NOT LIKE 'S9%') a FULL JOIN (SELECT date, series_id, 0.01::DOUBLE AS w FROM scores WHERE series_id NOT LIKE 'S8%') b ON a.date = b.date AND a.series_id = b.series_id")
def active_weights(spark, sf):
    a = h.weights(spark, sf).where("series_id not like 'S9%'")
    b = h.scores(spark, sf).where("series_id not like 'S8%'").select("date", "series_id", F.lit(0.01).alias("w"))
    return book.trades(a, b).select("date", "series_id", (F.col("w") - F.col("before")).alias("active"))


@query("k60_exposure_by_group", "SELECT date, region, r(sum(w)) AS weight, r(sum(w * score)) AS score FROM weights JOIN scores USING (date, series_id) JOIN meta USING (series_id) GROUP BY 1, 2")
def by_group(spark, sf):
    j = h.weights(spark, sf).join(h.scores(spark, sf), ["date", "series_id"]).join(h.meta(spark, sf), "series_id")
    return j.groupBy("date", "region").agg(F.sum("w").alias("weight"), F.sum(F.col("w") * F.col("score")).alias("score"))


_LAST = "(SELECT series_id, f.date, arg_max(level, l.date) AS level FROM levels l JOIN fridays f ON l.date <= f.date AND l.date > f.date - 7 WHERE level IS NOT NULL GROUP BY 1, 2)"
_CHANGE = "max(CASE WHEN series_id = '{s}' THEN {x} END)"


@query("k30_six_factors", f"""
WITH g AS (SELECT s.series_id, f.date, level FROM (SELECT DISTINCT series_id FROM levels WHERE series_id IN ('S1', 'S2', 'S3', 'S4', 'S5', 'S6')) s CROSS JOIN fridays f LEFT JOIN {_LAST} USING (series_id, date)),
c AS (SELECT series_id, date, ln(level / lag(level) OVER w) AS lg, level - lag(level) OVER w AS df FROM g WINDOW w AS (PARTITION BY series_id ORDER BY date)),
u AS (SELECT CASE WHEN median(level) >= 20 THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END AS scale FROM levels WHERE series_id = 'S4')
SELECT date, {', '.join(f"r({_CHANGE.format(s=s, x=x)}) AS {k}" for k, s, x in (('equity', 'S1', 'lg'), ('real_yield', 'S2', 'df'), ('breakeven', 'S3', 'df'), ('credit', 'S4', 'df * scale'), ('dollar', 'S5', 'lg'), ('commodities', 'S6', 'lg')))} FROM c, u GROUP BY 1""")
def six_factors(spark, sf):
    roles = dict(zip(("equity", "real_yield", "breakeven", "credit", "dollar", "commodities"), ("S1", "S2", "S3", "S4", "S5", "S6")))
    return factors.frame(h.levels(spark, sf), h.fridays(spark, sf), roles)


_NINE = """
w AS (SELECT region AS run_id, date, series_id, tier, w / sum(w) OVER (PARTITION BY region, date) AS w FROM weights JOIN meta USING (series_id)),
a AS (SELECT region AS run_id, series_id, date, ret - bench AS active FROM weekly JOIN bench USING (date) JOIN meta USING (series_id) WHERE ret IS NOT NULL),
te AS (SELECT *, CASE WHEN count(active) OVER x = 26 THEN stddev_samp(active) OVER x * sqrt(52) END AS te FROM a WINDOW x AS (PARTITION BY series_id ORDER BY date ROWS 25 PRECEDING)),
z AS (SELECT run_id, series_id, date, active / (before / sqrt(52)) AS z FROM (SELECT *, lag(te) OVER (PARTITION BY series_id ORDER BY date) AS before FROM te) WHERE before > 1e-12),
u AS (SELECT CASE grading WHEN 1 THEN 'ASIA' WHEN 2 THEN 'EUROPE' ELSE 'AMERICA' END AS run_id, knowledge_date, CASE WHEN grading = 1 AND day(period_end) % 9 = 0 THEN knowledge_date - 1 ELSE knowledge_date END AS used_on_date, period_end AS fitted_through FROM vintages),
sd AS (SELECT region AS run_id, hedged AS seed, avg(active) * 52 / (stddev_samp(active) * sqrt(52)) AS ir FROM a JOIN meta USING (series_id) GROUP BY 1, 2),
i AS (SELECT region AS run_id, date, CASE WHEN count(*) >= 5 AND stddev_pop(score) > 1e-12 AND stddev_pop(fwd) > 1e-12 THEN corr(score, fwd) END AS ic FROM scores JOIN meta USING (series_id) WHERE fwd IS NOT NULL GROUP BY 1, 2),
v AS (
SELECT run_id, 0 AS ord, max(w) <= 0.2 * (1 + 1e-9) AS passed, max(w) AS value FROM (SELECT run_id, date, sum(w) AS w FROM w WHERE tier = 'second' GROUP BY 1, 2) GROUP BY 1
UNION ALL SELECT run_id, 1, max(bias) <= 1.72, max(bias) FROM (SELECT run_id, series_id, year(date), stddev_samp(z) AS bias FROM z GROUP BY ALL HAVING count(z) >= 40) GROUP BY 1
UNION ALL SELECT run_id, 2, max(n) <= 30, max(n) FROM (SELECT run_id, date, count(*) FILTER (abs(w) > 0) AS n FROM w GROUP BY 1, 2) GROUP BY 1
UNION ALL SELECT run_id, 3, avg((s >= 0.8)::INT) >= 0.9, avg((s >= 0.8)::INT) FROM (SELECT region AS run_id, date, avg((ret IS NOT NULL)::INT) AS s FROM weekly JOIN meta USING (series_id) GROUP BY 1, 2) GROUP BY 1
UNION ALL SELECT run_id, 4, count(*) FILTER (bad) = 0, count(*) FILTER (bad) FROM (SELECT run_id, coalesce(used_on_date < knowledge_date, true) OR NOT coalesce(fitted_through <= used_on_date, false) AS bad FROM u) GROUP BY 1
UNION ALL SELECT region, 5, count(*) FILTER (date < start) = 0, count(*) FILTER (date < start) FROM levels JOIN meta USING (series_id) GROUP BY 1
UNION ALL SELECT run_id, 6, max(ir) - min(ir) <= 0.15 * (1 + 1e-9) AND count(ir) >= 2, max(ir) - min(ir) FROM sd GROUP BY 1
UNION ALL SELECT run_id, 8, sign(avg(ic)) = 1, avg(ic) FROM i GROUP BY 1),
o(ord, veto) AS (VALUES (0, 'cash'), (1, 'risk_calibration'), (2, 'positions'), (3, 'coverage'), (4, 'lookahead'), (5, 'frequency'), (6, 'seed_stability'), (7, 'multiple_testing'), (8, 'direction'))"""


def nine_inputs(spark, sf):
    """The tables of five runs, the regions: shuffles are missing for all, usage for two of them."""
    m = h.meta(spark, sf).select("series_id", F.col("region").alias("run_id"), "tier", "hedged", "start")
    of = lambda df: df.join(m, "series_id")
    w = of(h.weights(spark, sf)).withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("run_id", "date")))
    a = windows.active_returns(h.weekly(spark, sf).where("ret is not null"), h.bench(spark, sf))
    v = h.vintages(spark, sf)
    ir = F.avg("active") * 52 / (F.stddev_samp("active") * F.sqrt(F.lit(52)))
    early = (F.col("grading") == 1) & (F.dayofmonth("period_end") % 9 == 0)
    daily = of(h.scores(spark, sf)).where("fwd is not null").groupBy("run_id", "date").agg(F.when((F.count("*") >= 5) & (F.stddev_pop("score") > 1e-12) & (F.stddev_pop("fwd") > 1e-12), F.try_divide(F.covar_pop("score", "fwd"), F.stddev_pop("score") * F.stddev_pop("fwd"))).alias("ic"))
    return {
        "cash": w.where("tier = 'second'").groupBy("run_id", "date").agg(F.sum("w").alias("w")),
        "weights": w.select("run_id", "date", "series_id", "w"),
        "active": of(a).select("run_id", "series_id", "date", "active"),
        "te": of(windows.tracking_error(a, 26)).select("run_id", "series_id", "date", "te"),
        "usage": v.select(F.when(F.col("grading") == 1, "ASIA").when(F.col("grading") == 2, "EUROPE").otherwise("AMERICA").alias("run_id"), "knowledge_date", F.when(early, F.date_sub("knowledge_date", 1)).otherwise(F.col("knowledge_date")).alias("used_on_date"), F.col("period_end").alias("fitted_through")),
        "contributions": of(h.levels(spark, sf)).select("run_id", "series_id", "date"),
        "meta": m.select("run_id", "series_id", "start"),
        "availability": of(h.weekly(spark, sf)).select("run_id", "date", "series_id", F.col("ret").isNotNull().alias("available")),
        "seeds": of(a).groupBy("run_id", F.col("hedged").alias("seed")).agg(ir.alias("ir")),
        "ic": daily.withColumn("expected", F.lit(1)),
    }


@query("k65_nine_vetoes", f"WITH {_NINE} SELECT r.run_id, o.ord, o.veto, coalesce(passed, false) AS passed, r(value) AS value, CASE WHEN o.ord = 7 THEN 'missing input: t, null, own' WHEN value IS NULL THEN 'no data' ELSE '' END AS detail FROM (SELECT DISTINCT region AS run_id FROM meta) r CROSS JOIN o LEFT JOIN v USING (run_id, ord)")
def nine(spark, sf):
    runs = h.meta(spark, sf).select(F.col("region").alias("run_id")).distinct()
    return vetoes.verdicts(runs, nine_inputs(spark, sf))


@query("k67_first_failures", f"WITH {_NINE} SELECT run_id, arg_min(veto, ord) AS veto FROM (SELECT run_id, o.ord, o.veto, coalesce(passed, false) AS passed FROM (SELECT DISTINCT region AS run_id FROM meta) r CROSS JOIN o LEFT JOIN v USING (run_id, ord)) WHERE NOT passed GROUP BY 1")
def first_failing(spark, sf):
    return vetoes.first_failures(nine(spark, sf))


@query("k7_run_context")
def run_context(spark, sf):
    """The mandate's paths judged: their books, risk, returns and usage as tables of the vetoes."""
    from . import ladder_queries as ladder

    made = cut(ladder.view_path(spark, sf))
    scores = h.scores(spark, sf).join(h.meta(spark, sf).select("series_id", F.col("region").alias("universe")), "series_id")
    used = rule.usage(made, ladder.traded_weekly(spark, sf), scores.select("universe", "date", "series_id"), "sigma")
    return vetoes.verdicts(made.select(F.col("universe").alias("run_id")).distinct(), vetoes.context_of_paths(made, used))


_MOVES = """mv AS (SELECT o_orderkey AS pos, 'H' || o_custkey % 97 AS hypothesis_id, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'running' ELSE 'done' END AS to_state FROM orders),
ms AS (SELECT pos, hypothesis_id, CASE WHEN pos % 5 = 0 THEN 'pending' WHEN pos % 31 = 0 THEN 'parked' ELSE coalesce(lag(to_state) OVER (PARTITION BY hypothesis_id ORDER BY pos), 'pending') END AS from_state, to_state FROM mv)"""


def moves(spark, sf):
    """Orders as moves of 97 hypotheses; some name a state that their hypothesis does not stand in, or none there is."""
    to = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "running").otherwise("done")
    mv = h.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("H"), (F.col("o_custkey") % 97).cast("string")).alias("hypothesis_id"), to.alias("to_state"))
    before = F.coalesce(F.lag("to_state").over(Window.partitionBy("hypothesis_id").orderBy("pos")), F.lit("pending"))
    return mv.select("pos", "hypothesis_id", F.when(F.col("pos") % 5 == 0, "pending").when(F.col("pos") % 31 == 0, "parked").otherwise(before).alias("from_state"), "to_state")


@query("a41_judged_moves", f"""
WITH {_MOVES}, s AS (SELECT *, coalesce(lag(to_state) OVER (PARTITION BY hypothesis_id ORDER BY pos), 'pending') AS stood FROM ms)
SELECT pos, hypothesis_id, from_state, to_state, stood, CASE WHEN from_state NOT IN ('pending', 'running', 'done') THEN 'unknown state' WHEN from_state = to_state THEN 'no move' WHEN from_state <> stood THEN 'does not stand there' WHEN from_state = 'done' AND to_state = 'pending' THEN 'move not allowed' END AS fault FROM s""")
def judged_moves(spark, sf):
    """Each move held against where its hypothesis stands; what is done is not taken up from the start."""
    m = moves(spark, sf)
    allowed = tuple(x for x in lifecycle.MOVES if x != ("done", "pending"))
    return lifecycle.judged(m, spark.createDataFrame([], lifecycle.TRANSITIONS), allowed)


@query("a43_latest_states", f"WITH {_MOVES} SELECT hypothesis_id, arg_max(to_state, pos) AS state, max(pos)::INT AS pos, count(*) AS moves FROM ms GROUP BY 1")
def latest_states(spark, sf):
    log = moves(spark, sf).select(F.lit(1).cast("long").alias("seq"), F.col("pos").cast("int").alias("pos"), "hypothesis_id", "to_state")
    return lifecycle.latest(log).select("hypothesis_id", "state", "pos", "moves")


@query("a43_states_at", f"""
WITH {_MOVES}, t AS (SELECT ms.*, CAST(o_orderdate AS DATE) AS ts FROM ms JOIN orders ON pos = o_orderkey), d AS (SELECT unnest([DATE '1993-06-30', DATE '1995-12-31', DATE '1998-01-01']) AS as_of)
SELECT hypothesis_id, as_of, arg_max(to_state, (ts, pos)) AS state FROM t JOIN d ON ts <= as_of GROUP BY 1, 2""")
def states_at(spark, sf):
    when = h.table(spark, sf, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderdate").cast("date").cast("timestamp").alias("ts"))
    log = moves(spark, sf).join(when, "pos").select(F.lit(1).cast("long").alias("seq"), F.col("pos").cast("int").alias("pos"), "ts", "hypothesis_id", "to_state")
    dates = spark.createDataFrame([("1993-06-30",), ("1995-12-31",), ("1998-01-01",)], "d string").select(F.col("d").cast("date").alias("as_of"))
    return lifecycle.latest_at(log, dates).select("hypothesis_id", F.col("as_of").cast("date").alias("as_of"), "state")
