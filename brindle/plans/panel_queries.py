"""Queries of the panel operators: cleaning, returns, periods, currency."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import panel, windows
from ..sources import hosted as h
from .registry import query


@query("flagship_weekly_risk", """
WITH a AS (SELECT w.series_id, w.date, w.ret - b.bench AS active FROM weekly w JOIN bench b USING (date) WHERE w.ret IS NOT NULL),
t AS (SELECT *, CASE WHEN count(active) OVER o = 26 THEN stddev_samp(active) OVER o * sqrt(52) END AS te,
      product(1 + active) OVER (PARTITION BY series_id ORDER BY date) AS wealth FROM a WINDOW o AS (PARTITION BY series_id ORDER BY date ROWS 25 PRECEDING)),
d AS (SELECT *, wealth / max(wealth) OVER (PARTITION BY series_id ORDER BY date) - 1 AS dd FROM t)
SELECT series_id, count(*) AS weeks, r(avg(active) * 52 / (stddev_samp(active) * sqrt(52))) AS ir, r(max(te)) AS worst_te, r(min(dd)) AS drawdown FROM d GROUP BY 1""")
def flagship(spark, sf):
    a = windows.active_returns(h.weekly(spark, sf).where("ret is not null"), h.bench(spark, sf))
    return windows.risk_path(a, 26).groupBy("series_id").agg(F.count("*").alias("weeks"), windows.information_ratio(F.col("active")).alias("ir"), F.max("te").alias("worst_te"), F.min("drawdown").alias("drawdown"))


@query("b1_to_missing", """
WITH x AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '#N/A' WHEN event_id % 11 = 0 THEN 'NA' WHEN event_id % 13 = 0 THEN 'x1' WHEN event_id % 17 = 0 THEN '' ELSE props ->> '$.k' END AS raw FROM events)
SELECT event_id, CASE WHEN trim(raw) NOT IN ('#N/A', '#N/A N/A', '', 'NA', 'nan') THEN r(try_cast(raw AS DOUBLE)) END AS level FROM x""")
def to_missing(spark, sf):
    k = F.get_json_object("props", "$.k")
    e = F.col("event_id")
    raw = F.when(e % 7 == 0, "#N/A").when(e % 11 == 0, "NA").when(e % 13 == 0, "x1").when(e % 17 == 0, "").otherwise(k)
    return panel.cleaned(h.table(spark, sf, "events").select("event_id", raw.alias("raw")))


@query("b2_business_days", "SELECT series_id, date, r(level) AS level FROM levels WHERE date NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 97 = 0)")
def business(spark, sf):
    off = h.table(spark, sf, "orders").where("o_orderkey % 97 = 0").select(F.to_date("o_orderdate").alias("date")).distinct()
    return panel.business_days(h.raw_levels(spark, sf), off)


@query("b3_no_forward_fill", "SELECT series_id, date FROM levels WHERE day(date) = 3 AND series_id LIKE 'S1%'")
def no_fill(spark, sf):
    after = h.levels(spark, sf)
    before = after.withColumn("level", F.when((F.dayofmonth("date") == 3) & F.col("series_id").startswith("S1"), None).otherwise(F.col("level")))
    return panel.forward_fills(before, after)


@query("b4_truncated", "SELECT series_id, date, CASE WHEN date >= start THEN r(level) END AS level FROM levels JOIN meta USING (series_id)")
def truncated(spark, sf):
    return panel.truncated(h.levels(spark, sf), h.meta(spark, sf))


@query("b5_frequency_breaches", "SELECT series_id, date FROM levels LEFT JOIN (SELECT * FROM meta WHERE series_id <> 'S7') m USING (series_id) WHERE start IS NULL OR date < start")
def breaches(spark, sf):
    return panel.frequency_breaches(h.levels(spark, sf), h.meta(spark, sf).where("series_id <> 'S7'"))


@query("b6_before_holdout", "SELECT count(*) AS n, max(date) AS last FROM levels")
def holdout(spark, sf):
    return panel.before_holdout(h.levels(spark, sf), "2020-01-01").agg(F.count("*").alias("n"), F.max("date").alias("last"))


@query("b7_clipped", "SELECT series_id, count(*) AS n FROM levels WHERE date BETWEEN DATE '1997-01-05' AND DATE '1999-12-27' GROUP BY 1")
def clipped(spark, sf):
    return panel.clipped(h.levels(spark, sf), "1997-01-05", "1999-12-27").groupBy("series_id").agg(F.count("*").alias("n"))


@query("b9_net_flags", "SELECT series_id, NOT (series_id LIKE 'S1%' OR series_id LIKE 'S9%') AS gross FROM meta")
def net_flags(spark, sf):
    net = F.col("series_id").startswith("S1") | F.col("series_id").startswith("S9")
    return h.meta(spark, sf).select("series_id", (~net).alias("gross"))


@query("b10_net_series", "SELECT series_id FROM meta WHERE series_id LIKE 'S1%' OR series_id LIKE 'S9%'")
def net_series(spark, sf):
    return net_flags(spark, sf).where("not gross").select("series_id").orderBy("series_id")


@query("b11_hedged", "SELECT series_id, hedged FROM meta WHERE hedged = false")
def hedged(spark, sf):
    return h.meta(spark, sf).where("hedged = false").select("series_id", "hedged")


@query("b13_hedge_mixing", "SELECT region, series_id FROM meta WHERE hedged AND region IN (SELECT region FROM meta GROUP BY 1 HAVING bool_or(hedged) AND bool_or(NOT hedged))")
def mixing(spark, sf):
    w = Window.partitionBy("region")
    m = h.meta(spark, sf).withColumn("mixed", F.bool_or("hedged").over(w) & F.bool_or(~F.col("hedged")).over(w))
    return m.where("mixed and hedged").select("region", "series_id")


@query("b14_by_tier", "SELECT tier, count(*) AS n, count(*) FILTER (tier <> 'tradable_only' AND NOT hedged) AS estimation FROM meta GROUP BY 1")
def tiers(spark, sf):
    use = (F.col("tier") != "tradable_only") & ~F.col("hedged")
    return h.meta(spark, sf).groupBy("tier").agg(F.count("*").alias("n"), F.count_if(use).alias("estimation"))


@query("b16_requested_panel", "SELECT series_id, count(*) AS n FROM vintages WHERE series_id IN ('click', 'view', 'purchase') GROUP BY 1")
def requested(spark, sf):
    wanted = spark.createDataFrame([("click",), ("view",), ("purchase",)], "series_id string")
    return h.vintages(spark, sf).join(wanted, "series_id", "left_semi").groupBy("series_id").agg(F.count("*").alias("n"))


@query("b18_graded", "SELECT series_id, period_end, knowledge_date, r(value) AS value FROM vintages WHERE grading < 3")
def graded(spark, sf):
    return h.vintages(spark, sf).where("grading < 3").select("series_id", "period_end", "knowledge_date", "value")


@query("b19_lag_buckets", "SELECT series_id, count(*) FILTER (g < 7) AS under_7, count(*) FILTER (g >= 7 AND g < 30) AS under_30, count(*) FILTER (g >= 30) AS rest FROM (SELECT *, knowledge_date - period_end AS g FROM vintages) GROUP BY 1")
def lag_buckets(spark, sf):
    g = F.datediff("knowledge_date", "period_end")
    return h.vintages(spark, sf).groupBy("series_id").agg(F.count_if(g < 7).alias("under_7"), F.count_if((g >= 7) & (g < 30)).alias("under_30"), F.count_if(g >= 30).alias("rest"))


@query("b22_currency_guard", "SELECT CASE WHEN c IS NULL THEN 'blank' WHEN c = 'C0' THEN 'base' WHEN c IN (SELECT currency FROM fx) THEN 'convert' ELSE 'refused' END AS route, count(*) AS n FROM (SELECT CASE WHEN series_id LIKE 'S2%' THEN NULL WHEN series_id LIKE 'S3%' THEN 'XX' ELSE upper(trim(' ' || currency)) END AS c FROM meta) GROUP BY 1")
def currency_guard(spark, sf):
    s = F.col("series_id")
    c = F.when(s.startswith("S2"), None).when(s.startswith("S3"), "XX").otherwise(F.upper(F.trim(F.concat(F.lit(" "), F.col("currency")))))
    known = h.fx(spark, sf).select(F.col("currency").alias("k")).distinct()
    j = h.meta(spark, sf).select(c.alias("c")).join(F.broadcast(known), F.col("c") == F.col("k"), "left")  # one row a currency
    return j.groupBy(F.when(F.col("c").isNull(), "blank").when(F.col("c") == "C0", "base").when(F.col("k").isNotNull(), "convert").otherwise("refused").alias("route")).agg(F.count("*").alias("n"))


@query("b24_scope_mask", "SELECT series_id, (region IN ('ASIA', 'EUROPE') AND market <> '')::INT AS mask FROM meta")
def scope_mask(spark, sf):
    return h.meta(spark, sf).select("series_id", (F.col("region").isin("ASIA", "EUROPE") & (F.col("market") != "")).cast("int").alias("mask"))


@query("b25_scope_reach", "SELECT region, count(DISTINCT series_id) AS reach FROM meta JOIN weights USING (series_id) WHERE market <> '' GROUP BY 1")
def scope_reach(spark, sf):
    m = h.meta(spark, sf).where("market <> ''")
    return m.join(h.weights(spark, sf).select("series_id").distinct(), "series_id", "left_semi").groupBy("region").agg(F.count_distinct("series_id").alias("reach"))


@query("b26_unresolved_names", "SELECT DISTINCT 'S' || (l_suppkey + 3) AS name FROM lineitem WHERE 'S' || (l_suppkey + 3) NOT IN (SELECT series_id FROM meta)")
def unresolved(spark, sf):
    asked = h.table(spark, sf, "lineitem").select(F.concat(F.lit("S"), (F.col("l_suppkey") + 3).cast("string")).alias("name")).distinct()
    return asked.join(h.meta(spark, sf), F.col("name") == F.col("series_id"), "left_anti")


@query("b27_data_split", "SELECT conv_id, count(*) FILTER (role = 'user') AS available, count(*) FILTER (role <> 'user') AS missing FROM (SELECT DISTINCT conv_id, role FROM conversations) GROUP BY 1")
def data_split(spark, sf):
    need = h.table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("need"))
    have = F.array(F.lit("user"))
    return need.select("conv_id", F.size(F.array_intersect("need", have)).cast("bigint").alias("available"), F.size(F.array_except("need", have)).cast("bigint").alias("missing"))


@query("b28_validation", "SELECT conv_id, turn, concat_ws(';', CASE WHEN role NOT IN ('user', 'assistant') OR role IS NULL THEN 'role' END, CASE WHEN length(coalesce(text, '')) < 120 THEN 'short' END, CASE WHEN NOT regexp_matches(coalesce(text, ''), '^[A-Z]') THEN 'start' END) AS reasons FROM conversations")
def validation(spark, sf):
    text = F.coalesce("text", F.lit(""))
    role = F.when(~F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False)), "role")
    reasons = F.concat_ws(";", role, F.when(F.length(text) < 120, "short"), F.when(~text.rlike("^[A-Z]"), "start"))
    return h.table(spark, sf, "conversations").select("conv_id", "turn", reasons.alias("reasons"))


@query("b32_cost_buckets", "SELECT series_id, coalesce(CASE WHEN region = 'AFRICA' THEN 'high' END, bucket, 'high') AS bucket FROM meta")
def cost_buckets(spark, sf):
    override = F.when(F.col("region") == "AFRICA", "high")
    return h.meta(spark, sf).select("series_id", F.coalesce(override, "bucket", F.lit("high")).alias("bucket"))


@query("b33_label_rows", "SELECT series_id, region, market, market <> '' AND region <> 'AMERICA' AS region_view FROM meta WHERE tier <> 'tradable_only'")
def label_rows(spark, sf):
    return h.meta(spark, sf).where("tier <> 'tradable_only'").select("series_id", "region", "market", ((F.col("market") != "") & (F.col("region") != "AMERICA")).alias("region_view"))


@query("c15_converted", "SELECT series_id, date, r(level * rate) AS level FROM levels JOIN meta USING (series_id) LEFT JOIN fx USING (currency, date)")
def converted(spark, sf):
    return panel.converted(h.levels(spark, sf), h.meta(spark, sf), h.fx(spark, sf))


@query("c16_without_rate", "SELECT currency, date FROM (SELECT DISTINCT currency, date FROM levels JOIN meta USING (series_id)) n WHERE (currency, date) NOT IN (SELECT (currency, date) FROM fx) AND date >= (SELECT min(date) FROM fx WHERE fx.currency = n.currency) AND date <= (SELECT max(date) FROM fx WHERE fx.currency = n.currency)")
def without_rate(spark, sf):
    thin = h.fx(spark, sf)
    return panel.dates_without_rate(h.levels(spark, sf), h.meta(spark, sf), thin)


@query("a17_rates_by_convention", "SELECT currency, date, r(CASE WHEN currency IN ('C1', 'C3') THEN 1 / rate ELSE rate END) AS usd_per_unit FROM fx WHERE rate > 0")
def conventions(spark, sf):
    return h.fx(spark, sf).where("rate > 0").select("currency", "date", F.when(F.col("currency").isin("C1", "C3"), 1 / F.col("rate")).otherwise(F.col("rate")).alias("usd_per_unit"))


@query("a18_rate_rows", "SELECT currency, count(*) AS n, min(date) AS first FROM fx GROUP BY 1")
def rate_rows(spark, sf):
    return h.fx(spark, sf).groupBy("currency").agg(F.count("*").alias("n"), F.min("date").alias("first"))


@query("a25_joined_names", "SELECT region, string_agg(DISTINCT nation, '|' ORDER BY nation) AS nations, count(bucket) AS with_bucket FROM meta GROUP BY 1")
def joined_names(spark, sf):
    return h.meta(spark, sf).groupBy("region").agg(F.array_join(F.array_sort(F.collect_set("nation")), "|").alias("nations"), F.count("bucket").alias("with_bucket"))


@query("a15_series_meta", "SELECT series_id, region, currency, tier, coalesce(bucket, 'high') AS bucket, start FROM meta")
def series_meta(spark, sf):
    return h.meta(spark, sf).select("series_id", "region", "currency", "tier", F.coalesce("bucket", F.lit("high")).alias("bucket"), "start")


@query("e1_returns", "SELECT series_id, date, r(ret) AS ret FROM returns")
def returns(spark, sf):
    return h.returns(spark, sf)


@query("e2_spanned_days", "SELECT series_id, date, (date - lag(date) OVER (PARTITION BY series_id ORDER BY date))::INT AS days FROM levels")
def spanned(spark, sf):
    return panel.spanned_days(h.levels(spark, sf))


@query("e3_overlapping_returns", "SELECT series_id, date, CASE WHEN count(ret) OVER w = 2 THEN r(product(1 + ret) OVER w - 1) END AS ret FROM returns WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 1 PRECEDING)")
def overlapping(spark, sf):
    return panel.overlapping_returns(h.returns(spark, sf), 2)


@query("e4_true_daily_starts", """
WITH g AS (SELECT series_id, date, date - lag(date) OVER (PARTITION BY series_id ORDER BY date) AS days FROM levels),
k AS (SELECT series_id, date, count(days) OVER w AS n, count(*) FILTER (days > 11) OVER w AS wide FROM g WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING))
SELECT series_id, min(date) AS start FROM k WHERE n = 20 AND wide = 0 GROUP BY 1""")
def daily_starts(spark, sf):
    return panel.true_daily_starts(h.levels(spark, sf), 20, 11)


@query("e5_to_fridays", "SELECT series_id, date + (5 - isodow(date))::INT AS date, r(max_by(level, date)) AS level FROM (SELECT series_id, date, level FROM levels WHERE date < DATE '2000-06-14') GROUP BY 1, 2 HAVING levels_day(min(date)) < DATE '2000-06-14'".replace("levels_day(min(date))", "min(date + (5 - isodow(date))::INT)"))
def fridays(spark, sf):
    return panel.to_fridays(h.levels(spark, sf), "2000-06-14")


@query("e6_stale_dropped", """
WITH f AS (SELECT series_id, date + (5 - isodow(date))::INT AS date, floor(max_by(level, date) / 700) AS level FROM (SELECT series_id, date, level FROM levels) GROUP BY 1, 2),
s AS (SELECT *, coalesce(level = lag(level) OVER w AND date - lag(date) OVER w = 7, false) AS same FROM f WINDOW w AS (PARTITION BY series_id ORDER BY date)),
i AS (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY series_id ORDER BY date) AS island FROM s),
n AS (SELECT *, count(*) OVER (PARTITION BY series_id, island) AS n FROM i)
SELECT series_id, date, level::DOUBLE AS level FROM n WHERE NOT (same AND n >= 3)""")
def stale(spark, sf):
    coarse = panel.to_fridays(h.levels(spark, sf)).withColumn("level", F.floor(F.col("level") / 700).cast("double"))
    return panel.stale_dropped(coarse, 3)


@query("e7_change_points", """
WITH v AS (SELECT series_id, period_end, knowledge_date, floor(value / 50)::DOUBLE AS value, 1 AS grading FROM vintages),
p AS (SELECT *, lag(period_end) OVER w AS pe, lag(value) OVER w AS pv, row_number() OVER w AS k FROM v WINDOW w AS (PARTITION BY series_id ORDER BY knowledge_date, period_end))
SELECT series_id, period_end, knowledge_date, value, grading FROM p WHERE k = 1 OR period_end <> pe OR value <> pv""")
def changes(spark, sf):
    coarse = h.vintages(spark, sf).withColumn("value", F.floor(F.col("value") / 50).cast("double")).withColumn("grading", F.lit(1))
    return panel.change_points(coarse)


@query("e9_spliced", """
WITH t AS (SELECT date, level AS t FROM levels WHERE series_id = 'S1' AND date >= DATE '1997-01-01'), s AS (SELECT date, level AS s FROM levels WHERE series_id = 'S2'),
k AS (SELECT t / s AS scale FROM t JOIN s USING (date) ORDER BY date LIMIT 1)
SELECT date, r(coalesce(t, s * (SELECT scale FROM k))) AS level FROM t FULL JOIN s USING (date)""")
def spliced(spark, sf):
    late = h.levels(spark, sf).where("not (series_id = 'S1' and date < date'1997-01-01')")
    return panel.spliced(late, "S1", "S2").where("series_id = 'S1'").select("date", "level")


@query("c24_rebalance_dates", """
WITH d AS (SELECT DISTINCT date FROM levels WHERE date NOT IN (SELECT CAST(o_orderdate AS DATE) FROM orders WHERE o_orderkey % 3 = 0)), e AS (SELECT min(date) AS f, max(date) AS l FROM d),
n AS (SELECT CAST(unnest(generate_series(f + ((5 - isodow(f) + 7) % 7)::INT, l, INTERVAL 7 DAY)) AS DATE) AS nominal FROM e)
SELECT DISTINCT (SELECT max(d.date) FROM d WHERE d.date <= nominal) AS date FROM n""")
def rebalance(spark, sf):
    off = h.table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.to_date("o_orderdate").alias("date")).distinct()
    return panel.rebalance_dates(h.levels(spark, sf).join(off, "date", "left_anti"), 5)


@query("d1_period_returns", "SELECT series_id, date, r(ret) AS ret FROM weekly")
def period(spark, sf):
    return h.weekly(spark, sf)


@query("d2_compounded_or_zero", "SELECT s.series_id, f.date, r(coalesce(w.ret, 0)) AS ret FROM (SELECT DISTINCT series_id FROM returns) s CROSS JOIN fridays f LEFT JOIN weekly w USING (series_id, date)")
def or_zero(spark, sf):
    return panel.period_returns(h.returns(spark, sf), h.fridays(spark, sf), 0.0)


@query("c23_weekly_levels", """
WITH b AS (SELECT l.series_id, f.date AS d, max_by(l.level, l.date) AS level FROM levels l JOIN fridays f ON l.date <= f.date AND l.date > f.date - 7 GROUP BY 1, 2)
SELECT s.series_id, f.date, r(b.level) AS level FROM (SELECT DISTINCT series_id FROM levels) s CROSS JOIN fridays f LEFT JOIN b ON b.series_id = s.series_id AND b.d = f.date""")
def weekly_levels(spark, sf):
    return panel.weekly_levels(h.levels(spark, sf), h.fridays(spark, sf))


@query("c21_measured_cells", """
WITH x AS (SELECT series_id, date, CASE WHEN day(date) % 2 = 0 THEN level END AS oad, CASE WHEN day(date) % 3 = 0 THEN level / 10 END AS oas FROM levels),
b AS (SELECT series_id, f.date AS d, max_by(oad, x.date) FILTER (oad IS NOT NULL) AS oad, max_by(oas, x.date) FILTER (oas IS NOT NULL) AS oas FROM x JOIN fridays f ON x.date <= f.date AND x.date > f.date - 7 GROUP BY 1, 2)
SELECT series_id, d AS date, r(oad) AS oad, r(oas) AS oas FROM b WHERE oad IS NOT NULL OR oas IS NOT NULL""")
def measured(spark, sf):
    x = h.levels(spark, sf).select("series_id", "date", F.when(F.dayofmonth("date") % 2 == 0, F.col("level")).alias("oad"), F.when(F.dayofmonth("date") % 3 == 0, F.col("level") / 10).alias("oas"))
    return panel.bucketed_last(x, h.fridays(spark, sf))


@query("c28_reindexed", "SELECT s.series_id, f.date, r(w.w) AS w FROM (SELECT DISTINCT series_id FROM weights) s CROSS JOIN fridays f LEFT JOIN weights w USING (series_id, date)")
def reindexed(spark, sf):
    w = h.weights(spark, sf)
    grid = w.select("series_id").distinct().crossJoin(F.broadcast(h.fridays(spark, sf)))  # one row a week
    return grid.join(w, ["series_id", "date"], "left")


@query("h2_id_patterns", "SELECT o_orderkey, regexp_matches('H-' || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') || '-' || o_custkey, '^H-\\d{4}-\\d{4}$') AS ok FROM orders")
def patterns(spark, sf):
    made = F.concat(F.lit("H-"), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), F.lit("-"), F.col("o_custkey").cast("string"))
    return h.table(spark, sf, "orders").select("o_orderkey", made.rlike(r"^H-\d{4}-\d{4}$").alias("ok"))


@query("h1_split_names", "SELECT p_partkey, split_part(p_name, ' ', 1) AS head, CASE WHEN strpos(p_name, ' ') > 0 THEN substr(p_name, strpos(p_name, ' ') + 1) END AS rest FROM part")
def split_names(spark, sf):
    head, rest = scalars.split_first(F.col("p_name"), " ")
    return h.table(spark, sf, "part").select("p_partkey", head.alias("head"), rest.alias("rest"))


@query("h4_horizons", "SELECT p_partkey, p_size AS low, (p_size + p_partkey % 9)::INT AS high, floor(sqrt(p_size * (p_size + p_partkey % 9)) + 0.5)::INT AS h FROM part")
def horizons(spark, sf):
    text = F.concat_ws("-", "p_size", (F.col("p_size") + F.col("p_partkey") % 9).cast("string"))
    p = h.table(spark, sf, "part").select("p_partkey", scalars.parse_horizon(text).alias("x"))
    return p.select("p_partkey", "x.low", "x.high", scalars.horizon(F.col("x.low"), F.col("x.high")).alias("h"))


@query("h6_group_keys", "SELECT series_id, CASE WHEN market IN ('', 'all') THEN NULL WHEN region = 'ASIA' THEN market ELSE market || '/' || region END AS grp FROM meta")
def group_keys(spark, sf):
    return h.meta(spark, sf).select("series_id", scalars.group_key(F.col("market"), F.when(F.col("region") == "ASIA", "").otherwise(F.col("region"))).alias("grp"))


@query("h7_date_parts", "SELECT DISTINCT date, isodow(date)::INT AS dow, year(date)::INT AS y, last_day(date) AS month_end, date + (5 - isodow(date))::INT AS friday, date + 91 AS later FROM levels")
def date_parts(spark, sf):
    d = h.levels(spark, sf).select("date").distinct()
    return d.select("date", (F.weekday("date") + 1).alias("dow"), F.year("date").alias("y"), F.last_day("date").alias("month_end"), F.date_add("date", 4 - F.weekday("date")).alias("friday"), F.date_add("date", 91).alias("later"))


@query("h9_calendars", "SELECT date FROM fridays")
def calendars(spark, sf):
    return panel.weekly_calendar(h.levels(spark, sf), 5)


@query("h14_huber", "SELECT l_orderkey, l_linenumber, l_partkey, r(CASE WHEN abs(u) <= 1.345 THEN 0.5 * u * u ELSE 1.345 * abs(u) - 0.5 * 1.345 * 1.345 END) AS loss FROM (SELECT *, (l_quantity - 25) / 10 AS u FROM lineitem)")
def huber(spark, sf):
    return h.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scalars.huber((F.col("l_quantity") - 25) / 10).alias("loss"))


@query("h15_credit_scale", "SELECT series_id, CASE WHEN median(level) >= 1300 THEN 'bp' ELSE 'percent' END AS unit FROM levels GROUP BY 1")
def credit_scale(spark, sf):
    return h.levels(spark, sf).groupBy("series_id").agg(F.when(F.median("level") >= 1300, "bp").otherwise("percent").alias("unit"))


@query("h17_convictions", """
WITH p AS (SELECT o_orderkey, list_transform([o_custkey % 7 + 1, o_orderkey % 5 + 1, o_custkey % 3]::DOUBLE[], lambda x: x / (o_custkey % 7 + 1 + o_orderkey % 5 + 1 + o_custkey % 3)) AS p FROM orders),
e AS (SELECT o_orderkey, list_max(p) AS m, 1 + list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(3) AS ent FROM p)
SELECT o_orderkey, r(round(least(greatest(ent, 0), 1), 12)) AS entropy, r(round((m - 1.0::DOUBLE / 3) / (1 - 1.0::DOUBLE / 3), 12)) AS top, r(round(least(greatest(ent, 0), 1) * ((m - 1.0::DOUBLE / 3) / (1 - 1.0::DOUBLE / 3)), 12)) AS product FROM e""")
def convictions(spark, sf):
    raw = F.array(*[x.cast("double") for x in (F.col("o_custkey") % 7 + 1, F.col("o_orderkey") % 5 + 1, F.col("o_custkey") % 3)])
    p = h.table(spark, sf, "orders").select("o_orderkey", scalars.normalised(raw).alias("p"))
    e, t = scalars.entropy_conviction(F.col("p")), scalars.max_probability_conviction(F.col("p"))
    return p.select("o_orderkey", F.round(e, 12).alias("entropy"), F.round(t, 12).alias("top"), F.round(scalars.combined_conviction(e, t, "product"), 12).alias("product"))


@query("h24_array_functions", "SELECT conv_id, list_sort(list(DISTINCT role)) AS roles, list_contains(list(role), 'system') AS has_system, count(*) AS turns FROM conversations GROUP BY 1")
def arrays(spark, sf):
    return h.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("roles"), F.array_contains(F.collect_list("role"), "system").alias("has_system"), F.count("*").alias("turns"))


@query("h27_row_hashes", "SELECT series_id, sha256(series_id || '|' || region || '|' || coalesce(bucket, '')) AS digest FROM meta")
def row_hashes(spark, sf):
    return h.meta(spark, sf).select("series_id", F.sha2(F.concat(F.col("series_id"), F.lit("|"), F.col("region"), F.lit("|"), F.coalesce("bucket", F.lit(""))), 256).alias("digest"))


@query("h29_one_hot", "SELECT series_id, (region = 'ASIA')::INT AS asia, (region = 'EUROPE')::INT AS europe, (region = 'AFRICA')::INT AS africa FROM meta")
def one_hot(spark, sf):
    return h.meta(spark, sf).select("series_id", *[(F.col("region") == r).cast("int").alias(r.lower()) for r in ("ASIA", "EUROPE", "AFRICA")])


@query("h30_axis_cells", "SELECT series_id, date, r(CASE WHEN day(date) % 2 = 0 THEN level ELSE -level / 3 END) AS duration, CASE WHEN day(date) % 2 = 0 THEN 'measured' ELSE 'estimated' END AS provenance FROM levels")
def axis_cells(spark, sf):
    known = F.dayofmonth("date") % 2 == 0
    return h.levels(spark, sf).select("series_id", "date", F.when(known, F.col("level")).otherwise(-F.col("level") / 3).alias("duration"), F.when(known, "measured").otherwise("estimated").alias("provenance"))


@query("k8_penalties", "SELECT date, series_id, r(40.0 / 1e4 * greatest(0, w * 20 - 0.75) / 0.75 / 52) AS penalty, r(3 * (greatest(0, w - 0.005 + 0.01) * greatest(0, w - 0.005 + 0.01) - greatest(0, w - 0.005) * greatest(0, w - 0.005))) AS created, r(8 + (2 - 8) * least(greatest(w * 30, 0), 1)) AS te_coefficient FROM weights")
def penalties(spark, sf):
    w = F.col("w")
    return h.weights(spark, sf).select("date", "series_id", scalars.turnover_penalty(w * 20).alias("penalty"), scalars.created_quadratic(w - 0.005, F.lit(0.01), 3.0).alias("created"), scalars.te_coefficient(w * 30, 2.0, 8.0).alias("te_coefficient"))
