"""Queries of the experiment store, its reports and sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import lineage, store
from ..sources import hosted as h
from .registry import query

_OVER = """m AS (SELECT run_id, max(value) FILTER (name = 'net_ir') AS net_ir, max(value) FILTER (name = 'turnover') AS turnover FROM metrics GROUP BY 1), v AS (SELECT run_id, bool_and(passed) AS ok, count(*) AS n FROM verdicts GROUP BY 1),
o AS (SELECT runs.*, net_ir, turnover, coalesce(ok, false) AS passed, n FROM runs LEFT JOIN m USING (run_id) LEFT JOIN v USING (run_id))"""


def overview(spark, sf):
    return store.overview(h.runs(spark, sf), h.metrics(spark, sf), h.verdicts(spark, sf), ["net_ir", "turnover"])


@query("c5_run_overview", f"WITH {_OVER} SELECT run_id, ts, family, r(net_ir) AS net_ir, r(turnover) AS turnover, passed, n::INT AS verdicts FROM o")
def run_overview(spark, sf):
    return overview(spark, sf).select("run_id", "ts", "family", "net_ir", "turnover", "passed", F.when(F.col("verdicts").isNotNull(), F.size("verdicts")).alias("verdicts"))


@query("f1_leaderboard", f"WITH {_OVER} SELECT run_id, passed, r(net_ir) AS net_ir FROM o ORDER BY passed DESC, o.net_ir DESC NULLS LAST, ts, run_id LIMIT 100")
def leaderboard(spark, sf):
    return store.leaderboard(overview(spark, sf), "net_ir").select("run_id", "passed", "net_ir").limit(100)


@query("f2_listed_runs", "SELECT run_id, ts, family FROM runs WHERE status = 'F' ORDER BY ts, run_id LIMIT 50")
def listed(spark, sf):
    return h.runs(spark, sf).where("status = 'F'").orderBy("ts", "run_id").limit(50).select("run_id", "ts", "family")


@query("f3_champions", f"WITH {_OVER} SELECT family, run_id, r(net_ir) AS net_ir FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY net_ir DESC, run_id) AS k FROM o WHERE passed AND net_ir IS NOT NULL) WHERE k = 1")
def champions(spark, sf):
    o = overview(spark, sf).where("passed and net_ir is not null")
    return o.groupBy("family").agg(F.min_by("run_id", F.struct((-F.col("net_ir")).alias("x"), "run_id")).alias("run_id"), F.max("net_ir").alias("net_ir"))


@query("f5_lowest_ten", "SELECT p_partkey, r(p_retailprice) AS price FROM part ORDER BY p_retailprice, p_partkey LIMIT 10")
def lowest(spark, sf):
    return h.table(spark, sf, "part").orderBy("p_retailprice", "p_partkey").limit(10).select("p_partkey", F.col("p_retailprice").alias("price"))


@query("f6_capped_candidates", "SELECT p_brand, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS k FROM (SELECT DISTINCT p_brand, p_name FROM part)) WHERE k <= 3")
def capped(spark, sf):
    w = Window.partitionBy("p_brand").orderBy("p_name")
    return h.table(spark, sf, "part").select("p_brand", "p_name").distinct().withColumn("k", F.row_number().over(w)).where("k <= 3").drop("k")


@query("f7_first_failure", "SELECT run_id, arg_min(veto, ord) AS veto FROM verdicts WHERE NOT passed GROUP BY 1")
def first_failure(spark, sf):
    return store.first_failures(h.verdicts(spark, sf))


@query("c6_excess_over_baseline", f"""
WITH {_OVER}, b AS (SELECT family, nullif(hypothesis, 7) AS cap, net_ir AS base, row_number() OVER (PARTITION BY family, nullif(hypothesis, 7) ORDER BY ts, run_id) AS k FROM o WHERE status = 'O')
SELECT o.run_id, r(o.net_ir - b.base) AS excess FROM o LEFT JOIN b ON k = 1 AND o.family = b.family AND nullif(o.hypothesis, 7) IS NOT DISTINCT FROM b.cap WHERE o.status = 'F'""")
def excess(spark, sf):
    o = overview(spark, sf).withColumn("cap", F.nullif("hypothesis", F.lit(7)))
    return store.excess_over_baseline(o.where("status = 'F'"), o.where("status = 'O'"), ["family", "cap"], "net_ir").select("run_id", "excess")


@query("c8_transfer_ratio", "SELECT a.line, r(a.m / b.m) AS ratio FROM (SELECT l_linenumber AS line, avg(l_discount) AS m FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) a JOIN (SELECT l_linenumber AS line, avg(l_discount) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) b USING (line)")
def transfer_ratio(spark, sf):
    m = h.table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("line"), "l_returnflag").agg(F.avg("l_discount").alias("m"))
    p = m.groupBy("line").pivot("l_returnflag", ["N", "R"]).agg(F.first("m"))
    return p.select("line", (F.col("N") / F.col("R")).alias("ratio"))


@query("c9_rank_among_shuffles", f"WITH {_OVER}, g AS (SELECT *, rank() OVER (PARTITION BY family, hypothesis ORDER BY net_ir DESC) AS k FROM o WHERE net_ir IS NOT NULL) SELECT run_id, k::INT AS live_rank FROM g WHERE status = 'F'")
def live_rank(spark, sf):
    w = Window.partitionBy("family", "hypothesis").orderBy(F.desc("net_ir"))
    return overview(spark, sf).where("net_ir is not null").withColumn("live_rank", F.rank().over(w)).where("status = 'F'").select("run_id", "live_rank")


@query("c10_friction_by_cell", f"""
WITH {_OVER}, p AS (SELECT family, hypothesis, avg(turnover) FILTER (status = 'F') AS a, avg(turnover) FILTER (status = 'O') AS b FROM o GROUP BY 1, 2)
SELECT family, count(a - b) AS n, r(avg(a - b)) AS mean, r(stddev_samp(a - b)) AS sd, count(*) FILTER (a - b > 0) AS positive FROM p GROUP BY 1""")
def friction(spark, sf):
    p = overview(spark, sf).groupBy("family", "hypothesis").pivot("status", ["F", "O"]).agg(F.avg("turnover"))
    d = F.col("F") - F.col("O")
    return p.groupBy("family").agg(F.count(d).alias("n"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.count_if(d > 0).alias("positive"))


@query("c11_superseded", "WITH a AS (SELECT series_id, date, level FROM levels WHERE date < DATE '1999-01-01'), b AS (SELECT series_id, date, CASE WHEN day(date) = 1 THEN NULL WHEN day(date) = 2 THEN level + 1 ELSE level END AS level FROM levels WHERE date >= DATE '1996-01-01') SELECT count(*) FILTER (a.date IS NOT NULL AND b.date IS NOT NULL) AS both, count(*) FILTER (a.date IS NULL) AS added, count(*) FILTER (b.date IS NULL) AS removed, count(*) FILTER (a.date IS NOT NULL AND b.date IS NOT NULL AND a.level IS DISTINCT FROM b.level) AS changed, r(max(abs(a.level - b.level))) AS widest FROM a FULL JOIN b ON a.series_id = b.series_id AND a.date = b.date")
def superseded(spark, sf):
    x = h.levels(spark, sf)
    new = x.where("date >= date'1996-01-01'").withColumn("level", F.when(F.dayofmonth("date") == 1, None).when(F.dayofmonth("date") == 2, F.col("level") + 1).otherwise(F.col("level")))
    return store.differences(x.where("date < date'1999-01-01'"), new, ["series_id", "date"], "level")


@query("c25_prefix_candidates", "SELECT b.p_brand, p.p_partkey FROM (SELECT DISTINCT p_brand FROM part) b JOIN part p ON p.p_brand = b.p_brand AND starts_with(p.p_type, left(b.p_brand, 1)) UNION ALL SELECT p_brand, NULL FROM (SELECT DISTINCT p_brand FROM part) b WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_brand = b.p_brand AND starts_with(p.p_type, left(b.p_brand, 1)))")
def prefix(spark, sf):
    p = h.table(spark, sf, "part")
    hit = p.where(F.col("p_type").startswith(F.substring("p_brand", 1, 1))).select("p_brand", "p_partkey")
    return p.select("p_brand").distinct().join(hit, "p_brand", "left")


@query("c27_hypotheses_by_ticker", "SELECT coalesce(nullif(market, ''), series_id) AS ticker, list_sort(list(series_id)) AS hypotheses FROM meta GROUP BY 1")
def by_ticker(spark, sf):
    return h.meta(spark, sf).groupBy(F.coalesce(F.nullif("market", F.lit("")), "series_id").alias("ticker")).agg(F.array_sort(F.collect_list("series_id")).alias("hypotheses"))


@query("c2_joined_on_panel_dates", "SELECT coalesce(a.date, b.date) AS date, r(a.ret) AS a, r(b.ret) AS b FROM (SELECT * FROM weekly WHERE series_id = 'S1') a FULL JOIN (SELECT * FROM weekly WHERE series_id = 'S2') b USING (date) WHERE coalesce(a.date, b.date) IN (SELECT date FROM weights)")
def joined(spark, sf):
    w = h.weekly(spark, sf)
    a, b = (w.where(F.col("series_id") == s).select("date", F.col("ret").alias(n)) for s, n in (("S1", "a"), ("S2", "b")))
    return a.join(b, "date", "full").join(h.weights(spark, sf).select("date").distinct(), "date", "left_semi")


@query("c1_outer_sources", "SELECT series_id, count(*) AS n FROM (SELECT series_id, date FROM levels UNION ALL SELECT 'F' || currency, date FROM fx) GROUP BY 1")
def outer_sources(spark, sf):
    x = h.fx(spark, sf).select(F.concat(F.lit("F"), "currency").alias("series_id"), "date", F.col("rate").alias("level"))
    return h.levels(spark, sf).unionByName(x).groupBy("series_id").agg(F.count("*").alias("n"))


@query("c3_loadings_with_fit", "SELECT w.date, w.series_id, r(w.w) AS loading, r(s.score) AS fit, r(k.ret) AS measured, m.region FROM weights w JOIN scores s USING (date, series_id) LEFT JOIN weekly k USING (date, series_id) LEFT JOIN (SELECT * FROM meta WHERE NOT hedged) m USING (series_id)")
def with_fit(spark, sf):
    m = h.meta(spark, sf).where("not hedged").select("series_id", "region")
    j = h.weights(spark, sf).join(h.scores(spark, sf), ["date", "series_id"]).join(h.weekly(spark, sf), ["date", "series_id"], "left").join(m, "series_id", "left")
    return j.select("date", "series_id", F.col("w").alias("loading"), F.col("score").alias("fit"), F.col("ret").alias("measured"), "region")


@query("d44_store_summary", "SELECT status, count(*) AS n, count(DISTINCT hypothesis) AS hypotheses, r(sum(round(cost * 100)::BIGINT) / 100.0::DOUBLE) AS cost FROM runs GROUP BY 1")
def summary(spark, sf):
    cents = F.sum(F.round(F.col("cost") * 100).cast("bigint"))
    return h.runs(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("hypothesis").alias("hypotheses"), (cents / 100.0).alias("cost"))


@query("d45_last_cycle", "SELECT status, count(*) AS n FROM runs WHERE ts >= (SELECT max(ts) FROM runs) - 6 GROUP BY 1")
def last_cycle(spark, sf):
    r = h.runs(spark, sf)
    last = r.agg(F.date_sub(F.max("ts"), 6).alias("since"))
    return r.join(F.broadcast(last), F.col("ts") >= F.col("since")).groupBy("status").agg(F.count("*").alias("n"))  # one row


@query("d46_month_spend", "SELECT date_trunc('month', ts)::DATE AS month, r(sum(round(coalesce(CASE WHEN status <> 'P' THEN cost END, 1000) * 100)::BIGINT) / 100.0::DOUBLE) AS spent FROM runs GROUP BY 1")
def month_spend(spark, sf):
    c = F.round(F.coalesce(F.when(F.col("status") != "P", F.col("cost")), F.lit(1000.0)) * 100).cast("bigint")
    return h.runs(spark, sf).groupBy(F.trunc("ts", "month").alias("month")).agg((F.sum(c) / 100.0).alias("spent"))


@query("k70_run_labels", f"WITH {_OVER} SELECT run_id, CASE WHEN n IS NULL THEN '' WHEN passed AND net_ir >= 0.05 THEN 'candidate' ELSE 'not detected' END AS label FROM o WHERE net_ir IS NOT NULL")
def labels(spark, sf):
    o = overview(spark, sf).where("net_ir is not null")
    return o.select("run_id", scalars.run_label(F.when(F.col("verdicts").isNotNull(), F.col("passed")), F.col("net_ir"), 0.05).alias("label"))


@query("k66_threshold_verdicts", f"WITH {_OVER} SELECT run_id, concat_ws(';', CASE WHEN net_ir < 0.03 THEN 'ir' END, CASE WHEN turnover > 45 THEN 'turnover' END, CASE WHEN NOT passed THEN 'veto' END) AS failed FROM o")
def thresholds(spark, sf):
    f = F.concat_ws(";", F.when(F.col("net_ir") < 0.03, "ir"), F.when(F.col("turnover") > 45, "turnover"), F.when(~F.col("passed"), "veto"))
    return overview(spark, sf).select("run_id", f.alias("failed"))


@query("k67_applied_vetoes", "SELECT veto, count(*) AS n, count(*) FILTER (NOT passed) AS failed, bool_and(passed) AS clean FROM verdicts GROUP BY 1")
def vetoes(spark, sf):
    return h.verdicts(spark, sf).groupBy("veto").agg(F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("failed"), F.bool_and("passed").alias("clean"))


@query("k69_triage", "SELECT hypothesis, CASE WHEN bool_or(status = 'P') THEN 'blocked' WHEN count(*) FILTER (status = 'F') >= count(*) / 2.0 THEN 'ready' ELSE 'rejected' END AS state, max(ts) AS ts FROM runs GROUP BY 1")
def triage(spark, sf):
    state = F.when(F.bool_or(F.col("status") == "P"), "blocked").when(F.count_if(F.col("status") == "F") >= F.count("*") / 2, "ready").otherwise("rejected")
    return h.runs(spark, sf).groupBy("hypothesis").agg(state.alias("state"), F.max("ts").alias("ts"))


@query("k57_grid_cells", "SELECT ic, horizon, seed, printf('ic%.2f-h%d-s%d', ic, horizon, seed) AS key FROM (SELECT unnest([0.02, 0.05, 0.1, 0.2]::DOUBLE[]) AS ic), (SELECT unnest([4, 13, 26, 52]) AS horizon), (SELECT unnest(generate_series(0, 9))::INT AS seed) WHERE NOT (ic = 0.02 AND horizon = 52)", exact=True)
def grid(spark, sf):
    ic = spark.createDataFrame([(x,) for x in (0.02, 0.05, 0.1, 0.2)], "ic double")
    horizon = spark.createDataFrame([(x,) for x in (4, 13, 26, 52)], "horizon int")
    seed = spark.range(10).select(F.col("id").cast("int").alias("seed"))
    cells = ic.crossJoin(horizon).crossJoin(seed).where("not (ic = 0.02 and horizon = 52)")  # a grid of parameters
    return cells.withColumn("key", F.format_string("ic%.2f-h%d-s%d", "ic", "horizon", "seed"))


@query("k58_cells_with_twins", "SELECT ic, seed, live FROM (SELECT unnest([0.02, 0.05]::DOUBLE[]) AS ic), (SELECT unnest(generate_series(0, 4))::INT AS seed), (SELECT unnest([true, false]) AS live)", exact=True)
def twins(spark, sf):
    cells = spark.createDataFrame([(0.02,), (0.05,)], "ic double").crossJoin(spark.range(5).select(F.col("id").cast("int").alias("seed")))  # a grid of parameters
    return cells.select("ic", "seed", F.explode(F.array(F.lit(True), F.lit(False))).alias("live"))


@query("g1_union_all", "SELECT kind, count(*) AS n FROM (SELECT 'c' AS kind FROM customer UNION ALL SELECT 's' FROM supplier) GROUP BY 1")
def union_all(spark, sf):
    a = h.table(spark, sf, "customer").select(F.lit("c").alias("kind"))
    return a.unionByName(h.table(spark, sf, "supplier").select(F.lit("s").alias("kind"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("g2_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union(spark, sf):
    return h.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(h.table(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("g3_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0")
def intersect(spark, sf):
    return h.table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).intersect(h.table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select("s_nationkey"))


@query("g4_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0")
def except_(spark, sf):
    return h.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).subtract(h.table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select("s_nationkey"))


@query("g6_membership", "SELECT DISTINCT upper(p_brand) AS name FROM part WHERE upper(p_brand) NOT IN (SELECT upper(p_brand) FROM part WHERE p_size < 3)")
def membership(spark, sf):
    p = h.table(spark, sf, "part").select(F.upper("p_brand").alias("name"), "p_size")
    return p.select("name").distinct().join(p.where("p_size < 3").select("name"), "name", "left_anti")


@query("g7_transitive_closure", "WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 2 + 1) % 25 AS b FROM nation), c AS (SELECT a, b FROM e WHERE a IN (0, 3) UNION SELECT c.a, e.b FROM c JOIN e ON c.b = e.a) SELECT a::INT AS root, b::INT AS reached FROM c")
def closure(spark, sf):
    edges = h.table(spark, sf, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 2 + 1) % 25).alias("b"))
    return lineage.reached(edges, edges.where("a in (0, 3)")).select(F.col("a").cast("int").alias("root"), F.col("b").cast("int").alias("reached"))


@query("a47_profile", "SELECT count(*) AS n, count(bucket) AS with_bucket, count(nullif(market, '')) AS with_market, min(start) AS first, max(start) AS last FROM meta")
def profile(spark, sf):
    return h.meta(spark, sf).agg(F.count("*").alias("n"), F.count("bucket").alias("with_bucket"), F.count(F.nullif("market", F.lit(""))).alias("with_market"), F.min("start").alias("first"), F.max("start").alias("last"))


@query("a5_wide_to_long", "SELECT p_partkey AS id, field, r(value) AS value FROM (SELECT p_partkey, p_size::DOUBLE AS size, p_retailprice AS price FROM part) UNPIVOT (value FOR field IN (size, price))")
def wide_to_long(spark, sf):
    p = h.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    return p.unpivot("id", ["size", "price"], "field", "value")


@query("h26_json_fields", "SELECT event_id, (props ->> '$.k')::INT AS k FROM events")
def json_fields(spark, sf):
    return h.table(spark, sf, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("i4_weekly_tumbling", "SELECT event_type, time_bucket(INTERVAL 7 DAY, ts, TIMESTAMP '1970-01-01') AS week, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1, 2")
def tumbling(spark, sf):
    return h.table(spark, sf, "events").groupBy("event_type", F.window("ts", "7 days").alias("w")).agg(F.count("*").alias("n"), F.max("event_id").alias("last_id")).select("event_type", F.col("w.start").alias("week"), "n", "last_id")
