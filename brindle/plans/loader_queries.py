"""Queries of composed loads and of checks on what was asked for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.lineage import cut
from ..sources import hosted as h
from ..sources import loaders, synthetic
from .registry import query


@query("a7_index_map", "SELECT series_id AS ticker, region AS section, start AS first_daily FROM meta")
def index_map(spark, sf):
    sheet = h.meta(spark, sf).select(F.concat(F.lit(" "), "series_id").alias("Ticker"), F.col("region").alias("Section"), F.date_format("start", "dd/MM/yyyy").alias("First Daily"))
    return loaders.index_map(sheet, {"Ticker": "ticker", "Section": "section", "First Daily": "first_daily"})


@query("a9_universe", "SELECT series_id AS ticker, bucket, tier FROM meta")
def universe(spark, sf):
    return loaders.universe(h.meta(spark, sf).select(F.concat("series_id", F.lit(" ")).alias("ticker"), F.coalesce("bucket", F.lit("")).alias("bucket"), "tier"))


def text(spark, sf):
    """Levels as a vendor's text, with a marker on each 13th."""
    return h.raw_levels(spark, sf).select("series_id", "date", F.when(F.dayofmonth("date") == 13, "#N/A").otherwise(F.col("level").cast("string")).alias("raw"))


_LOADED = """cv AS (SELECT l.series_id, l.date, CASE WHEN l.date >= start THEN CASE WHEN {keep} THEN level ELSE level / rate END END AS level
FROM (SELECT series_id, date, CASE WHEN day(date) <> 13 THEN level END AS level FROM raw_levels WHERE isodow(date) <= 5) l JOIN meta USING (series_id) LEFT JOIN fx USING (currency, date))"""
_RETURNS = "SELECT series_id, date, r(level / lag(level) OVER (PARTITION BY series_id ORDER BY date) - 1) AS ret FROM ob"


@query("a10_loaded_returns", f"""
WITH {_LOADED.format(keep='hedged')},
pair AS (SELECT date, max(level) FILTER (series_id = 'S1') AS t, max(level) FILTER (series_id = 'S2') AS s FROM cv WHERE series_id IN ('S1', 'S2') AND level IS NOT NULL GROUP BY 1),
seam AS (SELECT arg_min(t / s, date) AS k FROM pair WHERE t IS NOT NULL AND s IS NOT NULL),
sp AS (SELECT * FROM cv WHERE series_id <> 'S1' UNION ALL SELECT 'S1', date, coalesce(t, s * k) FROM pair, seam),
ob AS (SELECT * FROM sp WHERE level IS NOT NULL AND date < DATE '1998-06-01') {_RETURNS}""")
def returns(spark, sf):
    m = cut(h.meta(spark, sf))  # read by the universe, guards, starts and members
    members = loaders.universe(m.select(F.col("series_id").alias("ticker"), "tier")).select(F.col("ticker").alias("series_id"))
    currencies = h.table(spark, sf, "region").select(F.concat(F.lit("C"), F.col("r_regionkey").cast("string")).alias("currency"))
    prints = text(spark, sf).join(m.select("series_id"), "series_id", "left_semi")
    return loaders.load_returns(prints, m, h.fx(spark, sf), [("S1", "S2")], "1998-06-01", members=members, currencies=currencies, tiers=("1995-12-31", "1997-12-31")).returns


@query("a14_benchmark_legs", f"WITH {_LOADED.format(keep='false')}, ob AS (SELECT * FROM cv WHERE series_id IN ('S1', 'S2', 'S3') AND level IS NOT NULL AND date < DATE '1998-06-01') {_RETURNS}")
def legs(spark, sf):
    m = h.meta(spark, sf)
    return loaders.load_benchmark(text(spark, sf), ["S1", "S2", "S3"], h.fx(spark, sf), m.select("series_id", "currency"), m.select("series_id", "start"), "1998-06-01")


_FIELDS = "f AS (SELECT series_id, 'oas' AS field, date, level AS value FROM levels UNION ALL SELECT series_id, 'oad', date, level / 16 FROM levels), s AS (SELECT series_id, 'oas' AS field, start FROM meta UNION ALL SELECT series_id, 'oad', start + 30 FROM meta WHERE tier = 'backbone')"


def fields(spark, sf):
    lv, m = h.levels(spark, sf), h.meta(spark, sf)
    of = lambda name, by: lv.select("series_id", F.lit(name).alias("field"), "date", (F.col("level") / by).alias("value"))
    starts = m.select("series_id", F.lit("oas").alias("field"), "start"), m.where("tier = 'backbone'").select("series_id", F.lit("oad").alias("field"), F.date_add("start", 30).alias("start"))
    return of("oas", 1), of("oad", 16), *starts


@query("a11_analytics", f"WITH {_FIELDS} SELECT series_id, field, date, r(value) AS value FROM f JOIN s USING (series_id, field) JOIN meta m USING (series_id) WHERE date >= s.start AND NOT (m.hedged AND field = 'oas')")
def analytics(spark, sf):
    a, b, s, t = fields(spark, sf)
    sections = h.meta(spark, sf).select("series_id", F.when(F.col("hedged"), "Treasury").otherwise("Credit").alias("section"))
    return loaders.load_analytics(loaders.merged_analytics(a, b), loaders.earlier_starts(s, t), sections)


@query("a12_merged_analytics", f"WITH {_FIELDS} SELECT series_id, field, count(*) AS n, min(date) AS first, r(avg(value)) AS mean FROM f GROUP BY 1, 2")
def merged(spark, sf):
    a, b, *_ = fields(spark, sf)
    return loaders.merged_analytics(a, b).groupBy("series_id", "field").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.avg("value").alias("mean"))


@query("a12_earlier_starts", "SELECT series_id, 'oas' AS field, CASE WHEN hedged THEN start - 9 ELSE start END AS start FROM meta")
def starts(spark, sf):
    m = h.meta(spark, sf)
    of = lambda df, days: df.select("series_id", F.lit("oas").alias("field"), F.date_add("start", days).alias("start"))
    return loaders.earlier_starts(of(m, 0), of(m.where("hedged"), -9))


@query("a13_extra_levels", "SELECT series_id, count(*) AS n FROM raw_levels GROUP BY 1")
def extra(spark, sf):
    """The levels and an extra file that is not there."""
    return text(spark, sf).unionByName(loaders.optional_levels(spark, f"{sf}/extra_levels.csv")).groupBy("series_id").agg(F.count("*").alias("n"))


@query("a33_synthetic_analytics")
def walks(spark, sf):
    return synthetic.analytics(spark, 12, "1999-01-04", "2001-12-31", 4).groupBy("series_id", "field").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("date").alias("last"))


@query("a35_benchmark", "WITH d AS (SELECT date, sum(0.5 * ret) AS ret FROM returns WHERE series_id IN ('S1', 'S2') AND ret IS NOT NULL GROUP BY 1 HAVING count(*) = 2) SELECT date, r(100 * product(1 + ret) OVER (ORDER BY date)) AS level FROM d")
def benchmark(spark, sf):
    return synthetic.benchmark(h.returns(spark, sf), {"S1": 0.5, "S2": 0.5})


@query("a44_data_request", "SELECT row_number() OVER (ORDER BY s) AS line, '- series: ' || s || chr(10) || '  reason: ' || why AS text FROM (SELECT 'S' || p_partkey AS s, string_agg(DISTINCT 'size ' || p_size, '; ' ORDER BY 'size ' || p_size) AS why FROM part WHERE 'S' || p_partkey NOT IN (SELECT series_id FROM meta) GROUP BY 1)")
def request(spark, sf):
    wanted = h.table(spark, sf, "part").select(F.concat(F.lit("S"), F.col("p_partkey").cast("string")).alias("series_id"), F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("reason"))
    return loaders.data_request(wanted, h.meta(spark, sf).select("series_id")).withColumn("line", F.col("line").cast("bigint"))


@query("b29_scope_faults", """
WITH n AS (SELECT n_name AS hypothesis, n_nationkey AS k FROM nation),
s AS (SELECT hypothesis, 'region' AS label, unnest(CASE WHEN k % 5 = 0 THEN ['ATLANTIS', 'ASIA'] ELSE ['ASIA'] END) AS value FROM n WHERE k % 6 <> 0 UNION ALL SELECT hypothesis, CASE WHEN k % 4 = 0 THEN 'planet' ELSE 'tier' END, 'backbone' FROM n),
g AS (SELECT hypothesis, unnest(CASE k % 3 WHEN 0 THEN ['bucket', 'bucket'] WHEN 1 THEN ['region'] ELSE ['colour'] END) AS label FROM n)
SELECT hypothesis, 'scope' AS part, 'planet' AS label, NULL::VARCHAR AS value, 'unknown label' AS fault FROM n WHERE k % 4 = 0
UNION ALL SELECT hypothesis, 'scope', label, value, 'unknown value' FROM s WHERE (label = 'region' AND value NOT IN (SELECT region FROM meta)) OR (label = 'tier' AND value NOT IN (SELECT tier FROM meta))
UNION ALL SELECT hypothesis, 'scope', 'region', NULL, 'empty' FROM n WHERE k % 6 = 0
UNION ALL SELECT hypothesis, 'group_by', label, NULL, 'unknown label' FROM g WHERE label = 'colour'
UNION ALL SELECT hypothesis, 'group_by', 'bucket', NULL, 'doubled' FROM n WHERE k % 3 = 0
UNION ALL SELECT hypothesis, 'group_by', 'region', NULL, 'one value only' FROM n WHERE k % 3 = 1 AND k % 6 <> 0 AND k % 5 <> 0""")
def faults(spark, sf):
    k, text_array = F.col("n_nationkey"), lambda *v: F.array(*[F.lit(x) for x in v]).cast("array<string>")
    regions = F.when(k % 6 == 0, text_array()).when(k % 5 == 0, text_array("ATLANTIS", "ASIA")).otherwise(text_array("ASIA"))
    scope = F.create_map(F.lit("region"), regions, F.when(k % 4 == 0, "planet").otherwise("tier"), text_array("backbone"))
    groups = F.when(k % 3 == 0, text_array("bucket", "bucket")).when(k % 3 == 1, text_array("region")).otherwise(text_array("colour"))
    asked = h.table(spark, sf, "nation").select(F.col("n_name").alias("hypothesis"), F.lit("directional").alias("expression"), scope.alias("scope"), groups.alias("group_by"))
    values = h.meta(spark, sf).unpivot("series_id", ["region", "tier", "bucket"], "label", "value").select("label", "value")
    return loaders.scope_faults(asked, values)


@query("b30_investable_flags", "SELECT series_id AS ticker, coalesce(hedged, false) AS investable FROM meta")
def flags(spark, sf):
    return loaders.investable_flags(h.meta(spark, sf).select(F.col("series_id").alias("ticker"), F.when(F.col("hedged"), " TRUE ").when(F.col("tier") == "second", None).otherwise("no").alias("investable")))


@query("c26_found_names", """
WITH p(pattern, prefix, cids) AS (VALUES ('a', 'S1', NULL::VARCHAR[]), ('b', 'S2', ['C1', 'C3']), ('c', 'Q', NULL)),
m AS (SELECT pattern, currency AS cid, series_id AS name, row_number() OVER (PARTITION BY pattern ORDER BY currency, series_id) AS k FROM p JOIN meta ON starts_with(series_id, prefix) AND (cids IS NULL OR list_contains(cids, currency)))
SELECT pattern, cid, name, k::INT AS k FROM p LEFT JOIN (SELECT * FROM m WHERE k <= 4) m USING (pattern)""")
def search(spark, sf):
    patterns = spark.createDataFrame([("a", "S1", None), ("b", "S2", ["C1", "C3"]), ("c", "Q", None)], "pattern string, prefix string, cids array<string>")
    return loaders.found_names(h.meta(spark, sf).select(F.col("currency").alias("cid"), F.col("series_id").alias("name")), patterns, 4)
