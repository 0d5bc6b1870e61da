"""Panel inputs hosted on the plain tables: each as a DataFrame and as SQL that says the same.

levels(series_id, date, level)      a ragged daily panel, from line items by supplier and ship date
meta(series_id, region, nation, currency, hedged, start, tier, bucket, market)   one row a series
fx(currency, date, rate)            units per currency and day, from orders
vintages(series_id, period_end, knowledge_date, value, grading)   revisions of event series, bitemporal
runs, metrics, verdicts             an experiment store: orders and line items
weights(date, series_id, w)         a book held on each Friday
scores(date, series_id, score, fwd) a weekly cross-section with what follows
pvals(test, p)                      a family of tests
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Line items that a task gets at most, about, where they are dealt by series.
ROWS_A_TASK = 500_000

SQL = {
    "raw_levels": "SELECT 'S' || l_suppkey AS series_id, CAST(l_shipdate AS DATE) AS date, max(l_extendedprice / l_quantity) AS level FROM lineitem GROUP BY 1, 2",
    "levels": "SELECT * FROM raw_levels WHERE isodow(date) <= 5",
    "meta": """SELECT 'S' || s_suppkey AS series_id, r_name AS region, n_name AS nation, 'C' || n_regionkey AS currency, s_suppkey % 3 = 0 AS hedged,
               first + 60 AS start, CASE WHEN year(first + 60) <= 1995 AND s_suppkey % 5 <> 0 THEN 'backbone' WHEN s_suppkey % 5 = 1 THEN 'second' ELSE 'tradable_only' END AS tier,
               CASE s_suppkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'mid' WHEN 2 THEN 'high' END AS bucket, CASE WHEN s_suppkey % 7 = 0 THEN '' ELSE 'M' || s_suppkey % 7 END AS market
               FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
               JOIN (SELECT series_id AS sid, min(date) AS first FROM levels GROUP BY 1) ON sid = 'S' || s_suppkey""",
    "fx": """SELECT 'C' || n_regionkey AS currency, CAST(o_orderdate AS DATE) AS date, 0.5 + max(o_custkey) / 1000.0::DOUBLE AS rate
             FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2""",
    "returns": """SELECT series_id, date, level / lag(level) OVER (PARTITION BY series_id ORDER BY date) - 1 AS ret FROM levels""",
    "fridays": """SELECT CAST(unnest(generate_series(f, l, INTERVAL 7 DAY)) AS DATE) AS date FROM (SELECT min(date) + (5 - isodow(min(date)))::INT AS f, max(date) AS l FROM levels)""",
    "weekly": """SELECT series_id, date, ret FROM (SELECT r.series_id, f.date, CASE WHEN count(ret) > 0 THEN product(1 + coalesce(ret, 0)) - 1 END AS ret
                 FROM returns r JOIN fridays f ON r.date <= f.date AND r.date > f.date - 7 GROUP BY 1, 2)""",
    "bench": "SELECT date, avg(ret) AS bench FROM weekly GROUP BY 1",
    "vintages": """SELECT series_id, period_end, knowledge_date, value, grading FROM (SELECT event_type AS series_id, CAST(ts AS DATE) - (event_id % 45)::INT AS period_end, CAST(ts AS DATE) AS knowledge_date,
                   value, 1 + (event_id % 3)::INT AS grading, row_number() OVER (PARTITION BY event_type, CAST(ts AS DATE) - (event_id % 45)::INT, CAST(ts AS DATE) ORDER BY event_id DESC) AS k FROM events) WHERE k = 1""",
    "runs": "SELECT o_orderkey AS run_id, CAST(o_orderdate AS DATE) AS ts, o_orderpriority AS family, o_orderstatus AS status, o_totalprice AS cost, o_custkey % 50 AS hypothesis FROM orders",
    "metrics": """SELECT l_orderkey AS run_id, 'net_ir' AS name, max(l_discount) AS value FROM lineitem GROUP BY 1 UNION ALL
                  SELECT l_orderkey, 'turnover', max(l_quantity) FROM lineitem WHERE l_linenumber > 1 GROUP BY 1""",
    "verdicts": "SELECT l_orderkey AS run_id, 'v' || l_linenumber AS veto, l_linenumber AS ord, l_returnflag <> 'R' AS passed FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS k FROM lineitem) WHERE k = 1",
    "weights": """SELECT date, series_id, q / sum(q) OVER (PARTITION BY date) AS w FROM (SELECT CAST(l_shipdate AS DATE) AS date, 'S' || l_suppkey AS series_id, sum(l_quantity::BIGINT) AS q
                  FROM lineitem WHERE isodow(CAST(l_shipdate AS DATE)) = 5 GROUP BY 1, 2)""",
    "scores": """SELECT date, series_id, q AS score, lead(q) OVER (PARTITION BY series_id ORDER BY date) AS fwd FROM (SELECT CAST(l_shipdate AS DATE) AS date, 'S' || l_suppkey AS series_id, max(l_quantity) AS q
                 FROM lineitem WHERE isodow(CAST(l_shipdate AS DATE)) = 5 GROUP BY 1, 2)""",
    "pvals": "SELECT p_partkey AS test, ((p_partkey * 7919) % 1009) / 2018.0::DOUBLE AS p FROM part",
}
_NEEDS = {k: [n for n in SQL if n != k and re.search(rf"\b{n}\b", v)] for k, v in SQL.items()}


def with_tables(sql: str) -> str:
    """The SQL with the hosted tables it names put before it as common tables, and r(x) spelled out."""
    wanted: list[str] = []

    def want(name: str) -> None:
        for n in _NEEDS[name]:
            want(n)
        if name not in wanted:
            wanted.append(name)

    for n in SQL:
        if re.search(rf"\b{n}\b", sql):
            want(n)
    head = ",\n".join(f"{n} AS (SELECT * FROM ({SQL[n]}))" for n in wanted)
    sql = re.sub(r"\br\(", "single(", sql)
    body = sql.strip()
    if not wanted:
        return _rounding(body)
    if body[:5].upper() == "WITH ":
        return _rounding(f"WITH {head},\n{body[5:]}")
    return _rounding(f"WITH {head}\n{body}")


def _rounding(sql: str) -> str:
    """single(x) as x in single precision, with nested parentheses."""
    out, at = "", 0
    while (i := sql.find("single(", at)) >= 0:
        depth, j = 1, i + 7
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            j += 1
        out += sql[at:i] + "CAST(CAST(" + _rounding(sql[i + 7 : j - 1]) + " AS FLOAT) AS DOUBLE)"
        at = j
    return out + sql[at:]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _series(col: str) -> Column:
    return F.concat(F.lit("S"), F.col(col).cast("string"))


def raw_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    prints = li.select(_series("l_suppkey").alias("series_id"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("level"))
    # Dealt by series once: windows over one need no further exchange. By rows, as their bytes say little of what a task sorts and groups.
    tasks = max(spark.sparkContext.defaultParallelism, -(-li.count() // ROWS_A_TASK))
    return prints.repartition(tasks, "series_id").groupBy("series_id", "date").agg(F.max("level").alias("level"))


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.panel import business_days

    return business_days(raw_levels(spark, sf_dir))


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, date) of ``levels``, as often as line items have them: for what asks for first or last days alone."""
    from ..operators.panel import business_days

    return business_days(table(spark, sf_dir, "lineitem").select(_series("l_suppkey").alias("series_id"), F.to_date("l_shipdate").alias("date")))


def meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    first = _printed(spark, sf_dir).groupBy("series_id").agg(F.min("date").alias("first"))
    key = F.col("s_suppkey")
    joined = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).withColumn("series_id", _series("s_suppkey")).join(first, "series_id")
    start = F.date_add("first", 60)
    tier = F.when((F.year(start) <= 1995) & (key % 5 != 0), "backbone").when(key % 5 == 1, "second").otherwise("tradable_only")
    bucket = F.when(key % 4 == 0, "low").when(key % 4 == 1, "mid").when(key % 4 == 2, "high")
    market = F.when(key % 7 == 0, "").otherwise(F.concat(F.lit("M"), (key % 7).cast("string")))
    return joined.select("series_id", F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.concat(F.lit("C"), F.col("n_regionkey").cast("string")).alias("currency"), (key % 3 == 0).alias("hedged"), start.alias("start"), tier.alias("tier"), bucket.alias("bucket"), market.alias("market"))


def fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy(F.concat(F.lit("C"), F.col("n_regionkey").cast("string")).alias("currency"), F.to_date("o_orderdate").alias("date")).agg((0.5 + F.max("o_custkey") / 1000.0).alias("rate"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.panel import returns_from_prior_observation

    return returns_from_prior_observation(levels(spark, sf_dir))


def fridays(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.panel import weekly_calendar

    return weekly_calendar(_printed(spark, sf_dir), 5)


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.panel import period_returns

    return period_returns(returns(spark, sf_dir), fridays(spark, sf_dir))


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weekly(spark, sf_dir).groupBy("date").agg(F.avg("ret").alias("bench"))


def vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    known = F.to_date("ts")
    keyed = e.select(F.col("event_type").alias("series_id"), F.date_sub(known, (F.col("event_id") % 45).cast("int")).alias("period_end"), known.alias("knowledge_date"), "event_id", F.struct("value", (1 + F.col("event_id") % 3).cast("int").alias("grading")).alias("x"))
    last = keyed.groupBy("series_id", "period_end", "knowledge_date").agg(F.max_by("x", "event_id").alias("x"))
    return last.select("series_id", "period_end", "knowledge_date", "x.value", "x.grading")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.to_date("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("family"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("cost"), (F.col("o_custkey") % 50).alias("hypothesis"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    one = li.groupBy(F.col("l_orderkey").alias("run_id")).agg(F.max("l_discount").alias("net_ir"), F.max(F.when(F.col("l_linenumber") > 1, F.col("l_quantity"))).alias("turnover"))
    return one.unpivot("run_id", ["net_ir", "turnover"], "name", "value").where("value is not null")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    one = li.groupBy(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("ord")).agg(F.min_by("l_returnflag", F.struct("l_partkey", "l_suppkey")).alias("flag"))
    return one.select("run_id", F.concat(F.lit("v"), F.col("ord").cast("string")).alias("veto"), "ord", (F.col("flag") != "R").alias("passed"))


def _fridays_of(spark: SparkSession, sf_dir: str, value: Column) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.weekday(F.to_date("l_shipdate")) == 4)
    return li.groupBy(F.to_date("l_shipdate").alias("date"), _series("l_suppkey").alias("series_id")).agg(value.alias("q"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:

    q = _fridays_of(spark, sf_dir, F.sum(F.col("l_quantity").cast("bigint")))
    return q.select("date", "series_id", (F.col("q") / F.sum("q").over(Window.partitionBy("date"))).alias("w"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:

    q = _fridays_of(spark, sf_dir, F.max("l_quantity"))
    return q.select("date", "series_id", F.col("q").alias("score"), F.lead("q").over(Window.partitionBy("series_id").orderBy("date")).alias("fwd"))


def pvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("test"), (((F.col("p_partkey") * 7919) % 1009) / 2018.0).alias("p"))
