"""Queries of covariances as of a date, mandates, planted signals and audit cells, fit and stability of loadings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import book, cells, covariance, fit, loadings, mandate, rule, stats, windows
from ..operators.lineage import cut
from ..sources import hosted as h
from ..sources import synthetic
from .model_queries import FACTORS, losses, ols, panel  # noqa: F401
from .registry import query
from .stat_queries import draws


def universes(spark, sf):
    """Weekly returns with the region as universe."""
    m = h.meta(spark, sf).select("series_id", F.col("region").alias("universe"))
    return h.weekly(spark, sf).join(m, "series_id").select("universe", "series_id", "date", "ret")


_PAIRS = """u AS (SELECT region AS universe, series_id, date, ret FROM weekly JOIN meta USING (series_id)),
c AS (SELECT a.universe, a.series_id AS a, b.series_id AS b, covar_samp(a.ret, b.ret) AS cov FROM u a JOIN u b USING (universe, date) WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2, 3)"""


@query("k15_rescaled_volatility", f"""
WITH {_PAIRS},
k AS (SELECT universe, date, pow(0.5::DOUBLE, (row_number() OVER (PARTITION BY universe ORDER BY date DESC) - 1) / 26.0::DOUBLE) AS w FROM (SELECT DISTINCT universe, date FROM u)),
n AS (SELECT universe, date, w / sum(w) OVER (PARTITION BY universe) AS w FROM k),
f AS (SELECT universe, series_id, sum(w * coalesce(ret, 0) * coalesce(ret, 0)) - pow(sum(w * coalesce(ret, 0)), 2) AS fast FROM u JOIN n USING (universe, date) GROUP BY 1, 2),
s AS (SELECT f.universe, series_id, sqrt(greatest(fast, 0) / cov) AS s FROM f JOIN c ON c.universe = f.universe AND c.a = series_id AND c.b = series_id WHERE cov > 0)
SELECT c.universe, c.a, c.b, r(cov * x.s * y.s) AS cov FROM c JOIN s x ON x.universe = c.universe AND x.series_id = c.a JOIN s y ON y.universe = c.universe AND y.series_id = c.b""")
def rescaled(spark, sf):
    return covariance.rescaled_pairs(universes(spark, sf), 26.0)


def rebalance_dates(spark, sf):
    """Every Friday, for every region."""
    f = h.fridays(spark, sf).select(F.col("date").alias("as_of")).distinct()
    return h.meta(spark, sf).select(F.col("region").alias("universe")).distinct().crossJoin(F.broadcast(f))  # one row a week of the calendar


@query("k17_trailing_covariance")
def trailing(spark, sf):
    return covariance.trailing(universes(spark, sf), rebalance_dates(spark, sf), [], present=0.5, half_life=26.0)


def with_leg(spark, sf):
    """Each universe with its equal-weighted mean as a benchmark leg."""
    u = universes(spark, sf)
    leg = u.where("ret is not null").groupBy("universe", "date").agg(F.avg("ret").alias("ret")).select("universe", F.lit("LEG").alias("series_id"), "date", "ret")
    return u.unionByName(leg)


@query("k16_embedded_legs")
def embedded(spark, sf):
    return covariance.trailing(with_leg(spark, sf), rebalance_dates(spark, sf), ["LEG"], present=0.5)


@query("k19_effective_breadth")
def breadth(spark, sf):
    return covariance.breadth(universes(spark, sf), h.bench(spark, sf), [1, 4, 13, 52], least=8)


_LEAST = """z AS (SELECT universe, date, row_number() OVER (PARTITION BY universe ORDER BY date DESC) AS k FROM (SELECT DISTINCT region AS universe, date FROM weekly JOIN meta USING (series_id))),
win AS (SELECT universe, date, count(*) OVER (PARTITION BY universe) AS t FROM z WHERE k <= 156),
u AS (SELECT universe, series_id, date, t, ret FROM weekly JOIN (SELECT series_id, region AS universe FROM meta) USING (series_id) JOIN win USING (universe, date)),
live AS (SELECT universe, series_id FROM u GROUP BY 1, 2 HAVING count(ret) >= 0.5 * any_value(t)),
g AS (SELECT l.universe, l.series_id, win.date, win.t, coalesce(u.ret, 0) AS x FROM live l JOIN win USING (universe) LEFT JOIN u ON u.universe = l.universe AND u.series_id = l.series_id AND u.date = win.date),
x AS (SELECT universe, series_id, date, t, x - avg(x) OVER (PARTITION BY universe, series_id) AS x FROM g),
p AS (SELECT universe, a.series_id AS a, b.series_id AS b, any_value(a.t) AS t, avg(a.x * b.x) AS s, avg(a.x * a.x * b.x * b.x) AS q, avg(a.x * a.x * a.x * b.x) AS th FROM x a JOIN x b USING (universe, date) GROUP BY 1, 2, 3),
v AS (SELECT universe, a AS id, sqrt(s) AS sd, s AS var, count(*) OVER (PARTITION BY universe) AS n, avg(s) OVER (PARTITION BY universe) AS mu FROM p WHERE a = b),
j AS (SELECT p.*, i.sd AS sa, i.var AS va, k.sd AS sb, i.n, i.mu FROM p JOIN v i ON i.universe = p.universe AND i.id = a JOIN v k ON k.universe = p.universe AND k.id = b)"""


@query("k13_ledoit_wolf", f"""
WITH {_LEAST},
r0 AS (SELECT universe, sum(CASE WHEN a <> b AND sa * sb > 0 THEN s / (sa * sb) ELSE 0 END) / any_value(n * (n - 1)) AS rbar FROM j GROUP BY 1),
f AS (SELECT j.*, rbar, CASE WHEN a = b THEN s ELSE rbar * sa * sb END AS f, q - s * s AS pi FROM j JOIN r0 USING (universe)),
k AS (SELECT universe, least(greatest((sum(pi) - sum(CASE WHEN a = b THEN pi WHEN sa > 0 THEN rbar * sb / sa * (th - va * s) ELSE 0 END)) / sum((s - f) * (s - f)) / any_value(t), 0), 1) AS k FROM f GROUP BY 1)
SELECT universe, a, b, r(k * f + (1 - k) * s) AS cov, r(k) AS shrinkage FROM f JOIN k USING (universe)""")
def ledoit_wolf(spark, sf):
    return covariance.shrunk(universes(spark, sf), "constant_correlation", present=0.5)


@query("k14_ledoit_wolf_identity", f"""
WITH {_LEAST},
f AS (SELECT j.*, CASE WHEN a = b THEN mu ELSE 0 END AS f FROM j),
k AS (SELECT universe, least(greatest(sum(q - s * s) / sum((s - f) * (s - f)) / any_value(t), 0), 1) AS k FROM f GROUP BY 1)
SELECT universe, a, b, r(k * f + (1 - k) * s) AS cov, r(k) AS shrinkage FROM f JOIN k USING (universe)""")
def identity(spark, sf):
    return covariance.shrunk(universes(spark, sf), "identity", present=0.5)


_PANEL = """fa AS (SELECT date, avg(ret) AS market, avg(ret) FILTER (region = 'ASIA') - avg(ret) AS tilt FROM weekly JOIN meta USING (series_id) GROUP BY 1),
pn AS (SELECT series_id AS instrument, date, ret, market, tilt, CASE WHEN ret IS NOT NULL THEN 1 END AS ok FROM weekly JOIN fa USING (date) WHERE tilt IS NOT NULL)"""
_OLS = f"""{_PANEL},
sm AS (SELECT instrument, date, count(ok) OVER w AS n, sum(market * ok) OVER w AS s1, sum(tilt * ok) OVER w AS s2, sum(ret) OVER w AS sy, sum(market * market * ok) OVER w AS s11, sum(market * tilt * ok) OVER w AS s12, sum(tilt * tilt * ok) OVER w AS s22, sum(market * ret) OVER w AS s1y, sum(tilt * ret) OVER w AS s2y, sum(ret * ret) OVER w AS syy
       FROM pn WINDOW w AS (PARTITION BY instrument ORDER BY date ROWS 155 PRECEDING)),
ce AS (SELECT instrument, date, n, s11 - s1 * s1 / n AS c11, s12 - s1 * s2 / n AS c12, s22 - s2 * s2 / n AS c22, s1y - s1 * sy / n AS c1, s2y - s2 * sy / n AS c2, syy - sy * sy / n AS cy FROM sm WHERE n >= 104),
be AS (SELECT *, (c22 * c1 - c12 * c2) / (c11 * c22 - c12 * c12) AS b1, (c11 * c2 - c12 * c1) / (c11 * c22 - c12 * c12) AS b2 FROM ce),
va AS (SELECT *, (cy - b1 * c1 - b2 * c2) / (n - 3) AS v FROM be)"""


@query("k31_rolling_ols", f"""
WITH {_OLS} SELECT instrument, date, 'market' AS factor, r(b1) AS loading, r(sqrt(v * c22 / (c11 * c22 - c12 * c12))) AS se, r(v) AS resid_var, n::INT AS n FROM va
UNION ALL SELECT instrument, date, 'tilt', r(b2), r(sqrt(v * c11 / (c11 * c22 - c12 * c12))), r(v), n::INT FROM va""")
def rolling(spark, sf):
    return ols(spark, sf)


_PREDICTED = f"""{_OLS},
la AS (SELECT pn.instrument, pn.date, ret, market, tilt, lag(b1) OVER w AS b1, lag(b2) OVER w AS b2 FROM pn LEFT JOIN be USING (instrument, date) WINDOW w AS (PARTITION BY pn.instrument ORDER BY pn.date)),
pr AS (SELECT instrument, date, ret, b1 * market + b2 * tilt AS p, b1 * market AS p1, b2 * tilt AS p2 FROM la WHERE ret IS NOT NULL AND b1 IS NOT NULL)"""
_HUBER = "CASE WHEN abs({x}) <= 1.345 THEN 0.5 * ({x}) * ({x}) ELSE 1.345 * abs({x}) - 0.5 * 1.345 * 1.345 END"


@query("k38_predicted_losses", f"WITH {_PREDICTED} SELECT instrument, r(avg({_HUBER.format(x='ret - p')})) AS loss, count(*) AS n FROM pr GROUP BY 1")
def predicted(spark, sf):
    return losses(spark, sf)


def predictions(spark, sf):
    return loadings.predicted(panel(spark, sf), FACTORS, "ols")


@query("k64_skill", f"WITH {_PREDICTED} SELECT instrument, count(*) AS n, r(1 - sum((ret - p) * (ret - p)) / sum(ret * ret)) AS r2, r(1 - sum({_HUBER.format(x='ret - p')}) / sum({_HUBER.format(x='ret')})) AS huber_skill, r(corr(p, ret)) AS corr FROM pr GROUP BY 1")
def skill(spark, sf):
    return fit.skill(predictions(spark, sf), ["instrument"])


@query("k64_factor_shares", f"WITH {_PREDICTED} SELECT 'market' AS factor, r(sum(p * p1) / sum(p * p)) AS share FROM pr UNION ALL SELECT 'tilt', r(sum(p * p2) / sum(p * p)) FROM pr")
def shares(spark, sf):
    return fit.factor_shares(predictions(spark, sf), [])


@query("k64_rank_correlations", f"""
WITH {_PREDICTED}, rk AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY p) + (count(*) OVER (PARTITION BY date, p) - 1) / 2.0 AS a, rank() OVER (PARTITION BY date ORDER BY ret) + (count(*) OVER (PARTITION BY date, ret) - 1) / 2.0 AS b FROM pr),
d AS (SELECT date, corr(a, b) AS rho, count(*) AS n FROM rk GROUP BY 1 HAVING count(*) >= 5)
SELECT r(avg(rho)) AS mean, r(stddev_samp(rho)) AS sd, r(avg((rho > 0)::INT)) AS above_zero, count(*) AS weeks FROM d""")
def ranks(spark, sf):
    d = fit.rank_correlations(predictions(spark, sf))
    return d.agg(F.avg("rho").alias("mean"), F.stddev_samp("rho").alias("sd"), F.avg((F.col("rho") > 0).cast("int")).alias("above_zero"), F.count("*").alias("weeks"))


@query("k64_stability", f"""
WITH {_OLS}, b AS (SELECT instrument, date, 'market' AS factor, b1 AS x FROM be UNION ALL SELECT instrument, date, 'tilt', b2 FROM be),
e AS (SELECT 'plain' AS estimator, * FROM b UNION ALL SELECT 'halved', instrument, date, factor, x / (1 + day(date) % 2) FROM b),
l AS (SELECT estimator, factor, abs(x - lag(x, 1) OVER w) AS weekly, abs(x - lag(x, 52) OVER w) AS annual FROM e WINDOW w AS (PARTITION BY estimator, instrument, factor ORDER BY date)),
m AS (SELECT estimator, factor, 'weekly' AS label, avg(weekly) AS change FROM l GROUP BY 1, 2 UNION ALL SELECT estimator, factor, 'annual', avg(annual) FROM l GROUP BY 1, 2)
SELECT m.estimator, factor, label, r(m.change) AS change, r(m.change / f.change) AS ratio FROM m JOIN (SELECT * FROM m WHERE estimator = 'plain') f USING (factor, label)""")
def stability(spark, sf):
    b = cut(ols(spark, sf).select("instrument", "date", "factor", "loading"))  # estimated once, read several times
    both = b.withColumn("estimator", F.lit("plain")).unionByName(b.withColumn("loading", F.col("loading") / (1 + F.dayofmonth("date") % 2)).withColumn("estimator", F.lit("halved")))
    return fit.stability(both, "plain", {"weekly": 1, "annual": 52})


@query("d37_quartiles", f"WITH {_PREDICTED}, c AS (SELECT instrument, corr(p, ret) AS c FROM pr GROUP BY 1 HAVING count(*) >= 26) SELECT count(c) AS n, r(quantile_cont(c, 0.25)) AS q1, r(median(c)) AS median, r(quantile_cont(c, 0.75)) AS q3 FROM c")
def quartiles(spark, sf):
    return fit.skill(predictions(spark, sf), ["instrument"]).where("n >= 26").agg(*fit.quartiles("corr"))


@query("d39_fit_stability")
def fit_stability(spark, sf):
    """How far the ten restarts of each week's regime fit agree with the best one."""
    return fit.restart_stability(loadings.restart_agreement(panel(spark, sf), FACTORS))


@query("e38_column_mean_corr", """
WITH j AS (SELECT series_id, corr(score, fwd) AS c, count(*) AS n, stddev_samp(score) AS sx, stddev_samp(fwd) AS sy FROM scores WHERE score IS NOT NULL AND fwd IS NOT NULL GROUP BY 1 HAVING count(*) > 2)
SELECT region, r(avg(c)) AS corr, count(*) AS series FROM j JOIN meta USING (series_id) WHERE sx > 0 AND sy > 0 GROUP BY 1""")
def mean_corr(spark, sf):
    s = h.scores(spark, sf).join(h.meta(spark, sf).select("series_id", "region"), "series_id")
    return fit.column_mean_corr(s.select("series_id", "date", "region", F.col("score").alias("x")), s.select("series_id", "date", F.col("fwd").alias("y")), ["region"])


@query("c13_twins", "SELECT l_linenumber AS horizon, r(avg(l_discount) FILTER (l_returnflag = 'R')) AS base, r(avg(l_discount) FILTER (l_returnflag = 'N')) AS frictionless FROM lineitem GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'R') > 0 AND count(*) FILTER (l_returnflag = 'N') > 0")
def twins(spark, sf):
    tag = F.when(F.col("l_returnflag") == "R", "base").when(F.col("l_returnflag") == "N", "frictionless").otherwise("other")
    return fit.twins(h.table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("horizon"), tag.alias("tag"), "l_discount"), ["horizon"], "l_discount", "base", "frictionless")


@query("f8_largest_active", "WITH n AS (SELECT w.date, w.series_id, w.w - 1.0::DOUBLE / count(*) OVER (PARTITION BY w.date) AS active FROM weights w), k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(active)::FLOAT DESC, series_id) AS k FROM n) SELECT date, series_id, r(abs(active)) AS size FROM k WHERE k = 1")
def largest(spark, sf):
    w = h.weights(spark, sf).withColumn("active", (F.col("w") - 1 / F.count("*").over(Window.partitionBy("date"))).cast("float"))
    return fit.largest(w, ["date"], "series_id", "active").withColumn("size", F.col("size").cast("double"))


@query("h20_conviction_series", """
WITH s AS (SELECT date, [count(*) FILTER (score < 20), count(*) FILTER (score BETWEEN 20 AND 40), count(*) FILTER (score > 40)]::DOUBLE[] AS c FROM scores GROUP BY 1),
p AS (SELECT date, list_transform(c, lambda x: x / list_sum(c)) AS p FROM s)
SELECT date, r(round(least(greatest(1 + list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / ln(3), 0), 1), 12)) AS entropy, r((list_max(p) - 1.0::DOUBLE / 3) / (1 - 1.0::DOUBLE / 3)) AS max_probability FROM p""")
def conviction(spark, sf):
    """Both measures of each date's probabilities of three states, side by side."""
    c = F.array(*[F.count_if(x).cast("double") for x in (F.col("score") < 20, F.col("score").between(20, 40), F.col("score") > 40)])
    p = h.scores(spark, sf).groupBy("date").agg(c.alias("c")).select("date", scalars.normalised(F.col("c")).alias("p"))
    return p.select("date", F.round(scalars.entropy_conviction(F.col("p")), 12).alias("entropy"), scalars.max_probability_conviction(F.col("p")).alias("max_probability"))


@query("k40_block_permuted", """
WITH d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS k FROM (SELECT DISTINCT date FROM weekly)),
m AS (SELECT date, row_number() OVER (ORDER BY ('0x' || substr(md5('block|7|' || (k // 13)), 1, 13))::BIGINT, k) - 1 AS at FROM d)
SELECT w.series_id, t.date, r(w.ret) AS ret FROM weekly w JOIN m USING (date) JOIN d t ON t.k = m.at""")
def permuted(spark, sf):
    return stats.block_permuted(h.weekly(spark, sf), 13, 7)


@query("k39_block_bootstrap", """
WITH wk AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS week FROM bench WHERE bench IS NOT NULL), n AS (SELECT count(*) AS n FROM wk),
g AS (SELECT d::INT AS draw, j, floor(('0x' || substr(md5('start|3|' || d || '|' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * (n - 13 + 1))::INT AS s, n FROM n, range(20) t(d), range(ceil(n / 13.0)::BIGINT) v(j)),
o AS (SELECT draw, s + o AS week FROM g, range(13) q(o) WHERE j * 13 + o < n),
x AS (SELECT series_id AS name, week, ret - avg(ret) OVER (PARTITION BY series_id) AS x FROM weekly JOIN wk USING (date) WHERE ret IS NOT NULL)
SELECT draw, name, r(avg(x)) AS mean FROM o JOIN x USING (week) GROUP BY 1, 2""")
def bootstrap(spark, sf):
    weeks = h.bench(spark, sf).where("bench is not null").withColumn("week", F.row_number().over(Window.orderBy("date")) - 1)  # one row a week
    n = weeks.count()
    x = h.weekly(spark, sf).where("ret is not null").join(weeks, "date").select(F.col("series_id").alias("name"), "week", F.col("ret").alias("x"))
    return stats.block_bootstrap(x, stats.bootstrap_starts(spark, n, 13, 20, 3))


_NULLS = "t0s AS (SELECT l_suppkey AS test, max(l_discount * l_quantity) AS t FROM lineitem WHERE l_linenumber = 1 GROUP BY 1), n0s AS (SELECT o_custkey % 200 AS draw, l_suppkey AS test, max(l_discount * l_quantity) AS t0 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber > 1 GROUP BY 1, 2), ps AS (SELECT test, avg(x) AS m, stddev_samp(x) AS s FROM (SELECT test, t AS x FROM t0s UNION ALL SELECT test, t0 FROM n0s) GROUP BY 1), ts AS (SELECT test, (t - m) / s AS t FROM t0s JOIN ps USING (test)), ns AS (SELECT draw, test, (t0 - m) / s AS t0 FROM n0s JOIN ps USING (test))"


def _stepdown(rounds: int = 8, alpha: float = 0.05) -> str:
    """The rounds of a stepdown, one after the other; a round after the last rejects nothing and gives no row."""
    parts, out = [_NULLS, "a0 AS (SELECT test, t FROM ts)", "f0 AS (SELECT 0.0::DOUBLE AS floor, true AS goes)"], []
    for i in range(rounds):
        parts += [
            f"m{i} AS (SELECT draw, max(t0) AS top FROM ns WHERE test IN (SELECT test FROM a{i}) GROUP BY 1)",
            f"p{i} AS (SELECT test, t, greatest((1 + (SELECT count(*) FILTER (top >= a.t) FROM m{i})) / (1.0::DOUBLE + (SELECT count(*) FROM m{i})), floor) AS p FROM a{i} a, f{i} WHERE goes)",
            f"h{i} AS (SELECT count(*) FILTER (p <= {alpha}) AS n FROM p{i})",
            f"a{i + 1} AS (SELECT test, t FROM p{i} WHERE p > {alpha})",
            f"f{i + 1} AS (SELECT coalesce((SELECT max(p) FROM p{i} WHERE p <= {alpha}), 0.0) AS floor, n > 0 AS goes FROM h{i})",
        ]
        out.append(f"SELECT test, r(p) AS p, p <= {alpha} AS rejected FROM p{i}, h{i} WHERE p <= {alpha} OR n = 0")
    return "WITH " + ",\n".join(parts) + "\n" + " UNION ALL ".join(out)


@query("k46_romano_wolf", _stepdown())
def romano_wolf(spark, sf):
    return stats.romano_wolf(*stats.standardised_columns(*draws(spark, sf)))


def _stepdown_of_two(rounds: int = 6, alpha: float = 0.05) -> str:
    """The rounds of the stepdown that allows one false rejection: from the second on each rejected test joins the active ones in turn."""
    parts, out = [_NULLS, "k AS (SELECT count(DISTINCT draw) AS k FROM ns)", "s0 AS (SELECT test, t, 'a' AS state, NULL::DOUBLE AS p FROM ts)", "f0 AS (SELECT 0.0::DOUBLE AS floor, true AS goes)"], []
    for i in range(rounds):
        first = i == 0
        pool = "SELECT NULL::BIGINT AS way" if first else f"SELECT test AS way FROM s{i} WHERE state = 'r'"
        parts += [
            f"o{i} AS (SELECT draw, list(t0 ORDER BY t0 DESC)[1:2] AS a FROM ns WHERE test IN (SELECT test FROM s{i} WHERE state = 'a') GROUP BY 1)",
            f"c{i} AS (SELECT way, draw, " + ("a[2]" if first else "greatest(coalesce(a[2], '-inf'::DOUBLE), least(a[1], coalesce(t0, '-inf'::DOUBLE)))") + f" AS c FROM ({pool}) w CROSS JOIN o{i}" + ("" if first else " LEFT JOIN (SELECT draw, test AS way, t0 FROM ns) x USING (draw, way)") + ")",
            f"w{i} AS (SELECT test, max(p) AS worst FROM (SELECT test, way, (1 + count(*) FILTER (c >= t)) / (1.0::DOUBLE + (SELECT k FROM k)) AS p FROM s{i} CROSS JOIN c{i} WHERE state = 'a' GROUP BY 1, 2) GROUP BY 1)",
            f"h{i} AS (SELECT count(*) FILTER (worst <= {alpha}) AS n, max(worst) FILTER (worst <= {alpha}) AS top, count(*) FILTER (worst <= {alpha}) + (SELECT count(*) FROM s{i} WHERE state = 'r') AS done FROM w{i})",
            f"s{i + 1} AS (SELECT test, t, CASE WHEN state <> 'a' THEN state WHEN worst <= {alpha} THEN 'r' WHEN n = 0 OR done < 2 THEN 'e' ELSE 'a' END AS state, CASE WHEN state <> 'a' THEN p WHEN worst <= {alpha} OR n = 0 THEN greatest(worst, floor) WHEN done < 2 THEN 1.0 END AS p FROM s{i} LEFT JOIN w{i} USING (test), h{i}, f{i})",
            f"f{i + 1} AS (SELECT greatest(floor, coalesce(top, 0)) AS floor, n > 0 AS goes FROM f{i}, h{i})",
        ]
    return "WITH " + ",\n".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts) + f"\nSELECT test, r(p) AS p, state = 'r' AS rejected, CASE WHEN count(*) OVER () < 8 THEN 1 ELSE 2 END::INT AS g, count(*) OVER () AS n_tests, (SELECT k FROM k) AS n_shuffles FROM s{rounds}"


@query("k49_gate", _stepdown_of_two())
def gate(spark, sf):
    return stats.gate(*draws(spark, sf))


def _batched(families: int, rounds: int = 8, alpha: float = 0.05) -> str:
    """As _stepdown, each family by itself."""
    parts, out = [_NULLS, f"nf AS (SELECT test % {families} AS family, draw, test, t0 FROM ns)", "k AS (SELECT family, count(DISTINCT draw) AS k FROM nf GROUP BY 1)", f"a0 AS (SELECT test % {families} AS family, test, t, 0.0::DOUBLE AS floor FROM ts)"], []
    for i in range(rounds):
        parts += [
            f"m{i} AS (SELECT family, draw, max(t0) AS top FROM nf SEMI JOIN a{i} USING (family, test) GROUP BY 1, 2)",
            f"p{i} AS (SELECT family, test, any_value(a.t) AS t, greatest((1 + count(*) FILTER (top >= a.t)) / (1.0::DOUBLE + any_value(k)), any_value(floor)) AS p FROM a{i} a JOIN m{i} USING (family) JOIN k USING (family) GROUP BY 1, 2)",
            f"h{i} AS (SELECT family, count(*) FILTER (p <= {alpha}) AS n, max(p) FILTER (p <= {alpha}) AS top FROM p{i} GROUP BY 1)",
            f"a{i + 1} AS (SELECT family, test, t, top AS floor FROM p{i} JOIN h{i} USING (family) WHERE p > {alpha} AND n > 0)",
        ]
        out.append(f"SELECT family, test, r(p) AS p, p <= {alpha} AS rejected FROM p{i} JOIN h{i} USING (family) WHERE p <= {alpha} OR n = 0")
    return "WITH " + ",\n".join(p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts) + "\n" + " UNION ALL ".join(out)


@query("k50_batched_stepdown", _batched(16))
def batched(spark, sf):
    """Sixteen families of tests step down in the same jobs, each until its own round rejects nothing."""
    t, n = stats.standardised_columns(*draws(spark, sf))
    family = (F.col("test") % 16).alias("family")
    return stats.stepdown(t.select(family, "test", "t"), n.select(family, "draw", "test", "t0"))


_Z = "sqrt(-2 * ln(1 - ('0x' || substr(md5(rep || '|' || test || '|1'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)) * cos(2 * 3.141592653589793::DOUBLE * (('0x' || substr(md5(rep || '|' || test || '|2'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE))"


@query("k51_error_rates", f"""
WITH x AS (SELECT rep, test, {_Z} + CASE WHEN test < 3 THEN 3.0::DOUBLE ELSE 0 END AS t FROM range(500) a(rep), range(10) b(test)),
p AS (SELECT rep, test, 1 / (1 + exp(1.5976::DOUBLE * t + 0.070566::DOUBLE * t * t * t)) AS p FROM x),
k AS (SELECT *, row_number() OVER (PARTITION BY rep ORDER BY p, test) AS i FROM p),
q AS (SELECT rep, test, max((10 - i + 1) * p) OVER (PARTITION BY rep ORDER BY i) AS holm, min(10 * p / i) OVER (PARTITION BY rep ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bh FROM k),
l AS (SELECT rep, test, 'holm' AS procedure, holm AS q FROM q UNION ALL SELECT rep, test, 'bh', bh FROM q UNION ALL SELECT rep, test, 'by_p', bh * (SELECT sum(1.0::DOUBLE / i) FROM range(1, 11) z(i)) FROM q),
c AS (SELECT procedure, rep, count(*) FILTER (q <= 0.05 AND test >= 3) AS v, count(*) FILTER (q <= 0.05 AND test < 3) AS s FROM l GROUP BY 1, 2)
SELECT procedure, r(avg((v > 0)::INT)) AS fwer, r(avg((v >= 2)::INT)) AS p2, r(avg(v / greatest(v + s, 1))) AS fdr, r(avg(CASE WHEN v + s > 0 THEN v / (v + s) END)) AS pfdr, r(avg(s / 3.0::DOUBLE)) AS power FROM c GROUP BY 1""")
def error_rates(spark, sf):
    """Replicated families of ten tests, three of them false: error rates and power of three procedures."""
    reps = spark.range(500).select(F.col("id").alias("rep"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("test"))
    z = scalars.normal(F.col("rep").cast("string"), F.col("test").cast("string"))
    x = reps.withColumn("t", z + F.when(F.col("test") < 3, 3.0).otherwise(0.0))
    p = x.withColumn("p", 1 / (1 + F.exp(1.5976 * F.col("t") + 0.070566 * F.col("t") * F.col("t") * F.col("t")))).select("rep", "test", "p")
    both = stats.step_up(stats.step_up(stats.holm(p, "rep"), "bh", family="rep"), "by_p", dependent=True, family="rep")
    long = both.unpivot(["rep", "test"], ["holm", "bh", "by_p"], "procedure", "q")
    per = long.groupBy("procedure", "rep").agg(F.count_if((F.col("q") <= 0.05) & (F.col("test") >= 3)).alias("v"), F.count_if((F.col("q") <= 0.05) & (F.col("test") < 3)).alias("s"))
    r = F.col("v") + F.col("s")
    return per.groupBy("procedure").agg(F.avg((F.col("v") > 0).cast("int")).alias("fwer"), F.avg((F.col("v") >= 2).cast("int")).alias("p2"), F.avg(F.col("v") / F.greatest(r, F.lit(1))).alias("fdr"), F.avg(F.when(r > 0, F.col("v") / r)).alias("pfdr"), F.avg(F.col("s") / 3).alias("power"))


@query("k52_planted_signal", "SELECT r(0.1::DOUBLE) AS ic, count(*) AS n FROM scores WHERE fwd IS NOT NULL")
def planted(spark, sf):
    """The planted correlation is exact."""
    d = h.scores(spark, sf).where("fwd is not null").select("series_id", "date", F.col("fwd").cast("double").alias("z"))
    return synthetic.planted_scores(d, 0.1, 5).join(d, ["series_id", "date"]).agg(F.corr("score", "z").alias("ic"), F.count("*").alias("n"))


@query("k53_planted_columns", "SELECT series_id, r(0.2::DOUBLE) AS ic, count(*) AS n FROM scores WHERE fwd IS NOT NULL GROUP BY 1 HAVING count(*) > 8 AND stddev_pop(fwd) > 0")
def columns(spark, sf):
    """Each series has the planted correlation by itself."""
    d = h.scores(spark, sf).where("fwd is not null").select("series_id", "date", F.col("fwd").cast("double").alias("z"))
    s = synthetic.planted_scores(d, 0.2, 5, by_column=True).join(d, ["series_id", "date"])
    return s.groupBy("series_id").agg(F.corr("score", "z").alias("ic"), F.count("*").alias("n")).where("n > 8")


@query("k54_planted_benchmark", "SELECT r(0.5::DOUBLE) AS ir, r(0.04::DOUBLE) AS risk, r(0.0::DOUBLE) AS gap, count(*) AS n FROM bench WHERE bench IS NOT NULL")
def planted_benchmark(spark, sf):
    """The path's ratio over its planted benchmark is exact, and benchmark plus active stream is the path."""
    p = synthetic.planted_benchmark(h.bench(spark, sf).where("bench is not null").select("date", F.col("bench").alias("net")), 0.5, 0.04, 9)
    sd = F.stddev_samp("active")
    gap = F.round(F.max(F.abs(F.col("net") - F.col("active") - F.col("bench"))), 9)
    return p.agg((F.avg("active") * 52 / (sd * F.sqrt(F.lit(52)))).alias("ir"), (sd * F.sqrt(F.lit(52))).alias("risk"), gap.alias("gap"), F.count("*").alias("n"))


@query("k59_axis_inputs", """
WITH m AS (SELECT DISTINCT series_id, date FROM weights), w AS (SELECT region, date, ret FROM weekly JOIN m USING (series_id, date) JOIN meta USING (series_id)),
f AS (SELECT region, w.date, avg(ret) - any_value(bench) AS factor, count(ret) AS n FROM w JOIN bench USING (date) GROUP BY 1, 2)
SELECT region, date, r(factor) AS factor, r(CASE WHEN count(factor) OVER x >= 26 THEN stddev_samp(factor) OVER x END) AS sigma, n FROM f WINDOW x AS (PARTITION BY region ORDER BY date ROWS 51 PRECEDING)""")
def axis_inputs(spark, sf):
    """Region factors over the series that the book has a row for on the date."""
    members = h.weights(spark, sf).select("series_id", "date").distinct().join(h.meta(spark, sf).select("series_id", "region"), "series_id")
    return cells.axis_inputs(h.weekly(spark, sf).select("series_id", "date", "ret"), members, h.bench(spark, sf))


def cell_panel(spark, sf):
    m = h.meta(spark, sf).select("series_id", F.col("region").alias("universe"), book.bps(F.col("bucket"), book.HALF_SPREAD).alias("half_spread"), book.bps(F.col("bucket"), book.ANNUAL_DRAG).alias("drag"), (F.col("tier") == "second").alias("is_cash"))
    return h.weekly(spark, sf).join(m, "series_id").select("universe", "date", "series_id", "ret", "half_spread", "drag", "is_cash")


def grid(spark, sf, kind: str, step: int):
    """Cells of every region: planted correlation by seed."""
    g = h.meta(spark, sf).select(F.col("region").alias("universe")).distinct()
    each = g.withColumn("ic", F.explode(F.array(F.lit(0.0), F.lit(0.1)))).withColumn("seed", F.explode(F.array(F.lit(1), F.lit(2))))
    out = each.withColumn("horizon", F.lit(4)).withColumn("cost", F.lit(1.0)).withColumn("step", F.lit(step)).withColumn("half_life", F.lit(26.0)).withColumn("kind", F.lit(kind))
    return out.withColumn("cell", F.concat_ws("/", "universe", "ic", "seed", "kind"))


@query("k55_frictionless")
def frictionless(spark, sf):
    return cells.run_grid(cell_panel(spark, sf), grid(spark, sf, "frictionless", 1), mandate.Mandate(te=0.03), present=0.5)


@query("k29_path_transfer")
def path_transfer(spark, sf):
    """How much of the scores' views the books of every Friday carry under the trailing covariance."""
    cov = cut(universes(spark, sf)), covariance.Trailing(present=0.5)
    m = h.meta(spark, sf).select("series_id", F.col("region").alias("universe"))
    held = h.weights(spark, sf).join(h.scores(spark, sf).select("date", "series_id", "score"), ["date", "series_id"], "left").join(m, "series_id")
    n = F.count("*").over(Window.partitionBy("universe", "date"))
    return covariance.path_transfer(held.select("universe", "date", "series_id", (F.col("w") / F.sum("w").over(Window.partitionBy("universe", "date"))).alias("w"), (F.col("score") / 1000).alias("alpha"), (1 / n).alias("bench")), cov)


_MANDATE = mandate.Mandate(te=0.8, max_cash=0.2, names=30)
#: Covariances of the traded paths, as of each date of views.
TRAILING = covariance.Trailing(("LEG",), present=0.5)


def traded_weekly(spark, sf):
    """A hundredth of the weekly returns, with each region's mean as its leg: hosted levels jump by their own size from day to day."""
    return with_leg(spark, sf).withColumn("ret", F.col("ret") / 100)


def traded_path(spark, sf, alpha, own_rule: rule.Rule, m: mandate.Mandate = _MANDATE):
    """The mandate of each region on every Friday, with its mean return as the benchmark leg. alpha: series_id, date, alpha."""
    own = h.meta(spark, sf).select("series_id", F.col("region").alias("universe"), book.bps(F.col("bucket"), book.HALF_SPREAD).alias("half_spread"), (F.col("tier") == "second").alias("is_cash"))
    dates = rebalance_dates(spark, sf)
    views = own.join(dates.select("universe", F.col("as_of").alias("date")), "universe").join(alpha, ["series_id", "date"], "left").select("universe", "date", "series_id", "alpha", "half_spread", "is_cash")
    weekly = cut(traded_weekly(spark, sf))  # read by covariances and paths several times
    return rule.path(weekly, views, TRAILING, {"LEG": 1.0}, m, own_rule)


@query("k20_long_only_books")
def mandate_books(spark, sf):
    """Scores as alpha, traded every Friday from the book before, without a charge for turnover."""
    alpha = h.scores(spark, sf).select("series_id", "date", (F.col("score") / 10_000).alias("alpha"))
    return rule.books(traded_path(spark, sf, alpha, rule.Rule(view_free_first=False, shadow_bp=0.0)))


def view_path(spark, sf):
    """Scores to z to views over a horizon of four weeks to alpha to books: linear charge on the year's turnover, at most half the book a week."""
    z = windows.standardised(h.scores(spark, sf), 20, 1.5).select("series_id", "date", "z")
    sigma = h.weekly(spark, sf).select("series_id", "date", (F.stddev_samp("ret").over(windows.trailing(52)) / 100).alias("sigma"))
    alpha = z.join(sigma, ["series_id", "date"]).select("series_id", "date", scalars.view_scale(0.05, F.col("sigma"), F.col("z"), F.lit(4.0)).alias("alpha"))
    return traded_path(spark, sf, alpha, rule.Rule(horizon=4.0, cap=0.5))


@query("k24_view_books")
def view_books(spark, sf):
    return rule.books(view_path(spark, sf))


@query("k23_rebalance_log")
def rebalance_log(spark, sf):
    """What each step of the path met, traded, paid and was charged."""
    return rule.log(view_path(spark, sf))
