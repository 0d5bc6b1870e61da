"""Queries of audit grids: whole cell rows from paths, their readings and reports, resolved parameters, views and signals."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import book, diagnostics, grid, report, views
from ..operators.lineage import cut
from ..operators.signals import SIGNALS
from ..params import Params
from ..sources import hosted as h
from .ladder_queries import _MANDATE, TRAILING, traded_weekly
from .registry import query

_PATH = """pt AS (SELECT series_id AS cell, date, ret / 100 AS gross, bench / 100 AS bench, abs(ret) / 10000 AS cost, abs(ret) / 50 AS turnover, 0.2 + month(date) / 100.0::DOUBLE AS te, day(date) / 100.0::DOUBLE AS cash,
day(date)::INT % 30 + 1 AS n_positions, 40 + month(date)::INT AS n_holdable, month(date)::DOUBLE AS shadow_bps, month(date) / 2.0::DOUBLE AS shadow_paid_bps, day(date) % 3 = 0 AS te_binding, day(date) % 4 = 0 AS turnover_binding,
day(date) % 5 = 0 AS cash_binding, day(date) % 7 = 0 AS positions_capped, CASE day(date) % 11 WHEN 0 THEN 'repair' WHEN 1 THEN 'minimum-te' ELSE 'optimal' END AS status, (year(date) - 1990)::DOUBLE AS repaired,
CASE WHEN day(date) % 2 = 0 THEN month(date) / 12.0::DOUBLE END AS transfer, CASE WHEN day(date) % 3 = 0 THEN month(date) / 24.0::DOUBLE END AS transfer_diagonal FROM weekly JOIN bench USING (date) WHERE ret IS NOT NULL),
s1 AS (SELECT *, row_number() OVER w AS k, lag(te) OVER w AS was, CASE WHEN count(*) OVER y = 52 THEN sum(turnover) OVER y END AS ty, lag(turnover, 26) OVER w AS l26, lag(turnover, 52) OVER w AS l52, lag(turnover, 53) OVER w AS l53, lag(turnover, 78) OVER w AS l78
FROM pt WINDOW w AS (PARTITION BY cell ORDER BY date), y AS (PARTITION BY cell ORDER BY date ROWS 51 PRECEDING)),
s2 AS (SELECT *, CASE WHEN k > 1 THEN gross - bench END AS ga, CASE WHEN k > 1 THEN gross - cost - bench END AS a FROM s1),
s3 AS (SELECT *, CASE WHEN was > 0.0001 THEN a / (was / sqrt(52)) END AS z, CASE WHEN count(a) OVER t = 156 THEN stddev_samp(a) OVER t * sqrt(52) END AS tr, sum(ln(1 + greatest(coalesce(a, 0), -0.999999))) OVER u AS g
FROM s2 WINDOW t AS (PARTITION BY cell ORDER BY date ROWS 155 PRECEDING), u AS (PARTITION BY cell ORDER BY date)),
st AS (SELECT *, exp(g - max(g) OVER (PARTITION BY cell ORDER BY date)) - 1 AS dd FROM s3),
yr AS (SELECT cell, year(date)::INT AS year, stddev_samp(z) AS b FROM st GROUP BY 1, 2 HAVING count(z) >= 40),
ca AS (SELECT cell, max(b) AS b, arg_max(year, (b, -year)) AS y, count(*) AS n FROM yr GROUP BY 1)"""


def _echo(k: int) -> str:
    return f"r(CASE WHEN stddev_pop(turnover) FILTER (l{k} IS NOT NULL) * stddev_pop(l{k}) > 0 THEN covar_pop(turnover, l{k}) / (stddev_pop(turnover) FILTER (l{k} IS NOT NULL) * stddev_pop(l{k})) END) AS turnover_autocorr_lag{k}"


_VOL, _MEAN, _TE95 = "stddev_samp(a) * sqrt(52)", "avg(a) * 52", "quantile_cont(tr, 0.95)"


@query("k56_path_diagnostics", f"""
WITH {_PATH}, m AS (
SELECT cell, r(max(turnover)) AS turnover_per_rebalance_max, r(quantile_cont(turnover, 0.95)) AS turnover_per_rebalance_p95, r(max(repaired) * 52 / count(*)) AS turnover_from_repairs_annual,
r(avg(shadow_bps)) AS shadow_bps_mean, r(max(shadow_bps)) AS shadow_bps_max, r(avg(shadow_paid_bps)) AS shadow_paid_bps_mean, {', '.join(_echo(k) for k in diagnostics.LAGS)},
r(CASE WHEN {_VOL} > 1e-12 THEN {_MEAN} / ({_VOL}) END) AS net_ir, r(CASE WHEN stddev_samp(ga) * sqrt(52) > 1e-12 THEN avg(ga) * 52 / (stddev_samp(ga) * sqrt(52)) END) AS gross_ir, r({_MEAN}) AS active_return_annual, r({_VOL}) AS active_vol_annual,
r({_TE95}) AS te_p95, r(max(tr)) AS te_max, r(avg(te)) AS te_ex_ante_mean, r(avg(turnover) * 52) AS turnover_annual, r(quantile_cont(ty, 0.95)) AS turnover_p95_rolling_1y, r(max(ty)) AS turnover_max_rolling_1y,
r(avg(cost) * 52) AS cost_drag_annual, r(min(dd)) AS max_active_drawdown, r(max(cash)) AS max_cash, max(n_positions) AS n_positions_max, r(avg(n_positions)) AS n_positions_mean, r(avg(n_holdable)) AS n_holdable_mean,
r(avg(te_binding::INT)) AS te_binding_share, r(avg(turnover_binding::INT)) AS turnover_binding_share, r(avg(cash_binding::INT)) AS cash_binding_share, r(avg(positions_capped::INT)) AS positions_capped_share,
r(avg((status = 'minimum-te')::INT)) AS infeasible_te_share, r(avg((status = 'repair')::INT)) AS repair_share, count(*) AS n_rebalances, min(date) AS first_date, max(date) AS last_date, min(date) FILTER (turnover > 1e-6) AS first_trade,
r({_VOL} / avg(te)) AS te_realised_to_ex_ante, r({_TE95} / avg(te)) AS te_p95_to_ex_ante, r({_TE95} / 0.3) AS te_p95_to_budget, r(stddev_samp(z)) AS bias_stat, r(CASE WHEN count(z) > 0 THEN 1.96 / sqrt(2.0 * count(z)) END) AS bias_band, count(z) AS bias_n,
r(CASE WHEN count(z) > 1 THEN quantile_cont(z, 0.05) END) AS left_tail_q05, r(CASE WHEN count(z) > 1 THEN abs(quantile_cont(z, 0.05)) / {diagnostics.Z05} END) AS "left_tail_L",
r(avg(transfer)) AS transfer_coefficient, r(avg(transfer_diagonal)) AS transfer_coefficient_diagonal, count(transfer) AS transfer_dates FROM st GROUP BY 1),
j AS (SELECT m.*, r(ca.b) AS bias_worst_annual, ca.y AS bias_worst_year, coalesce(ca.n, 0) AS bias_years_read, concat_ws(';', CASE WHEN NOT coalesce(max_cash <= 0.2 * (1 + 1e-9), false) THEN 'cash' END,
CASE WHEN NOT coalesce(n_positions_max <= 30 * (1 + 1e-9), false) THEN 'positions' END, CASE WHEN NOT coalesce(ca.b <= 1.72 * (1 + 1e-9), false) THEN 'risk_calibration' END) AS veto_detail FROM m LEFT JOIN ca USING (cell))
SELECT *, veto_detail = '' AS passes, coalesce(turnover_p95_rolling_1y > 2.0, false) AS turnover_highlight FROM j""")
def path_diagnostics(spark, sf):
    """Every column that a cell's row takes from its path, on a path made of each series' weeks."""
    day, month = F.dayofmonth("date"), F.month("date")
    p = h.weekly(spark, sf).where("ret is not null").join(h.bench(spark, sf), "date").select(
        F.col("series_id").alias("cell"), "date", (F.col("ret") / 100).alias("gross"), (F.col("bench") / 100).alias("bench"), (F.abs("ret") / 10000).alias("cost"), (F.abs("ret") / 50).alias("turnover"), (0.2 + month / 100).alias("te"),
        (day / 100).alias("cash"), (day % 30 + 1).alias("n_positions"), (40 + month).alias("n_holdable"), month.cast("double").alias("shadow_bps"), (month / 2).alias("shadow_paid_bps"), (day % 3 == 0).alias("te_binding"),
        (day % 4 == 0).alias("turnover_binding"), (day % 5 == 0).alias("cash_binding"), (day % 7 == 0).alias("positions_capped"), F.when(day % 11 == 0, "repair").when(day % 11 == 1, "minimum-te").otherwise("optimal").alias("status"),
        (F.year("date") - 1990).cast("double").alias("repaired"), F.when(day % 2 == 0, month / 12).alias("transfer"), F.when(day % 3 == 0, month / 24).alias("transfer_diagonal"),
    )
    return diagnostics.judged(diagnostics.cell_rows(p, 0.3))


def inputs(spark, sf):
    """What a grid trades in each region: weekly returns with the leg, costs, and how covariances are made of them."""
    weekly = cut(traded_weekly(spark, sf))  # read by plants and paths
    costs = h.meta(spark, sf).select(F.col("region").alias("universe"), "series_id", book.bps(F.col("bucket"), book.HALF_SPREAD).alias("half_spread"), book.bps(F.col("bucket"), book.ANNUAL_DRAG).alias("drag"), (F.col("tier") == "second").alias("is_cash"))
    return weekly, costs, TRAILING


def cells_of(spark, sf, axis: str, ics: list[float]):
    """A cell for each region and planted correlation."""
    each = h.meta(spark, sf).select(F.col("region").alias("universe")).distinct().withColumn("ic", F.explode(F.array(*[F.lit(x) for x in ics])))
    null = F.lit(None).cast("double")
    return each.select(F.concat_ws("/", "universe", F.lit(axis), F.col("ic").cast("string")).alias("cell"), "universe", F.lit("base").alias("tag"), F.lit(axis).alias("axis"), "ic", F.lit(4).alias("horizon"), F.lit(1).alias("seed"), F.lit(1.0).alias("cost"), F.lit("linear").alias("shadow"), F.lit(10.0).alias("shadow_bp"), F.lit(0.5).alias("cap"), null.alias("wall"))


def grid_rows(spark, sf, axis: str, ics: list[float], tiers: bool = False):
    weekly, costs, cov = inputs(spark, sf)
    groups = h.meta(spark, sf).select(F.col("region").alias("universe"), "series_id", F.col("tier").alias("group")) if tiers else None
    return grid.batch_of(weekly, costs, cov, {"LEG": 1.0}, _MANDATE, groups)(cells_of(spark, sf, axis, ics))


@query("k56_grid")
def audit_grid(spark, sf):
    """Whole rows of cells that trade every Friday, one with and one without a signal in each region."""
    return grid_rows(spark, sf, "series", [0.0, 0.1])[0]


@query("k61_pilot_cells")
def pilot(spark, sf):
    """Cells on group factors: the mean excess return of each tier is planted, its view goes to the tier's members."""
    return grid_rows(spark, sf, "group", [0.1], tiers=True)[0]


@query("d15_ladder_breadth")
def ladder_breadth(spark, sf):
    """Decisions a year that the mandate's cells deliver, net of the share of views that their books carry."""
    return grid.ladder_breadth(grid_rows(spark, sf, "series", [0.1])[0])


@query("i5_resumed_grid")
def resumed(spark, sf):
    """A grid that was stopped after its first batch and went on: its rows, with the dates of the base cells' stored weights and alphas (A45)."""
    from ..operators.lineage import checkpoint_folder

    folder = f"{checkpoint_folder(spark)}/brindle-grid-{uuid.uuid4().hex}"
    weekly, costs, cov = inputs(spark, sf)
    run, cells = grid.batch_of(weekly, costs, cov, {"LEG": 1.0}, _MANDATE), cells_of(spark, sf, "series", [0.1])
    ticks = iter([0.0, 0.0, 500.0, 500.0])
    grid.resume(spark, folder, cells, run, deadline=600.0, batch=3, clock=lambda: next(ticks))
    grid.resume(spark, folder, cells, run, batch=3)
    rows = spark.read.parquet(f"{folder}/rows").select("cell", "universe", "n_rebalances", "turnover_annual")
    stored = [spark.read.parquet(f"{folder}/{t}").groupBy("cell").agg(F.count_distinct("date").alias(f"{t}_dates")) for t in ("weights", "alpha")]
    return rows.join(stored[0], "cell", "left").join(stored[1], "cell", "left")


@query("d20_four_readings", """
WITH p AS (SELECT region AS cell, date, score, fwd FROM scores JOIN meta USING (series_id) WHERE score IS NOT NULL AND fwd IS NOT NULL),
k AS (SELECT *, rank() OVER (PARTITION BY cell, date ORDER BY score) + (count(*) OVER (PARTITION BY cell, date, score) - 1) / 2.0::DOUBLE AS rs, rank() OVER (PARTITION BY cell, date ORDER BY fwd) + (count(*) OVER (PARTITION BY cell, date, fwd) - 1) / 2.0::DOUBLE AS rt,
score - avg(score) OVER (PARTITION BY cell, date) AS ds, fwd - avg(fwd) OVER (PARTITION BY cell, date) AS dt FROM p),
d AS (SELECT cell, date, CASE WHEN stddev_pop(score) * stddev_pop(fwd) > 0 THEN corr(score, fwd) END AS p, CASE WHEN stddev_pop(rs) * stddev_pop(rt) > 0 THEN corr(rs, rt) END AS r FROM k GROUP BY 1, 2 HAVING count(*) >= 5),
m AS (SELECT cell, avg(p) AS pearson, avg(r) AS rank FROM d GROUP BY 1)
SELECT cell, r(corr(score, fwd)) AS pooled, r(any_value(pearson)) AS pearson, r(corr(ds, dt)) AS demeaned, r(any_value(rank)) AS rank FROM k LEFT JOIN m USING (cell) GROUP BY 1""")
def four_readings(spark, sf):
    s = h.scores(spark, sf).join(h.meta(spark, sf), "series_id").select(F.col("region").alias("cell"), "date", "series_id", F.col("score").cast("double").alias("score"), F.col("fwd").cast("double").alias("truth"))
    return diagnostics.four_readings(s)


_ROWS = """cr AS (SELECT l_orderkey * 10 + l_linenumber AS cell, CASE l_returnflag WHEN 'R' THEN 'stress' WHEN 'A' THEN 'frictionless' ELSE 'base' END AS tag, round(l_discount * 100)::INT // 2 / 20.0::DOUBLE AS ic, (l_linenumber % 4 + 1)::INT AS horizon,
l_suppkey % 15 AS seed, l_linestatus = 'O' AS baseline, l_tax * 20 - 0.5 AS net_ir, l_discount * 3 AS realised_ic, 0.8 + l_tax AS bias_stat, l_tax / 2 AS bias_band, 1 + l_discount * 10 AS bias_worst_annual, CASE WHEN l_linenumber <> 3 THEN year(l_shipdate)::INT END AS bias_worst_year,
l_quantity / 50 AS "left_tail_L", l_quantity / 100 AS te_p95, l_quantity > 45 AS turnover_highlight, l_quantity <> 1 OR l_linenumber < 7 AS lookahead_passed FROM lineitem)"""


def rows(spark, sf):
    """Line items as cell rows."""
    tag = F.when(F.col("l_returnflag") == "R", "stress").when(F.col("l_returnflag") == "A", "frictionless").otherwise("base")
    d = lambda c: F.col(c).cast("double")
    return h.table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell"), tag.alias("tag"), (F.floor(F.round(d("l_discount") * 100).cast("int") / 2).cast("int") / F.lit(20.0)).alias("ic"), (F.col("l_linenumber") % 4 + 1).cast("int").alias("horizon"),
        (F.col("l_suppkey") % 15).alias("seed"), (F.col("l_linestatus") == "O").alias("baseline"), (d("l_tax") * 20 - 0.5).alias("net_ir"), (d("l_discount") * 3).alias("realised_ic"), (0.8 + d("l_tax")).alias("bias_stat"), (d("l_tax") / 2).alias("bias_band"),
        (1 + d("l_discount") * 10).alias("bias_worst_annual"), F.when(F.col("l_linenumber") != 3, F.year("l_shipdate")).alias("bias_worst_year"), (d("l_quantity") / 50).alias("left_tail_L"), (d("l_quantity") / 100).alias("te_p95"),
        (F.col("l_quantity") > 45).alias("turnover_highlight"), ((F.col("l_quantity") != 1) | (F.col("l_linenumber") < 7)).alias("lookahead_passed"),
    )


@query("d20_readings_by_cell", f"WITH {_ROWS} SELECT r(ic) AS ic, horizon, r(avg(realised_ic)) AS realised_ic, r(avg(net_ir)) AS net_ir FROM cr WHERE tag = 'base' GROUP BY cr.ic, horizon")
def readings_by_cell(spark, sf):
    return report.readings(rows(spark, sf), ["realised_ic", "net_ir"])


@query("d22_calibration", f"""
WITH {_ROWS}, b AS (SELECT * FROM cr WHERE tag = 'base'), y AS (SELECT bias_worst_year AS y, count(*) AS n FROM b WHERE bias_worst_year IS NOT NULL GROUP BY 1)
SELECT r(median(bias_band)) AS bias_band_median, r(median(bias_stat)) AS bias_stat_median, r(median(bias_worst_annual)) AS bias_worst_annual_median, r(max(bias_worst_annual)) AS bias_worst_annual_max, r(median("left_tail_L")) AS "left_tail_L_median",
r(quantile_cont("left_tail_L", 0.05)) AS "left_tail_L_p05", r(quantile_cont("left_tail_L", 0.95)) AS "left_tail_L_p95", r(max("left_tail_L")) AS "left_tail_L_max", r(median(te_p95)) AS te_p95_median, r(max(te_p95)) AS te_p95_max, count(*) AS n_cells,
(SELECT arg_max(y, (n, -y)) FROM y) AS bias_worst_year_mode, r((SELECT max(n) FROM y) / count(bias_worst_year)) AS bias_worst_year_share FROM b""")
def calibration(spark, sf):
    return report.calibration(rows(spark, sf))


@query("d22_pivot", f"WITH {_ROWS} SELECT r(ic) AS ic, {', '.join(f'r(avg(bias_stat) FILTER (horizon = {k})) AS {chr(34)}{k}{chr(34)}' for k in (1, 2, 3, 4))} FROM cr WHERE tag = 'base' GROUP BY cr.ic")
def bias_pivot(spark, sf):
    return report.pivot(rows(spark, sf), "bias_stat", [1, 2, 3, 4])


@query("d22_against_frictionless", f"WITH {_ROWS} SELECT horizon, r(avg(bias_stat) FILTER (tag = 'base')) AS base, r(avg(bias_stat) FILTER (tag = 'frictionless')) AS frictionless FROM cr GROUP BY 1 HAVING count(*) FILTER (tag = 'base') > 0 AND count(*) FILTER (tag = 'frictionless') > 0")
def against(spark, sf):
    return report.against(rows(spark, sf), "bias_stat", ("base", "frictionless"))


@query("d22_turnover_highlight", f"WITH {_ROWS} SELECT count(*) AS n_cells, count(*) FILTER (turnover_highlight) AS n_highlighted FROM cr WHERE tag <> 'frictionless'")
def highlight(spark, sf):
    return report.highlighted(rows(spark, sf))


@query("d22_stress", f"WITH {_ROWS} SELECT cell, tag, r(ic) AS ic, r(net_ir) AS net_ir FROM cr WHERE tag IN ('base', 'stress') AND horizon = 2")
def stress(spark, sf):
    return report.stress(rows(spark, sf), "stress", 2).select("cell", "tag", "ic", "net_ir")


@query("d22_threshold_flags", f"WITH {_ROWS} SELECT cell, bool_and(net_ir >= 0.5) AS ir, bool_and(bias_worst_annual <= 1.72) AS calibrated, bool_and(te_p95 <= 0.3) AS risk, bool_and(net_ir >= 0.5 AND bias_worst_annual <= 1.72 AND te_p95 <= 0.3) AS passed FROM cr GROUP BY 1")
def threshold_flags(spark, sf):
    """Each cell against thresholds that are rows of a table."""
    t = spark.createDataFrame([("ir", "net_ir", False, 0.5), ("calibrated", "bias_worst_annual", True, 1.72), ("risk", "te_p95", True, 0.3)], "name string, column string, at_most boolean, bound double")
    out = report.flagged(rows(spark, sf), "cell", t)
    return out.select("cell", *[F.col("flags")[k].alias(k) for k in ("ir", "calibrated", "risk")], "passed")


_EXCESS = f"{_ROWS}, tw AS (SELECT ic, horizon, seed, min(net_ir) AS twin FROM cr WHERE baseline GROUP BY ALL), ex AS (SELECT cr.*, CASE WHEN NOT baseline THEN net_ir - twin END AS e FROM cr LEFT JOIN tw USING (ic, horizon, seed))"


@query("d23_per_ic", f"""
WITH {_EXCESS}, l AS (SELECT ic, 'net_ir' AS quantity, net_ir AS x FROM ex WHERE e IS NOT NULL UNION ALL SELECT ic, 'net_ir_excess', e FROM ex UNION ALL SELECT ic, 'realised_ic_live', realised_ic FROM ex WHERE e IS NOT NULL UNION ALL SELECT ic, 'realised_ic_twin', realised_ic FROM ex WHERE baseline),
g AS (SELECT DISTINCT ic, quantity FROM (SELECT DISTINCT ic FROM cr), (VALUES ('net_ir'), ('net_ir_excess'), ('realised_ic_live'), ('realised_ic_twin')) v(quantity))
SELECT r(ic) AS ic, quantity, count(x) AS n, r(avg(x)) AS mean, r(stddev_samp(x)) AS sd, r(min(x)) AS min, r(max(x)) AS max FROM g LEFT JOIN l USING (ic, quantity) GROUP BY g.ic, quantity""")
def per_ic(spark, sf):
    return report.per_ic(report.with_excess(rows(spark, sf), ["ic", "horizon", "seed"]))


@query("d24_acceptance", f"""
WITH {_EXCESS}, p AS (SELECT * FROM ex WHERE e IS NOT NULL),
f AS (SELECT regr_slope(e, ic) AS slope, count(*) AS n, regr_sxx(e, ic) AS sxx, sqrt((regr_syy(e, ic) - regr_slope(e, ic) * regr_sxy(e, ic)) / (count(*) - 2) / regr_sxx(e, ic)) AS se FROM p),
b AS (SELECT count(*) AS n, count(*) FILTER (net_ir >= 0.5 AND e > 0) AS hits FROM p WHERE ic = 0),
o AS (SELECT slope, se, slope / se AS t, f.n AS n_pairs, (SELECT avg(e) FROM p WHERE ic = 0.25) - (SELECT avg(e) FROM p WHERE ic = 0) AS gap, b.n AS b1_n, hits AS b1_count, hits / b.n AS b1_share FROM f, b)
SELECT (SELECT count(*) FROM cr) AS n_runs, r(slope) AS slope, r(se) AS se, r(t) AS t, n_pairs, r(gap) AS gap, b1_n, b1_count, r((SELECT avg((net_ir >= 0.5)::INT) FROM cr WHERE baseline)) AS twin_share, (SELECT bool_and(lookahead_passed) FROM cr) AS lookahead_all,
r(b1_share) AS b1_share, coalesce(t >= 2 AND gap >= 0.1, false) AS a2_met, coalesce(b1_share <= 0.1, false) AS b1_met FROM o""")
def acceptance(spark, sf):
    return report.acceptance(report.with_excess(rows(spark, sf), ["ic", "horizon", "seed"]), 0.5, 0.25)


@query("k68_resolved_parameters", "SELECT run_id, coalesce(CASE WHEN hypothesis % 3 = 0 THEN hypothesis::DOUBLE END, 26.0) AS half_life, coalesce(CASE WHEN hypothesis < 10 THEN 'per_series' END, 'scalar') AS overlay, CASE WHEN status = 'F' THEN 'linear' END AS shadow FROM runs")
def resolved(spark, sf):
    """Parameters of each run: its own where it has one, else those of the parameter file, else none."""
    p = Params.load('{"audit": {"overlay": {"half_life": 26.0, "form": "scalar"}}}')
    own = h.runs(spark, sf).select("run_id", F.when(F.col("hypothesis") % 3 == 0, F.col("hypothesis").cast("double")).alias("half_life"), F.when(F.col("hypothesis") < 10, "per_series").alias("overlay"), F.when(F.col("status") == "F", "linear").alias("shadow"))
    return grid.resolved(own, p, {"half_life": "audit.overlay.half_life", "overlay": "audit.overlay.form", "shadow": "audit.shadow"})


_FRAME = """fr AS (SELECT date, series_id, region, nation, market, CASE WHEN bucket IS NOT NULL THEN length(nation)::DOUBLE END AS x, (tier <> 'tradable_only')::INT::DOUBLE AS mask FROM weights JOIN meta USING (series_id)),
vw AS (SELECT date, region, avg(score) / 100 AS v FROM scores JOIN meta USING (series_id) GROUP BY 1, 2)"""


def frame(spark, sf):
    m = h.meta(spark, sf).select("series_id", "region", "nation", "market", F.when(F.col("bucket").isNotNull(), F.length("nation").cast("double")).alias("x"), (F.col("tier") != "tradable_only").cast("int").cast("double").alias("mask"))
    f = h.weights(spark, sf).select("date", "series_id").join(m, "series_id")
    v = h.scores(spark, sf).join(h.meta(spark, sf).select("series_id", "region"), "series_id").groupBy("date", "region").agg((F.avg("score") / 100).alias("v"))
    return f, v


@query("k25_directional_alpha", f"WITH {_FRAME}, d AS (SELECT date, avg(score) / 100 AS v FROM scores GROUP BY 1) SELECT fr.date, series_id, r(CASE WHEN mask > 0 AND x * v IS NOT NULL THEN x * v * mask ELSE 0 END) AS alpha FROM fr LEFT JOIN d USING (date)")
def directional(spark, sf):
    return views.directional(frame(spark, sf)[0], h.scores(spark, sf).groupBy("date").agg((F.avg("score") / 100).alias("v")))


@query("k25_group_alpha", f"""
WITH {_FRAME}, g AS (SELECT *, CASE WHEN region <> '' AND market <> 'all' AND mask > 0 THEN CASE WHEN market = '' THEN region ELSE region || '/' || market END END AS grp FROM fr),
v AS (SELECT date, CASE WHEN market = '' THEN region ELSE region || '/' || market END AS grp, avg(score) / 100 AS v FROM scores JOIN meta USING (series_id) GROUP BY 1, 2)
SELECT g.date, series_id, r(CASE WHEN mask > 0 AND x * v IS NOT NULL THEN x * v * mask ELSE 0 END) AS alpha FROM g LEFT JOIN v ON v.date = g.date AND v.grp = g.grp""")
def group_alpha(spark, sf):
    """A view for each region refined by market."""
    f = views.groups(frame(spark, sf)[0], ("region", "market"))
    m = h.meta(spark, sf).select("series_id", F.when(F.col("market") == "", F.col("region")).otherwise(F.concat_ws("/", "region", "market")).alias("group"))
    v = h.scores(spark, sf).join(m, "series_id").groupBy("date", "group").agg((F.avg("score") / 100).alias("v"))
    return views.by_group(f, v)


@query("k25_region_alpha", f"""
WITH {_FRAME}, c AS (SELECT series_id, region, 1.0::DOUBLE AS x FROM meta UNION ALL SELECT series_id, 'ASIA', 0.5 FROM meta WHERE hedged AND region <> 'ASIA'),
t AS (SELECT fr.date, fr.series_id, sum(c.x * v) AS a FROM fr JOIN c USING (series_id) JOIN vw ON vw.date = fr.date AND vw.region = c.region GROUP BY 1, 2)
SELECT fr.date, fr.series_id, r(CASE WHEN mask > 0 AND a IS NOT NULL THEN a * mask ELSE 0 END) AS alpha FROM fr LEFT JOIN t USING (date, series_id)""")
def region_alpha(spark, sf):
    f, v = frame(spark, sf)
    m = h.meta(spark, sf)
    cells = m.select("series_id", "region", F.lit(1.0).alias("x")).unionByName(m.where("hedged and region <> 'ASIA'").select("series_id", F.lit("ASIA").alias("region"), F.lit(0.5).alias("x")))
    return views.by_region(f, cells, v)


@query("j4_registered_signals", """
SELECT 'momentum' AS signal, series_id, date, r(CASE WHEN count(ret) OVER w = 26 THEN sum(ret) OVER w END) AS score FROM weekly WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND 4 PRECEDING)
UNION ALL SELECT 'reversal', series_id, date, r(CASE WHEN count(ret) OVER w = 4 THEN -sum(ret) OVER w END) FROM weekly WINDOW w AS (PARTITION BY series_id ORDER BY date ROWS 3 PRECEDING)""")
def registered(spark, sf):
    return SIGNALS.apply(SIGNALS.names(), h.weekly(spark, sf))
