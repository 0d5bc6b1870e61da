"""Grids of cells, what stored paths say, runs that go on, report arithmetic, views and the panel data source."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from brindle.operators import covariance, diagnostics, grid, mandate, report, rule, signals, views
from brindle.sources import datasource, readers

from .test_ladder import small_world

D = dt.date
M = mandate.Mandate(te=0.1, max_cash=0.4, names=None)


@pytest.fixture(scope="module")
def world(spark):
    x, days, rows = small_world(172, 6, 11)
    rows = rows + [("u", "LEG", d, float(x[i].mean())) for i, d in enumerate(days)]
    weekly = spark.createDataFrame(rows, "universe string, series_id string, date date, ret double").cache()
    costs = spark.createDataFrame([("u", f"S{j}", 1e-4 * (j + 1), 1e-3, j == 0) for j in range(6)], "universe string, series_id string, half_spread double, drag double, is_cash boolean")
    at = spark.createDataFrame([("u", d) for d in days], "universe string, as_of date")
    groups = spark.createDataFrame([("u", f"S{j}", "ab"[j % 2]) for j in range(6)], "universe string, series_id string, group string")
    cov = covariance.matrices(weekly, at, ["LEG"]).cache()
    return x, days, weekly, costs, cov, groups


def cells(spark, *rows):
    full = [(c, "u", tag, axis, ic, 4, seed, cost, "linear", 10.0, 0.5, None) for c, tag, axis, ic, seed, cost in rows]
    return spark.createDataFrame(full, grid.GRID)


def test_cells_in_blocks_equal_single_paths(spark, world, monkeypatch):
    x, days, weekly, costs, cov, groups = world
    g = cells(spark, ("a", "base", "series", 0.3, 1, 1.0), ("b", "stress", "series", 0.3, 1, 3.0), ("c", "base", "group", 0.3, 2, 1.0))
    monkeypatch.setattr(rule, "CELLS_A_TASK", 2)
    made, scores = grid.run_cells(g, weekly, costs, cov, {"LEG": 1.0}, M, groups)
    got = made.orderBy("cell", "date").collect()
    assert {r.cell for r in got} == {"a", "b", "c"} and len(got) == 3 * 17
    own = grid.views(scores, g, costs, groups)
    for cell in "ac":
        c = g.where(F.col("cell") == cell).first().asDict()
        alone = rule.path(weekly, own.where(F.col("cell") == cell).drop("cell"), cov, {"LEG": 1.0}, M, grid._rule(c)).orderBy("date").collect()
        assert [(r.date, r.book, r.turnover) for r in alone] == [(r.date, r.book, r.turnover) for r in got if r.cell == cell]
    s = scores.where("truth is not null and not isnan(truth)").groupBy("cell", "column").agg(F.corr("score", "truth").alias("c")).collect()
    assert all(r.c == pytest.approx(0.3, abs=1e-6) for r in s) and {r.column for r in s if r.cell == "c"} == {"a", "b"}
    paid = {r.cell: sum(y.cost for y in got if y.cell == r.cell) for r in got}
    assert paid["b"] > paid["a"] * 1.5
    rows = {r.cell: r for r in grid.rows_of(made, scores, g, M).collect()}
    assert all(r.lookahead_passed and r.n_rebalances == 17 and r.realised_ic_pooled == pytest.approx(0.3, abs=0.02) for r in rows.values()) and rows["a"].transfer_dates > 0
    late = scores.where(F.col("date") != F.lit(days[165]))
    assert not grid.lookahead(made, late).first().lookahead_passed  # a step without a score of its week


def test_a_run_that_was_killed_goes_on(spark, world, tmp_path):
    x, days, weekly, costs, cov, groups = world
    g = cells(spark, *[(f"c{i}", "base" if i % 2 else "stress", "series", 0.1 * i, 1, 1.0) for i in range(5)])
    run, calls = grid.batch_of(weekly, costs, cov, {"LEG": 1.0}, M), []

    def killed(now):
        calls.append([r.cell for r in now.collect()])
        if len(calls) == 2:
            raise RuntimeError("killed")
        return run(now)

    folder = str(tmp_path / "grid")
    with pytest.raises(RuntimeError, match="killed"):
        grid.resume(spark, folder, g, killed, batch=2)
    assert spark.read.parquet(f"{folder}/rows").count() == 2
    assert grid.resume(spark, folder, g, run, deadline=100.0, batch=2, clock=lambda: 0.0) == {"done": 2, "left": 3, "stopped": True}  # the first batch may take 120 s
    assert grid.resume(spark, folder, g, killed, batch=2) == {"done": 5, "left": 0, "stopped": False}
    assert calls == [["c0", "c1"], ["c2", "c3"], ["c2", "c3"], ["c4"]]
    rows = spark.read.parquet(f"{folder}/rows")
    assert sorted(r.cell for r in rows.collect()) == [f"c{i}" for i in range(5)]
    for name in ("weights", "alpha"):
        kept = spark.read.parquet(f"{folder}/{name}").groupBy("cell").agg(F.count_distinct("date").alias("n")).collect()
        assert {r.cell: r.n for r in kept} == {"c1": 17, "c3": 17}
    assert grid.should_stop(0.0, 100.0, []) and not grid.should_stop(0.0, 100.0, [10.0, 60.0, 20.0]) and not grid.should_stop(9e9, None, [1.0])


def test_what_a_path_says_equals_pandas(spark):
    rng = np.random.default_rng(3)
    n, days = 260, [D(2010, 1, 1) + dt.timedelta(7 * i) for i in range(260)]
    p = pd.DataFrame({"cell": "a", "date": days, "gross": rng.normal(size=n) * 0.02, "bench": rng.normal(size=n) * 0.02, "cost": rng.uniform(size=n) * 1e-4, "turnover": rng.uniform(size=n), "te": rng.uniform(0.05, 0.2, size=n)})
    rest = {"forced": 0.0, "cash": 0.1, "n_positions": 5, "n_holdable": 6, "shadow_bps": 1.0, "shadow_paid_bps": 2.0, "te_binding": True, "turnover_binding": False, "cash_binding": False, "positions_capped": False, "status": "optimal", "repaired": 0.5, "transfer": float("nan"), "transfer_diagonal": 0.2}
    r = diagnostics.cell_rows(spark.createDataFrame(p.assign(**rest)), 0.1).first()
    a = (p["gross"] - p["cost"] - p["bench"]).iloc[1:]
    z = a / (p["te"].shift(1).iloc[1:] / np.sqrt(52))
    assert r.net_ir == pytest.approx(a.mean() * 52 / (a.std() * np.sqrt(52))) and r.bias_stat == pytest.approx(z.std()) and r.bias_n == n - 1
    assert r.turnover_autocorr_lag53 == pytest.approx(p["turnover"].autocorr(53)) and r.turnover_p95_rolling_1y == pytest.approx(p["turnover"].rolling(52).sum().quantile(0.95))
    assert r.te_p95 == pytest.approx((a.rolling(156).std() * np.sqrt(52)).quantile(0.95)) and r.left_tail_L == pytest.approx(abs(z.quantile(0.05)) / 1.6448536269514722)
    wealth = (1 + a).cumprod()
    assert r.max_active_drawdown == pytest.approx((wealth / np.maximum(wealth.cummax(), 1.0) - 1).min())
    years = z.groupby([d.year for d in p["date"].iloc[1:]]).agg(["std", "count"]).query("count >= 40")
    assert r.bias_worst_annual == pytest.approx(years["std"].max()) and r.bias_worst_year == years["std"].idxmax() and r.bias_years_read == len(years)
    assert r.transfer_coefficient is None and r.transfer_coefficient_diagonal == pytest.approx(0.2) and r.turnover_from_repairs_annual == pytest.approx(0.5 * 52 / n)
    j = diagnostics.judged(diagnostics.cell_rows(spark.createDataFrame(p.assign(**(rest | {"cash": 0.3}))), 0.1), highlight=1.0).first()
    assert not j.passes and j.veto_detail.startswith("cash") and j.turnover_highlight
    flat = diagnostics.cell_rows(spark.createDataFrame(p.head(3).assign(**rest, )).withColumn("turnover", F.lit(0.1)), 0.1).first()
    assert flat.turnover_autocorr_lag26 is None and flat.te_p95 is None and flat.bias_worst_annual is None


def test_breadth_and_acceptance(spark):
    rows = spark.createDataFrame([("base", 4, 0.1, 0.2, 0.5), ("base", 4, 0.2, 0.4, 0.5), ("base", 4, 0.0, 9.0, 0.5), ("stress", 4, 0.1, 9.0, 0.5), ("base", 13, 0.1, -0.2, 0.5)], "tag string, horizon int, ic double, net_ir double, transfer_coefficient double")
    got = {r.horizon: r for r in grid.ladder_breadth(rows).collect()}
    assert got[4].ir_per_unit_ic == pytest.approx(2.0) and got[4].breadth == pytest.approx(16.0) and got[4].n_cells == 2 and got[13].breadth is None
    runs = [(ic, s, twin, (0.1 if twin else 0.1 + 2 * ic + 0.01 * s), 0.0, True) for ic in (0.0, 0.1, 0.35) for s in range(4) for twin in (True, False)]
    df = report.with_excess(spark.createDataFrame(runs, "ic double, seed int, baseline boolean, net_ir double, realised_ic double, lookahead_passed boolean"), ["ic", "seed"])
    r = report.acceptance(df, 0.5, 0.35).first()
    assert r.slope == pytest.approx(2.0) and r.gap == pytest.approx(0.7) and r.n_pairs == 12 and r.b1_count == 0 and r.twin_share == 0 and r.a2_met and r.b1_met and r.lookahead_all
    none = report.acceptance(df.limit(0), 0.5, 0.35).first()
    assert none.n_runs == 0 and none.slope is None and not none.a2_met and not none.b1_met
    t = spark.createDataFrame([("low", "x", True, 1.0), ("high", "x", False, 0.5)], "name string, column string, at_most boolean, bound double")
    flags = {r.k: (r.flags, r.passed) for r in report.flagged(spark.createDataFrame([(1, 0.7), (2, 2.0), (3, None)], "k int, x double"), "k", t).collect()}
    assert flags == {1: ({"high": True, "low": True}, True), 2: ({"high": True, "low": False}, False), 3: ({"high": False, "low": False}, False)}


def test_views_and_groups(spark):
    f = spark.createDataFrame([(1, "a", 2.0, 1.0, "HY", "Ba"), (1, "b", None, 1.0, "HY", ""), (1, "c", 2.0, 0.0, "HY", "Ba"), (1, "d", 2.0, 1.0, "", "Ba"), (1, "e", 2.0, 1.0, "IG", "all")], "date int, series_id string, x double, mask double, k1 string, k2 string")
    g = views.groups(f, ("k1", "k2"))
    assert {r.series_id: r.group for r in g.collect()} == {"a": "HY/Ba", "b": "HY", "c": None, "d": None, "e": None}
    v = spark.createDataFrame([(1, "HY/Ba", 0.5), (1, "HY", 1.0)], "date int, group string, v double")
    assert {r.series_id: r.alpha for r in views.by_group(g, v).collect()} == {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0, "e": 0.0}
    with pytest.raises(ValueError, match="one label"):
        views.groups(f, ("a", "b", "c"))
    with pytest.raises(signals.Missing, match="no estimator implements 'x'"):
        signals.SIGNALS.resolve("x", measurement=True)
    with pytest.raises(ValueError, match="registered"):
        signals.SIGNALS.register("momentum")(lambda df: df)


WIDE = "date,A_local_EUR,B_local_GBP\n2020-01-01,1.5,#N/A\n2020-01-02,2.5,7\n2020-01-04,9,9\n2020-01-06,,8\n"


def test_panel_files_as_a_data_source(spark, tmp_path):
    path = tmp_path / "w.csv"
    path.write_text(WIDE)
    got = {(r.series_id, r.date): (r.level, r.currency) for r in datasource.wide_panel(spark, str(path), ["A", "B"], ("EUR", "GBP")).collect()}
    old = {(r.series_id, r.date): r.level for r in readers.wide_csv(spark, str(path), ("EUR", "GBP")).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v for k, v in old.items() if k[1] != D(2020, 1, 4)} and got["B", D(2020, 1, 2)] == (7.0, "GBP")  # no weekend
    many = tmp_path / "m.csv"
    many.write_text("date,A_local_EUR\n" + "".join(f"{D(2000, 1, 3) + dt.timedelta(7 * i)},{i}\n" for i in range(900)))
    df = spark.read.format("panel").option("tickers", "A").option("currencies", "EUR").option("splitBytes", "700")
    for size in ("700", "16", "1000000"):
        out = df.option("splitBytes", size).load(str(many))
        assert sorted(r.level for r in out.collect()) == [float(i) for i in range(900)]
    assert df.option("splitBytes", "700").load(str(many)).rdd.getNumPartitions() > 10
    for text, fault in (("day,A_local_EUR\n", "date is expected"), ("date,A_local_USD,B_local_GBP\n", "quoted in USD"), ("date,A_local_EUR\n", "missing tickers"), ("date,A_local_EUR,B_local_GBP,C_local_EUR\n", "unknown ones"), ("date,A_local_EUR,A_local_EUR,B_local_GBP\n", "twice"), ("date,A,B_local_GBP\n", "not <ticker>")):
        path.write_text(text + "2020-01-01,1,2\n")
        with pytest.raises(Exception, match=fault):
            datasource.wide_panel(spark, str(path), ["A", "B"], ("EUR", "GBP"))
    path.write_text(WIDE + "2020-01-02,1,1\n")
    with pytest.raises(ValueError, match="same"):
        datasource.wide_panel(spark, str(path), ["A", "B"], ("EUR", "GBP"))
    long = tmp_path / "l.csv"
    long.write_text('date,ticker,oas,field\n2020-01-01,A,1.5,"x, y"\n2020-01-01,B,NA,\n')
    rows = datasource.long_panel(spark, str(long), ["oas", "field"], ["A", "B"], ("field",)).orderBy("ticker").collect()
    assert [tuple(r) for r in rows] == [(D(2020, 1, 1), "A", 1.5, "x, y"), (D(2020, 1, 1), "B", None, None)]
    with pytest.raises(Exception, match="header"):
        datasource.long_panel(spark, str(long), ["field", "oas"], ["A", "B"])
    with pytest.raises(Exception, match="not one of"):
        datasource.long_panel(spark, str(long), ["oas", "field"], ["A"], ("field",)).collect()
