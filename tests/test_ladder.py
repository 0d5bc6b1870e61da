"""Covariances as of a date, breadth, rebalances, cells, adjusted p in parts, and composed loads against plain computations."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import cells, covariance, mandate, stats
from brindle.sources import loaders

D = dt.date


def small_world(t=260, n=6, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(t, n)) * 0.01 + rng.normal(size=(t, 1)) * 0.01
    days = [D(2010, 1, 1) + dt.timedelta(7 * i) for i in range(t)]
    return x, days, [("u", f"S{j}", days[i], float(x[i, j])) for i in range(t) for j in range(n)]


def test_gate_refuses_few_shuffles_and_flat_tests(spark):
    rng = np.random.default_rng(2)
    null = rng.standard_normal((120, 3))
    t = spark.createDataFrame([(i, x) for i, x in enumerate([4.0, 0.1, 3.5])], "test int, t double")
    n = spark.createDataFrame([(d, i, float(null[d, i])) for d in range(120) for i in range(3)], "draw int, test int, t0 double")
    assert {r.test: r.rejected for r in stats.gate(t, n).collect()} == {0: True, 1: False, 2: True}
    with pytest.raises(ValueError, match="shuffles"):
        stats.gate(t, n, shuffles=121)
    flat = n.withColumn("t0", F.when(F.col("test") == 1, 0.1).otherwise(F.col("t0")))
    with pytest.raises(Exception, match="no finite spread"):
        stats.standardised_columns(t, flat)[0].collect()


def test_adjusted_p_over_ranges_equal_one_sort(spark):
    rng = np.random.default_rng(8)
    p = np.round(rng.uniform(size=500) ** 3, 3)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(p)], "test int, p double").repartition(7)
    out = stats.step_up(stats.step_up(stats.holm(df), "bh"), "by_p", dependent=True).toPandas().sort_values("test")
    order, m = np.lexsort((np.arange(500), p)), 500
    i = np.arange(1, m + 1)
    want = {"holm": np.maximum.accumulate((m - i + 1) * p[order]), "bh": np.minimum.accumulate((m * p[order] / i)[::-1])[::-1]}
    want["by_p"] = np.minimum.accumulate(((1 / i).sum() * m * p[order] / i)[::-1])[::-1]
    for c, x in want.items():
        assert np.allclose(out[c].to_numpy()[order], np.minimum(x, 1))


def test_trailing_covariance_as_of(spark):
    x, days, rows = small_world()
    late = [r for r in rows if not (r[1] == "S5" and r[2] < days[150])]  # S5 was not live at the window's start
    df = spark.createDataFrame(late + [("u", "LEG", days[i], float(x[i].mean())) for i in range(len(days))], "universe string, series_id string, date date, ret double")
    at = spark.createDataFrame([("u", days[200]), ("u", days[100])], "universe string, as_of date")
    got = covariance.trailing(df, at, ["LEG"], half_life=26.0).toPandas()
    assert set(got["as_of"]) == {days[200]} and "S5" not in set(got["a"])
    m = got.pivot(index="a", columns="b", values="cov")
    y = x[45:201, :5]
    c, _ = covariance.shrink(y, "constant_correlation")
    c = covariance.rescaled(c, y, 26.0)
    full, _, _, r2 = covariance.with_legs(c, y, x[45:201].mean(axis=1)[:, None], 26.0)
    ids = [f"S{j}" for j in range(5)] + ["LEG"]
    assert np.allclose(m.loc[ids, ids], full) and np.allclose(np.diag(c), covariance._spread(y, covariance.ewma(156, 26.0)))
    assert got[got["leg_r2"].notna()][["a", "b"]].values.tolist() == [["LEG", "LEG"]] and 0.8 < r2[0] <= 1
    flat = y.copy()
    flat[:, 2] = 0.0
    k, _ = covariance.shrink(flat, "constant_correlation")
    others, _ = covariance.shrink(flat[:, [0, 1, 3, 4]], "constant_correlation")
    assert (k[2] == 0).all() and np.allclose(np.diag(k)[[0, 1, 3, 4]], np.diag(others))
    again = covariance.trailing(df.where(F.col("date") <= F.lit(days[200])), at, ["LEG"], half_life=26.0).toPandas()
    assert np.allclose(again.pivot(index="a", columns="b", values="cov"), m)  # nothing after the date counts


def test_breadth_and_transfer(spark):
    rng = np.random.default_rng(1)
    days = [D(2010, 1, 1) + dt.timedelta(7 * i) for i in range(500)]
    rows = [("u", f"S{j}", d, float(v)) for d in days for j, v in enumerate(rng.normal(size=8))]
    df = spark.createDataFrame(rows, "universe string, series_id string, date date, ret double")
    b = spark.createDataFrame([(d, 0.0) for d in days], "date date, bench double")
    out = covariance.breadth(df, b, [4, 52]).orderBy("horizon").collect()
    assert out[0].n_series == 8 and out[0].bets_active == pytest.approx(8, rel=0.03) and out[0].breadth == pytest.approx(out[0].bets_active * 13) and out[1].implied_ic == pytest.approx(0.5 / np.sqrt(out[1].bets_active))
    omega = np.diag([1.0, 4.0, 9.0])
    a = np.array([0.3, -0.2, 0.1])
    t = covariance.transfer(a, np.linalg.solve(omega, a), omega)
    assert t["full"] == pytest.approx(1) and t["diagonal"] == pytest.approx(1) and t["alignment"] == pytest.approx(1) and t["condition"] == pytest.approx(9)


@pytest.mark.parametrize("seed", range(4))
def test_rebalance_against_a_grid(seed):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(3, 6)) * 0.01
    p = mandate.Problem(rng.normal(size=3) * 1e-3, a @ a.T / 6 + np.eye(3) * 1e-6, np.full(3, 1 / 3), rng.dirichlet(np.ones(3)), np.full(3, 2e-4), np.arange(3) == 0, np.ones(3, bool))
    side = np.linspace(0, 1, 161)
    w = np.stack([g.ravel() for g in np.meshgrid(side, side)], 1)
    w = np.column_stack([w, 1 - w.sum(axis=1)])[w.sum(axis=1) <= 1 + 1e-9]
    risk, moved = np.einsum("ij,jk,ik->i", w - p.bench, p.cov, w - p.bench), np.abs(w - p.before).sum(axis=1)
    gain = w @ p.alpha - np.abs(w - p.before) @ p.cost
    for m in (mandate.Mandate(te=0.03, max_cash=0.5, names=None), mandate.Mandate(te=0.01, max_cash=0.3, names=None, turnover=1.2), mandate.Mandate(te=0.02, max_cash=0.4, names=None, turnover=0.3)):
        book, told = mandate.rebalance(p, m)
        linear = (w[:, 0] <= m.max_cash + 1e-9) & (moved <= (m.turnover or 9) + 1e-9)
        ok = linear & (risk <= m.variance)
        assert np.isclose(book.sum(), 1) and (book >= 0).all() and book[0] <= m.max_cash + 1e-6
        if told["status"] == "optimal":
            assert told["te"] <= m.te * 1.001 and (m.turnover is None or told["turnover"] <= m.turnover + 1e-4)
            assert not ok.any() or book @ p.alpha - np.abs(book - p.before) @ p.cost >= gain[ok].max() - 1e-5
        elif told["status"] == "minimum-te":
            assert not ok.any() and told["turnover"] <= m.turnover + 1e-4
        else:
            assert not linear.any() and told["turnover"] <= moved[w[:, 0] <= m.max_cash].min() + 0.02
    capped, told = mandate.rebalance(p, mandate.Mandate(te=0.01, max_cash=1.0, names=1))
    assert (capped > 0).sum() == 1 and told["positions_capped"]


def test_cells_recover_what_is_planted(spark):
    x, days, rows = small_world(300, 8)
    panel = spark.createDataFrame([(u, d, s, r, 1e-4, 1e-4, False, s[-1:] in "0123") for u, s, d, r in rows], "universe string, date date, series_id string, ret double, half_spread double, drag double, is_cash boolean, group boolean")
    grid = spark.createDataFrame([(f"{k}{ic}", "u", ic, 4, 1, 1.0, s, None, k) for k, s in (("frictionless", 4), ("mandate", 13), ("axis", 13)) for ic in (0.0, 0.4)], "cell string, universe string, ic double, horizon int, seed int, cost double, step int, half_life double, kind string")
    got = {r.cell: r for r in cells.run_grid(panel, grid, mandate.Mandate(te=0.04)).collect()}
    assert len(got) == 6 and all(abs(r.ic_realised - r.ic) < 0.02 for r in got.values())
    best, idle, book = got["frictionless0.4"], got["mandate0.0"], got["mandate0.4"]
    assert best.ir > 1.0 and best.transfer == pytest.approx(1, abs=0.01) and best.te_mean == pytest.approx(0.04, rel=0.1)
    assert idle.turnover < 0.05 and idle.first_trade is None and book.gross_ir > 0.3 and book.ir < book.gross_ir and book.te_mean <= 0.0401
    assert book.n_rebalances == 12 and np.isfinite(got["axis0.4"].gross_ir)
    z, t = cells.plant(cells.forward(x, 4), 0.3, 2), cells.forward(x, 4)
    assert all(np.corrcoef(z[:-4, j], t[:-4, j])[0, 1] == pytest.approx(0.3, abs=1e-9) for j in range(8))
    bench, active = cells.planted_path(x[:, 0], 0.5, 0.04, 3)
    assert active.mean() * 52 / (active.std(ddof=1) * np.sqrt(52)) == pytest.approx(0.5) and np.allclose(bench + active, x[:, 0])


def test_loads_refuse_doubles_and_keep_what_is_written_once(spark, tmp_path):
    f = spark.createDataFrame([("a", "oas", D(2020, 1, 2), 1.0), ("b", "oas", D(2020, 1, 2), 2.0)], "series_id string, field string, date date, value double")
    with pytest.raises(ValueError, match="in both files"):
        loaders.merged_analytics(f, f.where("series_id = 'a'"))
    with pytest.raises(ValueError, match="same"):
        loaders.universe(spark.createDataFrame([("a ",), ("a",)], "ticker string"))
    assert loaders.optional_levels(spark, f"{tmp_path}/none.csv").count() == 0
    store = loaders.CharacteristicStore(spark, str(tmp_path / "store"))
    store.write("x", f, ["field"])
    assert store.write("x", f.repartition(3), ["field"])["rows"] == 2 and store.load("x").count() == 2
    with pytest.raises(ValueError, match="other content"):
        store.write("x", f.where("value > 1"), ["field"])
    f.write.mode("append").partitionBy("field").parquet(str(tmp_path / "store/x"))
    with pytest.raises(ValueError, match="changed"):
        store.load("x")
    cell = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "cell string, v double")
    path = str(tmp_path / "cells")
    assert [loaders.flush(cell.where("cell = 'a'"), path), loaders.flush(cell, path), loaders.flush(cell, path)] == [1, 1, 0]
    loaders.write_outputs(cell, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out/cells.csv"), header=True).count() == 2
    with pytest.raises(Exception, match="exists"):
        loaders.write_outputs(cell, str(tmp_path / "out"))


def test_loaded_returns_take_every_step_of_the_chain(spark):
    day = lambda i: D(2020, 1, i)
    level = lambda name, days, x: [(name, day(i), str(x * i)) for i in days]
    raw = spark.createDataFrame([*level("T", (8, 9, 10), 1.0), *level("NDU", (6, 7, 9), 2.0), *level("F", (6, 7, 8), 3.0)], "series_id string, date date, raw string")
    source = spark.createDataFrame([*level("S", (3, 6, 7, 8, 9), 5.0), ("S", day(10), "#N/A")], "series_id string, date date, raw string")
    kind = "series_id string, currency string, hedged boolean, start date, tier string"
    meta = spark.createDataFrame([("T", "", False, day(8), "second"), ("S", "USD", False, day(6), "backbone"), ("NDU", "USD", False, day(6), "backbone"), ("F", "EUR", False, day(6), "second")], kind)
    rates = spark.createDataFrame([("EUR", day(6), 2.0), ("EUR", day(8), 4.0)], "currency string, date date, rate double")
    eur = rates.select("currency")
    members = spark.createDataFrame([("T",), ("NDU",), ("F",)], "series_id string")
    load = lambda m, **how: loaders.load_returns(raw, m, rates, [("T", "S"), ("T", None), ("T", "none"), ("NDU", "NDU")], "2020-01-10", [source], currencies=eur, net=("ND",), tiers=("2020-01-06", "2020-01-08"), **how)
    got = load(meta, members=members)
    rets = {(r.series_id, r.date.day): r.ret for r in got.returns.collect()}
    assert {k for k, _ in rets} == {"T", "NDU", "F"}  # the source was spliced and is no member
    assert rets["T", 7] == pytest.approx(7 / 6 - 1) and ("T", 3) not in rets and ("T", 10) not in rets
    assert rets["F", 8] == pytest.approx((24 / 4) / (18 / 2) - 1) and rets["NDU", 9] == pytest.approx(9 / 7 - 1)
    told = {r.series_id: (r.start.day, r.tier, r.gross) for r in got.meta.collect()}
    assert told == {"T": (6, "backbone", True), "NDU": (6, "backbone", False), "F": (6, "second", True)}
    said = [(r.target, r.source, r.taken, r.scale, r.skipped) for r in got.splices.collect()]
    assert said[0] == ("T", "S", 2, pytest.approx(0.2), None) and [x[4] for x in said[1:]] == ["no source named", "source none not in the panel", "no gap to fill"]
    assert {r.series_id: r.without_rate for r in got.report.collect()}["F"] == 1
    assert {r.series_id for r in load(meta).returns.collect()} == {"T", "S", "NDU", "F"}
    with pytest.raises(ValueError, match="F: unknown currency"):
        load(meta.withColumn("currency", F.when(F.col("series_id") == "F", "XXX").otherwise(F.col("currency"))))
    with pytest.raises(ValueError, match="NDU: no daily start"):
        load(meta.where("series_id <> 'NDU'"))


def test_params_are_nested_fixed_and_hashed():
    from brindle.params import Params

    p = Params.load('{"a": {"b": {"c": 1}, "d": [1, 2]}}', '{"e": null}')
    assert p.get("a.b.c") == 1 and p.get("a.x") is None and p.require("a.d") == (1, 2)
    with pytest.raises(KeyError):
        p.require("e")
    with pytest.raises(ValueError, match="two parts"):
        Params.of({"a": 1}, {"a": 2})
    q = p.override("a.b.c", 2)
    assert q.get("a.b.c") == 2 and p.get("a.b.c") == 1 and q.sha256 != p.sha256 == Params.of({"e": None, "a": {"d": [1, 2], "b": {"c": 1}}}).sha256
    with pytest.raises(TypeError):
        p.values["a"]["d"] = 3
    assert p.first({"h": None}, "h", "a.b.c") == 1 and p.first({"h": 0}, "h", "a.b.c") == 0


def test_breadth_equals_that_of_whole_matrices_and_no_task_holds_a_universe(spark):
    rng = np.random.default_rng(5)
    days = [D(2010, 1, 1) + dt.timedelta(7 * i) for i in range(30)]
    worlds = {"u": rng.normal(size=(30, 45)) + rng.normal(size=(30, 1)), "v": rng.normal(size=(30, 6)), "one": rng.normal(size=(30, 1))}
    worlds["v"][3, 2] = np.nan
    worlds["v"][4:, 5] = np.nan  # too few to take part
    rows = [(u, f"{u}{j}", days[i], float(x[i, j]) if np.isfinite(x[i, j]) else None) for u, x in worlds.items() for i in range(30) for j in range(x.shape[1])]
    df = spark.createDataFrame(rows, "universe string, series_id string, date date, ret double").repartition(7)
    bench = rng.normal(size=30) * 0.3
    b = spark.createDataFrame([(d, float(v)) for d, v in zip(days[1:], bench[1:])], "date date, bench double")
    made = covariance.breadth(df, b, [4], least=8)
    got = {r.universe: r for r in made.collect()}
    assert set(got) == {"u", "v"}  # a series alone has no breadth
    for u, x in {"u": worlds["u"][1:], "v": np.delete(worlds["v"], 3, axis=0)[1:, :5]}.items():
        own = bench[1:] if u == "u" else np.delete(bench, 3)[1:]
        assert got[u].n_series == x.shape[1]
        assert got[u].bets_total == pytest.approx(covariance.bets(np.corrcoef(x.T))) and got[u].bets_active == pytest.approx(covariance.bets(np.corrcoef((x - own[:, None]).T)))
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()
