"""Books, tests, stores, estimators and solvers: hand-worked values, planted truth and brute force."""

import datetime as dt
import math
import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from brindle.operators import book, covariance, lineage, loadings, optimise, stats, store
from brindle.sources import synthetic

P = [0.001, 0.008, 0.039, 0.041, 0.042, 0.06, 0.074, 0.205, 0.212, 0.3]
D = dt.date


def test_known_rejections(spark):
    p = spark.createDataFrame(list(enumerate(P)), "test int, p double")
    out = stats.step_up(stats.step_up(stats.holm(p), "bh"), "by_p", dependent=True).toPandas().sort_values("test")
    assert [(out[c] <= 0.05).sum() for c in ("holm", "bh", "by_p")] == [1, 2, 1]
    assert out["holm"].is_monotonic_increasing and out["bh"].is_monotonic_increasing and (out["bh"] <= out["by_p"]).all()


def test_stepdown_against_brute_force(spark):
    rng = np.random.default_rng(3)
    t, null = np.array([4.0, 0.5, 2.6, 1.0]), rng.standard_normal((200, 4))
    td = spark.createDataFrame([(i, float(x)) for i, x in enumerate(t)], "test int, t double")
    nd = spark.createDataFrame([(d, i, float(null[d, i])) for d in range(200) for i in range(4)], "draw int, test int, t0 double")
    got = {r.test: (r.p, r.rejected) for r in stats.romano_wolf(td, nd).collect()}
    active, floor, want = list(range(4)), 0.0, {}
    while active:
        top = null[:, active].max(axis=1)
        p = {i: max(floor, (1 + (top >= t[i]).sum()) / 201) for i in active}
        hit = [i for i in active if p[i] <= 0.05]
        want |= {i: (p[i], i in hit) for i in (hit or active)}
        if not hit:
            break
        floor, active = max(p[i] for i in hit), [i for i in active if i not in hit]
    assert {k: (pytest.approx(v[0]), v[1]) for k, v in want.items()} == got


def test_generalised_stepdown(spark):
    rng = np.random.default_rng(5)
    null = rng.standard_normal((300, 6))
    t = np.array([4.0, 3.1, 2.4, 1.0, 0.2, -1.0])
    p1, p2 = stats.gfwer_adjusted(t, null, 1, 0.05), stats.gfwer_adjusted(t, null, 2, 0.05)
    one, two = p1 <= 0.05, p2 <= 0.05
    td = spark.createDataFrame([("f", i, float(x)) for i, x in enumerate(t)], "family string, test int, t double")
    nd = spark.createDataFrame([("f", d, i, float(null[d, i])) for d in range(300) for i in range(6)], "family string, draw int, test int, t0 double")
    plain = {r.test: r.rejected for r in stats.romano_wolf(td.drop("family"), nd.drop("family")).collect()}
    assert {i: bool(x) for i, x in enumerate(one)} == {**dict.fromkeys(range(6), False), **plain}
    assert (two | ~one).all() and two.sum() >= one.sum()
    assert {r.test: (r.p, r.rejected) for r in stats.gfwer(td, nd, 2).collect()} == {i: (pytest.approx(p2[i]), bool(x)) for i, x in enumerate(two)}
    rounds = {r.test: r.p for r in stats.romano_wolf(td.drop("family"), nd.drop("family")).collect()}
    assert all(p1[i] == pytest.approx(x) for i, x in rounds.items())
    assert (np.diff(p2[np.argsort(-t)]) >= -1e-12).all() and stats.gfwer_adjusted(np.array([5.0]), null[:, :1], 2, 0.05)[0] <= 0.05  # a set below g never binds


def test_blocks_keep_inner_order(spark):
    days = [D(2020, 1, 1) + dt.timedelta(i) for i in range(10)]
    rows = spark.createDataFrame([(s, d, float(i)) for s in "ab" for i, d in enumerate(days)], "series_id string, date date, ret double")
    got = stats.block_permuted(rows, 4, 1).orderBy("series_id", "date").collect()
    order = [int(r.ret) for r in got[:10]]
    assert [int(r.ret) for r in got[10:]] == order and sorted(order) == list(range(10)) and [r.date for r in got[:10]] == days
    assert {tuple(g) for g in ([0, 1, 2, 3], [4, 5, 6, 7], [8, 9])} == {tuple(b) for b in _runs(order)}


def _runs(order):
    out = [[order[0]]]
    for x in order[1:]:
        if x == out[-1][-1] + 1 and x % 4:
            out[-1].append(x)
        else:
            out.append([x])
    return out


def test_bootstrap_weeks_cover_each_draw(spark):
    s = stats.bootstrap_starts(spark, 25, 6, 4, 1)
    assert s.groupBy("draw").count().where("count <> 25").count() == 0 and s.agg(F.max("week")).first()[0] <= 24


def test_required_ic_cases(spark):
    rows = [(1, 0.02, 0.1), (1, 0.05, 0.5), (2, 0.02, 0.6), (2, 0.05, 0.7), (3, 0.02, 0.1), (3, 0.05, 0.2)]
    got = {r.horizon: (r.ic, r.how) for r in stats.required(spark.createDataFrame(rows, "horizon int, ic double, mean double"), 0.3).collect()}
    assert got == {1: (pytest.approx(0.035), "inside"), 2: (0.02, "below"), 3: (0.05, "above")}


def test_costs_over_the_union_of_books(spark):
    a = spark.createDataFrame([(D(2020, 1, 3), "A", 0.6), (D(2020, 1, 3), "B", 0.4)], "date date, series_id string, w double")
    b = spark.createDataFrame([(D(2020, 1, 3), "B", 0.5), (D(2020, 1, 3), "C", 0.5)], "date date, series_id string, w double")
    buckets = spark.createDataFrame([("A", "low"), ("B", "mid")], "series_id string, bucket string")
    r = book.rebalance_costs(book.trades(a, b), buckets).first()
    assert r.turnover == pytest.approx(1.2)
    assert r.cost == pytest.approx(0.6 * 5e-4 + 0.1 * 1e-3 + 0.5 * 2e-3 + (0.6 * 5e-4 + 0.4 * 15e-4) / 52)


def test_walk_forward_matches_a_loop(spark):
    days = pd.bdate_range("2020-01-01", "2020-03-01")
    rng = np.random.default_rng(0)
    r = rng.normal(0, 0.01, (len(days), 2))
    rows = [("run", d.date(), s, float(r[i, j]), 1e-3, 0.0) for i, d in enumerate(days) for j, s in enumerate("AB")]
    df = spark.createDataFrame(rows, "run_id string, date date, series_id string, ret double, half_spread double, drag double")
    got = book.walk_forward(df, lambda date, week: pd.Series({"A": 0.5, "B": 0.5})).orderBy("date").collect()
    held, want = None, []
    for i, d in enumerate(days):
        if held is not None:
            value = held * (1 + r[i])
            gross *= value.sum()
            held = value / value.sum()
        if d.weekday() == 4:
            if held is not None:
                traded = np.abs(0.5 - held).sum()
                want.append((gross - 1, gross - 1 - traded * 1e-3, traded))
            held, gross = np.array([0.5, 0.5]), 1.0
    assert len(got) == len(want) and np.allclose([(g.gross, g.net, g.turnover) for g in got], want)


def test_store_refuses_and_joins(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    run = lambda i: spark.createDataFrame([(i, None, "h", "f", "a", "v", "p", "d", 1, "done", None, 1, 0.5)], store.RUNS)
    s.record_runs(run("r1"))
    s.record_runs(run("r2"))
    with pytest.raises(ValueError, match="before"):
        s.record_runs(run("r1"))
    with pytest.raises(ValueError, match="no such run"):
        s.record_metrics(spark.createDataFrame([("zz", "net_ir", 1.0)], store.METRICS))
    s.record_metrics(spark.createDataFrame([("r1", "net_ir", 0.4)], store.METRICS))
    s.record_verdicts(spark.createDataFrame([("r1", "cash", True, ""), ("r1", "risk", True, "")], store.VERDICTS))
    got = {r.run_id: (r.net_ir, r.passed) for r in store.leaderboard(s.overview(["net_ir"]), "net_ir").collect()}
    assert got == {"r1": (0.4, True), "r2": (None, False)}
    s.write_artifact("weights", spark.createDataFrame([("r1", 1.0), ("r2", 2.0)], "run_id string, w double"))
    assert [r.w for r in s.artifact("weights", "r2").collect()] == [2.0]


def test_snapshot_notices_a_change(spark, tmp_path):
    df = spark.range(50).withColumn("x", F.col("id") * 2)
    known = store.freeze({"levels": df}, str(tmp_path / "snap"))
    assert store.verify(spark, str(tmp_path / "snap"), known) == [] and store.content_hash(df.repartition(3)) == known["levels"]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        store.freeze({"levels": df}, str(tmp_path / "snap"))
    df.limit(49).write.mode("overwrite").parquet(str(tmp_path / "snap/levels"))
    assert store.verify(spark, str(tmp_path / "snap"), known) == ["levels"]


def test_excess_matches_null_keys(spark):
    live = spark.createDataFrame([("a", None, 1.0), ("b", 1, 2.0), ("c", 9, 3.0)], "run_id string, cap int, x double")
    base = spark.createDataFrame([("p", None, 0.5, 1), ("q", None, 9.0, 2), ("r", 1, 0.25, 1)], "run_id string, cap int, x double, ts int")
    got = {r.run_id: r.excess for r in store.excess_over_baseline(live, base, ["cap"], "x").collect()}
    assert got == {"a": 0.5, "b": 1.75, "c": None}


def test_reachable_pairs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "a int, b int")
    assert sorted(map(tuple, lineage.reached(e, e.where("a = 1")).collect())) == [(1, 1), (1, 2), (1, 3)]


def world(t=320, k=2, seed=1):
    rng = np.random.default_rng(seed)
    f = rng.standard_normal((t, k)) * 0.02
    beta = np.array([1.2, -0.5])[:k]
    return f, f @ beta + rng.standard_normal(t) * 0.005, beta


@pytest.mark.parametrize("method", sorted(loadings.ESTIMATORS))
def test_estimators_recover_planted_loadings(method):
    f, y, beta = world()
    y[::40] = np.nan
    b, cov, var, n = loadings.ESTIMATORS[method](y, f)
    assert np.isnan(b[: loadings.LEAST - 1]).all() and np.abs(b[-1] - beta).max() < 0.08 and (np.diag(cov[-1]) > 0).all() and var[-1] > 0


@pytest.mark.parametrize("method", sorted(loadings.ESTIMATORS))
def test_estimators_do_not_look_ahead(method):
    f, y, _ = world()
    y[70:90] = np.nan
    y[200:], f[200:] = 3 * y[200:], -2 * f[200:]  # later weeks of another kind
    whole, part = loadings.ESTIMATORS[method](y, f), loadings.ESTIMATORS[method](y[:200], f[:200])
    for a, b in zip(whole[:3], part[:3]):
        assert np.isfinite(b).any() and np.allclose(a[:200], b, rtol=1e-9, atol=1e-12, equal_nan=True)


def test_filters_against_plain_recursions():
    """The state of a discounted random walk in actual units: precisions add up; the reverting filter's forecast comes from its own state."""
    f, y, _ = world(170)
    n, k = f.shape
    runs = []
    for d in loadings.DISCOUNTS:
        m, p, s, nu, total, path = np.zeros(k + 1), np.eye(k + 1) / (loadings.PRIOR_COV * loadings.PRIOR_VAR), loadings.PRIOR_VAR, 1.0, 0.0, []
        for t in range(n):
            z = np.concatenate([[1.0], f[t]])
            p = p * d
            wide = s + z @ np.linalg.solve(p, z)
            e = y[t] - z @ m
            total += math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi * wide) - (nu + 1) / 2 * math.log1p(e * e / (nu * wide))
            p = p + np.outer(z, z) / s
            m = m + np.linalg.solve(p, z) * e / s
            s, nu = s * (nu + e * e / wide) / (nu + 1), nu + 1
            path.append((total, m.copy(), s))
        runs.append(path)
    b, _, var, _ = loadings.discount_filter(y, f)
    for t in range(loadings.LEAST - 1, n):
        best = max(range(len(runs)), key=lambda i: runs[i][t][0])
        assert np.allclose(b[t], runs[best][t][1][1:], atol=1e-6) and np.isclose(var[t], runs[best][t][2])
    b = loadings.reverting_filter(y, f)[0]
    first = loadings.rolling_ols(y, f)[0][loadings.LEAST - 1]
    assert np.allclose(b[loadings.LEAST - 1], first)  # it starts at that window's mean, with no deviation


def test_windows_at_once_equal_windows_one_by_one():
    f, y, _ = world(230)
    y[[5, 60, 61, 130]] = np.nan
    b, cov, var, n = loadings.rolling_ols(y, f)
    for t in (110, 155, 156, 229):
        at = [i for i in range(max(0, t - loadings.WINDOW + 1), t + 1) if np.isfinite(y[i])]
        x = np.column_stack([np.ones(len(at)), f[at]])
        own, rest, *_ = np.linalg.lstsq(x, y[at], rcond=None)
        s2 = rest[0] / (len(at) - 3)
        assert n[t] == len(at) and np.allclose(b[t], own[1:]) and np.isclose(var[t], s2) and np.allclose(cov[t], s2 * np.linalg.inv(x.T @ x)[1:, 1:])


def test_peer_prior_uses_the_whole_covariance(spark):
    rng = np.random.default_rng(6)
    own = {i: (rng.normal(size=2), (lambda a: a @ a.T + 0.1 * np.eye(2))(rng.normal(size=(2, 2)))) for i in "abcdef"}
    rows = [(i, D(2020, 1, 3), x, float(b[j]), float(np.sqrt(c[j, j])), 0.1, 110, [float(v) for v in c[j]], j) for i, (b, c) in own.items() for j, x in enumerate("pq")]
    df = spark.createDataFrame(rows, "instrument string, date date, factor string, loading double, se double, resid_var double, n int, cov array<double>, place int")
    peers = spark.createDataFrame([(i, "x" if i < "e" else "y") for i in own], "instrument string, class string")
    got = {(r.instrument, r.factor): (r.loading, r.se) for r in loadings.with_peer_prior(df, peers).collect()}
    for i, (b, c) in own.items():
        if i < "e":
            others = np.array([own[j][0] for j in "abcd" if j != i])
            p, q = np.linalg.inv(c), np.diag(1 / others.var(axis=0, ddof=1))
            post = np.linalg.inv(p + q)
            b, c = post @ (p @ b + q @ others.mean(axis=0)), post
        for j, x in enumerate("pq"):
            assert np.allclose(got[i, x], (b[j], np.sqrt(c[j, j])))


def test_huber_shrugs_off_outliers():
    f, y, beta = world()
    y[-100::9] += 0.5
    ols, hub = loadings.rolling_ols(y, f)[0][-1], loadings.huber(y, f)[0][-1]
    assert np.abs(hub - beta).max() < np.abs(ols - beta).max()


def test_regimes_find_the_calm_weeks():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.01, (150, 2)), rng.normal(0, 0.05, (60, 2)), rng.normal(0, 0.01, (90, 2))])
    p, move = loadings.regimes(x, restarts=4)
    assert p[:140, 0].mean() > 0.9 and p[155:205, 1].mean() > 0.8 and np.allclose(move.sum(axis=1), 1)


def test_nnls_against_enumeration():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a, b = rng.standard_normal((8, 4)), rng.standard_normal(8)
        best = min((np.sum((a @ x - b) ** 2) for x in _feasible(a, b)))
        assert np.sum((a @ optimise.nnls(a, b) - b) ** 2) == pytest.approx(best, abs=1e-9)
    w = optimise.tracking_weights(a, a @ np.array([0.2, 0.3, 0.5, 0.0]))
    assert w == pytest.approx([0.2, 0.3, 0.5, 0.0], abs=1e-6)


def _feasible(a, b):
    for n in range(a.shape[1] + 1):
        for on in itertools.combinations(range(a.shape[1]), n):
            x = np.zeros(a.shape[1])
            if on:
                x[list(on)] = np.linalg.lstsq(a[:, on], b, rcond=None)[0]
            if (x >= 0).all():
                yield x


def test_long_only_against_a_grid():
    cov = np.array([[0.04, 0.01, 0.0], [0.01, 0.09, 0.02], [0.0, 0.02, 0.16]])
    bench, before, alpha, cost = np.ones(3) / 3, np.array([0.2, 0.3, 0.5]), np.array([0.02, 0.05, 0.08]), np.full(3, 0.002)
    value = lambda w: alpha @ w - cost @ np.abs(w - before)
    w = optimise.long_only(alpha, cov, bench, before, cost, 0.05)
    grid = [np.array([i, j, 100 - i - j]) / 100 for i in range(101) for j in range(101 - i)]
    best = max(value(g) for g in grid if (g - bench) @ cov @ (g - bench) <= 0.05**2)
    assert w.sum() == pytest.approx(1) and (w >= 0).all() and (w - bench) @ cov @ (w - bench) <= 0.05**2 + 1e-9
    assert value(w) >= best - 1e-3


def test_shrinkage_lies_between_sample_and_target():
    x = np.random.default_rng(6).standard_normal((60, 5)) @ np.diag([1, 2, 3, 4, 5])
    for target in ("constant_correlation", "identity"):
        c, k = covariance.shrink(x, target)
        assert 0 <= k <= 1 and np.allclose(c, c.T) and np.linalg.eigvalsh(c).min() > 0
    same = np.repeat(np.random.default_rng(7).standard_normal((60, 1)), 3, axis=1)
    assert covariance.shrink(same, "constant_correlation")[0] == pytest.approx(np.cov(same.T, ddof=0))


def test_planted_signal_has_its_ic(spark):
    rng = np.random.default_rng(1)
    truth = spark.createDataFrame([(f"S{s}", D(2020, 1, 1) + dt.timedelta(7 * t), float(rng.standard_normal())) for s in range(5) for t in range(80)], "series_id string, date date, z double")
    for ic in (0.0, 0.05, 0.5):
        got = synthetic.planted_scores(truth, ic, 3).join(truth, ["series_id", "date"]).agg(F.corr("score", "z")).first()[0]
        assert got == pytest.approx(ic, abs=1e-9)


def test_entry_and_registry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 150


def test_the_panel_holds_every_series(spark, monkeypatch):
    from brindle.plans import model_queries

    days = [D(2020, 1, 3), D(2020, 1, 10)]
    w = spark.createDataFrame([(f"S{i}", d, 0.01 * i) for i in range(8) for d in days], "series_id string, date date, ret double")
    m = spark.createDataFrame([(f"S{i}", "ASIA" if i % 2 else "EUROPE", f"M{i}" if i else "") for i in range(8)], "series_id string, region string, market string")
    monkeypatch.setattr(model_queries.h, "weekly", lambda *_: w)
    monkeypatch.setattr(model_queries.h, "meta", lambda *_: m)
    got = model_queries.panel(spark, "").groupBy("instrument").count().collect()
    assert {(r["instrument"], r["count"]) for r in got} == {(f"S{i}", 2) for i in range(8)}


def test_regimes_are_refitted_each_week_and_once_for_all_instruments(spark):
    f, y, _ = world(170)
    f[60:80] *= 4
    b = loadings.regime_conditional(y, f)[0]
    for t in (155, 156, 169):  # the last row of a shorter history is fitted anew
        assert np.allclose(b[t], loadings.regime_conditional(y[: t + 1], f[: t + 1])[0][-1])
        p, move = loadings.regimes(f[: t + 1])
        x = np.column_stack([np.ones(t + 1), f[: t + 1]])
        own = [np.linalg.lstsq(x * np.sqrt(p[:, [j]]), y[: t + 1] * np.sqrt(p[:, j]), rcond=None)[0][1:] for j in range(2)]
        assert np.allclose(b[t], (p[-1] @ move) @ np.array(own), atol=1e-6)
    days = [D(2020, 1, 3) + dt.timedelta(7 * i) for i in range(170)]
    rows = [(name, days[i], float(y[i]), float(f[i, 0]), float(f[i, 1])) for name, first in (("A", 0), ("B", 10)) for i in range(first, 170)]
    panel = spark.createDataFrame(rows, "instrument string, date date, ret double, p double, q double")
    got = loadings.estimated(panel, ["p", "q"], "regime").where("factor = 'p'").toPandas()
    assert np.allclose(got[got["instrument"] == "A"].sort_values("date")["loading"], b[loadings.WINDOW - 1 :, 0])
    assert (got["instrument"] == "B").sum() == 170 - loadings.WINDOW + 1


def test_regimes_have_full_covariances():
    rng = np.random.default_rng(5)
    z = rng.standard_normal((400, 2))
    calm = np.arange(400) % 200 < 120
    x = np.where(calm[:, None], np.column_stack([z[:, 0], 0.95 * z[:, 0] + 0.3 * z[:, 1]]), np.column_stack([z[:, 0], -0.95 * z[:, 0] + 0.3 * z[:, 1]]))  # alike but for the correlation
    p, _ = loadings.regimes(x)
    assert max((p.argmax(axis=1) == calm).mean(), (p.argmax(axis=1) != calm).mean()) > 0.9
