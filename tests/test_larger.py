"""Operators on more rows, blocks and ties than the small tables have, against plain computations."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from brindle.operators import book, covariance, stats

D = dt.date


def test_a_book_without_positive_weights_has_no_shares(spark):
    df = spark.createDataFrame([(D(2020, 1, 3), "S1", -0.1), (D(2020, 1, 3), "S2", 0.0), (D(2020, 1, 10), "S1", 0.5), (D(2020, 1, 10), "S2", 1.5)], "date date, series_id string, w double")
    got = {(r.date.day, r.series_id): r.w for r in book.polished(df, "S1", 0.01).collect()}
    assert got[3, "S1"] == 0.01 and np.isnan(got[3, "S2"])
    assert got[10, "S1"] == pytest.approx(0.01) and got[10, "S2"] == pytest.approx(0.99)


def test_pair_sums_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(covariance, "SERIES_BLOCK", 8)
    rng = np.random.default_rng(3)
    x = pd.DataFrame(rng.normal(size=(30, 40)), index=[D(2020, 1, 1) + dt.timedelta(i) for i in range(30)], columns=[f"S{j}" for j in range(40)]).mask(rng.uniform(size=(30, 40)) < 0.2)
    rows = [("u", k, d, float(v)) for (d, k), v in x.stack().items()]
    got = covariance.pairwise(spark.createDataFrame(rows, "set string, series_id string, date date, x double")).toPandas()
    want = x.cov()
    assert len(got) == 40 * 41 // 2 and (got["a"] <= got["b"]).all()
    assert np.allclose(got["cov"], [want.loc[a, b] for a, b in zip(got["a"], got["b"])])


def test_tests_with_the_same_values_tie_in_any_order_of_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.uniform(size=(41, 30)) * 0.1
    null = [(d, 30 * twin + j, float(x[d, j])) for twin in range(4) for d in rng.permutation(40).tolist() for j in range(30)]
    t = spark.createDataFrame([(30 * twin + j, float(x[40, j])) for twin in range(4) for j in range(30)], "test int, t double")
    got = dict(stats.standardised_columns(t, spark.createDataFrame(null, "draw int, test int, t0 double").repartition(5))[0].collect())
    assert all(got[j] == got[30 * twin + j] for twin in range(4) for j in range(30))
    want = (x[40] - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    assert np.allclose([got[j] for j in range(30)], want)


def test_shrunk_blocks_equal_the_whole_matrix(spark, monkeypatch):
    monkeypatch.setattr(covariance, "SHRUNK_BLOCK", 8)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(30, 40)) + rng.normal(size=(30, 1))
    x[:, 7] = 0.0
    days = [D(2020, 1, 3) + dt.timedelta(7 * i) for i in range(30)]
    world = {"u": x, "v": -x[:, :3] + x[:, :3].sum(axis=1, keepdims=True) * -0.4}
    df = spark.createDataFrame([(u, f"S{j:02d}", days[i], float(y[i, j])) for u, y in world.items() for i in range(30) for j in range(y.shape[1])], "universe string, series_id string, date date, ret double")
    for target in ("constant_correlation", "identity"):
        got = covariance.shrunk(df, target, window=26).toPandas()
        for u, y in world.items():
            want, k = covariance.shrink(y[-26:], target)
            own = got[got["universe"] == u]
            assert len(own) == want.size and np.allclose(own["shrinkage"], k)
            assert np.allclose(own.pivot(index="a", columns="b", values="cov").to_numpy(), want)
    bets = {r.universe: (r.bets, r.n) for r in covariance.shrunk_bets(df, window=26).collect()}
    for u, y in world.items():
        assert bets[u] == (pytest.approx(covariance.bets(covariance.correlation(covariance.shrink(y[-26:], "constant_correlation")[0]))), y.shape[1])


def test_no_task_of_a_shrunk_covariance_holds_a_universe(spark, monkeypatch):
    monkeypatch.setattr(covariance, "SHRUNK_BLOCK", 8)
    df = spark.range(40 * 30).selectExpr("'u' as universe", "concat('S', id % 40) as series_id", "date_add(date'2020-01-03', cast(7 * (id div 40) as int)) as date", "rand(1) as ret")
    sizes = [len(r.s) for r in covariance._packed(df, 26, 0.5).collect()]
    assert sum(sizes) == 40 and max(sizes) < 20


def test_pairs_of_regions_come_from_many_keys(spark, monkeypatch):
    monkeypatch.setattr(covariance, "SERIES_BLOCK", 8)
    m = spark.createDataFrame([(f"S{i}", "xyz"[i % 3]) for i in range(50)], "series_id string, region string")
    made = covariance.cross_region_pairs(m)
    want = {(a, b) for a in (f"S{i}" for i in range(50)) for b in (f"S{i}" for i in range(50)) if a < b and int(a[1:]) % 3 != int(b[1:]) % 3}
    got = [tuple(r) for r in made.collect()]
    assert len(got) == len(want) and set(got) == want
    assert "[i#" in made._jdf.queryExecution().optimizedPlan().toString() or "(i#" in made._jdf.queryExecution().optimizedPlan().toString()  # blocks, not regions, meet
    assert covariance.cross_region_pairs(m.limit(0)).count() == 0


def test_blocks_of_one_set_meet_by_key(spark):
    df = spark.createDataFrame([("u", "S1", D(2020, 1, 1), 1.0)], "set string, series_id string, date date, x double")
    joins = [x for x in covariance.pair_sums(df)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in x and "block" in x]
    assert joins and not any("<=" in x for x in joins)  # a pair of blocks is a key, not a row of a set's key


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_blocks_are_paired_where_they_were_written(spark):
    """No pair of series is sent or added up after it was made, and no side goes to all tasks."""
    df = spark.createDataFrame([("u", f"S{i}", D(2020, 1, d), float(i * d % 7)) for i in range(4) for d in range(1, 6)], "set string, series_id string, date date, x double")
    sums = plan_of(covariance.pair_sums(df))
    assert "CartesianProduct" in sums and "HashAggregate" not in sums and "SortMergeJoin" not in sums and "BroadcastHashJoin" not in sums
    weekly = df.select(df["set"].alias("universe"), "series_id", "date", df["x"].alias("ret"))
    for target in ("identity", "constant_correlation"):
        shrunk = plan_of(covariance.shrunk(weekly, target))
        assert "CartesianProduct" in shrunk and "block_b#" in shrunk and "SortMergeJoin" not in shrunk.split("CartesianProduct")[0]


def test_pairs_of_regions_send_no_side_to_all_tasks(spark):
    pairs = plan_of(covariance.cross_region_pairs(spark.createDataFrame([("S1", "x"), ("S2", "y")], "series_id string, region string")))
    assert "CartesianProduct" in pairs and "Broadcast" not in pairs


def test_far_pairs_alone_are_made_of_unlike_labels(spark, monkeypatch):
    monkeypatch.setattr(covariance, "SERIES_BLOCK", 8)
    rng = np.random.default_rng(5)
    x = pd.DataFrame(rng.normal(size=(30, 30)), index=[D(2020, 1, 1) + dt.timedelta(i) for i in range(30)], columns=[f"S{j}" for j in range(30)]).mask(rng.uniform(size=(30, 30)) < 0.2)
    df = spark.createDataFrame([("", k, d, float(v), "xyz"[int(k[1:]) % 3]) for (d, k), v in x.stack().items()], "set string, series_id string, date date, x double, label string")
    got, want = covariance.pairwise(df, apart=True).toPandas(), x.cov()
    assert len(got) == 30 * 20 // 2 and all(int(a[1:]) % 3 != int(b[1:]) % 3 and a < b for a, b in zip(got["a"], got["b"]))
    assert np.allclose(got["cov"], [want.loc[a, b] for a, b in zip(got["a"], got["b"])])


def test_rescaled_pairs_are_rescaled_covariances(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 6)) + rng.normal(size=(40, 1))
    x[:, 4] = 0.5
    x[rng.uniform(size=x.shape) < 0.2] = np.nan
    days = [D(2020, 1, 3) + dt.timedelta(7 * i) for i in range(40)]
    rows = [("u", f"S{j}", days[i], float(x[i, j]) if np.isfinite(x[i, j]) else None) for i in range(40) for j in range(6)]
    made = covariance.rescaled_pairs(spark.createDataFrame(rows, "universe string, series_id string, date date, ret double"), 13.0)
    got = made.toPandas().pivot(index="a", columns="b", values="cov").to_numpy()
    cov, w = pd.DataFrame(x).cov().to_numpy(), covariance.ewma(40, 13.0)
    y = np.nan_to_num(x)
    fast = w @ y**2 - (w @ y) ** 2
    s = np.where(np.diag(cov) > 1e-20, np.sqrt(fast / np.where(np.diag(cov) > 1e-20, np.diag(cov), 1)), 0)
    assert np.allclose(got, cov * np.outer(s, s)) and np.allclose(got, got.T)
    assert "Join" not in plan_of(made).split("CartesianProduct")[0]  # no pair meets its scales
