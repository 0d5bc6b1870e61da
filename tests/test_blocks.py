"""Blocks of instruments at once against one instrument, one window or one week at a time."""

import datetime as dt

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from brindle.operators import fit, loadings

D = dt.date


def ragged(m=5, n=230, k=2, seed=3):
    """Instruments of different lengths with holes, on shared factors."""
    rng = np.random.default_rng(seed)
    f = np.tile(rng.standard_normal((1, n, k)) * 0.05, (m, 1, 1))
    y = f @ np.array([1.2, -0.5])[:k] + rng.standard_t(2, (m, n)) * 0.02
    y[rng.uniform(size=y.shape) < 0.1] = np.nan
    for i in range(m):
        y[i, n - 20 * i :], f[i, n - 20 * i :] = np.nan, np.nan
    return y, f


def test_huber_of_a_block_equals_plain_reweighting():
    y, f = ragged()
    b, cov, var, count = loadings._huber_of(y, f)
    for i, t in [(0, 229), (0, 130), (2, 170), (4, 149), (4, 120)]:
        at = [s for s in range(max(0, t - loadings.WINDOW + 1), t + 1) if np.isfinite(y[i, s])]
        x, v = np.column_stack([np.ones(len(at)), f[i, at]]), y[i, at]
        own = np.linalg.lstsq(x, v, rcond=None)[0]
        for _ in range(300):
            e = v - x @ own
            scale = loadings.MAD * np.median(np.abs(e - np.median(e)))
            w = np.minimum(1, loadings.HUBER * scale / np.maximum(np.abs(e), 1e-300))
            own = np.linalg.lstsq(x * np.sqrt(w)[:, None], v * np.sqrt(w), rcond=None)[0]
        assert count[i, t] == len(at) and np.allclose(b[i, t], own[1:], rtol=1e-7) and np.isclose(var[i, t], ((v - x @ own) ** 2).sum() / (len(at) - 3))


def test_window_sums_keep_no_trace_of_old_rows():
    x = np.random.default_rng(1).normal(size=(2, 500, 1))
    x[0, 3] = 1e18
    got = loadings._window_sums(x)
    for t in (0, 100, 155, 156, 311, 312, 499):
        own = x[:, max(0, t - loadings.WINDOW + 1) : t + 1].sum(axis=1)
        assert np.allclose(got[:, t], own, rtol=1e-12)


def test_collinear_factors_have_the_least_loadings():
    y, f = ragged(2)
    f[:, :, 1] = 2 * f[:, :, 0]
    b = loadings._ols_of(y, f)[0][0, 229]
    assert b[1] == pytest.approx(2 * b[0])


def test_tables_of_whole_instruments():
    sizes = [3, 1, 7, 2, 9, 4]
    ids = np.repeat([f"S{i}" for i in range(6)], sizes)
    batches = [pa.record_batch({"instrument": pa.array(ids[i : i + 4]), "x": pa.array(np.arange(26)[i : i + 4])}) for i in range(0, 26, 4)]
    got = [t.to_pandas() for t in loadings._whole_instruments(iter(batches))]
    assert pd.concat(got)["x"].tolist() == list(range(26))
    assert sum(t["instrument"].nunique() for t in got) == 6 and len(got) > 1


@pytest.mark.parametrize("method", ["ols", "huber", "discount", "reverting"])
def test_blocks_give_what_single_instruments_give(spark, method):
    y, f = ragged()
    days = [D(2015, 1, 2) + dt.timedelta(7 * i) for i in range(y.shape[1])]
    rows = [(f"S{i}", days[t], float(y[i, t]) if np.isfinite(y[i, t]) else None, *map(float, f[i, t])) for i in range(5) for t in range(230 - 20 * i)]
    panel = spark.createDataFrame(rows, "instrument string, date date, ret double, p double, q double")
    got = {(r.instrument, r.date): (r.loading, r.se, r.resid_var, r.n, r.cov[1]) for r in loadings.estimated(panel, ["p", "q"], method, covariance=True).where("factor = 'p'").collect()}
    for i in range(5):
        b, cov, var, n = loadings.ESTIMATORS[method](y[i, : 230 - 20 * i], f[i, : 230 - 20 * i])
        due = np.flatnonzero(np.isfinite(b[:, 0]))
        assert sum(k[0] == f"S{i}" for k in got) == len(due) > 0
        for t in due:
            assert got[f"S{i}", days[t]] == pytest.approx((b[t, 0], np.sqrt(cov[t, 0, 0]), var[t], n[t], cov[t, 0, 1]), rel=1e-7)


def test_a_period_of_a_walk_forward_stands_for_itself(spark):
    """Against the loop over a whole run, with a series that prints on some days only; a task reads days of one period."""
    from brindle.operators import book

    days = [d for d in pd.bdate_range("2020-01-01", "2020-04-01") if d != pd.Timestamp("2020-02-07")]  # a Friday is missing
    rng = np.random.default_rng(0)
    rows = [("run", d.date(), s, None if i == 0 else float(rng.normal(0, 0.02)), 1e-3, 0.01) for i, d in enumerate(days) for j, s in enumerate("ABC") if j < 2 or i % 20 == 3]
    df = spark.createDataFrame(rows, "run_id string, date date, series_id string, ret double, half_spread double, drag double")

    def rule(date, week):
        assert len(week) == 3
        score = week.rank()
        return score / score.sum()

    made = book.walk_forward(df, rule)
    wide = df.toPandas().pivot(index="date", columns="series_id", values="ret").sort_index().fillna(0.0)
    ends, want, held = [i for i, d in enumerate(wide.index) if d.weekday() == 4], [], None
    for e in ends:
        new = rule(None, (1 + wide.iloc[max(0, e - 4) : e + 1]).prod() - 1).to_numpy()
        if held is not None:
            gross = 1.0
            for day in wide.iloc[last + 1 : e + 1].to_numpy():
                gross *= 1 + held @ day
                held = held * (1 + day) / (held * (1 + day)).sum()
            traded = np.abs(new - held).sum()
            want.append((gross - 1, traded, traded * 1e-3 + 0.01 / 52))
        held, last = new, e
    got = made.orderBy("date").collect()
    assert [g.date for g in got] == [wide.index[e] for e in ends[1:]] and np.allclose([(g.gross, g.turnover, g.cost) for g in got], want)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "FlatMapGroupsInPandas" not in plan  # no group holds a run


def test_predictions_made_with_the_loadings_equal_those_of_stored_loadings(spark):
    y, f = ragged(m=3, n=140)
    y[1, 120] = np.nan
    rows = [(f"S{i}", D(2020, 1, 3) + dt.timedelta(7 * t), *(float(v) if np.isfinite(v) else None for v in (y[i, t], *f[i, t]))) for i in range(3) for t in range(140)]
    panel = spark.createDataFrame(rows, "instrument string, date date, ret double, tilt double, market double")
    want = fit.predictions(loadings.estimated(panel, ["tilt", "market"], "ols"), panel, ["tilt", "market"]).orderBy("instrument", "date").toPandas()
    made = loadings.predicted(panel, ["tilt", "market"], "ols")
    got = made.orderBy("instrument", "date").toPandas()
    assert len(want) > 20 and list(got.columns) == list(want.columns) and (got[["instrument", "date"]] == want[["instrument", "date"]]).all(axis=None)
    assert np.allclose(got[["ret", "p"]], want[["ret", "p"]]) and all(a == pytest.approx(b) for a, b in zip(got["contributions"], want["contributions"]))
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()


def test_shares_of_factors_read_their_rows_once(spark):
    scored = spark.createDataFrame([("a", 1.0, {"x": 0.25, "y": 0.75}), ("a", 2.0, {"x": 2.0}), ("b", 3.0, None), ("b", 1.0, {"y": 1.0})], "g string, p double, contributions map<string,double>")
    got = {(r.g, r.factor): r.share for r in fit.factor_shares(scored, ["g"]).collect()}
    assert got == {("a", "x"): pytest.approx(4.25 / 5), ("a", "y"): pytest.approx(0.75 / 5), ("b", "y"): pytest.approx(0.1)}
    whole = fit.factor_shares(scored, [])
    assert {r.factor: r.share for r in whole.collect()} == {"x": pytest.approx(4.25 / 15), "y": pytest.approx(1.75 / 15)}
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()
