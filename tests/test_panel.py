"""Panel operators on small tables worked by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brindle.functions import scalars
from brindle.operators import asof, panel, windows
from brindle.sources import hosted

D = dt.date


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by).collect()]


def levels(spark, *data):
    return spark.createDataFrame(list(data), "series_id string, date date, level double")


def test_return_spans_a_gap(spark):
    df = levels(spark, ("B", D(2020, 1, 1), 100.0), ("B", D(2020, 1, 2), None), ("B", D(2020, 1, 3), 110.0), ("A", D(2020, 1, 2), 5.0))
    got = rows(panel.returns_from_prior_observation(df), "series_id", "date")
    assert [g[:2] for g in got] == [("A", D(2020, 1, 2)), ("B", D(2020, 1, 1)), ("B", D(2020, 1, 3))]
    assert got[0][2] is None and got[1][2] is None and got[2][2] == pytest.approx(0.1)


def test_markers_become_null(spark):
    df = spark.createDataFrame([(x,) for x in ("#N/A", "", "NA", "nan", "1.5", "x", None, " ")], "raw string")
    assert [r[0] for r in panel.cleaned(df).collect()] == [None, None, None, None, 1.5, None, None, None]


def test_true_daily_start_needs_all_gaps(spark):
    sparse = [("A", D(2020, 1, 1) + dt.timedelta(30 * i), 1.0) for i in range(5)]
    dense = [("A", D(2020, 6, 1) + dt.timedelta(i), 1.0) for i in range(21)]
    short = [("B", D(2020, 6, 1) + dt.timedelta(i), 1.0) for i in range(20)]
    assert rows(panel.true_daily_starts(levels(spark, *sparse, *dense, *short)), "series_id") == [("A", D(2020, 6, 1))]


@pytest.mark.parametrize(("repeats", "kept"), [(5, 5), (6, 1)])
def test_stale_runs(spark, repeats, kept):
    data = [("A", D(2020, 1, 3) + dt.timedelta(7 * i), 2.0) for i in range(repeats)]
    assert panel.stale_dropped(levels(spark, *data)).count() == kept


def test_a_missing_week_ends_a_stale_run(spark):
    data = [("A", D(2020, 1, 3) + dt.timedelta(7 * i), 2.0) for i in range(7) if i != 3]
    assert panel.stale_dropped(levels(spark, *data)).count() == 6


def test_splice_scales_at_the_first_common_date_and_fills_holes(spark):
    data = [("S", D(2020, 1, i), float(i)) for i in (1, 2, 3, 4)] + [("T", D(2020, 1, 2), 20.0), ("T", D(2020, 1, 4), 44.0)]
    got = rows(panel.spliced(levels(spark, *data), "T", "S").where("series_id = 'T'"), "date")
    assert [g[2] for g in got] == [10.0, 20.0, 30.0, 44.0]
    with pytest.raises(ValueError, match="no date"):
        panel.spliced(levels(spark, ("S", D(2020, 1, 1), 1.0), ("T", D(2020, 1, 2), 1.0)), "T", "S")


def test_change_points_keep_every_as_of_answer(spark):
    v = spark.createDataFrame([("A", D(2020, 1, 1), D(2020, 2, i), x, 1) for i, x in ((1, 1.0), (2, 1.0), (3, 2.0), (4, 2.0), (5, 1.0))], "series_id string, period_end date, knowledge_date date, value double, grading int")
    thin = panel.change_points(v)
    assert thin.count() == 3
    for day in range(1, 7):
        assert rows(asof.as_of(v, f"2020-02-0{day}"), "period_end") == rows(asof.as_of(thin, f"2020-02-0{day}"), "period_end")


def test_as_of_skips_null_and_later_vintages(spark):
    v = spark.createDataFrame([("A", D(2020, 1, 1), D(2020, 2, 1), 1.0), ("A", D(2020, 1, 1), D(2020, 2, 5), None), ("A", D(2020, 1, 1), D(2020, 3, 1), 9.0), ("A", D(2020, 2, 1), D(2020, 3, 2), 4.0)], "series_id string, period_end date, knowledge_date date, value double")
    assert rows(asof.as_of(v, "2020-02-28"), "period_end") == [("A", D(2020, 1, 1), 1.0)]
    assert rows(asof.latest_as_of(v, "2020-03-02"), "series_id") == [("A", D(2020, 2, 1), 4.0)]
    assert asof.usage_log(v, "2020-02-28").count() == 2
    many = asof.as_of_many(v, spark.createDataFrame([(D(2020, 1, 15),), (D(2020, 2, 28),), (D(2020, 3, 2),)], "date date"))
    assert [r[2:] for r in rows(many, "date")] == [(None, None), (D(2020, 1, 1), 1.0), (D(2020, 2, 1), 4.0)]


def test_tolerance(spark):
    left = spark.createDataFrame([("A", D(2020, 1, 7)), ("A", D(2020, 1, 8))], "k string, date date")
    right = spark.createDataFrame([("A", D(2020, 1, 1), 5.0)], "k string, date date, value double")
    assert rows(asof.nearest_before(left, right, "k", 6), "date") == [("A", D(2020, 1, 7), D(2020, 1, 1), 5.0), ("A", D(2020, 1, 8), None, None)]


def test_periods_are_open_on_the_left(spark):
    r = spark.createDataFrame([("A", D(2020, 1, 3), 0.5), ("A", D(2020, 1, 6), 0.1), ("A", D(2020, 1, 10), None), ("A", D(2020, 1, 10), 0.1), ("A", D(2020, 1, 20), None)], "series_id string, date date, ret double")
    ends = spark.createDataFrame([(D(2020, 1, 3),), (D(2020, 1, 10),), (D(2020, 1, 17),), (D(2020, 1, 24),)], "date date")
    got = {x[1]: x[2] for x in rows(panel.period_returns(r, ends), "date")}
    assert got[D(2020, 1, 3)] == pytest.approx(0.5) and got[D(2020, 1, 10)] == pytest.approx(0.21) and D(2020, 1, 17) not in got and got[D(2020, 1, 24)] is None
    zero = {x[1]: x[2] for x in rows(panel.period_returns(r, ends, 0.0).select("series_id", "date", "ret"), "date")}
    assert zero[D(2020, 1, 17)] == 0.0 and zero[D(2020, 1, 24)] == 0.0


def test_rebalance_dates_fall_back_and_do_not_repeat(spark):
    days = spark.createDataFrame([(D(2020, 1, 1),), (D(2020, 1, 2),), (D(2020, 1, 10),), (D(2020, 1, 13),)], "date date")
    assert [r[0] for r in rows(panel.rebalance_dates(days), "date")] == [D(2020, 1, 2), D(2020, 1, 10)]


def test_truncation_needs_metadata_and_holdout_holds(spark):
    df = levels(spark, ("A", D(2020, 1, 1), 1.0), ("A", D(2020, 1, 2), 1.0))
    meta = spark.createDataFrame([("A", D(2020, 1, 2))], "series_id string, start date")
    assert [r[2] for r in rows(panel.truncated(df, meta), "date")] == [None, 1.0]
    with pytest.raises(ValueError, match="without metadata"):
        panel.truncated(df, meta.where("false"))
    with pytest.raises(ValueError, match="or later"):
        panel.before_holdout(df, "2020-01-02")
    assert panel.before_holdout(df, "2020-01-03").count() == 2


def test_no_rate_gives_no_level(spark):
    df = levels(spark, ("A", D(2020, 1, 1), 10.0), ("A", D(2020, 1, 2), 10.0), ("A", D(2020, 1, 3), 10.0))
    cur = spark.createDataFrame([("A", "EUR")], "series_id string, currency string")
    fx = spark.createDataFrame([("EUR", D(2020, 1, 1), 1.1), ("EUR", D(2020, 1, 3), 1.2)], "currency string, date date, rate double")
    assert [r[2] for r in rows(panel.converted(df, cur, fx), "date")] == [pytest.approx(11.0), None, pytest.approx(12.0)]
    assert rows(panel.dates_without_rate(df, cur, fx), "date") == [("EUR", D(2020, 1, 2))]


def test_z_scores_are_zero_until_burnt_in(spark):
    s = spark.createDataFrame([("A", D(2020, 1, i + 1), x) for i, x in enumerate([1.0, 2.0, None, 3.0, 100.0])], "series_id string, date date, score double")
    z = [r[2] for r in rows(windows.standardised(s, burn_in=3, cap=1.2), "date")]
    assert z[:3] == [0.0, 0.0, 0.0] and z[3] == pytest.approx(1.0) and z[4] == 1.2


def test_first_drawdown_is_zero(spark):
    a = spark.createDataFrame([("A", D(2020, 1, i + 1), x) for i, x in enumerate([-0.5, 0.1, -0.2])], "series_id string, date date, active double")
    assert [r[3] for r in rows(windows.drawdown(a), "date")] == [0.0, 0.0, pytest.approx(-0.2)]


def test_average_ranks(spark):
    df = spark.createDataFrame([("d", x) for x in (1.0, 2.0, 2.0, 3.0)], "date string, x double")
    assert sorted(r[0] for r in df.select(windows.average_rank(F.col("x"), ["date"])).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_conviction_and_horizons(spark):
    one = spark.createDataFrame([([0.5, 0.5], [1.0, 0.0], [-1.0, 2.0], "4-13")], "a array<double>, b array<double>, c array<double>, h string")
    r = one.select(scalars.entropy_conviction(F.col("a")), scalars.entropy_conviction(F.col("b")), scalars.max_probability_conviction(F.col("a")), scalars.normalised(F.col("c")), scalars.horizon(*(scalars.parse_horizon(F.col("h"))[k] for k in ("low", "high")))).first()
    assert r[0] == pytest.approx(0.0) and r[1] == pytest.approx(1.0) and r[2] == pytest.approx(0.0) and r[3] is None and r[4] == 7


def test_lookahead_counts_null_dates(spark):
    u = spark.createDataFrame([("a", D(2020, 1, 1), D(2020, 1, 2), D(2020, 1, 1)), ("b", D(2020, 1, 3), D(2020, 1, 2), D(2020, 1, 1)), ("c", D(2020, 1, 1), D(2020, 1, 2), None), ("d", D(2020, 1, 1), D(2020, 1, 2), D(2020, 1, 3))], "series_id string, knowledge_date date, used_on_date date, fitted_through date")
    assert sorted(r[0] for r in asof.lookahead_breaches(u).collect()) == ["b", "c", "d"]


def test_days_meet_their_periods_without_copies(spark):
    r = spark.createDataFrame([("A", D(2020, 1, 3), 0.5), ("A", D(2020, 1, 6), 0.1)], "series_id string, date date, ret double").repartition(2, "series_id")
    ends = spark.createDataFrame([(D(2020, 1, 3),), (D(2020, 1, 10),)], "date date")
    plan = panel.period_returns(r, ends)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # the one asked for above
    assert [tuple(x) for x in panel.in_periods(r, ends, "period").orderBy("date").select("date", "period").collect()] == [(D(2020, 1, 3), D(2020, 1, 3)), (D(2020, 1, 6), D(2020, 1, 10))]


def test_levels_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(hosted, "ROWS_A_TASK", 100)
    rows = hosted.table(spark, "/root/testdata/sf0.001", "lineitem").count()
    assert hosted.levels(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == -(-rows // 100)
