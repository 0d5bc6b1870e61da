"""Readers, vetoes, factors and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from brindle.operators import factors, vetoes
from brindle.sources import readers
from brindle.streaming import weekly

D = dt.date


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_wide_grid(spark, tmp_path):
    path = write(tmp_path, "w.csv", "date,AA_local_EUR,BB_local_GBP\n2020-01-01,1.5,#N/A\n2020-01-02,,7\n")
    got = sorted(map(tuple, readers.wide_csv(spark, path, ("EUR", "GBP")).collect()), key=str)
    assert got == sorted([("AA", D(2020, 1, 1), 1.5), ("BB", D(2020, 1, 1), None), ("AA", D(2020, 1, 2), None), ("BB", D(2020, 1, 2), 7.0)], key=str)
    with pytest.raises(ValueError, match="local"):
        readers.wide_csv(spark, path, ("EUR",))
    with pytest.raises(ValueError, match="doubled"):
        readers.wide_csv(spark, write(tmp_path, "x.csv", "date,A,A\n2020-01-01,1,2\n"))


def test_blocks(spark, tmp_path):
    path = write(tmp_path, "b.csv", "i,d,v,i2,d2,v2\nA,2020-01-03,1,B,2020-01-03,2\nA,2020-01-10,3,,,\n")
    assert readers.blocks_csv(spark, path).count() == 3
    with pytest.raises(ValueError, match="not a number"):
        readers.blocks_csv(spark, write(tmp_path, "c.csv", "i,d,v\nA,2020-01-03,oops\n"))
    with pytest.raises(ValueError, match="same"):
        readers.blocks_csv(spark, write(tmp_path, "d.csv", "i,d,v\nA,2020-01-03,1\nA,2020-01-03,2\n"))


def test_request_lists_and_sources(spark, tmp_path):
    assert [r[0] for r in readers.request_list(spark, write(tmp_path, "r.txt", "# all\nUSD_X # one\n\nEUR_X\n")).collect()] == ["USD_X", "EUR_X"]
    with pytest.raises(ValueError, match="same"):
        readers.request_list(spark, write(tmp_path, "q.txt", "A\nA\n"))
    assert readers.source("synthetic")(spark, 2, "2020-01-01", "2020-02-01", 1).count() > 0
    with pytest.raises(ValueError, match="unknown"):
        readers.source("nowhere")
    for n in ("P-1", "P-3", "P-2", "Q-9"):
        (tmp_path / n).mkdir()
    assert readers.newest_folder(spark, str(tmp_path), "P-").endswith("P-3")
    with pytest.raises(FileNotFoundError):
        readers.newest_folder(spark, str(tmp_path), "Z-")


def test_vendor_pull(spark):
    schema = "real_date date, cid string, xcat string, value double, grading double, eop_lag double"
    pull = spark.createDataFrame([(D(2020, 2, 10), "USD", "X", 1.0, 1.0, 10.0), (D(2020, 2, 11), "USD", "X", None, 1.0, 11.0), (D(2020, 2, 12), "USD", "X", 2.0, 3.0, 12.0), (D(2020, 2, 12), "EUR", "X", 2.0, 1.0, 12.0)], schema)
    wanted = spark.createDataFrame([("USD_X",)], "series_id string")
    out, counts = readers.vintage_frame(pull, wanted)
    assert [(r.period_end, r.value) for r in out.collect()] == [(D(2020, 1, 31), 1.0)] and counts == {"rows": 3, "nulls": 1, "graded_out": 1}
    with pytest.raises(ValueError, match="not in the pull"):
        readers.vintage_frame(pull, spark.createDataFrame([("GBP_X",)], "series_id string"))
    for lag, grade in ((float("nan"), 1.0), (-93.0, 1.0), (1.0, None)):
        with pytest.raises(ValueError, match="bad lag"):
            readers.vintage_frame(spark.createDataFrame([(D(2020, 1, 1), "A", "B", 1.0, grade, lag)], schema))


def test_vetoes_pass_fail_and_missing(spark):
    c = {
        "cash": spark.createDataFrame([(D(2020, 1, 3), 0.2)], "date date, w double"),
        "weights": spark.createDataFrame([(D(2020, 1, 3), f"S{i}", 0.1) for i in range(31)], "date date, series_id string, w double"),
        "availability": spark.createDataFrame([(D(2020, 1, 3), f"S{i}", i < 8) for i in range(10)], "date date, series_id string, available boolean"),
        "seeds": spark.createDataFrame([(1, 0.30), (2, 0.45)], "seed int, ir double"),
        "ic": spark.createDataFrame([(0.02, 1)], "ic double, expected int"),
        "contributions": spark.createDataFrame([("A", D(2020, 1, 1))], "series_id string, date date"),
        "meta": spark.createDataFrame([("A", D(2020, 1, 2))], "series_id string, start date"),
        "usage": spark.createDataFrame([(D(2020, 1, 1), D(2020, 1, 1), D(2020, 1, 1))], "knowledge_date date, used_on_date date, fitted_through date"),
        "t": spark.createDataFrame([(1, 9.0)], "test int, t double"),
        "null": spark.range(120).select(F.col("id").alias("draw"), F.lit(1).alias("test"), F.sin("id").alias("t0")),
        "own": spark.createDataFrame([(1,)], "test int"),
    }
    out = vetoes.apply(spark, c)
    got = {r.veto: r.passed for r in out.collect()}
    assert got == {"cash": True, "risk_calibration": False, "positions": False, "coverage": True, "lookahead": True, "frequency": False, "seed_stability": True, "multiple_testing": True, "direction": True}
    assert vetoes.first_failure(out) == "risk_calibration"
    assert "missing" in out.where("veto = 'risk_calibration'").first().detail
    few = c | {"null": c["null"].where("draw < 99")}
    assert not vetoes.VETOES["multiple_testing"](few).first().passed


def test_factor_frame(spark):
    roles = {k: k for k in ("equity", "real_yield", "breakeven", "credit", "dollar", "commodities")}
    rows = [(k, D(2020, 1, 3) + dt.timedelta(7 * t), v * (1 + 0.1 * t)) for k, v in zip(roles, (100.0, 1.0, 2.0, 3.0, 90.0, 50.0)) for t in range(3) if not (k == "dollar" and t == 1)]
    cal = spark.createDataFrame([(D(2020, 1, 3) + dt.timedelta(7 * t),) for t in range(3)], "date date")
    got = factors.frame(spark.createDataFrame(rows, "series_id string, date date, level double"), cal, roles).orderBy("date").collect()
    assert got[1].equity == pytest.approx(0.0953102) and got[1].real_yield == pytest.approx(0.1) and got[1].credit == pytest.approx(30.0)
    assert got[1].dollar is None and got[2].dollar is None and got[0].equity is None


def test_streams(spark, tmp_path):
    schema = "event_id long, ts timestamp, event_type string, value double"
    base = dt.datetime(2020, 1, 2)
    for part, days in enumerate(([0, 1, 9], [20, 40], [1, 41])):
        spark.createDataFrame([(part * 10 + i, base + dt.timedelta(d), "a", float(d)) for i, d in enumerate(days)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = weekly.weekly_last(weekly.events(spark, str(tmp_path / "in"), schema)).writeStream.outputMode("append").format("memory").queryName("weeks").trigger(availableNow=True).start()
    q.awaitTermination(120)
    closed = spark.table("weeks").collect()
    assert closed and all(r.n >= 1 for r in closed)
    v = weekly.append_vintages(weekly.events(spark, str(tmp_path / "in"), schema), str(tmp_path / "v"), str(tmp_path / "ck"))
    v.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "v")).count() == 7


def test_local_columns(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    with open(path, "w") as f:
        f.write("date,A_local_EUR,A_USD_unhedged,B_USD_unhedged,C_local_JPY\n2020-01-02,1.5,9,2.5,#N/A\n")
    got = readers.local_csv(spark, path, {"A": "EUR", "B": "GBP", "C": "JPY"}).collect()
    assert sorted((r.series_id, r.level, r.currency) for r in got if r.level is not None) == [("A", 1.5, "EUR"), ("B", 2.5, "USD")] and len(got) == 3
    with pytest.raises(ValueError, match="not in USD"):
        readers.local_csv(spark, path, {"A": "USD"})
    with pytest.raises(ValueError, match="no column"):
        readers.local_csv(spark, path, {"D": "EUR"})
    assert readers.loader("synthetic").analytics is not None and readers.source("wide") is readers.wide_csv
    with pytest.raises(ValueError, match="unknown source"):
        readers.loader("nowhere")
