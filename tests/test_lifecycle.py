"""Moves of hypotheses: legal, refused, repeated, and two writers at once."""

import datetime as dt

import pytest

from brindle.operators import lifecycle as life


def batch(spark, *moves):
    t = dt.datetime(2020, 1, 1)
    return spark.createDataFrame([(i, t + dt.timedelta(days=i), h, a, b, None, "") for i, (h, a, b) in enumerate(moves)], "pos int, ts timestamp, hypothesis_id string, from_state string, to_state string, run_id string, detail string")


def test_moves_follow_one_another(spark, tmp_path):
    log = life.TransitionLog(spark, str(tmp_path / "log"))
    assert log.version() == 0 and log.rows().count() == 0
    assert log.record(batch(spark, ("a", "pending", "running"), ("b", "pending", "done"), ("a", "running", "done"))) == 1
    assert log.record(batch(spark, ("b", "done", "pending"), ("c", "pending", "running"))) == 2
    now = {r.hypothesis_id: (r.state, r.moves) for r in life.latest(log.rows()).collect()}
    assert now == {"a": ("done", 2), "b": ("pending", 2), "c": ("running", 1)}
    assert {r.hypothesis_id: r.state for r in life.latest(log.rows(1)).collect()} == {"a": "done", "b": "done"}
    assert {r.state: r.hypotheses for r in life.counts(log.rows()).collect()} == {"pending": 1, "running": 1, "done": 1}
    assert log.record(batch(spark).limit(0)) == 2 and log.version() == 2


@pytest.mark.parametrize("moves,fault", [
    ((("a", "pending", "running"), ("a", "pending", "done")), "does not stand there"),
    ((("a", "running", "done"),), "does not stand there"),
    ((("a", "pending", "pending"),), "no move"),
    ((("a", "pending", "gone"),), "unknown state"),
    (((None, "pending", "running"),), "no hypothesis"),
    ((("a", None, "running"),), "unknown state"),
])
def test_a_batch_with_a_fault_is_refused_whole(spark, tmp_path, moves, fault):
    log = life.TransitionLog(spark, str(tmp_path / "log"))
    with pytest.raises(life.Refused, match=fault):
        log.record(batch(spark, ("z", "pending", "running"), *moves))
    assert log.version() == 0 and log.rows().count() == 0


def test_repeated_and_forbidden_moves(spark, tmp_path):
    log = life.TransitionLog(spark, str(tmp_path / "log"), moves=(("pending", "running"), ("running", "done")))
    one = batch(spark, ("a", "pending", "running"))
    log.record(one)
    with pytest.raises(life.Refused, match="does not stand there"):
        log.record(one)
    with pytest.raises(life.Refused, match="not allowed"):
        log.record(batch(spark, ("b", "pending", "done")))
    with pytest.raises(life.Refused, match="one position"):
        log.record(one.unionByName(one).replace("a", "c", "hypothesis_id"))
    assert log.version() == 1


def test_of_two_writers_that_read_the_same_one_wins(spark, tmp_path):
    first, second = (life.TransitionLog(spark, str(tmp_path / "log")) for _ in range(2))
    read = first.version()
    assert second.record(batch(spark, ("a", "pending", "running")), read) == 1
    with pytest.raises(life.Overtaken):
        first.record(batch(spark, ("a", "pending", "done")), read)
    # What the loser wrote aside counts for nothing; after reading again its move is judged anew.
    assert [(r.hypothesis_id, r.to_state) for r in first.rows().collect()] == [("a", "running")]
    with pytest.raises(life.Refused, match="running"):
        first.record(batch(spark, ("a", "pending", "done")))
    assert first.record(batch(spark, ("a", "running", "done"))) == 2


def test_a_commit_that_is_there_is_not_replaced(spark, tmp_path, monkeypatch):
    """The second writer is past its look at the version when the first commits: the file system decides."""
    log = life.TransitionLog(spark, str(tmp_path / "log"))
    log.record(batch(spark, ("a", "pending", "running")))
    monkeypatch.setattr(life.TransitionLog, "version", lambda self: 0)
    with pytest.raises(life.Overtaken):
        log._claim(1, "other")
    monkeypatch.undo()
    assert [r.to_state for r in log.rows().collect()] == ["running"]


def test_states_at_dates_and_verdicts(spark, tmp_path):
    log = life.TransitionLog(spark, str(tmp_path / "log"))
    log.record(batch(spark, ("a", "pending", "running"), ("a", "running", "done"), ("b", "pending", "running")))
    dates = spark.createDataFrame([(dt.datetime(2019, 1, 1),), (dt.datetime(2020, 1, 1),), (dt.datetime(2020, 1, 2, 12),)], "as_of timestamp")
    got = sorted((r.hypothesis_id, r.as_of.day, r.state) for r in life.latest_at(log.rows(), dates).collect())
    assert got == [("a", 1, "running"), ("a", 2, "done")]
    assert life.verdict_detail("kept", "rejected") == "kept verdict: rejected; power_at_nearest_ic: null" and life.verdict_detail("", "ok", 0.5) == "verdict: ok; power_at_nearest_ic: 0.500"
