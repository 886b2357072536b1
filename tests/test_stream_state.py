"""Per-user state of the stream and its late rows."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.activity import merged_activity
from tidewatch.schema import MEASURES, SPIKES
from tidewatch.sources.activity_store import ADDITIVE
from tidewatch.sources.events import read_events, tag_events
from tidewatch.streaming import activity_stream as streaming
from tidewatch.streaming import user_state
from tidewatch.streaming.late import LateAwareActivity

from conftest import DATA


def _add_file(events, folder):
    events.coalesce(1).write.mode("append").parquet(folder)


def _days(events, a, b):
    low, high = (datetime(2024, 1, 1) + timedelta(days=d) for d in (a, b))
    return events.where((F.col("ts") >= F.lit(low)) & (F.col("ts") < F.lit(high)))


def _running(events):
    """{(user, date): row} of every day against the user's days up to it, by plain Python."""
    daily = merged_activity(tag_events(events, "day")).orderBy("user", "date").collect()
    out, past = {}, {}
    for r in daily:
        seen = past.setdefault(r.user, [])
        seen.append(tuple(r[m] for m in MEASURES))
        row = {"days": len(seen)}
        for i, spike in enumerate(SPIKES):
            values = [s[i] for s in seen]
            mean = sum(values) / len(values)
            spread = (sum((v - mean) ** 2 for v in values) / (len(values) - 1)) ** 0.5 if len(values) > 1 else 0
            row[spike] = (values[-1] - mean) / spread if spread > 1e-12 else None
        logons = [s[0] for s in seen[-3:]]
        row["logon_rolling_3"] = sum(logons) / len(logons)
        out[r.user, r.date] = row
    return out


def _check(rows, expected, keys):
    assert {(r.user, r.date) for r in rows} == keys and len(rows) == len(keys)
    for r in rows:
        for name, value in expected[r.user, r.date].items():
            assert r[name] == (value if value is None else pytest.approx(value, abs=1e-9)), (name, r)


def test_history_goes_on_over_runs(spark, tmp_path):
    source, table, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    events = read_events(spark, DATA)
    expected = _running(events)

    def run():
        stream = user_state.user_history(streaming.event_stream(spark, source, "*.parquet", files_per_batch=1))
        return streaming.drain(stream, path=table, checkpoint=marks).collect()

    for a, b in ((0, 9), (9, 10), (10, 40)):
        _add_file(_days(events, a, b), source)
        rows = run()
        latest = _days(events, 0, b).agg(F.max("ts")).first()[0]
        closed = {k for k in expected if k[1] + timedelta(days=1) <= latest - timedelta(days=1)}
        _check(rows, expected, closed)
    assert run() == rows


def test_days_out_of_order_within_the_delay(spark, tmp_path):
    events = read_events(spark, DATA)
    folder = str(tmp_path / "in")
    for a, b in ((0, 3), (4, 5), (3, 4), (5, 40)):  # the fourth day after the fifth
        _add_file(_days(events, a, b), folder)
    stream = user_state.user_history(streaming.event_stream(spark, folder, "*.parquet", files_per_batch=1), delay="2 days")
    rows = streaming.drain(stream).collect()
    latest = events.agg(F.max("ts")).first()[0]
    expected = _running(events)
    _check(rows, expected, {k for k in expected if k[1] + timedelta(days=1) <= latest - timedelta(days=2)})


def test_moments():
    history = user_state.Moments()
    for n, counts in enumerate([(3, 0, 1), (3, 0, 5), (9, 0, 2)], 1):
        found = user_state.Moments(history.packed()).add(counts)
        assert history.add(counts) == found and history.n == n
    assert found["http_spike"] is None and found["logon_spike"] == pytest.approx(4 / 12**0.5) and found["logon_rolling_3"] == 5


# --- late rows ---


def _rows(df):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select("user", "date", *ADDITIVE).collect())


def _batch(events):
    return _rows(merged_activity(tag_events(events, "day")))


def test_late_rows_correct_closed_windows(spark, tmp_path):
    events = read_events(spark, DATA)
    late = _days(events, 3, 6).where("event_id % 3 = 0") if "event_id" in events.columns else _days(events, 3, 6).where("hash(ts) % 3 = 0")
    folder = str(tmp_path / "in")
    first = events.subtract(late)
    for a, b in ((0, 10), (10, 20)):
        _add_file(_days(first, a, b), folder)
    _add_file(late, folder)
    _add_file(_days(first, 20, 40), folder)
    activity = LateAwareActivity(spark, str(tmp_path / "out"))
    activity.run(streaming.event_stream(spark, folder, "*.parquet", files_per_batch=1))
    assert _rows(activity.corrected()) == _batch(events)
    side = activity.late()
    counted = late.where("user_id is not null and ts is not null").where(F.col("event_type").isin("signup", "error", "view", "click", "purchase"))
    assert side.agg(F.sum("n_late")).first()[0] == counted.count() > 0
    assert {r.batch for r in side.collect()} == {2} and side.agg(F.min("seconds_late")).first()[0] > 0
    mark = activity.watermark()
    closed = _rows(activity.closed())
    assert closed == [r for r in _batch(first) if r[1] + timedelta(days=1) <= mark]


def test_repeated_batches_change_nothing(spark, tmp_path):
    events = read_events(spark, DATA)
    activity = LateAwareActivity(spark, str(tmp_path / "out"))
    batches = [_days(events, 10, 40), _days(events, 0, 10)]
    for i in (0, 1, 1, 0, 1):
        activity.take(batches[i], i)
    assert _rows(activity.corrected()) == _batch(events)
    assert not activity.late().isEmpty() and LateAwareActivity(spark, str(tmp_path / "none")).corrected().isEmpty()


def test_history_in_a_session_with_the_default_state_store(spark):
    """The provider that Spark starts with can not hold the states of a user."""
    import __spark_entry__ as contract

    key, default = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, default)
    try:
        rows = contract.stream_user_history(spark, DATA).collect()
        assert spark.conf.get(key) == default
    finally:
        spark.conf.set(key, before)
    events = read_events(spark, DATA)
    expected = _running(events)
    latest = events.agg(F.max("ts")).first()[0]
    assert {(r.user, r.date) for r in rows} == {k for k in expected if k[1] + timedelta(days=1) <= latest - timedelta(days=1)}
