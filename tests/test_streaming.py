from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.activity import merged_activity
from tidewatch.operators.features import user_baseline
from tidewatch.plans import scoring
from tidewatch.sources.events import read_events, tag_events
from tidewatch.streaming import activity_stream as streaming

from conftest import DATA


def _by_key(df):
    return {(r.user, r.date): tuple(round(v, 6) for v in r[2:]) for r in df.collect()}


@pytest.fixture(scope="module")
def batch(spark):
    return merged_activity(tag_events(read_events(spark, DATA), "day"))


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """The events as ten files in time order."""
    folder = str(tmp_path_factory.mktemp("events"))
    events = read_events(spark, DATA)
    for part in range(10):
        low = datetime(2024, 1, 1) + timedelta(days=3 * part)
        slice_ = events.where((F.col("ts") >= low) & (F.col("ts") < low + timedelta(days=3)))
        slice_.coalesce(1).write.mode("append").parquet(folder)
    return folder


@pytest.mark.parametrize("files_per_batch", [None, 3])
def test_closed_windows_equal_the_batch_answer(spark, batch, files, files_per_batch):
    stream = streaming.event_stream(spark, files, "*.parquet", files_per_batch)
    got = _by_key(streaming.drain(streaming.windowed_activity(stream)))
    expected = _by_key(batch)
    latest = read_events(spark, DATA).agg(F.max("ts")).first()[0]
    closed = {k: v for k, v in expected.items() if k[1] + timedelta(days=1) <= latest - timedelta(days=1)}
    assert got == closed and 0 < len(closed) < len(expected)


def test_scored_stream(spark, batch):
    log = tag_events(read_events(spark, DATA), "day")
    scored = scoring.score_features(scoring.features_of(log, "day"), keep=("user", "date"))
    # A baseline without one of the users: it scores 0 there.
    baseline = user_baseline(batch).where("user <> 3")
    stream = streaming.windowed_activity(streaming.event_stream(spark, DATA, "events.parquet"))
    got = streaming.drain(streaming.scored_activity(stream, baseline, scored.thresholds)).collect()
    expected = {(r.user, r.date): (r.risk_score, r.risk_level) for r in scored.frame.collect()}
    assert {r.risk_score for r in got if r.user == 3} == {0.0}
    known = [r for r in got if r.user != 3]
    assert known and all((r.risk_score, r.risk_level) == expected[r.user, r.date] for r in known)


def test_closed_and_open_windows_are_the_batch_answer(spark, batch, files):
    closed = streaming.drain(streaming.windowed_activity(streaming.event_stream(spark, files, "*.parquet")))
    both = closed.unionByName(streaming.open_windows(closed, read_events(spark, DATA)))
    assert _by_key(both) == _by_key(batch) and both.count() == batch.count()
    nothing = streaming.open_windows(closed.limit(0), read_events(spark, DATA))
    assert _by_key(nothing) == _by_key(batch)


def test_second_run_goes_on_where_the_first_stopped(spark, batch, tmp_path):
    source, table, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    events = read_events(spark, DATA)
    middle = datetime(2024, 1, 15)
    events.where(F.col("ts") < middle).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = streaming.windowed_activity(streaming.event_stream(spark, source, "*.parquet"))
        return _by_key(streaming.drain(stream, path=table, checkpoint=marks)), spark.read.parquet(table).count()

    first, rows = run()
    assert run() == (first, rows) and rows == len(first) > 0
    events.where(F.col("ts") >= middle).coalesce(1).write.mode("append").parquet(source)
    second, rows = run()
    assert rows == len(second) > len(first) and first.items() <= second.items()
    assert second.items() <= _by_key(batch).items()
