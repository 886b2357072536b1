from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions.calendar import calendar_columns, weekday_name
from tidewatch.functions.timestamps import truncate
from tidewatch.operators.features import behaviour_features, user_baseline


def _features(activity, chunk=None):
    return {(r.user, str(r.date)): r for r in behaviour_features(activity, chunk).collect()}


@pytest.mark.parametrize("chunk", [None, "hour", "day"])
def test_spikes_are_missing_without_deviation(activity_of, chunk):
    rows = [("single", "2024-01-01 08:00:00", 3, 1, 0)]
    rows += [("constant", f"2024-01-0{d} 08:00:00", 2, 4, 1) for d in range(1, 6)]
    for row in _features(activity_of(rows), chunk).values():
        assert (row.logon_spike, row.http_spike, row.device_spike) == (None, None, None)


@pytest.mark.parametrize("chunk", [None, "hour", "day"])
def test_rolling_mean_counts_rows_not_days(activity_of, chunk):
    days = ["2024-01-01 09:00:00", "2024-01-05 09:00:00", "2024-01-06 09:00:00", "2024-02-20 09:00:00"]
    rows = [("a", day, count, 0, 0) for day, count in zip(days, [5, 1, 3, 7], strict=True)]
    found = _features(activity_of(rows), chunk)
    rolled = [found["a", day].logon_rolling_3 for day in days]
    assert rolled == pytest.approx([5, 3, 3, 11 / 3])
    assert found["a", days[3]].logon_delta == pytest.approx(7 - 11 / 3)


def _random_rows(seed):
    rng = random.Random(seed)
    rows = {}
    for _ in range(400):
        user = rng.choice(["hot"] * 5 + ["a", "b", "c"])
        stamp = f"2024-01-{rng.randint(1, 4):02d} {rng.randint(0, 5):02d}:{rng.choice([0, 1, 2, 30]):02d}:{rng.choice([0, 9]):02d}"
        rows[user, stamp] = (user, stamp, rng.randint(0, 9), rng.randint(0, 99), rng.randint(0, 3))
    return list(rows.values())


@pytest.mark.parametrize("chunk", ["minute", "hour", "day"])
def test_chunks_give_the_values_of_whole_windows(activity_of, chunk):
    activity = activity_of(_random_rows(7))
    whole, chunked = _features(activity), _features(activity, chunk)
    assert whole.keys() == chunked.keys()
    for key, row in whole.items():
        other = chunked[key]
        for name in ("logon_rolling_3", "logon_delta", "logon_spike", "http_spike", "device_spike"):
            assert getattr(other, name) == pytest.approx(getattr(row, name), abs=1e-9), (key, name)


def test_features_against_pandas(activity_of):
    rows = _random_rows(3)
    frame = pd.DataFrame(rows, columns=["user", "date", "logon_count", "http_requests", "device_activity_count"])
    frame["date"] = pd.to_datetime(frame["date"])
    frame = frame.sort_values(["user", "date"]).reset_index(drop=True)
    by_user = frame.groupby("user")
    expected = pd.DataFrame(
        {
            "logon_spike": (frame.logon_count - by_user.logon_count.transform("mean"))
            / by_user.logon_count.transform("std"),
            "logon_rolling_3": by_user.logon_count.rolling(3, min_periods=1).mean().reset_index(drop=True),
            "device_http_ratio": frame.device_activity_count / (frame.http_requests + 1),
        }
    )
    got = behaviour_features(activity_of(rows)).orderBy("user", "date").toPandas()
    pd.testing.assert_frame_equal(got[expected.columns], expected)


def test_result_does_not_depend_on_partitioning(activity_of):
    activity = activity_of(_random_rows(11))
    assert _features(activity.repartition(1)) == _features(activity.repartition(8))


def test_baseline_uses_the_sample_deviation(activity_of):
    rows = [("a", f"2024-01-0{d} 08:00:00", c, 0, 0) for d, c in ((1, 1), (2, 2), (3, 6))]
    (row,) = user_baseline(activity_of(rows)).collect()
    assert row.logon_count_mean == pytest.approx(3)
    assert row.logon_count_std == pytest.approx(7**0.5)


@pytest.mark.parametrize(
    ("stamp", "weekday", "working", "off", "week"),
    [
        ("2024-01-07 06:59:00", 6, 0, 1, 1),
        ("2024-01-08 07:00:00", 0, 1, 0, 2),
        ("2024-01-01 19:59:00", 0, 1, 0, 1),
        ("2024-01-29 20:00:00", 0, 1, 1, 5),
    ],
)
def test_calendar_edges(spark, stamp, weekday, working, off, week):
    df = spark.sql(f"SELECT TIMESTAMP_NTZ '{stamp}' AS date")
    (row,) = df.withColumns(calendar_columns(F.col("date"))).collect()
    assert (row.weekday, row.is_working_day, row.is_off_hours, row.week_of_month) == (weekday, working, off, week)


def test_weekday_names(spark):
    names = spark.range(8).select(weekday_name(F.col("id").cast("int")).alias("n")).collect()
    assert [r.n for r in names] == ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", None]


def test_truncation_ignores_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-10 02:45:30' AS ts")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        columns = [truncate(F.col("ts"), g).cast("string").alias(g) for g in ("raw", "minute", "hour", "day")]
        (row,) = df.select(*columns).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r[11:] for r in row] == ["02:45:30", "02:45:00", "02:00:00", "00:00:00"]
    with pytest.raises(ValueError, match="grain"):
        truncate(F.col("ts"), "week")


def test_windows_share_one_shuffle_and_one_sort(activity_of):
    plan = behaviour_features(activity_of(_random_rows(1)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1
