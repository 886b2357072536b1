from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.filters import Filters
from tidewatch.plans import reports
from tidewatch.sources.risk_table import as_report_table

ROWS = [
    # user, date, hour, logon, http, device, logon_spike, http_spike, score, level
    ("o'neil", "2024-01-01 23:00:00", 23, 4, 0, 0, 1.0, -3.2, 9.0, "High"),
    ("ann", "2024-01-02 00:00:00", 0, 0, 3, 0, 1.5, 1.0, 2.0, "Medium"),
    ("ann", "2024-01-02 05:00:00", 5, 1, 1, 1, 3.5, None, 1.0, "Low"),
    ("bob", "2024-01-31 10:00:00", 10, 0, 0, 2, -3.2, 3.5, 5.0, "High"),
    ("bob", "2024-02-01 10:00:00", 10, 2, 0, 0, None, 0.0, 0.5, "Odd"),
    ("eve", "2024-02-02 10:00:00", 10, 2, 0, 0, None, 0.0, None, None),
]


@pytest.fixture(scope="module")
def risk(spark):
    schema = (
        "user STRING, date STRING, hour INT, logon_count BIGINT, http_requests BIGINT, device_activity_count BIGINT, "
        "logon_spike DOUBLE, http_spike DOUBLE, risk_score DOUBLE, risk_level STRING"
    )
    df = spark.createDataFrame(ROWS, schema).withColumns(
        {
            "date": F.col("date").cast("timestamp_ntz"),
            "device_spike": F.lit(0.0),
            "anomaly": F.when(F.col("risk_score") > 4, -1).otherwise(1),
        }
    )
    return as_report_table(df.withColumn("weekday", F.weekday("date"))).cache()


def _scores(df):
    return sorted(r.risk_score for r in df.collect() if r.risk_score is not None)


@pytest.mark.parametrize(
    ("filters", "scores"),
    [
        (Filters(start=date(2024, 1, 1), end=date(2024, 1, 31)), [1.0, 2.0, 5.0, 9.0]),
        (Filters(start=date(2024, 1, 31)), [0.5, 5.0]),
        (Filters(end=date(2024, 1, 1)), [9.0]),
        (Filters(users=["o'neil"]), [9.0]),
        (Filters(users=["ann", *map(str, range(1_000))]), [1.0, 2.0]),
        (Filters(levels=["High", "Low"]), [1.0, 5.0, 9.0]),
        (Filters(spikes=["logon_spike"]), [1.0]),
        (Filters(spikes=["logon_spike"], spike_mode="exact"), [9.0]),
        (Filters(spikes=["http_spike"], spike_mode="exact"), [2.0]),
        (Filters(activity=["device"]), [1.0, 5.0]),
        (Filters(activity=["http", "device"]), [1.0, 2.0, 5.0]),
        (Filters(), [0.5, 1.0, 2.0, 5.0, 9.0]),
        (Filters(users=["ann", "bob"], levels=["High"], end=date(2024, 1, 31)), [5.0]),
    ],
)
def test_filters(risk, filters, scores):
    assert _scores(filters.apply(risk)) == scores


def test_filters_by_a_user_table(spark, risk):
    users = spark.createDataFrame([("bob",), ("bob",)], "user STRING")
    assert _scores(Filters(users=users).apply(risk)) == [0.5, 5.0]


def test_filters_commute(risk):
    one, two = Filters(levels=["High"]), Filters(end=date(2024, 1, 15))
    both = Filters(levels=["High"], end=date(2024, 1, 15))
    assert _scores(one.apply(two.apply(risk))) == _scores(two.apply(one.apply(risk))) == _scores(both.apply(risk))


@pytest.mark.parametrize("wrong", [{"spikes": ["x"]}, {"activity": ["mail"]}, {"spike_mode": "any"}])
def test_unknown_filter_values(wrong):
    with pytest.raises(ValueError, match="unknown"):
        Filters(**wrong)


def test_unknown_levels_leave_the_distribution(risk):
    spread = [(r.risk_level, r["count"]) for r in reports.risk_level_distribution(risk).collect()]
    assert spread == [("Low", 1), ("Medium", 1), ("High", 2)]
    counted = [(r.risk_level, r["count"]) for r in reports.risk_level_counts(risk).collect()]
    assert counted == [("High", 2), ("Low", 1), ("Medium", 1), (None, 1), ("Odd", 1)]


def test_empty_selection(risk):
    nothing = Filters(start=date(2030, 1, 1))
    assert [r["count"] for r in reports.risk_level_distribution(risk, nothing).collect()] == [0, 0, 0]
    (row,) = reports.kpis(risk, nothing).collect()
    assert (row.filtered_rows, row.total_unique_users, row.avg_risk_score, row.range_start) == (0, 0, None, "2030-01")
    for report in (
        reports.high_risk_daily,
        reports.top_users_high_risk,
        reports.risk_score_histogram,
        reports.flagged_events,
        reports.daily_activity_trend,
        reports.high_risk_by_hour,
        reports.high_risk_by_weekday,
        reports.high_risk_heatmap,
        reports.user_picker,
        reports.top_high_risk,
    ):
        assert report(risk, nothing).isEmpty(), report.__name__


def test_key_figures(risk):
    (row,) = reports.kpis(risk).collect()
    assert (row.filtered_rows, row.total_unique_users, row.total_high_risk_events) == (6, 4, 2)
    assert row.avg_risk_score == pytest.approx(3.5)
    assert (row.range_start, row.range_end) == ("2024-01", "2024-02")
    (rough,) = reports.kpis(risk, approximate_users=True).collect()
    assert rough == row
    (text,) = reports.kpi_texts(reports.kpis(risk)).collect()
    assert tuple(text) == ("6", "4", "2", "3.50", "2024-01 to 2024-02")
    (more,) = reports.kpis_extended(risk).collect()
    assert tuple(more) == (2, 2, 4 + 3 + 3 + 2 + 2 + 2)


def test_picker_follows_dates_only(risk):
    filters = Filters(start=date(2024, 1, 2), end=date(2024, 1, 31), users=["eve"], levels=["Low"])
    assert [r.user for r in reports.user_picker(risk, filters).collect()] == ["ann", "bob"]


def test_top_rows_and_users(risk):
    assert [r.user for r in reports.top_high_risk(risk, limit=1).collect()] == ["o'neil"]
    top = [(r.user, r.high_risk_events) for r in reports.top_users_high_risk(risk).collect()]
    assert top == [("bob", 1), ("o'neil", 1)]
    assert [r.risk_score for r in reports.flagged_events(risk, limit=2).collect()] == [9.0, 5.0]


def test_heatmap(risk):
    found = {r.weekday: r.asDict() for r in reports.high_risk_heatmap(risk).collect()}
    assert found[0]["h23"] == 1 and found[2]["h10"] == 1
    assert sum(v for row in found.values() for k, v in row.items() if k != "weekday") == 2


@pytest.mark.parametrize(
    ("scores", "bins"),
    [
        ([0.0, 1.0, 49.0, 50.0], {1: 1, 2: 1, 50: 2}),
        ([7.0, 7.0, 7.0], {1: 3}),
        ([None, 2.0], {1: 1}),
    ],
)
def test_histogram_edges(spark, scores, bins):
    df = spark.createDataFrame([(s,) for s in scores], "risk_score DOUBLE")
    found = {r.bucket: r["count"] for r in reports.risk_score_histogram(df).collect()}
    assert found == bins


@pytest.mark.parametrize("value", [0.0, 0.125, 0.375, 1.005, 2.675, 1.115, 8.345, 0.005, 1234567.125, 1e9 + 0.305, -0.125, -1.005, None])
def test_two_decimals_as_in_c(spark, value):
    from tidewatch.functions.display import two_decimals

    got = spark.createDataFrame([(value,)], "x DOUBLE").select(two_decimals(F.col("x"))).first()[0]
    assert got == (None if value is None else "%.2f" % value)
