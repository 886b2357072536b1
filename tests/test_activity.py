from __future__ import annotations

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidewatch.operators.activity import merged_activity, merged_activity_join

DAY = "2024-01-02 00:00:00"


def _rows(df):
    columns = sorted(df.columns)
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_rows_without_user_or_date_form_no_group(log_of):
    log = log_of(
        [
            (None, DAY, "logon", "Logon", None, None),
            ("a", None, "http", "u", 1, 2),
            ("a", DAY, "device", "Connect", None, None),
        ]
    )
    for table in (merged_activity(log), merged_activity_join(log)):
        assert [r.user for r in table.collect()] == ["a"]


def test_missing_items_are_not_counted_but_keep_the_group(log_of):
    log = log_of([("a", DAY, "logon", None, None, None)])
    (row,) = merged_activity(log).collect()
    assert (row.logon_count, row.http_requests, row.device_activity_count) == (0, 0, 0)
    assert _rows(merged_activity(log)) == _rows(merged_activity_join(log))


def test_sum_of_missing_bytes_is_zero(log_of):
    log = log_of([("a", DAY, "http", "u", None, None), ("a", DAY, "http", "v", None, None)])
    (row,) = merged_activity(log).collect()
    assert (row.http_requests, row.http_bytes_sent, row.http_bytes_received) == (2, 0, 0)


def test_rows_in_one_source_only(log_of):
    log = log_of(
        [
            ("a", DAY, "logon", "x", None, None),
            ("b", DAY, "http", "x", 5, 7),
            ("c", DAY, "device", "x", None, None),
        ]
    )
    found = {
        r.user: (r.logon_count, r.http_requests, r.http_bytes_sent, r.http_bytes_received, r.device_activity_count)
        for r in merged_activity(log).collect()
    }
    assert found == {"a": (1, 0, 0, 0, 0), "b": (0, 1, 5, 7, 0), "c": (0, 0, 0, 0, 1)}


_event = st.tuples(
    st.sampled_from(["a", "b", None]),
    st.sampled_from([DAY, "2024-01-03 00:00:00", None]),
    st.sampled_from(["logon", "http", "device"]),
    st.sampled_from(["x", None]),
    st.sampled_from([1, 10, None]),
    st.sampled_from([3, None]),
)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(_event, min_size=1, max_size=30))
def test_one_aggregation_equals_outer_joins(log_of, rows):
    rows = [(*r[:4], *(r[4:] if r[2] == "http" else (None, None))) for r in rows]
    log = log_of(rows)
    assert _rows(merged_activity(log)) == _rows(merged_activity_join(log))


def test_one_shuffle_for_the_merge(log_of):
    log = log_of([("a", DAY, "logon", "x", None, None)])
    plan = merged_activity(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
