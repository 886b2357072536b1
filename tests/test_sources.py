from __future__ import annotations

from datetime import date, datetime

import pytest

from tidewatch import staging
from tidewatch.operators.activity import merged_activity
from tidewatch.operators.filters import Filters
from tidewatch.plans import reports, scoring
from tidewatch.schema import EXPORT
from tidewatch.session import require_utc
from tidewatch.sources import csv_logs
from tidewatch.sources.events import read_events, tag_events
from tidewatch.sources.risk_table import open_risk_table, read_risk_csv, write_csv, write_risk_table

from conftest import DATA

LOGON = """id,date,user,pc,activity
{1},01/02/2010 06:49:00,ann,PC-1,Logon
{2},01/02/2010 06:49:00,ann,PC-1,Logoff
{3},01/02/2010 07:00:00,NA,PC-1,Logon
{4},not a date,bob,PC-2,Logon
{5},01/03/2010 08:00:00,bob,PC-2,
"""
DEVICE = """activity,user,date
Connect,ann,01/02/2010 06:49:00
"""
HTTP = '''{a},01/02/2010 06:49:00,06:49,ann,PC-1,http://x.test/,"quoted, ""text""",10.0,5
{b},01/02/2010 06:49:00,06:49,ann,PC-1,http://y.test/,plain,,7
{c},01/04/2010 09:30:00,09:30,cid,PC-3,http://z.test/,plain,1,many
'''


@pytest.fixture
def paths(tmp_path):
    found = {}
    for name, text in (("logon", LOGON), ("device", DEVICE), ("http", HTTP)):
        (tmp_path / f"{name}.csv").write_text(text)
        found[name] = str(tmp_path / f"{name}.csv")
    return found


def test_logs_are_read_by_header_name(spark, paths, tmp_path):
    log = csv_logs.read_tagged(spark, **paths, rejects=str(tmp_path / "rejects"))
    found = {(r.user, r.date): r for r in merged_activity(log).collect()}
    ann = found["ann", datetime(2010, 1, 2, 6, 49)]
    assert (ann.logon_count, ann.http_requests, ann.device_activity_count) == (2, 2, 1)
    assert (ann.http_bytes_sent, ann.http_bytes_received) == (10, 12)
    # An empty activity is not counted but its user and date exist.
    assert found["bob", datetime(2010, 1, 3, 8)].logon_count == 0
    assert len(found) == 2
    aside = {(r.log, r.problem, r.raw_date) for r in spark.read.json(str(tmp_path / "rejects")).collect()}
    assert aside == {("logon", "date", "not a date"), ("http", "bytes_received", "01/04/2010 09:30:00")}


def test_unreadable_rows_end_the_job_by_default(spark, paths):
    with pytest.raises(Exception, match="unreadable date on not a date"):
        csv_logs.read_tagged(spark, **paths).where("source = 'logon'").collect()


def test_fractions_and_long_numbers_survive(spark, paths):
    row = "{{d}},01/02/2010 06:49:00,06:49,ann,PC-1,http://x.test/,t,{},{}\n"
    for sent, received, expected in (("12.7", "0.4", (12.7, 0.4)), ("9" * 20, "12.5", (1e20, 12.5)), ("", "NA", (0.0, 0.0))):
        with open(paths["http"], "w") as out:
            out.write(row.format(sent, received))
        web = csv_logs.read_logs(spark, **paths)[1]
        assert csv_logs.rejected(web).isEmpty()
        log = csv_logs.read_tagged(spark, **paths).where("source = 'http'")
        (got,) = merged_activity(log).collect()
        assert (got.http_bytes_sent, got.http_bytes_received) == pytest.approx(expected)
    for text in ("many", "1e999", "0x10"):
        with open(paths["http"], "w") as out:
            out.write(row.format(text, "1"))
        assert [r.problem for r in csv_logs.rejected(csv_logs.read_logs(spark, **paths)[1]).collect()] == ["bytes_sent"]


def test_headers_in_another_order(spark, tmp_path):
    folder = tmp_path / "both"
    folder.mkdir()
    (folder / "a.csv").write_text("user,date,activity\nann,01/02/2010 06:49:00,Logon\n")
    (folder / "b.csv").write_text("date,user,activity\n01/02/2010 06:50:00,bob,Logon\n")
    with pytest.raises(Exception, match="(?i)header"):
        csv_logs.read_headered(spark, str(folder)).collect()
    apart = csv_logs.read_headered(spark, [str(folder / "a.csv"), str(folder / "b.csv")])
    assert {r.user for r in apart.collect()} == {"ann", "bob"}


def test_grain_is_set_in_one_place(spark, paths, tmp_path):
    log = csv_logs.read_tagged(spark, **paths, rejects=str(tmp_path / "rejects"))
    days = scoring.features_of(log, "day").select("date").distinct().collect()
    assert {r.date for r in days} == {datetime(2010, 1, 2), datetime(2010, 1, 3)}


def test_headerless_web_log(spark, paths):
    rows = csv_logs.read_http(spark, paths["http"]).orderBy("id").collect()
    assert rows[0].content == 'quoted, "text"' and len(rows) == 3


def test_unreadable_dates_are_set_aside(spark, paths):
    logon, web, device = csv_logs.read_logs(spark, **paths)
    assert [(r.user, r.raw_date) for r in csv_logs.rejected(logon).collect()] == [("bob", "not a date")]
    assert [r.problem for r in csv_logs.rejected(web).collect()] == ["bytes_received"] and csv_logs.rejected(device).isEmpty()


@pytest.fixture(scope="module")
def risk(spark):
    return staging.stage(scoring.build_risk_table(tag_events(read_events(spark, DATA), "hour"), "hour"))


def test_stored_table_answers_like_the_fresh_one(spark, risk, tmp_path):
    path = str(tmp_path / "risk")
    write_risk_table(risk, path)
    stored = open_risk_table(spark, path)
    filters = Filters(start=date(2024, 1, 10), end=date(2024, 1, 12))
    kept = reports.filtered_export(stored, filters)
    assert kept.columns == list(EXPORT)
    expected = risk.where("date >= '2024-01-10' AND date < '2024-01-13'").count()
    assert kept.count() == expected > 0

    plan = filters.apply(stored).select("user").where("risk_level = 'High'")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(date,2024-01-10" in text and "EqualTo(risk_level,High)" in text
    assert "PartitionFilters: [isnotnull(event_month" in text
    assert "ReadSchema: struct<user:bigint,date:timestamp_ntz,risk_level:string>" in text


def test_csv_export_round_trip(spark, risk, tmp_path):
    path = str(tmp_path / "csv")
    write_csv(risk, path)
    back = read_risk_csv(spark, path)
    assert back.count() == risk.count()
    one, other = (
        {(int(r.user), r.event_time if "event_time" in r else r.date): r.asDict() for r in df.collect()}
        for df in (risk, back)
    )
    assert one.keys() == other.keys()
    for key, row in one.items():
        for name in EXPORT[2:]:
            assert other[key][name] == row[name], name


def test_float_counts_in_a_csv_export(spark, tmp_path):
    values = ["u1", "2010-01-02 06:49:00", "3.0", "0.0", "12.0", "7.0", "1.0", "", "0.5", "-0.5", "1.0", "3.0"]
    values += ["6", "5", "0", "1", "2.0", "1.0", "0.25", "High"]
    (tmp_path / "export.csv").write_text(",".join(EXPORT) + "\n" + ",".join(values) + "\n")
    (row,) = read_risk_csv(spark, str(tmp_path / "export.csv")).collect()
    assert (row.user, row.date, row.event_time) == ("u1", date(2010, 1, 2), datetime(2010, 1, 2, 6, 49))
    assert (row.logon_count, row.http_bytes_sent, row.logon_spike, row.risk_level) == (3, 12, None, "High")


def test_unneeded_columns_are_not_read(spark):
    log = tag_events(read_events(spark, DATA), "hour")
    plan = merged_activity(log).select("user", "logon_count")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
    assert "In(event_type" in plan


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = staging.shared_folder(spark)
    assert folder == configured or (configured is None and folder)
    assert staging.stage_path(spark, "x") != staging.stage_path(spark, "x")


def test_steps_that_need_utc(spark):
    require_utc(spark)
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        with pytest.raises(ValueError, match="UTC"):
            require_utc(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_stored_files_are_sorted_by_day(spark, risk, tmp_path):
    import glob

    import pyarrow.parquet as pq

    path = str(tmp_path / "risk")
    write_risk_table(risk, path)
    files = glob.glob(f"{path}/event_month=*/*.parquet")
    assert files
    for file in files:
        held = pq.ParquetFile(file).read(columns=["date", "user"]).to_pylist()
        assert held == sorted(held, key=lambda r: (r["date"], r["user"]))


def test_sizes_of_a_session():
    from tidewatch.session import DEFAULTS, initial_partitions

    assert initial_partitions(0) == 200 and initial_partitions(100 << 40) == 200_000
    assert initial_partitions(1 << 40) == 8192 and "spark.ui.enabled" not in DEFAULTS
