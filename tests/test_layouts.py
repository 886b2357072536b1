"""Ordered exports, files by user, and dates in several formats."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.filters import Filters
from tidewatch.sources import csv_logs, date_formats, ordered_export, user_files

ROWS = "user string, date timestamp_ntz, risk_score double, risk_level string"


@pytest.fixture(scope="module")
def risk(spark):
    """40 users over two months, one of them with a third of all rows."""
    moments = [datetime(2024, 1, 10) + timedelta(hours=7 * i) for i in range(120)]
    rows = [(f"u{i:02d}", moments[(7 * i + k) % 120], float(k), "High" if k % 5 == 0 else "Low") for i in range(40) for k in range(20)]
    rows += [("hot, \"the\" one", m, 1.0, "Low") for m in moments for _ in range(3)]
    return spark.createDataFrame(rows, ROWS).repartition(6)


@pytest.mark.parametrize("parts", [1, 8, None])
def test_ordered_export(spark, risk, tmp_path, parts):
    ordered_export.write_ordered(risk, str(tmp_path / "out"), parts=parts)
    back = ordered_export.read_ordered(spark, str(tmp_path / "out"), risk.schema).orderBy("row_no").collect()
    assert [r.row_no for r in back] == list(range(1, risk.count() + 1))
    keys = [(r.user, r.date) for r in back]
    assert keys == sorted(keys)
    manifest = ordered_export.read_manifest(spark, str(tmp_path / "out"), risk.schema)
    assert ordered_export.out_of_order(manifest).isEmpty()
    named = [(r.part, r.rows) for r in manifest.orderBy("part").collect()]
    assert sum(n for _, n in named) == len(back)
    if parts == 8:
        hot = ordered_export.parts_with(manifest, user='hot, "the" one').collect()
        assert len(named) > 4 and 1 < len(hot) < len(named) and max(n for _, n in named) < len(back) / 2


def test_broken_order_is_seen(spark):
    at = lambda u: (u, datetime(2024, 1, 1))
    rows = [("part-0", at("a"), at("c"), 2, 0), ("part-1", at("b"), at("d"), 2, 2)]
    key = "struct<user: string, date: timestamp_ntz>"
    manifest = spark.createDataFrame(rows, f"part string, first {key}, last {key}, rows bigint, rows_before bigint")
    assert [r.part for r in ordered_export.out_of_order(manifest).collect()] == ["part-1"]


def test_drilldown_opens_few_files(spark, risk, tmp_path):
    path = str(tmp_path / "by-user")
    user_files.write_by_user(risk, path, files=12)
    everything = spark.read.parquet(f"{path}/rows").inputFiles()
    for users in (["u03"], ["u03", "u21", "nobody"], ["hot, \"the\" one"]):
        opened = user_files.open_for_users(spark, path, users)
        got = Filters(users=users).apply(opened).select("user", "event_time", "risk_score")
        wanted = risk.where(F.col("user").isin(users)).select("user", "date", "risk_score")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))
        assert 0 < len(opened.inputFiles()) < len(everything) / 2
    assert user_files.open_for_users(spark, path, ["nobody"]).count() == 0
    chosen = risk.where("user = 'u05'").select("user").distinct()
    assert user_files.files_of(spark, path, chosen) == user_files.files_of(spark, path, ["u05"])


def test_files_carry_bloom_filters(spark, risk, tmp_path):
    path = str(tmp_path / "by-user")
    user_files.write_by_user(risk, path, files=2)
    jvm, found = spark._jvm, 0
    for name in spark.read.parquet(f"{path}/rows").inputFiles():
        place = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(name), spark._jsc.hadoopConfiguration())
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(place)
        for block in reader.getFooter().getBlocks():
            found += sum(c.getPath().toDotString() == "user" and c.getBloomFilterOffset() > 0 for c in block.getColumns())
        reader.close()
    assert found > 0


# --- date formats ---

MOMENTS = [datetime(2024, 1, 3, 4, 5, 6), datetime(2024, 1, 25, 14, 0, 0), datetime(2024, 2, 11, 23, 59, 59)]
STYLES = {"%m/%d/%Y %H:%M:%S": 0, "%d/%m/%Y %H:%M:%S": 1, "%Y-%m-%d %H:%M:%S": 2}


def _log(folder, name, header, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join([header, *rows] if header else rows) + "\n")


def test_every_file_votes(spark, tmp_path):
    for style, i in STYLES.items():
        texts = [m.strftime(style) for m in MOMENTS]
        _log(tmp_path / "logon", f"f{i}.csv", "user,date,activity", [f"u{k},{t},on" for k, t in enumerate(texts)])
        _log(tmp_path / "device", f"f{i}.csv", "user,date,activity", [f"u{k},{t},plug" for k, t in enumerate(texts)])
        _log(tmp_path / "http", f"f{i}.csv", "", [f"x,{t},,u{k},pc,url,c,1,2" for k, t in enumerate(texts)])
    _log(tmp_path / "logon", "empty.csv", "user,date,activity", ["u9,,on"])
    paths = {name: str(tmp_path / name) for name in ("logon", "device", "http")}
    got = csv_logs.read_tagged(spark, **paths, timestamp_format=date_formats.FORMATS)
    dated = sorted((r.source, r.user, r.date) for r in got.where("date is not null").collect())
    assert dated == sorted((s, f"u{k}", m) for s in paths for k, m in enumerate(MOMENTS) for _ in STYLES)


def test_undecidable_files_are_named(spark, tmp_path):
    _log(tmp_path / "logon", "either.csv", "user,date,activity", ["u1,01/02/2024 00:00:00,on", "u2,03/04/2024 00:00:00,on"])
    _log(tmp_path / "logon", "same.csv", "user,date,activity", ["u3,05/05/2024 00:00:00,on"])
    _log(tmp_path / "logon", "junk.csv", "user,date,activity", ["u4,yesterday,on"])
    _log(tmp_path / "logon", "mostly.csv", "user,date,activity", ["u5,31/01/2024 00:00:00,on", "u6,01/02/2024 00:00:00,on", "u7,01/31/2024 00:00:00,on", "u8,30/01/2024 00:00:00,on"])
    _log(tmp_path / "device", "d.csv", "user,date,activity", ["u1,2024-01-31 00:00:00,plug"])
    _log(tmp_path / "http", "h.csv", "", ["x,2024-01-31 00:00:00,,u1,pc,url,c,1,2"])
    paths = {name: str(tmp_path / name) for name in ("logon", "device", "http")}
    logon, _, _ = csv_logs.read_logs(spark, **paths, timestamp_format=date_formats.FORMATS)
    problems = {r.user: r.problem for r in logon.collect()}
    assert problems["u1"].endswith("either.csv: ambiguous") and problems["u2"] == problems["u1"]
    assert problems["u4"].endswith("junk.csv: unreadable")
    assert problems["u3"] is None and problems["u5"] is None and problems["u6"] is None and problems["u7"] == "date"
    assert {r.user: r.date for r in logon.collect()}["u6"] == datetime(2024, 2, 1)
    with pytest.raises(Exception, match="either.csv: ambiguous|junk.csv: unreadable|unreadable date"):
        csv_logs.read_tagged(spark, **paths, timestamp_format=date_formats.FORMATS).collect()
    kept = csv_logs.read_tagged(spark, **paths, rejects=str(tmp_path / "rejects"), timestamp_format=date_formats.FORMATS)
    assert sorted(r.user for r in kept.where("source = 'logon'").collect()) == ["u3", "u5", "u6", "u8"]
    assert spark.read.json(str(tmp_path / "rejects")).count() == 4


def test_parts_of_a_folder_vote_together(spark, tmp_path):
    """A part with the first days of a month decides nothing alone."""
    paths = {}
    for name in ("logon", "device", "http"):
        paths[name] = [str(tmp_path / name / str(i)) for i in STYLES.values()]
        for style, i in STYLES.items():
            (tmp_path / name).mkdir(exist_ok=True)
            for part, m in enumerate(MOMENTS):
                t = m.strftime(style)
                row = f"x,{t},,u{part},pc,url,c,1,2" if name == "http" else f"u{part},{t},on"
                _log(tmp_path / name / str(i), f"part-{part}.csv", "" if name == "http" else "user,date,activity", [row])
    got = csv_logs.read_tagged(spark, **paths, timestamp_format=date_formats.FORMATS, by_folder=True)
    assert sorted((r.source, r.user, r.date) for r in got.collect()) == sorted((s, f"u{k}", m) for s in paths for k, m in enumerate(MOMENTS) for _ in STYLES)
    with pytest.raises(Exception, match="ambiguous"):
        csv_logs.read_tagged(spark, **paths, timestamp_format=date_formats.FORMATS).collect()
    alone = csv_logs.read_logs(spark, **{n: p[:1] for n, p in paths.items()}, timestamp_format=date_formats.FORMATS[1:], by_folder=True)[0]
    assert {r.problem for r in alone.collect()} == {None, "date"}


def test_mixed_format_logs_of_events_in_order_of_time(spark, tmp_path):
    """Every part file that the query writes holds a few days only."""
    import __spark_entry__ as contract

    start = datetime(2024, 1, 1)
    kinds = ("signup", "view", "purchase")
    rows = [(24 * d + h, start + timedelta(days=d, hours=h), h % 9, kinds[(h // 9) % 3], 1.0, '{"k": 2}') for d in range(28) for h in range(24)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.repartitionByRange(7, "ts").write.parquet(str(tmp_path / "events.parquet"))
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(128 << 20))  # every file a task of its own
    try:
        got = contract.mixed_format_logs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(key, before)
    wanted = contract.csv_logs_activity(spark, str(tmp_path)).collect()
    assert sorted(got, key=str) == sorted(wanted, key=str) and len(got) == len(rows)
