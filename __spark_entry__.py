"""

Every query reads the whole ``events`` table. ``hour`` grain unless the query is
about days (rolling and trend queries). Doubles are rounded to six places on both
sides, as the order of a distributed sum may differ in the last bit.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable
from datetime import date

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.calendar import calendar_columns
from tidewatch.operators import activity as act
from tidewatch.operators import features as feat
from tidewatch.operators.clustering import ClusterDistance
from tidewatch.operators.filters import Filters
from tidewatch.operators.forest import IsolationForest
from tidewatch.operators.scaling import FeatureScaler
from tidewatch.operators.quantile_store import QuantileStore
from tidewatch.plans import reports, scoring, tuning
from tidewatch.schema import CONTAMINATION, EXPORT, FEATURES, HIGH_QUANTILE, KEYS, MEASURES, MEDIUM_QUANTILE
from tidewatch.functions.timestamps import truncate
from tidewatch.sources import csv_logs, user_bitmaps, user_files
from tidewatch.sources import ordered_export as ordered
from tidewatch.sources.activity_log import split_log
from tidewatch.sources.activity_store import ADDITIVE, ActivityStore
from tidewatch.sources.date_formats import FORMATS
from tidewatch.sources.events import read_events, tag_events
from tidewatch.sources.risk_table import as_report_table, open_risk_table, read_risk_csv, write_csv, write_risk_table
from tidewatch.staging import stage, stage_path
from tidewatch.streaming import activity_stream as streaming
from tidewatch.streaming import user_state
from tidewatch.streaming.late import LateAwareActivity

try:  # the text operators are optional: the rest works without their folder
    from tidewatch.llm import queries as text
except ImportError:
    text = None

Query = Callable[[SparkSession, str], DataFrame]

START, END = date(2024, 1, 8), date(2024, 1, 21)
RANGE = Filters(start=START, end=END)
# A z of 2 instead of the usual 3: hourly counts are small in the event table.
SPIKING = Filters(spikes=("device_spike",), spike_limit=2.0)


def _rounded(df: DataFrame) -> DataFrame:
    """Six places; adding 0.0 turns a negative zero positive."""
    doubles = {name: F.round(name, 6) + F.lit(0.0) for name, kind in df.dtypes if kind == "double"}
    return df.withColumns(doubles) if doubles else df


def _log(spark: SparkSession, sf: str, grain: str = "hour") -> DataFrame:
    return tag_events(read_events(spark, sf), grain)


def _activity(spark: SparkSession, sf: str, grain: str = "hour") -> DataFrame:
    return act.merged_activity(_log(spark, sf, grain))


def _features(spark: SparkSession, sf: str, grain: str = "hour") -> DataFrame:
    return scoring.features_of(_log(spark, sf, grain), grain)


def _scored(spark: SparkSession, sf: str, keep: tuple[str, ...], grain: str = "hour") -> DataFrame:
    """z-scored rows with the keys and the columns a query needs, and no others."""
    return scoring.score_features(_features(spark, sf, grain), keep=(*KEYS, *keep)).frame


def _risk(spark: SparkSession, sf: str, keep: tuple[str, ...] = (), grain: str = "hour") -> DataFrame:
    return as_report_table(_scored(spark, sf, keep, grain))


def _model_features(spark: SparkSession, sf: str) -> DataFrame:
    return scoring.staged_features(_log(spark, sf), "hour")


# --- activity and features ---


def logon_daily(spark: SparkSession, sf: str) -> DataFrame:
    return act.logon_daily(split_log(_log(spark, sf, "day"))[0])


def http_daily(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(act.http_daily(split_log(_log(spark, sf, "day"))[1]))


def device_daily(spark: SparkSession, sf: str) -> DataFrame:
    return act.device_daily(split_log(_log(spark, sf, "day"))[2])


def merged_activity(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_activity(spark, sf))


def merged_activity_join(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(act.merged_activity_join(_log(spark, sf)))


def calendar_features(spark: SparkSession, sf: str) -> DataFrame:
    names = ("year", "month", "day", "weekday", "hour", "minute", "is_working_day", "week_of_month", "is_off_hours")
    return _activity(spark, sf).withColumns(calendar_columns(F.col("date"))).select(*KEYS, *names)


def user_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(feat.user_baseline(_activity(spark, sf)))


def user_spikes(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_features(spark, sf).select(*KEYS, "logon_spike", "http_spike", "device_spike"))


def raw_grain_history(spark: SparkSession, sf: str) -> DataFrame:
    """Spikes and rolling mean per unrounded timestamp, by chunks of a user's history."""
    columns = ("logon_spike", "http_spike", "device_spike", "logon_rolling_3", "logon_delta")
    return _rounded(_features(spark, sf, "raw").select(*KEYS, *columns))


def activity_ratios(spark: SparkSession, sf: str) -> DataFrame:
    ratios = feat.ratio_columns()
    return _rounded(_activity(spark, sf).withColumns(ratios).select(*KEYS, *ratios))


def missing_flags(spark: SparkSession, sf: str) -> DataFrame:
    flags = feat.missing_flag_columns()
    return _activity(spark, sf).withColumns(flags).select(*KEYS, *flags)


def logon_rolling(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_features(spark, sf, "day").select(*KEYS, "logon_count", "logon_rolling_3", "logon_delta"))


def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_features(spark, sf).select(*FEATURES))


def scaled_features(spark: SparkSession, sf: str) -> DataFrame:
    features = _model_features(spark, sf)
    return _rounded(FeatureScaler.fit(features).transform(features))


# --- scores and levels ---


def zscore_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_scored(spark, sf, ()).select(*KEYS, "risk_score", "risk_level"))


def risk_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    cuts = scoring.score_features(_features(spark, sf), keep=KEYS).thresholds
    return _rounded(spark.createDataFrame([(cuts.medium, cuts.high)], "medium_from DOUBLE, high_from DOUBLE"))


def risk_export(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(scoring.build_risk_table(_log(spark, sf), "hour").select(*EXPORT))


def risk_level_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.risk_level_counts(_risk(spark, sf))


def zscore_anomaly_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.anomaly_counts(_risk(spark, sf))


def top5_high_risk(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.top_high_risk(_risk(spark, sf)))


def iforest_scores(spark: SparkSession, sf: str) -> DataFrame:
    frame = scoring.score_features(_model_features(spark, sf), IsolationForest(), keep=KEYS).frame
    return _rounded(frame.select(*KEYS, "anomaly", "anomaly_score", "risk_score", "risk_level"))


def anomaly_counts(spark: SparkSession, sf: str) -> DataFrame:
    scored = scoring.score_features(_model_features(spark, sf), IsolationForest(), keep=KEYS)
    return reports.anomaly_counts(scored.frame)


def zscore_anomaly_score(spark: SparkSession, sf: str) -> DataFrame:
    """The negated score, low for the unusual."""
    return _rounded(_scored(spark, sf, ()).select(*KEYS, "anomaly_score"))


def kmeans_scores(spark: SparkSession, sf: str) -> DataFrame:
    frame = scoring.score_features(_model_features(spark, sf), ClusterDistance(), keep=KEYS).frame
    return _rounded(frame.select(*KEYS, "anomaly", "risk_score", "risk_level"))


def grid_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(tuning.run_grid(_model_features(spark, sf)).summary)


def grid_pivot_std(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(tuning.grid_pivot(tuning.run_grid(_model_features(spark, sf)).summary, "score_std"))


def grid_pivot_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return tuning.grid_pivot(tuning.run_grid(_model_features(spark, sf)).summary, "anomaly_count")


def best_config(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(tuning.best_config(tuning.run_grid(_model_features(spark, sf)).summary))


def tuned_risk_export(spark: SparkSession, sf: str) -> DataFrame:
    """The export scored by the forest of the best grid point."""
    return _rounded(tuning.tuned_scores(tuning.run_grid(_model_features(spark, sf))).frame.select(*EXPORT))


# --- filters ---


def as_date(spark: SparkSession, sf: str) -> DataFrame:
    return _risk(spark, sf).select("user", "date", "risk_level")


def filter_date_range(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(RANGE.apply(_risk(spark, sf)).select("user", "date", "risk_score", "risk_level"))


def filter_users(spark: SparkSession, sf: str) -> DataFrame:
    """Drill-down: all rows of the ten users with the most High rows."""
    risk = _risk(spark, sf)
    chosen = Filters(users=reports.top_users_high_risk(risk))
    return _rounded(chosen.apply(risk).select("user", "date", "risk_score", "risk_level"))


def filter_risk_levels(spark: SparkSession, sf: str) -> DataFrame:
    kept = Filters(levels=("High", "Medium")).apply(_risk(spark, sf))
    return _rounded(kept.select("user", "date", "risk_score", "risk_level"))


def filter_spikes(spark: SparkSession, sf: str) -> DataFrame:
    risk = _risk(spark, sf, ("device_spike",))
    return _rounded(SPIKING.apply(risk).select("user", "date", "device_spike", "risk_level"))


def filter_spikes_all(spark: SparkSession, sf: str) -> DataFrame:
    """Logon and web spikes together, over a limit."""
    risk = _risk(spark, sf, ("logon_spike", "http_spike"))
    kept = Filters(spikes=("logon_spike", "http_spike"), spike_limit=0.5).apply(risk)
    return _rounded(kept.select("user", "date", "logon_spike", "http_spike", "risk_level"))


def filter_spikes_exact(spark: SparkSession, sf: str) -> DataFrame:
    """A z of exactly 1, which few rows have."""
    risk = _risk(spark, sf, ("logon_spike",))
    return Filters(spikes=("logon_spike",), spike_mode="exact").apply(risk).select("user", "date", "risk_level")


def filter_user_list(spark: SparkSession, sf: str) -> DataFrame:
    """Users as a list of texts, matched by the table's type; unknown ones match nothing."""
    kept = Filters(users=[*map(str, range(1, 40)), "nobody"]).apply(_risk(spark, sf))
    return _rounded(kept.select("user", "date", "risk_score", "risk_level"))


def filter_open_range(spark: SparkSession, sf: str) -> DataFrame:
    kept = Filters(end=END).apply(_risk(spark, sf))
    return _rounded(kept.select("user", "date", "risk_score", "risk_level"))


def filter_activity_type(spark: SparkSession, sf: str) -> DataFrame:
    risk = _risk(spark, sf, MEASURES)
    kept = Filters(activity=("logon", "device")).apply(risk)
    return kept.select("user", "date", *MEASURES, "risk_level")


def filter_combined(spark: SparkSession, sf: str) -> DataFrame:
    risk = _risk(spark, sf, (*MEASURES, "device_spike"))
    filters = Filters(
        start=START,
        end=END,
        users=reports.top_users_high_risk(risk),
        levels=("High", "Medium"),
        spikes=("device_spike",),
        spike_limit=1.0,
        activity=("device",),
    )
    return _rounded(filters.apply(risk).select("user", "date", *MEASURES, "device_spike", "risk_score", "risk_level"))


def filtered_export(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.filtered_export(_risk(spark, sf, FEATURES), RANGE))


# --- reports ---


def date_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return reports.date_bounds(as_report_table(_activity(spark, sf)))


def user_picker(spark: SparkSession, sf: str) -> DataFrame:
    return reports.user_picker(as_report_table(_activity(spark, sf)), RANGE)


def kpis(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.kpis(_risk(spark, sf), RANGE))


def kpi_texts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.kpi_texts(reports.kpis(_risk(spark, sf), RANGE))


def kpi_texts_empty(spark: SparkSession, sf: str) -> DataFrame:
    """The display of a selection without rows."""
    nothing = Filters(start=date(2199, 1, 1), end=date(2199, 1, 31))
    return reports.kpi_texts(reports.kpis(_risk(spark, sf), nothing))


def kpis_extended(spark: SparkSession, sf: str) -> DataFrame:
    return reports.kpis_extended(_risk(spark, sf, MEASURES), RANGE)


def risk_level_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return reports.risk_level_distribution(_risk(spark, sf), RANGE)


def high_risk_daily(spark: SparkSession, sf: str) -> DataFrame:
    return reports.high_risk_daily(_risk(spark, sf))


def top_users_high_risk(spark: SparkSession, sf: str) -> DataFrame:
    return reports.top_users_high_risk(_risk(spark, sf))


def risk_score_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return reports.risk_score_histogram(_risk(spark, sf))


def flagged_events(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(reports.flagged_events(_risk(spark, sf, FEATURES)))


def daily_activity_trend(spark: SparkSession, sf: str) -> DataFrame:
    return reports.daily_activity_trend(_risk(spark, sf, MEASURES, "day"))


def high_risk_by_hour(spark: SparkSession, sf: str) -> DataFrame:
    return reports.high_risk_by_hour(_risk(spark, sf, ("hour",)))


def high_risk_by_weekday(spark: SparkSession, sf: str) -> DataFrame:
    return reports.high_risk_by_weekday(_risk(spark, sf, ("weekday",)))


def high_risk_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return reports.high_risk_heatmap(_risk(spark, sf, ("hour", "weekday")))


# --- files in and out ---

BAD_USERS = 50  # of so many users one has unreadable dates, another unreadable byte counts


def _csv_logs(
    spark: SparkSession, sf: str, spoiled: bool = False, formats: tuple[str, ...] = (csv_logs.DEFAULT_FORMAT,)
) -> dict[str, list[str]]:
    """The events as the three CSV logs, in the shared folder: an equal share of the users in each date format,
    and a folder of part files for each in every log."""
    tops = {name: stage_path(spark, f"csv-{name}") for name in ("logon", "device", "http")}
    paths = {name: [f"{top}/{i}" for i in range(len(formats))] for name, top in tops.items()}
    user, kind = F.col("user_id"), F.col("event_type")
    for i, fmt in enumerate(formats):
        events = read_events(spark, sf).where("ts is not null and user_id is not null").where(user % len(formats) == i)
        moment = F.date_format("ts", fmt)
        bad = lambda at: F.lit(spoiled) & (user % BAD_USERS == at)
        moment = F.when(bad(7), F.lit("some day")).otherwise(moment)
        received = F.get_json_object("props", "$.k")
        received = F.when(bad(8), F.lit("many")).otherwise(received)
        rows = events.select(user.cast("string").alias("user"), moment.alias("date"), kind.alias("activity"), "value", received.alias("k"))
        for name, kinds in (("logon", ("signup", "error")), ("device", ("purchase",))):
            write_csv(rows.where(F.col("activity").isin(*kinds)).select("activity", "user", "date"), paths[name][i])
        web = rows.where(F.col("activity").isin("view", "click"))
        none = F.lit(None).cast("string")
        web = web.select(none.alias("id"), "date", none.alias("time"), "user", none.alias("pc"), F.col("activity").alias("url"),
                         none.alias("content"), F.col("value").cast("string"), "k")
        web.write.option("header", False).option("escape", '"').csv(paths["http"][i])
    return paths


def csv_logs_activity(spark: SparkSession, sf: str) -> DataFrame:
    """The events written as CSV logs, read back and merged by hour."""
    log = csv_logs.read_tagged(spark, **_csv_logs(spark, sf))
    merged = act.merged_activity(log.withColumn("date", truncate(F.col("date"), "hour")))
    whole = F.col("http_bytes_received").cast("bigint")
    return _rounded(merged.withColumns({"user": F.col("user").cast("bigint"), "http_bytes_received": whole}))


def mixed_format_logs(spark: SparkSession, sf: str) -> DataFrame:
    """The CSV logs with files in three date formats in each, merged by hour. The part files of a write vote together."""
    paths = _csv_logs(spark, sf, formats=FORMATS)
    log = csv_logs.read_tagged(spark, **paths, timestamp_format=FORMATS, by_folder=True)
    merged = act.merged_activity(log.withColumn("date", truncate(F.col("date"), "hour")))
    whole = F.col("http_bytes_received").cast("bigint")
    return _rounded(merged.withColumns({"user": F.col("user").cast("bigint"), "http_bytes_received": whole}))


def rejected_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of spoiled logs that cannot be read, counted by log and reason."""
    frames = csv_logs.read_logs(spark, **_csv_logs(spark, sf, spoiled=True))
    return csv_logs.rejected_rows(frames).groupBy("log", "problem").agg(F.count(F.lit(1)).alias("rows"))


def csv_export_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The 20-column export as CSV, opened again."""
    path = stage_path(spark, "csv-export")
    write_csv(scoring.build_risk_table(_log(spark, sf), "hour").select(*EXPORT), path)
    back = read_risk_csv(spark, path).withColumns({"date": F.col("event_time"), "user": F.col("user").cast("bigint")})
    return _rounded(back.withColumn("http_bytes_received", F.col("http_bytes_received").cast("bigint")).select(*EXPORT))


def stored_table_report(spark: SparkSession, sf: str) -> DataFrame:
    """The table written, opened, cut to a date range, and asked by SQL."""
    path = stage_path(spark, "stored")
    write_risk_table(scoring.build_risk_table(_log(spark, sf), "hour"), path)
    kept = RANGE.apply(open_risk_table(spark, path))
    asked = "SELECT user, date, risk_score, risk_level FROM {stored} WHERE risk_level <> :level"
    return _rounded(spark.sql(asked, args={"level": "Low"}, stored=kept))


def ordered_export(spark: SparkSession, sf: str) -> DataFrame:
    """The export written in order over eight parts, and read back with each row's place in it."""
    rows = _scored(spark, sf, ()).select(*KEYS, "risk_score", "risk_level")
    path = stage_path(spark, "ordered")
    ordered.write_ordered(rows, path, parts=8)
    return _rounded(ordered.read_ordered(spark, path, rows.schema))


def user_drilldown(spark: SparkSession, sf: str) -> DataFrame:
    """All rows of the ten users with the most High rows, from the files that can hold them."""
    risk = stage(_scored(spark, sf, ()).select(*KEYS, "risk_score", "risk_level"), "drilldown")
    path = stage_path(spark, "by-user")
    user_files.write_by_user(risk, path, files=16)
    chosen = reports.top_users_high_risk(as_report_table(risk))
    kept = Filters(users=chosen).apply(user_files.open_for_users(spark, path, chosen))
    return _rounded(kept.select("user", "date", "risk_score", "risk_level"))


def distinct_users_by_range(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct users, and those with a High row, of three date ranges, from daily bitmaps."""
    risk = stage(_scored(spark, sf, ()).select(*KEYS, "risk_level"), "bitmap-rows")
    numbers = stage(user_bitmaps.number_users(risk), "user-numbers")
    days = stage(user_bitmaps.daily_bitmaps(risk, numbers), "user-days")
    ranges = (("all", None, None), ("fortnight", START, END), ("day", START, START))
    return user_bitmaps.distinct_users(days, ranges)


# --- growing by loads ---

# The event table is a month; three loads of it by day.
LOADS = (("first", "2000-01-01", "2024-01-11"), ("second", "2024-01-11", "2024-01-21"), ("third", "2024-01-21", "2100-01-01"))


def _loads(spark: SparkSession, sf: str, grain: str) -> dict[str, DataFrame]:
    log = _log(spark, sf, grain)
    span = lambda a, b: (F.col("date") >= F.lit(a).cast("timestamp_ntz")) & (F.col("date") < F.lit(b).cast("timestamp_ntz"))
    return {name: log.where(span(a, b)) for name, a, b in LOADS}


def incremental_activity(spark: SparkSession, sf: str) -> DataFrame:
    """The merged activity out of order in three loads, one of them twice."""
    loads = _loads(spark, sf, "raw")
    store = ActivityStore(spark, stage_path(spark, "store"))
    for name in ("second", "first", "third", "second"):
        store.add(name, loads[name])
    return _rounded(store.merged().select(*KEYS, *ADDITIVE))


def refreshed_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """Score cuts after three loads of scores, one of them repeated."""
    scores = stage(_scored(spark, sf, ()).select(*KEYS, "risk_score"), "load-scores")
    store = QuantileStore(spark, stage_path(spark, "quantiles"))
    for name, a, b in (*LOADS, LOADS[0]):
        rows = scores.where((F.col("date") >= F.lit(a).cast("timestamp_ntz")) & (F.col("date") < F.lit(b).cast("timestamp_ntz")))
        store.add(name, rows.select(F.col("risk_score").alias("value")))
    cuts = store.quantiles([MEDIUM_QUANTILE, HIGH_QUANTILE, 1 - CONTAMINATION])
    return _rounded(spark.createDataFrame([(*cuts.values, cuts.rows)], "medium_from DOUBLE, high_from DOUBLE, anomaly_from DOUBLE, rows BIGINT"))


# --- streaming ---


def stream_daily_activity(spark: SparkSession, sf: str) -> DataFrame:
    """User-days of the event stream: those whose window the watermark closed, and the open ones."""
    stream = streaming.windowed_activity(streaming.event_stream(spark, sf, "events.parquet"))
    closed = streaming.drain(stream, "daily")
    return _rounded(closed.unionByName(streaming.open_windows(closed, read_events(spark, sf))))


def stream_scored_activity(spark: SparkSession, sf: str) -> DataFrame:
    """The same user-days scored and levelled with the batch job's baseline and cuts."""
    activity = stage(_activity(spark, sf, "day"), "activity")
    cuts = scoring.score_features(feat.behaviour_features(activity), keep=KEYS).thresholds
    stream = streaming.windowed_activity(streaming.event_stream(spark, sf, "events.parquet"))
    baseline = stage(feat.user_baseline(activity), "baseline")
    scored = streaming.drain(streaming.scored_activity(stream, baseline, cuts), "scored")
    open_ = streaming.open_windows(scored, read_events(spark, sf))
    scored = scored.unionByName(streaming.scored_activity(open_, baseline, cuts))
    return _rounded(scored.select(*KEYS, *MEASURES, "risk_score", "risk_level"))


def stream_user_history(spark: SparkSession, sf: str) -> DataFrame:
    """Spikes against each user's own past, from the state of the stream, for every closed day."""
    rows = streaming.drain(user_state.user_history(streaming.event_stream(spark, sf, "events.parquet")), "history")
    return _rounded(rows)


def stream_late_rows(spark: SparkSession, sf: str) -> DataFrame:
    """User-days of a stream whose files come out of order: closed windows corrected by late rows."""
    folder = stage_path(spark, "late-events")
    # The last ten days, the first, then those between: two thirds of the rows are late or out of order.
    for i in (2, 0, 1):
        _, a, b = LOADS[i]
        span = (F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz"))
        read_events(spark, sf).where(span).write.mode("append").parquet(folder)
    activity = LateAwareActivity(spark, stage_path(spark, "late"))
    activity.run(streaming.event_stream(spark, folder, "*.parquet", files_per_batch=1))
    return _rounded(activity.corrected())


REGISTERED: tuple[Query, ...] = (
    logon_daily, http_daily, device_daily, merged_activity, merged_activity_join, calendar_features,
    user_baseline, user_spikes, raw_grain_history, activity_ratios, missing_flags, logon_rolling,
    feature_matrix, scaled_features, zscore_scores, risk_thresholds, risk_export, risk_level_counts,
    zscore_anomaly_counts, top5_high_risk, iforest_scores, anomaly_counts, kmeans_scores, grid_summary,
    grid_pivot_std, grid_pivot_anomalies, best_config, tuned_risk_export, as_date, filter_date_range,
    filter_users, filter_risk_levels, filter_spikes, filter_activity_type, filter_combined,
    filtered_export, date_bounds, user_picker, kpis, kpi_texts, kpis_extended, risk_level_distribution,
    high_risk_daily, top_users_high_risk, risk_score_histogram, flagged_events, daily_activity_trend,
    high_risk_by_hour, high_risk_by_weekday, high_risk_heatmap, stream_daily_activity,
    stream_scored_activity, zscore_anomaly_score, filter_spikes_all, filter_spikes_exact, filter_user_list,
    filter_open_range, kpi_texts_empty, csv_logs_activity, rejected_rows, csv_export_round_trip, stored_table_report,
    mixed_format_logs, ordered_export, user_drilldown, distinct_users_by_range, incremental_activity, refreshed_thresholds,
    stream_user_history, stream_late_rows,
)


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: events to activity, spikes, scores, levels and the top users by High rows."""
    return top_users_high_risk(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    own = {query.__name__: query for query in REGISTERED}
    return own | (text.queries() if text else {})


def oracle_sql() -> dict[str, str]:
    from oracles import oracle_queries

    return oracle_queries() | (text.oracle_sql() if text else {})
