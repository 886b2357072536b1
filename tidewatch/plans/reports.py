"""Report queries over a risk table whose ``date`` is a DATE.

Each takes the table and a :class:`Filters` and returns an aggregated or limited
DataFrame; an empty selection gives an empty (or zero) result, never an error.
Every order has a tie-break.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.display import two_decimals
from ..functions.calendar import weekday_name
from ..functions.levels import level_rank
from ..operators.filters import Filters
from ..schema import EXPORT, MEASURES, RISK_LEVELS

HISTOGRAM_BINS = 50
DETAIL_ROWS = 1_000
DETAIL_COLUMNS = (
    "date", "user", "risk_level", "risk_score", "logon_count", "http_requests", "device_activity_count",
    "logon_spike", "http_spike", "device_spike", "hour", "weekday",
)

ALL = Filters()


def date_bounds(risk: DataFrame) -> DataFrame:
    return risk.agg(F.min("date").alias("min_date"), F.max("date").alias("max_date"))


def user_picker(risk: DataFrame, filters: Filters = ALL) -> DataFrame:
    """Distinct users of the date range; the other filters do not apply."""
    return filters.dates_only().apply(risk).select("user").distinct().orderBy("user")


def filtered_export(risk: DataFrame, filters: Filters = ALL) -> DataFrame:
    """All filtered rows in the export layout."""
    return filters.apply(risk).select(*EXPORT)


def _high(risk: DataFrame, filters: Filters) -> DataFrame:
    return filters.apply(risk).where(F.col("risk_level") == "High")


def kpis(risk: DataFrame, filters: Filters = ALL, approximate_users: bool = False) -> DataFrame:
    """One row of key figures; the month range shows the filter, or the data where it is open.

    Users are counted exactly unless ``approximate_users`` trades that for one pass.
    """
    distinct = F.approx_count_distinct if approximate_users else F.count_distinct
    start = F.lit(filters.start) if filters.start else F.min("date")
    end = F.lit(filters.end) if filters.end else F.max("date")
    figures = filters.apply(risk).agg(
        F.count(F.lit(1)).alias("filtered_rows"),
        distinct("user").alias("total_unique_users"),
        F.count_if(F.col("risk_level") == "High").alias("total_high_risk_events"),
        F.avg("risk_score").alias("avg_risk_score"),
        start.alias("start"),
        end.alias("end"),
    )
    return figures.select(
        "filtered_rows",
        "total_unique_users",
        "total_high_risk_events",
        "avg_risk_score",
        F.date_format("start", "yyyy-MM").alias("range_start"),
        F.date_format("end", "yyyy-MM").alias("range_end"),
    )


def kpi_texts(figures: DataFrame) -> DataFrame:
    """The key figures as display text: thousands separators, two decimals."""
    counts = ("filtered_rows", "total_unique_users", "total_high_risk_events")
    return figures.select(
        *(F.format_number(c, 0).alias(c) for c in counts),
        two_decimals(F.col("avg_risk_score")).alias("avg_risk_score"),
        F.concat_ws(" to ", "range_start", "range_end").alias("data_range"),
    )


def kpis_extended(risk: DataFrame, filters: Filters = ALL) -> DataFrame:
    """Anomalous rows, users with a High row, and the number of activities behind the rows."""
    activities = sum((F.col(c) for c in MEASURES[1:]), F.col(MEASURES[0]))
    return filters.apply(risk).agg(
        F.count_if(F.col("anomaly") == -1).alias("total_anomalies"),
        F.count_distinct(F.when(F.col("risk_level") == "High", F.col("user"))).alias("high_risk_users"),
        F.coalesce(F.sum(activities), F.lit(0).cast("bigint")).alias("activity_count"),
    )


def risk_level_distribution(risk: DataFrame, filters: Filters = ALL) -> DataFrame:
    """Rows of each known level in level order, 0 for a level that does not occur."""
    counts = [
        F.struct(F.lit(level).alias("risk_level"), F.count_if(F.col("risk_level") == level).alias("count"))
        for level in RISK_LEVELS
    ]
    return filters.apply(risk).agg(F.array(*counts).alias("levels")).select(F.inline("levels"))


def risk_level_counts(risk: DataFrame, filters: Filters = ALL) -> DataFrame:
    """Rows per level as it occurs, unknown levels included, largest first."""
    counted = filters.apply(risk).groupBy("risk_level").agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), level_rank(F.col("risk_level")), "risk_level")


def anomaly_counts(risk: DataFrame, filters: Filters = ALL) -> DataFrame:
    counted = filters.apply(risk).groupBy("anomaly").agg(F.count(F.lit(1)).alias("count"))
    return counted.orderBy(F.desc("count"), "anomaly")


def _high_per(risk: DataFrame, filters: Filters, key: str) -> DataFrame:
    return _high(risk, filters).groupBy(key).agg(F.count(F.lit(1)).alias("count")).orderBy(key)


def high_risk_daily(risk: DataFrame, filters: Filters = ALL) -> DataFrame:
    return _high_per(risk, filters, "date")


def high_risk_by_hour(risk: DataFrame, filters: Filters = ALL) -> DataFrame:
    return _high_per(risk, filters, "hour")


def high_risk_by_weekday(risk: DataFrame, filters: Filters = ALL) -> DataFrame:
    return _high_per(risk, filters, "weekday").withColumn("weekday_name", weekday_name(F.col("weekday")))


def high_risk_heatmap(risk: DataFrame, filters: Filters = ALL) -> DataFrame:
    """High rows per weekday (rows) and hour (columns h00 to h23)."""
    hours = list(range(24))
    pivoted = _high(risk, filters).groupBy("weekday").pivot("hour", hours).agg(F.count(F.lit(1)))
    return pivoted.fillna(0).toDF("weekday", *(f"h{h:02d}" for h in hours)).orderBy("weekday")


def top_users_high_risk(risk: DataFrame, filters: Filters = ALL, limit: int = 10) -> DataFrame:
    counted = _high(risk, filters).groupBy("user").agg(F.count(F.lit(1)).alias("high_risk_events"))
    return counted.orderBy(F.desc("high_risk_events"), "user").limit(limit)


def top_high_risk(risk: DataFrame, filters: Filters = ALL, limit: int = 5) -> DataFrame:
    """The High rows with the largest scores."""
    time = "event_time" if "event_time" in risk.columns else "date"
    ordered = _high(risk, filters).orderBy(F.desc("risk_score"), "user", time).limit(limit)
    return ordered.select("user", F.col(time).alias("date"), "risk_score", "risk_level")


def flagged_events(risk: DataFrame, filters: Filters = ALL, limit: int = DETAIL_ROWS) -> DataFrame:
    """The High and Medium rows with the largest scores, in the detail layout."""
    flagged = filters.apply(risk).where(F.col("risk_level").isin("High", "Medium"))
    time = "event_time" if "event_time" in risk.columns else "hour"
    return flagged.orderBy(F.desc("risk_score"), "user", "date", time).limit(limit).select(*DETAIL_COLUMNS)


def daily_activity_trend(risk: DataFrame, filters: Filters = ALL) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in MEASURES]
    return filters.apply(risk).groupBy("date").agg(*sums).orderBy("date")


def risk_score_histogram(risk: DataFrame, filters: Filters = ALL, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins between the smallest and largest score; empty bins are left out.

    The bounds are scalar subqueries, so the binning stays one lazy plan and only
    ``bins`` counts leave the aggregation.
    """
    scores = filters.apply(risk).select("risk_score").where(F.col("risk_score").isNotNull())
    low = scores.agg(F.min("risk_score").alias("low")).scalar()
    high = scores.agg(F.max("risk_score").alias("high")).scalar()
    # The largest score falls past the last bin; equal scores have no width, which gives NULL.
    found = F.coalesce(F.width_bucket("risk_score", low, high, F.lit(bins)), F.lit(1))
    bucket = F.least(found, F.lit(bins))
    return scores.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("count")).orderBy("bucket")
