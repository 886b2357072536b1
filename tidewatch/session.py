"""Session settings the jobs rely on."""

from __future__ import annotations

from pyspark import SparkConf
from pyspark.sql import SparkSession

# AQE decides broadcast versus shuffled joins from measured sizes, splits skewed
# join partitions and merges small ones, so no partition count is tuned by hand.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Recording the call site of every column operation doubles the time to build a plan.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # Streaming state may outgrow the heap; this provider keeps it on disk.
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


# Input bytes that one partition of a first shuffle should get.
PARTITION_BYTES = 128 << 20


def initial_partitions(input_bytes: int) -> int:
    """Partitions a shuffle of the whole input starts with; AQE merges them but never adds any."""
    return min(max(200, -(-input_bytes // PARTITION_BYTES)), 200_000)


def build_session(
    app: str = "tidewatch", master: str | None = None, input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """Create a session; on a cluster leave ``master`` to spark-submit.

    What spark-submit or the configuration files set stays; only ``conf`` overrides it.
    ``input_bytes`` sizes the shuffles of a large input.
    """
    given = SparkConf()
    settings = {key: value for key, value in DEFAULTS.items() if not given.contains(key)}
    if input_bytes is not None:
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = str(initial_partitions(input_bytes))
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def require_utc(spark: SparkSession) -> None:
    """Fail where a wall-clock value would be shifted by a non-UTC session zone."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"spark.sql.session.timeZone must be UTC for this step, not {zone}")
