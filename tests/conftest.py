from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidewatch.session import build_session

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    conf = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "4g",
        # Plans are checked in full.
        "spark.sql.maxMetadataStringLength": "2000",
    }
    session = build_session("tests", "local[8]", **conf)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def log_of(spark):
    """Build a tagged log from (user, date text, source, item, sent, received) rows."""
    from pyspark.sql import functions as F

    def build(rows):
        schema = "user STRING, date STRING, source STRING, item STRING, bytes_sent BIGINT, bytes_received BIGINT"
        return spark.createDataFrame(rows, schema).withColumn("date", F.col("date").cast("timestamp_ntz"))

    return build


@pytest.fixture(scope="session")
def activity_of(spark):
    """Build a merged activity table from (user, date text, logon, http, device) rows."""
    from pyspark.sql import functions as F

    def build(rows):
        schema = (
            "user STRING, date STRING, logon_count BIGINT, http_requests BIGINT, device_activity_count BIGINT"
        )
        return spark.createDataFrame(rows, schema).withColumns(
            {
                "date": F.col("date").cast("timestamp_ntz"),
                "http_bytes_sent": F.lit(0).cast("bigint"),
                "http_bytes_received": F.lit(0).cast("bigint"),
            }
        )

    return build
