"""Column names and constants shared by every stage."""

from __future__ import annotations

# Source names, measures and the export layout of the risk table.
SOURCES = ("logon", "http", "device")
MEASURES = ("logon_count", "http_requests", "device_activity_count")
SPIKES = ("logon_spike", "http_spike", "device_spike")
KEYS = ("user", "date")
FEATURES = (
    "logon_count",
    "http_requests",
    "http_bytes_sent",
    "http_bytes_received",
    "device_activity_count",
    "logon_spike",
    "http_spike",
    "device_spike",
    "device_http_ratio",
    "logon_http_ratio",
    "hour",
    "weekday",
    "is_working_day",
    "is_off_hours",
    "logon_rolling_3",
    "logon_delta",
)
EXPORT = (*KEYS, *FEATURES, "risk_score", "risk_level")
RISK_LEVELS = ("Low", "Medium", "High")
MEDIUM_QUANTILE = 0.75
HIGH_QUANTILE = 0.95
CONTAMINATION = 0.02
GRID_CONTAMINATION = (0.01, 0.015, 0.02, 0.025, 0.03)
GRID_MAX_FEATURES = (0.5, 0.75, 1.0)
TREES = 200
SAMPLE_SIZE = 256
SEED = 42
