"""Explicit schemas (DDL text) of the stored tables and wire records."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = (
    "id string, ts timestamp, user_name string, activity_type string, risk_level string, description string, "
    "details string, ip_address string, location string, current_activity string, activity_summary string"
)
TRAFFIC = (
    "id string, ts timestamp, source_ip string, destination_ip string, port long, protocol string, "
    "bytes_transferred long, packet_count long, latency long, is_anomalous boolean"
)
METRIC = (
    "host string, ts timestamp, cpu_usage double, memory_total long, memory_used long, memory_percent double, "
    "disk_total long, disk_used long, disk_percent double"
)
USER = (
    "id string, user_name string, role string, clearance_level string, status string, permissions array<string>"
)
PLAYBOOK = (
    "id string, name string, is_active boolean, trigger_field string, trigger_operator string, trigger_value string, "
    "action_type string, action_target string, min_confidence double, requires_approval boolean, "
    "rate_limit_count int, rate_limit_window_seconds int, scope string"
)
AUDIT = (
    "audit_id string, ts timestamp, playbook_id string, playbook_name string, source_log_id string, user_name string, "
    "action_type string, target string, status string, reason string, risk_level string, confidence double"
)
PLAYBOOK_DEFAULTS = {
    "min_confidence": 0.0, "requires_approval": False, "rate_limit_count": 5, "rate_limit_window_seconds": 300, "scope": "global",
}
SETTINGS_DEFAULTS = {"monitor_clipboard": False, "monitor_usb": False, "monitor_camera": False}
RENAMED = {"user": "user_name", "timestamp": "ts"}


def snake(name: str) -> str:
    return re.sub(r"(?<=[a-z0-9])([A-Z])", r"_\1", name).lower()


def normalised(df: DataFrame, renamed: Mapping[str, str] = RENAMED) -> DataFrame:
    """camelCase to snake_case; where both spellings exist the camelCase value wins.

    Text in the time column is parsed; unreadable text becomes null.
    """
    camel = {snake(c): c for c in df.columns if snake(c) != c}
    plain = [c for c in df.columns if snake(c) == c and c not in camel]
    out = df.select(
        *[F.col(c).alias(renamed.get(c, c)) for c in plain],
        *[F.col(c).alias(renamed.get(s, s)) for s, c in camel.items()],
    )
    if "ts" in out.columns and isinstance(out.schema["ts"].dataType, T.StringType):
        out = out.withColumn("ts", F.try_to_timestamp("ts"))
    return out
