"""Host monitors: metric rows as logs, clipboard and device changes, inactivity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actilens.functions.text import strip
from actilens.scale import time_chunk, with_neighbour

HOUR, DAY = 3_600, 86_400


def metric_logs(metrics: DataFrame) -> DataFrame:
    """Metric rows as log text, with memory in whole MB and in GB."""
    ram = F.col("memory_used") * 100.0 / F.col("memory_total")
    return metrics.select(
        "host", "ts",
        F.format_string("CPU: %.1f%%, RAM: %.1f%%", F.round("cpu_usage", 1), F.round(ram, 1)).alias("description"),
        F.expr("memory_total div 1048576").alias("memory_total_mb"),
        F.round(F.col("memory_used") / 1073741824.0, 2).alias("memory_used_gb"),
    )


def clipboard_changes(readings: DataFrame, keys: Sequence[str] = ("user_name",), chunk_seconds: int = HOUR) -> DataFrame:
    """Readings whose trimmed text differs from the previous one; only length and hash are kept."""
    body = strip(F.col("content"))
    hashed = readings.select(
        *keys, "ts", "seq", F.length(body).alias("length"), F.sha2(body, 256).alias("hash")
    ).filter(F.col("hash").isNotNull())
    chained = with_neighbour(hashed, keys, ["ts", "seq"], ["hash"], time_chunk("ts", chunk_seconds), False, "prev")
    changed = F.col("prev").isNull() | (F.col("prev.hash") != F.col("hash"))
    return chained.filter(changed).drop("prev").withColumn(
        "description", F.format_string("Clipboard updated (%d chars)", "length")
    )


def device_changes(
    snapshots: DataFrame, kind: str = "USB", keys: Sequence[str] = ("host",), chunk_seconds: int = DAY
) -> DataFrame:
    """Added and removed devices against the previous snapshot; the first one compares with none."""
    chained = with_neighbour(
        snapshots, keys, ["ts", "snapshot_id"], ["devices"], time_chunk("ts", chunk_seconds), False, "prev"
    )
    before = F.coalesce("prev.devices", F.array().cast("array<string>"))
    changed = chained.withColumns(
        {
            "added": F.array_sort(F.array_except("devices", before)),
            "removed": F.array_sort(F.array_except(before, "devices")),
        }
    ).filter((F.size("added") > 0) | (F.size("removed") > 0))
    return changed.withColumn("n_devices", F.size(F.array_distinct("devices"))).withColumn(
        "description",
        F.when(F.size("added") > 0, F.lit(f"{kind} device attached"))
        .when(F.size("removed") > 0, F.lit(f"{kind} device removed"))
        .otherwise(F.lit(f"{kind} device change detected")),
    ).drop("prev")


def inactivity(
    inputs: DataFrame,
    keys: Sequence[str] = ("user_name",),
    limit_minutes: int = 120,
    enabled: bool = True,
    chunk: Column | None = None,
) -> DataFrame:
    """Per input, the gap to the user's next one and the warning and limit events inside it."""
    limit = limit_minutes * 60
    warning = max(limit - 300, 0)
    following = with_neighbour(
        inputs, keys, ["ts", "id"], ["ts"], chunk if chunk is not None else time_chunk("ts", HOUR), True, "nxt"
    )
    gap = (F.unix_micros("nxt.ts") - F.unix_micros("ts")) / 1_000_000
    out = following.withColumn("gap_seconds", gap).drop("nxt")
    armed = F.lit(enabled)
    return out.withColumns(
        {
            "warned": armed & F.coalesce(F.col("gap_seconds") > warning, F.lit(False)),
            "limit_reached": armed & F.coalesce(F.col("gap_seconds") > limit, F.lit(False)),
        }
    )
