"""Exports, metric retention and the streaming sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actilens.functions.timefns import retry_delay
from actilens.operators.scans import csv_rows, json_rows, report_rows, retained, time_range


def export_logs(
    logs: DataFrame, path: str, fmt: str = "csv", compress: bool = False, start: str | None = None, end: str | None = None
) -> None:
    """Write logs as CSV (8 columns), JSON lines (9 fields) or report rows; other formats raise."""
    rows = time_range(logs, start, end)
    if fmt == "csv":
        writer = csv_rows(rows).write.option("header", True).option("escape", '"')
    elif fmt == "json":
        writer = json_rows(rows).write.option("ignoreNullFields", "false")
    elif fmt == "pdf":
        writer = report_rows(rows).write.option("header", True).option("escape", '"')
    else:
        raise ValueError("Invalid format")
    if compress:
        writer = writer.option("compression", "gzip")
    writer.mode("overwrite").format("json" if fmt == "json" else "csv").save(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append metric rows, partitioned by day so that old days can be skipped and dropped."""
    metrics.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def compact_metrics(spark: SparkSession, path: str, target: str, as_of: str, hours: int = 24) -> DataFrame:
    """Write the rows inside the retention time to ``target``; only their days are read."""
    bound = F.lit(as_of).cast("timestamp") - F.expr(f"interval {hours} hours")
    kept = retained(spark.read.parquet(path).filter(F.col("day") >= F.to_date(bound)), as_of, hours)
    kept.write.mode("overwrite").partitionBy("day").parquet(target)
    return spark.read.parquet(target)


def retry_step(queue: DataFrame, outcomes: DataFrame, now: str) -> DataFrame:
    """The delivery queue after a round: delivered rows leave, failed ones wait longer.

    ``outcomes`` holds (id, ok) for the attempted rows.
    """
    at = F.lit(now).cast("timestamp")
    joined = queue.join(outcomes, "id", "left")
    failed = F.coalesce(~F.col("ok"), F.lit(False))
    delay = retry_delay(F.col("retries"))
    later = F.timestamp_micros(F.unix_micros(at) + delay.cast("long") * 1_000_000)
    return (
        joined.filter(F.col("ok").isNull() | ~F.col("ok"))
        .withColumn("next_attempt", F.when(failed, later).otherwise(F.col("next_attempt")))
        .withColumn("retries", F.when(failed, F.greatest(F.col("retries"), F.lit(0)) + 1).otherwise(F.col("retries")))
        .drop("ok")
    )
