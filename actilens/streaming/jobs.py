"""Streaming twins of the batch operators, and a runner for available data."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actilens.functions import pii
from actilens.functions.casts import or_default
from actilens.functions.text import strip
from actilens.models.training import AnomalyPredictor
from actilens.operators import flows, policy, rules, sessions
from actilens.session import ROCKSDB, ensure_checkpoint_dir
from actilens.sources.sinks import retry_step
from actilens.streaming.processors import (
    CELL_SECONDS, ChangeDetector, FederatedRound, InactivityTimer, RateLimiter, Sequence,
)

WATERMARK = "10 minutes"
#: Allowed lateness of a replay of stored tables, whose files come in any order.
REPLAY_LATENESS = "36500 days"
#: Time of the row that ends a replay; less the lateness it is past all data, and pandas can hold it.
FAR = datetime(2250, 1, 1)


# --- ingest ------------------------------------------------------------------------------------


def enriched(logs: DataFrame, settings: policy.Settings, prediction: str | None = None) -> DataFrame:
    """Redact, then apply the policies: the same expressions for tables and streams."""
    return policy.apply_policies(pii.redact_rows(logs), settings, prediction)


def first_arrivals(logs: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Drop repeated ids that arrive within the watermark."""
    return logs.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["id"])


def ingest_batch(settings: policy.Settings, predictor: AnomalyPredictor | None, target: str):
    """``foreachBatch`` body: redact, score, apply policies, store.

    A retried batch overwrites its own folder, so a restart cannot store rows twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        clean = pii.redact_rows(batch)
        scored = predictor.transform(clean) if predictor else clean.withColumn("prediction", F.lit(1))
        out = policy.apply_policies(scored, settings, "prediction").drop("prediction")
        out.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def running_key_counts(logs: DataFrame) -> DataFrame:
    """Key counts accumulated for ever (update or complete mode)."""
    return sessions.live_key_counts(logs).groupBy("key").agg(F.sum("n").alias("n"))


def minute_series(traffic: DataFrame, watermark: str = "5 minutes") -> DataFrame:
    """Bytes per real minute and direction; rows behind the watermark are dropped."""
    direction = F.when(flows.is_inbound(F.col("destination_ip")), "inbound").otherwise("outbound")
    return (
        traffic.withWatermark("ts", watermark)
        .groupBy(F.window("ts", "1 minute").alias("w"), direction.alias("direction"))
        .agg(F.sum("bytes_transferred").alias("bytes"))
        .select(F.col("w.start").alias("minute"), "direction", "bytes")
    )


def flushed_pairs(packets: DataFrame, interval: str = "2 seconds", watermark: str = WATERMARK) -> DataFrame:
    return flows.pair_counts(packets.withWatermark("ts", watermark), interval)


# --- keyed state -------------------------------------------------------------------------------


def limited(df: DataFrame, keys: list[str], limit: Column, window_seconds: Column, cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """Add ``allowed`` with the sliding-window limiter; needs ``id`` and a watermark on ``ts``."""
    at_least_one = lambda c: F.greatest(F.coalesce(c, F.lit(1)).cast("long"), F.lit(1).cast("long"))
    prepared = df.withColumns({"us": F.unix_micros("ts"), "lim": at_least_one(limit), "win": at_least_one(window_seconds)})
    schema = T.StructType([*prepared.schema.fields, T.StructField("allowed", T.BooleanType())])
    return prepared.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=RateLimiter(cell_seconds), outputStructType=schema, outputMode="append", timeMode="EventTime"
    ).drop("us", "lim", "win")


def first_requests(requests: DataFrame, key: str, ttl_seconds: int = 300, cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """Requests that a time-to-live cache would not have answered: one per key and interval."""
    if requests.isStreaming:
        out = limited(requests, [key], F.lit(1), F.lit(ttl_seconds), cell_seconds)
    else:
        out = rules.rate_limit(requests, [key], F.lit(1), F.lit(ttl_seconds))
    return out.filter("allowed").drop("allowed")


def audit_parts(logs: DataFrame, playbooks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Matched pairs of a log stream: audit rows of those that are settled, and the pairs that wait for the limiter, which is
    keyed by ``playbook_id`` and ``t``."""
    pairs = rules.guarded_pairs(logs, playbooks)
    waiting = pairs.filter(F.col("status").isNull()).withColumn("t", or_default(F.col("target"), "-"))
    return _audit_rows(pairs.filter(F.col("status").isNotNull())), waiting


def _audit_rows(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        F.sha2(F.concat_ws("|", "playbook_id", "id"), 256).alias("audit_id"), "ts", "playbook_id", "playbook_name",
        F.col("id").alias("source_log_id"), "user_name", "action_type", "target", "status", "reason", "risk_level", "confidence",
    )


def decided(limited_pairs: DataFrame) -> DataFrame:
    """Audit rows of pairs that the limiter has ``allowed`` or not."""
    return _audit_rows(limited_pairs.withColumns(
        {
            "status": F.when(F.col("allowed"), "executed").otherwise("rate_limited"),
            "reason": F.when(F.col("allowed"), "executed_successfully").otherwise("rate_limit_exceeded"),
        }
    ))


def stream_audit(logs: DataFrame, playbooks: DataFrame, cell_seconds: int = CELL_SECONDS) -> tuple[DataFrame, DataFrame]:
    """(settled, limited) audit rows of a log stream; together they are the batch audit."""
    settled, waiting = audit_parts(logs, playbooks)
    keys = ["playbook_id", "t"]
    return settled, decided(limited(waiting, keys, F.col("rate_limit_count"), F.col("rate_limit_window_seconds"), cell_seconds))


def _keyed(df: DataFrame, key: str, value: Column, identity: str) -> DataFrame:
    return df.select(key, "ts", F.unix_micros("ts").alias("us"), F.col(identity).cast("string").alias("id"), value.alias("value"))


def clipboard_events(readings: DataFrame, key: str = "user_name", cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """Clipboard changes as length and hash."""
    body = strip(F.col("content"))
    packed = F.concat_ws(":", F.sha2(body, 256), F.length(body).cast("string"))
    rows = _keyed(readings.filter(F.col("content").isNotNull()), key, packed, "seq").withColumn(
        "id", F.lpad("id", 20, "0")
    )
    schema = T.StructType([*rows.drop("ts").schema.fields, T.StructField("previous", T.StringType())])
    changed = rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=ChangeDetector(cell_seconds), outputStructType=schema, outputMode="append", timeMode="EventTime"
    )
    parts = F.split("value", ":")
    return changed.select(
        key, F.timestamp_micros("us").alias("ts"), F.col("id").cast("long").alias("seq"),
        parts[1].cast("int").alias("length"), parts[0].alias("hash"),
        F.concat(F.lit("Clipboard updated ("), parts[1], F.lit(" chars)")).alias("description"),
    )


def device_events(snapshots: DataFrame, kind: str = "USB", key: str = "host", cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """Device-set changes with added and removed names."""
    rows = _keyed(snapshots, key, F.to_json(F.array_sort(F.array_distinct("devices"))), "snapshot_id").withColumn(
        "id", F.lpad("id", 20, "0")
    )
    schema = T.StructType([*rows.drop("ts").schema.fields, T.StructField("previous", T.StringType())])
    changed = rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=ChangeDetector(cell_seconds), outputStructType=schema, outputMode="append", timeMode="EventTime"
    )
    names = lambda c: F.from_json(F.coalesce(c, F.lit("[]")), "array<string>")
    now, before = names(F.col("value")), names(F.col("previous"))
    return (
        changed.withColumns({"added": F.array_except(now, before), "removed": F.array_except(before, now), "n_devices": F.size(now)})
        .filter((F.size("added") > 0) | (F.size("removed") > 0))
        .select(
            key, F.timestamp_micros("us").alias("ts"), F.col("id").cast("long").alias("snapshot_id"), "added", "removed", "n_devices",
            F.when(F.size("added") > 0, F.lit(f"{kind} device attached")).otherwise(F.lit(f"{kind} device removed")).alias("description"),
        )
    )


def activity_pairs(logs: DataFrame, cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """(activity_type, next_activity) rows of each user; counting them gives the transition model."""
    steps = logs.filter(F.col("activity_type").isNotNull() & (F.col("activity_type") != ""))
    rows = _keyed(steps, "user_name", F.col("activity_type"), "id")
    return rows.groupBy("user_name").transformWithStateInPandas(
        statefulProcessor=Sequence(cell_seconds), outputStructType=T.StructType.fromDDL("value string, next_value string"),
        outputMode="append", timeMode="EventTime",
    ).select(F.col("value").alias("activity_type"), F.col("next_value").alias("next_activity"))


def inactivity_events(inputs: DataFrame, limit_minutes: int = 120, cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """Warnings and limit events of users without input; needs a watermark on ``ts``."""
    rows = inputs.select("user_name", "ts", F.unix_micros("ts").alias("us"))
    schema = T.StructType.fromDDL("user_name string, kind string, at_us long")
    return rows.groupBy("user_name").transformWithStateInPandas(
        statefulProcessor=InactivityTimer(limit_minutes * 60, cell_seconds), outputStructType=schema, outputMode="append", timeMode="EventTime"
    ).select("user_name", "kind", F.timestamp_micros("at_us").alias("at"))


def round_events(updates: DataFrame, reveals: DataFrame, cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """Verdict per federated message; the completing reveal carries the average. Needs watermarks on ``submitted_at`` and
    ``revealed_at``; a round waits for the slower of the two."""
    sent = updates.select(
        "round_id", "agent_id", "message_id", F.col("submitted_at").alias("ts"), F.unix_micros("submitted_at").alias("us"), F.lit("update").alias("kind"),
        F.col("masked_update").alias("vector"), F.col("num_samples").cast("long").alias("num_samples"), "epsilon",
        F.col("min_clients").cast("int").alias("min_clients"), F.col("timeout_seconds").cast("int").alias("timeout_seconds"),
    )
    shown = reveals.select(
        "round_id", "agent_id", F.concat(F.lit("reveal-"), "agent_id").alias("message_id"), F.col("revealed_at").alias("ts"), F.unix_micros("revealed_at").alias("us"),
        F.lit("reveal").alias("kind"), F.col("mask").alias("vector"), F.lit(0).cast("long").alias("num_samples"),
        F.lit(0.0).alias("epsilon"), F.lit(0).alias("min_clients"), F.lit(0).alias("timeout_seconds"),
    )
    schema = T.StructType.fromDDL(
        "round_id string, agent_id string, message_id string, kind string, verdict string, average array<double>"
    )
    return sent.unionByName(shown).groupBy("round_id").transformWithStateInPandas(
        statefulProcessor=FederatedRound(cell_seconds), outputStructType=schema, outputMode="append", timeMode="EventTime"
    )


def retry_batch(queue_path: str, next_path: str, now: str):
    """``foreachBatch`` body: apply delivery outcomes (id, ok) to the stored queue."""

    def write(batch: DataFrame, batch_id: int) -> None:
        queue = batch.sparkSession.read.parquet(queue_path)
        retry_step(queue, batch.select("id", "ok"), now).write.mode("overwrite").parquet(next_path)

    return write


# --- running -----------------------------------------------------------------------------------


def work_folder(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint location."""
    return os.path.join(ensure_checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")


def run_available(stream: DataFrame, folder: str, mode: str = "append", name: str = "out") -> DataFrame:
    """Process what is available now into Parquet and read it back.

    Update-mode results are kept per micro-batch with their number; readers take the latest. Rows that came behind the
    watermark are counted, see ``late_rows``.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "100000")
    target = f"{folder}/{name}"
    schema = T.StructType([*stream.schema.fields, T.StructField("_batch", T.LongType())])
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{target}/part=none")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(f"{target}/part={batch_id}")

    query = (
        stream.writeStream.outputMode(mode).trigger(availableNow=True)
        .option("checkpointLocation", f"{folder}/{name}-state").foreachBatch(write).start()
    )
    query.awaitTermination()
    late = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    spark.createDataFrame([(late,)], "n long").write.mode("append").parquet(f"{folder}/{name}-late")
    return spark.read.schema(schema).parquet(f"{target}/part=*")


def late_rows(spark: SparkSession, folder: str, name: str = "out") -> int:
    """Rows that all runs of a stream so far have dropped because they came behind the watermark."""
    return spark.read.parquet(f"{folder}/{name}-late").agg(F.sum("n")).first()[0]


def replay(
    build: Callable[..., DataFrame], sources: Sequence[tuple[DataFrame, str]], folder: str, name: str = "out",
    lateness: str = REPLAY_LATENESS,
) -> DataFrame:
    """Run ``build`` over finite sources (stream, time column) to their end.

    The lateness is wide enough for any order of the files. When all rows are in, one empty row from a far time follows in
    each source; it moves the watermark past everything, so that all that is held comes out.
    """
    spark, marked, ends = sources[0][0].sparkSession, [], []
    for number, (source, column) in enumerate(sources):
        path = f"{folder}/{name}-end{number}"
        spark.createDataFrame([], source.schema).write.parquet(path)
        end = spark.readStream.schema(source.schema).parquet(path)
        marked.append(source.unionByName(end).withWatermark(column, lateness))
        ends.append((path, source.schema, column))
    out = build(*marked)
    run_available(out, folder, name=name)
    for path, schema, column in ends:
        blank = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
        # Filters on texts run before the watermark; a control character passes them and matches nothing.
        row = tuple(FAR if f.name == column else "\x03" if f.dataType == T.StringType() else None for f in blank.fields)
        spark.createDataFrame([row], blank).coalesce(1).write.mode("append").parquet(path)
    return run_available(out, folder, name=name)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Last version per key of an update-mode result."""
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v"))
    return best.select(*keys, "_v.*")
