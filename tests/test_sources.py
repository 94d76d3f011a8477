import glob
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from actilens import schemas
from actilens.functions import casts, timefns
from actilens.operators.scans import align_schema, due_rows
from actilens.sources import readers, sinks


def test_exports(make_logs, spark, tmp_path):
    logs = make_logs([{"description": 'a "quoted", text\nline'}, {"ip_address": None}])
    sinks.export_logs(logs, str(tmp_path / "c"))
    back = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(str(tmp_path / "c"))
    assert back.columns == ["ID", "Timestamp", "User", "Activity", "Risk Level", "Description", "IP", "Details"]
    assert 'a "quoted", text\nline' in [r["Description"] for r in back.collect()]
    sinks.export_logs(logs, str(tmp_path / "j"), "json", compress=True)
    assert glob.glob(str(tmp_path / "j" / "*.json.gz"))
    rows = spark.read.json(str(tmp_path / "j"))
    assert set(rows.columns) == {"id", "timestamp", "user", "activity_type", "risk_level", "description", "details", "ip_address", "location"}
    sinks.export_logs(logs, str(tmp_path / "p"), "pdf", end="2026-01-01T00:00:30")
    assert spark.read.option("header", True).csv(str(tmp_path / "p")).columns == ["timestamp", "level", "user", "description"]
    with pytest.raises(ValueError, match="Invalid format"):
        sinks.export_logs(logs, str(tmp_path / "x"), "xls")


def test_metric_retention(spark, tmp_path):
    start = datetime(2026, 1, 1)
    rows = [("h", start + timedelta(hours=h), 1.0) for h in range(0, 72, 6)]
    df = spark.createDataFrame(rows, "host string, ts timestamp, cpu_usage double")
    sinks.append_metrics(df.limit(6), str(tmp_path / "m"))
    sinks.append_metrics(df.subtract(df.limit(6)), str(tmp_path / "m"))
    kept = sinks.compact_metrics(spark, str(tmp_path / "m"), str(tmp_path / "k"), "2026-01-03 12:00:00")
    assert sorted(r["ts"] for r in kept.collect()) == [t for _, t, _ in rows if t >= datetime(2026, 1, 2, 12)]


def test_retry_step(spark):
    now = "2026-01-01 00:00:00"
    q = spark.createDataFrame([(1, 0, now), (2, 7, now), (3, 2, now), (4, -5, now)], "id long, retries int, next_attempt string").withColumn("next_attempt", F.col("next_attempt").cast("timestamp"))
    done = spark.createDataFrame([(1, False), (2, False), (3, True)], "id long, ok boolean")
    got = {r["id"]: (r["retries"], r["next_attempt"]) for r in sinks.retry_step(q, done, now).collect()}
    base = datetime(2026, 1, 1)
    assert got == {1: (1, base + timedelta(seconds=2)), 2: (8, base + timedelta(seconds=256)), 4: (-5, base)}
    assert [r["id"] for r in due_rows(q, now, 0).collect()] == [1]


def test_normalised_names(spark):
    df = spark.createDataFrame([("1", "2026-01-01T10:00:00", "ann", "HIGH", "LOW"), ("2", "never", "bob", "LOW", "LOW")], "id string, timestamp string, user string, riskLevel string, risk_level string")
    out = schemas.normalised(df)
    assert set(out.columns) == {"id", "ts", "user_name", "risk_level"}
    rows = {r["id"]: r for r in out.collect()}
    assert rows["1"]["risk_level"] == "HIGH" and rows["1"]["ts"] == datetime(2026, 1, 1, 10) and rows["2"]["ts"] is None
    assert schemas.snake("bytesTransferred") == "bytes_transferred"


def test_align_schema(spark):
    df = spark.createDataFrame([("p", 0.7)], "id string, min_confidence double")
    r = align_schema(df, schemas.PLAYBOOK_DEFAULTS).first()
    assert (r["min_confidence"], r["rate_limit_count"], r["scope"]) == (0.7, 5, "global")


def test_casts(spark):
    df = spark.createDataFrame([("3",), ("3.7",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(casts.safe_int(F.col("s"), 9)).collect()] == [3, 9, 9, 9]
    assert [r[0] for r in df.select(casts.safe_float(F.col("s"), 1.5)).collect()] == [3.0, 3.7, 1.5, 1.5]
    assert spark.range(1).select(casts.safe_int(F.lit(3.7))).first()[0] == 3


def test_retry_delay_and_expiry(spark):
    df = spark.createDataFrame([(0,), (7,), (8,), (50,)], "r int")
    assert [r[0] for r in df.select(timefns.retry_delay(F.col("r"))).collect()] == [2, 256, 256, 256]
    row = spark.range(1).select(timefns.expiry(F.lit("2026-01-01").cast("timestamp"), F.lit(5)).alias("e")).first()
    assert row["e"] == datetime(2026, 1, 1, 0, 0, 30)


def test_fixed_schema_reads(spark, tmp_path, make_logs):
    make_logs([{}, {}]).write.json(str(tmp_path / "logs"))
    assert readers.read_table(spark, str(tmp_path / "logs"), schemas.LOG, "json").count() == 2
    stream = readers.stream_table(spark, str(tmp_path / "logs"), schemas.LOG, "json", 1)
    assert stream.isStreaming and stream.columns[0] == "id"
