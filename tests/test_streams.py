"""Streams fed in several micro-batches give what the batch operators give."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from actilens.operators import devices, federated, flows, markov, policy, rules
from actilens.operators.policy import Settings
from actilens.streaming import jobs

START = datetime(2026, 1, 1)


def feed(spark, df, folder, parts=3, shuffled=False):
    """Write ``df`` as one file per slice, in the order of time or in none, and read the folder as a stream."""
    import random
    import time

    n = df.count()
    ordered = df.orderBy("ts").collect()
    if shuffled:
        random.Random(1).shuffle(ordered)
    size = max(1, -(-n // parts))
    for i in range(0, n, size):
        spark.createDataFrame(ordered[i : i + size], df.schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def replay(build, stream, folder):
    return jobs.replay(build, [(stream, "ts")], str(folder))


def same(a, b):
    a, b = a.select(sorted(a.columns)), b.select(sorted(b.columns))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.fixture
def busy_logs(make_logs):
    rows = []
    for i in range(60):
        rows.append(
            {
                "ts": START + timedelta(seconds=37 * i), "user_name": f"u{i % 3}", "activity_type": "ABC"[i % 5 % 3],
                "risk_level": ["INFO", "HIGH", "CRITICAL"][i % 3], "description": "secret bet" if i % 4 == 0 else "mail bob@example.com",
                "activity_summary": '{"confidence": 0.%d}' % (i % 10),
            }
        )
    return make_logs(rows)


def test_enrichment(spark, busy_logs, tmp_path):
    stream = feed(spark, busy_logs, str(tmp_path / "in"))
    out = jobs.run_available(jobs.enriched(stream, Settings()), str(tmp_path / "w")).drop("_batch")
    same(out, jobs.enriched(busy_logs, Settings()))


def test_ingest_batch_without_model(spark, busy_logs, tmp_path):
    stream = feed(spark, busy_logs, str(tmp_path / "in"))
    target = str(tmp_path / "store")
    q = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s")).foreachBatch(
        jobs.ingest_batch(Settings(), None, target)
    ).start()
    q.awaitTermination()
    stored = spark.read.parquet(target).drop("batch")
    same(stored, jobs.enriched(busy_logs, Settings()))


def test_duplicate_ids_enter_once(spark, busy_logs, tmp_path):
    doubled = busy_logs.unionByName(busy_logs)
    out = jobs.run_available(jobs.first_arrivals(feed(spark, doubled, str(tmp_path / "in"))), str(tmp_path / "w"))
    assert out.count() == 60 and out.select("id").distinct().count() == 60


def test_running_keys(spark, make_logs, tmp_path):
    rows = [{"activity_type": "KEYLOG", "activity_summary": '{"Key.a": 2}'}, {"activity_type": "KEYLOG", "activity_summary": '{"key_counts": {"a": 3, "b": 1}}'}, {"activity_type": "KEYLOG", "activity_summary": "x"}]
    out = jobs.latest(jobs.run_available(jobs.running_key_counts(feed(spark, make_logs(rows), str(tmp_path / "in"))), str(tmp_path / "w"), "update"), ["key"])
    assert {r["key"]: r["n"] for r in out.collect()} == {"A": 5, "B": 1}


TRAFFIC = "id string, ts timestamp, source_ip string, destination_ip string, bytes_transferred long"


def test_minute_series_drops_late_rows(spark, tmp_path):
    rows = [(str(i), START + timedelta(minutes=i), "s", "192.168.0.1" if i % 2 else "9.9.9.9", 10) for i in range(30)]
    base = spark.createDataFrame(rows, TRAFFIC)
    folder = str(tmp_path / "in")
    stream = feed(spark, base, folder)
    first = jobs.run_available(jobs.minute_series(stream), str(tmp_path / "w"), "update")
    assert jobs.latest(first, ["minute", "direction"]).count() == 30
    spark.createDataFrame([("late", START, "s", "9.9.9.9", 999), ("new", START + timedelta(minutes=29, seconds=5), "s", "192.168.0.1", 5)], TRAFFIC).coalesce(1).write.mode("append").parquet(folder)
    again = jobs.latest(jobs.run_available(jobs.minute_series(stream), str(tmp_path / "w"), "update"), ["minute", "direction"])
    assert jobs.late_rows(spark, str(tmp_path / "w")) == 1
    got = {r["minute"]: r["bytes"] for r in again.collect()}
    assert got[START] == 10 and got[START + timedelta(minutes=29)] == 15


def test_pair_counts(spark, tmp_path):
    rows = [(str(i), START + timedelta(milliseconds=700 * i), "s", f"d{i % 2}", 1) for i in range(20)]
    df = spark.createDataFrame(rows, TRAFFIC)
    out = jobs.run_available(jobs.flushed_pairs(feed(spark, df, str(tmp_path / "in"))), str(tmp_path / "w"), "update")
    same(jobs.latest(out, ["flushed_from", "source_ip", "destination_ip"]), flows.pair_counts(df))


def test_limiter(spark, busy_logs, tmp_path):
    narrow = busy_logs.select("id", "ts", "user_name")
    limited = lambda logs: jobs.limited(logs, ["user_name"], F.lit(2), F.lit(300))
    out = replay(limited, feed(spark, narrow, str(tmp_path / "in")), tmp_path / "w")
    same(out.drop("_batch"), rules.rate_limit(narrow, ["user_name"], F.lit(2), F.lit(300)))


def test_audit(spark, busy_logs, tmp_path):
    from tests.test_rules import book

    books = book(spark, {"id": "p1", "min_confidence": 0.3, "rate_limit_count": 2}, {"id": "p2", "trigger_field": "description", "trigger_operator": "contains", "trigger_value": "BET", "requires_approval": True})
    stream = feed(spark, busy_logs, str(tmp_path / "in"))
    parts = [replay(lambda logs, i=i: jobs.stream_audit(logs, books)[i], stream, tmp_path / f"w{i}") for i in (0, 1)]
    same(parts[0].unionByName(parts[1]).drop("_batch"), rules.audit(busy_logs, books))


def test_change_detectors(spark, tmp_path):
    clips = spark.createDataFrame([("u", START + timedelta(seconds=i), i, c) for i, c in enumerate(["x", " x", "y", None, "y", "x", "x"])], "user_name string, ts timestamp, seq long, content string")
    out = replay(jobs.clipboard_events, feed(spark, clips, str(tmp_path / "c")), tmp_path / "w1").drop("_batch")
    same(out, devices.clipboard_changes(clips))
    snaps = spark.createDataFrame([("h", START + timedelta(hours=i), i, d) for i, d in enumerate([[], ["a"], ["a"], ["a", "b"], ["b"], []])], "host string, ts timestamp, snapshot_id long, devices array<string>")
    out = replay(jobs.device_events, feed(spark, snaps, str(tmp_path / "d")), tmp_path / "w2").drop("_batch")
    same(out, devices.device_changes(snaps).drop("devices"))


def test_transitions(spark, busy_logs, tmp_path):
    out = replay(jobs.activity_pairs, feed(spark, busy_logs, str(tmp_path / "in")), tmp_path / "w")
    same(out.groupBy("activity_type", "next_activity").agg(F.count("*").alias("n")), markov.transitions(busy_logs))


def test_inactivity_timer_fires_once(spark, make_logs, tmp_path):
    times = [0, 100, 7000 + 100, 20000]
    rows = [{"ts": START + timedelta(seconds=s), "user_name": "ann"} for s in times]
    rows += [{"ts": START + timedelta(seconds=s), "user_name": "clock"} for s in range(0, 60000, 3000)]
    out = replay(jobs.inactivity_events, feed(spark, make_logs(rows), str(tmp_path / "in"), 6), tmp_path / "w")
    got = sorted((r["kind"], int((r["at"] - START).total_seconds())) for r in out.filter("user_name = 'ann'").collect())
    assert got == [("limit", 14300), ("limit", 27200), ("warning", 7000), ("warning", 14000), ("warning", 26900)]
    assert out.filter("user_name = 'clock'").filter(F.col("at") < F.lit(START + timedelta(seconds=57000))).count() == 0


def test_federated_rounds(spark, tmp_path):
    from tests.test_federated import reveals, updates

    u = updates(spark, ("a", [1.0, 2.0], 1, 0, "1"), ("a", [9.0, 9.0], 1, 1, "2"), ("b", [1.0], 1, 2, "3"), ("b", [3.0, 4.0], 3, 3, "4"), ("d", [0.0, 0.0], 1, 31, "6"))
    r = reveals(spark, ("a", [0.5, 0.5]), ("ghost", [0.0, 0.0]), ("b", [1.0, 1.0]), ("a", [7.0, 7.0]))
    us = feed(spark, u.withColumn("ts", F.col("submitted_at")), str(tmp_path / "u"), 1)
    rs = feed(spark, r.withColumn("ts", F.col("revealed_at")), str(tmp_path / "r"), 1)
    out = jobs.replay(jobs.round_events, [(us, "submitted_at"), (rs, "revealed_at")], str(tmp_path / "w"))
    verdicts = {x["message_id"]: x["verdict"] for x in out.filter("kind = 'update'").collect()}
    assert verdicts == {x["message_id"]: x["verdict"] for x in federated.submission_verdicts(u).collect()}
    average = out.filter("average is not null").first()["average"]
    assert average == pytest.approx(federated.secure_average(u, r).first()["feature_vector"])
    shown = {x["verdict"] for x in out.filter("kind = 'reveal'").collect()}
    assert shown == {"revealed", "no_submission", "round_already_finalized"}
    same(out.select("round_id", "agent_id", "message_id", "kind", "verdict"), federated.message_verdicts(u, r))


def test_rounds_with_messages_between_each_other(spark, tmp_path):
    """Batch and stream answer alike when submissions, reveals and repeats are mixed, and after a round has closed."""
    import random

    rng, updates, reveals = random.Random(5), [], []
    for k in range(150):
        at = START + timedelta(seconds=rng.randrange(40), microseconds=k)
        agent, round_id = f"a{rng.randrange(5)}", f"r{rng.randrange(12)}"
        vector = [float(rng.randrange(9))] * rng.choice([2, 2, 2, 1])
        if rng.random() < 0.5:
            updates.append((round_id, agent, vector, 1 + k % 3, 1.0, 1 + k % 2, 30, at, f"m{k:03d}"))
        else:
            reveals.append((round_id, agent, vector, at))
    u = spark.createDataFrame(updates, "round_id string, agent_id string, masked_update array<double>, num_samples int, epsilon double, min_clients int, timeout_seconds int, submitted_at timestamp, message_id string")
    r = spark.createDataFrame(reveals, "round_id string, agent_id string, mask array<double>, revealed_at timestamp")
    u.write.parquet(str(tmp_path / "u"))
    r.write.parquet(str(tmp_path / "r"))
    read = lambda name, df: spark.readStream.schema(df.schema).parquet(str(tmp_path / name))
    out = jobs.replay(jobs.round_events, [(read("u", u), "submitted_at"), (read("r", r), "revealed_at")], str(tmp_path / "w"))
    batch = federated.message_verdicts(u, r)
    same(out.select("round_id", "agent_id", "message_id", "kind", "verdict"), batch)
    assert {x["verdict"] for x in batch.collect()} >= {"accepted", "revealed", "no_submission", "duplicate_agent_submission", "round_already_finalized"}
    means = {x["round_id"]: x["average"] for x in out.filter("average is not null").collect()}
    for x in federated.secure_average(u, r).collect():
        assert x["feature_vector"] == pytest.approx(means.pop(x["round_id"]))
    assert not means


def test_request_cache(spark, tmp_path):
    df = spark.createDataFrame([("k", START + timedelta(seconds=s), f"{i}") for i, s in enumerate([0, 299, 300, 500, 600])], "request string, ts timestamp, id string")
    batch = jobs.first_requests(df, "request")
    assert sorted(r["id"] for r in batch.collect()) == ["0", "2", "4"]
    out = replay(lambda r: jobs.first_requests(r, "request"), feed(spark, df, str(tmp_path / "in")), tmp_path / "w")
    same(out.drop("_batch"), batch)


def test_retry_batches(spark, tmp_path):
    from actilens.sources.sinks import retry_step

    q = spark.createDataFrame([(i, 0, START) for i in range(4)], "id long, retries int, next_attempt timestamp")
    q.write.parquet(str(tmp_path / "q"))
    outcomes = spark.createDataFrame([(0, True, START), (1, False, START)], "id long, ok boolean, ts timestamp")
    stream = feed(spark, outcomes, str(tmp_path / "o"), 1)
    run = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "s")).foreachBatch(
        jobs.retry_batch(str(tmp_path / "q"), str(tmp_path / "next"), "2026-01-01 00:00:00")
    ).start()
    run.awaitTermination()
    same(spark.read.parquet(str(tmp_path / "next")), retry_step(q, outcomes.drop("ts"), "2026-01-01 00:00:00"))
    assert policy.ANOMALY_TAG.strip() == "[ML_DETECTED]"


@pytest.mark.parametrize("parts", [1, 12])
def test_rows_in_any_order_of_files(spark, busy_logs, tmp_path, parts):
    """However the rows are dealt over files, the result is that of the table."""
    narrow = busy_logs.select("id", "ts", "user_name", "activity_type")
    stream = feed(spark, narrow, str(tmp_path / "in"), parts, shuffled=True)
    out = replay(lambda logs: jobs.limited(logs, ["user_name"], F.lit(2), F.lit(300)), stream, tmp_path / "w1")
    same(out.drop("_batch"), rules.rate_limit(narrow, ["user_name"], F.lit(2), F.lit(300)))
    pairs = replay(jobs.activity_pairs, stream, tmp_path / "w2")
    same(pairs.groupBy("activity_type", "next_activity").agg(F.count("*").alias("n")), markov.transitions(narrow))
    seen = jobs.run_available(jobs.first_arrivals(stream, jobs.REPLAY_LATENESS), str(tmp_path / "w3"))
    assert seen.count() == narrow.count() and jobs.late_rows(spark, str(tmp_path / "w3")) == 0


def test_an_empty_stream_gives_an_empty_table(spark, make_logs, tmp_path):
    make_logs([{}]).limit(0).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(make_logs([{}]).schema).parquet(str(tmp_path / "in"))
    assert jobs.run_available(jobs.first_arrivals(stream), str(tmp_path / "w")).count() == 0
