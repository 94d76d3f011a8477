"""Streams that go through the batch operators in order of time: micro-batch by micro-batch the same as one table."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from actilens.operators import devices, federated, markov, rules
from actilens.streaming import ordered
from tests.test_streams import busy_logs, feed, same  # noqa: F401

START = datetime(2026, 1, 1)
SOON, EVER = timedelta(seconds=20), timedelta(days=36500)


@pytest.mark.parametrize("parts,shuffled,lateness", [(1, False, SOON), (4, False, SOON), (3, True, EVER)])
def test_one_hot_key(spark, tmp_path, parts, shuffled, lateness):
    """Half of all rows are of one key that is never quiet; its parts are cut into cells."""
    rng, now, rows = random.Random(3), 0, []
    for k in range(400):
        now += rng.choice([0, 1, 2])
        rows.append(("all" if k % 2 else f"k{rng.randrange(30)}", START + timedelta(seconds=now), f"{k:04d}"))
    df = spark.createDataFrame(rows, "k string, ts timestamp, id string")
    step = ordered.limiter(["k"], F.lit(3), F.lit(30), busy_rows=60, cell_rows=30)
    out = ordered.replay(feed(spark, df, str(tmp_path / "in"), parts, shuffled), step, str(tmp_path / "w"), lateness)
    same(out.drop("part"), rules.rate_limit(df, ["k"], F.lit(3), F.lit(30)))
    assert ordered.late_rows(spark, str(tmp_path / "w")) == 0
    if parts == 4:  # the last batch before the end
        carried = spark.read.parquet(str(tmp_path / "w" / "carried" / "part=3"))
        assert 0 < carried.count() <= 3 * 31 and carried.where("k = 'all'").count() <= 3


def test_rows_behind_the_clock_are_counted(spark, tmp_path):
    rows = [("a", START + timedelta(seconds=s), f"{i}") for i, s in enumerate([0, 100, 200, 5, 300])]
    folder = str(tmp_path / "in")
    schema = "k string, ts timestamp, id string"
    import time

    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = ordered.replay(stream, ordered.limiter(["k"], F.lit(1), F.lit(150)), str(tmp_path / "w"), SOON)
    assert {r.id: r.allowed for r in out.collect()} == {"0": True, "1": False, "2": True, "4": False}
    assert ordered.late_rows(spark, str(tmp_path / "w")) == 1


@pytest.mark.parametrize("parts,shuffled,lateness", [(3, False, SOON), (3, True, EVER)])
def test_transitions_and_clipboard(spark, busy_logs, tmp_path, parts, shuffled, lateness):  # noqa: F811
    steps = busy_logs.select("user_name", "ts", "id", "activity_type")
    out = ordered.replay(feed(spark, steps, str(tmp_path / "s"), parts, shuffled), ordered.transitions(), str(tmp_path / "w1"), lateness)
    same(out.groupBy("activity_type", "next_activity").agg(F.count("*").alias("n")), markov.transitions(steps))
    rng = random.Random(1)
    clips = spark.createDataFrame(
        [(f"u{i % 3}", START + timedelta(seconds=7 * i), i, rng.choice(["x", " x", "y", None, "z"])) for i in range(80)],
        "user_name string, ts timestamp, seq long, content string",
    )
    out = ordered.replay(feed(spark, clips, str(tmp_path / "c"), parts, shuffled), ordered.clipboard(), str(tmp_path / "w2"), lateness)
    same(out.drop("part"), devices.clipboard_changes(clips))


@pytest.mark.parametrize("size,lateness", [(70, SOON), (1000, EVER)])
def test_rounds(spark, tmp_path, size, lateness):
    """Half of all messages are of one round; verdicts and averages are those of the tables."""
    rng, updates, reveals = random.Random(7), [], []
    for k in range(200):
        at = START + timedelta(seconds=k // 2, microseconds=k)
        agent, round_id = f"a{rng.randrange(12)}", rng.choice(["all", f"r{rng.randrange(15)}"])
        vector = [float(rng.randrange(9))] * rng.choice([2, 2, 2, 1])
        if rng.random() < 0.5:
            updates.append((round_id, agent, vector, 1 + k % 3, 1.0, 1 + k % 2, 40, at, f"m{k:03d}"))
        else:
            reveals.append((round_id, agent, vector, at))
    u = spark.createDataFrame(updates, "round_id string, agent_id string, masked_update array<double>, num_samples int, epsilon double, min_clients int, timeout_seconds int, submitted_at timestamp, message_id string")
    r = spark.createDataFrame(reveals, "round_id string, agent_id string, mask array<double>, revealed_at timestamp")
    messages = ordered.round_messages(u, r)
    stream = feed(spark, messages, str(tmp_path / "in"), -(-200 // size))
    out = ordered.replay(stream, ordered.rounds(), str(tmp_path / "w"), lateness)
    same(out.select("round_id", "agent_id", "message_id", "kind", "verdict"), federated.message_verdicts(u, r))
    means = {x["round_id"]: x["average"] for x in out.filter("average is not null").collect()}
    for x in federated.secure_average(u, r).collect():
        assert x["feature_vector"] == pytest.approx(means.pop(x["round_id"]))
    assert not means


@pytest.mark.parametrize("parts,shuffled,lateness", [(1, False, SOON), (5, False, SOON), (3, True, EVER)])
def test_inactivity(spark, tmp_path, parts, shuffled, lateness):
    """The events of the gaps of the whole table, each once; a user whose name is missing is one like any other."""
    rng, now, rows = random.Random(11), 0, []
    for k in range(300):
        now += rng.choice([0, 1, 400, 3500])
        rows.append((f"{k:03d}", START + timedelta(seconds=now), rng.choice(["a", "a", "a", "b", "c", None])))
    df = spark.createDataFrame(rows, "id string, ts timestamp, user_name string")
    out = ordered.replay(feed(spark, df, str(tmp_path / "in"), parts, shuffled), ordered.inactivity(), str(tmp_path / "w"), lateness)
    expected = []
    for user in {u for _, _, u in rows}:
        times = [t for _, t, u in rows if u == user]
        for t, following in zip(times, [*times[1:], datetime.max]):
            waits = [("warning", timedelta(seconds=6900)), ("limit", timedelta(seconds=7200))]
            expected += [(str(user), kind, t + w) for kind, w in waits if following - t > w]
    assert sorted((str(r["user_name"]), r["kind"], r["at"]) for r in out.collect()) == sorted(expected)
    if parts == 5:
        assert 0 < spark.read.parquet(str(tmp_path / "w" / "carried" / "part=4")).count() <= 4
