from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from actilens.functions import vectors
from actilens.operators import federated
from actilens.operators.federated import Privacy

T0 = datetime(2026, 1, 1)
U = "round_id string, agent_id string, masked_update array<double>, num_samples int, epsilon double, min_clients int, timeout_seconds int, submitted_at timestamp, message_id string"
R = "round_id string, agent_id string, mask array<double>, revealed_at timestamp"


def updates(spark, *rows):
    return spark.createDataFrame([("r", a, v, n, 1.0, 2, 10, T0 + timedelta(seconds=s), m) for a, v, n, s, m in rows], U)


def reveals(spark, *rows):
    return spark.createDataFrame([("r", a, v, T0 + timedelta(hours=1, seconds=i)) for i, (a, v) in enumerate(rows)], R)


def test_verdict_cascade(spark):
    u = updates(
        spark, ("a", [1.0, 2.0], 1, 0, "1"), ("a", [9.0, 9.0], 1, 1, "2"), ("b", [1.0], 1, 2, "3"), ("b", [3.0, 4.0], 3, 3, "4"),
        ("c", [0.0, 0.0], 1, 30, "5"), ("d", [0.0, 0.0], 1, 31, "6"),
    )
    got = {r["message_id"]: r["verdict"] for r in federated.submission_verdicts(u).collect()}
    # The timeout is at least 30 s.
    assert got == {"1": "accepted", "2": "duplicate_agent_submission", "3": "dimension_mismatch", "4": "accepted", "5": "accepted", "6": "round_expired"}


def test_secure_average(spark):
    u = updates(spark, ("a", [1.0, 2.0], 0, 0, "1"), ("b", [3.0, 4.0], 3, 3, "2"))
    half = reveals(spark, ("a", [0.5, 0.5]))
    assert federated.secure_average(u, half).count() == 0
    s = federated.round_status(u, half).first()
    assert (s["submitted"], s["revealed"], s["pending"], s["finalized"]) == (2, 1, 1, False)
    full = reveals(spark, ("a", [0.5, 0.5]), ("b", [1.0, 1.0]), ("b", [7.0, 7.0]), ("ghost", [0.0, 0.0]))
    r = federated.secure_average(u, full).first()
    assert r["feature_vector"] == pytest.approx([(0.5 + 6) / 4, (1.5 + 9) / 4])
    assert (r["num_clients"], r["total_samples"], r["avg_epsilon"]) == (2, 3, 1.0)
    assert [x["agent_id"] for x in federated.refused_reveals(u, full).collect()] == ["ghost"]
    assert [x["agent_id"] for x in federated.pending_reveals(u, half).collect()] == ["b"]
    noisy = federated.secure_average(u, full, noise_sigma=0.1).first()["feature_vector"]
    assert noisy != r["feature_vector"] and noisy == federated.secure_average(u, full, noise_sigma=0.1).first()["feature_vector"]


def test_plain_average(spark):
    df = spark.createDataFrame([({"w": 1.0, "b": 2.0}, [1.0, 2.0]), ({"w": 3.0}, [3.0, 4.0]), ({}, None)], "m map<string,double>, v array<double>")
    got = {r["key"]: r["average"] for r in federated.plain_average(df, "m").collect()}
    assert got == {"w": pytest.approx(4 / 3), "b": pytest.approx(2 / 3)}
    assert federated.plain_vector_average(df, "v").first()["average"] == pytest.approx([4 / 3, 2.0])


def test_local_vectors_need_ten_logs(make_logs):
    logs = make_logs([{"risk_level": "HIGH"}] * 9 + [{"user_name": "bob", "risk_level": "high"}] * 10)
    rows = federated.local_vectors(logs).collect()
    assert [(r["agent_id"], r["risk_score"], r["num_samples"]) for r in rows] == [("bob", 1.0, 10)]


def test_clip(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.3, 0.4],)], "v array<double>")
    got = [r[0] for r in df.select(vectors.l2_clip(F.col("v"), 2.5)).collect()]
    assert got[0] == pytest.approx([1.5, 2.0]) and got[1] == pytest.approx([0.3, 0.4])


def test_noise_moments_and_repeatability(spark):
    df = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    draw = lambda d: d.select(
        "k", vectors.laplace_noise(F.col("k"), F.lit(0), 2.0, 7).alias("l"), vectors.gaussian_noise(F.col("k"), F.lit(0), 3.0, 7).alias("g")
    )
    pdf = draw(df).toPandas()
    assert abs(pdf["l"].mean()) < 0.1 and pdf["l"].var() == pytest.approx(8, rel=0.1)
    assert abs(pdf["g"].mean()) < 0.1 and pdf["g"].std() == pytest.approx(3, rel=0.05)
    assert np.mean(np.abs(pdf["l"]) < 2 * np.log(2)) == pytest.approx(0.5, abs=0.02)
    assert draw(df.repartition(3)).exceptAll(draw(df)).isEmpty()


def test_masked_message_reveals_the_private_vector(spark):
    v = spark.createDataFrame([(f"a{i}", [30.0, 40.0, 0.0], 10 + i) for i in range(5)], "agent_id string, feature_vector array<double>, num_samples int")
    off = federated.masked_updates(v, "r", Privacy(enabled=False), 3)
    for r in off.collect():
        assert np.subtract(r["masked_update"], r["mask"]) == pytest.approx([6.0, 8.0, 0.0]) and r["epsilon"] is None
    on = federated.masked_updates(v, "r", Privacy(), 3)
    assert on.first()["epsilon"] == 1.0
    masks = [tuple(r["mask"]) for r in federated.reveal_messages(on).collect()]
    assert len(set(masks)) == 5


def service(updates, reveals):
    """The round service, message after message."""
    state, out = {}, {}
    messages = [(u[4], u[5], 0, u) for u in updates] + [(r[2], f"reveal-{r[1]}", 1, r) for r in reveals]
    for at, message, kind, row in sorted(messages, key=lambda m: m[:3]):
        r = state.get(row[0])
        if kind == 0:
            r = state.setdefault(row[0], {"at": at, "dim": len(row[2]), "need": max(1, row[6]), "agents": {}, "shown": set(), "closed": False})
            late = (at - r["at"]).total_seconds() > max(30, row[7])
            verdict = (
                "round_already_finalized" if r["closed"] else "round_expired" if late else "duplicate_agent_submission" if row[1] in r["agents"]
                else "dimension_mismatch" if len(row[2]) != r["dim"] else "accepted"
            )
            if verdict == "accepted":
                r["agents"][row[1]] = row
        elif r is None:
            verdict = "unknown_round"
        else:
            verdict = (
                "round_already_finalized" if r["closed"] else "no_submission" if row[1] not in r["agents"] else "mask_already_revealed" if row[1] in r["shown"]
                else "dimension_mismatch" if len(row[3]) != r["dim"] else "revealed"
            )
            if verdict == "revealed":
                r["shown"].add(row[1])
                r["closed"] = len(r["shown"]) == len(r["agents"]) >= r["need"]
        out[row[0], row[1], message, at, kind] = verdict
    return out


@pytest.mark.parametrize("agents,seconds", [(700, 4000), (40, 90)])
def test_one_round_of_all_agents_in_many_tasks(spark, agents, seconds):
    import random
    from datetime import datetime, timedelta

    rng, start = random.Random(agents), datetime(2026, 1, 1)
    sent, shown = [], []
    for k in range(agents):
        name = "all" if k % 10 else f"r{k % 30}"
        for copy in range(1 + (k % 13 == 0)):
            at = start + timedelta(seconds=rng.randrange(seconds // 3), microseconds=rng.randrange(10**6))
            sent.append((name, f"a{k}", [1.0] * (2 if k % 17 else 3), k % 5, at, f"{k}-{copy}", 3, seconds // 4))
        for _ in range(rng.choice([1, 1, 1, 2])):
            shown.append((name, f"a{k}", start + timedelta(seconds=rng.randrange(seconds // 5, seconds), microseconds=rng.randrange(10**6)), [0.5] * (2 if k % 19 else 3)))
    shown.append(("nowhere", "x", start, [1.0]))
    u = spark.createDataFrame([(*s, 1.0) for s in sent], "round_id string, agent_id string, masked_update array<double>, num_samples long, submitted_at timestamp, message_id string, min_clients int, timeout_seconds int, epsilon double")
    r = spark.createDataFrame(shown, "round_id string, agent_id string, revealed_at timestamp, mask array<double>")
    want = service(sent, shown)
    got = federated.message_verdicts(u.repartition(3), r.repartition(3)).collect()
    bare = lambda k: (k[0], k[1], "reveal" if k[4] else "update", k[2])
    assert sorted((x.round_id, x.agent_id, x.kind, x.message_id, x.verdict) for x in got) == sorted((*bare(k), v) for k, v in want.items())
    assert len({v for v in want.values()}) >= 6
