"""The building blocks against brute force, with most rows on one key."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from actilens import scale
from actilens.operators import scans
from actilens.operators.features import seeded_hash, stratified_split
from actilens.operators.metrics import quantiles

START = datetime(2026, 1, 1)


def skewed(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 3)}", START + timedelta(seconds=rng.randint(0, 5000)), f"{i:04d}", rng.randint(0, 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "k string, ts timestamp, id string, v int")


@pytest.mark.parametrize("following", [True, False])
@pytest.mark.parametrize("width", [7, 600, 10**6])
def test_neighbour_equals_plain_order(spark, following, width):
    rows, df = skewed(spark)
    out = scale.with_neighbour(df, ["k"], ["ts", "id"], ["v"], scale.time_chunk("ts", width), following, "n")
    got = {r["id"]: r["n"]["v"] if r["n"] else None for r in out.collect()}
    want = {}
    for key in {r[0] for r in rows}:
        seq = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(seq):
            j = i + 1 if following else i - 1
            want[r[2]] = seq[j][3] if 0 <= j < len(seq) else None
    assert got == want


@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(spark, descending):
    rng = random.Random(2)
    rows = [("a" if i % 3 else "b", float(x), rng.randint(1, 5)) for i, x in enumerate(rng.sample(range(10_000), 300))]
    df = spark.createDataFrame(rows, "k string, x double, n long")
    out = scale.running_totals(df, ["k"], "x", ["n"], descending=descending)
    got = {(r["k"], r["x"]): r["cum_n"] for r in out.collect()}
    for k, x, _ in rows:
        want = sum(n for kk, y, n in rows if kk == k and (y >= x if descending else y <= x))
        assert got[(k, x)] == want


def test_running_totals_of_many_values_in_many_ranges(spark):
    df = spark.range(300_000, numPartitions=6).select((F.col("id") * 7919 % 300_000).alias("x"), (F.col("id") % 5).alias("n"))
    wide = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(wide, "false")
    try:
        out = scale.running_totals(df, [], "x", ["n"])
        assert len(out.inputFiles()) == 0 and out.select(F.spark_partition_id()).distinct().count() > 1
        got = {r.x: r.cum_n for r in out.where("x % 997 = 0").collect()}
    finally:
        spark.conf.set(wide, "true")
    total, want = 0, {}
    n = {7919 * k % 300_000: k % 5 for k in range(300_000)}
    for x in range(300_000):
        total += n[x]
        want[x] = total
    assert len(got) == 301 and all(want[x] == c for x, c in got.items())


@pytest.mark.parametrize("max_bytes", [0, 1 << 20])
def test_dictionary_join(spark, max_bytes):
    rng = random.Random(4)
    rows = [(k, "hot" if rng.random() < 0.8 else f"v{rng.randint(0, 40)}") for k in range(500)]
    df = spark.createDataFrame(rows, "k int, v string").repartition(7)
    table = spark.createDataFrame([("hot", 1)] + [(f"v{j}", 10 + j) for j in range(30)], "v string, code int")
    out = scale.dictionary_join(df, table, "v", max_bytes=max_bytes)
    code = {"hot": 1} | {f"v{j}": 10 + j for j in range(30)}
    assert out.columns == ["v", "k", "code"]
    assert sorted((r.k, r.v, r.code) for r in out.collect()) == sorted((k, v, code.get(v)) for k, v in rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert ("_salt" in plan) == (not max_bytes)


def test_segment_start(spark):
    rows, df = skewed(spark, 200)
    marked = df.withColumn("s", F.when(F.col("v") == 0, F.col("ts")))
    out = scale.segment_start(marked, ["k"], ["ts", "id"], "s", scale.time_chunk("ts", 300), "start")
    for r in out.collect():
        earlier = [t for k, t, i, v in rows if k == r["k"] and v == 0 and (t, i) <= (r["ts"], r["id"])]
        assert r["start"] == (max(earlier) if earlier else None)


def test_quantiles_interpolate(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    values = [float(round(v, 2)) for v in rng.exponential(5, 501)]
    df = spark.createDataFrame([("m", v) for v in values], "k string, v double")
    row = quantiles(df, ["k"], "v", {"p05": 0.05, "p50": 0.5, "p99": 0.99}).first()
    for name, q in (("p05", 5), ("p50", 50), ("p99", 99)):
        assert row[name] == pytest.approx(np.percentile(values, q))
    whole = quantiles(df, [], "v", {"q": 0.95}).first()
    assert whole["q"] == pytest.approx(np.percentile(values, 95))


def test_split_is_exact_per_class_and_stable(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("id"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    out = stratified_split(df, "y", 0.2)
    counts = {r["y"]: r["n"] for r in out.filter("is_validation").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert counts == {0: 180, 1: 20}
    again = stratified_split(df.repartition(7), "y", 0.2)
    assert out.filter("is_validation").select("id").exceptAll(again.filter("is_validation").select("id")).isEmpty()
    assert df.select(F.count_distinct(seeded_hash(42))).first()[0] == 1000


def test_split_share_is_clamped(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit(0).alias("y"))
    assert stratified_split(df, "y", 0.9).filter("is_validation").count() == 40
    assert stratified_split(df, "y", 0.0).filter("is_validation").count() == 10


def test_broadcast_only_when_small(spark):
    small, large = spark.range(10), spark.range(100)
    plan = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in plan(scale.broadcast_if_small(small, 20)).lower()
    assert "broadcast" not in plan(scale.broadcast_if_small(large, 20)).lower()


@pytest.mark.parametrize("limit", [1, 5, 12, 13, 16, 40])
def test_training_rows_leave_older_texts_alone(spark, limit):
    """The page is that of a full sort, with repeated and missing ids and times; the text of a row behind it is a division by
    zero."""
    rows = [(f"{i:02d}", START - timedelta(minutes=i // 2), str(i)) for i in range(12)]
    rows += [(None, START - timedelta(minutes=9), "12"), ("30", START - timedelta(minutes=9), "13"), (None, None, "14"), ("31", None, "15")]
    kept = spark.createDataFrame(rows, "id string, ts timestamp, user_name string").repartition(4)
    wide = kept.withColumns({"activity_type": F.lit("A"), "risk_level": F.lit("LOW")})
    behind = F.col("user_name").cast("int") >= limit
    logs = wide.withColumn("description", F.when(behind, (F.lit(1) / (F.length("risk_level") - 3)).cast("string")).otherwise("text"))
    got = scans.training_rows(logs, limit).collect()
    assert [int(r["user_name"]) for r in got] == list(range(min(limit, len(rows)))) and {r["description"] for r in got} == {"text"}
    assert scans.training_rows(logs.limit(0), limit).collect() == []
