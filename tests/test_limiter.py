"""The limiter of a key that is never quiet, in cells, against the greedy walk."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from actilens.operators import limiter, rules
from tests.test_rules import greedy

START = datetime(2026, 1, 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 4), st.integers(5, 9))
def test_least_of_the_table_is_the_greedy_state(steps, limit, window):
    """A cut anywhere: the state before it, put through the table of what follows, is the state at the end."""
    times = np.cumsum(steps)
    begin = int(times[0]) + window
    end = max(int(times[-1]) + 1, begin + window)
    flags = np.array(greedy(times.tolist(), limit, window))
    entry = times[(times > begin - window) & (times < begin)]
    admitted = times[flags]
    total, last = limiter.jump_table(entry, times[times >= begin], limit, window, end)
    held = np.flatnonzero(flags[(times > begin - window) & (times < begin)])
    sources = [(0, 0), *((len(entry) - int(k), -1 - v) for v, k in enumerate(held[::-1]))]
    found = [(t + total[e], last[e]) for e, t in sources]
    least = min(t for t, _ in found)
    at = [[f[t - least + r] for t, f in found if t - least + r < len(f)] for r in range(limit)]
    assert least == (admitted >= begin).sum()
    behind = len(times) - 1 - np.flatnonzero(flags & (times > end - window))[::-1]
    assert [min(x) for x in at if x] == behind.tolist()


@pytest.mark.parametrize("limit,window,n,step,cell", [(1, 20, 600, 3, 10), (3, 60, 900, 12, 25), (4, 10, 700, 2, 1), (5, 90, 400, 30, 60), (2, 7, 500, 6, 9)])
def test_one_busy_key_in_many_tasks(spark, limit, window, n, step, cell):
    rng = random.Random(limit * window)
    now, rows = 0, []
    for k in range(n):
        now += min(rng.choice([0, 0, 1, rng.randint(0, step)]), window - 1)  # never quiet for a window
        rows.append(("all", START + timedelta(seconds=now), f"{k:05d}", k if k % 5 else None))
    rows += [(f"k{j}", START + timedelta(seconds=rng.randint(0, 500)), f"{j:05d}", 2**60 + 1) for j in range(30)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, id string, big long").repartition(3)
    out = rules.rate_limit(df, ["k"], F.lit(limit), F.lit(window), busy_rows=50, cell_rows=cell)
    assert out.columns == [*df.columns, "allowed"]
    joined_up = "spark.sql.adaptive.coalescePartitions.enabled"  # small partitions stay apart, as large ones do
    spark.conf.set(joined_up, "false")
    try:
        got = {(r.k, r.id): r for r in out.withColumn("task", F.spark_partition_id()).collect()}
    finally:
        spark.conf.set(joined_up, "true")
    assert len(got) == len(rows) and all(got[k, i].big == big for k, _, i, big in rows)
    seconds = [int((t - START).total_seconds()) for k, t, *_ in rows if k == "all"]
    assert [got["all", f"{k:05d}"].allowed for k in range(n)] == greedy(seconds, limit, window)
    assert len({r.task for (k, _), r in got.items() if k == "all"}) > 1
