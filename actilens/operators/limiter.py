"""Greedy sliding-window limiter in parallel cells, for a key that is never quiet.

Let A(n) be the number of admitted rows among the first n of a key, and p(n) the last row that is at least one window older than
row n. A row is admitted if fewer than ``limit`` are in its window, so A(n) = min(A(n - 1) + 1, A(p(n)) + limit): a shortest
path, and so a function of a time cell that can be composed. What a cell needs of the time before is where A rises in the last
window; its *jump table* says for every row of that window what the limiter does to the cell if it starts empty right
behind that row. The state behind a cell is the least of at most ``limit`` + 1 of its entries.

Tables of cells are composed in pairs, pairs of pairs and so on; on the way down each cell gets the state in which it begins,
and all cells are then admitted side by side. One key with all rows is as many tasks as it has cells.

A state is the list ``last`` of the admitted rows of the last window, the newest first, each as the number of rows of that window
behind it; ``e`` counts a start in the same way, and ``total`` the rows admitted since the start.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actilens.session import cut_lineage

#: Rows of a cell, about. A cell is one window at least.
CELL_ROWS = 100_000
#: The largest limit that a jump table is made for; its entries are as wide as the limit.
MOST = 256
TABLE = "_key string, _cell long, e long, total long, last array<long>"


def jump_table(entry: np.ndarray, own: np.ndarray, limit: int, window: int, end: int) -> tuple[np.ndarray, list[list[int]]]:
    """``total`` and ``last`` of a cell for the starts behind the newest, second newest, ... row of the window before it
    (``entry``) and before all of them; ``own`` are the times of the cell, which ends at ``end``. All starts walk together."""
    t = np.concatenate([entry, own])
    padded, starts = np.append(t, 0), len(entry) + 1
    nxt = np.arange(len(entry), -1, -1)
    ring = np.full((starts, limit), -1, np.int64)
    total, active, step = np.zeros(starts, np.int64), np.arange(starts), 0
    while len(active):
        oldest = ring[active, step % limit]
        free = np.where(oldest >= 0, padded[oldest] + window, np.iinfo(np.int64).min)
        found = np.maximum(nxt[active], np.searchsorted(t, free))
        alive = found < len(t)
        active, found = active[alive], found[alive]
        ring[active, step % limit] = found
        nxt[active] = found + 1
        total[active] += 1
        step += 1
    ring = -np.sort(-ring, axis=1)
    kept = ring >= np.searchsorted(t, end - window, side="right")
    behind = (len(t) - 1 - ring).tolist()
    return total, [row[:n] for row, n in zip(behind, kept.sum(axis=1).tolist())]


def _cell_table(group: pa.Table) -> pa.Table:
    group = group.sort_by("_micros")
    times, before = group.column("_micros").to_numpy(), group.column("_entry").to_numpy(zero_copy_only=False).astype(bool)
    one = {c: group.column(c)[0].as_py() for c in ("_key", "_cell", "_limit", "_span", "_end")}
    total, last = jump_table(times[before], times[~before], one["_limit"], one["_span"], one["_end"])
    n = len(total)
    return pa.table({
        "_key": pa.array([one["_key"]] * n), "_cell": pa.array([one["_cell"]] * n), "e": pa.array(np.arange(n)), "total": pa.array(total),
        "last": pa.array(last, pa.list_(pa.int64())),
    })


def _least(found: Column) -> tuple[Column, Column]:
    """``total`` and ``last`` of the least of several step functions given by (total, last)."""
    total = F.array_min(F.transform(found, lambda x: x["total"]))
    longest = F.array_max(F.transform(found, lambda x: F.size(x["last"])))
    at = lambda r: F.array_min(F.transform(found, lambda x: F.get(x["last"], (x["total"] - total + r).cast("int"))))
    ranks = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))
    return total, F.filter(F.transform(ranks, at), lambda s: s.isNotNull())


def applied(states: DataFrame, tables: DataFrame) -> DataFrame:
    """``states`` (``_key``, ``_cell``, ``e``, ``total``, ``last`` at the begin of a cell) moved to its end by the cell's table."""
    levels = F.transform("last", lambda s, i: F.struct((s + 1).alias("x"), (F.col("total") - i - 1).alias("t")))
    sources = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("x"), F.col("total").alias("t"))), levels)
    wanted = states.select("_key", "_cell", F.col("e").alias("start"), F.inline(sources))
    entries = tables.select("_key", "_cell", F.col("e").alias("x"), F.col("total").alias("more"), F.col("last"))
    met = wanted.join(entries, ["_key", "_cell", "x"])
    # At most limit + 1 entries for each start.
    found = met.groupBy("_key", "_cell", "start").agg(F.collect_list(F.struct((F.col("t") + F.col("more")).alias("total"), "last")).alias("f"))
    total, last = _least(F.col("f"))
    return found.select("_key", "_cell", F.col("start").alias("e"), total.alias("total"), last.alias("last"))


def entry_states(tables: DataFrame, cells: int) -> DataFrame:
    """``_key``, ``_cell``, ``last`` at the begin of every cell, for keys of at most ``cells`` cells from 0 on."""
    levels = [tables]
    while cells > 1:
        below = levels[-1]
        left, right = below.where("_cell % 2 = 0"), below.where("_cell % 2 = 1").withColumn("_cell", F.col("_cell") - 1)
        paired = applied(left, right)
        alone = left.join(right.select("_key", "_cell").distinct(), ["_key", "_cell"], "left_anti")
        levels.append(cut_lineage(paired.unionByName(alone).withColumn("_cell", F.expr("_cell div 2"))))
        cells = (cells + 1) // 2
    zero = F.lit(0).cast("long")
    states = levels[-1].select("_key", "_cell").distinct().withColumn("last", F.array().cast("array<long>"))
    for below in reversed(levels[:-1]):
        left = states.withColumn("_cell", F.col("_cell") * 2)
        there = below.where("_cell % 2 = 1").select("_key", "_cell").distinct()
        right = applied(left.withColumns({"e": zero, "total": zero}), below).withColumn("_cell", F.col("_cell") + 1)
        right = right.join(there, ["_key", "_cell"], "left_semi").select("_key", "_cell", "last")
        states = cut_lineage(left.unionByName(right))
    return states


def admit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk sorted rows and admit at most ``_limit`` per sliding window of ``_span`` and (``_key``, ``_cell``).

    Rows with ``_entry`` are the window before a cell: the admitted ones among them are told by ``_last``. Only these times and
    the last admitted times of the current cell are held, whatever the length of its run.
    """
    current, admitted, before = None, deque(), []
    for batch in batches:
        if not batch.num_rows:
            continue
        of = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
        keys, cells, entries, times, limits, windows = map(of, ("_key", "_cell", "_entry", "_micros", "_limit", "_span"))
        entries = entries.astype(bool)
        allowed = np.zeros(len(keys), dtype=bool)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (cells[1:] != cells[:-1]) | (entries[1:] != entries[:-1])) + 1
        for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
            span, limit, window = times[lo:hi], limits[lo], windows[lo]
            if (keys[lo], cells[lo]) != current:
                current, admitted, before = (keys[lo], cells[lo]), deque(), []
            if entries[lo]:
                before.append(span)
                continue
            if before:
                held = np.concatenate(before)
                admitted, before = deque(held[len(held) - 1 - k] for k in reversed(batch.column("_last")[int(lo)].as_py())), []
            i = 0
            while i < len(span):
                while admitted and admitted[0] <= span[i] - window:
                    admitted.popleft()
                if len(admitted) < limit:
                    admitted.append(span[i])
                    allowed[lo + i] = True
                    i += 1
                else:
                    i = int(np.searchsorted(span, admitted[0] + window, side="left"))
        out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed)], [*batch.schema.names, "allowed"])
        yield out.filter(pa.array(~entries))


def with_states(rows: DataFrame, cell_rows: int) -> DataFrame:
    """Rows of busy keys (``_key``, ``_micros``, ``_limit``, ``_span`` in microseconds, and ``_from``, ``_to``, ``_n`` of the key) with
    their ``_cell``, its begin state ``_last``, and the rows of the window before it as further rows with ``_entry``."""
    length = F.col("_span") * F.least(F.lit(4096), F.greatest(F.lit(1), F.floor(cell_rows * (F.col("_to") - F.col("_from") + 1) / (F.col("_span") * F.col("_n")))))
    celled = rows.withColumn("_length", length.cast("long")).withColumns({
        "_cell": F.expr("(_micros - _from) div _length"), "_entry": F.lit(False),
    }).withColumn("_end", F.col("_from") + (F.col("_cell") + 1) * F.col("_length"))
    narrow = celled.select("_key", "_cell", "_micros", "_entry", "_limit", "_span", "_end", "_length", (F.expr("(_to - _from) div _length") + 1).alias("_cells"))
    narrow = cut_lineage(narrow)
    most = narrow.agg(F.max("_cells")).first()[0]
    late = narrow.where((F.col("_micros") > F.col("_end") - F.col("_span")) & (F.col("_cell") + 1 < F.col("_cells")))
    entry = late.withColumns({"_cell": F.col("_cell") + 1, "_entry": F.lit(True), "_end": F.col("_end") + F.col("_length")})
    tables = cut_lineage(narrow.unionByName(entry).groupBy("_key", "_cell").applyInArrow(_cell_table, TABLE))
    states = entry_states(tables, most).withColumnRenamed("last", "_last")
    kept = [*rows.columns, "_cell", "_entry"]
    entry = entry.select("_key", "_cell", "_micros", "_entry", "_limit", "_span")
    return celled.select(kept).unionByName(entry, allowMissingColumns=True).join(states, ["_key", "_cell"])
