"""Building blocks that keep ordered work distributed when one key holds a large share of the rows.

* ``running_totals``: global or per-key running sums without a one-task window.
* ``dictionary_join``: look-ups of values of which one may hold most rows.
* ``with_neighbour``: ``lag``/``lead`` per key, evaluated per (key, time chunk) and stitched at the seams.
* ``segment_start``: start time of the current run of rows, evaluated the same way.
* ``broadcast_if_small``: a broadcast hint only after the row count was checked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actilens.session import cut_lineage


def broadcast_if_small(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """Hint a broadcast when ``df`` is known to hold at most ``max_rows`` rows, else leave it alone."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def time_chunk(ts: str | Column, seconds: int) -> Column:
    """Number of the fixed-width time chunk a timestamp falls in."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_micros(column) / F.lit(seconds * 1_000_000)).cast("long")


def running_totals(df: DataFrame, keys: Sequence[str], order: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """Inclusive running sums ``cum_<c>`` over ``order`` within ``keys``.

    ``df`` must hold one row per (keys, order); callers aggregate to distinct values first. Rows are
    dealt over ranges of (keys, order), as many as their bytes ask for, and stored with the number of
    their range. Each range is summed in its own task, and only the totals of the ranges pass through
    a window over their numbers.
    """
    keys = list(keys)
    step = F.col(order).desc() if descending else F.col(order).asc()
    dealt = cut_lineage(df.repartitionByRange(*keys, step).withColumn("_range", F.spark_partition_id()))
    totals = dealt.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = (
        Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums]
    )
    upto = (
        Window.partitionBy(*keys, "_range")
        .orderBy(step)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = dealt.withColumns({f"_s_{c}": F.sum(c).over(upto) for c in sums})
    return summed.join(offsets, [*keys, "_range"]).select(
        *df.columns, *[(F.col(f"_s_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums]
    )


def dictionary_join(df: DataFrame, table: DataFrame, key: str, max_bytes: int = 32 << 20, salts: int = 32) -> DataFrame:
    """Left join with a table of one row per ``key``, for keys of which one may hold most rows.

    A table whose bytes are counted to be at most ``max_bytes`` is broadcast. A larger one is repeated for
    each salt, and the rows of a key are dealt over the salts by the task they come from, so that a
    frequent key is as many tasks as there are salts.
    """
    wide = [F.octet_length(F.col(c).cast("string")) for c in table.columns]
    size = table.agg(F.sum(sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(32)))).first()[0] or 0
    if size <= max_bytes:
        return df.join(F.broadcast(table), key, "left")
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts))).join(repeated, [key, "_salt"], "left").drop("_salt")


def with_neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    chunk: Column,
    following: bool,
    name: str,
) -> DataFrame:
    """Add struct ``name`` with ``values`` of the next (or previous) row of the same key.

    A key is cut into (key, chunk) groups, so a key with a third of all rows is spread over many
    tasks. Only one row per group, the one at the seam, is looked up across chunks.
    """
    keys = list(keys)
    base = df.withColumn("_chunk", chunk)
    local = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    whole = local.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    packed = F.struct(*values)
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_chunk")
    if following:
        marked = base.withColumn(name, F.lead(packed).over(local)).withColumn("_seam", F.first(packed).over(whole))
        stitched = F.lead("_seam").over(across)
    else:
        marked = base.withColumn(name, F.lag(packed).over(local)).withColumn("_seam", F.last(packed).over(whole))
        stitched = F.lag("_seam").over(across)
    inside = marked.filter(F.col(name).isNotNull())
    seams = marked.filter(F.col(name).isNull()).withColumn(name, stitched)
    return inside.unionByName(seams).drop("_chunk", "_seam")


def segment_start(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], starts: str, chunk: Column, name: str
) -> DataFrame:
    """Latest non-null ``starts`` (a time that grows with the order) at or before each row of a key."""
    keys = list(keys)
    base = df.withColumn("_chunk", chunk)
    local = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        base.groupBy(*keys, "_chunk")
        .agg(F.max(starts).alias("_m"))
        .select(*keys, "_chunk", F.max("_m").over(earlier).alias("_carried"))
    )
    return (
        base.withColumn(name, F.max(starts).over(local))
        .join(carried, [*keys, "_chunk"])
        .withColumn(name, F.coalesce(name, "_carried"))
        .drop("_chunk", "_carried")
    )
