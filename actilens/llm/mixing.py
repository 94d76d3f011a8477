"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

The documents of a source form blocks of ``block_docs``, in the order of a hash of their id. A source of weight w (a share of
all weights) gives its block j (from 0) the window from floor(j / w) to ceil((j + 1) / w), and in each slot the released block
with the earliest deadline goes first (ties: the source's name). All windows are met, so after any number of slots each source
is less than one block away from its weight. Weights are whole numbers of about ``RESOLUTION`` in sum, so windows
are exact and a given weight is met to a few billionths, over the whole run: there is no period and no limit on sources.

Earliest deadline first goes slot by slot, so a long run is cut into cells of at least the longest window (H slots), which are
scheduled side by side. The state at a cut comes from a run of the rule over the H slots before it, begun with the fluid
schedule rounded to the earliest deadlines; from such a state all later windows can be met, and what was released before
the H slots is served in them, so the blocks between the states of two neighbouring cuts fit into their cell: each
interval of slots holds no more windows than slots, and earliest deadline first, with deadlines cut to the cell, finds the places.

A source whose blocks have run out leaves its slots empty, and the others keep theirs; nothing is repeated or dropped.

Defined cases: null is a source of its own; a null id sorts with the hash of the empty text; documents with the same id are
ordered by a hash of the whole row, and rows that are the same in all columns may change places; a source without a given
weight gets ``LEAST`` of all; an empty table gives an empty result; a text of any length travels as it is; other columns
travel along in a struct, so their names cannot clash. A run of more than 2 ** 30 slots is an overflow error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actilens.llm.common import partitions

BLOCK_DOCS = 16
#: Sum of the whole-number weights, about.
RESOLUTION = 1 << 32
#: Share of a source whose weight is not given.
LEAST = 1.0 / (1 << 16)
#: Slots of a cell at least.
CELL_SLOTS = 4096
#: Slots whose picks are collected before they join the others of the cell.
SEGMENT = 512


def _source_key(column: str) -> Column:
    """The source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def whole_weights(counts: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``s``, ``n`` and ``weight`` (a whole number, at least 1) for the sources in ``counts`` (``s``, ``n``).

    ``weights`` (``source``, ``weight``) are the targets; without them a source weighs the square root of its documents,
    which lets small sources count for more and keeps the order of sizes.
    """
    if weights is None:
        weighed = counts.withColumn("w", F.sqrt("n"))
    else:
        given = weights.groupBy(_source_key("source").alias("s")).agg(F.max(F.col("weight").cast("double")).alias("w"))
        weighed = counts.join(given.where("w > 0"), "s", "left")
        every = F.coalesce(F.sum("w").over(Window.partitionBy()), F.lit(1.0))  # one row for each source
        weighed = weighed.withColumn("w", F.coalesce("w", LEAST * every))
    total = F.sum("w").over(Window.partitionBy())
    return weighed.select("s", "n", F.greatest(F.lit(1), F.round(F.lit(float(RESOLUTION)) * F.col("w") / total)).cast("long").alias("weight"))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once, also where it is used inside other lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def _earliest(line: Column, a: Column, total: Column, left: Column | None = None, quota: Column | None = None) -> Column:
    """Number of the released source with the earliest deadline. ``a`` is for each source what the fluid schedule is ahead of
    the served blocks, in parts of ``total``; ``left`` cuts deadlines, ``quota`` are the blocks that may still be served."""

    def key(x: Column, i: Column) -> Column:
        weight = F.get(line, i)["weight"]
        deadline = _div(total - x + weight - 1, weight)
        ready = x + weight > 0
        if left is not None:
            deadline, ready = F.least(deadline, left), ready & (F.get(quota, i) > 0)
        return F.when(ready, F.struct(deadline.alias("d"), i.alias("i")))

    return F.array_min(F.transform(a, key))["i"]


def _steps(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(1).cast("long"), n)).otherwise(F.array().cast("array<long>"))


def _cut_state(line: Column, total: Column, longest: Column, t: Column) -> Column:
    """What the fluid schedule is ahead of each source's blocks at slot ``t``: the fluid state ``longest`` slots before, rounded to
    the earliest deadlines, and the rule from there on."""
    begin = F.greatest(F.lit(0).cast("long"), t - longest)
    fluid = F.transform(line, lambda x: F.pmod(begin * x["weight"], total))

    def rounded(f: Column) -> Column:
        due = F.transform(f, lambda x, i: F.when(x > 0, F.struct(_div(total - x + F.get(line, i)["weight"] - 1, F.get(line, i)["weight"]).alias("d"), i.alias("i"))))
        ahead = _div(F.aggregate(f, F.lit(0).cast("long"), lambda s, x: s + x), total).cast("int")
        first = F.slice(F.array_sort(F.filter(due, lambda x: x.isNotNull())), 1, ahead)
        served = F.transform(first, lambda x: x["i"])
        return _bound(served, lambda e: F.transform(f, lambda x, i: x - F.when(F.array_contains(e, i), total).otherwise(0)))

    def step(a: Column, _: Column) -> Column:
        return _bound(_earliest(line, a, total), lambda n: F.transform(a, lambda x, i: x + F.get(line, i)["weight"] - F.when(i == n, total).otherwise(0)))

    return F.aggregate(_steps(t - begin), _bound(fluid, rounded), step)


def _cell_picks(line: Column, total: Column, state: Column, quota: Column, slots: Column, clipped: Column) -> Column:
    """The source of each slot of a cell: ``slots`` picks from ``state`` on, deadlines cut to the cell if ``clipped``."""

    def step(s: Column, k: Column) -> Column:
        left = F.when(clipped, slots - s["t"]).otherwise(F.lit(1 << 62))
        return _bound(_earliest(line, s["a"], total, left, s["q"]), lambda n: F.struct(
            F.transform(s["a"], lambda x, i: x + F.get(line, i)["weight"] - F.when(i == n, total).otherwise(0)).alias("a"),
            F.transform(s["q"], lambda x, i: x - F.when(i == n, 1).otherwise(0)).alias("q"),
            (s["t"] + 1).alias("t"), F.concat(s["picks"], F.array(n)).alias("picks"),
        ))

    def segment(s: Column, m: Column) -> Column:
        none = F.array().cast("array<int>")
        begun = F.struct(s["a"].alias("a"), s["q"].alias("q"), s["t"].alias("t"), none.alias("picks"))
        done = F.aggregate(_steps(F.least(F.lit(SEGMENT).cast("long"), slots - (m - 1) * SEGMENT)), begun, step)
        return _bound(done, lambda d: F.struct(d["a"].alias("a"), d["q"].alias("q"), d["t"].alias("t"), F.concat(s["all"], F.array(d["picks"])).alias("all")))

    start = F.struct(state.alias("a"), quota.alias("q"), F.lit(0).cast("long").alias("t"), F.array().cast("array<array<int>>").alias("all"))
    return F.flatten(F.aggregate(_steps(_div(slots + SEGMENT - 1, F.lit(SEGMENT))), start, segment)["all"])


def slot_table(weighed: DataFrame, block_docs: int = BLOCK_DOCS, cell_slots: int = CELL_SLOTS) -> DataFrame:
    """``s``, ``weight``, ``total``, ``block``, ``slot`` of every slot up to the last that a document needs, a row for each.

    One row holds all sources; it is repeated for each cell, and cells are scheduled in tasks of their own.
    """
    spark = weighed.sparkSession
    line = weighed.agg(F.sort_array(F.collect_list(F.struct("s", "weight", "n"))).alias("line")).where("size(line) > 0")
    line = line.withColumn("total", F.aggregate("line", F.lit(0).cast("long"), lambda a, x: a + x["weight"]))
    total = F.col("total")
    blocks = lambda x: _div(x["n"] + block_docs - 1, F.lit(block_docs))
    line = line.withColumns({
        "longest": F.array_max(F.transform("line", lambda x: _div(total + x["weight"] - 1, x["weight"]))),
        "slots": F.array_max(F.transform("line", lambda x: _div(blocks(x) * total + x["weight"] - 1, x["weight"]))),
    }).withColumn("k", F.greatest(F.lit(cell_slots).cast("long"), "longest"))
    cells = line.withColumn("cells", _div(F.col("slots") + F.col("k") - 1, F.col("k"))).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    dealt = cells.repartition(partitions(spark), "cell").withColumns({
        "begin": F.col("cell") * F.col("k"), "size": F.least("k", F.col("slots") - F.col("cell") * F.col("k")), "last": F.col("cell") + 1 == F.col("cells"),
    })
    cut = lambda t: _cut_state(F.col("line"), total, F.col("longest"), t)
    states = dealt.withColumn("at", cut(F.col("begin"))).withColumn("next", F.when(~F.col("last"), cut(F.col("begin") + F.col("size"))))
    quota = F.when(F.col("last"), F.transform("line", lambda x: F.lit(1 << 62))).otherwise(
        F.transform("line", lambda x, i: _div(F.col("size") * x["weight"] - F.get("next", i) + F.get("at", i), total))
    )
    picked = states.withColumn("picks", _cell_picks(F.col("line"), total, F.col("at"), quota, F.col("size"), ~F.col("last")))
    served = F.transform("line", lambda x, i: _div(F.col("begin") * x["weight"] - F.get("at", i), total))
    each = picked.select("line", "total", "cell", "begin", served.alias("served"), F.posexplode("picks").alias("t", "i"))
    inside = F.row_number().over(Window.partitionBy("cell", "i").orderBy("t"))
    return each.withColumn("r", inside).select(
        F.get("line", F.col("i"))["s"].alias("s"), F.get("line", F.col("i"))["weight"].alias("weight"), "total",
        (F.get("served", F.col("i")) + F.col("r") - 1).alias("block"), (F.col("begin") + F.col("t")).alias("slot"),
    )


def schedule(
    docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id", source_col: str = "source",
    block_docs: int = BLOCK_DOCS, cell_slots: int = CELL_SLOTS,
) -> DataFrame:
    """The schedule of every document: ``row`` (all its columns), ``weight``, ``total`` (the sum of all weights), ``block``,
    ``release``, ``deadline``, ``slot`` and ``place`` (its number in the block).

    A document's rank in its source comes from (source, range of hashes) groups: counts of the groups are added up per
    source, and rows are numbered inside a group, so a source with a third of all rows is many tasks. Slots come to a group
    as one array, so rows are shuffled once.
    """
    chunks = min(65_536, max(16, 2 * partitions(docs.sparkSession)))
    ident = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    chunk = F.floor(F.conv(F.substring("h", 1, 4), 16, 10).cast("long") * chunks / 65_536)
    rows = docs.select(F.struct("*").alias("row"), _source_key(source_col).alias("s"), ident.alias("h")).withColumn("c", chunk)
    counts = rows.groupBy("s", "c").agg(F.count("*").alias("n"))
    before = Window.partitionBy("s").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("s", "c", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    slots = slot_table(whole_weights(counts.groupBy("s").agg(F.sum("n").alias("n")), weights), block_docs, cell_slots)
    first, last = _div(F.col("before"), F.lit(block_docs)), _div(F.col("before") + F.col("n") - 1, F.lit(block_docs))
    blocks = offsets.select("s", "c", "before", first.alias("first"), F.explode(F.sequence(first, last)).alias("block"))
    placed = blocks.join(slots, ["s", "block"]).groupBy("s", "c").agg(
        F.first("before").alias("before"), F.first("first").alias("first"), F.first("weight").alias("weight"), F.first("total").alias("total"),
        F.transform(F.array_sort(F.collect_list(F.struct("block", "slot"))), lambda x: x["slot"]).alias("slots"),
    )
    inside = Window.partitionBy("s", "c").orderBy("h", F.col(f"row.`{id_col}`"), F.xxhash64("row"))
    ranked = rows.withColumn("inside", F.row_number().over(inside) - 1).join(placed, ["s", "c"]).withColumn("rank", F.col("before") + F.col("inside"))
    ranked = ranked.withColumn("block", _div(F.col("rank"), F.lit(block_docs)))
    return ranked.select(
        "row", "weight", "total", "block", F.expr("block * total div weight").alias("release"), F.expr("((block + 1) * total + weight - 1) div weight").alias("deadline"),
        F.get("slots", (F.col("block") - F.col("first")).cast("int")).alias("slot"), (F.col("rank") - F.col("block") * block_docs).cast("int").alias("place"),
    )


def schedule_rows(docs: DataFrame) -> DataFrame:
    """The rows of query op6."""
    out = schedule(docs.select("doc_id", "source"))
    return out.select("row.doc_id", "row.source", "weight", "block", "release", "deadline", "slot", "place")


def mixed(docs: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """``docs`` in the order of the schedule: written files, taken in order, hold the mix."""
    return schedule(docs, weights).orderBy("slot", "place").select("row.*")


#: The schedule in SQL: whole weights from square roots, then earliest deadline first slot by slot, for a run of one cell.
SCHEDULE_SQL = f"""
with recursive
k as (select doc_id, source, coalesce('=' || source, '') as s, md5(coalesce(doc_id::varchar, '')) as h from documents),
n as (select s, count(*) as n, sqrt(count(*)) as w from k group by s),
sh as (select s, n, greatest(1, round({RESOLUTION}.0 * w / (select sum(w) from n)))::bigint as weight from n),
l as (select list(weight order by s) as a, list(s order by s) as names, sum(weight)::bigint as total,
  max(((n + {BLOCK_DOCS - 1}) // {BLOCK_DOCS} * (select sum(weight)::bigint from sh) + weight - 1) // weight)::bigint as slots from sh),
pick(t, done, i) as (
  select -1::bigint, list_transform(a, lambda x: 0::bigint), 0::bigint from l
  union all
  select t, list_transform(done, lambda x, n: case when n = i then x + 1 else x end), i from (
    select t, done, list_position(d, list_min(d))::bigint as i from (
      select pick.t + 1 as t, done, list_transform(range(1, len(a) + 1), lambda i:
        case when done[i] * total // a[i] <= pick.t + 1 then ((done[i] + 1) * total + a[i] - 1) // a[i] else {2**62} end) as d
      from pick, l where pick.t + 1 < slots))
),
o as (select names[i] as s, t, row_number() over (partition by i order by t) - 1 as block from pick, l where t >= 0),
r as (select doc_id, source, s, row_number() over (partition by s order by h, doc_id) - 1 as rank from k),
b as (select r.*, rank // {BLOCK_DOCS} as block, rank % {BLOCK_DOCS} as place from r)
select doc_id, source, weight, block, block * total // weight as release, ((block + 1) * total + weight - 1) // weight as deadline,
  o.t as slot, place::integer as place
from b join sh using (s) join o using (s, block) cross join l
"""
