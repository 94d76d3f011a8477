"""Connected components of a link table by alternating star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actilens.llm.common import shuffled, stored


def _both(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, in one pass over ``edges``."""
    pairs = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    return edges.select(F.inline(pairs))


def _lowest(edges: DataFrame) -> DataFrame:
    """Each end u of the directed edges (u, v) with the lowest of u and its neighbours."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def _state(edges: DataFrame) -> tuple:
    """Number and sum of hashes of the edges: equal once a round changes nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (the lowest node reachable) for each node in an edge (a, b), a != b, that is not its own root.

    Large-star links the higher neighbours of a node to its lowest neighbour, small-star the lower ones; the table of
    edges becomes a forest of stars after a number of rounds that grows with the logarithm of the longest path. Minima
    are combined in the map tasks and met by a join that AQE may split, so a node with very many links is no hot task.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = _both(edges)
        large = (
            both.join(shuffled(_lowest(both)), "u").filter("v > u and v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        )
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = _lowest(down)
        small = (
            down.join(shuffled(low), "u").select(F.inline(F.array(
                F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")),
            ))).filter("a <> b").distinct()
        )
        edges = stored(small, "edges")
        state, before = _state(edges), state
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
