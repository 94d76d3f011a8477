"""User-to-address graph: risk-weighted edges, nodes, filters and degrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actilens.functions.risk import edge_rank

SHOWN_LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def edges(logs: DataFrame) -> DataFrame:
    """One edge per (user, address) with the highest risk seen; ties keep the earliest."""
    named = logs.filter((F.coalesce("user_name", F.lit("")) != "") & (F.coalesce("ip_address", F.lit("")) != ""))
    return (
        named.groupBy("user_name", "ip_address")
        .agg(F.min_by("risk_level", F.struct(-edge_rank(F.col("risk_level")), F.col("ts"), F.col("id"))).alias("risk_level"))
        .select(
            F.concat(F.lit("user-"), "user_name").alias("source"),
            F.concat(F.lit("ip-"), "ip_address").alias("target"),
            "user_name", "ip_address", "risk_level",
        )
    )


def nodes(links: DataFrame) -> DataFrame:
    people = links.select(F.col("source").alias("node_id"), F.lit("USER").alias("type"), F.col("user_name").alias("label"))
    hosts = links.select(F.col("target").alias("node_id"), F.lit("IP").alias("type"), F.col("ip_address").alias("label"))
    return people.distinct().unionByName(hosts.distinct())


def filter_edges(links: DataFrame, levels: Sequence[str] = SHOWN_LEVELS, search: str = "") -> DataFrame:
    """Edges of enabled levels whose user or address contains the search text."""
    allowed = [x for x in levels if x in SHOWN_LEVELS]
    kept = links.filter(F.col("risk_level").isin(allowed))
    needle = search.strip().lower()
    if not needle:
        return kept
    return kept.filter(F.lower("user_name").contains(needle) | F.lower("ip_address").contains(needle))


def visible_nodes(all_nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Nodes that are an endpoint of a kept edge."""
    ends = links.select(F.explode(F.array("source", "target")).alias("node_id")).distinct()
    return all_nodes.join(ends, "node_id", "left_semi")


def incident_edges(links: DataFrame, node_id: str) -> DataFrame:
    return links.filter((F.col("source") == node_id) | (F.col("target") == node_id))


def first_incident_edges(links: DataFrame, n: int = 8) -> DataFrame:
    """First ``n`` edges of every node, trimmed in each map task before the shuffle."""
    ends = links.select("source", "target", "risk_level", F.explode(F.array("source", "target")).alias("node_id"))
    w = Window.partitionBy("node_id").orderBy("source", "target")
    return ends.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def graph_counts(all_nodes: DataFrame, links: DataFrame) -> DataFrame:
    paths = links.agg(F.count("*")).scalar()
    return all_nodes.agg(F.count("*").alias("n_nodes")).withColumn("n_paths", paths)


def degrees(links: DataFrame) -> DataFrame:
    return links.select(F.explode(F.array("source", "target")).alias("node_id")).groupBy("node_id").agg(
        F.count("*").alias("degree")
    )
