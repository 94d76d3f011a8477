"""Network flows: admission, de-duplication, counter rates, byte allocation, pair counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actilens.operators.scans import on_interface
from actilens.scale import time_chunk, with_neighbour

MAX_FLOWS_PER_CYCLE = 100
BYTES_PER_PACKET = 1200
FLOW_KEY = ["local_ip", "remote_ip", "remote_port", "protocol"]
LOCAL_NAMES = ("localhost", "127.0.0.1", "::1")


def is_loopback(ip: Column) -> Column:
    return ip.startswith("127.") | (ip == "::1")


def is_inbound(destination: Column) -> Column:
    return destination.startswith("192.168")


def admitted_flows(
    connections: DataFrame,
    addresses: DataFrame | None = None,
    interface: str | None = None,
    protocols: Sequence[str] = ("TCP", "UDP"),
    include_loopback: bool = False,
    ingest_host: str = "localhost",
    ingest_port: int = 8000,
) -> DataFrame:
    """Connections worth recording: both ends known, wanted protocol and interface, not our own traffic."""
    local, remote, port = F.col("local_ip"), F.col("remote_ip"), F.col("remote_port")
    kept = connections.filter(
        (F.coalesce(local, F.lit("")) != "") & (F.coalesce(remote, F.lit("")) != "") & (F.coalesce(port, F.lit(0)) != 0)
    )
    own_host = remote == ingest_host
    if ingest_host in LOCAL_NAMES:
        own_host = own_host | is_loopback(remote)
    kept = kept.filter(~((port == ingest_port) & own_host)).filter(F.col("protocol").isin(*protocols))
    if not include_loopback:
        kept = kept.filter(~is_loopback(local) & ~is_loopback(remote))
    if interface and addresses is not None and not addresses.filter(F.col("iface") == interface).isEmpty():
        kept = on_interface(kept, addresses, interface, "local_ip")
    return kept


def unique_flows(flows: DataFrame, keys: Sequence[str] = (), order: Sequence[str] = ("ts", "id")) -> DataFrame:
    """Last row per flow key, as one partial-and-final aggregate."""
    group = [*keys, *FLOW_KEY]
    rest = [c for c in flows.columns if c not in group]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return flows.groupBy(*group).agg(last).select(*group, "_r.*")


def first_flows(flows: DataFrame, cycle: str, n: int = MAX_FLOWS_PER_CYCLE) -> DataFrame:
    """First ``n`` flows of a cycle. Each map task keeps at most ``n`` before the shuffle."""
    w = Window.partitionBy(cycle).orderBy(*FLOW_KEY)
    return flows.withColumn("flow_number", F.row_number().over(w)).filter(F.col("flow_number") <= n)


def allocate_bytes(flows: DataFrame, totals: DataFrame, cycle: str, n: int = MAX_FLOWS_PER_CYCLE) -> DataFrame:
    """Spread a cycle's bytes evenly over its flows; the first ones take the remainder.

    ``flows`` carries ``flow_number`` from :func:`first_flows`; ``totals`` has one row per cycle.
    """
    counted = flows.withColumn("_n", F.count("*").over(Window.partitionBy(cycle)))
    joined = counted.join(totals.filter(F.col("total_bytes") > 0), cycle)
    share = F.expr("total_bytes div _n") + F.when(F.col("flow_number") <= F.col("total_bytes") % F.col("_n"), 1).otherwise(0)
    return joined.withColumn("bytes_transferred", share).withColumn(
        "packet_count", F.greatest(F.lit(1).cast("long"), F.expr(f"bytes_transferred div {BYTES_PER_PACKET}"))
    ).drop("_n", "total_bytes")


def counter_rates(
    counters: DataFrame,
    cycle: Column,
    interface: str | None = None,
    include_loopback: bool = False,
    chunk_seconds: int = 3_600,
) -> DataFrame:
    """Bytes per cycle from cumulative interface counters; resets count as zero."""
    kept = counters
    if interface:
        kept = kept.filter(F.col("iface") == interface)
    if not include_loopback:
        kept = kept.filter(~F.lower("iface").startswith("lo"))
    chained = with_neighbour(
        kept, ["iface"], ["ts"], ["bytes_sent", "bytes_recv"], time_chunk("ts", chunk_seconds), False, "prev"
    )
    zero = F.lit(0).cast("long")
    grown = F.greatest(zero, F.coalesce(F.col("bytes_sent") - F.col("prev.bytes_sent"), zero)) + F.greatest(
        zero, F.coalesce(F.col("bytes_recv") - F.col("prev.bytes_recv"), zero)
    )
    return chained.groupBy(cycle.alias("cycle")).agg(F.sum(grown).alias("total_bytes"))


def pair_counts(packets: DataFrame, interval: str = "2 seconds") -> DataFrame:
    """Packets per (source, destination) and flush interval."""
    return packets.groupBy(F.window("ts", interval).alias("w"), "source_ip", "destination_ip").agg(
        F.count("*").alias("n")
    ).select(F.col("w.start").alias("flushed_from"), "source_ip", "destination_ip", "n")


def capture_totals(flows: DataFrame, failed: Column) -> DataFrame:
    return flows.agg(
        F.count_if(~failed).alias("packets_intercepted"),
        F.coalesce(F.sum(F.when(~failed, F.col("bytes_transferred"))), F.lit(0)).alias("bytes_intercepted"),
        F.count_if(failed).alias("errors"),
    )
