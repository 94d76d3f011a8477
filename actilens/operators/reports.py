"""Threat report, dashboard figures and network-traffic findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actilens.functions.risk import is_severe
from actilens.functions.timefns import clock_label
from actilens.operators.scans import newest

LARGE_TRANSFER_BYTES = 100 * 1024 * 1024
PORT_SCAN_PORTS = 10
PACKET_FLOOD = 10_000
FINDING_COLUMNS = ["type", "source", "destination", "value", "id"]


def threat_report(logs: DataFrame, limit: int | None = 100) -> DataFrame:
    """Score, summary, recommendations and flagged ids over the newest ``limit`` logs (all if None).

    One aggregate. With ``limit=None`` ``flagged_logs`` is null and the ids are left to :func:`flagged_logs`, since
    that list grows with the data.
    """
    rows = logs if limit is None else newest(logs.select("id", "ts", "risk_level"), limit)
    level = F.col("risk_level")
    aggregates = [
        F.count("*").alias("total_logs"),
        F.count_if(level == "CRITICAL").alias("critical"),
        F.count_if(level == "HIGH").alias("high"),
    ]
    flagged = F.array_sort(F.collect_list(F.when(level == "CRITICAL", F.col("id"))))
    aggregates.append((F.lit(None).cast("array<string>") if limit is None else flagged).alias("flagged_logs"))
    total, critical, high = F.col("total_logs"), F.col("critical"), F.col("high")
    raw = F.when(total > 0, F.least(F.lit(100.0), (critical * 10 + high * 5) / total * 100)).otherwise(0.0)
    counts = F.format_string(
        "Analyzed %d events. Detected %d critical and %d high-severity anomalies.", total, critical, high
    )
    state = F.when(F.col("_raw") > 50, " System is under significant threat pressure.").otherwise(
        " System status is within nominal parameters."
    )
    lines = lambda *text: F.array(*[t if not isinstance(t, str) else F.lit(t) for t in text])
    none = F.array().cast("array<string>")
    advice = F.concat(
        F.when(
            critical > 0,
            lines(
                F.format_string("IMMEDIATE: Investigate %d critical incidents.", critical),
                "Initiate lockdown for affected users.",
            ),
        ).otherwise(none),
        F.when(
            high > 5,
            lines(
                "Review firewall rules and access control lists.",
                "Audit user permissions for high-risk accounts.",
            ),
        ).otherwise(none),
        F.when(
            F.col("_raw") < 20, lines("Continue standard monitoring protocols.", "Update threat signatures.")
        ).otherwise(none),
    )
    out = (
        rows.agg(*aggregates)
        .withColumn("_raw", raw)
        .withColumn("threat_score", F.round("_raw", 2))
        .withColumn(
            "summary",
            F.when(total == 0, "No logs available for analysis.").otherwise(F.concat(counts, state)),
        )
        .withColumn("_advice", advice)
        .withColumn(
            "recommendations",
            F.when(total == 0, lines("Ensure log collection agents are active."))
            .when(F.size("_advice") == 0, lines("No immediate actions required."))
            .otherwise(F.col("_advice")),
        )
    )
    return out.drop("_raw", "_advice")


def missing_risk_report(logs: DataFrame) -> DataFrame:
    """The fixed answer for a table without a risk column."""
    return logs.sparkSession.createDataFrame(
        [(0.0, "Logs missing risk level information.", ["Check log format."], [])],
        "threat_score double, summary string, recommendations array<string>, flagged_logs array<string>",
    )


def flagged_logs(logs: DataFrame) -> DataFrame:
    """Ids of CRITICAL logs as a table, for inputs of any size."""
    return logs.filter(F.col("risk_level") == "CRITICAL").select("id")


def risk_distribution(logs: DataFrame) -> DataFrame:
    """Counts of the four shown levels, zero-filled; INFO is not shown."""
    levels = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    counts = logs.agg(*[F.count_if(F.col("risk_level") == x).alias(x) for x in levels])
    return counts.unpivot([], levels, "risk_level", "n")


def kpi_row(logs: DataFrame, users: DataFrame) -> DataFrame:
    level = F.col("risk_level")
    active = users.agg(F.count_if(F.col("status") == "ACTIVE")).scalar()
    return (
        logs.agg(
            F.count_if(is_severe(level)).alias("threats"),
            F.count_if(F.col("description").contains("[ML_DETECTED]")).alias("ai_anomalies"),
            F.floor(F.count_if(level == "LOW") * 100.0 / F.greatest(F.count("*"), F.lit(1)) + 0.5).alias("low_share_percent"),
        )
        .withColumn("active_users", active)
    )


def large_transfers(traffic: DataFrame, threshold: int = LARGE_TRANSFER_BYTES) -> DataFrame:
    megabytes = F.round(F.col("bytes_transferred") / (1024 * 1024), 2)
    return traffic.filter(F.col("bytes_transferred") > threshold).select(
        F.lit("High Data Transfer").alias("type"),
        F.coalesce("source_ip", F.lit("Unknown")).alias("source"),
        F.coalesce("destination_ip", F.lit("Unknown")).alias("destination"),
        F.format_string("%.2f MB", megabytes).alias("value"),
        "id",
    )


def port_scans(traffic: DataFrame, threshold: int = PORT_SCAN_PORTS, approximate: bool = False) -> DataFrame:
    """Sources that touch more than ``threshold`` distinct ports.

    (source, port) pairs are made distinct inside each map task first, so a busy source sends at
    most one row per port and task.
    """
    ports = F.approx_count_distinct("port") if approximate else F.count_distinct("port")
    return (
        traffic.filter(F.col("source_ip").isNotNull() & F.col("port").isNotNull())
        .groupBy("source_ip")
        .agg(ports.alias("n"))
        .filter(F.col("n") > threshold)
        .select(
            F.lit("Potential Port Scan").alias("type"),
            F.col("source_ip").alias("source"),
            F.lit("Multiple").alias("destination"),
            F.format_string("%d unique ports", "n").alias("value"),
            F.lit(None).cast("string").alias("id"),
        )
    )


def packet_floods(traffic: DataFrame, threshold: int = PACKET_FLOOD) -> DataFrame:
    return traffic.filter(F.col("packet_count") > threshold).select(
        F.lit("High Packet Volume (DDoS Risk)").alias("type"),
        F.coalesce("source_ip", F.lit("Unknown")).alias("source"),
        F.coalesce("destination_ip", F.lit("Unknown")).alias("destination"),
        F.format_string("%d packets", "packet_count").alias("value"),
        "id",
    )


def network_findings(traffic: DataFrame) -> DataFrame:
    """All three detectors in one table; an event may appear twice."""
    return large_transfers(traffic).unionByName(port_scans(traffic)).unionByName(packet_floods(traffic))


def network_summary(traffic: DataFrame) -> DataFrame:
    """Total, number of findings, score and sentence from two narrow aggregates."""
    scans = port_scans(traffic).agg(F.count("*")).scalar()
    counted = traffic.agg(
        F.count("*").alias("total_events"),
        (
            F.count_if(F.col("bytes_transferred") > LARGE_TRANSFER_BYTES) + F.count_if(F.col("packet_count") > PACKET_FLOOD)
        ).alias("_direct"),
    ).withColumn("anomalies_detected", F.col("_direct") + scans)
    total, found = F.col("total_events"), F.col("anomalies_detected")
    return counted.select(
        "total_events",
        "anomalies_detected",
        F.when(total > 0, F.round(F.least(F.lit(100.0), found / total * 100), 2)).otherwise(0.0).alias("anomaly_score"),
        F.when(total == 0, "No network traffic data available.")
        .otherwise(F.format_string("Analyzed %d traffic events. Detected %d anomalies.", total, found))
        .alias("summary"),
    )


def minute_traffic(traffic: DataFrame) -> DataFrame:
    """Inbound and outbound bytes per ``H:MM``; all days fold together."""
    inbound = F.col("destination_ip").startswith("192.168")
    size = F.col("bytes_transferred")
    return traffic.groupBy(clock_label(F.col("ts")).alias("time")).agg(
        F.sum(F.when(inbound, size).otherwise(0)).alias("inbound"),
        F.sum(F.when(inbound, 0).otherwise(size)).alias("outbound"),
    )


def context_json(logs: DataFrame, limit: int = 15) -> DataFrame:
    """The newest logs as one JSON array, newest first."""
    rows = newest(logs, limit)
    item = F.struct("id", "user_name", "activity_type", "risk_level")
    ranked = F.array_sort(
        F.collect_list(F.struct((-F.unix_micros("ts")).alias("k"), F.col("id").alias("i"), item.alias("item")))
    )
    return rows.agg(F.to_json(F.transform(ranked, lambda x: x["item"])).alias("context"))


def recent_notable(logs: DataFrame, limit: int = 3) -> DataFrame:
    return newest(logs.filter(F.col("risk_level") != "LOW"), limit)
