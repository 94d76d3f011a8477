"""Paged scans, filters, searches, export projections and retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actilens.functions.casts import or_default
from actilens.functions.timefns import iso_text
from actilens.scale import broadcast_if_small

# Export headers and role presets.
CSV_HEADERS = {
    "ID": "id", "Timestamp": "timestamp", "User": "user_name", "Activity": "activity_type",
    "Risk Level": "risk_level", "Description": "description", "IP": "ip_address", "Details": "details",
}
JSON_FIELDS = [
    "id", "timestamp", "user", "activity_type", "risk_level", "description", "details", "ip_address", "location",
]
ROLE_PERMISSIONS = {
    "Administrator": ["READ_LOGS", "EDIT_SETTINGS", "MANAGE_USERS", "EXPORT_DATA"],
    "Security Analyst": ["READ_LOGS", "EXPORT_DATA"],
    "Auditor": ["READ_LOGS"],
    "Standard User": [],
}


def page(df: DataFrame, order: Sequence[Column], skip: int = 0, limit: int = 100) -> DataFrame:
    """A bounded page; Spark plans it as a distributed top-k, not a full sort."""
    return df.orderBy(*order).offset(skip).limit(limit)


def newest(df: DataFrame, limit: int = 100, skip: int = 0) -> DataFrame:
    return page(df, [F.desc("ts"), F.asc("id")], skip, limit)


def users_page(users: DataFrame, skip: int = 0, limit: int = 100) -> DataFrame:
    return page(users, [F.asc("id")], skip, limit)


def rules(playbooks: DataFrame) -> DataFrame:
    """Flat rule rows in their nested form with guard-rail defaults filled in."""
    return playbooks.select(
        "id", "name", "is_active",
        F.struct(
            F.col("trigger_field").alias("field"),
            F.col("trigger_operator").alias("operator"),
            F.col("trigger_value").alias("value"),
        ).alias("trigger"),
        F.struct(F.col("action_type").alias("type"), F.col("action_target").alias("target")).alias("action"),
        F.coalesce("min_confidence", F.lit(0.0)).alias("min_confidence"),
        F.coalesce("requires_approval", F.lit(False)).alias("requires_approval"),
        F.coalesce("rate_limit_count", F.lit(5)).alias("rate_limit_count"),
        F.coalesce("rate_limit_window_seconds", F.lit(300)).alias("rate_limit_window_seconds"),
        or_default(F.col("scope"), "global").alias("scope"),
    )


def active_rules(playbooks: DataFrame) -> DataFrame:
    return playbooks.filter("is_active")


def training_rows(logs: DataFrame, limit: int | None = 50_000) -> DataFrame:
    """The newest rows with the five columns the models read; ``None`` keeps them all.

    The last place of the page is found on times and ids alone, so texts of rows behind it do not go to the task that sorts.
    """
    columns = ["ts", "user_name", "activity_type", "risk_level", "description"]
    if limit is None:
        return logs.select(columns)
    # Structs compare field by field with nulls first: the order of ``newest``, where a missing time is last.
    place = F.struct(F.isnull("ts").alias("none"), (-F.unix_micros("ts")).alias("back"), F.col("id").alias("id"))
    last = newest(logs.select("ts", "id"), limit).agg(F.max(place)).scalar()
    return newest(logs.select("id", *columns).filter(place <= last), limit).select(columns)


def csv_rows(logs: DataFrame) -> DataFrame:
    shown = logs.withColumn("timestamp", iso_text(F.col("ts")))
    return shown.select(*[F.col(source).alias(header) for header, source in CSV_HEADERS.items()])


def json_rows(logs: DataFrame) -> DataFrame:
    return logs.withColumn("timestamp", iso_text(F.col("ts"))).withColumnRenamed("user_name", "user").select(JSON_FIELDS)


def report_rows(logs: DataFrame) -> DataFrame:
    return logs.select(
        F.substring(iso_text(F.col("ts")), 1, 19).alias("timestamp"),
        F.col("risk_level").alias("level"),
        F.substring("user_name", 1, 20).alias("user"),
        F.substring("description", 1, 50).alias("description"),
    )


def time_range(df: DataFrame, start: str | None = None, end: str | None = None, column: str = "ts") -> DataFrame:
    """Inclusive bounds, either optional. A date without a time means midnight."""
    if start:
        df = df.filter(F.col(column) >= F.lit(start).cast("timestamp"))
    if end:
        df = df.filter(F.col(column) <= F.lit(end).cast("timestamp"))
    return df


def search_logs(logs: DataFrame, term: str = "", risk: str = "ALL") -> DataFrame:
    needle = term.lower()
    hit = F.lower("description").contains(needle) | F.lower("user_name").contains(needle)
    return logs.filter(hit) if risk == "ALL" else logs.filter(hit & (F.col("risk_level") == risk))


def search_users(
    users: DataFrame, term: str = "", status: str = "ALL", clearance: str = "ALL", role: str = "ALL"
) -> DataFrame:
    needle = term.lower()
    out = users.filter(F.lower("user_name").contains(needle) | F.lower("role").contains(needle))
    for column, wanted in (("status", status), ("clearance_level", clearance), ("role", role)):
        if wanted != "ALL":
            out = out.filter(F.col(column) == wanted)
    return out


def of_activity(logs: DataFrame, activity: str) -> DataFrame:
    return logs.filter(F.col("activity_type") == activity)


def scoring_defaults(logs: DataFrame) -> DataFrame:
    """Fill what the scoring step needs; null and empty text count as missing."""
    for column, default in (
        ("user_name", "unknown"), ("activity_type", "UNKNOWN"), ("risk_level", "INFO"), ("description", ""),
    ):
        logs = logs.withColumn(column, or_default(F.col(column), default))
    return logs


def with_permissions(users: DataFrame) -> DataFrame:
    """Add the permission list of the user's role; unknown roles get none."""
    entries = []
    for role, permissions in ROLE_PERMISSIONS.items():
        entries += [F.lit(role), F.array(*[F.lit(p) for p in permissions]).cast("array<string>")]
    preset = F.create_map(*entries)[F.col("role")]
    return users.withColumn("permissions", F.coalesce(preset, F.array().cast("array<string>")))


def align_schema(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Add the columns a newer schema has, with their defaults; existing columns stay as they are."""
    missing = {name: F.lit(value) for name, value in defaults.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df


def metrics_history(metrics: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Metric rows of the last ``hours`` in time order, nested per resource."""
    extra = lambda name: [F.col(name).alias("percent")] if name in metrics.columns else []
    return (
        retained(metrics, as_of, hours)
        .orderBy("ts", "host")
        .select(
            "host", "ts",
            F.struct(F.col("cpu_usage").alias("usage_percent")).alias("cpu"),
            F.struct(
                F.col("memory_total").alias("total"),
                (F.col("memory_total") - F.col("memory_used")).alias("available"),
                F.col("memory_used").alias("used"), *extra("memory_percent"),
            ).alias("memory"),
            F.struct(
                F.col("disk_total").alias("total"),
                (F.col("disk_total") - F.col("disk_used")).alias("free"),
                F.col("disk_used").alias("used"), *extra("disk_percent"),
            ).alias("disk"),
        )
    )


def retained(df: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Rows not older than ``hours`` before ``as_of``; the filter reaches the scan."""
    return df.filter(F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr(f"interval {hours} hours"))


def due_rows(queue: DataFrame, as_of: str, limit: int = 50) -> DataFrame:
    """Deliveries whose next attempt has come, oldest id first."""
    due = queue.filter(F.col("next_attempt") <= F.lit(as_of).cast("timestamp"))
    return due.orderBy("id").limit(max(1, limit))


def newest_per_host(df: DataFrame, n: int, key: str = "host", order: Sequence[str] = ("ts",)) -> DataFrame:
    """Newest ``n`` rows per key. Spark trims each map task to ``n`` rows before the shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def resolve_user(requests: DataFrame, users: DataFrame, target: str = "target") -> DataFrame:
    """Find a user by name, or by id where no name matches.

    Two equi-joins instead of one OR condition, so neither needs a nested loop.
    """
    by_name = users.select(F.col("user_name").alias(target), F.col("id").alias("_id_by_name"), F.col("user_name").alias("_n1"))
    by_id = users.select(F.col("id").alias(target), F.col("id").alias("_id_by_id"), F.col("user_name").alias("_n2"))
    return (
        requests.join(by_name, target, "left")
        .join(by_id, target, "left")
        .withColumn("matched_id", F.coalesce("_id_by_name", "_id_by_id"))
        .withColumn("matched_name", F.coalesce("_n1", "_n2"))
        .withColumn("matched_by", F.when(F.col("_id_by_name").isNotNull(), "name").when(F.col("_id_by_id").isNotNull(), "id"))
        .drop("_id_by_name", "_id_by_id", "_n1", "_n2")
    )


def on_interface(flows: DataFrame, addresses: DataFrame, interface: str, ip_column: str) -> DataFrame:
    """Keep flows whose local address belongs to the interface."""
    mine = addresses.filter(F.col("iface") == interface).select(F.col("address").alias(ip_column)).distinct()
    return flows.join(broadcast_if_small(mine), ip_column, "left_semi")
