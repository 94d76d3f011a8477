"""The analytic tables (logs, traffic, users, ...) derived from the driver's Parquet tables.

Nothing here is synthetic: every row comes from a row of the given tables, and texts are taken whole.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actilens.sources.readers import spread

PLAYBOOK_SCHEMA = (
    "id string, name string, is_active boolean, trigger_field string, trigger_operator string, "
    "trigger_value string, action_type string, action_target string, min_confidence double, "
    "requires_approval boolean, rate_limit_count int, rate_limit_window_seconds int, scope string"
)
PLAYBOOKS = [
    ("p1", "lock critical", True, "riskLevel", "equals", "critical", "LOCK_USER", None, 0.0, False, 2, 86400, "global"),
    ("p2", "alert high", True, "riskLevel", "equals", "HIGH", "ALERT_ADMIN", None, 0.5, False, 3, 3600, "internal_only"),
    ("p3", "text rule", True, "description", "contains", "tion", "QUARANTINE_USER", None, 0.9, True, 1, 600, "global"),
    ("p4", "llm rule", True, "llmRiskLevel", "equals", "malicious", "BLOCK_IP", None, 0.2, False, 5, 300, "global"),
    ("p5", "off", False, "activityType", "equals", "ERROR", "LOCK_USER", None, 0.0, False, 5, 300, "global"),
    ("p6", "bad operator", True, "activityType", "matches", "ERROR", "LOCK_USER", None, 0.0, False, 5, 300, "global"),
    ("p7", "no such field", True, "nothing", "equals", "x", "LOCK_USER", None, 0.0, False, None, None, None),
]
CLUSTERS = [
    ("alpha", "tion"), ("alpha", "whst"), ("beta", "eaux"), ("beta", "quei"), ("gamma", "zero-day"), ("gamma", "token"),
]
INTERFACES = [("eth1", "10.1.0.1"), ("eth1", "10.1.0.2"), ("eth2", "10.1.0.3"), ("eth2", "10.1.0.1")]


def _s(column: str):
    return F.col(column).cast("string")


class Tables:
    """Lazy access to the raw tables and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def texts(self, name: str) -> DataFrame:
        """A table of long texts, split finely enough for per-row text work."""
        table = self.raw(name)
        return table if table.isStreaming else spread(table)

    @cached_property
    def documents(self) -> DataFrame:
        return self.texts("documents")

    @cached_property
    def pages(self) -> DataFrame:
        return self.texts("pages")

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def logs_core(self) -> DataFrame:
        """Logs without the two text columns: no join, one narrow scan."""
        e = self.events
        k = F.regexp_extract("props", "([0-9]+)", 1).cast("long").cast("string")
        return e.select(
            _s("event_id").alias("id"),
            "ts",
            F.concat(F.lit("u"), _s("user_id")).alias("user_name"),
            F.upper("event_type").alias("activity_type"),
            F.when(F.col("value") >= 200, "CRITICAL")
            .when(F.col("value") >= 100, "HIGH")
            .when(F.col("value") >= 50, "MEDIUM")
            .when(F.col("value") >= 20, "LOW")
            .otherwise("INFO")
            .alias("risk_level"),
            F.concat(F.lit("10.0."), (F.col("user_id") % 7).cast("string"), F.lit("."), (F.col("event_id") % 40).cast("string")).alias("ip_address"),
            F.when(F.col("user_id") % 3 == 0, "Internal").when(F.col("user_id") % 3 == 1, "Remote").alias("location"),
            F.concat(
                F.lit('{"confidence": '), k, F.lit('e-2, "risk_level": "'),
                F.when(F.col("value") >= 100, "MALICIOUS").otherwise("BENIGN"), F.lit('"}'),
            ).alias("activity_summary"),
            "event_id", "user_id", "value", "props",
        )

    @cached_property
    def logs(self) -> DataFrame:
        """Logs with the whole document text as description; all documents are used in turn."""
        docs = self.documents.select("doc_id", F.col("text").alias("description"))
        n_docs = self.raw("documents").agg(F.count("*")).scalar()
        return (
            self.logs_core.withColumn("doc_id", F.col("event_id") % n_docs)
            .join(docs, "doc_id")
            .withColumn(
                "details",
                F.concat(F.lit("session of "), "user_name", F.lit(" from "), "ip_address", F.lit(" "), "props"),
            )
            .select(
                "id", "ts", "user_name", "activity_type", "risk_level", "description", "details",
                "ip_address", "location", "activity_summary",
            )
        )

    @cached_property
    def logs_slim(self) -> DataFrame:
        return self.logs_core.drop("event_id", "user_id", "value", "props")

    @cached_property
    def traffic(self) -> DataFrame:
        sup, part = F.col("l_suppkey"), F.col("l_partkey")
        return self.raw("lineitem").select(
            F.concat(_s("l_orderkey"), F.lit("-"), _s("l_linenumber")).alias("id"),
            F.col("l_shipdate").cast("timestamp").alias("ts"),
            F.concat(F.lit("10.1."), F.floor(sup / 256).cast("string"), F.lit("."), (sup % 256).cast("string")).alias("source_ip"),
            F.when(part % 5 == 0, F.concat(F.lit("192.168.1."), (part % 250).cast("string")))
            .otherwise(F.concat(F.lit("45.33."), (part % 200).cast("string"), F.lit(".11")))
            .alias("destination_ip"),
            (1 + F.floor("l_quantity") % (3 + sup % 15)).cast("long").alias("port"),
            F.when(F.col("l_returnflag") == "A", "UDP").otherwise("TCP").alias("protocol"),
            F.floor(F.col("l_extendedprice") * 1024).cast("long").alias("bytes_transferred"),
            F.floor(F.col("l_quantity") * F.col("l_quantity") * 5).cast("long").alias("packet_count"),
        )

    @cached_property
    def users(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(
            _s("c_custkey").alias("id"),
            F.concat(F.lit("u"), _s("c_custkey")).alias("user_name"),
            F.when(k % 20 == 0, "Administrator").when(k % 20 < 5, "Security Analyst").when(k % 20 < 8, "Auditor").otherwise("Standard User").alias("role"),
            F.when(k % 20 == 0, "ADMIN").when(k % 20 < 5, "L2").otherwise("L1").alias("clearance_level"),
            F.when(k % 11 == 0, "LOCKED").when(k % 7 == 0, "INACTIVE").otherwise("ACTIVE").alias("status"),
        )

    @cached_property
    def sessions(self) -> DataFrame:
        """KEYLOG rows with both summary shapes, blank apps and malformed JSON."""
        eid = F.col("event_id")
        k = F.regexp_extract("props", "([0-9]+)", 1)
        events = self.texts("events").withColumn("ts", F.col("ts").cast("timestamp"))
        return events.select(
            _s("event_id").alias("id"),
            "ts",
            F.concat(F.lit("u"), _s("user_id")).alias("user_name"),
            F.lit("KEYLOG").alias("activity_type"),
            F.when(eid % 50 == 0, "not json")
            .when(eid % 3 == 0, F.concat(F.lit('{"a": '), k, F.lit(', "Key.space": '), (eid % 4).cast("string"), F.lit("}")))
            .otherwise(
                F.concat(
                    F.lit('{"key_counts": {"a": '), k, F.lit(', "b": '), (eid % 5).cast("string"),
                    F.lit('}, "duration_seconds": '), (eid % 60).cast("string"),
                    F.lit('.5, "total_keystrokes": '), (eid % 90).cast("string"), F.lit(', "active_window": "'),
                    F.when(eid % 13 == 0, "").otherwise(F.concat(F.lit("app"), (eid % 9).cast("string"))), F.lit('"}'),
                )
            )
            .alias("activity_summary"),
        )

    @cached_property
    def posts(self) -> DataFrame:
        return self.pages.select(
            "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), "html"
        )

    @cached_property
    def predictions(self) -> DataFrame:
        d = self.raw("documents").select("doc_id", "lang", "n_chars")
        return self.raw("labels").join(d, "doc_id").select(
            F.col("doc_id").alias("id"),
            F.col("quality").alias("y_true"),
            F.when(F.col("n_chars") % 1000 >= 300, 1).otherwise(0).alias("y_pred"),
            ((F.col("n_chars") % 1000).cast("double") / 1000).alias("score"),
            F.col("lang").alias("model_name"),
            ((F.col("n_chars") % 97).cast("double") / 10).alias("latency_ms"),
        )

    @cached_property
    def metric_points(self) -> DataFrame:
        v = F.col("value")
        return self.events.select(
            F.concat(F.lit("h"), (F.col("user_id") % 5).cast("string")).alias("host"),
            "ts",
            F.least(v, F.lit(100.0)).alias("cpu_usage"),
            F.lit(17179869184).alias("memory_total"),
            F.floor(v * 1000000).cast("long").alias("memory_used"),
            F.lit(500000000000).alias("disk_total"),
            F.floor(v * 100000000).cast("long").alias("disk_used"),
        )

    @cached_property
    def interface_counters(self) -> DataFrame:
        nic = F.col("user_id") % 4
        return self.events.select(
            F.concat(F.when(nic == 0, "lo").otherwise("eth"), nic.cast("string")).alias("iface"),
            "ts",
            F.floor(F.col("value") * 1000).cast("long").alias("bytes_sent"),
            (F.regexp_extract("props", "([0-9]+)", 1).cast("long") * 100).alias("bytes_recv"),
        )

    @cached_property
    def playbooks(self) -> DataFrame:
        return self.spark.createDataFrame(PLAYBOOKS, PLAYBOOK_SCHEMA)

    @cached_property
    def user_rules(self) -> DataFrame:
        """One response rule for each user, with unset guard rails here and there."""
        k = F.col("id").cast("long")
        unless = lambda n, value: F.when(k % n != 0, value)
        return self.users.select(
            F.concat(F.lit("rule-"), "id").alias("id"), F.concat(F.lit("watch "), "user_name").alias("name"),
            (F.col("status") == "ACTIVE").alias("is_active"), F.lit("user").alias("trigger_field"), F.lit("equals").alias("trigger_operator"),
            F.col("user_name").alias("trigger_value"),
            F.when(F.col("role") == "Administrator", "ALERT_ADMIN").otherwise("LOCK_USER").alias("action_type"),
            F.lit(None).cast("string").alias("action_target"), unless(4, F.lit(0.5)).alias("min_confidence"),
            unless(5, F.col("clearance_level") == "L1").alias("requires_approval"), unless(6, (k % 9).cast("int")).alias("rate_limit_count"),
            unless(7, F.lit(3600)).alias("rate_limit_window_seconds"), F.when(k % 8 == 0, "").otherwise(F.when(k % 3 != 0, "internal_only")).alias("scope"),
        )

    @cached_property
    def keyword_clusters(self) -> DataFrame:
        rows = [(c, k, "manual") for c, k in CLUSTERS]
        return self.spark.createDataFrame(rows, "cluster string, keyword string, source string")

    @cached_property
    def interface_addresses(self) -> DataFrame:
        return self.spark.createDataFrame(INTERFACES, "iface string, address string")

    @cached_property
    def federated_updates(self) -> DataFrame:
        """One masked update per vector; every 25th agent sends its update a second time."""
        e = self.raw("embeddings")
        vid = F.col("vec_id")
        copies = F.when(vid % 25 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
        return e.select("*", F.explode(copies).alias("copy")).select(
            F.concat(F.lit("r"), _s("label")).alias("round_id"),
            F.concat(F.lit("a"), _s("vec_id")).alias("agent_id"),
            F.col("embedding").cast("array<double>").alias("masked_update"),
            (1 + vid % 7).alias("num_samples"),
            F.lit(1.0).alias("epsilon"),
            F.lit(3).alias("min_clients"),
            F.lit(300).alias("timeout_seconds"),
            F.timestamp_seconds(F.lit(1767225600) + vid + F.col("copy")).alias("submitted_at"),
            F.concat(_s("vec_id"), F.lit("-"), _s("copy")).alias("message_id"),
        )

    @cached_property
    def federated_reveals(self) -> DataFrame:
        e = self.raw("embeddings").filter(~((F.col("vec_id") % 10 == 9) & (F.col("label") % 2 == 0)))
        return e.select(
            F.concat(F.lit("r"), _s("label")).alias("round_id"),
            F.concat(F.lit("a"), _s("vec_id")).alias("agent_id"),
            F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 0.5).alias("mask"),
            F.timestamp_seconds(F.lit(1767312000) + F.col("vec_id")).alias("revealed_at"),
        )

    @cached_property
    def device_snapshots(self) -> DataFrame:
        """One snapshot per order: the sorted set of device names seen with it."""
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        line = self.raw("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 8).alias("d"))
        devices = line.groupBy("o_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("dev"), _s("d")))).alias("devices"))
        return o.join(devices, "o_orderkey").select(
            F.concat(F.lit("h"), (F.col("o_custkey") % 20).cast("string")).alias("host"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
            F.col("o_orderkey").alias("snapshot_id"),
            "devices",
        )

    @cached_property
    def action_requests(self) -> DataFrame:
        eid = F.col("event_id")
        return self.events.filter(F.col("event_type") == "error").select(
            _s("event_id").alias("request_id"),
            "ts",
            F.when(eid % 3 == 0, "block_ip").when(eid % 3 == 1, "isolate_host").otherwise("reset_password").alias("action"),
            F.when(eid % 3 == 0, F.concat(F.lit("10.9.0."), (eid % 200).cast("string")))
            .when(eid % 3 == 1, F.concat(F.lit("host"), (eid % 50).cast("string")))
            .when(eid % 2 == 0, F.concat(F.lit("u"), (eid % 3000).cast("string")))
            .otherwise((eid % 3000).cast("string"))
            .alias("target"),
            F.when(eid % 5 != 0, F.concat(F.lit("ticket "), _s("event_id"))).alias("reason"),
            F.concat(F.lit("u"), _s("user_id")).alias("requested_by"),
        )

    @cached_property
    def clipboard(self) -> DataFrame:
        """Chat turns as clipboard readings of one user per conversation."""
        return self.raw("conversations").select(
            F.concat(F.lit("c"), (F.col("conv_id") % 40).cast("string")).alias("user_name"),
            (F.col("conv_id") * 100 + F.col("turn")).alias("seq"),
            F.timestamp_seconds(F.lit(1767225600) + F.col("conv_id") * 100 + F.col("turn")).alias("ts"),
            F.when(F.col("turn") % 3 == 0, F.concat(F.lit("  "), "role", F.lit(" "))).otherwise(F.col("text")).alias("content"),
        )


class StreamTables(Tables):
    """The same views with some raw tables read as streams; the others stay static."""

    def __init__(self, spark: SparkSession, folder: str, streamed: tuple[str, ...], files_per_trigger: int | None = 32):
        super().__init__(spark, folder)
        self.streamed = streamed
        self.files_per_trigger = files_per_trigger

    def raw(self, name: str) -> DataFrame:
        if name not in self.streamed:
            return super().raw(name)
        # A pattern instead of a plain path: the table may be one file or a folder of files.
        path = f"{self.folder}/{name}[.]parquet"
        reader = self.spark.readStream.schema(super().raw(name).schema)
        if self.files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", self.files_per_trigger)
        return reader.parquet(path)
