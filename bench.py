"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from actilens.models.autoencoder import AutoEncoder
from actilens.models.isolation_forest import IsolationForest
from actilens.operators.features import FEATURES, SCALED, fit_raw, raw_features
from actilens.plans.catalog import spark_queries
from actilens.session import build_session
from actilens.sources.views import Tables

HEADLINE = [
    "a01_threat_report", "a05_risk_distribution", "a06_kpi_row", "a07_port_scan", "a10_network_summary", "a11_session_totals",
    "a12_key_totals", "a14_minute_traffic", "a16_transitions", "a19_secure_average", "a26_roc_auc", "a30_latency_percentiles",
    "a33_edges", "f02_log_search", "j01_rule_match", "j04_match_clusters", "j08_recent_context", "k01_top_apps",
    "m01_feature_frame", "m13_stratified_split", "o01_policy_chain", "o03_audit", "o05_system_events", "p04_rewrite",
    "p08_profile", "u01_network_findings", "w02_predictions", "w03_rate_limit", "w04_counter_rates", "w05_allocated_bytes",
    "w08_device_changes", "w10_inactivity", "t04_minute_series",
]
AS_OF = "2024-02-01 00:00:00"


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, wanted = spark_queries(), sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{folder}/events.parquet").count()
    times: dict[str, float] = {}
    for key in wanted:
        # The no-op sink runs the whole plan without bringing rows to the driver.
        times[key] = timed(lambda: queries[key](spark, folder).write.format("noop").mode("overwrite").save())
    rates: dict[str, float] = {}
    if not sys.argv[1:]:
        t = Tables(spark, folder)
        raw = raw_features(t.logs, AS_OF).select("id", "user_name", "activity_type", *SCALED).persist()
        frame = fit_raw(raw, AS_OF).transform_raw(raw).select("id", *FEATURES).persist()
        n = frame.count()
        forest = IsolationForest.fit(frame, FEATURES)
        coder = AutoEncoder.fit(frame, FEATURES, epochs=2)
        for name, model in (("m05_forest_scoring", forest), ("m09_autoencoder_scoring", coder)):
            times[name] = timed(lambda: model.transform(frame).write.format("noop").mode("overwrite").save())
            rates[f"{name}_rows_per_second"] = round(n / times[name])
    print(
        json.dumps(
            {
                "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "rates": rates,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
