from pyspark.sql import functions as F

from actilens.operators import reports, scans


def levels(make_logs, **counts):
    return make_logs([{"risk_level": level} for level, n in counts.items() for _ in range(n)])


def test_threat_report_high_pressure(make_logs):
    r = reports.threat_report(levels(make_logs, CRITICAL=1, HIGH=6, INFO=3)).first()
    assert r["threat_score"] == 100.0
    assert r["summary"].endswith("System is under significant threat pressure.")
    assert r["summary"].startswith("Analyzed 10 events. Detected 1 critical and 6 high-severity anomalies.")
    assert len(r["recommendations"]) == 4 and r["recommendations"][0] == "IMMEDIATE: Investigate 1 critical incidents."
    assert r["flagged_logs"] == ["l0"]


def test_threat_report_quiet_and_middle(make_logs):
    quiet = reports.threat_report(levels(make_logs, INFO=4)).first()
    assert quiet["threat_score"] == 0.0 and quiet["recommendations"][0] == "Continue standard monitoring protocols."
    middle = reports.threat_report(levels(make_logs, HIGH=1, INFO=19)).first()
    assert middle["threat_score"] == 25.0 and middle["recommendations"] == ["No immediate actions required."]
    assert "nominal" in middle["summary"]


def test_threat_report_empty(make_logs):
    r = reports.threat_report(make_logs([])).first()
    assert (r["threat_score"], r["summary"], r["flagged_logs"]) == (0.0, "No logs available for analysis.", [])
    assert r["recommendations"] == ["Ensure log collection agents are active."]


def test_threat_report_uses_the_newest_hundred(make_logs):
    rows = [{"risk_level": "CRITICAL"}] * 10 + [{"risk_level": "INFO"}] * 100
    assert reports.threat_report(make_logs(rows)).first()["critical"] == 0
    whole = reports.threat_report(make_logs(rows), limit=None).first()
    assert whole["critical"] == 10 and whole["total_logs"] == 110


def test_missing_risk(make_logs):
    r = reports.missing_risk_report(make_logs([])).first()
    assert r["summary"] == "Logs missing risk level information."


def traffic(spark, rows):
    return spark.createDataFrame(
        rows, "id string, ts timestamp, source_ip string, destination_ip string, port long, protocol string, bytes_transferred long, packet_count long"
    )


def test_network_thresholds_and_nulls(spark):
    from datetime import datetime

    t = datetime(2026, 1, 1)
    rows = [("a", t, "s", "d", p, "TCP", 104857600, 10000) for p in range(10)]
    rows += [("b", t, "s", "d", None, "TCP", 104857601, 10001), ("c", t, None, "d", 99, "TCP", 1, 1)]
    base = traffic(spark, rows)
    assert reports.port_scans(base).count() == 0
    big = reports.large_transfers(base).collect()
    assert [(r["id"], r["value"]) for r in big] == [("b", "100.00 MB")]
    assert [r["value"] for r in reports.packet_floods(base).collect()] == ["10001 packets"]
    eleven = base.unionByName(traffic(spark, [("e", t, "s", "d", 77, "TCP", 1, 1)]))
    scan = reports.port_scans(eleven).first()
    assert (scan["source"], scan["destination"], scan["value"], scan["id"]) == ("s", "Multiple", "11 unique ports", None)
    assert reports.network_findings(eleven).count() == 3
    s = reports.network_summary(eleven).first()
    assert (s["anomalies_detected"], s["anomaly_score"]) == (3, 23.08)
    empty = reports.network_summary(base.limit(0)).first()
    assert (empty["summary"], empty["anomaly_score"], empty["anomalies_detected"]) == ("No network traffic data available.", 0.0, 0)


def test_minute_traffic_folds_days(spark):
    from datetime import datetime

    rows = [
        ("a", datetime(2026, 1, 1, 9, 5, 1), "s", "192.168.0.1", 1, "TCP", 5, 1),
        ("b", datetime(2026, 1, 2, 9, 5, 59), "s", "8.8.8.8", 1, "TCP", 7, 1),
    ]
    r = reports.minute_traffic(traffic(spark, rows)).collect()
    assert [(x["time"], x["inbound"], x["outbound"]) for x in r] == [("9:05", 5, 7)]


def test_kpis_on_empty_logs(make_logs, spark):
    users = spark.createDataFrame([("u", "ACTIVE"), ("v", "LOCKED")], "user_name string, status string")
    r = reports.kpi_row(make_logs([]), users).first()
    assert (r["threats"], r["low_share_percent"], r["active_users"]) == (0, 0, 1)


def test_page_is_newest_first_with_ties_by_id(make_logs):
    from datetime import datetime

    same = datetime(2026, 5, 1)
    logs = make_logs([{"id": "b", "ts": same}, {"id": "a", "ts": same}, {"id": "c"}])
    assert [r["id"] for r in scans.newest(logs, 2).collect()] == ["a", "b"]
    assert [r["id"] for r in scans.newest(logs, 2, skip=2).collect()] == ["c"]


def test_time_range_date_only_end_means_midnight(make_logs):
    from datetime import datetime

    logs = make_logs([{"id": "in", "ts": datetime(2026, 2, 19)}, {"id": "out", "ts": datetime(2026, 2, 19, 10)}])
    assert [r["id"] for r in scans.time_range(logs, "2026-02-19", "2026-02-19").collect()] == ["in"]
    assert scans.time_range(logs).count() == 2


def test_user_lookup_prefers_names(spark):
    users = spark.createDataFrame([("1", "x"), ("x", "y")], "id string, user_name string")
    req = spark.createDataFrame([("x",), ("1",), ("zz",)], "target string")
    got = {r["target"]: (r["matched_id"], r["matched_by"]) for r in scans.resolve_user(req, users).collect()}
    assert got == {"x": ("1", "name"), "1": ("1", "id"), "zz": (None, None)}


def test_permissions(spark):
    users = spark.createDataFrame([("Administrator",), ("Auditor",), ("Standard User",), ("Nobody",)], "role string")
    got = {r["role"]: len(r["permissions"]) for r in scans.with_permissions(users).collect()}
    assert got == {"Administrator": 4, "Auditor": 1, "Standard User": 0, "Nobody": 0}


def test_newest_per_host_trims_in_map_tasks(spark):
    df = spark.range(100).select((F.col("id") % 2).cast("string").alias("host"), F.timestamp_seconds("id").alias("ts"))
    out = scans.newest_per_host(df, 5)
    assert out.count() == 10
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()
