import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from actilens.operators import context, devices, flows, graph, markov, sessions

START = datetime(2026, 1, 1)


def test_old_session_shape(make_logs):
    logs = make_logs([{"activity_type": "KEYLOG", "activity_summary": json.dumps({"x": n})} for n in (1, 2, 3)])
    s = sessions.key_sessions(logs)
    t = sessions.session_totals(s).first()
    assert (t["total_sessions"], t["total_keystrokes"], t["total_duration_seconds"]) == (3, 6, 0.0)
    assert [(r["app"], r["n"]) for r in sessions.top_apps(s).collect()] == [("Unknown", 3)]
    assert [(r["key"], r["n"]) for r in sessions.key_totals(s).collect()] == [("x", 6)]


def test_session_oddities(make_logs):
    rows = [
        '{"key_counts": {"a": 2, "b": "x", "c": 2.9}, "duration_seconds": 1.5, "total_keystrokes": 4, "active_window": "ed"}',
        '{"key_counts": {"a": 1}, "duration_seconds": "bad", "total_keystrokes": 9, "active_window": "lost"}',
        '{"key_counts": {"a": 1}, "duration_seconds": 2, "total_keystrokes": "bad", "active_window": "lost"}',
        '{"key_counts": {}, "duration_seconds": 1, "active_window": ""}',
        '{"a": 5, "b": "text"}', "[1, 2]", "nonsense", None, "7",
    ]
    logs = make_logs([{"activity_type": "KEYLOG", "activity_summary": r} for r in rows] + [{"activity_summary": '{"a": 100}'}])
    s = sessions.key_sessions(logs)
    t = sessions.session_totals(s).first()
    assert (t["total_sessions"], t["total_keystrokes"], t["total_duration_seconds"]) == (9, 4, 4.5)
    assert {r["key"]: r["n"] for r in sessions.key_totals(s).collect()} == {"a": 4, "b": 0, "c": 2}
    assert [(r["app"], r["n"]) for r in sessions.top_apps(s).collect()] == [("ed", 1)]


def test_heat_bands(spark):
    totals = spark.createDataFrame([("Key.a", 10), (" key.A ", 10), ("b", 3), ("c", 8), ("d", 0), ("e", 12)], "key string, n long")
    got = {r["key"]: (r["n"], r["intensity"], r["band"]) for r in sessions.heat_table(totals).collect()}
    assert got == {"A": (20, 1.0, "peak"), "B": (3, 0.15, "low"), "C": (8, 0.4, "medium"), "D": (0, 0.0, "none"), "E": (12, 0.6, "high")}


def test_flush_summary_ties(spark):
    rows = [("s", START, "a", "w2"), ("s", START + timedelta(seconds=3), "a", "w1"), ("s", START + timedelta(seconds=4), "b", "w1"), ("s", START + timedelta(seconds=9), "b", "w2")]
    df = spark.createDataFrame(rows, "session string, ts timestamp, key string, window string")
    r = sessions.flush_summaries(df, ["session"]).first()
    assert (r["duration_seconds"], r["total_keystrokes"], r["active_window"], r["key_counts"]) == (9.0, 4, "w1", {"a": 2, "b": 2})


def test_markov_drops_blank_steps_first(make_logs):
    logs = make_logs([{"activity_type": a} for a in ("A", "", "B", None, "A", "B", "C")])
    counts = markov.transitions(logs)
    got = {(r["activity_type"], r["next_activity"]): r["n"] for r in counts.collect()}
    assert got == {("A", "B"): 2, ("B", "A"): 1, ("B", "C"): 1}
    p = markov.predict_next(counts, "B").collect()
    assert [(r["next_activity"], r["probability"]) for r in p] == [("A", 0.5), ("C", 0.5)]
    assert markov.predict_next(counts, "nowhere").count() == 0


def test_counter_rates_clamp_resets(spark):
    rows = [("eth0", 0, 100, 10), ("eth0", 60, 150, 5), ("eth0", 120, 20, 30), ("lo", 60, 999, 0), ("lo", 120, 9999, 0)]
    df = spark.createDataFrame([(i, START + timedelta(seconds=s), a, b) for i, s, a, b in rows], "iface string, ts timestamp, bytes_sent long, bytes_recv long")
    got = {r["cycle"]: r["total_bytes"] for r in flows.counter_rates(df, F.col("ts")).collect()}
    assert got == {START: 0, START + timedelta(seconds=60): 50, START + timedelta(seconds=120): 25}


def test_allocation(spark):
    rows = [("c", "l", f"r{i}", 80, "TCP", START, str(i)) for i in range(3)] + [("d", "l", "r", 80, "TCP", START, "9")]
    df = spark.createDataFrame(rows, "cycle string, local_ip string, remote_ip string, remote_port long, protocol string, ts timestamp, id string")
    first = flows.first_flows(flows.unique_flows(df, ["cycle"]), "cycle", 2)
    totals = spark.createDataFrame([("c", 4801), ("d", 0)], "cycle string, total_bytes long")
    got = [(r["remote_ip"], r["bytes_transferred"], r["packet_count"]) for r in flows.allocate_bytes(first, totals, "cycle").orderBy("flow_number").collect()]
    assert got == [("r0", 2401, 2), ("r1", 2400, 2)]


def test_admission(spark):
    rows = [("10.0.0.1", "8.8.8.8", 443, "TCP"), ("127.0.0.1", "8.8.8.8", 443, "TCP"), ("10.0.0.1", "::1", 8000, "TCP"), ("10.0.0.1", None, 443, "TCP"),
            ("10.0.0.1", "8.8.8.8", 0, "TCP"), ("10.0.0.1", "8.8.8.8", 443, "UNKNOWN"), ("10.0.0.2", "8.8.8.8", 443, "UDP")]
    df = spark.createDataFrame(rows, "local_ip string, remote_ip string, remote_port long, protocol string")
    nics = spark.createDataFrame([("eth0", "10.0.0.1")], "iface string, address string")
    assert flows.admitted_flows(df).count() == 2
    assert flows.admitted_flows(df, nics, "eth0").count() == 1
    assert flows.admitted_flows(df, nics, "eth9").count() == 2
    assert flows.admitted_flows(df, include_loopback=True).count() == 3


def test_devices_and_clipboard(spark):
    rows = [("h", START + timedelta(hours=i), i, d) for i, d in enumerate([["a"], ["a"], ["a", "b"], ["b"], []])]
    df = spark.createDataFrame(rows, "host string, ts timestamp, snapshot_id long, devices array<string>")
    got = [(r["added"], r["removed"], r["n_devices"], r["description"]) for r in devices.device_changes(df).orderBy("ts").collect()]
    assert got == [(["a"], [], 1, "USB device attached"), (["b"], [], 2, "USB device attached"), ([], ["a"], 1, "USB device removed"), ([], ["b"], 0, "USB device removed")]
    clips = spark.createDataFrame([("u", START + timedelta(days=i), i, c) for i, c in enumerate(["x", " x\n", "y", None, "y", "x"])], "user_name string, ts timestamp, seq long, content string")
    out = devices.clipboard_changes(clips).orderBy("ts").collect()
    assert [r["seq"] for r in out] == [0, 2, 5] and out[0]["description"] == "Clipboard updated (1 chars)" and "content" not in out[0]


def test_inactivity_bounds(make_logs):
    logs = make_logs([{"ts": START}, {"ts": START + timedelta(seconds=6900)}, {"ts": START + timedelta(seconds=13801)}, {"ts": START + timedelta(seconds=21002)}])
    got = [(r["warned"], r["limit_reached"]) for r in devices.inactivity(logs.select("id", "ts", "user_name")).orderBy("ts").collect()]
    assert got == [(False, False), (True, False), (True, True), (False, False)]
    off = devices.inactivity(logs.select("id", "ts", "user_name"), enabled=False)
    assert off.filter("warned or limit_reached").count() == 0


def test_context_against_brute_force(make_logs):
    rng = random.Random(5)
    rows = [{"id": f"{i:03d}", "ts": START + timedelta(seconds=rng.choice([300, 300, rng.randint(0, 1500)])), "description": f"d{i}"} for i in range(150)]
    logs = make_logs(rows)
    anchors = logs.filter("cast(id as int) % 7 = 0").select("id", "ts")
    got = {r["id"]: r["context"] for r in context.recent_context(anchors, logs).collect()}
    for r in rows:
        if int(r["id"]) % 7:
            continue
        near = [x for x in rows if r["ts"] - timedelta(minutes=5) <= x["ts"] <= r["ts"]]
        near = sorted(near, key=lambda x: (-x["ts"].timestamp(), x["id"]))[:10]
        assert got[r["id"]] == "\n".join(f"[{x['ts'].isoformat(timespec='microseconds')}] LOGIN: {x['description']}" for x in near)


def test_context_without_logs(make_logs):
    logs = make_logs([{"id": "old", "ts": START}])
    anchors = make_logs([{"id": "a", "ts": START + timedelta(hours=1)}]).select("id", "ts")
    r = context.recent_context(anchors, logs).first()
    assert (r["context"], r["n"]) == ("No recent logs.", 0)


def test_graph(make_logs):
    logs = make_logs(
        [{"risk_level": "LOW"}, {"risk_level": "HIGH"}, {"risk_level": "INFO", "ip_address": "10.0.0.2"}, {"risk_level": "ODD", "ip_address": "10.0.0.2"},
         {"user_name": ""}, {"ip_address": None}, {"user_name": "bob", "risk_level": "CRITICAL"}]
    )
    links = graph.edges(logs)
    got = {(r["source"], r["target"]): r["risk_level"] for r in links.collect()}
    assert got == {("user-ann", "ip-10.0.0.1"): "HIGH", ("user-ann", "ip-10.0.0.2"): "INFO", ("user-bob", "ip-10.0.0.1"): "CRITICAL"}
    nodes = graph.nodes(links)
    assert nodes.count() == 4
    kept = graph.filter_edges(links, ["HIGH", "CRITICAL", "INFO"])
    assert kept.count() == 2 and graph.filter_edges(links, search=" BOB").count() == 1
    assert sorted(r["node_id"] for r in graph.visible_nodes(nodes, kept).collect()) == ["ip-10.0.0.1", "user-ann", "user-bob"]
    assert {r["node_id"]: r["degree"] for r in graph.degrees(links).collect()}["user-ann"] == 2
    assert graph.graph_counts(nodes, links).first().asDict() == {"n_nodes": 4, "n_paths": 3}
    assert graph.first_incident_edges(links, 1).count() == 4


def test_logs_that_no_anchor_shows_are_left_out_before_their_texts_are_met(spark, make_logs):
    rows = [{"id": f"{i:03d}", "ts": START + timedelta(minutes=i)} for i in range(60)]
    texts = spark.range(7).select(F.col("id").alias("doc"), F.concat(F.lit("text "), "id").alias("description"))
    logs = make_logs(rows).drop("description").withColumn("doc", F.col("id").cast("long") % 7).join(texts.hint("merge"), "doc")
    out = context.recent_context(make_logs(rows).where("id = '007'").select("id", "ts"), logs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join LeftSemi") > plan.index("Join Inner, (doc")
    assert out.first()["n"] == 6 and [line[-1] for line in out.first()["context"].split("\n")] == list("065432")
