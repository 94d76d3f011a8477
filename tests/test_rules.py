import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from actilens.operators import rules, scans
from actilens.sources.views import PLAYBOOK_SCHEMA

START = datetime(2026, 1, 1)


def book(spark, *rows):
    base = dict(
        id="p", name="n", is_active=True, trigger_field="riskLevel", trigger_operator="equals", trigger_value="CRITICAL",
        action_type="LOCK_USER", action_target=None, min_confidence=0.0, requires_approval=False, rate_limit_count=5,
        rate_limit_window_seconds=300, scope="global",
    )
    names = [c.split()[0] for c in PLAYBOOK_SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], PLAYBOOK_SCHEMA)


def greedy(times, limit, window):
    kept, flags = [], []
    for t in times:
        kept = [k for k in kept if k > t - window]
        flags.append(len(kept) < limit)
        if flags[-1]:
            kept.append(t)
    return flags


def run_limiter(spark, rows, limit, window):
    df = spark.createDataFrame([(k, START + timedelta(seconds=s), f"{i:05d}") for i, (k, s) in enumerate(rows)], "k string, ts timestamp, id string")
    return rules.rate_limit(df, ["k"], F.lit(limit), F.lit(window))


def test_limiter_example(spark):
    out = run_limiter(spark, [("a", s) for s in (0, 10, 20, 29, 31, 41)], 2, 30).orderBy("id")
    assert [r["allowed"] for r in out.collect()] == [True, True, False, False, True, True]


@pytest.mark.parametrize("limit,window,spread", [(1, 5, 400), (3, 60, 2000), (2, 7, 300), (5, 1, 50)])
def test_limiter_against_brute_force(spark, limit, window, spread):
    rng = random.Random(limit * window)
    rows = [("hot" if rng.random() < 0.8 else f"k{rng.randint(0, 4)}", rng.randint(0, spread)) for _ in range(500)]
    got = {(r["k"], r["id"]): r["allowed"] for r in run_limiter(spark, rows, limit, window).collect()}
    assert len(got) == 500
    for key in {k for k, _ in rows}:
        seq = sorted((s, f"{i:05d}") for i, (k, s) in enumerate(rows) if k == key)
        assert [got[(key, i)] for _, i in seq] == greedy([s for s, _ in seq], limit, window)


def test_limiter_bounds_are_at_least_one(spark):
    out = run_limiter(spark, [("a", 0), ("a", 0), ("a", 1)], 0, 0).orderBy("id")
    assert [r["allowed"] for r in out.collect()] == [True, False, True]


def test_match_fields_and_operators(make_logs, spark):
    logs = make_logs(
        [
            {"risk_level": "critical", "description": "Data ExFiltration", "activity_summary": '{"risk_level": "malicious"}'},
            {"risk_level": None, "description": None, "activity_summary": "not json"},
            {"risk_level": "LOW", "activity_summary": '{"risk_level": null}', "user_name": "bob"},
        ]
    )
    books = book(
        spark,
        {"id": "eq"}, {"id": "has", "trigger_field": "description", "trigger_operator": "contains", "trigger_value": "exfil"},
        {"id": "llm", "trigger_field": "llmRiskLevel", "trigger_value": "Malicious"},
        {"id": "blank", "trigger_field": "llmRiskLevel", "trigger_value": ""},
        {"id": "user", "trigger_field": "user", "trigger_value": "BOB"},
        {"id": "off", "is_active": False}, {"id": "odd", "trigger_operator": "matches"}, {"id": "none", "trigger_field": "nothing"},
    )
    for literal in (200, 0):
        pairs = rules.match_rules(logs, books, ["id"], max_literal=literal)
        got = sorted((r["id"], r["playbook_id"]) for r in pairs.collect())
        assert got == [("l0", "eq"), ("l0", "has"), ("l0", "llm"), ("l2", "user")], literal


def test_rules_that_share_an_id_stay_apart(make_logs, spark):
    logs = make_logs([{"risk_level": "CRITICAL", "description": "exfil"}])
    books = book(
        spark, {"id": "p", "action_type": "A"}, {"id": "p", "action_type": "B"}, {"id": "p", "action_type": "B"},
        {"id": "p", "trigger_field": "description", "trigger_value": "exfil", "action_type": "C"},
    )
    for literal in (200, 0):
        got = sorted(r["action_type"] for r in rules.match_rules(logs, books, ["id"], max_literal=literal).collect())
        assert got == ["A", "B", "B", "C"], literal


def test_very_many_fields_and_no_known_field(make_logs, spark):
    logs = make_logs([{"risk_level": "CRITICAL", "location": "here"}])
    many = [{"id": f"n{k}", "trigger_field": f"field{k:04d}"} for k in range(1500)]
    many += [{"id": "a"}, {"id": "z", "trigger_field": "location", "trigger_value": "HERE"}, {"id": "c", "trigger_operator": "contains", "trigger_value": "crit"}]
    for literal in (2000, 0):
        pairs = rules.match_rules(logs, book(spark, *many), ["id"], max_literal=literal)
        assert sorted(r["playbook_id"] for r in pairs.collect()) == ["a", "c", "z"], literal
    for literal in (200, 0):
        assert rules.match_rules(logs, book(spark, {"id": "x", "trigger_field": "nothing"}), ["id"], max_literal=literal).count() == 0


def test_summaries_must_be_one_json_object(spark):
    texts = {
        '{"confidence": 0.9}': 0.9, ' {"confidence": 0.9} ': 0.9, '{"confidence": "0.7"}': 0.7, '{"confidence": true}': 1.0, '{"confidence": "true"}': 0.0,
        '{"confidence": 0.9} x': 0.0, "{'confidence': 0.9}": 0.0, '{"confidence": 0.9}{}': 0.0, '{"confidence": 0.9}]': 0.0, '{"confidence": 0.9}}': 0.0,
        '{"confidence": 0.9}, 1': 0.0, '[{"confidence": 0.9}]': 0.0, "": 0.0, '{"confidence": 7}': 1.0, '{"confidence": null}': 0.0, '{"a": {"b": "x } y"}}': 0.0,
    }
    rows = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t: r.c for r in rows.select("t", rules.confidence(F.col("t")).alias("c")).collect()}
    assert got == {**texts, None: 0.0}
    risk = lambda t: spark.createDataFrame([(t,)], "t string").select(rules.reported_risk(F.col("t")).alias("r")).first().r
    assert [risk(t) for t in ('{"risk_level": "x"}', '{"a": 1}', '{"a": 1} x', "{'risk_level': 'x'}", "")] == ["x", "", None, None, ""]


def test_absent_reported_level_is_blank(make_logs, spark):
    logs = make_logs([{"activity_summary": None}, {"activity_summary": '{"a": 1}'}, {"activity_summary": "[1]"}])
    books = book(spark, {"id": "blank", "trigger_field": "llmRiskLevel", "trigger_value": ""})
    assert sorted(r["id"] for r in rules.match_rules(logs, books, ["id"]).collect()) == ["l0", "l1"]


def test_guard_rail_order(make_logs, spark):
    logs = make_logs(
        [
            {"risk_level": "CRITICAL", "activity_summary": '{"confidence": 0.95}', "location": "Remote"},
            {"risk_level": "CRITICAL", "activity_summary": '{"confidence": 0.95}'},
            {"risk_level": "CRITICAL", "activity_summary": '{"confidence": 0.98}'},
            {"risk_level": "CRITICAL", "activity_summary": '{"confidence": 0.5}'},
        ]
    )
    books = book(spark, {"min_confidence": 0.9, "requires_approval": True, "rate_limit_count": 1, "scope": "internal_only"})
    got = {r["source_log_id"]: (r["status"], r["reason"]) for r in rules.audit(logs, books).collect()}
    assert got == {
        "l0": ("skipped", "scope_mismatch:internal_only"),
        "l1": ("pending_approval", "manual_approval_required"),
        "l2": ("executed", "executed_successfully"),
        "l3": ("skipped", "confidence_below_threshold:0.50"),
    }


def test_skipped_rows_use_no_quota(make_logs, spark):
    rows = [{"risk_level": "CRITICAL", "activity_summary": '{"confidence": %s}' % c} for c in (0.1, 0.9, 0.9)]
    books = book(spark, {"min_confidence": 0.5, "rate_limit_count": 1})
    got = [r["status"] for r in rules.audit(make_logs(rows), books).orderBy("ts").collect()]
    assert got == ["skipped", "executed", "rate_limited"]


def test_status_changes_once_and_last_rule_wins(make_logs, spark):
    users = spark.createDataFrame([("1", "ann", "ACTIVE"), ("2", "bob", "LOCKED")], "id string, user_name string, status string")
    logs = make_logs(
        [{"risk_level": "CRITICAL"}, {"risk_level": "CRITICAL"}, {"risk_level": "HIGH"}, {"risk_level": "CRITICAL", "user_name": "bob"}, {"risk_level": "CRITICAL", "user_name": "ghost"}]
    )
    books = book(spark, {"id": "p1"}, {"id": "p2", "trigger_value": "HIGH", "action_type": "QUARANTINE_USER"}, {"id": "p3", "trigger_value": "HIGH", "action_type": "ALERT_ADMIN"})
    audited = rules.audit(logs, books)
    changes = [(r["source_log_id"], r["before"], r["new_status"]) for r in rules.status_changes(audited, users).orderBy("ts").collect()]
    assert changes == [("l0", "ACTIVE", "LOCKED"), ("l2", "LOCKED", "QUARANTINED")]
    after = {r["user_name"]: r["status"] for r in rules.updated_users(audited, users).collect()}
    assert after == {"ann": "QUARANTINED", "bob": "LOCKED"}
    assert [r["user_name"] for r in rules.unknown_targets(audited, users).collect()] == ["ghost"]
    events = rules.system_events(audited, users, logs).orderBy("activity_type", "ts").collect()
    assert [(e["activity_type"], e["risk_level"]) for e in events] == [("HIGH_PRIORITY_ALERT", "CRITICAL"), ("SOAR_ACTION", "INFO"), ("SOAR_ACTION", "INFO")]
    assert events[0]["details"] == "Triggered by activity from ann: hello" and events[0]["user_name"] == "SOAR_ENGINE"


def test_targets(spark):
    rows = [("t", "BLOCK_IP", "ip", "u"), (None, "BLOCK_IP", "ip", "u"), ("", "LOCK_USER", "ip", "u"), (None, "BLOCK_IP", None, "u"), (None, "X", "ip", None)]
    df = spark.createDataFrame(rows, "t string, a string, i string, u string")
    got = [r[0] for r in df.select(rules.action_target(*[F.col(c) for c in "taiu"])).collect()]
    assert got == ["t", "ip", "u", "", ""]


def test_client_variant_ignores_server_fields(make_logs, spark):
    users = spark.createDataFrame([("1", "ann")], "id string, user_name string")
    logs = make_logs([{"risk_level": "CRITICAL", "activity_summary": '{"risk_level": "x"}'}])
    books = book(spark, {"id": "a"}, {"id": "b", "trigger_field": "llmRiskLevel", "trigger_value": "x"}, {"id": "c", "action_type": "BLOCK_IP"})
    got = {r["playbook_id"]: (r["new_status"], r["user_id"]) for r in rules.client_matches(logs, books, users).collect()}
    assert got == {"a": ("LOCKED", "1"), "c": (None, None)}


def test_nested_rules_with_defaults(spark):
    full = book(spark, {"min_confidence": 0.75, "requires_approval": True, "rate_limit_count": 2, "rate_limit_window_seconds": 60, "scope": "internal_only"})
    r = scans.rules(full).first()
    assert r["trigger"]["field"] == "riskLevel" and r["action"]["type"] == "LOCK_USER" and r["min_confidence"] == 0.75
    bare = book(spark, {"min_confidence": None, "requires_approval": None, "rate_limit_count": None, "rate_limit_window_seconds": None, "scope": ""})
    r = scans.rules(bare).first()
    assert (r["min_confidence"], r["requires_approval"], r["rate_limit_count"], r["rate_limit_window_seconds"], r["scope"]) == (0.0, False, 5, 300, "global")


def test_request_logs(spark):
    df = spark.createDataFrame(
        [("1", START, "block_ip", "1.2.3.4", None, "ann"), ("2", START, "isolate_host", "h", "", "ann"), ("3", START, "reset_password", "u", "why", "ann")],
        "request_id string, ts timestamp, action string, target string, reason string, requested_by string",
    )
    got = [(r["risk_level"], r["details"], r["ip_address"]) for r in rules.request_logs(df).orderBy("id").collect()]
    assert got == [("INFO", "Reason: Manual Action", "1.2.3.4"), ("HIGH", "Reason: Manual Action", None), ("MEDIUM", "Reason: why", None)]
