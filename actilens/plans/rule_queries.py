"""Queries for response rules, rate limiting, status changes and derived events."""

from __future__ import annotations

from pyspark.sql import functions as F

from actilens.operators import markov, rules
from actilens.plans.registry import query
from actilens.session import cut_lineage

FIELD_SQL = """case p.trigger_field when 'riskLevel' then l.risk_level when 'activityType' then l.activity_type when 'description' then l.description
  when 'llmRiskLevel' then coalesce(json_extract_string(l.activity_summary, '$.risk_level'), '') end"""
PAIRS_SQL = f"""
select l.id, l.ts, l.user_name, l.ip_address, l.location, l.risk_level, l.activity_summary, p.id as playbook_id, p.name as playbook_name,
  p.action_type, p.min_confidence, p.requires_approval, p.rate_limit_count, p.rate_limit_window_seconds, p.scope
from logs l join playbooks p on p.is_active and ((p.trigger_operator = 'equals' and upper({FIELD_SQL}) = upper(p.trigger_value))
  or (p.trigger_operator = 'contains' and contains(upper({FIELD_SQL}), upper(p.trigger_value))))"""
GUARDED_SQL = f"""
select *, case when outside or low then 'skipped' when approval then 'pending_approval' end as status,
  case when outside then 'scope_mismatch:' || scope when low then printf('confidence_below_threshold:%.2f', round(confidence, 2))
       when approval then 'manual_approval_required' end as reason
from (select *, scope = 'internal_only' and lower(coalesce(location, '')) not in ('internal', 'local', 'agent-monitored-device') as outside,
        confidence < coalesce(min_confidence, 0) as low, requires_approval and confidence < 0.98e0 as approval
      from (select *, least(1e0, greatest(0e0, coalesce(try_cast(json_extract_string(activity_summary, '$.confidence') as double), 0e0))) as confidence,
              case when action_type = 'BLOCK_IP' then coalesce(ip_address, '') else coalesce(user_name, '') end as target
            from ({PAIRS_SQL})))"""


def limiter_sql(source: str, keys: list[str]) -> str:
    """Recursive steps over numbered rows; ``source`` has the keys, ts, id, lim and win (seconds)."""
    k = ", ".join(keys)
    sk = ", ".join(f"s.{c}" for c in keys)
    on = " and ".join(f"s.{c} = p.{c}" for c in keys)
    live = "list_filter(p.adm, lambda x: x > s.us - cast(s.win as bigint) * 1000000)"
    return f"""with recursive
numbered as (select *, epoch_us(ts) as us, row_number() over (partition by {k} order by ts, id) as rn from ({source})),
walk as (
  select {k}, id, rn, true as allowed, [us] as adm from numbered where rn = 1
  union all
  select {sk}, s.id, s.rn, len({live}) < s.lim, case when len({live}) < s.lim then list_append({live}, s.us) else {live} end
  from walk p join numbered s on {on} and s.rn = p.rn + 1)"""


OPEN_SQL = f"""select *, coalesce(nullif(target, ''), '-') as t, greatest(coalesce(rate_limit_count, 1), 1) as lim,
  greatest(coalesce(rate_limit_window_seconds, 1), 1) as win from guarded where status is null"""
AUDIT_SQL = f"""with recursive guarded as materialized ({GUARDED_SQL}),
{limiter_sql(OPEN_SQL, ['playbook_id', 't'])[len('with recursive'):]},
audited as materialized (
  select id, ts, playbook_id, playbook_name, user_name, action_type, target, status, reason, risk_level, confidence from guarded where status is not null
  union all
  select g.id, g.ts, g.playbook_id, g.playbook_name, g.user_name, g.action_type, g.target, case when w.allowed then 'executed' else 'rate_limited' end,
    case when w.allowed then 'executed_successfully' else 'rate_limit_exceeded' end, g.risk_level, g.confidence
  from guarded g join walk w on w.playbook_id = g.playbook_id and w.id = g.id where g.status is null)"""
CHANGES_SQL = """changes as (
  select *, coalesce(lag(new_status) over (partition by user_name order by ts, id, playbook_id), old_status) as before
  from (select a.*, u.status as old_status, case a.action_type when 'LOCK_USER' then 'LOCKED' else 'QUARANTINED' end as new_status
        from audited a join users u on u.user_name = a.user_name
        where a.status = 'executed' and a.action_type in ('LOCK_USER', 'QUARANTINE_USER')))"""


@query("j01_rule_match", f"select id, playbook_id, action_type from ({PAIRS_SQL})")
def _(t):
    return rules.match_rules(t.logs, t.playbooks, ["id"]).select("id", "playbook_id", "action_type")


@query("j01_rule_match_joined", f"select id, playbook_id, action_type from ({PAIRS_SQL})")
def _(t):
    return rules.match_rules(t.logs, t.playbooks, ["id"], max_literal=0).select("id", "playbook_id", "action_type")


@query("j02_known_users", """
select l.id, l.user_name, u.id as user_id, u.status from logs_core l join users u on u.user_name = l.user_name""")
def _(t):
    u = t.users.select("user_name", F.col("id").alias("user_id"), "status")
    return t.logs_slim.select("id", "user_name").join(u, "user_name")


@query("j02_unknown_users", "select id, user_name from logs_core where user_name not in (select user_name from users)")
def _(t):
    return t.logs_slim.select("id", "user_name").join(t.users.select("user_name"), "user_name", "left_anti")


@query("j03_client_match", """
select l.id, l.user_name, p.id as playbook_id, p.action_type,
  case p.action_type when 'LOCK_USER' then 'LOCKED' when 'QUARANTINE_USER' then 'QUARANTINED' end as new_status,
  case when p.action_type in ('LOCK_USER', 'QUARANTINE_USER') then u.id end as user_id
from logs l join playbooks p on p.is_active and (
    (p.trigger_operator = 'equals' and upper(case p.trigger_field when 'riskLevel' then l.risk_level when 'activityType' then l.activity_type when 'description' then l.description end) = upper(p.trigger_value))
    or (p.trigger_operator = 'contains' and contains(upper(case p.trigger_field when 'riskLevel' then l.risk_level when 'activityType' then l.activity_type when 'description' then l.description end), upper(p.trigger_value))))
  left join users u on u.user_name = l.user_name""")
def _(t):
    return rules.client_matches(t.logs, t.playbooks, t.users)


@query("h15_confidence", """
select id, least(1e0, greatest(0e0, coalesce(try_cast(json_extract_string(s, '$.confidence') as double), 0e0))) as confidence
from (select id, case event_id % 6 when 0 then '{"confidence": 7}' when 1 then '{"other": 1}' when 2 then '{"confidence": "x"}' else activity_summary end as s from logs_core)""")
def _(t):
    e = F.col("event_id") % 6
    s = F.when(e == 0, '{"confidence": 7}').when(e == 1, '{"other": 1}').when(e == 2, '{"confidence": "x"}').otherwise(F.col("activity_summary"))
    return t.logs_core.select("id", rules.confidence(s).alias("confidence"))


@query("h16_action_target", f"select id, playbook_id, target from ({GUARDED_SQL})")
def _(t):
    return rules.guarded_pairs(t.logs, t.playbooks).select("id", "playbook_id", "target")


@query("h17_scope", """
select id, lower(coalesce(location, '')) in ('internal', 'local', 'agent-monitored-device') as internal_only, true as global, true as other from logs_core""")
def _(t):
    where = F.col("location")
    return t.logs_slim.select(
        "id", rules.scope_matches(F.lit("internal_only"), where).alias("internal_only"),
        rules.scope_matches(F.lit("global"), where).alias("global"), rules.scope_matches(F.lit("elsewhere"), where).alias("other"),
    )


@query("h18_approval", """
select id, value % 3 < 1 and value / 100 < 0.98e0 as needed from logs_core""")
def _(t):
    return t.logs_core.select("id", rules.needs_approval(F.col("value") % 3 < 1, F.col("value") / 100).alias("needed"))


@query("o02_guard_rails", f"{AUDIT_SQL} select id as source_log_id, playbook_id, status, reason from audited")
def _(t):
    return rules.audit(t.logs, t.playbooks).select("source_log_id", "playbook_id", "status", "reason")


@query("o03_audit", f"""{AUDIT_SQL}
select sha256(playbook_id || '|' || id) as audit_id, ts, playbook_id, playbook_name, id as source_log_id, user_name, action_type, target, status, reason, risk_level, confidence from audited""")
def _(t):
    return rules.audit(t.logs, t.playbooks)


def _stored_audit(t):
    """The audit as the stored table that the later steps read."""
    return cut_lineage(rules.audit(t.logs, t.playbooks))


@query("o04_user_status", f"""{AUDIT_SQL},
last as (select user_name, arg_max(case action_type when 'LOCK_USER' then 'LOCKED' else 'QUARANTINED' end, (epoch_us(ts), id, playbook_id)) as s
  from audited where status = 'executed' and action_type in ('LOCK_USER', 'QUARANTINE_USER') group by user_name)
select u.id, u.user_name, u.role, u.clearance_level, coalesce(l.s, u.status) as status from users u left join last l on l.user_name = u.user_name""")
def _(t):
    return rules.updated_users(_stored_audit(t), t.users)


@query("w11_status_changes", f"{AUDIT_SQL}, {CHANGES_SQL} select user_name, ts, id as source_log_id, playbook_id, before, new_status from changes where before <> new_status")
def _(t):
    return rules.status_changes(_stored_audit(t), t.users).select(
        "user_name", "ts", "source_log_id", "playbook_id", "before", "new_status"
    )


@query("o05_system_events", f"""{AUDIT_SQL}, {CHANGES_SQL}
select sha256('action|' || playbook_id || '|' || id) as id, ts, 'SOAR_ACTION' as activity_type, 'INFO' as risk_level,
  'User ' || user_name || ' account ' || new_status as description, 'Triggered by playbook: ' || playbook_name as details, 'SOAR_ENGINE' as user_name, 'Internal' as location
from changes where before <> new_status
union all
select sha256('alert|' || a.playbook_id || '|' || a.id), a.ts, 'HIGH_PRIORITY_ALERT', 'CRITICAL', 'Alert: ' || a.playbook_name,
  'Triggered by activity from ' || a.user_name || ': ' || l.description, 'SOAR_ENGINE', 'Internal'
from audited a join logs l on l.id = a.id where a.status = 'executed' and a.action_type = 'ALERT_ADMIN'""")
def _(t):
    return rules.system_events(_stored_audit(t), t.users, t.logs)


@query("o06_unknown_actions", f"{AUDIT_SQL} select id as source_log_id, playbook_id, target from audited where status = 'executed' and action_type not in ('LOCK_USER', 'QUARANTINE_USER', 'ALERT_ADMIN')")
def _(t):
    known = ["LOCK_USER", "QUARANTINE_USER", "ALERT_ADMIN"]
    a = rules.audit(t.logs, t.playbooks)
    return a.filter((F.col("status") == "executed") & ~F.col("action_type").isin(known)).select("source_log_id", "playbook_id", "target")


@query("o09_action_logs", """
select request_id as id, ts, requested_by as user_name, 'SOAR_ACTION' as activity_type,
  case action when 'block_ip' then 'INFO' when 'isolate_host' then 'HIGH' else 'MEDIUM' end as risk_level,
  case action when 'block_ip' then 'Blocked IP Address: ' when 'isolate_host' then 'Isolated Host: ' else 'Reset Password for User: ' end || target as description,
  'Reason: ' || coalesce(nullif(reason, ''), 'Manual Action') as details, case when action = 'block_ip' then target end as ip_address, 'Internal' as location
from action_requests""")
def _(t):
    return rules.request_logs(t.action_requests)


TRANSITIONS_SQL = """select activity_type, nxt as next_activity, count(*) as n from (
  select activity_type, lead(activity_type) over (partition by user_name order by ts, id) as nxt from logs_core) where nxt is not null group by 1, 2"""
PREDICTIONS_SQL = f"""select activity_type, next_activity, probability, rank, 'Based on historical frequency' as reason from (
  select *, row_number() over (partition by activity_type order by probability desc, next_activity) as rank
  from (select *, n / sum(n) over (partition by activity_type) as probability from ({TRANSITIONS_SQL}))) where rank <= 3"""


@query("w01_next_activity", "select id, activity_type, lead(activity_type) over (partition by user_name order by ts, id) as next_activity from logs_core")
def _(t):
    return markov.next_activities(t.logs_slim).select("id", "activity_type", "next_activity")


@query("a16_transitions", TRANSITIONS_SQL)
def _(t):
    return markov.transitions(t.logs_slim)


@query("w02_predictions", PREDICTIONS_SQL)
def _(t):
    return markov.predictions(markov.transitions(t.logs_slim))


@query("k05_predict_next", f"select * from ({PREDICTIONS_SQL}) where activity_type = 'ERROR'")
def _(t):
    return markov.predict_next(markov.transitions(t.logs_slim), "ERROR")


@query("o10_severe_predictions", f"""
select l.id, p.* from logs_core l join ({PREDICTIONS_SQL}) p on p.activity_type = l.activity_type where l.risk_level in ('HIGH', 'CRITICAL')""")
def _(t):
    return markov.severe_log_predictions(t.logs_slim, markov.transitions(t.logs_slim))


LIMIT_SQL = limiter_sql("select id, ts, user_name, activity_type, 2 as lim, 86400 as win from logs_core", ["user_name"])


@query("w03_rate_limit", f"{LIMIT_SQL} select user_name, id, allowed from walk")
def _(t):
    limited = rules.rate_limit(t.logs_slim.select("id", "ts", "user_name"), ["user_name"], F.lit(2), F.lit(86400))
    return limited.select("user_name", "id", "allowed")
