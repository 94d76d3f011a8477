"""The derived tables again, written as plain SQL for the comparison engine."""

from __future__ import annotations

import re

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "logs_core": ((), """
select cast(event_id as varchar) as id, cast(ts as timestamp) as ts, 'u' || cast(user_id as varchar) as user_name,
  upper(event_type) as activity_type,
  case when value >= 200 then 'CRITICAL' when value >= 100 then 'HIGH' when value >= 50 then 'MEDIUM'
       when value >= 20 then 'LOW' else 'INFO' end as risk_level,
  '10.0.' || cast(user_id % 7 as varchar) || '.' || cast(event_id % 40 as varchar) as ip_address,
  case when user_id % 3 = 0 then 'Internal' when user_id % 3 = 1 then 'Remote' end as location,
  '{"confidence": ' || cast(cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as varchar) || 'e-2, "risk_level": "' ||
    case when value >= 100 then 'MALICIOUS' else 'BENIGN' end || '"}' as activity_summary,
  event_id, user_id, value, props
from events"""),
    "logs": (("logs_core",), """
select c.id, c.ts, c.user_name, c.activity_type, c.risk_level, d.text as description,
  'session of ' || c.user_name || ' from ' || c.ip_address || ' ' || c.props as details, c.ip_address, c.location, c.activity_summary
from logs_core c join documents d on d.doc_id = c.event_id % (select count(*) from documents)"""),
    "traffic": ((), """
select cast(l_orderkey as varchar) || '-' || cast(l_linenumber as varchar) as id, cast(l_shipdate as timestamp) as ts,
  '10.1.' || cast(cast(floor(l_suppkey / 256.0) as bigint) as varchar) || '.' || cast(l_suppkey % 256 as varchar) as source_ip,
  case when l_partkey % 5 = 0 then '192.168.1.' || cast(l_partkey % 250 as varchar)
       else '45.33.' || cast(l_partkey % 200 as varchar) || '.11' end as destination_ip,
  cast(1 + cast(floor(l_quantity) as bigint) % (3 + l_suppkey % 15) as bigint) as port,
  case when l_returnflag = 'A' then 'UDP' else 'TCP' end as protocol,
  cast(floor(l_extendedprice * 1024) as bigint) as bytes_transferred,
  cast(floor(l_quantity * l_quantity * 5) as bigint) as packet_count
from lineitem"""),
    "users": ((), """
select cast(c_custkey as varchar) as id, 'u' || cast(c_custkey as varchar) as user_name,
  case when c_custkey % 20 = 0 then 'Administrator' when c_custkey % 20 < 5 then 'Security Analyst'
       when c_custkey % 20 < 8 then 'Auditor' else 'Standard User' end as role,
  case when c_custkey % 20 = 0 then 'ADMIN' when c_custkey % 20 < 5 then 'L2' else 'L1' end as clearance_level,
  case when c_custkey % 11 = 0 then 'LOCKED' when c_custkey % 7 = 0 then 'INACTIVE' else 'ACTIVE' end as status
from customer"""),
    "sessions": ((), """
select cast(event_id as varchar) as id, cast(ts as timestamp) as ts, 'u' || cast(user_id as varchar) as user_name, 'KEYLOG' as activity_type,
  case when event_id % 50 = 0 then 'not json'
       when event_id % 3 = 0 then '{"a": ' || regexp_extract(props, '([0-9]+)', 1) || ', "Key.space": ' || cast(event_id % 4 as varchar) || '}'
       else '{"key_counts": {"a": ' || regexp_extract(props, '([0-9]+)', 1) || ', "b": ' || cast(event_id % 5 as varchar) ||
            '}, "duration_seconds": ' || cast(event_id % 60 as varchar) || '.5, "total_keystrokes": ' || cast(event_id % 90 as varchar) ||
            ', "active_window": "' || case when event_id % 13 = 0 then '' else 'app' || cast(event_id % 9 as varchar) end || '"}'
  end as activity_summary
from events"""),
    "posts": ((), "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, html from pages"),
    "predictions": ((), """
select l.doc_id as id, l.quality as y_true, case when d.n_chars % 1000 >= 300 then 1 else 0 end as y_pred,
  cast(d.n_chars % 1000 as double) / 1000 as score, d.lang as model_name, cast(d.n_chars % 97 as double) / 10 as latency_ms
from labels l join documents d on d.doc_id = l.doc_id"""),
    "metric_points": ((), """
select 'h' || cast(user_id % 5 as varchar) as host, cast(ts as timestamp) as ts, least(value, 100e0) as cpu_usage,
  17179869184 as memory_total, cast(floor(value * 1000000) as bigint) as memory_used,
  500000000000 as disk_total, cast(floor(value * 100000000) as bigint) as disk_used
from events"""),
    "interface_counters": ((), """
select case when user_id % 4 = 0 then 'lo' else 'eth' end || cast(user_id % 4 as varchar) as iface, cast(ts as timestamp) as ts,
  cast(floor(value * 1000) as bigint) as bytes_sent, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) * 100 as bytes_recv
from events"""),
    "user_rules": (("users",), """
select 'rule-' || id as id, 'watch ' || user_name as name, status = 'ACTIVE' as is_active, 'user' as trigger_field, 'equals' as trigger_operator,
  user_name as trigger_value, case when role = 'Administrator' then 'ALERT_ADMIN' else 'LOCK_USER' end as action_type,
  case when k % 4 <> 0 then 0.5e0 end as min_confidence, case when k % 5 <> 0 then clearance_level = 'L1' end as requires_approval,
  case when k % 6 <> 0 then cast(k % 9 as integer) end as rate_limit_count, case when k % 7 <> 0 then 3600 end as rate_limit_window_seconds,
  case when k % 8 = 0 then '' when k % 3 <> 0 then 'internal_only' end as scope
from (select *, cast(id as bigint) as k from users)"""),
    "playbooks": ((), """
select * from (values
  ('p1', 'lock critical', true,  'riskLevel',    'equals',   'critical',  'LOCK_USER',       0.0e0,  false, 2, 86400, 'global'),
  ('p2', 'alert high',    true,  'riskLevel',    'equals',   'HIGH',      'ALERT_ADMIN',     0.5e0,  false, 3, 3600,  'internal_only'),
  ('p3', 'text rule',     true,  'description',  'contains', 'tion',      'QUARANTINE_USER', 0.9e0,  true,  1, 600,   'global'),
  ('p4', 'llm rule',      true,  'llmRiskLevel', 'equals',   'malicious', 'BLOCK_IP',        0.2e0,  false, 5, 300,   'global'),
  ('p5', 'off',           false, 'activityType', 'equals',   'ERROR',     'LOCK_USER',       0.0e0,  false, 5, 300,   'global'),
  ('p6', 'bad operator',  true,  'activityType', 'matches',  'ERROR',     'LOCK_USER',       0.0e0,  false, 5, 300,   'global'),
  ('p7', 'no such field', true,  'nothing',      'equals',   'x',         'LOCK_USER',       0.0e0,  false, null, null, null)
) as t(id, name, is_active, trigger_field, trigger_operator, trigger_value, action_type, min_confidence, requires_approval,
       rate_limit_count, rate_limit_window_seconds, scope)"""),
    "keyword_clusters": ((), """
select *, 'manual' as source from (values ('alpha','tion'), ('alpha','whst'), ('beta','eaux'), ('beta','quei'), ('gamma','zero-day'), ('gamma','token'))
  as t(cluster, keyword)"""),
    "interface_addresses": ((), """
select * from (values ('eth1','10.1.0.1'), ('eth1','10.1.0.2'), ('eth2','10.1.0.3'), ('eth2','10.1.0.1')) as t(iface, address)"""),
    "federated_updates": ((), """
select 'r' || cast(label as varchar) as round_id, 'a' || cast(vec_id as varchar) as agent_id, cast(embedding as double[]) as masked_update,
  1 + vec_id % 7 as num_samples, 1e0 as epsilon, 3 as min_clients, 300 as timeout_seconds,
  timestamp '2026-01-01 00:00:00' + to_seconds(vec_id + copy) as submitted_at, cast(vec_id as varchar) || '-' || cast(copy as varchar) as message_id
from embeddings, (values (0), (1)) as c(copy) where copy = 0 or vec_id % 25 = 0"""),
    "federated_reveals": ((), """
select 'r' || cast(label as varchar) as round_id, 'a' || cast(vec_id as varchar) as agent_id,
  list_transform(cast(embedding as double[]), lambda x: x * 0.5e0) as mask, timestamp '2026-01-02 00:00:00' + to_seconds(vec_id) as revealed_at
from embeddings where not (vec_id % 10 = 9 and label % 2 = 0)"""),
    "device_snapshots": ((), """
select 'h' || cast(o_custkey % 20 as varchar) as host, cast(o_orderdate as timestamp) as ts, o_orderkey as snapshot_id,
  list_sort(list(distinct 'dev' || cast(l_partkey % 8 as varchar))) as devices
from orders join lineitem on l_orderkey = o_orderkey group by o_orderkey, o_custkey, o_orderdate"""),
    "action_requests": ((), """
select cast(event_id as varchar) as request_id, cast(ts as timestamp) as ts,
  case event_id % 3 when 0 then 'block_ip' when 1 then 'isolate_host' else 'reset_password' end as action,
  case when event_id % 3 = 0 then '10.9.0.' || cast(event_id % 200 as varchar)
       when event_id % 3 = 1 then 'host' || cast(event_id % 50 as varchar)
       when event_id % 2 = 0 then 'u' || cast(event_id % 3000 as varchar) else cast(event_id % 3000 as varchar) end as target,
  case when event_id % 5 <> 0 then 'ticket ' || cast(event_id as varchar) end as reason, 'u' || cast(user_id as varchar) as requested_by
from events where event_type = 'error'"""),
    "clipboard": ((), """
select 'c' || cast(conv_id % 40 as varchar) as user_name, conv_id * 100 + turn as seq,
  timestamp '2026-01-01 00:00:00' + to_seconds(conv_id * 100 + turn) as ts,
  case when turn % 3 = 0 then '  ' || role || ' ' else text end as content
from conversations"""),
}


def with_views(body: str) -> str:
    """Put the derived tables a query names in front of it as common table expressions."""
    needed: list[str] = []

    def add(name: str) -> None:
        deps, _ = VIEWS[name]
        for dep in deps:
            add(dep)
        if name not in needed:
            needed.append(name)

    for name in VIEWS:
        if re.search(rf"\b{name}\b", body):
            add(name)
    ctes = ",\n".join(f"{name} as ({VIEWS[name][1]})" for name in needed)
    text = body.strip()
    lowered = text.lower()
    if lowered.startswith("with recursive"):
        return f"with recursive {ctes}, {text[len('with recursive'):]}" if ctes else text
    if lowered.startswith("with "):
        return f"with {ctes}, {text[4:]}" if ctes else text
    return f"with {ctes}\n{text}" if ctes else text
