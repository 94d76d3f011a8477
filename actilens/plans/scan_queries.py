"""Queries for scans, filters, searches, exports, top-k and the report family."""

from __future__ import annotations

from pyspark.sql import functions as F

from actilens.functions import casts, risk, timefns
from actilens.operators import reports, scans
from actilens.plans.registry import query

LOG_COLS = ["id", "ts", "user_name", "activity_type", "risk_level", "description"]
AS_OF = "2024-01-30 12:00:00"
ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')"


@query("s01_log_page", "select id, ts, user_name, activity_type, risk_level, description from logs order by ts desc, id limit 100 offset 20")
def _(t):
    return scans.newest(t.logs.select(LOG_COLS), limit=100, skip=20)


@query("s02_traffic_page", "select * from traffic order by ts desc, id, bytes_transferred, source_ip limit 100")
def _(t):
    order = [F.desc("ts"), F.asc("id"), F.asc("bytes_transferred"), F.asc("source_ip")]
    return scans.page(t.traffic, order, limit=100)


@query("s03_user_page", "select * from users order by id limit 100 offset 10")
def _(t):
    return scans.users_page(t.users, skip=10, limit=100)


@query("s04_rules", """
select id, name, is_active, trigger_field as field, trigger_operator as operator, trigger_value as value, action_type as type,
  coalesce(min_confidence, 0e0) as min_confidence, coalesce(requires_approval, false) as requires_approval,
  coalesce(rate_limit_count, 5) as rate_limit_count, coalesce(rate_limit_window_seconds, 300) as rate_limit_window_seconds,
  coalesce(nullif(scope, ''), 'global') as scope
from user_rules""")
def _(t):
    return scans.rules(t.user_rules).select(
        "id", "name", "is_active", "trigger.*", F.col("action.type"), "min_confidence", "requires_approval",
        "rate_limit_count", "rate_limit_window_seconds", "scope",
    )


@query("s07_training_rows", "select ts, user_name, activity_type, risk_level, description from logs order by ts desc, id limit 50000")
def _(t):
    return scans.training_rows(t.logs)


@query("s08_csv_export", f"""
select id as "ID", {ISO.format('ts')} as "Timestamp", user_name as "User", activity_type as "Activity", risk_level as "Risk Level",
  description as "Description", ip_address as "IP", details as "Details" from logs""")
def _(t):
    return scans.csv_rows(t.logs)


@query("s09_json_export", f"""
select id, {ISO.format('ts')} as "timestamp", user_name as "user", activity_type, risk_level, description, details, ip_address, location from logs""")
def _(t):
    return scans.json_rows(t.logs)


@query("s10_report_rows", f"""
select substring({ISO.format('ts')}, 1, 19) as "timestamp", risk_level as "level", substring(user_name, 1, 20) as "user",
  substring(description, 1, 50) as description from logs""")
def _(t):
    return scans.report_rows(t.logs)


@query("s12_ranged_export", f"""
select id, {ISO.format('ts')} as "timestamp", user_name as "user", activity_type, risk_level, description, details, ip_address, location
from logs where ts >= timestamp '2024-01-05 00:00:00' and ts <= timestamp '2024-01-20 06:30:00'""")
def _(t):
    return scans.json_rows(scans.time_range(t.logs, "2024-01-05", "2024-01-20T06:30:00"))


@query("s16_metric_retention", "select * from metric_points where ts >= timestamp '2024-01-29 12:00:00'")
def _(t):
    return scans.retained(t.metric_points, AS_OF)


@query("f01_time_range", "select id, ts from logs_core where ts >= timestamp '2024-01-10 00:00:00' and ts <= timestamp '2024-01-12 00:00:00'")
def _(t):
    return scans.time_range(t.logs_slim, "2024-01-10", "2024-01-12").select("id", "ts")


@query("f02_log_search", """
select id, user_name, risk_level, length(description) as n from logs
where (contains(lower(description), 'tion d') or contains(lower(user_name), 'tion d')) and risk_level = 'HIGH'""")
def _(t):
    return scans.search_logs(t.logs, "Tion D", "HIGH").select("id", "user_name", "risk_level", F.length("description").alias("n"))


@query("f03_user_search", "select * from users where (contains(lower(user_name), 'a') or contains(lower(role), 'a')) and status = 'ACTIVE' and clearance_level = 'L2'")
def _(t):
    return scans.search_users(t.users, "A", status="ACTIVE", clearance="L2")


@query("f04_activity_filter", "select id, ts, user_name from logs_core where activity_type = 'ERROR'")
def _(t):
    return scans.of_activity(t.logs_slim, "ERROR").select("id", "ts", "user_name")


@query("f05_severe_filter", "select id, ts, user_name, risk_level from logs_core where risk_level in ('HIGH', 'CRITICAL')")
def _(t):
    return t.logs_slim.filter(risk.is_severe(F.col("risk_level"))).select("id", "ts", "user_name", "risk_level")


@query("f07_scoring_defaults", """
select id, coalesce(nullif(case when event_id % 7 = 0 then '' else user_name end, ''), 'unknown') as user_name,
  coalesce(nullif(case when event_id % 11 = 0 then null else activity_type end, ''), 'UNKNOWN') as activity_type,
  coalesce(nullif(case when event_id % 13 = 0 then '' else risk_level end, ''), 'INFO') as risk_level,
  coalesce(nullif(case when event_id % 17 = 0 then null else props end, ''), '') as description from logs_core""")
def _(t):
    e = F.col("event_id")
    blanked = t.logs_core.select(
        "id",
        F.when(e % 7 == 0, "").otherwise(F.col("user_name")).alias("user_name"),
        F.when(e % 11 != 0, F.col("activity_type")).alias("activity_type"),
        F.when(e % 13 == 0, "").otherwise(F.col("risk_level")).alias("risk_level"),
        F.when(e % 17 != 0, F.col("props")).alias("description"),
    )
    return scans.scoring_defaults(blanked)


@query("f08_safe_casts", """
select id, case when regexp_full_match(v, '[0-9]+') then cast(v as bigint) else 0 end as as_int,
  coalesce(try_cast(v as double), -1e0) as as_float
from (select id, case event_id % 3 when 0 then props when 1 then regexp_extract(props, '([0-9]+)', 1)
             else regexp_extract(props, '([0-9]+)', 1) || '.7' end as v from logs_core)""")
def _(t):
    e, digits = F.col("event_id"), F.regexp_extract("props", "([0-9]+)", 1)
    v = F.when(e % 3 == 0, F.col("props")).when(e % 3 == 1, digits).otherwise(F.concat(digits, F.lit(".7")))
    return t.logs_core.select("id", casts.safe_int(v).alias("as_int"), casts.safe_float(v, -1.0).alias("as_float"))


@query("f09_attack_label", """
select id, case when risk_level in ('HIGH', 'CRITICAL') then 1 else 0 end as attack,
  case when risk_level in ('HIGH', 'CRITICAL') then -1 else 1 end as anomaly from logs_core""")
def _(t):
    level = F.col("risk_level")
    return t.logs_slim.select("id", risk.attack_label(level).alias("attack"), risk.anomaly_label(level).alias("anomaly"))


@query("f10_risk_class", "select id, case risk_level when 'MEDIUM' then 1 when 'HIGH' then 2 when 'CRITICAL' then 3 else 0 end as risk_class from logs_core")
def _(t):
    return t.logs_slim.select("id", risk.risk_class(F.col("risk_level")).alias("risk_class"))


@query("f11_risk_score", """
select id, case upper(lower(risk_level)) when 'MEDIUM' then 5 when 'HIGH' then 8 when 'CRITICAL' then 10 else 1 end as risk_score from logs_core""")
def _(t):
    return t.logs_slim.select("id", risk.risk_score(F.lower("risk_level")).alias("risk_score"))


@query("f12_edge_rank", "select id, case risk_level when 'LOW' then 1 when 'MEDIUM' then 2 when 'HIGH' then 3 when 'CRITICAL' then 4 else 0 end as edge_rank from logs_core")
def _(t):
    return t.logs_slim.select("id", risk.edge_rank(F.col("risk_level")).alias("edge_rank"))


@query("f15_metrics_history", """
select host, ts, cpu_usage as usage_percent, memory_total - memory_used as memory_available, disk_total - disk_used as disk_free
from metric_points where ts >= timestamp '2024-01-29 12:00:00'""")
def _(t):
    h = scans.metrics_history(t.metric_points, AS_OF)
    return h.select(
        "host", "ts", "cpu.usage_percent", F.col("memory.available").alias("memory_available"), F.col("disk.free").alias("disk_free")
    )


QUEUE_SQL = """select event_id as id, event_id % 12 as retries, ts + to_seconds(event_id % 600) as next_attempt from logs_core"""


def _queue(t):
    seconds = (F.col("event_id") % 600).cast("long") * 1_000_000
    return t.logs_core.select(
        F.col("event_id").alias("id"), (F.col("event_id") % 12).alias("retries"),
        F.timestamp_micros(F.unix_micros("ts") + seconds).alias("next_attempt"),
    )


@query("f17_due_rows", f"select * from ({QUEUE_SQL}) where next_attempt <= timestamp '2024-01-10 00:00:00' order by id limit 50")
def _(t):
    return scans.due_rows(_queue(t), "2024-01-10 00:00:00", 50)


@query("h21_retry_backoff", f"""
select id, retries + 1 as retries, cast(least(300, power(2, least(retries + 1, 8))) as integer) as delay from ({QUEUE_SQL})""")
def _(t):
    return _queue(t).select("id", (F.col("retries") + 1).alias("retries"), timefns.retry_delay(F.col("retries")).alias("delay"))


@query("f18_active_rules", "select id, name, trigger_value from user_rules where is_active")
def _(t):
    return scans.active_rules(t.user_rules).select("id", "name", "trigger_value")


@query("f19_role_permissions", """
select id, user_name, role, case role when 'Administrator' then 4 when 'Security Analyst' then 2 when 'Auditor' then 1 else 0 end as n_permissions
from users where role in ('Administrator', 'Security Analyst')""")
def _(t):
    p = scans.with_permissions(t.users).filter(F.array_contains("permissions", "EXPORT_DATA"))
    return p.select("id", "user_name", "role", F.size("permissions").alias("n_permissions"))


SCORE_SQL = """
select total_logs, critical, high, case when total_logs > 0 then least(100e0, (critical * 10 + high * 5) / cast(total_logs as double) * 100) else 0e0 end as raw, flagged
from (select count(*) as total_logs, count(*) filter (risk_level = 'CRITICAL') as critical, count(*) filter (risk_level = 'HIGH') as high,
        list_sort(list(id) filter (risk_level = 'CRITICAL')) as flagged
      from (select * from logs_core order by ts desc, id limit 100))"""


@query("a01_threat_report", f"select total_logs, critical, high, round(raw, 2) as threat_score from ({SCORE_SQL})")
def _(t):
    return reports.threat_report(t.logs_slim).select("total_logs", "critical", "high", "threat_score")


@query("a01_threat_report_all", f"""
select total_logs, critical, high, round(raw, 2) as threat_score
from ({SCORE_SQL.replace("order by ts desc, id limit 100", "")})""")
def _(t):
    return reports.threat_report(t.logs_slim, limit=None).select("total_logs", "critical", "high", "threat_score")


@query("a02_threat_summary", f"""
select printf('Analyzed %d events. Detected %d critical and %d high-severity anomalies.', total_logs, critical, high) ||
  case when raw > 50 then ' System is under significant threat pressure.' else ' System status is within nominal parameters.' end as summary
from ({SCORE_SQL})""")
def _(t):
    return reports.threat_report(t.logs_slim).select("summary")


@query("a03_recommendations", f"""
select unnest(case when len(advice) = 0 then ['No immediate actions required.'] else advice end) as recommendation from (
select list_concat(list_concat(
  case when critical > 0 then [printf('IMMEDIATE: Investigate %d critical incidents.', critical), 'Initiate lockdown for affected users.'] else [] end,
  case when high > 5 then ['Review firewall rules and access control lists.', 'Audit user permissions for high-risk accounts.'] else [] end),
  case when raw < 20 then ['Continue standard monitoring protocols.', 'Update threat signatures.'] else [] end) as advice from ({SCORE_SQL}))""")
def _(t):
    return reports.threat_report(t.logs_slim).select(F.explode("recommendations").alias("recommendation"))


@query("a04_flagged_ids", "select id from logs_core where risk_level = 'CRITICAL'")
def _(t):
    return reports.flagged_logs(t.logs_slim)


@query("a04_flagged_newest", f"select unnest(flagged) as id from ({SCORE_SQL})")
def _(t):
    return reports.threat_report(t.logs_slim).select(F.explode("flagged_logs").alias("id"))


@query("a05_risk_distribution", """
select l.level as risk_level, count(c.id) as n from (values ('LOW'), ('MEDIUM'), ('HIGH'), ('CRITICAL')) as l(level)
left join logs_core c on c.risk_level = l.level group by l.level""")
def _(t):
    return reports.risk_distribution(t.logs_slim)


@query("a06_kpi_row", """
select count(*) filter (risk_level in ('HIGH', 'CRITICAL')) as threats, count(*) filter (contains(description, '[ML_DETECTED]')) as ai_anomalies,
  cast(floor(count(*) filter (risk_level = 'LOW') * 100e0 / greatest(count(*), 1) + 0.5e0) as bigint) as low_share_percent,
  (select count(*) from users where status = 'ACTIVE') as active_users from logs""")
def _(t):
    return reports.kpi_row(t.logs, t.users)


LARGE_SQL = """select 'High Data Transfer' as type, source_ip as source, destination_ip as destination,
  printf('%.2f MB', round(bytes_transferred / 1048576e0, 2)) as value, id from traffic where bytes_transferred > 104857600"""
SCAN_SQL = """select 'Potential Port Scan' as type, source_ip as source, 'Multiple' as destination,
  printf('%d unique ports', count(distinct port)) as value, cast(null as varchar) as id from traffic group by source_ip having count(distinct port) > 10"""
FLOOD_SQL = """select 'High Packet Volume (DDoS Risk)' as type, source_ip as source, destination_ip as destination,
  printf('%d packets', packet_count) as value, id from traffic where packet_count > 10000"""
FINDINGS_SQL = f"{LARGE_SQL} union all {SCAN_SQL} union all {FLOOD_SQL}"


@query("a07_port_scan", SCAN_SQL)
def _(t):
    return reports.port_scans(t.traffic)


@query("a08_large_transfer", LARGE_SQL)
def _(t):
    return reports.large_transfers(t.traffic)


@query("a09_packet_flood", FLOOD_SQL)
def _(t):
    return reports.packet_floods(t.traffic)


@query("a10_network_summary", f"""
select total_events, found as anomalies_detected, round(least(100e0, found / cast(total_events as double) * 100), 2) as anomaly_score,
  printf('Analyzed %d traffic events. Detected %d anomalies.', total_events, found) as summary
from (select (select count(*) from traffic) as total_events, (select count(*) from ({FINDINGS_SQL})) as found)""")
def _(t):
    return reports.network_summary(t.traffic)


@query("u01_network_findings", FINDINGS_SQL)
def _(t):
    return reports.network_findings(t.traffic)


@query("a14_minute_traffic", """
select cast(hour(ts) as varchar) || ':' || lpad(cast(minute(ts) as varchar), 2, '0') as time,
  cast(sum(case when starts_with(ip, '192.168') then b else 0 end) as bigint) as inbound,
  cast(sum(case when starts_with(ip, '192.168') then 0 else b end) as bigint) as outbound
from (select ts + to_minutes(packet_count % 1440) as ts, destination_ip as ip, bytes_transferred as b from traffic) group by 1""")
def _(t):
    shifted = F.timestamp_micros(F.unix_micros("ts") + (F.col("packet_count") % 1440) * 60_000_000)
    return reports.minute_traffic(t.traffic.withColumn("ts", shifted))


@query("k03_context_json", """
select '[' || string_agg('{"id":"' || id || '","user_name":"' || user_name || '","activity_type":"' || activity_type ||
  '","risk_level":"' || risk_level || '"}', ',' order by ts desc, id) || ']' as context
from (select * from logs_core order by ts desc, id limit 15)""")
def _(t):
    return reports.context_json(t.logs_slim)


@query("k04_recent_notable", "select id, ts, user_name, risk_level from logs_core where risk_level <> 'LOW' order by ts desc, id limit 3")
def _(t):
    return reports.recent_notable(t.logs_slim).select("id", "ts", "user_name", "risk_level")


@query("k08_bounded_traffic", f"""
with newest as (select * from traffic order by ts desc, id, bytes_transferred, source_ip limit 1000)
select count(*) as total_events, count(*) filter (packet_count > 10000) as floods, count(*) filter (bytes_transferred > 104857600) as transfers from newest""")
def _(t):
    order = [F.desc("ts"), F.asc("id"), F.asc("bytes_transferred"), F.asc("source_ip")]
    return scans.page(t.traffic, order, limit=1000).agg(
        F.count("*").alias("total_events"), F.count_if(F.col("packet_count") > 10000).alias("floods"),
        F.count_if(F.col("bytes_transferred") > 104857600).alias("transfers"),
    )


@query("w09_live_history", "select host, ts, cpu_usage from (select *, row_number() over (partition by host order by ts desc) as rn from metric_points) where rn <= 60")
def _(t):
    return scans.newest_per_host(t.metric_points, 60).select("host", "ts", "cpu_usage")


@query("w09_newest_traffic", "select * from traffic order by ts desc, id, bytes_transferred, source_ip limit 5000")
def _(t):
    order = [F.desc("ts"), F.asc("id"), F.asc("bytes_transferred"), F.asc("source_ip")]
    return scans.page(t.traffic, order, limit=5000)


@query("a36_roles", "select distinct role from users")
def _(t):
    return t.users.select("role").distinct()


@query("j09_user_lookup", """
select r.request_id, r.target, coalesce(n.id, i.id) as matched_id, coalesce(n.user_name, i.user_name) as matched_name,
  case when n.id is not null then 'name' when i.id is not null then 'id' end as matched_by
from action_requests r left join users n on n.user_name = r.target left join users i on i.id = r.target""")
def _(t):
    return scans.resolve_user(t.action_requests, t.users).select("request_id", "target", "matched_id", "matched_name", "matched_by")


@query("j07_interface_members", "select * from traffic where source_ip in (select address from interface_addresses where iface = 'eth1')")
def _(t):
    return scans.on_interface(t.traffic, t.interface_addresses, "eth1", "source_ip")
