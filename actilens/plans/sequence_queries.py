"""Queries for flows, devices, sessions, context and the user-address graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from actilens.operators import context, devices, flows, graph, sessions
from actilens.plans.registry import query

# --- flows -------------------------------------------------------------------------------------


def _connections(t):
    return t.traffic.select(
        "id", "ts", F.col("source_ip").alias("local_ip"), F.col("destination_ip").alias("remote_ip"),
        F.col("port").alias("remote_port"), "protocol", "bytes_transferred",
    )


CONN_SQL = "select id, ts, source_ip as local_ip, destination_ip as remote_ip, port as remote_port, protocol, bytes_transferred from traffic"
OWN = dict(ingest_host="192.168.1.5", ingest_port=3)


@query("f13_admitted_flows", f"""
select * from ({CONN_SQL}) where local_ip <> '' and remote_ip <> '' and remote_port <> 0 and protocol = 'TCP'
  and not (remote_port = 3 and remote_ip = '192.168.1.5') and local_ip in (select address from interface_addresses where iface = 'eth1')
  and not (starts_with(local_ip, '127.') or local_ip = '::1' or starts_with(remote_ip, '127.') or remote_ip = '::1')""")
def _(t):
    return flows.admitted_flows(_connections(t), t.interface_addresses, "eth1", ["TCP"], **OWN)


@query("h19_direction", """
select id, starts_with(destination_ip, '192.168') as inbound, starts_with(source_ip, '127.') or source_ip = '::1' as loopback from traffic""")
def _(t):
    return t.traffic.select("id", flows.is_inbound(F.col("destination_ip")).alias("inbound"), flows.is_loopback(F.col("source_ip")).alias("loopback"))


UNIQUE_SQL = f"""select ts as cycle, local_ip, remote_ip, remote_port, protocol, max(id) as id from ({CONN_SQL}) group by all"""
FIRST_SQL = f"""select * from (select *, row_number() over (partition by cycle order by local_ip, remote_ip, remote_port, protocol) as flow_number from ({UNIQUE_SQL})) where flow_number <= 100"""


def _unique(t):
    return flows.unique_flows(_connections(t).withColumn("cycle", F.col("ts")).drop("bytes_transferred"), ["cycle"])


@query("w06_unique_flows", UNIQUE_SQL)
def _(t):
    return _unique(t).select("cycle", *flows.FLOW_KEY, "id")


@query("k07_first_flows", f"select cycle, local_ip, remote_ip, remote_port, protocol, flow_number from ({FIRST_SQL})")
def _(t):
    return flows.first_flows(_unique(t), "cycle").select("cycle", *flows.FLOW_KEY, "flow_number")


@query("w05_allocated_bytes", f"""
select cycle, local_ip, remote_ip, remote_port, protocol, b as bytes_transferred, greatest(1, b // 1200) as packet_count from (
select f.*, t.total // n + case when flow_number <= t.total % n then 1 else 0 end as b
from (select *, count(*) over (partition by cycle) as n from ({FIRST_SQL})) f
join (select ts as cycle, cast(sum(packet_count) as bigint) as total from traffic group by ts having sum(packet_count) > 0) t on t.cycle = f.cycle)""")
def _(t):
    totals = t.traffic.groupBy(F.col("ts").alias("cycle")).agg(F.sum("packet_count").alias("total_bytes"))
    out = flows.allocate_bytes(flows.first_flows(_unique(t), "cycle"), totals, "cycle")
    return out.select("cycle", *flows.FLOW_KEY, "bytes_transferred", "packet_count")


@query("w04_counter_rates", """
select date_trunc('hour', ts) as cycle, cast(sum(d) as bigint) as total_bytes from (
  select ts, greatest(0, coalesce(bytes_sent - lag(bytes_sent) over w, 0)) + greatest(0, coalesce(bytes_recv - lag(bytes_recv) over w, 0)) as d
  from interface_counters where not starts_with(lower(iface), 'lo') window w as (partition by iface order by ts)) group by 1""")
def _(t):
    return flows.counter_rates(t.interface_counters, F.date_trunc("hour", "ts"))


@query("a15_pair_counts", """
select ts as flushed_from, source_ip, destination_ip, count(*) as n from traffic group by all""")
def _(t):
    return flows.pair_counts(t.traffic)


@query("a38_capture_totals", """
select count(*) filter (not failed) as packets_intercepted, cast(coalesce(sum(bytes_transferred) filter (not failed), 0) as bigint) as bytes_intercepted,
  count(*) filter (failed) as errors from (select *, port = 1 as failed from traffic)""")
def _(t):
    return flows.capture_totals(t.traffic, F.col("port") == 1)


# --- devices -----------------------------------------------------------------------------------


@query("w07_clipboard_changes", """
select user_name, ts, seq, length(c) as length, h as hash, printf('Clipboard updated (%d chars)', length(c)) as description from (
  select *, sha256(c) as h, lag(sha256(c)) over (partition by user_name order by ts, seq) as prev from (
    select user_name, ts, seq, trim(content, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) as c from clipboard)) where prev is null or prev <> h""")
def _(t):
    return devices.clipboard_changes(t.clipboard)


CHANGES_SQL = """
select host, ts, snapshot_id, list_sort(list_filter(devices, lambda x: not list_contains(prev, x))) as added,
  list_sort(list_filter(prev, lambda x: not list_contains(devices, x))) as removed, len(devices) as n_devices
from (select *, coalesce(lag(devices) over (partition by host order by ts, snapshot_id), []) as prev from device_snapshots)"""


@query("w08_device_changes", f"""
select host, ts, snapshot_id, array_to_string(added, ',') as added, array_to_string(removed, ',') as removed, n_devices,
  case when len(added) > 0 then 'USB device attached' else 'USB device removed' end as description
from ({CHANGES_SQL}) where len(added) > 0 or len(removed) > 0""")
def _(t):
    d = devices.device_changes(t.device_snapshots)
    return d.select(
        "host", "ts", "snapshot_id", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"),
        F.col("n_devices").cast("long").alias("n_devices"), "description",
    )


@query("u04_set_difference", f"""
select 'added' as side, host, snapshot_id, unnest(added) as device from ({CHANGES_SQL})
union all select 'removed', host, snapshot_id, unnest(removed) from ({CHANGES_SQL})""")
def _(t):
    d = devices.device_changes(t.device_snapshots)
    side = lambda name: d.select(F.lit(name).alias("side"), "host", "snapshot_id", F.explode(name).alias("device"))
    return side("added").unionByName(side("removed"))


@query("w10_inactivity", """
select id, user_name, round(gap, 6) as gap_seconds, coalesce(gap > 6900, false) as warned, coalesce(gap > 7200, false) as limit_reached from (
  select id, user_name, (epoch_us(lead(ts) over (partition by user_name order by ts, id)) - epoch_us(ts)) / 1000000e0 as gap from logs_core)""")
def _(t):
    out = devices.inactivity(t.logs_slim.select("id", "ts", "user_name"))
    return out.select("id", "user_name", F.round("gap_seconds", 6).alias("gap_seconds"), "warned", "limit_reached")


# --- sessions ----------------------------------------------------------------------------------

PARSED_SQL = """
select id, ts, case when json_valid(activity_summary) and json_exists(activity_summary, '$.key_counts') then 'new' when json_valid(activity_summary) then 'old' end as shape,
  activity_summary as s from (select * from sessions where activity_type = 'KEYLOG')"""
KEYS_SQL = f"""
select unnest(json_keys(j)) as key, j from (
  select case shape when 'new' then json_extract(s, '$.key_counts') when 'old' then cast(s as json) end as j from ({PARSED_SQL})) where j is not null"""
TOTALS_SQL = f"""select key, cast(sum(cast(json_extract_string(j, '$."' || key || '"') as bigint)) as bigint) as n from ({KEYS_SQL}) group by key"""
FIELDS_SQL = f"""
select id, ts, shape, case when shape = 'new' then cast(json_extract_string(s, '$.duration_seconds') as double) else 0e0 end as duration,
  case shape when 'new' then cast(json_extract_string(s, '$.total_keystrokes') as bigint)
             when 'old' then cast(json_extract_string(s, '$.a') as bigint) + cast(json_extract_string(s, '$."Key.space"') as bigint) else 0 end as keystrokes,
  case shape when 'new' then coalesce(nullif(json_extract_string(s, '$.active_window'), ''), 'Unknown') when 'old' then 'Unknown' end as app from ({PARSED_SQL})"""


@query("h25_summary_shapes", f"select id, shape, duration, keystrokes, app from ({FIELDS_SQL})")
def _(t):
    return sessions.key_sessions(t.sessions).select("id", "shape", "duration", "keystrokes", "app")


@query("a11_session_totals", f"""
select count(*) as total_sessions, coalesce(sum(duration), 0) as total_duration_seconds, cast(coalesce(sum(keystrokes), 0) as bigint) as total_keystrokes
from ({FIELDS_SQL}) where ts >= timestamp '2024-01-03 00:00:00' and ts <= timestamp '2024-01-25 00:00:00'""")
def _(t):
    return sessions.session_totals(sessions.key_sessions(t.sessions, "2024-01-03", "2024-01-25"))


@query("k01_top_apps", f"select app, count(*) as n from ({FIELDS_SQL}) where app <> 'Unknown' group by app order by n desc, app limit 5")
def _(t):
    return sessions.top_apps(sessions.key_sessions(t.sessions))


@query("a12_key_totals", TOTALS_SQL)
def _(t):
    return sessions.key_totals(sessions.key_sessions(t.sessions))


HEAT_SQL = f"select upper(regexp_replace(trim(key), '^(?i)key\\.', '')) as key, cast(sum(n) as bigint) as n from ({TOTALS_SQL}) group by 1"


@query("a13_heat_table", f"""
select key, n, round(i, 9) as intensity, case when n = 0 then 'none' when i < 0.2 then 'low' when i < 0.5 then 'medium' when i < 0.8 then 'high' else 'peak' end as band
from (select *, case when n = 0 then 0e0 else least(n / cast(max(n) over () as double), 1e0) end as i from ({HEAT_SQL}))""")
def _(t):
    heat = sessions.heat_table(sessions.key_totals(sessions.key_sessions(t.sessions)))
    return heat.withColumn("intensity", F.round("intensity", 9))


@query("k02_top_keys", f"select * from ({HEAT_SQL}) order by n desc, key limit 10")
def _(t):
    return sessions.top_keys(sessions.key_totals(sessions.key_sessions(t.sessions)))


STROKES_SQL = """select user_name, cast(ts as date) as day, ts, lower(activity_type) as key, 'app' || cast(event_id % 4 as varchar) as win from logs_core"""


@query("a21_flush_summaries", f"""
with cells as (select user_name, day, win, count(*) as n from ({STROKES_SQL}) group by all),
keys as (select user_name, day, key, count(*) as n from ({STROKES_SQL}) group by all)
select s.user_name, s.day, round((epoch_us(s.hi) - epoch_us(s.lo)) / 1000000e0, 6) as duration_seconds, s.n as total_keystrokes, d.win as active_window, k.counts as key_counts
from (select user_name, day, min(ts) as lo, max(ts) as hi, count(*) as n from ({STROKES_SQL}) group by all) s
join (select user_name, day, arg_min(win, (-n, win)) as win from cells group by all) d on d.user_name = s.user_name and d.day = s.day
join (select user_name, day, string_agg(key || '=' || cast(n as varchar), ',' order by key) as counts from keys group by all) k on k.user_name = s.user_name and k.day = s.day""")
def _(t):
    strokes = t.logs_core.select(
        "user_name", F.to_date("ts").alias("day"), "ts", F.lower("activity_type").alias("key"),
        F.concat(F.lit("app"), (F.col("event_id") % 4).cast("string")).alias("window"),
    )
    out = sessions.flush_summaries(strokes, ["user_name", "day"])
    pairs = F.transform(F.map_entries("key_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return out.select(
        "user_name", "day", F.round("duration_seconds", 6).alias("duration_seconds"), "total_keystrokes", "active_window",
        F.array_join(pairs, ",").alias("key_counts"),
    )


# --- context and graph -------------------------------------------------------------------------


@query("j08_recent_context", f"""
with anchors as (select id, ts from logs_core where risk_level in ('HIGH', 'CRITICAL')),
hits as (select a.id as anchor, l.ts, l.id, '[' || strftime(l.ts, '%Y-%m-%dT%H:%M:%S.%f') || '] ' || l.activity_type || ': ' || l.description as line,
    row_number() over (partition by a.id order by l.ts desc, l.id) as rn
  from anchors a join logs l on l.ts >= a.ts - interval 5 minute and l.ts <= a.ts)
select a.id, a.ts, count(h.id) as n, coalesce(string_agg(h.line, chr(10) order by h.ts desc, h.id), 'No recent logs.') as context
from anchors a left join hits h on h.anchor = a.id and h.rn <= 10 group by a.id, a.ts""")
def _(t):
    from actilens.functions.risk import is_severe

    anchors = t.logs_slim.filter(is_severe(F.col("risk_level"))).select("id", "ts")
    return context.recent_context(anchors, t.logs).withColumn("n", F.col("n").cast("long"))


EDGES_SQL = """
select 'user-' || user_name as source, 'ip-' || ip_address as target, user_name, ip_address, arg_min(risk_level, (-r, epoch_us(ts), id)) as risk_level
from (select *, case risk_level when 'LOW' then 1 when 'MEDIUM' then 2 when 'HIGH' then 3 when 'CRITICAL' then 4 else 0 end as r from logs_core) group by user_name, ip_address"""
NODES_SQL = f"""
select distinct source as node_id, 'USER' as type, user_name as label from ({EDGES_SQL}) union select distinct target, 'IP', ip_address from ({EDGES_SQL})"""
KEPT_SQL = f"""
select * from ({EDGES_SQL}) where risk_level in ('CRITICAL', 'HIGH') and (contains(user_name, 'u1') or contains(ip_address, 'u1'))"""


def _kept(t):
    return graph.filter_edges(graph.edges(t.logs_slim), ["CRITICAL", "HIGH", "INFO"], " U1 ")


@query("a33_edges", EDGES_SQL)
def _(t):
    return graph.edges(t.logs_slim)


@query("a34_nodes", NODES_SQL)
def _(t):
    return graph.nodes(graph.edges(t.logs_slim))


@query("u02_node_union", f"select type, count(*) as n from ({NODES_SQL}) group by type")
def _(t):
    return graph.nodes(graph.edges(t.logs_slim)).groupBy("type").agg(F.count("*").alias("n"))


@query("a35_graph_counts", f"select (select count(*) from ({NODES_SQL})) as n_nodes, (select count(*) from ({EDGES_SQL})) as n_paths")
def _(t):
    links = graph.edges(t.logs_slim)
    return graph.graph_counts(graph.nodes(links), links)


@query("a35_degrees", f"select node_id, count(*) as degree from (select unnest([source, target]) as node_id from ({EDGES_SQL})) group by node_id")
def _(t):
    return graph.degrees(graph.edges(t.logs_slim))


@query("f16_filtered_edges", KEPT_SQL)
def _(t):
    return _kept(t)


@query("j05_visible_nodes", f"select * from ({NODES_SQL}) where node_id in (select unnest([source, target]) from ({KEPT_SQL}))")
def _(t):
    return graph.visible_nodes(graph.nodes(graph.edges(t.logs_slim)), _kept(t))


@query("j11_incident_edges", f"select * from ({EDGES_SQL}) where source = 'user-u7' or target = 'user-u7'")
def _(t):
    return graph.incident_edges(graph.edges(t.logs_slim), "user-u7")


@query("k06_first_incident_edges", f"""
select node_id, source, target, risk_level from (select *, row_number() over (partition by node_id order by source, target) as rn
  from (select unnest([source, target]) as node_id, source, target, risk_level from ({EDGES_SQL}))) where rn <= 8""")
def _(t):
    return graph.first_incident_edges(graph.edges(t.logs_slim))
