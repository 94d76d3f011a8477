"""Streaming queries over the given tables, run on what is available and compared with SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from actilens.plans import rule_queries, sequence_queries
from actilens.plans.model_queries import FED_SQL
from actilens.plans.registry import query
from actilens.sources.views import StreamTables
from actilens.streaming import jobs, ordered


#: Allowed lateness of a replay of stored tables, whose files come in any order.
ANY_ORDER = timedelta(days=36500)


def _streamed(t, *names: str) -> StreamTables:
    return StreamTables(t.spark, t.folder, names)


def _run(stream, mode: str = "append"):
    return jobs.run_available(stream, jobs.work_folder(stream.sparkSession), mode)


def _in_order(stream, step):
    """Run to the end of a stored source through a batch operator."""
    return ordered.replay(stream, step, jobs.work_folder(stream.sparkSession), ANY_ORDER)


@query("s05_log_stream", "select id, ts, user_name, activity_type, risk_level from logs_core")
def _(t):
    s = _streamed(t, "events")
    return _run(s.logs_slim.select("id", "ts", "user_name", "activity_type", "risk_level")).drop("_batch")


@query("s06_traffic_stream", "select * from traffic")
def _(t):
    return _run(_streamed(t, "lineitem").traffic).drop("_batch")


@query("t02_first_arrivals", "select id, ts from logs_core")
def _(t):
    s = _streamed(t, "events")
    twice = s.logs_slim.select("id", "ts", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    return _run(jobs.first_arrivals(twice, jobs.REPLAY_LATENESS)).select("id", "ts")


@query("t03_running_keys", sequence_queries.HEAT_SQL)
def _(t):
    s = _streamed(t, "events")
    return jobs.latest(_run(jobs.running_key_counts(s.sessions), "update"), ["key"])


@query("t04_minute_series", """
select date_trunc('minute', ts) as minute, case when starts_with(destination_ip, '192.168') then 'inbound' else 'outbound' end as direction,
  cast(sum(bytes_transferred) as bigint) as bytes from traffic group by 1, 2""")
def _(t):
    s = _streamed(t, "lineitem")
    return jobs.latest(_run(jobs.minute_series(s.traffic, jobs.REPLAY_LATENESS), "update"), ["minute", "direction"])


@query("t05_flushed_pairs", "select ts as flushed_from, source_ip, destination_ip, count(*) as n from traffic group by all")
def _(t):
    s = _streamed(t, "lineitem")
    return jobs.latest(_run(jobs.flushed_pairs(s.traffic, watermark=jobs.REPLAY_LATENESS), "update"), ["flushed_from", "source_ip", "destination_ip"])


@query("t06_stream_limiter", f"{rule_queries.LIMIT_SQL} select user_name, id, allowed from walk")
def _(t):
    s = _streamed(t, "events")
    step = ordered.limiter(["user_name"], F.lit(2), F.lit(86400))
    return _in_order(s.logs_slim.select("id", "ts", "user_name"), step).select("user_name", "id", "allowed")


@query("t07_stream_audit", f"{rule_queries.AUDIT_SQL} select id as source_log_id, playbook_id, status, reason from audited")
def _(t):
    s = _streamed(t, "events")
    settled, waiting = jobs.audit_parts(s.logs, t.playbooks)
    step = ordered.limiter(["playbook_id", "t"], F.col("rate_limit_count"), F.col("rate_limit_window_seconds"), ["ts", "id", "playbook_id"])
    rows = _run(settled).drop("_batch").unionByName(jobs.decided(_in_order(waiting, step)))
    return rows.select("source_log_id", "playbook_id", "status", "reason")


@query("t08_inactivity_events", """
select user_name, 'warning' as kind, ts + to_seconds(6900) as at from gaps where coalesce(gap, 1e18) > 6900
union all select user_name, 'limit', ts + to_seconds(7200) from gaps where coalesce(gap, 1e18) > 7200""".replace("gaps", """(
  select user_name, ts, (epoch_us(lead(ts) over (partition by user_name order by ts, id)) - epoch_us(ts)) / 1000000e0 as gap from logs_core)"""))
def _(t):
    """The last gap of a user is open and falls due when the stream's clock has passed it."""
    logs = _streamed(t, "events").logs_slim.select("id", "ts", "user_name")
    return _in_order(logs, ordered.inactivity()).select("user_name", "kind", "at")


@query("t09_clipboard_stream", """
select user_name, ts, seq, length(c) as length, h as hash, printf('Clipboard updated (%d chars)', length(c)) as description from (
  select *, sha256(c) as h, lag(sha256(c)) over (partition by user_name order by ts, seq) as prev from (
    select user_name, ts, seq, trim(content, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) as c from clipboard)) where prev is null or prev <> h""")
def _(t):
    readings = _streamed(t, "conversations").clipboard.select("user_name", "ts", "seq", "content")
    return _in_order(readings, ordered.clipboard()).select("user_name", "ts", "seq", "length", "hash", "description")


@query("t10_round_verdicts", f"""{FED_SQL}
select message_id, round_id, agent_id, verdict from judged""")
def _(t):
    s = _streamed(t, "embeddings")
    out = _in_order(ordered.round_messages(s.federated_updates, s.federated_reveals), ordered.rounds())
    return out.filter(F.col("kind") == "update").select("message_id", "round_id", "agent_id", "verdict")


@query("t10_round_averages", f"""{FED_SQL}
select s.round_id, p.pos, p.value from status s join (
  select round_id, pos, round(sum(weight * (u - m)) / sum(weight), 9) as value from (
    select round_id, weight, unnest(masked_update) as u, unnest(mask) as m, generate_subscripts(mask, 1) - 1 as pos from joined where mask is not null) group by round_id, pos) p
on p.round_id = s.round_id where s.finalized""")
def _(t):
    s = _streamed(t, "embeddings")
    out = _in_order(ordered.round_messages(s.federated_updates, s.federated_reveals), ordered.rounds()).filter(F.col("average").isNotNull())
    return out.select("round_id", F.posexplode("average").alias("pos", "value")).withColumn("value", F.round("value", 9))


TTL_SQL = rule_queries.limiter_sql("select id, ts, activity_type || props as request, 1 as lim, 300 as win from logs_core", ["request"])


@query("t11_first_requests", f"{TTL_SQL} select request, id from walk where allowed")
def _(t):
    s = _streamed(t, "events")
    requests = s.logs_core.select("id", "ts", F.concat("activity_type", "props").alias("request"))
    return _in_order(requests, ordered.limiter(["request"], F.lit(1), F.lit(300))).filter("allowed").select("request", "id")


@query("t12_metric_history", "select host, ts, cpu_usage from metric_points where ts >= timestamp '2024-01-29 12:00:00'")
def _(t):
    from actilens.operators.scans import retained

    stored = _run(_streamed(t, "events").metric_points)
    return retained(stored, "2024-01-30 12:00:00").select("host", "ts", "cpu_usage")


@query("t13_retry_queue", """
select id, case when ok then null when ok is null then retries else retries + 1 end as retries,
  case when ok is null then next_attempt else timestamp '2024-01-10 00:00:00' + to_seconds(cast(least(300, power(2, least(retries + 1, 8))) as bigint)) end as next_attempt
from (select event_id as id, event_id % 12 as retries, ts + to_seconds(event_id % 600) as next_attempt,
        case when ts + to_seconds(event_id % 600) <= timestamp '2024-01-10 00:00:00' then event_id % 4 = 0 end as ok from logs_core) where ok is null or not ok""")
def _(t):
    from actilens.plans.scan_queries import _queue
    from actilens.sources.sinks import retry_step

    queue, now = _queue(t), "2024-01-10 00:00:00"
    sent = _run(_queue(_streamed(t, "events")).filter(F.col("next_attempt") <= F.lit(now).cast("timestamp")))
    return retry_step(queue, sent.select("id", (F.col("id") % 4 == 0).alias("ok")), now).select("id", "retries", "next_attempt")


@query("t14_streamed_transitions", rule_queries.TRANSITIONS_SQL)
def _(t):
    steps = _streamed(t, "events").logs_slim.select("user_name", "ts", "id", "activity_type")
    pairs = _in_order(steps, ordered.transitions())
    return pairs.groupBy("activity_type", "next_activity").agg(F.count("*").alias("n"))
