"""Queries for scalar functions, privacy, policy, alerts and keyword clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from actilens.functions import pii, risk, text, timefns
from actilens.operators import keywords, policy
from actilens.plans.registry import query

SETTINGS = policy.Settings(
    block_social_media=True,
    webhook_url="https://hooks.example.org/a",
    email_notifications=True,
    notification_email="soc@example.org",
    quiet_hours_start="22:00",
    quiet_hours_end="08:00",
)


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _any(column: str, terms: list[str]) -> str:
    return "(" + " or ".join(f"contains({column}, {_sql_text(t)})" for t in terms) + ")"


@query("h01_contains_any", f"select doc_id, {_any('lower(text)', ['token', 'password', 'the'])} as hit from documents")
def _(t):
    return t.documents.select("doc_id", text.contains_any(F.lower("text"), ["token", "password", "the"]).alias("hit"))


@query("h02_upper_match", "select id, upper(lower(activity_type)) = upper('error') as eq, contains(upper(user_name), upper('u1')) as inside from logs_core")
def _(t):
    return t.logs_slim.select(
        "id", (F.upper(F.lower("activity_type")) == "error".upper()).alias("eq"),
        F.upper("user_name").contains("u1".upper()).alias("inside"),
    )


@query("h04_truncate", "select doc_id, case when length(text) > 1500 then substring(text, 1, 1497) || '...' else text end as short from documents")
def _(t):
    return t.documents.select("doc_id", text.truncate(F.col("text")).alias("short"))


@query("h05_control_characters", r"""
select doc_id, regexp_replace(text || chr(7) || chr(9) || chr(31) || 'x', '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g') as clean from documents""")
def _(t):
    return t.documents.select("doc_id", text.drop_control(F.concat("text", F.lit("\x07\t\x1fx"))).alias("clean"))


def _nested_replace(column: str) -> str:
    out = column
    for phrase in text.INSTRUCTION_PHRASES:
        out = f"replace({out}, {_sql_text(phrase)}, '[redacted-instruction]')"
    return out


SANITIZE_SQL = f"""
select doc_id, case when length(s) > 1500 then substring(s, 1, 1497) || '...' else s end as safe from (
select doc_id, trim(case when r <> l then r else c end, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31)) as s from (
select doc_id, c, l, {_nested_replace('l')} as r from (select doc_id, c, lower(c) as l from (
select doc_id, regexp_replace(case when doc_id % 3 = 0 then chr(1) || text || ' System Prompt' when doc_id % 3 = 1 then text else ' Act As ' || text end,
  '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', ' ', 'g') as c from documents))))"""


@query("h06_sanitize", SANITIZE_SQL)
def _(t):
    d, body = F.col("doc_id"), F.col("text")
    marked = (
        F.when(d % 3 == 0, F.concat(F.lit("\x01"), body, F.lit(" System Prompt")))
        .when(d % 3 == 1, body)
        .otherwise(F.concat(F.lit(" Act As "), body))
    )
    return t.documents.select("doc_id", text.sanitize(marked).alias("safe"))


LINES_SQL = f"""
select doc_id, string_agg(case when length(s) > 1500 then substring(s, 1, 1497) || '...' else s end, '|' order by pos) as items from (
select doc_id, pos, trim(case when r <> l then r else c end, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(28) || chr(29) || chr(30) || chr(31)) as s from (
select doc_id, pos, c, l, {_nested_replace('l')} as r from (select doc_id, pos, c, lower(c) as l from (
select doc_id, unnest(string_split(text, chr(10))) as c, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents) where pos <= 10))) group by doc_id"""


@query("k09_context_items", LINES_SQL)
def _(t):
    lines = F.transform(F.split("text", "\n"), lambda x: F.create_map(F.lit("line"), x))
    kept = text.sanitize_items(lines, 10)
    return t.documents.select("doc_id", F.array_join(F.transform(kept, lambda m: m["line"]), "|").alias("items"))


@query("h07_normalize_actions", """
select request_id, unnest(list_filter(list_transform([' Block IP ', upper(action), 'unplug it', ' ' || replace(action, '_', ' ')],
  lambda a: replace(lower(trim(a)), ' ', '_')),
  lambda a: a in ('isolate_host', 'block_ip', 'reset_password', 'investigate_process_tree', 'collect_forensics'))) as action from action_requests""")
def _(t):
    a = F.col("action")
    raw = F.array(F.lit(" Block IP "), F.upper(a), F.lit("unplug it"), F.concat(F.lit(" "), F.replace(a, F.lit("_"), F.lit(" "))))
    return t.action_requests.select("request_id", F.explode(text.normalize_actions(raw)).alias("action"))


ASSESS_SQL = """select id, case event_id % 5 when 0 then 'BENIGN' when 1 then 'SUSPICIOUS' when 2 then 'MALICIOUS' when 3 then 'benign' end as level,
  case when event_id % 7 = 0 then '' else activity_type end as threat, value / 150 as confidence, case when event_id % 11 <> 0 then props end as reasoning from logs_core"""


@query("h08_assessment_check", f"""
select id, case when level is null or level not in ('BENIGN', 'SUSPICIOUS', 'MALICIOUS') then 'risk_level'
  when threat is null or length(threat) not between 1 and 120 then 'threat_type'
  when confidence is null or confidence not between 0 and 1 then 'confidence'
  when reasoning is null or length(reasoning) not between 1 and 1500 then 'reasoning' end as error from ({ASSESS_SQL})""")
def _(t):
    e = F.col("event_id")
    level = F.when(e % 5 == 0, "BENIGN").when(e % 5 == 1, "SUSPICIOUS").when(e % 5 == 2, "MALICIOUS").when(e % 5 == 3, "benign")
    threat = F.when(e % 7 == 0, "").otherwise(F.col("activity_type"))
    return t.logs_core.select(
        "id", text.assessment_error(level, threat, F.col("value") / 150, F.when(e % 11 != 0, F.col("props"))).alias("error")
    )


@query("h09_score_band", """
select id, case when value >= 70 then 'MALICIOUS' when value >= 30 then 'SUSPICIOUS' else 'BENIGN' end as band,
  round(least(1e0, greatest(0e0, value / 100e0)), 9) as confidence from logs_core where value > 30""")
def _(t):
    v = F.col("value")
    return t.logs_core.filter(v > 30).select(
        "id", risk.assessment_band(v).alias("band"), F.round(risk.assessment_confidence(v), 9).alias("confidence")
    )


@query("h10_report_status", "select id, case when value > 70 then 'CRITICAL' when value > 30 then 'ELEVATED' else 'STABLE' end as status from logs_core")
def _(t):
    return t.logs_core.select("id", risk.report_status(F.col("value")).alias("status"))


@query("h11_hour_weekday", """
select id, cast(hour(x) as integer) as hour, cast(isodow(x) - 1 as integer) as weekday
from (select id, case when event_id % 9 = 0 then timestamp '2024-02-03 12:00:00' else ts end as x from logs_core)""")
def _(t):
    raw = F.when(F.col("event_id") % 9 == 0, "not a time").otherwise(timefns.iso_text(F.col("ts")))
    when = timefns.parse_time(raw, F.lit("2024-02-03 12:00:00").cast("timestamp"))
    return t.logs_core.select("id", F.hour(when).alias("hour"), F.weekday(when).alias("weekday"))


@query("h12_cyclic", """
select id, round(sin(2 * pi() * hour(ts) / 24), 9) as hour_sin, round(cos(2 * pi() * hour(ts) / 24), 9) as hour_cos,
  round(sin(2 * pi() * (isodow(ts) - 1) / 7), 9) as dow_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 9) as dow_cos from logs_core""")
def _(t):
    hs, hc = timefns.cyclic(F.hour("ts"), 24)
    ds, dc = timefns.cyclic(F.weekday("ts"), 7)
    return t.logs_slim.select(
        "id", F.round(hs, 9).alias("hour_sin"), F.round(hc, 9).alias("hour_cos"), F.round(ds, 9).alias("dow_sin"), F.round(dc, 9).alias("dow_cos")
    )


TOKENS_SQL = r"case when trim(regexp_replace({c}, '[ \t\n\r\f\v]+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace({c}, '[ \t\n\r\f\v]+', ' ', 'g')), ' ')) end"


@query("h13_text_size", f"select doc_id, length(text) as n_chars, {TOKENS_SQL.format(c='text')} as n_tokens from documents")
def _(t):
    return t.documents.select("doc_id", F.length("text").alias("n_chars"), text.token_count(F.col("text")).alias("n_tokens"))


@query("h14_quiet_hours", """
select id, strftime(ts, '%H:%M') >= '22:00' or strftime(ts, '%H:%M') <= '08:00' as night,
  strftime(ts, '%H:%M') between '09:00' and '17:30' as day, false as never from logs_core""")
def _(t):
    ts = F.col("ts")
    return t.logs_slim.select(
        "id", timefns.in_quiet_hours(ts, "22:00", "08:00").alias("night"),
        timefns.in_quiet_hours(ts, "09:00", "17:30").alias("day"), timefns.in_quiet_hours(ts, None, "08:00").alias("never"),
    )


@query("h20_texts", """
select id, printf('%.2f MB', round(bytes_transferred / 1048576e0, 2)) as megabytes, printf('%d packets', packet_count) as packets from traffic""")
def _(t):
    return t.traffic.select(
        "id", F.format_string("%.2f MB", F.round(F.col("bytes_transferred") / 1048576, 2)).alias("megabytes"),
        F.format_string("%d packets", "packet_count").alias("packets"),
    )


@query("h26_hash", "select doc_id, '[HASH:' || substring(sha256(text), 1, 8) || ']' as h from documents")
def _(t):
    return t.documents.select("doc_id", pii.short_hash(F.col("text")).alias("h"))


@query("h28_key_names", """
select id, upper(regexp_replace(trim(k), '^(?i)key\\.', '')) as key from (
  select id, unnest([' Key.' || lower(activity_type) || ' ', 'KEY.space', user_name, 'monkey.x']) as k from logs_core)""")
def _(t):
    raw = F.array(F.concat(F.lit(" Key."), F.lower("activity_type"), F.lit(" ")), F.lit("KEY.space"), F.col("user_name"), F.lit("monkey.x"))
    return t.logs_slim.select("id", F.explode(raw).alias("k")).select("id", text.key_name(F.col("k")).alias("key"))


@query("h29_alert_text", """
select id, '[' || risk_level || '] ' || activity_type || ': ' || description as message,
  case when risk_level = 'CRITICAL' then '#ff0000' else '#ffcc00' end as colour from logs where risk_level in ('HIGH', 'CRITICAL')""")
def _(t):
    severe = t.logs.filter(risk.is_severe(F.col("risk_level")))
    return severe.select(
        "id", text.alert_text(F.col("risk_level"), F.col("activity_type"), F.col("description")).alias("message"),
        text.alert_colour(F.col("risk_level")).alias("colour"),
    )


@query("h30_time_labels", """
select id, cast(hour(ts) as varchar) || strftime(ts, ':%M') as hm, cast(hour(ts) as varchar) || strftime(ts, ':%M:%S') as hms from logs_core""")
def _(t):
    return t.logs_slim.select("id", timefns.clock_label(F.col("ts")).alias("hm"), timefns.clock_label(F.col("ts"), seconds=True).alias("hms"))


@query("h31_expiry", """
select round_id, agent_id, message_id, submitted_at + to_seconds(greatest(num_samples * 10, 30)) as expires_at from federated_updates""")
def _(t):
    return t.federated_updates.select(
        "round_id", "agent_id", "message_id", timefns.expiry(F.col("submitted_at"), F.col("num_samples") * 10).alias("expires_at")
    )


@query("h32_metric_log", """
select host, ts, printf('CPU: %.1f%%, RAM: %.1f%%', round(cpu_usage, 1), round(100e0 * memory_used / memory_total, 1)) as description,
  memory_total // 1048576 as memory_total_mb, round(memory_used / 1073741824e0, 2) as memory_used_gb from metric_points""")
def _(t):
    from actilens.operators.devices import metric_logs

    return metric_logs(t.metric_points)


@query("h33_severity_bands", """
select id, case when value > 50 then 'red' when value > 20 then 'yellow' else 'normal' end as score,
  case when value > 80 then 'red' when value > 50 then 'yellow' else 'normal' end as cpu, case when value > 90 then 'red' else 'normal' end as memory from logs_core""")
def _(t):
    v = F.col("value")
    return t.logs_core.select(
        "id", risk.severity_colour(v, 50, 20).alias("score"), risk.severity_colour(v, 80, 50).alias("cpu"),
        risk.severity_colour(v, 90).alias("memory"),
    )


# --- personal data -----------------------------------------------------------------------------

REDACT_SQL = {
    "ssn": "repeat('*', case when length(v) >= 4 then length(v) - 4 else length(v) end) || case when length(v) >= 4 then right(v, 4) else '' end",
    "credit_card": "repeat('*', case when length(v) >= 4 then length(v) - 4 else length(v) end) || case when length(v) >= 4 then right(v, 4) else '' end",
    "email": "case when len(string_split(v, '@')) = 2 and length(split_part(v, '@', 1)) > 1 then substring(v, 1, 1) || '***@' || split_part(v, '@', 2) else '***@***' end",
    "phone": "case when length(regexp_replace(v, '[^0-9]', '', 'g')) >= 4 then '***-***-' || right(regexp_replace(v, '[^0-9]', '', 'g'), 4) else '***-***-****' end",
    "password": "'[REDACTED]'",
    "api_key": "'[REDACTED]'",
    "ip_address": "case when len(string_split(v, '.')) >= 4 then split_part(v, '.', 1) || '.' || split_part(v, '.', 2) || '.*.*' else '*.*.*.*' end",
    "mac_address": "case when len(string_split(replace(v, '-', ':'), ':')) >= 6 then split_part(replace(v, '-', ':'), ':', 1) || ':' || split_part(replace(v, '-', ':'), ':', 2) || ':**:**:**:**' else '**:**:**:**:**:**' end",
    "account_number": "'[HASH:' || substring(sha256(v), 1, 8) || ']'",
}


def _detect_sql(source: str, key: str, column: str) -> str:
    parts, n = [], 0
    for kind, patterns in pii.PATTERNS:
        for pattern in patterns:
            n += 1
            hits = f"select {key}, unnest(regexp_extract_all({column}, {_sql_text('(?i)' + pattern)}, 0)) as v, generate_subscripts(regexp_extract_all({column}, {_sql_text('(?i)' + pattern)}, 0), 1) as pos from {source}"
            parts.append(f"select {key}, {n} as step, pos, '{kind}' as pii_type, v as original, {REDACT_SQL[kind]} as redacted from ({hits})")
    return " union all ".join(parts)


DETECT_SQL = _detect_sql("documents", "doc_id", "text")


@query("p01_detect", f"select doc_id, pii_type, original from ({DETECT_SQL})")
def _(t):
    docs = t.documents.withColumnRenamed("text", "content")
    return pii.detect(docs, "content", ["doc_id"]).select("doc_id", "pii_type", "original")


@query("p03_redacted_values", f"select doc_id, pii_type, redacted from ({DETECT_SQL})")
def _(t):
    docs = t.documents.withColumnRenamed("text", "content")
    return pii.detect(docs, "content", ["doc_id"]).select("doc_id", "pii_type", "redacted")


@query("p04_rewrite", f"""
with found as ({DETECT_SQL}),
folded as (select doc_id, list({{'t': '', 'o': original, 'r': redacted}} order by step, pos) as ds from found group by doc_id)
select d.doc_id, case when f.ds is null then d.text
  else list_reduce(f.ds, lambda a, x: {{'t': replace(a.t, x.o, x.r), 'o': '', 'r': ''}}, {{'t': d.text, 'o': '', 'r': ''}}).t end as content
from documents d left join folded f on f.doc_id = d.doc_id""")
def _(t):
    docs = t.documents.select("doc_id", F.col("text").alias("content"))
    return pii.redact_rows(docs).select("doc_id", "content")


@query("p05_row_metadata", f"""
with found as ({DETECT_SQL})
select d.doc_id, count(f.doc_id) > 0 as redacted, count(f.doc_id) as n, coalesce(string_agg(distinct pii_type, ',' order by pii_type), '') as types
from documents d left join found f on f.doc_id = d.doc_id group by d.doc_id""")
def _(t):
    docs = t.documents.select("doc_id", F.col("text").alias("content"))
    return pii.redact_rows(docs).select(
        "doc_id", F.col("_pii_redacted").alias("redacted"), F.col("_pii_count").cast("long").alias("n"),
        F.array_join("_pii_types", ",").alias("types"),
    )


@query("p08_profile", f"""
with found as ({DETECT_SQL}) select d.source, f.pii_type, count(*) as n from found f join documents d on d.doc_id = f.doc_id group by 1, 2""")
def _(t):
    docs = t.documents.withColumnRenamed("text", "content")
    return pii.detect(docs, "content", ["source"]).groupBy("source", "pii_type").agg(F.count("*").alias("n"))


# --- policy and alerts -------------------------------------------------------------------------

POLICY_SQL = f"""
select id, ts, user_name, activity_type, ip_address, details,
  case when anomaly and l3 <> 'CRITICAL' then 'HIGH' else l3 end as risk_level, d3 || case when anomaly then ' [ML_DETECTED]' else '' end as description
from (select *, case when soc and l2 <> 'CRITICAL' then 'HIGH' else l2 end as l3, d2 || case when soc then ' [POLICY VIOLATION: SOCIAL MEDIA]' else '' end as d3
from (select *, case when gam then 'CRITICAL' else l1 end as l2, d1 || case when gam then ' [POLICY VIOLATION: GAMBLING]' else '' end as d2
from (select *, case when kw and risk_level not in ('HIGH', 'CRITICAL') then 'HIGH' else risk_level end as l1,
  description || case when kw and risk_level not in ('HIGH', 'CRITICAL') then ' [KEYWORD DETECTED]' else '' end as d1
from (select *, length(description) % 10 = 0 as anomaly,
  {_any('ld', SETTINGS.keywords)} or {_any('lx', SETTINGS.keywords)} as kw,
  {_any('ld', policy.GAMBLING_TERMS)} or {_any('lx', policy.GAMBLING_TERMS)} as gam,
  {_any('ld', policy.SOCIAL_TERMS)} or {_any('lx', policy.SOCIAL_TERMS)} as soc
from (select *, lower(description) as ld, lower(details) as lx from logs)))))"""


def _enriched(t):
    scored = t.logs.withColumn("prediction", F.when(F.length("description") % 10 == 0, -1).otherwise(1))
    return policy.apply_policies(scored, SETTINGS, "prediction").drop("prediction")


@query("o01_policy_chain", f"select id, risk_level, description from ({POLICY_SQL})")
def _(t):
    return _enriched(t).select("id", "risk_level", "description")


@query("h03_tags", f"""
select id, contains(description, ' [KEYWORD DETECTED]') as keyword, contains(description, ' [POLICY VIOLATION: GAMBLING]') as gambling,
  contains(description, ' [POLICY VIOLATION: SOCIAL MEDIA]') as social, ends_with(description, ' [ML_DETECTED]') as anomaly from ({POLICY_SQL})""")
def _(t):
    d = F.col("description")
    return _enriched(t).select(
        "id", d.contains(policy.KEYWORD_TAG).alias("keyword"), d.contains(policy.GAMBLING_TAG).alias("gambling"),
        d.contains(policy.SOCIAL_TAG).alias("social"), d.endswith(policy.ANOMALY_TAG).alias("anomaly"),
    )


OUTBOX_SQL = """
select id, ts, user_name, ip_address, details, risk_level, '[' || risk_level || '] ' || activity_type || ': ' || description as message,
  case when risk_level = 'CRITICAL' then '#ff0000' else '#ffcc00' end as colour
from logs where risk_level in ('HIGH', 'CRITICAL') and (risk_level = 'CRITICAL' or not (strftime(ts, '%H:%M') >= '22:00' or strftime(ts, '%H:%M') <= '08:00'))"""


@query("o07_alert_outbox", f"select id, risk_level, message, colour from ({OUTBOX_SQL})")
def _(t):
    return policy.alert_outbox(t.logs, SETTINGS).select("id", "risk_level", "message", "colour")


@query("o08_deliveries", f"""
select id, risk_level, 'webhook' as channel, 'https://hooks.example.org/a' as destination, length(message) as message_length from ({OUTBOX_SQL})
union all select id, risk_level, 'email', 'soc@example.org', length(message) from ({OUTBOX_SQL})""")
def _(t):
    d = policy.deliveries(policy.alert_outbox(t.logs, SETTINGS), SETTINGS)
    message = F.when(F.col("channel") == "webhook", F.get_json_object("body", "$.text")).otherwise(F.substring_index("body", "\n", -1))
    whole = F.when(F.col("channel") == "email", F.length("body") - F.length(F.concat(F.lit("Alert - "), "risk_level", F.lit("\n")))).otherwise(F.length(message))
    return d.select("id", "risk_level", "channel", "destination", whole.alias("message_length"))


# --- keyword clusters --------------------------------------------------------------------------


@query("j04_match_clusters", """
select doc_id, cluster, string_agg(distinct keyword, ',' order by keyword) as hits from documents join keyword_clusters on contains(lower(text), lower(keyword))
group by doc_id, cluster""")
def _(t):
    m = keywords.match_clusters(t.documents, t.keyword_clusters, "text", ["doc_id"])
    return m.select("doc_id", "cluster", F.array_join("hits", ",").alias("hits"))


def _values(pairs) -> str:
    return ", ".join("(" + ", ".join(_sql_text(v) for v in p) + ")" for p in pairs)


DEFAULTS = _values((c, k) for c, ks in keywords.DEFAULT_CLUSTERS.items() for k in ks)


@query("j04_match_defaults", f"""
select page_id, cluster, string_agg(distinct keyword, ',' order by keyword) as hits from pages
join (values {DEFAULTS}) as d(cluster, keyword) on contains(lower(html), keyword) group by page_id, cluster""")
def _(t):
    m = keywords.match_clusters(t.pages, keywords.default_clusters(t.spark), "html", ["page_id"])
    return m.select("page_id", "cluster", F.array_join("hits", ",").alias("hits"))


TERMS_SQL = f"""select lower(unnest(regexp_extract_all(x, {_sql_text(keywords.COMBINED_PATTERN)}, 0))) as keyword
  from (select title as x from posts union all select html || ' ' from posts union all
        select text from documents)"""


def _posts(t):
    docs = t.documents.select(F.lit(None).cast("string").alias("title"), F.lit("").alias("html"), F.col("text").alias("plaintext"))
    return t.posts.select("title", "html", F.lit("").alias("plaintext")).unionByName(docs)


@query("a42_extracted_keywords", f"select keyword, count(*) as n from ({TERMS_SQL}) group by keyword")
def _(t):
    return keywords.extract_keywords(_posts(t))


MERGED_SQL = f"""
select cluster, keyword, source from keyword_clusters where cluster <> 'gamma' union all
select distinct 'gamma', keyword, 'ghost' from (select keyword from keyword_clusters where cluster = 'gamma' union all select keyword from ({TERMS_SQL}))"""


def _merged(t):
    return keywords.merge_extracted(t.keyword_clusters, keywords.extract_keywords(_posts(t)), "gamma")


@query("u03_merged_keywords", MERGED_SQL)
def _(t):
    return _merged(t)


@query("u03_replaced_cluster", f"""
select * from ({MERGED_SQL}) where cluster <> 'beta' union all select * from (values ('beta', 'new', 'manual'), ('beta', 'terms', 'manual')) as v(cluster, keyword, source)""")
def _(t):
    return keywords.replace_cluster(_merged(t), "beta", ["New", "TERMS", "new"])


@query("a37_cluster_inventory", f"""
select cluster, string_agg(distinct keyword, ',' order by keyword) as keywords, count(distinct keyword) as n, max(source) as source from ({MERGED_SQL}) group by cluster""")
def _(t):
    return keywords.inventory(_merged(t)).select("cluster", F.array_join("keywords", ",").alias("keywords"), "n", "source")


@query("a37_all_keywords", f"select distinct keyword from ({MERGED_SQL})")
def _(t):
    return keywords.all_keywords(_merged(t))
