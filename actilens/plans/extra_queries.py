"""Queries for column normalising, schema alignment, encryption, nested redaction and file sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from actilens import schemas
from actilens.functions import crypto, pii
from actilens.operators import policy, scans
from actilens.plans import text_queries
from actilens.plans.registry import query
from actilens.plans.text_queries import DETECT_SQL, POLICY_SQL, _detect_sql
from actilens.sources import readers, sinks
from actilens.streaming import jobs

KEY = "0123456789abcdef0123456789abcdef"
FOLD_SQL = """case when f.ds is null then {column} else list_reduce(f.ds, lambda a, x: {{'t': replace(a.t, x.o, x.r), 'o': '', 'r': ''}},
  {{'t': {column}, 'o': '', 'r': ''}}).t end"""
REWRITTEN_SQL = f"""
with found as ({DETECT_SQL}),
folded as (select doc_id, list({{'t': '', 'o': original, 'r': redacted}} order by step, pos) as ds, count(*) as n from found group by doc_id)"""


@query("f06_normalised_names", "select id, user_name, risk_level, ts from logs_core")
def _(t):
    wire = t.logs_slim.select(
        "id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.col("user_name").alias("user"),
        F.col("risk_level").alias("riskLevel"), F.lit("stale").alias("risk_level"),
    )
    return schemas.normalised(wire).select("id", "user_name", "risk_level", "ts")


@query("f14_aligned_schema", "select id, user_name, false as monitor_clipboard, false as monitor_usb, false as monitor_camera from users")
def _(t):
    return scans.align_schema(t.users.select("id", "user_name"), schemas.SETTINGS_DEFAULTS)


@query("h27_encryption", "select doc_id, text as opened, true as sealed, true as wrong_key_fails from documents")
def _(t):
    sealed = t.documents.select("doc_id", crypto.encrypt(F.col("text"), F.lit(KEY)).alias("e"))
    return sealed.select(
        "doc_id", crypto.decrypt(F.col("e"), F.lit(KEY)).alias("opened"), F.col("e").startswith(crypto.PREFIX).alias("sealed"),
        crypto.decrypt(F.col("e"), F.lit(KEY[::-1])).isNull().alias("wrong_key_fails"),
    )


@query("p02_checked_fields", f"""{REWRITTEN_SQL}
select d.doc_id, d.text as subject, {FOLD_SQL.format(column='d.text')} as "userToken" from documents d left join folded f on f.doc_id = d.doc_id""")
def _(t):
    docs = t.documents.select("doc_id", F.col("text").alias("subject"), F.col("text").alias("userToken"))
    return pii.redact_rows(docs).select("doc_id", "subject", "userToken")


@query("p06_nested_redaction", f"""{REWRITTEN_SQL}
select d.doc_id, {FOLD_SQL.format(column='d.text')} as inner_text, {FOLD_SQL.format(column='d.text')} as listed_text, d.text as tag, 2 * coalesce(f.n, 0) as n
from documents d left join folded f on f.doc_id = d.doc_id""")
def _(t):
    body = F.col("text")
    docs = t.documents.select(
        "doc_id", F.struct(body.alias("content")).alias("meta"), F.array(F.struct(body.alias("message"))).alias("items"), F.array(body).alias("tags")
    )
    out = pii.redact_rows(docs)
    return out.select(
        "doc_id", F.col("meta.content").alias("inner_text"), F.col("items")[0]["message"].alias("listed_text"), F.col("tags")[0].alias("tag"),
        F.col("_pii_count").cast("long").alias("n"),
    )


@query("p07_configured_redaction", f"""{REWRITTEN_SQL}
select d.doc_id, {FOLD_SQL.format(column='d.text')} as note, d.text as description, d.text as untouched from documents d left join folded f on f.doc_id = d.doc_id""")
def _(t):
    docs = t.documents.select("doc_id", F.col("text").alias("note"), F.col("text").alias("description"))
    custom = pii.redact_rows(docs, fields=["note"]).select("doc_id", "note", "description")
    off = pii.redact_rows(docs, enabled=False).select("doc_id", F.col("note").alias("untouched"))
    return custom.join(off, "doc_id")


@query("s11_compressed_export", "select id, risk_level, description from logs")
def _(t):
    folder = jobs.work_folder(t.spark)
    sinks.export_logs(t.logs, folder, "json", compress=True)
    return readers.read_table(t.spark, folder, "id string, risk_level string, description string", "json")


CLEAN_SQL = f"""
with found as ({DETECT_SQL}),
folded as (select doc_id, list({{'t': '', 'o': original, 'r': redacted}} order by step, pos) as ds, count(*) as n from found group by doc_id),
detail_found as ({_detect_sql('logs', 'id', 'details')}),
detail_folded as (select id, list({{'t': '', 'o': original, 'r': redacted}} order by step, pos) as ds, count(*) as n from detail_found group by id),
texts as (select d.doc_id, coalesce(f.n, 0) as n, {FOLD_SQL.format(column='d.text')} as description from documents d left join folded f on f.doc_id = d.doc_id),
details as (select l.id, coalesce(f.n, 0) as n, {FOLD_SQL.format(column='l.details')} as details from logs l left join detail_folded f on f.id = l.id),
clean as (select c.id, c.ts, c.user_name, c.activity_type, c.risk_level, c.ip_address, t.description, x.details, t.n + x.n as n
  from logs_core c join texts t on t.doc_id = c.event_id % (select count(*) from documents) join details x on x.id = c.id),
enriched as ({POLICY_SQL.replace('from logs)', 'from clean)').replace('length(description) % 10 = 0 as anomaly', 'false as anomaly')})"""


@query("t01_enriched_stream", f"{CLEAN_SQL} select e.id, e.risk_level, e.description, c.n as pii_count from enriched e join clean c on c.id = e.id")
def _(t):
    s = text_queries_stream(t)
    out = jobs.run_available(jobs.enriched(s.logs, text_queries.SETTINGS), jobs.work_folder(t.spark))
    return out.select("id", "risk_level", "description", F.col("_pii_count").cast("long").alias("pii_count"))


@query("s17_published_rows", f"{CLEAN_SQL} select id, user_name, risk_level from enriched where risk_level in ('HIGH', 'CRITICAL')")
def _(t):
    """The ingest sink read by live consumers: severe rows of the stored batches."""
    s = text_queries_stream(t)
    folder = jobs.work_folder(t.spark)
    s.logs.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(
        jobs.ingest_batch(text_queries.SETTINGS, None, f"{folder}/logs")
    ).start().awaitTermination()
    stored = t.spark.read.parquet(f"{folder}/logs")
    return stored.filter(F.col("risk_level").isin("HIGH", "CRITICAL")).select("id", "user_name", "risk_level")


def text_queries_stream(t):
    from actilens.sources.views import StreamTables

    return StreamTables(t.spark, t.folder, ("events",))


@query("o01_policy_off", "select id, risk_level, description from logs")
def _(t):
    off = policy.Settings(alert_on_keywords=False, block_gambling=False)
    return policy.apply_policies(t.logs, off).select("id", "risk_level", "description")
