"""Queries for federated aggregation, features, evaluation metrics and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from actilens.functions import vectors
from actilens.operators import features, federated, metrics
from actilens.plans.registry import query
from actilens.session import cut_lineage
from actilens.streaming.jobs import work_folder

AS_OF = "2024-02-01 00:00:00"

# --- federated ---------------------------------------------------------------------------------

VERDICT_SQL = """
select u.*, f.opened_at, f.dimension, f.round_min_clients, f.expires_at, len(u.masked_update) as dim,
  case when u.submitted_at > f.expires_at then 'round_expired' when w.won < (u.submitted_at, u.message_id) then 'duplicate_agent_submission'
       when len(u.masked_update) <> f.dimension then 'dimension_mismatch' else 'accepted' end as verdict
from federated_updates u
join rounds_opened f on f.round_id = u.round_id
left join winners w on w.round_id = u.round_id and w.agent_id = u.agent_id"""
FED_SQL = f"""
with rounds_opened as (select round_id, min(submitted_at) as opened_at, arg_min(len(masked_update), (submitted_at, message_id)) as dimension,
    greatest(1, arg_min(min_clients, (submitted_at, message_id))) as round_min_clients,
    min(submitted_at) + to_seconds(greatest(30, arg_min(timeout_seconds, (submitted_at, message_id)))) as expires_at from federated_updates group by round_id),
winners as (select u.round_id, u.agent_id, min((u.submitted_at, u.message_id)) as won from federated_updates u join rounds_opened f on f.round_id = u.round_id
  where u.submitted_at <= f.expires_at and len(u.masked_update) = f.dimension group by 1, 2),
judged as ({VERDICT_SQL}),
accepted as (select *, cast(greatest(num_samples, 1) as double) as weight from judged where verdict = 'accepted'),
joined as (select a.*, r.mask from accepted a left join federated_reveals r on r.round_id = a.round_id and r.agent_id = a.agent_id),
status as (select round_id, count(*) as submitted, count(mask) as revealed, max(dimension) as dimension, cast(sum(num_samples) as bigint) as total_samples,
  avg(epsilon) as avg_epsilon, max(round_min_clients) as min_clients, max(expires_at) as expires_at, greatest(0, count(*) - count(mask)) as pending,
  count(*) >= max(round_min_clients) and count(mask) = count(*) as finalized from joined group by round_id)"""


@query("a17_local_vectors", """
select user_name as agent_id, round(avg(hour(ts)), 9) as hour, round(avg(isodow(ts) - 1), 9) as day,
  round(avg(case risk_level when 'MEDIUM' then 5 when 'HIGH' then 8 when 'CRITICAL' then 10 else 1 end), 9) as risk_score, count(*) as num_samples
from logs_core group by user_name having count(*) >= 10""")
def _(t):
    v = federated.local_vectors(t.logs_slim)
    return v.select("agent_id", *[F.round(c, 9).alias(c) for c in ("hour", "day", "risk_score")], "num_samples")


@query("a18_plain_average", """
select key, round(sum(v) / (select count(*) from logs_core), 9) as average from (
  select lower(activity_type) as key, value as v from logs_core union all select 'all', value from logs_core) group by key""")
def _(t):
    updates = t.logs_core.select(F.create_map(F.lower("activity_type"), F.col("value"), F.lit("all"), F.col("value")).alias("weights"))
    return federated.plain_average(updates, "weights").select("key", F.round("average", 9).alias("average"))


@query("a18_plain_vector_average", """
select pos, round(sum(x) / (select count(*) from embeddings), 9) as average
from (select unnest(cast(embedding as double[])) as x, generate_subscripts(embedding, 1) - 1 as pos from embeddings where vec_id % 3 <> 0) group by pos""")
def _(t):
    e = t.raw("embeddings").select(F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("v"))
    out = federated.plain_vector_average(e, "v")
    return out.select(F.posexplode("average").alias("pos", "average")).withColumn("average", F.round("average", 9))


@query("w12_submission_verdicts", f"{FED_SQL} select message_id, round_id, agent_id, verdict from judged")
def _(t):
    return federated.submission_verdicts(t.federated_updates).select("message_id", "round_id", "agent_id", "verdict")


@query("w12_message_verdicts", f"""{FED_SQL},
sent as (select round_id, agent_id, message_id, (submitted_at, message_id) as o, verdict, dimension, round_min_clients from judged),
shown as (select r.round_id, r.agent_id, 'reveal-' || r.agent_id as message_id, (r.revealed_at, 'reveal-' || r.agent_id) as o, len(r.mask) as size, s.o as sent_o,
  s.dimension, s.round_min_clients from federated_reveals r left join sent s on s.round_id = r.round_id and s.agent_id = r.agent_id and s.verdict = 'accepted'),
first_shown as (select round_id, agent_id, min(o) as first_o, max(round_min_clients) as n from shown where sent_o < o and size = dimension group by 1, 2),
events as (select round_id, o, 0 as kind, round_min_clients as n from sent where verdict = 'accepted' union all select round_id, first_o, 1, n from first_shown),
counted as (select *, sum(kind) over w as shown, sum(1 - kind) over w as got from events window w as (partition by round_id order by o, kind)),
closed as (select round_id, min(o) as closed_o from counted where kind = 1 and shown = got and got >= n group by round_id),
opened as (select round_id, min(o) as opened_o from sent group by round_id)
select s.round_id, s.agent_id, s.message_id, 'update' as kind, case when c.closed_o < s.o then 'round_already_finalized' else s.verdict end as verdict
from sent s left join closed c on c.round_id = s.round_id
union all
select r.round_id, r.agent_id, r.message_id, 'reveal', case when p.opened_o is null or r.o < p.opened_o then 'unknown_round' when c.closed_o < r.o then 'round_already_finalized'
  when r.sent_o is null or r.sent_o > r.o then 'no_submission' when f.first_o < r.o then 'mask_already_revealed' when r.size <> r.dimension then 'dimension_mismatch' else 'revealed' end
from shown r left join closed c on c.round_id = r.round_id left join opened p on p.round_id = r.round_id
left join first_shown f on f.round_id = r.round_id and f.agent_id = r.agent_id""")
def _(t):
    return federated.message_verdicts(t.federated_updates, t.federated_reveals)


@query("j06_revealed_updates", f"{FED_SQL} select round_id, agent_id, message_id, weight, mask is not null as revealed from joined")
def _(t):
    r = federated.revealed_updates(t.federated_updates, t.federated_reveals)
    return r.select("round_id", "agent_id", "message_id", "weight", F.col("mask").isNotNull().alias("revealed"))


@query("j06_pending_reveals", f"{FED_SQL} select round_id, agent_id from joined where mask is null")
def _(t):
    return federated.pending_reveals(t.federated_updates, t.federated_reveals)


@query("j06_refused_reveals", f"""{FED_SQL}
select r.round_id, r.agent_id from federated_reveals r left join accepted a on a.round_id = r.round_id and a.agent_id = r.agent_id where a.agent_id is null""")
def _(t):
    return federated.refused_reveals(t.federated_updates, t.federated_reveals)


@query("a20_round_status", f"{FED_SQL} select * from status")
def _(t):
    return federated.round_status(t.federated_updates, t.federated_reveals)


@query("a19_secure_average", f"""{FED_SQL}
select s.round_id, s.submitted as num_clients, s.total_samples, s.avg_epsilon, p.pos, p.value from status s join (
  select round_id, pos, round(sum(weight * (u - m)) / sum(weight), 9) as value from (
    select round_id, weight, unnest(masked_update) as u, unnest(mask) as m, generate_subscripts(mask, 1) - 1 as pos from joined where mask is not null) group by round_id, pos) p
on p.round_id = s.round_id where s.finalized""")
def _(t):
    out = federated.secure_average(t.federated_updates, t.federated_reveals)
    return out.select(
        "round_id", "num_clients", "total_samples", "avg_epsilon", F.posexplode("feature_vector").alias("pos", "value")
    ).withColumn("value", F.round("value", 9))


@query("h22_l2_clip", """
select vec_id, pos, round(case when n > 0.5 then x * (0.5 / n) else x end, 7) as x from (
  select vec_id, sqrt(list_sum(list_transform(cast(embedding as double[]), lambda v: v * v))) as n, unnest(cast(embedding as double[])) as x,
    generate_subscripts(embedding, 1) - 1 as pos from embeddings)""")
def _(t):
    clipped = vectors.l2_clip(F.col("embedding").cast("array<double>"), 0.5)
    return t.raw("embeddings").select("vec_id", F.posexplode(clipped).alias("pos", "x")).withColumn("x", F.round("x", 7))


def draw_sql(seed: int, stream: int, key: str) -> str:
    """The draw of a counter, as the vector functions make it; ``pos`` is the position."""
    return f"((('0x' || substr(sha256('{seed}|{stream}|' || {key} || '|' || pos), 1, 13))::bigint) + 0.5) / {2**52}.0"


#: Local vectors clipped to norm 10, with Laplace noise of scale 1.
PRIVATE_SQL = f"""
with means as (select user_name as agent_id, [avg(hour(ts)), avg(isodow(ts) - 1),
    avg(case risk_level when 'MEDIUM' then 5.0 when 'HIGH' then 8.0 when 'CRITICAL' then 10.0 else 1.0 end)] as v, count(*) as num_samples
  from logs_core group by user_name having count(*) >= 10),
norms as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as n from means),
clipped as (select agent_id, num_samples, unnest(v) * case when n > 10 then 10 / n else 1 end as x, generate_subscripts(v, 1) - 1 as pos from norms),
drawn as (select *, {draw_sql(7, 1, "agent_id")} - 0.5 as u from clipped),
private as (select agent_id, num_samples, pos, x - sign(u) * ln(1 - 2 * abs(u)) as value from drawn)"""


@query("h23_laplace_noise", f"{PRIVATE_SQL} select agent_id, pos, round(value, 7) as value from private")
def _(t):
    noisy = federated.privatised(federated.local_vectors(t.logs_slim), federated.Privacy(), seed=7)
    return noisy.select("agent_id", F.posexplode("dp_vector").alias("pos", "value")).withColumn("value", F.round("value", 7))


MASK_KEY = "'round-1|' || agent_id"


@query("h24_masked_updates", f"""{PRIVATE_SQL},
masks as (select *, sqrt(-2 * ln({draw_sql(8, 2, MASK_KEY)})) * cos(2 * pi() * ({draw_sql(8, 3, MASK_KEY)})) as mask from private)
select 'round-1' as round_id, agent_id, pos, round(value + mask, 7) as masked, round(mask, 7) as mask, num_samples, 1.0::double as epsilon from masks""")
def _(t):
    out = federated.masked_updates(federated.local_vectors(t.logs_slim), "round-1", federated.Privacy(), seed=7)
    each = F.posexplode(F.arrays_zip("masked_update", "mask")).alias("pos", "x")
    flat = out.select("round_id", "agent_id", each, "num_samples", "epsilon")
    return flat.select("round_id", "agent_id", "pos", F.round("x.masked_update", 7).alias("masked"), F.round("x.mask", 7).alias("mask"), "num_samples", "epsilon")


# --- features ----------------------------------------------------------------------------------

TOKENS = r"case when trim(regexp_replace(description, '[ \t\n\r\f\v]+', ' ', 'g')) = '' then 0 else len(string_split(trim(regexp_replace(description, '[ \t\n\r\f\v]+', ' ', 'g')), ' ')) end"
RAW_SQL = f"""
select id, user_name, activity_type, hour(ts) as hour, isodow(ts) - 1 as day_of_week, sin(2 * pi() * hour(ts) / 24) as hour_sin, cos(2 * pi() * hour(ts) / 24) as hour_cos,
  sin(2 * pi() * (isodow(ts) - 1) / 7) as dow_sin, cos(2 * pi() * (isodow(ts) - 1) / 7) as dow_cos, length(description) as description_length,
  {TOKENS} as description_token_count from logs"""
SCALED_SQL = ", ".join(
    f"round(({c} - (select avg({c}) from raw)) / (select case when stddev_pop({c}) = 0 then 1 else stddev_pop({c}) end from raw), 6) as {c}"
    for c in features.SCALED
)


@query("m01_feature_frame", f"""with raw as materialized ({RAW_SQL})
select id, {SCALED_SQL}, dense_rank() over (order by user_name) - 1 as user_encoded, dense_rank() over (order by activity_type) - 1 as activity_type_encoded from raw""")
def _(t):
    raw = cut_lineage(
        features.raw_features(t.logs, AS_OF).select("id", "user_name", "activity_type", *features.SCALED)
    )
    out = features.fit_raw(raw, AS_OF).transform_raw(raw)
    return out.select("id", *[F.round(c, 6).alias(c) for c in features.SCALED], *features.ENCODED)


def _store_sql() -> str:
    """One select for each feature, in model order."""
    rows = []
    for k, c in enumerate(features.FEATURES):
        if c in features.ENCODED:
            values = f"null::double as mean, null::double as std, count(distinct {features.ENCODED[c]}) as codes"
        else:
            values = f"round(avg({c}), 7) as mean, round(case when stddev_pop({c}) = 0 then 1 else stddev_pop({c}) end, 7) as std, null::bigint as codes"
        rows.append(f"select {k} as position, '{c}' as feature, {values} from raw")
    return " union all ".join(rows)


@query("s14_feature_columns", f"with raw as materialized ({RAW_SQL}) {_store_sql()}")
def _(t):
    """The fitted encoders, scaler and feature list, saved and loaded again."""
    raw = cut_lineage(features.raw_features(t.logs, AS_OF).select("id", "user_name", "activity_type", *features.SCALED))
    folder = work_folder(t.spark)
    features.fit_raw(raw, AS_OF).save(folder)
    listed = t.spark.read.parquet(f"{folder}/feature_columns")
    fitted = features.FittedFeatures.load(t.spark, folder).described()
    return listed.join(fitted, "feature").select("position", "feature", F.round("mean", 7).alias("mean"), F.round("std", 7).alias("std"), "codes")


@query("m02_label_codes", "select value, row_number() over (order by value) - 1 as code from (select distinct user_name as value from logs_core)")
def _(t):
    return features.fit_encoder(t.logs_slim, "user_name")


@query("j10_encoder_lookup", """
select u.user_name, coalesce(e.code, 0) as code from users u left join (
  select value, row_number() over (order by value) - 1 as code from (select distinct user_name as value from logs_core)) e on e.value = u.user_name""")
def _(t):
    return features.encode(t.users.select("user_name"), features.fit_encoder(t.logs_slim, "user_name"), "user_name", "code")


@query("m03_scaler", """
select round(avg(value), 6) as value_mean, round(case when stddev_pop(value) = 0 then 1 else stddev_pop(value) end, 6) as value_std, 4.0e0 as flat_mean, 1e0 as flat_std from logs_core""")
def _(t):
    s = features.fit_scaler(t.logs_core.withColumn("flat", F.lit(4.0)), ["value", "flat"])
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


HASH_SQL = "cast('0x' || substring(sha256('42|' || id), 1, 15) as bigint)"


@query("m13_stratified_split", f"""
select id, risk_level, rank <= round(0.2e0 * n) as is_validation from (
  select id, risk_level, row_number() over (partition by risk_level order by {HASH_SQL}, id) as rank, count(*) over (partition by risk_level) as n from logs_core)""")
def _(t):
    return features.stratified_split(t.logs_slim.select("id", "risk_level"), "risk_level")


BALANCED_SQL = f"""
attacks as (select id, risk_level, 1 as label from logs_core where risk_level in ('HIGH', 'CRITICAL') order by {HASH_SQL}, id limit 2000),
normals as (select id, risk_level, 0 as label, row_number() over (order by {HASH_SQL}, id) as rn from logs_core where risk_level in ('INFO', 'LOW')),
balanced as (select id, risk_level, label from attacks union all select id, risk_level, label from normals where rn <= 3 * (select count(*) from attacks))"""


@query("m14_balanced_set", f"with {BALANCED_SQL} select * from balanced")
def _(t):
    return features.balanced_training_set(t.logs_slim).select("id", "risk_level", "label")


@query("u05_sample_union", f"with {BALANCED_SQL} select label, risk_level, count(*) as n from balanced group by 1, 2")
def _(t):
    return features.balanced_training_set(t.logs_slim).groupBy("label", "risk_level").agg(F.count("*").alias("n"))


@query("m16_legacy_features", """
select id as log_id, unnest(['hour', 'day', 'risk_score']) as feature, unnest([cast(hour(ts) as double), isodow(ts) - 1, case risk_level when 'HIGH' then 8 else 10 end]) as contribution
from logs_core where risk_level in ('HIGH', 'CRITICAL')""")
def _(t):
    return features.legacy_explanations(t.logs_slim, AS_OF)


# --- evaluation --------------------------------------------------------------------------------

P = ["precision", "recall", "f1_score"]


def _rounded(df, columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


REPORT_SQL = """
per as (select model_name, label, sum(tp) as tp, sum(support) as support, sum(predicted) as predicted from (
    select model_name, y_true as label, case when y_true = y_pred then 1 else 0 end as tp, 1 as support, 0 as predicted from predictions
    union all select model_name, y_pred, 0, 0, 1 from predictions) group by 1, 2),
per1 as (select *, case when predicted = 0 then 0e0 else tp / predicted end as precision, case when support = 0 then 0e0 else tp / support end as recall from per),
per2 as (select *, case when precision + recall = 0 then 0e0 else 2 * precision * recall / (precision + recall) end as f1_score from per1),
overall as (select model_name, sum(tp) / sum(support) as accuracy, sum(precision * support) / sum(support) as precision,
  sum(recall * support) / sum(support) as recall, sum(f1_score * support) / sum(support) as f1_score from per2 group by 1)"""
AUC_SQL = """
steps as (select model_name, score, sum(y_true) as pos, sum(1 - y_true) as neg from predictions group by 1, 2),
sized as (select model_name, sum(y_true) as p, sum(1 - y_true) as n from predictions group by 1),
cum as (select s.*, z.p, z.n, sum(pos) over w as cum_pos, sum(neg) over w as cum_neg from steps s join sized z on z.model_name = s.model_name
  window w as (partition by s.model_name order by score desc rows unbounded preceding)),
areas as (select model_name, sum(pos * (n - cum_neg + neg / 2)) / (max(p) * max(n)) as roc_auc from cum group by 1)"""


@query("a22_confusion_matrix", """
with labels as (select distinct model_name, unnest([y_true, y_pred]) as label from predictions)
select a.model_name, a.label as y_true, b.label as y_pred, count(p.id) as n from labels a join labels b on b.model_name = a.model_name
left join predictions p on p.model_name = a.model_name and p.y_true = a.label and p.y_pred = b.label group by 1, 2, 3""")
def _(t):
    return metrics.confusion_matrix(t.predictions)


@query("a23_overall_report", f"""with {REPORT_SQL}
select model_name, round(accuracy, 9) as accuracy, round(precision, 9) as precision, round(recall, 9) as recall, round(f1_score, 9) as f1_score from overall""")
def _(t):
    return _rounded(metrics.overall_report(t.predictions), ["accuracy", *P])


@query("a24_class_report", f"""with {REPORT_SQL}
select model_name, cast(label as varchar) as average, round(precision, 9) as precision, round(recall, 9) as recall, round(f1_score, 9) as f1_score, cast(support as bigint) as support from per2
union all select model_name, 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1_score), 9), cast(sum(support) as bigint) from per2 group by 1
union all select model_name, 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9),
  round(sum(f1_score * support) / sum(support), 9), cast(sum(support) as bigint) from per2 group by 1""")
def _(t):
    per = metrics.class_report(t.predictions).select("model_name", F.col("label").cast("string").alias("average"), *P, "support")
    return _rounded(per.unionByName(metrics.averaged_report(t.predictions)), P)


@query("a25_binary_report", """
select model_name, round(ok / n, 9) as accuracy, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 9) as precision,
  round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 9) as recall, round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 9) as f1_score
from (select model_name, count(*) as n, count(*) filter (y_true = y_pred) as ok, count(*) filter (y_true = 1 and y_pred = 1) as tp,
  count(*) filter (y_true = 0 and y_pred = 1) as fp, count(*) filter (y_true = 1 and y_pred = 0) as fn from predictions group by 1)""")
def _(t):
    return _rounded(metrics.binary_report(t.predictions), ["accuracy", *P])


@query("a26_roc_auc", f"with {AUC_SQL} select model_name, round(roc_auc, 9) as roc_auc, cast(null as varchar) as roc_auc_error from areas")
def _(t):
    return _rounded(metrics.roc_auc(t.predictions), ["roc_auc"])


@query("a26_macro_auc", f"with {AUC_SQL} select 'all' as model_name, round(avg(roc_auc), 9) as roc_auc, cast(null as varchar) as roc_auc_error from areas")
def _(t):
    rows = t.predictions.withColumn("class", F.col("model_name")).withColumn("model_name", F.lit("all"))
    return _rounded(metrics.macro_auc(rows), ["roc_auc"])


@query("a27_roc_points", f"""with {AUC_SQL}
select model_name, score as threshold, round(cum_neg / n, 9) as fpr, round(cum_pos / p, 9) as tpr from cum
union all select distinct model_name, cast(null as double), 0e0, 0e0 from cum""")
def _(t):
    return _rounded(metrics.roc_points(t.predictions), ["fpr", "tpr"])


@query("a28_pr_points", f"""with {AUC_SQL}
select model_name, score as threshold, round(cum_pos / (cum_pos + cum_neg), 9) as precision, round(cum_pos / p, 9) as recall from cum""")
def _(t):
    return _rounded(metrics.pr_points(t.predictions), ["precision", "recall"])


@query("a28_pr_area", f"""with {AUC_SQL}, curve as (
  select model_name, cum_pos / (cum_pos + cum_neg) as pr, cum_pos / p as re, score from cum),
steps2 as (select *, lag(pr, 1, 1e0) over w as pr0, lag(re, 1, 0e0) over w as re0 from curve window w as (partition by model_name order by score desc))
select model_name, round(sum((re - re0) * (pr + pr0) / 2), 9) as pr_auc from steps2 group by 1""")
def _(t):
    return _rounded(metrics.pr_area(t.predictions), ["pr_auc"])


@query("a29_calibration", """
select model_name, len(list_filter([0.1e0, 0.2e0, 0.30000000000000004e0, 0.4e0, 0.5e0, 0.6000000000000001e0, 0.7000000000000001e0, 0.8e0, 0.9e0], lambda e: e < score)) as bin,
  round(avg(score), 9) as mean_predicted, round(avg(y_true), 9) as fraction_positive from predictions group by 1, 2""")
def _(t):
    return _rounded(metrics.calibration(t.predictions), ["mean_predicted", "fraction_positive"])


@query("a30_latency_percentiles", """
select model_name, round(quantile_cont(latency_ms, 0.5), 9) as p50, round(quantile_cont(latency_ms, 0.95), 9) as p95,
  round(quantile_cont(latency_ms, 0.99), 9) as p99, round(avg(latency_ms), 9) as mean from predictions group by 1""")
def _(t):
    return _rounded(metrics.latency_percentiles(t.predictions), ["p50", "p95", "p99", "mean"])


@query("a31_throughput", "select model_name, round(count(*) / 10e0, 9) as rows_per_second from predictions group by 1")
def _(t):
    return _rounded(metrics.throughput(t.predictions, 10.0), ["rows_per_second"])


SUMMARY_SQL = """select model_name, avg(latency_ms) filter (y_pred = 1) as avg_latency_ms, min(latency_ms) filter (y_pred = 1) as min_latency_ms,
  max(latency_ms) filter (y_pred = 1) as max_latency_ms, count(*) filter (y_pred = 1) as successful from predictions group by 1"""


@query("a32_latency_summary", f"select model_name, round(avg_latency_ms, 9) as avg_latency_ms, min_latency_ms, max_latency_ms, successful from ({SUMMARY_SQL})")
def _(t):
    return _rounded(metrics.latency_summary(t.predictions, F.col("y_pred") == 1), ["avg_latency_ms"])


@query("a32_recommended_model", f"select coalesce((select model_name from ({SUMMARY_SQL}) where avg_latency_ms < 2000 order by avg_latency_ms, model_name limit 1), 'base') as model_name")
def _(t):
    return metrics.recommended_model(metrics.latency_summary(t.predictions, F.col("y_pred") == 1), "base")


@query("a40_error_distribution", "select y_true as label, cast(floor(score / 0.05e0) as bigint) as bin, count(*) as n from predictions group by 1, 2")
def _(t):
    return metrics.error_distribution(t.predictions.select(F.col("y_true").alias("label"), F.col("score").alias("error")), 0.05)


@query("a41_class_counts", "select y_true, count(*) as n, round(100 * count(*) / cast((select count(*) from predictions) as double), 9) as share_percent from predictions group by 1")
def _(t):
    return _rounded(metrics.class_counts(t.predictions, "y_true"), ["share_percent"])


@query("m12_hybrid_vote", """
select id, case when a + b + r >= 2 then 1 else 0 end as hybrid, case when a + b = 2 then 1 else 0 end as both_unsupervised from (
  select id, case when score < 0.4 then 1 else 0 end as a, case when latency_ms > 5 then 1 else 0 end as b, y_pred as r from predictions)""")
def _(t):
    votes = t.predictions.select(
        "id", F.when(F.col("score") < 0.4, -1).otherwise(1).alias("if_pred"),
        F.when(F.col("latency_ms") > 5, -1).otherwise(1).alias("ae_pred"), F.col("y_pred").alias("rf_pred"),
    )
    return metrics.hybrid_vote(votes).select("id", "hybrid", "both_unsupervised")


@query("m18_metric_digest", f"""with {REPORT_SQL}, {AUC_SQL}
select o.model_name, unnest(['accuracy', 'precision', 'recall', 'f1_score', 'roc_auc']) as metric,
  round(unnest([o.accuracy, o.precision, o.recall, o.f1_score, a.roc_auc]), 9) as value from overall o join areas a on a.model_name = o.model_name""")
def _(t):
    both = metrics.overall_report(t.predictions).join(metrics.roc_auc(t.predictions), "model_name")
    return _rounded(metrics.metric_digest(both), ["value"])


@query("m19_claim_check", f"""with {REPORT_SQL}
select o.model_name, round(o.f1_score, 9) as f1_score, o.f1_score >= 0.9 as f1_passed, round(l.p50, 9) as p50, l.p50 < 500 as latency_passed
from overall o join (select model_name, quantile_cont(latency_ms, 0.5) as p50 from predictions group by 1) l on l.model_name = o.model_name
where o.model_name = (select model_name from overall where model_name in ('fr', 'en') order by case model_name when 'fr' then 1 else 2 end limit 1)""")
def _(t):
    out = metrics.claim_check(metrics.overall_report(t.predictions), metrics.latency_percentiles(t.predictions), ["fr", "en"])
    return _rounded(out, ["f1_score", "p50"])
