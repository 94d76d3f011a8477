"""Response rules: matching, guard rails, rate limiting, audit, status changes and derived events."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from actilens.functions.casts import json_object, or_default
from actilens.functions.timefns import iso_text
from actilens.operators import limiter
from actilens.operators.terms import with_terms
from actilens.scale import broadcast_if_small, time_chunk, with_neighbour
from actilens.session import cut_lineage

# Confidence that overrides approval, internal locations, statuses per action.
AUTO_APPROVE = 0.98
INTERNAL_LOCATIONS = ["internal", "local", "agent-monitored-device"]
STATUS_OF_ACTION = {"LOCK_USER": "LOCKED", "QUARANTINE_USER": "QUARANTINED"}
ENGINE_USER = "SOAR_ENGINE"

MAX_LITERAL_RULES = 200
#: Rows of a key without a quiet gap beyond which the limiter cuts them into time cells.
BUSY_ROWS = 1_000_000
#: Rules that may be broadcast to the texts in which they were found.
SMALL_RULES = 20_000
HOUR = 3_600

RULE_COLUMNS = {
    "id": "playbook_id", "name": "playbook_name", "action_type": "action_type", "action_target": "action_target",
    "min_confidence": "min_confidence", "requires_approval": "requires_approval",
    "rate_limit_count": "rate_limit_count", "rate_limit_window_seconds": "rate_limit_window_seconds",
    "scope": "scope",
}


# --- what a rule looks at ----------------------------------------------------------------------


def reported_risk(summary: Column) -> Column:
    """``risk_level`` inside the JSON summary: '' when absent, null when the JSON is unusable."""
    fields = json_object(F.coalesce(F.nullif(summary, F.lit("")), F.lit("{}")))
    return F.when(fields.isNull(), F.lit(None)).when(
        F.map_contains_key(fields, "risk_level"), fields["risk_level"]
    ).otherwise("")


def server_fields(logs: DataFrame) -> Callable[[str], Column | None]:
    """Trigger field names as stored rules use them; other names mean the column of that name."""
    special = {
        "riskLevel": F.col("risk_level"),
        "activityType": F.col("activity_type"),
        "description": F.col("description"),
        "llmRiskLevel": reported_risk(F.col("activity_summary")),
        "user": F.col("user_name"),
        "timestamp": iso_text(F.col("ts")),
    }
    return lambda name: special.get(name, F.col(name) if name in logs.columns else None)


def client_fields(logs: DataFrame) -> Callable[[str], Column | None]:
    """Trigger field names of the browser-side variant (camelCase attributes of a log)."""
    names = {
        "id": "id", "user": "user_name", "activityType": "activity_type", "riskLevel": "risk_level",
        "description": "description", "details": "details", "ipAddress": "ip_address", "location": "location",
        "activitySummary": "activity_summary",
    }
    return lambda name: F.col(names[name]) if names.get(name) in logs.columns else None


# Field names that stored rules use besides the columns themselves.
FIELD_NAMES = [
    "riskLevel", "activityType", "description", "llmRiskLevel", "user", "timestamp", "id", "details", "ipAddress", "location",
    "activitySummary",
]


# --- matching ----------------------------------------------------------------------------------


def match_rules(
    logs: DataFrame,
    playbooks: DataFrame,
    keep: Sequence[str],
    fields: Callable[[str], Column | None] | None = None,
    max_literal: int = MAX_LITERAL_RULES,
) -> DataFrame:
    """(log, rule) pairs for active rules, compared in upper case.

    A rule set checked to be small is compiled into expressions: one pass over the logs, no join.
    A larger one is an equi-join on (field, value) for ``equals``, and for ``contains`` one pass of the values past an
    automaton of all rule texts (``terms``); both give the same pairs.
    """
    fields = fields or server_fields(logs)
    usable = playbooks.filter(
        F.col("is_active") & F.col("trigger_operator").isin("equals", "contains") & F.col("trigger_field").isNotNull()
    )
    rules = usable.select(
        "trigger_field",
        "trigger_operator",
        F.upper(F.coalesce("trigger_value", F.lit("None"))).alias("trigger_text"),
        *[F.col(c).alias(a) for c, a in RULE_COLUMNS.items()],
    )
    heads = rules.limit(max_literal + 1).collect()
    if len(heads) <= max_literal:
        return _match_literal(logs, heads, rules.schema, keep, fields)
    return _match_joined(logs, rules, keep, fields)


def _match_literal(logs, heads, schema, keep, fields) -> DataFrame:
    """Rules are told apart by their place in ``heads``, so rules that share an id stay two rules."""
    used = {h["trigger_field"]: fields(h["trigger_field"]) for h in heads}
    used = {name: column for name, column in used.items() if column is not None}
    number = {name: f"_u{i}" for i, name in enumerate(sorted(used))}
    prepared = logs.withColumns({number[n]: F.upper(c.cast("string")) for n, c in used.items()})
    hits = []
    for place, h in enumerate(heads):
        if h["trigger_field"] not in used:
            continue
        value, wanted = F.col(number[h["trigger_field"]]), F.lit(h["trigger_text"])
        test = value == wanted if h["trigger_operator"] == "equals" else F.contains(value, wanted)
        hits.append(F.when(test, F.lit(place)))
    matched = F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<int>")
    pairs = prepared.select(*keep, F.explode(matched).alias("_rule"))
    numbered = T.StructType([T.StructField("_rule", T.IntegerType()), *schema.fields])
    rules = logs.sparkSession.createDataFrame([(place, *h) for place, h in enumerate(heads)], numbered)
    return pairs.join(F.broadcast(rules.drop("trigger_field", "trigger_operator", "trigger_text")), "_rule").drop("_rule")


def _match_joined(logs, rules, keep, fields) -> DataFrame:
    # Every name that a log of these columns can have; rules of other names find no partner in the joins.
    names = sorted({*FIELD_NAMES, *logs.columns})
    known = [(n, fields(n)) for n in names if fields(n) is not None]
    if not known:
        return logs.select(*keep).crossJoin(F.broadcast(rules.limit(0))).drop("trigger_field", "trigger_operator", "trigger_text")
    stacked = F.array(*[F.struct(F.lit(n).alias("f"), F.upper(c.cast("string")).alias("v")) for n, c in known])
    wanted = rules.select("trigger_field").distinct()  # one of the known names at most that many times
    values = (
        logs.select(*keep, F.explode(stacked).alias("x"))
        .select(*keep, F.col("x.f").alias("trigger_field"), F.col("x.v").alias("_value"))
        .filter(F.col("_value").isNotNull())
        .join(F.broadcast(wanted.filter(F.col("trigger_field").isin([n for n, _ in known]))), "trigger_field", "left_semi")
    )
    equal = rules.filter(F.col("trigger_operator") == "equals").withColumnRenamed("trigger_text", "_value")
    out = values.join(equal, ["trigger_field", "_value"]).drop("_value", "trigger_field", "trigger_operator")
    inside = rules.filter(F.col("trigger_operator") == "contains")
    entries = inside.select(F.col("trigger_field").alias("label"), F.col("trigger_text").alias("term"))
    marked = with_terms(values, "_value", entries, "_hits").select(*keep, "trigger_field", F.explode("_hits").alias("_h"))
    hits = marked.filter(F.col("_h.label") == F.col("trigger_field")).select(*keep, "trigger_field", F.col("_h.term").alias("trigger_text"))
    found = hits.join(broadcast_if_small(inside, SMALL_RULES), ["trigger_field", "trigger_text"])
    return out.unionByName(found.drop("trigger_field", "trigger_text", "trigger_operator"))


# --- guard rails -------------------------------------------------------------------------------


def confidence(summary: Column) -> Column:
    """Confidence from the JSON summary, 0 when absent or unreadable, clamped to [0, 1]; true is 1."""
    found = json_object(summary)["confidence"]
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(summary), "$.confidence", "variant"))
    value = F.when(kind == "BOOLEAN", (found == "true").cast("double")).otherwise(found.try_cast("double"))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value, F.lit(0.0))))


def action_target(target: Column, action: Column, ip: Column, user: Column) -> Column:
    fallback = F.when(action == "BLOCK_IP", F.coalesce(ip, F.lit(""))).otherwise(F.coalesce(user, F.lit("")))
    return F.coalesce(F.nullif(target, F.lit("")), fallback)


def scope_matches(scope: Column, location: Column) -> Column:
    inside = F.lower(F.coalesce(location, F.lit(""))).isin(INTERNAL_LOCATIONS)
    return F.when(scope == "internal_only", inside).otherwise(True)


def needs_approval(required: Column, value: Column) -> Column:
    return F.coalesce(required, F.lit(False)) & (value < AUTO_APPROVE)


PAIR_LOG_COLUMNS = ["id", "ts", "user_name", "ip_address", "location", "risk_level", "activity_summary"]


def guarded_pairs(logs: DataFrame, playbooks: DataFrame) -> DataFrame:
    """Matched pairs with confidence, target and the verdict of the stateless guard rails.

    ``status`` stays null for the pairs that go on to the rate limiter.
    """
    pairs = match_rules(logs, playbooks, PAIR_LOG_COLUMNS).withColumns(
        {
            "confidence": confidence(F.col("activity_summary")),
            "target": action_target(F.col("action_target"), F.col("action_type"), F.col("ip_address"), F.col("user_name")),
        }
    )
    low = F.col("confidence") < F.coalesce("min_confidence", F.lit(0.0))
    outside = ~scope_matches(F.col("scope"), F.col("location"))
    approval = needs_approval(F.col("requires_approval"), F.col("confidence"))
    return pairs.withColumns(
        {
            "status": F.when(outside | low, "skipped").when(approval, "pending_approval"),
            "reason": F.when(outside, F.concat(F.lit("scope_mismatch:"), "scope"))
            .when(low, F.format_string("confidence_below_threshold:%.2f", F.round("confidence", 2)))
            .when(approval, "manual_approval_required"),
        }
    ).drop("activity_summary", "location", "action_target", "min_confidence", "requires_approval", "scope")


def rate_limit(
    df: DataFrame, keys: Sequence[str], limit: Column, window_seconds: Column, order: Sequence[str] = ("ts", "id"),
    busy_rows: int = BUSY_ROWS, cell_rows: int = limiter.CELL_ROWS,
) -> DataFrame:
    """Add ``allowed``: greedy sliding-window limiter per key; refused rows use no quota.

    A key is first split at every quiet gap of at least one window, where all admitted rows have
    expired, so a busy key is spread over many tasks. Inside a part the rows stream through in
    order and are never gathered. A part of more than ``busy_rows`` is cut into time cells, whose
    begin states come from composed jump tables, with the same result.
    """
    span = F.greatest(F.coalesce(window_seconds, F.lit(1)).cast("long"), F.lit(1).cast("long")) * 1_000_000
    base = df.withColumns(
        {
            "_limit": F.greatest(F.coalesce(limit, F.lit(1)).cast("long"), F.lit(1).cast("long")),
            "_span": span,
            "_micros": F.unix_micros("ts"),
        }
    ).withColumn("_window", F.floor(F.col("_micros") / F.col("_span")))
    cells = base.groupBy(*keys, "_window").agg(
        F.min("_micros").alias("_from"), F.max("_micros").alias("_to"), F.max("_span").alias("_w"), F.max("_limit").alias("_l"),
        F.count("*").alias("_n"),
    )
    by_time = Window.partitionBy(*keys).orderBy("_window")
    fresh = F.col("_from") - F.lag("_to").over(by_time) >= F.col("_w")
    begun = cells.withColumn("_fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn(
        "_part", F.sum("_fresh").over(by_time.rowsBetween(Window.unboundedPreceding, 0))
    )
    whole = Window.partitionBy(*keys, "_part")
    totals = {"_n": F.sum("_n").over(whole), "_from": F.min("_from").over(whole), "_to": F.max("_to").over(whole), "_l": F.max("_l").over(whole)}
    parts = cut_lineage(begun.withColumns(totals).select(*keys, "_window", "_part", *totals))
    placed = base.join(parts, [*keys, "_window"]).withColumn("_key", F.to_json(F.struct(*keys, "_part"))).drop("_window", "_part")
    busy = (F.col("_n") > busy_rows) & (F.col("_l") <= limiter.MOST)
    plain = {"_cell": F.lit(0).cast("long"), "_entry": F.lit(False), "_last": F.array().cast("array<long>")}
    ready = placed.where(~busy).withColumns(plain)
    if not parts.where(busy).isEmpty():
        ready = ready.unionByName(limiter.with_states(placed.where(busy), cell_rows))
    helpers = ["_n", "_from", "_to", "_l"]
    ready = ready.drop(*helpers)
    ordered = ready.repartition("_key", "_cell").sortWithinPartitions("_key", "_cell", F.desc("_entry"), "_micros", *order)
    schema = T.StructType([*ordered.schema.fields, T.StructField("allowed", T.BooleanType())])
    return ordered.mapInArrow(limiter.admit, schema).select(*df.columns, "allowed")


def audit(logs: DataFrame, playbooks: DataFrame) -> DataFrame:
    """One row per matched pair with its final status; executed rows are those the limiter admits.

    The matched pairs, a narrow table without texts, are stored first: the three steps that follow
    would otherwise scan and match the logs once each.
    """
    pairs = cut_lineage(guarded_pairs(logs, playbooks))
    settled = pairs.filter(F.col("status").isNotNull())
    open_ = pairs.filter(F.col("status").isNull()).withColumn("_t", or_default(F.col("target"), "-"))
    limited = rate_limit(
        open_, ["playbook_id", "_t"], F.col("rate_limit_count"), F.col("rate_limit_window_seconds"),
        ["ts", "id", "playbook_id"],
    ).drop("_t")
    decided = limited.withColumns(
        {
            "status": F.when(F.col("allowed"), "executed").otherwise("rate_limited"),
            "reason": F.when(F.col("allowed"), "executed_successfully").otherwise("rate_limit_exceeded"),
        }
    ).drop("allowed")
    return settled.unionByName(decided).select(
        F.sha2(F.concat_ws("|", "playbook_id", "id"), 256).alias("audit_id"),
        "ts", "playbook_id", "playbook_name", F.col("id").alias("source_log_id"), "user_name", "action_type",
        "target", "status", "reason", "risk_level", "confidence",
    )


# --- effects -----------------------------------------------------------------------------------


def status_requests(audited: DataFrame) -> DataFrame:
    """Executed rows that ask for a user status."""
    pairs = [F.lit(x) for kv in STATUS_OF_ACTION.items() for x in kv]
    executed = audited.filter((F.col("status") == "executed") & F.col("action_type").isin(*STATUS_OF_ACTION))
    return executed.select(
        "user_name", "ts", "source_log_id", "playbook_id", "playbook_name",
        F.create_map(*pairs)[F.col("action_type")].alias("new_status"),
    )


def status_changes(audited: DataFrame, users: DataFrame) -> DataFrame:
    """Real status transitions of known users, in (time, log, rule) order."""
    known = status_requests(audited).join(
        users.select("user_name", F.col("status").alias("old_status")), "user_name"
    )
    chained = with_neighbour(
        known, ["user_name"], ["ts", "source_log_id", "playbook_id"], ["new_status"], time_chunk("ts", HOUR), False, "prev"
    )
    before = F.coalesce("prev.new_status", "old_status")
    return chained.filter(~before.eqNullSafe(F.col("new_status"))).withColumn("before", before).drop("prev", "old_status")


def unknown_targets(audited: DataFrame, users: DataFrame) -> DataFrame:
    """Status requests for users that do not exist; they have no effect."""
    return status_requests(audited).join(users.select("user_name"), "user_name", "left_anti")


def updated_users(audited: DataFrame, users: DataFrame) -> DataFrame:
    """The whole users table after all executed actions; the last rule wins."""
    last = status_requests(audited).groupBy("user_name").agg(
        F.max_by("new_status", F.struct("ts", "source_log_id", "playbook_id")).alias("_new")
    )
    return users.join(last, "user_name", "left").withColumn("status", F.coalesce("_new", "status")).drop("_new")


def system_events(audited: DataFrame, users: DataFrame, logs: DataFrame) -> DataFrame:
    """Log rows written by the rules: one per status change and one per executed admin alert."""
    changed = status_changes(audited, users).select(
        F.sha2(F.concat_ws("|", F.lit("action"), "playbook_id", "source_log_id"), 256).alias("id"),
        "ts",
        F.lit("SOAR_ACTION").alias("activity_type"),
        F.lit("INFO").alias("risk_level"),
        F.concat(F.lit("User "), "user_name", F.lit(" account "), "new_status").alias("description"),
        F.concat(F.lit("Triggered by playbook: "), "playbook_name").alias("details"),
    )
    alerts = audited.filter((F.col("status") == "executed") & (F.col("action_type") == "ALERT_ADMIN"))
    texts = logs.select(F.col("id").alias("source_log_id"), F.col("description").alias("_text"))
    raised = alerts.join(texts, "source_log_id").select(
        F.sha2(F.concat_ws("|", F.lit("alert"), "playbook_id", "source_log_id"), 256).alias("id"),
        "ts",
        F.lit("HIGH_PRIORITY_ALERT").alias("activity_type"),
        F.lit("CRITICAL").alias("risk_level"),
        F.concat(F.lit("Alert: "), "playbook_name").alias("description"),
        F.concat(F.lit("Triggered by activity from "), "user_name", F.lit(": "), "_text").alias("details"),
    )
    return changed.unionByName(raised).withColumns(
        {"user_name": F.lit(ENGINE_USER), "location": F.lit("Internal")}
    )


def request_logs(requests: DataFrame) -> DataFrame:
    """Operator action requests as log rows; unknown targets are logged all the same."""
    action, target = F.col("action"), F.col("target")
    return requests.select(
        F.col("request_id").alias("id"), "ts", F.col("requested_by").alias("user_name"),
        F.lit("SOAR_ACTION").alias("activity_type"),
        F.when(action == "block_ip", "INFO").when(action == "isolate_host", "HIGH").otherwise("MEDIUM").alias("risk_level"),
        F.when(action == "block_ip", F.concat(F.lit("Blocked IP Address: "), target))
        .when(action == "isolate_host", F.concat(F.lit("Isolated Host: "), target))
        .otherwise(F.concat(F.lit("Reset Password for User: "), target))
        .alias("description"),
        F.concat(F.lit("Reason: "), or_default(F.col("reason"), "Manual Action")).alias("details"),
        F.when(action == "block_ip", target).alias("ip_address"),
        F.lit("Internal").alias("location"),
    )


def client_matches(logs: DataFrame, playbooks: DataFrame, users: DataFrame) -> DataFrame:
    """The browser-side variant: no guard rails; status actions name the user they would change."""
    pairs = match_rules(logs, playbooks, ["id", "user_name"], client_fields(logs))
    wanted = F.when(F.col("action_type") == "LOCK_USER", "LOCKED").when(F.col("action_type") == "QUARANTINE_USER", "QUARANTINED")
    found = users.select("user_name", F.col("id").alias("user_id"))
    return (
        pairs.select("id", "user_name", "playbook_id", "action_type", wanted.alias("new_status"))
        .join(found, "user_name", "left")
        .withColumn("user_id", F.when(F.col("new_status").isNotNull(), F.col("user_id")))
    )
