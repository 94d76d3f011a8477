"""Input-session statistics over JSON summaries of two shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actilens.functions.casts import json_object
from actilens.functions.text import key_name
from actilens.operators.scans import of_activity, time_range

UNKNOWN = "Unknown"


def _kind(value: Column) -> Column:
    """``n`` (number), ``b`` (boolean), ``t`` (text) or ``o`` (null, list, object) of a JSON value."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind == "STRING", "t").when(kind == "BOOLEAN", "b").when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "n").otherwise("o")
    )


def _number(value: Column) -> Column:
    """A JSON number, or 1 and 0 for a boolean; null for anything else."""
    kind = _kind(value)
    return F.when(kind == "n", F.try_variant_get(value, "$", "double")).when(kind == "b", F.try_variant_get(value, "$", "boolean").cast("double"))


def _text(value: Column) -> Column:
    return F.when(_kind(value) == "t", F.try_variant_get(value, "$", "string"))


def _whole(value: Column) -> Column:
    """A number without its fraction, or a text that is a whole number."""
    number, text = _number(value), _text(value)
    return F.coalesce((F.signum(number) * F.floor(F.abs(number))).cast("long"), F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(text).try_cast("long")))


def parsed_summaries(logs: DataFrame, column: str = "activity_summary") -> DataFrame:
    """Add shape, duration, keystrokes, app and key counts read from the summary.

    The newer shape has ``key_counts``; the older one is just a map of counts. Values keep their JSON types: only numbers
    and booleans are counts of the older shape, while the newer one also reads texts that are numbers. What cannot be read
    stays null: a bad duration also hides keystrokes and app, a bad old-shape value hides all.
    """
    # The fields go through a one-row explode: later filters then cannot copy the parsing into their conditions.
    doc = F.when(json_object(F.col(column)).isNotNull(), F.try_parse_json(F.col(column))).try_cast("map<string,variant>")
    has = lambda name: F.map_contains_key(F.col("_doc"), name)
    item = lambda name: F.col("_doc")[name]
    nought = F.lit(0).cast("long")
    newer, older = F.col("shape") == "new", F.col("shape") == "old"
    seconds = F.when(has("duration_seconds"), F.coalesce(_number(item("duration_seconds")), _text(item("duration_seconds")).try_cast("double"))).otherwise(0.0)
    strokes = F.when(has("total_keystrokes"), _whole(item("total_keystrokes"))).otherwise(nought)
    values = F.transform(F.map_values("_doc"), _number)
    readable = F.forall(values, lambda v: v.isNotNull())
    typed = lambda m: F.transform_values(m, lambda _, v: F.coalesce(_whole(v), nought))
    usable = F.col("_doc").isNotNull()
    return (
        logs.select("*", F.explode(F.array(F.struct(doc.alias("doc")))).alias("_j"))
        .withColumn("_doc", F.col("_j.doc"))
        .withColumn("shape", F.when(usable & has("key_counts"), "new").when(usable, "old"))
        .withColumn("_duration", F.when(newer, seconds))
        .withColumn("_total", F.when(newer & F.col("_duration").isNotNull(), strokes))
        .withColumns(
            {
                "duration": F.coalesce("_duration", F.lit(0.0)),
                "keystrokes": F.when(newer, F.coalesce("_total", nought))
                .when(older & readable, F.floor(F.aggregate(values, F.lit(0.0), lambda a, v: a + v)).cast("long"))
                .otherwise(nought),
                "app": F.when(
                    newer & F.col("_total").isNotNull(),
                    F.coalesce(F.nullif(F.try_variant_get(item("active_window"), "$", "string"), F.lit("")), F.lit(UNKNOWN)),
                ).when(older & readable, UNKNOWN),
                "key_counts": F.when(newer, typed(item("key_counts").try_cast("map<string,variant>"))).when(older & readable, typed(F.col("_doc"))),
            }
        )
        .drop("_j", "_doc", "_duration", "_total")
    )


def key_sessions(logs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    return parsed_summaries(time_range(of_activity(logs, "KEYLOG"), start, end))


def session_totals(sessions: DataFrame) -> DataFrame:
    return sessions.agg(
        F.count("*").alias("total_sessions"),
        F.coalesce(F.sum("duration"), F.lit(0.0)).alias("total_duration_seconds"),
        F.coalesce(F.sum("keystrokes"), F.lit(0)).alias("total_keystrokes"),
    )


def top_apps(sessions: DataFrame, n: int = 5) -> DataFrame:
    """Most used apps by sessions; 'Unknown' shows only when nothing else is known."""
    counts = sessions.groupBy("app").agg(F.count("app").alias("n")).filter(F.col("n") > 0)
    known = F.col("app") != UNKNOWN
    # Known apps sort first, so if there is one at all it is among the rows kept.
    kept = counts.orderBy(F.desc(known), F.desc("n"), F.asc("app")).limit(n)
    any_known = F.max(known).over(Window.partitionBy(F.lit(0)))
    return kept.withColumn("_k", any_known).filter(known | ~F.col("_k")).drop("_k").orderBy(F.desc("n"), F.asc("app"))


def key_totals(sessions: DataFrame) -> DataFrame:
    exploded = sessions.select(F.explode("key_counts").alias("key", "n"))
    return exploded.groupBy("key").agg(F.sum("n").alias("n"))


def heat_table(totals: DataFrame) -> DataFrame:
    """Normalised keys with intensity relative to the busiest key and a colour band."""
    merged = totals.groupBy(key_name(F.col("key")).alias("key")).agg(F.sum("n").alias("n"))
    peak = merged.agg(F.max("n")).scalar()
    intensity = F.when(F.col("n") == 0, 0.0).otherwise(F.least(F.col("n") / F.col("_peak"), F.lit(1.0)))
    return (
        merged.withColumn("_peak", peak)
        .withColumn("intensity", intensity)
        .withColumn(
            "band",
            F.when(F.col("n") == 0, "none").when(F.col("intensity") < 0.2, "low").when(F.col("intensity") < 0.5, "medium")
            .when(F.col("intensity") < 0.8, "high").otherwise("peak"),
        )
        .drop("_peak")
    )


def top_keys(totals: DataFrame, n: int = 10) -> DataFrame:
    merged = totals.groupBy(key_name(F.col("key")).alias("key")).agg(F.sum("n").alias("n"))
    return merged.orderBy(F.desc("n"), F.asc("key")).limit(n)


def flush_summaries(keystrokes: DataFrame, session: Sequence[str]) -> DataFrame:
    """Duration, count, count map and dominant window per session of raw key events.

    Events are counted per (session, key, window) before anything is gathered, so the gathered
    maps grow with the number of different keys only.
    """
    cells = keystrokes.groupBy(*session, "key", "window").agg(
        F.count("*").alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")
    )
    keys = cells.groupBy(*session, "key").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    totals = keys.groupBy(*session).agg(
        ((F.unix_micros(F.max("hi")) - F.unix_micros(F.min("lo"))) / 1_000_000).alias("duration_seconds"),
        F.sum("n").alias("total_keystrokes"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("key_counts"),
    )
    windows = cells.groupBy(*session, "window").agg(F.sum("n").alias("n"))
    dominant = windows.groupBy(*session).agg(F.min_by("window", F.struct(-F.col("n"), F.col("window"))).alias("active_window"))
    return totals.join(dominant, list(session))


def live_key_counts(logs: DataFrame) -> DataFrame:
    """(key, n) rows of each KEYLOG record, for running heat maps in batch or stream."""
    parsed = parsed_summaries(of_activity(logs, "KEYLOG"))
    return parsed.select(F.explode("key_counts").alias("raw", "n")).select(key_name(F.col("raw")).alias("key"), "n")
