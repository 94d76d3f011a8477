"""Next-step prediction from activity sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from actilens.functions.risk import is_severe
from actilens.scale import broadcast_if_small, time_chunk, with_neighbour

REASON = "Based on historical frequency"
HOUR = 3_600


def next_activities(logs: DataFrame, chunk_seconds: int = HOUR) -> DataFrame:
    """Each activity with the user's next one; rows without an activity are dropped first."""
    steps = logs.filter(F.col("activity_type").isNotNull() & (F.col("activity_type") != "")).select(
        "user_name", "ts", "id", "activity_type"
    )
    chained = with_neighbour(
        steps, ["user_name"], ["ts", "id"], ["activity_type"], time_chunk("ts", chunk_seconds), True, "nxt"
    )
    return chained.withColumn("next_activity", F.col("nxt.activity_type")).drop("nxt")


def transitions(logs: DataFrame, chunk_seconds: int = HOUR) -> DataFrame:
    """Counts of (current, next) activity pairs over all users."""
    return (
        next_activities(logs, chunk_seconds)
        .filter(F.col("next_activity").isNotNull())
        .groupBy("activity_type", "next_activity")
        .agg(F.count("*").alias("n"))
    )


def predictions(counts: DataFrame, top: int | None = 3) -> DataFrame:
    """Most likely next activities per current one, ties by name."""
    current = Window.partitionBy("activity_type")
    scored = counts.withColumn("probability", F.col("n") / F.sum("n").over(current))
    ranked = scored.withColumn(
        "rank", F.row_number().over(current.orderBy(F.desc("probability"), F.asc("next_activity")))
    )
    kept = ranked if top is None else ranked.filter(F.col("rank") <= top)
    return kept.select("activity_type", "next_activity", "probability", "rank", F.lit(REASON).alias("reason"))


def predict_next(counts: DataFrame, activity: str, top: int = 3) -> DataFrame:
    """Predictions for one activity; an unknown activity gives no rows."""
    return predictions(counts.filter(F.col("activity_type") == activity), top)


def severe_log_predictions(logs: DataFrame, counts: DataFrame) -> DataFrame:
    """Predictions for the HIGH and CRITICAL logs only."""
    severe = logs.filter(is_severe(F.col("risk_level"))).select("id", "activity_type")
    return severe.join(broadcast_if_small(predictions(counts)), "activity_type")
