"""Streams through the batch operators: rows wait for the clock, and what it has passed is worked on as a table.

A micro-batch is put beside the rows that wait. The clock is the latest time seen less the lateness; rows behind it are
closed, since nothing earlier is accepted any more. Closed rows and the few that were *carried* over go through the batch
operator, which cuts a hot key into many tasks, and the results of the closed rows come out. No key has a state of its own,
so no task holds one: waiting and carried rows are tables in the shared folder.

What a batch leaves is written to folders with its number, overwriting what an earlier attempt left, so a batch that runs again
after a failure gives the same rows once. A batch reads only what the one before it has left; older folders are removed.
Rows without a time have no place in the order and are dropped; rows behind the clock are dropped and counted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from actilens.operators import devices, federated, markov, rules
from actilens.session import cut_lineage

NEVER, ALWAYS = datetime(1970, 1, 1), datetime(9999, 1, 1)


@dataclass(frozen=True)
class Step:
    """``run``: (rows, since) to results; ``carry``: (rows, results, clock) to the rows on which later ones depend; ``fresh``:
    (results, since, clock) to those that were not given before and are due."""

    run: Callable[[DataFrame, datetime], DataFrame]
    carry: Callable[[DataFrame, DataFrame, datetime], DataFrame]
    fresh: Callable[[DataFrame, datetime, datetime], DataFrame] = lambda results, since, clock: results.where(F.col("ts") >= F.lit(since))


class Ordered:
    """A ``foreachBatch`` body that runs a step over the stream's rows in the order of their time column ``ts``."""

    def __init__(self, spark: SparkSession, schema, step: Step, folder: str, lateness: timedelta):
        self.spark, self.schema, self.step, self.folder, self.lateness = spark, schema, step, folder, lateness

    def _path(self, kind: str, number: int) -> str:
        return f"{self.folder}/{kind}/part={number}"

    def _left(self, kind: str, number: int) -> DataFrame:
        if number < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._path(kind, number))

    def _clock(self, number: int) -> tuple[datetime, int]:
        return self.spark.read.parquet(self._path("clock", number)).select("clock", "late").first() if number >= 0 else (NEVER, 0)

    def _remove(self, number: int) -> None:
        for kind in ("waiting", "carried", "clock") if number >= 0 else ():
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(kind, number))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch = batch.where(F.col("ts").isNotNull()).persist()
        since, late = self._clock(number - 1)
        newest, behind = batch.agg(F.max("ts"), F.count_if(F.col("ts") < F.lit(since))).first()
        clock = max(since, max(newest, NEVER + self.lateness) - self.lateness) if newest else since
        self._close(batch.where(F.col("ts") >= F.lit(since)), number, since, clock, late + behind)
        batch.unpersist()

    def finish(self, number: int) -> None:
        """The stream has ended: all that waits is closed."""
        since, late = self._clock(number - 1)
        self._close(self.spark.createDataFrame([], self.schema), number, since, ALWAYS, late)

    def _close(self, fresh: DataFrame, number: int, since: datetime, clock: datetime, late: int) -> None:
        there = fresh.unionByName(self._left("waiting", number - 1))
        passed = F.col("ts") < F.lit(clock)
        there.where(~passed).write.mode("overwrite").parquet(self._path("waiting", number))
        state = self.spark.createDataFrame([(clock, late)], "clock timestamp, late long")
        state.coalesce(1).write.mode("overwrite").parquet(self._path("clock", number))
        if clock == since:  # the clock stands still, nothing is closed
            self._left("carried", number - 1).write.mode("overwrite").parquet(self._path("carried", number))
            self._remove(number - 2)
            return
        rows = there.where(passed).unionByName(self._left("carried", number - 1))
        results = cut_lineage(self.step.run(rows, since))
        self.step.fresh(results, since, clock).write.mode("overwrite").parquet(self._path("out", number))
        self.step.carry(rows, results, clock).select(self.schema.names).write.mode("overwrite").parquet(self._path("carried", number))
        self._remove(number - 2)


def replay(stream: DataFrame, step: Step, folder: str, lateness: timedelta) -> DataFrame:
    """Run a step over a finite stream to its end, and read the results."""
    spark, last = stream.sparkSession, [-1]
    sink = Ordered(spark, stream.schema, step, folder, lateness)

    def write(batch: DataFrame, number: int) -> None:
        sink(batch, number)
        last[0] = number

    query = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").foreachBatch(write).start()
    query.awaitTermination()
    sink.finish(last[0] + 1)
    return spark.read.option("mergeSchema", "true").parquet(f"{folder}/out/part=*")


def late_rows(spark: SparkSession, folder: str) -> int:
    """Rows that came behind the clock, up to the last batch."""
    return spark.read.parquet(f"{folder}/clock/part=*").agg(F.max("late")).first()[0]


# --- steps -------------------------------------------------------------------------------------


def limiter(keys: Sequence[str], limit: Column, window_seconds: Column, order: Sequence[str] = ("ts", "id"), **how) -> Step:
    """Rows with ``allowed``. Carried: the admitted rows of the last window, which are all admitted again when the next rows
    come behind them."""
    ends = F.timestamp_micros(F.unix_micros("ts") + F.greatest(F.coalesce(window_seconds, F.lit(1)).cast("long"), F.lit(1).cast("long")) * 1_000_000)
    return Step(
        run=lambda rows, since: rules.rate_limit(rows, keys, limit, window_seconds, order, **how),
        carry=lambda rows, results, clock: results.where(F.col("allowed") & (ends > F.lit(clock))),
    )


def _last_rows(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    last = F.max_by(F.struct("*"), F.struct(*order)).alias("r")
    return rows.groupBy(F.col(key).alias("_key")).agg(last).select("r.*")


def clipboard(key: str = "user_name") -> Step:
    """Clipboard changes. Carried: the last reading of each key."""
    return Step(
        run=lambda rows, since: devices.clipboard_changes(rows, [key]),
        carry=lambda rows, results, clock: _last_rows(rows.where("content is not null"), key, ["ts", "seq"]),
    )


def transitions() -> Step:
    """(activity, next activity) pairs. Carried: the last step of each user, which has no next one yet."""
    return Step(
        run=lambda rows, since: markov.next_activities(rows),
        carry=lambda rows, results, clock: results.where("next_activity is null"),
        fresh=lambda results, since, clock: results.where("next_activity is not null"),
    )


def inactivity(key: str = "user_name", limit_minutes: int = 120) -> Step:
    """Warnings and limit events (``kind``, ``at``) of the gaps of each key. An open gap is told when the clock has passed the
    event. Carried: the last row of a key while its limit lies ahead of the clock."""
    limit = limit_minutes * 60
    later = lambda seconds: F.timestamp_micros(F.unix_micros("ts") + seconds * 1_000_000)

    def run(rows: DataFrame, since: datetime) -> DataFrame:
        gaps = devices.inactivity(rows.select("id", "ts", key), [key], limit_minutes)
        event = lambda kind, told, seconds: F.struct(
            F.lit(kind).alias("kind"), later(seconds).alias("at"), (F.col(told) | F.isnull("gap_seconds")).alias("told")
        )
        events = F.array(event("warning", "warned", max(limit - 300, 0)), event("limit", "limit_reached", limit))
        return gaps.select(key, F.inline(events)).where("told").drop("told")

    return Step(
        run=run,
        carry=lambda rows, results, clock: _last_rows(rows, key, ["ts"]).where(later(limit) >= F.lit(clock)),
        fresh=lambda results, since, clock: results.where((F.col("at") >= F.lit(since)) & (F.col("at") < F.lit(clock))),
    )


def round_messages(updates: DataFrame, reveals: DataFrame) -> DataFrame:
    """Submissions and reveals as one stream."""
    sent = updates.select(
        F.col("submitted_at").alias("ts"), F.lit("update").alias("kind"), "round_id", "agent_id", "message_id", F.col("masked_update").alias("vector"),
        F.size("masked_update").alias("dim"), F.col("num_samples").cast("long").alias("num_samples"), F.col("epsilon").cast("double").alias("epsilon"),
        F.col("min_clients").cast("int").alias("min_clients"), F.col("timeout_seconds").cast("long").alias("timeout_seconds"),
    )
    shown = reveals.select(
        F.col("revealed_at").alias("ts"), F.lit("reveal").alias("kind"), "round_id", "agent_id", F.lit(None).cast("string").alias("message_id"),
        F.col("mask").alias("vector"), F.size("mask").alias("dim"), F.lit(None).cast("long").alias("num_samples"), F.lit(None).cast("double").alias("epsilon"),
        F.lit(None).cast("int").alias("min_clients"), F.lit(None).cast("long").alias("timeout_seconds"),
    )
    return sent.unionByName(shown)


def rounds() -> Step:
    """A verdict for each message of ``round_messages``, and the average with the reveal that completes a round. Carried: the
    messages of all rounds, without their vectors once a round has closed."""

    def run(rows: DataFrame, since: datetime) -> DataFrame:
        sent = rows.where("kind = 'update'").withColumnsRenamed({"ts": "submitted_at", "vector": "masked_update"})
        shown = rows.where("kind = 'reveal'").select("round_id", "agent_id", F.col("ts").alias("revealed_at"), F.col("vector").alias("mask"), "dim")
        return federated.round_results(sent, shown, since)

    def carry(rows: DataFrame, results: DataFrame, clock: datetime) -> DataFrame:
        closed = results.where("completes").select("round_id", F.lit(True).alias("closed")).distinct()
        return rows.join(closed, "round_id", "left").withColumn("vector", F.when(F.col("closed").isNull(), F.col("vector")))

    return Step(run=run, carry=carry)
