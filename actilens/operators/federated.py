"""Federated aggregation: local vectors, privacy noise, round rules and secure averages."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from actilens.functions.risk import risk_score
from actilens.functions.timefns import expiry
from actilens.functions.vectors import add, gaussian_mask, gaussian_noise, l2_clip, with_laplace
from actilens.scale import running_totals
from actilens.session import cut_lineage

# Fallbacks of a local vector and the least number of logs it needs.
BAD_TIME_HOUR, BAD_TIME_DAY, MIN_LOCAL_LOGS = 12, 0, 10


@dataclass(frozen=True)
class Privacy:
    enabled: bool = True
    clip_norm: float = 10.0
    epsilon: float = 1.0
    sensitivity: float = 1.0

    @property
    def scale(self) -> float:
        return self.sensitivity / max(1e-6, self.epsilon)


def local_vectors(logs: DataFrame, agent: str = "user_name") -> DataFrame:
    """Mean hour, weekday and risk score per agent with at least ten logs."""
    known = F.col("ts").isNotNull()
    return (
        logs.groupBy(F.col(agent).alias("agent_id"))
        .agg(
            F.avg(F.when(known, F.hour("ts")).otherwise(BAD_TIME_HOUR)).alias("hour"),
            F.avg(F.when(known, F.weekday("ts")).otherwise(BAD_TIME_DAY)).alias("day"),
            F.avg(risk_score(F.col("risk_level"), ignore_case=False)).alias("risk_score"),
            F.count("*").alias("num_samples"),
        )
        .filter(F.col("num_samples") >= MIN_LOCAL_LOGS)
        .withColumn("feature_vector", F.array("hour", "day", "risk_score"))
    )


def privatised(vectors: DataFrame, privacy: Privacy, seed: int, column: str = "feature_vector") -> DataFrame:
    """Clip to the norm bound and add Laplace noise; with privacy off only the clipping stays."""
    clipped = l2_clip(F.col(column), privacy.clip_norm)
    noisy = with_laplace(clipped, F.col("agent_id"), privacy.scale, seed) if privacy.enabled else clipped
    return vectors.withColumn("dp_vector", noisy)


def masked_updates(vectors: DataFrame, round_id: str, privacy: Privacy, seed: int) -> DataFrame:
    """Update messages: privatised vector plus a random mask, with the mask kept for the reveal."""
    mask = gaussian_mask(F.col("dp_vector"), F.concat_ws("|", F.lit(round_id), "agent_id"), 1.0, seed + 1)
    return (
        privatised(vectors, privacy, seed)
        .withColumn("mask", mask)
        .select(
            F.lit(round_id).alias("round_id"), "agent_id", add(F.col("dp_vector"), F.col("mask")).alias("masked_update"),
            "mask", "num_samples", F.lit(privacy.epsilon if privacy.enabled else None).cast("double").alias("epsilon"),
        )
    )


def reveal_messages(updates: DataFrame) -> DataFrame:
    return updates.select("round_id", "agent_id", "mask")


def _dimension(messages: DataFrame, vector: str) -> Column:
    """Length of the vector; messages whose vector is no longer needed tell it in ``dim``."""
    return F.col("dim") if "dim" in messages.columns else F.size(vector)


def submission_verdicts(updates: DataFrame) -> DataFrame:
    """Accept or refuse each submission: expiry, one per agent and round, same dimension.

    A round opens with its first submission, which also fixes its dimension and limits. Only
    aggregates and joins are used, so a round with very many agents stays spread out.
    """
    order = F.struct("submitted_at", "message_id")
    sized = updates.withColumn("_dim", _dimension(updates, "masked_update"))
    first = sized.groupBy("round_id").agg(
        F.min("submitted_at").alias("opened_at"),
        F.min_by("_dim", order).alias("dimension"),
        F.greatest(F.lit(1), F.min_by("min_clients", order)).alias("round_min_clients"),
        F.min_by("timeout_seconds", order).alias("_timeout"),
    ).withColumn("expires_at", expiry(F.col("opened_at"), F.col("_timeout"))).drop("_timeout")
    placed = sized.join(first, "round_id")
    late = F.col("submitted_at") > F.col("expires_at")
    fits = F.col("_dim") == F.col("dimension")
    winners = placed.filter(~late & fits).groupBy("round_id", "agent_id").agg(F.min(order).alias("_won"))
    judged = placed.join(winners, ["round_id", "agent_id"], "left")
    verdict = (
        F.when(late, "round_expired")
        .when(F.col("_won") < order, "duplicate_agent_submission")
        .when(~fits, "dimension_mismatch")
        .otherwise("accepted")
    )
    return judged.withColumn("verdict", verdict).withColumn("accepted", F.col("verdict") == "accepted").drop("_won", "_dim")


def accepted_updates(updates: DataFrame) -> DataFrame:
    return submission_verdicts(updates).filter("accepted").withColumn(
        "weight", F.greatest(F.col("num_samples"), F.lit(1)).cast("double")
    )


def first_reveals(reveals: DataFrame) -> DataFrame:
    """The first reveal per (round, agent); later ones are refused as already revealed."""
    return reveals.groupBy("round_id", "agent_id").agg(F.min_by("mask", "revealed_at").alias("mask"))


ORDER = "struct<at:timestamp,m:string>"


def _reveal_id() -> Column:
    return F.concat(F.lit("reveal-"), "agent_id")


def _order(at: str, message: Column) -> Column:
    return F.struct(F.col(at).alias("at"), message.alias("m")).cast(ORDER)


def _placed(updates: DataFrame, reveals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Submissions and reveals on narrow rows, without vectors, in the order ``o`` of (time, message); judged once and stored."""
    kept = [
        "round_id", "agent_id", "message_id", "submitted_at", "dimension", "round_min_clients", "expires_at", "verdict", "num_samples", "epsilon",
    ]
    sent = cut_lineage(submission_verdicts(updates).select(*kept, _order("submitted_at", F.col("message_id")).alias("o")))
    shown = reveals.select(
        "round_id", "agent_id", _reveal_id().alias("message_id"), _dimension(reveals, "mask").alias("size"), "revealed_at", _order("revealed_at", _reveal_id()).alias("o"),
    )
    accepted = sent.filter("verdict = 'accepted'").select("round_id", "agent_id", "dimension", "round_min_clients", F.col("o").alias("sent_o"))
    return sent, shown.join(accepted, ["round_id", "agent_id"], "left")


def _closings(sent: DataFrame, shown: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``first``: when the mask of each agent was first revealed; ``closed``: when each round was complete.

    A round closes with the first reveal at which as many masks are shown as submissions are in, and enough of them. Both
    numbers are running totals over ranges of time, so a round of very many agents is many tasks.
    """
    valid = shown.filter((F.col("sent_o") < F.col("o")) & (F.col("size") == F.col("dimension")))
    first = valid.groupBy("round_id", "agent_id").agg(F.min("o").alias("first_o"), F.first("round_min_clients").alias("n"))
    step = lambda df, o, kind: df.select("round_id", F.struct(F.col(o).alias("o"), F.lit(kind).alias("k")).alias("at"), F.col("n"))
    subs = sent.filter("verdict = 'accepted'").withColumn("n", F.col("round_min_clients"))
    events = step(subs, "o", 0).unionByName(step(first, "first_o", 1)).groupBy("round_id", "at").agg(F.max("n").alias("n"), F.count("*").alias("rows"))
    events = events.withColumns({"shown": F.col("at.k") * F.col("rows"), "in": (1 - F.col("at.k")) * F.col("rows")})
    counted = running_totals(events, ["round_id"], "at", ["shown", "in"])
    full = (F.col("at.k") == 1) & (F.col("cum_shown") == F.col("cum_in")) & (F.col("cum_in") >= F.col("n"))
    return first.drop("n"), counted.filter(full).groupBy("round_id").agg(F.min("at.o").alias("closed_o"))


def _outcome(sent: DataFrame, shown: DataFrame) -> DataFrame:
    """Accepted submissions that came before their round closed, with the time ``first_o`` at which their mask was shown (null:
    not shown). Narrow rows, stored."""
    first, closed = _closings(sent, shown)
    accepted = sent.filter("verdict = 'accepted'").join(closed, "round_id", "left")
    accepted = accepted.filter(F.col("closed_o").isNull() | (F.col("o") < F.col("closed_o"))).drop("closed_o", "verdict")
    weight = F.greatest(F.col("num_samples"), F.lit(1)).cast("double")
    return cut_lineage(accepted.join(first, ["round_id", "agent_id"], "left").withColumn("weight", weight))


def _with_vectors(outcome: DataFrame, updates: DataFrame, reveals: DataFrame) -> DataFrame:
    """``outcome`` with the vector of each submission and its mask where it was shown: vectors meet the decisions once."""
    masks = reveals.select("round_id", "agent_id", "mask", _order("revealed_at", _reveal_id()).alias("first_o"))
    masks = masks.join(outcome.select("round_id", "agent_id", "first_o"), ["round_id", "agent_id", "first_o"], "left_semi")
    masks = masks.groupBy("round_id", "agent_id").agg(F.first("mask").alias("mask"))
    names = ["round_id", "agent_id", "message_id", "submitted_at"]
    sent = updates.select(*names, "masked_update").dropDuplicates(names)
    return outcome.join(sent, names).join(masks, ["round_id", "agent_id"], "left").drop("o", "first_o")


def message_verdicts(updates: DataFrame, reveals: DataFrame) -> DataFrame:
    """``round_id``, ``agent_id``, ``message_id``, ``kind``, ``verdict`` of every submission and reveal, as the round service
    answers them in order of time: what comes after a round has closed is refused."""
    return _answers(*_placed(updates, reveals)).select("round_id", "agent_id", "message_id", "kind", "verdict")


def _answers(sent: DataFrame, shown: DataFrame) -> DataFrame:
    """Verdicts with the time ``ts`` of the message; ``completes`` marks the reveal that closes its round."""
    first, closed = _closings(sent, shown)
    opened = sent.groupBy("round_id").agg(F.min("o").alias("opened_o"))
    after = F.col("closed_o").isNotNull() & (F.col("o") > F.col("closed_o"))
    names = ["round_id", "agent_id", "message_id", F.col("o.at").alias("ts")]
    told = sent.join(closed, "round_id", "left").select(
        *names, F.lit("update").alias("kind"), F.when(after, "round_already_finalized").otherwise(F.col("verdict")).alias("verdict"),
        F.lit(False).alias("completes"),
    )
    verdict = (
        F.when(F.col("opened_o").isNull() | (F.col("o") < F.col("opened_o")), "unknown_round")
        .when(after, "round_already_finalized")
        .when(F.col("sent_o").isNull() | (F.col("sent_o") > F.col("o")), "no_submission")
        .when(F.col("first_o") < F.col("o"), "mask_already_revealed")
        .when(F.col("size") != F.col("dimension"), "dimension_mismatch")
        .otherwise("revealed")
    )
    answered = shown.join(first, ["round_id", "agent_id"], "left").join(closed, "round_id", "left").join(opened, "round_id", "left")
    completes = F.coalesce((verdict == "revealed") & (F.col("o") == F.col("closed_o")), F.lit(False))
    return told.unionByName(answered.select(*names, F.lit("reveal").alias("kind"), verdict.alias("verdict"), completes.alias("completes")))


def round_results(updates: DataFrame, reveals: DataFrame, since: datetime) -> DataFrame:
    """``message_verdicts`` with ``ts`` and ``completes``, and the ``average`` of the round with the message that completes it, if
    that came at ``since`` or later. Messages of rounds that have closed before need no vectors, only ``dim``."""
    placed = _placed(updates, reveals)
    answers = cut_lineage(_answers(*placed))
    done = answers.where(F.col("completes") & (F.col("ts") >= F.lit(since))).select("round_id").distinct()
    mine = [df.join(done, "round_id", "left_semi") for df in (updates, reveals, *placed)]
    means = _means(_outcome(*mine[2:]), *mine[:2]).select("round_id", F.lit(True).alias("completes"), F.col("feature_vector").alias("average"))
    return answers.join(means, ["round_id", "completes"], "left")


def revealed_updates(updates: DataFrame, reveals: DataFrame) -> DataFrame:
    """Submissions accepted before their round closed, with their mask where it was revealed; reveals alone are refused."""
    return _with_vectors(_outcome(*_placed(updates, reveals)), updates, reveals)


def pending_reveals(updates: DataFrame, reveals: DataFrame) -> DataFrame:
    return accepted_updates(updates).select("round_id", "agent_id").join(
        first_reveals(reveals).select("round_id", "agent_id"), ["round_id", "agent_id"], "left_anti"
    )


def refused_reveals(updates: DataFrame, reveals: DataFrame) -> DataFrame:
    """Reveals of agents that have no accepted submission in that round."""
    return first_reveals(reveals).select("round_id", "agent_id").join(
        accepted_updates(updates).select("round_id", "agent_id"), ["round_id", "agent_id"], "left_anti"
    )


def round_status(updates: DataFrame, reveals: DataFrame) -> DataFrame:
    return _status(_outcome(*_placed(updates, reveals)))


def _status(outcome: DataFrame) -> DataFrame:
    ready = (F.col("submitted") >= F.col("min_clients")) & (F.col("revealed") == F.col("submitted")) & (F.col("submitted") > 0)
    return (
        outcome.groupBy("round_id")
        .agg(
            F.count("*").alias("submitted"),
            F.count("first_o").alias("revealed"),
            F.first("dimension").alias("dimension"),
            F.sum("num_samples").alias("total_samples"),
            F.avg("epsilon").alias("avg_epsilon"),
            F.first("round_min_clients").alias("min_clients"),
            F.first("expires_at").alias("expires_at"),
        )
        .withColumn("pending", F.greatest(F.lit(0), F.col("submitted") - F.col("revealed")))
        .withColumn("finalized", ready)
    )


def _means(outcome: DataFrame, updates: DataFrame, reveals: DataFrame) -> DataFrame:
    unmasked = _with_vectors(outcome, updates, reveals).filter(F.col("mask").isNotNull()).select(
        "round_id", "weight", array_to_vector(F.zip_with("masked_update", "mask", lambda u, m: u - m)).alias("v")
    )
    return unmasked.groupBy("round_id").agg(vector_to_array(Summarizer.mean(F.col("v"), F.col("weight"))).alias("feature_vector"))


def secure_average(updates: DataFrame, reveals: DataFrame, noise_sigma: float = 0.0, seed: int = 42) -> DataFrame:
    """Weighted mean of unmasked updates per finished round.

    The vector aggregate sums arrays inside each task, so only one vector per task and round is
    shuffled; nothing is exploded or gathered.
    """
    outcome = _outcome(*_placed(updates, reveals))
    out = _status(outcome).filter("finalized").join(_means(outcome, updates, reveals), "round_id")
    if noise_sigma > 0:
        noisy = F.transform("feature_vector", lambda x, i: x + gaussian_noise(F.col("round_id"), i, noise_sigma, seed))
        out = out.withColumn("feature_vector", noisy)
    return out.select(
        "round_id", F.col("submitted").alias("num_clients"), "total_samples", "avg_epsilon", "feature_vector"
    )


def plain_average(updates: DataFrame, column: str) -> DataFrame:
    """Sum over updates divided by the number of all updates, per key of a numeric map."""
    n = updates.agg(F.count("*")).scalar()
    sums = updates.select(F.explode(column).alias("key", "value")).groupBy("key").agg(F.sum("value").alias("_s"))
    return sums.withColumn("average", F.col("_s") / n).drop("_s")


def plain_vector_average(updates: DataFrame, column: str) -> DataFrame:
    """Element-wise average; updates without the vector still count in the divisor."""
    v = array_to_vector(F.col(column).cast("array<double>"))
    present = updates.filter(F.col(column).isNotNull())
    n = updates.agg(F.count("*")).scalar()
    total = present.agg(vector_to_array(Summarizer.sum(v)).alias("_s"))
    return total.withColumn("_n", n).select(F.transform("_s", lambda x: x / F.col("_n")).alias("average"))
