"""Feature frame, label encoding, standardising, splits and class balancing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actilens.functions.risk import is_severe, risk_score
from actilens.functions.text import token_count
from actilens.functions.timefns import cyclic
from actilens.scale import dictionary_join, running_totals

# Scaled and encoded features, in model order.
SCALED = [
    "hour", "day_of_week", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "description_length", "description_token_count",
]
ENCODED = {"user_encoded": "user_name", "activity_type_encoded": "activity_type"}
FEATURES = [*SCALED, *ENCODED]


def raw_features(logs: DataFrame, as_of: str) -> DataFrame:
    """The numeric features before scaling; missing times become ``as_of``, missing text is empty."""
    ts = F.coalesce("ts", F.lit(as_of).cast("timestamp"))
    base = logs if "description" in logs.columns else logs.withColumn("description", F.lit(""))
    text = F.coalesce("description", F.lit(""))
    timed = base.withColumns({"hour": F.hour(ts), "day_of_week": F.weekday(ts)})
    hs, hc = cyclic(F.col("hour"), 24)
    ds, dc = cyclic(F.col("day_of_week"), 7)
    return timed.withColumns(
        {
            "hour_sin": hs, "hour_cos": hc, "dow_sin": ds, "dow_cos": dc,
            "description_length": F.length(text).cast("double"),
            "description_token_count": token_count(text).cast("double"),
        }
    )


def fit_encoder(df: DataFrame, column: str) -> DataFrame:
    """(value, code): codes 0.. in sorted value order, null counted as 'unknown'.

    Codes come from running totals over ranges of values, so a dictionary with millions of users is
    numbered in many tasks.
    """
    values = df.select(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).distinct()
    numbered = running_totals(values.withColumn("one", F.lit(1).cast("long")), [], "value", ["one"])
    return numbered.select("value", (F.col("cum_one") - 1).alias("code"))


def encode(df: DataFrame, encoder: DataFrame, column: str, output: str) -> DataFrame:
    """Look codes up; unseen values get 0."""
    key = F.coalesce(F.col(column).cast("string"), F.lit("unknown"))
    table = encoder.select(F.col("value").alias("_v"), F.col("code").alias("_code"))
    return dictionary_join(df.withColumn("_v", key), table, "_v").withColumn(output, F.coalesce("_code", F.lit(0))).drop("_v", "_code")


def fit_scaler(df: DataFrame, columns: Sequence[str] = tuple(SCALED)) -> DataFrame:
    """One row with mean and population standard deviation per column; zero deviation becomes 1."""
    stats = []
    for c in columns:
        deviation = F.stddev_pop(c)
        stats += [F.avg(c).alias(f"{c}_mean"), F.when(deviation == 0, 1.0).otherwise(deviation).alias(f"{c}_std")]
    return df.agg(*stats)


def scale(df: DataFrame, scaler: DataFrame, columns: Sequence[str] = tuple(SCALED)) -> DataFrame:
    packed = scaler.select(F.struct("*").alias("s")).scalar()
    return (
        df.withColumn("_s", packed)
        .withColumns({c: (F.col(c) - F.col(f"_s.{c}_mean")) / F.col(f"_s.{c}_std") for c in columns})
        .drop("_s")
    )


@dataclass
class FittedFeatures:
    """Tables learned from a training set; missing ones mean 'not fitted'."""

    encoders: dict[str, DataFrame]
    scaler: DataFrame
    as_of: str

    def transform(self, logs: DataFrame) -> DataFrame:
        return self.transform_raw(raw_features(logs, self.as_of))

    def transform_raw(self, raw: DataFrame) -> DataFrame:
        """The same for rows that already went through :func:`raw_features`."""
        out = scale(raw, self.scaler)
        for output, column in ENCODED.items():
            out = encode(out, self.encoders[column], column, output)
        return out

    def save(self, folder: str) -> None:
        for column, table in self.encoders.items():
            table.write.mode("overwrite").parquet(f"{folder}/encoder_{column}")
        self.scaler.withColumn("as_of", F.lit(self.as_of)).write.mode("overwrite").parquet(f"{folder}/scaler")
        rows = [(i, name) for i, name in enumerate(FEATURES)]
        self.scaler.sparkSession.createDataFrame(rows, "position int, feature string").write.mode("overwrite").parquet(
            f"{folder}/feature_columns"
        )

    def described(self) -> DataFrame:
        """``feature``, ``mean`` and ``std`` of a scaled one, number of ``codes`` of an encoded one."""
        scaled = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"{c}_mean").alias("mean"), F.col(f"{c}_std").alias("std")) for c in SCALED])
        out = self.scaler.select(F.inline(scaled)).withColumn("codes", F.lit(None).cast("long"))
        for feature, column in ENCODED.items():
            codes = self.encoders[column].agg(F.count("*").alias("codes"))
            none = F.lit(None).cast("double")
            out = out.unionByName(codes.select(F.lit(feature).alias("feature"), none.alias("mean"), none.alias("std"), "codes"))
        return out

    @staticmethod
    def load(spark, folder: str) -> FittedFeatures | None:
        """The saved tables, or None when any is missing."""
        from pyspark.errors import AnalysisException

        try:
            encoders = {c: spark.read.parquet(f"{folder}/encoder_{c}") for c in ENCODED.values()}
            scaler = spark.read.parquet(f"{folder}/scaler")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        as_of = scaler.first()["as_of"]
        return FittedFeatures(encoders, scaler.drop("as_of"), as_of)


def fit_features(logs: DataFrame, as_of: str) -> FittedFeatures:
    return fit_raw(raw_features(logs, as_of), as_of)


def fit_raw(raw: DataFrame, as_of: str) -> FittedFeatures:
    """Fit on rows with raw features. Store that narrow frame first when the texts are long: it is
    read once per encoder, once for the scaler and once more for the transformation."""
    encoders = {column: fit_encoder(raw, column) for column in ENCODED.values()}
    return FittedFeatures(encoders, fit_scaler(raw), as_of)


def legacy_features(logs: DataFrame, as_of: str) -> DataFrame:
    """The three-value vector: hour, weekday, risk score."""
    ts = F.coalesce("ts", F.lit(as_of).cast("timestamp"))
    return logs.withColumn(
        "features",
        F.array(F.hour(ts).cast("double"), F.weekday(ts).cast("double"), risk_score(F.coalesce("risk_level", F.lit("INFO"))).cast("double")),
    )


def legacy_explanations(logs: DataFrame, as_of: str) -> DataFrame:
    """Severe logs with their raw three features as (log, feature, contribution) rows."""
    names = ["hour", "day", "risk_score"]
    vector = legacy_features(logs.filter(is_severe(F.col("risk_level"))), as_of)
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col("features")[i].alias("contribution")) for i, n in enumerate(names)])
    return vector.select(F.col("id").alias("log_id"), F.explode(pairs).alias("p")).select("log_id", "p.*")


def _hash_rank(df: DataFrame, keys: Sequence[str], identity: Column) -> DataFrame:
    """Add ``_rank``: 1-based position by hash within keys, computed per (keys, hash bucket)."""
    keys = list(keys)
    # The top 12 bits of an evenly spread 60-bit hash give buckets of even size for classes of any size.
    hashed = df.withColumn("_h", identity).withColumn("_b", F.shiftrightunsigned("_h", 48))
    sizes = hashed.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", "id")
    return (
        hashed.join(offsets, [*keys, "_b"]).withColumn("_rank", F.row_number().over(inside) + F.col("_o")).drop("_b", "_o", "_h")
    )


def seeded_hash(seed: int, column: str = "id") -> Column:
    """A 60-bit hash that other engines can compute too."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(column)), 256), 1, 15), 16, 10).cast("long")


def stratified_split(df: DataFrame, label: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``is_validation``; the share is exact per class and clamped to [0.1, 0.4]."""
    share = max(0.1, min(fraction, 0.4))
    ranked = _hash_rank(df, [label], seeded_hash(seed))
    sizes = df.groupBy(label).agg(F.count("*").alias("_size"))
    quota = F.round(F.lit(share) * F.col("_size"))
    return ranked.join(sizes, label).withColumn("is_validation", F.col("_rank") <= quota).drop("_rank", "_size")


class TooFewRows(ValueError):
    """The training table is too small to balance."""


def balanced_training_set(logs: DataFrame, max_attacks: int = 2000, ratio: int = 3, seed: int = 42, least: int = 100) -> DataFrame:
    """At most ``max_attacks`` severe logs and ``ratio`` times as many calm ones, chosen by hash.

    Each class is a bounded top-k by hash, which Spark trims in every map task. MEDIUM is left out.
    """
    if logs.limit(least).count() < least:
        raise TooFewRows(f"fewer than {least} logs")
    level = F.col("risk_level")
    order = [seeded_hash(seed), F.col("id")]
    attacks = logs.filter(is_severe(level)).orderBy(*order).limit(max_attacks).withColumn("label", F.lit(1))
    n_attacks = logs.filter(is_severe(level)).limit(max_attacks).count()
    normals = logs.filter(level.isin("INFO", "LOW")).orderBy(*order).limit(n_attacks * ratio).withColumn("label", F.lit(0))
    return normals.unionByName(attacks)
