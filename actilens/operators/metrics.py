"""Model evaluation as aggregates: confusion, reports, curves, calibration, latency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from actilens.scale import running_totals

# Acceptance limits of the digest, default recommendation.
F1_CLAIM, LATENCY_CLAIM_MS, RECOMMEND_BELOW_MS = 0.90, 500.0, 2000.0
CALIBRATION_BINS = 10


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def confusion_matrix(predictions: DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    """Counts over the sorted union of labels, zero-filled, per model."""
    keys = list(keys)
    cells = predictions.groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))
    labels = cells.select(*keys, F.explode(F.array("y_true", "y_pred")).alias("label")).distinct()
    rows, columns = labels.withColumnRenamed("label", "y_true"), labels.withColumnRenamed("label", "y_pred")
    grid = rows.join(columns, keys)
    return grid.join(cells, [*keys, "y_true", "y_pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def class_report(predictions: DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    keys = list(keys)
    cells = predictions.groupBy(*keys, "y_true", "y_pred").agg(F.count("*").alias("n"))
    sides = cells.select(
        *keys, "n", F.explode(
            F.array(
                F.struct(F.col("y_true").alias("label"), F.lit(True).alias("actual")),
                F.struct(F.col("y_pred").alias("label"), F.lit(False).alias("actual")),
            )
        ).alias("s"), (F.col("y_true") == F.col("y_pred")).alias("hit"),
    )
    actual = F.col("s.actual")
    per = sides.groupBy(*keys, F.col("s.label").alias("label")).agg(
        F.sum(F.when(actual & F.col("hit"), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(actual, F.col("n")).otherwise(0)).alias("support"),
        F.sum(F.when(~actual, F.col("n")).otherwise(0)).alias("predicted"),
    )
    precision, recall = _ratio(F.col("tp"), F.col("predicted")), _ratio(F.col("tp"), F.col("support"))
    return per.withColumns({"precision": precision, "recall": recall}).withColumn(
        "f1_score", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def averaged_report(predictions: DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    """Macro and support-weighted averages of the per-class report."""
    keys = list(keys)
    per = class_report(predictions, keys)
    names = ["precision", "recall", "f1_score"]
    both = per.groupBy(*keys).agg(
        F.sum("support").alias("support"),
        F.struct(*[F.avg(c).alias(c) for c in names]).alias("macro avg"),
        F.struct(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names]).alias("weighted avg"),
    )
    return both.unpivot([*keys, "support"], ["macro avg", "weighted avg"], "average", "v").select(
        *keys, "average", *[F.col(f"v.{c}").alias(c) for c in names], "support"
    )


def overall_report(predictions: DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    """Accuracy with weighted precision, recall and F1."""
    keys = list(keys)
    per = class_report(predictions, keys)
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    return per.groupBy(*keys).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        weighted("precision").alias("precision"), weighted("recall").alias("recall"), weighted("f1_score").alias("f1_score"),
    )


def binary_report(predictions: DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    """Accuracy, precision, recall and F1 for class 1."""
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    counts = predictions.groupBy(*keys).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"),
        F.count_if(F.col("y_true") == F.col("y_pred")).alias("ok"), F.count("*").alias("n"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        *keys, _ratio(F.col("ok"), F.col("n")).alias("accuracy"), _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def _score_steps(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct scores from high to low with positives and negatives, own and cumulative, and totals."""
    keys = list(keys)
    steps = predictions.groupBy(*keys, "score").agg(
        F.sum(F.when(F.col("y_true") == 1, 1).otherwise(0)).alias("pos"),
        F.sum(F.when(F.col("y_true") == 1, 0).otherwise(1)).alias("neg"),
    )
    cumulative = running_totals(steps, keys, "score", ["pos", "neg"], descending=True)
    totals = cumulative.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    if keys:
        return cumulative.join(totals, keys)
    return cumulative.withColumn("_t", totals.select(F.struct("P", "N")).scalar()).select("*", "_t.*").drop("_t")


def roc_auc(predictions: DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    """Exact area under the ROC curve by the rank sum; one-class input gives null and a reason."""
    steps = _score_steps(predictions, keys)
    # A positive beats every negative with a lower score and half of those with the same score.
    below = F.col("N") - F.col("cum_neg")
    wins = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    area = steps.groupBy(*keys).agg(wins.alias("_w"), F.first("P").alias("P"), F.first("N").alias("N"))
    one_class = (F.col("P") == 0) | (F.col("N") == 0)
    return area.select(
        *keys, F.when(~one_class, F.col("_w") / (F.col("P") * F.col("N"))).alias("roc_auc"),
        F.when(one_class, "Only one class present in y_true").alias("roc_auc_error"),
    )


def macro_auc(class_scores: DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    """One-versus-rest areas averaged over classes; rows are (keys, class, y_true in 0/1, score)."""
    per = roc_auc(class_scores, [*keys, "class"])
    broken = F.max("roc_auc_error")
    return per.groupBy(*keys).agg(
        F.when(broken.isNull(), F.avg("roc_auc")).alias("roc_auc"), broken.alias("roc_auc_error")
    )


def roc_points(predictions: DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, with the origin as a row without threshold."""
    steps = _score_steps(predictions, keys)
    points = steps.select(
        *keys, F.col("score").alias("threshold"), _ratio(F.col("cum_neg"), F.col("N")).alias("fpr"),
        _ratio(F.col("cum_pos"), F.col("P")).alias("tpr"),
    )
    origin = predictions.select(*keys).distinct().select(
        *keys, F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


def pr_points(predictions: DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    """(threshold, precision, recall) per distinct score."""
    steps = _score_steps(predictions, keys)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return steps.select(
        *keys, F.col("score").alias("threshold"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, F.col("P")).alias("recall")
    )


def pr_area(predictions: DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    """Trapezoid area under the precision-recall curve, starting at recall 0 and precision 1.

    The previous point of each step follows from its own counts, so no neighbour lookup is needed.
    """
    steps = _score_steps(predictions, keys)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    before = F.when(tp0 + fp0 == 0, 1.0).otherwise(tp0 / (tp0 + fp0))
    slab = F.col("pos") / F.col("P") * (tp / (tp + fp) + before) / 2
    return steps.groupBy(*keys).agg(F.sum(slab).alias("pr_auc"))


def calibration(predictions: DataFrame, keys: Sequence[str] = ("model_name",), bins: int = CALIBRATION_BINS) -> DataFrame:
    """Mean score and share of positives per equal-width bin; a bin includes its upper edge."""
    edges = F.array(*[F.lit(i * (1.0 / bins)) for i in range(1, bins)])
    number = F.size(F.filter(edges, lambda e: e < F.col("score")))
    return predictions.groupBy(*keys, number.alias("bin")).agg(
        F.avg("score").alias("mean_predicted"), F.avg(F.when(F.col("y_true") == 1, 1.0).otherwise(0.0)).alias("fraction_positive")
    )


def quantiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, for groups of any size.

    Values are counted, numbered through running totals, and the two ranks around each quantile
    are picked by conditional minima.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    ranked = running_totals(counts, keys, value, ["n"])
    totals = ranked.groupBy(*keys).agg(F.sum("n").alias("_n"))
    placed = ranked.join(totals, keys) if keys else ranked.withColumn("_n", ranked.agg(F.sum("n")).scalar())
    picks = []
    for name, q in points.items():
        position = F.lit(q) * (F.col("_n") - 1)
        picks.append(F.min(F.when(F.col("cum_n") > F.floor(position), F.col(value))).alias(f"_lo_{name}"))
        picks.append(F.min(F.when(F.col("cum_n") > F.ceil(position), F.col(value))).alias(f"_hi_{name}"))
        picks.append(F.first(position - F.floor(position)).alias(f"_f_{name}"))
    edges = placed.groupBy(*keys).agg(*picks)
    mixed = [
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n) for n in points
    ]
    return edges.select(*keys, *mixed)


def latency_percentiles(samples: DataFrame, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    marks = quantiles(samples, keys, "latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    means = samples.groupBy(*keys).agg(F.avg("latency_ms").alias("mean"))
    return marks.join(means, list(keys))


def throughput(samples: DataFrame, seconds: float, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    return samples.groupBy(*keys).agg((F.count("*") / F.lit(seconds)).alias("rows_per_second"))


def latency_summary(samples: DataFrame, ok: Column, keys: Sequence[str] = ("model_name",)) -> DataFrame:
    good = F.when(ok, F.col("latency_ms"))
    return samples.groupBy(*keys).agg(
        F.avg(good).alias("avg_latency_ms"), F.min(good).alias("min_latency_ms"), F.max(good).alias("max_latency_ms"),
        F.count(good).alias("successful"),
    )


def recommended_model(summary: DataFrame, default: str, below_ms: float = RECOMMEND_BELOW_MS) -> DataFrame:
    """Fastest model on average under the bound, else the default; always one row."""
    best = F.min_by("model_name", F.struct("avg_latency_ms", "model_name"))
    return summary.filter(F.col("avg_latency_ms") < below_ms).agg(F.coalesce(best, F.lit(default)).alias("model_name"))


def error_distribution(errors: DataFrame, width: float) -> DataFrame:
    """Fixed-width histogram of reconstruction errors per label."""
    return errors.groupBy("label", F.floor(F.col("error") / F.lit(width)).alias("bin")).agg(F.count("*").alias("n"))


def class_counts(labelled: DataFrame, label: str = "label") -> DataFrame:
    """Rows per class with their share in percent."""
    counts = labelled.groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("share_percent", 100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def ranked_importance(importances: DataFrame) -> DataFrame:
    return importances.orderBy(F.desc("importance"), F.asc("feature"))


def metric_digest(reports: DataFrame) -> DataFrame:
    """The key figures per model as (model, metric, value) rows."""
    names = ["accuracy", "precision", "recall", "f1_score", "roc_auc"]
    return reports.unpivot(["model_name"], names, "metric", "value")


def claim_check(reports: DataFrame, latency: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """F1 of the first available preferred model, and its median latency, against the limits."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in preferred]), F.col("model_name")), F.lit(0))
    chosen = reports.filter(rank > 0).agg(F.min_by(F.struct("model_name", "f1_score"), rank).alias("b")).select("b.*")
    return chosen.join(latency.select("model_name", "p50"), "model_name").select(
        "model_name", "f1_score", (F.col("f1_score") >= F1_CLAIM).alias("f1_passed"), "p50",
        (F.col("p50") < LATENCY_CLAIM_MS).alias("latency_passed"),
    )


def hybrid_vote(votes: DataFrame) -> DataFrame:
    """Two-of-three vote of forest, auto-encoder and classifier, and the two-model AND form."""
    forest, coder = F.when(F.col("if_pred") == -1, 1).otherwise(0), F.when(F.col("ae_pred") == -1, 1).otherwise(0)
    return votes.withColumns(
        {
            "hybrid": F.when(forest + coder + F.col("rf_pred") >= 2, 1).otherwise(0),
            "both_unsupervised": F.when(forest + coder == 2, 1).otherwise(0),
        }
    )
