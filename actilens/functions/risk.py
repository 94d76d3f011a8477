"""Risk-level expressions: labels, classes, scores, ranks and display bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Risk class, risk score and edge rank per level.
RISK_CLASS = {"LOW": 0, "INFO": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
RISK_SCORE = {"LOW": 1, "INFO": 1, "MEDIUM": 5, "HIGH": 8, "CRITICAL": 10}
EDGE_RANK = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}
SEVERE = ("HIGH", "CRITICAL")


def _lookup(level: Column, table: dict[str, int], default: int) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[level], F.lit(default))


def is_severe(level: Column) -> Column:
    return level.isin(*SEVERE)


def attack_label(level: Column) -> Column:
    return F.when(is_severe(level), 1).otherwise(0)


def anomaly_label(level: Column) -> Column:
    """-1 for classes from HIGH upwards, else 1."""
    return F.when(risk_class(level) >= 2, -1).otherwise(1)


def risk_class(level: Column) -> Column:
    return _lookup(level, RISK_CLASS, 0)


def risk_score(level: Column, ignore_case: bool = True) -> Column:
    return _lookup(F.upper(level) if ignore_case else level, RISK_SCORE, 1)


def edge_rank(level: Column) -> Column:
    return _lookup(level, EDGE_RANK, 0)


def assessment_band(score: Column) -> Column:
    return F.when(score >= 70, "MALICIOUS").when(score >= 30, "SUSPICIOUS").otherwise("BENIGN")


def assessment_confidence(score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score / 100.0))


def report_status(score: Column) -> Column:
    return F.when(score > 70, "CRITICAL").when(score > 30, "ELEVATED").otherwise("STABLE")


def severity_colour(value: Column, red: float, yellow: float | None = None) -> Column:
    """'red' above the upper bound, 'yellow' above the lower one, else 'normal'."""
    band = F.when(value > red, "red")
    if yellow is not None:
        band = band.when(value > yellow, "yellow")
    return band.otherwise("normal")
