"""Imports every query module so that the registry is complete."""

from actilens.plans import (  # noqa: F401
    extra_queries, model_queries, rule_queries, scan_queries, sequence_queries, stream_queries, text_queries,
    training_queries,
)
from actilens.plans.registry import oracles, spark_queries

__all__ = ["oracles", "spark_queries"]
