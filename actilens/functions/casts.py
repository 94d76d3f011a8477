"""Tolerant casts and defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_float(value: Column, default: float = 0.0) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default))


def safe_int(value: Column, default: int = 0) -> Column:
    """Whole number or the default; text with a decimal point is not a whole number."""
    return F.coalesce(value.try_cast("long"), F.lit(default).cast("long"))


def or_default(value: Column, default: str) -> Column:
    """Null and empty text count as missing."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def json_object(text: Column) -> Column:
    """The fields of a text that is one JSON object and nothing else, as text; null for any other text.

    The parser stops behind the first value, so the text is parsed inside a list and inside an object: what follows it
    then breaks one of the two.
    """
    strict = {"allowSingleQuotes": "false"}
    listed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", strict)
    held = F.from_json(F.concat(F.lit('{"d":'), text, F.lit("}")), "d map<string,string>", strict)["d"]
    return F.when(F.size(listed) == 1, held)
