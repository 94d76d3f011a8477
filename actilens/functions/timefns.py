"""Clock expressions: ISO text, hour/weekday, labels, quiet hours, cyclic encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, ISO_FORMAT)


def parse_time(text: Column, as_of: Column) -> Column:
    """ISO text to a timestamp; unreadable or missing text becomes ``as_of``."""
    return F.coalesce(F.try_to_timestamp(text), as_of)


def clock_label(ts: Column, seconds: bool = False) -> Column:
    """``H:MM`` or ``H:MM:SS``; the hour is not padded."""
    return F.concat(F.hour(ts).cast("string"), F.date_format(ts, ":mm:ss" if seconds else ":mm"))


def in_quiet_hours(ts: Column, start: str | None, end: str | None) -> Column:
    """Inclusive ``HH:MM`` interval that may cross midnight; a missing bound means never."""
    if not start or not end:
        return F.lit(False)
    now = F.date_format(ts, "HH:mm")
    if start < end:
        return now.between(start, end)
    return (now >= start) | (now <= end)


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = value * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def expiry(created: Column, timeout_seconds: Column) -> Column:
    """Creation time plus the timeout, which is at least 30 s."""
    seconds = F.greatest(timeout_seconds.cast("long"), F.lit(30).cast("long"))
    return F.timestamp_micros(F.unix_micros(created) + seconds * 1_000_000)


def retry_delay(retries: Column) -> Column:
    """Seconds until the next attempt after one more failure: 2^n capped at 2^8 and at 300."""
    attempt = F.greatest(retries, F.lit(0)) + 1
    return F.least(F.lit(300), F.pow(F.lit(2), F.least(attempt, F.lit(8))).cast("int"))
