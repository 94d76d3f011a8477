"""String expressions: sanitising, truncation, tags, key names, alert text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Control characters, redacted phrases, allowed actions, assessment levels.
CONTROL_CHARACTERS = r"[\x00-\x08\x0B\x0C\x0E-\x1F]"
INSTRUCTION_PHRASES = [
    "ignore previous instructions", "system prompt", "developer message", "act as", "jailbreak",
]
REDACTED_INSTRUCTION = "[redacted-instruction]"
ALLOWED_ACTIONS = ["isolate_host", "block_ip", "reset_password", "investigate_process_tree", "collect_forensics"]
ASSESSMENT_LEVELS = ["BENIGN", "SUSPICIOUS", "MALICIOUS"]
# What Python's str.strip() removes from ASCII text.
WHITESPACE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def contains_any(text: Column, terms: list[str]) -> Column:
    """True when any term occurs in ``text`` (both lower case already)."""
    out = F.lit(False)
    for term in terms:
        out = out | text.contains(term)
    return out


def truncate(text: Column, max_length: int = 1500) -> Column:
    return F.when(
        F.length(text) > max_length, F.concat(F.substring(text, 1, max_length - 3), F.lit("..."))
    ).otherwise(text)


def drop_control(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_CHARACTERS, " ")


def sanitize(text: Column, max_length: int = 1500) -> Column:
    """Blank control characters, replace instruction phrases, trim and truncate.

    A text in which a phrase was replaced comes back in lower case.
    """
    cleaned = drop_control(F.coalesce(text, F.lit("")))
    lowered = F.lower(cleaned)
    replaced = lowered
    for phrase in INSTRUCTION_PHRASES:
        replaced = F.replace(replaced, F.lit(phrase), F.lit(REDACTED_INSTRUCTION))
    return truncate(strip(F.when(replaced != lowered, replaced).otherwise(cleaned)), max_length)


def sanitize_items(items: Column, max_items: int = 10) -> Column:
    """First ``max_items`` maps of a list, with keys and values sanitised."""
    kept = F.slice(items, 1, max_items)
    clean = lambda m: F.map_from_entries(
        F.transform(
            F.map_entries(m),
            lambda e: F.struct(sanitize(e["key"], 64).alias("key"), sanitize(e["value"]).alias("value")),
        )
    )
    return F.transform(kept, clean)


def normalize_actions(actions: Column) -> Column:
    named = F.transform(actions, lambda a: F.replace(F.lower(strip(a)), F.lit(" "), F.lit("_")))
    return F.filter(named, lambda a: a.isin(ALLOWED_ACTIONS))


def assessment_error(level: Column, threat: Column, confidence: Column, reasoning: Column) -> Column:
    """First broken rule of an assessment, null when it is valid."""
    return (
        F.when(level.isNull() | ~level.isin(ASSESSMENT_LEVELS), "risk_level")
        .when(threat.isNull() | ~F.length(threat).between(1, 120), "threat_type")
        .when(confidence.isNull() | ~confidence.between(0.0, 1.0), "confidence")
        .when(reasoning.isNull() | ~F.length(reasoning).between(1, 1500), "reasoning")
    )


def key_name(raw: Column) -> Column:
    """Trimmed, without a leading ``key.``, in upper case."""
    return F.upper(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), "^(?i)key\\.", ""))


def token_count(text: Column) -> Column:
    """Number of whitespace-separated words, 0 for null or blank text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("\\S+"))


def alert_text(level: Column, activity: Column, description: Column) -> Column:
    show = lambda c: F.coalesce(c, F.lit("None"))
    return F.concat(F.lit("["), show(level), F.lit("] "), show(activity), F.lit(": "), show(description))


def alert_colour(level: Column) -> Column:
    return F.when(level == "CRITICAL", "#ff0000").otherwise("#ffcc00")
