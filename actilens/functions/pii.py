"""Personal-data patterns, their redacted forms and whole-text rewriting as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns per type in detection order, and the field names checked by default.
PATTERNS: list[tuple[str, list[str]]] = [
    ("ssn", [r"\b\d{3}-\d{2}-\d{4}\b", r"\b\d{9}\b"]),
    ("credit_card", [r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b", r"\b\d{13,19}\b"]),
    ("email", [r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"]),
    ("phone", [r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", r"\b\(\d{3}\)\s*\d{3}[-.]?\d{4}\b", r"\b\+1\d{10}\b"]),
    ("password", [r'password["\s:=]+\S+', r'passwd["\s:=]+\S+', r'pwd["\s:=]+\S+']),
    (
        "api_key",
        [
            r"""api[_-]?key["\s:=]+["']?[\w-]{20,}["']?""",
            r"""token["\s:=]+["']?[\w-]{20,}["']?""",
            r"bearer[\s]+[\w.-]+",
        ],
    ),
    ("ip_address", [r"\b(?:\d{1,3}\.){3}\d{1,3}\b", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"]),
    ("mac_address", [r"\b([0-9A-Fa-f]{2}[:-]){5}([0-9A-Fa-f]{2})\b"]),
    ("account_number", [r"\b\d{8,17}\b"]),
]
#: What a text holds at least if a pattern of the type hits it. Each begins with one class of characters, so that a look for it
#: is much cheaper than the patterns; only ASCII letters have a case there.
NEEDED: dict[str, str] = {
    "ssn": "[0-9]{3}",
    "credit_card": "[0-9]{4}",
    "email": "@",
    "phone": "[0-9]{3}",
    "password": "[Ww](?<=[PpSs][Ww])(?:[Oo][Rr])?[Dd]",
    "api_key": "[BbKk][Ee](?:[YyNn]|[Aa][Rr][Ee][Rr])",
    "ip_address": "[.:](?<=[0-9A-Fa-f][.:])[0-9A-Fa-f]",
    "mac_address": "[:-](?<=[0-9A-Fa-f][:-])[0-9A-Fa-f]",
    "account_number": "[0-9]{8}",
}
#: The same for a hit of any type; a digit stands for all that need one.
NEEDED_BY_ANY = (
    "[0-9@:BbKkWw-](?:(?<=[0-9@])|(?<=[A-Fa-f][:-])[A-Fa-f]|(?<=[PpSs][Ww])(?:[Oo][Rr])?[Dd]"
    "|(?<=[Kk])[Ee][Yy]|(?<=[Tt][Oo][Kk])[Ee][Nn]|(?<=[Bb])[Ee][Aa][Rr][Ee][Rr])"
)
CHECK_FIELDS = ["description", "details", "content", "message", "user_input", "clipboard_content", "url", "command"]
SECRET_FIELD_PARTS = ["password", "key", "token"]
CONFIDENCE = 0.95


def is_checked_field(name: str, fields: Sequence[str] | None = None) -> bool:
    """Named in the list, ending in a listed name, or hinting at a secret."""
    lowered = name.lower()
    listed = any(lowered.endswith(f.lower()) for f in (CHECK_FIELDS if fields is None else fields))
    return listed or any(part in lowered for part in SECRET_FIELD_PARTS)


def short_hash(value: Column) -> Column:
    return F.concat(F.lit("[HASH:"), F.substring(F.sha2(value, 256), 1, 8), F.lit("]"))


def redacted(pii_type: str, value: Column) -> Column:
    """What a detected value of ``pii_type`` is replaced by."""
    if pii_type in ("ssn", "credit_card"):
        n = F.length(value)
        last = F.when(n >= 4, F.right(value, F.lit(4))).otherwise("")
        return F.concat(F.repeat(F.lit("*"), F.when(n >= 4, n - 4).otherwise(n)), last)
    if pii_type == "email":
        parts = F.split(value, "@")
        return F.when(
            (F.size(parts) == 2) & (F.length(parts[0]) > 1),
            F.concat(F.substring(parts[0], 1, 1), F.lit("***@"), parts[1]),
        ).otherwise("***@***")
    if pii_type == "phone":
        digits = F.regexp_replace(value, "[^0-9]", "")
        return F.when(
            F.length(digits) >= 4, F.concat(F.lit("***-***-"), F.right(digits, F.lit(4)))
        ).otherwise("***-***-****")
    if pii_type in ("password", "api_key"):
        return F.lit("[REDACTED]")
    if pii_type == "ip_address":
        parts = F.split(value, "\\.")
        return F.when(F.size(parts) >= 4, F.concat(parts[0], F.lit("."), parts[1], F.lit(".*.*"))).otherwise("*.*.*.*")
    if pii_type == "mac_address":
        parts = F.split(F.replace(value, F.lit("-"), F.lit(":")), ":")
        return F.when(
            F.size(parts) >= 6, F.concat(parts[0], F.lit(":"), parts[1], F.lit(":**:**:**:**"))
        ).otherwise("**:**:**:**:**:**")
    return short_hash(value)


def detections(text: Column) -> Column:
    """Array of (pii_type, original, redacted), in pattern order; overlapping hits all count.

    The patterns of a type run over the texts that hold what the type needs.
    """
    def describe(kind: str):
        return lambda v: F.struct(F.lit(kind).alias("pii_type"), v.alias("original"), redacted(kind, v).alias("redacted"))

    def where(needed: str, hits: list[Column]) -> Column:
        return F.when(~text.rlike(needed), EMPTY()).otherwise(F.concat(*hits))

    found = []
    for pii_type, patterns in PATTERNS:
        hits = [F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(0)) for pattern in patterns]
        found.append(where(NEEDED[pii_type], [F.transform(h, describe(pii_type)) for h in hits]))
    return where(NEEDED_BY_ANY, found)


def rewritten(text: Column, found: Column) -> Column:
    """``text`` with every detected value replaced, in detection order."""
    return F.aggregate(found, text, lambda acc, d: F.replace(acc, d["original"], d["redacted"]))


def detect(df: DataFrame, column: str, keep: Sequence[str] = ()) -> DataFrame:
    """Long table of detections in one text column."""
    return df.select(*keep, F.explode(detections(F.col(column))).alias("_d")).select(
        *keep, F.lit(column).alias("field_name"), "_d.pii_type", "_d.original", "_d.redacted",
        F.lit(CONFIDENCE).alias("confidence"),
    )


def _collect(field: T.DataType, value: Column, name: str, fields: Sequence[str] | None) -> Column | None:
    """Detections in a value of any shape, or None where nothing is checked."""
    if isinstance(field, T.StringType):
        return F.coalesce(detections(value), EMPTY()) if is_checked_field(name, fields) else None
    if isinstance(field, T.StructType):
        parts = [_collect(f.dataType, value[f.name], f.name, fields) for f in field.fields]
        parts = [F.when(value.isNotNull(), p).otherwise(EMPTY()) for p in parts if p is not None]
        return F.concat(*parts) if parts else None
    if isinstance(field, T.ArrayType) and isinstance(field.elementType, T.StructType):
        if _collect(field.elementType, value[0], name, fields) is None:
            return None
        inner = F.transform(value, lambda x: _collect(field.elementType, x, name, fields))
        return F.coalesce(F.flatten(inner), EMPTY())
    return None


def EMPTY() -> Column:
    return F.array().cast("array<struct<pii_type:string,original:string,redacted:string>>")


def _rewrite(field: T.DataType, value: Column, name: str, fields: Sequence[str] | None) -> Column:
    if isinstance(field, T.StringType):
        return rewritten(value, detections(value)) if is_checked_field(name, fields) else value
    if isinstance(field, T.StructType):
        inner = F.struct(*[_rewrite(f.dataType, value[f.name], f.name, fields).alias(f.name) for f in field.fields])
        return F.when(value.isNotNull(), inner)
    if isinstance(field, T.ArrayType) and isinstance(field.elementType, T.StructType):
        return F.transform(value, lambda x: _rewrite(field.elementType, x, name, fields))
    return value


def redact_rows(df: DataFrame, fields: Sequence[str] | None = None, enabled: bool = True) -> DataFrame:
    """Redact every checked text column, also inside structs and arrays of structs.

    Adds ``_pii_redacted``, ``_pii_count`` and the sorted ``_pii_types``. Plain strings inside
    arrays are left alone. ``enabled=False`` returns the input unchanged.
    """
    if not enabled:
        return df
    flat = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and is_checked_field(f.name, fields)]
    nested = [f for f in df.schema.fields if not isinstance(f.dataType, T.StringType)]
    # Patterns run once per flat column; both the rewrite and the counts read that array.
    work = df.withColumns({f"_found_{c}": F.coalesce(detections(F.col(c)), EMPTY()) for c in flat})
    arrays = [F.col(f"_found_{c}") for c in flat]
    for f in nested:
        extra = _collect(f.dataType, F.col(f.name), f.name, fields)
        if extra is not None:
            work = work.withColumn(f"_found_{f.name}", extra)
            arrays.append(F.col(f"_found_{f.name}"))
    if not arrays:
        return df.withColumns(
            {"_pii_redacted": F.lit(False), "_pii_count": F.lit(0), "_pii_types": F.array().cast("array<string>")}
        )
    everything = F.concat(*arrays)
    out = []
    for f in df.schema.fields:
        if f.name in flat:
            out.append(rewritten(F.col(f.name), F.col(f"_found_{f.name}")).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            out.append(F.col(f.name))
        else:
            out.append(_rewrite(f.dataType, F.col(f.name), f.name, fields).alias(f.name))
    return work.select(
        *out,
        (F.size(everything) > 0).alias("_pii_redacted"),
        F.size(everything).alias("_pii_count"),
        F.array_sort(F.array_distinct(F.transform(everything, lambda d: d["pii_type"]))).alias("_pii_types"),
    )
