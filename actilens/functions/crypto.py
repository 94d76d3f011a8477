"""Field encryption at rest: base64 of nonce, ciphertext and tag (AES-256-GCM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "[ENCRYPTED] "


def encrypt(text: Column, key: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.base64(F.aes_encrypt(text, key, F.lit("GCM"))))


def decrypt(text: Column, key: Column) -> Column:
    """The clear text, or null when the value was not encrypted with this key."""
    body = F.when(text.startswith(PREFIX), F.substring(text, len(PREFIX) + 1, 2_000_000_000)).otherwise(text)
    return F.try_aes_decrypt(F.unbase64(body), key, F.lit("GCM")).cast("string")
