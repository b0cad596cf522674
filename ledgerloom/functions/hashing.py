"""Hashes composed from built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def hmac_sha256(key: bytes, text: Column) -> Column:
    """HMAC-SHA256 of a text in hex; key pads are literals, so do not log plans that hold them."""
    import hashlib

    key = hashlib.sha256(key).digest() if len(key) > 64 else key
    pad = lambda b: F.lit(bytearray(x ^ b for x in key.ljust(64, b"\0")))
    return F.sha2(F.concat(pad(0x5C), F.unhex(F.sha2(F.concat(pad(0x36), F.encode(text, "UTF-8")), 256))), 256)


def identity_hash(key: bytes, kind: str, identity: Column) -> Column:
    return hmac_sha256(key, F.concat(F.lit(f"{kind}:"), identity))


def counterparty_hash(key: bytes, jurisdiction: Column, trn: Column) -> Column:
    return hmac_sha256(key, F.concat(F.lit("counterparty:"), jurisdiction, F.lit(":"), F.regexp_replace(trn, r"[\s-]", "")))


def recurrence_key(entity: Column, rule: Column, term: Column, regex_class: Column) -> Column:
    parts = [F.coalesce(c, F.lit(d)) for c, d in ((entity, ""), (rule, ""), (term, ""), (regex_class, "no-shape"))]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def line_bucket(n: Column) -> Column:
    return F.when(n <= 1, "1").when(n <= 5, "2-5").when(n <= 20, "6-20").when(n <= 100, "21-100").otherwise("100+")
