"""Deterministic randomness: rows are ordered by an MD5 of seed, salt and key, so any engine draws the same sample."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int, salt: str, *key: Column | str) -> Column:
    """The hexadecimal MD5 of seed:salt:key, in whose order rows are shuffled."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *[p.cast("string") for p in parts]).cast("binary"))


def uniform(key: Column) -> Column:
    """A number in [0, 1) from an order key's first 32 bits."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def order_key_sql(seed: int, salt: str, key: str) -> str:
    return f"md5('{seed}:{salt}:' || CAST({key} AS VARCHAR))"


def uniform_sql(key: str) -> str:
    return f"(CAST(CAST('0x' || substr({key}, 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"
