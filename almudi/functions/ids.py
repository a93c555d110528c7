"""Deterministic ids and splits from hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_key(*named: tuple[str, Column]) -> tuple[Column, Column]:
    """(kind, value) of the first key that isn't blank."""
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, c in reversed(named):
        t = F.trim(c)
        kind, value = F.when(t != "", F.lit(name)).otherwise(kind), F.when(t != "", t).otherwise(value)
    return kind, value


def hashed(prefix: str, *parts: Column, size: int = 16) -> Column:
    """``prefix`` and the leading hex digits of a SHA-256 over the parts."""
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(size)))


def split_of(key: Column) -> Column:
    """train, validation or test (60 / 20 / 20) by the key's hash."""
    n = F.conv(F.left(F.sha2(key, 256), F.lit(8)), 16, 10).cast("long") % 10
    return F.when(n < 6, "train").when(n < 8, "validation").otherwise("test")
