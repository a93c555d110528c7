"""Differences of two states, and classified changes between consecutive states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def diff_plan(desired: DataFrame, existing: DataFrame, key: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """insert, update, retire or unchanged for every key of either side, by row hash."""
    digest = F.xxhash64(*[F.coalesce(F.col(v).cast("string"), F.lit("\0")) for v in values])
    d = desired.select(*key, digest.alias("d"))
    e = existing.select(*key, digest.alias("e"))
    action = F.when(F.col("e").isNull(), "insert").when(F.col("d").isNull(), "retire").when(F.col("d") == F.col("e"), "unchanged").otherwise("update")
    return d.join(e, list(key), "full_outer").select(*key, action.alias("action"))


def classified_changes(state: DataFrame, key: tuple[str, ...], at: str, fields: dict[str, str]) -> DataFrame:
    """Every state row that differs from the one before it: the changed fields and the class
    of change (``fields`` maps a field to its class; several changed ones are 'multiple')."""
    w = W.partitionBy(*key).orderBy(at)
    changed = F.filter(F.array(*[F.when(~F.lag(f).over(w).eqNullSafe(F.col(f)), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    s = state.withColumn("first_row", F.lag(at).over(w).isNull()).withColumn("changed", changed)
    kind = F.lit(None).cast("string")
    for f, k in fields.items():
        kind = F.when(F.array_contains("changed", f), F.lit(k)).otherwise(kind)
    label = F.when(F.col("first_row"), "initial").when(F.size("changed") > 1, "multiple").otherwise(kind)
    return s.where(F.col("first_row") | (F.size("changed") > 0)).select(*key, at, label.alias("change_class"), F.when(F.col("first_row"), "").otherwise(F.array_join("changed", ",")).alias("changed_fields"))


def chain_faults(periods: DataFrame, key: tuple[str, ...], start: str, end: str) -> DataFrame:
    """Breaks of period chains: an end that isn't the next start, or several open periods."""
    w = W.partitionBy(*key).orderBy(start)
    p = periods.withColumn("next_start", F.lead(start).over(w))
    return p.groupBy(*key).agg(F.count("*").alias("n_periods"), F.count_if(F.col("next_start").isNotNull() & ~F.col(end).eqNullSafe(F.col("next_start"))).alias("n_gaps"), F.count_if(F.col(end).isNull()).alias("n_open"))
