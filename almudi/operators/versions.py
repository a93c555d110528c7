"""History of changing attributes (problem 3): per-attribute change logs, combined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _same(a: str, attributes: tuple[str, ...], w) -> Column:
    return F.lag(a).over(w).eqNullSafe(F.col(a))


def change_points(state: DataFrame, key: tuple[str, ...], at: str, attributes: tuple[str, ...]) -> DataFrame:
    """State rows that can start an interval: those unlike the one before them, plus the
    first of every key and quarter.

    The first pass is partitioned by (key, quarter), so an entity with a very long
    history is spread over many tasks; only what it leaves is shuffled by key alone.
    """
    part = state.select(*key, at, *attributes, F.date_trunc("quarter", at).alias("_q"))
    w = W.partitionBy(*key, "_q").orderBy(at)
    same = F.lit(True)
    for a in attributes:
        same = same & _same(a, attributes, w)
    first = F.lag(at).over(w).isNull()
    return part.withColumn("_keep", first | ~same).where("_keep").drop("_q", "_keep")


def attribute_log(state: DataFrame, key: tuple[str, ...], at: str, attributes: tuple[str, ...]) -> DataFrame:
    """The event log: one row per key, attribute and period its value held.

    Values are text (null is a value). ``valid_to`` is null while the value holds.
    """
    points = change_points(state, key, at, attributes).repartition(*key)
    cells = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes])
    long = points.select(*key, F.col(at).alias("valid_from"), F.explode(cells).alias("c")).select(*key, "valid_from", "c.*")
    w = W.partitionBy(*key, "attribute").orderBy("valid_from")
    events = long.withColumn("_new", F.lag("valid_from").over(w).isNull() | ~F.lag("value").over(w).eqNullSafe(F.col("value"))).where("_new").drop("_new")
    return events.withColumn("valid_to", F.lead("valid_from").over(w))


def combine_logs(log: DataFrame, key: tuple[str, ...], attributes: tuple[str, ...]) -> DataFrame:
    """Versions of all attributes together.

    Time is split at the union of the logs' boundaries; in each piece every attribute has
    the value of its own interval there (carried from its last event); equal neighbours
    are coalesced. Partitioned by ``key`` throughout, like the log: no further shuffle.
    """
    starts = log.groupBy(*key, "valid_from").agg(*[F.max(F.when(F.col("attribute") == a, F.struct(F.col("value")))).alias(a) for a in attributes])
    w = W.partitionBy(*key).orderBy("valid_from")
    pieces = starts.select(*key, "valid_from", *[F.last(a, ignorenulls=True).over(w)["value"].alias(a) for a in attributes])
    same = F.lag("valid_from").over(w).isNotNull()
    for a in attributes:
        same = same & _same(a, attributes, w)
    return pieces.withColumn("_same", same).where(~F.col("_same")).drop("_same").withColumn("valid_to", F.lead("valid_from").over(w))


def versions(state: DataFrame, key: tuple[str, ...], at: str, attributes: tuple[str, ...]) -> DataFrame:
    """Every version of ``attributes`` with the period for which it held.

    ``state`` has at most one row per key and instant; times are not null. Nulls equal
    nulls, gaps end nothing, the last version is open (``valid_to`` null).
    """
    return combine_logs(attribute_log(state, key, at, attributes), key, attributes)
