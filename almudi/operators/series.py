"""Summaries of irregular value series: whole-series, windows with a baseline, runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almudi.functions.rounding import days, mean_half_up, pct_half_up


def series_summary(points: DataFrame, key: tuple[str, ...], at: str, value: str) -> DataFrame:
    """One row per series of non-null values: counts, extremes, centre, change, spread.

    Change counts use ``lag`` on the same partitioning as the grouping, so the series are
    shuffled once.
    """
    w = W.partitionBy(*key).orderBy(at)
    p = points.where(F.col(value).isNotNull()).withColumn("prev", F.lag(value).over(w))
    s = p.groupBy(*key).agg(
        F.count("*").alias("n_points"), F.min_by(value, at).alias("first_value"), F.max_by(value, at).alias("last_value"), F.min(value).alias("least"), F.max(value).alias("greatest"),
        F.sum(value).alias("total"), F.percentile(value, 0.5).alias("median"), F.count_distinct(value).alias("n_distinct"),
        F.count_if(F.col("prev").isNotNull() & (F.col("prev") != F.col(value))).alias("n_changes"), F.stddev_pop(value).alias("sd"), F.min(at).alias("from_at"), F.max(at).alias("to_at"),
    )
    change = F.col("last_value") - F.col("first_value")
    return s.select(
        *key, "n_points", "first_value", "last_value", "least", "greatest", mean_half_up(F.col("total"), F.col("n_points")).alias("mean"), "median", "n_distinct", "n_changes",
        pct_half_up(change, F.col("first_value")).alias("change_pct"), pct_half_up(F.col("greatest") - F.col("least"), F.col("least")).alias("range_pct"),
        days(F.unix_micros("to_at") - F.unix_micros("from_at")).alias("span_days"), F.round(F.try_divide(F.col("sd") * 100, F.col("total") / F.col("n_points")), 4).alias("variation_pct"),
        F.when(change > 0, "up").when(change < 0, "down").otherwise("same").alias("direction"),
    )


def window_summaries(points: DataFrame, key: tuple[str, ...], at: str, value: str, as_of: Column, windows: tuple[int, ...]) -> DataFrame:
    """Per series and window of days ending at ``as_of``: the value that held at its start
    (as-of baseline, else insufficient history) and what followed in it.

    One pass: a row per series and window start is never joined to the points; each point
    says for itself whether it precedes or lies in a window.
    """
    p = points.where(F.col(value).isNotNull() & (F.col(at) <= as_of))
    each = p.withColumn("window_days", F.explode(F.array(*[F.lit(d) for d in windows])))
    start = as_of - F.make_dt_interval(F.col("window_days"))
    before, inside = F.col(at) <= start, F.col(at) > start
    g = each.groupBy(*key, "window_days").agg(
        F.max_by(F.when(before, F.col(value)), F.when(before, F.col(at))).alias("baseline"), F.count_if(inside).alias("n_inside"),
        F.min(F.when(inside, F.col(value))).alias("least_inside"), F.max(F.when(inside, F.col(value))).alias("greatest_inside"), F.max_by(value, at).alias("last_value"),
    )
    known = F.col("baseline").isNotNull()
    return g.select(
        *key, "window_days", F.when(known, "ok").otherwise("insufficient_history").alias("status"), "baseline", "n_inside", "last_value",
        F.when(known, F.least("baseline", F.coalesce("least_inside", "baseline"))).alias("least"), F.when(known, F.greatest("baseline", F.coalesce("greatest_inside", "baseline"))).alias("greatest"),
        F.when(known, pct_half_up(F.col("last_value") - F.col("baseline"), F.col("baseline"))).alias("change_pct"),
    )


def period_changes(periods: DataFrame, key: tuple[str, ...], at: str, value: str) -> DataFrame:
    """Each period with its predecessor's value, the change and its direction."""
    w = W.partitionBy(*key).orderBy(at)
    p = periods.withColumn("previous", F.lag(value).over(w)).withColumn("is_first", F.lag(at).over(w).isNull()).withColumn("is_current", F.lead(at).over(w).isNull())
    change = F.col(value) - F.col("previous")
    direction = F.when(F.col("is_first"), "initial").when(change > 0, "up").when(change < 0, "down").when(change == 0, "unchanged").otherwise("unknown")
    return p.select(*key, at, value, "previous", change.alias("change"), pct_half_up(change, F.col("previous")).alias("change_pct"), direction.alias("direction"), "is_current")


def flag_runs(points: DataFrame, key: tuple[str, ...], at: str, flag: str) -> DataFrame:
    """How often a flag starts, on how many points it holds, and since when it holds at the
    end (null if it doesn't)."""
    w = W.partitionBy(*key).orderBy(at)
    on = F.coalesce(F.col(flag), F.lit(False))
    p = points.select(*key, at, on.alias("on")).withColumn("starts", F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False)))
    last_off = F.max(F.when(~F.col("on"), F.col(at))).over(W.partitionBy(*key))
    p = p.withColumn("tail", F.col("on") & (F.col(at) > F.coalesce(last_off, F.lit("0001-01-01").cast("timestamp"))))
    return p.groupBy(*key).agg(F.count("*").alias("n_points"), F.count_if("on").alias("n_on"), F.count_if("starts").alias("n_starts"), F.min(F.when(F.col("tail"), F.col(at))).alias("on_since"))


def equal_tail_start(points: DataFrame, key: tuple[str, ...], at: str, value: str) -> DataFrame:
    """Start of the trailing run of equal values."""
    w = W.partitionBy(*key).orderBy(at)
    p = points.withColumn("new_run", F.lag(at).over(w).isNull() | ~F.lag(value).over(w).eqNullSafe(F.col(value)))
    return p.groupBy(*key).agg(F.max(F.when(F.col("new_run"), F.col(at))).alias("since"), F.max_by(value, at).alias("value"))


def change_points(points: DataFrame, key: tuple[str, ...], at: str, value: str) -> DataFrame:
    """One point a day (the last), then only days whose value differs from the day kept before."""
    daily = points.groupBy(*key, F.to_date(at).alias("day")).agg(F.max_by(value, at).alias("value"))
    w = W.partitionBy(*key).orderBy("day")
    return daily.withColumn("same", F.lag("day").over(w).isNotNull() & F.lag("value").over(w).eqNullSafe(F.col("value"))).where(~F.col("same")).drop("same")
