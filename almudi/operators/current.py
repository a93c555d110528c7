"""Current rows, freshness, scopes and rows not seen any more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def current_rows(state: DataFrame) -> DataFrame:
    """The latest state row of every product and location (``max_by`` combines map-side)."""
    values = [c for c in state.columns if c not in ("product_id", "location_id")]
    last = state.groupBy("product_id", "location_id").agg(F.max_by(F.struct(*values), "valid_from_utc").alias("s"))
    return last.select("product_id", "location_id", "s.*")


def last_accepted(runs: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Newest accepted run per location, at most ``as_of``; ties by run id."""
    r = runs.where(F.col("observed_at_utc") <= as_of) if as_of is not None else runs
    best = r.groupBy("location_id").agg(F.max(F.struct("observed_at_utc", "scrape_run_id")).alias("b"))
    return best.select("location_id", "b.scrape_run_id", "b.observed_at_utc")


def freshness(last: DataFrame, as_of: Column, window_hours: int) -> DataFrame:
    """Whole hours of age, and FRESH or STALE."""
    age = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("observed_at_utc")) / 3600).cast("long")
    return last.withColumn("age_hours", age).withColumn("freshness", F.when(F.col("age_hours") <= window_hours, "FRESH").otherwise("STALE"))


def unseen(current: DataFrame, last: DataFrame, most_share: float) -> DataFrame:
    """Per location, current rows that its latest accepted run no longer lists, and whether
    they are few enough to be hidden."""
    latest = last.select("location_id", F.col("scrape_run_id").alias("latest_run"))
    m = current.join(latest, "location_id").groupBy("location_id").agg(F.count("*").alias("n_current"), F.count_if(~F.col("scrape_run_id").eqNullSafe(F.col("latest_run"))).alias("n_unseen"))
    return m.withColumn("hide", F.col("n_unseen") <= F.col("n_current") * most_share)


def rank_within(df: DataFrame, group: str, value: str, member: str) -> DataFrame:
    """Dense rank of ``value`` in its group with the group's least and greatest value."""
    w = W.partitionBy(group)
    return df.withColumn("price_rank", F.dense_rank().over(w.orderBy(value))).withColumn("best", F.min(value).over(w)).withColumn("highest", F.max(value).over(w))
