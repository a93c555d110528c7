"""Snapshot state and what changed between consecutive full snapshots (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Columns that a delivered state row may be corrected in.
STATE = ("current_price_minor", "reported_regular_price_minor", "is_promotion", "availability")


def accepted_runs(runs: DataFrame) -> DataFrame:
    """One row per successful run; repeated rows are one run."""
    return runs.where("run_status = 'success' and scrape_run_id is not null").groupBy("scrape_run_id").agg(F.min("location_id").alias("location_id"), F.min("observed_at_utc").alias("observed_at_utc"))


def state_rows(history: DataFrame, runs: DataFrame, columns: tuple[str, ...] = STATE, with_run: bool = True) -> DataFrame:
    """The state rows of ``history``: rows of successful runs, of several with the same
    product, location and valid_from the one loaded last.

    Rows loaded at the same instant: the one with the largest values counts (nulls
    smallest), so the result doesn't depend on row order. Without ``with_run`` the run's id
    isn't carried through the shuffle. Null product or location are
    values like any other; a null valid_from states no time and gives no row. The
    grouping has a map-side combine: repeated deliveries shrink before the shuffle.
    """
    rows = history.where("valid_from_utc is not null").join(accepted_runs(runs).select("scrape_run_id"), "scrape_run_id")
    carried = (*columns, "scrape_run_id") if with_run else columns
    best = F.max(F.struct("loaded_at_utc", *carried)).alias("s")
    kept = rows.groupBy("product_id", "location_id", "valid_from_utc").agg(best)
    return kept.select("product_id", "location_id", "valid_from_utc", *[f"s.{c}" for c in carried])


def run_pairs(runs: DataFrame) -> DataFrame:
    """Each accepted run with its location's previous and next one."""
    w = W.partitionBy("location_id").orderBy("observed_at_utc", "scrape_run_id")
    return accepted_runs(runs).select("scrape_run_id", F.lag("scrape_run_id").over(w).alias("prev_run"), F.lead("scrape_run_id").over(w).alias("next_run"))


def snapshot_changes(state: DataFrame, runs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Signed-cell difference of consecutive snapshots.

    Every state row is unpivoted into cells (field, value) plus a key-presence marker;
    they count +1 in the pair that ends with its run and -1 in the pair that starts with
    it. Cells whose sum is zero cancel. What remains says everything: a marker of +1 is
    an added key, of -1 a removed one, no marker but other cells a change, and the fields
    of the remaining cells are the ones that changed. One shuffle by (pair, key): both
    groupings run on it.

    A null value is a value (nulls equal nulls). Ties of runs at one instant go by run id.
    """
    p = state.join(run_pairs(runs), "scrape_run_id")
    own = F.when(F.col("prev_run").isNotNull(), F.struct(F.col("scrape_run_id").alias("run"), F.lit(1).alias("sign")))
    into = F.when(F.col("next_run").isNotNull(), F.struct(F.col("next_run").alias("run"), F.lit(-1).alias("sign")))
    signed = p.select("product_id", *fields, F.explode(F.filter(F.array(own, into), lambda x: x.isNotNull())).alias("x")).select(F.col("x.run").alias("scrape_run_id"), "product_id", F.col("x.sign").alias("sign"), *fields)
    cells = F.array(F.struct(F.lit("").alias("field"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])
    long = signed.repartition("scrape_run_id", "product_id").select("scrape_run_id", "product_id", "sign", F.explode(cells).alias("c"))
    left = long.groupBy("scrape_run_id", "product_id", F.col("c.field").alias("field"), F.col("c.value").alias("value")).agg(F.sum("sign").alias("net")).where("net <> 0")
    keys = left.groupBy("scrape_run_id", "product_id").agg(F.sum(F.when(F.col("field") == "", F.col("net"))).alias("presence"), F.array_sort(F.collect_set(F.when(F.col("field") != "", F.col("field")))).alias("changed_fields"))
    kind = F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed")
    return keys.select("scrape_run_id", "product_id", kind.alias("change_kind"), F.when(kind == "changed", F.concat_ws(",", "changed_fields")).otherwise("").alias("changed_fields"))
