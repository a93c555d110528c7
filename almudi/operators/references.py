"""References to records that do not exist (problem 2).

Parents and children are put in one long form and grouped by (parent table, key); groups
whose parent flag never rises are orphans. Child rows are pre-aggregated to one row per
(table, key, period) on the map side, so neither a hot key nor a hot table reaches one
task with more rows than there are periods.

Defined results
    * a null key refers to nothing and gives no row; keys are compared exactly, as text.
    * a null time belongs to period 'none' and can't be late.
    * parents delivered twice: the earliest start counts; retired if any row says so.
    * empty tables give empty results; a missing parent table makes every key 'missing'.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Child:
    """A referring table: its key column, time (or None) and which rows a retirement breaks."""

    name: str
    df: DataFrame
    parent: str
    key: str
    at: str | None = None
    active: Column = field(default_factory=lambda: F.lit(False))


@dataclass(frozen=True)
class Parent:
    """A referred table: its key column, when a row starts to exist, and whether it is retired."""

    name: str
    df: DataFrame
    key: str
    since: str | None = None
    retired: Column = field(default_factory=lambda: F.lit(False))


def _references(c: Child) -> DataFrame:
    at = F.col(c.at) if c.at else F.lit(None).cast("timestamp")
    rows = c.df.select(F.lit(c.parent).alias("parent_table"), F.col(c.key).cast("string").alias("ref_key"), F.lit(c.name).alias("child_table"), F.coalesce(F.date_format(at, "yyyy-MM"), F.lit("none")).alias("period_month"), at.alias("at"), F.coalesce(c.active, F.lit(False)).alias("active"))
    return rows.where("ref_key is not null")


def _child_rows(c: Child) -> DataFrame:
    return (
        _references(c)
        .groupBy("parent_table", "ref_key", "child_table", "period_month")
        .agg(
            F.count("*").alias("n"),
            F.count_if("active").alias("n_active"),
            F.min("at").alias("first_at"),
            F.min(F.when(~F.col("active"), F.col("at"))).alias("first_idle_at"),
        )
    )


def orphan_references(children: list[Child], parents: list[Parent]) -> DataFrame:
    """One row per (child table, key, period, kind) with the number of references.

    ``missing``: no parent row. ``deleted``: an active reference to a retired parent.
    ``late``: otherwise, the reference is older than its parent. ``period_refs`` counts the
    key's references of that kind in the period. In the month in which the parent starts, the
    grouping knows only that some are late: there it is null, and ``counted`` counts them.
    """
    blank = {"child_table": "string", "period_month": "string", "n": "bigint", "n_active": "bigint", "first_at": "timestamp", "first_idle_at": "timestamp"}
    sides = []
    for p in parents:
        sides.append(p.df.select(F.lit(p.name).alias("parent_table"), F.col(p.key).cast("string").alias("ref_key"), F.lit(True).alias("is_parent"), F.coalesce(p.retired, F.lit(False)).alias("retired"), (F.col(p.since) if p.since else F.lit(None)).cast("timestamp").alias("since"), *[F.lit(None).cast(t).alias(c) for c, t in blank.items()]).where("ref_key is not null"))
    for c in children:
        sides.append(_child_rows(c).select("parent_table", "ref_key", F.lit(False).alias("is_parent"), F.lit(False).alias("retired"), F.lit(None).cast("timestamp").alias("since"), *blank))
    long = reduce(DataFrame.unionByName, sides)
    groups = long.groupBy("parent_table", "ref_key").agg(
        F.max("is_parent").alias("has_parent"),
        F.max("retired").alias("retired"),
        F.min("since").alias("since"),
        # at most one struct per (child table, period): bounded whatever the key's rows
        F.collect_list(F.when(~F.col("is_parent"), F.struct(*blank))).alias("refs"),
    )
    r = groups.select("parent_table", "ref_key", "has_parent", "retired", "since", F.explode("refs").alias("r")).select("*", "r.*").drop("r", "refs")
    idle_late = F.col("first_idle_at") < F.col("since")
    kinds = F.when(~F.col("has_parent"), F.array(F.struct(F.lit("missing").alias("kind"), F.col("n").alias("n_refs")))).otherwise(
        F.filter(
            F.array(
                F.when(F.col("retired") & (F.col("n_active") > 0), F.struct(F.lit("deleted").alias("kind"), F.col("n_active").alias("n_refs"))),
                F.when(F.when(F.col("retired"), idle_late).otherwise(F.col("first_at") < F.col("since")), F.struct(F.lit("late").alias("kind"), F.when(F.date_format("since", "yyyy-MM") > F.col("period_month"), F.when(F.col("retired"), F.col("n") - F.col("n_active")).otherwise(F.col("n"))).alias("n_refs"))),
            ),
            lambda x: x.isNotNull(),
        )
    )
    return r.select("child_table", "ref_key", "period_month", "parent_table", "since", "retired", F.explode(kinds).alias("k")).select("child_table", "ref_key", "period_month", "parent_table", "since", "retired", F.col("k.kind").alias("orphan_kind"), F.col("k.n_refs").alias("period_refs"))


def counted(orphans: DataFrame, children: list[Child]) -> DataFrame:
    """``orphans`` with every ``period_refs``. The references of the months in which a parent
    starts are read again, for the keys that are late there and no others."""
    key = ["child_table", "parent_table", "ref_key", "period_month"]
    open_ = orphans.where("orphan_kind = 'late' and period_refs is null").select(*key, "since", "retired")
    rows = reduce(DataFrame.unionByName, [_references(c) for c in children])
    late = rows.join(open_, key).where((F.col("at") < F.col("since")) & ~(F.col("retired") & F.col("active"))).groupBy(*key).agg(F.count("*").alias("late"))
    return orphans.join(late.withColumn("orphan_kind", F.lit("late")), [*key, "orphan_kind"], "left").withColumn("period_refs", F.coalesce("period_refs", "late")).drop("late")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan keys and references per table, period and kind."""
    return orphans.groupBy("child_table", "period_month", "orphan_kind").agg(F.count("*").alias("orphan_keys"), F.sum("period_refs").alias("period_refs"))
