"""Votes, baskets, search, stratified samples and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def vote(members: DataFrame, group: str, value: str, tier: str) -> DataFrame:
    """The surviving value of a group: best tier, then most frequent, then least text."""
    counts = members.where(F.col(value).isNotNull()).groupBy(group, tier, value).agg(F.count("*").alias("votes"))
    best = counts.groupBy(group).agg(F.min(F.struct(F.col(tier), -F.col("votes"), F.col(value))).alias("b"), F.sum("votes").alias("all_votes"))
    return best.select(group, F.col(f"b.{value}").alias(value), F.col(f"b.{tier}").alias("best_tier"), (-F.col("b.col2")).alias("votes"), "all_votes")


def basket_options(lines: DataFrame, offers: DataFrame) -> DataFrame:
    """Single-seller options of every basket: coverage in floored basis points, and a total
    only where the seller has every line."""
    need = lines.groupBy("basket", "item").agg(F.sum("quantity").alias("quantity"))
    size = need.groupBy("basket").agg(F.count("*").alias("requested"))
    have = need.join(offers, "item").groupBy("basket", "seller").agg(F.count("*").alias("covered"), F.sum(F.col("quantity") * F.col("price")).alias("sum_price"))
    o = have.join(size, "basket")
    return o.select("basket", "seller", "requested", "covered", F.floor(F.col("covered") * 10000 / F.col("requested")).cast("long").alias("coverage_bp"), F.when(F.col("covered") == F.col("requested"), F.col("sum_price")).alias("total"))


def split_basket(lines: DataFrame, offers: DataFrame) -> DataFrame:
    """Each basket bought item by item at the cheapest seller; null total if an item is missing."""
    need = lines.groupBy("basket", "item").agg(F.sum("quantity").alias("quantity"))
    cheapest = offers.groupBy("item").agg(F.min(F.struct("price", "seller")).alias("o"))
    j = need.join(cheapest, "item", "left")
    return j.groupBy("basket").agg(F.count("*").alias("requested"), F.count_if(F.col("o").isNull()).alias("missing"), F.count_distinct("o.seller").alias("sellers"), F.sum(F.col("quantity") * F.col("o.price")).alias("sum_price")).select("basket", "requested", "missing", "sellers", F.when(F.col("missing") == 0, F.col("sum_price")).alias("total"))


def upper_medians(rows: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """The upper middle value by (outer, inner) and by inner alone (outer null, all_outer 1).

    Values are counted first, so a group moves as its distinct values with their counts;
    the middle is where the running count passes half.
    """
    n = rows.groupBy(outer, inner, value).agg(F.count("*").alias("c")).withColumn("all_outer", F.lit(0).cast("long"))
    alone = n.groupBy(inner, value).agg(F.sum("c").alias("c")).select(F.lit(None).cast("string").alias(outer), inner, value, "c", F.lit(1).cast("long").alias("all_outer"))
    w = W.partitionBy("all_outer", outer, inner)
    m = n.unionByName(alone).withColumn("n", F.sum("c").over(w)).withColumn("upto", F.sum("c").over(w.orderBy(value)))
    return m.where(F.col("upto") >= F.floor(F.col("n") / 2) + 1).groupBy("all_outer", outer, inner, "n").agg(F.min(value).alias("upper_median"))


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(W.partitionBy(*group).orderBy(*order))).where(F.col("place") <= k)


def stratified(df: DataFrame, stratum: str, key: Column, per_stratum: int) -> DataFrame:
    """The rows with the least key hashes of every stratum: a sample that any engine and
    partitioning draws alike."""
    return top_per_group(df.withColumn("draw", F.sha2(key, 256)), [stratum], [F.col("draw").asc()], per_stratum)


def search(rows: DataFrame, text: str, terms: list[str], lead: int = 2) -> DataFrame:
    """Rows that hold every term as a word: tier 0 if a term is among the leading words."""
    words = F.split(F.col(text), " ")
    hit = F.lit(True)
    for t in terms:
        hit = hit & F.array_contains(words, t)
    leads = F.arrays_overlap(F.slice(words, 1, lead), F.array(*[F.lit(t) for t in terms]))
    return rows.where(hit).withColumn("tier", F.when(leads, 0).otherwise(1))


def chunked(df: DataFrame, group: str, key: str, size: int, block: int = 65_536) -> DataFrame:
    """Rows of each group in order of a whole-number key, in chunks of at most ``size``.

    Rows are numbered within blocks of the key range; the blocks' counts give each block
    its offset. A group of any size is spread over its blocks.
    """
    b = df.withColumn("_block", F.floor(F.col(key) / block))
    n = b.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    b = b.join(n.select(group, "_block", before.alias("_before")), [group, "_block"])
    place = F.col("_before") + F.row_number().over(W.partitionBy(group, "_block").orderBy(key)) - 1
    return b.withColumn("chunk", F.floor(place / size).cast("int")).drop("_block", "_before")
