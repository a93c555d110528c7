"""Offers, price indices, state mutations and writes.

Defined results
    * null prices are no offers; they close periods and count as unpriced states.
    * repeated keys: the earliest of equal order counts, by id.
    * empty tables give empty results; an insert into nothing inserts everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ("product_id", "location_id")


def shared_master_members(listings: DataFrame, masters: dict[str, str]) -> DataFrame:
    """Listings (product_id, supermarket_id, gtin) with ``member``: 'allowed' where exactly one
    product master has two or more chains of the number and the listing's chain is of it."""
    names = F.create_map(*[F.lit(x) for kv in masters.items() for x in kv])
    m = listings.withColumn("master", F.coalesce(names[F.col("supermarket_id")], F.col("supermarket_id")))
    c = m.groupBy("gtin", "master").agg(F.count_distinct("supermarket_id").alias("chains"))
    k = c.where("chains >= 2").groupBy("gtin").agg(F.count("*").alias("eligible"), F.max("master").alias("the_master"))
    ok = (F.col("eligible") == 1) & (F.col("master") == F.col("the_master"))
    return m.join(k, "gtin", "left").withColumn("member", F.when(ok, "allowed").otherwise("excluded"))


def loose_matches(goods: DataFrame) -> DataFrame:
    """(product_id, n_chains, best_elsewhere) of goods (type, dim, unit_price) that other chains
    sell too; prices under half or over twice the lower median are left out."""
    v = goods.groupBy("type", "dim", "unit_price").agg(F.count("*").alias("n"))
    whole = W.partitionBy("type", "dim")
    r = v.withColumns({"upto": F.sum("n").over(whole.orderBy("unit_price")), "all_n": F.sum("n").over(whole)})
    median = r.where(F.col("upto") >= F.floor((F.col("all_n") + 1) / 2)).groupBy("type", "dim").agg(F.min("unit_price").alias("low_median"))
    ok = goods.join(median, ["type", "dim"]).where("2 * unit_price >= low_median and unit_price <= 2 * low_median")
    chains = ok.groupBy("type", "dim", "supermarket_id").agg(F.min("unit_price").alias("best"))
    other = chains.withColumnRenamed("supermarket_id", "other")
    return ok.join(other, ["type", "dim"]).where("supermarket_id <> other").groupBy("product_id").agg(F.count("*").alias("n_chains"), F.min("best").alias("best_elsewhere"))


def price_index(chain_prices: DataFrame) -> DataFrame:
    """Mean, median, spread and index against the median in hundredths, from the sorted prices
    of an item (one a chain)."""
    g = chain_prices.groupBy("gtin").agg(F.count("*").alias("n"), F.sum("price").alias("total"), F.array_sort(F.collect_list("price")).alias("l"))
    g = g.withColumn("twice", F.element_at("l", F.floor((F.col("n") + 1) / 2).cast("int")) + F.element_at("l", (F.floor(F.col("n") / 2) + 1).cast("int")))
    j = chain_prices.join(g, "gtin")
    whole = lambda e: F.expr(e)
    return j.select("gtin", "supermarket_id", whole("(200 * total + n) div (2 * n)").alias("mean_x100"), (50 * F.col("twice")).alias("median_x100"), (F.element_at("l", -1) - F.element_at("l", 1)).alias("spread"), whole("(2 * price * 20000 + twice) div (2 * twice)").alias("pci_x100"))


def open_with_previous(versions: DataFrame) -> DataFrame:
    """The open version of every key with the price of the one before it."""
    w = W.partitionBy(*KEY).orderBy("valid_from")
    return versions.withColumn("previous", F.lag("price").over(w)).where("valid_to is null")


def real_reductions(versions: DataFrame) -> DataFrame:
    r = open_with_previous(versions)
    cut = F.when(F.col("previous").isNotNull() | F.col("price").isNotNull(), F.greatest(F.col("previous") - F.col("price"), F.lit(0)))
    return r.select(*KEY, F.col("price").alias("current_price_minor"), "previous", cut.alias("reduction"), F.coalesce(F.col("previous") > F.col("price"), F.lit(False)).alias("is_real"))


def last_two(state: DataFrame, price: str) -> DataFrame:
    """Per key the latest row, its price as ``now`` and the price of the row before (any, also
    null) as ``before``."""
    w = W.partitionBy(*KEY).orderBy("valid_from_utc")
    s = state.withColumns({"now": F.col(price), "before": F.lag(price).over(w), "next": F.lead("valid_from_utc").over(w)})
    return s.where("next is null").drop("next")


def mutations(state: DataFrame) -> DataFrame:
    w = W.partitionBy(*KEY).orderBy("valid_from_utc")
    now = F.col("current_price_minor")
    s = state.withColumns({"before": F.lag("current_price_minor").over(w), "first": F.lag("valid_from_utc").over(w).isNull()})
    old, first = F.col("before"), F.col("first")
    kinds = {
        "opened": first & now.isNotNull(), "changed": ~first & (now != old), "confirmed": now == old, "closed": now.isNull() & old.isNotNull(),
        "reopened": ~first & now.isNotNull() & old.isNull(), "still_unpriced": now.isNull() & old.isNull(),
    }
    return s.groupBy("location_id").agg(*[F.count_if(c).alias(f"n_{k}") for k, c in kinds.items()])


def weighted_bands(labelled: DataFrame, population: DataFrame) -> DataFrame:
    """Precision by band of (link_method, band, match), plain and weighted by how many links
    of the method each label stands for."""
    t = labelled.groupBy("link_method").agg(F.count("*").alias("sampled"))
    weight = population.join(t, "link_method").select("link_method", (F.col("population") / F.col("sampled")).alias("weight"))
    g = labelled.groupBy("link_method", "band").agg(F.count("*").alias("n"), F.count_if("match").alias("m")).join(weight, "link_method")
    b = g.groupBy("band").agg(F.sum("n").alias("labelled"), F.sum("m").alias("matches"), F.sum(F.col("m") * F.col("weight")).alias("wm"), F.sum(F.col("n") * F.col("weight")).alias("wn"))
    return b.select("band", "labelled", "matches", F.round(F.col("matches") / F.col("labelled"), 4).alias("precision"), F.round(F.col("wm") / F.col("wn"), 4).alias("precision_weighted"))


def insert_absent(existing: DataFrame, incoming: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """``incoming`` with its outcome against rows that never change: inserted, present, conflict."""
    e = existing.select(*key, F.struct(*values).alias("e"), F.lit(True).alias("there"))
    j = incoming.join(e, key, "left")
    return j.select(*key, *values, F.when(F.col("there").isNull(), "inserted").when(F.struct(*values).eqNullSafe(F.col("e")), "present").otherwise("conflict").alias("outcome"))


def rebuilt(df: DataFrame, renamed: dict[str, str], path: str, name: str) -> DataFrame:
    """Writes ``df`` with new column names and compares the rows before and after."""
    df.withColumnsRenamed(renamed).write.mode("errorifexists").parquet(path)
    n, after = df.agg(F.count("*").alias("n_before")), df.sparkSession.read.parquet(path).agg(F.count("*").alias("n_after"))
    return n.join(F.broadcast(after), how="cross").select(F.lit(name).alias("table_name"), "n_before", "n_after", (F.col("n_before") == F.col("n_after")).alias("same"))  # one row each
