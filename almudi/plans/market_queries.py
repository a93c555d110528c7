"""Queries of offers, marts, states, guards and sinks, with oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almudi.core.runtime import read_table, scratch, tabled
from almudi.functions import gtin as G
from almudi.functions.rounding import pct_half_even
from almudi.operators import market as M
from almudi.plans.data_queries import _STATE, _VERSIONED_SQL, _versions
from almudi.plans.identity_queries import _STD, _UNIT, _std, _unit_prices
from almudi.plans.reference_queries import _CUR, _OFFERS, _chain_prices, _current, _state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_VISIBLE = f"{_CUR}, vis AS (SELECT * FROM cur WHERE current_price_minor > 0 AND availability <> 'out_of_stock')"
_HALF_EVEN = "({0} // {1} + CASE WHEN 2 * ({0} % {1}) > {1} OR (2 * ({0} % {1}) = {1} AND ({0} // {1}) % 2 = 1) THEN 1 ELSE 0 END)"


def _visible(spark: SparkSession, sf: str) -> DataFrame:
    return _current(spark, sf).where("current_price_minor > 0 and availability <> 'out_of_stock'")


# ---- scans and scopes ------------------------------------------------------------------
@query(f"WITH {_CUR}, ids AS (SELECT DISTINCT product_id FROM master_product_links WHERE status = 'active') SELECT i.product_id, count(c.location_id) AS n_states, min(c.current_price_minor) AS least_price, count(c.location_id) > 0 AS covered FROM ids i LEFT JOIN cur c USING (product_id) GROUP BY 1")
def sc_states_of_list(spark, sf):
    """Current states of a list of products, and whether the list is covered."""
    ids = read_table(spark, sf, "master_product_links", "product_id", "status").where("status = 'active'").select("product_id").distinct()
    c = _current(spark, sf).groupBy("product_id").agg(F.count("*").alias("n"), F.min("current_price_minor").alias("least_price"))
    return ids.join(c, "product_id", "left").select("product_id", F.coalesce("n", F.lit(0)).alias("n_states"), "least_price", F.col("n").isNotNull().alias("covered"))


@query(f"WITH {_STATE} SELECT s.product_id, l.city_name, count(DISTINCT s.location_id) AS n_locations, array_to_string(list_sort(list(DISTINCT s.location_id)), ',') AS locations FROM state s JOIN locations l USING (location_id) GROUP BY 1, 2")
def sc_product_contexts(spark, sf):
    """Every product and city with the locations that listed it (bounded by the locations)."""
    s = _state(spark, sf).select("product_id", "location_id").distinct().join(read_table(spark, sf, "locations", "location_id", "city_name").distinct(), "location_id")
    return s.groupBy("product_id", "city_name").agg(F.count_distinct("location_id").alias("n_locations"), F.array_join(F.array_sort(F.collect_set("location_id")), ",").alias("locations"))


@query(f"WITH {_CUR} SELECT location_id, count(*) AS n_rows, count(*) FILTER (WHERE current_price_minor IS NULL AND availability = 'out_of_stock') AS n_set_apart, 50 * count(*) FILTER (WHERE current_price_minor IS NULL AND availability = 'out_of_stock') <= count(*) AS within_limit FROM cur GROUP BY 1")
def pf_unpriced_apart(spark, sf):
    """Rows without price and out of stock are set apart, two per cent of a location at most."""
    apart = F.count_if(F.col("current_price_minor").isNull() & (F.col("availability") == "out_of_stock"))
    return _current(spark, sf).groupBy("location_id").agg(F.count("*").alias("n_rows"), apart.alias("n_set_apart"), (50 * apart <= F.count("*")).alias("within_limit"))


_MASTERS = {"mercado_tolua": "shared", "tienda_lumbre": "shared"}
_MASTER_SQL = "CASE WHEN supermarket_id IN ('mercado_tolua', 'tienda_lumbre') THEN 'shared' ELSE supermarket_id END"


@query(f"""WITH {_STD}, r AS (SELECT s.product_id, s.supermarket_id, z.g AS gtin FROM std s JOIN std0 z USING (product_id) WHERE s.gtin IS NULL AND z.g IS NOT NULL AND list_sum([CAST(substr(z.g, i, 1) AS INT) * (CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END) for i in range(1, 15)]) % 10 = 0),
c AS (SELECT gtin, {_MASTER_SQL} AS master, count(DISTINCT supermarket_id) AS chains FROM r GROUP BY 1, 2), k AS (SELECT gtin, count(*) FILTER (WHERE chains >= 2) AS eligible, max(master) FILTER (WHERE chains >= 2) AS master FROM c GROUP BY 1)
SELECT r.product_id, r.gtin, CASE WHEN k.eligible = 1 AND {_MASTER_SQL} = k.master THEN 'allowed' ELSE 'excluded' END AS member FROM r JOIN k USING (gtin)""")
def pf_restricted_members(spark, sf):
    """Numbers of in-store use may join chains that share one product master only, and only
    if exactly one master has two chains or more there."""
    p = read_table(spark, sf, "products", "product_id", "supermarket_id", "ean").select("product_id", "supermarket_id", G.canonical_gtin(F.col("ean")).alias("gtin")).where(G.restricted(F.col("gtin")))
    return M.shared_master_members(p, _MASTERS).select("product_id", "gtin", "member")


@query("""WITH l AS (SELECT product_id, link_method, master_product_id, row_number() OVER (PARTITION BY product_id ORDER BY CASE link_method WHEN 'manual_review' THEN 0 ELSE 1 END, decided_at_utc DESC, link_id) AS n FROM master_product_links WHERE status = 'active' AND link_method IN ('manual_review', 'reviewed_decision'))
SELECT l.product_id, coalesce(t.master_product_id, m.master_product_id) AS master_product_id, l.link_method, m.merged_into IS NOT NULL AND t.master_product_id IS NOT NULL AS followed_merge FROM l JOIN master_products m ON l.master_product_id = m.master_product_id LEFT JOIN master_products t ON m.merged_into = t.master_product_id WHERE l.n = 1""")
def j_curated_links(spark, sf):
    """Links that people decided, the latest of the surest method, led on by one merge."""
    l = read_table(spark, sf, "master_product_links", "link_id", "product_id", "master_product_id", "link_method", "decided_at_utc", "status").where("status = 'active' and link_method in ('manual_review', 'reviewed_decision')")
    order = F.struct(F.when(F.col("link_method") == "manual_review", 0).otherwise(1).alias("o"), (-F.unix_micros("decided_at_utc")).alias("t"), "link_id", "master_product_id", "link_method")
    best = l.groupBy("product_id").agg(F.min(order).alias("b")).select("product_id", "b.master_product_id", "b.link_method")
    m = read_table(spark, sf, "master_products", "master_product_id", "merged_into")
    t = m.select(F.col("master_product_id").alias("merged_into"), F.col("master_product_id").alias("target"))
    return best.join(m, "master_product_id").join(t, "merged_into", "left").select("product_id", F.coalesce("target", "master_product_id").alias("master_product_id"), "link_method", F.col("target").isNotNull().alias("followed_merge"))


@query(f"WITH {_STD} SELECT left(gtin, 9) AS prefix, count(*) AS n_listings, count(DISTINCT gtin) AS n_numbers, min(product_id) AS first_product FROM std WHERE gtin IS NOT NULL GROUP BY 1")
def j_barcode_prefixes(spark, sf):
    """Index of numbers by their first nine digits."""
    s = _std(spark, sf).where("gtin is not null")
    return s.groupBy(F.left("gtin", F.lit(9)).alias("prefix")).agg(F.count("*").alias("n_listings"), F.count_distinct("gtin").alias("n_numbers"), F.min("product_id").alias("first_product"))


@query(f"""WITH {_UNIT}, l AS (SELECT product_id, supermarket_id, dim, unit_price, type AS loose_key FROM up WHERE type IS NOT NULL AND brand IS NULL), m AS (SELECT loose_key, dim, list_sort(list(unit_price))[(count(*) + 1) // 2] AS low_median FROM l GROUP BY 1, 2), ok AS (SELECT l.*, m.low_median FROM l JOIN m USING (loose_key, dim) WHERE 2 * unit_price >= low_median AND unit_price <= 2 * low_median),
c AS (SELECT loose_key, dim, supermarket_id, min(unit_price) AS best FROM ok GROUP BY 1, 2, 3) SELECT o.product_id, count(*) AS n_chains, min(c.best) AS best_elsewhere FROM ok o JOIN c ON o.loose_key = c.loose_key AND o.dim = c.dim AND o.supermarket_id <> c.supermarket_id GROUP BY 1""")
def j_loose_matches(spark, sf):
    """Unbranded goods of one kind in other chains, at half to twice the lower median. Other
    chains' best prices are aggregated first, so goods never meet goods."""
    l = tabled(_unit_prices(spark, sf).where("type is not null and brand is null").select("product_id", "supermarket_id", "dim", "unit_price", "type"), "loose")
    return M.loose_matches(l)


# ---- marts -----------------------------------------------------------------------------
@query(f"""WITH {_OFFERS}, j AS (SELECT c.*, min(price) OVER (PARTITION BY gtin) AS best FROM chain_price c WHERE gtin IN (SELECT gtin FROM wide)) SELECT gtin, supermarket_id, price - best AS delta_minor, {_HALF_EVEN.format("((price - best) * 10000)", "best")} / 100.0 AS delta_pct FROM j""")
def w_market_deltas(spark, sf):
    """Distance of every chain's price from the market's least, per cent with halves to even."""
    w = W.partitionBy("gtin")
    c = _chain_prices(spark, sf).withColumn("best", F.min("price").over(w))
    return c.select("gtin", "supermarket_id", (F.col("price") - F.col("best")).alias("delta_minor"), pct_half_even(F.col("price") - F.col("best"), F.col("best")).alias("delta_pct"))


@query(f"""WITH {_OFFERS}, g AS (SELECT gtin, count(*) AS n, sum(price) AS total, min(price) AS low, max(price) AS high, list_sort(list(price)) AS l FROM chain_price WHERE gtin IN (SELECT gtin FROM wide) GROUP BY 1),
m AS (SELECT *, l[(n + 1) // 2] + l[n // 2 + 1] AS twice_median FROM g)
SELECT c.gtin, c.supermarket_id, CAST((200 * m.total + m.n) // (2 * m.n) AS BIGINT) AS mean_x100, CAST(50 * m.twice_median AS BIGINT) AS median_x100, m.high - m.low AS spread, CAST((2 * c.price * 20000 + m.twice_median) // (2 * m.twice_median) AS BIGINT) AS pci_x100 FROM chain_price c JOIN m USING (gtin)""")
def a_price_index(spark, sf):
    """Mean, median and spread of an item's chain prices and each chain's price index against
    the median (hundredths, halves up)."""
    return M.price_index(_chain_prices(spark, sf))


@query(f"""WITH {_VERSIONED_SQL}, r AS (SELECT product_id, location_id, valid_from_epoch, current_price_minor, lag(current_price_minor) OVER (PARTITION BY product_id, location_id ORDER BY valid_from_epoch) AS previous, valid_to_epoch FROM v)
SELECT product_id, location_id, current_price_minor, previous, greatest(previous - current_price_minor, 0) AS reduction, coalesce(previous > current_price_minor, false) AS is_real FROM r WHERE valid_to_epoch = 0""")
def w_real_reductions(spark, sf):
    """The open period against the one before it; what the source calls regular doesn't count."""
    v = _versions(spark, sf).select("product_id", "location_id", "valid_from", "valid_to", F.col("current_price_minor").cast("long").alias("price"))
    return M.real_reductions(v)


@query(f"""WITH {_VISIBLE}, ch AS (SELECT product_id, location_id, current_price_minor AS now, lead_price AS before FROM (SELECT *, lag(current_price_minor) OVER (PARTITION BY product_id, location_id ORDER BY valid_from_utc) AS lead_price, row_number() OVER (PARTITION BY product_id, location_id ORDER BY valid_from_utc DESC) AS n FROM state) WHERE n = 1),
o AS (SELECT l.supermarket_id, v.product_id, v.is_promotion, c.now, c.before FROM vis v JOIN locations l USING (location_id) JOIN ch c USING (product_id, location_id))
SELECT supermarket_id, count(*) AS n_visible, count(*) FILTER (WHERE is_promotion) AS n_promotions, count(*) FILTER (WHERE now > before) AS n_up, count(*) FILTER (WHERE now < before) AS n_down, count(*) FILTER (WHERE now = before) AS n_unchanged, count(*) FILTER (WHERE before IS NULL) AS n_new FROM o GROUP BY 1""")
def a_chain_summary(spark, sf):
    """Visible offers of a chain, promotions, and what went up, down or stayed since the run before."""
    two = M.last_two(_state(spark, sf), "current_price_minor")
    c = two.where("now > 0 and availability <> 'out_of_stock'").join(read_table(spark, sf, "locations", "location_id", "supermarket_id"), "location_id")
    n = lambda ok: F.count_if(ok)
    now, old = F.col("now"), F.col("before")
    return c.groupBy("supermarket_id").agg(F.count("*").alias("n_visible"), n(F.col("is_promotion")).alias("n_promotions"), n(now > old).alias("n_up"), n(now < old).alias("n_down"), n(now == old).alias("n_unchanged"), n(old.isNull()).alias("n_new"))


@query(f"WITH {_OFFERS}, b AS (SELECT gtin, min(price) AS best, max(price) AS worst, count(*) AS n FROM chain_price WHERE gtin IN (SELECT gtin FROM wide) GROUP BY 1) SELECT c.supermarket_id, count(*) AS n_comparable, count(*) FILTER (WHERE c.price = b.best) AS n_wins, CAST(sum(b.worst - c.price) AS BIGINT) AS saved_against_worst, CAST(sum(c.price - b.best) AS BIGINT) AS lost_against_best FROM chain_price c JOIN b USING (gtin) GROUP BY 1")
def a_chain_wins(spark, sf):
    """Comparable items of a chain, how often it is cheapest (ties count), and what is saved or lost."""
    w = W.partitionBy("gtin")
    c = _chain_prices(spark, sf).withColumns({"best": F.min("price").over(w), "worst": F.max("price").over(w)})
    return c.groupBy("supermarket_id").agg(F.count("*").alias("n_comparable"), F.count_if(F.col("price") == F.col("best")).alias("n_wins"), F.sum(F.col("worst") - F.col("price")).alias("saved_against_worst"), F.sum(F.col("price") - F.col("best")).alias("lost_against_best"))


@query(f"WITH {_STD}, {_VISIBLE}, d AS (SELECT coalesce(s.leaf, 'other') AS department, v.product_id FROM vis v JOIN std s USING (product_id)) SELECT department, count(DISTINCT product_id) AS n_products, rank() OVER (ORDER BY count(DISTINCT product_id) DESC, department) AS place FROM d GROUP BY 1")
def a_departments(spark, sf):
    """Departments by number of visible products."""
    v = _visible(spark, sf).select("product_id").distinct()
    d = v.join(_std(spark, sf).select("product_id", F.coalesce("leaf", F.lit("other")).alias("department")), "product_id").groupBy("department").agg(F.count("*").alias("n_products"))
    return d.withColumn("place", F.rank().over(W.orderBy(F.desc("n_products"), "department")).cast("long"))  # one row a department


@query(f"WITH {_STD}, g AS (SELECT gtin, count(*) AS n, count(DISTINCT supermarket_id) AS c FROM std WHERE gtin IS NOT NULL GROUP BY 1) SELECT (SELECT count(*) FROM std) AS n_listings, (SELECT count(gtin) FROM std) AS n_numbered, (SELECT count(brand) FROM std) AS n_branded, (SELECT count(*) FROM std WHERE size IS NOT NULL) AS n_sized, (SELECT count(*) FROM g) AS n_groups, (SELECT count(*) FROM g WHERE c >= 2) AS n_comparable_groups, (SELECT count(*) FROM g WHERE n > c) AS n_chain_collisions")
def a_identity_counts(spark, sf):
    """How much of the catalogue has the evidence that identity needs."""
    s = tabled(_std(spark, sf).select("gtin", "supermarket_id", "brand", "size"), "profiles")
    g = s.where("gtin is not null").groupBy("gtin").agg(F.count("*").alias("n"), F.count_distinct("supermarket_id").alias("c")).agg(F.count("*").alias("n_groups"), F.count_if(F.col("c") >= 2).alias("n_comparable_groups"), F.count_if(F.col("n") > F.col("c")).alias("n_chain_collisions"))
    a = s.agg(F.count("*").alias("n_listings"), F.count("gtin").alias("n_numbered"), F.count("brand").alias("n_branded"), F.count("size").alias("n_sized"))
    return a.join(F.broadcast(g), how="cross")  # one row each


@query(f"WITH {_VERSIONED_SQL}, open_v AS (SELECT location_id, count(*) FILTER (WHERE valid_to_epoch = 0) AS n_open, count(*) AS n_versions FROM v GROUP BY 1), h AS (SELECT location_id, count(*) AS n_states, count(*) FILTER (WHERE availability = 'in_stock') AS n_in_stock, count(*) FILTER (WHERE availability = 'out_of_stock') AS n_out_of_stock, count(*) FILTER (WHERE availability = 'unknown') AS n_unknown FROM state GROUP BY 1) SELECT h.*, o.n_versions, o.n_open FROM h JOIN open_v o USING (location_id)")
def a_location_audit(spark, sf):
    """States, versions, open versions and availabilities of every location."""
    s = _state(spark, sf).groupBy("location_id").agg(F.count("*").alias("n_states"), *[F.count_if(F.col("availability") == a).alias(f"n_{a}") for a in ("in_stock", "out_of_stock", "unknown")])
    v = _versions(spark, sf).groupBy("location_id").agg(F.count("*").alias("n_versions"), F.count_if(F.col("valid_to").isNull()).alias("n_open"))
    return s.join(v, "location_id")


_BASKET = "b(line, product_type, quantity) AS (VALUES (1, 'leche', 4), (2, 'arroz', 2), (3, 'aceite', 1), (4, 'huevos', 1), (5, 'cafe', 1), (6, 'jugo', 3))"
_LINES = ((1, "leche", 4), (2, "arroz", 2), (3, "aceite", 1), (4, "huevos", 1), (5, "cafe", 1), (6, "jugo", 3))


def _basket(spark: SparkSession, sf: str) -> DataFrame:
    """Cheapest visible price of every basket line in every chain."""
    lines = spark.createDataFrame(_LINES, "line int, type string, quantity int")
    s = _std(spark, sf).select("product_id", "supermarket_id", "type")
    best = _visible(spark, sf).groupBy("product_id").agg(F.min("current_price_minor").alias("price")).join(s, "product_id").groupBy("supermarket_id", "type").agg(F.min("price").alias("price"))
    return lines.join(best, "type").select("supermarket_id", "line", "quantity", "price")


_BASKET_CTE = f"{_STD}, {_VISIBLE}, {_BASKET}, pp AS (SELECT product_id, min(current_price_minor) AS price FROM vis GROUP BY 1), o AS (SELECT s.supermarket_id, b.line, b.quantity, min(pp.price) AS price FROM b JOIN std s ON s.type = b.product_type JOIN pp USING (product_id) GROUP BY 1, 2, 3)"


@query(f"WITH {_BASKET_CTE} SELECT supermarket_id, CAST(sum(price * quantity) AS BIGINT) AS partial_total, 6 - count(*) AS n_missing, CASE WHEN count(*) = 6 THEN CAST(sum(price * quantity) AS BIGINT) END AS whole_total FROM o GROUP BY 1")
def a_cart_totals(spark, sf):
    """A basket's total in every chain over the lines it has, with what is missing; the whole
    total only where nothing is."""
    total = F.sum(F.col("price") * F.col("quantity"))
    return _basket(spark, sf).groupBy("supermarket_id").agg(total.alias("partial_total"), (len(_LINES) - F.count("*")).alias("n_missing"), F.when(F.count("*") == len(_LINES), total).alias("whole_total"))


@query(f"WITH {_BASKET_CTE}, m AS (SELECT line, min(price) AS low, count(*) AS n FROM o GROUP BY 1) SELECT o.line, max(CASE WHEN supermarket_id = 'mercado_tolua' THEN price * quantity END) AS mercado_tolua, max(CASE WHEN supermarket_id = 'super_verapan' THEN price * quantity END) AS super_verapan, max(CASE WHEN supermarket_id = 'despensa_orilla' THEN price * quantity END) AS despensa_orilla, max(m.low * quantity) AS cheapest, count(*) FILTER (WHERE price = m.low AND m.n >= 2) AS n_highlighted FROM o JOIN m USING (line) GROUP BY 1")
def a_cart_table(spark, sf):
    """Lines by chains; the cheapest are marked where there is something to compare."""
    o = _basket(spark, sf)
    wide = o.groupBy("line").pivot("supermarket_id", ["mercado_tolua", "super_verapan", "despensa_orilla"]).agg(F.max(F.col("price") * F.col("quantity")))
    m = o.groupBy("line").agg(F.min(F.struct("price", "quantity")).alias("b"), F.count("*").alias("n"), F.collect_list("price").alias("prices"))  # one price a chain
    low = F.col("b.price")
    marks = F.when(F.col("n") >= 2, F.size(F.filter("prices", lambda p: p == low))).otherwise(0)
    return wide.join(m, "line").select("line", "mercado_tolua", "super_verapan", "despensa_orilla", (low * F.col("b.quantity")).alias("cheapest"), marks.cast("long").alias("n_highlighted"))


@query(f"""WITH {_VISIBLE}, d AS (SELECT product_id, location_id, CAST(((reported_regular_price_minor - current_price_minor) * 200 + reported_regular_price_minor) // (2 * reported_regular_price_minor) AS BIGINT) AS pct FROM vis WHERE reported_regular_price_minor > current_price_minor), b AS (SELECT product_id, max(pct) AS best FROM d GROUP BY 1)
SELECT b.product_id, b.best AS discount_pct, count(*) AS n_offers, min(d.location_id) FILTER (WHERE d.pct = b.best) AS location_id FROM b JOIN d USING (product_id) GROUP BY 1, 2""")
def a_best_discounts(spark, sf):
    """The best declared discount of every product, whole per cent with halves up."""
    r, c = F.col("reported_regular_price_minor"), F.col("current_price_minor")
    d = _visible(spark, sf).where(r > c).select("product_id", "location_id", F.expr("((reported_regular_price_minor - current_price_minor) * 200 + reported_regular_price_minor) div (2 * reported_regular_price_minor)").alias("pct"))
    return d.groupBy("product_id").agg(F.min(F.struct((-F.col("pct")).alias("o"), "location_id")).alias("b"), F.count("*").alias("n_offers")).select("product_id", (-F.col("b.o")).alias("discount_pct"), "n_offers", "b.location_id")


@query(f"""WITH {_STD}, x AS (SELECT product_id, gtin AS g FROM std WHERE gtin IS NOT NULL), y AS (SELECT product_id, min(master_product_id) AS m FROM master_product_links WHERE status = 'active' GROUP BY 1), j AS (SELECT coalesce(x.product_id, y.product_id) AS product_id, x.g, y.m FROM x FULL JOIN y USING (product_id))
SELECT CASE WHEN g IS NULL THEN 'links_only' WHEN m IS NULL THEN 'numbers_only' ELSE 'both' END AS outcome, count(*) AS n_listings, count(DISTINCT g) AS n_numbers, count(DISTINCT m) AS n_masters FROM j GROUP BY 1""")
def a_rule_difference(spark, sf):
    """Two rules of identity, by number and by link: what each covers alone and both together."""
    x = _std(spark, sf).where("gtin is not null").select("product_id", "gtin")
    y = read_table(spark, sf, "master_product_links", "product_id", "master_product_id", "status").where("status = 'active'").groupBy("product_id").agg(F.min("master_product_id").alias("m"))
    j = x.join(y, "product_id", "full_outer")
    return j.groupBy(F.when(F.col("gtin").isNull(), "links_only").when(F.col("m").isNull(), "numbers_only").otherwise("both").alias("outcome")).agg(F.count("*").alias("n_listings"), F.count_distinct("gtin").alias("n_numbers"), F.count_distinct("m").alias("n_masters"))


@query(f"""WITH {_STD}, e AS (SELECT l.link_id, l.link_method, coalesce(l.confidence, 1.0) AS confidence, s.gtin, CASE WHEN length(regexp_replace(coalesce(m.primary_gtin, ''), '[^0-9]', '', 'g')) BETWEEN 8 AND 14 THEN lpad(regexp_replace(m.primary_gtin, '[^0-9]', '', 'g'), 14, '0') END AS mg FROM master_product_links l JOIN std s USING (product_id) JOIN master_products m USING (master_product_id)),
g AS (SELECT *, CASE WHEN confidence >= 0.9 THEN 'auto_match' WHEN confidence >= 0.75 THEN 'review' ELSE 'non_match' END AS band FROM e WHERE gtin IS NOT NULL AND mg IS NOT NULL), p AS (SELECT link_method, count(*) AS population FROM master_product_links GROUP BY 1), t AS (SELECT link_method, count(*) AS sampled FROM g GROUP BY 1), z AS (SELECT g.*, p.population / t.sampled::DOUBLE AS weight FROM g JOIN p USING (link_method) JOIN t USING (link_method))
SELECT band, count(*) AS labelled, count(*) FILTER (WHERE gtin = mg) AS matches, round(count(*) FILTER (WHERE gtin = mg) / count(*)::DOUBLE, 4) AS precision, round(coalesce(sum(weight) FILTER (WHERE gtin = mg), 0) / sum(weight), 4) AS precision_weighted FROM z GROUP BY 1""")
def a_weighted_evaluation(spark, sf):
    """Precision of the confidence bands of links, by labels (equal numbers) weighted to the
    population of their method."""
    return M.weighted_bands(*_labelled_links(spark, sf))


def _labelled_links(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    l = read_table(spark, sf, "master_product_links", "link_id", "product_id", "master_product_id", "link_method", "confidence")
    d = G.digits(F.col("primary_gtin"))
    m = read_table(spark, sf, "master_products", "master_product_id", "primary_gtin").select("master_product_id", F.when(F.length(d).between(8, 14), F.lpad(d, 14, "0")).alias("mg")).where("mg is not null")
    g = l.join(_std(spark, sf).select("product_id", "gtin").where("gtin is not null"), "product_id").join(m, "master_product_id")
    c = F.coalesce("confidence", F.lit(1.0))
    band = F.when(c >= 0.9, "auto_match").when(c >= 0.75, "review").otherwise("non_match")
    return g.select("link_method", band.alias("band"), (F.col("gtin") == F.col("mg")).alias("match")), l.groupBy("link_method").agg(F.count("*").alias("population"))


@query(f"WITH {_STD}, r AS (SELECT gtin, product_id, row_number() OVER (PARTITION BY gtin ORDER BY brand IS NOT NULL DESC, size IS NOT NULL DESC, type IS NOT NULL DESC, length(folded) DESC, product_id) AS n, count(*) OVER (PARTITION BY gtin) AS c FROM std WHERE gtin IS NOT NULL) SELECT gtin, product_id, c AS n_members FROM r WHERE n = 1")
def w_representatives(spark, sf):
    """The listing that stands for a number: complete ones first, then the longest name."""
    order = F.struct(F.col("brand").isNull().alias("a"), F.col("size").isNull().alias("b"), F.col("type").isNull().alias("c"), (-F.length("folded")).alias("d"), "product_id")
    return _std(spark, sf).where("gtin is not null").groupBy("gtin").agg(F.min(order)["product_id"].alias("product_id"), F.count("*").alias("n_members"))


# ---- states and guards -----------------------------------------------------------------
@query(f"WITH {_VERSIONED_SQL}, cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, location_id ORDER BY valid_from_utc DESC) AS n FROM state) WHERE n = 1) SELECT c.location_id, count(*) AS n_current, count(v.product_id) AS n_open, count(*) FILTER (WHERE v.product_id IS NULL OR v.current_price_minor IS DISTINCT FROM c.current_price_minor OR v.is_promotion IS DISTINCT FROM c.is_promotion) AS n_disagree FROM cur c LEFT JOIN v ON v.product_id = c.product_id AND v.location_id = c.location_id AND v.valid_to_epoch = 0 GROUP BY 1")
def st_rehydrated(spark, sf):
    """Current states rebuilt from open versions, and where the two disagree."""
    c = _current(spark, sf).select("product_id", "location_id", "current_price_minor", "is_promotion")
    v = _versions(spark, sf).where("valid_to is null").select("product_id", "location_id", F.col("current_price_minor").cast("long").alias("p"), F.col("is_promotion").cast("boolean").alias("q"), F.lit(True).alias("open"))
    j = c.join(v, ["product_id", "location_id"], "left")
    bad = F.col("open").isNull() | ~F.col("p").eqNullSafe(F.col("current_price_minor")) | ~F.col("q").eqNullSafe(F.col("is_promotion"))
    return j.groupBy("location_id").agg(F.count("*").alias("n_current"), F.count("open").alias("n_open"), F.count_if(bad).alias("n_disagree"))


@query("""WITH r AS (SELECT DISTINCT scrape_run_id, location_id, observed_at_utc, run_status FROM scrape_runs), l AS (SELECT h.scrape_run_id, max(h.loaded_at_utc) AS loaded FROM price_history h GROUP BY 1), o AS (SELECT r.*, l.loaded FROM r JOIN l USING (scrape_run_id) WHERE run_status = 'success'),
b AS (SELECT *, max(observed_at_utc) OVER (PARTITION BY location_id ORDER BY loaded, scrape_run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest_before FROM o) SELECT scrape_run_id, location_id, coalesce(observed_at_utc < newest_before, false) AS out_of_order FROM b""")
def st_out_of_order(spark, sf):
    """Runs delivered after a newer one of their location; such a run is rejected whole."""
    loaded = read_table(spark, sf, "price_history", "scrape_run_id", "loaded_at_utc").groupBy("scrape_run_id").agg(F.max("loaded_at_utc").alias("loaded"))
    r = read_table(spark, sf, "scrape_runs", "scrape_run_id", "location_id", "observed_at_utc", "run_status").where("run_status = 'success'").distinct()
    w = W.partitionBy("location_id").orderBy("loaded", "scrape_run_id").rowsBetween(W.unboundedPreceding, -1)
    o = r.join(loaded, "scrape_run_id")
    return o.select("scrape_run_id", "location_id", F.coalesce(F.col("observed_at_utc") < F.max("observed_at_utc").over(w), F.lit(False)).alias("out_of_order"))


@query(f"""WITH {_STATE}, x AS (SELECT *, lag(current_price_minor) OVER w AS before, lag(valid_from_utc) OVER w IS NULL AS first FROM state WINDOW w AS (PARTITION BY product_id, location_id ORDER BY valid_from_utc))
SELECT location_id, count(*) FILTER (WHERE first AND current_price_minor IS NOT NULL) AS n_opened, count(*) FILTER (WHERE NOT first AND current_price_minor IS NOT NULL AND before IS NOT NULL AND current_price_minor <> before) AS n_changed, count(*) FILTER (WHERE current_price_minor IS NOT NULL AND before = current_price_minor) AS n_confirmed, count(*) FILTER (WHERE current_price_minor IS NULL AND before IS NOT NULL) AS n_closed, count(*) FILTER (WHERE NOT first AND current_price_minor IS NOT NULL AND before IS NULL) AS n_reopened, count(*) FILTER (WHERE current_price_minor IS NULL AND before IS NULL) AS n_still_unpriced FROM x GROUP BY 1""")
def st_mutations(spark, sf):
    """What each state row does: open a period, change, confirm, close it (listed without
    price: nothing opens), or open it again."""
    return M.mutations(_state(spark, sf).select("product_id", "location_id", "valid_from_utc", "current_price_minor"))


@query("""WITH r AS (SELECT DISTINCT scrape_run_id, location_id, run_status, sku_count, catalog_product_count, error_reason FROM scrape_runs), n AS (SELECT scrape_run_id, count(DISTINCT product_id) AS n_rows, count(DISTINCT product_id) FILTER (WHERE current_price_minor IS NULL) AS n_unpriced FROM price_history GROUP BY 1)
SELECT r.scrape_run_id, CASE WHEN run_status <> 'success' OR error_reason IS NOT NULL THEN 'REJECTED' WHEN coalesce(n.n_rows, 0) = 0 OR 20 * n.n_unpriced > n.n_rows THEN 'DEGRADED' ELSE 'ACCEPTED' END AS quality, coalesce(n.n_rows, 0) AS n_rows FROM r LEFT JOIN n USING (scrape_run_id)""")
def q_run_quality(spark, sf):
    """Runs that aren't complete are rejected; empty ones or a twentieth without price only degrade."""
    r = read_table(spark, sf, "scrape_runs", "scrape_run_id", "location_id", "run_status", "sku_count", "catalog_product_count", "error_reason").distinct()
    # a product may be delivered twice in a run
    each = read_table(spark, sf, "price_history", "scrape_run_id", "product_id", "current_price_minor").groupBy("scrape_run_id", "product_id").agg(F.max(F.col("current_price_minor").isNull()).alias("unpriced"))
    n = each.groupBy("scrape_run_id").agg(F.count("*").alias("n"), F.count_if("unpriced").alias("u"))
    j = r.join(n, "scrape_run_id", "left")
    quality = F.when((F.col("run_status") != "success") | F.col("error_reason").isNotNull(), "REJECTED").when((F.coalesce("n", F.lit(0)) == 0) | (20 * F.col("u") > F.col("n")), "DEGRADED").otherwise("ACCEPTED")
    return j.select("scrape_run_id", quality.alias("quality"), F.coalesce("n", F.lit(0)).alias("n_rows"))


@query("""WITH d AS (SELECT scrape_run_id, product_id, location_id, count(*) AS n, count(DISTINCT current_price_minor) AS prices, count(DISTINCT availability) AS avail FROM price_history GROUP BY 1, 2, 3), a AS (SELECT location_id, count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS n_repeated, count(*) FILTER (WHERE prices > 1) AS n_price_disagreements, count(*) FILTER (WHERE avail > 1) AS n_availability_disagreements FROM d GROUP BY 1) SELECT *, 100 * n_price_disagreements > n_keys AS quarantine FROM a""")
def q_disagreements(spark, sf):
    """Rows of one run that disagree on a product; over one per cent of a location is quarantined."""
    h = read_table(spark, sf, "price_history", "scrape_run_id", "product_id", "location_id", "current_price_minor", "availability")
    lo_hi = lambda c: F.min(c) != F.max(c)
    d = h.groupBy("scrape_run_id", "product_id", "location_id").agg(F.count("*").alias("n"), lo_hi("current_price_minor").alias("p"), lo_hi("availability").alias("v"))
    a = d.groupBy("location_id").agg(F.count("*").alias("n_keys"), F.count_if(F.col("n") > 1).alias("n_repeated"), F.count_if("p").alias("n_price_disagreements"), F.count_if("v").alias("n_availability_disagreements"))
    return a.withColumn("quarantine", 100 * F.col("n_price_disagreements") > F.col("n_keys"))


# ---- writes ----------------------------------------------------------------------------
@query(f"""WITH {_STD}, e AS (SELECT product_id, folded FROM std WHERE product_id % 3 <> 0), i AS (SELECT product_id, CASE WHEN product_id % 7 = 0 THEN folded || ' x' ELSE folded END AS folded FROM std WHERE product_id % 5 <> 0)
SELECT CASE WHEN e.product_id IS NULL THEN 'inserted' WHEN e.folded = i.folded THEN 'present' ELSE 'conflict' END AS outcome, count(*) AS n_rows FROM i LEFT JOIN e USING (product_id) GROUP BY 1""")
def sk_insert_absent(spark, sf):
    """Rows of an incoming set that are inserted, already there, or in conflict with an
    immutable row; two made-up overlapping parts of the catalogue."""
    s = tabled(_std(spark, sf).select("product_id", "folded"), "rows")
    i = s.where("product_id % 5 <> 0").select("product_id", F.when(F.col("product_id") % 7 == 0, F.concat("folded", F.lit(" x"))).otherwise(F.col("folded")).alias("folded"))
    return M.insert_absent(s.where("product_id % 3 <> 0"), i, ["product_id"], ["folded"]).groupBy("outcome").agg(F.count("*").alias("n_rows"))


@query(f"""WITH {_VERSIONED_SQL}, p AS (SELECT *, lag(current_price_minor) OVER (PARTITION BY product_id, location_id ORDER BY valid_from_epoch) AS previous FROM v)
SELECT p.product_id, p.location_id, l.city_name, p.current_price_minor, p.previous AS previous_price_minor, CASE WHEN p.previous IS NULL OR p.current_price_minor IS NULL THEN 'unknown' WHEN p.current_price_minor > p.previous THEN 'up' WHEN p.current_price_minor < p.previous THEN 'down' ELSE 'same' END AS direction, p.valid_from_epoch FROM p JOIN locations l USING (location_id) WHERE p.valid_to_epoch = 0""")
def sk_report_records(spark, sf):
    """Typed export records: the open period, the price before it, and the direction."""
    v = _versions(spark, sf).select("product_id", "location_id", "valid_from", "valid_to", F.col("current_price_minor").cast("long").alias("price"))
    r = M.open_with_previous(v)
    direction = F.when(F.col("previous").isNull() | F.col("price").isNull(), "unknown").when(F.col("price") > F.col("previous"), "up").when(F.col("price") < F.col("previous"), "down").otherwise("same")
    l = read_table(spark, sf, "locations", "location_id", "city_name")
    return r.join(l, "location_id").select("product_id", "location_id", "city_name", F.col("price").alias("current_price_minor"), F.col("previous").alias("previous_price_minor"), direction.alias("direction"), F.unix_timestamp("valid_from").alias("valid_from_epoch"))


@query(f"""WITH {_STATE}, u AS (SELECT scrape_run_id, 'prices' AS row_set, count(*) AS n FROM state WHERE current_price_minor IS NOT NULL GROUP BY 1 UNION ALL SELECT scrape_run_id, 'stock', count(*) FROM state GROUP BY 1 UNION ALL SELECT scrape_run_id, 'promotions', count(*) FROM state WHERE is_promotion GROUP BY 1) SELECT scrape_run_id, row_set, n AS n_rows FROM u WHERE n > 0""")
def sk_row_sets(spark, sf):
    """The typed row sets that a run would write, from one pass over its states."""
    s = _state(spark, sf)
    sets = F.filter(F.array(F.when(F.col("current_price_minor").isNotNull(), "prices"), F.lit("stock"), F.when(F.col("is_promotion"), "promotions")), lambda x: x.isNotNull())
    return s.select("scrape_run_id", F.explode(sets).alias("row_set")).groupBy("scrape_run_id", "row_set").agg(F.count("*").alias("n_rows"))


@query("SELECT 'products' AS table_name, count(*) AS n_before, count(*) AS n_after, true AS same FROM products")
def sk_rebuilt_table(spark, sf):
    """A table rebuilt under a new path, renamed on the way, with a guard on its rows."""
    p = read_table(spark, sf, "products", "product_id", "supermarket_id", "name")
    return M.rebuilt(p, {"supermarket_id": "chain_id"}, scratch(spark, "rebuilt"), "products")


@query(f"""WITH {_OFFERS}, g AS (SELECT gtin, max(price) - min(price) AS saving, count(*) AS n_chains FROM chain_price WHERE gtin IN (SELECT gtin FROM wide) GROUP BY 1) SELECT gtin, saving, n_chains, row_number() OVER (ORDER BY saving DESC, n_chains DESC, gtin) AS place FROM g ORDER BY saving DESC, n_chains DESC, gtin LIMIT 40""")
def sk_public_sample(spark, sf):
    """The forty comparable items with the largest saving, for a public sample."""
    g = _chain_prices(spark, sf).groupBy("gtin").agg((F.max("price") - F.min("price")).alias("saving"), F.count("*").alias("n_chains"))
    top = g.orderBy(F.desc("saving"), F.desc("n_chains"), "gtin").limit(40)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("saving"), F.desc("n_chains"), "gtin")).cast("long"))


@query(f"""WITH {_STD}, s AS (SELECT canonical_gtin, net_content_value, net_content_unit FROM size_decisions WHERE decision = 'size'), m AS (SELECT DISTINCT ON (k.product_id) k.product_id, m.brand AS mb FROM master_product_links k JOIN master_products m USING (master_product_id) WHERE k.status = 'active' AND m.brand IS NOT NULL ORDER BY k.product_id, k.link_id)
SELECT z.product_id, CASE WHEN z.brand IS NOT NULL THEN 'own' WHEN m.mb IS NOT NULL THEN 'filled' ELSE 'missing' END AS brand_from, CASE WHEN z.size IS NOT NULL THEN 'own' WHEN s.canonical_gtin IS NOT NULL THEN 'filled' ELSE 'missing' END AS size_from FROM std z LEFT JOIN s ON z.gtin = s.canonical_gtin LEFT JOIN m USING (product_id)""")
def d_filled_attributes(spark, sf):
    """Brands and sizes that a listing lacks, filled from its master and its decided size."""
    k = read_table(spark, sf, "master_product_links", "link_id", "product_id", "master_product_id", "status").where("status = 'active'")
    m = read_table(spark, sf, "master_products", "master_product_id", "brand").where("brand is not null").withColumnRenamed("brand", "mb")
    best = k.join(m, "master_product_id").groupBy("product_id").agg(F.min_by("mb", "link_id").alias("mb"))
    d = read_table(spark, sf, "size_decisions", "canonical_gtin", "decision").where("decision = 'size'").select(F.col("canonical_gtin").alias("gtin"), F.lit(True).alias("sized"))
    j = _std(spark, sf).select("product_id", "brand", "size", "gtin").join(best, "product_id", "left").join(d, "gtin", "left")
    return j.select("product_id", F.when(F.col("brand").isNotNull(), "own").when(F.col("mb").isNotNull(), "filled").otherwise("missing").alias("brand_from"), F.when(F.col("size").isNotNull(), "own").when(F.col("sized"), "filled").otherwise("missing").alias("size_from"))
