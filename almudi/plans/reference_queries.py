"""Queries of the catalogue and price operators, each with oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almudi.core.runtime import read_table
from almudi.functions import gtin as G
from almudi.functions import ids, text
from almudi.functions.rounding import pct_half_even, pct_half_up
from almudi.operators import changes, current, ranking, series, snapshots, versions
from almudi.plans.data_queries import _STATE, _VERSIONED_SQL, VERSIONED

AS_OF = "2025-09-01 00:00:00"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
KEY = ("product_id", "location_id")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _as_of():
    return F.lit(AS_OF).cast("timestamp")


def _state(spark: SparkSession, sf: str) -> DataFrame:
    h = read_table(spark, sf, "price_history", "product_id", "location_id", "valid_from_utc", "loaded_at_utc", "scrape_run_id", *snapshots.STATE)
    return snapshots.state_rows(h, read_table(spark, sf, "scrape_runs"))


def _current(spark: SparkSession, sf: str) -> DataFrame:
    return current.current_rows(_state(spark, sf))


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    return snapshots.accepted_runs(read_table(spark, sf, "scrape_runs"))


_CUR = f"""{_STATE},
cur AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY product_id, location_id ORDER BY valid_from_utc DESC) AS n FROM state) WHERE n = 1)"""
_LAST = "last_run AS (SELECT location_id, max_by(scrape_run_id, (observed_at_utc, scrape_run_id)) AS scrape_run_id, max(observed_at_utc) AS observed_at_utc FROM runs WHERE observed_at_utc <= TIMESTAMPTZ '2025-09-01 00:00:00+00' GROUP BY location_id)"
_FOLD = "nullif(trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g')), '')"


def _pct(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) > 0 THEN sign({n}) * ((2 * abs({n}) * 10000 + ({d})) // (2 * ({d}))) / 100.0 WHEN ({n}) IS NOT NULL THEN 0.0 END)"


# ---- scans, filters, joins -------------------------------------------------------------
@query(f"WITH {_CUR} SELECT product_id, location_id, current_price_minor, availability, CAST(floor(epoch(valid_from_utc)) AS BIGINT) AS valid_from_epoch FROM cur")
def sc_current_rows(spark, sf):
    return _current(spark, sf).select(*KEY, "current_price_minor", "availability", F.unix_timestamp("valid_from_utc").alias("valid_from_epoch"))


@query(f"WITH {_STATE}, {_LAST} SELECT location_id, scrape_run_id, CAST(floor((epoch(TIMESTAMPTZ '2025-09-01 00:00:00+00') - floor(epoch(observed_at_utc))) / 3600) AS BIGINT) AS age_hours, CASE WHEN floor((epoch(TIMESTAMPTZ '2025-09-01 00:00:00+00') - floor(epoch(observed_at_utc))) / 3600) <= 240 THEN 'FRESH' ELSE 'STALE' END AS freshness FROM last_run")
def sc_freshness(spark, sf):
    last = current.last_accepted(_runs(spark, sf), _as_of())
    return current.freshness(last, _as_of(), 240).select("location_id", "scrape_run_id", "age_hours", "freshness")


@query(f"""WITH {_STATE}, {_LAST}, a AS (SELECT l.supermarket_id, r.observed_at_utc FROM last_run r JOIN locations l USING (location_id))
SELECT supermarket_id, count(*) AS n_locations, CAST(floor((epoch(max(observed_at_utc)) - epoch(min(observed_at_utc))) / 3600) AS BIGINT) AS gap_hours, CASE WHEN epoch(max(observed_at_utc)) - epoch(min(observed_at_utc)) <= 240 * 3600 THEN 'COMPARABLE' ELSE 'INSUFFICIENT' END AS market_window FROM a GROUP BY 1""")
def q_market_window(spark, sf):
    last = current.last_accepted(_runs(spark, sf), _as_of()).join(read_table(spark, sf, "locations", "location_id", "supermarket_id"), "location_id")
    gap = F.unix_micros(F.max("observed_at_utc")) - F.unix_micros(F.min("observed_at_utc"))
    g = last.groupBy("supermarket_id").agg(F.count("*").alias("n_locations"), gap.alias("gap"))
    return g.select("supermarket_id", "n_locations", F.floor(F.col("gap") / 3_600_000_000).cast("long").alias("gap_hours"), F.when(F.col("gap") <= 240 * 3_600_000_000, "COMPARABLE").otherwise("INSUFFICIENT").alias("market_window"))


@query(f"""WITH {_CUR} SELECT c.product_id, c.location_id, l.city_name, p.supermarket_id, p.name, p.category, c.current_price_minor, c.availability
FROM cur c JOIN products p ON c.product_id = p.product_id JOIN locations l ON c.location_id = l.location_id WHERE c.current_price_minor > 0 AND c.availability <> 'out_of_stock'""")
def sc_visible_offers(spark, sf):
    c = _current(spark, sf).where("current_price_minor > 0 and availability <> 'out_of_stock'")
    p = read_table(spark, sf, "products", "product_id", "supermarket_id", "name", "category")
    return c.join(read_table(spark, sf, "locations", "location_id", "city_name"), "location_id").join(p, "product_id").select(*KEY, "city_name", "supermarket_id", "name", "category", "current_price_minor", "availability")


@query(f"""WITH {_STATE}, scope(supermarket_id, city_name) AS (SELECT DISTINCT supermarket_id, city_name FROM locations WHERE city_name IN (SELECT city_name FROM locations GROUP BY city_name HAVING count(DISTINCT supermarket_id) >= 2))
SELECT h.location_id, count(*) AS n_rows, count(DISTINCT h.product_id) AS n_products FROM state h JOIN locations l ON h.location_id = l.location_id WHERE EXISTS (SELECT 1 FROM scope s WHERE s.supermarket_id = l.supermarket_id AND s.city_name = l.city_name) GROUP BY 1""")
def pf_scope(spark, sf):
    """Rows of locations in cities where at least two chains compete (semi join on pairs)."""
    loc = read_table(spark, sf, "locations")
    cities = loc.groupBy("city_name").agg(F.count_distinct("supermarket_id").alias("n")).where("n >= 2")
    scope = loc.join(cities, "city_name", "left_semi").select("supermarket_id", "city_name").distinct()
    inside = loc.join(scope, ["supermarket_id", "city_name"], "left_semi").select("location_id")
    s = _state(spark, sf).join(inside, "location_id", "left_semi")
    return s.groupBy("location_id").agg(F.count("*").alias("n_rows"), F.count_distinct("product_id").alias("n_products"))


@query(f"""WITH {_CUR}, {_LAST} SELECT c.location_id, count(*) AS n_current, count(*) FILTER (WHERE c.scrape_run_id IS DISTINCT FROM r.scrape_run_id) AS n_unseen, count(*) FILTER (WHERE c.scrape_run_id IS DISTINCT FROM r.scrape_run_id) <= count(*) * 0.25 AS hide
FROM cur c JOIN last_run r ON c.location_id = r.location_id GROUP BY 1""")
def pf_unseen(spark, sf):
    return current.unseen(_current(spark, sf), current.last_accepted(_runs(spark, sf), _as_of()), 0.25)


@query("""SELECT p.supermarket_id, count(*) AS n_products, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM price_history h WHERE h.product_id = p.product_id AND h.current_price_minor IS NOT NULL)) AS n_priced,
count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM master_product_links l WHERE l.product_id = p.product_id AND l.status = 'active')) AS n_unlinked FROM products p GROUP BY 1""")
def j_semi_anti(spark, sf):
    """Products ever priced (semi join) and without an active link (anti join), per chain."""
    p = read_table(spark, sf, "products", "product_id", "supermarket_id")
    priced = read_table(spark, sf, "price_history", "product_id", "current_price_minor").where("current_price_minor is not null").groupBy("product_id").agg(F.lit(True).alias("priced"))
    linked = read_table(spark, sf, "master_product_links", "product_id", "status").where("status = 'active'").groupBy("product_id").agg(F.lit(True).alias("linked"))
    j = p.join(priced, "product_id", "left").join(linked, "product_id", "left")
    return j.groupBy("supermarket_id").agg(F.count("*").alias("n_products"), F.count_if("priced").alias("n_priced"), F.count_if(F.col("linked").isNull()).alias("n_unlinked"))


@query("""WITH x AS (SELECT m.master_product_id, CAST(u.v AS BIGINT) AS product_id FROM master_products m, unnest(CAST(json_extract(m.attribute_provenance_json, '$.brand.product_ids') AS BIGINT[])) AS u(v))
SELECT x.master_product_id, count(*) AS n_members, count(p.product_id) AS n_known, count(DISTINCT p.supermarket_id) AS n_chains FROM x LEFT JOIN products p ON x.product_id = p.product_id GROUP BY 1""")
def j_unnested_members(spark, sf):
    """Member ids unnested from provenance JSON, joined with the products they name."""
    m = read_table(spark, sf, "master_products", "master_product_id", "attribute_provenance_json")
    members = F.from_json(F.get_json_object("attribute_provenance_json", "$.brand.product_ids"), "array<bigint>")
    x = m.select("master_product_id", F.explode(members).alias("product_id"))
    p = read_table(spark, sf, "products", "product_id", "supermarket_id").withColumn("known", F.lit(True))
    return x.join(p, "product_id", "left").groupBy("master_product_id").agg(F.count("*").alias("n_members"), F.count("known").alias("n_known"), F.count_distinct("supermarket_id").alias("n_chains"))


# ---- comparison ------------------------------------------------------------------------
_EAN = "CASE WHEN length(regexp_replace(p.ean, '[^0-9]', '', 'g')) IN (8, 12, 13, 14) THEN lpad(regexp_replace(p.ean, '[^0-9]', '', 'g'), 14, '0') END"
_CHECK = "list_sum([CAST(substr({0}, i, 1) AS INT) * (CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END) for i in range(1, 15)]) % 10 = 0"
_OFFERS = f"""{_CUR},
e AS (SELECT p.product_id, p.supermarket_id, {_EAN} AS g FROM products p),
chain_price AS (SELECT e.g AS gtin, e.supermarket_id, min(c.current_price_minor) AS price FROM e JOIN cur c ON c.product_id = e.product_id WHERE e.g IS NOT NULL AND {_CHECK.format("e.g")} AND c.current_price_minor > 0 AND c.availability <> 'out_of_stock' GROUP BY 1, 2),
wide AS (SELECT gtin FROM chain_price GROUP BY gtin HAVING count(*) >= 2)"""


def _chain_prices(spark: SparkSession, sf: str) -> DataFrame:
    """Lowest current price per trade item and chain, of items that two chains offer."""
    p = read_table(spark, sf, "products", "product_id", "supermarket_id", "ean")
    p = p.select("product_id", "supermarket_id", G.canonical_gtin(F.col("ean")).alias("gtin")).where("gtin is not null")
    c = _current(spark, sf).where("current_price_minor > 0 and availability <> 'out_of_stock'").select("product_id", "current_price_minor")
    by_chain = c.join(p, "product_id").groupBy("gtin", "supermarket_id").agg(F.min("current_price_minor").alias("price"))
    return by_chain.withColumn("n_chains", F.count("*").over(W.partitionBy("gtin"))).where("n_chains >= 2").drop("n_chains")


@query(f"""WITH {_OFFERS}, j AS (SELECT *, dense_rank() OVER (PARTITION BY gtin ORDER BY price) AS price_rank, min(price) OVER (PARTITION BY gtin) AS best, max(price) OVER (PARTITION BY gtin) AS highest FROM chain_price WHERE gtin IN (SELECT gtin FROM wide))
SELECT gtin, supermarket_id, price, price_rank, best, highest, price - best AS over_best, {_pct("price - best", "best")} AS over_best_pct FROM j""")
def a_price_ranks(spark, sf):
    r = current.rank_within(_chain_prices(spark, sf), "gtin", "price", "supermarket_id")
    over = F.col("price") - F.col("best")
    return r.select("gtin", "supermarket_id", "price", "price_rank", "best", "highest", over.alias("over_best"), pct_half_up(over, F.col("best")).alias("over_best_pct"))


@query(f"""WITH {_OFFERS} SELECT gtin, count(*) AS n_chains, min(price) AS best, max(price) AS highest, median(price) AS median_price, max(price) - min(price) AS spread, {_pct("max(price) - min(price)", "min(price)")} AS spread_pct, min_by(supermarket_id, (price, supermarket_id)) AS cheapest
FROM chain_price WHERE gtin IN (SELECT gtin FROM wide) GROUP BY gtin""")
def a_product_comparison(spark, sf):
    spread = F.max("price") - F.min("price")
    g = _chain_prices(spark, sf).groupBy("gtin").agg(F.count("*").alias("n_chains"), F.min("price").alias("best"), F.max("price").alias("highest"), F.percentile("price", 0.5).alias("median_price"), spread.alias("spread"), F.min(F.struct("price", "supermarket_id")).alias("c"))
    return g.select("gtin", "n_chains", "best", "highest", "median_price", "spread", pct_half_up(F.col("spread"), F.col("best")).alias("spread_pct"), F.col("c.supermarket_id").alias("cheapest"))


@query("""WITH o AS (SELECT l_partkey AS item, l_suppkey % 5 AS seller, CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT) AS price, row_number() OVER (PARTITION BY l_partkey, l_suppkey % 5 ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem),
offers AS (SELECT item, seller, price FROM o WHERE n = 1), need AS (SELECT l_orderkey AS basket, l_partkey AS item, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1, 2),
size AS (SELECT basket, count(*) AS requested FROM need GROUP BY 1), have AS (SELECT basket, seller, count(*) AS covered, CAST(sum(quantity * price) AS BIGINT) AS s FROM need JOIN offers USING (item) GROUP BY 1, 2)
SELECT basket, seller, requested, covered, covered * 10000 // requested AS coverage_bp, CASE WHEN covered = requested THEN s END AS total FROM have JOIN size USING (basket)""")
def a_basket_options(spark, sf):
    lines, offers = _baskets(spark, sf)
    return ranking.basket_options(lines, offers)


@query("""WITH o AS (SELECT l_partkey AS item, l_suppkey % 5 AS seller, CAST(round(l_extendedprice * 100 / l_quantity) AS BIGINT) AS price, row_number() OVER (PARTITION BY l_partkey, l_suppkey % 5 ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS n FROM lineitem),
best AS (SELECT item, min_by(seller, (price, seller)) AS seller, min(price) AS price FROM o WHERE n = 1 GROUP BY 1), need AS (SELECT l_orderkey AS basket, l_partkey AS item, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY 1, 2)
SELECT basket, count(*) AS requested, count(*) FILTER (WHERE price IS NULL) AS missing, count(DISTINCT seller) AS sellers, CASE WHEN count(*) FILTER (WHERE price IS NULL) = 0 THEN CAST(sum(quantity * price) AS BIGINT) END AS total FROM need LEFT JOIN best USING (item) GROUP BY 1""")
def a_split_basket(spark, sf):
    lines, offers = _baskets(spark, sf)
    return ranking.split_basket(lines, offers)


def _baskets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    price = F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long")
    offers = li.groupBy(F.col("l_partkey").alias("item"), (F.col("l_suppkey") % 5).alias("seller")).agg(F.max_by(price, F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("price"))
    return li.select(F.col("l_orderkey").alias("basket"), F.col("l_partkey").alias("item"), F.col("l_quantity").cast("long").alias("quantity")), offers


# ---- series ----------------------------------------------------------------------------
_MEAN = "(2 * CAST(sum({0}) AS BIGINT) + count(*)) // (2 * count(*))"


@query(f"""WITH {_STATE}, x AS (SELECT *, lag(current_price_minor) OVER (PARTITION BY product_id, location_id ORDER BY valid_from_utc) AS prev FROM state WHERE current_price_minor IS NOT NULL),
s AS (SELECT product_id, location_id, count(*) AS n_points, min_by(current_price_minor, valid_from_utc) AS first_value, max_by(current_price_minor, valid_from_utc) AS last_value, min(current_price_minor) AS least, max(current_price_minor) AS greatest, {_MEAN.format("current_price_minor")} AS mean, median(current_price_minor) AS median,
count(DISTINCT current_price_minor) AS n_distinct, count(*) FILTER (WHERE prev <> current_price_minor) AS n_changes, stddev_pop(current_price_minor) AS sd, avg(current_price_minor) AS av, epoch_us(max(valid_from_utc)) - epoch_us(min(valid_from_utc)) AS us FROM x GROUP BY 1, 2)
SELECT product_id, location_id, n_points, first_value, last_value, least, greatest, mean, median, n_distinct, n_changes, {_pct("last_value - first_value", "first_value")} AS change_pct, {_pct("greatest - least", "least")} AS range_pct, ((us * 200 + 86400000000) // 172800000000) / 100.0 AS span_days, round(sd * 100 / av, 4) AS variation_pct, CASE WHEN last_value > first_value THEN 'up' WHEN last_value < first_value THEN 'down' ELSE 'same' END AS direction FROM s""")
def a_series_summary(spark, sf):
    return series.series_summary(_state(spark, sf), KEY, "valid_from_utc", "current_price_minor")


@query(f"""WITH {_STATE}, x AS (SELECT s.*, w.d AS window_days, valid_from_utc <= TIMESTAMPTZ '2025-09-01 00:00:00+00' - to_days(CAST(w.d AS INT)) AS before FROM state s, (VALUES (7), (30), (90), (365)) w(d) WHERE current_price_minor IS NOT NULL AND valid_from_utc <= TIMESTAMPTZ '2025-09-01 00:00:00+00'),
g AS (SELECT product_id, location_id, window_days, max_by(current_price_minor, valid_from_utc) FILTER (WHERE before) AS baseline, count(*) FILTER (WHERE NOT before) AS n_inside, min(current_price_minor) FILTER (WHERE NOT before) AS li, max(current_price_minor) FILTER (WHERE NOT before) AS gi, max_by(current_price_minor, valid_from_utc) AS last_value FROM x GROUP BY 1, 2, 3)
SELECT product_id, location_id, window_days, CASE WHEN baseline IS NULL THEN 'insufficient_history' ELSE 'ok' END AS status, baseline, n_inside, last_value, CASE WHEN baseline IS NOT NULL THEN least(baseline, coalesce(li, baseline)) END AS least, CASE WHEN baseline IS NOT NULL THEN greatest(baseline, coalesce(gi, baseline)) END AS greatest, CASE WHEN baseline IS NOT NULL THEN {_pct("last_value - baseline", "baseline")} END AS change_pct FROM g""")
def a_window_summaries(spark, sf):
    return series.window_summaries(_state(spark, sf), KEY, "valid_from_utc", "current_price_minor", _as_of(), (7, 30, 90, 365))


@query(f"""WITH {_VERSIONED_SQL}, x AS (SELECT *, lag(current_price_minor) OVER w AS previous, lag(valid_from_epoch) OVER w IS NULL AS is_first, lead(valid_from_epoch) OVER w IS NULL AS is_current FROM v WINDOW w AS (PARTITION BY product_id, location_id ORDER BY valid_from_epoch))
SELECT product_id, location_id, valid_from_epoch, current_price_minor, previous, current_price_minor - previous AS change, {_pct("current_price_minor - previous", "previous")} AS change_pct, CASE WHEN is_first THEN 'initial' WHEN current_price_minor > previous THEN 'up' WHEN current_price_minor < previous THEN 'down' WHEN current_price_minor = previous THEN 'unchanged' ELSE 'unknown' END AS direction, is_current FROM x""")
def w_period_changes(spark, sf):
    v = versions.versions(_state(spark, sf), KEY, "valid_from_utc", VERSIONED)
    p = v.select(*KEY, F.unix_timestamp("valid_from").alias("valid_from_epoch"), F.col("current_price_minor").cast("long").alias("current_price_minor"))
    return series.period_changes(p, KEY, "valid_from_epoch", "current_price_minor")


@query(f"""WITH {_STATE}, x AS (SELECT product_id, location_id, valid_from_utc, coalesce(is_promotion, false) AS p FROM state), y AS (SELECT *, p AND NOT coalesce(lag(p) OVER (PARTITION BY product_id, location_id ORDER BY valid_from_utc), false) AS st, max(CASE WHEN NOT p THEN valid_from_utc END) OVER (PARTITION BY product_id, location_id) AS last_off FROM x)
SELECT product_id, location_id, count(*) AS n_points, count(*) FILTER (WHERE p) AS n_on, count(*) FILTER (WHERE st) AS n_starts, coalesce(CAST(floor(epoch(min(CASE WHEN p AND (last_off IS NULL OR valid_from_utc > last_off) THEN valid_from_utc END))) AS BIGINT), 0) AS on_since FROM y GROUP BY 1, 2""")
def w_promotion_runs(spark, sf):
    r = series.flag_runs(_state(spark, sf), KEY, "valid_from_utc", "is_promotion")
    return r.withColumn("on_since", F.coalesce(F.unix_timestamp("on_since"), F.lit(0)))


@query(f"""WITH {_STATE}, x AS (SELECT *, lag(valid_from_utc) OVER w IS NULL OR lag(current_price_minor) OVER w IS DISTINCT FROM current_price_minor AS nr FROM state WINDOW w AS (PARTITION BY product_id, location_id ORDER BY valid_from_utc))
SELECT product_id, location_id, CAST(floor(epoch(max(CASE WHEN nr THEN valid_from_utc END))) AS BIGINT) AS since_epoch, arg_max_null(current_price_minor, valid_from_utc) AS value FROM x GROUP BY 1, 2""")
def w_price_since(spark, sf):
    s = series.equal_tail_start(_state(spark, sf), KEY, "valid_from_utc", "current_price_minor")
    return s.select(*KEY, F.unix_timestamp("since").alias("since_epoch"), "value")


@query(f"""WITH {_STATE}, d AS (SELECT product_id, location_id, CAST(valid_from_utc AT TIME ZONE 'UTC' AS DATE) AS day, arg_max_null(current_price_minor, valid_from_utc) AS value FROM state GROUP BY 1, 2, 3), x AS (SELECT *, lag(day) OVER w IS NOT NULL AND lag(value) OVER w IS NOT DISTINCT FROM value AS same FROM d WINDOW w AS (PARTITION BY product_id, location_id ORDER BY day))
SELECT product_id, location_id, CAST(day AS VARCHAR) AS day, value FROM x WHERE NOT same""")
def w_change_points(spark, sf):
    return series.change_points(_state(spark, sf), KEY, "valid_from_utc", "current_price_minor").withColumn("day", F.col("day").cast("string"))


# ---- changes and chains ----------------------------------------------------------------
@query(f"""WITH {_STATE}, x AS (SELECT *, lag(valid_from_utc) OVER w IS NULL AS f, lag(current_price_minor) OVER w IS DISTINCT FROM current_price_minor AS a, lag(reported_regular_price_minor) OVER w IS DISTINCT FROM reported_regular_price_minor AS b, lag(is_promotion) OVER w IS DISTINCT FROM is_promotion AS c, lag(availability) OVER w IS DISTINCT FROM availability AS d FROM state WINDOW w AS (PARTITION BY product_id, location_id ORDER BY valid_from_utc))
SELECT product_id, location_id, CAST(floor(epoch(valid_from_utc)) AS BIGINT) AS at_epoch, CASE WHEN f THEN 'initial' WHEN a::INT + b::INT + c::INT + d::INT > 1 THEN 'multiple' WHEN a THEN 'price' WHEN b THEN 'regular' WHEN c THEN 'promotion' ELSE 'availability' END AS change_class,
CASE WHEN f THEN '' ELSE concat_ws(',', CASE WHEN a THEN 'current_price_minor' END, CASE WHEN b THEN 'reported_regular_price_minor' END, CASE WHEN c THEN 'is_promotion' END, CASE WHEN d THEN 'availability' END) END AS changed_fields FROM x WHERE f OR a OR b OR c OR d""")
def st_classified_changes(spark, sf):
    kinds = {"current_price_minor": "price", "reported_regular_price_minor": "regular", "is_promotion": "promotion", "availability": "availability"}
    c = changes.classified_changes(_state(spark, sf), KEY, "valid_from_utc", kinds)
    return c.select(*KEY, F.unix_timestamp("valid_from_utc").alias("at_epoch"), "change_class", "changed_fields")


@query("""WITH p AS (SELECT DISTINCT product_id, location_id, valid_from_utc, valid_to_utc FROM price_history), x AS (SELECT *, lead(valid_from_utc) OVER (PARTITION BY product_id, location_id ORDER BY valid_from_utc, valid_to_utc NULLS FIRST) AS nx FROM p),
f AS (SELECT product_id, location_id, count(*) AS n_periods, count(*) FILTER (WHERE nx IS NOT NULL AND valid_to_utc IS DISTINCT FROM nx) AS n_gaps, count(*) FILTER (WHERE valid_to_utc IS NULL) AS n_open FROM x GROUP BY 1, 2)
SELECT location_id, count(*) AS n_chains, CAST(sum(n_periods) AS BIGINT) AS n_periods, count(*) FILTER (WHERE n_open <> 1) AS not_one_open, CAST(sum(n_open) AS BIGINT) AS n_open FROM f GROUP BY 1""")
def st_chain_faults(spark, sf):
    """The loader's provisional periods, audited: chains without exactly one open period."""
    p = read_table(spark, sf, "price_history", *KEY, "valid_from_utc", "valid_to_utc").distinct()
    f = changes.chain_faults(p, KEY, "valid_from_utc", "valid_to_utc")
    return f.groupBy("location_id").agg(F.count("*").alias("n_chains"), F.sum("n_periods").alias("n_periods"), F.count_if(F.expr("n_open <> 1")).alias("not_one_open"), F.sum("n_open").alias("n_open"))


@query(f"""WITH {_STATE}, o AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY observed_at_utc DESC, scrape_run_id DESC) AS n FROM runs), d AS (SELECT s.* FROM state s JOIN o USING (scrape_run_id) WHERE o.n = 1), e AS (SELECT s.* FROM state s JOIN o USING (scrape_run_id) WHERE o.n = 2)
SELECT coalesce(d.location_id, e.location_id) AS location_id, CASE WHEN e.product_id IS NULL THEN 'insert' WHEN d.product_id IS NULL THEN 'retire' WHEN d.current_price_minor IS NOT DISTINCT FROM e.current_price_minor AND d.reported_regular_price_minor IS NOT DISTINCT FROM e.reported_regular_price_minor AND d.is_promotion IS NOT DISTINCT FROM e.is_promotion AND d.availability IS NOT DISTINCT FROM e.availability THEN 'unchanged' ELSE 'update' END AS action, count(*) AS n
FROM d FULL JOIN e ON d.product_id = e.product_id AND d.location_id = e.location_id GROUP BY 1, 2""")
def s_diff_plan(spark, sf):
    """What turns each location's last but one snapshot into its last."""
    w = W.partitionBy("location_id").orderBy(F.desc("observed_at_utc"), F.desc("scrape_run_id"))
    runs = _runs(spark, sf).select("scrape_run_id", F.row_number().over(w).alias("n")).where("n <= 2")
    s = _state(spark, sf).join(runs, "scrape_run_id")
    return changes.diff_plan(s.where("n = 1"), s.where("n = 2"), KEY, snapshots.STATE).groupBy("location_id", "action").agg(F.count("*").alias("n"))


@query(f"""WITH {_STATE}, o AS (SELECT *, row_number() OVER (PARTITION BY location_id ORDER BY observed_at_utc DESC, scrape_run_id DESC) AS n FROM runs), d AS (SELECT s.location_id, s.product_id, s.current_price_minor AS p FROM state s JOIN o USING (scrape_run_id) WHERE o.n = 1), e AS (SELECT s.location_id, s.product_id, s.current_price_minor AS p FROM state s JOIN o USING (scrape_run_id) WHERE o.n = 2)
SELECT coalesce(d.location_id, e.location_id) AS location_id, count(*) FILTER (WHERE d.product_id IS NOT NULL AND e.product_id IS NOT NULL) AS n_common, count(*) FILTER (WHERE e.product_id IS NULL) AS n_added, count(*) FILTER (WHERE d.product_id IS NULL) AS n_removed, count(*) FILTER (WHERE d.p <> e.p) AS n_changed, coalesce(CAST(sum(d.p - e.p) AS BIGINT), 0) AS basket_delta FROM d FULL JOIN e ON d.product_id = e.product_id AND d.location_id = e.location_id GROUP BY 1""")
def j_run_comparison(spark, sf):
    """Common, added, removed and repriced products of each location's last two snapshots."""
    w = W.partitionBy("location_id").orderBy(F.desc("observed_at_utc"), F.desc("scrape_run_id"))
    runs = _runs(spark, sf).select("scrape_run_id", F.row_number().over(w).alias("n")).where("n <= 2")
    s = _state(spark, sf).join(runs, "scrape_run_id")
    # one grouping instead of a full outer join: a product has at most one row per run
    g = s.groupBy("location_id", "product_id").agg(F.count_if(F.expr("n = 1")).alias("now"), F.count_if(F.expr("n = 2")).alias("before"), F.max(F.when(F.col("n") == 1, F.col("current_price_minor"))).alias("p1"), F.max(F.when(F.col("n") == 2, F.col("current_price_minor"))).alias("p2"))
    return g.groupBy("location_id").agg(F.count_if(F.expr("now = 1 and before = 1")).alias("n_common"), F.count_if(F.expr("before = 0")).alias("n_added"), F.count_if(F.expr("now = 0")).alias("n_removed"), F.count_if(F.expr("p1 <> p2")).alias("n_changed"), F.coalesce(F.sum(F.col("p1") - F.col("p2")), F.lit(0)).alias("basket_delta"))


@query(f"""WITH {_STATE}, b AS (SELECT scrape_run_id, product_id // 4096 AS block, sha256(string_agg(CAST(product_id AS VARCHAR) || ':' || coalesce(CAST(current_price_minor AS VARCHAR), ''), ',' ORDER BY product_id)) AS d, count(*) AS n FROM state GROUP BY 1, 2)
SELECT scrape_run_id, sha256(scrape_run_id || '|' || string_agg(d, ',' ORDER BY block)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n_rows FROM b GROUP BY 1""")
def h_run_fingerprints(spark, sf):
    """Order-independent digest of every accepted run: digests of blocks of 4,096 ids, then
    one digest over the blocks, so that no run is gathered in one task."""
    s = _state(spark, sf)
    line = F.struct("product_id", F.concat(F.col("product_id").cast("string"), F.lit(":"), F.coalesce(F.col("current_price_minor").cast("string"), F.lit(""))).alias("t"))
    b = s.groupBy("scrape_run_id", F.floor(F.col("product_id") / 4096).alias("block")).agg(F.array_sort(F.collect_list(line)).alias("rows"))
    b = b.select("scrape_run_id", F.struct("block", F.sha2(F.array_join(F.transform("rows", lambda r: r["t"]), ","), 256).alias("d")).alias("d"), F.size("rows").cast("long").alias("n"))
    g = b.groupBy("scrape_run_id").agg(F.array_sort(F.collect_list("d")).alias("ds"), F.sum("n").alias("n_rows"))
    return g.select("scrape_run_id", F.sha2(F.concat_ws("|", "scrape_run_id", F.array_join(F.transform("ds", lambda d: d["d"]), ",")), 256).alias("fingerprint"), "n_rows")


# ---- groupings -------------------------------------------------------------------------
@query("""WITH x AS (SELECT category, net_content_unit AS unit, try_cast(replace(trim(net_content_value), ',', '.') AS DOUBLE) AS v FROM master_products), y AS (SELECT * FROM x WHERE v > 0 AND unit IS NOT NULL)
SELECT coalesce(category, '(all)') AS category, unit, count(*) AS n, list_sort(list(v))[count(*) // 2 + 1] AS upper_median, GROUPING(category) AS all_categories FROM y WHERE category IS NOT NULL GROUP BY GROUPING SETS ((category, unit), (unit)) HAVING count(*) >= 8""")
def a_unit_medians(spark, sf):
    """Upper median content by (category, unit) and by unit alone."""
    m = read_table(spark, sf, "master_products", "category", "net_content_unit", "net_content_value")
    v = F.regexp_replace(F.trim("net_content_value"), ",", ".").try_cast("double")
    x = m.select("category", F.col("net_content_unit").alias("unit"), v.alias("v")).where("v > 0 and unit is not null and category is not null")
    g = ranking.upper_medians(x, "category", "unit", "v").where("n >= 8")
    return g.select(F.coalesce("category", F.lit("(all)")).alias("category"), "unit", "n", "upper_median", F.col("all_outer").alias("all_categories"))


@query("""SELECT coalesce(supermarket_id, '(all)') AS supermarket_id, coalesce(source_key_type, '(all)') AS source_key_type, count(*) AS n, count(ean) AS n_ean, GROUPING(supermarket_id, source_key_type) AS level FROM products GROUP BY ROLLUP (supermarket_id, source_key_type)""")
def a_rollup_coverage(spark, sf):
    p = read_table(spark, sf, "products", "supermarket_id", "source_key_type", "ean")
    r = p.rollup("supermarket_id", "source_key_type").agg(F.count("*").alias("n"), F.count("ean").alias("n_ean"), F.grouping_id().alias("level"))
    return r.select(F.coalesce("supermarket_id", F.lit("(all)")).alias("supermarket_id"), F.coalesce("source_key_type", F.lit("(all)")).alias("source_key_type"), "n", "n_ean", "level")


@query("""SELECT location_id, count(*) FILTER (WHERE availability = 'in_stock') AS in_stock, count(*) FILTER (WHERE availability = 'out_of_stock') AS out_of_stock, count(*) FILTER (WHERE availability = 'unknown') AS "unknown" FROM price_history GROUP BY 1""")
def a_availability_pivot(spark, sf):
    kinds = ["in_stock", "out_of_stock", "unknown"]
    h = read_table(spark, sf, "price_history", "location_id", "availability")
    return h.groupBy("location_id").pivot("availability", kinds).count().na.fill(0, kinds)


@query("""SELECT l.location_id, k.kind AS run_status, count(r.scrape_run_id) AS n_runs FROM (SELECT DISTINCT location_id FROM locations) l, (VALUES ('success'), ('rejected'), ('failed')) k(kind) LEFT JOIN (SELECT DISTINCT scrape_run_id, location_id, run_status FROM scrape_runs) r ON r.location_id = l.location_id AND r.run_status = k.kind GROUP BY 1, 2""")
def a_zero_filled_runs(spark, sf):
    """Runs per location and status with explicit zeros; the statuses are a constant list."""
    loc = read_table(spark, sf, "locations", "location_id").distinct()
    grid = loc.withColumn("run_status", F.explode(F.array(F.lit("success"), F.lit("rejected"), F.lit("failed"))))
    runs = read_table(spark, sf, "scrape_runs", "scrape_run_id", "location_id", "run_status").distinct()
    return grid.join(runs.groupBy("location_id", "run_status").agg(F.count("*").alias("n")), ["location_id", "run_status"], "left").select("location_id", "run_status", F.coalesce("n", F.lit(0)).alias("n_runs"))


@query(f"""WITH {_CUR} SELECT p.supermarket_id, count(DISTINCT c.product_id) AS products, count(*) AS offers, avg(c.current_price_minor) AS avg_price, avg(c.current_price_minor) FILTER (WHERE c.is_promotion) AS avg_promo_price, CAST(sum(c.reported_regular_price_minor - c.current_price_minor) FILTER (WHERE c.reported_regular_price_minor > c.current_price_minor) AS BIGINT) AS declared_saving, count(*) FILTER (WHERE c.is_promotion) * 1.0 / nullif(count(c.is_promotion), 0) AS promo_share
FROM cur c JOIN products p ON c.product_id = p.product_id GROUP BY 1""")
def a_measures(spark, sf):
    c = _current(spark, sf).join(read_table(spark, sf, "products", "product_id", "supermarket_id"), "product_id")
    saving = F.when(F.col("reported_regular_price_minor") > F.col("current_price_minor"), F.col("reported_regular_price_minor") - F.col("current_price_minor"))
    return c.groupBy("supermarket_id").agg(F.count_distinct("product_id").alias("products"), F.count("*").alias("offers"), F.avg("current_price_minor").alias("avg_price"), F.avg(F.when(F.col("is_promotion"), F.col("current_price_minor"))).alias("avg_promo_price"), F.sum(saving).alias("declared_saving"), F.try_divide(F.count_if("is_promotion"), F.count("is_promotion")).alias("promo_share"))


@query("""WITH x AS (SELECT category, net_content_unit AS unit, count(*) AS n FROM master_products WHERE category IS NOT NULL AND net_content_unit IS NOT NULL GROUP BY 1, 2) SELECT category, max_by(unit, (n, unit)) AS modal_unit, max(n) AS n_modal, CAST(sum(n) AS BIGINT) AS n_all, max(n) * 2 > sum(n) AS is_majority FROM x GROUP BY 1""")
def a_modal_unit(spark, sf):
    m = read_table(spark, sf, "master_products", "category", "net_content_unit").where("category is not null and net_content_unit is not null")
    n = m.groupBy("category", F.col("net_content_unit").alias("unit")).agg(F.count("*").alias("n"))
    return n.groupBy("category").agg(F.max_by("unit", F.struct("n", "unit")).alias("modal_unit"), F.max("n").alias("n_modal"), F.sum("n").alias("n_all")).withColumn("is_majority", F.col("n_modal") * 2 > F.col("n_all"))


@query(f"""WITH b AS (SELECT l.master_product_id, CASE l.link_method WHEN 'manual_review' THEN 0 WHEN 'reviewed_decision' THEN 1 WHEN 'gtin_exact' THEN 2 WHEN 'gtin_sku_derived' THEN 3 ELSE 4 END AS tier, {_FOLD.format("p.brand")} AS brand FROM master_product_links l JOIN products p ON l.product_id = p.product_id WHERE l.status = 'active'),
c AS (SELECT master_product_id, tier, brand, count(*) AS votes FROM b WHERE brand IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY master_product_id ORDER BY tier, votes DESC, brand) AS n, sum(votes) OVER (PARTITION BY master_product_id) AS all_votes FROM c)
SELECT master_product_id, brand, tier AS best_tier, votes, CAST(all_votes AS BIGINT) AS all_votes FROM r WHERE n = 1""")
def a_brand_vote(spark, sf):
    p = read_table(spark, sf, "products", "product_id", "brand").select("product_id", text.fold(F.col("brand")).alias("brand"))
    links = read_table(spark, sf, "master_product_links", "product_id", "master_product_id", "link_method", "status").where("status = 'active'")
    m = F.col("link_method")
    tier = F.when(m == "manual_review", 0).when(m == "reviewed_decision", 1).when(m == "gtin_exact", 2).when(m == "gtin_sku_derived", 3).otherwise(4)
    return ranking.vote(links.select("product_id", "master_product_id", tier.alias("tier")).join(p, "product_id"), "master_product_id", "brand", "tier")


@query("SELECT product_id, location_id, valid_from_utc IS NULL AS no_time, count(*) AS n_rows, count(DISTINCT loaded_at_utc) AS n_loads FROM price_history GROUP BY product_id, location_id, valid_from_utc HAVING count(*) > 1")
def q_repeated_keys(spark, sf):
    h = read_table(spark, sf, "price_history", *KEY, "valid_from_utc", "loaded_at_utc")
    g = h.groupBy(*KEY, "valid_from_utc").agg(F.count("*").alias("n_rows"), F.count_distinct("loaded_at_utc").alias("n_loads")).where("n_rows > 1")
    return g.select(*KEY, F.col("valid_from_utc").isNull().alias("no_time"), "n_rows", "n_loads")


_WILSON = "round(({s} / {n} + 1.9208 / {n} - 1.96 * sqrt({s} / {n} * (1 - {s} / {n}) / {n} + 0.9604 / ({n} * {n}))) / (1 + 3.8416 / {n}), 6)"


@query(f"""WITH x AS (SELECT link_method, status <> 'rejected' AS ok FROM master_product_links), g AS (SELECT coalesce(link_method, '(all)') AS link_method, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE ok) AS DOUBLE) AS s FROM x GROUP BY ROLLUP (link_method))
SELECT link_method, CAST(n AS BIGINT) AS n, CAST(s AS BIGINT) AS n_kept, round(s / n, 6) AS kept_share, {_WILSON.format(s="s", n="n")} AS wilson_lower FROM g""")
def a_wilson_by_method(spark, sf):
    """Kept share of links with its Wilson lower bound, per method and overall."""
    x = read_table(spark, sf, "master_product_links", "link_method", "status")
    g = x.rollup("link_method").agg(F.count("*").alias("n"), F.count_if(F.expr("status <> 'rejected'")).alias("n_kept"))
    n, s = F.col("n").cast("double"), F.col("n_kept").cast("double")
    low = (s / n + 1.9208 / n - 1.96 * F.sqrt(s / n * (1 - s / n) / n + 0.9604 / (n * n))) / (1 + 3.8416 / n)
    return g.select(F.coalesce("link_method", F.lit("(all)")).alias("link_method"), "n", "n_kept", F.round(s / n, 6).alias("kept_share"), F.round(low, 6).alias("wilson_lower"))


# ---- top-k, search, samples, chunks ----------------------------------------------------
@query(f"""WITH {_VERSIONED_SQL}, x AS (SELECT *, lag(current_price_minor) OVER (PARTITION BY product_id, location_id ORDER BY valid_from_epoch) AS previous FROM v), c AS (SELECT product_id, location_id, valid_from_epoch, {_pct("current_price_minor - previous", "previous")} AS change_pct FROM x WHERE previous > 0 AND current_price_minor IS NOT NULL AND current_price_minor <> previous),
r AS (SELECT *, 'drop' AS list_name, row_number() OVER (ORDER BY change_pct, product_id, location_id, valid_from_epoch) AS place FROM c UNION ALL SELECT *, 'rise', row_number() OVER (ORDER BY change_pct DESC, product_id, location_id, valid_from_epoch) FROM c) SELECT * FROM r WHERE place <= 12""")
def t_largest_changes(spark, sf):
    """The twelve largest drops and rises (a top-k report)."""
    v = versions.versions(_state(spark, sf), KEY, "valid_from_utc", VERSIONED)
    p = v.select(*KEY, F.unix_timestamp("valid_from").alias("valid_from_epoch"), F.col("current_price_minor").cast("long").alias("current_price_minor"))
    c = series.period_changes(p, KEY, "valid_from_epoch", "current_price_minor").where("previous > 0 and current_price_minor is not null and change <> 0").select(*KEY, "valid_from_epoch", "change_pct")
    rest = [F.col("product_id"), F.col("location_id"), F.col("valid_from_epoch")]
    lists = []
    for name, first in (("drop", F.asc("change_pct")), ("rise", F.desc("change_pct"))):
        top = c.orderBy(first, *rest).limit(12)  # k rows from each task, then k overall
        lists.append(top.select("*", F.lit(name).alias("list_name"), F.row_number().over(W.partitionBy(F.lit(1)).orderBy(first, *rest)).alias("place")))
    return lists[0].unionByName(lists[1])


@query(f"""WITH w AS (SELECT product_id, supermarket_id, category, {_FOLD.format("name")} AS folded FROM products), h AS (SELECT *, CASE WHEN list_has_any(string_split(folded, ' ')[1:2], ['leche', 'entera']) THEN 0 ELSE 1 END AS tier FROM w WHERE list_has_all(string_split(folded, ' '), ['leche', 'entera'])) SELECT product_id, supermarket_id, folded, tier FROM h ORDER BY tier, folded, product_id LIMIT 60""")
def t_search(spark, sf):
    p = read_table(spark, sf, "products", "product_id", "supermarket_id", "name").select("product_id", "supermarket_id", text.fold(F.col("name")).alias("folded"))
    return ranking.search(p, "folded", ["leche", "entera"]).orderBy("tier", "folded", "product_id").limit(60)


@query("""WITH x AS (SELECT link_method, link_id, row_number() OVER (PARTITION BY link_method ORDER BY sha256(CAST(link_id AS VARCHAR))) AS place FROM master_product_links) SELECT * FROM x WHERE place <= 40""")
def t_stratified_sample(spark, sf):
    x = read_table(spark, sf, "master_product_links", "link_method", "link_id")
    return ranking.stratified(x, "link_method", F.col("link_id").cast("string"), 40).select("link_method", "link_id", "place")


@query("""WITH x AS (SELECT coalesce(category, '(none)') AS category, product_id, (row_number() OVER (PARTITION BY coalesce(category, '(none)') ORDER BY product_id) - 1) // 250 AS chunk FROM products) SELECT category, CAST(chunk AS INT) AS chunk, count(*) AS n_rows, min(product_id) AS first_id, max(product_id) AS last_id FROM x GROUP BY 1, 2""")
def sk_chunks(spark, sf):
    p = read_table(spark, sf, "products", "category", "product_id").withColumn("category", F.coalesce("category", F.lit("(none)")))
    return ranking.chunked(p, "category", "product_id", 250).groupBy("category", "chunk").agg(F.count("*").alias("n_rows"), F.min("product_id").alias("first_id"), F.max("product_id").alias("last_id"))


# ---- scalar functions ------------------------------------------------------------------
@query(f"SELECT product_id, {_FOLD.format('name')} AS folded, {_FOLD.format('brand')} AS brand_key, replace({_FOLD.format('category')}, ' ', '-') AS category_slug, substr({_FOLD.format('name')}, 1, 2) AS prefix FROM products")
def x_folded_text(spark, sf):
    p = read_table(spark, sf, "products", "product_id", "name", "brand", "category")
    return p.select("product_id", text.fold(F.col("name")).alias("folded"), text.fold(F.col("brand")).alias("brand_key"), text.slug(F.col("category")).alias("category_slug"), F.left(text.fold(F.col("name")), F.lit(2)).alias("prefix"))


@query(f"""WITH d AS (SELECT product_id, regexp_replace(coalesce(ean, ''), '[^0-9]', '', 'g') AS d FROM products), c AS (SELECT *, CASE WHEN length(d) IN (8, 12, 13, 14) THEN lpad(d, 14, '0') END AS g FROM d), v AS (SELECT product_id, CASE WHEN {_CHECK.format("g")} THEN g END AS gtin FROM c), n AS (SELECT *, CAST(gtin AS BIGINT) AS n FROM v),
w AS (SELECT *, CASE WHEN n >= 90000000000000 THEN 'variable_measure' WHEN n < 100000000 THEN CASE WHEN n // 10000000 IN (0, 2) THEN 'short_in_store' END WHEN n % 10000000000000 // 10000000000 BETWEEN 20 AND 29 THEN 'variable_measure_upc' WHEN n % 10000000000000 // 10000000000 BETWEEN 40 AND 49 THEN 'company_upc' WHEN n % 10000000000000 // 10000000000 BETWEEN 200 AND 299 THEN 'in_store' WHEN n % 10000000000000 // 10000000000 >= 980 THEN 'coupon' END AS reason FROM n)
SELECT product_id, gtin, CASE WHEN gtin IS NULL THEN 'invalid' WHEN n < 100000000 THEN 'ean_8' WHEN n < 1000000000000 THEN 'upc_a' WHEN n < 10000000000000 THEN 'ean_13' ELSE 'gtin_14' END AS kind, reason, CASE WHEN gtin IS NOT NULL THEN reason IS NOT NULL END AS restricted FROM w""")
def h_gtins(spark, sf):
    g = read_table(spark, sf, "products", "product_id", "ean").select("product_id", G.canonical_gtin(F.col("ean")).alias("gtin"))
    return g.select("*", G.gtin_kind(F.col("gtin")).alias("kind"), G.restricted_reason(F.col("gtin")).alias("reason"), G.restricted(F.col("gtin")).alias("restricted"))


@query("""SELECT product_id, CASE WHEN trim(source_item_id) <> '' THEN 'item' WHEN trim(reference) <> '' THEN 'reference' WHEN trim(ean) <> '' THEN 'barcode' END AS key_kind, coalesce(nullif(trim(source_item_id), ''), nullif(trim(reference), ''), nullif(trim(ean), '')) AS key_value,
'src_' || substr(sha256(concat_ws('|', supermarket_id, source_key_type, source_key)), 1, 16) AS source_id, CASE WHEN ('0x' || substr(sha256(concat_ws('|', supermarket_id, source_key_type, source_key)), 1, 8))::UBIGINT % 10 < 6 THEN 'train' WHEN ('0x' || substr(sha256(concat_ws('|', supermarket_id, source_key_type, source_key)), 1, 8))::UBIGINT % 10 < 8 THEN 'validation' ELSE 'test' END AS split FROM products""")
def h_ids(spark, sf):
    p = read_table(spark, sf, "products", "product_id", "supermarket_id", "source_key_type", "source_key", "source_item_id", "reference", "ean")
    kind, value = ids.first_key(("item", F.col("source_item_id")), ("reference", F.col("reference")), ("barcode", F.col("ean")))
    natural = F.concat_ws("|", "supermarket_id", "source_key_type", "source_key")
    return p.select("product_id", kind.alias("key_kind"), value.alias("key_value"), ids.hashed("src_", natural).alias("source_id"), ids.split_of(natural).alias("split"))


@query("""SELECT scrape_run_id, CAST(CAST(observed_at_utc AT TIME ZONE 'UTC' - INTERVAL 6 HOUR AS DATE) AS VARCHAR) AS local_day, sku_count, CASE WHEN catalog_product_count > 0 THEN ((abs(sku_count - catalog_product_count) * 10000) // catalog_product_count + CASE WHEN (abs(sku_count - catalog_product_count) * 10000) % catalog_product_count * 2 > catalog_product_count OR ((abs(sku_count - catalog_product_count) * 10000) % catalog_product_count * 2 = catalog_product_count AND (abs(sku_count - catalog_product_count) * 10000) // catalog_product_count % 2 = 1) THEN 1 ELSE 0 END) * sign(sku_count - catalog_product_count) / 100.0 END AS surplus_pct FROM (SELECT DISTINCT scrape_run_id, observed_at_utc, CAST(sku_count AS BIGINT) AS sku_count, CAST(catalog_product_count AS BIGINT) AS catalog_product_count FROM scrape_runs)""")
def m_dates_and_rounding(spark, sf):
    r = read_table(spark, sf, "scrape_runs", "scrape_run_id", "observed_at_utc", F.col("sku_count").cast("long").alias("sku_count"), F.col("catalog_product_count").cast("long").alias("catalog_product_count")).distinct()
    return r.select("scrape_run_id", F.to_date(F.col("observed_at_utc") - F.expr("interval 6 hours")).cast("string").alias("local_day"), "sku_count", pct_half_even(F.col("sku_count") - F.col("catalog_product_count"), F.col("catalog_product_count")).alias("surplus_pct"))


@query(f"""WITH b AS (SELECT product_id, {_FOLD.format("name")} AS f FROM products), w AS (SELECT product_id, list_distinct(string_split(f, ' ')) AS ws FROM b WHERE f IS NOT NULL), u AS (SELECT product_id, unnest(ws) AS word FROM w), d AS (SELECT word, count(*) AS df FROM u GROUP BY 1), n AS (SELECT count(*) AS n FROM w)
SELECT word, df, round(ln((1.0 + n.n) / (1.0 + df)) + 1, 6) AS idf FROM d, n""")
def x_word_weights(spark, sf):
    """Document frequency and smoothed inverse document frequency of every name word."""
    p = read_table(spark, sf, "products", "product_id", "name").select("product_id", text.fold(F.col("name")).alias("f")).where("f is not null")
    d = p.select(F.explode(F.array_distinct(F.split("f", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    n = p.count()  # one number
    return d.select("word", "df", F.round(F.log((1.0 + n) / (1.0 + F.col("df"))) + 1, 6).alias("idf"))
