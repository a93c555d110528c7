"""Queries of the catalogue operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almudi.core.runtime import read_table
from almudi.functions import gtin as G
from almudi.functions import text
from almudi.operators import catalogue as C
from almudi.functions.rounding import pct_half_up
from almudi.operators import current, ranking, snapshots
from almudi.plans.reference_queries import _CHECK, _CUR, _EAN, _FOLD, _STATE, _pct


def _state(spark: SparkSession, sf: str) -> DataFrame:
    h = read_table(spark, sf, "price_history", "product_id", "location_id", "valid_from_utc", "loaded_at_utc", "scrape_run_id", *snapshots.STATE)
    return snapshots.state_rows(h, read_table(spark, sf, "scrape_runs"))


def pf_collapsed_titles(spark, sf):
    """Per chain and folded title the listing with an ean first, then the least id."""
    p = read_table(spark, sf, "products", "product_id", "supermarket_id", "name", "ean").withColumn("title", text.fold(F.col("name")))
    c = C.collapse(p, ["supermarket_id", "title"], [F.col("ean").isNull().cast("int"), F.col("product_id")], F.col("ean").isNotNull())
    return c.select("supermarket_id", "title", "product_id", "n_variants")


def sk_prefix_length(spark, sf):
    return C.unique_prefix_length(read_table(spark, sf, "master_products", "master_product_id"), "master_product_id", 4, 23)


def x_urls_and_codes(spark, sf):
    p = read_table(spark, sf, "products", "product_id", "supermarket_id", "source_key")
    url = F.concat(F.lit("HTTPS://Shop."), F.col("supermarket_id"), F.lit(".HN/p/"), F.col("source_key"), F.lit("/?utm_source=x&id="), F.col("product_id"), F.lit("&gclid=7#top"))
    return p.select("product_id", C.canonical_url(url).alias("url"), C.upc_e_to_a(F.concat(F.lit("0"), F.lpad((F.col("product_id") % 10000000).cast("string"), 7, "0"))).alias("upc_a"))


def h_membership_sets(spark, sf):
    """Each location's current product keys as compressed, digest-guarded values (blocks of
    4,096 ids, so that none grows with the location), decoded again."""
    c = current.current_rows(_state(spark, sf)).select("location_id", F.floor(F.col("product_id") / 4096).alias("block"), F.col("product_id").cast("string").alias("k"))
    e = c.groupBy("location_id", "block").agg(F.collect_list("k").alias("keys")).select("location_id", C.encode_keys("keys").alias("e"))
    d = e.select("location_id", C.decode_keys("e.payload", "e.sha").alias("keys"))
    return d.groupBy("location_id").agg(F.sum(F.size("keys").cast("long")).alias("n_keys"), F.min(F.array_min("keys")).alias("first_key"), F.max(F.array_max("keys")).alias("last_key"))


def s_reconciled_products(spark, sf):
    """Product ids of listings, price rows and links: which sides hold them, counted."""
    sides = {n: read_table(spark, sf, n, "product_id").distinct() for n in ("products", "price_history", "master_product_links")}
    return C.reconcile(sides, "product_id").groupBy("held_by").agg(F.count("*").alias("n"))


def st_upserted_decisions(spark, sf):
    """Size decisions put over the contents of master products, by GTIN in any notation."""
    m = read_table(spark, sf, "master_products", "master_product_id", "primary_gtin", "net_content_value", "net_content_unit")
    digits = G.digits(F.col("primary_gtin"))
    base = m.where(F.length(digits).between(1, 14)).groupBy(F.lpad(digits, 14, "0").alias("gtin")).agg(F.min_by(F.struct("net_content_value", "net_content_unit"), "master_product_id").alias("v")).select("gtin", "v.*")
    s = read_table(spark, sf, "size_decisions", F.col("canonical_gtin").alias("gtin"), "net_content_value", "net_content_unit").where("net_content_value is not null")
    return C.upsert(base, s, ["gtin"], ["net_content_value", "net_content_unit"])


def st_episodes(spark, sf):
    e = C.episodes(_state(spark, sf), ["product_id", "location_id"], "valid_from_utc", F.col("current_price_minor").isNotNull())
    return e.select("product_id", "location_id", F.unix_timestamp("first_seen").alias("first_seen"), F.unix_timestamp("last_seen").alias("last_seen"), F.coalesce(F.unix_timestamp("priced_since"), F.lit(0)).alias("priced_since"), "n_unpriced")


def d_gtin_conflicts(spark, sf):
    """Trade item numbers whose listings disagree in brand or chain."""
    p = read_table(spark, sf, "products", "supermarket_id", "ean", "brand").select(G.canonical_gtin(F.col("ean")).alias("gtin"), text.fold(F.col("brand")).alias("brand"), "supermarket_id").where("gtin is not null")
    return C.group_conflicts(p, "gtin", ["brand", "supermarket_id"])


def d_link_cliques(spark, sf):
    """Masters whose linked products all share one chain pairwise (pairs by equal chain)."""
    links = read_table(spark, sf, "master_product_links", "master_product_id", "product_id", "supermarket_id", "status").where("status = 'active'").drop("status").distinct()
    n = links.groupBy("master_product_id", "supermarket_id").agg(F.count_distinct("product_id").alias("n"))
    return n.groupBy("master_product_id").agg(F.sum("n").alias("n"), F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias("n_pairs")).withColumn("is_clique", F.col("n_pairs") == F.col("n") * (F.col("n") - 1) / 2)


def q_audit(spark, sf):
    """Problems of listings, counted by chain."""
    p = read_table(spark, sf, "products", "product_id", "supermarket_id", "ean", "brand", "presentation", "category", "name")
    problems = {"no_ean": F.col("ean").isNull(), "bad_ean": F.col("ean").isNotNull() & G.canonical_gtin(F.col("ean")).isNull(), "no_brand": F.coalesce(text.fold(F.col("brand")), F.lit("")) == "", "no_size": ~F.coalesce("presentation", F.lit("")).rlike("[0-9]"), "no_category": F.col("category").isNull(), "all_capitals": F.col("name") == F.upper("name")}
    return C.audit(p, ["product_id", "supermarket_id"], problems).groupBy("supermarket_id", "problem").agg(F.count("*").alias("n"))


def x_brand_lexicon(spark, sf):
    return C.brand_lexicon(read_table(spark, sf, "products", "brand").select(text.fold(F.col("brand")).alias("brand")), "brand")


def sc_columnar_round_trip(spark, sf):
    """Listings written as dictionary-like columnar JSON, one document per chain, and decoded."""
    p = read_table(spark, sf, "products", "product_id", "supermarket_id", "category")
    row = F.array(F.col("product_id").cast("string"), F.col("category"))
    # documents are chunks of 250 rows: none grows with the catalogue
    chunk = F.floor(F.col("product_id") / 250)
    docs = p.groupBy("supermarket_id", chunk.alias("c")).agg(F.to_json(F.struct(F.array(F.lit("product_id"), F.lit("category")).alias("columns"), F.collect_list(row).alias("rows"))).alias("doc"))
    return C.decode_columnar(docs, "doc", {"product_id": "bigint", "category": "string", "absent": "string"})


def _cheapest(spark, sf):
    """Lowest current price per product, with category."""
    c = current.current_rows(_state(spark, sf)).where("current_price_minor > 0").groupBy("product_id").agg(F.min("current_price_minor").alias("price"))
    return c.join(read_table(spark, sf, "products", "product_id", "category").where("category is not null"), "product_id")


def t_alternatives(spark, sf):
    """Per category the six cheapest products within a sixth and six times its median price
    (a top-k report)."""
    c = _cheapest(spark, sf)
    mid = c.groupBy("category").agg(F.percentile("price", 0.5).alias("mid"))
    near = c.join(mid, "category").where((F.col("price") * 6 >= F.col("mid")) & (F.col("price") <= F.col("mid") * 6))
    return ranking.top_per_group(near, ["category"], [F.col("price"), F.col("product_id")], 6).select("category", "place", "product_id", "price", "mid")


def t_disjoint_lists(spark, sf):
    """Twenty listings with the most distinct prices, then twenty of the others with the most
    locations (top-k reports that share no listing)."""
    g = _state(spark, sf).groupBy("product_id").agg(F.count_distinct("current_price_minor").alias("n_prices"), F.count_distinct("location_id").alias("n_locations"))
    first = g.orderBy(F.desc("n_prices"), "product_id").limit(20)
    second = g.join(first.select("product_id"), "product_id", "left_anti").orderBy(F.desc("n_locations"), "product_id").limit(20)
    return first.select(F.lit("prices").alias("list_name"), "product_id").unionByName(second.select(F.lit("locations").alias("list_name"), "product_id"))


def q_run_coverage(spark, sf):
    """Products delivered by each accepted run against the count it reported."""
    r = read_table(spark, sf, "scrape_runs", "scrape_run_id", "run_status", "sku_count").where("run_status = 'success'").groupBy("scrape_run_id").agg(F.max("sku_count").cast("long").alias("reported"))
    n = read_table(spark, sf, "price_history", "scrape_run_id", "product_id").groupBy("scrape_run_id").agg(F.count_distinct("product_id").alias("delivered"))
    d = F.coalesce("delivered", F.lit(0))
    return r.join(n, "scrape_run_id", "left").select("scrape_run_id", "reported", d.alias("delivered"), pct_half_up(d, F.col("reported")).alias("coverage_pct"))


def u_size_buckets(spark, sf):
    """Logarithmic size buckets (steps of five percent) of master contents, counted."""
    m = read_table(spark, sf, "master_products", "net_content_value", "net_content_unit")
    v = F.regexp_replace(F.trim("net_content_value"), ",", ".").try_cast("double")
    return m.select("net_content_unit", v.alias("v")).where("v > 0").groupBy(F.coalesce("net_content_unit", F.lit("")).alias("unit"), F.floor(F.log(F.col("v")) / 0.05).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


def x_split_stems(spark, sf):
    """Names with glued words split, and the stem of their last word."""
    p = read_table(spark, sf, "products", "product_id", "name")
    last = F.element_at(F.split(text.fold(F.col("name")), " "), -1)
    return p.select("product_id", text.split_glued(F.col("name")).alias("split_name"), text.plural_stem(last).alias("last_stem"))


def sk_search_index(spark, sf):
    """One compact row per product: best current price, where it is, how widely it is sold."""
    c = current.current_rows(_state(spark, sf))
    g = c.groupBy("product_id").agg(F.min(F.when(F.col("current_price_minor") > 0, F.struct("current_price_minor", "location_id"))).alias("b"), F.count("*").alias("n_locations"), F.max(F.coalesce("is_promotion", F.lit(False))).alias("any_promotion"))
    p = read_table(spark, sf, "products", "product_id", "name").select("product_id", text.fold(F.col("name")).alias("folded"))
    return p.join(g, "product_id").select("product_id", "folded", F.col("b.current_price_minor").alias("best_price"), F.col("b.location_id").alias("best_location"), "n_locations", "any_promotion")


def a_age_buckets(spark, sf):
    """Current rows by chain and age in days at the latest accepted run of all."""
    c = current.current_rows(_state(spark, sf)).join(read_table(spark, sf, "locations", "location_id", "supermarket_id"), "location_id")
    age = F.floor((F.unix_timestamp(F.lit("2025-09-01 00:00:00").cast("timestamp")) - F.unix_timestamp("valid_from_utc")) / 86400)
    bucket = F.when(age < 0, "later").when(age <= 7, "week").when(age <= 30, "month").when(age <= 90, "quarter").otherwise("older")
    return c.groupBy("supermarket_id", bucket.alias("age")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (pf_collapsed_titles, sk_prefix_length, x_urls_and_codes, h_membership_sets, s_reconciled_products, st_upserted_decisions, st_episodes, d_gtin_conflicts, d_link_cliques, q_audit, x_brand_lexicon, sc_columnar_round_trip, t_alternatives, t_disjoint_lists, q_run_coverage, u_size_buckets, x_split_stems, sk_search_index, a_age_buckets)}

_UPC = "lpad(CAST(product_id % 10000000 AS VARCHAR), 7, '0')"
ORACLE = {
    "pf_collapsed_titles": f"WITH x AS (SELECT supermarket_id, {_FOLD.format('name')} AS title, product_id, ean FROM products), y AS (SELECT *, count(ean) OVER (PARTITION BY supermarket_id, title) AS n_variants, row_number() OVER (PARTITION BY supermarket_id, title ORDER BY ean IS NULL, product_id) AS n FROM x) SELECT supermarket_id, title, product_id, n_variants FROM y WHERE n = 1",
    "sk_prefix_length": "WITH x AS (SELECT DISTINCT master_product_id AS id FROM master_products), c AS (SELECT k, count(DISTINCT substr(id, 1, k)) AS d FROM x, range(4, 24) t(k) GROUP BY k) SELECT (SELECT count(*) FROM x) AS n, CAST(min(k) AS INT) AS prefix_length FROM c WHERE d = (SELECT count(*) FROM x)",
    "x_urls_and_codes": f"""SELECT product_id, 'https://shop.' || supermarket_id || '.hn/p/' || source_key || '?id=' || product_id AS url,
'0' || CASE WHEN substr({_UPC}, 6, 1) IN ('0', '1', '2') THEN substr({_UPC}, 1, 2) || substr({_UPC}, 6, 1) || '0000' || substr({_UPC}, 3, 3) WHEN substr({_UPC}, 6, 1) = '3' THEN substr({_UPC}, 1, 3) || '00000' || substr({_UPC}, 4, 2) WHEN substr({_UPC}, 6, 1) = '4' THEN substr({_UPC}, 1, 4) || '00000' || substr({_UPC}, 5, 1) ELSE substr({_UPC}, 1, 5) || '0000' || substr({_UPC}, 6, 1) END || substr({_UPC}, 7, 1) AS upc_a FROM products""",
    "h_membership_sets": f"WITH {_CUR} SELECT location_id, count(*) AS n_keys, min(CAST(product_id AS VARCHAR)) AS first_key, max(CAST(product_id AS VARCHAR)) AS last_key FROM cur GROUP BY 1",
    "s_reconciled_products": "WITH u AS (SELECT product_id, 'products' AS s FROM products UNION SELECT product_id, 'price_history' FROM price_history UNION SELECT product_id, 'master_product_links' FROM master_product_links), g AS (SELECT product_id, string_agg(s, ',' ORDER BY s) AS held_by FROM u WHERE product_id IS NOT NULL GROUP BY 1) SELECT held_by, count(*) AS n FROM g GROUP BY 1",
    "st_upserted_decisions": """WITH b AS (SELECT * FROM (SELECT lpad(regexp_replace(primary_gtin, '[^0-9]', '', 'g'), 14, '0') AS gtin, net_content_value AS v, net_content_unit AS u, row_number() OVER (PARTITION BY lpad(regexp_replace(primary_gtin, '[^0-9]', '', 'g'), 14, '0') ORDER BY master_product_id) AS n FROM master_products WHERE length(regexp_replace(primary_gtin, '[^0-9]', '', 'g')) BETWEEN 1 AND 14) WHERE n = 1), i AS (SELECT canonical_gtin AS gtin, net_content_value AS v, net_content_unit AS u FROM size_decisions WHERE net_content_value IS NOT NULL)
SELECT coalesce(i.gtin, b.gtin) AS gtin, CASE WHEN i.gtin IS NOT NULL THEN i.v ELSE b.v END AS net_content_value, CASE WHEN i.gtin IS NOT NULL THEN i.u ELSE b.u END AS net_content_unit, CASE WHEN b.gtin IS NULL THEN 'inserted' WHEN i.gtin IS NULL OR (i.v IS NOT DISTINCT FROM b.v AND i.u IS NOT DISTINCT FROM b.u) THEN 'kept' ELSE 'updated' END AS outcome FROM b FULL JOIN i ON b.gtin = i.gtin""",
    "st_episodes": f"WITH {_STATE} SELECT product_id, location_id, CAST(floor(epoch(min(valid_from_utc))) AS BIGINT) AS first_seen, CAST(floor(epoch(max(valid_from_utc))) AS BIGINT) AS last_seen, coalesce(CAST(floor(epoch(min(valid_from_utc) FILTER (WHERE current_price_minor IS NOT NULL))) AS BIGINT), 0) AS priced_since, count(*) FILTER (WHERE current_price_minor IS NULL) AS n_unpriced FROM state GROUP BY 1, 2",
    "d_gtin_conflicts": f"WITH e AS (SELECT {_EAN} AS gtin, {_FOLD.format('p.brand')} AS brand, supermarket_id FROM products p) SELECT gtin, count(*) AS n, concat_ws(',', CASE WHEN count(DISTINCT brand) > 1 THEN 'brand' END, CASE WHEN count(DISTINCT supermarket_id) > 1 THEN 'supermarket_id' END) AS conflicts FROM e WHERE gtin IS NOT NULL AND {_CHECK.format('gtin')} GROUP BY 1",
    "d_link_cliques": "WITH l AS (SELECT DISTINCT master_product_id, product_id, supermarket_id FROM master_product_links WHERE status = 'active'), n AS (SELECT master_product_id, CAST(count(*) AS BIGINT) AS n FROM l GROUP BY 1), p AS (SELECT a.master_product_id, count(*) AS n_pairs FROM l a JOIN l b ON a.master_product_id = b.master_product_id AND a.supermarket_id = b.supermarket_id AND a.product_id < b.product_id GROUP BY 1) SELECT n.master_product_id, n.n, coalesce(p.n_pairs, 0) AS n_pairs, coalesce(p.n_pairs, 0) = n.n * (n.n - 1) / 2 AS is_clique FROM n LEFT JOIN p ON n.master_product_id = p.master_product_id",
    "q_audit": f"""WITH e AS (SELECT p.*, {_EAN} AS g FROM products p), x AS (SELECT supermarket_id, unnest(list_filter([CASE WHEN ean IS NULL THEN 'no_ean' END, CASE WHEN ean IS NOT NULL AND NOT coalesce({_CHECK.format("g")}, false) THEN 'bad_ean' END, CASE WHEN {_FOLD.format("brand")} IS NULL THEN 'no_brand' END, CASE WHEN NOT regexp_matches(coalesce(presentation, ''), '[0-9]') THEN 'no_size' END, CASE WHEN category IS NULL THEN 'no_category' END, CASE WHEN name = upper(name) THEN 'all_capitals' END], lambda v: v IS NOT NULL)) AS problem FROM e) SELECT supermarket_id, problem, count(*) AS n FROM x GROUP BY 1, 2""",
    "x_brand_lexicon": f"WITH b AS (SELECT {_FOLD.format('brand')} AS spelling FROM products), n AS (SELECT spelling, replace(spelling, ' ', '') AS squashed, count(*) AS n FROM b WHERE spelling IS NOT NULL GROUP BY 1) SELECT squashed, min_by(spelling, (-n, spelling)) AS brand, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_spellings FROM n GROUP BY 1",
    "sc_columnar_round_trip": "SELECT product_id, category, CAST(NULL AS VARCHAR) AS absent FROM products",
    "t_alternatives": f"WITH {_CUR}, c AS (SELECT p.category, x.product_id, x.price FROM (SELECT product_id, min(current_price_minor) AS price FROM cur WHERE current_price_minor > 0 GROUP BY 1) x JOIN products p ON p.product_id = x.product_id WHERE p.category IS NOT NULL), m AS (SELECT category, median(price) AS mid FROM c GROUP BY 1), r AS (SELECT c.category, row_number() OVER (PARTITION BY c.category ORDER BY price, product_id) AS place, product_id, price, mid FROM c JOIN m ON c.category = m.category WHERE price * 6 >= mid AND price <= mid * 6) SELECT * FROM r WHERE place <= 6",
    "t_disjoint_lists": f"WITH {_STATE}, g AS (SELECT product_id, count(DISTINCT current_price_minor) AS np, count(DISTINCT location_id) AS nl FROM state GROUP BY 1), a AS (SELECT product_id FROM g ORDER BY np DESC, product_id LIMIT 20), b AS (SELECT product_id FROM g WHERE product_id NOT IN (SELECT product_id FROM a) ORDER BY nl DESC, product_id LIMIT 20) SELECT 'prices' AS list_name, product_id FROM a UNION ALL SELECT 'locations', product_id FROM b",
    "q_run_coverage": f"WITH r AS (SELECT scrape_run_id, CAST(max(sku_count) AS BIGINT) AS reported FROM scrape_runs WHERE run_status = 'success' GROUP BY 1), n AS (SELECT scrape_run_id, count(DISTINCT product_id) AS d FROM price_history GROUP BY 1) SELECT r.scrape_run_id, reported, coalesce(d, 0) AS delivered, {_pct('coalesce(d, 0)', 'reported')} AS coverage_pct FROM r LEFT JOIN n ON r.scrape_run_id = n.scrape_run_id",
    "u_size_buckets": "WITH x AS (SELECT coalesce(net_content_unit, '') AS unit, try_cast(replace(trim(net_content_value), ',', '.') AS DOUBLE) AS v FROM master_products) SELECT unit, CAST(floor(ln(v) / 0.05) AS BIGINT) AS bucket, count(*) AS n FROM x WHERE v > 0 GROUP BY 1, 2",
    "x_split_stems": f"""WITH x AS (SELECT product_id, regexp_replace(regexp_replace(regexp_replace(name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g') AS split_name, string_split({_FOLD.format("name")}, ' ')[-1] AS w FROM products)
SELECT product_id, split_name, CASE WHEN length(w) > 5 AND w LIKE '%es' THEN left(w, -2) WHEN length(w) > 4 AND w LIKE '%s' THEN left(w, -1) ELSE w END AS last_stem FROM x""",
    "sk_search_index": f"WITH {_CUR}, g AS (SELECT product_id, min(CASE WHEN current_price_minor > 0 THEN current_price_minor END) AS best_price, min_by(location_id, (current_price_minor, location_id)) FILTER (WHERE current_price_minor > 0) AS best_location, count(*) AS n_locations, bool_or(coalesce(is_promotion, false)) AS any_promotion FROM cur GROUP BY 1) SELECT p.product_id, {_FOLD.format('p.name')} AS folded, best_price, best_location, n_locations, any_promotion FROM products p JOIN g ON p.product_id = g.product_id",
    "a_age_buckets": f"WITH {_CUR}, x AS (SELECT l.supermarket_id, floor((epoch(TIMESTAMPTZ '2025-09-01 00:00:00+00') - floor(epoch(c.valid_from_utc))) / 86400) AS age FROM cur c JOIN locations l ON c.location_id = l.location_id) SELECT supermarket_id, CASE WHEN age < 0 THEN 'later' WHEN age <= 7 THEN 'week' WHEN age <= 30 THEN 'month' WHEN age <= 90 THEN 'quarter' ELSE 'older' END AS age, count(*) AS n FROM x GROUP BY 1, 2",
}
