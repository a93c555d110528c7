"""Queries of the general data problems (p1, p2, p3, p6, p7) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almudi.core.runtime import read_table
from almudi.operators import nested, quantities, references, snapshots, versions

VERSIONED = ("current_price_minor", "reported_regular_price_minor", "is_promotion")


# ---- 1: nested pages -> flat tables ----------------------------------------------------
def _flat(spark: SparkSession, sf: str) -> nested.FlatTables:
    return nested.FlatTables(read_table(spark, sf, "documents_6602"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf).table("price").select("page_id", "pid", "variant_pos", "skuid", "entry_pos", "price_minor", "availability")


def p1_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf).table("page")


def p1_documents(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf).table("document")


def p1_variants(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(spark, sf).table("variant")


def p1_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per table, and how many of them lack their parent row (none should)."""
    flat = _flat(spark, sf)
    parts = []
    for child, parent in (("document", "page"), ("variant", "document"), ("price", "variant")):
        parents = flat.table(parent).select(F.col("pk").alias("parent_pk"), F.lit(True).alias("has_parent"))
        rows = flat.table(child).select("parent_pk").join(parents, "parent_pk", "left")
        parts.append(rows.agg(F.lit(child).alias("table_name"), F.count("*").alias("n_rows"), F.count_if(F.col("has_parent").isNull()).alias("n_orphans")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# ---- 2: references to records that do not exist ----------------------------------------
def _orphans(spark: SparkSession, sf: str) -> tuple[DataFrame, list[Child]]:
    from almudi.operators.references import Child, Parent

    history = read_table(spark, sf, "price_history", "product_id", "valid_from_utc")
    links = read_table(spark, sf, "master_product_links", "master_product_id", "decided_at_utc", "status")
    children = [
        Child("price_history", history, "products", "product_id", "valid_from_utc"),
        Child("master_product_links", links, "master_products", "master_product_id", "decided_at_utc", F.col("status") == "active"),
        Child("locations", read_table(spark, sf, "locations", "supermarket_id"), "supermarkets", "supermarket_id"),
    ]
    parents = [
        Parent("products", read_table(spark, sf, "products", "product_id", "first_seen_utc"), "product_id", "first_seen_utc"),
        Parent("master_products", read_table(spark, sf, "master_products", "master_product_id", "created_at_utc", "status"), "master_product_id", "created_at_utc", F.col("status") == "retired"),
        Parent("supermarkets", read_table(spark, sf, "supermarkets", "supermarket_id"), "supermarket_id"),
    ]
    return references.orphan_references(children, parents), children


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf)[0].select("child_table", "ref_key", "period_month", "orphan_kind")


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return references.orphan_report(references.counted(*_orphans(spark, sf)))


_P2_ROWS = """
refs AS (
  SELECT 'price_history' AS child_table, CAST(h.product_id AS VARCHAR) AS ref_key, strftime(h.valid_from_utc AT TIME ZONE 'UTC', '%Y-%m') AS period_month,
         CASE WHEN p.product_id IS NULL THEN 'missing' WHEN h.valid_from_utc < p.first_seen_utc THEN 'late' END AS orphan_kind
  FROM price_history h LEFT JOIN products p ON h.product_id = p.product_id
  UNION ALL
  SELECT 'master_product_links', l.master_product_id, strftime(l.decided_at_utc AT TIME ZONE 'UTC', '%Y-%m'),
         CASE WHEN m.master_product_id IS NULL THEN 'missing' WHEN l.status = 'active' AND m.status = 'retired' THEN 'deleted' WHEN l.decided_at_utc < m.created_at_utc THEN 'late' END
  FROM master_product_links l LEFT JOIN master_products m ON l.master_product_id = m.master_product_id
  UNION ALL
  SELECT 'locations', c.supermarket_id, 'none', CASE WHEN s.supermarket_id IS NULL THEN 'missing' END
  FROM locations c LEFT JOIN supermarkets s ON c.supermarket_id = s.supermarket_id)"""


# ---- 3 and 6: states, versions, changes ------------------------------------------------
def _state(spark: SparkSession, sf: str, columns: tuple[str, ...], with_run: bool = True) -> DataFrame:
    history = read_table(spark, sf, "price_history", "product_id", "location_id", "valid_from_utc", "loaded_at_utc", "scrape_run_id", *columns)
    return snapshots.state_rows(history, read_table(spark, sf, "scrape_runs"), columns, with_run)


def _versions(spark: SparkSession, sf: str) -> DataFrame:
    return versions.versions(_state(spark, sf, VERSIONED, with_run=False), ("product_id", "location_id"), "valid_from_utc", VERSIONED)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    v = _versions(spark, sf)
    return v.select("product_id", "location_id", F.unix_timestamp("valid_from").alias("valid_from_epoch"), F.coalesce(F.unix_timestamp("valid_to"), F.lit(0)).alias("valid_to_epoch"))


def p3_versions(spark: SparkSession, sf: str) -> DataFrame:
    v = _versions(spark, sf)
    return v.select("product_id", "location_id", F.col("current_price_minor").cast("long").alias("current_price_minor"), F.col("reported_regular_price_minor").cast("long").alias("reported_regular_price_minor"), F.col("is_promotion").cast("boolean").alias("is_promotion"), F.unix_timestamp("valid_from").alias("valid_from_epoch"), F.coalesce(F.unix_timestamp("valid_to"), F.lit(0)).alias("valid_to_epoch"))


def p3_attribute_log(spark: SparkSession, sf: str) -> DataFrame:
    log = versions.attribute_log(_state(spark, sf, VERSIONED, with_run=False), ("product_id", "location_id"), "valid_from_utc", VERSIONED)
    return log.select("product_id", "location_id", "attribute", F.coalesce("value", F.lit("")).alias("value"), F.unix_timestamp("valid_from").alias("valid_from_epoch"), F.coalesce(F.unix_timestamp("valid_to"), F.lit(0)).alias("valid_to_epoch"))


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    fields = ("current_price_minor", "availability")
    return snapshots.snapshot_changes(_state(spark, sf, fields), read_table(spark, sf, "scrape_runs"), fields)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).select("scrape_run_id", "product_id", "change_kind")


def p6_fields(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf)


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf).groupBy("scrape_run_id", "change_kind", "changed_fields").agg(F.count("*").alias("n_products"))


_STATE = """
runs AS (SELECT DISTINCT scrape_run_id, location_id, observed_at_utc FROM scrape_runs WHERE run_status = 'success'),
state AS (
  SELECT * FROM (
    SELECT h.product_id, h.location_id, h.valid_from_utc, h.scrape_run_id, h.current_price_minor, h.reported_regular_price_minor, h.is_promotion, h.availability,
           row_number() OVER (PARTITION BY h.product_id, h.location_id, h.valid_from_utc ORDER BY h.loaded_at_utc DESC NULLS LAST, h.current_price_minor DESC NULLS LAST, h.reported_regular_price_minor DESC NULLS LAST, h.is_promotion DESC NULLS LAST, h.availability DESC NULLS LAST) AS rn
    FROM price_history h JOIN runs r ON h.scrape_run_id = r.scrape_run_id) WHERE rn = 1)"""
_VERSIONED_SQL = f"""{_STATE},
marked AS (
  SELECT *, lag(valid_from_utc) OVER w IS NULL OR lag(current_price_minor) OVER w IS DISTINCT FROM current_price_minor
            OR lag(reported_regular_price_minor) OVER w IS DISTINCT FROM reported_regular_price_minor OR lag(is_promotion) OVER w IS DISTINCT FROM is_promotion AS is_new
  FROM state WINDOW w AS (PARTITION BY product_id, location_id ORDER BY valid_from_utc)),
v AS (
  SELECT product_id, location_id, current_price_minor, reported_regular_price_minor, is_promotion, CAST(floor(epoch(valid_from_utc)) AS BIGINT) AS valid_from_epoch,
         coalesce(CAST(floor(epoch(lead(valid_from_utc) OVER (PARTITION BY product_id, location_id ORDER BY valid_from_utc))) AS BIGINT), 0) AS valid_to_epoch
  FROM marked WHERE is_new)"""
_CHANGES = f"""{_STATE},
pairs AS (SELECT scrape_run_id, lag(scrape_run_id) OVER (PARTITION BY location_id ORDER BY observed_at_utc, scrape_run_id) AS prev_run FROM runs),
new_rows AS (SELECT p.scrape_run_id, s.product_id, s.current_price_minor, s.availability FROM pairs p JOIN state s ON s.scrape_run_id = p.scrape_run_id WHERE p.prev_run IS NOT NULL),
old_rows AS (SELECT p.scrape_run_id, s.product_id, s.current_price_minor, s.availability FROM pairs p JOIN state s ON s.scrape_run_id = p.prev_run),
both_rows AS (
  SELECT coalesce(n.scrape_run_id, o.scrape_run_id) AS scrape_run_id, coalesce(n.product_id, o.product_id) AS product_id,
         CASE WHEN o.product_id IS NULL THEN 'added' WHEN n.product_id IS NULL THEN 'removed'
              WHEN n.current_price_minor IS DISTINCT FROM o.current_price_minor OR n.availability IS DISTINCT FROM o.availability THEN 'changed' END AS change_kind,
         CASE WHEN o.product_id IS NULL OR n.product_id IS NULL THEN ''
              ELSE concat_ws(',', CASE WHEN n.availability IS DISTINCT FROM o.availability THEN 'availability' END, CASE WHEN n.current_price_minor IS DISTINCT FROM o.current_price_minor THEN 'current_price_minor' END) END AS changed_fields
  FROM new_rows n FULL JOIN old_rows o ON n.scrape_run_id = o.scrape_run_id AND n.product_id = o.product_id)"""


# ---- 7: quantities ---------------------------------------------------------------------
def _quantities(spark: SparkSession, sf: str, bare: bool = True) -> DataFrame:
    return quantities.converted(read_table(spark, sf, "products"), read_table(spark, sf, "size_decisions"), bare=bare)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every stated content; an ounce whose reading stays uncertain by the likelier one."""
    return _quantities(spark, sf, bare=False).where("has_unit").select("rec_table", "rec_key", "field_name", "base_unit", "base_milli")


def p7_inferred(spark: SparkSession, sf: str) -> DataFrame:
    """Conversions that the classifier decided with confidence."""
    return _quantities(spark, sf).where("how = 'inferred'")


def p7_holdout(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy and calibration of the unit classifier on held-out rows with hidden units."""
    return quantities.holdout(read_table(spark, sf, "products"), read_table(spark, sf, "size_decisions"))


def p7_review(spark: SparkSession, sf: str) -> DataFrame:
    """Uncertain assignments, for a person to look at."""
    return _quantities(spark, sf).where("how = 'review'")


_P1 = """
ok AS (SELECT page_id, CAST(payload AS JSON) AS j FROM documents_6602 WHERE json_valid(payload)),
d0 AS (SELECT page_id, coalesce(json_extract(j, '$.documents'), json_extract(j, '$.data.documents')) AS d FROM ok),
dl AS (SELECT page_id, NULL AS ks, CASE WHEN json_type(d) = 'ARRAY' THEN from_json(d, '["JSON"]') WHEN json_type(d) = 'OBJECT' THEN [d] ELSE [] END AS l FROM d0 WHERE json_type(d) <> 'OBJECT' OR json_exists(d, '$.pid') OR json_exists(d, '$.variants')
  UNION ALL SELECT page_id, json_keys(d), [json_extract(d, '$."' || k || '"') for k in json_keys(d)] FROM d0 WHERE json_type(d) = 'OBJECT' AND NOT (json_exists(d, '$.pid') OR json_exists(d, '$.variants'))),
dd AS (SELECT page_id, i - 1 AS doc_pos, ks[i] AS k, l[i] AS doc FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM dl)),
docs AS (SELECT page_id, doc_pos, coalesce(json_extract_string(doc, '$.pid'), k) AS pid, json_extract(doc, '$.variants') AS x FROM dd WHERE json_type(doc) = 'OBJECT'),
vl AS (SELECT page_id, doc_pos, pid, CASE json_type(x) WHEN 'ARRAY' THEN from_json(x, '["JSON"]') WHEN 'OBJECT' THEN [x] ELSE [] END AS l FROM docs),
vars AS (SELECT page_id, doc_pos, pid, i - 1 AS variant_pos, l[i] AS v FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM vl) WHERE json_type(l[i]) = 'OBJECT')"""


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_pages, p1_documents, p1_variants, p1_lineage, p2_found, p2_report, p3_found, p3_versions, p3_attribute_log, p6_found, p6_fields, p6_report, p7_found, p7_inferred, p7_review, p7_holdout)
}

ORACLE = {
    "p1_pages": f"""WITH {_P1} SELECT CAST(p.page_id AS VARCHAR) AS pk, CAST(NULL AS VARCHAR) AS parent_pk, p.page_id, p.club, coalesce(json_valid(p.payload), false) AS is_complete, coalesce(len(dl.l), 0) AS n_documents FROM documents_6602 p LEFT JOIN dl ON p.page_id = dl.page_id""",
    "p1_variants": f"""WITH {_P1} SELECT page_id || '/' || doc_pos || '/' || variant_pos AS pk, page_id || '/' || doc_pos AS parent_pk, page_id, pid, doc_pos, variant_pos, coalesce(json_extract_string(v, '$.skuid'), '') AS skuid,
CASE json_type(v, '$.inventory_HN_6602') WHEN 'ARRAY' THEN json_extract_string(v, '$.inventory_HN_6602[0]') ELSE json_extract_string(v, '$.inventory_HN_6602') END AS inventory FROM vars""",
    "p1_lineage": f"""WITH {_P1}, e AS (SELECT CASE WHEN json_type(v, '$.price_HN_6602') = 'ARRAY' THEN greatest(len(list_filter(from_json(json_extract(v, '$.price_HN_6602'), '["JSON"]'), lambda z: coalesce(json_extract_string(z, '$') <> '', false))), 1) ELSE 1 END AS n FROM vars)
SELECT 'document' AS table_name, count(*) AS n_rows, 0 AS n_orphans FROM docs UNION ALL SELECT 'variant', count(*), 0 FROM vars UNION ALL SELECT 'price', CAST(sum(n) AS BIGINT), 0 FROM e""",
    "p1_found": r"""
WITH ok AS (SELECT page_id, CAST(payload AS JSON) AS j FROM documents_6602 WHERE json_valid(payload)),
d0 AS (SELECT page_id, coalesce(json_extract(j, '$.documents'), json_extract(j, '$.data.documents')) AS d FROM ok),
d1 AS (
  SELECT page_id, NULL AS k, unnest(from_json(d, '["JSON"]')) AS doc FROM d0 WHERE json_type(d) = 'ARRAY'
  UNION ALL SELECT page_id, NULL, d FROM d0 WHERE json_type(d) = 'OBJECT' AND (json_exists(d, '$.pid') OR json_exists(d, '$.variants'))
  UNION ALL SELECT page_id, k, json_extract(d, '$."' || k || '"') FROM (SELECT page_id, d, unnest(json_keys(d)) AS k FROM d0 WHERE json_type(d) = 'OBJECT' AND NOT (json_exists(d, '$.pid') OR json_exists(d, '$.variants')))),
v0 AS (SELECT page_id, coalesce(json_extract_string(doc, '$.pid'), k) AS pid, json_extract(doc, '$.variants') AS x FROM d1 WHERE json_type(doc) = 'OBJECT'),
v1 AS (SELECT page_id, pid, CASE json_type(x) WHEN 'ARRAY' THEN from_json(x, '["JSON"]') WHEN 'OBJECT' THEN [x] ELSE [] END AS l FROM v0),
v2 AS (SELECT page_id, pid, i - 1 AS variant_pos, l[i] AS v FROM (SELECT page_id, pid, l, unnest(range(1, len(l) + 1)) AS i FROM v1)),
v3 AS (SELECT page_id, pid, variant_pos, coalesce(json_extract_string(v, '$.skuid'), '') AS skuid, json_extract(v, '$.price_HN_6602') AS p, json_extract(v, '$.availability_HN_6602') AS a FROM v2 WHERE json_type(v) = 'OBJECT'),
v4 AS (SELECT page_id, pid, variant_pos, skuid, CASE WHEN p IS NULL OR json_type(p) = 'NULL' THEN [] WHEN json_type(p) = 'ARRAY' THEN from_json(p, '["JSON"]') ELSE [p] END AS ps, CASE WHEN a IS NULL OR json_type(a) = 'NULL' THEN [] WHEN json_type(a) = 'ARRAY' THEN from_json(a, '["JSON"]') ELSE [a] END AS av FROM v3),
e AS (SELECT *, i - 1 AS entry_pos, json_extract_string(ps[i], '$') AS t FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM v4)),
priced AS (SELECT page_id, pid, variant_pos, skuid, entry_pos, CASE WHEN regexp_matches(t, '^[0-9]+$') THEN CAST(t AS BIGINT) ELSE CAST(round(CAST(replace(t, ',', '.') AS DECIMAL(18, 6)) * 100) AS BIGINT) END AS price_minor, av FROM e WHERE t IS NOT NULL AND t <> ''),
none AS (SELECT page_id, pid, variant_pos, skuid, 0 AS entry_pos, -1 AS price_minor, av FROM v4 WHERE NOT list_bool_or(list_transform(ps, lambda z: coalesce(json_extract_string(z, '$') <> '', false)))  OR len(ps) = 0),
u AS (SELECT * FROM priced UNION ALL SELECT * FROM none)
SELECT page_id, pid, variant_pos, skuid, entry_pos, price_minor, CASE WHEN lower(json_extract_string(av[entry_pos + 1], '$')) IN ('true', 'false') THEN lower(json_extract_string(av[entry_pos + 1], '$')) ELSE 'unknown' END AS availability FROM u""",
    "p2_found": f"WITH {_P2_ROWS} SELECT DISTINCT child_table, ref_key, period_month, orphan_kind FROM refs WHERE orphan_kind IS NOT NULL AND ref_key IS NOT NULL",
    "p2_report": f"""WITH {_P2_ROWS}
SELECT child_table, period_month, orphan_kind, count(DISTINCT ref_key) AS orphan_keys, count(*) AS period_refs FROM refs WHERE orphan_kind IS NOT NULL AND ref_key IS NOT NULL GROUP BY 1, 2, 3""",
    "p3_found": f"WITH {_VERSIONED_SQL} SELECT product_id, location_id, valid_from_epoch, valid_to_epoch FROM v",
    "p3_versions": f"WITH {_VERSIONED_SQL} SELECT * FROM v",
    "p3_attribute_log": f"""WITH {_STATE},
cells AS (
  SELECT product_id, location_id, valid_from_utc, 'current_price_minor' AS attribute, CAST(current_price_minor AS VARCHAR) AS value FROM state
  UNION ALL SELECT product_id, location_id, valid_from_utc, 'reported_regular_price_minor', CAST(reported_regular_price_minor AS VARCHAR) FROM state
  UNION ALL SELECT product_id, location_id, valid_from_utc, 'is_promotion', CAST(is_promotion AS VARCHAR) FROM state),
e AS (SELECT *, lag(valid_from_utc) OVER w IS NULL OR lag(value) OVER w IS DISTINCT FROM value AS is_new FROM cells WINDOW w AS (PARTITION BY product_id, location_id, attribute ORDER BY valid_from_utc))
SELECT product_id, location_id, attribute, coalesce(value, '') AS value, CAST(floor(epoch(valid_from_utc)) AS BIGINT) AS valid_from_epoch,
       coalesce(CAST(floor(epoch(lead(valid_from_utc) OVER (PARTITION BY product_id, location_id, attribute ORDER BY valid_from_utc))) AS BIGINT), 0) AS valid_to_epoch
FROM e WHERE is_new""",
    "p6_found": f"WITH {_CHANGES} SELECT scrape_run_id, product_id, change_kind FROM both_rows WHERE change_kind IS NOT NULL",
    "p6_fields": f"WITH {_CHANGES} SELECT scrape_run_id, product_id, change_kind, changed_fields FROM both_rows WHERE change_kind IS NOT NULL",
    "p6_report": f"WITH {_CHANGES} SELECT scrape_run_id, change_kind, changed_fields, count(*) AS n_products FROM both_rows WHERE change_kind IS NOT NULL GROUP BY 1, 2, 3",
}
