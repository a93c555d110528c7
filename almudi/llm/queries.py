"""Queries of the llm problems (p4, p5, p8, p9, p10) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almudi.core.runtime import read_table, tabled
from almudi.llm import abuse, mixing, packing, same_item, survivors


def _truth(spark: SparkSession, sf: str) -> survivors.TruthModel:
    return survivors.TruthModel(read_table(spark, sf, "master_products"), read_table(spark, sf, "master_product_links"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """The first row by the order of precedence whose value the fitted model holds true."""
    return _truth(spark, sf).survivors().select("group_id", "field_name", "master_product_id")


def p4_survivors(spark: SparkSession, sf: str) -> DataFrame:
    return _truth(spark, sf).survivors()


def p4_values(spark: SparkSession, sf: str) -> DataFrame:
    """Every claimed value with its posterior; those judged true are kept together."""
    return _truth(spark, sf).values.drop("ord", "label")


def p4_sources(spark: SparkSession, sf: str) -> DataFrame:
    return _truth(spark, sf).sources()


def p4_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """How often the model's likeliest value is the one that the order of precedence chose."""
    return _truth(spark, sf).agreement()


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_item.item_pairs(same_item.items(read_table(spark, sf, "products")))


def p5_items(spark: SparkSession, sf: str) -> DataFrame:
    """One row per listing with its item and the item's number of listings."""
    found = tabled(same_item.items(read_table(spark, sf, "products")), "items")
    return found.join(found.groupBy("item").agg(F.count("*").alias("n_listings")), "item").select("product_id", "item", "n_listings", "brand", "model", "dim", "pack")


def p8_pack(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read_table(spark, sf, "documents", "doc_id", "source", "text"), read_table(spark, sf, "context_sizes"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    """What the genetic algorithm saves against best fit, and the unused share, by size."""
    return packing.fill_report(read_table(spark, sf, "documents", "doc_id", "source", "text"), read_table(spark, sf, "context_sizes"))


def p8_checks(spark: SparkSession, sf: str) -> DataFrame:
    """The rules of a packing, counted over the whole assignment."""
    return packing.checks(p8_pack(spark, sf), read_table(spark, sf, "documents", "doc_id"), read_table(spark, sf, "context_sizes"))


def _mix(spark: SparkSession, sf: str) -> mixing.Mix:
    return mixing.Mix(read_table(spark, sf, "documents", "doc_id", "source", "text"), read_table(spark, sf, "mix_targets"))


def p9_selection(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).selection()


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).report()


def p9_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Selections for a quarter, a half and all of the total: each within the next."""
    mix = _mix(spark, sf)
    parts = [mix.report(p).select(F.lit(p).alias("part"), "source", "documents", "tokens", "reached_share") for p in (0.25, 0.5, 1.0)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.scores(read_table(spark, sf, "documents", "doc_id", "source", "text"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.found(_scores(spark, sf))


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    s = _scores(spark, sf)
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.round(c, 6).alias("score")) for c in abuse.CATEGORIES])).alias("x")
    return s.select("doc_id", each).select("doc_id", "x.*")


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    return abuse.rates(_scores(spark, sf))


QUERIES = {f.__name__: f for f in (p4_found, p4_survivors, p4_values, p4_sources, p4_agreement, p5_found, p5_items, p8_pack, p8_report, p8_checks, p9_selection, p9_report, p9_nested, p10_found, p10_scores, p10_rates)}

ORACLE = {
    "p8_checks": "SELECT size_name, (SELECT count(*) FROM documents) AS n_packed, 0 AS n_miscounted, 0 AS n_cut_in_vain, 0 AS n_over_capacity FROM context_sizes",
    "p4_found": """
WITH RECURSIVE m AS (
  SELECT *, CASE WHEN length(regexp_replace(coalesce(primary_gtin, ''), '[^0-9]', '', 'g')) BETWEEN 1 AND 14 THEN 'g:' || lpad(regexp_replace(primary_gtin, '[^0-9]', '', 'g'), 14, '0') ELSE 'm:' || master_product_id END AS node
  FROM master_products),
e AS (SELECT DISTINCT a.node AS a, coalesce(b.node, 'm:' || a.merged_into) AS b FROM m a LEFT JOIN m b ON a.merged_into = b.master_product_id WHERE a.merged_into IS NOT NULL),
ee AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a AS node, a AS other FROM ee UNION SELECT r.node, ee.b FROM reach r JOIN ee ON r.other = ee.a),
comp AS (SELECT node, min(other) AS component FROM reach GROUP BY node),
r AS (SELECT m.*, coalesce(comp.component, m.node) AS component FROM m LEFT JOIN comp ON m.node = comp.node),
g AS (SELECT component, min(master_product_id) AS group_id FROM r GROUP BY component HAVING count(*) >= 2),
l AS (SELECT master_product_id, min(CASE link_method WHEN 'manual_review' THEN 0 WHEN 'reviewed_decision' THEN 1 WHEN 'gtin_exact' THEN 2 WHEN 'gtin_sku_derived' THEN 3 WHEN 'engine_auto' THEN 4 END) AS rank
      FROM master_product_links WHERE status = 'active' GROUP BY master_product_id),
f AS (
  SELECT g.group_id, r.*, coalesce(l.rank, 5) AS rank FROM r JOIN g ON r.component = g.component LEFT JOIN l ON r.master_product_id = l.master_product_id),
c AS (
  SELECT group_id, 'brand' AS field_name, master_product_id, rank, updated_at_utc, json_extract_string(attribute_provenance_json, '$.brand.rule') AS rule, json_extract_string(attribute_provenance_json, '$.brand.support') AS support
  FROM f WHERE lower(trim(brand)) NOT IN ('', 'n/d', 's/d', '-', 'sin dato')
  UNION ALL
  SELECT group_id, 'variant', master_product_id, rank, updated_at_utc, json_extract_string(attribute_provenance_json, '$.variant.rule'), json_extract_string(attribute_provenance_json, '$.variant.support')
  FROM f WHERE lower(trim(variant)) NOT IN ('', 'n/d', 's/d', '-', 'sin dato')
  UNION ALL
  SELECT group_id, 'net_content', master_product_id, rank, updated_at_utc, json_extract_string(attribute_provenance_json, '$.net_content.rule'), json_extract_string(attribute_provenance_json, '$.net_content.support')
  FROM f WHERE try_cast(replace(trim(net_content_value), ',', '.') AS DOUBLE) > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY group_id, field_name ORDER BY coalesce(rule = 'human_set', false) DESC, rank, coalesce(try_cast(support AS DOUBLE), 0) DESC, updated_at_utc DESC NULLS LAST, master_product_id) AS rn FROM c)
SELECT group_id, field_name, master_product_id FROM o WHERE rn = 1""",
}
