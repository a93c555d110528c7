"""Queries of names, sizes, record comparison and deterministic identity, with oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almudi.core.runtime import read_table, tabled
from almudi.functions import gtin as G
from almudi.functions import listing as S
from almudi.functions import text
from almudi.operators import comparison as C
from almudi.plans.reference_queries import _CHECK, _CUR, _EAN, _FOLD, _current

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _std(spark: SparkSession, sf: str) -> DataFrame:
    return S.standardized(read_table(spark, sf, "products", "product_id", "supermarket_id", "name", "brand", "presentation", "category", "ean"))


# ---- the same in SQL -------------------------------------------------------------------
def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _plain_sql(x: str) -> str:
    t = f"lower(strip_accents(coalesce({x}, '')))"
    return f"regexp_replace(regexp_replace({t}, '([0-9]),([0-9]{{3}})([^0-9]|$)', '\\1\\2\\3', 'g'), '([0-9]),([0-9])', '\\1.\\2', 'g')"


def _case(pairs: dict[str, str], x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in pairs.items()) + " END"


def _size_sql(x: str) -> str:
    t = _plain_sql(x)
    unit, packs, amount = (f"regexp_extract({t}, '{S.SIZE}', {k})" for k in (3, 1, 2))
    dim, factor = _case({u: f"'{d}'" for u, (d, _) in S.UNITS.items()}, unit), _case({u: f"{f!r}::DOUBLE" for u, (_, f) in S.UNITS.items()}, unit)
    n = f"coalesce(try_cast({packs} AS INT), 1)"
    total = f"round({n} * try_cast({amount} AS DOUBLE) * {factor}, 3)"
    return f"CASE WHEN {unit} <> '' AND {n} > 0 AND {total} > 0 THEN struct_pack(dim := {dim}, packs := {n}, total := {total}, imperial := {unit} IN {_in(S.IMPERIAL)}, n := len(regexp_extract_all({t}, '{S.SIZE}', 0))) END"


def _type_sql(words: str) -> str:
    rules = []
    for kind, every, some, none in S.TYPES:
        ok = [f"list_contains({words}, '{w}')" for w in every] + ([f"list_has_any({words}, [{', '.join(repr(w) for w in some)}])"] if some else []) + [f"NOT list_contains({words}, '{w}')" for w in none]
        rules.append(f"WHEN {' AND '.join(ok)} THEN '{kind}'")
    return "CASE " + " ".join(rules) + " END"


_DROP = _in([*S.STOPWORDS, *S.PACKAGING, *[u for u in S.UNITS if " " not in u]])
_FAMILY = " UNION ALL ".join(f"SELECT '{f}' AS family, unnest([{', '.join(repr(v) for v in vs)}]) AS v" for f, vs in S.VARIANTS.items())
_BRAND_SQL = f"(SELECT CASE b {' '.join(f'WHEN {k!r} THEN {v!r}' for k, v in S.ALIASES.items())} ELSE b END FROM (SELECT nullif(CASE WHEN x NOT IN {_in(S.PLACEHOLDERS)} THEN x END, '') AS b FROM (SELECT regexp_replace({_FOLD.format('{0}')}, '^marca ', '') AS x)))"
_STD = f"""fam AS ({_FAMILY}),
std0 AS MATERIALIZED (SELECT product_id, supermarket_id, coalesce({_FOLD.format("name")}, '') AS folded, {_BRAND_SQL.format("brand")} AS brand, {_size_sql("name")} AS ns, {_size_sql("presentation")} AS ps,
  {_FOLD.format("string_split(category, '>')[-1]")} AS leaf, {_EAN.replace("p.ean", "ean")} AS g FROM products),
std AS MATERIALIZED (SELECT product_id, supermarket_id, folded, brand, replace(brand, ' ', '') AS squashed,
  list_filter(list_distinct(string_split(folded, ' ')), lambda w: length(w) > 1 AND NOT regexp_matches(w, '[0-9]') AND w NOT IN {_DROP} AND NOT list_contains(string_split(coalesce(brand, ''), ' '), w)) AS bag,
  list_filter(string_split(folded, ' '), lambda w: length(w) > 1 AND NOT regexp_matches(w, '[0-9]') AND w NOT IN {_DROP} AND NOT list_contains(string_split(coalesce(brand, ''), ' '), w)) AS core_all,
  list_sort(list_distinct(list_filter(string_split(folded, ' '), lambda w: regexp_matches(w, '^[a-z]{{1,3}}[0-9]{{1,4}}$')))) AS codes, coalesce(ns, ps) AS size, ns, ps, leaf, {_type_sql("string_split(folded, ' ')")} AS type,
  CASE WHEN {_CHECK.format("g")} AND CAST(g AS BIGINT) < 90000000000000 AND NOT (CAST(g AS BIGINT) < 100000000 AND CAST(g AS BIGINT) // 10000000 IN (0, 2)) AND NOT (CAST(g AS BIGINT) >= 100000000 AND (CAST(g AS BIGINT) % 10000000000000 // 10000000000 BETWEEN 20 AND 29 OR CAST(g AS BIGINT) % 10000000000000 // 10000000000 BETWEEN 40 AND 49 OR CAST(g AS BIGINT) % 10000000000000 // 10000000000 BETWEEN 200 AND 299 OR CAST(g AS BIGINT) % 10000000000000 // 10000000000 >= 980)) THEN g END AS gtin FROM std0),
var AS (SELECT s.product_id, list_sort(list(DISTINCT f.family || ':' || f.v)) AS variants FROM std s JOIN fam f ON list_contains(string_split(s.folded, ' '), f.v) GROUP BY 1)"""


def _compatible_sql(a: str, b: str) -> str:
    return f"coalesce({a}.dim = {b}.dim AND {a}.packs = {b}.packs AND CASE WHEN {a}.dim IN ('unit', 'oz') THEN {a}.total = {b}.total ELSE abs({a}.total - {b}.total) <= 1.5 OR abs({a}.total - {b}.total) <= (CASE WHEN {a}.imperial OR {b}.imperial THEN 0.02::DOUBLE ELSE 0.005::DOUBLE END) * greatest({a}.total, {b}.total) END, false)"


# ---- names, brands, words --------------------------------------------------------------
@query(f"WITH {_STD} SELECT p.product_id, trim(regexp_replace(lower(p.name), '\\s+', ' ', 'g')) AS canonical, s.brand, s.squashed, s.brand IS NULL AND p.brand IS NOT NULL AS placeholder FROM products p JOIN std s USING (product_id)")
def x_brands(spark, sf):
    """Canonical names, brand keys without placeholders, aliases resolved."""
    p = read_table(spark, sf, "products", "product_id", "name", "brand")
    b = S.normal_brand(F.col("brand"))
    return p.select("product_id", F.trim(F.regexp_replace(F.lower("name"), r"\s+", " ")).alias("canonical"), b.alias("brand"), S.squashed(b).alias("squashed"), (b.isNull() & F.col("brand").isNotNull()).alias("placeholder"))


@query(f"WITH {_STD} SELECT s.product_id, array_to_string(list_sort(bag), ' ') AS core, array_to_string(codes, ' ') AS codes, coalesce(array_to_string(variants, ' '), '') AS variants, len(bag) AS n_core FROM std s LEFT JOIN var v USING (product_id)")
def x_product_words(spark, sf):
    """Product words, model codes and declared variants of every listing."""
    s = _std(spark, sf)
    return s.select("product_id", F.array_join(F.array_sort("core"), " ").alias("core"), F.array_join("codes", " ").alias("codes"), F.array_join("variants", " ").alias("variants"), F.size("core").alias("n_core"))


@query(f"""WITH {_STD}, lex AS (SELECT brand, count(*) AS n FROM std WHERE brand IS NOT NULL AND length(replace(brand, ' ', '')) >= 3 GROUP BY 1),
w AS (SELECT s.product_id, s.brand, s.folded, l.brand AS found FROM std s JOIN lex l ON (' ' || s.folded || ' ') LIKE ('% ' || l.brand || ' %')),
m AS (SELECT product_id, count(DISTINCT found) FILTER (WHERE found <> coalesce(brand, '') AND NOT (' ' || coalesce(brand, '') || ' ') LIKE ('% ' || found || ' %') AND NOT (' ' || found || ' ') LIKE ('% ' || coalesce(brand, '-') || ' %')) AS others,
  max(found) FILTER (WHERE found <> coalesce(brand, '') AND NOT (' ' || coalesce(brand, '') || ' ') LIKE ('% ' || found || ' %') AND NOT (' ' || found || ' ') LIKE ('% ' || coalesce(brand, '-') || ' %')) AS other, bool_or(coalesce(found = brand, false)) AS own FROM w GROUP BY 1)
SELECT s.product_id, CASE WHEN s.brand IS NULL THEN CASE WHEN others = 1 THEN 'from_name' ELSE 'none' END WHEN coalesce(own, false) OR coalesce(others, 0) <> 1 THEN 'source' ELSE 'source_conflict' END AS brand_status,
CASE WHEN s.brand IS NULL THEN CASE WHEN others = 1 THEN other END WHEN coalesce(own, false) OR coalesce(others, 0) <> 1 THEN s.brand END AS resolved FROM std s LEFT JOIN m USING (product_id)""")
def x_resolved_brands(spark, sf):
    """The source's brand, unless the name holds exactly one other brand and not this one;
    without a source brand the only one that the name holds. Phrases meet the lexicon by a
    join of the names' word runs."""
    return C.resolved_brands(tabled(_std(spark, sf).select("product_id", "folded", "brand"), "names"))


@query(f"WITH {_STD}, l AS (SELECT s.leaf || ' ' || s.bag_first AS leaf_key, m.product_type, count(*) AS n FROM (SELECT *, core_all[1] AS bag_first FROM std) s JOIN master_product_links k ON s.product_id = k.product_id AND k.status = 'active' JOIN master_products m USING (master_product_id) WHERE m.product_type IS NOT NULL AND s.leaf IS NOT NULL AND s.bag_first IS NOT NULL GROUP BY 1, 2), t AS (SELECT leaf_key, sum(n) AS support, max(n) AS best FROM l GROUP BY 1) SELECT t.leaf_key, CAST(t.support AS BIGINT) AS support, min(l.product_type) AS product_type FROM t JOIN l ON l.leaf_key = t.leaf_key AND l.n = t.best WHERE t.support >= 5 AND t.best >= 0.8 * t.support GROUP BY 1, 2")
def e_leaf_types(spark, sf):
    """Product types learned by category leaf and leading word: five listings, four fifths of them agreeing."""
    s = _std(spark, sf).select("product_id", F.concat_ws(" ", "leaf", F.get("core", F.lit(0))).alias("leaf_key"), (F.col("leaf").isNotNull() & (F.size("core") > 0)).alias("ok")).where("ok")
    k = read_table(spark, sf, "master_product_links", "product_id", "master_product_id", "status").where("status = 'active'")
    m = read_table(spark, sf, "master_products", "master_product_id", "product_type").where("product_type is not null")
    n = s.join(k, "product_id").join(m, "master_product_id").groupBy("leaf_key", "product_type").agg(F.count("*").alias("n"))
    best = n.groupBy("leaf_key").agg(F.sum("n").alias("support"), F.max("n").alias("best"), F.min(F.struct((-F.col("n")).alias("o"), "product_type"))["product_type"].alias("product_type"))
    return best.where((F.col("support") >= 5) & (F.col("best") >= 0.8 * F.col("support"))).select("leaf_key", "support", "product_type")


# ---- sizes -----------------------------------------------------------------------------
@query(f"""WITH {_STD} SELECT product_id, CASE WHEN ns IS NULL AND ps IS NULL THEN 'missing' WHEN ns IS NULL THEN 'source_only' WHEN ns.n > 1 AND ps IS NULL THEN 'ambiguous' WHEN ps IS NULL THEN 'name_only'
WHEN {_compatible_sql("ns", "ps")} OR (ns.packs > 1 AND ps.packs = 1 AND {_compatible_sql("struct_pack(dim := ns.dim, packs := 1, total := ns.total, imperial := ns.imperial)", "ps")}) THEN 'confirmed' ELSE 'conflict' END AS size_status, coalesce(ns.dim, ps.dim) AS dim, coalesce(ns.total, ps.total) AS total FROM std""")
def u_resolved_sizes(spark, sf):
    """The name's size against the source's: confirmed, one of them only, conflict, ambiguous, missing."""
    s = _std(spark, sf)
    n, p = F.col("ns"), F.col("ps")
    single = F.struct(n["dim"].alias("dim"), F.lit(1).alias("packs"), n["total"].alias("total"), n["imperial"].alias("imperial"))
    status = F.when(n.isNull() & p.isNull(), "missing").when(n.isNull(), "source_only").when(p.isNull() & (n["n"] > 1), "ambiguous").when(p.isNull(), "name_only").when(S.compatible(n, p) | ((n["packs"] > 1) & (p["packs"] == 1) & S.compatible(single, p)), "confirmed").otherwise("conflict")
    return s.select("product_id", status.alias("size_status"), F.coalesce("ns.dim", "ps.dim").alias("dim"), F.coalesce("ns.total", "ps.total").alias("total"))


_OFFICIAL = "CASE WHEN lower(trim(net_content_unit)) IN ('g', 'gr', 'ml', 'l', 'kg') THEN try_cast(replace(trim(net_content_value), ',', '.') AS DOUBLE) * (CASE WHEN lower(trim(net_content_unit)) IN ('l', 'kg') THEN 1000 ELSE 1 END) END"


@query(f"""WITH {_STD}, o AS (SELECT canonical_gtin AS g, {_OFFICIAL} AS total, CASE WHEN lower(trim(net_content_unit)) IN ('ml', 'l') THEN 'ml' ELSE 'g' END AS dim FROM size_decisions WHERE decision = 'size')
SELECT s.product_id, CASE WHEN s.size IS NULL OR o.total IS NULL THEN 'unknown' WHEN s.size.dim = o.dim AND abs(s.size.total - o.total) <= 0.005 * o.total THEN 'match' WHEN s.size.dim = 'oz' AND abs(s.size.total * (CASE WHEN o.dim = 'g' THEN {S.OUNCE_G}::DOUBLE ELSE {S.OUNCE_ML}::DOUBLE END) - o.total) <= 0.02 * o.total THEN 'ounce'
WHEN s.size.dim IN ('g', 'ml') AND s.size.dim <> o.dim AND abs(s.size.total - o.total) <= 0.05 * o.total THEN 'weight_as_volume' ELSE 'contradiction' END AS official FROM std s JOIN o ON s.gtin = o.g""")
def u_official_sizes(spark, sf):
    """Listings against the decided size of their number; ounces are tried both ways."""
    unit = F.lower(F.trim("net_content_unit"))
    total = F.when(unit.isin("g", "gr", "ml", "l", "kg"), F.replace(F.trim("net_content_value"), F.lit(","), F.lit(".")).try_cast("double") * F.when(unit.isin("l", "kg"), 1000).otherwise(1))
    o = read_table(spark, sf, "size_decisions", "canonical_gtin", "decision", "net_content_value", "net_content_unit").where("decision = 'size'").select(F.col("canonical_gtin").alias("gtin"), total.alias("total"), F.when(unit.isin("ml", "l"), "ml").otherwise("g").alias("dim"))
    s = _std(spark, sf).select("product_id", "gtin", "size").join(o, "gtin")
    off = lambda x: F.abs(x - F.col("total"))
    ounce = F.col("size.total") * F.when(F.col("dim") == "g", S.OUNCE_G).otherwise(S.OUNCE_ML)
    verdict = (
        F.when(F.col("size").isNull() | F.col("total").isNull(), "unknown").when((F.col("size.dim") == F.col("dim")) & (off(F.col("size.total")) <= 0.005 * F.col("total")), "match")
        .when((F.col("size.dim") == "oz") & (off(ounce) <= 0.02 * F.col("total")), "ounce").when(F.col("size.dim").isin("g", "ml") & (F.col("size.dim") != F.col("dim")) & (off(F.col("size.total")) <= 0.05 * F.col("total")), "weight_as_volume").otherwise("contradiction")
    )
    return s.select("product_id", verdict.alias("official"))


_UNIT = f"""{_STD}, {_CUR}, price AS (SELECT product_id, min(current_price_minor) AS price FROM cur WHERE current_price_minor > 0 AND availability <> 'out_of_stock' GROUP BY 1),
up0 AS (SELECT s.product_id, s.supermarket_id, s.brand, s.core_all[1] AS lead, s.type, s.leaf, s.size.dim AS dim, s.size.packs AS packs, s.size.total AS total, p.price, CASE s.size.dim WHEN 'unit' THEN 1 ELSE 1000 END AS basis, CAST(round(s.size.total * 1000) AS BIGINT) AS milli FROM std s JOIN price p USING (product_id) WHERE s.size.dim IN ('g', 'ml', 'unit')),
up AS (SELECT *, price * basis * 1000 // milli + CASE WHEN 2 * (price * basis * 1000 % milli) > milli OR (2 * (price * basis * 1000 % milli) = milli AND price * basis * 1000 // milli % 2 = 1) THEN 1 ELSE 0 END AS unit_price FROM up0),
med AS (SELECT type, dim, count(*) AS n, list_sort(list(unit_price))[count(*) // 2 + 1] AS median FROM up WHERE type IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 8)"""


def _unit_prices(spark: SparkSession, sf: str) -> DataFrame:
    c = _current(spark, sf).where("current_price_minor > 0 and availability <> 'out_of_stock'").groupBy("product_id").agg(F.min("current_price_minor").alias("price"))
    s = _std(spark, sf).where(F.col("size.dim").isin("g", "ml", "unit")).select("product_id", "supermarket_id", "brand", F.get("core", F.lit(0)).alias("lead"), "type", "leaf", "size.dim", "size.packs", "size.total")
    return s.join(c, "product_id").withColumn("unit_price", C.unit_price(F.col("price"), F.col("total"), F.col("dim")))


@query(f"WITH {_UNIT} SELECT product_id, dim, total, price, unit_price FROM up")
def u_unit_prices(spark, sf):
    """Cents per kilogram, litre or unit, halves to even."""
    return _unit_prices(spark, sf).select("product_id", "dim", "total", "price", "unit_price")


@query(f"WITH {_UNIT} SELECT type, dim, n AS n_rows, median FROM med")
def a_unit_price_medians(spark, sf):
    """Upper median of unit prices by type and dimension, of eight rows or more."""
    return C.unit_medians(_unit_prices(spark, sf), 8).select("type", "dim", "n_rows", "median")


@query(f"""WITH {_UNIT} SELECT u.product_id, u.packs, CASE WHEN u.packs < 2 THEN 'single' WHEN m.median IS NULL THEN 'each' WHEN 4 * u.unit_price >= m.median AND u.unit_price * u.unit_price * u.packs >= m.median * m.median THEN 'each' ELSE 'total' END AS pack_verdict,
CASE WHEN (u.dim = 'g' AND u.total > 50000) OR (u.dim = 'ml' AND u.total > 60000) THEN 'too_large' WHEN m.median IS NULL THEN 'unknown' WHEN u.unit_price >= 100 * m.median THEN 'too_dear' WHEN 20 * u.unit_price <= m.median THEN 'too_cheap' ELSE 'plausible' END AS plausibility FROM up u LEFT JOIN med m ON u.type = m.type AND u.dim = m.dim""")
def u_pack_verdicts(spark, sf):
    """Whether a pack's size is of each container or of all, by the median of its type, and sizes that can't be."""
    u = _unit_prices(spark, sf)
    m = C.unit_medians(u, 8).select(F.col("type"), F.col("dim"), "median")
    j = u.join(m, ["type", "dim"], "left")
    return j.select("product_id", "packs", C.pack_verdict(F.col("packs"), F.col("unit_price"), F.col("median")).alias("pack_verdict"), C.plausibility(F.col("dim"), F.col("total"), F.col("unit_price"), F.col("median")).alias("plausibility"))


@query(f"""WITH {_UNIT}, g AS (SELECT brand, lead, dim, min(unit_price) AS low, count(DISTINCT total) AS n_sizes FROM up WHERE brand IS NOT NULL AND lead IS NOT NULL GROUP BY 1, 2, 3)
SELECT u.product_id, g.low AS best_unit_price, u.unit_price - g.low AS dearer_by FROM up u JOIN g ON u.brand = g.brand AND u.lead = g.lead AND u.dim = g.dim WHERE g.n_sizes > 1 AND u.unit_price > g.low""")
def u_cheaper_sizes(spark, sf):
    """Listings of which another size of the same brand and product costs less per unit."""
    u = _unit_prices(spark, sf).where("brand is not null and lead is not null")
    g = u.groupBy("brand", "lead", "dim").agg(F.min("unit_price").alias("best_unit_price"), F.count_distinct("total").alias("n_sizes")).where("n_sizes > 1").drop("n_sizes")
    return u.join(g, ["brand", "lead", "dim"]).where("unit_price > best_unit_price").select("product_id", "best_unit_price", (F.col("unit_price") - F.col("best_unit_price")).alias("dearer_by"))


@query(f"""WITH {_UNIT}, d AS (SELECT product_id, ns, ps FROM std) SELECT u.product_id, CASE WHEN d.ns IS NULL OR d.ps IS NULL THEN 'one_source' WHEN {_compatible_sql("d.ns", "d.ps")} THEN 'agrees' ELSE 'contradicts' END AS title, CAST(u.price * u.basis * 1000 AS BIGINT) // nullif(u.unit_price, 0) AS implied_milli,
CASE WHEN u.packs > 1 THEN u.packs || ' x ' ELSE '' END || CAST(CAST(round(u.total * 1000 / u.packs) AS BIGINT) // 1000 AS VARCHAR) || ' ' || u.dim AS label FROM up u JOIN d USING (product_id)""")
def u_display_sizes(spark, sf):
    """Label of the size, whether title and presentation agree, and the size that the unit price implies."""
    u = _unit_prices(spark, sf).join(_std(spark, sf).select("product_id", "ns", "ps"), "product_id")
    basis = F.when(F.col("dim") == "unit", 1).otherwise(1000).cast("long")
    title = F.when(F.col("ns").isNull() | F.col("ps").isNull(), "one_source").when(S.compatible(F.col("ns"), F.col("ps")), "agrees").otherwise("contradicts")
    each = F.floor(F.round(F.col("total") * 1000 / F.col("packs")).cast("long") / 1000).cast("string")
    label = F.concat(F.when(F.col("packs") > 1, F.concat(F.col("packs").cast("string"), F.lit(" x "))).otherwise(""), each, F.lit(" "), F.col("dim"))
    return u.select("product_id", title.alias("title"), F.when(F.col("unit_price") > 0, F.expr("price * 1000 * (case when dim = 'unit' then 1 else 1000 end) div unit_price")).alias("implied_milli"), label.alias("label"))


# ---- record comparison -----------------------------------------------------------------
_BUCKET = "CAST(floor(ln(s.size.total) / ln(1.25)) AS INT)"
_PAIRS = f"""{_STD}, k AS (SELECT s.product_id, s.supermarket_id, list_sort(s.bag) AS bag, unnest(list_filter([CASE WHEN s.squashed IS NOT NULL AND s.size IS NOT NULL THEN 'bs|' || s.squashed || '|' || s.size.dim || '|' || {_BUCKET} END, CASE WHEN s.type IS NOT NULL AND s.squashed IS NOT NULL AND len(s.core_all) > 0 THEN 'tb|' || s.type || '|' || s.squashed || '|' || s.core_all[1] END, CASE WHEN s.gtin IS NOT NULL THEN 'gt|' || s.gtin END], lambda x: x IS NOT NULL)) AS key FROM std s),
probe AS (SELECT s.product_id, unnest(CASE WHEN s.squashed IS NOT NULL AND s.size IS NOT NULL THEN ['bs|' || s.squashed || '|' || s.size.dim || '|' || ({_BUCKET} - 1), 'bs|' || s.squashed || '|' || s.size.dim || '|' || ({_BUCKET} + 1)] ELSE [] END) AS key FROM std s UNION ALL SELECT product_id, key FROM k),
cand AS (SELECT DISTINCT least(p.product_id, k.product_id) AS a, greatest(p.product_id, k.product_id) AS b FROM probe p JOIN k ON p.key = k.key WHERE p.product_id <> k.product_id),
j AS (SELECT a, b, x.supermarket_id AS chain_a, y.supermarket_id AS chain_b, coalesce(len(list_intersect(x.bag, y.bag)) / nullif(len(x.bag) + len(y.bag) - len(list_intersect(x.bag, y.bag)), 0)::DOUBLE, 0.0) AS similarity FROM cand JOIN std x ON x.product_id = a JOIN std y ON y.product_id = b WHERE x.supermarket_id <> y.supermarket_id),
both_ways AS (SELECT a AS id, b AS other, chain_b AS chain, similarity FROM j UNION ALL SELECT b, a, chain_a, similarity FROM j),
ranked AS (SELECT *, row_number() OVER (PARTITION BY id, chain ORDER BY round(similarity, 9) DESC, other) AS n FROM both_ways),
pairs AS (SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b, similarity FROM ranked WHERE n <= 6)"""


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    std = tabled(_std(spark, sf), "standard")
    return C.with_sides(tabled(C.candidates(std, 6), "candidates"), std)


@query(f"WITH {_PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def e_candidates(spark, sf):
    """Candidate pairs of different chains by blocking keys (brand and size with neighbours,
    type, brand and leading word, number): the six likest of every other chain, ties by id."""
    return C.candidates(tabled(_std(spark, sf), "standard"), 6).select("a", "b", F.round("similarity", 6).alias("similarity"))


def _size_level_sql(a: str, b: str) -> str:
    rel = f"abs({a}.total - {b}.total) / greatest({a}.total, {b}.total)"
    bridge = f"abs((CASE WHEN {a}.dim = 'oz' THEN {a}.total ELSE {b}.total END) * (CASE WHEN 'g' IN ({a}.dim, {b}.dim) THEN {S.OUNCE_G}::DOUBLE ELSE {S.OUNCE_ML}::DOUBLE END) - (CASE WHEN {a}.dim = 'oz' THEN {b}.total ELSE {a}.total END)) <= 0.03 * greatest((CASE WHEN {a}.dim = 'oz' THEN {a}.total ELSE {b}.total END) * (CASE WHEN 'g' IN ({a}.dim, {b}.dim) THEN {S.OUNCE_G}::DOUBLE ELSE {S.OUNCE_ML}::DOUBLE END), (CASE WHEN {a}.dim = 'oz' THEN {b}.total ELSE {a}.total END))"
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 'missing' WHEN {a}.dim = {b}.dim THEN CASE WHEN {a}.dim = 'unit' THEN CASE WHEN {a}.total = {b}.total THEN 'exact' ELSE 'conflict' END WHEN {a}.dim = 'oz' THEN CASE WHEN {a}.total = {b}.total THEN 'exact' WHEN {rel} <= 0.02 THEN 'close' ELSE 'conflict' END WHEN abs({a}.total - {b}.total) <= 1.5 OR {rel} <= 0.005 THEN 'exact' WHEN {rel} <= 0.02 THEN 'close' WHEN {rel} <= 0.06 THEN 'near' ELSE 'conflict' END WHEN 'unit' IN ({a}.dim, {b}.dim) THEN 'missing' WHEN 'oz' IN ({a}.dim, {b}.dim) THEN CASE WHEN {bridge} THEN 'ounce_bridge' ELSE 'conflict' END ELSE 'conflict' END"


_SETS = "CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 'none' WHEN len({0}) = 0 OR len({1}) = 0 THEN 'one_sided' WHEN {0} = {1} THEN 'agree' WHEN list_has_any({0}, {1}) THEN 'partial' ELSE 'conflict' END"
_LEVELS = f"""{_PAIRS}, lv AS (SELECT p.a, p.b, p.similarity,
CASE WHEN x.brand IS NULL AND y.brand IS NULL THEN 'both_missing' WHEN x.brand IS NULL OR y.brand IS NULL THEN CASE WHEN length(coalesce(x.squashed, y.squashed)) >= 4 AND contains(replace(CASE WHEN x.brand IS NULL THEN x.folded ELSE y.folded END, ' ', ''), coalesce(x.squashed, y.squashed)) THEN 'in_other_name' ELSE 'one_missing' END
  WHEN x.squashed = y.squashed THEN 'exact' WHEN least(length(x.squashed), length(y.squashed)) >= 4 AND (starts_with(x.squashed, y.squashed) OR starts_with(y.squashed, x.squashed)) THEN 'fuzzy' WHEN (length(x.squashed) >= 4 AND contains(replace(y.folded, ' ', ''), x.squashed)) OR (length(y.squashed) >= 4 AND contains(replace(x.folded, ' ', ''), y.squashed)) THEN 'cross_name' ELSE 'conflict' END AS brand,
CASE WHEN similarity >= 0.8 THEN 'very_high' WHEN similarity >= 0.6 THEN 'high' WHEN similarity >= 0.4 THEN 'medium' WHEN similarity >= 0.2 THEN 'low' ELSE 'very_low' END AS name,
CASE WHEN len(list_filter(x.bag, lambda w: NOT list_contains(y.bag, w))) = 0 AND len(list_filter(y.bag, lambda w: NOT list_contains(x.bag, w))) = 0 THEN 'none' WHEN len(list_filter(x.bag, lambda w: NOT list_contains(y.bag, w))) = 0 OR len(list_filter(y.bag, lambda w: NOT list_contains(x.bag, w))) = 0 THEN 'one_side' ELSE 'both_sides' END AS name_diff,
{_size_level_sql("x.size", "y.size")} AS size, CASE WHEN x.size IS NULL OR y.size IS NULL OR x.size.dim = 'unit' OR y.size.dim = 'unit' THEN 'missing' WHEN x.size.packs <> y.size.packs THEN 'conflict' WHEN x.size.packs > 1 THEN 'same_multi' ELSE 'same_single' END AS pack,
{_SETS.format("coalesce(vx.variants, [])", "coalesce(vy.variants, [])")} AS variant, {_SETS.format("x.codes", "y.codes")} AS codes,
CASE WHEN x.type IS NULL OR y.type IS NULL THEN CASE WHEN x.leaf IS NULL OR y.leaf IS NULL THEN 'unknown' WHEN x.leaf = y.leaf THEN 'same_department' ELSE 'department_conflict' END WHEN x.type = y.type THEN 'same_type' WHEN starts_with(x.type, y.type) OR starts_with(y.type, x.type) THEN 'type_partial' ELSE 'type_conflict' END AS type,
CASE WHEN x.gtin IS NULL OR y.gtin IS NULL THEN 'missing' WHEN x.gtin = y.gtin THEN 'same' ELSE 'different' END AS gtin, x.supermarket_id AS chain_a, y.supermarket_id AS chain_b
FROM pairs p JOIN std x ON x.product_id = p.a JOIN std y ON y.product_id = p.b LEFT JOIN var vx ON vx.product_id = p.a LEFT JOIN var vy ON vy.product_id = p.b)"""


@query(f"WITH {_LEVELS} SELECT a, b, brand, name, name_diff, size, pack, variant, codes, type, gtin FROM lv")
def e_levels(spark, sf):
    """Nine comparison levels of every candidate pair."""
    return C.levels(_pairs(spark, sf)).select("a", "b", *C.FIELDS)


_WEIGH = f"""{_LEVELS}, f AS (SELECT a, b, gtin, unnest([{", ".join(f"struct_pack(field := '{f}', level := {f})" for f in ("brand", "name", "name_diff", "size", "pack", "variant", "codes", "type"))}]) AS x FROM lv),
n AS (SELECT x.field AS field, x.level AS level, count(*) FILTER (WHERE gtin = 'same') AS hits, count(*) FILTER (WHERE gtin = 'different') AS misses FROM f GROUP BY 1, 2), t AS (SELECT field, sum(hits) AS all_hits, sum(misses) AS all_misses, count(*) AS k FROM n GROUP BY 1),
w AS (SELECT n.field, n.level, (hits + 1.0) / (all_hits + k) AS m, (misses + 1.0) / (all_misses + k) AS u FROM n JOIN t USING (field)),
pr AS (SELECT (count(*) FILTER (WHERE gtin = 'same') + 1.0) / (count(*) FILTER (WHERE gtin IN ('same', 'different')) + 2.0) AS prior FROM lv),
sc AS (SELECT f.a, f.b, f.gtin, round(log2(max(pr.prior) / (1 - max(pr.prior))) + sum(log2(w.m / w.u)), 4) AS weight FROM f JOIN w ON f.x.field = w.field AND f.x.level = w.level CROSS JOIN pr GROUP BY 1, 2, 3)"""


@query(f"WITH {_WEIGH} SELECT field, level, round(m, 6) AS m, round(u, 6) AS u, round(log2(m / u), 4) AS bits FROM w")
def e_waterfall(spark, sf):
    """What every level of every field adds to a match's weight."""
    return C.Weights(tabled(C.levels(_pairs(spark, sf)), "levels")).table()


@query(f"WITH {_WEIGH} SELECT a, b, round(weight, 3) AS weight, round(CASE WHEN weight >= 60 THEN 1.0 WHEN weight <= -60 THEN 0.0 ELSE pow(2.0, weight) / (1 + pow(2.0, weight)) END, 5) AS probability FROM sc")
def e_probabilities(spark, sf):
    """Weight and probability of a match by labelled levels (numbers same or different)."""
    s = C.Weights(tabled(C.levels(_pairs(spark, sf)), "levels")).scored()
    return s.select("a", "b", F.round("weight", 3).alias("weight"), F.round(C.probability("weight"), 5).alias("probability"))


@query(f"""WITH {_WEIGH}, b AS (SELECT sc.*, CASE WHEN weight >= 3 THEN 'auto_match' WHEN weight >= 0 THEN 'review' ELSE 'non_match' END AS band, lv.chain_a || '|' || lv.chain_b AS grp FROM sc JOIN lv USING (a, b) WHERE sc.gtin <> 'missing'),
g AS (SELECT grp, gtin, band FROM b UNION ALL SELECT 'all', gtin, band FROM b)
SELECT grp AS pair_group, count(*) AS labelled, count(*) FILTER (WHERE gtin = 'same' AND band = 'auto_match') AS tp, count(*) FILTER (WHERE gtin <> 'same' AND band = 'auto_match') AS fp, count(*) FILTER (WHERE gtin = 'same' AND band <> 'auto_match') AS fn,
round(tp / nullif(tp + fp, 0)::DOUBLE, 4) AS precision, round(tp / nullif(tp + fn, 0)::DOUBLE, 4) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 4) AS f1 FROM g GROUP BY 1""")
def e_evaluation(spark, sf):
    """True and false matches of the automatic band by pair of chains and in all."""
    s = C.Weights(tabled(C.levels(_pairs(spark, sf)), "levels")).scored()
    s = s.where("gtin <> 'missing'").select(F.concat_ws("|", "chain_a", "chain_b").alias("pair_group"), (F.col("gtin") == "same").alias("match"), (F.col("weight") >= 3).alias("auto"))
    return C.band_metrics(s, "pair_group", "match", "auto")


# ---- deterministic identity ------------------------------------------------------------
_CONFLICTS = f"""{_LEVELS}, cf AS (SELECT a, b, chain_a, chain_b, list_sort(list_filter([CASE WHEN brand = 'conflict' THEN 'brand' END, CASE WHEN size = 'conflict' THEN 'size' END, CASE WHEN pack = 'conflict' THEN 'pack' END, CASE WHEN variant = 'conflict' THEN 'variant' END, CASE WHEN codes = 'conflict' THEN 'codes' END, CASE WHEN type IN ('type_conflict', 'department_conflict') THEN 'type' END, CASE WHEN gtin = 'different' THEN 'gtin' END], lambda x: x IS NOT NULL)) AS reasons,
20 * (type IN ('same_type', 'type_partial'))::INT + 25 * (size IN ('exact', 'close', 'ounce_bridge'))::INT + 20 * (brand IN ('exact', 'fuzzy'))::INT + CAST(floor(45 * similarity + 0.5) AS INT) AS score, gtin, brand FROM lv)"""


@query(f"WITH {_CONFLICTS} SELECT a, b, array_to_string(reasons, ',') AS conflicts, CAST(score AS BIGINT) AS score, CASE WHEN len(reasons) > 0 THEN 'not_comparable' WHEN gtin = 'missing' OR brand NOT IN ('exact', 'fuzzy') THEN 'review_required' ELSE 'comparable' END AS status FROM cf")
def d_pair_status(spark, sf):
    """Hard conflicts of a pair, its score of 100 (20 type, 25 size, 20 brand, 45 name, capped
    by its parts) and whether it is comparable: conflicts first, then missing evidence."""
    return C.pair_status(C.levels(_pairs(spark, sf))).select("a", "b", "conflicts", "score", "status")


_GROUPS = f"""{_STD}, mem AS (SELECT s.product_id, s.supermarket_id, s.gtin, s.brand, s.size, s.type FROM std s WHERE s.gtin IS NOT NULL),
gr AS (SELECT gtin, count(*) AS n, count(DISTINCT supermarket_id) AS n_chains, count(DISTINCT brand) AS n_brands, count(DISTINCT type) AS n_types, count(DISTINCT size.dim) AS n_dims, max(size.total) FILTER (WHERE size.dim IN ('g', 'ml')) AS hi, min(size.total) FILTER (WHERE size.dim IN ('g', 'ml')) AS lo, count(brand) AS with_brand FROM mem GROUP BY 1)"""


@query(f"WITH {_GROUPS} SELECT gtin, n, n_chains, CASE WHEN n_chains < 2 THEN 'review_required' WHEN n_brands > 1 OR n_types > 1 OR coalesce(hi > 1.06 * lo, false) THEN 'not_comparable' WHEN n_chains < n OR with_brand < n THEN 'review_required' ELSE 'comparable' END AS status FROM gr")
def d_group_status(spark, sf):
    """The worst status within a number's listings; no pair across chains means review. From
    extremes and distinct counts, so no pairs are built."""
    return C.group_status(_std(spark, sf).where("gtin is not null")).select("gtin", "n", "n_chains", "status")


@query(f"""WITH {_STD}, m AS (SELECT product_id, supermarket_id, gtin, brand, type, size FROM std WHERE gtin IS NOT NULL), c AS (SELECT *, count(*) OVER (PARTITION BY gtin, supermarket_id) AS same_chain, count(brand) OVER (PARTITION BY gtin) AS all_b, count(*) OVER (PARTITION BY gtin, brand) AS same_b, count(type) OVER (PARTITION BY gtin) AS all_t, count(*) OVER (PARTITION BY gtin, type) AS same_t FROM m),
d AS (SELECT *, CASE WHEN same_chain > 1 THEN 'chain_collision' END AS first_reason, CASE WHEN brand IS NULL THEN 0 ELSE all_b - same_b END + CASE WHEN type IS NULL THEN 0 ELSE all_t - same_t END AS degree FROM c),
x AS (SELECT *, max(degree) FILTER (WHERE first_reason IS NULL) OVER (PARTITION BY gtin) AS worst FROM d)
SELECT product_id, gtin, CASE WHEN first_reason IS NOT NULL THEN first_reason WHEN degree > 0 AND degree = worst THEN 'most_conflicts' ELSE 'kept' END AS member FROM x""")
def d_number_members(spark, sf):
    """Members of a number: all of a chain that has it twice are out, then those that differ
    from most others in brand and type; counts of values stand for pairs."""
    return C.number_members(_std(spark, sf).where("gtin is not null")).select("product_id", "gtin", "member")


@query("""WITH l AS (SELECT l.*, m.status AS master_status FROM master_product_links l JOIN master_products m USING (master_product_id) WHERE l.status = 'active'),
d AS (SELECT product_id, supermarket_id, master_product_id, row_number() OVER (PARTITION BY product_id ORDER BY coalesce(confidence, 1.0) DESC, master_product_id, link_id) AS n FROM l WHERE master_status = 'active'), k AS (SELECT *, count(*) OVER (PARTITION BY master_product_id, supermarket_id) AS c FROM d WHERE n = 1)
SELECT CASE WHEN c = 1 THEN 'm:' || master_product_id ELSE 'p:' || product_id END AS group_key, count(*) AS n_offers, count(DISTINCT supermarket_id) AS n_chains, substr(sha256(array_to_string(list_sort(list(CAST(product_id AS VARCHAR))), '|')), 1, 16) AS cluster_id FROM k GROUP BY 1""")
def d_master_groups(spark, sf):
    """Offers grouped by the surest link to an active master; two offers of one chain leave
    the group and stand alone. With the id of the member list."""
    l = read_table(spark, sf, "master_product_links", "link_id", "product_id", "supermarket_id", "master_product_id", "confidence", "status").where("status = 'active'")
    m = read_table(spark, sf, "master_products", "master_product_id", "status").where("status = 'active'").select("master_product_id")
    best = l.join(m, "master_product_id").groupBy("product_id").agg(F.min(F.struct((-F.coalesce("confidence", F.lit(1.0))).alias("o"), "master_product_id", "link_id", "supermarket_id")).alias("b")).select("product_id", "b.master_product_id", "b.supermarket_id")
    c = best.groupBy("master_product_id", "supermarket_id").agg(F.count("*").alias("c"))
    key = F.when(F.col("c") == 1, F.concat(F.lit("m:"), "master_product_id")).otherwise(F.concat(F.lit("p:"), F.col("product_id").cast("string")))
    g = best.join(c, ["master_product_id", "supermarket_id"]).select(key.alias("group_key"), "product_id", "supermarket_id")
    ids = F.array_join(F.array_sort(F.collect_list(F.col("product_id").cast("string"))), "|")  # at most one a chain
    return g.groupBy("group_key").agg(F.count("*").alias("n_offers"), F.count_distinct("supermarket_id").alias("n_chains"), F.left(F.sha2(ids, 256), F.lit(16)).alias("cluster_id"))


@query(f"""WITH {_GROUPS}, want AS (SELECT DISTINCT 'mp_' || substr(sha256(m.gtin), 1, 16) AS master_id, m.product_id FROM mem m JOIN gr USING (gtin) WHERE gr.n_chains >= 2 AND gr.n_brands <= 1 AND gr.n_chains = gr.n), have AS (SELECT DISTINCT product_id FROM master_product_links WHERE status = 'active')
SELECT w.product_id, w.master_id, CASE WHEN h.product_id IS NULL THEN 'new_link' ELSE 'linked' END AS plan FROM want w LEFT JOIN have h USING (product_id)""")
def d_desired_links(spark, sf):
    """Masters that numbers of one listing a chain should have, and links still to be made."""
    s = tabled(_std(spark, sf).where("gtin is not null").select("product_id", "supermarket_id", "gtin", "brand"), "numbered")
    ok = s.groupBy("gtin").agg(F.count("*").alias("n"), F.count_distinct("supermarket_id").alias("c"), F.count_distinct("brand").alias("b")).where("c >= 2 and b <= 1 and c = n").select("gtin")
    have = read_table(spark, sf, "master_product_links", "product_id", "status").where("status = 'active'").select("product_id").distinct().withColumn("linked", F.lit(True))
    w = s.join(ok, "gtin").select("product_id", F.concat(F.lit("mp_"), F.left(F.sha2("gtin", 256), F.lit(16))).alias("master_id"))
    return w.join(have, "product_id", "left").select("product_id", "master_id", F.when(F.col("linked").isNull(), "new_link").otherwise("linked").alias("plan"))


@query("""WITH c AS (SELECT product_id, regexp_replace(coalesce(source_item_id, ''), '[^0-9]', '', 'g') AS d, ean FROM products), p AS (SELECT product_id, CASE WHEN length(d) BETWEEN 7 AND 13 THEN lpad(d, 13, '0') END AS b, ean FROM c),
s AS (SELECT *, list_sum([CAST(substr(b, i, 1) AS INT) * (CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END) for i in range(1, 14)]) AS t FROM p), e AS (SELECT product_id, b || CAST((10 - t % 10) % 10 AS VARCHAR) AS rebuilt, regexp_replace(coalesce(ean, ''), '[^0-9]', '', 'g') AS own FROM s)
SELECT product_id, rebuilt, CASE WHEN length(own) IN (8, 12, 13, 14) THEN 'ean' WHEN rebuilt IS NOT NULL THEN 'code' ELSE 'none' END AS number_source FROM e""")
def h_rebuilt_numbers(spark, sf):
    """Numbers rebuilt from internal codes by their check digit, and where a number comes from."""
    p = read_table(spark, sf, "products", "product_id", "source_item_id", "ean")
    r = G.with_check_digit(G.digits(F.col("source_item_id")))
    return p.select("product_id", r.alias("rebuilt"), F.when(F.length(G.digits(F.col("ean"))).isin(8, 12, 13, 14), "ean").when(r.isNotNull(), "code").otherwise("none").alias("number_source"))


@query(f"WITH {_STD} SELECT coalesce(type, 'unassigned') AS product_type, count(*) AS n_listings, count(DISTINCT supermarket_id) AS n_chains, count(*) FILTER (WHERE brand IS NOT NULL) AS n_branded, count(*) FILTER (WHERE size IS NOT NULL) AS n_sized, count(*) FILTER (WHERE gtin IS NOT NULL) AS n_numbered FROM std GROUP BY 1")
def d_profiles(spark, sf):
    """Listings by assigned type, and how complete their profiles are."""
    return _std(spark, sf).groupBy(F.coalesce("type", F.lit("unassigned")).alias("product_type")).agg(F.count("*").alias("n_listings"), F.count_distinct("supermarket_id").alias("n_chains"), F.count("brand").alias("n_branded"), F.count("size").alias("n_sized"), F.count("gtin").alias("n_numbered"))


@query(f"""WITH {_STD}, g AS (SELECT gtin, brand, dim, total, count(*) AS n FROM (SELECT gtin, brand, size.dim AS dim, size.total AS total FROM std WHERE gtin IS NOT NULL AND size IS NOT NULL) GROUP BY 1, 2, 3, 4), s AS (SELECT gtin, dim, total, sum(n) AS n FROM g GROUP BY 1, 2, 3), t AS (SELECT gtin, sum(n) AS all_n, max(n) AS best FROM s GROUP BY 1)
SELECT t.gtin, CAST(t.all_n AS BIGINT) AS n_sized, CASE WHEN 2 * t.best > t.all_n THEN 'majority' ELSE 'open' END AS decision, CASE WHEN 2 * t.best > t.all_n THEN max(s.total) END AS total FROM t JOIN s ON s.gtin = t.gtin AND s.n = t.best GROUP BY t.gtin, t.all_n, t.best""")
def a_majority_sizes(spark, sf):
    """Per number the size that more than half of its sized listings state."""
    s = _std(spark, sf).where("gtin is not null and size is not null").groupBy("gtin", "size.dim", "size.total").agg(F.count("*").alias("n"))
    t = s.groupBy("gtin").agg(F.sum("n").alias("n_sized"), F.max(F.struct("n", "total")).alias("b"))
    most = 2 * F.col("b.n") > F.col("n_sized")
    return t.select("gtin", "n_sized", F.when(most, "majority").otherwise("open").alias("decision"), F.when(most, F.col("b.total")).alias("total"))


@query(f"WITH {_STD} SELECT s.gtin, s.product_id, row_number() OVER (PARTITION BY s.gtin ORDER BY same DESC, len(bag) DESC, length(folded) DESC, product_id) AS place FROM (SELECT *, count(*) OVER (PARTITION BY gtin, folded) AS same FROM std WHERE gtin IS NOT NULL) s")
def w_display_order(spark, sf):
    """Members of a number in the order in which one of them would speak for all."""
    s = _std(spark, sf).where("gtin is not null").select("gtin", "product_id", "folded", F.size("core").alias("n_core"))
    same = s.groupBy("gtin", "folded").agg(F.count("*").alias("same"))
    w = W.partitionBy("gtin").orderBy(F.desc("same"), F.desc("n_core"), F.desc(F.length("folded")), "product_id")
    return s.join(same, ["gtin", "folded"]).select("gtin", "product_id", F.row_number().over(w).cast("long").alias("place"))


@query("""WITH p AS (SELECT product_id, replace(coalesce(nullif(trim(brand), ''), ''), '®', '') AS b, ean FROM products), r AS (SELECT supermarket_id, lower(trim(name)) AS n FROM products WHERE name IS NOT NULL) SELECT n AS name_key, count(*) AS n_listings, count(DISTINCT supermarket_id) AS n_chains, array_to_string(list_sort(list(DISTINCT supermarket_id)), ',') AS chains FROM r GROUP BY 1 HAVING count(*) > 1""")
def j_shared_names(spark, sf):
    """Names that several listings share, with their chains."""
    r = read_table(spark, sf, "products", "supermarket_id", "name").where("name is not null")
    g = r.groupBy(F.lower(F.trim("name")).alias("name_key")).agg(F.count("*").alias("n_listings"), F.count_distinct("supermarket_id").alias("n_chains"), F.array_join(F.array_sort(F.collect_set("supermarket_id")), ",").alias("chains"))
    return g.where("n_listings > 1")


@query(f"""WITH {_STD}, m AS (SELECT master_product_id, {_BRAND_SQL.format("brand")} AS brand, product_type, try_cast(replace(net_content_value, ',', '.') AS DOUBLE) AS v FROM master_products WHERE status = 'active'),
mm AS (SELECT *, CASE WHEN v > 0 THEN CAST(floor(ln(v) / ln(1.25)) AS INT) END AS bucket FROM m), ss AS (SELECT product_id, brand, type, core_all[1] AS lead, CASE WHEN size.dim IN ('g', 'ml') THEN CAST(floor(ln(size.total) / ln(1.25)) AS INT) END AS bucket FROM std),
votes AS (SELECT s.product_id, m.master_product_id, 3 AS vote FROM ss s JOIN mm m ON s.brand = m.brand AND m.brand IS NOT NULL UNION ALL SELECT s.product_id, m.master_product_id, 2 FROM ss s JOIN mm m ON s.brand = m.brand AND abs(s.bucket - m.bucket) <= 1 UNION ALL SELECT s.product_id, m.master_product_id, 1 FROM ss s JOIN mm m ON s.brand = m.brand AND starts_with(m.product_type, s.lead)),
v AS (SELECT product_id, master_product_id, sum(vote) AS votes FROM votes GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY votes DESC, master_product_id) AS place FROM v) SELECT product_id, master_product_id, CAST(votes AS BIGINT) AS votes, place FROM r WHERE place <= 3""")
def t_master_candidates(spark, sf):
    """The three active masters with most votes of a listing: brand 3, size bucket next to it 2, type begins with its leading word 1."""
    m = read_table(spark, sf, "master_products", "master_product_id", "brand", "product_type", "net_content_value", "status").where("status = 'active'")
    v = F.replace("net_content_value", F.lit(","), F.lit(".")).try_cast("double")
    m = m.select("master_product_id", S.normal_brand(F.col("brand")).alias("brand"), "product_type", F.when(v > 0, C.size_bucket(v)).alias("mb"))
    s = _std(spark, sf).where("brand is not null").select("product_id", "brand", F.get("core", F.lit(0)).alias("lead"), F.when(F.col("size.dim").isin("g", "ml"), C.size_bucket(F.col("size.total"))).alias("sb"))
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    # votes depend on bucket and type only: the three least ids of each stand for all of them
    few = m.withColumn("n", F.row_number().over(W.partitionBy("brand", "mb", "product_type").orderBy("master_product_id"))).where("n <= 3").drop("n")
    kinds = s.select("brand", "lead", "sb").distinct()
    j = kinds.join(few, "brand").withColumn("votes", (3 + 2 * yes(F.abs(F.col("sb") - F.col("mb")) <= 1) + yes(F.startswith("product_type", F.col("lead")))).cast("long"))
    w = W.partitionBy("brand", "lead", "sb").orderBy(F.desc("votes"), "master_product_id")
    best = j.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3")
    alike = s.brand.eqNullSafe(best.brand) & s.lead.eqNullSafe(best.lead) & s.sb.eqNullSafe(best.sb)
    return s.join(best, alike).select(s.product_id, "master_product_id", "votes", "place")
