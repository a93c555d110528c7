"""Listings out of the nested payloads of shop platforms, by built-in JSON expressions.

Each parser takes (page_id, payload) and returns the same columns: page_id, product_id,
item_id, name, brand, reference, ean, category, price_minor, regular_minor, available, and
``fault`` - why a row must not be used, or null. Faulty rows are kept apart, never dropped:
``split`` parts them.

Defined results
    * null payloads and texts that aren't the expected JSON give one row with fault 'payload'.
    * a product or variant delivered twice in a page: fault 'repeated' on every copy.
    * prices are rounded to cents, halves up; absent, negative or zero ones are faults.
    * lists that are absent or empty give no rows; unknown fields are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almudi.functions import gtin as G

COLUMNS = ("page_id", "product_id", "item_id", "name", "brand", "reference", "ean", "category", "price_minor", "regular_minor", "available")

_SEARCH = "data struct<productSearch:struct<products:array<struct<productId:string,productName:string,brand:string,categories:array<string>,items:array<struct<itemId:string,ean:string,sellers:array<struct<commertialOffer:struct<Price:double,ListPrice:double,AvailableQuantity:double>>>>>>>>>"
_FEED = "products array<struct<id:bigint,handle:string,title:string,vendor:string,product_type:string,variants:array<struct<id:bigint,product_id:bigint,sku:string,barcode:string,price:string,compare_at_price:string,available:boolean>>>>"
_CATALOG = "products array<struct<code:string,name:string,brandName:string,materialGroupName:string,price:double,offerPrice:double,stock:double>>"
_GROUPS = "groups array<struct<category_id:string,category_name:string,documents:array<struct<pid:string,title:string,brand:string,price:double>>>>"


def _text(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def _minor(c: Column) -> Column:
    return F.floor(c.try_cast("decimal(18,4)") * 100 + F.lit("0.5").cast("decimal(2,1)")).cast("long")


def _parsed(pages: DataFrame, schema: str) -> DataFrame:
    return pages.select("page_id", F.from_json("payload", schema).alias("x"))


def _judged(rows: DataFrame, broken: DataFrame) -> DataFrame:
    """The common columns with faults, and a row for every page that couldn't be read."""
    key = W.partitionBy("page_id", "product_id", "item_id")
    fault = (
        F.when(F.col("product_id").isNull(), "product_id").when(F.col("name").isNull(), "name").when(F.count("*").over(key) > 1, "repeated")
        .when(F.col("price_minor").isNull() | (F.col("price_minor") <= 0), "price").when(F.col("regular_minor") < F.col("price_minor"), "regular_below_price")
    )
    good = rows.select(*COLUMNS, fault.alias("fault"))
    bad = broken.select("page_id", *[F.lit(None).cast(good.schema[c].dataType).alias(c) for c in COLUMNS[1:]], F.lit("payload").alias("fault"))
    return good.unionByName(bad)


def search_results(pages: DataFrame) -> DataFrame:
    """Search answers: products with items, each with sellers' offers; the first offer counts."""
    p = _parsed(pages, _SEARCH)
    products = F.col("x.data.productSearch.products")
    item = p.select("page_id", F.explode(products).alias("p")).select("page_id", "p", F.explode("p.items").alias("i"))
    offer = F.get(F.col("i.sellers"), F.lit(0))["commertialOffer"]
    rows = item.select(
        "page_id", _text(F.col("p.productId")).alias("product_id"), _text(F.col("i.itemId")).alias("item_id"), _text(F.col("p.productName")).alias("name"), _text(F.col("p.brand")).alias("brand"), F.lit(None).cast("string").alias("reference"),
        G.canonical_gtin(F.col("i.ean")).alias("ean"), _text(F.get("p.categories", F.lit(0))).alias("category"), _minor(offer["Price"]).alias("price_minor"), _minor(offer["ListPrice"]).alias("regular_minor"), (offer["AvailableQuantity"] > 0).alias("available"),
    )
    return _judged(rows, p.where(products.isNull()))


def product_feed(pages: DataFrame) -> DataFrame:
    """Feeds of products with variants; a variant of another product is at fault. A number is
    taken from the barcode, else from the stock code if it is one."""
    p = _parsed(pages, _FEED)
    v = p.select("page_id", F.explode("x.products").alias("p")).select("page_id", "p", F.explode("p.variants").alias("v"))
    own = F.coalesce(F.col("v.product_id") == F.col("p.id"), F.lit(False)) & F.coalesce(F.col("p.handle").rlike("^[a-z0-9][a-z0-9-]*$"), F.lit(False))
    rows = v.select(
        "page_id", F.when(own, F.col("p.id").cast("string")).alias("product_id"), F.col("v.id").cast("string").alias("item_id"), _text(F.col("p.title")).alias("name"), _text(F.col("p.vendor")).alias("brand"), _text(F.col("v.sku")).alias("reference"),
        F.coalesce(G.canonical_gtin(F.col("v.barcode")), G.canonical_gtin(F.col("v.sku"))).alias("ean"), _text(F.col("p.product_type")).alias("category"), _minor(F.col("v.price")).alias("price_minor"), _minor(F.col("v.compare_at_price")).alias("regular_minor"), F.col("v.available").alias("available"),
    )
    return _judged(rows, p.where("x.products is null"))


def catalog_pages(pages: DataFrame) -> DataFrame:
    """Catalogue pages whose code is a number without its check digit; the offer's price counts
    where there is one."""
    p = _parsed(pages, _CATALOG)
    c = p.select("page_id", F.explode("x.products").alias("c"))
    code = _text(F.col("c.code"))
    offered = F.col("c.offerPrice").isNotNull() & (F.col("c.offerPrice") > 0)
    rebuilt = F.when(F.length(code).isin(7, 10, 11, 12) & ~F.startswith(code, F.lit("99")), G.with_check_digit(code))
    rows = c.select(
        "page_id", code.alias("product_id"), code.alias("item_id"), _text(F.col("c.name")).alias("name"), _text(F.col("c.brandName")).alias("brand"), code.alias("reference"), F.when(~G.restricted(rebuilt), rebuilt).alias("ean"), _text(F.col("c.materialGroupName")).alias("category"),
        _minor(F.when(offered, F.col("c.offerPrice")).otherwise(F.col("c.price"))).alias("price_minor"), _minor(F.when(offered, F.col("c.price"))).alias("regular_minor"), (F.col("c.stock") > 0).alias("available"),
    )
    return _judged(rows, p.where("x.products is null"))


def memberships(pages: DataFrame) -> DataFrame:
    """(page_id, pid, title, brand, price_minor, categories, n_versions): documents listed under
    several roots once, with all roots; ``n_versions`` over 1 marks copies that disagree."""
    g = _parsed(pages, _GROUPS).select("page_id", F.explode("x.groups").alias("g")).select("page_id", "g.category_name", F.explode("g.documents").alias("d")).where("d.pid is not null")
    m = g.groupBy("page_id", "d.pid").agg(F.min("d").alias("d"), F.count_distinct(F.to_json("d")).alias("n_versions"), F.array_join(F.array_sort(F.collect_set("category_name")), " | ").alias("categories"))
    return m.select("page_id", "pid", "d.title", "d.brand", _minor(F.col("d.price")).alias("price_minor"), "categories", "n_versions")


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable rows, quarantined rows with their fault)."""
    return rows.where("fault is null").drop("fault"), rows.where("fault is not null")


def snapshot_faults(rows: DataFrame, expected: DataFrame, most_quarantined: float = 0.02) -> DataFrame:
    """Per page, whether a snapshot may be used: the count that the source reported, the digest
    of its sorted distinct keys, and the share of quarantined rows. ``expected`` has page_id,
    n_products and, where known, key_sha."""
    keys = F.sha2(F.array_join(F.array_sort(F.collect_set("product_id")), ","), 256)  # one page's keys
    s = rows.groupBy("page_id").agg(F.count_distinct("product_id").alias("n"), F.count("*").alias("n_rows"), F.count("fault").alias("n_faults"), keys.alias("sha"))
    j = expected.join(s, "page_id", "left")
    checks = {"missing": F.col("n").isNull(), "count": F.col("n") != F.col("n_products"), "keys": F.col("key_sha") != F.col("sha"), "quarantine": F.col("n_faults") > most_quarantined * F.col("n_rows")}
    why = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in checks.items()]), lambda x: x.isNotNull())
    return j.select("page_id", F.array_join(why, ",").alias("faults"), (F.size(why) == 0).alias("usable"))
