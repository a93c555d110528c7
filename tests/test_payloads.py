import hashlib
import json

from almudi.sources import payloads as P

PAGE = "page_id long, payload string, name string, brand string"


def _pages(spark, *payloads):
    return spark.createDataFrame([(i, p if p is None or isinstance(p, str) else json.dumps(p), "x", "y") for i, p in enumerate(payloads)], PAGE)


def _rows(df):
    return sorted(((r.page_id, r.product_id, r.item_id, r.ean, r.price_minor, r.regular_minor, r.available, r.fault) for r in df.collect()), key=str)


def test_search_results(spark):
    offer = lambda p, r, q: {"sellers": [{"commertialOffer": {"Price": p, "ListPrice": r, "AvailableQuantity": q}}]}
    page = {"data": {"productSearch": {"products": [{"productId": "7", "productName": " Pan ", "brand": "", "categories": ["/a/"], "items": [{"itemId": "1", "ean": "4006381333931"} | offer(12.345, 15, 3), {"itemId": "2"} | offer(0, 1, 0)]}, {"productId": "8", "items": [{"itemId": "3"} | offer(1, 1, 1)]}, {"productId": "9", "items": []}]}}}
    assert _rows(P.search_results(_pages(spark, page, None, "no", {"data": None}))) == sorted([(0, "7", "1", "04006381333931", 1235, 1500, True, None), (0, "7", "2", None, 0, 100, False, "price"), (0, "8", "3", None, 100, 100, True, "name"), *[(i, *[None] * 6, "payload") for i in (1, 2, 3)]], key=str)


def test_feed_and_repeats(spark):
    v = {"id": 1, "product_id": 5, "sku": "4006381333931", "barcode": None, "price": "10.5", "compare_at_price": None, "available": True}
    page = {"products": [{"id": 5, "handle": "pan-1", "title": "Pan", "variants": [v, v | {"id": 2, "compare_at_price": "9"}, v | {"id": 3, "product_id": 6}, v | {"id": 4}, v | {"id": 4}]}]}
    got = _rows(P.product_feed(_pages(spark, page, {"products": []}, "")))
    assert [(r[2], r[7]) for r in got if r[0] == 0] == [("1", None), ("2", "regular_below_price"), ("4", "repeated"), ("4", "repeated"), ("3", "product_id")] and got[0][3] == "04006381333931"
    assert [r for r in got if r[0]] == [(2, *[None] * 6, "payload")]
    good, bad = P.split(P.product_feed(_pages(spark, page)))
    assert good.count() == 1 and bad.count() == 4


def test_catalog_pages(spark):
    page = {"products": [{"code": "400638133393", "name": "Pan", "price": 10, "offerPrice": 8, "stock": 0}, {"code": "9912345", "name": "Sal", "price": 3}, {"code": " ", "name": "x", "price": 1}]}
    assert _rows(P.catalog_pages(_pages(spark, page))) == sorted([(0, "400638133393", "400638133393", "04006381333931", 800, 1000, False, None), (0, "9912345", "9912345", None, 300, None, None, None), (0, None, None, None, 100, None, None, "product_id")], key=str)


def test_memberships_and_snapshots(spark):
    d = {"pid": "a", "title": "t", "price": 2}
    page = {"groups": [{"category_id": "1", "category_name": "uno", "documents": [d, {"pid": "b", "price": 1}]}, {"category_id": "2", "category_name": "dos", "documents": [d, {"pid": "b", "price": 3}, {"title": "none"}]}]}
    got = {r.pid: (r.categories, r.n_versions, r.price_minor) for r in P.memberships(_pages(spark, page, None)).collect()}
    assert got == {"a": ("dos | uno", 1, 200), "b": ("dos | uno", 2, 100)}
    rows = P.catalog_pages(_pages(spark, {"products": [{"code": c, "name": c, "price": 1} for c in "ba"]}, {"products": [{"code": "a", "name": "a"}]}))
    sha = hashlib.sha256(b"a,b").hexdigest()
    want = spark.createDataFrame([(0, 2, sha), (1, 2, None), (2, 1, None)], "page_id long, n_products long, key_sha string")
    assert {r.page_id: (r.faults, r.usable) for r in P.snapshot_faults(rows, want).collect()} == {0: ("", True), 1: ("count,quarantine", False), 2: ("missing", False)}
