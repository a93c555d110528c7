import json

from almudi.operators import nested

PAGES = "page_id long, club string, payload string, pk string"


def _visit(doc):
    return [(t, k, p, x) for t, k, p, x in nested.visit(1, "6602", json.dumps(doc))]


def test_prices_in_cents_and_lempiras():
    cases = {34057: 34057, "34057": 34057, "678.58": 67858, "678,5": 67850, "0.005": 1, 12.0: 12, 12.5: 1250, None: None, "": None, "x": None, True: None}
    assert {k: nested.price_minor(k) for k in cases} == cases


def test_positions_lone_values_and_missing_prices():
    doc = {"documents": {"pid": 7, "variants": {"skuid": 5, "price_HN_6602": [None, 100, "1.50"], "availability_HN_6602": ["true", "FALSE"]}}}
    prices = [x for t, _, _, x in _visit(doc) if t == "price"]
    assert [(x["pid"], x["variant_pos"], x["skuid"], x["entry_pos"], x["price_minor"], x["availability"]) for x in prices] == [("7", 0, "5", 1, 100, "false"), ("7", 0, "5", 2, 150, "unknown")]
    bare = [x for t, _, _, x in _visit({"data": {"documents": [{"pid": "a", "variants": [None, {"availability_HN_6602": True}]}]}}) if t == "price"]
    assert [(x["variant_pos"], x["skuid"], x["entry_pos"], x["price_minor"], x["availability"]) for x in bare] == [(1, "", 0, -1, "true")]


def test_documents_by_key_and_without_variants():
    rows = _visit({"documents": {"11": {"title": "x", "variants": []}, "12": {"pid": "z", "variants": None}}})
    assert [x["pid"] for t, _, _, x in rows if t == "document"] == ["11", "z"]
    assert not [1 for t, *_ in rows if t in ("variant", "price")]


def test_incomplete_json_and_parents(spark):
    good = json.dumps({"documents": [{"pid": "1", "variants": [{"skuid": "s", "price_HN_6602": [5, 6]}]}]})
    rows = [(1, "6602", good, "x"), (2, None, good[:-3], None), (3, "6602", None, None), (4, "6602", "", None), (5, "6602", '{"documents": [NaN]}', None), (6, "6602", "[]", None)]
    flat = nested.FlatTables(spark.createDataFrame(rows, PAGES))
    assert {(r.page_id, r.is_complete) for r in flat.table("page").collect()} == {(1, True), (2, False), (3, False), (4, False), (5, False), (6, True)}
    prices = flat.table("price")
    assert sorted((r.page_id, r.entry_pos, r.price_minor) for r in prices.collect()) == [(1, 0, 5), (1, 1, 6)]
    for child, parent in (("document", "page"), ("variant", "document"), ("price", "variant")):
        keys = {r.pk for r in flat.table(parent).collect()}
        assert all(r.parent_pk in keys for r in flat.table(child).collect())


def test_empty_table(spark):
    flat = nested.FlatTables(spark.createDataFrame([], PAGES))
    assert flat.table("price").count() == 0 and flat.table("page").count() == 0
