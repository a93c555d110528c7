from pyspark.sql import functions as F

from almudi.operators import market as M


def test_restricted_numbers_need_one_shared_master(spark):
    rows = [(1, "a", "g"), (2, "b", "g"), (3, "c", "g"), (4, "a", "h"), (5, "c", "h"), (6, "c", "i"), (7, "d", "i"), (8, "a", "i"), (9, "b", "i")]
    got = {r.product_id: r.member for r in M.shared_master_members(spark.createDataFrame(rows, "product_id long, supermarket_id string, gtin string"), {"a": "x", "b": "x", "c": "y", "d": "y"}).collect()}
    assert got == {1: "allowed", 2: "allowed", 3: "excluded", 4: "excluded", 5: "excluded", 6: "excluded", 7: "excluded", 8: "excluded", 9: "excluded"}


def test_mutations(spark, ts):
    rows = [(1, "l", ts(i), p) for i, p in enumerate([None, 5, 5, 6, None, None, 7])]
    r = M.mutations(spark.createDataFrame(rows, "product_id long, location_id string, valid_from_utc timestamp, current_price_minor long")).first()
    assert (r.n_opened, r.n_changed, r.n_confirmed, r.n_closed, r.n_reopened, r.n_still_unpriced) == (0, 1, 1, 1, 2, 2)


def test_price_index_and_loose_goods(spark):
    c = spark.createDataFrame([("g", "a", 100), ("g", "b", 200), ("g", "c", 301), ("h", "a", 10), ("h", "b", 30)], "gtin string, supermarket_id string, price long")
    got = {(r.gtin, r.supermarket_id): (r.mean_x100, r.median_x100, r.spread, r.pci_x100) for r in M.price_index(c).collect()}
    assert got["g", "a"] == (20033, 20000, 201, 5000) and got["h", "b"] == (2000, 2000, 20, 15000)
    goods = spark.createDataFrame([(1, "a", "t", "g", 10), (2, "b", "t", "g", 15), (3, "c", "t", "g", 500), (4, "a", "t", "g", 10), (5, "a", "u", "g", 10)], "product_id long, supermarket_id string, type string, dim string, unit_price long")
    assert {r.product_id: (r.n_chains, r.best_elsewhere) for r in M.loose_matches(goods).collect()} == {1: (1, 15), 2: (1, 10), 4: (1, 15)}


def test_reductions_inserts_and_empty(spark, ts):
    v = spark.createDataFrame([(1, "l", ts(0), ts(1), 9), (1, "l", ts(1), None, 7), (2, "l", ts(0), None, None)], "product_id long, location_id string, valid_from timestamp, valid_to timestamp, price long")
    assert {r.product_id: (r.previous, r.reduction, r.is_real) for r in M.real_reductions(v).collect()} == {1: (9, 2, True), 2: (None, None, False)}
    e, i = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string"), spark.createDataFrame([(1, "a"), (2, None), (2, "x"), (3, "c")], "k long, v string")
    assert sorted((r.k, r.outcome) for r in M.insert_absent(e, i, ["k"], ["v"]).collect()) == [(1, "present"), (2, "conflict"), (2, "present"), (3, "inserted")]
    assert M.real_reductions(v.where("false")).count() == M.insert_absent(e, i.where("false"), ["k"], ["v"]).count() == 0


def test_weighted_bands(spark):
    l = spark.createDataFrame([("m", "hi", True), ("m", "hi", False), ("n", "hi", True)], "link_method string, band string, match boolean")
    r = M.weighted_bands(l, spark.createDataFrame([("m", 20), ("n", 1)], "link_method string, population long")).first()
    assert (r.labelled, r.matches, r.precision, r.precision_weighted) == (3, 2, 0.6667, round(11 / 21, 4))
    assert M.weighted_bands(l.where(F.lit(False)), spark.createDataFrame([], "link_method string, population long")).count() == 0
