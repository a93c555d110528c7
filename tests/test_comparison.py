from itertools import combinations

import pytest
from pyspark.sql import functions as F

from almudi.functions import gtin as G
from almudi.functions import listing as S
from almudi.operators import comparison as C

PROD = "product_id long, supermarket_id string, name string, brand string, presentation string, category string, ean string, size string, type string"


def _products(spark, rows):
    return spark.createDataFrame([(i, *r, "x", "y") for i, r in enumerate(rows)], PROD)


ROWS = [
    ("a", "Leche Entera Zuvare 946 ml", "Zuvare", None, "Lácteos", "4006381333931"), ("b", "ZUVARE LECHE ENTERA 0.946 L", "Marca Zuvare®", "x", "Super > LACTEOS", "4006381333931"),
    ("b", "Leche Entera Zuvare 1,000 ml", "S/M", "1 L", None, None), ("c", "Leche Descremada Zuvare 32 oz", "Zuvare", "", "Lácteos", "2012345678900"),
    ("a", None, None, None, None, None), ("c", "", "", "", "", ""), ("c", "Cable V8 6 x 2 lb pack", "Otros", "3 kg", "Ferreteria", "123"), ("b", "Leche Entera Zuvare 946 ml", "Zuvare", None, "Lácteos", None),
]


def test_standard_form(spark):
    r = {x.product_id: x for x in S.standardized(_products(spark, ROWS)).collect()}
    assert (r[0].brand, r[0].core, r[0].size.dim, r[0].size.total, r[0].type, r[0].gtin) == ("zuvare", ["leche", "entera"], "ml", 946.0, "leche", "04006381333931")
    assert (r[1].brand, r[1].size.total, r[1].leaf) == ("zuvare", 946.0, "lacteos") and r[2].brand is None and r[2].size.total == 1000.0
    assert r[3].gtin is None and r[3].size.dim == "oz" and r[3].variants == ["fat:descremada"]
    assert all((r[i].brand, r[i].size, r[i].core) == (None, None, []) for i in (4, 5)) or r[5].core == [""]
    assert (r[6].codes, r[6].size.packs, r[6].size.total, r[6].size.imperial) == (["v8"], 6, pytest.approx(5443.108, abs=1e-3), True)
    assert S.standardized(_products(spark, ROWS).where("false")).count() == 0


def test_candidates_against_brute_force(spark):
    """Copies, ties and a hot block: the likest of every other chain, as if all were compared."""
    rows = ROWS + [("abc"[i % 3], f"Leche Entera Zuvare {('dulce', 'fina', 'rica', 'pura')[i % 4]} 946 ml", "Zuvare", None, None, None) for i in range(40)]
    std = S.standardized(_products(spark, rows))
    p = std.withColumn("bucket", C.size_bucket(F.col("size.total"))).collect()
    want = set()
    for x in p:
        best = {}
        for y in p:
            by_size = x.squashed and x.squashed == y.squashed and x.size and y.size and x.size.dim == y.size.dim and abs(x.bucket - y.bucket) <= 1
            typed = x.type and x.type == y.type and x.squashed and x.squashed == y.squashed and x.core[:1] == y.core[:1]
            if x.supermarket_id != y.supermarket_id and (by_size or typed or (x.gtin and x.gtin == y.gtin)):
                u = set(x.core) | set(y.core)
                best.setdefault(y.supermarket_id, []).append((-len(set(x.core) & set(y.core)) / len(u) if u else 0.0, y.product_id))
        want |= {(min(x.product_id, i), max(x.product_id, i)) for c in best.values() for _, i in sorted(c)[:6]}
    got = C.candidates(std, 6).collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want)
    assert C.candidates(std.where("false"), 6).count() == 0


def test_levels_and_status(spark):
    std = S.standardized(_products(spark, ROWS))
    pairs = spark.createDataFrame([(a, b, 0.5) for a, b in combinations(range(len(ROWS)), 2)], "a long, b long, similarity double")
    lv = {(r.a, r.b): r for r in C.pair_status(C.levels(C.with_sides(pairs, std))).collect()}
    assert len(lv) == 28
    assert (lv[0, 1].brand, lv[0, 1].size, lv[0, 1].gtin, lv[0, 1].status) == ("exact", "exact", "same", "comparable")
    assert (lv[0, 2].brand, lv[0, 2].size) == ("in_other_name", "near") and lv[0, 3].size == "ounce_bridge" and lv[0, 3].variant == "conflict"
    assert (lv[4, 5].brand, lv[4, 5].size, lv[4, 5].pack, lv[4, 5].codes) == ("both_missing", "missing", "missing", "none")
    assert lv[0, 6].brand == "one_missing" and lv[0, 6].status == "not_comparable"


def test_size_levels(spark):
    size = "struct<dim:string,packs:int,total:double,imperial:boolean>"
    rows = [(("g", 1, 100.0, False), (d, 1, t, False)) for d, t in (("g", 101.5), ("g", 104.0), ("g", 110.0), ("oz", 3.5), ("unit", 5.0), ("ml", 100.0))] + [(("g", 1, 1000.0, False), ("g", 1, t, False)) for t in (1004.0, 1015.0, 1050.0)] + [(None, ("g", 1, 1.0, False))]
    got = [r[0] for r in spark.createDataFrame(rows, f"a {size}, b {size}").select(C.size_level(F.col("a"), F.col("b"))).collect()]
    assert got == ["exact", "near", "conflict", "ounce_bridge", "missing", "conflict", "exact", "close", "near", "missing"]


def test_unit_prices_medians_and_packs(spark):
    rows = [(i, "t", "g", 1, 100.0, p) for i, p in enumerate([10, 10, 10, 20, 30, 40, 50, 60])] + [(9, "u", "g", 1, 100.0, 5)]
    df = spark.createDataFrame(rows, "id long, type string, dim string, packs int, total double, price long").withColumn("unit_price", C.unit_price(F.col("price"), F.col("total"), F.col("dim")))
    assert [(r.type, r.median, r.n_rows) for r in C.unit_medians(df, 8).collect()] == [("t", 300, 8)]
    odd = spark.createDataFrame([(1, 8.0), (3, 8.0), (5, 8.0), (None, 8.0)], "price long, total double").select(C.unit_price(F.col("price"), F.col("total"), F.lit("unit"))).collect()
    assert [r[0] for r in odd] == [0, 0, 1, None]
    v = spark.createDataFrame([(1, 10, 10), (4, 10, 100), (4, 40, 80), (4, 10, None)], "packs int, price long, median long").select(C.pack_verdict(F.col("packs"), F.col("price"), F.col("median"))).collect()
    assert [r[0] for r in v] == ["single", "total", "each", "each"]


def test_weights_and_metrics(spark):
    rows = [(i, i + 1, "exact" if i % 4 else "conflict", "same" if i % 4 else "different") for i in range(40)]
    df = spark.createDataFrame(rows, "a long, b long, brand string, gtin string").select("*", *[F.lit("none").alias(f) for f in C.Weights.FIELDS if f != "brand"])
    w = {(r.brand): r.weight for r in C.Weights(df).scored().collect()}
    assert w["exact"] > 3 > -3 > w["conflict"]
    assert spark.createDataFrame([(0.0,), (61.0,), (-61.0,), (1.0,)], "w double").select(C.probability("w")).collect() == [(0.5,), (1.0,), (0.0,), (2 / 3,)]
    m = spark.createDataFrame([("x", True, True), ("x", False, True), ("y", True, False)], "g string, m boolean, a boolean")
    got = {r.g: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in C.band_metrics(m, "g", "m", "a").collect()}
    assert got == {"x": (1, 1, 0, 0.5, 1.0), "y": (0, 0, 1, None, 0.0), "all": (1, 1, 1, 0.5, 0.5)}
    assert C.band_metrics(m.where("false"), "g", "m", "a").count() == 0


def test_number_members_against_pairs(spark):
    rows = [(i, "abcd"[i % 4], f"g{i % 5}", ("u", "v", "u", None)[i % 7 % 4], ("t", None)[i % 3 % 2]) for i in range(12)]
    got = {r.product_id: r.member for r in C.number_members(spark.createDataFrame(rows, "product_id long, supermarket_id string, gtin string, brand string, type string")).collect()}
    for g in {r[2] for r in rows}:
        mine = [r for r in rows if r[2] == g]
        twice = {r[0] for r in mine if sum(o[1] == r[1] for o in mine) > 1}
        degree = {r[0]: sum((r[k] is not None) and o[k] is not None and o[k] != r[k] for o in mine for k in (3, 4)) for r in mine}
        worst = max((degree[r[0]] for r in mine if r[0] not in twice), default=0)
        for r in mine:
            assert got[r[0]] == ("chain_collision" if r[0] in twice else "most_conflicts" if degree[r[0]] and degree[r[0]] == worst else "kept")


def test_check_digits(spark):
    rows = [("400638133393", "04006381333931"), ("3600029145", None), ("x", None), (None, None), ("", None)]
    got = spark.createDataFrame([(c,) for c, _ in rows], "c string").select(G.with_check_digit(F.col("c")).alias("g"), G.check_digit_ok(G.with_check_digit(F.col("c"))).alias("ok")).collect()
    assert got[0].g == rows[0][1] and all(r.ok for r in got[:2]) and [r.g for r in got[2:]] == [None] * 3
    reasons = {"90000000000000": "variable_measure", "00000020000004": "short_in_store", "02012345678903": "in_store", "00201234567890": "variable_measure_upc", "09812345678903": "coupon", "04006381333931": None}
    assert {r.c: r.w for r in spark.createDataFrame([(c,) for c in reasons], "c string").select("c", G.restricted_reason(F.col("c")).alias("w")).collect()} == reasons
