"""Scalar functions against plain Python and known values."""

from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from almudi.functions import gtin, ids, text
from almudi.functions.rounding import days, mean_half_up, pct_half_even, pct_half_up


def test_percentages(spark):
    cases = [(1, 8), (-1, 8), (125, 100000), (-125, 100000), (375, 100000), (5, 0), (5, -3), (0, 7), (None, 3), (7, None), (1, 3), (2, 3)]
    rows = spark.createDataFrame(cases, "n long, d long").select("n", "d", pct_half_up(F.col("n"), F.col("d")).alias("up"), pct_half_even(F.col("n"), F.col("d")).alias("even")).collect()
    for r in rows:
        if r.n is None:
            assert r.up is None and r.even is None
        elif r.d is None or r.d <= 0:
            assert r.up == 0.0 and r.even is None
        else:
            exact = Decimal(r.n) * 100 / Decimal(r.d)
            assert Decimal(str(r.up)) == exact.quantize(Decimal("0.01"), ROUND_HALF_UP), r
            assert Decimal(str(r.even)) == exact.quantize(Decimal("0.01"), ROUND_HALF_EVEN), r


def test_means_and_days(spark):
    r = spark.createDataFrame([(7, 2, 43_200_000_000)], "t long, n long, us long").select(mean_half_up(F.col("t"), F.col("n")).alias("m"), days(F.col("us")).alias("d")).first()
    assert (r.m, r.d) == (4, 0.5)


def test_folding(spark):
    rows = [("  Café-MOLÍDO  ñandú ", "cafe molido nandu"), ("", None), ("¡¡!!", None), (None, None), ("a" * 50_000, "a" * 50_000)]
    got = spark.createDataFrame([(a,) for a, _ in rows], "t string").select(text.fold(F.col("t"))).collect()
    assert [r[0] for r in got] == [b for _, b in rows]
    r = spark.createDataFrame([("PanBlanco500g",)], "t string").select(text.split_glued(F.col("t")), text.plural_stem(F.lit("galletas")), text.plural_stem(F.lit("panes")), text.char_ngrams(F.lit("ab c"), 3)).first()
    assert list(r) == ["Pan Blanco 500 g", "galleta", "pane", ["#ab", "ab#", "#c#"]]


def test_gtins(spark):
    cases = {"4006381333931": ("04006381333931", "ean_13"), "036000291452": ("00036000291452", "upc_a"), "96385074": ("00000096385074", "ean_8"), " 4006381333931 ": ("04006381333931", "ean_13"), "4006381333932": (None, "invalid"), "123": (None, "invalid"), None: (None, "invalid"), "": (None, "invalid")}
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", gtin.canonical_gtin(F.col("c")).alias("g"), gtin.gtin_kind(gtin.canonical_gtin(F.col("c"))).alias("k")).collect()
    assert {r.c: (r.g, r.k) for r in rows} == cases
    r = spark.range(1).select(gtin.restricted(F.lit("02012345678903")), gtin.restricted(F.lit("04006381333931")), gtin.restricted(F.lit(None).cast("string"))).first()
    assert list(r) == [True, False, None]


def test_ids(spark):
    kind, value = ids.first_key(("a", F.col("a")), ("b", F.col("b")))
    rows = spark.createDataFrame([(" ", "x"), (None, None), ("y", "x")], "a string, b string").select(kind, value).collect()
    assert [tuple(r) for r in rows] == [("b", "x"), (None, None), ("a", "y")]
    shares = spark.range(5000).select(ids.split_of(F.col("id").cast("string")).alias("s")).groupBy("s").count().collect()
    assert {r.s: round(r["count"] / 5000, 1) for r in shares} == {"train": 0.6, "validation": 0.2, "test": 0.2}


def test_jaro_winkler_known_values():
    assert text.jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    assert text.jaro_winkler_text("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert text.jaro_winkler_text("dixon", "dicksonx") == pytest.approx(0.813333, abs=1e-6)
    assert text.jaro_winkler_text("abcd", "abxy") == pytest.approx(0.733333, abs=1e-6)
    assert text.jaro("", "") == text.jaro("", "a") == 0.0 and text.jaro("adcbaca", "aaadbda") == pytest.approx(0.742857, abs=1e-6) and text.jaro("a", "a") == 1.0


@settings(max_examples=80, deadline=None)
@given(st.text("abcd ", max_size=12), st.text("abcd ", max_size=12))
def test_similarities_are_bounded_and_one_for_equal_texts(a, b):
    for f in (text.jaro, text.jaro_winkler_text, text.token_set_text, text.soft_overlap_text):
        assert 0.0 <= f(a, b) <= 1.0 + 1e-12
    assert text.jaro(a, a) == (1.0 if a else 0.0) and text.token_set_text(a, a) in (0.0, 1.0)
    assert text.soft_overlap_text(a, a) in (0.0, 1.0)
