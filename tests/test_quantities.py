import pytest
from pyspark.sql import functions as F

from almudi.functions.quantity import parse, parse_fields
from almudi.operators import quantities

CASES = {
    "680 gr": ("g", 680_000), "1 1/2 Lt": ("ml", 1_500_000), "1/2 lb": ("g", 226_796), "2,500 GR": ("g", 2_500_000), "2,5 lb": ("g", 1_133_981), "6x330 ML": ("ml", 1_980_000),
    "90 gr x 6": ("g", 540_000), "Pack 6 de 40 G": ("g", 240_000), "3 unidades de 454 GR": ("g", 1_362_000), "12 und / 3.785 LTS": ("ml", 45_420_000), "106 gr (3 unidades)": ("g", 318_000),
    "5.3 oz (150 gr)": ("g", 150_000), "1.6 Oz / 45 GR": ("g", 45_000), "32 FL OZ": ("ml", 946_353), "6.8 oz fl": ("ml", 201_100), "3 docenas": ("unit", 36_000), "1 galón": ("ml", 3_785_412),
    "Caja 20 und": ("unit", 20_000), "20 uds. aprox.": ("unit", 20_000), "600 ml x 12, ya": ("ml", 7_200_000), "0,5 kg": ("g", 500_000), "1.000 kg": ("g", 1_000_000),
}


@pytest.mark.parametrize("text", CASES)
def test_stated(text):
    c = parse(text)
    assert (c.dim, c.milli) == CASES[text]


def test_no_case_and_ounces():
    assert [parse(t) for t in (None, "", "UN", "a granel", "Paquete", "500", "2x1", "0 g")] == [None] * 8
    c = parse("16.9oz")
    assert (c.dim, c.milli, c.milli_ml) == ("oz", 479_107, 499_793)
    assert parse("x" * 100_000 + " 5 kg").milli == 5_000_000


def test_over_columns():
    assert parse_fields("1500", "g").milli == 1_500_000
    assert parse_fields("1500g", None).milli == 1_500_000
    assert parse_fields("14.11", None, "declarado en OZ").dim == "oz"
    assert parse_fields("750", None, "valor leído en gr. de la foto") == ("g", 750_000, 0)
    assert parse_fields(None, None, "el empaque declara 140 g (2 fotos)").milli == 140_000
    assert parse_fields(None, None, "visto en 3 supermercados") is None
    assert parse_fields("750", None, "decisión tomada en lote 14") is None


PROD = "product_id long, supermarket_id string, ean string, name string, category string, presentation string, label int, dim string"
SIZE = "canonical_gtin string, net_content_value string, net_content_unit string, declared_value string, declared_unit string, note string, milli long"


def test_ounces_follow_the_kind_of_product(spark):
    rows = [(i, "s", f"95200000{i:05d}", f"Jugo Mango {i}", "Bebidas", "500 ml", 1, "x") for i in range(60)]
    rows += [(100 + i, "s", f"95200001{i:05d}", f"Queso Crema {i}", "Lácteos", "400 g", 1, "x") for i in range(60)]
    rows += [(500, "s", None, "Jugo Mango", "Bebidas", "16.9 oz", 1, "x"), (501, "s", None, "Queso Crema", "Lácteos", "16 oz", 1, "x"), (502, "s", None, "Jugo Mango", None, "750", 1, "x"), (503, None, None, None, None, None, 1, "x"), (504, "s", None, "Queso", "Lácteos", "", 1, "x")]
    sizes = [("09520000000001", "16.9", "oz", "500", "ml", None, 1), ("09520000100001", None, None, "14.1 oz", None, None, 1), ("00000000000000", None, None, None, None, None, 1)]
    c = quantities.converted(spark.createDataFrame(rows, PROD), spark.createDataFrame(sizes, SIZE))
    got = {(r.rec_key, r.field_name): (r.base_unit, r.base_milli, r.has_unit) for r in c.collect()}
    assert got["500", "presentation"] == ("ml", 499_793, True) and got["501", "presentation"] == ("g", 453_592, True)
    assert got["09520000000001", "net_content"] == ("ml", 499_793, True) and got["09520000100001", "declared"] == ("g", 399_728, True)
    assert got["502", "presentation"][2] is False and got["502", "presentation"][0] == "ml"
    assert ("503", "presentation") not in got and ("00000000000000", "declared") not in got


def test_words_of_few_rows_are_evidence(spark):
    rows = [(1, "s", None, "Kombucha", "x", "300 ml", 1, "x"), (2, "s", None, "Kombucha", "x", "16 oz", 1, "x"), (3, "s", None, "Granola", "x", "300 g", 1, "x")]
    got = {r.product_id: r.w_ml for r in quantities.evidence(quantities.product_records(spark.createDataFrame(rows, PROD))).collect()}
    assert got[2] > 0 and got[1] is None and got[3] is None  # a row is no evidence for itself


def test_empty_tables_and_nothing_to_learn(spark):
    p, s = spark.createDataFrame([], PROD), spark.createDataFrame([], SIZE)
    assert quantities.converted(p, s).count() == 0
    one = spark.createDataFrame([(1, "s", None, "Jugo", "Bebidas", "16 oz", 1, "x")], PROD)
    r = quantities.converted(one, s).first()
    assert (r.how, r.has_unit) == ("review", True)


def test_held_out_accuracy(spark):
    """Units hidden from labelled rows are predicted back."""
    names = [("Jugo Naranja", "Bebidas", "ml", 330), ("Leche Entera", "Lácteos", "ml", 946), ("Yogurt Fresa", "Lácteos", "g", 200), ("Café Molido", "Abarrotes", "g", 400), ("Huevos Grandes", "Frescos", "und", 30)]
    rows = [(i, f"s{i % 3}", None, f"{n} M{i % 17}", c, f"{v} {u}", 1, "x") for i in range(600) for n, c, u, v in [names[i % 5]]]
    hidden = [(1000 + i, "s1", None, f"{n} M{i % 17}", c, f"{v}", 1, "x") for i in range(50) for n, c, u, v in [names[i % 5]]]
    c = quantities.converted(spark.createDataFrame(rows + hidden, PROD), spark.createDataFrame([], SIZE)).where("not has_unit")
    unit = {"ml": "ml", "g": "g", "und": "unit"}
    want = {str(1000 + i): unit[names[i % 5][2]] for i in range(50)}
    hits = sum(r.base_unit == want[r.rec_key] for r in c.collect())
    assert hits >= 48
    assert c.where("how = 'inferred'").count() >= 45 and c.select(F.max("confidence")).first()[0] <= 1.01
