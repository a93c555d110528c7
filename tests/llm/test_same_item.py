from itertools import combinations

from almudi.llm import same_item as S

PROD = "product_id long, supermarket_id string, name string, brand string, presentation string, ean string, item string, words string"
BRANDS = ("Zuvare", "Mirano", "Tesulo", "Gavipe", "Donuri", "Pazoce", "Lubiti", "Nerofa", "Kabulo", "Sitero", "Wamiju", "Bofele")


def _rows():
    """Items in several wordings under many brands, from which wordings are learned."""
    rows, want, n, code = [], set(), 0, 950000000000

    def add(*listings, gtin=True):
        nonlocal n, code
        ids, code = [], code + 1
        for name, brand, pres in listings:
            rows.append((n, "s", name, brand, pres, str(code) if gtin else None, "x", "y"))
            ids.append(n)
            n += 1
        want.update(combinations(ids, 2))

    for i, b in enumerate(BRANDS):
        ad = ("Oferta", "¡Nueva Imagen!", "Rendidor")[i % 3]
        add((f"Leche Entera {b} Fortificada 200 ml", b, None), (f"{b} Lche Ent Forti. 200ML {ad}", b, None), (f"{b} Leche Íntegra Fortificada", b, "200 ml"))
        add((f"Leche Entera {b} Deslactosada 946 ml", b, None), (f"{ad} LCHE ENT DESLA. {b} 946ML", b.upper(), "946ml"), (f"Leche Íntegra Deslactosada {b} 32 fl oz", None, "32 FL OZ"), ("Leche Entera Deslactosada", f"Marca {b}", "0.946 L"))
        add((f"Refresco {b} Cola 2 L", b, None), (f"Gaseosa Cola {b} 2 litros", b, None), (f"{b} Refr Cola Original {ad}", b, "2 L"))
        add((f"Atún en Lata en Agua {b} 140 g x 4", b, None), (f"Atun Lta en Agua {b} 4 und / 4.9 oz", b, None), (f"{b} Atún en Agua", b, "Pack 4 de 140 gr"))
    add(("Zvuare Mantequilla con Sal 100 g", "S/M", None), ("Zuvare Mantequilla con Sal 100 g", "Zuvare", None), gtin=False)
    add(("Zuvare Mantequilla sin Sal 100 g", "Zuvare", None), gtin=False)
    add(("Mirano Mantequilla sin Sal 100 g", "Mirano", None), gtin=False)
    add(("Tesulo Mantequilla con Sal 100 g", "Tesulo", None), gtin=False)
    add(("Leche Entera Zuvare Kids Deslactosada 946 ml", "Zuvare Kids", None), ("zuvare kids lche integra desla", None, "946 cc"), gtin=False)
    add(("Leche Entera Zuvare 946 ml", "Zuvare", None), ("Leche Entera Original Zuvare", "Zuvare", "946 ml"), ("Zuvare Leche Integra Clásico 946 ml Oferta", "Zuvare", None), gtin=False)
    add(("Atún en Lata en Agua Bofele 140 g", "Bofele", None), gtin=False)
    add(("Atún en Lata en Aceite Bofele 140 g", "Bofele", None), gtin=False)
    add((None, None, None), gtin=False)
    add(("", "Zuvare", "946 ml"), gtin=False)
    return rows, want


def _pairs(spark, rows):
    return {tuple(r) for r in S.item_pairs(S.items(spark.createDataFrame(rows, PROD))).collect()}


def test_pairs_against_truth(spark):
    rows, want = _rows()
    assert _pairs(spark, rows) == want


def test_blocks_find_what_one_automaton_finds(spark, monkeypatch):
    rows, want = _rows()
    monkeypatch.setattr(S, "BLOCK", 7)
    assert _pairs(spark, rows) == want


def test_long_brands_and_the_first_of_equal_ones(spark, monkeypatch):
    names = [(1, None, "", "leche casa pan miel uva sal entera".split()), (2, None, "", "bofele leche zuvare".split()), (3, None, "zuvare", "bofele leche zuvare".split())]
    listings = spark.createDataFrame([(*n, None, None, None, None, None) for n in names], S._PREPARED)
    words = spark.createDataFrame([(b, "brand", 1) for b in ("casa pan miel uva sal", "casa pan", "bofele", "zuvare")] + [(w, "model", 3) for w in ("leche", "entera")], "phrase string, kind string, support long")
    brand = lambda: {r.product_id: (r.name_brand, r.rest) for r in S.match_names(listings, words).collect()}
    once = brand()
    monkeypatch.setattr(S, "BLOCK", 1)
    assert brand() == once == {1: ("casa pan miel uva sal", ["leche", "entera"]), 2: ("bofele", ["leche", "zuvare"]), 3: ("zuvare", ["bofele", "leche"])}


def test_empty_and_hot_item(spark):
    assert S.item_pairs(S.items(spark.createDataFrame([], PROD))).count() == 0
    rows = [(i, "s", "Leche Entera Zuvare 946 ml", "Zuvare", None, "9520000000017", "x", "y") for i in range(60)] + [(100 + i, "s", "Leche Entera Mirano 946 ml", "Mirano", None, None, "x", "y") for i in range(3)]
    found = S.items(spark.createDataFrame(rows, PROD))
    assert found.count() == 63 and found.select("item").distinct().count() == 2
    pairs = S.item_pairs(found, slice_rows=7)
    assert pairs.count() == pairs.distinct().count() == 60 * 59 // 2 + 3


def test_spelling_is_a_slip_not_a_replacement(spark):
    p = spark.createDataFrame([("zuvare", 9), ("zuvrae", 1), ("zuvaree", 1), ("zuvari", 1), ("zuare", 1), ("zuvare kids", 3), ("zuvare kdis", 1)], "phrase string, support long")
    got = {r.phrase: r.brand for r in S.resolve_spelling(p).collect()}
    assert got == {"zuvare": "zuvare", "zuvrae": "zuvare", "zuvaree": "zuvare", "zuvari": "zuvari", "zuare": "zuvare", "zuvare kids": "zuvare kids", "zuvare kdis": "zuvare kids"}


def test_sizes_dont_chain(spark):
    sizes = [100.0, 101.9, 103.8, 105.7, 107.7, 109.8]
    k = spark.createDataFrame([(i, "b", "m", "g", 1.0, 0.0, s) for i, s in enumerate(sizes)], "product_id long, brand string, model string, dim string, pack double, width double, milli double")
    items = {}
    for r in S._by_content(k).collect():
        items.setdefault(r.item, []).append(sizes[r.product_id])
    assert sorted(map(sorted, items.values())) == [[100.0, 101.9], [103.8, 105.7], [107.7, 109.8]]


def test_wordings(spark):
    """A short form stands for its long form; what comes and goes is optional."""
    wordings = [f"lche ent {v}|leche entera {v} oferta|leche entera {v}" for v in ("fresa", "uva", "mora", "coco")] + ["gaseosa cola|refresco cola", "gaseosa uva|refresco uva", "gaseosa mora|refresco mora"]
    rows = [(i, "g%013d" % i, f"b{i}", w.split(), "ml", 1.0, 0.0, 1.0) for i, x in enumerate(wordings) for w in x.split("|")]
    b = spark.createDataFrame(rows, "product_id long, gtin string, brand string, ws array<string>, dim string, milli double, milli_ml double, pack double")
    b = b.withColumn("ws", S.F.array_sort("ws"))
    got = {r.set: r.model for r in S.models(b).collect()}
    for x in wordings:
        assert len({got[" ".join(sorted(w.split()))] for w in x.split("|")}) == 1, x
    assert len(set(got.values())) == len(wordings)


def test_every_wording_of_an_item_is_evidence(spark):
    """One item in 60 wordings: 30 words, each with its own short form."""
    words = [(f"{x}o{y}o", x + y) for x in "bcdfghjklm" for y in "npq"]
    rows = [(i, "g1", "b", sorted(["agua", w]), "ml", 1.0, 0.0, 1.0) for i, w in enumerate(w for pair in words for w in pair)]
    b = spark.createDataFrame(rows, "product_id long, gtin string, brand string, ws array<string>, dim string, milli double, milli_ml double, pack double")
    assert S._evidence(b).select("at").distinct().count() == 60
    got = {r.set: r.model for r in S.models(b).collect()}
    assert all(got[f"agua {long_}"] == got[f"agua {short}"] for long_, short in words) and len(set(got.values())) == 30
