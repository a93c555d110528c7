"""Standard form of catalogue listings: brand, product words, codes, variants, stated size.

All built-in expressions, so that standardising stays in one JVM stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almudi.functions import gtin as G
from almudi.functions import text

# Brand columns that name no brand; other spellings of brands.
PLACEHOLDERS = ("generico", "generica", "sin marca", "s m", "n d", "s d", "n a", "na", "sin dato", "otros", "varios")
ALIASES = {"coca cola company": "coca cola", "p g": "procter gamble", "colgate palmolive": "colgate"}
# Words that say nothing of a product.
STOPWORDS = ("de", "del", "la", "el", "los", "las", "en", "con", "sin", "para", "y", "a", "x", "al")
PACKAGING = ("bolsa", "caja", "paquete", "paq", "pack", "lata", "botella", "frasco", "unidad", "unidades", "und", "uds", "pieza", "piezas")
# Units as written, their dimension and factor; those of the imperial system.
UNITS = {
    "kgs": ("g", 1000.0), "kg": ("g", 1000.0), "kilos": ("g", 1000.0), "kilo": ("g", 1000.0), "gramos": ("g", 1.0), "grs": ("g", 1.0), "gr": ("g", 1.0), "g": ("g", 1.0),
    "libras": ("g", 453.59237), "lbs": ("g", 453.59237), "lb": ("g", 453.59237), "mililitros": ("ml", 1.0), "ml": ("ml", 1.0), "cc": ("ml", 1.0), "litros": ("ml", 1000.0),
    "litro": ("ml", 1000.0), "lts": ("ml", 1000.0), "lt": ("ml", 1000.0), "l": ("ml", 1000.0), "gal": ("ml", 3785.411784), "fl oz": ("ml", 29.5735295625), "oz": ("oz", 1.0),
    "onzas": ("oz", 1.0), "unidades": ("unit", 1.0), "unid": ("unit", 1.0), "und": ("unit", 1.0), "uds": ("unit", 1.0), "piezas": ("unit", 1.0), "docena": ("unit", 12.0),
}
IMPERIAL = ("libras", "lbs", "lb", "gal", "fl oz", "oz", "onzas")
OUNCE_G, OUNCE_ML = 28.349523125, 29.5735295625
SIZE = "(?:([0-9]+) ?x ?)?([0-9]+(?:[.][0-9]+)?) ?(" + "|".join(UNITS) + ")(?:[^a-z0-9]|$)"
# Families of variants and the words that declare them.
VARIANTS = {
    "flavour": ("fresa", "vainilla", "chocolate", "naranja", "limon", "uva", "mango", "pina", "manzana", "mora", "melocoton", "coco", "toronja", "sandia", "natural"),
    "fat": ("entera", "integra", "descremada", "semidescremada", "light", "deslactosada"),
    "size_class": ("grandes", "medianas", "medianos", "pequenas", "pequenos", "xg"),
    "form": ("polvo", "barra", "liquido", "molido", "instantanea", "hojuelas"),
}
# Product types by ordered rules (type, all of, any of, none of).
TYPES = (
    ("queso", ("queso",), (), ()), ("quesillo", ("quesillo",), (), ()), ("yogurt", ("yogurt",), (), ()), ("mantequilla", ("mantequilla",), (), ()), ("crema_dental", ("dental",), ("crema", "pasta"), ()),
    ("leche", ("leche",), (), ("coco", "chocolate")), ("agua", ("agua", "purificada"), (), ()), ("jugo", (), ("jugo", "nectar"), ()), ("refresco", (), ("refresco", "gaseosa"), ()), ("aceite", ("aceite",), (), ("atun",)),
    ("atun", ("atun",), (), ()), ("arroz", ("arroz",), (), ("leche",)), ("frijoles", ("frijoles",), (), ()), ("harina", ("harina",), (), ("tortillas",)), ("tortillas", ("tortillas",), (), ()), ("pan", ("pan",), ("molde", "blanco", "integral", "caja"), ()),
    ("cafe", ("cafe",), (), ()), ("azucar", ("azucar",), (), ()), ("detergente", ("detergente",), (), ()), ("suavizante", (), ("suavizante", "acondicionador"), ()), ("jabon", ("jabon",), (), ()), ("champu", (), ("champu", "shampoo"), ()),
    ("papel", ("papel",), ("higienico", "bano"), ()), ("panales", ("panales",), (), ()), ("huevos", ("huevos",), (), ()), ("pollo", ("pollo",), (), ("alimento",)), ("alimento_perro", ("perro",), ("alimento", "concentrado"), ()),
)


def plain(value: Column) -> Column:
    """Lower case without accents, decimal commas as points, no grouping commas."""
    t = F.lower(F.translate(value, text.ACCENTED, text.PLAIN))
    t = F.regexp_replace(t, "([0-9]),([0-9]{3})([^0-9]|$)", "$1$2$3")
    return F.regexp_replace(t, "([0-9]),([0-9])", "$1.$2")


def normal_brand(brand: Column) -> Column:
    """Folded, without a leading 'marca', null for placeholders, aliases as their brand."""
    b = F.regexp_replace(text.fold(brand), "^marca ", "")
    b = F.when(~b.isin(*PLACEHOLDERS) & (b != ""), b)
    return F.coalesce(F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])[b], b)


def squashed(brand: Column) -> Column:
    return F.replace(brand, F.lit(" "), F.lit(""))


def stated_size(value: Column) -> Column:
    """The first size of a text: dim, packs, total (packs x amount in base units), imperial,
    and the number of sizes; null where none is stated."""
    t = plain(F.coalesce(value, F.lit("")))
    unit = F.regexp_extract(t, SIZE, 3)
    dims = F.create_map(*[F.lit(x) for u, (d, _) in UNITS.items() for x in (u, d)])
    factors = F.create_map(*[F.lit(x) for u, (_, f) in UNITS.items() for x in (u, f)])
    packs = F.coalesce(F.regexp_extract(t, SIZE, 1).try_cast("int"), F.lit(1))
    total = F.round(packs * F.regexp_extract(t, SIZE, 2).try_cast("double") * factors[unit], 3)
    return F.when((unit != "") & (packs > 0) & (total > 0), F.struct(dims[unit].alias("dim"), packs.alias("packs"), total.alias("total"), unit.isin(*IMPERIAL).alias("imperial"), F.size(F.regexp_extract_all(t, F.lit(SIZE), F.lit(0))).alias("n")))


def compatible(a: Column, b: Column) -> Column:
    """Whether two stated sizes may be one: same dimension and packs; counts and ounces equal,
    else within 1.5 base units or half a per cent (two if one is imperial). Not transitive."""
    off = F.abs(a["total"] - b["total"])
    share = F.when(a["imperial"] | b["imperial"], 0.02).otherwise(0.005)
    near = F.when(a["dim"].isin("unit", "oz"), off == 0).otherwise((off <= 1.5) | (off <= share * F.greatest(a["total"], b["total"])))
    return F.coalesce((a["dim"] == b["dim"]) & (a["packs"] == b["packs"]) & near, F.lit(False))


def core_tokens(name: Column, brand: Column) -> Column:
    """Distinct words of a folded name that aren't of its brand, small words, packaging,
    numbers, units or single letters, in order."""
    words = F.split(name, " ")
    drop = [*STOPWORDS, *PACKAGING, *[u for u in UNITS if " " not in u]]
    of_brand = F.split(F.coalesce(brand, F.lit("")), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.rlike("[0-9]") & ~w.isin(*drop) & ~F.array_contains(of_brand, w)))


def codes(name: Column) -> Column:
    """Model codes: letters and digits in one word, letters first, that state no size."""
    return F.array_sort(F.array_distinct(F.filter(F.split(name, " "), lambda w: w.rlike("^[a-z]{1,3}[0-9]{1,4}$"))))


def variants(name: Column) -> Column:
    """(family:value) labels declared by a folded name."""
    words = F.split(name, " ")
    labelled = lambda family: lambda v: F.concat(F.lit(f"{family}:"), v)
    each = [F.transform(F.array_intersect(words, F.array(*[F.lit(v) for v in values])), labelled(family)) for family, values in VARIANTS.items()]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*each))))


def product_type(name: Column) -> Column:
    """The first rule of ``TYPES`` that a folded name fulfils."""
    words = F.split(F.coalesce(name, F.lit("")), " ")
    has = lambda w: F.array_contains(words, w)
    out = None
    for kind, every, some, none in TYPES:
        ok = F.lit(True)
        for w in every:
            ok = ok & has(w)
        if some:
            ok = ok & F.arrays_overlap(words, F.array(*[F.lit(w) for w in some]))
        for w in none:
            ok = ok & ~has(w)
        out = F.when(ok, kind) if out is None else out.when(ok, kind)
    return out


def leaf(category: Column) -> Column:
    """The last part of a category path, folded."""
    return text.fold(F.element_at(F.split(category, ">"), -1))


def standardized(products: DataFrame) -> DataFrame:
    """One row per listing: product_id, supermarket_id, folded, brand, squashed, core, codes,
    variants, size (name's, else presentation's), leaf, type, gtin (identity only)."""
    folded, brand, number = text.fold(F.col("name")), normal_brand(F.col("brand")), G.canonical_gtin(F.col("ean"))
    p = products.select(
        "product_id", "supermarket_id", F.coalesce(folded, F.lit("")).alias("folded"), brand.alias("brand"), stated_size(F.col("name")).alias("ns"), stated_size(F.col("presentation")).alias("ps"),
        leaf(F.col("category")).alias("leaf"), F.when(~G.restricted(number), number).alias("gtin"),
    )
    return p.select(
        "product_id", "supermarket_id", "folded", "brand", squashed(F.col("brand")).alias("squashed"), core_tokens(F.col("folded"), F.col("brand")).alias("core"), codes(F.col("folded")).alias("codes"),
        variants(F.col("folded")).alias("variants"), F.coalesce("ns", "ps").alias("size"), "ns", "ps", "leaf", product_type(F.col("folded")).alias("type"), "gtin",
    )
