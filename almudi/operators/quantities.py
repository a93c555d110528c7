"""Quantities recorded in different units (problem 7).

Stated contents are parsed exactly. What text alone can't settle - a unit that is missing,
or an ounce that may be a weight or a volume - is predicted by a calibrated random forest
from the magnitude, the chain, the category, the words of the name and the neighbouring
fields. Confident assignments are converted; uncertain ones go to review.

Word, category and chain statistics are taken over all rows. Only the forest is fitted on
a bounded sample of the labelled rows (``max_train``).

Defined results
    * null, blank and number-free texts are no case; a number without any unit is no case
      of ``found`` but gets an inferred unit or a review row.
    * a gtin without products is judged by its own fields alone.
    * without labelled rows nothing can be learned: ambiguous contents all go to review.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from almudi.core.runtime import tabled
from almudi.functions.quantity import Content, bare_number, first_number, parse, parse_fields

MAX_TRAIN = 20_000
CONFIDENT = 0.6
DIMS = ("g", "ml", "unit")
FEATURES = ("w_ml", "w_ml_max", "w_ml_min", "w_unit", "w_unit_max", "c_ml", "c_unit", "s_ml", "magnitude", "nb_g", "nb_ml", "nb_unit")

_CONTENT = T.StructType([T.StructField("dim", T.StringType()), T.StructField("milli", T.LongType()), T.StructField("milli_ml", T.LongType()), T.StructField("bare", T.DoubleType()), T.StructField("written", T.DoubleType())])
_UNIT_WORDS = "^(gr|grs|gramos?|kgs?|kilos?|lbs?|libras?|onz|onzas?|mililitros?|lts?|litros?|gal|galon|galones|und|unid|unidades|uds|pza|piezas?|doc|docenas?|pack|caja|bolsa|paq|empaque|para|con|sin|los|las|por|del)$"
_ACCENTS = ("ÁÉÍÓÚÜÑáéíóúüñ", "aeiouunaeiouun")


def _frame(contents: list[Content | None], bare: list[float | None], written: list[float | None]) -> pd.DataFrame:
    return pd.DataFrame({"written": written} | {"dim": [c and c.dim for c in contents], "milli": pd.array([c and c.milli for c in contents], dtype="Int64"), "milli_ml": pd.array([c and c.milli_ml for c in contents], dtype="Int64"), "bare": bare})[_CONTENT.fieldNames()]


@F.pandas_udf(_CONTENT)
def stated(text: pd.Series) -> pd.DataFrame:
    contents = [parse(t) for t in text]
    return _frame(contents, [None if c else bare_number(t) for c, t in zip(contents, text, strict=True)], [first_number(t) for t in text])


@F.pandas_udf(_CONTENT)
def stated_fields(value: pd.Series, unit: pd.Series, note: pd.Series) -> pd.DataFrame:
    contents = [parse_fields(v, u, n) for v, u, n in zip(value, unit, note, strict=True)]
    return _frame(contents, [None if c else bare_number(v) for c, v in zip(contents, value, strict=True)], [first_number(v, u, n) for v, u, n in zip(value, unit, note, strict=True)])


def _words(name) -> F.Column:
    folded = F.lower(F.translate(F.coalesce(name, F.lit("")), *_ACCENTS))
    return F.array_distinct(F.filter(F.split(F.regexp_replace(folded, "[^a-z]+", " "), " "), lambda w: (F.length(w) >= 3) & ~w.rlike(_UNIT_WORDS)))


def gtin14(ean) -> F.Column:
    digits = F.regexp_replace(ean, "[^0-9]", "")
    return F.when((F.length(digits) > 0) & (F.length(digits) <= 14), F.lpad(digits, 14, "0"))


def product_records(products: DataFrame) -> DataFrame:
    """Products with the contents stated by presentation and name, written once."""
    return products.select(
        "product_id", "supermarket_id", gtin14(F.col("ean")).alias("gtin"), "name",
        F.lower(F.translate(F.coalesce(F.trim("category"), F.lit("")), *_ACCENTS)).alias("cat"),
        stated(F.col("presentation")).alias("p"), stated(F.col("name")).alias("n"),
    )


def _odds(a: str, b: str) -> F.Column:
    return F.log((F.col(a) + 0.5) / (F.col(b) + 0.5))


def _counts(df: DataFrame, key: str) -> DataFrame:
    t = df.groupBy(key).agg(*[F.count_if(F.col("label") == d).alias(f"n_{d}") for d in DIMS])
    return t.withColumn("n_rest", F.col("n_g") + F.col("n_ml"))


def evidence(records: DataFrame) -> DataFrame:
    """Per product: log-odds of volume against weight, and of counts against both, of its
    words, category and chain, from counts over all labelled rows. A row's own label doesn't
    count for its words, so that rare words say the same of labelled and other rows."""
    label = F.when(F.col("p.dim").isin(*DIMS), F.col("p.dim"))
    base = records.select("product_id", "supermarket_id", "cat", label.alias("label"), _words(F.col("name")).alias("words"))
    words = base.select("product_id", "label", F.explode("words").alias("word"))
    others = {f"n_{d}": F.col(f"n_{d}") - F.col("label").eqNullSafe(F.lit(d)).cast("int") for d in DIMS}
    by_word = words.join(_counts(words, "word").drop("n_rest"), "word").withColumns(others).withColumn("n_rest", F.col("n_g") + F.col("n_ml")).where("n_rest + n_unit > 0")
    scored = by_word.select("product_id", _odds("n_ml", "n_g").alias("ml"), _odds("n_unit", "n_rest").alias("unit")).groupBy("product_id").agg(F.avg("ml").alias("w_ml"), F.max("ml").alias("w_ml_max"), F.min("ml").alias("w_ml_min"), F.avg("unit").alias("w_unit"), F.max("unit").alias("w_unit_max"))
    by_cat = _counts(base, "cat").select("cat", _odds("n_ml", "n_g").alias("c_ml"), _odds("n_unit", "n_rest").alias("c_unit"))
    by_chain = _counts(base, "supermarket_id").select("supermarket_id", _odds("n_ml", "n_g").alias("s_ml"))
    return base.select("product_id", "supermarket_id", "cat").join(scored, "product_id", "left").join(by_cat, "cat", "left").join(by_chain, "supermarket_id", "left").drop("cat", "supermarket_id")


def _neighbour(dim: str, *cols: str) -> F.Column:
    hit = F.lit(0.0)
    for c in cols:
        hit = hit + F.when(F.col(c) == dim, 1.0).otherwise(0.0)
    return hit.alias(f"nb_{dim}")


def cases(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """All fields that state something, with the features of the classifier."""
    ev = evidence(records)
    stats = ("w_ml", "w_ml_max", "w_ml_min", "w_unit", "w_unit_max", "c_ml", "c_unit", "s_ml")
    products = records.join(ev, "product_id")
    own = products.select(F.lit("products").alias("rec_table"), F.col("product_id").cast("string").alias("rec_key"), F.lit("presentation").alias("field_name"), F.col("p").alias("c"), *stats, *[_neighbour(d, "n.dim") for d in DIMS])
    by_gtin = products.where("gtin is not null").groupBy("gtin").agg(*[F.avg(s).alias(s) for s in stats], *[F.avg(F.greatest(F.col("n.dim").eqNullSafe(F.lit(d)).cast("double"), F.col("p.dim").eqNullSafe(F.lit(d)).cast("double"))).alias(f"g_{d}") for d in DIMS])
    sd = decisions.select("canonical_gtin", stated_fields(F.col("net_content_value"), F.col("net_content_unit"), F.lit(None).cast("string")).alias("net"), stated_fields(F.col("declared_value"), F.col("declared_unit"), F.col("note")).alias("dec"))
    joined = sd.join(by_gtin, sd.canonical_gtin == by_gtin.gtin, "left")
    fields = F.explode(F.array(F.struct(F.lit("net_content").alias("field_name"), F.col("net").alias("c"), F.col("dec.dim").alias("other")), F.struct(F.lit("declared").alias("field_name"), F.col("dec").alias("c"), F.col("net.dim").alias("other")))).alias("f")
    theirs = joined.select("canonical_gtin", fields, *stats, *[f"g_{d}" for d in DIMS]).select(F.lit("size_decisions").alias("rec_table"), F.col("canonical_gtin").alias("rec_key"), "f.field_name", "f.c", *stats, *[F.greatest(F.coalesce(f"g_{d}", F.lit(0.0)), F.col("f.other").eqNullSafe(F.lit(d)).cast("double")).alias(f"nb_{d}") for d in DIMS])
    all_cases = own.unionByName(theirs).where("c.dim is not null or c.bare is not null")
    size = lambda c: F.log10(F.greatest(F.coalesce(c, F.lit(0.001)), F.lit(0.001)))
    magnitude, written = size(F.coalesce(F.col("c.milli") / 1000.0, F.col("c.bare"))), size(F.coalesce("c.written", "c.bare"))
    return all_cases.select("rec_table", "rec_key", "field_name", "c.dim", "c.milli", "c.milli_ml", "c.bare", magnitude.alias("magnitude"), written.alias("written"), *[F.coalesce(F.col(s), F.lit(0.0)).alias(s) for s in FEATURES if s != "magnitude"])


def _monotone(bins: list[tuple[int, float, float]]) -> list[tuple[float, float]]:
    """Pool-adjacent-violators over (bin, hits, rows): points (mean score, rate) of the blocks."""
    blocks: list[list[float]] = []
    for b, hits, rows in sorted(bins):
        blocks.append([(b + 0.5) / 50.0 * rows, hits, rows])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            low = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], low, strict=True)]
    return [(at / n, (hits + 0.5) / (n + 1.0)) for at, hits, n in blocks]


class UnitClassifier:
    """Random forest over the features; per-class isotonic calibration on held-out rows.

    ``hidden``: the magnitude is that of the number as written, so that a missing unit looks
    like a known one with its unit hidden; otherwise that of the content, for ounces.
    """

    def __init__(self, table: DataFrame, max_train: int = MAX_TRAIN, hidden: bool = False):
        self.hidden = hidden
        index = F.when(F.col("dim") == "g", 0.0).when(F.col("dim") == "ml", 1.0).when(F.col("dim") == "unit", 2.0)
        labelled = table.where(F.col("dim").isin(*DIMS) & (F.col("rec_table") == "products")).withColumn("label", index)
        n = labelled.count()
        self.model = None
        if n == 0:
            return
        slots = 1 << 20
        at = F.pmod(F.xxhash64("rec_key", F.lit(7)), F.lit(slots))
        share = min(slots, math.floor(slots * max_train / n))
        sample = self._vectors(labelled.where(at < share)).select("label", "x", (at % 8).alias("part")).cache()
        fit, held, self.test = sample.where("part not in (0, 4)" + (" and part <> 1" if hidden else "")), sample.where("part in (0, 4)"), sample.where("part = 1")
        if fit.count() == 0:
            return
        self.model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=24, maxDepth=7, seed=11).fit(fit)
        raw = self.model.transform(held).select("label", vector_to_array("probability").alias("p"))
        k = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.get("p", F.lit(i)).alias("s"), (F.col("label") == i).cast("double").alias("hit")) for i in range(3)])).alias("b")
        bins = raw.select(k).select("b.*").groupBy("k", F.floor(F.coalesce("s", F.lit(0.0)) * 50).alias("bin")).agg(F.sum("hit").alias("hits"), F.count("*").alias("rows")).collect()
        self.steps = [_monotone([(r.bin, r.hits, float(r["rows"])) for r in bins if r.k == i]) for i in range(3)]
        sample.unpersist()

    def holdout(self) -> DataFrame:
        """(confidence_bin, n_rows, n_right, mean_confidence) of labelled rows that neither the
        forest nor its calibration saw, with their units hidden."""
        if self.model is None:
            return None
        out = self.model.transform(self.test).withColumn("_p", vector_to_array("probability")).select("label", *[self._calibrated(i).alias(f"p_{d}") for i, d in enumerate(DIMS)])
        best = F.greatest(*[F.col(f"p_{d}") for d in DIMS])
        guess = F.when(F.col("p_g") == best, 0.0).when(F.col("p_ml") == best, 1.0).otherwise(2.0)
        bin_ = F.least(F.floor(best * 10), F.lit(9)).cast("int")
        return out.groupBy(bin_.alias("confidence_bin")).agg(F.count("*").alias("n_rows"), F.count_if(guess == F.col("label")).alias("n_right"), F.round(F.avg(best), 4).alias("mean_confidence"))

    def _vectors(self, df: DataFrame) -> DataFrame:
        columns = ["written" if self.hidden and f == "magnitude" else f for f in FEATURES]
        return VectorAssembler(inputCols=columns, outputCol="x", handleInvalid="keep").transform(df)

    def _calibrated(self, i: int) -> F.Column:
        """The isotonic rate at the forest's score, linear between the blocks' points."""
        score = F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0))
        points = self.steps[i] or [(0.0, 0.0)]
        rate = F.lit(points[0][1])
        for (x0, y0), (x1, y1) in zip(points, points[1:], strict=False):
            rate = F.when(score >= x0, F.lit(y0) + (score - x0) * ((y1 - y0) / (x1 - x0))).otherwise(rate)
        return F.when(score >= points[-1][0], F.lit(points[-1][1])).otherwise(rate)

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds calibrated p_g, p_ml, p_unit."""
        if self.model is None:
            return df.select("*", *[F.lit(None).cast("double").alias(f"p_{d}") for d in DIMS])
        out = self.model.transform(self._vectors(df)).withColumn("_p", vector_to_array("probability"))
        return out.select(*df.columns, *[self._calibrated(i).alias(f"p_{d}") for i, d in enumerate(DIMS)])


def holdout(products: DataFrame, decisions: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """How well hidden units of held-out rows are predicted, by confidence."""
    table = tabled(cases(tabled(product_records(products), "quantity-records"), decisions), "quantity-cases")
    empty = "confidence_bin int, n_rows long, n_right long, mean_confidence double"
    found = UnitClassifier(table, max_train, hidden=True).holdout()
    return table.sparkSession.createDataFrame([], empty) if found is None else found


def converted(products: DataFrame, decisions: DataFrame, max_train: int = MAX_TRAIN, bare: bool = True) -> DataFrame:
    """Every stated content in base units.

    ``how``: 'stated' (the text settles it), 'inferred' (classifier, confident) or
    'review' (uncertain; base_milli by the likelier reading). ``has_unit`` is false where
    the field gives a number only; such a number is taken in the base unit. Without ``bare``
    those are left out.
    """
    table = tabled(cases(tabled(product_records(products), "quantity-records"), decisions), "quantity-cases")
    known = table.where(F.col("dim").isin(*DIMS)).select("rec_table", "rec_key", "field_name", F.col("dim").alias("base_unit"), F.col("milli").alias("base_milli"), F.lit(1.0).alias("confidence"), F.lit("stated").alias("how"), F.lit(True).alias("has_unit"))
    open_ = UnitClassifier(table, max_train).predict(table.where("dim = 'oz'"))
    if bare:
        open_ = open_.unionByName(UnitClassifier(table, max_train, hidden=True).predict(table.where("dim is null")))
    both = F.col("p_g") + F.col("p_ml")
    ounce = F.col("dim").eqNullSafe("oz")
    unit = F.when(ounce, F.when(F.col("p_ml") > F.col("p_g"), "ml").otherwise("g")).when(F.col("p_unit") > F.greatest("p_g", "p_ml"), "unit").when(F.col("p_ml") > F.col("p_g"), "ml").otherwise("g")
    confidence = F.when(ounce, F.greatest("p_g", "p_ml") / both).otherwise(F.greatest("p_g", "p_ml", "p_unit"))
    o = open_.withColumn("base_unit", unit).withColumn("confidence", F.coalesce(confidence, F.lit(0.0)))
    milli = F.when(ounce, F.when(F.col("base_unit") == "ml", F.col("milli_ml")).otherwise(F.col("milli"))).otherwise(F.floor(F.col("bare") * 1000 + 0.5).cast("long"))
    guessed = o.select("rec_table", "rec_key", "field_name", "base_unit", milli.alias("base_milli"), "confidence", F.when(F.col("confidence") >= CONFIDENT, "inferred").otherwise("review").alias("how"), ounce.alias("has_unit"))
    return known.unionByName(guessed)
