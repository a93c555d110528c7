"""Record comparison: blocking, levels, weights, evaluation, conflicts, unit prices.

Candidates meet as classes of listings that are equal in all that blocking and comparison of
words see, so copies never multiply; only a class's listings that can be among the best are
carried along. Pairs become listings again at the end, a bounded number for each.

Defined results
    * listings without brand, size, type or number lack the blocking keys made of them; one
      without any key has no candidates.
    * repeated listings are listings; a listing is never its own candidate.
    * null levels don't occur: what is missing has a level of its own.
    * empty tables give empty results; without labelled pairs all weights are those of the
      smoothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almudi.core.runtime import tabled
from almudi.functions import listing as S

FIELDS = ("brand", "name", "name_diff", "size", "pack", "variant", "codes", "type", "gtin")


def size_bucket(total: Column, step: float = 1.25) -> Column:
    return F.floor(F.log(total) / math.log(step)).cast("int")


# ---- brands ----------------------------------------------------------------------------
def resolved_brands(names: DataFrame, longest: int = 4) -> DataFrame:
    """(product_id, brand_status, resolved) from (product_id, folded, brand).

    Runs of up to ``longest`` words of the names are joined with the brands of the source
    (three letters or more); brands are never paired with names otherwise.
    """
    lex = names.where("brand is not null").select("brand").distinct().where(F.length(S.squashed(F.col("brand"))) >= 3).where(F.size(F.split("brand", " ")) <= longest)
    words = F.split("folded", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i + 1)), lambda n: F.array_join(F.slice(words, i, n), " "))))
    hits = names.where("folded <> ''").select("product_id", "brand", F.explode(F.array_distinct(runs)).alias("found")).join(lex.withColumnRenamed("brand", "found"), "found")
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    own = F.coalesce(F.col("brand"), F.lit(""))
    inside = F.contains(padded(own), padded(F.col("found"))) | (F.col("brand").isNotNull() & F.contains(padded(F.col("found")), padded(own)))
    other = F.when(~inside, F.col("found"))
    m = hits.groupBy("product_id").agg(F.count(other).alias("others"), F.max(other).alias("other"), F.max(F.col("found").eqNullSafe(F.col("brand"))).alias("own"))
    j = names.join(m, "product_id", "left")
    alone = F.coalesce("others", F.lit(0)) == 1
    keep = F.coalesce("own", F.lit(False)) | ~alone
    status = F.when(F.col("brand").isNull(), F.when(alone, "from_name").otherwise("none")).when(keep, "source").otherwise("source_conflict")
    return j.select("product_id", status.alias("brand_status"), F.when(F.col("brand").isNull(), F.when(alone, F.col("other"))).when(keep, F.col("brand")).alias("resolved"))


# ---- unit prices -----------------------------------------------------------------------
def unit_price(price: Column, total: Column, dim: Column) -> Column:
    """Cents per kilogram, litre or unit of a content in base units; halves to even, exactly."""
    top = price * F.when(dim == "unit", 1).otherwise(1000).cast("long") * 1000
    milli = F.round(total * 1000).cast("long")
    low = F.floor((top - top % milli) / milli).cast("long")
    twice = 2 * (top % milli)
    return low + F.when((twice > milli) | ((twice == milli) & (low % 2 == 1)), 1).otherwise(0)


def unit_medians(prices: DataFrame, least: int) -> DataFrame:
    """Upper medians by type and dimension of at least ``least`` rows. Ranks come from counts
    of distinct prices, so equal prices are one row however many listings have them."""
    v = prices.where("type is not null").groupBy("type", "dim", "unit_price").agg(F.count("*").alias("n"))
    w = W.partitionBy("type", "dim").orderBy("unit_price")
    all_n = F.sum("n").over(W.partitionBy("type", "dim"))
    r = v.withColumns({"upto": F.sum("n").over(w), "n_rows": all_n})
    return r.where((F.col("upto") > F.floor(F.col("n_rows") / 2)) & (F.col("n_rows") >= least)).groupBy("type", "dim").agg(F.min("unit_price").alias("median"), F.first("n_rows").alias("n_rows"))


def pack_verdict(packs: Column, price: Column, median: Column) -> Column:
    """'each' where a pack's stated size is of every container: its unit price is no less than
    a quarter of the median and nearer to it, in ratio, than if the size were the total."""
    return F.when(packs < 2, "single").when(median.isNull(), "each").when((4 * price >= median) & (price * price * packs >= median * median), "each").otherwise("total")


def plausibility(dim: Column, total: Column, price: Column, median: Column) -> Column:
    """Sizes over 50 kg or 60 l, unit prices 100 times or a twentieth of the median."""
    large = ((dim == "g") & (total > 50_000)) | ((dim == "ml") & (total > 60_000))
    return F.when(large, "too_large").when(median.isNull(), "unknown").when(price >= 100 * median, "too_dear").when(20 * price <= median, "too_cheap").otherwise("plausible")


# ---- candidates ------------------------------------------------------------------------
_CLASS = ("supermarket_id", "bag", "squashed", "dim", "bucket", "type", "lead", "gtin")


def _keys(near: bool) -> Column:
    """Blocking keys; with ``near`` those of the neighbouring size buckets too."""
    by_size = [F.when(F.col("squashed").isNotNull() & F.col("bucket").isNotNull(), F.concat_ws("|", F.lit("bs"), "squashed", "dim", (F.col("bucket") + d).cast("string"))) for d in ((-1, 0, 1) if near else (0,))]
    typed = F.when(F.col("type").isNotNull() & F.col("squashed").isNotNull() & F.col("lead").isNotNull(), F.concat_ws("|", F.lit("tb"), "type", "squashed", "lead"))
    return F.explode(F.filter(F.array(*by_size, typed, F.concat(F.lit("gt|"), "gtin")), lambda x: x.isNotNull()))


def candidates(std: DataFrame, top: int) -> DataFrame:
    """(a, b, similarity): for every listing the ``top`` likest of each other chain that share
    a blocking key with it, ties by id. Similarity is Jaccard's of the product words."""
    s = std.select("product_id", "supermarket_id", F.array_sort("core").alias("bag"), "squashed", F.col("size.dim").alias("dim"), size_bucket(F.col("size.total")).alias("bucket"), "type", F.get("core", F.lit(0)).alias("lead"), "gtin")
    s = tabled(s.withColumn("class", F.xxhash64(F.to_json(F.struct(*_CLASS)))), "classed")
    few = s.withColumn("n", F.row_number().over(W.partitionBy("class").orderBy("product_id"))).where(F.col("n") <= top).groupBy("class").agg(F.collect_list("product_id").alias("ids"))
    c = tabled(s.groupBy("class").agg(*[F.first(x).alias(x) for x in _CLASS]).join(few, "class"), "classes")
    probe, index = c.select("class", "supermarket_id", _keys(True).alias("key")), c.select(F.col("class").alias("other"), F.col("supermarket_id").alias("chain"), _keys(False).alias("key"))
    met = probe.join(index, "key").where("supermarket_id <> chain").select("class", "other", "chain").distinct()
    bags = c.select(F.col("class"), F.col("bag").alias("bag_a")), c.select(F.col("class").alias("other"), F.col("bag").alias("bag_b"), "ids")
    like = F.coalesce(F.try_divide(F.size(F.array_intersect("bag_a", "bag_b")).cast("double"), F.size(F.array_union("bag_a", "bag_b"))), F.lit(0.0))
    each = met.join(bags[0], "class").join(bags[1], "other").select("class", "chain", like.alias("similarity"), F.explode("ids").alias("id"))
    best = each.withColumn("n", F.row_number().over(W.partitionBy("class", "chain").orderBy(F.desc(F.round("similarity", 9)), "id"))).where(F.col("n") <= top)
    back = s.select("class", "product_id").join(best, "class")
    return back.select(F.least("product_id", "id").alias("a"), F.greatest("product_id", "id").alias("b"), "similarity").distinct()


def with_sides(pairs: DataFrame, std: DataFrame) -> DataFrame:
    """Pairs with both listings as structs x and y."""
    side = lambda k, n: std.select(F.col("product_id").alias(k), F.struct("supermarket_id", "folded", "brand", "squashed", "core", "codes", "variants", "size", "leaf", "type", "gtin").alias(n))
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")


# ---- levels ----------------------------------------------------------------------------
def brand_level(x: Column, y: Column) -> Column:
    inside = lambda b, o: (F.length(b["squashed"]) >= 4) & F.contains(F.replace(o["folded"], F.lit(" "), F.lit("")), b["squashed"])
    begins = (F.least(F.length(x["squashed"]), F.length(y["squashed"])) >= 4) & (F.startswith(x["squashed"], y["squashed"]) | F.startswith(y["squashed"], x["squashed"]))
    one = F.when(F.when(x["brand"].isNull(), inside(y, x)).otherwise(inside(x, y)), "in_other_name").otherwise("one_missing")
    return (
        F.when(x["brand"].isNull() & y["brand"].isNull(), "both_missing").when(x["brand"].isNull() | y["brand"].isNull(), one).when(x["squashed"] == y["squashed"], "exact")
        .when(begins, "fuzzy").when(inside(x, y) | inside(y, x), "cross_name").otherwise("conflict")
    )


def size_level(a: Column, b: Column) -> Column:
    off, relative = F.abs(a["total"] - b["total"]), F.abs(a["total"] - b["total"]) / F.greatest(a["total"], b["total"])
    same = (
        F.when(a["dim"] == "unit", F.when(off == 0, "exact").otherwise("conflict")).when(a["dim"] == "oz", F.when(off == 0, "exact").when(relative <= 0.02, "close").otherwise("conflict"))
        .when((off <= 1.5) | (relative <= 0.005), "exact").when(relative <= 0.02, "close").when(relative <= 0.06, "near").otherwise("conflict")
    )
    has = lambda d: (a["dim"] == d) | (b["dim"] == d)
    ounce = F.when(a["dim"] == "oz", a["total"]).otherwise(b["total"]) * F.when(has("g"), S.OUNCE_G).otherwise(S.OUNCE_ML)
    metric = F.when(a["dim"] == "oz", b["total"]).otherwise(a["total"])
    bridge = F.when(F.abs(ounce - metric) <= 0.03 * F.greatest(ounce, metric), "ounce_bridge").otherwise("conflict")
    return F.when(a.isNull() | b.isNull(), "missing").when(a["dim"] == b["dim"], same).when(has("unit"), "missing").when(has("oz"), bridge).otherwise("conflict")


def set_level(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) & (F.size(b) == 0), "none").when((F.size(a) == 0) | (F.size(b) == 0), "one_sided").when(a == b, "agree").when(F.arrays_overlap(a, b), "partial").otherwise("conflict")


def levels(pairs: DataFrame) -> DataFrame:
    """(a, b, similarity, the nine levels, chain_a, chain_b) of pairs with sides."""
    x, y = F.col("x"), F.col("y")
    only_x, only_y = F.size(F.array_except(x["core"], y["core"])), F.size(F.array_except(y["core"], x["core"]))
    s = F.col("similarity")
    name = F.when(s >= 0.8, "very_high").when(s >= 0.6, "high").when(s >= 0.4, "medium").when(s >= 0.2, "low").otherwise("very_low")
    diff = F.when((only_x == 0) & (only_y == 0), "none").when((only_x == 0) | (only_y == 0), "one_side").otherwise("both_sides")
    counted = x["size"].isNull() | y["size"].isNull() | (x["size"]["dim"] == "unit") | (y["size"]["dim"] == "unit")
    pack = F.when(counted, "missing").when(x["size"]["packs"] != y["size"]["packs"], "conflict").when(x["size"]["packs"] > 1, "same_multi").otherwise("same_single")
    leaf = F.when(x["leaf"].isNull() | y["leaf"].isNull(), "unknown").when(x["leaf"] == y["leaf"], "same_department").otherwise("department_conflict")
    kind = F.when(x["type"].isNull() | y["type"].isNull(), leaf).when(x["type"] == y["type"], "same_type").when(F.startswith(x["type"], y["type"]) | F.startswith(y["type"], x["type"]), "type_partial").otherwise("type_conflict")
    number = F.when(x["gtin"].isNull() | y["gtin"].isNull(), "missing").when(x["gtin"] == y["gtin"], "same").otherwise("different")
    each = {"brand": brand_level(x, y), "name": name, "name_diff": diff, "size": size_level(x["size"], y["size"]), "pack": pack, "variant": set_level(x["variants"], y["variants"]), "codes": set_level(x["codes"], y["codes"]), "type": kind, "gtin": number}
    return pairs.select("a", "b", "similarity", *[c.alias(f) for f, c in each.items()], x["supermarket_id"].alias("chain_a"), y["supermarket_id"].alias("chain_b"))


# ---- weights ---------------------------------------------------------------------------
def probability(weight: str) -> Column:
    """2^w / (1 + 2^w), exactly 0 or 1 beyond 60 bits."""
    w = F.col(weight)
    odds = F.pow(F.lit(2.0), F.least(F.greatest(w, F.lit(-60.0)), F.lit(60.0)))
    return F.when(w >= 60, 1.0).when(w <= -60, 0.0).otherwise(odds / (1 + odds))


class Weights:
    """m and u of every level, from pairs that numbers label (same or different), smoothed by
    one pair a level; the number itself is no field. The tables are bounded by the levels."""

    FIELDS = tuple(f for f in FIELDS if f != "gtin")

    def __init__(self, leveled: DataFrame):
        self.leveled = leveled
        each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("level")) for f in self.FIELDS])).alias("x")
        n = leveled.select("gtin", each).groupBy("x.field", "x.level").agg(F.count_if(F.col("gtin") == "same").alias("hits"), F.count_if(F.col("gtin") == "different").alias("misses")).collect()
        self.rows = []
        for f in self.FIELDS:
            own = [r for r in n if r.field == f]
            hits, misses = sum(r.hits for r in own) + len(own), sum(r.misses for r in own) + len(own)
            self.rows += [(f, r.level, (r.hits + 1) / hits, (r.misses + 1) / misses) for r in own]
        labels = leveled.agg(F.count_if(F.col("gtin") == "same").alias("s"), F.count_if(F.col("gtin") == "different").alias("d")).first()
        self.prior = (labels.s + 1) / (labels.s + labels.d + 2)

    def table(self) -> DataFrame:
        rows = [(f, v, round(m, 6), round(u, 6), round(math.log2(m / u), 4)) for f, v, m, u in self.rows]
        return self.leveled.sparkSession.createDataFrame(rows, "field string, level string, m double, u double, bits double")

    def scored(self) -> DataFrame:
        """``leveled`` with the log2 odds of a match."""
        total = F.lit(math.log2(self.prior / (1 - self.prior)))
        for f in self.FIELDS:
            add = F.lit(0.0)
            for g, v, m, u in self.rows:
                if g == f:
                    add = F.when(F.col(f) == v, F.lit(math.log2(m / u))).otherwise(add)
            total = total + add
        return self.leveled.withColumn("weight", F.round(total, 4))


def band_metrics(rows: DataFrame, group: str, match: str, auto: str) -> DataFrame:
    """Precision, recall and F1 of ``auto`` by group and in all, from one rollup."""
    m, a = F.col(match), F.col(auto)
    g = rows.rollup(group).agg(F.count("*").alias("labelled"), F.count_if(m & a).alias("tp"), F.count_if(~m & a).alias("fp"), F.count_if(m & ~a).alias("fn"))
    ratio = lambda n, d: F.round(F.try_divide(n.cast("double"), d), 4)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = g.select(F.coalesce(group, F.lit("all")).alias(group), "labelled", "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))
    return out.where("labelled > 0")


# ---- conflicts -------------------------------------------------------------------------
def pair_status(leveled: DataFrame) -> DataFrame:
    """Hard conflicts, a score of 100 and the status: conflicts, then missing evidence."""
    c = lambda ok, name: F.when(ok, F.lit(name))
    why = F.array_sort(F.filter(F.array(*[c(F.col(f) == "conflict", f) for f in ("brand", "size", "pack", "variant", "codes")], c(F.col("type").isin("type_conflict", "department_conflict"), "type"), c(F.col("gtin") == "different", "gtin")), lambda x: x.isNotNull()))
    part = lambda f, ok, n: F.when(F.col(f).isin(*ok), n).otherwise(0)
    score = part("type", ("same_type", "type_partial"), 20) + part("size", ("exact", "close", "ounce_bridge"), 25) + part("brand", ("exact", "fuzzy"), 20) + F.floor(45 * F.col("similarity") + 0.5)
    status = F.when(F.size(why) > 0, "not_comparable").when((F.col("gtin") == "missing") | ~F.col("brand").isin("exact", "fuzzy"), "review_required").otherwise("comparable")
    return leveled.select("*", F.array_join(why, ",").alias("conflicts"), score.cast("long").alias("score"), status.alias("status"))


def group_status(members: DataFrame) -> DataFrame:
    """(gtin, n, n_chains, status) of listings with a number: the worst that any pair could be."""
    metric = F.when(F.col("size.dim").isin("g", "ml"), F.col("size.total"))
    g = members.groupBy("gtin").agg(F.count("*").alias("n"), F.count_distinct("supermarket_id").alias("n_chains"), F.count_distinct("brand").alias("b"), F.count_distinct("type").alias("t"), F.max(metric).alias("hi"), F.min(metric).alias("lo"), F.count("brand").alias("branded"))
    bad = (F.col("b") > 1) | (F.col("t") > 1) | F.coalesce(F.col("hi") > 1.06 * F.col("lo"), F.lit(False))
    status = F.when(F.col("n_chains") < 2, "review_required").when(bad, "not_comparable").when((F.col("n_chains") < F.col("n")) | (F.col("branded") < F.col("n")), "review_required").otherwise("comparable")
    return g.select("gtin", "n", "n_chains", status.alias("status"))


def number_members(members: DataFrame) -> DataFrame:
    """(product_id, gtin, member): 'chain_collision', 'most_conflicts' or 'kept'. How many
    others a listing differs from follows from counts per value, without pairs."""
    g = members.groupBy("gtin").agg(F.count("brand").alias("all_b"), F.count("type").alias("all_t"))
    chain = members.groupBy("gtin", "supermarket_id").agg(F.count("*").alias("same_chain"))
    b, t = members.groupBy("gtin", "brand").agg(F.count("*").alias("same_b")).where("brand is not null"), members.groupBy("gtin", "type").agg(F.count("*").alias("same_t")).where("type is not null")
    m = members.select("product_id", "gtin", "supermarket_id", "brand", "type").join(chain, ["gtin", "supermarket_id"]).join(g, "gtin").join(b, ["gtin", "brand"], "left").join(t, ["gtin", "type"], "left")
    degree = F.coalesce(F.col("all_b") - F.col("same_b"), F.lit(0)) + F.coalesce(F.col("all_t") - F.col("same_t"), F.lit(0))
    d = tabled(m.select("product_id", "gtin", (F.col("same_chain") > 1).alias("twice"), degree.alias("degree")), "degrees")
    worst = d.where("not twice").groupBy("gtin").agg(F.max("degree").alias("worst"))
    j = d.join(worst, "gtin", "left")
    return j.select("product_id", "gtin", F.when(F.col("twice"), "chain_collision").when((F.col("degree") > 0) & (F.col("degree") == F.col("worst")), "most_conflicts").otherwise("kept").alias("member"))
