"""Product listings describing the same item (problem 5).

A reference dictionary of brand phrases and model words is mined from trusted listings
(those whose brand column also stands in their name). Aho-Corasick finds its phrases in
every name, the longest match consistent with the listing's brand wins, and what is left of
the name (product words, variant) is compared with contents and pack.

How the trade words things is mined too, from listings that agree in trade item number,
brand and rough size: words that replace each other there (abbreviations, synonyms) become
one word, and words that come and go there (advertising, fillers) are dropped, everywhere or
beside the word that makes them redundant. The number is evidence for the vocabulary only; no
two listings are the same item because of it.

Steps: normalise -> mine dictionary -> match -> resolve misspelt brands -> mine wording ->
compare.

Everything is counted over all listings, and all wordings of a trade item are evidence. A dictionary of more than ``BLOCK``
phrases is matched in blocks, each by its automaton. Misspellings are resolved by a join on
one-letter deletions between distinct phrases, never between listings.

Defined results
    * null or blank names: the brand column, presentation and content alone describe the
      item; a listing without any brand, or without any words, matches none.
    * no stated content: only listings without content match it.
    * repeated listings are listings; ids are taken as unique.
    * without trade item numbers no wording is learned: names match word by word.
    * extra columns are ignored; empty tables give no pairs.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almudi.core.runtime import tabled
from almudi.functions import quantity as Q
from almudi.operators.components import connected_components

BLOCK = 200_000
TOLERANCE = 0.02
SWAPPED = 0.3
OPTIONAL = 0.3

# Brand columns that name no brand; the language's small words and the notation
# of packs; names of a plain item.
NO_BRAND = frozenset(("", "s m", "sm", "generico", "generica", "sin marca", "n d", "s d", "sin dato", "na", "n a"))
JOINING = frozenset(("de", "en", "para", "con", "la", "el", "los", "las", "x", "pack", "del", "y", "a", "al"))
PLAIN = frozenset(("original", "clasico", "clasica", "tradicional"))

_PREPARED = "product_id long, gtin string, col_brand string, words array<string>, dim string, milli double, milli_ml double, width double, pack double"


def fold(text: str | None) -> str:
    text = unicodedata.normalize("NFKD", (text or "").lower())
    return "".join(c for c in text if not unicodedata.combining(c))


@lru_cache(maxsize=100_000)
def brand_phrase(text: str | None) -> str:
    """The brand column as a phrase, or '' where it names no brand."""
    phrase = " ".join(re.sub("[^a-z0-9]+", " ", fold(text)).split())
    phrase = re.sub("^marca ", "", phrase)
    return "" if phrase in NO_BRAND else phrase


@lru_cache(maxsize=200_000)
def contents(text: str | None) -> list[tuple[float, float, float, float, str]]:
    """(thousandths by weight or count, by volume, rounding half-width, packs, dim) of the sizes in a text."""
    t = fold(text)
    sizes, counts, packs = [], [], []
    for m in Q._QUANTITY.finditer(t):
        unit, n = Q._unit(m["u"]), Q.number(m["n"])
        if n <= 0:
            continue
        factor, dim = Q.UNITS[unit]
        decimals = len(re.sub(r",(?=\d{3}(?!\d))", "", m["n"]).replace(",", ".").partition(".")[2])
        width = 0.5 * 10.0**-decimals / float(n) if decimals else 0.0  # whole numbers and fractions are meant exactly
        row = (float(n) * float(factor) * 1000, float(n) * float(Q.FLUID_OUNCE) * 1000 if dim == "oz" else 0.0, width, dim)
        (counts if dim == "unit" else sizes).append(row)
        before, after = t[: m.start()], t[m.end() :]
        if b := Q._TIMES_BEFORE.search(before) or Q._PACK_BEFORE.search(before):
            packs.append(float(b[1]))
        elif a := Q._TIMES_AFTER.search(after):
            packs.append(float(a[1]))
    if not sizes:
        return [(c[0] * (packs[0] if packs else 1.0), 0.0, 0.0, 1.0, "unit") for c in counts[:1]]
    pack = packs[0] if packs else counts[0][0] / 1000 if counts else 1.0
    return [(s[0], s[1], s[2], pack, s[3]) for s in sizes]


def content(name: str | None, presentation: str | None) -> tuple:
    """The most precise content of both texts; a metric one before an ounce of equal precision."""
    found = contents(name) + contents(presentation)
    if not found:
        return (None, None, None, None, None)
    sized = [f for f in found if f[4] != "unit"] or found
    best = min(sized, key=lambda f: (f[2] > 0.012, f[4] == "oz", f[2]))
    pack = max(f[3] for f in sized)
    return (best[4], best[0], best[1], best[2], pack)


def name_words(name: str | None) -> list[str]:
    """The words of a name without sizes, in order."""
    return re.findall(r"\d+x\d+|\d+%|[a-z]+", Q._QUANTITY.sub(" ", fold(name)))


def _gtin(ean: Column) -> Column:
    """A trade item number of 12 to 14 digits, padded to 14; shorter ones are a shop's own."""
    digits = F.regexp_replace(ean, "[^0-9]", "")
    return F.when(F.length(digits).between(12, 14), F.lpad(digits, 14, "0"))


def prepare(products: DataFrame) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = [(int(i), g, brand_phrase(b), name_words(n), *content(n, p)) for i, g, n, b, p in zip(pdf.product_id, pdf.gtin, pdf.name, pdf.brand, pdf.presentation, strict=True)]
            yield pd.DataFrame(rows, columns=["product_id", "gtin", "col_brand", "words", "dim", "milli", "milli_ml", "width", "pack"])

    return products.select("product_id", "name", "brand", "presentation", _gtin(F.col("ean")).alias("gtin")).mapInPandas(run, _PREPARED)


# ---- dictionary ------------------------------------------------------------------------
def _text(words) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def mine_dictionary(listings: DataFrame) -> DataFrame:
    """Phrases (phrase, kind, support): brands that stand in both column and name of trusted
    listings, and model words - the other words of trusted names - that no brand has for
    itself and that few brands hold."""
    trusted = listings.where((F.col("col_brand") != "") & _text(F.col("words")).contains(F.concat(F.lit(" "), "col_brand", F.lit(" "))))
    brands = trusted.groupBy("col_brand").agg(F.count("*").alias("support")).select(F.col("col_brand").alias("phrase"), F.lit("brand").alias("kind"), "support")
    rest = trusted.select("col_brand", F.explode(F.array_except("words", F.split("col_brand", " "))).alias("phrase"))
    words = rest.groupBy("phrase", "col_brand").count().groupBy("phrase").agg(F.count("*").alias("support"), F.max("count").alias("most"), F.sum("count").alias("all"))
    words = words.where((F.col("support") >= 2) & (F.col("most") < 0.8 * F.col("all"))).select("phrase", F.lit("model").alias("kind"), "support")
    in_brand = brands.select(F.explode(F.split("phrase", " ")).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("as_brand"))
    words = words.join(in_brand, "phrase", "left").where(F.coalesce("as_brand", F.lit(0)) < 0.3 * F.col("support")).drop("as_brand")
    return brands.unionByName(words)


def longest_match(text: str, spans: list[tuple[int, int]], column: str) -> tuple[int, str]:
    """(start, brand) of the longest matched span that contains or is contained in the
    column's brand; without a column brand simply the longest, the first of equal ones."""
    found = [(a, text[a:b]) for a, b in spans]
    agreeing = [f for f in found if f[1] == column or f"{f[1]} ".startswith(f"{column} ") or f"{column} ".startswith(f"{f[1]} ")] if column else found
    return max(agreeing, key=lambda f: (len(f[1]), -f[0]), default=(-1, ""))


def _model_words(words: list[str], brand: str, known: list[bool]) -> tuple[list[str], str]:
    """(words outside the brand, the brand as written). Unknown words after the matched
    brand belong to it (a line name); without a match unknown words are the brand, one
    that the dictionary lacks or that is misspelt."""
    mark = brand.split()
    known = [k or w in JOINING or w in PLAIN for w, k in zip(words, known, strict=True)]
    if not mark:
        return [w for w, k in zip(words, known, strict=True) if k], " ".join(w for w, k in zip(words, known, strict=True) if not k)
    for i in range(len(words) - len(mark) + 1):
        if words[i : i + len(mark)] == mark:
            end = i + len(mark)
            while end < len(words) and not known[end]:
                end += 1
            return words[:i] + words[end:], " ".join(words[i:end])
    return list(words), brand


def match_names(listings: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Adds ``name_brand`` (dictionary phrase or unknown words) and ``rest`` (other words).

    Each block's automaton holds at most about ``BLOCK`` phrases; a listing carries its best
    match and its known words from block to block, so blocks find what one automaton would.
    """
    sc = listings.sparkSession.sparkContext
    blocks = max(1, -(-dictionary.count() // BLOCK))
    block = F.pmod(F.xxhash64("phrase"), F.lit(blocks))
    carried = listings.withColumns({"at": F.lit(-1), "hit": F.lit(""), "known": F.transform("words", lambda w: F.lit(False))})

    def matcher(phrases):
        def run(batches):
            auto = ahocorasick.Automaton()
            for phrase, kind in phrases.value:
                key = f" {phrase} "
                auto.add_word(key, (len(phrase), auto.get(key, (0, ""))[1] + kind[0]))
            if len(auto):
                auto.make_automaton()
            for pdf in batches:
                ats, hits, flags = [], [], []
                for words, column, at, hit, known in zip(pdf.words, pdf.col_brand, pdf["at"], pdf.hit, pdf.known, strict=True):
                    text, known = f" {' '.join(words)} ", list(known)
                    spans = []
                    for end, (n, kinds) in auto.iter(text) if len(auto) else ():
                        if "b" in kinds:
                            spans.append((end - n, end))
                        if "m" in kinds:
                            first = text.count(" ", 0, end - n) - 1
                            for i in range(first, first + text.count(" ", end - n, end) + 1):
                                known[i] = True
                    a, h = longest_match(text, spans, column)
                    if (len(h), -a) > (len(hit), -at):
                        at, hit = a, h
                    ats.append(at)
                    hits.append(hit)
                    flags.append(known)
                yield pdf.assign(at=ats, hit=hits, known=flags)

        return run

    for b in range(blocks):
        phrases = sc.broadcast([tuple(r) for r in dictionary.where(block == b).select("phrase", "kind").collect()])  # one block
        carried = carried.mapInPandas(matcher(phrases), carried.schema)

    def split(batches):
        for pdf in batches:
            found = [_model_words(list(w), h, list(k)) for w, h, k in zip(pdf.words, pdf.hit, pdf.known, strict=True)]
            yield pdf.drop(columns=["words", "at", "hit", "known"]).assign(name_brand=[f[1] for f in found], rest=[f[0] for f in found])

    kept = [f for f in carried.schema.fieldNames() if f not in ("words", "at", "hit", "known")]
    return carried.mapInPandas(split, carried.select(*kept, F.lit("").alias("name_brand"), F.col("words").alias("rest")).schema)


# ---- misspelt brands -------------------------------------------------------------------
def _one_slip(a: F.Column, b: F.Column) -> F.Column:
    """Two phrases one insertion, deletion or swap of neighbours apart (not a replacement:
    brands that differ in a letter are different brands)."""
    la, lb = F.length(a), F.length(b)
    same_letters = F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, ""))
    return (F.abs(la - lb) == 1) | ((la == lb) & same_letters)


def resolve_spelling(phrases: DataFrame) -> DataFrame:
    """(phrase, brand): each distinct phrase with the best supported one within a slip.

    ``phrases`` has phrase and support. Candidates share a one-letter deletion, so the
    join groups stay as small as the alphabet allows.
    """
    cuts = F.transform(F.sequence(F.lit(1), F.length("phrase")), lambda i: F.concat(F.substring("phrase", F.lit(1), i - 1), F.col("phrase").substr(i + 1, F.length("phrase"))))
    keyed = phrases.where("phrase <> ''").select("phrase", "support", F.explode(F.array_distinct(F.concat(F.array("phrase"), cuts))).alias("cut"))
    other = keyed.select(F.col("phrase").alias("other"), F.col("support").alias("other_support"), "cut")
    near = keyed.join(other, "cut").where((F.col("other") == F.col("phrase")) | (_one_slip(F.col("phrase"), F.col("other")) & (F.col("other_support") > F.col("support"))))
    return near.groupBy("phrase").agg(F.max_by("other", F.struct("other_support", "other")).alias("brand"))


# ---- wording ---------------------------------------------------------------------------
def model_words(rest: Column) -> Column:
    """The set of words of a name that can tell items apart, as far as language goes."""
    plain = lambda w: F.reduce(F.array(*[F.lit(p) for p in sorted(PLAIN)]), F.lit(False), lambda acc, p: acc | (w == p) | ((F.length(w) >= 4) & F.startswith(p, w)))
    return F.array_sort(F.array_distinct(F.filter(rest, lambda w: ~w.isin(*JOINING) & ~plain(w))))


def _evidence(branded: DataFrame) -> DataFrame:
    """(item, at, word, n, all): the words of every wording of every trade item with two or
    more, the number of its wordings and their hashes taken together (exclusive or).

    An item is what agrees in number, brand, pack and size to a quarter.
    """
    size = F.round(F.log(F.greatest(F.coalesce("milli", F.lit(1.0)), F.lit(1.0))) * 4)
    e = branded.where("gtin is not null and size(ws) > 0").select(F.xxhash64("gtin", "brand", F.coalesce("pack", F.lit(1.0)), size).alias("item"), "ws").distinct()
    each = tabled(e.withColumn("at", F.monotonically_increasing_id()), "item-wordings")
    counted = each.join(each.groupBy("item").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("at")).alias("all")).where("n >= 2"), "item")
    return counted.select("item", "at", F.explode("ws").alias("word"), "n", "all")


def _placed(evidence: DataFrame) -> DataFrame:
    """(item, word, places, n, mark, all): in which of an item's n wordings a word stands, and
    their hashes taken together."""
    return evidence.groupBy("item", "word").agg(F.array_sort(F.collect_set("at")).alias("places"), F.first("n").alias("n"), F.bit_xor(F.xxhash64("at")).alias("mark"), F.first("all").alias("all"))


def _short_form(a: str, b: str) -> Column:
    """One word has the letters of the other in order, the first the same."""
    short, long_ = F.when(F.length(a) <= F.length(b), F.col(a)).otherwise(F.col(b)), F.when(F.length(a) <= F.length(b), F.col(b)).otherwise(F.col(a))
    return (F.length(short) < F.length(long_)) & F.rlike(long_, F.concat(F.lit("^"), F.regexp_replace(short, "(.)", "$1.*")))


def _swaps(evidence: DataFrame, whole: bool) -> DataFrame:
    """(a, b, swaps, na, nb): pairs of words that stand in the same items but in different
    wordings, and each one's items: pairs of a short form and its long form, or with ``whole``
    any pairs of which every wording of the item has one.

    Words meet by first letter, or by the hash of the wordings that the other one lacks, so
    that an item of very many wordings doesn't compare all of its words."""
    placed = tabled(_placed(evidence), "placed")
    n = placed.groupBy("word").agg(F.count("*").alias("items"))
    loose = placed.where(F.size("places") < F.col("n"))
    mine, other = (F.col("mark"), F.col("mark").bitwiseXOR(F.col("all"))) if whole else (F.left("word", F.lit(1)), F.left("word", F.lit(1)))
    a, b = loose.select("item", "n", mine.alias("meet"), F.col("word").alias("a"), F.col("places").alias("pa")), loose.select("item", other.alias("meet"), F.col("word").alias("b"), F.col("places").alias("pb"))
    pairs = F.size("pa") + F.size("pb") == F.col("n") if whole else _short_form("a", "b")
    met = a.join(b, ["item", "meet"]).where((F.col("a") < F.col("b")) & pairs & ~F.arrays_overlap("pa", "pb"))
    swaps = met.groupBy("a", "b").agg(F.count("*").alias("swaps"))
    return swaps.join(n.select(F.col("word").alias("a"), F.col("items").alias("na")), "a").join(n.select(F.col("word").alias("b"), F.col("items").alias("nb")), "b").where(F.col("swaps") >= SWAPPED * F.least("na", "nb"))


def _never_together(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    near = tabled(pairs, "swaps")
    both = sets.select("set", F.col("word").alias("a")).join(near, "a").join(sets.select("set", F.col("word").alias("b")), ["set", "b"]).groupBy("a", "b").agg(F.count("*").alias("together"))
    return near.join(both, ["a", "b"], "left").where(F.coalesce("together", F.lit(0)) <= 0.05 * F.col("swaps")).select("a", "b")


def mine_classes(evidence: DataFrame, sets: DataFrame) -> DataFrame:
    """(word, same): words that replace each other within items, and never stand together.

    First short forms (a word's letters in order, the first the same) meet their long forms,
    in ``SWAPPED`` of the rarer word's items. With these taken as one word, other words are
    the same if in as large a share of the rarer one's items, and at least three, every
    wording has one of the two. ``sets`` are all different word sets (set, word) of the catalogue.
    """
    forms = tabled(_never_together(_swaps(evidence, False), sets), "short-forms")
    first = tabled(connected_components(forms).select(F.col("node").alias("word"), F.col("label").alias("same")), "forms")
    others = _never_together(_swaps(_in_classes(evidence, first).distinct(), True).where("swaps >= 3"), _in_classes(sets, first).distinct())
    return connected_components(forms.unionByName(others)).select(F.col("node").alias("word"), F.col("label").alias("same"))


def mine_optional(evidence: DataFrame) -> DataFrame:
    """(word, beside): words that come and go within items; ``beside`` is the word that makes
    them redundant, or '' where they are so anywhere. ``evidence`` is in classes."""
    placed = tabled(_placed(evidence).withColumn("loose", F.size("places") < F.col("n")), "placed-classes")
    alone = placed.groupBy("word").agg(F.count("*").alias("n"), F.count_if("loose").alias("gone")).where((F.col("gone") >= 2) & (F.col("gone") >= OPTIONAL * F.col("n"))).select("word", F.lit("").alias("beside"))
    firm = placed.where("not loose").select("item", F.col("word").alias("beside"))
    pairs = placed.join(alone.select("word"), "word", "left_anti").join(firm, "item").where("word <> beside").groupBy("word", "beside").agg(F.count("*").alias("n"), F.count_if("loose").alias("gone"))
    beside = pairs.where((F.col("gone") >= 2) & (F.col("gone") >= OPTIONAL * F.col("n"))).select("word", "beside")
    mutual = beside.select(F.col("beside").alias("word"), F.col("word").alias("beside"))  # of two the first stays
    return alone.unionByName(beside.join(mutual.where("word < beside"), ["word", "beside"], "left_anti"))


def _in_classes(words: DataFrame, classes: DataFrame) -> DataFrame:
    return words.join(classes, "word", "left").withColumn("word", F.coalesce("same", "word")).drop("same")


def models(branded: DataFrame) -> DataFrame:
    """(set, model): every different word set of the catalogue in the mined wording."""
    sets = tabled(branded.select(F.array_join("ws", " ").alias("set"), "ws").distinct().select("set", F.explode("ws").alias("word")), "word-sets")
    evidence = tabled(_evidence(branded), "wordings")
    classes = tabled(mine_classes(evidence, sets), "word-classes")
    optional = tabled(mine_optional(_in_classes(evidence, classes).distinct()), "optional-words")
    always = optional.where("beside = ''").select("word")
    kept = tabled(_in_classes(sets, classes).distinct().join(always, "word", "left_anti"), "kept-words")
    gone = kept.join(optional.where("beside <> ''"), "word").join(kept.select("set", F.col("word").alias("beside")), ["set", "beside"]).select("set", "word").distinct()
    return kept.join(gone, ["set", "word"], "left_anti").groupBy("set").agg(F.array_join(F.array_sort(F.collect_set("word")), " ").alias("model"))


# ---- comparison ------------------------------------------------------------------------
def items(products: DataFrame) -> DataFrame:
    """(product_id, item): listings with the same ``item`` describe the same trade item."""
    listings = tabled(prepare(products), "listings")
    matched = tabled(match_names(listings, tabled(mine_dictionary(listings), "dictionary")), "matched")
    phrases = matched.select(F.explode(F.array("col_brand", "name_brand")).alias("phrase")).where("phrase <> ''").groupBy("phrase").agg(F.count("*").alias("support"))
    spelling = tabled(resolve_spelling(phrases), "spelling")
    # listings without a brand in one place have nothing to look up there: their keys are spread
    key = lambda c: F.when(F.col(c) != "", F.col(c)).otherwise(F.concat(F.lit("\0"), F.pmod(F.xxhash64("product_id"), F.lit(4096))))
    col, name = spelling.select(F.col("phrase").alias("k1"), F.col("brand").alias("b1")), spelling.select(F.col("phrase").alias("k2"), F.col("brand").alias("b2"))
    b = matched.withColumn("k1", key("col_brand")).withColumn("k2", key("name_brand")).join(col, "k1", "left").join(name, "k2", "left")
    # the longer of two agreeing brands holds the line name; in conflict the column counts
    brand = F.when(F.col("b1").isNull(), F.col("b2")).when(F.startswith(F.coalesce("b2", F.lit("")), F.concat("b1", F.lit(" "))), F.col("b2")).otherwise(F.col("b1"))
    cols = ["dim", "milli", "milli_ml", "width", F.coalesce("pack", F.lit(1.0)).alias("pack")]
    branded = tabled(b.select("product_id", "gtin", brand.alias("brand"), model_words(F.col("rest")).alias("ws"), *cols).where("brand is not null and size(ws) > 0"), "branded")
    k = branded.withColumn("set", F.array_join("ws", " ")).join(models(branded), "set")
    # a plain ounce is what the model's metric sizes are
    kind = k.groupBy("model").agg(F.when(F.count_if(F.col("dim") == "ml") > F.count_if(F.col("dim") == "g"), "ml").otherwise("g").alias("ounce"))
    k = tabled(k.join(kind, "model").select("product_id", "brand", "model", "pack", "width", F.when(F.col("dim") == "oz", F.col("ounce")).otherwise(F.coalesce("dim", F.lit(""))).alias("dim"), F.when((F.col("dim") == "oz") & (F.col("ounce") == "ml"), F.col("milli_ml")).otherwise(F.coalesce("milli", F.lit(0.0))).alias("milli")), "keys")
    return _by_content(k)


def _classed(values: DataFrame, group: list[str], tolerance: float) -> DataFrame:
    """Numbers the distinct sizes of a group: from the least on, a size starts a new number if
    it is more than ``tolerance`` above the one that started the last, so no number spans more."""
    each = values.groupBy(*group).agg(F.array_sort(F.collect_set("milli")).alias("sizes"))  # sizes of one product

    def step(acc, x):
        new = (F.size(acc) == 0) | (x > F.element_at(acc, -1)["start"] * (1 + tolerance))
        last = F.when(F.size(acc) > 0, F.element_at(acc, -1)["no"]).otherwise(F.lit(0))
        start = F.when(new, x).otherwise(F.element_at(acc, -1)["start"])
        return F.concat(acc, F.array(F.struct(x.alias("milli"), start.alias("start"), (last + new.cast("int")).alias("no"))))

    empty = F.lit(None).cast("array<struct<milli:double,start:double,no:int>>")
    numbered = F.aggregate("sizes", F.coalesce(empty, F.array().cast("array<struct<milli:double,start:double,no:int>>")), step)
    return values.join(each.select(*group, F.explode(numbered).alias("x")).select(*group, F.col("x.milli").alias("milli"), F.col("x.no").cast("long").alias("size_no")), [*group, "milli"])


def _by_content(k: DataFrame) -> DataFrame:
    """Splits (brand, model, dim, pack) groups by content.

    Works on distinct contents only, however many listings state them. Contents
    rounded too roughly to tell sizes apart join the nearest exact one inside their
    rounding.
    """
    group = ["brand", "model", "dim", "pack"]
    k = k.withColumn("rough", F.coalesce(F.col("width"), F.lit(0.0)) > 0.012)
    values = k.groupBy(*group, "rough", "milli").agg(F.max("width").alias("width"))
    exact = _classed(values.where("not rough"), group, TOLERANCE)
    near = values.where("rough").join(exact.select(*group, F.col("milli").alias("exact"), "size_no"), group, "left")
    off = F.abs(F.log(F.col("exact") / F.col("milli")))
    fits = off <= F.col("width") + 0.5 * TOLERANCE
    rough = near.groupBy(*group, "milli").agg(F.min_by(F.when(fits, F.col("size_no")), F.when(fits, off)).alias("size_no"))
    alone = _classed(rough.where("size_no is null").drop("size_no"), group, 2 * TOLERANCE).withColumn("size_no", -F.col("size_no"))
    cols = [*group, "milli", "size_no"]
    sized = exact.select(*cols, F.lit(False).alias("rough")).unionByName(rough.where("size_no is not null").select(*cols, F.lit(True).alias("rough"))).unionByName(alone.select(*cols, F.lit(True).alias("rough")))
    return k.join(sized, [*group, "rough", "milli"]).select("product_id", F.xxhash64(*group, "size_no").alias("item"), *group, "milli")


def item_pairs(found: DataFrame, slice_rows: int = 4096) -> DataFrame:
    """All pairs of listings of one item (the result TESTDATA.md asks for). An item of very
    many listings is cut into slices on one side, each of which meets the other side whole."""
    slices = found.groupBy("item").agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("slices"))
    sliced = found.join(slices, "item")
    a = sliced.select("item", F.col("product_id").alias("product_id_a"), F.pmod(F.xxhash64("product_id"), F.col("slices")).cast("int").alias("slice"))
    b = sliced.select("item", F.col("product_id").alias("product_id_b"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
    return a.join(b, ["item", "slice"]).where("product_id_a < product_id_b").select("product_id_a", "product_id_b")
