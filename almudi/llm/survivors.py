"""Best representative of each duplicate group (problem 4).

Rows of one trade item are grouped by GTIN and merges. Every usable value is a claim, made as
often as rows state it, of a source: the chain and method of its row's best active link, a
human decision, or none. A two-sided latent model - each source has a sensitivity (its rows
state a true value) and a specificity (they don't state a false one) - is fitted by
expectation-maximisation; values with a posterior of at least one half are judged true, and a
field keeps all of them.

The surviving row of a field is the first, in the order of precedence that the data's users
fixed (human decision, link method, support, recency, id), of the rows whose value the model
holds true. That order is total, and no model of sources can reproduce it: the value it puts
first is the model's label, true when the sources are judged and when values are, the others
are latent. ``survivors`` shows each surviving value beside the posterior that the claims
alone give it, and ``agreement`` how often claims alone would have chosen the same.

Defined results
    * a GTIN is its digits padded to 14; without digits, or with more than 14, it joins nothing.
    * ``merged_into`` joins even where its target is absent (rows merged into one absent row).
    * null or unreadable provenance and unknown link methods give no trust; null times are oldest.
    * repeated rows count as rows; groups of fewer than two rows give nothing.
    * empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from almudi.core.runtime import tabled
from almudi.operators.components import connected_components

FIELDS = ("brand", "net_content", "variant")
# Link methods from most to least trusted; values that say nothing.
METHODS = ("manual_review", "reviewed_decision", "gtin_exact", "gtin_sku_derived", "engine_auto")
EMPTY = ("", "n/d", "s/d", "-", "sin dato")
ROUNDS = 8


def _usable(field: str) -> Column:
    """The usable value of a field in normal form, else null."""
    if field == "net_content":
        text = F.regexp_replace(F.trim("net_content_value"), ",", ".")
        number = F.when(text.rlike(r"^\+?[0-9]*\.?[0-9]+$"), text.cast("double"))
        return F.when(number > 0, F.concat_ws(" ", number.cast("string"), F.lower(F.trim(F.coalesce("net_content_unit", F.lit(""))))))
    text = F.lower(F.trim(field))
    return F.when(~text.isin(*EMPTY), text)


def _method_rank(method: str = "link_method") -> Column:
    rank = F.lit(None).cast("int")
    for i, m in enumerate(METHODS):
        rank = F.when(F.col(method) == m, F.lit(i)).otherwise(rank)
    return rank


def claims(masters: DataFrame, links: DataFrame) -> DataFrame:
    """One row per master row and usable field: node, value, source and order of precedence."""
    chain = F.coalesce(F.col("supermarket_id"), F.lit("")) if "supermarket_id" in links.columns else F.lit("")
    best = links.where("status = 'active'").withColumn("r", _method_rank()).where("r is not null").groupBy("master_product_id").agg(F.min("r").alias("rank"), F.min(F.struct("r", chain.alias("c")))["c"].alias("chain"))
    rows = node_rows(masters).join(best, "master_product_id", "left")
    each = []
    for f in FIELDS:
        rule = F.get_json_object("attribute_provenance_json", f"$.{f}.rule")
        support = F.coalesce(F.get_json_object("attribute_provenance_json", f"$.{f}.support").try_cast("double"), F.lit(0.0))
        human = F.coalesce(rule == "human_set", F.lit(False))
        rank = F.coalesce("rank", F.lit(len(METHODS)))
        method = F.element_at(F.array(*[F.lit(m) for m in (*METHODS, "none")]), rank + 1)
        source = F.when(human, "human_set").when(F.col("rank").isNull(), "none").otherwise(F.concat_ws("@", method, "chain"))
        recency = -F.coalesce(F.unix_micros("updated_at_utc"), F.lit(-(1 << 62)))
        order = F.struct((~human).cast("int").alias("a"), rank.alias("b"), (-support).alias("c"), recency.alias("d"), F.col("master_product_id").alias("e"))
        each.append(F.struct(F.lit(f).alias("field_name"), _usable(f).alias("value"), source.alias("source"), order.alias("ord")))
    return rows.select("node", "master_product_id", F.explode(F.array(*each)).alias("x")).select("node", "master_product_id", "x.*").where("value is not null")


def node_rows(masters: DataFrame) -> DataFrame:
    digits = F.regexp_replace(F.coalesce("primary_gtin", F.lit("")), "[^0-9]", "")
    gtin = F.when(F.length(digits).between(1, 14), F.lpad(digits, 14, "0"))
    return masters.select("master_product_id", "brand", "net_content_value", "net_content_unit", "variant", "attribute_provenance_json", "merged_into", "updated_at_utc", F.coalesce(F.concat(F.lit("g:"), gtin), F.concat(F.lit("m:"), "master_product_id")).alias("node"))


def groups(masters: DataFrame) -> DataFrame:
    """(node, component) for nodes joined by merges; other nodes stand for themselves."""
    rows = node_rows(masters)
    target = rows.select(F.col("master_product_id").alias("merged_into"), F.col("node").alias("target"))
    merged = rows.where("merged_into is not null").select("node", "merged_into").join(target, "merged_into", "left")
    edges = merged.select(F.col("node").alias("a"), F.coalesce("target", F.concat(F.lit("m:"), "merged_into")).alias("b")).distinct()
    return connected_components(edges).select("node", F.col("label").alias("component"))


def _component(df: DataFrame, comp: DataFrame) -> DataFrame:
    return df.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")


def _odds(quality: dict[tuple[str, str], tuple[float, float]], prior: dict[str, float]) -> Column:
    """Log-odds that a value is true from its claims ``obs``; unknown sources say nothing."""
    if not quality:
        return F.lit(0.0)
    entries = [F.lit(x) for (f, s), (sens, spec) in sorted(quality.items()) for x in (f"{f}|{s}", f"{math.log(sens / (1 - spec))!r} {math.log((1 - sens) / spec)!r}")]
    known = F.create_map(*entries)
    ratio = lambda o: F.split(known[F.concat_ws("|", "field_name", o["source"])], " ")
    term = lambda o: F.coalesce(o["said"] * F.get(ratio(o), F.lit(0)).cast("double") + o["silent"] * F.get(ratio(o), F.lit(1)).cast("double"), F.lit(0.0))
    start = F.lit(0.0)
    for f, p in sorted(prior.items()):
        start = F.when(F.col("field_name") == f, F.lit(math.log(p / (1 - p)))).otherwise(start)
    return start + F.aggregate("obs", F.lit(0.0), lambda acc, o: acc + term(o))


def _posterior(odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(60.0)), F.lit(-60.0))))


def fit(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[dict[tuple[str, str], tuple[float, float]], dict[str, float]]:
    """EM over (field_name, obs, label, n): different claim patterns with their counts. A
    pattern's ``obs`` says of every source present how many rows state the value (said) and
    how many another one (silent); labelled values are true. Returns (sensitivity,
    specificity) by field and source, and the prior by field; each round collects one row a
    field and source."""
    quality: dict[tuple[str, str], tuple[float, float]] = {(r.field_name, r.source): (0.8, 0.7) for r in patterns.select("field_name", F.explode("obs.source").alias("source")).distinct().collect()}
    prior = dict.fromkeys(FIELDS, 0.5)
    for _ in range(rounds if quality else 0):
        p = patterns.withColumn("p", F.when(F.col("label"), F.lit(1.0)).otherwise(_posterior(_odds(quality, prior))))
        each = p.select("field_name", "p", "n", F.explode(F.concat(F.array(F.struct(F.lit("").alias("source"), F.lit(1).cast("long").alias("said"), F.lit(0).cast("long").alias("silent"))), "obs")).alias("o"))
        true, false = F.col("n") * F.col("p"), F.col("n") * (1 - F.col("p"))
        sums = each.groupBy("field_name", "o.source").agg(F.sum(true * F.col("o.said")).alias("ts"), F.sum(true * F.col("o.silent")).alias("tq"), F.sum(false * F.col("o.said")).alias("fs"), F.sum(false * F.col("o.silent")).alias("fq")).collect()
        clip = lambda x: min(max(x, 0.02), 0.98)
        quality = {(r.field_name, r.source): (clip((r.ts + 4) / (r.ts + r.tq + 5)), clip((r.fq + 3.5) / (r.fs + r.fq + 5))) for r in sums if r.source}
        prior |= {r.field_name: min(max((r.ts + 1) / (r.ts + r.fs + 2), 0.05), 0.95) for r in sums if not r.source}
    return quality, prior


class TruthModel:
    """Claims of all groups of two or more rows, their labels, and the model fitted to them."""

    def __init__(self, masters: DataFrame, links: DataFrame):
        self.comp = groups(masters)
        # per node first: a GTIN shared by very many rows meets its component as one row
        per_node = node_rows(masters).groupBy("node").agg(F.count("*").alias("n"), F.min("master_product_id").alias("first"))
        self.groups = _component(per_node, self.comp).groupBy("component").agg(F.sum("n").alias("n"), F.min("first").alias("group_id")).where("n >= 2").select("component", "group_id")
        said = claims(masters, links).groupBy("node", "field_name", "value", "source").agg(F.count("*").alias("n_rows"), F.min("ord").alias("ord"))
        said = _component(said, self.comp).groupBy("component", "field_name", "value", "source").agg(F.sum("n_rows").alias("n_rows"), F.min("ord").alias("ord"))
        self.said = said.join(self.groups, "component").drop("component")
        self._fitted = None

    def labels(self) -> DataFrame:
        """(group_id, field_name, master_product_id, value) of the surviving rows."""
        best = self.said.groupBy("group_id", "field_name").agg(F.min(F.struct("ord", "value")).alias("s"))
        return best.select("group_id", "field_name", F.col("s.ord.e").alias("master_product_id"), "s.value")

    def _model(self) -> tuple[DataFrame, dict, dict]:
        if self._fitted is None:
            said = tabled(self.said, "claims")
            present = said.groupBy("group_id", "field_name", "source").agg(F.sum("n_rows").alias("n"), F.min(F.struct("ord", "value")).alias("ord")).groupBy("group_id", "field_name").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("present"), F.min("ord").alias("first"))
            values = said.groupBy("group_id", "field_name", "value").agg(F.map_from_entries(F.collect_list(F.struct("source", "n_rows"))).alias("by"), F.sum("n_rows").alias("n_rows"), F.min("ord").alias("ord"))
            count = lambda s: F.coalesce(F.try_element_at("by", s), F.lit(0).cast("long"))
            obs = F.array_sort(F.transform(F.map_entries("present"), lambda e: F.struct(e["key"].alias("source"), count(e["key"]).alias("said"), (e["value"] - count(e["key"])).alias("silent"))))
            coded = tabled(values.join(present, ["group_id", "field_name"]).select("group_id", "field_name", "value", "n_rows", "ord", (F.struct("ord", "value") == F.col("first")).alias("label"), obs.alias("obs")), "coded")
            patterns = tabled(coded.groupBy("field_name", "obs", "label").agg(F.count("*").alias("n")), "patterns")
            self._fitted = (coded, *fit(patterns), patterns)
        return self._fitted

    @property
    def values(self) -> DataFrame:
        """(group_id, field_name, value, n_rows, posterior, is_true): every claimed value with
        its posterior by the claims, and whether it is held true (labels always are)."""
        coded, quality, prior, _ = self._model()
        p = coded.withColumn("posterior", _posterior(_odds(quality, prior)))
        return p.select("group_id", "field_name", "value", "n_rows", "posterior", (F.col("label") | (F.col("posterior") >= 0.5)).alias("is_true"), "label", "ord")

    def sources(self) -> DataFrame:
        _, quality, prior, _ = self._model()
        rows = [(f, s, *q, prior[f]) for (f, s), q in sorted(quality.items())]
        return self.said.sparkSession.createDataFrame(rows, "field_name string, source string, sensitivity double, specificity double, prior double")

    def survivors(self) -> DataFrame:
        """Per group and field, the surviving row: of the values that the fitted model holds
        true the one whose best row comes first in the order of precedence, with its posterior
        by the claims."""
        best = self.values.where("is_true").groupBy("group_id", "field_name").agg(F.min(F.struct("ord", "value", "posterior")).alias("s"))
        return best.select("group_id", "field_name", F.col("s.ord.e").alias("master_product_id"), "s.value", "s.posterior", (F.col("s.posterior") >= 0.5).alias("claims_agree"))

    def agreement(self) -> DataFrame:
        """Per field: groups with more than one value, and in how many of them the likeliest
        value is the label, with the model as fitted and fitted without any label."""
        coded, quality, prior, patterns = self._model()
        blind = fit(patterns.withColumn("label", F.lit(False)).groupBy("field_name", "obs", "label").agg(F.sum("n").alias("n")))
        top = lambda odds: F.max_by("label", F.struct(odds, F.col("label").cast("int")))
        g = coded.groupBy("group_id", "field_name").agg(F.count("*").alias("n"), top(_odds(quality, prior)).alias("fitted"), top(_odds(*blind)).alias("blind")).where("n > 1")
        return g.groupBy("field_name").agg(F.count("*").alias("n_groups"), F.count_if("fitted").alias("n_agree"), F.count_if("blind").alias("n_agree_unlabelled"))
