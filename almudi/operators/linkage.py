"""Record linkage: exact set-similarity join, MinHash bands, TF-IDF, Fellegi-Sunter weights.

Records with equal word sets form a class first; joins run between class representatives,
so copies never multiply. The set join is exact: candidates share words among each side's
rarest words (prefix filter), which keeps frequent words out of the join keys, and nothing
is capped or skipped.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from almudi.core.runtime import tabled
from almudi.operators.components import connected_components

THRESHOLD = 0.8
FREQUENT = 65_536


def word_sets(words: Column) -> Column:
    return F.array_sort(F.array_distinct(words))


def word_classes(records: DataFrame, id_col: str, words: Column) -> tuple[DataFrame, DataFrame]:
    """(classes: class_id, words, n_members; membership: id, class_id) by distinct word set.

    Records without words belong to no class.
    """
    r = records.select(id_col, word_sets(words).alias("words")).where("size(words) > 0")
    m = r.withColumn("class_id", F.sha2(F.array_join("words", " "), 256))
    classes = m.groupBy("class_id").agg(F.first("words").alias("words"), F.count("*").alias("n_members"))
    return classes, m.select(id_col, "class_id")


def jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def _rarest_first(classes: DataFrame) -> DataFrame:
    """(class_id, words): the words of every class in one order that holds for all classes,
    rare ones first. Only the counts of the ``FREQUENT`` most frequent words are looked up;
    the other words come before them, in the order of the alphabet."""
    tokens = classes.select("class_id", F.explode("words").alias("word"))
    often = tokens.groupBy("word").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "word").limit(FREQUENT)
    ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")))
    return tokens.join(F.broadcast(often), "word", "left").groupBy("class_id").agg(ranked["word"].alias("words"))


def _similar(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity, wa, wb): each pair of ``similar_classes`` once, with its words.

    Different sets as similar as more than one half have two common words at least; the two
    rarest of them are among each side's rarest words, so these two are the join key.
    """
    shared = 2 if threshold > 0.5 else 1
    n = F.size("words")

    def keyed(least, side):
        """A set that has ``least`` words of its partner, under each key it can meet it by."""
        p = F.slice("words", 1, F.greatest((n - F.ceil(least - 1e-9) + shared).cast("int"), F.lit(0)))
        after = lambda x, i: F.transform(F.slice(p, i + 2, F.size(p)), lambda y: F.xxhash64(x, y))
        keys = F.flatten(F.transform(p, after)) if shared == 2 else F.transform(p, lambda x: F.xxhash64(x))
        return ordered.select(F.col("class_id").alias(f"id_{side}"), F.col("words").alias(f"w_{side}"), n.alias(f"n_{side}"), F.explode(F.array_distinct(keys)).alias("key"))

    ordered = _rarest_first(classes)
    # the union has all words of the larger set, and twice those of the smaller one less the common ones at least
    larger, smaller = keyed(n * threshold, "x"), keyed(n * (2 * threshold / (1 + threshold)), "y")
    need = F.ceil((F.col("n_x") + F.col("n_y")) * (threshold / (1 + threshold)) - 1e-9)
    # different sets of one size share less than all words; each such pair meets in one order
    near_size = (need <= F.col("n_y")) & ((F.col("n_x") > F.col("n_y")) | ((F.col("n_x") == F.col("n_y")) & (need < F.col("n_y")) & (F.col("id_x") < F.col("id_y"))))
    # candidates are compared inside the join, so that none is shuffled, and kept at the key of their rarest common words
    once = F.xxhash64(*[F.get(F.array_intersect("w_x", "w_y"), F.lit(i)) for i in range(shared)]) == F.col("key")
    similar = jaccard(F.col("w_x"), F.col("w_y"))
    met = larger.join(smaller, "key").where(near_size & (similar >= threshold - 1e-9) & once)
    return met.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b"), similar.alias("similarity"), F.col("w_x").alias("wa"), F.col("w_y").alias("wb"))


def similar_classes(classes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of different classes with a Jaccard similarity of at least ``threshold``."""
    return _similar(classes, threshold).select("a", "b", "similarity")


def _least_hash(words: str, seed: int) -> Column:
    return F.array_min(F.transform(words, lambda w: F.xxhash64(w, F.lit(seed))))


def _bands(words: str, bands: int, rows: int) -> list[Column]:
    """The hash of each band of a class's MinHash values."""
    return [F.xxhash64(*[_least_hash(words, s) for s in range(k * rows, (k + 1) * rows)]) for k in range(bands)]


def minhash_pairs(classes: DataFrame, bands: int = 16, rows: int = 3, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs that agree in a band of MinHash values, verified: fast, with a measured recall."""
    band = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), h.alias("h")) for k, h in enumerate(_bands("words", bands, rows))]))
    keys = classes.select("class_id", band.alias("x")).select("class_id", "x.*")
    pairs = keys.select(F.col("class_id").alias("a"), "k", "h").join(keys.select(F.col("class_id").alias("b"), "k", "h"), ["k", "h"]).where("a < b").select("a", "b").distinct()
    wa, wb = classes.select(F.col("class_id").alias("a"), F.col("words").alias("wa")), classes.select(F.col("class_id").alias("b"), F.col("words").alias("wb"))
    return pairs.join(wa, "a").join(wb, "b").select("a", "b", jaccard(F.col("wa"), F.col("wb")).alias("similarity")).where(F.col("similarity") >= threshold - 1e-9)


def minhash_found(classes: DataFrame, bands: int = 16, rows: int = 3, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, fast): every pair of ``similar_classes`` and whether ``minhash_pairs`` finds it.

    A verified pair is a similar one, so ``minhash_pairs`` finds just those similar pairs
    that agree in a band. Its other candidates, whose number grows with the square of the
    catalogue, needn't be made for that.
    """
    agree = reduce(or_, [x == y for x, y in zip(_bands("wa", bands, rows), _bands("wb", bands, rows), strict=True)])
    return _similar(classes, threshold).select("a", "b", agree.alias("fast"))


def tfidf(records: DataFrame, id_col: str, grams: Column, needed: DataFrame | None = None) -> DataFrame:
    """(id, gram, weight): sublinear term frequency, smoothed inverse frequency, unit length.

    ``records`` has one row per id. Frequencies are over all records; with ``needed`` only
    its ids get weights.
    """
    df = records.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    some = records if needed is None else records.join(needed, id_col, "left_semi")
    g = some.select(id_col, F.explode(grams).alias("gram")).groupBy(id_col, "gram").agg(F.count("*").alias("tf"))
    n = records.count()
    w = g.join(df, "gram").select(id_col, "gram", ((1 + F.log("tf")) * (F.log((1.0 + n) / (1.0 + F.col("df"))) + 1)).alias("w"))
    norm = w.groupBy(id_col).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, id_col).select(id_col, "gram", (F.col("w") / F.col("norm")).alias("weight"))


def cosines(pairs: DataFrame, vectors: DataFrame, id_col: str) -> DataFrame:
    """Cosine of the given pairs (a, b) of ids: both vectors are looked up, nothing else is joined."""
    va = vectors.select(F.col(id_col).alias("a"), "gram", F.col("weight").alias("wa"))
    vb = vectors.select(F.col(id_col).alias("b"), "gram", F.col("weight").alias("wb"))
    dots = pairs.select("a", "b").join(va, "a").join(vb, ["b", "gram"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine"))
    return pairs.join(dots, ["a", "b"], "left").withColumn("cosine", F.coalesce("cosine", F.lit(0.0)))


def level(a: Column, b: Column) -> Column:
    """same, differs or missing."""
    return F.when(a.isNull() | b.isNull(), "missing").when(a == b, "same").otherwise("differs")


class FellegiSunter:
    """Match weights of level patterns; m, u and the prior by expectation-maximisation over
    distinct patterns, whose number the levels bound."""

    def __init__(self, fields: Iterable[str], iterations: int = 40):
        self.fields, self.iterations = tuple(fields), iterations

    def fit(self, patterns: list[tuple[tuple[str, ...], int]]) -> FellegiSunter:
        self.levels = [sorted({p[k] for p, _ in patterns}) for k in range(len(self.fields))]
        x = [np.array([self.levels[k].index(p[k]) for p, _ in patterns]) for k in range(len(self.fields))]
        n = np.array([c for _, c in patterns], dtype=float)
        m = [np.array([0.9 if v == "same" else 0.05 for v in lv]) for lv in self.levels]
        m = [v / v.sum() for v in m]
        u = [(np.bincount(xk, n, len(lv)) + 1) / (n.sum() + len(lv)) for xk, lv in zip(x, self.levels, strict=True)]
        self.prior = 0.1
        for _ in range(self.iterations):
            odds = math.log(self.prior / (1 - self.prior)) + sum(np.log(mk[xk] / uk[xk]) for mk, uk, xk in zip(m, u, x, strict=True))
            p = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
            self.prior = float(np.clip((n * p).sum() / n.sum(), 1e-4, 0.99))
            m = [(np.bincount(xk, n * p, len(lv)) + 0.5) / ((n * p).sum() + 0.5 * len(lv)) for xk, lv in zip(x, self.levels, strict=True)]
            u = [(np.bincount(xk, n * (1 - p), len(lv)) + 0.5) / ((n * (1 - p)).sum() + 0.5 * len(lv)) for xk, lv in zip(x, self.levels, strict=True)]
        self.weights = {f: {v: float(np.log2(mk[i] / uk[i])) for i, v in enumerate(lv)} for f, lv, mk, uk in zip(self.fields, self.levels, m, u, strict=True)}
        return self

    def weight(self) -> Column:
        """log2 odds of a match from the level columns."""
        total = F.lit(math.log2(self.prior / (1 - self.prior)))
        for f in self.fields:
            add = F.lit(0.0)
            for v, w in self.weights[f].items():
                add = F.when(F.col(f) == v, F.lit(w)).otherwise(add)
            total = total + add
        return total


def threshold_for(scored: DataFrame, score: str, label: str, target: float, support: int = 20) -> float | None:
    """The least score from which the cumulated precision of labelled pairs reaches
    ``target``; equal scores enter together. Scores are pattern weights, so few distinct."""
    rows = scored.where(F.col(label).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.count_if(label).alias("hits")).collect()
    best, n, hits = None, 0, 0
    for r in sorted(rows, key=lambda r: -r[score]):
        n, hits = n + r.n, hits + r.hits
        if n >= support and hits / n >= target:
            best = r[score]
    return best


def mutual_best(pairs: DataFrame, score: str, side_a: str, side_b: str) -> DataFrame:
    """Pairs that are each other's best partner in the other's group; ties by id."""
    both = pairs.select("a", "b", score, F.col(side_b).alias("g")).unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), score, F.col(side_a).alias("g")))
    best = both.groupBy("a", "g").agg(F.max_by("b", F.struct(score, "b")).alias("best"))
    fwd = pairs.join(best.select("a", F.col("g").alias(side_b), F.col("best").alias("b")), ["a", side_b, "b"], "left_semi")
    back = best.select(F.col("a").alias("b"), F.col("g").alias(side_a), F.col("best").alias("a"))
    return fwd.join(back, ["b", side_a, "a"], "left_semi")


def resolve(edges: Iterable[tuple[int, int, str, str]]) -> dict[int, int]:
    """(node: least node of its cluster) of edges (a, b, group of a, group of b), best first.

    Two clusters merge over an edge if they have no group in common and every pair between
    them is an edge (complete linkage). The groups bound a cluster's size.
    """
    edges = list(edges)
    linked = {frozenset(e[:2]) for e in edges}
    group = {n: g for a, b, ga, gb in edges for n, g in ((a, ga), (b, gb))}
    cluster = {n: [n] for n in group}
    for a, b, *_ in edges:
        x, y = cluster[a], cluster[b]
        if x is y or {group[n] for n in x} & {group[n] for n in y} or not all(frozenset((n, m)) in linked for n in x for m in y):
            continue
        x += y
        for n in y:
            cluster[n] = x
    return {n: min(c) for n, c in cluster.items() if len(c) > 1}


def constrained_clusters(pairs: DataFrame, rank: str, side_a: str, side_b: str) -> DataFrame:
    """(node, cluster_id) of pairs (a, b) of ids, merged by descending ``rank``, ties by id;
    see ``resolve``. No merge crosses a connected component, so each is worked on alone."""
    labels = connected_components(pairs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["place", "a", "b"])
        found = resolve(zip(ordered.a, ordered.b, ordered.ga, ordered.gb, strict=True))
        return pd.DataFrame({"node": list(found), "cluster_id": list(found.values())}, dtype="int64")

    place = F.row_number().over(W.partitionBy("label").orderBy(F.desc(rank), "a", "b"))
    e = pairs.join(labels.select(F.col("node").alias("a"), "label"), "a").select("a", "b", F.col(side_a).alias("ga"), F.col(side_b).alias("gb"), "label", place.alias("place"))
    return tabled(e.groupBy("label").applyInPandas(run, "node long, cluster_id long"), "resolved")
