"""Series, changes, ranking and linkage operators against brute force."""

import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from almudi.operators import changes, current, linkage, ranking, series
from almudi.operators.components import connected_components
from almudi.plans import linkage_queries

PTS = "k string, at timestamp, v long, f boolean, value string"


def _points(ts):
    rng = random.Random(5)
    return [(k, ts(i), rng.choice([None, 100, 110, 90]), rng.choice([True, False, None]), "x") for k in "abc" for i in range(rng.randint(1, 40))]


def test_series_summary(spark, ts):
    pts = _points(ts)
    got = {r.k: r for r in series.series_summary(spark.createDataFrame(pts, PTS), ("k",), "at", "v").collect()}
    for k in "abc":
        v = [p[2] for p in pts if p[0] == k and p[2] is not None]
        assert (got[k].n_points, got[k].first_value, got[k].last_value, got[k].n_distinct) == (len(v), v[0], v[-1], len(set(v)))
        assert got[k].n_changes == sum(a != b for a, b in itertools.pairwise(v))
        mean = sum(v) / len(v)
        assert got[k].variation_pct == pytest.approx(100 * math.sqrt(sum((x - mean) ** 2 for x in v) / len(v)) / mean, abs=1e-3)


def test_windows_take_the_value_that_held_at_their_start(spark, ts):
    pts = [("a", ts(0), 100, None, "x"), ("a", ts(95), 120, None, "x"), ("b", ts(98), 50, None, "x"), ("c", ts(200), 5, None, "x"), ("d", ts(1), None, None, "x")]
    r = series.window_summaries(spark.createDataFrame(pts, PTS), ("k",), "at", "v", F.lit(ts(100)), (7, 30)).collect()
    got = {(x.k, x.window_days): (x.status, x.baseline, x.n_inside, x.least, x.greatest, x.change_pct) for x in r}
    assert got["a", 7] == ("ok", 100, 1, 100, 120, 20.0) and got["b", 30] == ("insufficient_history", None, 1, None, None, None)
    assert ("c", 7) not in got and ("d", 7) not in got


def test_flag_runs_and_tails(spark, ts):
    flags = [True, True, None, True, False, True, True]
    pts = [("a", ts(i), 5 if i < 3 else 7, f, "x") for i, f in enumerate(flags)] + [("b", ts(0), None, False, "x")]
    df = spark.createDataFrame(pts, PTS)
    r = {x.k: (x.n_on, x.n_starts, x.on_since) for x in series.flag_runs(df, ("k",), "at", "f").collect()}
    assert r == {"a": (5, 3, ts(5).replace(tzinfo=None)), "b": (0, 0, None)}
    t = {x.k: (x.since, x.value) for x in series.equal_tail_start(df, ("k",), "at", "v").collect()}
    assert t == {"a": (ts(3).replace(tzinfo=None), 7), "b": (ts(0).replace(tzinfo=None), None)}


def test_change_classes(spark, ts):
    rows = [("a", ts(0), 1, True, "x"), ("a", ts(1), 1, True, "x"), ("a", ts(2), 2, True, "x"), ("a", ts(3), None, None, "x")]
    c = changes.classified_changes(spark.createDataFrame(rows, PTS), ("k",), "at", {"v": "price", "f": "promo"}).orderBy("at").collect()
    assert [(r.change_class, r.changed_fields) for r in c] == [("initial", ""), ("price", "v"), ("multiple", "v,f")]


def test_diff_plan_and_chains(spark, ts):
    a = spark.createDataFrame([("x", 1), ("y", None), ("z", 3)], "k string, v long")
    b = spark.createDataFrame([("x", 2), ("y", None), ("w", 3)], "k string, v long")
    assert {tuple(r) for r in changes.diff_plan(a, b, ("k",), ("v",)).collect()} == {("x", "update"), ("y", "unchanged"), ("z", "insert"), ("w", "retire")}
    p = spark.createDataFrame([("a", ts(0), ts(1)), ("a", ts(1), ts(3)), ("a", ts(2), None)], "k string, s timestamp, e timestamp")
    r = changes.chain_faults(p, ("k",), "s", "e").first()
    assert (r.n_periods, r.n_gaps, r.n_open) == (3, 1, 1)


def test_baskets_and_votes(spark):
    lines = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "c", 1)], "basket long, item string, quantity long")
    offers = spark.createDataFrame([("a", "s", 10), ("b", "s", 5), ("a", "t", 8)], "item string, seller string, price long")
    o = {(r.basket, r.seller): (r.coverage_bp, r.total) for r in ranking.basket_options(lines, offers).collect()}
    assert o == {(1, "s"): (10000, 25), (1, "t"): (5000, None)}
    s = {r.basket: (r.missing, r.sellers, r.total) for r in ranking.split_basket(lines, offers).collect()}
    assert s == {1: (0, 2, 21), 2: (1, 0, None)}
    m = spark.createDataFrame([("g", 1, "b"), ("g", 1, "a"), ("g", 1, "a"), ("g", 2, "c"), ("g", 0, None)], "g string, tier int, v string")
    assert tuple(ranking.vote(m, "g", "v", "tier").first()) == ("g", "a", 1, 2, 4)


def test_current_rows_and_ranks(spark, ts):
    s = spark.createDataFrame([(1, "l", ts(0), "r", 5), (1, "l", ts(2), "r2", None), (2, "l", ts(1), "r", 5)], "product_id long, location_id string, valid_from_utc timestamp, scrape_run_id string, p long")
    assert {(r.product_id, r.p) for r in current.current_rows(s).collect()} == {(1, None), (2, 5)}
    r = current.rank_within(spark.createDataFrame([("g", 5, "a"), ("g", 5, "b"), ("g", 9, "c")], "g string, v long, m string"), "g", "v", "m").collect()
    assert {(x.m, x.price_rank, x.best, x.highest) for x in r} == {("a", 1, 5, 9), ("b", 1, 5, 9), ("c", 2, 5, 9)}


def test_components_of_chains_and_stars(spark):
    edges = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)] + [("hub", f"s{i}") for i in range(50)] + [("x", "x"), (None, "y"), ("p", "q"), ("q", "p")]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"c{i:03}"] for i in range(61)} == {"c000"} and {got[f"s{i}"] for i in range(50)} == {"hub"}
    assert got["p"] == got["q"] == "p" and "x" not in got and "y" not in got
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0


def _sets():
    rng = random.Random(3)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 3)) for _ in range(rng.randint(1, 9))] for _ in range(60)]
    near = [b[:-1] + ["zz"] if rng.random() < 0.5 else [*b, "yy"] for b in base]
    return base + near + base[:20] + [[], None]


def test_set_join_is_exact_and_minhash_recalls(spark):
    sets = _sets()
    df = spark.createDataFrame(list(enumerate(sets)), "id long, words array<string>")
    classes, members = linkage.word_classes(df, "id", F.col("words"))
    ids = {r.id: r.class_id for r in members.collect()}
    assert len(ids) == sum(bool(s) for s in sets)
    want = set()
    for (i, a), (j, b) in itertools.combinations([(i, set(s)) for i, s in enumerate(sets) if s], 2):
        if ids[i] != ids[j] and len(a & b) / len(a | b) >= 0.8:
            want.add(tuple(sorted((ids[i], ids[j]))))
    got = {(r.a, r.b) for r in linkage.similar_classes(classes).collect()}
    assert got == want and want
    fast = {(r.a, r.b) for r in linkage.minhash_pairs(classes).collect()}
    assert fast <= want and len(fast) >= 0.9 * len(want)
    empty = classes.where("false")
    assert linkage.similar_classes(empty).count() == 0


@pytest.mark.parametrize("threshold", [0.4, 0.8, 1.0])
def test_set_join_at_other_thresholds_and_many_frequent_words(spark, monkeypatch, threshold):
    monkeypatch.setattr(linkage, "FREQUENT", 5)
    sets = {i: frozenset(s) for i, s in enumerate(_sets()) if s}
    sets |= {1000 + i: frozenset(f"w{k}" for k in range(12) if k != i) for i in range(12)}
    distinct = {s: i for i, s in sets.items()}
    classes = spark.createDataFrame([(i, sorted(s)) for s, i in distinct.items()], "class_id long, words array<string>")
    want = sorted(tuple(sorted((i, j))) for (a, i), (b, j) in itertools.combinations(distinct.items(), 2) if len(a & b) / len(a | b) >= threshold - 1e-9)
    assert sorted((r.a, r.b) for r in linkage.similar_classes(classes, threshold).collect()) == want
    found = linkage.minhash_found(classes, threshold=threshold).collect()
    assert sorted((r.a, r.b) for r in found) == want
    assert {(r.a, r.b) for r in found if r.fast} == {(r.a, r.b) for r in linkage.minhash_pairs(classes, threshold=threshold).collect()}


def test_recall_needs_no_band_candidates(spark, monkeypatch, tmp_path):
    """Bands meet in nearly all pairs of these names, whose number grows with the square."""
    names = [f"leche entera fresca {chr(97 + i // 26)}{chr(97 + i % 26)}z" for i in range(300)] + ["pan dulce con pasas", "pan dulce con pasas y", "pan dulce con pasas", None, ""]
    spark.createDataFrame([(i, "s", n, None, None) for i, n in enumerate(names)], "product_id long, supermarket_id string, name string, brand string, ean string").coalesce(1).write.parquet(f"{tmp_path}/products.parquet")
    monkeypatch.setattr(linkage, "minhash_pairs", None)
    assert linkage_queries.e_minhash_recall(spark, str(tmp_path)).first().asDict() == {"n_exact": 1, "n_fast": 1, "n_both": 1, "recall": 1.0}


def test_tfidf_cosine(spark):
    docs = {1: "pan blanco", 2: "pan blanco", 3: "leche"}
    df = spark.createDataFrame(list(docs.items()), "id long, t string")
    v = linkage.tfidf(df, "id", F.split("t", " "))
    pairs = spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")
    assert {(r.a, r.b): round(r.cosine, 6) for r in linkage.cosines(pairs, v, "id").collect()} == {(1, 2): 1.0, (1, 3): 0.0}
    w = {(r.id, r.gram): r.weight for r in v.collect()}
    idf = {g: math.log(4 / (1 + n)) + 1 for g, n in Counter(x for t in docs.values() for x in t.split()).items()}
    assert w[1, "pan"] == pytest.approx(idf["pan"] / math.hypot(idf["pan"], idf["blanco"]))


def test_weights_separate_matches(spark):
    rng = random.Random(1)
    rows = [("same", "same", "same")] * 30 + [tuple(rng.choice(["differs", "differs", "same", "missing"]) for _ in range(3)) for _ in range(300)]
    fs = linkage.FellegiSunter(("x", "y", "z")).fit(sorted(Counter(rows).items()))
    df = spark.createDataFrame(list(set(rows)), "x string, y string, z string").withColumn("w", fs.weight())
    got = {(r.x, r.y, r.z): r.w for r in df.collect()}
    assert max(got, key=got.get) == ("same", "same", "same") and fs.weights["x"]["same"] > fs.weights["x"]["differs"]


def test_thresholds_and_mutual_best(spark):
    s = spark.createDataFrame([(3.0, True)] * 20 + [(2.0, True)] * 9 + [(2.0, False)] * 2 + [(1.0, False)] * 20, "w double, ok boolean")
    assert linkage.threshold_for(s, "w", "ok", 0.9) == 2.0
    p = spark.createDataFrame([("a", "x", 5.0, "1", "2"), ("a", "y", 3.0, "1", "2"), ("b", "x", 4.0, "1", "2")], "a string, b string, w double, ga string, gb string")
    assert [(r.a, r.b) for r in linkage.mutual_best(p, "w", "ga", "gb").collect()] == [("a", "x")]
