import json
import random

from pyspark.sql import functions as F

from almudi.operators import catalogue as C
from almudi.operators import ranking


def test_columnar_documents(spark):
    docs = [json.dumps({"columns": ["a", "b"], "rows": [["1", "x"], ["2", None], ["q"]]}), "{broken", None, json.dumps({"columns": ["b"], "rows": [["y"]]})]
    got = C.decode_columnar(spark.createDataFrame([(d,) for d in docs], "doc string"), "doc", {"a": "bigint", "b": "string"}).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "x"), (2, None), (None, None), (None, "y")], key=str)


def test_collapse_with_ties_and_nulls(spark):
    rows = [("t", 2, None), ("t", 1, "e"), ("t", 3, "e"), (None, 9, None), (None, 9, None)]
    df = spark.createDataFrame(rows, "title string, id long, ean string")
    got = {r.title: (r.id, r.n_variants) for r in C.collapse(df, ["title"], [F.col("ean").isNull().cast("int"), F.col("id")], F.col("ean").isNotNull()).collect()}
    assert got == {"t": (1, 2), None: (9, 0)}


def test_prefix_length(spark):
    df = spark.createDataFrame([("abcd",), ("abce",), ("abce",), ("b",), (None,)], "id string")
    assert tuple(C.unique_prefix_length(df.where("id is not null"), "id", 1, 4).first()) == (3, 4)
    assert C.unique_prefix_length(df.where("id is not null"), "id", 1, 3).first().prefix_length is None


def test_urls_and_codes(spark):
    urls = {"HTTPS://A.b/X/?utm_source=1&q=2#t": "https://a.b/X?q=2", "http://a.b": "http://a.b", "http://a.b/?gclid=1": "http://a.b", None: None}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", C.canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in rows} == urls
    codes = {"04252614": "042100005264", "01234565": "012345000065", "0123": None, None: None}
    rows = spark.createDataFrame([(c,) for c in codes], "c string").select("c", C.upc_e_to_a(F.col("c")).alias("a")).collect()
    assert {r.c: r.a for r in rows} == codes


def test_key_sets_round_trip_and_tampering(spark):
    df = spark.createDataFrame([(["b", "a", "a", None],), ([],), (None,)], "k array<string>").select("k", C.encode_keys("k").alias("e"))
    assert [r.x for r in df.select(C.decode_keys("e.payload", "e.sha").alias("x")).collect()] == [["a", "b"], [], []]
    bad = df.select(C.decode_keys(F.concat(F.lit("A"), "e.payload"), "e.sha").alias("x"), C.decode_keys("e.payload", F.lit("0")).alias("y"))
    assert all(r.x is None and r.y is None for r in bad.collect())


def test_reconcile_upsert_and_conflicts(spark):
    one = lambda *v: spark.createDataFrame([(x,) for x in v], "k long")
    assert {tuple(r) for r in C.reconcile({"b": one(1, 1, 2), "a": one(2, None), "c": one()}, "k").collect()} == {(1, "b"), (2, "a,b")}
    s = "k long, v string"
    u = C.upsert(spark.createDataFrame([(1, "x"), (2, None), (3, "z")], s), spark.createDataFrame([(1, "y"), (2, None), (4, "n")], s), ["k"], ["v"])
    assert {tuple(r) for r in u.collect()} == {(1, "y", "updated"), (2, None, "kept"), (3, "z", "kept"), (4, "n", "inserted")}
    g = spark.createDataFrame([("g", "a", None), ("g", "b", "z"), ("h", "a", "z")], "g string, p string, q string")
    assert {tuple(r) for r in C.group_conflicts(g, "g", ["p", "q"]).collect()} == {("g", 2, "p"), ("h", 1, "")}


def test_cliques_audit_lexicon(spark, ts):
    nodes = spark.createDataFrame([("g", x) for x in "abc"] + [("h", "x"), ("h", "y")], "g string, n string")
    edges = spark.createDataFrame([("g", "a", "b"), ("g", "b", "a"), ("g", "b", "c"), ("g", "a", "a"), ("h", "y", "x")], "g string, a string, b string")
    assert {(r.g, r.n_pairs, r.is_clique) for r in C.cliques(nodes, edges, "g", "n").collect()} == {("g", 2, False), ("h", 1, True)}
    a = C.audit(spark.createDataFrame([(1, None), (1, None), (2, "x")], "k long, v string"), ["k"], {"none": F.col("v").isNull(), "x": F.col("v") == "x"})
    assert {tuple(r) for r in a.collect()} == {(1, "none"), (2, "x")}
    b = spark.createDataFrame([("la vaca",), ("lavaca",), ("la vaca",), (None,)], "b string")
    assert [tuple(r) for r in C.brand_lexicon(b, "b").collect()] == [("lavaca", "la vaca", 3, 2)]
    e = C.episodes(spark.createDataFrame([("k", ts(1), None), ("k", ts(3), 5)], "k string, at timestamp, p long"), ["k"], "at", F.col("p").isNotNull()).first()
    assert (e.first_seen, e.last_seen, e.priced_since, e.n_unpriced) == (ts(1).replace(tzinfo=None), ts(3).replace(tzinfo=None), ts(3).replace(tzinfo=None), 1)


def test_chunks_and_upper_medians_across_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), i, float(rng.randint(1, 9))) for i in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "g string, id long, v double")
    got = {r.id: r.chunk for r in ranking.chunked(df, "g", "id", 7, block=64).collect()}
    for g in "ab":
        ids = sorted(i for h, i, _ in rows if h == g)
        assert [got[i] for i in ids] == [k // 7 for k in range(len(ids))]
    m = {(r.all_outer, r.g): r.upper_median for r in ranking.upper_medians(df.withColumn("u", F.lit("x")), "g", "u", "v").collect()}
    for key, want in ((0, "a"), (0, "b"), (1, None)):
        v = sorted(x for h, _, x in rows if want in (None, h))
        assert m[key, want] == v[len(v) // 2]
