import json

import numpy as np

from almudi.llm import survivors as V

M = "master_product_id string, primary_gtin string, brand string, net_content_value string, net_content_unit string, variant string, attribute_provenance_json string, merged_into string, updated_at_utc timestamp, node string, source string"
L = "master_product_id string, link_method string, status string, value string"


def _m(i, gtin=None, brand=None, net=None, variant=None, prov=None, into=None, at=None):
    return (i, gtin, brand, net, "g", variant, prov if isinstance(prov, str) or prov is None else json.dumps(prov), into, at, "n", "s")


def _found(spark, masters, links):
    t = V.TruthModel(spark.createDataFrame(masters, M), spark.createDataFrame(links, L))
    got = {(r.group_id, r.field_name): r.master_product_id for r in t.labels().collect()}
    assert got == {(r.group_id, r.field_name): r.master_product_id for r in t.survivors().collect()}
    return got, t


def test_precedence(spark, ts):
    masters = [
        _m("a", "0952-1", "N/D", "0", "x", {"variant": {"rule": "human_set"}}), _m("b", " 09521", "Uno", "400,5", None, {"brand": {"support": 2}}), _m("c", None, "dos", "1.5", "y", {"brand": {"support": 9}}, into="a"),
        _m("d", "77", "  ", None, "-", at=ts(1)), _m("e", "77", "z", "5", "v", at=ts(1)), _m("f", "0077", "w", "5", "v", at=ts(2)), _m("g", "0077", "w", "5", "v", at=ts(2)),
        _m("h", "5", "alone", "1", "q"), _m("i", None, "q"), _m("j", "", "q"), _m("k", "999999999999999", "q"), _m("l", "999999999999999", "q"),
    ]
    links = [("c", "engine_auto", "active", "x"), ("b", "manual_review", "rejected", "x"), ("c", "manual_review", "superseded", "x"), (None, "gtin_exact", "active", "x"), ("e", "unheard of", "active", "x")]
    got, _ = _found(spark, masters, links)
    assert got == {("a", "brand"): "c", ("a", "net_content"): "c", ("a", "variant"): "a", ("d", "brand"): "f", ("d", "net_content"): "f", ("d", "variant"): "f"}


def test_support_decides_between_equal_methods(spark):
    masters = [_m("a", "1", "x", prov={"brand": {"support": 2}}), _m("b", "1", "y", prov={"brand": {"support": 10}}), _m("c", "1", "z", prov="not json")]
    assert _found(spark, masters, [])[0] == {("a", "brand"): "b"}


def test_long_merge_chain_and_hot_gtin(spark):
    masters = [_m(f"m{i:03}", None, f"b{i}", into=f"m{i + 1:03}" if i < 39 else None) for i in range(40)] + [_m(f"z{i}", "123", "q") for i in range(300)]
    got, t = _found(spark, masters, [])
    assert got == {("m000", "brand"): "m000", ("z0", "brand"): "z0"}
    assert t.values.where("group_id = 'z0'").first().n_rows == 300


def test_empty(spark):
    got, t = _found(spark, [], [])
    assert got == {} and t.sources().count() == t.agreement().count() == 0


def test_em_recovers_source_quality(spark):
    """Sources of known quality, some stating a value several times, and no labels: estimates
    come close, and values judged true are mostly true ones."""
    rng = np.random.default_rng(4)
    sens, spec = {"a": 0.95, "b": 0.6, "c": 0.9}, {"a": 0.9, "b": 0.95, "c": 0.4}
    rows, truth = [], []
    for _ in range(3000):
        t = rng.random() < 0.6
        obs = []
        for s in sens:
            n = int(rng.integers(1, 3))
            said = int(rng.binomial(n, sens[s] if t else 1 - spec[s]))
            obs.append((s, said, n - said))
        rows.append(("brand", obs, False, 1))
        truth.append(t)
    df = spark.createDataFrame(rows, "field_name string, obs array<struct<source:string,said:long,silent:long>>, label boolean, n long").coalesce(1)
    quality, prior = V.fit(df, 20)
    for s in sens:
        assert abs(quality["brand", s][0] - sens[s]) < 0.1 and abs(quality["brand", s][1] - spec[s]) < 0.1
    assert abs(prior["brand"] - 0.6) < 0.1
    judged = [r.p >= 0.5 for r in df.select(V._posterior(V._odds(quality, prior)).alias("p")).collect()]
    assert np.mean(np.array(judged) == np.array(truth)) > 0.9


def test_labels_make_their_sources_trusted_and_counts_weigh(spark):
    masters, links = [], []
    for g in range(30):
        for k, (chain, method, value) in enumerate([("x", "manual_review", "right"), ("y", "engine_auto", "wrong"), ("x", "gtin_exact", "right"), ("z", "gtin_exact", "right" if g % 2 else "other")]):
            masters.append(_m(f"g{g:02}-{k}", f"{1000 + g}", value))
            links.append((f"g{g:02}-{k}", method, "active", "v", chain))
    t = V.TruthModel(spark.createDataFrame(masters, M), spark.createDataFrame(links, L + ", supermarket_id string"))
    q = {r.source: r for r in t.sources().collect()}
    assert set(q) == {"manual_review@x", "engine_auto@y", "gtin_exact@x", "gtin_exact@z"}
    assert q["manual_review@x"].sensitivity > 0.8 > 0.2 > q["engine_auto@y"].sensitivity
    r = t.agreement().first()
    assert (r.field_name, r.n_groups, r.n_agree) == ("brand", 30, 30)
    assert {(v.value, v.is_true) for v in t.values.collect()} >= {("right", True), ("wrong", False)}


def test_found_rows_are_those_of_values_that_the_model_holds_true(spark, monkeypatch, tmp_path):
    from almudi.llm import queries as Q

    masters = [_m("a", "1", "x", prov={"brand": {"rule": "human_set"}}), _m("b", "1", "y", prov={"brand": {"support": 9}}), _m("c", "1", "z"), _m("d", "1", "z")]
    spark.createDataFrame(masters, M).write.parquet(f"{tmp_path}/master_products.parquet")
    spark.createDataFrame([("c", "gtin_exact", "active", "v")], L).write.parquet(f"{tmp_path}/master_product_links.parquet")
    found = lambda: [tuple(r) for r in Q.p4_found(spark, str(tmp_path)).collect()]
    assert found() == [("a", "brand", "a")]
    values = V.TruthModel.values.fget
    monkeypatch.setattr(V.TruthModel, "values", property(lambda t: values(t).withColumn("is_true", V.F.col("value") != "x")))
    assert found() == [("a", "brand", "c")]


def test_found_against_sql(spark):
    import glob
    from pathlib import Path

    import duckdb
    import pytest

    from almudi.llm import queries as Q

    sf = "/root/testdata/sf0.001"
    if not Path(sf).is_dir():
        pytest.skip("test tables absent")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    for name, sql in Q.ORACLE.items():
        df = Q.QUERIES[name](spark, sf)
        cur = con.execute(sql)
        cols = [c[0] for c in cur.description]
        assert sorted(df.columns) == sorted(cols), name
        assert sorted(map(str, map(tuple, df.select(*cols).collect()))) == sorted(map(str, cur.fetchall())), name
