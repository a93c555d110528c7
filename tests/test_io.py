import pytest

from almudi.sources import readers, sinks
from almudi.streaming import events


def test_json_and_csv(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "id long, t string")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert sorted(map(tuple, readers.read_jsonl(spark, str(tmp_path / "j"), "id long, t string").collect()), key=str) == [(1, 'a "b", c'), (2, None)]
    sinks.write_csv(df, str(tmp_path / "c"), ["id", "t"])
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path / "c"), "id long, t string").collect()), key=str) == [(1, 'a "b", c'), (2, None)]
    (tmp_path / "bad.json").write_text('{"id": "x"}\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        readers.read_jsonl(spark, str(tmp_path / "bad.json"), "id long, t string").collect()


def test_quarantine(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"id": 1}')
    (tmp_path / "no.json").write_text('{"id": ')
    good, bad = readers.read_documents(spark, str(tmp_path), "id long")
    assert [r.id for r in good.collect()] == [1] and len(bad.collect()) == 1


def test_sitemap_and_cards(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc> http://a/1 </loc></url><url><loc>http://a/1</loc></url><url><loc></loc></url></urlset>")
    assert [r.loc for r in readers.sitemap_urls(spark, str(tmp_path / "s.xml")).collect()] == ["http://a/1"]
    html = '<div><p data-product-id="7" data-price="9.50">Pan <b>blanco</b><br> 500g</p><i data-product-id="8">x</i></div>'
    rows = readers.product_cards(spark.createDataFrame([(1, html), (2, None), (3, "<p")], "page_id long, html string")).collect()
    assert [tuple(r) for r in rows] == [(1, 0, "7", "9.50", "Pan blanco 500g"), (1, 1, "8", None, "x")]


def test_chunks_manifest_and_absent(spark, tmp_path):
    df = spark.range(25).selectExpr("id", "id % 2 AS part")
    sinks.write_chunks(df, str(tmp_path / "k"), "part", 5)
    m = sinks.manifest(spark, str(tmp_path / "k"), ".parquet").collect()
    assert len(m) == 6 and all(len(r.sha256) == 64 and r.bytes > 0 for r in m)
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k long"), spark.createDataFrame([(2,)], "k long")
    assert [r.k for r in sinks.insert_absent(a, b, ["k"]).collect()] == [1]


def test_streams_agree_with_batch(spark, tmp_path):
    rows = [(i, f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", i % 4, "click" if i % 5 else "view", 1.5, "{}") for i in range(60)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "value", "props")
    df.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    w = events.run_available(events.windowed(events.event_stream(spark, str(tmp_path))), "complete")
    want = {}
    for _, t, _, k, v, _ in rows:
        want[t[:10], k] = want.get((t[:10], k), 0) + 1
    assert {(str(r.start)[:10], r.event_type): r.n for r in w.collect()} == want
    s = events.run_available(events.user_switches(events.event_stream(spark, str(tmp_path))), "update", "user_id")
    for r in s.collect():
        mine = [k for _, t, u, k, _, _ in sorted(rows, key=lambda x: (x[1], x[0])) if u == r.user_id]
        assert (r.n_events, r.n_switches, r.last_type) == (len(mine), sum(a != b for a, b in zip(mine, mine[1:], strict=False)), mine[-1])
