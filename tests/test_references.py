from pyspark.sql import functions as F

from almudi.operators.references import Child, Parent, counted, orphan_references, orphan_report

REF = "k string, at timestamp, status string, n long"
PAR = "k string, since timestamp, status string, n long"


def _run(spark, refs, parents):
    c = Child("child", spark.createDataFrame(refs, REF), "parent", "k", "at", F.col("status") == "active")
    p = Parent("parent", spark.createDataFrame(parents, PAR), "k", "since", F.col("status") == "retired")
    return counted(orphan_references([c], [p]), [c])


def test_kinds_by_month(spark, ts):
    refs = [
        ("gone", ts(0), "active", 1), ("gone", ts(40), None, 1), ("gone", ts(40), None, 1), (None, ts(0), "active", 1),
        ("old", ts(0), "active", 1), ("old", ts(0), "superseded", 1), ("old", ts(70), "superseded", 1),
        ("new", ts(0), "active", 1), ("new", ts(99), "active", 1), ("ok", ts(5), "active", 1), ("ok", None, "active", 1), (" ok", ts(5), "active", 1),
    ]
    parents = [("old", ts(50), "retired", 1), ("new", ts(10), "active", 1), ("ok", ts(1), "active", 1), ("ok", ts(1), "active", 1), (None, ts(1), "active", 1)]
    found = {(r.ref_key, r.period_month, r.orphan_kind): r.period_refs for r in _run(spark, refs, parents).collect()}
    assert found == {
        ("gone", "2025-01", "missing"): 1, ("gone", "2025-02", "missing"): 2, ("old", "2025-01", "deleted"): 1, ("old", "2025-01", "late"): 1,
        ("new", "2025-01", "late"): 1, (" ok", "2025-01", "missing"): 1,
    }


def test_null_time_has_no_month_and_empty_tables(spark):
    assert [(r.period_month, r.orphan_kind) for r in _run(spark, [("x", None, None, 1)], []).collect()] == [("none", "missing")]
    assert _run(spark, [], []).count() == 0
    assert orphan_report(_run(spark, [("x", None, None, 1)], [])).first().orphan_keys == 1


def test_hot_key_against_brute_force(spark, ts):
    refs = [("hot", ts(i % 60), "active", i) for i in range(900)] + [(f"k{i % 7}", ts(i % 90), "active", i) for i in range(300)]
    parents = [(f"k{i}", ts(20 * i), "active", i) for i in range(5)]
    since = {k: s for k, s, _, _ in parents}
    want = {}
    for k, at, _, _ in refs:
        kind = "missing" if k not in since else "late" if at < since[k] else None
        if kind:
            key = (k, at.strftime("%Y-%m"), kind)
            want[key] = want.get(key, 0) + 1
    assert {(r.ref_key, r.period_month, r.orphan_kind): r.period_refs for r in _run(spark, refs, parents).collect()} == want
