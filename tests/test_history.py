"""Versions (3) and snapshot changes (6) against brute force."""

import random

from almudi.operators import snapshots, versions

HIST = "product_id long, location_id string, current_price_minor long, reported_regular_price_minor long, is_promotion boolean, availability string, valid_from_utc timestamp, scrape_run_id string, loaded_at_utc timestamp, value string, run string"
RUNS = "scrape_run_id string, location_id string, observed_at_utc timestamp, run_status string, field string"
ATTR = ("current_price_minor", "reported_regular_price_minor", "is_promotion")
KEY = ("product_id", "location_id")


def _data(ts, seed, products=6, n_runs=30):
    rng = random.Random(seed)
    runs, hist = [], []
    for loc in ("a", "b"):
        for i in range(n_runs):
            status = "success" if rng.random() < 0.85 else "rejected"
            at = ts(7 * i + rng.randint(0, 5))
            run = (f"{loc}{rng.random()}", loc, at, status, "f")
            runs += [run] * rng.choice([1, 1, 2])
            for p in range(products):
                if rng.random() < 0.8:
                    for d in range(rng.choice([1, 1, 1, 2])):
                        hist.append((p, loc, rng.choice([None, 10, 20]), rng.choice([None, 30]), rng.choice([None, True, False]), rng.choice(["in_stock", "unknown"]), at, run[0], ts(7 * i + 6, d), "v", "r"))
    rng.shuffle(hist)
    return runs, hist


def _state(runs, hist):
    ok = {r[0] for r in runs if r[3] == "success"}
    best = {}
    for h in hist:
        if h[7] in ok and h[6] is not None:
            k = (h[0], h[1], h[6])
            if k not in best or h[8] > best[k][8]:
                best[k] = h
    return best


def test_versions_against_brute_force(spark, ts):
    runs, hist = _data(ts, 1)
    state = snapshots.state_rows(spark.createDataFrame(hist, HIST), spark.createDataFrame(runs, RUNS))
    got = {(r.product_id, r.location_id, r.valid_from, r.valid_to) for r in versions.versions(state, KEY, "valid_from_utc", ATTR).collect()}
    want, series = set(), {}
    for (p, loc, at), h in sorted(_state(runs, hist).items()):
        series.setdefault((p, loc), []).append((at.replace(tzinfo=None), h[2:5]))
    for k, rows in series.items():
        starts = [r[0] for i, r in enumerate(rows) if i == 0 or r[1] != rows[i - 1][1]]
        want |= {(*k, a, b) for a, b in zip(starts, [*starts[1:], None], strict=True)}
    assert got == want and len(want) > 40


def test_changes_against_brute_force(spark, ts):
    runs, hist = _data(ts, 2)
    r, h = spark.createDataFrame(runs, RUNS), spark.createDataFrame(hist, HIST)
    fields = ("current_price_minor", "availability")
    got = {tuple(x) for x in snapshots.snapshot_changes(snapshots.state_rows(h, r, fields), r, fields).collect()}
    by_run = {}
    for (p, _, _), x in _state(runs, hist).items():
        by_run.setdefault(x[7], {})[p] = (x[2], x[5])
    want = set()
    for loc in ("a", "b"):
        order = [x[0] for x in sorted({x for x in runs if x[3] == "success" and x[1] == loc}, key=lambda x: x[2])]
        for old, new in zip(order, order[1:], strict=False):
            o, n = by_run.get(old, {}), by_run.get(new, {})
            for p in o.keys() | n.keys():
                if p not in o:
                    want.add((new, p, "added", ""))
                elif p not in n:
                    want.add((new, p, "removed", ""))
                elif o[p] != n[p]:
                    names = [f for f, a, b in (("availability", o[p][1], n[p][1]), ("current_price_minor", o[p][0], n[p][0])) if a != b]
                    want.add((new, p, "changed", ",".join(names)))
    assert got == want and {x[2] for x in want} == {"added", "removed", "changed"}


def test_one_entity_with_a_long_history(spark, ts):
    """A single hot key over many quarters: boundaries between quarters start no version."""
    runs = [(f"r{i}", "a", ts(i), "success", "f") for i in range(400)]
    hist = [(1, "a", 5 if i < 250 else 6, None, None, "in_stock", ts(i), f"r{i}", ts(i), "v", "r") for i in range(400)]
    state = snapshots.state_rows(spark.createDataFrame(hist, HIST), spark.createDataFrame(runs, RUNS))
    v = versions.versions(state, KEY, "valid_from_utc", ATTR).orderBy("valid_from").collect()
    assert [(r.current_price_minor, r.valid_from, r.valid_to) for r in v] == [("5", ts(0).replace(tzinfo=None), ts(250).replace(tzinfo=None)), ("6", ts(250).replace(tzinfo=None), None)]


def test_nulls_ties_and_empty(spark, ts):
    runs = spark.createDataFrame([("r", "a", ts(1), "success", "f"), (None, "a", ts(2), "success", "f"), ("q", "a", ts(3), None, "f")], RUNS)
    row = (None, None, None, None, None, None, ts(1), "r", None, "v", "r")
    rows = [row, row, (1, "a", 5, None, None, "x", ts(1), "r", ts(1), "v", "r"), (1, "a", 7, None, None, "x", ts(1), "r", ts(1), "v", "r"), (2, "a", 7, None, None, "x", None, "r", ts(1), "v", "r"), (3, "a", 7, None, None, "x", ts(3), "q", ts(1), "v", "r")]
    state = snapshots.state_rows(spark.createDataFrame(rows, HIST), runs)
    assert sorted((r.product_id or 0, r.current_price_minor or 0) for r in state.collect()) == [(0, 0), (1, 7)]
    assert versions.versions(state, KEY, "valid_from_utc", ATTR).count() == 2
    none = snapshots.state_rows(spark.createDataFrame([], HIST), spark.createDataFrame([], RUNS))
    assert versions.versions(none, KEY, "valid_from_utc", ATTR).count() == 0
    assert snapshots.snapshot_changes(none, spark.createDataFrame([], RUNS), ("availability",)).count() == 0
