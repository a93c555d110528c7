from collections import Counter, defaultdict
from random import Random

from almudi.llm import packing as P
from almudi.llm.mixing import Mix
from almudi.llm.tokens import encoding, token_counts

DOC = "doc_id long, text string, source string, n_tokens long, h long"
SIZE = "size_name string, capacity_tokens int"
MIX = "source string, target_share double, max_repeats int"
WORDS = "pan leche arroz queso café precio tienda bolsa marca oferta".split()


def _docs(n, seed=1, longest=60):
    rng = Random(seed)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, longest))), rng.choice(["A ", "b", "C", None]), 0, 0) for i in range(n)]
    return rows + [(n, None, "b", 0, 0), (n + 1, "  ", "b", 0, 0), (n + 2, "pan " * 900, "c", 0, 0)]


def test_every_text_is_packed_within_capacity(spark):
    rows = _docs(400)
    sizes = [("s", 64), ("m", 300), (None, 9), ("bad", 0), ("s", 50)]
    docs = spark.createDataFrame(rows, DOC)
    n = {r.doc_id: r.n_tokens for r in token_counts(docs).collect()}
    out = P.pack(docs, spark.createDataFrame(sizes, SIZE)).collect()
    for name, cap in (("s", 64), ("m", 300)):
        fill, total, pieces = Counter(), Counter(), defaultdict(list)
        for r in out:
            if r.size_name == name:
                fill[r.container_id] += r.n_tokens
                total[r.doc_id] += r.n_tokens
                pieces[r.doc_id].append(r.piece_no)
        assert max(fill.values()) <= cap and dict(total) == n and set(pieces) == set(n)
        for d, k in pieces.items():
            assert sorted(k) == list(range(max(1, -(-n[d] // cap))))  # cut only if longer than the capacity
        assert len(fill) <= 1.03 * sum(n.values()) / cap + 2
    assert {r.size_name for r in out} == {"s", "m"}


def test_rows_without_their_own_id_are_packed(spark):
    rows = _docs(40) + [(1, "pan " * 20, "b", 0, 0), (1, "pan " * 150, "b", 0, 0), (1, "pan " * 150, "b", 0, 0), (None, "arroz", "b", 0, 0), (None, "leche " * 30, "b", 0, 0), (None, "leche " * 30, "b", 0, 0)]
    docs = spark.createDataFrame(rows, DOC)
    out = P.pack(docs, spark.createDataFrame([("s", 64)], SIZE)).collect()
    fill, total, want = Counter(), Counter(), Counter()
    for r in out:
        fill[r.container_id] += r.n_tokens
        total[r.doc_id] += r.n_tokens
    for r in token_counts(docs).collect():
        want[r.doc_id] += r.n_tokens
    assert max(fill.values()) <= 64 and total == want
    assert Counter(r.doc_id for r in out)[None] == 3


def test_packing_is_repeatable_and_empty(spark):
    rows, sizes = _docs(60), spark.createDataFrame([("s", 64)], SIZE)
    one = sorted(map(tuple, P.pack(spark.createDataFrame(rows, DOC), sizes).collect()))
    assert one == sorted(map(tuple, P.pack(spark.createDataFrame(rows[::-1], DOC).repartition(3), sizes).collect()))
    assert P.pack(spark.createDataFrame([], DOC), sizes).count() == 0
    assert P.pack(spark.createDataFrame(rows, DOC), spark.createDataFrame([], SIZE)).count() == 0


def test_crossover_keeps_every_item_once():
    rng = Random(2)
    sizes = [rng.randint(0, 50) for _ in range(200)]
    a, b = P.best_fit(list(range(200)), sizes, 100), P.best_fit(list(range(199, -1, -1)), sizes, 100)
    for child in (P.crossover(a, b, sizes, 100, rng), P.mutate(a, sizes, 100, rng), P.evolve(sizes, 100, 3)):
        assert sorted(i for x in child for i in x) == list(range(200))
        assert max(sum(sizes[i] for i in x) for x in child) <= 100


def _fitted(sizes, capacity):
    return len(P.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, capacity))


def test_evolution_saves_containers():
    """Triples that fill a container exactly, which best fit misses; never more than best fit."""
    rng, saved = Random(7), 0
    for seed in range(4):
        sizes = []
        for _ in range(40):
            a = rng.randint(38, 49)
            b = rng.randint(26, (99 - a) // 2 + 8)
            sizes += [a, b, 100 - a - b]
        best = len(P.evolve(sizes, 100, seed))
        assert P.least_bins(sizes, 100) <= best <= _fitted(sizes, 100)
        saved += _fitted(sizes, 100) - best
    assert saved >= 2


def test_lower_bound_against_brute_force():
    def exact(sizes, cap, bins=()):
        if not sizes:
            return len(bins)
        rest, x = sizes[1:], sizes[0]
        tried = {b for b in bins if b + x <= cap}
        return min([exact(rest, cap, tuple(sorted([*bins[: bins.index(b)], b + x, *bins[bins.index(b) + 1 :]]))) for b in tried] + [exact(rest, cap, tuple(sorted([*bins, x])))])

    rng = Random(3)
    for _ in range(60):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 6))]
        assert P.least_bins(sizes, 20) <= exact(sizes, 20)
    assert P.least_bins([11, 11, 11, 9], 20) == 3 and P.least_bins([], 20) == 0


def test_report_and_checks(spark):
    docs, sizes = spark.createDataFrame(_docs(300), DOC), spark.createDataFrame([("s", 64), ("m", 300)], SIZE)
    for r in P.fill_report(docs, sizes).collect():
        assert r.least_of_shards <= r.evolved_containers <= r.best_fit_containers and r.least_containers <= r.containers
    packed = P.pack(docs, sizes)
    assert all((r.n_packed, r.n_miscounted, r.n_cut_in_vain, r.n_over_capacity) == (303, 0, 0, 0) for r in P.checks(packed, docs, sizes).collect())
    broken = packed.where("not (doc_id = 1 and piece_no = 0 and size_name = 's')").withColumn("container_id", P.F.when(P.F.col("size_name") == "m", "x").otherwise(P.F.col("container_id")))
    got = {r.size_name: r for r in P.checks(broken, docs, sizes).collect()}
    assert got["s"].n_packed == 302 and got["m"].n_over_capacity == 1


def test_mix_reaches_targets_within_caps(spark):
    docs = spark.createDataFrame(_docs(900, 3), DOC)
    mix = Mix(docs, spark.createDataFrame([(" a", 0.5, 2), ("B", 0.3, 1), ("none", 0.2, 4), ("x", None, 1), (None, 0.1, 1)], MIX))
    rep = {r.source: r for r in mix.report().collect()}
    assert set(rep) == {"a", "b", "none"} and rep["none"].reached_share == 0
    assert abs(rep["a"].reached_share - 0.625) < 0.01 and abs(rep["b"].reached_share - 0.375) < 0.01
    assert rep["a"].most_repeats <= 2 and rep["b"].most_repeats <= 1
    small, large = {r.doc_id: r.repeats for r in mix.selection(0.4).collect()}, {r.doc_id: r.repeats for r in mix.selection().collect()}
    assert set(small) <= set(large) and all(large[d] >= k for d, k in small.items())
    assert not {900, 901} & set(large)


def test_mix_of_nothing(spark):
    docs, none = spark.createDataFrame(_docs(20), DOC), spark.createDataFrame([], MIX)
    assert Mix(docs, none).selection().count() == 0 and Mix(docs, none).report().count() == 0
    empty = Mix(spark.createDataFrame([], DOC), spark.createDataFrame([("a", 1.0, 1)], MIX))
    assert empty.selection().count() == 0 and [r.tokens for r in empty.report().collect()] == [0]


def test_tokens_are_whole_texts(spark):
    text = "El café cuesta L 12.50. " * 500
    assert encoding().decode(encoding().encode_ordinary(text)) == text
    got = token_counts(spark.createDataFrame([(1, text, " X ", 0, 0)], DOC)).first()
    assert (got.source, got.n_tokens) == ("x", len(encoding().encode_ordinary(text)))
