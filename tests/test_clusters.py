"""Pair weights and clusters of listings on small catalogues."""

import pytest

from almudi.operators import linkage as L
from almudi.plans import linkage_queries as Q

PROD = "product_id long, supermarket_id string, name string, brand string, ean string"
SORTS = "arroz frijoles leche queso avena harina azucar pasta cafe jugo atun sal miel pan crema".split()


def _ean(n):
    body = f"740{n:09}"
    return body + str(-sum(int(d) * (3 if k % 2 else 1) for k, d in enumerate(body)) % 10)


def _labelled():
    """Fifteen products under one name and GTIN in three chains, from id 100 on."""
    return [(100 + 3 * i + c, f"chain {c}", f"{s} marca{i} grande bolsa entera {i + 1} kg", f"marca{i}", _ean(i)) for i, s in enumerate(SORTS) for c in range(3)]


def _catalogue(spark, folder, rows):
    spark.createDataFrame(rows, PROD).write.parquet(f"{folder}/products.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def named(spark, tmp_path_factory):
    """Equal names in several chains; a copy within a chain; a similar text of a chain that the
    first listing of a class has too."""
    rows = _labelled() + [(1, "chain 0", "aceite soya zuvare grande 500 ml", "zuvare", None), (2, "chain 1", "aceite soya zuvare grande 500 ml", "zuvare", None), (4, "chain 1", "aceite soya zuvare grande 500 ml", "zuvare", None)]
    rows += [(3, "chain 0", "aceite soya zuvare grande botella 500 ml", "zuvare", None)]
    rows += [(5, "chain 2", "aceite soya zuvare grande lata 500 ml", "zuvare", None)]
    return _catalogue(spark, tmp_path_factory.mktemp("named"), rows)


def test_members_of_one_class_are_linked(spark, named):
    got = {(r.product_id_a, r.product_id_b): r.similarity for r in Q.e_pair_weights(spark, named).collect()}
    assert got[1, 2] == 1.0 and all(got[100 + 3 * i, 101 + 3 * i] == 1.0 for i in range(len(SORTS)))
    assert got[2, 3] == pytest.approx(6 / 7) and (1, 3) in got  # listing 1 doesn't stand for listing 2
    assert not any(4 in p for p in got)  # a copy of listing 2


def test_every_listing_gets_its_cluster(spark, named):
    rows = Q.e_clusters(spark, named).collect()
    got = {r.product_id: r.cluster_id for r in rows}
    assert len(got) == len(rows)
    for i in range(len(SORTS)):
        assert got[100 + 3 * i] == got[101 + 3 * i] == got[102 + 3 * i] == 100 + 3 * i
    assert got.get(2) == got.get(4)


def test_clashes_drop_the_weakest_links(spark, tmp_path):
    """1 and 5 are of one chain: the component 1 - 2 - 3 - 5 keeps 1 - 2 - 3, and 5 gets no cluster."""
    name = "aceite soya zuvare grande fino"
    rows = _labelled() + [(1, "chain 0", name, "zuvare", _ean(90)), (2, "chain 1", name, "zuvare", _ean(90)), (3, "chain 2", name, "zuvare", _ean(90)), (5, "chain 0", f"{name} ya", "zuvare", None)]
    got = {r.product_id: (r.cluster_id, r.n_listings) for r in Q.e_clusters(spark, _catalogue(spark, tmp_path, rows)).collect()}
    assert got[1] == got[2] == got[3] == (1, 3) and 5 not in got
    assert len(got) == 3 + 3 * len(SORTS)


def test_constrained_clusters(spark):
    rows = [(1, 2, "x", "y", 9.0), (2, 3, "y", "x", 8.0), (3, 4, "x", "y", 7.0), (4, 5, "y", "z", 6.0), (10, 11, "x", "y", 5.0), (11, 12, "y", "z", 4.0)]
    p = spark.createDataFrame(rows, "a long, b long, ga string, gb string, w double")
    got = {r.node: r.cluster_id for r in L.constrained_clusters(p, "w", "ga", "gb").collect()}
    # 2 - 3 joins two of chain x; 5 has no pair with 3, nor 12 with 10
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 10: 10, 11: 10}
    assert L.constrained_clusters(p.where("false"), "w", "ga", "gb").count() == 0
