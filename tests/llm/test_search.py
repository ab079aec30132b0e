import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import search
from attestry.llm.search import TopKParams, best_of, products, top_k


def model(rows, k, scale=64.0):
    use = [(i, np.floor(np.array(v) * scale).astype(object)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all()]
    out = []
    for a, (i, x) in enumerate(use):
        if i % 20 == 0:
            found = sorted((-int(x @ y), j) for b, (j, y) in enumerate(use) if b != a and len(y) == len(x))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("p", [TopKParams(), TopKParams(k=3, block=16, queries=4, lane=1, fan_in=2), TopKParams(k=400, block=64, lane=2)])
def test_against_all_pairs(spark, p):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))]
    rows += [(400 + i, rows[7][1]) for i in range(60)] + [(20, rows[3][1]), (20, rows[3][1])]       # ties and repeated ids
    rows += [(500, None), (501, [float("nan")] * 8), (502, [None] * 8), (None, rows[1][1]), (503, []), (504, [1.0] * 3), (520, [2.0] * 3), (540, [3.0] * 5)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, block int").repartition(5)
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, p).collect())
    assert got == model(rows, p.k)
    assert top_k(df.limit(0), F.col("vec_id") % 20 == 0, p).collect() == []


def test_products_are_exact():
    rng = np.random.default_rng(2)
    for top in (60, 10 ** 4, 10 ** 8):
        a, b = rng.integers(-top, top, (5, 64)), rng.integers(-top, top, (7, 64))
        assert (products(a, b) == a.astype(object) @ b.astype(object).T).all()


def test_best_of_breaks_ties_by_id():
    scores, ids = np.array([[1, 5, 5, 5, 0]]), np.array([9, 8, 3, 7, 1])
    best, found = best_of(scores, ids, 2)
    assert best.tolist() == [[5, 5]] and found.tolist() == [[3, 7]]


def test_copies_of_queries_do_not_pass_through_the_driver(spark):
    p = TopKParams(k=3, block=16, queries=4, lane=1, lanes=2)
    rows = [(i, [float(i % 7), 1.0 - i % 3]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    blocks = search._blocks(df, F.col("vec_id") % 20 == 0, p)
    tiles = search._tiles(search._query_blocks(blocks, p), blocks, 13, p)
    assert "Broadcast" not in tiles._jdf.queryExecution().executedPlan().toString()     # their copies are not in the size check
    assert len(blocks.first()["points"]) <= 2 * 2 * 16                                  # two bytes a component, not eight
    assert sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, p).collect()) == model(rows, 3)


def test_narrow_integers_keep_their_values():
    for top in (127, 128, 2 ** 15, 2 ** 31, 2 ** 62):
        a = np.array([[-top, top - 1], [0, 1]])
        assert (search._wide(search._narrow(a), 2, 2) == a).all()
