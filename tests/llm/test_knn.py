import numpy as np
import pytest

from pyspark.sql import functions as F

from versio.llm import knn


def want(rows, k, every):
    vecs = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vecs[i] = np.floor(64 * np.array(v, float))
    out = set()
    for q, x in vecs.items():
        if q % every == 0:
            def dot(y, x=x):
                return sum(int(a) * int(b) for a, b in zip(x, y))
            best = sorted((-dot(y), i) for i, y in vecs.items() if i != q)[:k]
            out |= {(q, r, i, -s) for r, (s, i) in enumerate(best, 1)}
    return out


def got(spark, rows, k, every, **more):
    df = spark.createDataFrame([(i, v, 9) for i, v in rows], "vec_id bigint, v array<float>, score int")
    out = knn.top_k(df, "vec_id", "v", k, F.col("vec_id") % every == 0, **more)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    rows = [tuple(r) for r in out.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("shape", ["spread", "clusters", "hot"])
def test_equals_brute_force(spark, shape):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 6)).astype(np.float32)
    if shape == "clusters":
        x = (np.repeat(rng.normal(size=(6, 6)) * 5, 100, 0) + 0.1 * x).astype(np.float32)
    if shape == "hot":
        x[:250] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    expected = want(rows, 7, 5)
    assert got(spark, rows, 7, 5) == expected
    assert got(spark, rows, 7, 5, pivots=9, query_block=16, data_block=100) == expected


def test_bounds_prune_what_is_far():
    points = np.array([[0.0, 0.0, 0.0], [100.0, 0.0, 0.0]])
    pivots = knn.Pivots(points, 0.0)
    groups = knn.summary_bounds(pivots, 2, {0: (5, 1.0)}, [(0, 0.5), (0, 1.0), (0, 1.5), (1, 0.2), (1, 0.3), (1, 0.4)], 100)
    assert groups.theta == pytest.approx([2.5], abs=1e-4) and groups.salts.tolist() == [1]
    x = np.array([[0.5, 0.0], [3.4, 0.0], [3.6, 0.0], [99.0, 0.0]])
    assert groups.need(pivots, x)[:, 0].tolist() == [True, True, False, False]
    many = knn.summary_bounds(pivots, 2, {0: (250, 1.0), 1: (40, 1.0)}, [(0, 0.5), (0, 1.0)], 100)
    assert many.salts.tolist() == [3, 1] and np.isinf(many.theta).all() and many.need(pivots, x).all()
    line = np.arange(6.0)[:, None] * np.array([[1.0, 0.0]])
    assert knn.packed(line[[0, 5, 1, 4, 2, 3]], np.array([3, 3, 3, 3, 3, 3]), 6) == [[0, 2], [1, 3], [4, 5]]
    assert knn.packed(line, np.array([1, 1, 9, 1, 1, 1]), 4) == [[0, 1], [2], [3, 4, 5]]


def test_clustered_vectors_are_pruned(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = (np.repeat(centres / np.linalg.norm(centres, axis=1)[:, None], 100, 0) + 0.02 * rng.normal(size=(4000, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, v array<float>")
    join = knn.plan(df, "vec_id", "v", 10, F.col("vec_id") % 20 == 0, pivots=40, query_block=10)
    assert join.rows == 4000 and join.groups.share(join.rows) < 0.3
    assert join.groups.replicated < 0.3 * join.rows * len(join.groups.salts)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    assert got(spark, rows, 10, 20, pivots=40, query_block=10, data_block=300) == want(rows, 10, 20)


def test_components_of_any_size(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(60)]
    # a component of 2^25 and more is the best neighbour of many
    rows += [(100, [float(2**26), 0.0, 0.0, 0.0]), (101, [-float(2**40), 1.0, 0.0, 0.0]), (102, [0.0, float(2**25), 0.0, 0.0])]
    expected = want(rows, 5, 4)
    assert got(spark, rows, 5, 4) == expected and {100, 101, 102} <= {r[2] for r in expected}
    with pytest.raises(Exception, match="64-bit"):
        got(spark, [(0, [1e30]), (1, [1e30]), (2, [0.0])], 2, 2)
    assert got(spark, [(0, [1e30, 0.0]), (1, [0.0, 1e30]), (2, [0.0, 0.0])], 2, 1) == {(0, 1, 1, 0), (0, 2, 2, 0), (1, 1, 0, 0), (1, 2, 2, 0), (2, 1, 0, 0), (2, 2, 1, 0)}


def test_cases(spark):
    rows = [(0, [1.0, 0.5]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [0.25]), (6, []), (7, [1.0, 0.5]), (8, [1.0, 0.5]), (None, [9.0, 9.0]), (10, [-0.01, 0.0])]
    assert got(spark, rows, 20, 10) == want(rows, 20, 10)
    assert got(spark, [*rows, (7, [1.0, 0.5])], 2, 10) == want(rows, 2, 10)
    assert got(spark, [], 3, 1) == set()
    assert got(spark, [(1, [1.0])], 3, 1) == set()
    assert got(spark, [(1, [1.0]), (3, [2.0])], 3, 2) == set()
    big = [(k, [float(2**20 + k), -float(2**20)]) for k in range(30)]
    assert got(spark, big, 3, 10) == want(big, 3, 10)
