"""Nearest neighbours and near-duplicates of embeddings, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonelake.llm import ann, itq
from tonelake.llm.queries import queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(x)]
    return spark.createDataFrame([*rows, *extra], SCHEMA).withColumns({c: F.lit("x") for c in ("id", "vec", "cell", "shard", "block", "node", "code", "a", "b", "root")})


ODD = [(9000, None, 1), (9001, [], 1), (9002, [1.0] * 3, 1), (9003, [float("nan")] * 16, 1), (9004, [float("inf")] + [0.0] * 15, 1), (9005, [None] * 16, 1)]


@pytest.mark.parametrize("kind", ["clustered", "uniform"])
def test_recall(spark, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    if kind == "clustered":
        x += rng.normal(size=(25, 16)).astype(np.float32)[rng.integers(0, 25, 1500)] * 4
    rows = ann.neighbours(frame(spark, x, ODD), shard_rows=300, query_rows=400).collect()
    d = ((x[:, None].astype(np.float64) - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    best = np.argsort(d, axis=1, kind="stable")[:, : ann.K]
    found = [[] for _ in x]
    for r in sorted(rows, key=lambda r: r.rank):
        found[r.vec_id].append(r.neighbour_id)
        assert r.distance == pytest.approx(d[r.vec_id, r.neighbour_id] ** 0.5, rel=1e-5)
    assert all(len(f) == ann.K and len(set(f)) == ann.K for f in found)
    assert np.mean([len(set(f) & set(b)) for f, b in zip(found, best.tolist(), strict=True)]) / ann.K >= 0.9


def test_traverse_is_in_order():
    rng = np.random.default_rng(3)
    a, b = rng.random(7), rng.random(9)
    got = ann.traverse(a, b, np.ones(63, int), 63)
    assert got == sorted(range(63), key=lambda c: a[c // 9] + b[c % 9])
    assert len(ann.traverse(a, b, np.zeros(63, int), 5)) == 0


def test_a_cell_larger_than_a_shard(spark):
    """All rows in one cell, cut over shards: with every entry visited the result is exact."""
    x = np.random.default_rng(5).normal(size=(400, 8)).astype(np.float32) * 1e-3
    rows = ann.neighbours(frame(spark, x), queries=lambda i: i % 20 == 0, centroids=1, share=1.0, shard_rows=50, query_rows=7, k=3).collect()
    d = ((x[:, None].astype(np.float64) - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(i, r + 1, int(n)) for i in range(0, 400, 20) for r, n in enumerate(np.argsort(d[i], kind="stable")[:3])}
    assert {(r.vec_id, r.rank, r.neighbour_id) for r in rows} == want


def test_op1_recall(spark):
    """The registered query: ids divisible by 20 against all rows, by brute force."""
    at = "/root/testdata/sf0.01"
    t = spark.read.parquet(f"{at}/embeddings.parquet").toPandas()
    x, ids = np.array(t["embedding"].tolist(), np.float64), t["vec_id"].to_numpy()
    found = {}
    for r in queries()["op1_inverted_multi_index"](spark, at).collect():
        found.setdefault(r.vec_id, set()).add(r.neighbour_id)
    asked = ids[ids % 20 == 0]
    assert set(found) == set(asked.tolist())
    hits = 0
    for i in asked:
        d = ((x - x[ids == i][0]) ** 2).sum(1)
        d[ids == i] = np.inf
        hits += len(found[i] & set(ids[np.argsort(d, kind="stable")[: ann.K]].tolist()))
    assert hits / (len(asked) * ann.K) >= 0.9


def test_neighbour_cases(spark):
    same = [[1.0] * 16, [1.0] * 16, [2.0] * 16]
    rows = ann.neighbours(frame(spark, same, [*ODD, (0, [1.0] * 16, 5)])).orderBy("vec_id", "rank").collect()
    assert [(r.vec_id, r.rank, r.neighbour_id, r.distance) for r in rows] == [(0, 1, 1, 0.0), (0, 2, 2, 4.0), (1, 1, 0, 0.0), (1, 2, 2, 4.0), (2, 1, 0, 4.0), (2, 2, 1, 4.0)]
    assert ann.neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ann.neighbours(spark.createDataFrame([(1, [1.0, 2.0], 0)], SCHEMA)).count() == 0


def test_neighbours_of_repeated_and_large_ids(spark):
    v = lambda x: [float(x)] * 16
    rows = spark.createDataFrame([(1, v(0)), (1, v(10)), (2, v(1)), (None, v(11)), (None, v(2.5)), (2**53, v(30)), (2**53 + 1, v(31))], "vec_id long, embedding array<float>")
    found = ann.neighbours(rows, k=1, share=1.0).collect()
    assert len(found) == 7  # every row is a query
    # the two rows of id 1 and of the null id keep their own neighbour
    assert sorted((r.vec_id if r.vec_id is not None else -1, r.neighbour_id if r.neighbour_id is not None else -1, r.distance) for r in found) == [
        (-1, 1, 4.0), (-1, 2, 6.0), (1, -1, 4.0), (1, 2, 4.0), (2, 1, 4.0), (2**53, 2**53 + 1, 4.0), (2**53 + 1, 2**53, 4.0),
    ]


def groups_of(x, threshold):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= threshold
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([root[near[i]].min() for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    return root


def test_itq_against_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 64))
    copies = np.concatenate([base[i : i + 1] + rng.normal(size=(1 + i % 4, 64)) * 0.08 for i in range(0, 120, 2)])
    x = np.concatenate([base, copies, base[:30] * 3]).astype(np.float32)
    rows = itq.near_duplicates(frame(spark, x, [*ODD, (9006, [0.0] * 64, 0)])).collect()
    root = groups_of(x.astype(np.float64), itq.THRESHOLD)
    want = {i: int(root[i]) for i in range(len(x)) if (root == root[i]).sum() > 1}
    got = {r.vec_id: r.group_id for r in rows}
    assert set(got) <= set(want) and sum(got.get(i) == g for i, g in want.items()) >= 0.97 * len(want)
    assert all(r.keep == (r.vec_id == r.group_id) for r in rows)


def test_itq_cases(spark):
    one = [1.0, 2.0, 3.0, 4.0]
    rows = itq.near_duplicates(frame(spark, [one, one, [-1.0, 0.0, 0.0, 1.0]], [(0, one, 3), (7, [2.0, 4.0, 6.0, 8.0], 0), (8, None, 0), (9, [0.0] * 4, 0)])).orderBy("vec_id").collect()
    assert [(r.vec_id, r.group_id, r.group_size, r.n_links, r.keep) for r in rows] == [(0, 0, 3, 0, True), (1, 0, 3, 0, False), (7, 0, 3, 0, False)]
    assert itq.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        itq.near_duplicates(spark.createDataFrame([], SCHEMA), bits=65)


def test_rotation_is_orthogonal_and_balanced(spark):
    from tonelake.llm.vectors import matrix, vector_table

    x = np.random.default_rng(4).normal(size=(800, 32)) * np.linspace(1, 3, 32)
    table, d = vector_table(frame(spark, x), "vec_id", "embedding", unit=True)
    mean, w = itq.learn(table, d, 32, 10, 3)
    assert np.allclose(w.T @ w, np.eye(32), atol=1e-8)
    on = (np.array([np.frombuffer(r.vec, "<f4") for r in table.collect()]) - mean) @ w > 0
    assert matrix is not None and np.abs(on.mean(0) - 0.5).max() < 0.12
