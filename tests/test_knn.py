"""The graph of nearest neighbours against all pairs."""

import numpy as np
import pytest

from strataweave.operators.knn import knn_graph, nearest


def all_pairs(ids, v, k):
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    out = {}
    for i, a in enumerate(ids):
        out[a] = sorted(((-s[i, j], b) for j, b in enumerate(ids) if b != a))[:k]
    return out


@pytest.mark.parametrize("spread", [0.05, 3.0])
def test_equal_to_all_pairs(spark, spread):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(12, 6))[rng.integers(0, 12, 400)] + spread * rng.normal(size=(400, 6))
    v[:150] = v[0] + 0.01 * rng.normal(size=(150, 6))  # a hot cell
    ids = [int(x) for x in rng.permutation(1000)[:400]]
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in zip(ids, v)], "vec_id long, embedding array<double>").repartition(5)
    want = all_pairs(ids, v, 5)
    got = {}
    for r in nearest(df, 5, pivots=20, block=16).collect():
        got.setdefault(r.vec_id, []).append((r.rank, r.neighbour, r.similarity))
    assert set(got) == set(ids)
    for a, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == [1, 2, 3, 4, 5] and len({r[1] for r in rows}) == 5
        assert np.allclose([-r[2] for r in rows], [s for s, _ in want[a]], atol=1e-8)
    graph = knn_graph(df, 5, pivots=20, block=16).collect()
    assert sum(r.times for r in graph) == 2 * 5 * 400
    assert {(r.dst, r.src) for r in graph} == {(r.src, r.dst) for r in graph}


def test_ties_and_vectors_without_direction(spark):
    rows = [(i, [1.0, 0.0]) for i in range(6)] + [(6, [0.0, 0.0]), (7, None), (8, []), (9, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, 2, pivots=3, block=2).orderBy("vec_id", "rank").collect():
        got.setdefault(r.vec_id, []).append(r.neighbour)
    assert got == {0: [1, 2], 1: [0, 2], 2: [0, 1], 3: [0, 1], 4: [0, 1], 5: [0, 1], 9: [0, 1]}
    assert nearest(df.where("vec_id = 7"), 2).count() == 0
    assert nearest(df.where("vec_id = 9"), 2).count() == 0


def test_blocks_are_sent_once_for_a_tile(spark):
    """128 blocks without clusters: pairs of blocks would move about 16,000 blocks of 2 KB twice."""
    from test_scale import shuffled

    v = np.random.default_rng(5).normal(size=(2048, 16))
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = {(r.vec_id, r.rank): r.neighbour for r in nearest(df, 3, pivots=8, block=16).collect()}
        assert shuffled(spark) - before < 25_000_000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = all_pairs(list(range(2048)), v, 3)
    assert got == {(a, i + 1): b for a, best in want.items() for i, (_, b) in enumerate(best)}


def test_pairs_below_a_bound_are_neither_rounded_nor_sorted():
    """The same k best as from all pairs, for a small part of their cost."""
    import time

    from strataweave.operators.knn import _above, _best, _first

    rng = np.random.default_rng(7)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in rng.normal(size=(2, 1500, 8)))
    b[:40] = b[40]  # ties
    ids = rng.permutation(5000)[:1500]
    began = time.process_time()
    row, n, s = _best(-1 - np.arange(1500), a, ids, b, 5)
    long = time.process_time() - began
    began = time.process_time()
    x, y, sims = _above(a, b, s.reshape(-1, 5)[:, -1])
    got = _first(x, ids[y], sims, 5)
    assert all(np.array_equal(p, q) for p, q in zip(got, (row, n, s)))
    assert time.process_time() - began < long / 3
    assert [len(c) for c in _first(*(c[:0] for c in got), 5)] == [0, 0, 0]
