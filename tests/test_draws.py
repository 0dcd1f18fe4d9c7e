"""Dictionaries, k-means cuts and walks against plain loops."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.operators import draws as D
from strataweave.operators.dictionary import dictionary, with_node_ids


def spread(values, counts, starts):
    total = 0.0
    for a, b in zip(starts, [*starts[1:], len(values)]):
        n, x = np.array(counts[a:b], float), np.array(values[a:b], float)
        total += (n * (x - (n * x).sum() / n.sum()) ** 2).sum()
    return total


def test_cuts_are_the_best_of_all():
    rng = random.Random(3)
    for _ in range(40):
        m = rng.randint(1, 9)
        values, counts, k = sorted(rng.sample(range(60), m)), [rng.randint(1, 9) for _ in range(m)], rng.randint(1, 4)
        got = [values.index(v) for v in D.best_cuts(np.array(values), np.array(counts), k)]
        assert len(got) == min(k, m) and got[0] == 0
        best = min(spread(values, counts, [0, *c]) for c in itertools.combinations(range(1, m), min(k, m) - 1))
        assert abs(spread(values, counts, got) - best) < 1e-6


def test_cuts_of_200_values_equal_all_pairs_of_cuts():
    rng = random.Random(4)
    values = sorted(rng.sample(range(512), 200))
    got = [values.index(v) for v in D.best_cuts(np.array(values), np.ones(200, int), 3)]
    x = np.concatenate([[0], np.cumsum(np.array(values, float))])
    y = np.concatenate([[0], np.cumsum(np.array(values, float) ** 2)])
    cost = lambda a, b: y[b] - y[a] - (x[b] - x[a]) ** 2 / (b - a)
    best = min((cost(0, i) + cost(i, j) + cost(j, 200), i, j) for i in range(1, 199) for j in range(i + 1, 200))
    assert abs(cost(0, got[1]) + cost(got[1], got[2]) + cost(got[2], 200) - best[0]) < 1e-6


def test_strata_without_scores_and_with_few_values(spark):
    df = spark.createDataFrame([(1, 0.1), (2, None), (3, 0.1), (4, 0.9), (5, 1.0), (6, 7.0), (7, -1.0)], "row_id long, p double")
    got = {r.row_id: r.stratum for r in D.score_strata(df, 10).collect()}
    assert got == {1: 2, 2: None, 3: 2, 4: 3, 5: 4, 6: 4, 7: 1}
    assert [r.stratum for r in D.score_strata(df.where("p is null"), 10).collect()] == [None]


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_dictionary_of_strings(spark, parts):
    rng = random.Random(5)
    words = ["", "a", "a_1", "A", "é", "z" * 40, "0_10", "0_9"] + [f"{rng.randint(0, 9)}_{rng.randint(0, 10**6)}" for _ in range(500)]
    rows = [(w,) for w in words] + [("hot",)] * 1000 + [(None,)]
    got = {r.v: r.idx for r in dictionary(spark.createDataFrame(rows, "v string").repartition(5), "v", parts).collect()}
    want = sorted({w for w, in rows if w is not None}, key=str.encode)
    assert got == {w: i for i, w in enumerate(want)}
    assert dictionary(spark.createDataFrame([], "v string"), "v", parts).count() == 0


def test_edges_keep_rows_whose_end_is_null(spark):
    edges, nodes = with_node_ids(spark.createDataFrame([(1, "b", "a"), (2, "a", None), (3, "a", "a"), (3, "a", "a")], "row_id int, src string, dst string"))
    assert sorted((r.row_id, r.src_idx, r.dst_idx) for r in edges.collect() if r.dst) == [(1, 1, 0), (3, 0, 0), (3, 0, 0)]
    assert [(r.src_idx, r.dst_idx) for r in edges.where("row_id = 2").collect()] == [(0, None)]
    assert sorted((r.node, r.idx) for r in nodes.collect()) == [("a", 0), ("b", 1)]


def number(what, step, walker):
    return int(hashlib.md5(f"9|{what}|{step}|{walker}".encode()).hexdigest()[:12], 16)


def plain_walk(edges, n, walkers, limit, patience=100):
    near = {}
    for r, a, b in sorted(edges):
        near.setdefault(a, []).append((r, b))
        if a != b:
            near.setdefault(b, []).append((r, a))
    nodes = sorted(near)
    at = [nodes[number("jump", 0, w) % len(nodes)] for w in range(walkers)]
    seen, idle = {}, 0
    for step in range(1, limit + 1):
        before = len(seen)
        for w in range(walkers):
            if number("home", step, w) % (1 << 30) < int(0.15 * (1 << 30)):
                at[w] = nodes[number("jump", step, w) % len(nodes)]
                continue
            r, at[w] = near[at[w]][number("move", step, w) % len(near[at[w]])]
            if len(seen) < n:
                seen.setdefault(r, (step, w))
        idle = 0 if len(seen) > before else idle + 1
        if len(seen) >= n or idle >= patience:
            break
    return seen


def test_walk_equals_a_plain_loop_on_any_partitioning(spark):
    rng = random.Random(8)
    edges = [(i, rng.randint(0, 30), 0 if rng.random() < 0.4 else rng.randint(0, 30)) for i in range(120)]
    want = plain_walk(edges, 40, 10, 400)
    assert len(want) == 40
    for parts in (1, 6):
        df = spark.createDataFrame(edges, "row_id long, src long, dst long").repartition(parts)
        got = {r.row_id: (r.step, r.walker) for r in D.walk_sample(df, 40, 9, 10).collect()}
        assert got == want


def test_walk_is_topped_up(spark):
    df = spark.createDataFrame([(i, 2 * i, 2 * i + 1) for i in range(12)], "row_id long, src long, dst long")
    want = plain_walk([(i, 2 * i, 2 * i + 1) for i in range(12)], 9, 3, 2)
    seen = D.first_visits(D.walk(D.incidences(df), dictionary(df.select(F.explode(F.array("src", "dst")).alias("node")), "node"), 3, 9, lambda s: D._number(9, "home", s) % D.UNIT < int(0.15 * D.UNIT)), "row_id", 9, 2)
    got = D._topped_up(df, "row_id", seen, 9, 9).collect()
    assert {r.row_id: (r.step, r.walker) for r in got if r.step} == want
    rest = sorted((i for i in range(12) if i not in want), key=lambda i: hashlib.md5(f"9|top|{i}".encode()).hexdigest())
    assert sorted(r.row_id for r in got if r.step is None) == sorted(rest[: 9 - len(want)])


def test_walk_over_no_edges(spark):
    assert D.walk_sample(spark.createDataFrame([], "row_id long, src long, dst long"), 5, 1).count() == 0


def test_node_walk_without_illicit_nodes(spark):
    nodes = spark.createDataFrame([(i, 0) for i in range(9)], "node long, label int")
    links = spark.createDataFrame([(0, 1, 2)], "row_id long, src long, dst long")
    got = D.node_walk_sample(nodes, links, 4, 1).collect()
    assert len(got) == 4 and {r.weight for r in got} == {9 / 4} and {r.step for r in got} == {None}


def test_hubs_are_numbered_by_cells_and_ends_may_be_null(spark, monkeypatch):
    monkeypatch.setattr(D, "HUB", 5)
    rng = random.Random(9)
    edges = [(i, rng.randint(0, 30), 0 if rng.random() < 0.4 else rng.randint(0, 30)) for i in range(120)]
    got = {r.row_id: (r.step, r.walker) for r in D.walk_sample(spark.createDataFrame(edges, "row_id long, src long, dst long"), 40, 9, 10).collect()}
    assert got == plain_walk(edges, 40, 10, 400)
    lame = spark.createDataFrame([(0, 1, None), (1, 1, 2)], "row_id long, src long, dst long")
    assert {r.row_id for r in D.walk_sample(lame, 2, 9, 4).collect()} == {0, 1}


def rows_read(spark, since: int) -> tuple[int, int]:
    """(rows that the tasks of later stages have read from tables, the last stage)."""
    store, tracker = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext.statusTracker()
    last, total = max((s for j in tracker.getJobIdsForGroup() for s in tracker.getJobInfo(j).stageIds), default=0), 0
    for stage in range(since + 1, last + 1):
        tasks = store.taskList(stage, 0, 10_000)
        for m in (tasks.apply(i).taskMetrics() for i in range(tasks.size())):
            total += m.get().inputMetrics().recordsRead() if m.isDefined() else 0
    return total, last


def test_steps_read_the_rows_near_their_walkers(spark):
    """Three walkers on a path of 400,000 edges: ten steps together read fewer rows than the table holds."""
    n = 400_000
    edges = spark.range(n).selectExpr("id AS row_id", "id AS src", "id + 1 AS dst")
    near = D.written(D.incidences(edges, loops=2), "near")
    assert tuple(near.agg(F.count("*"), F.sum("degree"), F.sum("i")).first()) == (2 * n, 4 * n - 2, n - 1)
    targets = spark.createDataFrame([(0, 5), (1, n // 2)], "idx long, node long")
    before = rows_read(spark, 0)[1]
    last = list(itertools.islice(D.walk(near, targets, 3, 9, lambda s: F.lit(False)), 10))[-1].collect()
    assert len(last) == 3 and all(min(abs(r.node - 5), abs(r.node - n // 2)) <= 10 and (r.node - min((5, n // 2), key=lambda x: abs(x - r.node))) % 2 == 0 for r in last)
    assert rows_read(spark, before)[0] < 2 * n
