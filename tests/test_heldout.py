"""Held-out designs: allocations, draws against a plain loop, and errors of means and contrasts against matrices."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.operators import heldout as H


def _rows(n=400):
    return [(i, int(i % 40 == 0), (i * 37 % n) / n, [int(i % 3 == 0), int(i % 5 == 0)]) for i in range(n)]


@pytest.fixture(scope="module")
def strata(spark):
    df = spark.createDataFrame(_rows(), "row_id long, label int, p double, flags array<int>")
    return H.benign_strata(df, F.lit(0.9))


@pytest.mark.parametrize("budget", [7, 60, 389, 390])
def test_allocations_are_positive_and_whole(strata, budget):
    got = [tuple(r) for r in H.allocate(strata, budget).collect()]
    assert len(got) == 8
    for sampler in H.SAMPLERS:
        mine = [(pool, n) for s, _, pool, n in got if s == sampler]
        assert sum(n for _, n in mine) == budget and sum(p for p, _ in mine) == 390
        assert all(1 <= n <= pool for pool, n in mine)


@pytest.mark.parametrize("budget", [2, 391])
def test_a_budget_that_cannot_be_dealt_is_refused(strata, budget):
    with pytest.raises(ValueError):
        H.allocate(strata, budget)


def test_no_benign_rows_are_refused(spark):
    df = spark.createDataFrame([(1, 1, 0.5, [1])], "row_id long, label int, p double, flags array<int>")
    with pytest.raises(ValueError):
        H.allocate(H.benign_strata(df, F.lit(0.9)), 1)


@pytest.mark.parametrize("budget", [60, 390])
def test_draws_equal_a_plain_loop(strata, budget):
    design = H.allocate(strata, budget)
    got = {(r.draw, r.sampler, r.stratum, r.scorer): r.x for r in H.draw_counts(strata, design, "flags", 3, 5).collect()}
    members = {}
    for r in strata.collect():
        for s in r.strata:
            members.setdefault((s.sampler, s.stratum), []).append((r.row_id, r.flags))
    want = {}
    for d in design.collect():
        for draw in range(3):
            order = sorted(members[d.sampler, d.stratum], key=lambda m: hashlib.md5(f"{5 + 7919 * draw}|{m[0]}".encode()).hexdigest())
            for scorer in range(2):
                want[draw, d.sampler, d.stratum, scorer] = sum(flags[scorer] for _, flags in order[: d.n])
    assert got == want


def test_a_census_has_no_error_and_no_width(strata, spark):
    counts = H.draw_counts(strata, H.allocate(strata, 390), "flags", 2, 5)
    rows = _rows()
    known = [(k, sum(f[k] for _, y, _, f in rows if y), 10, sum(f[k] for _, y, _, f in rows if not y)) for k in range(2)]
    judged = H.evaluate_counts(counts, spark.createDataFrame(known, "scorer int, tp long, pos long, fp long"), 2)
    for r in H.summary(judged, ["sampler", "scorer", "metric"]).collect():
        assert r.bias == pytest.approx(0) and r.mean_width == pytest.approx(0) and r.coverage == 1


def _cells(spark):
    """Two strata of 20 and 50 rows, of which 8 and 10 are taken, and 5 illicit rows; cells a and b with three runs."""
    rng, rows = np.random.default_rng(3), []
    for i in range(23):
        stratum, pool, n, label = ("easy", 50, 10, 0) if i < 10 else ("hard", 20, 8, 0) if i < 18 else ("illicit", 5, 5, 1)
        for cell in "ab":
            rows += [(i, label, stratum, pool, n, cell, run, int(rng.random() < 0.4 + 0.3 * label)) for run in range(3)]
    return rows, spark.createDataFrame(rows, "row_id long, label int, stratum string, pool long, n long, cell string, run int, pred int")


def _by_matrices(rows, cell):
    """Points, gradients and the covariance of the false positives of a cell, with matrices of rows by runs."""
    mine = sorted(r for r in rows if r[5] == cell)
    ids = sorted({r[0] for r in mine})
    pred = np.array([[next(r[7] for r in mine if r[0] == i and r[6] == k) for k in range(3)] for i in ids], float)
    info = {r[0]: r for r in mine}
    label, stratum = np.array([info[i][1] for i in ids]), np.array([info[i][2] for i in ids])
    pool, n = np.array([info[i][3] for i in ids]), np.array([info[i][4] for i in ids])
    tp, fp = (pred * label[:, None]).sum(0), (pred * (1 - label[:, None]) * (pool / n)[:, None]).sum(0)
    gradient = {"precision": -tp / (tp + fp) ** 2, "f1": -2 * tp / (tp + 5 + fp) ** 2}
    gradient["lift"] = gradient["precision"] * 75 / 5
    return pred * (1 - label[:, None]), stratum, pool, n, gradient, {"precision": (tp / (tp + fp)).mean(), "f1": (2 * tp / (tp + 5 + fp)).mean()}


def _variance(values, stratum, pool, n):
    total = 0.0
    for s in ("easy", "hard"):
        at = stratum == s
        big, small = pool[at][0], n[at][0]
        total += big**2 * (1 - small / big) * np.var(values[at], ddof=1) / small
    return total


def test_errors_of_cells_and_contrasts(spark):
    rows, df = _cells(spark)
    both = {c: _by_matrices(rows, c) for c in "ab"}
    got = {(r.cell, r.metric): r for r in H.cell_uncertainty(df, "cell", "run").collect()}
    for c in "ab":
        benign, stratum, pool, n, gradient, mean = both[c]
        for m, g in gradient.items():
            assert got[c, m].se == pytest.approx(_variance((benign * g).mean(1), stratum, pool, n) ** 0.5)
        for m, v in mean.items():
            assert got[c, m].mean == pytest.approx(v) and got[c, m].low <= v <= got[c, m].high
        assert got[c, "recall"].se == 0
    gap = {r.metric: r for r in H.paired_contrast(df, "cell", "run", "a", "b").collect()}
    for m in ("precision", "f1", "lift"):
        (a, stratum, pool, n, ga, _), (b, _, _, _, gb, _) = both["a"], both["b"]
        assert gap[m].se == pytest.approx(_variance((a * ga[m] - b * gb[m]).mean(1), stratum, pool, n) ** 0.5)
        assert gap[m].low <= gap[m].difference <= gap[m].high


def test_equal_cells_have_no_error(spark):
    rows, _ = _cells(spark)
    same = [r for r in rows if r[5] == "a"]
    df = spark.createDataFrame(same + [(*r[:5], "b", *r[6:]) for r in same], "row_id long, label int, stratum string, pool long, n long, cell string, run int, pred int")
    for r in H.paired_contrast(df, "cell", "run", "a", "b").collect():
        assert r.difference == pytest.approx(0) and r.se == 0
