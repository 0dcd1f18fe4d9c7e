"""Searches for designs against a brute-force judge of every prefix."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.operators import designs as D
from strataweave.session import written

LIMITS = D.Limits(rows=6, spread=0.02, kl_typology=0.5, kl_difficulty=0.6, f1=0.12)
TAU = 0.8


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    return [(i, y := int(rng.random() < 0.15), round(rng.random() ** (0.4 if y else 1.5), 6), rng.choice([-1, 0, 1, 2]) if y else -1) for i in range(260)]


@pytest.fixture(scope="module")
def table(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, label int, p double, typology int").repartition(3)
    return written(D.judged(df, range(9), TAU, LIMITS), "judged-test")


def brute(rows, seeds):
    h = lambda s, i: int(hashlib.md5(f"{s}|{i}".encode()).hexdigest()[:12], 16)
    hard = lambda r: 1 - 2 * abs(r[2] - 0.5)
    ill, ben = [r for r in rows if r[1]], [r for r in rows if not r[1]]

    def third(part):
        a, b = np.quantile([hard(r) for r in part], [0.33, 0.67])
        return {r[0]: 1 if hard(r) < a else 2 if hard(r) < b else 3 for r in part}

    def shares(part):
        t, b = np.full(8, 1e-9), np.full(10, 1e-9)
        for r in part:
            if r[3] >= 0:
                t[r[3]] += 1
            b[min(int(hard(r) * 10), 9)] += 1
        return t / t.sum(), b / b.sum()

    f1 = lambda a, b: 2 * sum(r[2] >= TAU for r in a) / (sum(r[2] >= TAU for r in a) + sum(r[2] >= TAU for r in b) + len(a))
    of_ill, of_ben, whole, full = third(ill), third(ben), shares(ill), f1(ill, ben)
    sizes = [sum(t <= k for t in of_ben.values()) for k in (0, 1, 2, 3)]
    out = {}
    for s in seeds:
        strata, order = defaultdict(list), []
        for r in sorted(ill, key=lambda r: h(s, r[0])):
            strata[r[3] * 3 + of_ill[r[0]]].append(r)
        for part in strata.values():
            order += [(k, h(s, r[0]), r) for k, r in enumerate(part)]
        order = [r for _, _, r in sorted(order)]
        parts = {t: [r for r in sorted(ben, key=lambda r: h(s, r[0])) if of_ben[r[0]] == t] for t in (1, 2, 3)}
        for n in range(1, len(ill) + 1):
            n_ben = min(n * len(rows) // len(ill) - n, len(ben))
            taken = [r for t in (1, 2, 3) for r in parts[t][: n_ben * sizes[t] // len(ben) - n_ben * sizes[t - 1] // len(ben)]]
            some = order[:n]
            t, b = shares(some)
            kl = [float((x * np.log(x / y)).sum()) for x, y in zip((t, b), whole)]
            spread, types = float(np.std([hard(r) for r in some])), len({r[3] for r in some if r[3] >= 0})
            off = abs(f1(some, taken) - full)
            ok = n >= LIMITS.rows and spread >= LIMITS.spread and kl[0] <= LIMITS.kl_typology and kl[1] <= LIMITS.kl_difficulty and off <= LIMITS.f1 and types == len({r[3] for r in ill if r[3] >= 0})
            out[s, n] = (n + len(taken), f1(some, taken), off, *kl, spread, types, ok)
    return out


def test_every_size_of_every_seed(rows, table):
    want = brute(rows, range(9))
    got = {(r.seed, r.n_illicit): tuple(r)[2:] for r in table.collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][0] == w[0] and got[k][6:] == w[6:], k
        assert np.allclose(got[k][1:6], w[1:6], atol=1e-9), k
    assert 0 < sum(w[-1] for w in want.values()) < len(want)


def test_exhaustive_is_a_scan(rows, table):
    want = brute(rows, range(9))
    probe, scan, confirm = range(0, 2), range(2, 5), range(5, 9)
    n_ill = max(n for _, n in want)
    low, high, least, probes = 6, n_ill, 6, 0
    while high - low > max(2, int((n_ill - least) * 0.01)):
        m = max(low + 1, min(high - 1, math.isqrt(low * high)))
        low, high = (low, m) if any(want[s, m][-1] for s in probe) else (m, high)
        probes += 1
    first = next(n for n in range(max(least, low * 95 // 100), min(n_ill, high * 105 // 100 + 1) + 1) if any(want[s, n][-1] for s in scan))
    (r,) = D.exhaustive(table, probe, scan, confirm, 6).collect()
    assert (r.n_illicit, r.probes, r.p_feasible) == (first, probes, sum(want[s, first][-1] for s in confirm) / 4)
    assert want[r.seed, first][-1] and r.n_total == want[r.seed, first][0]


def test_constrained_finds_the_best_of_its_trials_and_comes_near_the_best_of_all(rows, table):
    want = brute(rows, range(9))
    got = D.constrained(table, 5, 60, range(9), 6).collect()
    assert len(got) == 300 and all(want[r.seed, r.n_illicit][-1] == r.feasible and want[r.seed, r.n_illicit][0] == r.n_total for r in got)
    (best,) = [r for r in got if r.best]
    assert best.n_total == min(r.n_total for r in got if r.feasible)
    assert best.n_total == min(w[0] for w in want.values() if w[-1])


def test_nothing_feasible_and_no_illicit_row(spark, rows):
    df = spark.createDataFrame(rows, "row_id long, label int, p double, typology int")
    none = written(D.judged(df, range(2), TAU, D.Limits(rows=6, spread=0.9)), "judged-test")
    assert D.exhaustive(none, [0], [1], [1], 6).count() == 0
    assert not any(r.best for r in D.constrained(none, 2, 5, range(2), 6).collect())
    empty = written(D.judged(df.where("label = 0"), range(2), TAU), "judged-test")
    assert empty.count() == 0 and D.exhaustive(empty, [0], [1], [1], 6).count() == 0 and D.constrained(empty, 2, 5, range(2), 6).count() == 0


def test_running_sums_by_given_cells(spark):
    """Cells of a hash give the same sums as cells by quantiles."""
    from strataweave.operators.ordered import running

    df = spark.range(3000).selectExpr("id % 3 AS g", "abs(xxhash64(id)) % 281474976710656 AS h", "id % 7 AS x")
    got = [sorted(map(tuple, running(df, "h", {"s": F.col("x")}, ["g"], cell=cell).collect())) for cell in (None, F.shiftright("h", 40))]
    assert got[0] == got[1] and len(got[0]) == 3000
