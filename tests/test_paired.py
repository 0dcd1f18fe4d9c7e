"""Exact signed ranks, the paired bootstrap and the envelope of metrics, against enumeration and plain loops."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataweave.operators import statistics as A


def signs_by_enumeration(diffs):
    a = [abs(round(d, 12)) for d in diffs]
    rank = [sum(y < x for y in a) + (sum(y == x for y in a) + 1) / 2 for x in a]
    zeros = sum(r / 2 for r, x in zip(rank, a) if x == 0)
    w = zeros + sum(r for r, d in zip(rank, diffs) if d > 0 and round(d, 12))
    live = [r for r, x in zip(rank, a) if x]
    if not live:
        return w, None, None
    sums = [zeros + sum(r for r, s in zip(live, way) if s) for way in itertools.product((0, 1), repeat=len(live))]
    up, down = np.mean([x >= w for x in sums]), np.mean([x <= w for x in sums])
    return w, up, min(1, 2 * min(up, down))


def test_exact_signed_ranks(spark):
    rng = random.Random(6)
    groups = [[rng.choice([-3, -2, -1, -0.5, 0, 0.5, 1, 2, 2, 4]) for _ in range(n)] for n in range(1, 16)]
    groups += [[rng.random() - 0.4 for _ in range(12)], [0.0] * 5, [1.0] * 9, [-2.0] * 4]
    rows = [(g, float(d)) for g, part in enumerate(groups) for d in part] + [(0, None)]
    df = spark.createDataFrame(rows, "g int, d double").repartition(4)
    got = {r.g: r for r in A.wilcoxon_exact(df, ["g"], "d").collect()}
    for g, part in enumerate(groups):
        w, up, both = signs_by_enumeration(part)
        assert (got[g].n, got[g].w_plus, got[g].exact) == (len(part), w, True)
        assert (got[g].p_greater is None) == (up is None)
        if up is not None:
            assert math.isclose(got[g].p_greater, up, abs_tol=1e-12) and math.isclose(got[g].p_two_sided, both, abs_tol=1e-12)


def test_large_groups_are_normal(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(rng.gauss(0.3, 1),) for _ in range(60)], "d double")
    (exact,), (normal,) = A.wilcoxon_exact(df, [], "d", most=60).collect(), A.wilcoxon_exact(df, [], "d", most=50).collect()
    assert exact.exact and not normal.exact and abs(exact.p_greater - normal.p_greater) < 0.01 and abs(exact.p_two_sided - normal.p_two_sided) < 0.01
    assert A.wilcoxon_exact(df.limit(0), ["d"], "d").count() == 0


def plain_weight(row, b):
    mask = (1 << 64) - 1
    x = (row * 0x9E3779B97F4A7C15 + b * 0xD6E8FEB86659FD93) & mask
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = ((x ^ (x >> 30)) * factor) & mask
    u, k, total = (x ^ (x >> 31)) >> 32, 0, math.exp(-1)
    while k < 13 and u >= int(total * 2**32):
        k += 1
        total += math.exp(-1) / math.factorial(k)
    return k


def test_bootstrap_is_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(0.2, 1)) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, d double")
    keys = {r.id: r.h & ((1 << 64) - 1) for r in df.select("id", F.xxhash64(F.lit(5), "id").alias("h")).collect()}
    means = []
    for b in range(1, 201):
        w = [plain_weight(keys[i], b) for i, d in rows if d is not None]
        means.append(sum(x * d for x, (_, d) in zip(w, rows)) / sum(w))
    for parts in (1, 7):
        (r,) = A.paired_bootstrap(df.repartition(parts), "d", "id", resamples=200, seed=5).collect()
        assert r.n == 40 and math.isclose(r.mean, np.mean([d for _, d in rows[:40]]))
        assert np.allclose((r.low, r.high), np.quantile(means, [0.025, 0.975]), atol=1e-12)


def test_bootstrap_of_many_pairs_and_of_equal_ones(spark):
    df = spark.range(2000).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0).alias("d"))
    (r,) = A.paired_bootstrap(df, "d", "id").collect()
    half = 1.96 * math.sqrt(1 / 12 / 2000)
    assert abs(r.high - r.low - 2 * half) < 0.1 * half and r.low < r.mean < r.high
    (same,) = A.paired_bootstrap(df.limit(9).withColumn("d", F.lit(0.25)), "d", "id", resamples=20).collect()
    assert (same.n, same.low, same.high) == (9, 0.25, 0.25)
    (none,) = A.paired_bootstrap(df.limit(0), "d", "id", resamples=20).collect()
    assert (none.n, none.low, none.high) == (0, None, None)


@pytest.mark.parametrize("seed", range(6))
def test_tails_equal_sums(seed):
    rng = random.Random(seed)
    for _ in range(60):
        pool = rng.randint(1, 40)
        marked, n = rng.randint(0, pool), rng.randint(0, pool)
        x = rng.randint(0, n)
        p = lambda i: math.comb(marked, i) * math.comb(pool - marked, n - i) / math.comb(pool, n)  # noqa: E731, B023
        assert math.isclose(A.tail(pool, marked, n, x, True), sum(p(i) for i in range(x, n + 1)), abs_tol=1e-12)
        assert math.isclose(A.tail(pool, marked, n, x, False), sum(p(i) for i in range(x + 1)), abs_tol=1e-12)
    assert math.isclose(A.tail(10_000_000, 5_000_000, 1_000_000, 500_000, True) + A.tail(10_000_000, 5_000_000, 1_000_000, 499_999, False), 1.0, rel_tol=1e-6)


def test_envelope_holds_every_corner(spark):
    boxes = [(2, 5), (0, 3), (4, 4)]
    tp, pos, total = 6, 10, 90
    df = spark.createDataFrame([(lo, hi, tp, pos, total) for lo, hi in boxes], "low long, high long, tp long, pos long, total long")
    (r,) = A.metric_envelope(df, []).collect()
    grid = [sum(x) for x in itertools.product(*[range(lo, hi + 1) for lo, hi in boxes])]
    assert (r.fp_low, r.fp_high) == (min(grid), max(grid))
    for name, f in (("precision", lambda fp: tp / (tp + fp)), ("f1", lambda fp: 2 * tp / (tp + pos + fp)), ("lift", lambda fp: tp / (tp + fp) * total / pos)):
        values = [f(fp) for fp in grid]
        assert math.isclose(r[f"{name}_low"], min(values)) and math.isclose(r[f"{name}_high"], max(values))
