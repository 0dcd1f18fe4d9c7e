"""Long cycles against a search of all paths."""

import contextlib
import io
import random
from collections import Counter

from strataweave.operators import cycles
from strataweave.operators.cycles import long_cycles


def every_cycle(edges, length, seconds):
    out = Counter()

    def go(start, at, t0, t1, seen, hops):
        for a, b, t in edges:
            if a != at or a == b or t <= t1 or t - t0 > seconds:
                continue
            if b == start:
                out[start, hops + 1] += 1
            elif b not in seen and hops + 1 < length:
                go(start, b, t0, t, seen | {b}, hops + 1)

    for a, b, t in edges:
        if a != b:
            go(a, b, t, t, {a, b}, 1)
    return out


def test_long_cycles(spark):
    rng = random.Random(12)
    edges = [(rng.randint(0, 6), rng.randint(0, 6), rng.randint(-40, 160)) for _ in range(70)] + [(i, (i + 1) % 9, 500 + i) for i in range(9)] + [(0, 1, 500)]
    df = spark.createDataFrame(edges, "src long, dst long, epoch_s long").repartition(3)
    for length in (2, 5, 9, 10):
        want = every_cycle(edges, length, 60)
        assert {(r.start, r.hops): r.n for r in long_cycles(df, length, 60).collect()} == want
    assert want[0, 9] >= 2 and max(h for _, h in want) >= 9


def test_no_edges(spark):
    assert long_cycles(spark.createDataFrame([(1, 1, 1)], "src long, dst long, epoch_s long"), 4, 60).count() == 0


def test_paths_are_not_sent_whole(spark):
    """A small table stays out of the driver's memory too; each length is one table before they are united."""
    edges = [(i % 9, (i + 1) % 9, i) for i in range(40)]
    out = io.StringIO()
    def kept(df, what, write=cycles.written):
        with contextlib.redirect_stdout(out):
            df.explain()
        return write(df, what)

    cycles.written, former = kept, cycles.written
    try:
        found = cycles.long_cycles(spark.createDataFrame(edges, "src long, dst long, epoch_s long"), 4, 60)
        with contextlib.redirect_stdout(out):
            found.explain()
    finally:
        cycles.written = former
    assert "Broadcast" not in out.getvalue() and "Join" not in out.getvalue().split("== Physical Plan ==")[-1]
