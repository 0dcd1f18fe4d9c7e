"""Work that must not grow with a hub: what is shuffled, and the same rows as brute force."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from strataweave.operators import checks as C
from strataweave.operators import graph as G


def shuffled(spark) -> int:
    """Bytes that this session has written to shuffles."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


@pytest.fixture
def unsent(spark):
    """Tables count as too large to be sent whole to the tasks, as they are at size."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hops_from_a_hub_shuffle_what_they_keep(spark, unsent):
    hub, cases, cap = 3000, 300, 3
    edges = spark.range(1, hub + 1).selectExpr("id AS row_id", "0L AS src", "id AS dst")
    seeds = spark.range(1, cases + 1).selectExpr("id AS case_id", "explode(array(0L, id)) AS node")
    before = shuffled(spark)
    got = {}
    for r in G.k_hop(seeds, edges, 1, cap).collect():
        got.setdefault(r["case_id"], set()).add(r["node"])
    took = shuffled(spark) - before
    assert took < 2_000_000
    draw = lambda c, x: lambda y: hashlib.md5(f"42|{c}|{x}|{y}".encode()).hexdigest()
    assert got == {c: {0, c, *sorted(set(range(1, hub + 1)) - {c}, key=draw(c, 0))[:cap]} for c in range(1, cases + 1)}


def test_nodes_that_lack_hashes_below_the_bound_are_looked_through(spark):
    """The hub's first neighbours by hash are all seeds of the case, so that what lies below the bound does not suffice."""
    draw = lambda y: hashlib.md5(f"42|1|0|{y}".encode()).hexdigest()
    order = sorted(range(1, 401), key=draw)
    edges = spark.range(1, 401).selectExpr("id AS row_id", "0L AS src", "id AS dst")
    seeds = spark.createDataFrame([(1, 0)] + [(1, y) for y in order[:380]], "case_id long, node long")
    new = G.k_hop(seeds, edges, 1, 5).where("hop = 1")
    assert {r["node"] for r in new.collect()} == set(order[380:385])


def test_induced_tells_blocks_of_cases_apart(spark, unsent):
    """More cases than a block holds, parallel edges and loops; the edges of a hub that most cases share are shuffled once a block."""
    n = 150
    edges = spark.range(2000).selectExpr("id AS row_id", "id % 40 AS src", "id % 3 AS dst")
    nodes = spark.range(n).selectExpr("id * 7 - 20 AS case_id", f"explode(sequence(0L, 39L - id % 5)) AS node")
    before = shuffled(spark)
    got = G.induced(nodes, edges).groupBy("case_id").agg(F.count("*").alias("n"), F.sum("row_id").alias("s")).collect()
    took = shuffled(spark) - before
    rows = [(i, i % 40, i % 3) for i in range(2000)]
    want = {c * 7 - 20: (lambda held: (len(held), sum(held)))([i for i, a, b in rows if a <= 39 - c % 5 and b <= 39 - c % 5]) for c in range(n)}
    assert {r["case_id"]: (r["n"], r["s"]) for r in got} == want
    assert took < 600_000


def test_windows_of_a_busy_account_are_linear(spark):
    """One account with 60,000 rows in a day: windows that take in their rows one by one need minutes."""
    n = 60_000
    rows = spark.range(n).selectExpr("id AS row_id", "id % 50 AS src", "7L AS dst", "id AS epoch_s", "cast(id % 3 as double) AS amount")
    began = time.time()
    f = G.trailing(rows, "dst").agg(F.sum("degree"), F.max("degree"), F.max("fan")).first()
    m = {r["row_id"]: r for r in G.vertex_moments(rows, "dst").where(f"row_id in (0, 1, {n - 1})").collect()}
    assert time.time() - began < 40
    assert tuple(f) == (n * (n + 1) // 2, n, 50)
    assert (m[0]["skewness"], m[0]["kurtosis"], m[0]["sd_time_s"]) == (0, 0, 0) and abs(m[1]["kurtosis"] + 2) < 1e-9
    assert abs(m[n - 1]["skewness"]) < 1e-9 and abs(m[n - 1]["kurtosis"] + 1.5) < 1e-9 and abs(m[n - 1]["mean_age_s"] - (n - 1) / 2) < 1e-6


def test_parts_of_windows_meet_at_the_edges_of_cells(spark):
    times = [-86_402, -86_401, -86_400, -1, 0, 0, 1, 86_399, 86_400, 86_401, 172_801, 172_802]
    rows = [(i, i % 4, 1, t, float((i * 7) % 5 + 1)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "row_id long, src long, dst long, epoch_s long, amount double")
    day = lambda t: [r for r in rows if 0 <= t - r[3] <= 86_400]
    got = {r["row_id"]: (r["degree"], r["fan"]) for r in G.trailing(df, "dst").collect()}
    assert got == {r[0]: (len(day(r[3])), len({x[1] for x in day(r[3])})) for r in rows}
    for r in G.vertex_moments(df, "dst").collect():
        t = rows[r["row_id"]][3]
        a, n = [x[4] for x in day(t)], len(day(t))
        m = [sum((x - sum(a) / n) ** k for x in a) / n for k in (2, 3, 4)]
        assert abs(r["skewness"] - (m[1] / m[0] ** 1.5 if m[0] > 1e-18 else 0)) < 1e-9 and abs(r["kurtosis"] - (m[2] / m[0] ** 2 - 3 if m[0] > 1e-18 else 0)) < 1e-9
        assert abs(r["ratio"] - rows[r["row_id"]][4] / (sum(a) / n)) < 1e-12


def peak_since(spark, stages: set) -> int:
    """The largest memory, in MB, that a task of later stages took for groups and sorts."""
    store = spark.sparkContext._jsc.sc().statusStore()
    best = 0
    for stage in range(max(stages) + 1, max(seen_stages(spark)) + 1):
        tasks = store.taskList(stage, 0, 10_000)
        for i in range(tasks.size()):
            m = tasks.apply(i).taskMetrics()
            best = max(best, m.get().peakExecutionMemory() if m.isDefined() else 0)
    return best >> 20


def seen_stages(spark) -> set:
    tracker = spark.sparkContext.statusTracker()
    return {s for j in tracker.getJobIdsForGroup() for s in (tracker.getJobInfo(j).stageIds if tracker.getJobInfo(j) else [])} | {0}


def test_predictions_are_grouped_in_parts_of_bounded_size(spark):
    """Three million predictions of different cases in one partition."""
    n = 500_000
    cases = spark.range(0, n, 1, 1).selectExpr("concat('e_', id) AS case_id")
    found = cases.selectExpr("explode(array('a', 'b', 'c', 'd', 'e', 'f')) AS model", "0 AS run", "case_id", "1 AS verdict")
    before = seen_stages(spark)
    got = C.prediction_report(cases, found, ["model", "run"]).collect()
    assert {tuple(r[c] for c in ("unknown", "repeated", "no_verdict", "accepted", "missing")) for r in got} == {(0, 0, 0, n, 0)} and len(got) == 6
    assert peak_since(spark, before) < 250
