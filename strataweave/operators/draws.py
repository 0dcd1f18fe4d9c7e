"""Drawn samples of the comparison designs: strata of scores by exact k-means, walks, attributes, and samples of nodes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataweave.functions.identifiers import draw
from strataweave.operators import sampling as S
from strataweave.operators.dictionary import dictionary
from strataweave.operators.ordered import running
from strataweave.session import written

#: Numbers drawn from a hash have 48 bits; shares are compared in 2^30 steps.
UNIT = 1 << 30


# ---------------------------------------------------------------- strata of scores


def best_cuts(values: np.ndarray, counts: np.ndarray, k: int) -> list[int]:
    """The first value of each of k clusters of weighted ascending integers with the least sum of squared distances; of equal ones, the cut furthest to the left.

    Dynamic programming over the places: exact, k times the square of the number of values.
    """
    n, x = counts.astype(np.int64), values.astype(np.int64)
    sums = [np.concatenate([[0], np.cumsum(n * x**e)]) for e in (0, 1, 2)]
    m = len(x)
    s0, s1, s2 = ((s[None, 1:] - s[:-1, None]).astype(np.float64) for s in sums)  # [i, j]: values i to j
    late = np.tril(np.ones((m, m), bool), -1)
    cost = np.where(late, np.inf, s2 - s1 * s1 / np.where(late, 1.0, s0))
    best, starts = cost[0].copy(), []
    for _ in range(1, min(k, m)):
        whole = np.concatenate([[np.inf], best[:-1]])[:, None] + cost
        starts.append(whole.argmin(axis=0))
        best = whole.min(axis=0)
    out, j = [], m - 1
    for s in reversed(starts):
        out.append(int(s[j]))
        j = int(s[j]) - 1
    return [int(x[i]) for i in [0, *reversed(out)]]


def score_strata(df: DataFrame, k: int = 10, value: str = "p", bins: int = 512) -> DataFrame:
    """Adds stratum, 1 to k: exact one-dimensional k-means of a score from 0 to 1 over a histogram.

    The histogram has ``bins`` rows at most, whatever the table holds; it alone comes to the driver. A row without a score
    has no stratum. Fewer distinct bins than k make as many strata as there are bins.
    """
    place = F.greatest(F.lit(0), F.least(F.floor(F.col(value) * bins), F.lit(bins - 1))).cast("int")
    place = F.when(F.col(value).isNotNull(), place)
    got = sorted((r["b"], r["n"]) for r in df.where(F.col(value).isNotNull()).groupBy(place.alias("b")).agg(F.count("*").alias("n")).collect())
    if not got:
        return df.withColumn("stratum", F.lit(None).cast("int"))
    cuts = best_cuts(np.array([b for b, _ in got]), np.array([n for _, n in got]), k)
    return df.withColumn("stratum", reduce(lambda a, b: a + b, [(place >= c).cast("int") for c in cuts]))


def neyman_sizes(df: DataFrame, n: int, right: Column) -> DataFrame:
    """(stratum, pool, s, take): n shared by pool times the deviation of being right; the largest stratum takes what rounding leaves. One row for each stratum."""
    g = df.where("stratum is not null").groupBy("stratum").agg(F.count("*").alias("pool"), F.count_if(right).alias("_right"))
    q = F.col("_right") / F.col("pool")
    g = g.withColumn("s", F.greatest(F.sqrt(q * (1 - q)), F.lit(1e-8)))
    whole = Window.partitionBy()
    first = F.greatest(F.lit(1), F.rint(n * F.col("pool") * F.col("s") / F.sum(F.col("pool") * F.col("s")).over(whole))).cast("bigint")
    g = g.withColumn("_n", first).withColumn("_all", F.sum("_n").over(whole)).withColumn("_place", F.row_number().over(Window.orderBy(F.desc("pool"), "stratum")))
    take = F.when(F.col("_place") == 1, F.greatest(F.lit(1), F.col("_n") + n - F.col("_all"))).otherwise(F.col("_n"))
    return g.select("stratum", "pool", "s", F.least("pool", take).cast("bigint").alias("take"))


def drawn(df: DataFrame, by: str, sizes: DataFrame, seed: int | str, key: str = "row_id") -> DataFrame:
    """The first ``take`` rows of each stratum by hash, with pool, take and weight; ``sizes`` has pool and take and may bring its own weight."""
    if "weight" not in sizes.columns:
        sizes = sizes.withColumn("weight", F.col("pool") / F.col("take"))
    sizes = written(sizes.select(by, "pool", "take", "weight").where("take > 0"), "sizes")
    taken = S.first_ranked(df.withColumn("_draw", draw(seed, F.col(key))), [by], "_draw", sizes).drop("_draw")
    return taken.join(sizes, by)


def neyman_sample(df: DataFrame, n: int, seed: int | str, k: int = 10) -> DataFrame:
    """Rows of k-means strata of ``p`` with Neyman sizes, and the weights pool / take. Nothing keeps the rare class."""
    strata = written(score_strata(df, k), "strata")
    right = (F.col("p") >= 0.5) == (F.col("label") == 1)
    return drawn(strata, "stratum", neyman_sizes(strata, n, right), seed)


def attribute_sample(df: DataFrame, by: str, n: int, seed: int | str) -> DataFrame:
    """Rows of the strata of an attribute in proportion to their pools, largest first; the last one takes what is left."""
    pools = df.groupBy(by).agg(F.count("*").alias("pool"))
    return drawn(df, by, S.proportional(pools, "pool", n, [F.desc("pool"), F.col(by)]), seed)


# ---------------------------------------------------------------- walks


def _number(seed: int | str, what: str, step: int) -> Column:
    text = F.concat(F.lit(f"{seed}|{what}|{step}|"), F.col("walker").cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")


#: Edges of a node up to which one task numbers them; walkers up to which the rows at their nodes are looked up by name.
HUB, CROWD = 100_000, 256


def incidences(edges: DataFrame, loops: int = 1) -> DataFrame:
    """(node, i, degree, row_id, other): the edges at each node, numbered from 0 in the order of their ids; a loop counts once or twice.

    The edges of a hub are numbered by cells of the order, so that no task needs a whole one. The table is written in the
    order of the nodes, so that a reader of some nodes finds their rows without the others.
    """
    there = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "row_id", F.lit(0).alias("_side"))
    back = edges if loops == 2 else edges.where("src != dst")
    ends = there.unionByName(back.select(F.col("dst").alias("node"), F.col("src").alias("other"), "row_id", F.lit(1).alias("_side")))
    ends = written(ends.where("node is not null").withColumn("_order", F.col("row_id") * 2 + F.col("_side")), "ends")
    hubs = written(ends.groupBy("node").agg(F.count("*").alias("degree")).where(F.col("degree") > HUB), "hubs")  # a row for each HUB edge ends at most
    at = Window.partitionBy("node")
    few = ends.join(F.broadcast(hubs), "node", "left_anti").repartitionByRange("node")
    near = few.select("node", (F.row_number().over(at.orderBy("_order")) - 1).cast("bigint").alias("i"), F.count("*").over(at).alias("degree"), "row_id", "other")
    if hubs.limit(1).count():
        large = running(ends.join(F.broadcast(hubs.select("node")), "node", "left_semi"), "_order", {"i": F.lit(1)}, ["node"], inclusive=False)
        large = large.join(F.broadcast(hubs), "node").select("node", F.col("i").cast("bigint").alias("i"), "degree", "row_id", "other")
        near = near.unionByName(large.repartitionByRange("node", "i").sortWithinPartitions("node", "i"))
    return written(near, "incidences")


def _rows_at(near: DataFrame, nodes: list) -> DataFrame:
    """The rows of ``near`` at some nodes: single comparisons, as these let a reader of Parquet leave out what cannot hold them."""
    tests = [F.col("node") == n for n in sorted(nodes)]
    while len(tests) > 1:
        tests = [reduce(lambda a, b: a | b, tests[k : k + 2]) for k in range(0, len(tests), 2)]
    return near.where(tests[0] if tests else F.lit(False))


def walk(near: DataFrame, targets: DataFrame, walkers: int, seed: int | str, away: Callable[[int], Column]) -> Iterator[DataFrame]:
    """Yields, step by step from 1, (walker, node, row_id): where each walker is and by which edge, null after a jump.

    ``near`` holds incidences and ``targets`` (idx, node) the nodes to start from and to jump to, where ``away(step)`` is
    true or a node has no edges. A step sends the walkers to the edges; of these it reads, for up to CROWD walkers, only what
    may lie at their nodes. Each step is written before the next one.
    """
    aims = written(targets, "targets")
    count = aims.count()
    if not count:
        return
    aim = lambda s: (_number(seed, "jump", s) % count).alias("idx")
    crowd = near.sparkSession.range(walkers).select(F.col("id").alias("walker"))
    jump = lambda who, s: aims.join(F.broadcast(who.select("walker", aim(s))), "idx").select("walker", "node", F.lit(None).cast("bigint").alias("row_id"))
    here = written(jump(crowd, 0), "walk")  # the walkers are a parameter
    step = 0
    while True:
        step += 1
        moving = here.where(~away(step)).select("walker", "node", _number(seed, "move", step).alias("_move"))
        edges = near if walkers > CROWD else _rows_at(near, [r["node"] for r in here.where("node is not null").select("node").distinct().collect()])
        moved = edges.join(F.broadcast(moving), "node").where(F.col("i") == F.col("_move") % F.col("degree"))
        moved = written(moved.select("walker", F.col("other").alias("node"), "row_id"), "moved")
        jumped = jump(here.select("walker").join(F.broadcast(moved.select("walker")), "walker", "left_anti"), step)
        here = written(moved.unionByName(jumped), "walk")
        yield here


def first_visits(steps: Iterator[DataFrame], item: str, n: int, limit: int, patience: int = 100) -> DataFrame | None:
    """(item, step, walker): the first n distinct items in the order of (step, walker); null items don't count.

    Fewer where ``limit`` steps bring fewer, or where ``patience`` steps in a row bring none, as in a component that is used up.

    Steps come one at a time until n are reached, and only the items of the last one are ranked, by cells.
    """
    seen, count, idle = None, 0, 0
    for step, here in enumerate(steps, 1):
        now = here.where(F.col(item).isNotNull()).groupBy(item).agg(F.min("walker").alias("walker")).select(item, F.lit(step).alias("step"), "walker")
        now = written(now if seen is None else now.join(seen.select(item), item, "left_anti"), "visits")
        fresh = now.count()
        if count + fresh > n:
            now = running(now, "walker", {"_place": F.lit(1)}).where(F.col("_place") <= n - count).drop("_place")
        seen = now if seen is None else seen.unionByName(now)
        count, idle = count + fresh, 0 if fresh else idle + 1
        if count >= n or step >= limit or idle >= patience:
            break
    return seen


def _topped_up(all_items: DataFrame, key: str, seen: DataFrame | None, n: int, seed: int | str) -> DataFrame:
    """The visited items and, up to n, others by hash; step and walker are null for those."""
    if seen is None:
        rest, have, out = all_items.select(key), 0, None
    else:
        out = written(seen, "visited")
        rest, have = all_items.select(key).join(out.select(key), key, "left_anti"), out.count()
    if have >= n:
        return out
    want = all_items.sparkSession.range(1).select(F.lit(n - have).cast("bigint").alias("take"))
    more = S.first_ranked(rest.withColumn("_draw", draw(f"{seed}|top", F.col(key))), [], "_draw", want).select(key, F.lit(None).cast("int").alias("step"), F.lit(None).cast("bigint").alias("walker"))
    return more if out is None else out.unionByName(more)


def walk_sample(edges: DataFrame, n: int, seed: int | str, walkers: int | None = None, teleport: float = 0.15) -> DataFrame:
    """(row_id, step, walker): n edges by walks on the undirected multigraph, in the order of first visits, topped up uniformly.

    Each step goes over a uniform edge of the node, or, with the probability of ``teleport``, to a uniform node. All walkers
    (a quarter of n by default) go at once and make at most 100 n steps together.
    """
    walkers = walkers or max(1, n // 4)
    near = incidences(edges)
    away = lambda s: _number(seed, "home", s) % UNIT < int(teleport * UNIT)
    seen = first_visits(walk(near, dictionary(near, "node"), walkers, seed, away), "row_id", n, math.ceil(100 * n / walkers))
    return _topped_up(edges, "row_id", seen, n, seed)


# ---------------------------------------------------------------- samples of nodes


def node_time_sample(benign: DataFrame, n: int, seed: int | str, time: str = "step") -> DataFrame:
    """Benign nodes by time step in proportion, at least one each; what exceeds n is cut from the last steps. Weights are pool / first take, as drawn before the cut."""
    sizes = benign.groupBy(time).agg(F.count("*").alias("pool"))  # a row for each time step
    first = F.greatest(F.lit(1), F.rint(n * F.col("pool") / F.sum("pool").over(Window.partitionBy()))).cast("bigint")
    sizes = _cut_back(sizes.withColumn("take", F.least("pool", first)), time, n)
    return drawn(benign, time, sizes, seed, "node")


def node_degree_sample(benign: DataFrame, n: int, seed: int | str) -> DataFrame:
    """Benign nodes, a third of n from each tercile of the degree, with the weights of the pools."""
    cut = benign.crossJoin(F.broadcast(S.quantile_cuts(benign, "degree")))  # one row
    tiers = written(cut.withColumn("tercile", S.tercile(F.col("degree"), F.col("cuts"))).drop("cuts"), "tiers")
    sizes = tiers.groupBy("tercile").agg(F.count("*").alias("pool")).withColumn("take", F.least("pool", F.lit(max(1, n // 3)).cast("bigint")))
    return drawn(tiers, "tercile", _cut_back(sizes, "tercile", n), seed, "node")


def _cut_back(sizes: DataFrame, order: str, n: int) -> DataFrame:
    """Sets the weight by the first take, then cuts takes from the last groups until they sum to n. The table is small."""
    before = F.coalesce(F.sum("take").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = sizes.withColumn("weight", F.col("pool") / F.col("take")).withColumn("_before", before)
    return sized.withColumn("take", F.greatest(F.lit(0), F.least(F.col("take"), n - F.col("_before"))).cast("bigint")).drop("_before")


def node_walk_sample(nodes: DataFrame, edges: DataFrame, n: int, seed: int | str, seeds: int = 64, length: int = 50, walkers: int | None = None) -> DataFrame:
    """(node, step, walker, weight): n benign nodes in the order in which walks from illicit ones meet them, topped up uniformly.

    ``seeds`` illicit nodes by hash are the places to start from; a walker starts again after ``length`` steps. Weights are
    the benign pool over the nodes taken. Without illicit nodes all are drawn uniformly.
    """
    walkers = walkers or max(1, n // 4)
    benign = written(nodes.where("label = 0").select("node"), "benign")
    illicit = nodes.where("label = 1").select("node")
    from_ = S.first_ranked(illicit.withColumn("_draw", draw(seed, F.col("node"))), [], "_draw", nodes.sparkSession.range(1).select(F.lit(seeds).cast("bigint").alias("take"))).select("node")
    near = incidences(edges, loops=2)
    steps = walk(near, dictionary(from_, "node"), walkers, seed, lambda s: F.lit(s % (length + 1) == 0))
    met = (here.where("row_id is not null").join(benign, "node", "left_semi") for here in steps)
    out = written(_topped_up(benign, "node", first_visits(met, "node", n, math.ceil(100 * n / walkers)), n, seed), "sample")
    pool, got = benign.count(), out.count()
    return out.withColumn("weight", F.lit(pool / max(got, 1)))
