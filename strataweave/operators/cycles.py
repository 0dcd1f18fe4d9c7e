"""Cycles of many edges in ascending time, put together from two half paths."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.session import written


def time_paths(edges: DataFrame, length: int, seconds: int) -> list[DataFrame]:
    """Tables of the simple paths of 1, 2, ... ``length`` edges in strictly ascending time within the window: (start, end, t0, t1, inner).

    ``inner`` holds the nodes between the ends. Each extension joins on (node, time cell) and is written before the next. Paths are
    small as files and large as rows, so they are never sent whole to the tasks, as the driver would have to hold them first.
    """
    cell = lambda t: F.floor(F.col(t) / seconds)
    one = written(edges.where("src != dst").select(F.col("src").alias("start"), F.col("dst").alias("end"), F.col("epoch_s").alias("t0"), F.col("epoch_s").alias("t1"), F.array().cast("array<bigint>").alias("inner")), "paths")
    step = one.select(F.col("start").alias("at"), F.col("end").alias("to"), F.col("t0").alias("t"), cell("t0").alias("cell"))
    out = [one]
    for _ in range(1, length):
        reach = out[-1].withColumn("cell", F.explode(F.array(cell("t1"), cell("t1") + 1)))
        longer = reach.join(step.hint("merge"), (reach["end"] == step["at"]) & (reach["cell"] == step["cell"])).where(f"t > t1 and t - t0 <= {seconds} and to != start and not array_contains(inner, to)")
        out.append(written(longer.select("start", F.col("to").alias("end"), "t0", F.col("t").alias("t1"), F.concat("inner", F.array("end")).alias("inner")), "paths"))
    return out


def long_cycles(edges: DataFrame, length: int = 10, seconds: int = 86_400) -> DataFrame:
    """(start, hops, n): cycles of 2 to ``length`` edges in strictly ascending time within the window, from the node of the first edge.

    A cycle of h edges is one path of its first half, rounded up, and one of the rest, which starts where the first ends and ends where
    it starts, later, with other nodes between. So no path is longer than half the cycle, and halves meet on both of
    their ends and the time cell; counts are summed before they are shuffled and written length by length. Loops are left out; equal rows count each.
    """
    paths = time_paths(edges, -(-length // 2), seconds)
    cell = lambda t: F.floor(F.col(t) / seconds)
    found = []
    for hops in range(2, length + 1):
        first = paths[-(-hops // 2) - 1].withColumn("cell", F.explode(F.array(cell("t1"), cell("t1") + 1)))
        rest = paths[hops // 2 - 1].select(F.col("end").alias("start"), F.col("start").alias("end"), F.col("t0").alias("u0"), F.col("t1").alias("u1"), F.col("inner").alias("others"), cell("t0").alias("cell"))
        met = first.join(rest.hint("merge"), ["start", "end", "cell"]).where(f"u0 > t1 and u1 - t0 <= {seconds} and not arrays_overlap(inner, others)")
        found.append(written(met.groupBy("start").agg(F.count("*").alias("n")).select("start", F.lit(hops).alias("hops"), "n"), "cycles"))
    return reduce(DataFrame.unionByName, found)
