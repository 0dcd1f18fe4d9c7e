"""Strata, exact-size deterministic samples, and weights from realised membership.

Samples are the first n rows of a stratum in the order of a hash of seed and key: exact in size, the same on any
cluster, and independent for each seed. Ranks never need a whole stratum in one task: rows are cut by hash into
buckets, the buckets' counts say where the n-th row falls, and only the bucket that holds it is ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataweave.functions.identifiers import draw
from strataweave.operators.ordered import quantiles
from strataweave.session import written


def difficulty(p: Column) -> Column:
    return 1 - 2 * F.abs(p - 0.5)


def is_hard(label: Column, p: Column, tau: float | Column) -> Column:
    """A benign row whose score reaches half of the threshold."""
    return (label == 0) & (p >= 0.5 * tau)


def quantile_cuts(df: DataFrame, value: str, shares: Sequence[float] = (0.33, 0.67), by: Sequence[str] = ()) -> DataFrame:
    """Exact, linearly interpolated quantiles of the whole pool as cuts."""
    return quantiles(df, value, shares, by)


def tercile(value: Column, cuts: Column) -> Column:
    return F.when(value < cuts[0], 1).when(value < cuts[1], 2).otherwise(3)


def stratify(df: DataFrame, tau: float, value: str = "difficulty") -> DataFrame:
    """Adds stratum: illicit, hard_neg, or easy_t1 to easy_t3 by exact terciles of the easy rows' difficulty.

    The rows are written before the cuts are taken, and again with their strata, as samples read them several times.
    """
    df = written(df.withColumn("difficulty", difficulty(F.col("p"))), "difficulty")
    hard = is_hard(F.col("label"), F.col("p"), tau)
    cuts = quantile_cuts(df.where((F.col("label") == 0) & ~hard), value)  # one row
    name = F.when(F.col("label") == 1, "illicit").when(hard, "hard_neg").otherwise(F.concat(F.lit("easy_t"), tercile(F.col(value), F.col("cuts")).cast("string")))
    return written(df.crossJoin(F.broadcast(cuts)).withColumn("stratum", name).drop("cuts"), "strata")


def first_ranked(df: DataFrame, by: Sequence[str], order: str, sizes: DataFrame, size: str = "take", digits: int = 3) -> DataFrame:
    """The ``size`` first rows of each group of ``by`` in the order of the hex digest in ``order``; ``sizes`` has a row for each group."""
    bucket = df.withColumn("_bucket", F.substring(order, 1, digits))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = bucket.groupBy(*by, "_bucket").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    open_ones = counts.join(sizes.select(*by, F.col(size).alias("_take")), list(by)) if by else counts.crossJoin(F.broadcast(sizes.select(F.col(size).alias("_take"))))
    open_ones = open_ones.where(F.col("_before") < F.col("_take")).withColumn("_left", F.col("_take") - F.col("_before")).select(*by, "_bucket", "_left")
    near = bucket.join(open_ones, [*by, "_bucket"])
    rank = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(order))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_left")).select(*df.columns)


def sample(df: DataFrame, by: Sequence[str], size: Column | int, seed: int | str, key: str = "row_id") -> DataFrame:
    """At most ``size`` rows of each group, with pool and n of the group and the weight pool / n.

    ``size`` may use pool, the number of rows of the group.
    """
    pools = df.groupBy(*by).agg(F.count("*").alias("pool"))
    sizes = pools.withColumn("n", F.least(F.col("pool"), (size if isinstance(size, Column) else F.lit(size)).cast("bigint")))
    sizes = written(sizes, "sizes")
    taken = first_ranked(df.withColumn("_draw", draw(seed, F.col(key))), by, "_draw", sizes, "n").drop("_draw")
    joined = taken.join(sizes, list(by)) if by else taken.crossJoin(F.broadcast(sizes))
    return joined.withColumn("weight", F.col("pool") / F.col("n"))


def with_census(illicit: DataFrame, sampled: DataFrame) -> DataFrame:
    """All illicit rows with weight 1, and the weighted benign sample."""
    return illicit.withColumn("weight", F.lit(1.0)).unionByName(sampled, allowMissingColumns=True)


def benign_sizes(strata: DataFrame, budget: int, hard_share: float = 0.3) -> DataFrame:
    """Adds take and gap to (stratum, pool): hard rows up to their share of a budget, the easy terciles a third of the rest each; gap is what the takes leave of the budget, to be filled from all rows that remain.

    The table has at most four rows.
    """
    at = Window.partitionBy()
    n = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("pool"))).over(at), F.lit(0))
    hard = F.col("stratum") == "hard_neg"
    h, e = n(hard), n(~hard)
    nh0 = F.least(F.lit(int(budget * hard_share)), h)
    ne = F.least(F.lit(budget) - nh0, e)
    nh = F.when((ne < budget - nh0) & (h > nh0), F.least(F.lit(budget) - ne, h)).otherwise(nh0)
    base = F.when(hard, nh).otherwise(F.least(F.greatest(F.lit(1), F.floor(ne / 3)), F.col("pool")))
    sized = strata.withColumn("take", F.when(F.lit(budget) >= h + e, F.col("pool")).otherwise(base).cast("bigint"))
    spare = F.sum(F.col("pool") - F.col("take")).over(at)
    return sized.withColumn("gap", F.greatest(F.least(F.lit(budget) - F.sum("take").over(at), spare), F.lit(0)).cast("bigint"))


def benign_sample(df: DataFrame, budget: int, seed: int | str, hard_share: float = 0.3, key: str = "row_id") -> DataFrame:
    """The benign part of the weighted sample from stratified rows, with pool, n and weight.

    What the strata leave of the budget is drawn from all rows that remain, each as likely as any other, and counts in
    its own stratum; weights are pool / n of what was really taken.
    """
    benign = df.where("stratum != 'illicit'")
    sizes = written(benign_sizes(benign.groupBy("stratum").agg(F.count("*").alias("pool")), budget, hard_share), "sizes")
    first = written(first_ranked(benign.withColumn("_draw", draw(seed, F.col(key))), ["stratum"], "_draw", sizes), "taken")
    rest = benign.join(first.select(key), key, "left_anti").withColumn("_draw", draw(f"{seed}|fill", F.col(key)))
    fill = first_ranked(rest.select(*first.columns), [], "_draw", sizes.agg(F.coalesce(F.max("gap"), F.lit(0)).alias("take")))
    taken = written(first.unionByName(fill).drop("_draw"), "taken")
    real = taken.groupBy("stratum").agg(F.count("*").alias("n"))
    known = sizes.select("stratum", "pool").join(real, "stratum")
    return taken.join(F.broadcast(known), "stratum").withColumn("weight", F.col("pool") / F.col("n"))  # four rows at most


def largest_remainder(groups: DataFrame, by: Sequence[str], capacity: str, order: str, budget: Column | int) -> DataFrame:
    """Integer shares of a budget in proportion to capacity; what rounding leaves goes to the largest remainders, earliest first. ``groups`` is the small table of strata."""
    whole = Window.partitionBy(*by)
    total = F.sum(capacity).over(whole)
    b = budget if isinstance(budget, Column) else F.lit(budget)
    shares = groups.withColumn("_floor", F.floor(b * F.col(capacity) / total)).withColumn("_rest", (b * F.col(capacity)) % total)
    left = b - F.sum("_floor").over(whole)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_rest"), order))
    return shares.withColumn("_left", left).withColumn("share", (F.col("_floor") + F.when(rank <= F.col("_left"), 1).otherwise(0)).cast("bigint")).drop("_floor", "_rest", "_left")


def proportional(groups: DataFrame, size: str, budget: int, order: Sequence[Column], last_takes_rest: bool = True) -> DataFrame:
    """max(1, round(budget * pool / total)) for each group in the given order, the last one takes what remains; capped by pool and by what remains. The table of groups is small."""
    total = F.sum(size).over(Window.partitionBy())
    want = F.greatest(F.lit(1), F.rint(F.lit(budget) * F.col(size) / total)).cast("bigint")
    w = Window.orderBy(*order)
    ranked = groups.withColumn("_want", F.least(want, F.col(size))).withColumn("_last", F.lead(size).over(w).isNull())
    before = F.coalesce(F.sum("_want").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(budget) - before, F.lit(0))
    take = F.when(F.col("_last") & F.lit(last_takes_rest), F.least(left, F.col(size))).otherwise(F.least(F.col("_want"), left))
    return ranked.withColumn("take", take.cast("bigint")).drop("_want", "_last")


def round_robin(groups: DataFrame, size: str, order: str, budget: int) -> DataFrame:
    """Equal shares of a budget; what small groups cannot fill goes to the others, one round after the other, earlier groups first.

    With the groups by size, the level that all can reach is the largest L with sum(min(size, L)) <= budget; the rest
    of the budget gives one more to the earliest groups that have more. The table of groups is small.
    """
    w = Window.orderBy(size, order)
    sized = groups.withColumn("_done", F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_open", F.count("*").over(Window.partitionBy()) - F.row_number().over(w) + 1)
    level = F.floor((F.lit(budget) - F.col("_done")) / F.col("_open"))
    whole = Window.partitionBy()
    sized = sized.withColumn("_level", F.when(level < F.col(size), level))
    sized = sized.withColumn("_at", F.coalesce(F.max("_level").over(whole), F.max(size).over(whole)))
    sized = sized.withColumn("_base", F.least(F.col(size), F.col("_at"))).withColumn("_rest", F.lit(budget) - F.sum("_base").over(whole))
    more = F.row_number().over(Window.partitionBy(F.col(size) > F.col("_at")).orderBy(order))
    one = F.when((F.col(size) > F.col("_at")) & (more <= F.col("_rest")), 1).otherwise(0)
    return sized.withColumn("take", (F.col("_base") + one).cast("bigint")).drop("_done", "_open", "_level", "_at", "_base", "_rest")


def filled(df: DataFrame, by: str, sizes: DataFrame, budget: Column, seed: int | str, key: str = "row_id") -> DataFrame:
    """The ``take`` first rows of each group of ``by`` and, up to the budget, the first of all that remain in an order of their own. ``sizes`` (by, take) is small and written."""
    first = written(first_ranked(df.withColumn("_draw", draw(seed, F.col(key))), [by], "_draw", sizes), "taken")
    due = sizes.agg(F.greatest(F.coalesce(F.max(budget), F.lit(0)) - F.coalesce(F.sum("take"), F.lit(0)), F.lit(0)).alias("take"))
    rest = df.join(first.select(key), key, "left_anti").withColumn("_draw", draw(f"{seed}|fill", F.col(key)))
    return first.unionByName(first_ranked(rest.select(*first.columns), [], "_draw", due)).drop("_draw")


def naive_draw(df: DataFrame, n_illicit: int, seed: int | str, key: str = "row_id") -> DataFrame:
    """Unweighted rows at the population's ratio: illicit ones in equal parts of each (typology, tercile of their difficulty), benign ones in
    proportion to the terciles of theirs; what either lacks is drawn from all of its rows that remain. ``stratum`` numbers the parts, benign ones from -3 to -1.

    With more parts than rows, the first parts have one row each. Without illicit rows the result is empty.
    """
    rows = written(df.select(key, "label", "typology", difficulty(F.col("p")).alias("difficulty")), "naive")
    cuts = quantile_cuts(rows, "difficulty", by=["label"])  # two rows
    third = tercile(F.col("difficulty"), F.col("cuts"))
    rows = written(rows.join(F.broadcast(cuts), "label").withColumn("stratum", F.when(F.col("label") == 1, F.col("typology") * 3 + third + 2).otherwise(third - 4)).select(key, "label", "stratum"), "naive")
    pools = rows.groupBy("label", "stratum").agg(F.count("*").alias("pool"))
    whole, order = Window.partitionBy(), Window.orderBy("stratum")  # a row for each typology and tercile, and three
    illicit = pools.where("label = 1").withColumn("_all", F.sum("pool").over(whole)).withColumn("_due", F.least("_all", F.lit(n_illicit)).cast("bigint"))
    base = F.when(F.col("_all") <= n_illicit, F.col("pool")).otherwise(F.least("pool", F.greatest(F.lit(1), F.floor(F.lit(n_illicit) / F.count("*").over(whole)))))
    illicit = illicit.withColumn("_base", base.cast("bigint"))
    before = F.coalesce(F.sum("_base").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    illicit = written(illicit.withColumn("take", F.least(F.col("_base"), F.greatest(F.col("_due") - before, F.lit(0)))), "naive-sizes")
    known = illicit.agg(F.max("_due").alias("_due"), F.max("_all").alias("_all"))  # one row
    benign = pools.where("label = 0").withColumn("_benign", F.sum("pool").over(whole)).crossJoin(F.broadcast(known))
    ratio = F.col("_all") / (F.col("_all") + F.col("_benign"))
    benign = benign.withColumn("_due", F.least(F.floor(F.col("_due") / ratio) - F.col("_due"), F.col("_benign")).cast("bigint")).where("_due is not null")
    benign = written(benign.withColumn("take", F.floor(F.col("_due") * (F.col("pool") / F.col("_benign"))).cast("bigint")), "naive-sizes")
    parts = [filled(rows.where(F.col("label") == y), "stratum", sizes, F.col("_due"), seed, key) for y, sizes in ((1, illicit), (0, benign))]
    return parts[0].unionByName(parts[1])


def weight_report(df: DataFrame, by: str = "stratum") -> DataFrame:
    """For each stratum of a sample with pool, n and weight: realised size, modal weight, and whether the weights fit."""
    got = df.groupBy(by).agg(F.count("*").alias("n_real"), F.max("pool").alias("pool"), F.mode("weight", True).alias("modal_weight"), F.min("weight").alias("_min"), F.max("weight").alias("_max"))
    fits = (F.col("_min") == F.col("_max")) & (F.abs(F.col("modal_weight") * F.col("n_real") - F.col("pool")) < 1e-6)
    return got.withColumn("consistent", fits).drop("_min", "_max")


def infer_hard_cut(df: DataFrame) -> DataFrame:
    """The middle between the largest score outside and the smallest inside the hard stratum of weight-1 benign rows; null unless they are apart."""
    inside = F.min(F.when((F.col("label") == 0) & F.col("inside"), F.col("p")))
    outside = F.max(F.when((F.col("label") == 0) & ~F.col("inside"), F.col("p")))
    return df.agg(inside.alias("min_inside"), outside.alias("max_outside")).withColumn("cut", F.when(F.col("max_outside") < F.col("min_inside"), (F.col("max_outside") + F.col("min_inside")) / 2))
