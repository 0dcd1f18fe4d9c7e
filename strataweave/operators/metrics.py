"""Weighted and unweighted detection metrics, threshold sweeps, multi-class F1."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataweave.functions.ratios import f1, ratio0, ratio_null
from strataweave.operators.ordered import running

#: The two threshold grids, kept apart on purpose.
CONSTRUCTION_GRID = np.arange(0.05, 0.95, 0.01)
EVALUATION_GRID = np.linspace(0.01, 0.99, 200)


def counts(label: Column, predicted: Column, weight: Column | None = None) -> list[Column]:
    """tp, fp, fn, tn as sums of weights, or as counts."""
    one = F.lit(1) if weight is None else weight
    zero = F.lit(0) if weight is None else F.lit(0.0)
    cell = lambda y, p: F.coalesce(F.sum(F.when((label == y) & (predicted == p), one).otherwise(zero)), zero)
    return [cell(y, p).alias(name) for name, y, p in (("tp", 1, 1), ("fp", 0, 1), ("fn", 1, 0), ("tn", 0, 0))]


def with_rates(confusion: DataFrame) -> DataFrame:
    """Adds precision, recall, f1 and accuracy to tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return confusion.withColumns({"precision": ratio0(tp, tp + fp), "recall": ratio0(tp, tp + fn), "f1": f1(tp, fp, fn), "accuracy": ratio0(tp + tn, tp + fp + fn + tn)})


def prf(df: DataFrame, by: Sequence[str] = (), label: str = "label", predicted: str = "pred", weight: str | None = None) -> DataFrame:
    cells = counts(F.col(label), F.col(predicted), F.col(weight) if weight else None)
    return with_rates(df.groupBy(*by).agg(*cells))


def predict_all_floor(df: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """What a scorer gets that flags everything."""
    return prf(df.withColumn("pred", F.lit(1)), by, weight=weight)


def grid_index(score: Column, grid: Sequence[float]) -> Column:
    """How many thresholds of an ascending, evenly spaced grid are at most the score: a guess by division, put right by comparison."""
    values, n = F.array(*[F.lit(float(g)) for g in grid]), len(grid)
    step = (float(grid[-1]) - float(grid[0])) / (n - 1)
    guess = F.greatest(F.lit(0), F.least(F.lit(n), F.floor((score - float(grid[0])) / step) + 1)).cast("int")
    at = lambda i: F.get(values, i)
    return F.when((guess > 0) & (score < at(guess - 1)), guess - 1).when((guess < n) & (score >= at(guess)), guess + 1).otherwise(guess)


def threshold_sweep(df: DataFrame, grid: Sequence[float], by: Sequence[str] = (), label: str = "label", score: str = "p", weight: str | None = None) -> DataFrame:
    """Confusion and rates at each threshold; a row is predicted positive if its score reaches it.

    Rows are summed by their place in the grid, so the sweep moves one row for each place, never a copy of the
    input for each threshold; the rest is a running sum over the grid.
    """
    w = F.col(weight) if weight else F.lit(1)
    placed = df.withColumn("_i", grid_index(F.col(score), grid)).groupBy(*by, "_i").agg(F.sum(F.when(F.col(label) == 1, w).otherwise(0 * w)).alias("_pos"), F.sum(F.when(F.col(label) == 0, w).otherwise(0 * w)).alias("_neg"))
    groups = placed.select(*by).distinct() if by else None
    steps = df.sparkSession.createDataFrame([(i + 1, float(g)) for i, g in enumerate(grid)], "_i int, threshold double")
    frame = placed.select(*by, "_i", "_pos", "_neg", F.lit(None).cast("double").alias("threshold"))
    marks = (groups.crossJoin(F.broadcast(steps)) if by else steps).select(*by, "_i", F.lit(0).alias("_pos"), F.lit(0).alias("_neg"), "threshold")  # as many rows as the grid for each group
    at = Window.partitionBy(*by).orderBy("_i").rangeBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(*by)
    swept = frame.unionByName(marks).select(*by, "threshold", F.sum("_pos").over(at).alias("tp"), F.sum("_neg").over(at).alias("fp"), F.sum("_pos").over(whole).alias("_p"), F.sum("_neg").over(whole).alias("_n"))
    swept = swept.where("threshold is not null").withColumns({"fn": F.col("_p") - F.col("tp"), "tn": F.col("_n") - F.col("fp")}).drop("_p", "_n")
    return with_rates(swept)


def best_threshold(sweep: DataFrame, by: Sequence[str] = (), default: float = 0.5) -> DataFrame:
    """The lowest threshold of the largest F1; the default where every F1 is 0."""
    best = sweep.groupBy(*by).agg(F.max("f1").alias("best_f1"), F.max_by("threshold", F.struct(F.col("f1"), -F.col("threshold"))).alias("threshold"))
    return best.withColumn("threshold", F.when(F.col("best_f1") > 0, F.col("threshold")).otherwise(F.lit(default)))


def spread(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """mean, population and sample deviation, min, max."""
    v = F.col(value)
    return df.groupBy(*by).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd_pop"), F.stddev_samp(v).alias("sd_samp"), F.min(v).alias("min"), F.max(v).alias("max"))


def cell_mean_range(df: DataFrame, by: Sequence[str], cell: Sequence[str], values: Sequence[str], floor: DataFrame | None = None) -> DataFrame:
    """The range over cells of the mean of each cell, for each value; with f1 and precision of a floor for each group of ``by``."""
    means = df.groupBy(*by, *cell).agg(*[F.avg(v).alias(v) for v in values])
    got = means.groupBy(*by).agg(F.count("*").alias("cells"), *[c for v in values for c in (F.min(v).alias(f"{v}_lowest"), F.max(v).alias(f"{v}_highest"))])
    if floor is None:
        return got
    low = floor.select(*by, F.col("f1").alias("floor_f1"), F.col("precision").alias("floor_precision"))
    return got.join(low, list(by), "left") if by else got.crossJoin(F.broadcast(low))  # one row


def class_f1(df: DataFrame, truth: str, predicted: str, classes: DataFrame | None = None, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """tp, fp, fn, support and f1 of each class, over ``classes`` (cls) or the labels on either side.

    Both sides are summed by class before they meet, so nothing is multiplied by the number of classes. f1 is 0 for a
    class without any row and null where the truth lacks it.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    side = lambda c, hit, n: df.where(F.col(c).isNotNull()).groupBy(*by, F.col(c).alias("cls")).agg(F.sum(F.when(F.col(truth) == F.col(predicted), w).otherwise(0.0)).alias(hit), F.sum(w).alias(n))
    both = side(truth, "tp", "support").join(side(predicted, "_tp", "predicted"), [*by, "cls"], "full_outer")
    if classes is not None:
        groups = df.select(*by).distinct() if by else None
        every = groups.crossJoin(F.broadcast(classes)) if by else classes  # a row for each class and group
        both = every.join(both, [*by, "cls"], "left")
    tp, support, predicted_n = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("tp", "support", "predicted"))
    return both.select(*by, "cls", tp.alias("tp"), (predicted_n - tp).alias("fp"), (support - tp).alias("fn"), support.alias("support"), F.when(support > 0, ratio0(2 * tp, support + predicted_n)).alias("f1"), ratio0(2 * tp, support + predicted_n).alias("f1_or_0"))


def macro_f1(per_class: DataFrame, by: Sequence[str] = (), present_only: bool = True) -> DataFrame:
    """The mean over the classes that the truth has, or over all listed."""
    value = F.col("f1") if present_only else F.col("f1_or_0")
    return per_class.groupBy(*by).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("macro_f1"), F.count(value).alias("classes"))


def weighted_typology(df: DataFrame, truth: str, predicted: str, classes: DataFrame, weight: str, by: Sequence[str] = (), least: int = 3) -> DataFrame:
    """(by, typ_macro_f1, typ_accuracy) over the rows that name a class, weighted; both 0 where fewer than ``least`` do. Groups that name none have no row."""
    named = df.where(F.col(predicted).isNotNull())
    right = F.sum(F.when(F.col(truth) == F.col(predicted), F.col(weight)).otherwise(0.0))
    share = named.groupBy(*by).agg(F.count("*").alias("_named"), ratio0(right, F.sum(weight)).alias("_accuracy"))
    macro = macro_f1(class_f1(named, truth, predicted, classes, by, weight), by)
    both = share.join(macro, list(by)) if by else share.crossJoin(F.broadcast(macro))  # one row
    return both.select(*by, *[F.when(F.col("_named") >= least, F.col(c)).otherwise(0.0).alias(n) for c, n in (("macro_f1", "typ_macro_f1"), ("_accuracy", "typ_accuracy"))])


def transitions(df: DataFrame, by: Sequence[str], label: str, first: str, second: str, weight: str) -> DataFrame:
    """How often two scorers are both right, both wrong, or one of them is."""
    a, b = F.col(first) == F.col(label), F.col(second) == F.col(label)
    kind = F.when(a & b, "both_right").when(a, "first_only").when(b, "second_only").otherwise("both_wrong")
    return df.withColumn("category", kind).groupBy(*by, "category").agg(F.count("*").alias("n"), F.sum(weight).alias("weighted_n"))


def rates_over(df: DataFrame, sets: Sequence[Sequence[str]], measures: dict[str, tuple[str, str]]) -> DataFrame:
    """(k, n, rate) of each measure over grouping sets; ``measures`` maps a name to the conditions of k and n."""
    columns = sorted({c for s in sets for c in s})
    cells = []
    for m, (k, n) in measures.items():
        hit, all_ = F.count_if(F.expr(f"({k}) AND ({n})")), F.count_if(F.expr(n))
        cells += [hit.alias(f"{m}_k"), all_.alias(f"{m}_n"), F.try_divide(hit, all_).alias(f"{m}_rate")]
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(*cells)


def pr_curve(df: DataFrame, by: Sequence[str] = (), label: str = "label", score: str = "p") -> DataFrame:
    """(score, pos, neg, tp, fp, positives, precision, recall) at each distinct score, downwards. Equal scores are summed before any window."""
    at = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(label).alias("pos"), (F.count("*") - F.sum(label)).alias("neg"))
    curve = running(at, "score", {"tp": F.col("pos"), "fp": F.col("neg")}, by, descending=True)
    whole = at.groupBy(*by).agg(F.sum("pos").alias("positives"))
    curve = curve.join(whole, list(by)) if by else curve.crossJoin(F.broadcast(whole))  # one row
    return curve.withColumns({"precision": ratio0(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio0(F.col("tp"), F.col("positives"))})


def average_precision(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum of recall steps times precision, and the trapezoid area that starts at precision 1. The point before comes from the counts at the point itself."""
    tp, flagged = F.col("tp") - F.col("pos"), F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")
    step = F.col("recall") - ratio0(tp, F.col("positives"))
    before = F.when(flagged == 0, 1.0).otherwise(ratio0(tp, flagged))
    return curve.withColumn("_ap", step * F.col("precision")).withColumn("_area", step * (F.col("precision") + before) / 2).groupBy(*by).agg(F.sum("_ap").alias("average_precision"), F.sum("_area").alias("pr_auc"))


def rate(k: Column, n: Column) -> Column:
    return ratio_null(k, n)
