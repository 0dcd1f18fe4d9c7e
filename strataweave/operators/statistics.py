"""Agreement, item response, divergence, finite-population uncertainty, rank tests."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataweave.functions.ratios import ratio0
from strataweave.operators.ordered import quantiles, running
from strataweave.session import written


def cohen_kappa(ratings: DataFrame, item: str, rater: str, score: str) -> DataFrame:
    """(rater_a, rater_b, n, agreement, kappa) of 0/1 ratings for each pair of raters; 1 or 0 where chance agreement is 1.

    A pivot by rater brings each item's few ratings into one row; pairs are then sums over rows, in one pass.
    """
    names = [r[0] for r in ratings.select(rater).distinct().orderBy(rater).collect()]  # the raters, a handful by design
    wide = ratings.groupBy(item).pivot(rater, names).agg(F.max(score))
    cells = []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
            both = x.isNotNull() & y.isNotNull()
            cells.append(F.struct(F.lit(a).alias("rater_a"), F.lit(b).alias("rater_b"), F.count_if(both).alias("n"), F.count_if(both & (x == y)).alias("same"), F.count_if(both & (x == 1)).alias("ones_a"), F.count_if(both & (y == 1)).alias("ones_b")))
    sums = wide.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")
    n = F.col("n")
    po, pa, pb = (ratio0(F.col(c), n) for c in ("same", "ones_a", "ones_b"))
    pe = pa * pb + (1 - pa) * (1 - pb)
    return sums.select("rater_a", "rater_b", "n", po.alias("agreement"), F.when(pe >= 1, F.when(po >= 1, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def fleiss_kappa(ratings: DataFrame, item: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(items, p_bar, p_e, kappa) over items with the same number of raters; counts by item and category come first."""
    counts = ratings.groupBy(*by, item, score).agg(F.count("*").alias("c"))
    items = counts.groupBy(*by, item).agg(F.sum("c").alias("r"), F.sum(F.col("c") * (F.col("c") - 1)).alias("s"))
    per = items.groupBy(*by).agg(F.count("*").alias("items"), F.avg(F.col("s") / (F.col("r") * (F.col("r") - 1))).alias("p_bar"))
    shares = counts.groupBy(*by, score).agg(F.sum("c").alias("c")).withColumn("share", F.col("c") / F.sum("c").over(Window.partitionBy(*by)))
    chance = shares.groupBy(*by).agg(F.sum(F.col("share") * F.col("share")).alias("p_e"))
    both = per.join(chance, list(by)) if by else per.crossJoin(F.broadcast(chance))  # one row each
    return both.withColumn("kappa", F.when(F.col("p_e") >= 1, F.when(F.col("p_bar") >= 1, 1.0).otherwise(0.0)).otherwise((F.col("p_bar") - F.col("p_e")) / (1 - F.col("p_e"))))


def rater_ceiling(ratings: DataFrame, rater: str, score: str, limit: float = 0.95) -> DataFrame:
    """The share of ones of each rater and whether chance agreement with itself leaves no room for kappa."""
    r = ratings.groupBy(rater).agg(F.count("*").alias("n"), F.avg(score).alias("share"))
    return r.withColumn("ceiling", F.col("share") * F.col("share") + (1 - F.col("share")) * (1 - F.col("share")) >= limit)


def histogram_share(df: DataFrame, by: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """Shares over bins of [0, 1], the right end in the last bin, each count raised by 1e-9; all bins listed."""
    i = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).cast("int")
    counts = df.groupBy(*by, i.alias("bin")).agg(F.count("*").alias("c"))
    every = df.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return smoothed(every.join(counts, [*by, "bin"], "left"), by)


def smoothed(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    c = F.coalesce(F.col("c"), F.lit(0)) + 1e-9
    return counts.withColumn("share", c / F.sum(c).over(Window.partitionBy(*by))).drop("c")


def divergence(p: DataFrame, q: DataFrame, on: Sequence[str]) -> DataFrame:
    """Sum of p ln(p / q)."""
    both = p.select(*on, F.col("share").alias("p")).join(q.select(*on, F.col("share").alias("q")), list(on))
    return both.agg(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))).alias("kl"))


def item_response(responses: DataFrame, item: str, rater: str, correct: str) -> DataFrame:
    """accuracy, one-parameter difficulty and point-biserial discrimination of each item; 0 where a deviation is 0."""
    r = responses.groupBy(rater).agg(F.avg(correct).alias("ability"))  # a row for each rater
    a = F.least(F.greatest(F.avg(correct), F.lit(0.01)), F.lit(0.99))
    return responses.join(r, rater).groupBy(item).agg(F.avg(correct).alias("accuracy"), F.log((1 - a) / a).alias("difficulty"), F.coalesce(F.try_divide(F.covar_pop(correct, "ability"), F.stddev_pop(correct) * F.stddev_pop("ability")), F.lit(0.0)).alias("discrimination"))


def eligibility(items: DataFrame, raters: int, value: str = "accuracy") -> DataFrame:
    """GOOD, WEAK or NO with the number of broken conditions: size, raters, spread, and three equally filled ranges of at least five."""
    stats = items.agg(F.count("*").alias("n"), F.stddev_pop(value).alias("sd")).crossJoin(F.broadcast(quantiles(items, value, (1 / 3, 2 / 3)).withColumnRenamed("cuts", "c")))  # one row each
    v = F.col(value)
    bins = items.crossJoin(F.broadcast(stats)).agg(F.max("n").alias("n"), F.max("sd").alias("sd"), F.count_if(v <= F.col("c")[0]).alias("low"), F.count_if((v >= F.col("c")[0]) & (v <= F.col("c")[1])).alias("mid"), F.count_if(v >= F.col("c")[1]).alias("high"))  # one row
    bad = sum((c.cast("int") for c in (F.lit(raters < 5), F.col("sd") < 0.1, F.least("low", "mid", "high") < 5)), (F.col("n") < 50).cast("int"))
    return bins.withColumn("issues", bad).withColumn("verdict", F.when((bad == 0) & (F.col("n") >= 100), "GOOD").when(F.col("n") >= 50, "WEAK").otherwise("NO"))


def cliffs_delta(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """P(a > b) - P(a < b) over all pairs, from counts by distinct value and their running sums, never from the pairs."""
    both = a.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("na")).join(b.groupBy(F.col(value).alias("v")).agg(F.count("*").alias("nb")), "v", "full_outer").na.fill(0, ["na", "nb"])
    run = running(both, "v", {"less": F.col("nb")}, inclusive=False)
    total = run.agg(F.sum("na").alias("n"), F.sum("nb").alias("m"), F.sum(F.col("na") * F.col("less")).alias("gt"), F.sum(F.col("na") * (F.col("less") + F.col("nb"))).alias("ge"))
    return total.select((F.col("gt") + F.col("ge") - F.col("n") * F.col("m")).cast("double").alias("x"), F.col("n"), F.col("m")).select(F.try_divide(F.col("x"), (F.col("n") * F.col("m")).cast("double")).alias("delta"))


def stratified_covariance(samples: DataFrame, pools: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Covariance of two estimated totals: sum over strata of pool^2 (1 - n/pool) S / n; 0 for a census or one row."""
    s = samples.groupBy(*by, "stratum").agg(F.count("*").alias("n"), F.coalesce(F.covar_samp(x, y), F.lit(0.0)).alias("s")).join(pools, "stratum")
    return s.groupBy(*by).agg(F.sum(F.col("pool") * F.col("pool") * (1 - F.col("n") / F.col("pool")) * F.col("s") / F.col("n")).alias("covariance"))


def log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def tail(pool: int, marked: int, n: int, x: int, upper: bool) -> float:
    """P(X >= x) or P(X <= x) of marked units in n draws without replacement: from the logarithm of one term, the others follow by their ratios."""
    lo, hi = max(0, n + marked - pool), min(n, marked)
    first, last = (max(x, lo), hi) if upper else (lo, min(x, hi))
    if first > last:
        return 0.0
    i = np.arange(first, last, dtype=np.float64)
    ratios = np.log((marked - i) * (n - i)) - np.log((i + 1) * (pool - marked - n + i + 1))
    start = log_choose(marked, first) + log_choose(pool - marked, n - first) - log_choose(pool, n)
    return math.fsum(np.exp(start + np.concatenate(([0.0], np.cumsum(ratios)))).tolist())


def count_interval(pool: int, n: int, x: int, alpha: float) -> tuple[int, int]:
    """Exact interval of the marked units in the pool: those with at least alpha / 2 in either tail, by bisection."""
    if n == pool:
        return x, x
    if n == 0:
        return 0, pool
    least, most, slack = x, pool - n + x, 1e-12

    def first(ok, a: int, z: int) -> int:
        while a < z:
            m = (a + z) // 2
            a, z = (a, m) if ok(m) else (m + 1, z)
        return a

    low = first(lambda m: tail(pool, m, n, x, True) >= alpha / 2 - slack, least, most)
    high = most - first(lambda d: tail(pool, most - d, n, x, False) >= alpha / 2 - slack, 0, most - least)
    return low, high


def _interval(pool: pd.Series, n: pd.Series, x: pd.Series, alpha: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([count_interval(int(a), int(b), int(c), float(d)) for a, b, c, d in zip(pool, n, x, alpha)], columns=["low", "high"])


def with_intervals(df: DataFrame, alpha: Column) -> DataFrame:
    """Adds low and high for (pool, n, x); each distinct combination is evaluated once and joined back."""
    keyed = df.withColumn("_alpha", F.round(alpha, 12))
    once = keyed.select("pool", "n", "x", "_alpha").distinct().withColumn("_i", F.pandas_udf(_interval, "low bigint, high bigint")("pool", "n", "x", "_alpha")).select("pool", "n", "x", "_alpha", "_i.low", "_i.high")
    return keyed.join(once, ["pool", "n", "x", "_alpha"]).drop("_alpha")


def metric_envelope(df: DataFrame, by: Sequence[str], low: str = "low", high: str = "high") -> DataFrame:
    """Bounds of precision, F1 and lift from bounds of the false positives of each stratum, and the known tp, pos and total.

    All three fall as the false positives grow, so their extremes over the box of all strata are at its two corners, the
    sums of the lower and of the upper bounds.
    """
    sums = df.groupBy(*by).agg(F.sum(low).alias("fp_low"), F.sum(high).alias("fp_high"), F.max("tp").alias("tp"), F.max("pos").alias("pos"), F.max("total").alias("total"))
    tp, out = F.col("tp").cast("double"), {}
    for side, fp in (("low", F.col("fp_high")), ("high", F.col("fp_low"))):
        out[f"precision_{side}"] = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
        out[f"f1_{side}"] = F.coalesce(F.try_divide(2 * tp, tp + F.col("pos") + fp), F.lit(0.0))
        out[f"lift_{side}"] = F.try_divide(out[f"precision_{side}"] * F.col("total"), F.col("pos").cast("double"))
    return sums.withColumns(out)


#: The limits of the hypotheses, in points: least gain of F1, most change of over- and of under-prediction.
HYPOTHESES = {"f1": 5, "over": -10, "under": 5}


def paired_hypotheses(df: DataFrame, by: Sequence[str], cell: Sequence[str], arm: str, control: str, treated: str, label: str = "label", pred: str = "pred") -> DataFrame:
    """(by, cells, delta_f1_pp, h1, delta_over_pp, h2, delta_under_pp, h3): means over cells of treated less control, against the limits.

    Over- and under-prediction are shares of all rows of a cell. Cells that lack either arm are left out.
    """
    y, p, mine = F.col(label), F.col(pred), F.col(arm)
    side = lambda which: {f"{k}_{which}": F.count_if((mine == {"a": control, "b": treated}[which]) & c) for k, c in (("n", F.lit(True)), ("tp", (y == 1) & (p == 1)), ("fp", (y == 0) & (p == 1)), ("fn", (y == 1) & (p == 0)))}
    cells = df.groupBy(*by, *cell).agg(*[c.alias(k) for which in "ab" for k, c in side(which).items()]).where("n_a > 0 AND n_b > 0")
    c = F.col
    score = lambda w: {"f1": 100 * ratio0(2 * c(f"tp_{w}"), 2 * c(f"tp_{w}") + c(f"fp_{w}") + c(f"fn_{w}")), "over": 100 * c(f"fp_{w}") / c(f"n_{w}"), "under": 100 * c(f"fn_{w}") / c(f"n_{w}")}
    before, after = score("a"), score("b")
    means = cells.groupBy(*by).agg(F.count("*").alias("cells"), *[F.avg(after[m] - before[m]).alias(m) for m in HYPOTHESES])
    return means.select(*by, "cells", c("f1").alias("delta_f1_pp"), (c("f1") >= HYPOTHESES["f1"]).alias("h1"), c("over").alias("delta_over_pp"), (c("over") <= HYPOTHESES["over"]).alias("h2"), c("under").alias("delta_under_pp"), (c("under") <= HYPOTHESES["under"]).alias("h3"))


def average_ranks(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(value)
    return df.withColumn("_r", F.rank().over(w)).withColumn("rank", F.col("_r") + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2).drop("_r")


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """The chi-square statistic of ranks within blocks, without correction for ties, and the spread of the mean ranks."""
    ranks = average_ranks(df, [block], value)
    sums = ranks.groupBy(treatment).agg(F.sum("rank").alias("r"), F.count("*").alias("n"))
    k, n = F.count("*"), F.max("n")
    return sums.agg((12 / (n * k * (k + 1)) * F.sum(F.col("r") * F.col("r")) - 3 * n * (k + 1)).alias("chi2"), (F.max(F.col("r") / F.col("n")) - F.min(F.col("r") / F.col("n"))).alias("spread"), k.alias("treatments"), n.alias("blocks"))


def wilcoxon(df: DataFrame, by: Sequence[str], difference: str) -> DataFrame:
    """Signed-rank sums and the normal two-sided p of paired differences, zeros split between the signs, with tie correction."""
    d = df.withColumn("_a", F.abs(F.round(difference, 12))).where("_a is not null")
    signs = d.groupBy(*by, "_a").agg(F.count("*").alias("t"), F.count_if(F.col(difference) > 1e-12).alias("up"), F.count_if(F.col(difference) < -1e-12).alias("down"))
    at = running(signs, "_a", {"less": F.col("t")}, by, inclusive=False).withColumn("rank", F.col("less") + (F.col("t") + 1) / 2)
    zero, t = F.col("_a") == 0, F.col("t")
    half = F.when(zero, F.col("rank") * t / 2).otherwise(0.0)
    s = at.groupBy(*by).agg(F.sum("t").alias("n"), F.sum(F.col("rank") * F.col("up") + half).alias("w_plus"), F.sum(F.col("rank") * F.col("down") + half).alias("w_minus"), F.sum(F.when(~zero, t * t * t - t).otherwise(0)).alias("ties"), F.sum(F.when(zero, t).otherwise(0)).alias("zeros"))
    n, z = F.col("n").cast("double"), F.col("zeros").cast("double")
    variance = (n * (n + 1) * (2 * n + 1) - z * (z + 1) * (2 * z + 1) - F.col("ties") / 2) / 24
    score = F.try_divide(F.least("w_plus", "w_minus") - n * (n + 1) / 4, F.sqrt(variance))

    @F.pandas_udf("double")
    def two_sided(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None or math.isnan(v) else min(1.0, math.erfc(abs(v) / math.sqrt(2))))

    return s.withColumn("z", score).withColumn("p_value", two_sided("z")).drop("ties", "zeros")


def exact_signs(ranks: Sequence[int], times: Sequence[int], w: int, zeros: int) -> tuple[float, float]:
    """P(W >= w) and P(W <= w) of the sum of the ranks with a positive sign, all signs as likely, by dynamic programming over the sums.

    Ranks, w and zeros (what the zeros give to either side) are doubled, so that ties have whole numbers.
    """
    ways = [1]
    for rank, n in zip(ranks, times):
        for _ in range(n):
            more = ways + [0] * rank
            for i, c in enumerate(ways):
                more[i + rank] += c
            ways = more
    at, whole = w - zeros, sum(ways)
    return sum(ways[max(at, 0) :]) / whole, sum(ways[: max(at + 1, 0)]) / whole


def wilcoxon_exact(df: DataFrame, by: Sequence[str], difference: str, most: int = 50) -> DataFrame:
    """``wilcoxon`` with p_greater (positive differences prevail) and p_two_sided: exact in groups of at most ``most`` pairs, else normal; null where all pairs tie."""
    d = df.withColumn("_a", F.abs(F.round(difference, 12))).where("_a is not null")
    signs = d.groupBy(*by, "_a").agg(F.count("*").alias("t"))
    at = running(signs, "_a", {"less": F.col("t")}, by, inclusive=False).withColumn("_rank", (2 * F.col("less") + F.col("t") + 1).cast("bigint"))
    test = written(wilcoxon(df, by, difference), "signed-ranks")
    sizes = [F.max(F.when(F.col("_a") == 0, F.col("_rank") * F.col("t")).otherwise(0)).alias("_zeros"), F.max("_a").alias("_most"), F.collect_list(F.when((F.col("n") <= most) & (F.col("_a") > 0), F.struct("_rank", "t"))).alias("_ranks")]  # ``most`` ranks at most
    ranks = (at.join(test.select(*by, "n"), list(by)) if by else at.crossJoin(F.broadcast(test.select("n")))).groupBy(*by).agg(*sizes)  # one row

    @F.pandas_udf("greater double, less double")
    def exact(ranks: pd.Series, w: pd.Series, zeros: pd.Series) -> pd.DataFrame:
        # the zeros' ranks count half on either side: their doubled rank times t, halved
        got = [exact_signs([int(r["_rank"]) for r in each], [int(r["t"]) for r in each], round(2 * x), int(z) // 2) for each, x, z in zip(ranks, w, zeros)]
        return pd.DataFrame(got, columns=["greater", "less"])

    @F.pandas_udf("double")
    def beyond(z: pd.Series) -> pd.Series:
        return z.map(lambda v: None if v is None or math.isnan(v) else 0.5 * math.erfc(v / math.sqrt(2)))

    both = (test.join(ranks, list(by)) if by else test.crossJoin(F.broadcast(ranks))).withColumn("_e", exact("_ranks", "w_plus", "_zeros"))  # one row
    up = F.when(F.col("w_plus") >= F.col("w_minus"), -F.col("z")).otherwise(F.col("z"))
    small, tied = F.col("n") <= most, F.col("_most") == 0
    p = {"exact": small, "p_greater": F.when(~tied, F.when(small, F.col("_e.greater")).otherwise(beyond(up))), "p_two_sided": F.when(~tied, F.when(small, F.least(F.lit(1.0), 2 * F.least("_e.greater", "_e.less"))).otherwise(F.col("p_value")))}
    return both.withColumns(p).select(*by, "n", "w_plus", "w_minus", "exact", "p_greater", "p_two_sided")


#: A bijection of 64-bit numbers spreads (row, resample) over the numbers that weights are read from.
_ROW, _RESAMPLE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
POISSON = np.cumsum([math.exp(-1) / math.factorial(i) for i in range(13)])


def resample_weights(rows: np.ndarray, resamples: int) -> np.ndarray:
    """The weight of each row (a hash) in each resample: Poisson with mean 1, a matrix of small numbers."""
    with np.errstate(over="ignore"):
        x = rows[:, None] * np.uint64(_ROW) + np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(_RESAMPLE)
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return np.searchsorted((POISSON * 2.0**32).astype(np.uint32), (x >> np.uint64(32)).astype(np.uint32), side="right").astype(np.float64)


def paired_bootstrap(df: DataFrame, difference: str, key: str, resamples: int = 10_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """(n, mean, low, high): the percentile interval of the mean difference of pairs.

    Each pair's weight in a resample is drawn in its task from a hash of seed, key and resample, so a task hands on one vector of
    sums, whatever its rows, and results don't depend on how rows are dealt. Weights are Poisson, and a resample's mean is over
    its own weight. Where all differences are equal, the interval is that point; nulls are left out.
    """
    rows = df.where(F.col(difference).isNotNull()).select(F.xxhash64(F.lit(seed), key).alias("h"), F.col(difference).cast("double").alias("d"))

    def run(batches):
        weight, total = np.zeros(resamples), np.zeros(resamples)
        step = max(1, (1 << 20) // resamples)
        for batch in batches:
            h, d = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for a in range(0, len(h), step):
                w = resample_weights(h[a : a + step], resamples)
                weight += w.sum(axis=0)
                total += d[a : a + step] @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), pa.array(weight), pa.array(total)], names=["b", "weight", "total"])

    means = rows.mapInArrow(run, "b bigint, weight double, total double").groupBy("b").agg((F.sum("total") / F.nullif(F.sum("weight"), F.lit(0.0))).alias("m"))
    cuts = means.agg(F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))
    point = rows.agg(F.count("*").alias("n"), F.avg("d").alias("mean"), F.min("d").alias("_min"), F.max("d").alias("_max"))
    same = F.col("_min") == F.col("_max")
    return point.crossJoin(F.broadcast(cuts)).select("n", "mean", F.when(same, F.col("_min")).otherwise(F.col("low")).alias("low"), F.when(same, F.col("_min")).otherwise(F.col("high")).alias("high"))  # one row each


def bootstrap_mean(df: DataFrame, value: str, key: str, resamples: int = 200, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the mean under Poisson resampling: each row's weight in a resample comes from a hash of seed, resample and key, so each task sums its own rows for all resamples."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("b"), F.col(key)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    steps, total, weight = [], 0.0, F.lit(0)
    for i in range(12):
        total += math.exp(-1) / math.factorial(i)
        steps.append(total)
    for t in steps:
        weight = weight + F.when(u > t, 1).otherwise(0)
    each = df.select(key, value).withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples)))).withColumn("w", weight)
    means = each.groupBy("b").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("m"))
    return means.agg(F.avg("m").alias("mean"), F.percentile("m", F.lit(alpha / 2)).alias("low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("high"))
