"""Held-out designs: strata and allocations fixed from the scorers that build a sample, judged on scorers it has not seen.

A design has a few rows (sampler, stratum, pool, n). All draws of all samplers come from one job and share their hashes;
what a draw finds is a count of flagged rows for each stratum and scorer, and all else follows from these counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataweave.functions.identifiers import draw
from strataweave.functions.ratios import ratio0
from strataweave.operators import sampling as S
from strataweave.operators.statistics import with_intervals
from strataweave.session import written

#: The names of the samplers.
SAMPLERS = ("uniform_ht", "difficulty_ht", "hard_terciles_ht")


def benign_strata(df: DataFrame, tau: Column, score: str = "p") -> DataFrame:
    """The benign rows, written, with ``strata``: an array of (sampler, stratum), one for each sampler.

    uniform_ht has one stratum; difficulty_ht the exact terciles of difficulty; hard_terciles_ht the rows whose score reaches half of
    the threshold and the terciles of the others. Rows without a score have no difficulty and fall into the last tercile.
    """
    hard = F.coalesce(F.col(score) >= tau / 2, F.lit(False))
    benign = written(df.where("label = 0").withColumns({"difficulty": S.difficulty(F.col(score)), "_hard": hard}), "benign")
    cuts = lambda part, name: S.quantile_cuts(part, "difficulty").agg(F.max("cuts").alias(name))
    both = benign.crossJoin(F.broadcast(cuts(benign, "_all"))).crossJoin(F.broadcast(cuts(benign.where("NOT _hard"), "_easy")))  # one row each
    third = lambda prefix, at: F.concat(F.lit(prefix), S.tercile(F.col("difficulty"), F.col(at)).cast("string"))
    names = (F.lit("benign"), third("difficulty_", "_all"), F.when(F.col("_hard"), "hard").otherwise(third("easy_", "_easy")))
    return both.withColumn("strata", F.array(*[F.struct(F.lit(s).alias("sampler"), n.alias("stratum")) for s, n in zip(SAMPLERS, names)])).drop("_all", "_easy", "_hard")


def allocate(strata: DataFrame, budget: int) -> DataFrame:
    """(sampler, stratum, pool, n), at most eight rows, each with n of at least 1: first shares, then the largest remainders of what they leave, in whole numbers.

    Raises where the budget does not allow a row of every stratum or exceeds the benign rows.
    """
    pools = strata.select(F.explode("strata").alias("s")).groupBy("s.sampler", "s.stratum").agg(F.count("*").alias("pool"))
    each, b = Window.partitionBy("sampler"), F.lit(budget).cast("bigint")
    hard, easy = F.col("stratum") == "hard", F.col("stratum").startswith("easy_")
    share = F.least("pool", F.greatest(F.lit(1), F.lit(int(0.3 * budget))), b - F.sum(easy.cast("int")).over(each))
    sized = pools.withColumn("_hard", F.coalesce(F.max(F.when(hard, share)).over(each), F.lit(0)))
    rest = F.when(easy, F.floor((b - F.col("_hard")) / 3)).otherwise(F.lit(budget // 3))
    first = F.when(F.col("stratum") == "benign", b).when(hard, F.col("_hard")).otherwise(F.least("pool", F.greatest(F.lit(1), rest)))
    sized = sized.withColumn("_first", first.cast("bigint")).withColumn("_room", F.col("pool") - F.col("_first")).withColumn("_left", b - F.sum("_first").over(each))
    sized = sized.withColumn("_total", F.nullif(F.sum("_room").over(each), F.lit(0)))
    whole, part = F.expr("coalesce(_left * _room div _total, 0)"), F.expr("coalesce(_left * _room % _total, 0)")
    sized = sized.withColumns({"_whole": whole, "_part": part})
    rank = F.row_number().over(each.orderBy(F.desc("_part"), F.desc(hard), "stratum"))
    more = (rank <= F.col("_left") - F.sum("_whole").over(each)).cast("int")
    design = written(sized.select("sampler", "stratum", "pool", (F.col("_first") + F.col("_whole") + more).cast("bigint").alias("n")), "design")
    wrong = design.groupBy("sampler").agg(F.min("n").alias("least"), F.max(F.col("n") - F.col("pool")).alias("over"), F.sum("n").alias("all")).where((F.col("least") < 1) | (F.col("over") > 0) | (F.col("all") != budget))
    if wrong.count() or not design.count():
        raise ValueError("the budget must allow a row of every stratum and not exceed the benign rows")
    return design


def draw_counts(strata: DataFrame, design: DataFrame, flags: str, draws: int, seed: int, key: str = "row_id") -> DataFrame:
    """(draw, sampler, stratum, pool, n, scorer, x): the rows that each scorer flags among those drawn; ``flags`` is an array of 0 and 1, a scorer's number its place.

    A draw takes the n rows of a stratum with the smallest hashes. Hashes over a bound that n rows stay below but for one
    in a million million are left out as they are made; should a stratum lack rows, the bound is doubled, up to all rows.
    """
    cells = design.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    parts = strata.select(key, F.col(flags).alias("_flags"), F.explode("strata").alias("_s")).select(key, "_flags", "_s.*").join(F.broadcast(design), ["sampler", "stratum"])  # eight rows
    number = F.conv(F.substring("_d", 1, 8), 16, 10).cast("bigint")
    near, scale = None, 1.0
    while near is None:
        share = (F.col("n") + 8 * F.sqrt("n") + 16) * scale / F.col("pool")
        tried = parts.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_d", draw(seed + 7919 * F.col("draw"), F.col(key)))
        tried = written(tried.where((share >= 1) | (number < F.floor(share * 2.0**32))).drop("pool", "n"), "drawn")
        found = tried.groupBy("draw", "sampler", "stratum").count()
        if cells.join(found, ["draw", "sampler", "stratum"], "left").where("count is null or count < n").isEmpty():
            near = tried
        scale *= 2
    taken = S.first_ranked(near, ["draw", "sampler", "stratum"], "_d", cells, "n")
    counted = taken.select("draw", "sampler", "stratum", F.posexplode("_flags").alias("scorer", "_x")).groupBy("draw", "sampler", "stratum", "scorer").agg(F.sum("_x").cast("bigint").alias("x"))
    return counted.join(F.broadcast(design), ["sampler", "stratum"])  # eight rows


def _metrics(fp: Column) -> dict[str, Column]:
    tp, pos = F.col("tp").cast("double"), F.col("pos").cast("double")
    return {"precision": ratio0(tp, tp + fp), "recall": ratio0(tp, pos), "f1": ratio0(2 * tp, tp + pos + fp)}


def evaluate_counts(counts: DataFrame, known: DataFrame, scorers: int, alpha: float = 0.05) -> DataFrame:
    """(draw, sampler, scorer, metric, estimate, lower, upper, truth) from the counts and (scorer, tp, pos, fp) of the whole test part.

    tp and pos are known, as every illicit row is taken. The exact intervals of the counts share alpha over all scorers and all strata
    of the sampler that are not taken whole, so that all hold at once; precision and F1 fall with the false positives.
    """
    random = counts.select("sampler", "stratum", "pool", "n").distinct().groupBy("sampler").agg((F.count_if(F.col("n") < F.col("pool")) * scorers).alias("_parts"))
    part = F.coalesce(F.try_divide(F.lit(alpha), F.col("_parts")), F.lit(alpha))
    bounds = with_intervals(counts.join(F.broadcast(random), "sampler"), part)  # three rows
    sums = bounds.groupBy("draw", "sampler", "scorer").agg(F.sum(F.col("pool") / F.col("n") * F.col("x")).alias("_fp"), F.sum("low").alias("_low"), F.sum("high").alias("_high"))
    at = sums.join(F.broadcast(known), "scorer")  # a row for each scorer
    point, lower, upper, truth = (_metrics(F.col(c)) for c in ("_fp", "_high", "_low", "fp"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), point[m].alias("estimate"), lower[m].alias("lower"), upper[m].alias("upper"), truth[m].alias("truth")) for m in point]))
    return at.select("draw", "sampler", "scorer", each.alias("_m")).select("draw", "sampler", "scorer", "_m.*")


def summary(evaluated: DataFrame, by: list[str]) -> DataFrame:
    """Over draws: truth, mean, bias, mean absolute and squared error, deviation, coverage of the intervals with its own error, and their mean width."""
    e = F.col("estimate") - F.col("truth")
    inside = ((F.col("lower") <= F.col("truth") + 1e-12) & (F.col("upper") >= F.col("truth") - 1e-12)).cast("double")
    found = evaluated.groupBy(*by).agg(
        F.count("*").alias("draws"), F.max("truth").alias("truth"), F.avg("estimate").alias("mean_estimate"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.stddev_samp("estimate").alias("sd"), F.avg(inside).alias("coverage"), F.avg(F.col("upper") - F.col("lower")).alias("mean_width"),
    )
    return found.withColumn("coverage_mcse", F.sqrt(F.col("coverage") * (1 - F.col("coverage")) / F.col("draws")))


def cell_points(rows: DataFrame, cell: str, run: str) -> DataFrame:
    """(cell, run, tp, fp, pos, total) and the gradients of precision, F1 and lift by the false positives, from a sample whose illicit rows are all taken.

    ``rows`` has, for each sampled row, cell and run: label, stratum, pool, n, pred.
    """
    weight = F.col("pool") / F.col("n")
    per = rows.groupBy(cell, run).agg(F.sum(F.col("pred") * F.col("label")).cast("double").alias("tp"), F.sum(F.when(F.col("label") == 0, F.col("pred") * weight).otherwise(0.0)).alias("fp"), F.sum("label").alias("pos"), F.round(F.sum(weight)).cast("bigint").alias("total"))
    tp, fp, pos = F.col("tp"), F.col("fp"), F.col("pos")
    gradient = -ratio0(tp, (tp + fp) * (tp + fp))
    return written(per.withColumns({"_precision": gradient, "_f1": -ratio0(2 * tp, (tp + pos + fp) * (tp + pos + fp)), "_lift": gradient * F.try_divide(F.col("total"), pos)}), "cell-points")


METRICS = ("precision", "recall", "f1", "lift")


def _levels(fp: Column) -> dict[str, Column]:
    m = _metrics(fp)
    return {**m, "lift": m["precision"] * F.try_divide(F.col("total"), F.col("pos"))}


def _deviations(values: DataFrame, by: list[str]) -> DataFrame:
    """The standard error of an estimated mean from the linearised values of sampled rows: variance within strata, less the share that was taken."""
    share = F.col("pool") * F.col("pool") * (1 - F.col("n") / F.col("pool")) / F.col("n")
    names = [m for m in METRICS if m != "recall"]
    within = values.groupBy(*by, "stratum", "pool", "n").agg(*[F.coalesce(F.var_samp(f"z_{m}"), F.lit(0.0)).alias(m) for m in names])
    total = within.groupBy(*by).agg(*[F.sqrt(F.sum(share * F.col(m))).alias(m) for m in names])
    return total.select(*by, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.lit(0.0) if m == "recall" else F.col(m)).alias("se")) for m in METRICS])).alias("_s")).select(*by, "_s.*")


def _linearised(rows: DataFrame, points: DataFrame, cell: str, run: str, key: str) -> DataFrame:
    gradients = F.broadcast(points.select(cell, run, "_precision", "_f1", "_lift"))  # a row for each cell and run
    return rows.where("label = 0").join(gradients, [cell, run]).groupBy(key, "stratum", "pool", "n", cell).agg(*[F.avg(F.col("pred") * F.col(f"_{m}")).alias(f"z_{m}") for m in ("precision", "f1", "lift")])


def _envelopes(rows: DataFrame, points: DataFrame, cell: str, run: str, comparisons: int, alpha: float) -> DataFrame:
    """(cell, metric, mean, run_sd, low, high): means over runs, their deviation, and means of the ends that hold for all counts at once."""
    benign = rows.where("label = 0").groupBy(cell, run, "stratum", "pool", "n").agg(F.sum("pred").cast("bigint").alias("x"))
    runs = points.groupBy(cell).agg(F.count("*").alias("_runs"))
    strata = rows.where("label = 0").select("stratum", "pool", "n").distinct().agg(F.count_if(F.col("n") < F.col("pool")).alias("_strata"))
    part = F.coalesce(F.try_divide(F.lit(alpha), comparisons * F.col("_runs") * F.col("_strata")), F.lit(alpha))
    ends = with_intervals(benign.join(F.broadcast(runs), cell).crossJoin(F.broadcast(strata)), part).groupBy(cell, run).agg(F.sum("low").alias("_low"), F.sum("high").alias("_high"))  # a row for each cell; one row
    at = points.join(ends, [cell, run])
    level, low, high = (_levels(F.col(c)) for c in ("fp", "_high", "_low"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), level[m].alias("v"), low[m].alias("a"), high[m].alias("z")) for m in METRICS]))
    long = at.select(cell, each.alias("_m")).select(cell, "_m.*")
    return long.groupBy(cell, "metric").agg(F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("run_sd"), F.avg("a").alias("low"), F.avg("z").alias("high"))


def cell_uncertainty(rows: DataFrame, cell: str, run: str, key: str = "row_id", alpha: float = 0.05) -> DataFrame:
    """(cell, metric, mean, run_sd, se, low, high, over_floor): metrics of each cell as means over its runs on one shared sample.

    se is that of the sampling alone, with the covariance between runs, as the values of all runs are linearised and added row by row
    before their variance is taken. over_floor is what the mean has over a scorer that flags everything.
    """
    points = cell_points(rows, cell, run)
    se = _deviations(_linearised(rows, points, cell, run, key), [cell])
    floor = points.groupBy(cell).agg(F.max("pos").alias("pos"), F.max("total").alias("total")).withColumn("tp", F.col("pos"))
    flat = _levels(F.col("total") - F.col("pos"))
    floors = floor.select(cell, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), flat[m].alias("floor")) for m in METRICS])).alias("_f")).select(cell, "_f.*")
    both = _envelopes(rows, points, cell, run, 1, alpha).join(se, [cell, "metric"]).join(floors, [cell, "metric"])
    return both.select(cell, "metric", "mean", "run_sd", "se", "low", "high", (F.col("mean") - F.col("floor")).alias("over_floor"))


def paired_contrast(rows: DataFrame, cell: str, run: str, first: str, second: str, key: str = "row_id", alpha: float = 0.05) -> DataFrame:
    """(metric, difference, se, low, high) of first less second on the same rows; equal predictions have se 0, as rows are subtracted before the variance.

    The intervals of both cells share alpha, and their ends are subtracted crosswise.
    """
    rows = rows.where(F.col(cell).isin(first, second))
    points = cell_points(rows, cell, run)
    values = _linearised(rows, points, cell, run, key)
    sign = F.when(F.col(cell) == first, 1).otherwise(-1)
    apart = values.groupBy(key, "stratum", "pool", "n").agg(*[F.sum(sign * F.col(f"z_{m}")).alias(f"z_{m}") for m in ("precision", "f1", "lift")])
    ends = _envelopes(rows, points, cell, run, 2, alpha)
    side = lambda which, c: F.max(F.when(F.col(cell) == which, F.col(c)))
    gap = ends.groupBy("metric").agg((side(first, "mean") - side(second, "mean")).alias("difference"), (side(first, "low") - side(second, "high")).alias("low"), (side(first, "high") - side(second, "low")).alias("high"))
    return gap.join(_deviations(apart, []), "metric").select("metric", "difference", "se", "low", "high")
