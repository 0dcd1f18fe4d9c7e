"""Searches for the smallest design: subsets with the population's ratio of classes that keep its scores and distributions.

A seed orders the illicit rows by (rank in their stratum, hash), so that each prefix takes strata in turn, and the benign
rows of each difficulty tercile by hash. A subset is a prefix of n illicit rows, with as many benign rows as the population
has for n, dealt to the terciles in proportion. Running sums over both orders judge every size of every seed in one pass: no
subset is ever drawn, and nothing is sorted whole (sums go by cells, see ``ordered``).
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.identifiers import draw
from strataweave.operators.ordered import running
from strataweave.operators.sampling import difficulty, quantile_cuts, tercile
from strataweave.session import written

TYPOLOGIES, BINS = 8, 10


@dataclass(frozen=True)
class Limits:
    """A subset is feasible with at least so many illicit rows, so much spread of their difficulty, so little divergence and change of F1, and all typologies."""

    rows: int = 100
    spread: float = 0.10
    kl_typology: float = 0.20
    kl_difficulty: float = 0.15
    f1: float = 0.05


def _number(seed: Column | int, key: Column) -> Column:
    return F.conv(F.substring(draw(seed, key), 1, 12), 16, 10).cast("bigint")


def _shares(names: Sequence[str]) -> list[Column]:
    whole = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return [(F.col(n) + 1e-9) / (whole + len(names) * 1e-9) for n in names]


def judged(df: DataFrame, seeds: Sequence[int], tau: float, limits: Limits = Limits()) -> DataFrame:
    """(seed, n_illicit, n_total, f1, d_f1, kl_typology, kl_difficulty, spread, typologies, feasible) for every size of every seed.

    df has row_id, label, p, typology (-1: none). Without an illicit row the result is empty.
    """
    rows = written(df.select("row_id", "label", "p", "typology").withColumns({"difficulty": difficulty(F.col("p")), "hit": (F.col("p") >= tau).cast("bigint")}), "design-rows")
    ill, ben = rows.where("label = 1"), rows.where("label = 0")
    binned = F.least(F.floor(F.col("difficulty") * BINS), F.lit(BINS - 1))
    flags = {f"t{i}": (F.col("typology") == i).cast("bigint") for i in range(TYPOLOGIES)} | {f"b{i}": (binned == i).cast("bigint") for i in range(BINS)}
    whole = rows.agg(F.count("*").alias("n"), F.sum(F.col("hit") * (1 - F.col("label"))).alias("fp"), F.sum("label").alias("ill"), F.sum(F.col("hit") * F.col("label")).alias("tp"), *[F.coalesce(F.sum(c * F.col("label")), F.lit(0)).alias(n) for n, c in flags.items()]).first()  # one row
    if not whole["ill"]:
        return df.sparkSession.createDataFrame([], "seed int, n_illicit bigint, n_total bigint, f1 double, d_f1 double, kl_typology double, kl_difficulty double, spread double, typologies int, feasible boolean")
    n, n_ill, n_ben = whole["n"], whole["ill"], whole["n"] - whole["ill"]
    full_f1 = 2 * whole["tp"] / (whole["tp"] + whole["fp"] + n_ill) if whole["tp"] else 0.0
    each = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")

    cut = lambda part: part.crossJoin(F.broadcast(quantile_cuts(part, "difficulty"))).withColumn("third", tercile(F.col("difficulty"), F.col("cuts"))).drop("cuts")  # noqa: E731  one row
    cell = F.shiftright("_h", 40)  # 256 cells of a hash of 48 bits
    drawn = cut(ill).select("*", each).withColumns({"stratum": F.col("typology") * 3 + F.col("third"), "_h": _number(F.col("seed"), F.col("row_id"))})
    drawn = written(drawn.select("seed", "stratum", "_h", "hit", "difficulty", "typology"), "design-illicit")
    taken = written(running(drawn, "_h", {"_r": F.lit(1)}, ["seed", "stratum"], cell=cell), "design-ranks").withColumn("_place", F.col("_r").cast("decimal(20,0)") * F.lit(1 << 48) + F.col("_h"))
    sums = {"n_illicit": F.lit(1), "tp": F.col("hit"), "_d": F.col("difficulty"), "_dd": F.col("difficulty") * F.col("difficulty"), **flags}
    prefixes = written(running(taken, "_place", sums, ["seed"]).select("seed", *sums), "design-prefixes")
    thirds = cut(ben).select("row_id", "hit", "third")
    pools = {r["third"]: r["count"] for r in thirds.groupBy("third").count().collect()}  # three rows
    benign = written(thirds.select("*", each).select("seed", "third", "hit", _number(F.col("seed"), F.col("row_id")).alias("_h")), "design-benign")
    hits = written(running(benign, "_h", {"_r": F.lit(1), "fp": F.col("hit")}, ["seed", "third"], cell=cell).select("seed", "third", "_r", "fp"), "design-hits")

    out = prefixes.withColumn("n_benign", F.least(F.expr(f"n_illicit * {n} div {n_ill}") - F.col("n_illicit"), F.lit(n_ben)))
    before, fp = 0, F.lit(0)
    for third in (1, 2, 3):
        upto = before + pools.get(third, 0)
        out = out.withColumn("_take", F.expr(f"n_benign * {upto} div {max(n_ben, 1)} - n_benign * {before} div {max(n_ben, 1)}"))
        out = out.join(hits.where(F.col("third") == third).select("seed", F.col("_r").alias("_take"), F.col("fp").alias(f"_fp{third}")), ["seed", "_take"], "left").drop("_take")
        before, fp = upto, fp + F.coalesce(F.col(f"_fp{third}"), F.lit(0))
    kl = lambda names: sum((s * F.log(s / F.lit((whole[c] + 1e-9) / (sum(whole[x] for x in names) + len(names) * 1e-9))) for s, c in zip(_shares(names), names)), F.lit(0.0))
    typed, bins = [f"t{i}" for i in range(TYPOLOGIES)], [f"b{i}" for i in range(BINS)]
    k = F.col("n_illicit")
    out = out.withColumns({"f1": F.coalesce(F.try_divide((2 * F.col("tp")).cast("double"), F.col("tp") + fp + k), F.lit(0.0)), "kl_typology": kl(typed), "kl_difficulty": kl(bins), "spread": F.sqrt(F.greatest(F.col("_dd") / k - F.pow(F.col("_d") / k, F.lit(2)), F.lit(0.0))), "typologies": sum(((F.col(c) > 0).cast("int") for c in typed), F.lit(0))})
    out = out.withColumn("d_f1", F.abs(F.col("f1") - full_f1))
    fits = (k >= min(limits.rows, n_ill)) & (F.col("spread") >= limits.spread) & (F.col("kl_typology") <= limits.kl_typology) & (F.col("kl_difficulty") <= limits.kl_difficulty) & (F.col("d_f1") <= limits.f1) & (F.col("typologies") >= sum(whole[c] > 0 for c in typed))
    return out.select("seed", "n_illicit", (k + F.col("n_benign")).alias("n_total"), "f1", "d_f1", "kl_typology", "kl_difficulty", "spread", "typologies", fits.alias("feasible"))


def exhaustive(table: DataFrame, probe: Sequence[int], scan: Sequence[int], confirm: Sequence[int], least: int) -> DataFrame:
    """The smallest feasible number of illicit rows, from a table of ``judged`` that is written.

    1. Bisection in steps of the geometric mean narrows the border with the seeds of ``probe``. 2. All sizes from 95% of its
    lower to 105% of its upper end are looked through upwards with the seeds of ``scan``; the first feasible one is the minimum.
    3. The seeds of ``confirm`` say how often a draw of that size is feasible; the first such seed is taken, else the first of ``scan``.
    One row, or none where nothing is feasible; each probe reads the counts of one size.
    """
    of = lambda seeds: F.count_if(F.col("feasible") & F.col("seed").isin(list(seeds)))
    first = lambda seeds: F.min(F.when(F.col("feasible") & F.col("seed").isin(list(seeds)), F.col("seed")))
    sizes = written(table.groupBy("n_illicit").agg(of(probe).alias("probed"), of(scan).alias("scanned"), of(confirm).alias("confirmed"), F.coalesce(first(confirm), first(scan)).alias("seed")), "design-sizes")
    most = sizes.agg(F.max("n_illicit")).first()[0]
    if most is None:
        return table.limit(0).select("n_illicit", "n_total", "seed", "f1", "d_f1", "kl_typology", "kl_difficulty", F.lit(0.0).alias("p_feasible"), F.lit(0).alias("probes"), F.lit(0).alias("scan_from"), F.lit(0).alias("scan_to"))
    least = min(least, most)
    low, high, probes = least, most, 0
    while high - low > max(2, int((most - least) * 0.01)):
        middle = max(low + 1, min(high - 1, math.isqrt(low * high)))
        found, probes = sizes.where(F.col("n_illicit") == middle).first()["probed"], probes + 1
        low, high = (low, middle) if found else (middle, high)
    start, stop = max(least, low * 95 // 100), min(most, high * 105 // 100 + 1)
    best = sizes.where(F.col("n_illicit").between(start, stop) & (F.col("scanned") > 0)).orderBy("n_illicit").limit(1)
    row = best.withColumn("p_feasible", F.col("confirmed") / len(confirm)).select("n_illicit", "seed", "p_feasible")
    more = {"probes": F.lit(probes), "scan_from": F.lit(start), "scan_to": F.lit(stop)}
    return table.join(F.broadcast(row), ["n_illicit", "seed"]).withColumns(more).select("n_illicit", "n_total", "seed", "f1", "d_f1", "kl_typology", "kl_difficulty", "p_feasible", "probes", "scan_from", "scan_to")  # one row


def constrained(table: DataFrame, rounds: int, batch: int, seeds: Sequence[int], least: int, seed: int = 0) -> DataFrame:
    """(round, trial, n_illicit, seed, n_total, feasible, best): a search by rounds of trials, each one join with the written table of ``judged``.

    A round draws ``batch`` sizes, log-uniform between the lower end and the smallest feasible size so far, each with a seed of its
    own; the lower end rises to half of the sizes that failed by a quantile, so that rounds halve the range where trials are spent. best
    marks the trial with the smallest feasible subset (ties: the earlier one).
    """
    most = table.agg(F.max("n_illicit")).first()[0]
    low, high, out = min(least, most or 0), most, None
    if most is None:
        return table.limit(0).select(F.lit(0).alias("round"), F.lit(0).alias("trial"), "n_illicit", "seed", "n_total", "feasible", F.col("feasible").alias("best"))
    for r in range(rounds):
        trials = table.sparkSession.range(batch).select(F.lit(r).alias("round"), F.col("id").cast("int").alias("trial"))
        u = lambda what: _number(seed, F.concat_ws("|", F.lit(what), "round", "trial")) / F.lit(float(1 << 48))
        size = F.least(F.lit(high), F.floor(F.exp(F.lit(math.log(low)) + u("size") * (math.log(high + 1) - math.log(low))))).cast("bigint")
        which = F.element_at(F.array(*[F.lit(s) for s in seeds]), (F.floor(u("seed") * len(seeds)) + 1).cast("int"))
        got = written(table.join(F.broadcast(trials.withColumns({"n_illicit": size, "seed": which})), ["n_illicit", "seed"]).select("round", "trial", "n_illicit", "seed", "n_total", "feasible"), "design-trials")  # ``batch`` rows
        out = got if out is None else out.unionByName(got)
        good, bad = got.agg(F.min(F.when(F.col("feasible"), F.col("n_illicit"))), F.percentile(F.when(~F.col("feasible"), F.col("n_illicit")), 0.5)).first()
        high = min(high, good or high)
        low = max(low, min(high, int(bad or low) // 2))
    best = out.where("feasible").agg(F.min(F.struct("n_total", "round", "trial")).alias("_b"))
    marked = out.crossJoin(F.broadcast(best))  # one row
    return marked.withColumn("best", F.coalesce((F.col("_b.round") == F.col("round")) & (F.col("_b.trial") == F.col("trial")), F.lit(False))).drop("_b")
