"""Which scorer decides: deferral rules, gates and their sweeps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.ratios import f1
from strataweave.operators import metrics as M

RECALL_GATES, PRECISION_GATES = np.arange(0.001, 0.5, 0.005), np.arange(0.5, 0.99, 0.005)
BAND = 0.10


def is_census(weight: Column) -> Column:
    return weight <= 1.01


def consults(rule: str, weight: Column, ml: Column, p: Column, tau: float, other: Column) -> Column:
    """Whether a rule asks the external model about a row."""
    census = is_census(weight)
    doubt, close = census & (ml == 0), census & (F.abs(p - tau) < BAND)
    return {"dt": doubt, "confidence": close, "union": doubt | close, "disagree": census & (ml != other)}[rule]


def routed(asked: Column, ml: Column, other: Column) -> tuple[Column, Column]:
    """The final verdict and the route that it took."""
    pred = F.when(asked, other).otherwise(ml)
    route = F.when(asked & (other == 1), "llm_flipped").when(asked, "llm_legit").when(ml == 1, "ml_illicit").otherwise("ml_legit")
    return pred, route


def evaluate(df: DataFrame, rule: str, tau: float, classes: DataFrame, by: Sequence[str] = (), weight: str = "w") -> DataFrame:
    """(by, n_consult, consult_ratio, precision, recall, f1, typ_macro_f1, typ_accuracy), weighted, of a rule over rows (label, typology, p, ml, ml_typology, pred, pred_typology, weight).

    A true positive takes its typology from the scorer that flagged it: the external model where it was asked, else the
    head of the first one. Negative numbers and null name no class.
    """
    asked = consults(rule, F.col(weight), F.col("ml"), F.col("p"), tau, F.col("pred"))
    x = df.withColumns({"_asked": asked, "_final": routed(asked, F.col("ml"), F.col("pred"))[0]})
    named = F.when(F.col("_asked"), F.col("pred_typology")).when(F.col("ml") == 1, F.col("ml_typology"))
    hits = x.where("_final = 1 and label = 1").select(*by, F.col(weight), F.when(F.col("typology") >= 0, F.col("typology")).alias("_truth"), F.when(named >= 0, named).alias("_named"))
    asks = x.groupBy(*by).agg(F.count_if("_asked").alias("n_consult"), (F.count_if("_asked") / F.count("*")).alias("consult_ratio"))
    rates = M.prf(x, by, predicted="_final", weight=weight).select(*by, "precision", "recall", "f1")
    typ = M.weighted_typology(hits, "_truth", "_named", classes, weight, by)
    met = asks.join(rates, list(by)).join(typ, list(by), "left") if by else asks.crossJoin(F.broadcast(rates)).join(F.broadcast(typ), F.lit(True), "left")  # one row each
    return met.na.fill(0.0, ["typ_macro_f1", "typ_accuracy"])


def gate_sweep(df: DataFrame, kind: str, taus: Sequence[float], threshold: float, by: Sequence[str] = (), label: str = "label", p: str = "p", other: str = "pred", weight: Column | None = None) -> DataFrame:
    """(by, tau, consulted, tp, fp, fn, f1) for each gate; recall gates flip rows of tau <= p < threshold to illicit, precision gates those of threshold <= p < tau to benign.

    Rows are summed by their place among the taus, their side and verdict; the sweep is then a running sum over the
    gates, so it moves a few rows for each gate and not a copy of the input.
    """
    from pyspark.sql.window import Window

    from strataweave.operators.metrics import grid_index

    w = F.lit(1.0) if weight is None else weight
    score, up = F.col(p), kind == "recall"
    y, flips = F.col(label) == 1, F.col(other) == (1 if up else 0)
    side = score < threshold if up else score >= threshold
    total = lambda c: F.sum(F.when(c, w).otherwise(0.0))
    place = df.withColumn("_i", grid_index(score, taus)).groupBy(*by, "_i").agg(
        F.count_if(side).alias("asked"), total(side & flips & y).alias("flip_pos"), total(side & flips & ~y).alias("flip_neg"), total((score >= threshold) & y).alias("pos"), total((score >= threshold) & ~y).alias("neg"), total(y).alias("all_pos")
    )
    sums = ["asked", "flip_pos", "flip_neg", "pos", "neg", "all_pos"]
    marks = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(taus)], "_i int, tau double")
    if by:
        marks = df.select(*by).distinct().crossJoin(F.broadcast(marks))  # a row for each gate and group
    marks = marks.select(*by, "_i", "tau", *[F.lit(0).alias(s) for s in sums])
    rows = place.withColumn("tau", F.lit(None).cast("double")).unionByName(marks)
    # A row at place i has p >= the first i taus: a recall gate tau_j asks those of place >= j, a precision gate those of place < j.
    at = Window.partitionBy(*by).orderBy("_i")
    near = at.rangeBetween(Window.currentRow, Window.unboundedFollowing) if up else at.rangeBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    run = rows.select(*by, "tau", *[F.coalesce(F.sum(s).over(near), F.lit(0)).alias(s) for s in ("asked", "flip_pos", "flip_neg")], *[F.sum(s).over(whole).alias(s) for s in ("pos", "neg", "all_pos")]).where("tau is not null")
    sign = 1 if up else -1
    out = run.select(*by, "tau", F.col("asked").cast("bigint").alias("consulted"), (F.col("pos") + sign * F.col("flip_pos")).alias("tp"), (F.col("neg") + sign * F.col("flip_neg")).alias("fp"), "all_pos").withColumn("fn", F.col("all_pos") - F.col("tp")).drop("all_pos")
    return out.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def gate_summary(sweeps: dict[str, DataFrame], df: DataFrame, by: Sequence[str], weight: str, label: str = "label", ml: str = "ml", other: str = "pred") -> DataFrame:
    """(by, gate, tau, f1, consulted, ml_f1, other_f1, delta): the best tau of each kind of gate and what it gains over the first scorer alone; consulted is the share of rows asked."""
    alone = lambda c, name: M.prf(df, by, label, c, weight).select(*by, F.col("f1").alias(name))
    base = alone(ml, "ml_f1").join(alone(other, "other_f1"), list(by)).join(df.groupBy(*by).agg(F.count("*").alias("_n")), list(by))
    best = None
    for gate, sweep in sweeps.items():
        at = F.struct(F.col("f1"), -F.col("tau"))
        one = sweep.groupBy(*by).agg(F.max_by("tau", at).alias("tau"), F.max("f1").alias("f1"), F.max_by("consulted", at).alias("_asked")).withColumn("gate", F.lit(gate))
        best = one if best is None else best.unionByName(one)
    return best.join(base, list(by)).select(*by, "gate", "tau", "f1", (F.col("_asked") / F.col("_n")).alias("consulted"), "ml_f1", "other_f1", (F.col("f1") - F.col("ml_f1")).alias("delta"))


def fused(p: Column, tau: float, other: Column) -> dict[str, Column]:
    """or, and, and the doubt band around tau, clamped to [.05, .95], in which the other scorer decides."""
    lo, hi = max(0.05, tau - BAND), min(0.95, tau + BAND)
    band = (p >= lo) & (p < hi)
    own = (p >= tau).cast("int")
    return {"either": F.greatest(own, other), "both": F.least(own, other), "gate": F.when(band, other).otherwise(own), "doubt": ((p >= hi) | (band & (other == 1))).cast("int")}
