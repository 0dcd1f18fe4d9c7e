"""Recomputes the weights of an archived sample from its realised strata, and checks the strata against the archived weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataweave.operators import sampling as S
from strataweave.session import written

#: Fixed value: more weights above the usual one than this can't come from filling up a sample.
MOST_FILL = 8


def recompute(population: DataFrame, archive: DataFrame, key: str = "row_id") -> DataFrame:
    """The archive (key, weight) with label, stratum, pool, n and fixed: the weight pool / n of its realised stratum, 1 for illicit rows.

    The hard stratum is taken whole, so its benign rows are those of weight 1, and the cut of the scores lies halfway between
    the smallest of them and the largest score of all other benign rows of the population (key, label, p). Raises where no
    benign row has weight 1, where the two are not apart, where the archive repeats a row, or where it has a row or a
    score that the population lacks. The population is read whole, the archive joins it once.
    """
    held = archive.select(key, F.col("weight").alias("archived"), F.lit(True).alias("_in"))
    rows = written(population.select(key, "label", "p").join(held, key, "full_outer").withColumn("_in", F.coalesce("_in", F.lit(False))), "archived")
    census = (F.col("label") == 0) & F.col("_in") & (F.col("archived") == 1)
    cut = S.infer_hard_cut(rows.withColumn("inside", F.coalesce(census, F.lit(False))))
    odd = rows.where("_in").agg(F.count_if(F.col("label").isNull() | F.col("p").isNull() | F.col("archived").isNull()).alias("unknown"), (F.count("*") - F.countDistinct(key)).alias("again"))
    found = cut.crossJoin(F.broadcast(odd)).first()  # one row each
    if found["unknown"] or found["again"]:
        raise ValueError(f"{found['unknown']} archived rows without label, score or weight in the population, {found['again']} repeated")
    if found["min_inside"] is None:
        raise ValueError("no benign row carries weight 1: the cut can't be found")
    if found["max_outside"] is not None and found["cut"] is None:
        raise ValueError("the benign rows of weight 1 are not apart from the others by their scores")
    at = found["cut"] if found["cut"] is not None else found["min_inside"]
    strata = S.stratify(rows.where("label is not null"), 2 * at)
    sizes = strata.groupBy("stratum").agg(F.count("*").alias("pool"), F.count_if("_in").alias("n"))  # five rows
    fixed = F.when(F.col("stratum") == "illicit", F.lit(1.0)).otherwise(F.col("pool") / F.col("n"))
    return strata.where("_in").join(F.broadcast(sizes), "stratum").select(key, "label", "stratum", "pool", "n", "archived", fixed.alias("fixed"))


def report(repaired: DataFrame) -> DataFrame:
    """A row for each benign stratum: members, pool, distinct and modal archived weight, the weight that pool and members of the modal weight imply, members above and below the modal weight, rows where weight 1 and the hard stratum disagree, and what the repair changes."""
    benign = written(repaired.where("label = 0"), "repaired")
    modal = benign.groupBy("stratum").agg(F.mode("archived", True).alias("modal"))  # four rows
    w, m = F.col("archived"), F.col("modal")
    off = F.abs(w - F.col("fixed"))
    changed = off > 1e-9 + 1e-9 * F.abs(F.col("fixed"))
    got = benign.join(F.broadcast(modal), "stratum").groupBy("stratum").agg(
        F.count("*").alias("members"), F.max("pool").alias("pool"), F.countDistinct("archived").alias("weights"), F.max("modal").alias("modal"), (F.max("pool") / F.count_if(w == m)).alias("implied"),
        F.count_if(w > m).alias("fill"), F.count_if(w < m).alias("misassigned"), F.count_if((w == 1) != (F.col("stratum") == "hard_neg")).alias("census_off"), F.count_if(changed).alias("changed"), F.max(F.when(changed, off).otherwise(0.0)).alias("largest_change"),
    )
    fits = F.abs(F.col("modal") - F.col("implied")) <= 1e-9 * F.col("implied")
    return got.withColumn("consistent", fits & (F.col("misassigned") == 0) & (F.col("census_off") == 0) & (F.col("fill") <= MOST_FILL))


def accepted(repaired: DataFrame) -> DataFrame:
    """The repaired rows, if every stratum agrees with its archived weights; else raises with the strata that don't."""
    wrong = [r["stratum"] for r in report(repaired).where("NOT consistent").orderBy("stratum").collect()]  # four rows
    if wrong:
        raise ValueError(f"the strata {wrong} do not fit their archived weights")
    return repaired
