"""Checks of tables against rules and against each other. Each gives rows with the reason, or counts; ``accepted`` raises if any is not zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a part, about, where groups are as many as rows.
ROWS = 200_000


def accepted(report: DataFrame, counts: Sequence[str]) -> DataFrame:
    """The report if all its counts are zero; else an error with the first rows that break a rule."""
    bad = report.where(" or ".join(f"`{c}` > 0" for c in counts)).limit(5).collect()
    if bad:
        raise ValueError(f"rejected: {[r.asDict() for r in bad]}")
    return report


def set_relation(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """(both_sides, left_only, right_only, equal) of the distinct keys; null keys are a key of their own."""
    sides = left.select(*key).distinct().withColumn("_s", F.lit(1)).union(right.select(*key).distinct().withColumn("_s", F.lit(2)))
    each = sides.groupBy(*key).agg(F.sum("_s").alias("_s"))
    return each.agg(F.count_if(F.col("_s") == 3).alias("both_sides"), F.count_if(F.col("_s") == 1).alias("left_only"), F.count_if(F.col("_s") == 2).alias("right_only"), (F.count_if(F.col("_s") != 3) == 0).alias("equal"))


def one_to_one(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """(left_only, right_only, left_repeated, right_repeated, matched) of the keys: all but the last are zero where the tables pair one to one."""
    sides = left.select(*key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).union(right.select(*key, F.lit(0), F.lit(1)))
    each = sides.groupBy(*key).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    l, r = F.col("_l"), F.col("_r")
    return each.agg(F.count_if(r == 0).alias("left_only"), F.count_if(l == 0).alias("right_only"), F.count_if(l > 1).alias("left_repeated"), F.count_if(r > 1).alias("right_repeated"), F.count_if((l == 1) & (r == 1)).alias("matched"))


def lockstep(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """For each shared column how many rows of the same key differ, nulls being equal; and how many keys have one side only."""
    columns = [c for c in left.columns if c in right.columns and c not in key]
    l = left.select(*key, F.struct(*columns).alias("_l"))
    both = l.join(right.select(*key, F.struct(*columns).alias("_r")), list(key), "full_outer")
    paired = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    return both.agg(F.count_if(~paired).alias("unpaired"), *[F.count_if(paired & ~F.col(f"_l.{c}").eqNullSafe(F.col(f"_r.{c}"))).alias(c) for c in columns])


def probability_violations(df: DataFrame, p: str) -> DataFrame:
    """Adds violation: missing, not a number, out of range, or null where the probability is sound."""
    c = F.col(p)
    return df.withColumn("violation", F.when(c.isNull(), "missing").when(F.isnan(c), "not a number").when((c < 0) | (c > 1), "out of range"))


def prediction_report(cases: DataFrame, found: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, unknown, repeated, no_verdict, accepted, missing) of predictions (by, case_id, verdict) against the cases (case_id).

    Nearly every row is a group of its own, so rows are dealt by case into parts of about ROWS before they are grouped.
    """
    many = max(8, min(2048, (found.count() + cases.count()) // ROWS))
    known = cases.select("case_id").repartition(many, "case_id").distinct().withColumn("_known", F.lit(True))
    each = found.select(*by, "case_id", "verdict").repartition(many, "case_id").groupBy(*by, "case_id").agg(F.count("*").alias("_n"), F.count("verdict").alias("_v")).join(known, "case_id", "left")
    is_known, once = F.col("_known").isNotNull(), F.col("_n") == 1
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("_n"))), F.lit(0))
    got = each.groupBy(*by).agg(total(~is_known).alias("unknown"), total(is_known & ~once).alias("repeated"), total(is_known & once & (F.col("_v") == 0)).alias("no_verdict"), total(is_known & once & (F.col("_v") == 1)).alias("accepted"), F.count_if(is_known).alias("_covered"))
    return got.crossJoin(F.broadcast(known.agg(F.count("*").alias("_cases")))).withColumn("missing", F.col("_cases") - F.col("_covered")).drop("_cases", "_covered")  # one row


def binary_violations(df: DataFrame, flags: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Adds violation for judges' and raters' sheets: a key that is missing or repeated, or a flag other than 0 and 1."""
    times = df.groupBy(*key).agg(F.count("*").alias("_times"))
    joined = df.join(times, list(key), "left")
    bad = F.when(F.greatest(*[F.col(k).isNull().cast("int") for k in key], F.lit(0)) == 1, "missing key").when(F.col("_times") > 1, "repeated key")
    for f in flags:
        bad = bad.when(~F.coalesce(F.col(f).cast("string").isin("0", "1"), F.lit(False)), f"{f} is not 0 or 1")
    return joined.withColumn("violation", bad).drop("_times")
