"""Identifiers of nodes, edges and cases, file-order splits, deterministic draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The prefixes of case names, the present and the former one.
PREFIX, FORMER = "amlc_", "v2_"
CASE = rf"^({PREFIX}|{FORMER})(\d+)$"


def node_id(bank: Column, account: Column) -> Column:
    return F.concat_ws("_", F.trim(bank.cast("string")), F.trim(account.cast("string")))


def edge_id(row: Column) -> Column:
    return F.concat(F.lit("e_"), row.cast("string"))


def match_key(*columns: Column) -> Column:
    return F.concat_ws(",", *[F.trim(c.cast("string")) for c in columns])


def case_id(number: Column, prefix: str = PREFIX) -> Column:
    """The prefix with at least five digits."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(digits) < 5, F.lpad(digits, 5, "0")).otherwise(digits))


def case_number(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, CASE, 2), F.lit("")).cast("bigint")


def canonical_case(name: Column) -> Column:
    return case_id(case_number(name))


def retag(text: Column, old: str = FORMER, new: str = PREFIX) -> Column:
    """Replaces the prefix of whole tokens that are case numbers of five digits or more; tokens inside longer words stay."""
    return F.regexp_replace(text, rf"(?<![A-Za-z0-9_]){old}(\d{{5,}})(?![A-Za-z0-9_])", f"{new}$1")


def retag_count(text: Column, old: str = FORMER) -> Column:
    return F.regexp_count(text, F.lit(rf"(?<![A-Za-z0-9_]){old}(\d{{5,}})(?![A-Za-z0-9_])"))


def split_bounds(n: int, train: float = 0.6, val: float = 0.2) -> tuple[int, int]:
    return int(n * train), int(n * (train + val))


def split_label(row: Column, bounds: tuple[int, int]) -> Column:
    """By position in the file, never by time: timestamps overlap across the parts."""
    return F.when(row < bounds[0], "train").when(row < bounds[1], "val").otherwise("test")


def draw(seed: int | str | Column, *key: Column) -> Column:
    """A pseudo-random order that any engine repeats: md5 of seed and key."""
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", seed.cast("string"), *[k.cast("string") for k in key]))


def numbered(distinct: DataFrame, column: str, width: int = 4096) -> DataFrame:
    """Adds idx, the place of each value of a distinct integer column in ascending order, from 0.

    Cells of ``width`` neighbouring values are counted first; only their counts meet in one task, and each cell is
    numbered by itself.
    """
    cell = distinct.withColumn("_cell", F.floor(F.col(column) / width))
    counts = cell.groupBy("_cell").count()
    before = counts.select("_cell", F.coalesce(F.sum("count").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy(column)) - 1
    return cell.join(before, "_cell").withColumn("idx", (F.col("_before") + inside).cast("bigint")).drop("_cell", "_before")
