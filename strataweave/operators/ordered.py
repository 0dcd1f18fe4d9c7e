"""Running sums, ranks and quantiles over an order that a whole table shares, without a window over the whole table.

Values are cut into at most ``FINE * FINE`` cells by approximate quantiles, which only balance the cells: any cuts give
the same results. Cells are summed first; the sums of the cells before, a few hundred rows for each group, are added to
a window inside each cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strataweave.session import written

FINE = 16


def with_cell(df: DataFrame, value: str, name: str = "_cell") -> DataFrame:
    """Adds the number of the cell of ``value``: equal values share one, and cells ascend with values. Null has cell -1."""
    shares, v = [i / FINE**2 for i in range(1, FINE**2)], F.col(value).cast("double")
    all_cuts = df.agg(F.percentile_approx(v, shares, 5000).alias("_c"))
    first = F.transform(F.sequence(F.lit(1), F.lit(FINE - 1)), lambda i: F.element_at("_c", i * FINE))
    fine = F.transform(F.sequence(F.lit(0), F.lit(FINE - 1)), lambda i: F.slice("_c", i * FINE + 1, F.lit(FINE - 1)))
    cuts = all_cuts.select(F.when(F.col("_c").isNotNull(), F.struct(first.alias("first"), fine.alias("fine"))).alias("_cuts"))
    below = lambda part: F.size(F.filter(part, lambda c: c <= v))
    # one element, so that the coarse place is found once and not wherever it is used
    found = F.transform(F.array(below(F.col("_cuts.first"))), lambda i: i * FINE + below(F.element_at(F.col("_cuts.fine"), i + 1)))[0]
    cell = F.when(F.col(value).isNull(), -1).when(F.col("_cuts").isNull(), 0).otherwise(found)
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, cell.cast("int")).drop("_cuts")  # one row


def running(df: DataFrame, order: str, sums: dict[str, Column], by: Sequence[str] = (), descending: bool = False, inclusive: bool = True, cell: Column | None = None) -> DataFrame:
    """Adds the running sums over rows in the order of ``order``, which must be distinct within each group of ``by``; the row itself included or not.

    Where ``order`` is spread evenly, as a hash is, its cell may be given: a number that ascends with it.
    """
    cells = with_cell(df, order) if cell is None else df.withColumn("_cell", cell.cast("int"))
    totals = cells.groupBy(*by, "_cell").agg(*[F.sum(c).alias(f"_of_{n}") for n, c in sums.items()])
    down = lambda c: F.desc(c) if descending else F.asc(c)
    before = Window.partitionBy(*by).orderBy(down("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_cell", *[F.coalesce(F.sum(f"_of_{n}").over(before), F.lit(0)).alias(f"_before_{n}") for n in sums])
    inside = Window.partitionBy(*by, "_cell").orderBy(down(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    out = cells.join(totals, [*by, "_cell"])
    return out.withColumns({n: F.col(f"_before_{n}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).select(*df.columns, *sums)


def counted(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, value, n, less): each distinct value, how often it stands there, and how many rows have a smaller one."""
    return running(df.groupBy(*by, value).agg(F.count("*").alias("n")), value, {"less": F.col("n")}, by, inclusive=False)


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, cuts): exact quantiles, interpolated between the two rows next to the place ``share * (n - 1)``; nulls are left out."""
    values = written(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")), "values")
    at = written(running(values, value, {"less": F.col("n")}, by, inclusive=False), "ranks")
    whole = at.groupBy(*by).agg(F.sum("n").alias("_all"))
    at = at.join(whole, list(by)) if by else at.crossJoin(F.broadcast(whole))  # one row
    place = [F.lit(float(s)) * (F.col("_all") - 1) for s in shares]
    holds = lambda i: (F.col("less") <= i) & (i < F.col("less") + F.col("n"))
    near = [F.max(F.when(holds(f(p)), F.col(value))).alias(f"_{i}_{side}") for i, p in enumerate(place) for side, f in (("low", F.floor), ("high", F.ceil))]
    got = at.groupBy(*by).agg(F.max("_all").alias("_all"), *near)
    cuts = [F.col(f"_{i}_low") + (p - F.floor(p)) * (F.col(f"_{i}_high") - F.col(f"_{i}_low")) for i, p in enumerate(place)]
    return written(got.select(*by, F.array(*[c.cast("double") for c in cuts]).alias("cuts")), "cuts")
