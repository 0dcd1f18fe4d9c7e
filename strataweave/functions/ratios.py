"""The two policies for an empty denominator, and intervals of a share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the two-sided 95% quantile of the normal distribution.
Z95 = 1.959963984540054


def ratio0(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0: the rule for precision, recall and F1."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def ratio_null(a: Column, b: Column) -> Column:
    """a / b, and null where b is 0: the rule for rates."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio0(2 * tp, 2 * tp + fp + fn)


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval; (0, 0) without trials."""
    p, wide = ratio0(k, n), F.lit(z * z)
    n1 = F.greatest(n.cast("double"), F.lit(1.0))
    centre, scale = p + wide / (2 * n1), 1 + wide / n1
    half = F.lit(z) * F.sqrt(p * (1 - p) / n1 + wide / (4 * n1 * n1))
    return tuple(F.when(n > 0, (centre + s * half) / scale).otherwise(F.lit(0.0)) for s in (-1, 1))
