"""Comparisons and means in which NaN never qualifies.

Spark orders NaN above every number, so a bare ``c >= 9`` keeps NaN rows; survey
cuts must drop them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ge_num(c: Column, bound: float) -> Column:
    """c >= bound, false for NaN; the bare comparison is still pushed to the scan."""
    return (c >= F.lit(bound)) & ~F.isnan(c)


def gt_num(c: Column, bound: float) -> Column:
    """c > bound, false for NaN."""
    return (c > F.lit(bound)) & ~F.isnan(c)


def avg_num(c: Column) -> Column:
    """Mean over the values that are neither null nor NaN."""
    return F.avg(F.nanvl(c, F.lit(None).cast("double")))


def share(part: Column, whole: Column) -> Column:
    """100 * part / whole, null when whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)
