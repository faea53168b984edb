"""Running and trailing sums over a series.

All windows share one specification, ``PARTITION BY id ORDER BY t``, so a query shuffles and sorts
its series once.  Trailing windows are differences of running sums, which cost O(1) a row whatever
their width; feed them z-scores or integers, as sums of large values lose digits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def series():
    return Window.partitionBy("id").orderBy("t")


def so_far():
    return series().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running(c) -> Column:
    """Sum of all values so far."""
    return F.sum(c).over(so_far())


def running_max(c) -> Column:
    return F.max(c).over(so_far())


def running_min(c) -> Column:
    return F.min(c).over(so_far())


def previous(c, k: int = 1) -> Column:
    return F.lag(c, k).over(series())


def with_running(df: DataFrame, **columns: Column) -> DataFrame:
    """Add running sums under the given names."""
    return df.withColumns({name: running(c) for name, c in columns.items()})


def trailing(total: str, width: int) -> Column:
    """Sum over the last ``width`` rows from a running sum's column."""
    return F.col(total) - F.coalesce(F.lag(total, width).over(series()), F.lit(0.0))


def reflected(total: str) -> Column:
    """A one-sided CUSUM from the running sum of its increments: the walk reflected at zero."""
    return F.col(total) - F.least(F.lit(0.0), running_min(total))


def smoothed(c, alpha: float) -> Column:
    """EWMA seeded with the first value, e = q e + alpha x, over rows numbered by t from 0.

    The closed form, q^t times the running sum of alpha x q^-t, overflows, so it restarts every B rows
    with q^B about 1e-100 and carries the sum of the block before on.  Older blocks weigh less than
    1e-100, far below a double's last digit.
    """
    q = 1 - alpha
    size = max(1, int(-100 * math.log(10) / math.log(q)))
    block, at = F.floor(F.col("t") / size), F.col("t") % size
    part = F.when(F.col("t") == 0, c).otherwise(alpha * c * F.pow(F.lit(1 / q), at))
    rows = Window.partitionBy("id").orderBy(block)
    own = F.sum(part).over(Window.partitionBy("id", block).orderBy("t").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    before = F.sum(part * F.lit(q) ** size).over(rows.rangeBetween(-1, -1))
    return F.pow(F.lit(q), at) * (own + F.coalesce(before, F.lit(0.0)))


def at_least(c, floor: float) -> Column:
    return F.greatest(c, F.lit(floor))


def clip(c, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def safe_log(c) -> Column:
    return F.log(at_least(c, 1e-12))
