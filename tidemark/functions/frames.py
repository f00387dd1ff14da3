"""Ordered frames over one series: lags, rolling and forward aggregates with full-frame guards.

A rolling value exists only once its frame holds as many non-null values as it is long.
Flags are 0 or 1, and 0 where the comparison is unknown. All frames of one object share
their partitioning and order, so Spark sorts and shuffles once for all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

EPS = 1e-10


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def flag(condition: Column) -> Column:
    """1 if the condition holds, 0 if it does not or is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def ratio(a: str | Column, b: str | Column, eps: float = 0.0) -> Column:
    """``a / (b + eps)``, null where the divisor is zero."""
    below = col(b) + F.lit(eps) if eps else col(b)
    return col(a) / F.nullif(below.cast("double"), F.lit(0.0))


def correlation(a: str | Column, b: str | Column, frame: WindowSpec | None = None) -> Column:
    """Correlation of complete pairs, null where either side is constant; an aggregate, or over ``frame``."""
    x, y = F.when(col(b).isNotNull(), col(a).cast("double")), F.when(col(a).isNotNull(), col(b).cast("double"))
    parts = [F.covar_pop(x, y), F.stddev_pop(x), F.stddev_pop(y)]
    both, sx, sy = [p.over(frame) for p in parts] if frame else parts
    return both / F.nullif(sx * sy, F.lit(0.0))


class Frames:
    """Frames over rows of the same ``keys`` in the order of ``order``."""

    def __init__(self, keys: tuple[str, ...] = ("symbol",), order: tuple[str, ...] = ("ts",)) -> None:
        self.keys, self.order = keys, order

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def back(self, n: int) -> WindowSpec:
        """The row itself and the ``n - 1`` before it."""
        return self.window.rowsBetween(-(n - 1), 0)

    def before(self, n: int) -> WindowSpec:
        """The ``n`` rows before, without the row itself."""
        return self.window.rowsBetween(-n, -1)

    def ahead(self, n: int) -> WindowSpec:
        """The ``n`` rows after."""
        return self.window.rowsBetween(1, n)

    @property
    def so_far(self) -> WindowSpec:
        return self.window.rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, x: str | Column, k: int = 1) -> Column:
        return F.lag(x, k).over(self.window)

    def lead(self, x: str | Column, k: int = 1) -> Column:
        return F.lead(x, k).over(self.window)

    def full(self, x: str | Column, n: int, agg: Callable[[Column], Column], frame: WindowSpec | None = None) -> Column:
        """``agg`` over a frame of ``n`` rows, null unless all of them are non-null."""
        frame = frame or self.back(n)
        return F.when(F.count(x).over(frame) == n, agg(col(x)).over(frame))

    def mean(self, x: str | Column, n: int) -> Column:
        return self.full(x, n, F.avg)

    def std(self, x: str | Column, n: int) -> Column:
        return self.full(x, n, F.stddev_samp)

    def total(self, x: str | Column, n: int) -> Column:
        return self.full(x, n, F.sum)

    def low(self, x: str | Column, n: int) -> Column:
        return self.full(x, n, F.min)

    def high(self, x: str | Column, n: int) -> Column:
        return self.full(x, n, F.max)

    def quantile(self, x: str | Column, n: int, p: float) -> Column:
        return self.full(x, n, lambda c: F.percentile(c, F.lit(p)))

    def corr(self, a: str | Column, b: str | Column, n: int) -> Column:
        """Correlation of the pairs of ``n`` rows, null unless every pair is complete."""
        frame = self.back(n)
        both = F.when(col(a).isNotNull() & col(b).isNotNull(), 1)
        return F.when(F.count(both).over(frame) == n, correlation(a, b, frame))

    def values(self, x: str | Column, n: int) -> Column:
        """The frame's values in order as an array, null unless it is full."""
        return self.full(x, n, F.collect_list)

    def rank_share(self, x: str | Column, n: int) -> Column:
        """Share of the frame at the row's average rank."""
        v, own = self.values(x, n), col(x)
        below = F.size(F.filter(v, lambda e: e < own))
        equal = F.size(F.filter(v, lambda e: e == own))
        return (below + (equal + 1) / 2) / F.lit(float(n))

    def below_share(self, x: str | Column, n: int) -> Column:
        """Share of the frame strictly below the row."""
        own = col(x)
        return F.size(F.filter(self.values(x, n), lambda e: e < own)) / F.lit(float(n))

    def running(self, x: str | Column) -> Column:
        return F.sum(x).over(self.so_far)

    def filled(self, x: str | Column) -> Column:
        """The last non-null value so far."""
        return F.last(x, ignorenulls=True).over(self.so_far)
