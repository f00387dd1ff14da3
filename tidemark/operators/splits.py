"""Train and test memberships: walk-forward, purged and combinatorial folds over row numbers.

Every operator returns the input's rows with ``fold`` and ``role``, once for each fold that a row
belongs to. Memberships are arithmetic on the row number, so nothing is joined or collected.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TRAIN, TEST = "train", "test"


def numbered(df: DataFrame, keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """``row_no`` from 0 in each series and ``rows``, the series' length."""
    out = df.withColumn("row_no", F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)
    return out.withColumn("rows", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def _members(df: DataFrame, folds: list[tuple[int, Column, Column]]) -> DataFrame:
    """Rows once for each (fold, is train, is test) that holds."""
    found = [F.when(train, F.struct(F.lit(f).alias("fold"), F.lit(TRAIN).alias("role"))).when(test, F.struct(F.lit(f).alias("fold"), F.lit(TEST).alias("role"))) for f, train, test in folds]
    out = df.withColumn("_m", F.explode(F.array_compact(F.array(*found))))
    return out.select("*", "_m.fold", "_m.role").drop("_m")


def rolling(df: DataFrame, train: int, test: int, embargo: int = 0) -> DataFrame:
    """Fixed windows that advance by the test length; only whole windows count."""
    n, r = F.col("rows"), F.col("row_no")
    whole = F.floor((n - train - embargo - test) / test)  # number of the last fold
    first = F.greatest(F.floor((r - train - embargo - test) / test) + 1, F.lit(0))
    last = F.least(F.floor(r / test), whole)
    out = df.withColumn("fold", F.explode(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    at = r - F.col("fold") * test
    role = F.when(at < train, TRAIN).when((at >= train + embargo) & (at < train + embargo + test), TEST)
    return out.withColumns({"role": role, "fold": F.col("fold").cast("int")}).where("role is not null")


def walk_forward(df: DataFrame, folds: int, embargo: int = 0, expanding: bool = True, max_train: int | None = None) -> DataFrame:
    """Tests of equal length after two such lengths of training and an embargo; only whole tests count.

    Training ends an embargo before the test. It starts at the first row, or with ``expanding=False``
    so many rows before its end, two test lengths unless ``max_train`` says otherwise.
    """
    size, r, out = F.floor(F.col("rows") / (folds + 1)), F.col("row_no"), []
    for k in range(folds):
        start = size * (2 + k) + embargo
        whole = start + size <= F.col("rows")
        first = F.lit(0) if expanding else F.greatest(F.lit(0), start - embargo - (F.lit(max_train) if max_train else size * 2))
        out.append((k, whole & (r >= first) & (r < start - embargo), whole & (r >= start) & (r < start + size)))
    return _members(df, out)


def purged(df: DataFrame, folds: int, purge: int, embargo: int) -> DataFrame:
    """K-fold: training rows within ``purge`` before or ``embargo`` after the test part are left out."""
    size = F.floor(F.col("rows") / folds)
    r, out = F.col("row_no"), []
    for k in range(folds):
        a, b = size * k, size * (k + 1)
        out.append((k, (r < a - purge) | (r >= b + embargo), (r >= a) & (r < b)))
    return _members(df, out)


def combinatorial(df: DataFrame, groups: int, tests: int, t1: str | None = None, embargo_share: float = 0.0, purge_share: float = 0.0) -> DataFrame:
    """Combinatorial purged folds: every choice of ``tests`` of the groups.

    With ``t1``, the row number at which a label ends, a training row goes if its label ends after the
    first test row, and a test row before the last training row goes if its label ends after the first
    one. The fold's bounds are arithmetic on the group size, but for the last training row that the
    purge leaves, which is an aggregate by fold. Without ``t1``, rows just before the test part go.
    """
    size, n, r = F.floor(F.col("rows") / groups), F.col("rows"), F.col("row_no")
    group = F.least(F.floor(r / size), F.lit(groups - 1))
    embargo, purge = F.floor(n * embargo_share), F.floor(n * purge_share)
    folds = []
    for f, chosen in enumerate(combinations(range(groups), tests)):
        first = size * chosen[0]
        last = (size * (chosen[-1] + 1) if chosen[-1] < groups - 1 else n) - 1
        test = group.isin(*chosen)
        kept = (F.col(t1) <= first) if t1 else ~((r >= first - purge) & (r < first))
        train = ~test & kept & ~((r > last) & (r <= last + embargo))
        folds.append((f, train, test))
    out = _members(df, folds)
    if t1:
        # the purge of test rows looks at training rows before the embargo takes some
        spans = [(f, ~group.isin(*c) & (F.col(t1) <= size * c[0]), F.lit(False)) for f, c in enumerate(combinations(range(groups), tests))]
        left = _members(df, spans).groupBy(*[k for k in ("symbol",) if k in df.columns], "fold").agg(F.min("row_no").alias("_a"), F.max("row_no").alias("_b"))
        out = out.join(left, [*[k for k in ("symbol",) if k in df.columns], "fold"], "left")
        gone = (F.col("role") == TEST) & F.coalesce((r < F.col("_b")) & (F.col(t1) > F.col("_a")), F.lit(False))
        out = out.where(~gone).drop("_a", "_b")
    return out


def appearance_weights(members: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Training rows with weights against how often they appear, summing to each fold's length."""
    train = members.where(F.col("role") == TRAIN)
    often = train.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "row_no")))
    often = often.withColumn("_w", F.max("_n").over(Window.partitionBy(*keys)) / F.col("_n"))
    fold = Window.partitionBy(*keys, "fold")
    return often.withColumn("weight", F.col("_w") / F.sum("_w").over(fold) * F.count(F.lit(1)).over(fold)).drop("_n", "_w")


def exact_backward_purge(members: DataFrame, t1: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Test rows whose label span holds any training row of their fold go: an as-of look ahead to the next one."""
    ahead = Window.partitionBy(*keys, "fold").orderBy("row_no").rowsBetween(0, Window.unboundedFollowing)
    train_at = F.when(F.col("role") == TRAIN, F.col("row_no"))
    out = members.withColumn("_next", F.min(train_at).over(ahead))
    return out.where((F.col("role") == TRAIN) | F.col("_next").isNull() | (F.col("_next") > F.col(t1))).drop("_next")


def day_folds(df: DataFrame, train_days: int, test_days: int, ts: str = "ts") -> DataFrame:
    """Calendar folds: so many days of training, then of test; the next fold starts after the test."""
    first = F.min(F.to_date(ts)).over(Window.partitionBy("symbol"))
    last = F.max(F.to_date(ts)).over(Window.partitionBy("symbol"))
    out = df.withColumns({"_d": F.datediff(F.to_date(ts), first), "_n": F.datediff(last, first) + 1})
    folds = F.sequence(F.greatest(F.floor((F.col("_d") - train_days - test_days) / test_days) + 1, F.lit(0)), F.floor(F.col("_d") / test_days))
    whole = F.floor((F.col("_n") - train_days - test_days) / test_days)
    out = out.withColumn("fold", F.explode(F.filter(folds, lambda f: f <= whole)))
    at = F.col("_d") - F.col("fold") * test_days
    return out.withColumns({"role": F.when(at < train_days, TRAIN).otherwise(TEST), "fold": F.col("fold").cast("int")}).drop("_d", "_n")


def holdout(df: DataFrame, share: float) -> DataFrame:
    """The last ``share`` of each series is the test part."""
    cut = F.floor(F.col("rows") * (1 - share))
    return df.withColumn("role", F.when(F.col("row_no") < cut, TRAIN).otherwise(TEST))


def sequences(df: DataFrame, columns: list[str], n: int, keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """The last ``n`` rows' values as ``array<array<double>>``, only where there are as many."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(n - 1), 0)
    out = df.withColumn("sequence", F.collect_list(F.array(*[F.col(c).cast("double") for c in columns])).over(w))
    return out.where(F.size("sequence") == n)


def embargo_rows(horizon: int, lookback: int, minutes: int = 5, day_minutes: int = 390, days: float = 0.0) -> int:
    """Rows between train and test: the label horizon or the lookback, and so many trading days at least."""
    return max(horizon, lookback, ceil(days * day_minutes / minutes))
