"""Row numbers of ordered series without a task that sees a whole series."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECES = 64


def piece_of(df: DataFrame, order: str, pieces: int = PIECES) -> Column:
    """The number of the piece a row's value of ``order`` (a number, date or time) falls in; nulls are in the first.

    The pieces are cut at fixed values, the approximate quantiles, found once: a row's piece depends on its own
    value only, so a task that runs again finds the same one.
    """
    at = F.col(order)
    if df.schema[order].dataType.simpleString().startswith(("timestamp", "date")):
        at = F.unix_micros(at.cast("timestamp"))
    at = at.cast("double")
    cuts = sorted(set(df.select(at.alias("at")).approxQuantile("at", [i / pieces for i in range(1, pieces)], 1 / (4 * pieces))))
    # plain comparisons: they are compiled, and filters that the optimizer infers from a lambda can name columns that are not there
    return F.coalesce(reduce(add, [(at > c).cast("int") for c in cuts]), F.lit(0)) if cuts else F.lit(0)


def sums_before(df: DataFrame, keys: tuple[str, ...], order: str, weight: Column, name: str, pieces: int = PIECES) -> DataFrame:
    """``df`` with the sum of ``weight`` over the rows of the same keys that come before in ``order``, which is unique there.

    Sums of the pieces give the offsets, so no task holds more than a piece of a series. Null keys are a
    series of their own; null order values come first.
    """
    rows = df.withColumns({"_piece": piece_of(df, order, pieces), "_w": weight})
    inside = F.sum("_w").over(Window.partitionBy(*keys, "_piece").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_w")
    sizes = rows.groupBy(*keys, "_piece").agg(F.sum("_w").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_piece")) - F.col("_n")
    # one row for each piece of a series
    offsets = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_piece").alias("_at"), before.alias("_before"))
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_k_{k}")), keys, F.col("_piece") == F.col("_at"))
    out = rows.withColumn("_in", inside).join(offsets, same)
    return out.withColumn(name, F.col("_before") + F.col("_in")).drop("_piece", "_w", "_in", "_before", "_at", *[f"_k_{k}" for k in keys])


def row_numbers(df: DataFrame, keys: tuple[str, ...], order: str, name: str = "_row", pieces: int = PIECES) -> DataFrame:
    """Row numbers from 0 of each series."""
    return sums_before(df, keys, order, F.lit(1).cast("long"), name, pieces)


def value_ranks(df: DataFrame, keys: tuple[str, ...], x: str, weight: Column | None = None, pieces: int = PIECES) -> DataFrame:
    """``keys, x, n, before``: the distinct values of each group, how many rows have them and how many have smaller ones."""
    counts = df.groupBy(*keys, x).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    return sums_before(counts, keys, x, F.col("n"), "before", pieces)
