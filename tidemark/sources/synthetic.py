"""Series of made numbers for tests and demonstrations: the same on any partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.draws import uniform
from tidemark.functions.rows import sums_before
from tidemark.operators.recursive import ema_by_rate


def normal(seed: int, row: str | Column) -> Column:
    """A standard normal draw for each row number, from two uniform ones."""
    u, v = (uniform(seed, row, F.lit(k)) for k in (1, 2))
    return F.sqrt(-2 * F.ln(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * math.pi * v)


def _days(spark: SparkSession, n: int, first: str) -> DataFrame:
    days = spark.range(n).select(F.lit("made").alias("symbol"), F.col("id").alias("nth"))
    return days.withColumn("date", F.date_add(F.lit(first).cast("date"), F.col("nth").cast("int")))


def mean_reverting(spark: SparkSession, n: int, level: float = 20.0, speed: float = 0.05, noise: float = 1.0, lowest: float = 9.0, seed: int = 1, first: str = "2024-01-01") -> DataFrame:
    """``date, close`` of an index that returns to ``level``: x[t] = x[t-1] + speed * (level - x[t-1]) + noise * draw, not below ``lowest``.

    That is an exponential average of ``level + noise / speed * draw``.
    """
    rows = _days(spark, n, first).withColumn("_x", F.when(F.col("nth") == 0, level).otherwise(level + noise / speed * normal(seed, "nth")))
    out = ema_by_rate(rows, {"close": ("_x", speed)}, order="nth")
    return out.select("date", F.greatest("close", F.lit(lowest)).alias("close"))


def random_walk(spark: SparkSession, n: int, start: float = 0.0, noise: float = 1.0, seed: int = 2, first: str = "2024-01-01") -> DataFrame:
    """``date, value``: a sum of normal steps."""
    rows = _days(spark, n, first).withColumn("_step", noise * normal(seed, "nth"))
    out = sums_before(rows, ("symbol",), "nth", F.col("_step"), "_sum")
    return out.select("date", (start + F.col("_sum") + F.col("_step")).alias("value"))
