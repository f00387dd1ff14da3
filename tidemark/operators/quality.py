"""Data and feature quality: integrity scans, profiles, leakage and constancy checks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import correlation


def valid_ohlc() -> Column:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return (h >= low) & (h >= o) & (h >= c) & (low <= o) & (low <= c)


def bar_quality(bars: DataFrame) -> DataFrame:
    """Nulls, broken bars, repeated times and negative volumes by symbol; rows have no order to be out of."""
    nulls = sum((F.col(c).isNull().cast("int") for c in ("open", "high", "low", "close", "volume")), F.lit(0))
    same = Window.partitionBy("symbol", "ts")
    rows = bars.withColumn("_twins", F.count(F.lit(1)).over(same))
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"),
        (F.sum(nulls) / (5 * F.count(F.lit(1)))).alias("null_share"),
        F.count_if(~F.coalesce(valid_ohlc(), F.lit(False))).alias("broken"),
        F.count_if(F.col("_twins") > 1).alias("repeated"),
        F.count_if(F.col("volume") < 0).alias("negative_volume"),
        F.count_if(F.col("volume") == 0).alias("no_volume"),
    )


def profile(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.countDistinct(F.to_date("ts")).alias("days"),
        F.min("low").alias("lowest"), F.max("high").alias("highest"), F.count_if(F.col("close").isNull()).alias("null_close"),
    )


def gaps(bars: DataFrame, minutes: int) -> DataFrame:
    """Steps between bars that are longer than ``minutes``: how many, the longest, and the sum of missing bars."""
    step = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts")).cast("timestamp"))) / 60e6
    rows = bars.withColumn("_m", step).where(F.col("_m") > minutes)
    return rows.groupBy("symbol").agg(F.count(F.lit(1)).alias("gaps"), F.max("_m").alias("longest_minutes"), F.sum(F.col("_m") / minutes - 1).alias("missing_bars"))


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinite doubles become null, columns are sorted by name; a repeated name is an error."""
    if len(set(df.columns)) < len(df.columns):
        raise ValueError("repeated column names")
    fixed = {c: F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")}
    return df.withColumns(fixed).select(*sorted(df.columns)) if fixed else df.select(*sorted(df.columns))


def long_form(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``feature, x``: one row for each value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.feature", "p.x")


def feature_quality(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """One row for each column: null share, variance, largest z-score, correlation with the target, constancy.

    One aggregate over the wide table yields all of them; it is turned into rows afterwards.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        aggs += [F.count(c).alias(f"n_{c}"), F.var_samp(c).alias(f"v_{c}"), F.avg(c).alias(f"m_{c}"), F.max(c).alias(f"a_{c}"), F.min(c).alias(f"b_{c}"), correlation(c, target).alias(f"r_{c}")]
    one = df.agg(*aggs)
    rows = []
    for c in columns:
        sd = F.nullif(F.sqrt(f"v_{c}"), F.lit(0.0))
        rows.append(
            F.struct(
                F.lit(c).alias("feature"), (1 - F.col(f"n_{c}") / F.col("_n")).alias("null_share"), F.col(f"v_{c}").alias("variance"),
                F.greatest((F.col(f"a_{c}") - F.col(f"m_{c}")) / sd, (F.col(f"m_{c}") - F.col(f"b_{c}")) / sd).alias("largest_z"), F.col(f"r_{c}").alias("target_corr"),
            )
        )
    out = one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    r = F.abs("target_corr")
    ladder = F.when(r > 0.95, "leakage").when(r > 0.8, "likely").when(r > 0.5, "suspicious").otherwise("legitimate")
    return out.withColumns({"constant": F.coalesce(F.col("variance") < 1e-10, F.lit(True)).cast("int"), "outlier": F.coalesce(F.col("largest_z") > 10, F.lit(False)).cast("int"), "class": ladder})


def perfect_predictors(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Columns of which every value goes with one target class only, with more than one class overall."""
    rows = long_form(df.where(F.col(target).isNotNull()), columns, [target]).where("x is not null")
    by = rows.groupBy("feature", "x").agg(F.countDistinct(target).alias("k"))
    return by.groupBy("feature").agg(F.max("k").alias("classes"), F.count(F.lit(1)).alias("values")).withColumn("perfect", (F.col("classes") == 1).cast("int"))


def class_spread(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Standard deviation inside each class, and whether it is next to nothing."""
    rows = long_form(df.where(F.col(target).isNotNull()), columns, [target])
    return rows.groupBy("feature", target).agg(F.stddev_samp("x").alias("std")).withColumn("degenerate", F.coalesce(F.col("std") < 1e-10, F.lit(False)).cast("int"))


#: Name patterns that hint at looking ahead: fixed values.
SUSPECT = (r"future", r"forward", r"next_", r"target", r"label", r"lead_\d", r"_ahead")


def suspect_names(columns: list[str]) -> list[str]:
    return [c for c in columns if any(re.search(p, c) for p in SUSPECT)]


def looks_ahead(df: DataFrame) -> bool:
    """Whether the plan has a window frame or an offset that reaches past the current row."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return bool(re.search(r"specifiedwindowframe\((Row|Range)Frame, [^,]+, ([1-9]\d*|unboundedfollowing\$\(\))\)|(?i:lead)\(", plan))


def lookahead_scan(df: DataFrame, columns: list[str], ret: str, keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """Correlation of each column with the current and the next return, all in one aggregate."""
    rows = df.withColumn("_next", F.lead(ret).over(Window.partitionBy(*keys).orderBy(order)))
    one = rows.agg(*[correlation(c, ret).alias(f"p_{c}") for c in columns], *[correlation(c, "_next").alias(f"f_{c}") for c in columns])
    out = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"p_{c}").alias("past"), F.col(f"f_{c}").alias("future")) for c in columns])).alias("r"))
    return out.select("r.*").withColumn("suspicious", F.coalesce(F.abs("future") > 0.3, F.lit(False)).cast("int"))


def pick(df: DataFrame, names: list[str] = (), prefixes: tuple[str, ...] = (), horizon: int | None = None, keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Keys and the columns that are named, start with a prefix or end with the horizon's number, each once and in the table's order."""
    ends = f"_{horizon}" if horizon is not None else None
    chosen = [c for c in df.columns if c not in keys and (c in names or c.startswith(tuple(prefixes)) or (ends and c.endswith(ends)))]
    return df.select(*keys, *chosen)
