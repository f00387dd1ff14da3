"""Readers and writers for bar, tick and daily files. All return columns with fixed names and UTC times."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names that mean the same: fixed values.
TIME_NAMES = ("ts_event", "timestamp", "datetime", "time", "date")
ALIASES = {"o": "open", "h": "high", "l": "low", "c": "close", "v": "volume"}
OHLCV = ("open", "high", "low", "close", "volume")


def minute_text(spark: SparkSession, path: str, symbol: str, zone: str = "America/Chicago") -> DataFrame:
    """``yyyyMMdd HHmmss;open;high;low;close;volume`` without a header; times are the zone's wall clock."""
    raw = spark.read.csv(path, sep=";", schema="at string, open double, high double, low double, close double, volume long")
    return raw.select(F.lit(symbol).alias("symbol"), F.to_utc_timestamp(F.to_timestamp("at", "yyyyMMdd HHmmss"), zone).alias("ts"), *OHLCV)


def tick_time(at: Column) -> Column:
    """``yyyyMMdd HHmmss [fraction]``; the fraction's first six digits are microseconds, padded on the right."""
    parts = F.split(at, " +")
    micros = F.rpad(F.substring(F.coalesce(F.get(parts, F.lit(2)), F.lit("")), 1, 6), 6, "0").cast("int")
    second = F.to_timestamp(F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1))), "yyyyMMdd HHmmss")
    return F.timestamp_micros(F.unix_micros(second) + micros)


def tick_text(spark: SparkSession, path: str, symbol: str, zone: str = "America/Chicago") -> DataFrame:
    raw = spark.read.csv(path, sep=";", schema="at string, price double, size long")
    return raw.select(F.lit(symbol).alias("symbol"), F.to_utc_timestamp(tick_time(F.col("at")), zone).alias("ts"), "price", "size")


def renamed(df: DataFrame) -> DataFrame:
    """Lower-cased names, one-letter aliases spelled out, the first known time column as ``ts``."""
    out = df.select(*[F.col(f"`{c}`").alias(ALIASES.get(c.strip().lower(), c.strip().lower())) for c in df.columns])
    known = next((c for c in TIME_NAMES if c in out.columns), None)
    if known is None:
        raise ValueError(f"no time column among {', '.join(out.columns)}")
    return out.withColumnRenamed(known, "ts")


def bar_csv(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """A CSV of bars with a header; times without a zone are UTC; rows with a missing value go."""
    raw = renamed(spark.read.csv(path, header=True))
    missing = [c for c in OHLCV if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    kinds = {"volume": "long"}
    out = raw.select(F.lit(symbol).alias("symbol"), F.try_to_timestamp("ts").alias("ts"), *[F.expr(f"try_cast(`{c}` AS {kinds.get(c, 'double')})").alias(c) for c in OHLCV])
    return out.dropna()


def first_available(spark: SparkSession, readers: list[tuple[str, str]], symbol: str) -> DataFrame:
    """Bars from the first source that exists: a list of (kind, path) with kinds ``csv`` and ``minute``."""
    for kind, path in readers:
        try:
            return {"csv": bar_csv, "minute": minute_text}[kind](spark, path, symbol)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    raise FileNotFoundError("; ".join(p for _, p in readers))


def put_call_csv(spark: SparkSession, path: str) -> DataFrame:
    """A daily put/call file with lines before its header: ``date, pcr_total, call_volume, put_volume, total_volume``.

    The header is the first line that names a date or trade column; columns are found by their words, and the
    ratio is put over call where the file has none.
    """
    lines = spark.read.text(path)
    header = lines.where(F.upper("value").rlike("DATE|TRADE")).first()
    if header is None:
        raise ValueError(f"no header line in {path}")
    names = [re.sub(r"\s+", "_", c.strip().lower()) for c in header["value"].split(",")]
    fields = lines.where(F.col("value") != header["value"]).select(F.split("value", ",").alias("f"))

    def number(at: int | None) -> Column:
        return F.expr(f"try_cast(trim(get(f, {at})) AS double)") if at is not None else F.lit(None).cast("double")

    def find(*words: str, without: tuple[str, ...] = ()) -> int | None:
        return next((i for i, c in enumerate(names) if any(w in c for w in words) and not any(w in c for w in without)), None)

    day = find("date")
    text = F.trim(F.get("f", F.lit(0 if day is None else day)))
    date = F.coalesce(F.expr("try_to_date(trim(get(f, %d)), 'M/d/yyyy')" % (day or 0)), F.expr("try_to_date(trim(get(f, %d)))" % (day or 0)))
    ratio, call, put, total = find("p/c", "ratio"), find("call", without=("put",)), find("put", without=("call",)), find("total", without=("ratio", "p/c"))
    rows = fields.where(text != "").select(date.alias("date"), number(ratio).alias("r"), number(call).alias("call_volume"), number(put).alias("put_volume"), number(total).alias("total_volume"))
    pcr = F.coalesce("r", F.col("put_volume") / F.nullif(F.col("call_volume"), F.lit(0.0)))
    return rows.select("date", pcr.alias("pcr_total"), "call_volume", "put_volume", "total_volume").where("date is not null and pcr_total is not null")


def daily_csv(spark: SparkSession, path: str, value: str) -> DataFrame:
    """``date, value`` of a daily file: a date column, else the first; a close column, else the adjusted one."""
    raw = spark.read.csv(path, header=True)
    raw = raw.select(*[F.col(f"`{c}`").alias(c.strip().lower()) for c in raw.columns])
    day = "date" if "date" in raw.columns else raw.columns[0]
    source = "close" if "close" in raw.columns else "adj close"
    return raw.select(F.to_date(F.try_to_timestamp(f"`{day}`")).alias("date"), F.expr(f"try_cast(`{source}` AS double)").alias(value)).where("date is not null")


def write_bars(bars: DataFrame, path: str) -> None:
    """Parquet by symbol and day, so that filters on either read only their folders."""
    out = bars.withColumn("date", F.to_date("ts"))
    out.repartition("symbol", "date").sortWithinPartitions("ts").write.mode("overwrite").partitionBy("symbol", "date").parquet(path)


def read_bars(spark: SparkSession, path: str, symbols: list[str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Bars of :func:`write_bars`; symbols and days outside are not read. ``end`` is included."""
    out = spark.read.parquet(path)
    if symbols:
        out = out.where(F.col("symbol").isin(*symbols))
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    if end:
        out = out.where(F.col("date") <= F.lit(end).cast("date"))
    return out


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
