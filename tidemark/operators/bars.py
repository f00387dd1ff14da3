"""Ticks to bars, bars to coarser bars, session filters and calendar densification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Timeframe names and their minutes: fixed values.
TIMEFRAMES = {
    "1T": 1, "5T": 5, "15T": 15, "30T": 30, "60T": 60, "1H": 60, "2H": 120, "240T": 240, "4H": 240, "1D": 1440, "D": 1440, "W": 10080,
}


def minutes_of(timeframe: str) -> int:
    if timeframe not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {timeframe!r}; known: {', '.join(TIMEFRAMES)}")
    return TIMEFRAMES[timeframe]


def bucket(ts: str | Column, minutes: int) -> Column:
    """Start of the left-closed bucket that holds ``ts``, counted from midnight of its own clock.

    Whole days and weeks are counted from Monday 1970-01-05.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    if minutes > 1440:
        day = F.date_trunc("day", ts)
        days = F.datediff(day, F.lit("1970-01-05").cast("date"))
        return F.date_trunc("day", F.date_sub(day.cast("date"), F.pmod(days, F.lit(minutes // 1440))))
    day = F.date_trunc("day", ts)
    of_day = F.hour(ts) * 60 + F.minute(ts)
    start = (F.floor(of_day / minutes) * minutes).cast("int")
    return F.timestamp_add("MINUTE", start, day)


def ticks_to_bars(
    ticks: DataFrame, minutes: int, symbol: str = "symbol", ts: str = "ts", price: str = "price", size: str | None = None, tie: str | None = None
) -> DataFrame:
    """``symbol, ts, open, high, low, close, volume``; without ``size`` the volume is the number of ticks.

    Partial aggregates leave each task, so a hot symbol is no hot group. ``tie`` orders ticks of one time.
    """
    order = F.struct(*[F.col(c) for c in (ts, tie) if c])
    volume = F.sum(size) if size else F.count(F.lit(1))
    return (
        ticks.groupBy(F.col(symbol).alias("symbol"), bucket(ts, minutes).alias("bucket"))
        .agg(
            F.min_by(price, order).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, order).alias("close"),
            volume.cast("long").alias("volume"),
        )
        .select("symbol", F.col("bucket").alias("ts"), "open", "high", "low", "close", "volume")
    )


def resample(bars: DataFrame, minutes: int) -> DataFrame:
    """Coarser bars: first open, highest high, lowest low, last close, summed volume. Empty buckets do not appear."""
    return (
        bars.groupBy("symbol", bucket("ts", minutes).alias("bucket"))
        .agg(
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum("volume").cast("long").alias("volume"),
        )
        .select("symbol", F.col("bucket").alias("ts"), "open", "high", "low", "close", "volume")
    )


def in_session(
    ts: str | Column, start: int = 570, end: int = 960, zone: str | None = None, weekdays: bool = True, closed: bool = False
) -> Column:
    """Whether a time lies in a session given in minutes of the day, ``end`` included only if ``closed``.

    ``zone`` converts a UTC time to the wall clock first.
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    local = F.from_utc_timestamp(ts, zone) if zone else ts
    minute = F.hour(local) * 60 + F.minute(local)
    inside = (minute >= start) & ((minute <= end) if closed else (minute < end))
    return inside & (F.weekday(local) < 5) if weekdays else inside


def session_filter(bars: DataFrame, **session) -> DataFrame:
    return bars.where(in_session("ts", **session))


def densify_days(series: DataFrame, key: str, day: str, value: str) -> DataFrame:
    """One row for each calendar day between a key's first and last, values carried forward."""
    span = series.groupBy(key).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = span.select(key, F.explode(F.sequence("a", "b")).alias(day))
    joined = days.join(series.select(key, day, value), [key, day], "left")
    seen = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(value, F.last(value, ignorenulls=True).over(seen))


def continuous(parts: list[DataFrame]) -> DataFrame:
    """Contracts after each other: of several bars of one time the first contract's stays."""
    tagged = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    first = Window.partitionBy("symbol", "ts").orderBy("_part")
    return out.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_part", "_nth")


def resample_statistics(bars: DataFrame, minutes: int, session_minutes: int = 390, lookback_bars: int = 0) -> DataFrame:
    """Bars, days, bars per day, the bars a full session would have, and the embargo that covers a lookback."""
    return bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"),
        F.countDistinct(F.to_date("ts")).alias("days"),
        (F.count(F.lit(1)) / F.countDistinct(F.to_date("ts"))).alias("bars_per_day"),
        F.lit(session_minutes // minutes).cast("long").alias("expected_per_day"),
        F.lit(lookback_bars).cast("long").alias("embargo_bars"),
    )
