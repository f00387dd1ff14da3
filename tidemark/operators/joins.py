"""Joins along time: as-of, previous day, intervals and event windows.

None of them compares all rows with all rows: as-of joins are one sorted pass over the union
of both sides, event windows meet in time buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(
    left: DataFrame, right: DataFrame, columns: list[str], by: tuple[str, ...] = ("symbol",), on: str = "ts", inclusive: bool = True
) -> DataFrame:
    """``left`` with the right side's ``columns`` of its last row at or before each time.

    Each column takes its last non-null value. Without ``inclusive`` rows of the same time do not count.
    Of right rows of one time the one with the greatest values counts, in the order of ``columns``.
    """
    return asof_many(left, [(right, columns)], by, on, inclusive)


def asof_many(left: DataFrame, rights: list[tuple[DataFrame, list[str]]], by: tuple[str, ...] = ("symbol",), on: str = "ts", inclusive: bool = True) -> DataFrame:
    """:func:`asof` for several right sides with columns of their own, in one sorted pass over all of them."""
    kept, columns = left.columns, [c for _, names in rights for c in names]
    kinds = {c: right.schema[c].dataType for right, names in rights for c in names}
    none = {c: F.lit(None).cast(k).alias(f"_r_{c}") for c, k in kinds.items()}
    rows = left.select(*kept, *none.values(), F.lit(1 if inclusive else 0).alias("_side"))
    empty = [F.lit(None).cast(left.schema[c].dataType).alias(c) if c not in (*by, on) else F.col(c) for c in kept]
    for right, names in rights:
        r = right.select(*by, on, *[F.col(c).alias(f"_r_{c}") for c in names])
        rows = rows.unionByName(r.select(*empty, *[F.col(f"_r_{c}") if c in names else none[c] for c in columns], F.lit(0 if inclusive else 1).alias("_side")))
    w = Window.partitionBy(*by).orderBy(on, "_side", *[f"_r_{c}" for c in columns]).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.withColumns({c: F.last(f"_r_{c}", ignorenulls=True).over(w) for c in columns})
    return both.where(F.col("_side") == (1 if inclusive else 0)).select(*kept, *columns)


def previous_day(bars: DataFrame, daily: DataFrame, columns: list[str], ts: str = "ts", day: str = "date", days: int = 1, fill: bool = True) -> DataFrame:
    """Bars with the daily values of exactly ``days`` calendar days before.

    With ``fill``, gaps take the last value, then the next one, then 0. The next one looks ahead at the
    start of a series; that is kept for parity and can be turned off with ``fill=False``.
    """
    right = daily.select(F.date_add(day, days).alias("_d"), *[F.col(c).alias(f"_v_{c}") for c in columns])
    out = bars.withColumn("_d", F.to_date(ts)).join(right, "_d", "left")
    w = Window.partitionBy("symbol").orderBy(ts)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    for c in columns:
        v = F.col(f"_v_{c}")
        if fill:
            v = F.coalesce(F.last(v, ignorenulls=True).over(back), F.first(v, ignorenulls=True).over(ahead), F.lit(0.0))
        out = out.withColumn(c, v)
    return out.drop("_d", *[f"_v_{c}" for c in columns])


def same_day(bars: DataFrame, daily: DataFrame, columns: list[str], ts: str = "ts", day: str = "date", lag_days: int = 0) -> DataFrame:
    """Bars with the same day's values, carried forward over days without one."""
    right = daily.select(F.date_add(day, lag_days).alias("_d"), *columns)
    out = bars.withColumn("_d", F.to_date(ts)).join(right, "_d", "left")
    w = Window.partitionBy("symbol").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns}).drop("_d")


def seconds(ts: str | Column) -> Column:
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000.0)


def event_windows(
    bars: DataFrame, events: DataFrame, minutes: int, lag_minutes: int, score: str, weight: str | None = None, decay: float | None = None, ts: str = "ts", event_ts: str = "ts"
) -> DataFrame:
    """Bars with the number and the weighted mean of the events in ``[ts - lag - window, ts - lag)``.

    Both sides carry the number of a time bucket as long as the window; a bar meets the two buckets its
    window can touch, so the join is an equi-join and its rows are the true pairs and their neighbours.
    ``decay`` weighs an event by ``decay ** minutes`` of its distance from the bar.
    """
    width = minutes * 60.0
    end = seconds(ts) - lag_minutes * 60.0
    b = bars.withColumns({"_end": end}).withColumn("_bucket", F.floor(F.col("_end") / width))
    b = b.select("symbol", ts, "_end", F.explode(F.array(F.col("_bucket"), F.col("_bucket") - 1)).alias("_bucket"))
    e = events.select(
        seconds(event_ts).alias("_at"), F.col(score).cast("double").alias("_s"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")
    ).withColumn("_bucket", F.floor(F.col("_at") / width))
    pairs = b.join(e, "_bucket").where((F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - width))
    w = F.col("_w")
    if decay is not None:
        w = w * F.pow(F.lit(decay), (F.col("_end") + lag_minutes * 60.0 - F.col("_at")) / 60.0)
    found = pairs.groupBy("symbol", ts).agg(
        F.count(F.lit(1)).alias("events"), (F.sum(F.col("_s") * w) / F.nullif(F.sum(w), F.lit(0.0))).alias("score"), F.sum("_w").alias("weight")
    )
    out = bars.join(found, ["symbol", ts], "left")
    return out.withColumns({"events": F.coalesce("events", F.lit(0)), "weight": F.coalesce("weight", F.lit(0.0))})


def valid_fold(rows: DataFrame, folds: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows with the fold whose ``[valid_from, valid_until)`` holds their time, else the last fold.

    Folds are a schedule of disjoint validity times, spread over the days they cover for an equi-join.
    """
    days = folds.select(
        F.col("fold").alias("_f"), "valid_from", "valid_until", F.explode(F.sequence(F.to_date("valid_from"), F.to_date("valid_until"))).alias("_day")
    )
    inside = (F.to_date(ts) == F.col("_day")) & (F.col(ts) >= F.col("valid_from")) & (F.col(ts) < F.col("valid_until"))
    last = folds.agg(F.max("fold").alias("_last"))  # one row
    out = rows.join(days, inside, "left").join(F.broadcast(last))
    return out.withColumn("fold", F.coalesce("_f", "_last")).drop("_f", "_day", "_last", "valid_from", "valid_until")


def outer_by_day(left: DataFrame, right: DataFrame, day: str = "date", suffix: str = "_right") -> DataFrame:
    """Full outer join of two daily tables, values carried forward."""
    renamed = right.select(F.col(day).alias("_day"), *[F.col(c).alias(c + suffix if c in left.columns else c) for c in right.columns if c != day])
    out = left.join(renamed, left[day] == renamed["_day"], "full_outer").withColumn(day, F.coalesce(day, "_day")).drop("_day")
    w = Window.partitionBy(F.lit(1)).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)  # one row a day
    return out.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in out.columns if c != day})
