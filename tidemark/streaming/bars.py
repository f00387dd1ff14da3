"""Streams of ticks to bars, and rolling columns over streams of bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.bars import ticks_to_bars


def bar_stream(ticks: DataFrame, minutes: int, late: str = "10 minutes", symbol: str = "symbol", ts: str = "ts", price: str = "price", size: str | None = None) -> DataFrame:
    """Bars of a tick stream; a bar is final once the watermark has passed its end, later ticks are dropped.

    ``ts`` must be a timestamp. The bucket is an event-time window, so its length has to divide a day.
    """
    if 1440 % minutes:
        raise ValueError("the bar length must divide a day")
    t = ticks.withWatermark(ts, late)
    order = F.col(ts)
    volume = F.sum(size) if size else F.count(F.lit(1))
    out = t.groupBy(F.col(symbol).alias("symbol"), F.window(ts, f"{minutes} minutes").alias("w")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), volume.cast("long").alias("volume")
    )
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def session_bars(ticks: DataFrame, gap: str, late: str = "10 minutes", symbol: str = "symbol", ts: str = "ts", price: str = "price") -> DataFrame:
    """One bar for each burst of ticks that a pause of ``gap`` ends."""
    t = ticks.withWatermark(ts, late)
    out = t.groupBy(F.col(symbol).alias("symbol"), F.session_window(ts, gap).alias("w")).agg(
        F.min_by(price, ts).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, ts).alias("close"), F.count(F.lit(1)).alias("volume")
    )
    return out.select("symbol", F.col("w.start").alias("ts"), F.col("w.end").alias("until"), "open", "high", "low", "close", "volume")


class RollingColumns:
    """Batch operators over a stream of bars, with the last rows of each symbol as state.

    Each micro-batch is put behind the kept rows, the operator runs as in batch, and only new bars are handed
    on, so stream and batch agree by construction. The kept rows of batch n are a table named n in ``path``; a
    batch that is run again reads those of n - 1 again, so it repeats its result exactly.
    """

    def __init__(self, operator: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], path: str, rows: int = 200, only_full: bool = True) -> None:
        self.operator, self.sink, self.path, self.rows, self.only_full = operator, sink, path, rows, only_full

    def _kept(self, spark: SparkSession, batch: int, like: DataFrame) -> DataFrame:
        if batch < 0:
            return spark.createDataFrame([], like.schema)
        return spark.read.schema(like.schema).parquet(f"{self.path}/{batch}")

    def __call__(self, new: DataFrame, batch: int) -> None:
        spark = new.sparkSession
        both = self._kept(spark, batch - 1, new).withColumn("_new", F.lit(False)).unionByName(new.withColumn("_new", F.lit(True)))
        order = Window.partitionBy("symbol").orderBy("ts")
        out = self.operator(both).withColumn("_nth", F.row_number().over(order))
        out = out.where(F.col("_new") & (F.col("_nth") >= self.rows)) if self.only_full else out.where("_new")
        self.sink(out.drop("_new", "_nth"), batch)
        last = both.withColumn("_k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).where(F.col("_k") <= self.rows)
        last.select(*new.columns).write.mode("overwrite").parquet(f"{self.path}/{batch}")


def batch_bars(ticks: DataFrame, minutes: int, **names) -> DataFrame:
    """The same bars in batch."""
    return ticks_to_bars(ticks, minutes, **names)
