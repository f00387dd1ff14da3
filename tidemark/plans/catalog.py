"""Registry of queries: a Spark callable and the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bars as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PLACES = 6
#: Added before rounding: values that end in a 5 at the seventh place are ties that engines round to different sides.
TIE_SHIFT = 1.3e-7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the event stream: one symbol for each event type."""
    bars = B.ticks_to_bars(table(spark, sf_dir, "events"), 60, symbol="event_type", price="value", tie="event_id")
    return bars.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def shown(df: DataFrame, floats: list[str] = (), ints: list[str] = (), keys: tuple[str, ...] = ("symbol", "ts")) -> DataFrame:
    """Keys, floats rounded to six places, ints."""
    return df.select(
        *keys,
        *[F.round(F.col(c).cast("double") + TIE_SHIFT, PLACES).alias(c) for c in floats],
        *[F.col(c).cast("int").alias(c) for c in ints],
    )


def add(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} exists")
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def on_bars(operator: Callable[[DataFrame], DataFrame], floats: list[str] = (), ints: list[str] = ()) -> Query:
    return lambda spark, sf_dir: shown(operator(hour_bars(spark, sf_dir)), floats, ints)
