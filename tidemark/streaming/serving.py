"""Requests and decisions: JSON lines in, JSON lines out, as columns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REQUEST = "type string, symbol string, timestamp string, open double, high double, low double, close double, volume long, position int, features array<double>, atr double"
WIDTH = 42  # inputs of the model vector


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """The request of each line; ``kind`` is ERROR for what is no JSON or no known type."""
    r = F.from_json(F.col(value), REQUEST)
    known = F.col("request.type").isin("BAR_UPDATE", "HEARTBEAT", "STATUS")
    return lines.withColumn("request", r).withColumn("kind", F.when(known, F.col("request.type")).otherwise("ERROR"))


def decide(vol: Column, up: Column, down: Column, position: Column, min_vol: float = 0.40, min_breakout: float = 0.45) -> tuple[Column, Column]:
    """Action and reason; a signal in the direction of an open position is FLAT, equal probabilities are no signal."""
    action = F.when(vol < min_vol, "FLAT").when((up > down) & (up >= min_breakout), "LONG").when((down > up) & (down >= min_breakout), "SHORT").otherwise("FLAT")
    reason = F.when(vol < min_vol, "no volatility expansion").when(action == "FLAT", "no clear direction").otherwise("signal")
    held = ((position > 0) & (action == "LONG")) | ((position < 0) & (action == "SHORT"))
    return F.when(held, "FLAT").otherwise(action), F.when(held, F.when(position > 0, "already long").otherwise("already short")).otherwise(reason)


def responses(requests: DataFrame, scored: dict[str, Column], mode: str = "live") -> DataFrame:
    """``response``: the JSON answer to each parsed request.

    ``scored`` has the columns ``vol``, ``up`` and ``down``; vectors of the wrong width are rejected.
    """
    action, reason = decide(scored["vol"], scored["up"], scored["down"], F.coalesce("request.position", F.lit(0)))
    wide = F.col("request.features").isNull() | (F.size("request.features") == WIDTH)
    signal = F.to_json(
        F.struct(
            F.lit("SIGNAL").alias("type"), F.when(wide, action).otherwise("FLAT").alias("action"), F.when(wide, reason).otherwise(f"expected {WIDTH} features").alias("reason"),
            scored["vol"].alias("vol_prob"), F.greatest(scored["up"], scored["down"]).alias("breakout_prob"),
        )
    )
    ack = F.to_json(F.struct(F.lit("HEARTBEAT_ACK").alias("type"), F.col("request.timestamp").alias("timestamp")))
    status = F.to_json(F.struct(F.lit("STATUS").alias("type"), F.lit(mode).alias("mode"), F.coalesce("request.position", F.lit(0)).alias("position")))
    error = F.to_json(F.struct(F.lit("ERROR").alias("type"), F.lit("unknown or malformed request").alias("message")))
    answer = F.when(F.col("kind") == "BAR_UPDATE", signal).when(F.col("kind") == "HEARTBEAT", ack).when(F.col("kind") == "STATUS", status).otherwise(error)
    return requests.withColumn("response", answer)


def rejections(answered: DataFrame) -> DataFrame:
    """How often each reason kept a bar from being a signal."""
    r = F.get_json_object("response", "$.reason")
    return answered.where((F.col("kind") == "BAR_UPDATE") & (r != "signal")).groupBy(r.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def warm_up(bars: DataFrame, rows: int = 200, quiet: str | None = None) -> DataFrame:
    """``symbol, ts, seen, ready``: how many bars of a symbol the stream has seen, and whether they fill the buffer.

    State is one number for each symbol. ``quiet`` drops it after so long without a bar, by processing time.
    """
    out = "symbol string, ts timestamp, seen long, ready boolean"

    def count(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = state.get[0] if state.exists else 0
        got = pd.concat(list(frames)).sort_values("ts")
        numbers = range(seen + 1, seen + len(got) + 1)
        state.update((seen + len(got),))
        if quiet:
            state.setTimeoutDuration(quiet)
        yield pd.DataFrame({"symbol": key[0], "ts": got["ts"].to_numpy(), "seen": list(numbers), "ready": [n >= rows for n in numbers]})

    timeout = GroupStateTimeout.ProcessingTimeTimeout if quiet else GroupStateTimeout.NoTimeout
    return bars.select("symbol", "ts").groupBy("symbol").applyInPandasWithState(count, out, "seen long", "append", timeout)


def gap_alerts(bars: DataFrame, hours: float = 1.0) -> DataFrame:
    """Bars that come more than ``hours`` after the one before, in batch or inside a micro-batch."""
    from pyspark.sql import Window

    last = F.lag("ts").over(Window.partitionBy("symbol").orderBy("ts"))
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(last.cast("timestamp"))) / 3.6e9
    return bars.withColumn("gap_hours", gap).where(F.col("gap_hours") > hours)
