"""Microstructure proxies from bars: volume, intensity, price impact, bands, sessions, order flow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import EPS, Frames, ratio
from tidemark.operators.price import simple_return

FRAMES = Frames()


def volume_metrics(bars: DataFrame, frames: Frames = FRAMES) -> DataFrame:
    v = F.col("volume")
    out = bars.withColumns(
        {
            "_d": v - frames.lag("volume"),
            "volume_momentum_5": ratio("volume", frames.lag("volume", 5)) - 1,
            "volume_zscore": (v - frames.mean("volume", 20)) / (frames.std("volume", 20) + EPS),
            "volume_percentile_20": frames.rank_share("volume", 20),
            "dollar_volume": v * F.col("close"),
            "volume_weighted_range": (F.col("high") - F.col("low")) * v,
        }
    )
    return out.withColumns({"volume_accel": F.col("_d") - frames.lag("_d"), "dollar_volume_ma20": frames.mean("dollar_volume", 20)}).drop("_d")


def trade_intensity(bars: DataFrame, frames: Frames = FRAMES) -> DataFrame:
    v, spread = F.col("volume"), F.col("high") - F.col("low") + EPS
    out = bars.withColumn("_r", simple_return(1, frames))
    r = F.col("_r")
    out = out.withColumns(
        {
            "trade_size_proxy": v / (spread * 100 + 1),
            "trade_intensity_5": frames.total("volume", 5),
            "trade_intensity_20": frames.total("volume", 20),
            "up_volume": F.when(r > 0, v).otherwise(0),
            "down_volume": F.when(r < 0, v).otherwise(0),
            "signed_volume": r * v,
        }
    )
    return out.withColumns(
        {
            "up_down_ratio": frames.total("up_volume", 20) / (frames.total("down_volume", 20) + EPS),
            "cum_volume_delta": frames.running("signed_volume"),
            "volume_delta_ma20": frames.mean("signed_volume", 20),
        }
    ).drop("_r")


def price_impact(bars: DataFrame, frames: Frames = FRAMES) -> DataFrame:
    """Amihud illiquidity, Kyle's lambda proxy, range impact and price efficiency."""
    v, c = F.col("volume"), F.col("close")
    out = bars.withColumns(
        {
            "amihud": F.abs(simple_return(1, frames)) / (v + EPS),
            "kyle_lambda": F.abs(c - frames.lag("close")) / (v + EPS),
            "range_impact": (F.col("high") - F.col("low")) / (v + EPS),
            "volume_normalised_return": simple_return(1, frames) / (F.sqrt(v) + EPS),
            "_hl": F.col("high") - F.col("low"),
        }
    )
    return out.withColumns(
        {
            "amihud_ma20": frames.mean("amihud", 20),
            "kyle_lambda_ma20": frames.mean("kyle_lambda", 20),
            "range_impact_ma20": frames.mean("range_impact", 20),
            "price_efficiency": F.abs(c - frames.lag("close", 20)) / (frames.total("_hl", 20) + EPS),
        }
    ).drop("_hl")


def vwap_bands(bars: DataFrame, n: int = 20, k: float = 2.0, frames: Frames = FRAMES) -> DataFrame:
    """Rolling VWAP with bands of the volume-weighted distance of each close from its own row's VWAP."""
    v = F.col("volume")
    out = bars.withColumn("_t", (F.col("high") + F.col("low") + F.col("close")) / 3).withColumn("_tv", F.col("_t") * v)
    out = out.withColumn("vwap_n", frames.total("_tv", n) / (frames.total("volume", n) + EPS))
    out = out.withColumn("_sq", F.pow(F.col("close") - F.col("vwap_n"), 2) * v)
    out = out.withColumn("_sd", F.sqrt(frames.total("_sq", n) / (frames.total("volume", n) + EPS)))
    out = out.withColumns({"vwap_upper": F.col("vwap_n") + k * F.col("_sd"), "vwap_lower": F.col("vwap_n") - k * F.col("_sd"), "poc_proxy": frames.high("_t", n)})
    position = (F.col("close") - F.col("vwap_lower")) / (F.col("vwap_upper") - F.col("vwap_lower") + EPS)
    return out.withColumn("vwap_position", position).drop("_t", "_tv", "_sq", "_sd")


def session_metrics(bars: DataFrame, symbol: str = "symbol", ts: str = "ts") -> DataFrame:
    """Cumulative volume, range, VWAP and bar number inside each calendar day."""
    day = Frames((symbol, "_day"), (ts,))
    out = bars.withColumns({"_day": F.to_date(ts), "_tv": (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")})
    out = out.withColumns(
        {
            "session_volume": day.running("volume"),
            "session_high": F.max("high").over(day.so_far),
            "session_low": F.min("low").over(day.so_far),
            "bars_in_session": F.row_number().over(day.window),
            "_n": day.running("_tv"),
        }
    )
    out = out.withColumns(
        {
            "session_range": F.col("session_high") - F.col("session_low"),
            "session_vwap": F.col("_n") / (F.col("session_volume") + EPS),
            "session_volume_rate": F.col("session_volume") / F.col("bars_in_session"),
        }
    )
    return out.withColumns(
        {
            "session_position": (F.col("close") - F.col("session_low")) / (F.col("session_range") + EPS),
            "session_vwap_dist": ratio(F.col("close") - F.col("session_vwap"), "session_vwap") * 100,
        }
    ).drop("_day", "_tv", "_n")


def order_flow(bars: DataFrame, frames: Frames = FRAMES) -> DataFrame:
    v, c, spread = F.col("volume"), F.col("close"), F.col("high") - F.col("low") + EPS
    place = (c - F.col("low")) / spread
    out = bars.withColumns(
        {
            "buy_volume": v * place,
            "sell_volume": v * (1 - place),
            "trade_pressure": (c - F.col("open")) / spread,
            "sell_pressure": (F.col("high") - c) / spread,
            "tick_volume": F.signum(c - frames.lag("close")) * v,
        }
    )
    out = out.withColumns({"ofi": F.col("buy_volume") - F.col("sell_volume"), "pressure_volume": F.col("trade_pressure") * v})
    return out.withColumns(
        {
            "ofi_ma10": frames.mean("ofi", 10),
            "ofi_ma20": frames.mean("ofi", 20),
            "cum_ofi": frames.running("ofi"),
            "pressure_ma10": frames.mean("pressure_volume", 10),
            "cum_tick_volume": frames.running("tick_volume"),
        }
    )
