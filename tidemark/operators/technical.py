"""Trend, momentum, volatility and volume indicators as window expressions.

Each function adds its columns to a bar table. Values that are frames over other frames are
added in layers that share one partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import EPS, Frames, flag, ratio
from tidemark.operators.price import simple_return, true_range
from tidemark.operators.recursive import ema, hurst_udf

FRAMES = Frames()


def moving_averages(bars: DataFrame, periods: tuple[int, ...] = (5, 10, 20, 50, 100, 200), frames: Frames = FRAMES) -> DataFrame:
    """SMA, the distance of the close from it, and its change over five bars."""
    out = bars.withColumns({f"sma_{n}": frames.mean("close", n) for n in periods})
    return out.withColumns(
        {f"sma_{n}_dist": ratio("close", f"sma_{n}") - 1 for n in periods}
        | {f"sma_{n}_slope": ratio(f"sma_{n}", frames.lag(f"sma_{n}", 5)) - 1 for n in periods}
    )


def crosses(bars: DataFrame, fast: int = 50, slow: int = 200, frames: Frames = FRAMES) -> DataFrame:
    out = bars.withColumns({"_f": frames.mean("close", fast), "_s": frames.mean("close", slow)})
    f, s = F.col("_f"), F.col("_s")
    pf, ps = frames.lag("_f"), frames.lag("_s")
    return out.withColumns(
        {
            "golden_cross": flag((f > s) & (pf <= ps)),
            "death_cross": flag((f < s) & (pf >= ps)),
            "above_fast": flag(F.col("close") > f),
            "above_slow": flag(F.col("close") > s),
            "fast_above_slow": flag(f > s),
        }
    ).drop("_f", "_s")


def ema_columns(bars: DataFrame, periods: tuple[int, ...] = (5, 10, 20, 50, 100, 200)) -> DataFrame:
    return ema(bars, {f"ema_{n}": ("close", n) for n in periods})


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, frames: Frames = FRAMES) -> DataFrame:
    out = ema(bars, {"_ef": ("close", fast), "_es": ("close", slow)}).withColumn("macd", F.col("_ef") - F.col("_es"))
    out = ema(out, {"macd_signal": ("macd", signal)})
    out = out.withColumn("macd_hist", F.col("macd") - F.col("macd_signal"))
    m, s = F.col("macd"), F.col("macd_signal")
    return out.withColumns(
        {
            "macd_norm": ratio("macd", "close"),
            "macd_cross_up": flag((m > s) & (frames.lag("macd") <= frames.lag("macd_signal"))),
            "macd_cross_down": flag((m < s) & (frames.lag("macd") >= frames.lag("macd_signal"))),
        }
    ).drop("_ef", "_es")


def adx(bars: DataFrame, periods: tuple[int, ...] = (14, 20), frames: Frames = FRAMES) -> DataFrame:
    """Directional indicators from rolling means."""
    up, down = F.col("high") - frames.lag("high"), frames.lag("low") - F.col("low")
    out = bars.withColumns({"_up": up, "_down": down, "_tr": true_range(frames)})
    u, d = F.col("_up"), F.col("_down")
    out = out.withColumns({"_pdm": F.when((u > d) & (u > 0), u).otherwise(0.0), "_mdm": F.when((d > u) & (d > 0), d).otherwise(0.0)})
    for n in periods:
        spread = frames.mean("_tr", n) + EPS
        out = out.withColumns({f"plus_di_{n}": 100 * frames.mean("_pdm", n) / spread, f"minus_di_{n}": 100 * frames.mean("_mdm", n) / spread})
        p, m = F.col(f"plus_di_{n}"), F.col(f"minus_di_{n}")
        out = out.withColumn("_dx", 100 * F.abs(p - m) / (p + m + EPS)).withColumn(f"adx_{n}", frames.mean("_dx", n))
    return out.drop("_up", "_down", "_tr", "_pdm", "_mdm", "_dx")


def aroon(bars: DataFrame, n: int = 25, frames: Frames = FRAMES) -> DataFrame:
    highs, lows = frames.values("high", n), frames.values("low", n)
    out = bars.withColumns(
        {
            "aroon_up": F.array_position(highs, F.array_max(highs)) / F.lit(float(n)) * 100,
            "aroon_down": F.array_position(lows, F.array_min(lows)) / F.lit(float(n)) * 100,
        }
    )
    return out.withColumn("aroon_osc", F.col("aroon_up") - F.col("aroon_down"))


def rsi(bars: DataFrame, periods: tuple[int, ...] = (7, 14, 21), frames: Frames = FRAMES) -> DataFrame:
    """RSI from rolling means of gains and losses, with overbought and oversold flags."""
    d = F.col("close") - frames.lag("close")
    out = bars.withColumn("_d", d).withColumns({"_g": F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0), "_l": F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0)})
    out = out.withColumns({f"rsi_{n}": 100 - 100 / (1 + frames.mean("_g", n) / (frames.mean("_l", n) + EPS)) for n in periods})
    flags = {f"rsi_{n}_high": flag(F.col(f"rsi_{n}") > 70) for n in periods} | {f"rsi_{n}_low": flag(F.col(f"rsi_{n}") < 30) for n in periods}
    return out.withColumns(flags).drop("_d", "_g", "_l")


def stochastic(bars: DataFrame, n: int = 14, smooth: int = 3, frames: Frames = FRAMES) -> DataFrame:
    low, high = frames.low("low", n), frames.high("high", n)
    out = bars.withColumn("stoch_k", 100 * (F.col("close") - low) / (high - low + EPS))
    out = out.withColumn("stoch_d", frames.mean("stoch_k", smooth))
    return out.withColumns({"stoch_high": flag(F.col("stoch_k") > 80), "stoch_low": flag(F.col("stoch_k") < 20)})


def cci(bars: DataFrame, n: int = 20, frames: Frames = FRAMES) -> DataFrame:
    """Commodity channel index with the mean absolute deviation around each window's own mean."""
    out = bars.withColumn("_t", (F.col("high") + F.col("low") + F.col("close")) / 3)
    out = out.withColumns({"_m": frames.mean("_t", n), "_v": frames.values("_t", n)})
    off = F.aggregate("_v", F.lit(0.0), lambda s, x: s + F.abs(x - F.col("_m"))) / F.lit(float(n))
    return out.withColumn(f"cci_{n}", (F.col("_t") - F.col("_m")) / (0.015 * off + EPS)).drop("_t", "_m", "_v")


def momentum(bars: DataFrame, periods: tuple[int, ...] = (5, 10, 20), n: int = 14, frames: Frames = FRAMES) -> DataFrame:
    """Rate of change and Williams %R."""
    low, high = frames.low("low", n), frames.high("high", n)
    return bars.withColumns(
        {f"roc_{k}": 100 * simple_return(k, frames) for k in periods}
        | {f"williams_r_{n}": -100 * (high - F.col("close")) / (high - low + EPS)}
    )


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, squeeze: int = 50, frames: Frames = FRAMES) -> DataFrame:
    out = bars.withColumns({"bb_mid": frames.mean("close", n), "_sd": frames.std("close", n)})
    out = out.withColumns({"bb_upper": F.col("bb_mid") + k * F.col("_sd"), "bb_lower": F.col("bb_mid") - k * F.col("_sd")})
    out = out.withColumns(
        {
            "bb_pct": (F.col("close") - F.col("bb_lower")) / (F.col("bb_upper") - F.col("bb_lower") + EPS),
            "bb_width": ratio(F.col("bb_upper") - F.col("bb_lower"), "bb_mid"),
        }
    )
    return out.withColumn("bb_squeeze", flag(F.col("bb_width") < frames.mean("bb_width", squeeze))).drop("_sd")


def channels(bars: DataFrame, n: int = 20, k: float = 2.0, frames: Frames = FRAMES) -> DataFrame:
    """Keltner channel (EMA and ATR) and Donchian channel."""
    out = ema(bars, {"kc_mid": ("close", n)}).withColumn("_tr", true_range(frames)).withColumn("_atr", frames.mean("_tr", n))
    out = out.withColumns({"kc_upper": F.col("kc_mid") + k * F.col("_atr"), "kc_lower": F.col("kc_mid") - k * F.col("_atr")})
    out = out.withColumn("kc_position", (F.col("close") - F.col("kc_lower")) / (F.col("kc_upper") - F.col("kc_lower") + EPS))
    return donchian(out, n, frames).drop("_tr", "_atr")


def donchian(bars: DataFrame, n: int = 20, frames: Frames = FRAMES) -> DataFrame:
    out = bars.withColumns({"dc_upper": frames.high("high", n), "dc_lower": frames.low("low", n)})
    return out.withColumn("dc_position", (F.col("close") - F.col("dc_lower")) / (F.col("dc_upper") - F.col("dc_lower") + EPS))


def obv(bars: DataFrame, n: int = 20, frames: Frames = FRAMES, first_zero: bool = True) -> DataFrame:
    """On-balance volume and its trend; ``first_zero`` counts the first bar as no move, else it is null."""
    d = F.signum(F.col("close") - frames.lag("close")) * F.col("volume")
    out = bars.withColumn("_d", F.coalesce(d, F.lit(0.0)) if first_zero else d)
    out = out.withColumn("obv", frames.running("_d")).withColumn("_m", frames.mean("obv", n))
    return out.withColumns({"obv_sma": F.col("_m"), "obv_above": flag(F.col("obv") > F.col("_m"))}).drop("_d", "_m")


def vwap(bars: DataFrame, periods: tuple[int, ...] = (20, 50), frames: Frames = FRAMES) -> DataFrame:
    out = bars.withColumns({"_t": (F.col("high") + F.col("low") + F.col("close")) / 3}).withColumn("_tv", F.col("_t") * F.col("volume"))
    out = out.withColumns(
        {f"vwap_{n}": frames.total("_tv", n) / (frames.total("volume", n) + EPS) for n in periods}
        | {"vwap_cum": frames.running("_tv") / (frames.running("volume") + EPS)}
    )
    return out.withColumns({f"vwap_{n}_dist": ratio("close", f"vwap_{n}") - 1 for n in periods}).drop("_t", "_tv")


def money_flow(bars: DataFrame, cmf: int = 21, mfi: int = 14, frames: Frames = FRAMES) -> DataFrame:
    """Chaikin money flow and the money flow index."""
    h, low, c, v = (F.col(x) for x in ("high", "low", "close", "volume"))
    out = bars.withColumns({"_f": ((c - low) - (h - c)) / (h - low + EPS) * v, "_t": (h + low + c) / 3})
    up = F.col("_t") - frames.lag("_t")
    flow = F.col("_t") * v
    out = out.withColumn("_up", up).withColumns({"_p": F.when(F.col("_up") > 0, flow).otherwise(0.0), "_n": F.when(F.col("_up") < 0, flow).otherwise(0.0)})
    out = out.withColumns(
        {
            f"cmf_{cmf}": frames.total("_f", cmf) / (frames.total("volume", cmf) + EPS),
            f"mfi_{mfi}": 100 - 100 / (1 + frames.total("_p", mfi) / (frames.total("_n", mfi) + EPS)),
        }
    )
    return out.withColumns({"mfi_high": flag(F.col(f"mfi_{mfi}") > 80), "mfi_low": flag(F.col(f"mfi_{mfi}") < 20)}).drop("_f", "_t", "_up", "_p", "_n")


def volume_profile(bars: DataFrame, n: int = 20, frames: Frames = FRAMES) -> DataFrame:
    """Relative volume, its changes and trend, and the price-volume trend."""
    out = bars.withColumns(
        {
            f"rel_volume_{n}": F.col("volume") / (frames.mean("volume", n) + EPS),
            "volume_roc_5": ratio("volume", frames.lag("volume", 5)) - 1,
            "volume_trend": frames.mean("volume", 5) / (frames.mean("volume", n) + EPS),
            "_pv": simple_return(1, frames) * F.col("volume"),
        }
    )
    return out.withColumn("pvt", frames.running("_pv")).drop("_pv")


def realised_volatility(bars: DataFrame, periods: tuple[int, ...] = (5, 10, 21), year: float = 252.0, frames: Frames = FRAMES) -> DataFrame:
    """Annualised standard deviation of log returns, and Parkinson's range estimator."""
    out = bars.withColumns({"_r": F.ln(ratio("close", frames.lag("close"))), "_hl": F.pow(F.ln(ratio("high", "low")), 2)})
    scale = F.lit(year**0.5)
    return out.withColumns(
        {f"rv_{n}": frames.std("_r", n) * scale for n in periods}
        | {f"parkinson_{n}": F.sqrt(frames.mean("_hl", n) / (4 * F.ln(F.lit(2.0)))) for n in periods}
    ).drop("_r", "_hl")


def hurst(bars: DataFrame, periods: tuple[int, ...] = (20, 50, 100), frames: Frames = FRAMES) -> DataFrame:
    run = hurst_udf()
    out = bars.withColumn("_r", simple_return(1, frames))
    out = out.withColumns({f"_v{n}": frames.values("_r", n) for n in periods})
    return out.withColumns({f"hurst_{n}": F.nanvl(run(f"_v{n}"), F.lit(None).cast("double")) for n in periods}).drop("_r", *[f"_v{n}" for n in periods])


def clipped(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
