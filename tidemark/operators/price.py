"""Prices, returns, ranges and shapes of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import EPS, Frames, ratio

FRAMES = Frames()


def price_levels(bars: DataFrame) -> DataFrame:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return bars.withColumns(
        {
            "mid": (h + low) / 2,
            "typical": (h + low + c) / 3,
            "weighted_close": (h + low + 2 * c) / 4,
            "ohlc_avg": (o + h + low + c) / 4,
        }
    )


def simple_return(k: int, frames: Frames = FRAMES, x: str = "close") -> Column:
    return ratio(x, frames.lag(x, k)) - 1


def log_return(k: int, frames: Frames = FRAMES, x: str = "close") -> Column:
    return F.ln(ratio(x, frames.lag(x, k)))


def returns(bars: DataFrame, periods: tuple[int, ...] = (1, 2, 3, 5, 10, 20, 60), frames: Frames = FRAMES) -> DataFrame:
    return bars.withColumns({f"return_{k}": simple_return(k, frames) for k in periods})


def log_returns(bars: DataFrame, periods: tuple[int, ...] = (1, 5, 20), frames: Frames = FRAMES) -> DataFrame:
    return bars.withColumns({f"log_return_{k}": log_return(k, frames) for k in periods})


def price_ratios(bars: DataFrame, frames: Frames = FRAMES) -> DataFrame:
    return bars.withColumns(
        {
            "high_low_ratio": ratio("high", "low"),
            "close_open_ratio": ratio("close", "open"),
            "gap": ratio("open", frames.lag("close")) - 1,
            "close_position": (F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + EPS),
            **{f"close_to_sma_{n}": ratio("close", frames.mean("close", n)) - 1 for n in (10, 20, 50)},
        }
    )


def true_range(frames: Frames = FRAMES) -> Column:
    """The largest of high - low and the distances to the last close; nulls are skipped."""
    last = frames.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - last), F.abs(F.col("low") - last))


def atr(bars: DataFrame, periods: tuple[int, ...] = (7, 14, 20), frames: Frames = FRAMES) -> DataFrame:
    """``true_range`` and its rolling means; a mean of the range, not a smoothed one."""
    ranged = bars.withColumn("true_range", true_range(frames))
    return ranged.withColumns({f"atr_{n}": frames.mean("true_range", n) for n in periods})


def range_shape(bars: DataFrame, n: int = 20, frames: Frames = FRAMES) -> DataFrame:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    shaped = bars.withColumns(
        {
            "range_pct": ratio(h - low, c),
            "body": F.abs(c - o),
            "upper_shadow": h - F.greatest(o, c),
            "lower_shadow": F.least(o, c) - low,
            "body_ratio": F.abs(c - o) / (h - low + EPS),
        }
    )
    return shaped.withColumn(f"range_percentile_{n}", frames.rank_share("range_pct", n))


def return_statistics(bars: DataFrame, n: int = 20, lags: tuple[int, ...] = (1, 2, 3, 5), frames: Frames = FRAMES) -> DataFrame:
    """Lagged, cumulative, volatility and Sharpe columns of one-bar returns."""
    base = bars.withColumn("return_1", simple_return(1, frames))
    return base.withColumns(
        {
            **{f"return_lag_{k}": frames.lag("return_1", k) for k in lags},
            f"cum_return_{n}": frames.total("return_1", n),
            f"return_vol_{n}": frames.std("return_1", n),
            f"sharpe_{n}": frames.mean("return_1", n) / (frames.std("return_1", n) + EPS),
        }
    )
