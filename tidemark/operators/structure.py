"""Pyramiding, averaging zones, confirmed pivots and pivot levels, all from past bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import EPS, Frames, flag, ratio
from tidemark.operators.price import true_range

FRAMES = Frames()


def pyramiding(bars: DataFrame, lookbacks: tuple[int, ...] = (5, 10, 20), frames: Frames = FRAMES) -> DataFrame:
    c = F.col("close")
    out = bars.withColumns({"_pc": frames.lag("close"), "_tr": true_range(frames), "_r": ratio("close", frames.lag("close")) - 1})
    out = out.withColumns({"_atr": frames.mean("_tr", 14), "_vol": frames.std("_r", 20), "_up": flag(F.col("_r") > 0), "_sma10": frames.mean("close", 10)})
    for n in lookbacks:
        top, bottom = frames.full("high", n, F.max, frames.before(n)), frames.full("low", n, F.min, frames.before(n))
        out = out.withColumns({"_f": (top - F.col("_pc")) / (F.col("_pc") + EPS), "_a": (F.col("_pc") - bottom) / (F.col("_pc") + EPS)})
        out = out.withColumns(
            {
                f"pyramid_rr_{n}": F.col("_f") / (F.col("_a") + EPS),
                f"pyramid_long_{n}": flag((F.col("_f") > 0.005) & (F.col("_a") < 0.003)),
                f"pyramid_short_{n}": flag((F.col("_a") > 0.005) & (F.col("_f") < 0.003)),
            }
        )
    out = out.withColumn("pyramid_calm", flag(F.col("_vol") < frames.mean("_vol", 50)))
    for k in (1, 2, 3):
        out = out.withColumns(
            {
                f"pyramid_add_{k}_long": flag(c < F.col("_sma10") - F.col("_atr") * (0.5 * k)),
                f"pyramid_add_{k}_short": flag(c > F.col("_sma10") + F.col("_atr") * (0.5 * k)),
            }
        )
    out = out.withColumns(
        {f"trend_consistency_{n}": frames.total("_up", n) / n for n in (10, 20)} | {f"pyramid_momentum_{n}": ratio("close", frames.lag("close", n)) - 1 for n in (10, 20)}
    )
    return out.withColumns({f"trend_accel_{n}": F.col(f"pyramid_momentum_{n}") - frames.lag(f"pyramid_momentum_{n}") for n in (10, 20)}).drop(
        "_pc", "_tr", "_r", "_atr", "_vol", "_up", "_sma10", "_f", "_a"
    )


def averaging_zones(bars: DataFrame, frames: Frames = FRAMES) -> DataFrame:
    """Places in the recent range, buy and sell zones, distances in ATR and how past zones worked out."""
    c = F.col("close")
    out = bars.withColumn("_tr", true_range(frames)).withColumn("_atr", frames.mean("_tr", 14))
    for n in (20, 50):
        low, high = frames.low("low", n), frames.high("high", n)
        out = out.withColumn(f"range_position_{n}", (c - low) / (high - low + EPS))
        p = F.col(f"range_position_{n}")
        out = out.withColumns(
            {f"buy_zone_{n}": flag(p < 0.3), f"strong_buy_{n}": flag(p < 0.15), f"sell_zone_{n}": flag(p > 0.7), f"strong_sell_{n}": flag(p > 0.85)}
        )
    out = out.withColumns(
        {"atr_from_high": (frames.high("high", 20) - c) / (F.col("_atr") + EPS), "atr_from_low": (c - frames.low("low", 20)) / (F.col("_atr") + EPS)}
    )
    for k in (1, 2, 3):
        out = out.withColumns({f"buy_level_{k}": flag(F.col("atr_from_high") >= k), f"sell_level_{k}": flag(F.col("atr_from_low") >= k)})
    for n in (10, 20):
        past = frames.lag("close", n)
        out = out.withColumns(
            {
                f"buy_pattern_{n}": flag((frames.lag("buy_zone_20", n) == 1) & (frames.lag("close") > past)),
                f"sell_pattern_{n}": flag((frames.lag("sell_zone_20", n) == 1) & (frames.lag("close") < past)),
            }
        )
        out = out.withColumns({f"buy_effect_{n}": frames.mean(f"buy_pattern_{n}", 50), f"sell_effect_{n}": frames.mean(f"sell_pattern_{n}", 50)})
    return out.drop("_tr", "_atr")


def confirmed_pivots(bars: DataFrame, lookback: int = 10, confirm: int = 5, touches: int = 50, frames: Frames = FRAMES) -> DataFrame:
    """Pivots known ``confirm`` bars later, the last levels, touches, wicks, breakouts and failed ones."""
    c, h, low = F.col("close"), F.col("high"), F.col("low")
    span = lookback + confirm
    top, bottom = frames.full("high", span, F.max, frames.before(span)), frames.full("low", span, F.min, frames.before(span))
    out = bars.withColumns({"pivot_high": flag(frames.lag("high", confirm) >= top), "pivot_low": flag(frames.lag("low", confirm) <= bottom)})
    out = out.withColumns(
        {"last_high": frames.filled(F.when(F.col("pivot_high") == 1, h)), "last_low": frames.filled(F.when(F.col("pivot_low") == 1, low))}
    )
    wick_up, wick_down, body = h - F.greatest("open", "close"), F.least("open", "close") - low, F.abs(c - F.col("open"))
    out = out.withColumns(
        {
            "to_resistance": ratio(F.col("last_high") - c, "close") * 100,
            "to_support": ratio(c - F.col("last_low"), "close") * 100,
            "_rz": flag(ratio(F.abs(h - F.col("last_high")), "last_high") < 0.002),
            "_sz": flag(ratio(F.abs(low - F.col("last_low")), "last_low") < 0.002),
            "upper_wick": wick_up / (body + wick_up + wick_down + EPS),
            "lower_wick": wick_down / (body + wick_up + wick_down + EPS),
            "_ph": frames.full("high", 20, F.max, frames.before(20)),
            "_pl": frames.full("low", 20, F.min, frames.before(20)),
        }
    )
    return out.withColumns(
        {
            "near_resistance": flag(F.abs("to_resistance") < 0.2),
            "near_support": flag(F.abs("to_support") < 0.2),
            "resistance_touches": frames.total("_rz", touches),
            "support_touches": frames.total("_sz", touches),
            "rejection_high": flag((F.col("pivot_high") == 1) & (F.col("upper_wick") > 0.5)),
            "rejection_low": flag((F.col("pivot_low") == 1) & (F.col("lower_wick") > 0.5)),
            "breakout_high": flag(c > F.col("_ph")),
            "breakout_low": flag(c < F.col("_pl")),
            "failed_high": flag((frames.lag("close") > frames.lag("_ph")) & (c < F.col("_ph"))),
            "failed_low": flag((frames.lag("close") < frames.lag("_pl")) & (c > F.col("_pl"))),
        }
    ).drop("_rz", "_sz", "_ph", "_pl")


def pivot_levels(bars: DataFrame, n: int = 20, frames: Frames = FRAMES) -> DataFrame:
    """Classic, Fibonacci and Camarilla levels over a rolling session."""
    c = F.col("close")
    out = bars.withColumns({"_h": frames.high("high", n), "_l": frames.low("low", n), "_c": frames.lag("close")})
    h, low, last = F.col("_h"), F.col("_l"), F.col("_c")
    out = out.withColumns({"pivot_point": (h + low + last) / 3, "_w": h - low})
    p, w = F.col("pivot_point"), F.col("_w")
    made = {"s1": 2 * p - h, "s2": p - w, "s3": low - 2 * (h - p), "r1": 2 * p - low, "r2": p + w, "r3": h + 2 * (p - low)}
    for i, k in enumerate((0.382, 0.618, 1.0), 1):
        made |= {f"fib_s{i}": p - k * w, f"fib_r{i}": p + k * w}
    for i, k in enumerate((12, 6, 4), 1):
        made |= {f"cam_s{i}": last - w * 1.1 / k, f"cam_r{i}": last + w * 1.1 / k}
    out = out.withColumns(made)
    return out.withColumns(
        {"to_pivot": ratio(c - p, p) * 100, "above_pivot": flag(c > p), "above_r1": flag(c > F.col("r1")), "below_s1": flag(c < F.col("s1"))}
    ).drop("_h", "_l", "_c", "_w")
