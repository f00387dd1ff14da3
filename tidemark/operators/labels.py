"""Forward-looking labels. They live apart from feature columns: nothing here may feed a model."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import Frames, flag, ratio
from tidemark.functions.sliding import sliding_quantiles
from tidemark.operators.price import true_range

FRAMES = Frames()
#: Barrier codes: fixed values.
UPPER, LOWER, VERTICAL = 1, -1, 0


def future(x: str | Column, n: int, agg, frames: Frames = FRAMES) -> Column:
    """``agg`` over the next ``n`` rows, null where fewer follow."""
    return frames.full(x, n, agg, frames.ahead(n))


def volatility_targets(bars: DataFrame, horizons: tuple[int, ...] = (5, 10, 20), factor: float = 1.2, year: float = 19656.0, regime_rows: int = 19656, frames: Frames = FRAMES) -> DataFrame:
    """Future realised volatility, ATR and range volatility, expansion and contraction, and the future regime third."""
    out = bars.withColumns({"_r": ratio("close", frames.lag("close")) - 1, "_tr": true_range(frames), "_hl": F.pow(F.ln(ratio("high", "low")), 2)})
    scale = F.sqrt(F.lit(year))
    for h in horizons:
        now, then = frames.std("_r", h) * scale, future("_r", h, F.stddev_samp, frames) * scale
        out = out.withColumns({"_now": now, f"future_rv_{h}": then, f"future_atr_{h}": future("_tr", h, F.avg, frames)})
        out = out.withColumns(
            {
                f"vol_expansion_{h}": flag(F.col(f"future_rv_{h}") > F.col("_now") * factor),
                f"vol_contraction_{h}": flag(F.col(f"future_rv_{h}") < F.col("_now") / factor),
                f"future_parkinson_{h}": F.sqrt(future("_hl", h, F.avg, frames) / (4 * F.ln(F.lit(2.0)))),
            }
        )
    out = out.withColumns({"_rv": frames.std("_r", 20), "_frv": future("_r", 20, F.stddev_samp, frames)})
    out = sliding_quantiles(out, "_rv", regime_rows, {"_q1": 0.33, "_q2": 0.67}, frames.keys, frames.order[0])
    regime = F.when(F.col("_frv") <= F.col("_q1"), 0).when(F.col("_frv") <= F.col("_q2"), 1).otherwise(2)
    return out.withColumn("future_regime", regime).drop("_r", "_tr", "_hl", "_now", "_rv", "_frv", "_q1", "_q2")


def trend_targets(bars: DataFrame, horizons: tuple[int, ...] = (10, 20, 30), dead_band: float = 0.001, frames: Frames = FRAMES) -> DataFrame:
    """Future return, direction outside a dead band, strength, persistence and excursions."""
    out, c = bars, F.col("close")
    for h in horizons:
        out = out.withColumn(f"future_return_{h}", ratio(frames.lead("close", h) - c, "close"))
        r = F.col(f"future_return_{h}")
        past, ahead = F.coalesce(c - frames.lag("close", h) > 0, F.lit(False)), F.coalesce(r > 0, F.lit(False))
        out = out.withColumns(
            {
                f"trend_dir_{h}": F.when(r > dead_band, 1).when(r < -dead_band, 0),
                f"trend_strength_{h}": F.abs(r),
                f"trend_persist_{h}": flag(past == ahead),
                f"mfe_up_{h}": ratio(future("high", h, F.max, frames) - c, "close"),
                f"mfe_down_{h}": ratio(c - future("low", h, F.min, frames), "close"),
            }
        )
    return out


def price_targets(bars: DataFrame, multiples: tuple[float, ...] = (1.0, 1.5, 2.0, 2.5), horizons: tuple[int, ...] = (10, 20, 30), atr_n: int = 14, frames: Frames = FRAMES) -> DataFrame:
    """Whether levels of so many ATR are reached, new highs and lows, upside, downside and their ratio."""
    out = bars.withColumn("_tr", true_range(frames)).withColumn("_atr", frames.mean("_tr", atr_n))
    c = F.col("close")
    for h in horizons:
        out = out.withColumns({"_top": future("high", h, F.max, frames), "_bottom": future("low", h, F.min, frames)})
        made = {
            f"new_high_{h}": flag(F.col("_top") > frames.high("high", h)),
            f"new_low_{h}": flag(F.col("_bottom") < frames.low("low", h)),
            f"upside_{h}": ratio(F.col("_top") - c, "close"),
            f"downside_{h}": ratio(c - F.col("_bottom"), "close"),
        }
        for m in multiples:
            made |= {f"reach_up_{m:g}_{h}": flag(F.col("_top") >= c + m * F.col("_atr")), f"reach_down_{m:g}_{h}": flag(F.col("_bottom") <= c - m * F.col("_atr"))}
        out = out.withColumns(made).withColumn(f"rr_ratio_{h}", F.col(f"upside_{h}") / (F.col(f"downside_{h}") + 0.0001))
    return out.drop("_tr", "_atr", "_top", "_bottom")


def pipeline_targets(bars: DataFrame, frames: Frames = FRAMES) -> DataFrame:
    """Directions, a three-class return with right-closed bins, returns and excursions."""
    c = F.col("close")
    r5 = ratio(frames.lead("close", 5), "close") - 1
    made = {f"target_direction_{h}": flag(frames.lead("close", h) > c) for h in (1, 5)}
    made["target_class_3"] = F.when(r5 <= -0.005, 0).when(r5 <= 0.005, 1).when(r5 > 0.005, 2)
    made |= {f"target_return_{h}": ratio(frames.lead("close", h), "close") - 1 for h in (1, 5, 10, 20)}
    for h in (5, 10):
        made |= {f"target_mfe_{h}": ratio(future("high", h, F.max, frames) - c, "close"), f"target_mae_{h}": ratio(future("low", h, F.min, frames) - c, "close")}
    return bars.withColumns(made)


def strategy_targets(bars: DataFrame, h: int = 10, lookback: int = 20, expansion: float = 1.2, frames: Frames = FRAMES) -> DataFrame:
    """Whether volatility expands, price rises and the range of ``lookback`` bars breaks within ``h`` bars; 0 where that is unknown."""
    out = bars.withColumn("_r", ratio("close", frames.lag("close")) - 1)
    made = {
        "strategy_vol_expansion": flag(future("_r", h, F.stddev_samp, frames) > frames.std("_r", h) * expansion),
        "strategy_direction": flag(frames.lead("close", h) > F.col("close")),
        "strategy_breakout_up": flag(future("high", h, F.max, frames) > frames.high("high", lookback)),
        "strategy_breakout_down": flag(future("low", h, F.min, frames) < frames.low("low", lookback)),
    }
    return out.withColumns(made).drop("_r")


def largest_horizon(names: list[str], default: int = 10) -> int:
    """The largest number that target names end with: how many bars ahead their labels look."""
    return max([int(m[1]) for n in names if (m := re.search(r"_(\d+)$", n))], default=default)


def label_ends(numbered: DataFrame, names: list[str], default: int = 10) -> DataFrame:
    """Rows with ``row_no`` and ``rows``, and ``t1``: the number of the row at which the longest of the named labels is known."""
    return numbered.withColumn("t1", F.least(F.col("row_no") + largest_horizon(names, default), F.col("rows") - 1))


def complete(targets: DataFrame, columns: list[str]) -> DataFrame:
    """Only rows where every target is known; with dead-band directions this also drops flat rows."""
    return targets.dropna(how="any", subset=columns)


def target_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """``target, n, mean, std, distinct``: one row for each target, in one pass."""
    aggs = []
    for c in columns:
        aggs += [F.count(c).alias(f"n_{c}"), F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"), F.countDistinct(c).alias(f"d_{c}")]
    one = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("target"), F.col(f"n_{c}").alias("n"), F.col(f"m_{c}").alias("mean"), F.col(f"s_{c}").alias("std"), F.col(f"d_{c}").alias("distinct")) for c in columns]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@dataclass(frozen=True)
class Barriers:
    """Barrier widths in ATR, or in shares of the entry price."""

    upper: float = 2.0
    lower: float = 1.0
    holding: int = 20
    atr_rows: int = 14
    in_atr: bool = True
    flat: float = 0.0001


#: Barrier presets: fixed values.
PRESETS = {
    "tight_short": Barriers(1.5, 1.0, 6),
    "standard": Barriers(2.0, 1.0, 12),
    "wide_medium": Barriers(2.5, 1.5, 18),
    "wide_long": Barriers(3.0, 2.0, 24),
}


def first_touch(high: str, low: str, close: str, n: int, up: Column, down: Column, side: Column, frames: Frames) -> Column:
    """``struct<bar, upper, last_bar, last_close>``: the first bar ahead that touches a barrier, and which.

    The upper barrier (profit) counts before the lower one in the same bar. For a short side profit
    is below. ``bar`` is null if none is touched; the frame may be shorter than ``n`` at the end.
    """
    ahead = F.collect_list(F.struct(F.col(high).alias("h"), F.col(low).alias("l"), F.col(close).alias("c"))).over(frames.ahead(n))
    return F.struct(ahead.alias("ahead"), up.alias("up"), down.alias("down"), side.alias("side"))


def resolve(touch: str) -> dict[str, Column]:
    """Columns of a resolved :func:`first_touch` struct column."""
    a, up, down, side = (F.col(f"{touch}.{x}") for x in ("ahead", "up", "down", "side"))
    profit = F.transform(a, lambda b: F.when(side >= 0, b["h"] >= up).otherwise(b["l"] <= up))
    loss = F.transform(a, lambda b: F.when(side >= 0, b["l"] <= down).otherwise(b["h"] >= down))
    p, q = F.array_position(profit, True), F.array_position(loss, True)
    first = F.least(F.nullif(p, F.lit(0)), F.nullif(q, F.lit(0)))
    return {
        "bar": first.cast("int"),
        "is_profit": (p > 0) & (p == first),
        "n_ahead": F.size(a),
        "last_close": F.when(F.size(a) > 0, F.element_at(a, -1)["c"]),
    }


def triple_barrier(bars: DataFrame, barriers: Barriers = PRESETS["standard"], side: str | None = None, events: str | None = None, frames: Frames = FRAMES) -> DataFrame:
    """Label 1, -1 or 0, the barrier that was touched, bars held, return and levels.

    The last ``holding`` rows, rows without an ATR and rows outside ``events`` get zeros.
    """
    s = F.col(side).cast("int") if side else F.lit(1)
    out = bars.withColumn("_tr", true_range(frames)).withColumn("_atr", frames.mean("_tr", barriers.atr_rows))
    c = F.col("close")
    wide = (lambda k: k * F.col("_atr")) if barriers.in_atr else (lambda k: k * c)
    up = F.when(s >= 0, c + wide(barriers.upper)).otherwise(c - wide(barriers.upper))
    down = F.when(s >= 0, c - wide(barriers.lower)).otherwise(c + wide(barriers.lower))
    out = out.withColumns({"_up": up, "_down": down})
    out = out.withColumn("_t", first_touch("high", "low", "close", barriers.holding, F.col("_up"), F.col("_down"), s, frames))
    out = out.withColumns({f"_{k}": v for k, v in resolve("_t").items()})
    known = (F.col("_n_ahead") == barriers.holding) & F.col("_atr").isNotNull()
    if events:
        known = known & F.coalesce(F.col(events).cast("boolean"), F.lit(False))
    level = F.when(F.col("_bar").isNull(), F.col("_last_close")).when(F.col("_is_profit"), F.col("_up")).otherwise(F.col("_down"))
    gain = ratio(level - c, "close") * F.when(s >= 0, 1).otherwise(-1)
    out = out.withColumns({"_known": known, "_ret": gain})
    timed = F.when(F.abs("_ret") < barriers.flat, 0).when(F.col("_ret") > 0, 1).otherwise(-1)
    label = F.when(F.col("_bar").isNull(), timed).when(F.col("_is_profit"), 1).otherwise(-1)
    which = F.when(F.col("_bar").isNull(), VERTICAL).when(F.col("_is_profit"), UPPER).otherwise(LOWER)
    zero = lambda x, z: F.when(F.col("_known"), x).otherwise(z)
    return out.withColumns(
        {
            "tb_label": zero(label, 0),
            "tb_barrier": zero(which, VERTICAL),
            "tb_holding": zero(F.coalesce("_bar", F.lit(barriers.holding)), 0),
            "tb_return": zero(F.col("_ret"), 0.0),
            "tb_upper": zero(F.col("_up"), 0.0),
            "tb_lower": zero(F.col("_down"), 0.0),
        }
    ).drop("_tr", "_atr", "_up", "_down", "_t", "_bar", "_is_profit", "_n_ahead", "_last_close", "_known", "_ret")


def meta_labels(df: DataFrame, prediction: str, label: str = "tb_label") -> DataFrame:
    """1 where a long or short prediction agrees with the label."""
    p, y = F.col(prediction), F.col(label)
    return df.withColumn("meta_label", flag(((p == 1) & (y == 1)) | ((p == -1) & (y == -1))))
