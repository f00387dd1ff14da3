"""Fixed model inputs: the 42-column vector and the lagged barrier-pipeline columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import EPS, Frames, ratio
from tidemark.operators.price import simple_return, true_range

FRAMES = Frames()
#: The order of the model's inputs is a contract: fixed values.
VECTOR = (
    [f"return_lag{k}" for k in (1, 2, 3, 5, 10, 20)]
    + [f"{n}_{p}" for p in (5, 10, 14, 20) for n in ("rv", "atr", "atr_pct")]
    + [f"{n}_{p}" for p in (10, 20, 50) for n in ("close_vs_high", "close_vs_low", "range_pct")]
    + [f"{n}_{p}" for p in (5, 10, 20) for n in ("momentum", "ma_dist")]
    + ["rsi_7", "rsi_14", "bb_pct_20"]
    + [f"{n}_{p}" for p in (5, 10, 20) for n in ("volume_sma", "volume_ratio")]
)


def model_vector(bars: DataFrame, frames: Frames = FRAMES, with_range: bool = True) -> DataFrame:
    """Bars with the 42 model inputs; without the range columns it is the ensemble's variant."""
    c = F.col("close")
    out = bars.withColumns({"_tr": true_range(frames), "_r": simple_return(1, frames), "_d": c - frames.lag("close")})
    out = out.withColumns({"_g": F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0), "_l": F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0)})
    made = {f"return_lag{k}": simple_return(k, frames) for k in (1, 2, 3, 5, 10, 20)}
    for p in (5, 10, 14, 20):
        made |= {f"rv_{p}": frames.std("_r", p), f"atr_{p}": frames.mean("_tr", p), f"atr_pct_{p}": ratio(frames.mean("_tr", p), "close")}
    for p in (10, 20, 50):
        top, bottom = frames.high("high", p), frames.low("low", p)
        made |= {f"close_vs_high_{p}": ratio(c - top, "close"), f"close_vs_low_{p}": ratio(c - bottom, "close"), f"range_pct_{p}": ratio(top - bottom, "close")}
    for p in (5, 10, 20):
        made |= {f"momentum_{p}": simple_return(p, frames), f"ma_dist_{p}": ratio(c, frames.mean("close", p)) - 1}
    for p in (7, 14):
        made[f"rsi_{p}"] = 100 - 100 / (1 + frames.mean("_g", p) / (frames.mean("_l", p) + EPS))
    mid, sd = frames.mean("close", 20), frames.std("close", 20)
    made["bb_pct_20"] = (c - (mid - 2 * sd)) / (4 * sd + EPS)
    for p in (5, 10, 20):
        made |= {f"volume_sma_{p}": frames.mean("volume", p), f"volume_ratio_{p}": F.col("volume") / (frames.mean("volume", p) + 1)}
    out = out.withColumns(made).drop("_tr", "_r", "_d", "_g", "_l")
    return out if with_range else out.drop(*[f"range_pct_{p}" for p in (10, 20, 50)])


def barrier_inputs(bars: DataFrame, frames: Frames = FRAMES) -> DataFrame:
    """Columns of the barrier pipeline, all one extra bar late."""
    c = frames.lag("close")
    out = bars.withColumns({"_d": F.col("close") - frames.lag("close"), "_c": c})
    out = out.withColumns(
        {"_g": F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0), "_l": F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0)}
        | {f"_m{p}": frames.mean("close", p) for p in (10, 20)}
        | {f"_k{k}": simple_return(k, frames) for k in (1, 2, 3, 5, 10)}
    )
    out = out.withColumns({f"_s{p}": 100 - 100 / (1 + frames.mean("_g", p) / F.when(frames.mean("_l", p) == 0, EPS).otherwise(frames.mean("_l", p))) for p in (7, 14)})
    made = {f"return_late{k}": frames.lag(f"_k{k}") for k in (1, 2, 3, 5, 10)}
    made |= {f"momentum_late{p}": ratio(F.col("_c"), frames.lag("close", p + 1)) - 1 for p in (5, 10, 20)}
    made |= {f"to_ma_late{p}": ratio(F.col("_c"), frames.lag(f"_m{p}")) - 1 for p in (10, 20)}
    made |= {f"rsi_late{p}": frames.lag(f"_s{p}") for p in (7, 14)}
    made |= {"bars_since_open": (F.hour("ts") - 9) * 12 + F.floor(F.minute("ts") / 5)}
    return out.withColumns(made).drop("_d", "_c", "_g", "_l", "_m10", "_m20", *[f"_k{k}" for k in (1, 2, 3, 5, 10)], "_s7", "_s14")
