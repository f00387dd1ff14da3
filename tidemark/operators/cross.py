"""Columns across markets and timeframes: correlation, lead and lag, spreads, strength, agreement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import EPS, Frames, flag, ratio
from tidemark.functions.rows import PIECES, piece_of
from tidemark.operators.bars import resample
from tidemark.operators.joins import asof_many
from tidemark.operators.price import true_range

FRAMES = Frames()


def paired(bars: DataFrame, primary: str, related: list[str], pieces: int = PIECES) -> DataFrame:
    """Bars of ``primary`` with ``close_{s}`` of each related symbol, as of the bar's time.

    One pass over all symbols by pieces of time serves every related market: inside a piece the last close
    so far, before its first one the last close of earlier pieces, of which there is one row a piece.
    """
    own, close = F.col("symbol") == primary, lambda s: F.when(F.col("symbol") == s, F.col("close"))
    rows = bars.where(F.col("symbol").isin(primary, *related)).withColumn("_piece", piece_of(bars, "ts", pieces))
    w = Window.partitionBy("_piece").orderBy("ts", own).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumns({f"close_{s}": F.last(close(s), ignorenulls=True).over(w) for s in related}).where(own)
    ends = rows.groupBy("_piece").agg(*[F.max_by(close(s), F.when(close(s).isNotNull(), F.col("ts"))).alias(f"_e_{s}") for s in related])
    before = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)  # one row a piece
    starts = ends.select("_piece", *[F.last(f"_e_{s}", ignorenulls=True).over(before).alias(f"_e_{s}") for s in related])
    out = seen.join(F.broadcast(starts), "_piece")
    out = out.withColumns({f"close_{s}": F.coalesce(f"close_{s}", f"_e_{s}") for s in related}).drop("_piece", *[f"_e_{s}" for s in related])
    made = {"ret": ratio("close", FRAMES.lag("close")) - 1}
    return out.withColumns(made | {f"ret_{s}": ratio(f"close_{s}", FRAMES.lag(f"close_{s}")) - 1 for s in related})


def correlations(pairs: DataFrame, related: list[str], windows: tuple[int, ...] = (10, 20, 50), frames: Frames = FRAMES) -> DataFrame:
    made = {f"corr_{s}_{n}": frames.corr("ret", f"ret_{s}", n) for s in related for n in windows}
    made |= {f"corr_change_{s}": frames.corr("ret", f"ret_{s}", 5) - frames.corr("ret", f"ret_{s}", 20) for s in related}
    return pairs.withColumns(made)


def lead_lag(pairs: DataFrame, s: str, lags: tuple[int, ...] = (1, 5, 10), n: int = 20, frames: Frames = FRAMES) -> DataFrame:
    """Correlation with the other market's earlier returns and of its returns with earlier own ones, and the best lag."""
    out = pairs.withColumns({f"_o{k}": frames.lag(f"ret_{s}", k) for k in lags} | {f"_p{k}": frames.lag("ret", k) for k in lags})
    out = out.withColumns({f"lead_{k}": frames.corr("ret", f"_o{k}", n) for k in lags} | {f"lag_{k}": frames.corr(f"ret_{s}", f"_p{k}", n) for k in lags})
    sizes = F.array(*[F.abs(F.col(f"lead_{k}")) for k in lags])
    full = reduce(lambda a, b: a & b, [F.col(f"lead_{k}").isNotNull() for k in lags])
    best = F.element_at(F.array(*[F.lit(k) for k in lags]), F.array_position(sizes, F.array_max(sizes)).cast("int"))
    return out.withColumn("best_lag", F.when(full, best)).drop(*[f"_{x}{k}" for k in lags for x in "op"])


def spreads(pairs: DataFrame, s: str, frames: Frames = FRAMES) -> DataFrame:
    out = pairs.withColumn("spread", F.col("ret") - F.col(f"ret_{s}"))
    return out.withColumns(
        {
            "spread_ma5": frames.mean("spread", 5),
            "spread_zscore": (F.col("spread") - frames.mean("spread", 20)) / (frames.std("spread", 20) + EPS),
            "risk_on": flag(frames.mean("spread", 5) > 0),
            "flight": flag((F.col("ret") < 0) & (F.col(f"ret_{s}") > 0)),
        }
    )


def relative_strength(pairs: DataFrame, s: str, frames: Frames = FRAMES) -> DataFrame:
    out = pairs.withColumn("rs", ratio("close", f"close_{s}"))
    return out.withColumns(
        {
            "rs_mom5": ratio("rs", frames.lag("rs", 5)) - 1,
            "rs_mom20": ratio("rs", frames.lag("rs", 20)) - 1,
            "rs_vs_ma20": ratio("rs", frames.mean("rs", 20)),
        }
    )


def row_mean(columns: list[Column]) -> Column:
    """Mean of a row's non-null values."""
    present = F.array_compact(F.array(*columns))
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda s, x: s + x) / F.size(present))


def row_std(columns: list[Column]) -> Column:
    """Sample standard deviation of a row's non-null values."""
    present, mean = F.array_compact(F.array(*columns)), row_mean(columns)
    return F.when(F.size(present) > 1, F.sqrt(F.aggregate(present, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / (F.size(present) - 1)))


def correlation_regimes(pairs: DataFrame, related: list[str], n: int = 20, frames: Frames = FRAMES) -> DataFrame:
    out = pairs.withColumns({f"_c_{s}": frames.corr("ret", f"ret_{s}", n) for s in related})
    out = out.withColumn("avg_corr", row_mean([F.col(f"_c_{s}") for s in related]))
    out = out.withColumn("_d", F.col("avg_corr") - frames.lag("avg_corr", 5)).withColumn("_sd", frames.std("_d", 20))
    return out.withColumns(
        {
            "high_corr": flag(F.col("avg_corr") > 0.7),
            "low_corr": flag(F.col("avg_corr") < 0.3),
            "corr_spike_up": flag(F.col("_d") > F.col("_sd") * 2),
            "corr_spike_down": flag(F.col("_d") < -F.col("_sd") * 2),
        }
    ).drop("_d", "_sd", *[f"_c_{s}" for s in related])


def timeframe_columns(bars: DataFrame, minutes: int, frames: Frames = FRAMES) -> DataFrame:
    """Trend, RSI, ATR, range and volume columns of a coarser timeframe, one completed bar late."""
    h = resample(bars, minutes).withColumn("ts", F.col("ts").cast(bars.schema["ts"].dataType))
    d = F.col("close") - frames.lag("close")
    h = h.withColumns({"_d": d, "_tr": true_range(frames)})
    h = h.withColumns({"_g": F.when(F.col("_d") > 0, F.col("_d")).otherwise(0.0), "_l": F.when(F.col("_d") < 0, -F.col("_d")).otherwise(0.0), "_atr": frames.mean("_tr", 14)})
    made = {
        "sma_20": frames.mean("close", 20),
        "trend_up": flag(F.col("_d") > 0),
        "higher_high": flag(F.col("high") > frames.lag("high")),
        "lower_low": flag(F.col("low") < frames.lag("low")),
        "rsi_14": 100 - 100 / (1 + frames.mean("_g", 14) / (frames.mean("_l", 14) + EPS)),
        "roc_5": ratio("close", frames.lag("close", 5)) - 1,
        "atr_14": F.col("_atr"),
        "atr_expansion": flag(F.col("_atr") > frames.mean("_atr", 14)),
        "range_pct": ratio(F.col("high") - F.col("low"), "close"),
        "rel_volume": F.col("volume") / (frames.mean("volume", 20) + EPS),
    }
    h = h.withColumns({f"tf{minutes}_{n}": c for n, c in made.items()})
    names = [f"tf{minutes}_{n}" for n in made]
    return h.withColumns({n: frames.lag(n) for n in names}).select("symbol", "ts", *names)


def multi_timeframe(bars: DataFrame, minutes: list[int], frames: Frames = FRAMES) -> DataFrame:
    """Bars with each coarser timeframe's columns as of their time, and how far the timeframes agree."""
    coarse = [timeframe_columns(bars, m, frames) for m in minutes]
    out = asof_many(bars, [(tf, [c for c in tf.columns if c.startswith("tf")]) for tf in coarse])
    base = flag(F.col("close") > frames.lag("close"))
    out = out.withColumn("_b", base)
    trends = [F.col("_b").cast("double"), *[F.col(f"tf{m}_trend_up").cast("double") for m in minutes]]
    rsis = [F.col(f"tf{m}_rsi_14") for m in minutes]
    total = F.aggregate(F.array_compact(F.array(*trends)), F.lit(0.0), lambda s, x: s + x)
    return out.withColumns(
        {
            "trend_agreement": row_mean(trends),
            "all_up": flag(total == len(trends)),
            "all_down": flag(total == 0),
            "base_vs_coarse": F.col("_b") - row_mean(trends[1:]),
            "rsi_mean": row_mean(rsis),
            "rsi_std": row_std(rsis),
            "expansion": row_mean([F.col(f"tf{m}_atr_expansion").cast("double") for m in minutes]),
        }
    ).drop("_b")
