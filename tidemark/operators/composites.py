"""Daily sentiment with proxies, macro spreads, snapshot zones, contrarian signals and a model ensemble."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.frames import EPS, Frames, flag, ratio
from tidemark.operators import simulations as M
from tidemark.operators.boosting import boosted_scores
from tidemark.operators.cross import row_mean
from tidemark.operators.joins import previous_day
from tidemark.operators.ranking import fold_scores

FRAMES = Frames()
#: Levels and long-run averages of the sentiment columns: fixed values.
FEAR, EXTREME_FEAR, CALM = 25.0, 30.0, 15.0
BULL_AVERAGE, BEAR_AVERAGE = 37.5, 31.0
PUT_HEAVY, CALL_HEAVY = 1.1, 0.8


def _clip(x, low, high):
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def daily_sentiment(daily: DataFrame, x: str, n: int = 20, frames: Frames = FRAMES) -> DataFrame:
    """Columns of a volatility index, and survey and put/call proxies that follow from it where no own data is."""
    v = F.col(x)
    out = daily.withColumns(
        {
            "vix_ma5": frames.mean(x, 5), "vix_ma10": frames.mean(x, 10), "vix_vs_ma10": ratio(x, frames.mean(x, 10)), "vix_percentile": frames.below_share(x, n),
            "vix_fear": flag(v > FEAR), "vix_extreme_fear": flag(v > EXTREME_FEAR), "vix_calm": flag(v < CALM), "vix_change": ratio(x, frames.lag(x)) - 1,
            "vix_sentiment": -_clip((v - 20) / 15, -1.0, 1.0), "pcr_total": 0.6 + 0.7 * _clip((v - 12) / 25, 0.0, 1.0),
        }
    )
    p = F.coalesce("vix_percentile", F.lit(0.5))
    out = out.withColumns({"vix_spike": flag(F.col("vix_change") > 0.15), "bearish": 25 + p * 30, "bullish": 50 - p * 30})
    bull, bear, pcr = F.col("bullish"), F.col("bearish"), F.col("pcr_total")
    out = out.withColumns(
        {
            "neutral": 100 - bull - bear, "survey_spread": bull - bear, "bull_deviation": bull - BULL_AVERAGE, "bear_deviation": bear - BEAR_AVERAGE,
            "extreme_bullish": flag(bull > 50), "extreme_bearish": flag(bear > 50), "survey_contrarian": (bear - bull) / 100,
            "pcr_ma5": frames.mean("pcr_total", 5), "pcr_put_heavy": flag(pcr > PUT_HEAVY), "pcr_call_heavy": flag(pcr < CALL_HEAVY),
            "pcr_contrarian": _clip((pcr - 0.95) / 0.35, -1.0, 1.0),
        }
    )
    return out.withColumns(
        {
            "composite_contrarian": row_mean([F.col("vix_sentiment"), F.col("survey_contrarian"), F.col("pcr_contrarian")]),
            "fear_regime": flag((F.col("vix_fear") == 1) | (F.col("extreme_bearish") == 1) | (F.col("pcr_put_heavy") == 1)),
            "greed_regime": flag((F.col("vix_calm") == 1) | (F.col("extreme_bullish") == 1) | (F.col("pcr_call_heavy") == 1)),
        }
    )


def aligned_sentiment(bars: DataFrame, daily: DataFrame, columns: list[str], day: str = "date") -> DataFrame:
    """Bars with the sentiment of the day before, gaps filled forwards, then backwards, then with 0."""
    return previous_day(bars, daily, columns, day=day)


def macro_spreads(daily: DataFrame, ten: str, two: str, corporate: str, breakeven: str, frames: Frames = FRAMES) -> DataFrame:
    """Yield curve and its inversion, credit spread, real rate and rate momentum."""
    curve = F.col(ten) - F.col(two)
    return daily.withColumns(
        {
            "yield_curve": curve, "curve_inverted": flag(curve < 0), "credit_spread": F.col(corporate) - F.col(ten), "real_rate": F.col(ten) - F.col(breakeven),
            "rate_mom_5": F.col(ten) - frames.lag(ten, 5), "rate_mom_20": F.col(ten) - frames.lag(ten, 20),
        }
    )


def snapshot_zones(bars: DataFrame, score: str, news: str, posts: str, frames: Frames = FRAMES) -> DataFrame:
    """Zones of a 0 to 100 score, divergence of news from price, and social volume against volatility."""
    g = F.col(score)
    out = bars.withColumn("_r", ratio("close", frames.lag("close")) - 1)
    up = F.coalesce(frames.mean("_r", 20) > 0, F.lit(False))
    edges = (("extreme_fear", None, 25), ("fear", 25, 45), ("neutral_zone", 45, 55), ("greed", 55, 75), ("extreme_greed", 75, None))
    zones = {f"zone_{n}": flag((g >= lo if lo is not None else F.lit(True)) & (g < hi if hi is not None else F.lit(True)) & g.isNotNull()) for n, lo, hi in edges}
    return out.withColumns(
        zones | {"score_share": g / 100, "news_divergence": F.when(up, -F.col(news)).otherwise(F.col(news)), "social_intensity": F.col(posts) / (frames.std("_r", 20) * 10000 + 1)}
    ).drop("_r")


def contrarian_signals(df: DataFrame, prob: str, percentile: str, atr: str, high: float = 0.7, low: float = 0.3, min_prob: float = 0.55, tp: float = 2.0, sl: float = 1.0, most: int = 3) -> DataFrame:
    """Against the crowd where volatility is expected to expand: long in fear, short in calm; sized by the probability."""
    p, x = F.col(prob), F.col(percentile)
    side = F.when((p > min_prob) & (x > high), 1).when((p > min_prob) & (x < low), -1).otherwise(0)
    out = df.withColumn("signal", side)
    s = F.col("signal")
    size = F.least(F.greatest(F.floor(1 + (p - min_prob) * 4), F.lit(1)), F.lit(most))
    return out.withColumns(
        {
            "size": F.when(s != 0, size).otherwise(0).cast("int"),
            "tp_price": F.when(s != 0, F.col("close") + s * tp * F.col(atr)).otherwise(0.0),
            "sl_price": F.when(s != 0, F.col("close") - s * sl * F.col(atr)).otherwise(0.0),
        }
    )


def holding_statistics(trades: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Minutes held, contracts, span of days and trades a day."""
    minutes = (F.unix_micros(F.col("exit_time").cast("timestamp")) - F.unix_micros(F.col("entry_time").cast("timestamp"))) / 60e6
    return trades.groupBy(*keys).agg(
        F.avg(minutes).alias("avg_minutes"), F.min(minutes).alias("min_minutes"), F.max(minutes).alias("max_minutes"), F.avg("contracts").alias("avg_contracts"),
        F.max("contracts").alias("max_contracts"), F.sum("contracts").alias("total_contracts"), (F.datediff(F.max("entry_time"), F.min("entry_time")) + 1).alias("total_days"),
    )


def bootstrap_sharpe(returns: DataFrame, x: str, sims: int, keys: tuple[str, ...] = ("model",), id_col: str = "date", year: float = 252.0) -> DataFrame:
    """Point estimate and 95 % interval of the annualised Sharpe ratio over resamples with replacement."""
    point = returns.groupBy(*keys).agg((F.avg(x) / (F.stddev_pop(x) + EPS) * F.lit(year**0.5)).alias("sharpe"))
    return point.join(M.intervals(M.sharpe_runs(returns, x, sims, keys, id_col, year), "sharpe", keys), list(keys))


def bootstrap_total(trades: DataFrame, sims: int, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Total profit and its 95 % interval over resamples with replacement."""
    total = trades.groupBy(*keys).agg(F.sum("net_pnl").alias("net_pnl"))
    return total.join(M.intervals(M.runs(trades, sims, M.BOOTSTRAP, keys), "net_pnl", keys), list(keys))


def ensemble_scores(members: DataFrame, columns: list[str], targets: dict[str, str], kinds: dict[str, str] | None = None) -> DataFrame:
    """Out-of-fold scores of several models side by side: ``{score column: target column}``, each with its own kind.

    The boosted ones are fitted together.
    """
    parts = []
    boosted = {n: t for n, t in targets.items() if (kinds or {}).get(n, "gbt") == "gbt"}
    if boosted:
        scores = boosted_scores(members, columns, sorted(set(boosted.values())))
        parts += [scores.where(F.col("target") == t).select("symbol", "ts", "fold", F.col("score").alias(n)) for n, t in boosted.items()]
    for name, target in targets.items():
        if name in boosted:
            continue
        one = fold_scores(members, columns, target, kinds[name])
        parts.append(one.select("symbol", "ts", "fold", F.col("score").alias(name)))
    return reduce(lambda a, b: a.join(b, ["symbol", "ts", "fold"]), parts)
