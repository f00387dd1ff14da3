"""Volatility regimes: level series, term structure, rules, run lengths, transitions, mixtures."""

from __future__ import annotations

from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.frames import EPS, Frames, correlation, flag, ratio

FRAMES = Frames()
#: Regime codes: fixed values.
LOW_TREND, LOW_RANGE, HIGH_TREND, HIGH_CHAOS = 0, 1, 2, 3


def level_columns(df: DataFrame, x: str, low: float, high: float, extreme: float, n: int = 252, frames: Frames = FRAMES) -> DataFrame:
    """Zones, percentile, changes, z-score and range of a level series such as a volatility index."""
    v = F.col(x)
    change = ratio(x, frames.lag(x)) - 1
    above = flag(v > 20)
    out = df.withColumns(
        {
            "level_low": flag(v < low),
            "level_mid": flag((v >= low) & (v < high)),
            "level_high": flag((v >= high) & (v < extreme)),
            "level_extreme": flag(v >= extreme),
            "level_percentile": frames.below_share(x, n) * 100,
            **{f"level_roc_{k}": ratio(x, frames.lag(x, k)) - 1 for k in (1, 5, 10)},
            "level_momentum_5": v - frames.mean(x, 5),
            "level_zscore": (v - frames.mean(x, 20)) / (frames.std(x, 20) + EPS),
            "level_above_sma21": flag(v > frames.mean(x, 21)),
            "level_spike": flag(change > 0.10),
            "level_spike_size": F.when(change.isNotNull(), F.greatest(change, F.lit(0.0))),
            "level_contraction": flag(change < -0.05),
            "level_range_5": frames.high(x, 5) - frames.low(x, 5),
            "_a": above,
        }
    )
    return out.withColumn("level_days_above", frames.total("_a", 21)).drop("_a")


def term_structure(df: DataFrame, spot: str, front: str, second: str, n: int = 252, frames: Frames = FRAMES) -> DataFrame:
    s, f, g = F.col(spot), F.col(front), F.col(second)
    out = df.withColumns(
        {
            "basis": s - f,
            "basis_pct": ratio(s - f, spot),
            "contango": flag(f > s),
            "backwardation": flag(s > f),
            "term_spread": f - g,
            "term_slope": ratio(f - g, spot),
        }
    )
    return out.withColumn("basis_percentile", frames.below_share("basis", n) * 100)


def rule_regimes(bars: DataFrame, vol_n: int = 21, median_n: int = 252, frames: Frames = FRAMES) -> DataFrame:
    """Four regimes from volatility and trend against their rolling medians, one-hot flags, changes and run lengths."""
    out = bars.withColumns({"_r": F.ln(ratio("close", frames.lag("close"))), "_t": F.abs(ratio("close", frames.lag("close", vol_n)) - 1)})
    out = out.withColumn("_v", frames.std("_r", vol_n) * F.sqrt(F.lit(252.0)))
    out = out.withColumns({"_vm": frames.quantile("_v", median_n, 0.5), "_tm": frames.quantile("_t", median_n, 0.5)})
    high, low = flag(F.col("_v") > F.col("_vm") * 1.2) == 1, flag(F.col("_v") < F.col("_vm") * 0.8) == 1
    trend = flag(F.col("_t") > F.col("_tm")) == 1
    regime = F.when(high & trend, HIGH_TREND).when(high, HIGH_CHAOS).when(low & trend, LOW_TREND).otherwise(LOW_RANGE)
    out = out.withColumn("regime", regime)
    for name, code in (("low_trend", LOW_TREND), ("low_range", LOW_RANGE), ("high_trend", HIGH_TREND), ("high_chaos", HIGH_CHAOS)):
        out = out.withColumn(f"regime_{name}", flag(F.col("regime") == code))
    return run_lengths(out, "regime", frames).drop("_r", "_t", "_v", "_vm", "_tm")


def run_lengths(df: DataFrame, x: str, frames: Frames = FRAMES) -> DataFrame:
    """``{x}_change`` (1 on each first row of a run) and ``{x}_duration``, the place in the run from 1."""
    out = df.withColumn("_c", F.coalesce(~F.col(x).eqNullSafe(frames.lag(x)), F.lit(True)).cast("int"))
    out = out.withColumn("_c", F.when(F.row_number().over(frames.window) == 1, 1).otherwise(F.col("_c")))
    out = out.withColumn("_g", frames.running("_c"))
    place = F.row_number().over(Window.partitionBy(*frames.keys, "_g").orderBy(*frames.order))
    return out.withColumns({f"{x}_change": F.col("_c"), f"{x}_duration": place}).drop("_c", "_g")


def transitions(df: DataFrame, x: str, frames: Frames = FRAMES) -> DataFrame:
    """``symbol, state, next, n, p``: how often each state follows another, and its share."""
    pairs = df.select(*frames.keys, F.col(x).alias("state"), frames.lead(x).alias("next")).where("state is not null and next is not null")
    counts = pairs.groupBy(*frames.keys, "state", "next").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*frames.keys, "state")))


def forecast(matrix: DataFrame, steps: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """State probabilities after ``steps`` transitions: ``state, next, p``, by joins of the matrix with itself."""
    one = matrix.select(*keys, "state", "next", "p")
    out = one
    for _ in range(steps - 1):
        hop = one.select(*keys, F.col("state").alias("_mid"), F.col("next").alias("_to"), F.col("p").alias("_p"))
        out = out.withColumnRenamed("next", "_mid").join(hop, [*keys, "_mid"])
        out = out.groupBy(*keys, "state", F.col("_to").alias("next")).agg(F.sum(F.col("p") * F.col("_p")).alias("p"))
    return out


def emissions(df: DataFrame, state: str, value: str, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return df.groupBy(*keys, state).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def autocorrelation(df: DataFrame, x: str, n: int = 21, frames: Frames = FRAMES) -> DataFrame:
    """Lag-one autocorrelation inside windows of ``n`` rows, from their ``n - 1`` inner pairs."""
    out = df.withColumn("_p", frames.lag(x))
    rows = F.count(x).over(frames.back(n))
    return out.withColumn(f"autocorr_{n}", F.when(rows == n, correlation(x, "_p", frames.back(n - 1)))).drop("_p")


def mixture_regimes(df: DataFrame, columns: list[str], k: int = 4, seed: int = 42) -> DataFrame:
    """Gaussian-mixture regime and its probability from standardised columns; rows with a null are left out."""
    rows = VectorAssembler(inputCols=columns, outputCol="_raw").transform(df.dropna(subset=columns))
    rows = StandardScaler(inputCol="_raw", outputCol="_x", withMean=True).fit(rows).transform(rows)
    out = GaussianMixture(k=k, featuresCol="_x", predictionCol="mixture", probabilityCol="_p", seed=seed).fit(rows).transform(rows)
    return out.withColumn("mixture_p", F.array_max(vector_to_array("_p"))).drop("_raw", "_x", "_p")
