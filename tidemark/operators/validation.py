"""Overfitting and dependence statistics from small aggregates.

The tables are reduced by Spark to a few rows (lags, blocks, moments); the closed forms on them
are plain arithmetic.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from tidemark.functions import normal
from tidemark.functions.frames import EPS, correlation
from tidemark.functions.draws import uniform_array


def autocorrelations(series: DataFrame, x: str, lags: int, keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """``lag, n, acf, z, significant``: all lags in one pass over the ordered series."""
    w = Window.partitionBy(*keys).orderBy(order)
    mean = F.avg(x).over(Window.partitionBy(*keys))
    out = series.select(*keys, order, (F.col(x) - mean).alias("_d"))
    out = out.withColumns({f"_l{k}": F.lag("_d", k).over(w) for k in range(1, lags + 1)})
    sums = out.groupBy(*keys).agg(F.count("_d").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("_v"), *[F.sum(F.col("_d") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, lags + 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("lag"), (F.col(f"_s{k}") / F.nullif(F.col("_v"), F.lit(0.0))).alias("acf")) for k in range(1, lags + 1)])
    out = sums.select(*keys, "n", F.explode(rows).alias("r")).select(*keys, "n", "r.lag", "r.acf")
    z = F.col("acf") * F.sqrt("n")
    return out.withColumns({"z": z, "significant": (F.abs(z) > 1.96).cast("int")})


def ljung_box(acf: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The Ljung-Box statistic over the lags of an autocorrelation table, and its chi-square p-value."""
    n = F.col("n")
    out = acf.groupBy(*keys).agg((F.first("n") * (F.first("n") + 2) * F.sum(F.col("acf") ** 2 / (n - F.col("lag")))).alias("q"), F.max("lag").alias("lags"))

    @F.pandas_udf("double")
    def tail(q: pd.Series, lags: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) else normal.chi2_tail(x, int(k)) for x, k in zip(q, lags)], dtype=float)

    return out.withColumn("p_value", tail("q", "lags"))


def suggested_embargo(acf: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The last significant lag of each series, at least 1."""
    return acf.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("significant") == 1, F.col("lag"))), F.lit(1)).alias("embargo"))


def moments(series: DataFrame, x: str, keys: tuple[str, ...] = ("symbol",), year: float = 252.0) -> DataFrame:
    """``n, mean, std, skew, kurtosis`` (excess) and the annualised Sharpe ratio."""
    out = series.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.skewness(x).alias("skew"), F.kurtosis(x).alias("kurtosis"))
    return out.withColumn("sharpe", F.col("mean") / F.nullif(F.col("std"), F.lit(0.0)) * F.lit(math.sqrt(year)))


def deflated_by_logs(moment_rows: DataFrame, trials: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``sharpe, expected_max, statistic, p_value`` with the asymptotic expansion of the largest of ``trials`` normal values."""
    root = math.sqrt(2 * math.log(trials)) if trials > 1 else 0.0
    top = root - (normal.EULER + math.log(2 * math.log(trials))) / (2 * root) if trials > 1 else 0.0
    s, g = F.col("sharpe"), F.col("skew")
    error = F.sqrt((1 + 0.5 * s * s - g * s + F.col("kurtosis") / 4 * s * s) / (F.col("n") - 1))
    out = moment_rows.withColumns({"expected_max": F.lit(top), "statistic": (s - top) / (error + EPS)})

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: 1 - normal.cdf(v), na_action="ignore")

    return out.select(*keys, "sharpe", "expected_max", "statistic", tail("statistic").alias("p_value"))


@dataclass(frozen=True)
class Deflated:
    observed: float
    expected_max: float
    statistic: float
    p_value: float


def expected_max_sharpe(trials: int) -> float:
    """Expected largest of ``trials`` independent normal values."""
    if trials <= 1:
        return 0.0
    return (1 - normal.EULER) * normal.quantile(1 - 1 / (trials + 1)) + normal.EULER * normal.quantile(1 - 1 / (trials * math.e))


def deflated_sharpe(sharpe: float, trials: int, n: int, skew: float = 0.0, kurtosis: float = 3.0) -> Deflated:
    """The Sharpe ratio against the largest expected by chance; its error allows for skew and kurtosis (3: normal)."""
    variance = max((1 + 0.5 * sharpe**2 - skew * sharpe + (kurtosis - 3) / 4 * sharpe**2) / (n - 1), 1e-10)
    top = expected_max_sharpe(trials)
    stat = (sharpe - top) / math.sqrt(variance)
    return Deflated(sharpe, top, stat, 1 - normal.cdf(stat))


def deflated_sharpe_log(sharpe: float, trials: int, n: int, skew: float, excess: float, year: float = 252.0) -> Deflated:
    """The variant with the root-log bound on the largest Sharpe ratio, scaled by its inverse per-period value."""
    root = math.sqrt(year)
    sr = sharpe / root
    top = math.sqrt(2 * math.log(trials)) * (1 / sr if sr else 1.0)
    variance = (1 + 0.5 * sr**2 - skew * sr + excess / 4 * sr**2) / n
    stat = (sr - top / root) / math.sqrt(variance) if variance > 0 else 0.0
    return Deflated(sharpe, top, stat, 1 - normal.cdf(stat))


def deflated(moment_rows: DataFrame, trials: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Deflated Sharpe ratios of each series of a moments table: one row for each series."""
    @F.pandas_udf("struct<expected_max:double, statistic:double, p_value:double>")
    def run(sharpe: pd.Series, n: pd.Series, skew: pd.Series, excess: pd.Series) -> pd.DataFrame:
        rows = [deflated_sharpe(s, trials, int(k), a, b + 3) for s, k, a, b in zip(sharpe, n, skew, excess)]
        return pd.DataFrame([(r.expected_max, r.statistic, r.p_value) for r in rows], columns=["expected_max", "statistic", "p_value"])

    return moment_rows.withColumn("_d", run("sharpe", "n", "skew", "kurtosis")).select(*keys, "sharpe", "_d.*")


def deflated_by_bound(moment_rows: DataFrame, trials: int, keys: tuple[str, ...] = ("symbol",), year: float = 252.0) -> DataFrame:
    """The form of :func:`deflated_sharpe_log` for each series of a moments table, on ratios per period."""
    root, sr = math.sqrt(year), F.col("sharpe") / math.sqrt(year)
    top = F.lit(math.sqrt(2 * math.log(trials))) * F.when(sr != 0, 1 / sr).otherwise(1.0)
    variance = (1 + 0.5 * sr * sr - F.col("skew") * sr + F.col("kurtosis") / 4 * sr * sr) / F.col("n")
    stat = F.when(variance > 0, (sr - top / root) / F.sqrt(variance)).otherwise(0.0)
    out = moment_rows.withColumns({"expected_max": top, "statistic": stat})

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: 1 - normal.cdf(v), na_action="ignore")

    return out.select(*keys, "sharpe", "expected_max", "statistic", tail("statistic").alias("p_value"))


def blocks(series: DataFrame, x: str, n: int, keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """``block, n, s, ss``: each series cut into ``n`` equal parts; rows past the last whole part are left out."""
    w = Window.partitionBy(*keys)
    out = series.where(F.col(x).isNotNull()).withColumns({"_r": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    out = out.withColumn("block", F.floor(F.col("_r") / F.floor(F.col("_n") / n)).cast("int")).where(F.col("block") < n)
    return out.groupBy(*keys, "block").agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(F.col(x) * F.col(x)).alias("ss"))


def _ratio(n: str, s: str, ss: str):
    mean = F.col(s) / F.col(n)
    var = (F.col(ss) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1)
    return mean / (F.sqrt(F.greatest(var, F.lit(0.0))) + EPS)


def symmetric_splits(block_rows: DataFrame, n: int, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``p_overfit, splits``: how often the one half of the blocks has a higher Sharpe ratio than the other.

    All C(n, n/2) halves are combined from each block's count, sum and sum of squares; the series itself is
    read once. ``n`` bounds the halves, not the data.
    """
    splits = block_rows.sparkSession.range(1 << n).where(F.bit_count("id") == n // 2).select(F.col("id").alias("split"))
    halves = splits.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    halves = halves.withColumn("inside", F.expr("shiftright(split, block) & 1"))
    met = block_rows.join(halves, "block")  # n * C(n, n/2) rows for each series
    pick = lambda c, v: F.sum(F.when(F.col("inside") == v, F.col(c)))
    sums = met.groupBy(*keys, "split").agg(*[pick(c, v).alias(f"{c}{v}") for c in ("n", "s", "ss") for v in (0, 1)])
    worse = (_ratio("n1", "s1", "ss1") > _ratio("n0", "s0", "ss0")).cast("int")
    return sums.groupBy(*keys).agg(F.avg(worse).alias("p_overfit"), F.count(F.lit(1)).alias("splits"))


def stability(series: DataFrame, x: str, period: str, keys: tuple[str, ...] = ("symbol",), year: float = 252.0) -> DataFrame:
    """Share of periods with a positive Sharpe ratio, and its coefficient of variation."""
    by = moments(series, x, (*keys, period), year).where(F.col("sharpe").isNotNull())
    out = by.groupBy(*keys).agg(
        F.avg((F.col("sharpe") > 0).cast("int")).alias("positive_share"), (F.coalesce(F.stddev_samp("sharpe"), F.lit(0.0)) / (F.abs(F.avg("sharpe")) + EPS)).alias("cv"), F.count(F.lit(1)).alias("periods")
    )
    return out.withColumn("stable", ((F.col("positive_share") >= 0.8) & (F.col("cv") < 0.5)).cast("int"))


def rank_overfit(performance: DataFrame, path: str, strategy: str, inside: str, outside: str) -> DataFrame:
    """Probability that the best strategy inside a path ranks in the lower half outside, and the mean logit of its rank."""
    w = Window.partitionBy(path)
    ranked = performance.withColumns(
        {
            "_i": F.row_number().over(w.orderBy(F.desc(inside), strategy)),
            "_o": F.rank().over(w.orderBy(outside)),
            "_n": F.count(F.lit(1)).over(w),
        }
    )
    best = ranked.where("_i = 1").withColumn("_w", F.col("_o") / (F.col("_n") + 1))
    logit = F.ln(F.col("_w") / (1 - F.col("_w")))
    return best.agg(F.avg((F.col("_w") <= 0.5).cast("int")).alias("pbo"), F.avg(logit).alias("mean_logit"), F.count(F.lit(1)).alias("paths"))


def random_half_overfit(returns: DataFrame, trials: int = 1000, seed: int = 11, period: str = "period", strategy: str = "strategy", ret: str = "ret") -> DataFrame:
    """Overfit probability over random halves of the periods (whole numbers); halves depend on period, trial and seed only.

    Ratios are compared to nine places, so strategies with the same trades are equals. ``strategy`` names a grid of parameters:
    a task holds four sums for each trial, half and strategy, and nothing is multiplied by the trials but these.
    """
    spans = returns.groupBy(strategy).agg(F.min(ret).alias("a"), F.max(ret).alias("b")).orderBy(strategy).collect()  # strategies
    place, n = {r[strategy]: k for k, r in enumerate(spans)}, len(spans)
    # constant returns have no spread to the last bit when they are counted from their own value
    centre = np.array([r["a"] if r["a"] is not None and r["a"] == r["b"] and math.isfinite(r["a"]) else 0.0 for r in spans])
    sims = np.arange(trials)

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 4, trials, n))
        for batch in batches:
            if not batch.num_rows:
                continue
            periods, at = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            who = np.array([place[x] for x in batch.column(1).to_pylist()])
            x = batch.column(2).to_numpy() - centre[who]
            odd = ~np.isfinite(x)  # they spoil their own half only
            x = np.where(odd, 0.0, x)
            cells = np.zeros((4, len(periods), n))
            for cell, value in zip(cells, (1.0, x, x * x, odd.astype(float))):
                np.add.at(cell, (at, who), value)
            inside = uniform_array(seed, periods[:, None], sims[None, :]).T < 0.5
            for half, chosen in enumerate((inside, ~inside)):
                sums[half] += chosen.astype(float) @ cells
        flat = sums.reshape(8, -1)
        ids = [np.repeat(sims, n), np.tile(np.arange(n), trials).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*ids, *flat)], names=["trial", "_k", *HALVES])

    rows = returns.where(F.col(period).isNotNull() & F.col(ret).isNotNull()).select(F.col(period).cast("long").alias("period"), strategy, F.col(ret).cast("double").alias("ret"))
    rows = rows.repartition("period").sortWithinPartitions("period")  # strategies of a period share its draws
    sums = rows.mapInArrow(halves, "trial long, _k int, " + ", ".join(f"{c} double" for c in HALVES)).groupBy("trial", "_k").agg(*[F.sum(c).alias(c) for c in HALVES])
    names = returns.sparkSession.createDataFrame([(r[strategy], k, float(c)) for k, (r, c) in enumerate(zip(spans, centre))], StructType([returns.schema[strategy], StructField("_k", IntegerType()), StructField("_c", DoubleType())]))

    def ratio(half: int) -> Column:
        count, total, squares, odd = (F.col(c) for c in HALVES[4 * half : 4 * half + 4])
        mean, square = total / F.nullif(count, F.lit(0.0)), squares / F.nullif(count, F.lit(0.0))
        spread = F.when(square - mean * mean > 1e-13 * square, F.sqrt(square - mean * mean)).otherwise(0.0)
        return F.when(odd > 0, F.lit(float("nan"))).otherwise(F.round((F.col("_c") + mean) / (spread + EPS), 9))

    perf = sums.join(F.broadcast(names), "_k").select("trial", strategy, ratio(0).alias("inside"), ratio(1).alias("outside"))
    return rank_overfit(perf, "trial", strategy, "inside", "outside")


#: Sums of both halves: rows, returns, squares, returns that are no finite numbers.
HALVES = [f"_{half}{c}" for half in ("in", "out") for c in "nsqx"]


def stationarity(series: DataFrame, x: str, keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> DataFrame:
    """An approximate unit-root statistic: correlation of the level with the next change, times root n."""
    before = F.lag(x).over(Window.partitionBy(*keys).orderBy(order))
    out = series.withColumn("_b", before).withColumn("_c", F.col(x) - F.col("_b")).where("_b is not null")
    out = out.groupBy(*keys).agg((correlation("_b", "_c") * F.sqrt(F.count(F.lit(1)))).alias("statistic"))
    return out.withColumn("stationary", (F.col("statistic") < -2.86).cast("int"))


def fold_summary(metrics: DataFrame, metric: str, keys: tuple[str, ...] = (), chance: float = 0.5) -> DataFrame:
    """Mean, spread and t statistic of a fold metric against chance, with a normal confidence interval."""
    out = metrics.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.count(metric).alias("folds"))
    se = F.col("std") / F.sqrt("folds")
    return out.withColumns({"t": (F.col("mean") - chance) / F.nullif(se, F.lit(0.0)), "ci_low": F.col("mean") - 1.96 * se, "ci_high": F.col("mean") + 1.96 * se})


#: Gates of the full validation: fixed values.
AUC_GATE, P_GATE, OVERFIT_GATE, DEFLATED_GATE = 0.5, 0.05, 0.5, 0.10


def gated(folds: DataFrame, overfit: DataFrame, deflated_row: DataFrame, main: str, others: dict[str, str]) -> DataFrame:
    """One row of a full validation, with its gates.

    ``folds``: :func:`fold_summary` by ``target``; ``overfit``: of :func:`random_half_overfit`; ``deflated_row``: of :func:`deflated`
    for the chosen strategy. The model of target ``main`` must beat chance in the lower end of its interval and by
    its two-sided p-value (``z`` of the fold metrics), the overfit probability and the deflated p-value must be small. ``others`` name the AUC of other targets.
    """

    @F.pandas_udf("double")
    def two_sided(t: pd.Series) -> pd.Series:
        return t.map(lambda x: 2 * (1 - normal.cdf(abs(x))), na_action="ignore")

    m = folds.where(F.col("target") == main).select(F.col("mean").alias("auc"), "ci_low", "ci_high", two_sided("t").alias("p_value"), "folds")
    for target, name in others.items():
        m = m.join(F.broadcast(folds.where(F.col("target") == target).select(F.col("mean").alias(name))))  # one row each
    m = m.join(F.broadcast(overfit.select("pbo", "mean_logit", F.col("paths").alias("trials")))).join(F.broadcast(deflated_row.select(F.col("sharpe").alias("observed_sharpe"), F.col("expected_max").alias("haircut"), F.col("statistic").alias("dsr"), F.col("p_value").alias("dsr_p_value"))))
    gates = {"cpcv_pass": (F.col("ci_low") > AUC_GATE) & (F.col("p_value") < P_GATE), "pbo_pass": F.col("pbo") < OVERFIT_GATE, "dsr_pass": F.col("dsr_p_value") < DEFLATED_GATE}
    m = m.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in gates.items()})
    return m.withColumn("overall_pass", F.col("cpcv_pass") & F.col("pbo_pass") & F.col("dsr_pass"))


def verdict(p_overfit: float, deflated_p: float, stationary: bool, positive_share: float) -> str:
    """The ladder of the combined assessment."""
    passed = (deflated_p < 0.05) + (p_overfit < 0.5) + bool(stationary) + (positive_share >= 0.8)
    return {4: "robust", 3: "acceptable", 2: "doubtful"}.get(passed, "overfit")
