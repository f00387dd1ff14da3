"""Trade ledgers to metrics: profit and loss, drawdown, streaks, daily ratios, regimes, grids, stress.

Ledgers are keyed by ``model``; every operator works on all models at once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.draws import first_draw
from tidemark.functions.frames import EPS
from tidemark.operators.simulations import every_trade

YEAR = 252.0


def _sum_if(c: Column, x: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, x)), F.lit(0.0))


def trade_metrics(trades: DataFrame, keys: tuple[str, ...] = ("model",), no_loss: str = "inf") -> DataFrame:
    """Counts, win rates, profit factor, payoff, expectancy and costs.

    ``no_loss`` says what the profit factor is without a loss: ``inf``, ``zero``, or ``unit`` for a divisor of 1.
    """
    pnl, long = F.col("net_pnl"), F.col("direction") == "LONG"
    won, lost = pnl > 0, pnl < 0
    out = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_trades"),
        F.count_if(won).alias("winning_trades"),
        F.count_if(lost).alias("losing_trades"),
        F.count_if(long).alias("long_trades"),
        F.count_if(long & won).alias("long_winners"),
        F.count_if(~long & won).alias("short_winners"),
        F.sum("gross_pnl").alias("gross_pnl"),
        F.sum("net_pnl").alias("net_pnl"),
        F.sum("commission").alias("commission"),
        F.sum("slippage").alias("slippage"),
        _sum_if(won, pnl).alias("_won"),
        (-_sum_if(lost, pnl)).alias("_lost"),
        F.coalesce(F.avg(F.when(won, pnl)), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(F.when(lost, pnl)), F.lit(0.0)).alias("avg_loss"),
        F.coalesce(F.max(F.when(won, pnl)), F.lit(0.0)).alias("max_win"),
        F.coalesce(F.min(F.when(lost, pnl)), F.lit(0.0)).alias("max_loss"),
        F.sum("contracts").alias("contracts"),
        F.countDistinct(F.to_date("entry_time")).alias("trading_days"),
    )
    empty = {"inf": F.lit(float("inf")), "zero": F.lit(0.0), "unit": F.col("_won")}[no_loss]
    return out.withColumns(
        {
            "short_trades": F.col("total_trades") - F.col("long_trades"),
            "win_rate": F.col("winning_trades") / F.col("total_trades"),
            "profit_factor": F.when(F.col("_lost") > 0, F.col("_won") / F.nullif(F.col("_lost"), F.lit(0.0))).otherwise(empty),
            "payoff": F.when(F.col("avg_loss") != 0, F.abs(F.col("avg_win") / F.nullif(F.col("avg_loss"), F.lit(0.0)))).otherwise(float("inf")),
            "expectancy": F.col("net_pnl") / F.col("total_trades"),
            "trades_per_day": F.col("total_trades") / F.col("trading_days"),
        }
    ).drop("_won", "_lost")


def equity(trades: DataFrame, keys: tuple[str, ...] = ("model",), order: tuple[str, ...] = ("entry_time", "trade_id"), from_zero: bool = True) -> DataFrame:
    """Running profit, its peak and the drawdown; the peak starts at 0 or at the first trade."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = trades.withColumn("equity", F.sum("net_pnl").over(w))
    peak = F.max("equity").over(w)
    out = out.withColumn("peak", F.greatest(F.lit(0.0), peak) if from_zero else peak)
    return out.withColumn("drawdown", F.col("peak") - F.col("equity"))


def drawdown_runs(curve: DataFrame, keys: tuple[str, ...] = ("model",), order: tuple[str, ...] = ("entry_time", "trade_id")) -> DataFrame:
    """``start, trades, depth, recovered``: each run of trades below the peak."""
    w = Window.partitionBy(*keys).orderBy(*order)
    under = (F.col("drawdown") > 0).cast("int")
    out = curve.withColumn("_u", under).withColumn("_g", F.sum((F.col("_u") == 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_last", F.lead(F.lit(1)).over(w).isNull())
    runs = out.where("_u = 1").groupBy(*keys, "_g").agg(
        F.min(order[0]).alias("start"), F.count(F.lit(1)).alias("trades"), F.max("drawdown").alias("depth"), F.min((~F.col("_last")).cast("int")).alias("recovered")
    )
    return runs.drop("_g")


def drawdown_metrics(curve: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    d = F.col("drawdown")
    return curve.groupBy(*keys).agg(
        F.max(d).alias("max_drawdown"),
        F.coalesce(F.avg(F.when(d > 0, d)), F.lit(0.0)).alias("avg_drawdown"),
        F.max("equity").alias("max_runup"),
        F.when(F.max("peak") > 0, F.max(d) / F.nullif(F.max("peak"), F.lit(0.0))).alias("max_drawdown_share"),
    )


def streaks(trades: DataFrame, keys: tuple[str, ...] = ("model",), order: tuple[str, ...] = ("entry_time", "trade_id")) -> DataFrame:
    """The longest runs of winning and of other trades."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = trades.withColumn("_w", F.col("net_pnl") > 0)
    out = out.withColumn("_c", F.coalesce(F.col("_w") != F.lag("_w").over(w), F.lit(True)).cast("int"))
    out = out.withColumn("_g", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = out.groupBy(*keys, "_g", "_w").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*keys).agg(
        F.coalesce(F.max(F.when(F.col("_w"), F.col("n"))), F.lit(0)).alias("max_wins"), F.coalesce(F.max(F.when(~F.col("_w"), F.col("n"))), F.lit(0)).alias("max_losses")
    )


def daily_pnl(trades: DataFrame, keys: tuple[str, ...] = ("model",), by: str = "entry_time") -> DataFrame:
    """Profit, trades and win rate by day, and the running profit."""
    out = trades.groupBy(*keys, F.to_date(by).alias("date")).agg(
        F.sum("net_pnl").alias("pnl"), F.count(F.lit(1)).alias("trades"), (F.count_if(F.col("net_pnl") > 0) / F.count(F.lit(1))).alias("win_rate")
    )
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cumulative", F.sum("pnl").over(w))


def daily_ratios(trades: DataFrame, keys: tuple[str, ...] = ("model",), by: str = "entry_time") -> DataFrame:
    """Sharpe, Sortino and Calmar ratios of daily profits, and the extremes of days."""
    days = daily_pnl(trades, keys, by)
    w = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("_dd", F.greatest(F.lit(0.0), F.max("cumulative").over(w)) - F.col("cumulative"))
    p = F.col("pnl")
    out = days.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("days"), F.avg(p).alias("avg_day"), F.stddev_samp(p).alias("_sd"), F.stddev_samp(F.when(p < 0, p)).alias("_dsd"), F.sum(p).alias("_total"),
        F.max("_dd").alias("_mdd"), F.max(p).alias("best_day"), F.min(p).alias("worst_day"), F.count_if(p > 0).alias("winning_days"), F.count_if(p < 0).alias("losing_days"),
    )
    root = YEAR**0.5
    return out.withColumns(
        {
            "sharpe": F.coalesce(F.col("avg_day") / F.nullif(F.col("_sd"), F.lit(0.0)) * root, F.lit(0.0)),
            "sortino": F.coalesce(F.col("avg_day") / F.nullif(F.col("_dsd"), F.lit(0.0)) * root, F.lit(0.0)),
            "calmar": F.when(F.col("_mdd") > 0, F.col("_total") / (F.col("days") / YEAR) / F.nullif(F.col("_mdd"), F.lit(0.0))).otherwise(float("inf")),
        }
    ).drop("_sd", "_dsd", "_total", "_mdd")


def validators(trades: DataFrame, keys: tuple[str, ...] = ("model",), start: int = 570, end: int = 960, largest: float = 1e5) -> DataFrame:
    """Rule violations of a ledger: entries out of session, exits before entries, huge results, losing-day share."""
    from tidemark.operators.bars import in_session

    days = daily_pnl(trades, keys).groupBy(*keys).agg((F.count_if(F.col("pnl") < 0) / F.count(F.lit(1))).alias("losing_day_share"))
    rows = trades.groupBy(*keys).agg(
        F.count_if(~in_session("entry_time", start, end)).alias("out_of_session"),
        F.count_if(F.col("exit_time") < F.col("entry_time")).alias("exit_before_entry"),
        F.count_if(F.abs("net_pnl") > largest).alias("huge_results"),
        F.count_if(F.col("contracts") <= 0).alias("no_contracts"),
    )
    return rows.join(days, list(keys))


def regime_metrics(trades: DataFrame, sets: list[str]) -> DataFrame:
    """Metrics by each regime column in one pass over grouping sets, with shares of trades and profit."""
    pnl = F.col("net_pnl")
    tagged = trades.select("net_pnl", F.explode(F.array(*[F.struct(F.lit(s).alias("regime"), F.coalesce(F.col(s).cast("string"), F.lit("unknown")).alias("value")) for s in sets])).alias("r"))
    out = tagged.groupBy("r.regime", "r.value").agg(
        F.count(F.lit(1)).alias("trades"), F.sum(pnl).alias("net_pnl"), F.avg(pnl).alias("avg_trade"),
        (F.count_if(pnl > 0) / F.count(F.lit(1))).alias("win_rate"), _sum_if(pnl > 0, pnl).alias("_w"), (-_sum_if(pnl < 0, pnl)).alias("_l"),
    )
    total = Window.partitionBy("regime")
    return out.withColumns(
        {
            "profit_factor": F.when(F.col("_l") > 0, F.col("_w") / F.nullif(F.col("_l"), F.lit(0.0))).otherwise(float("inf")),
            "trade_share": F.col("trades") / F.sum("trades").over(total),
            "pnl_share": F.col("net_pnl") / F.nullif(F.sum("net_pnl").over(total), F.lit(0.0)),
        }
    ).drop("_w", "_l")


def worst_windows(trades: DataFrame, n: int = 30, k: int = 10, keys: tuple[str, ...] = ("model",), order: tuple[str, ...] = ("entry_time", "trade_id")) -> DataFrame:
    """The ``k`` windows of ``n`` consecutive trades with the lowest profit, over all models."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(n - 1), 0)
    won = (F.col("net_pnl") > 0).cast("int")
    out = trades.withColumns(
        {"_n": F.count("net_pnl").over(w), "window_pnl": F.sum("net_pnl").over(w), "start": F.first("entry_time").over(w), "win_rate": F.avg(won).over(w)}
    )
    out = out.where(F.col("_n") == n).orderBy("window_pnl", *keys, *order).limit(k)
    return out.select(*keys, "start", F.col("entry_time").alias("end"), "window_pnl", "win_rate")


def sensitivity(trades: DataFrame, grid: DataFrame, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Metrics for each row of a parameter table (``min_prob, tp_scale, sl_scale``) by filtering and rescaling results.

    Scaled results have moments that follow from those of the winners and the others, so trades meet the different ``min_prob`` only,
    and the settings meet sums.
    """
    x, won = F.col("net_pnl"), F.col("net_pnl") > 0
    rows = trades.join(F.broadcast(grid.select("min_prob").distinct()), F.col("prob") >= F.col("min_prob"))  # a parameter table
    sums = rows.groupBy(*keys, "min_prob").agg(
        F.count(F.lit(1)).alias("trades"), F.count(x).alias("_n"), F.count_if(won).alias("_wins"), F.count_if(x < 0).alias("_losses"),
        _sum_if(won, x).alias("_w"), _sum_if(~won, x).alias("_l"), _sum_if(won, x * x).alias("_ww"), _sum_if(~won, x * x).alias("_ll"),
    )
    t, s, n = F.col("tp_scale"), F.col("sl_scale"), F.col("_n")
    total = t * F.col("_w") + s * F.col("_l")
    variance = (t * t * F.col("_ww") + s * s * F.col("_ll") - total * total / n) / F.nullif(n - 1, F.lit(0))
    hits = F.when(t > 0, F.col("_wins")).otherwise(0) + F.when(s < 0, F.col("_losses")).otherwise(0)
    return sums.join(F.broadcast(grid), "min_prob").select(
        *keys, "min_prob", "tp_scale", "sl_scale", "trades", F.when(n > 0, total).alias("net_pnl"), (hits / F.col("trades")).alias("win_rate"),
        (total / n / (F.sqrt(F.greatest(variance, F.lit(0.0))) + EPS)).alias("trade_sharpe"),
    )


def robustness(results: DataFrame, metric: str, keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """Coefficient of variation of a metric over a grid, and the share of profitable settings."""
    return results.groupBy(*keys).agg(
        (F.stddev_samp(metric) / (F.abs(F.avg(metric)) + EPS)).alias("cv"), (F.count_if(F.col(metric) > 0) / F.count(F.lit(1))).alias("profitable")
    )


def best_setting(results: DataFrame, metric: str, columns: list[str], keys: tuple[str, ...] = ("model",)) -> DataFrame:
    """The parameters with the highest metric; the smaller parameters of equals."""
    order = F.struct(F.col(metric), *[(-F.col(c)).alias(f"_{c}") for c in columns])
    return results.groupBy(*keys).agg(F.max_by(F.struct(*columns, metric), order).alias("b")).select(*keys, "b.*")


def stress(trades: DataFrame, kind: str, level: float, sims: int = 1, seed: int = 7, keys: tuple[str, ...] = ("model",), id_col: str = "trade_id") -> DataFrame:
    """Profit of each simulation under one kind of stress.

    ``slippage``: costs times the level. ``dropout``: that share of trades is missed. ``adverse``: that share of
    winners is missed. ``swan``: one trade in so many loses ten times its size. ``combined``: slippage times 3, 30 %
    of trades and 20 % of winners missed, and the level's share of ten-fold losses. Draws depend on the
    trade's whole number ``id_col`` and the simulation.
    """
    if kind not in STRESSES:
        raise ValueError(f"unknown stress {kind!r}")
    columns = {"x": "net_pnl"} | ({"slippage": "slippage"} if kind in ("slippage", "combined") else {})
    out = every_trade(trades, columns, id_col, lambda grid: lambda trade: STRESSES[kind](trade, level, lambda k, share: grid.reach(seed + k, _first(share))), sims, keys)
    return out.select(*keys, "sim", F.when(F.col("n") > 0, F.col("x")).alias("net_pnl"), F.col("n").cast("long").alias("trades"))


@functools.cache
def _first(share: float) -> np.ndarray:
    return first_draw(share)


def _swan(x: np.ndarray, spared: np.ndarray) -> np.ndarray:
    return np.where(spared, x, -10 * np.abs(x))


def _all_at_once(t: dict, level: float, reach: Callable) -> tuple[np.ndarray, np.ndarray]:
    seen = reach(1, 0.3) & ((t["x"] <= 0) | reach(2, 0.2))
    return _swan(t["x"] - t["slippage"] * 2, reach(0, level)), seen


#: From trades, the level and what tells which draws reach a share: results, and which of them count (None: all).
STRESSES = {
    "slippage": lambda t, level, reach: (t["x"] - t["slippage"] * (level - 1), None),
    "dropout": lambda t, level, reach: (t["x"], reach(0, level)),
    "adverse": lambda t, level, reach: (t["x"], (t["x"] <= 0) | reach(0, level)),
    "swan": lambda t, level, reach: (_swan(t["x"], reach(0, level)), None),
    "combined": _all_at_once,
}


def simulation_summary(sims: DataFrame, x: str = "net_pnl", keys: tuple[str, ...] = ("model",)) -> DataFrame:
    q = lambda p: F.percentile(x, F.lit(p))
    return sims.groupBy(*keys).agg(
        F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), q(0.5).alias("median"), q(0.025).alias("ci_low"), q(0.975).alias("ci_high"),
        F.min(x).alias("min"), F.max(x).alias("max"), (F.count_if(F.col(x) > 0) / F.count(F.lit(1))).alias("prob_positive"),
    )
