"""Probabilities to decisions: gates, sides, sizes, and simulated trades."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.frames import EPS, Frames
from tidemark.operators.labels import first_touch, resolve

FRAMES = Frames()


@dataclass(frozen=True)
class Rules:
    """Thresholds, sizes, exits and costs. The defaults are fixed values."""

    min_vol: float = 0.50
    min_breakout: float = 0.50
    min_sentiment: float = 0.55
    technical_weight: float = 0.6
    sentiment_weight: float = 0.4
    tp_atr: float = 2.0
    sl_atr: float = 1.0
    tp_adjust: float = 0.0
    base_contracts: int = 1
    max_contracts: int = 3
    holding: int = 20
    point_value: float = 50.0
    tick: float = 0.25
    commission: float = 1.29
    slippage_ticks: float = 0.5


def vol_gate(rules: Rules, technical: str, sentiment: str | None = None, method: str = "agreement") -> tuple[Column, Column]:
    """Whether volatility is expected to expand, and the combined probability."""
    t = F.col(technical)
    if sentiment is None:
        return t >= rules.min_vol, t
    s = F.col(sentiment)
    if method == "agreement":
        return (t >= rules.min_vol) & (s >= rules.min_sentiment), F.least(t, s)
    if method == "weighted":
        mixed = rules.technical_weight * t + rules.sentiment_weight * s
        return mixed >= rules.min_vol, mixed
    if method == "either":
        return (t >= rules.min_vol) | (s >= rules.min_sentiment), F.greatest(t, s)
    raise ValueError(f"unknown method {method!r}")


def resolve_signals(df: DataFrame, rules: Rules, technical: str, high: str, low: str, atr: str, predicted_atr: str, sentiment: str | None = None, method: str = "agreement") -> DataFrame:
    """``direction`` (1, -1, 0), ``breakout_prob``, ``contracts``, ``tp_offset`` and ``sl_offset``.

    Equal breakout probabilities above the threshold go short. No signal has zero contracts.
    """
    gate, mixed = vol_gate(rules, technical, sentiment, method)
    up, down = F.col(high) >= rules.min_breakout, F.col(low) >= rules.min_breakout
    long = up & (~down | (F.col(high) > F.col(low)))
    side = F.when(gate & long, 1).when(gate & down, -1).otherwise(0)
    out = df.withColumns({"combined_vol": mixed, "direction": side})
    d, p = F.col("direction"), F.col(predicted_atr)
    prob = F.when(d == 1, F.col(high)).when(d == -1, F.col(low))
    factor = F.least(F.greatest(F.col(atr) / (p + EPS), F.lit(0.5)), F.lit(2.0))
    size = F.least(F.greatest(F.floor(rules.base_contracts * factor), F.lit(1)), F.lit(rules.max_contracts))
    out = out.withColumn("breakout_prob", prob)
    reach = rules.tp_atr * (1 + rules.tp_adjust * (F.col("breakout_prob") - 0.5))
    return out.withColumns(
        {
            "contracts": F.when(d != 0, size).otherwise(0).cast("int"),
            "tp_offset": F.when(d != 0, reach * p * d),
            "sl_offset": F.when(d != 0, -rules.sl_atr * p * d),
        }
    )


def costs(rules: Rules, contracts: Column) -> tuple[Column, Column]:
    """Commission and slippage of both sides of a trade."""
    return rules.commission * 2 * contracts, rules.slippage_ticks * rules.tick * rules.point_value * 2 * contracts


def independent_trades(signals: DataFrame, rules: Rules, frames: Frames = FRAMES) -> DataFrame:
    """One trade for each signal: the first touch of target or stop within ``holding`` bars, else the last close.

    Trades overlap freely, so this is one window pass and no state. A signal on a series' last bar is no trade.
    """
    d = F.col("direction")
    out = signals.withColumns({"_tp": F.col("close") + F.col("tp_offset"), "_sl": F.col("close") + F.col("sl_offset")})
    out = out.withColumn("_t", first_touch("high", "low", "close", rules.holding, F.col("_tp"), F.col("_sl"), d, frames))
    times = F.collect_list("ts").over(frames.ahead(rules.holding))
    out = out.withColumns({f"_{k}": v for k, v in resolve("_t").items()}).withColumn("_times", times)
    out = out.where((d != 0) & (F.col("_n_ahead") > 0))
    held = F.coalesce(F.col("_bar"), F.col("_n_ahead"))
    reason = F.when(F.col("_bar").isNull(), "time").when(F.col("_is_profit"), "tp").otherwise("sl")
    price = F.when(F.col("_bar").isNull(), F.col("_last_close")).when(F.col("_is_profit"), F.col("_tp")).otherwise(F.col("_sl"))
    out = out.withColumns({"bars_held": held, "exit_reason": reason, "exit_price": price})
    commission, slippage = costs(rules, F.col("contracts"))
    out = out.withColumns(
        {
            "exit_time": F.element_at("_times", F.col("bars_held").cast("int")),
            "gross_pnl": (F.col("exit_price") - F.col("close")) * d * rules.point_value * F.col("contracts"),
            "commission": commission,
            "slippage": slippage,
        }
    )
    return out.select(
        "symbol", F.col("ts").alias("entry_time"), "exit_time", F.when(d == 1, "LONG").otherwise("SHORT").alias("direction"), "contracts",
        F.col("close").alias("entry_price"), "exit_price", "gross_pnl", "commission", "slippage",
        (F.col("gross_pnl") - F.col("commission") - F.col("slippage")).alias("net_pnl"), "exit_reason", "bars_held",
    )


def fixed_horizon_trades(signals: DataFrame, horizon: int, rules: Rules, frames: Frames = FRAMES) -> DataFrame:
    """Every signal held for ``horizon`` bars, or to the last one of its series."""
    rest = frames.window.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    last = F.last("close").over(rest)
    out = signals.withColumn("exit_price", F.coalesce(frames.lead("close", horizon), last)).where("direction <> 0")
    commission, slippage = costs(rules, F.col("contracts"))
    gross = (F.col("exit_price") - F.col("close")) * F.col("direction") * rules.point_value * F.col("contracts")
    return out.withColumn("net_pnl", gross - commission - slippage).select(
        "symbol", F.col("ts").alias("entry_time"), "direction", "contracts", F.col("close").alias("entry_price"), "exit_price", "net_pnl"
    )


@dataclass(frozen=True)
class Limits:
    """Limits and exits of the one-position simulator. The defaults are fixed values."""

    hold_bars: int = 3
    stop_ticks: float | None = 20
    target_ticks: float | None = 40
    long_above: float = 0.55
    short_below: float = 0.45
    min_strength: float = 0.1
    max_daily_trades: int = 10
    max_daily_loss: float = 1000.0
    max_consecutive_losses: int = 5
    session: tuple[int, int] | None = None  # minutes of the day between which positions open and close, Monday to Friday


def in_session(ts: pd.Timestamp, session: tuple[int, int] | None) -> bool:
    return session is None or (session[0] <= ts.hour * 60 + ts.minute < session[1] and ts.weekday() < 5)


def walk_one_position(frame: pd.DataFrame, limits: Limits, rules: Rules, contracts: int = 1) -> list[dict]:
    """Trades of one series with a single position at a time.

    Slippage is part of both prices and is charged as a cost again, as the ledger's definition has it. Bars outside
    the session count as held but change nothing.
    """
    slip = rules.slippage_ticks * rules.tick
    trades, position = [], None
    counts: dict = {}
    losses: dict = {}
    streak = 0
    rows = list(zip(frame["ts"], frame["close"], frame["high"], frame["low"], frame["score"]))
    for i in range(len(rows) - limits.hold_bars - 1):
        ts, close, _, _, score = rows[i]
        if not in_session(ts, limits.session):
            continue
        day = ts.date()
        if position:
            moved = (close - position["entry_price"]) * position["side"]
            reason = "hold" if i - position["bar"] >= limits.hold_bars else None
            if limits.stop_ticks and moved <= -limits.stop_ticks * rules.tick:
                reason = "stop"
            elif limits.target_ticks and reason is None and moved >= limits.target_ticks * rules.tick:
                reason = "target"
            if reason:
                side, entry = position["side"], position["entry_price"]
                price = close - slip * side
                span = rows[position["bar"] : i + 1]
                up, down = max(r[2] for r in span) - entry, entry - min(r[3] for r in span)
                best, worst = (up, down) if side > 0 else (down, up)
                gross = (price - entry) * side * rules.point_value * contracts
                net = gross - rules.commission * 2 * contracts - slip * rules.point_value * contracts * 2
                trades.append(
                    {
                        "entry_time": rows[position["bar"]][0], "exit_time": ts, "direction": "LONG" if side > 0 else "SHORT", "contracts": contracts,
                        "entry_price": entry, "exit_price": price, "gross_pnl": gross, "net_pnl": net, "exit_reason": reason, "bars_held": i - position["bar"],
                        "mfe": max(0.0, best) * rules.point_value * contracts, "mae": max(0.0, worst) * rules.point_value * contracts,
                    }
                )
                losses[day] = losses.get(day, 0.0) + min(0.0, net)
                streak = streak + 1 if net < 0 else 0
                position = None
            continue
        if counts.get(day, 0) >= limits.max_daily_trades or abs(losses.get(day, 0.0)) >= limits.max_daily_loss or streak >= limits.max_consecutive_losses:
            continue
        if score != score or abs(score - 0.5) < limits.min_strength:
            continue
        side = 1 if score > limits.long_above else -1 if score < limits.short_below else 0
        if side:
            position = {"bar": i, "side": side, "entry_price": close + slip * side}
            counts[day] = counts.get(day, 0) + 1
    return trades


TRADE = (
    "symbol string, entry_time {time}, exit_time {time}, direction string, contracts int, entry_price double, exit_price double, "
    "gross_pnl double, net_pnl double, exit_reason string, bars_held int, mfe double, mae double"
)


def _per_series(df: DataFrame, keys: tuple[str, ...], run: Callable[[pd.DataFrame], list[dict]]) -> DataFrame:
    """A path-dependent walk over each group; groups are series, folds or strategies, not the whole table."""
    schema = T.StructType.fromDDL(TRADE.format(time=df.schema["ts"].dataType.simpleString()))
    extra = [df.schema[k] for k in keys if k != "symbol"]
    full = T.StructType([*schema.fields, *extra])

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", kind="stable")
        out = pd.DataFrame(run(frame), columns=[f.name for f in schema.fields if f.name != "symbol"])
        for k in ("symbol", *[f.name for f in extra]):
            out[k] = frame[k].iloc[0]
        return out[full.names]

    return df.groupBy(*keys).applyInPandas(walk, full)


def one_position_trades(scored: DataFrame, limits: Limits, rules: Rules, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """``scored`` has bars and ``score``. Limits depend on earlier trades, so each group is walked in order."""
    return _per_series(scored, keys, lambda frame: walk_one_position(frame, limits, rules))


def walk_reentry(frame: pd.DataFrame, holding: int, tp_atr: float, sl_atr: float, rules: Rules) -> list[dict]:
    """One position at a time with ATR exits; a new signal may enter on the bar of an exit."""
    rows = list(zip(frame["ts"], frame["close"], frame["high"], frame["low"], frame["direction"], frame["atr"]))
    trades, position = [], None
    for i, (ts, close, high, low, side, atr) in enumerate(rows):
        if position and i > position["bar"]:
            s, entry = position["side"], position["entry"]
            tp, sl = position["tp"], position["sl"]
            hit_tp, hit_sl = (high >= tp, low <= sl) if s > 0 else (low <= tp, high >= sl)
            price, reason = (tp, "tp") if hit_tp else (sl, "sl") if hit_sl else (close, "time") if i - position["bar"] >= holding else (None, None)
            if reason:
                gross = (price - entry) * s * rules.point_value
                net = gross - rules.commission * 2 - rules.slippage_ticks * rules.tick * rules.point_value * 2
                trades.append(
                    {
                        "entry_time": rows[position["bar"]][0], "exit_time": ts, "direction": "LONG" if s > 0 else "SHORT", "contracts": 1, "entry_price": entry,
                        "exit_price": price, "gross_pnl": gross, "net_pnl": net, "exit_reason": reason, "bars_held": i - position["bar"], "mfe": None, "mae": None,
                    }
                )
                position = None
        if position is None and side == side and side and atr == atr and i < len(rows) - 1:
            s = int(side)
            position = {"bar": i, "side": s, "entry": close, "tp": close + tp_atr * atr * s, "sl": close - sl_atr * atr * s}
    return trades


def reentry_trades(signals: DataFrame, rules: Rules, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    return _per_series(signals, keys, lambda frame: walk_reentry(frame, rules.holding, rules.tp_atr, rules.sl_atr, rules))


@dataclass(frozen=True)
class GridRules:
    """Exits, sizes and costs of the threshold strategies. The defaults are fixed values."""

    stop_atr: float = 2.0
    target_atr: float = 3.0
    hold_bars: int = 30
    cost: float = 0.0005  # of a round trip
    base_contracts: int = 1
    max_contracts: int = 3


def _held_bars(side: int, entry: float, atr: float, high: np.ndarray, low: np.ndarray, rules: GridRules) -> int | None:
    """How many bars a position stays, given the bars after the one that follows its entry; None: beyond them."""
    down, up = (rules.stop_atr, rules.target_atr) if side > 0 else (rules.target_atr, rules.stop_atr)
    high, low = high[: rules.hold_bars], low[: rules.hold_bars]  # before they are compared: the work follows the holding time, not the series
    touched = (low <= entry * (1 - down * atr / entry)) | (high >= entry * (1 + up * atr / entry))
    if touched.any():
        return int(touched.argmax()) + 1
    return rules.hold_bars if len(touched) == rules.hold_bars else None


def grid_positions(frame: pd.DataFrame, rules: GridRules) -> np.ndarray:
    """Return of each bar of one strategy: positions open at a bar's close and follow the next bars' returns.

    The volatility gate and one breakout threshold open a position, the higher probability where both sides
    pass. Half of the cost falls on the bar of entry and half on the bar before the exit's prices.
    """
    close, high, low, atr, expected, vol, up, down = (frame[c].to_numpy(float) for c in ("close", "high", "low", "atr", "predicted_atr", "vol_p", "up_p", "down_p"))
    n, least = len(close), frame["min_breakout"].iloc[0]
    rise, fall = up >= least, down >= least
    side = np.where(rise & (~fall | (up > down)), 1, np.where(fall, -1, 0)) * (vol >= frame["min_vol"].iloc[0]) * ~(np.isnan(atr) | np.isnan(expected))
    size = np.clip(np.floor(rules.base_contracts * np.clip(atr / (expected + EPS), 0.5, 2.0)), 1, rules.max_contracts) / rules.base_contracts
    out, starts, at = np.zeros(n), np.flatnonzero(side[: max(0, n - 1)]), 0
    while (k := int(np.searchsorted(starts, at))) < len(starts):
        e = int(starts[k])
        s, scale = int(side[e]), float(size[e])
        held = _held_bars(s, close[e], atr[e], high[e + 2 :], low[e + 2 :], rules)
        last = n - 2 if held is None else e + held
        out[e] -= rules.cost * scale / 2
        out[e + 1 : last + 1] += s * scale * (close[e + 2 : last + 2] / close[e + 1 : last + 1] - 1)
        out[n - 1 if held is None else last] -= rules.cost * scale / 2
        at = last + 1
    return out


def strategy_grid_returns(scored: DataFrame, grid: DataFrame, rules: GridRules = GridRules()) -> DataFrame:
    """``symbol, strategy, ts, ret``: per-bar returns of each pair of a volatility and a breakout threshold.

    ``scored`` has bars with ``vol_p, up_p, down_p, atr, predicted_atr``; ``grid`` (``strategy, min_vol, min_breakout``)
    is a parameter table. One position at a time depends on its own past, so a task walks one series of one strategy.
    """

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts", kind="stable").reset_index(drop=True)
        return frame[["symbol", "strategy", "ts"]].assign(ret=grid_positions(frame, rules))

    kind = scored.schema["ts"].dataType.simpleString()
    pairs = scored.select("symbol", "ts", "high", "low", "close", "vol_p", "up_p", "down_p", "atr", "predicted_atr").join(F.broadcast(grid))  # a parameter table
    return pairs.groupBy("symbol", "strategy").applyInPandas(walk, f"symbol string, strategy int, ts {kind}, ret double")


def excursions(trades: DataFrame, bars: DataFrame, rules: Rules) -> DataFrame:
    """Best and worst excursion of each trade in money and ticks, from the bars it was open; null where there is none.

    Trades and bars meet by day: a trade is spread over the days it was open, never over all bars. Equal
    trades have equal excursions, so they are looked up once and each keeps its row.
    """
    keys = ["symbol", "entry_time", "exit_time", "direction", "contracts", "entry_price"]
    spread = trades.select(*keys).distinct().withColumn("_day", F.explode(F.sequence(F.to_date("entry_time"), F.to_date("exit_time"))))
    b = bars.select(F.col("symbol").alias("_s"), F.col("ts").alias("_ts"), F.to_date("ts").alias("_day"), "high", "low")
    open_then = (spread["symbol"] == b["_s"]) & (spread["_day"] == b["_day"]) & (F.col("_ts") >= F.col("entry_time")) & (F.col("_ts") <= F.col("exit_time"))
    top, bottom = F.max("high") - F.first("entry_price"), F.first("entry_price") - F.min("low")
    long = F.first("direction") == "LONG"
    found = spread.join(b, open_then).groupBy(*keys).agg(F.when(long, top).otherwise(bottom).alias("_f"), F.when(long, bottom).otherwise(top).alias("_a"))
    found = found.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.greatest("_f", F.lit(0.0)).alias("_f"), F.greatest("_a", F.lit(0.0)).alias("_a"))
    same = reduce(lambda a, k: a & F.col(k).eqNullSafe(F.col(f"_k_{k}")), keys, F.lit(True))
    money, f, a = rules.point_value * F.col("contracts"), F.col("_f"), F.col("_a")
    out = trades.select(*keys).join(found, same, "left")
    return out.select(*keys, (f * money).alias("mfe"), (a * money).alias("mae"), (f / rules.tick).alias("mfe_ticks"), (a / rules.tick).alias("mae_ticks"))


def meta_size(prob: str, method: str = "linear", floor: float = 0.55, largest: float = 1.0) -> Column:
    """Bet size from the probability that a signal is right: none below ``floor``, ``largest`` at certainty."""
    edge = (F.col(prob) - 0.5) * 2
    size = {"linear": edge, "kelly": 2 * F.col(prob) - 1, "sqrt": F.sqrt(F.greatest(edge, F.lit(0.0)))}[method] * largest
    return F.when(F.col(prob) >= floor, F.least(F.greatest(size, F.lit(0.0)), F.lit(largest))).otherwise(0.0)
