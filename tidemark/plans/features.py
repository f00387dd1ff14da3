"""Queries over hourly bars: microstructure, calendar, regimes, markets, timeframes, structure, sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.frames import Frames
from tidemark.operators import bars as B
from tidemark.operators import calendar as C
from tidemark.operators import cross as X
from tidemark.operators import joins as J
from tidemark.operators import micro as M
from tidemark.operators import price as P
from tidemark.operators import regime as R
from tidemark.operators import sentiment as S
from tidemark.operators import structure as U
from tidemark.operators import technical as T
from tidemark.plans.catalog import add, hour_bars, on_bars, shown, table
from tidemark.plans.indicators import EPS, TR, frame_list, ret
from tidemark.plans.sql import BARS, before, ema_ctes, flag, lag, over, quantile, roll, running, statement


def rank_share(x: str, v: str, n: int) -> str:
    return f"CASE WHEN len({v}) = {n} THEN (len(list_filter({v}, lambda q: q < {x})) + (len(list_filter({v}, lambda q: q = {x})) + 1) / 2) / {n}.0 END"


def below_share(x: str, v: str, n: int, times: str = "1") -> str:
    return f"CASE WHEN len({v}) = {n} THEN len(list_filter({v}, lambda q: q < {x})) / {n}.0 * {times} END"


# ---- microstructure
VOL = [
    {
        "d": f"volume - {lag('volume')}",
        "volume_momentum_5": f"volume / nullif({lag('volume', 5)}, 0) - 1",
        "volume_zscore": f"(volume - {roll('avg', 'volume', 20)}) / ({roll('stddev_samp', 'volume', 20)} + {EPS})",
        "v": frame_list("volume", 20),
        "dollar_volume": "volume * close",
        "volume_weighted_range": "(high - low) * volume",
    },
    {"volume_accel": f"d - {lag('d')}", "volume_percentile_20": rank_share("volume", "v", 20), "dollar_volume_ma20": roll("avg", "dollar_volume", 20)},
]
VOLC = ["volume_momentum_5", "volume_zscore", "volume_percentile_20", "dollar_volume", "volume_weighted_range", "volume_accel", "dollar_volume_ma20"]
add("volume_metrics", on_bars(M.volume_metrics, VOLC), statement(VOL, VOLC))
INT = [
    {"r": ret(1)},
    {
        "trade_size_proxy": f"volume / ((high - low + {EPS}) * 100 + 1)",
        "trade_intensity_5": roll("sum", "volume", 5),
        "trade_intensity_20": roll("sum", "volume", 20),
        "up_volume": "CASE WHEN r > 0 THEN volume ELSE 0 END",
        "down_volume": "CASE WHEN r < 0 THEN volume ELSE 0 END",
        "signed_volume": "r * volume",
    },
    {
        "up_down_ratio": f"{roll('sum', 'up_volume', 20)} / ({roll('sum', 'down_volume', 20)} + {EPS})",
        "volume_delta_ma20": roll("avg", "signed_volume", 20),
        "cum_volume_delta": f"round({running('sum', 'signed_volume')}, 3)",
    },
]
INTC = ["trade_size_proxy", "trade_intensity_5", "trade_intensity_20", "up_down_ratio", "volume_delta_ma20", "cum_volume_delta"]
add("trade_intensity", on_bars(lambda b: M.trade_intensity(b).withColumn("cum_volume_delta", F.round("cum_volume_delta", 3)), INTC), statement(INT, INTC))
IMP = [
    {
        "amihud": f"abs({ret(1)}) / (volume + {EPS})",
        "kyle_lambda": f"abs(close - {lag('close')}) / (volume + {EPS})",
        "range_impact": f"(high - low) / (volume + {EPS})",
        "volume_normalised_return": f"({ret(1)}) / (sqrt(volume) + {EPS})",
        "hl": "high - low",
    },
    {
        "amihud_ma20": roll("avg", "amihud", 20),
        "kyle_lambda_ma20": roll("avg", "kyle_lambda", 20),
        "range_impact_ma20": roll("avg", "range_impact", 20),
        "price_efficiency": f"abs(close - {lag('close', 20)}) / ({roll('sum', 'hl', 20)} + {EPS})",
    },
]
IMPC = ["amihud", "kyle_lambda", "range_impact", "volume_normalised_return", "amihud_ma20", "kyle_lambda_ma20", "range_impact_ma20", "price_efficiency"]
add("amihud_kyle", on_bars(M.price_impact, IMPC), statement(IMP, IMPC))
BANDS = [
    {"t": "(high + low + close) / 3"},
    {"tv": "t * volume"},
    {"vwap_n": f"{roll('sum', 'tv', 20)} / ({roll('sum', 'volume', 20)} + {EPS})"},
    {"sq": "pow(close - vwap_n, 2) * volume"},
    {"sd": f"sqrt({roll('sum', 'sq', 20)} / ({roll('sum', 'volume', 20)} + {EPS}))"},
    {"vwap_upper": "vwap_n + 2 * sd", "vwap_lower": "vwap_n - 2 * sd", "poc_proxy": roll("max", "t", 20)},
    {"vwap_position": f"(close - vwap_lower) / (vwap_upper - vwap_lower + {EPS})"},
]
BANDC = ["vwap_n", "vwap_upper", "vwap_lower", "poc_proxy", "vwap_position"]
add("vwap_bands", on_bars(M.vwap_bands, BANDC), statement(BANDS, BANDC))
DAY = "(PARTITION BY symbol, CAST(ts AS DATE) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
SES = [
    {
        "session_volume": f"sum(volume) OVER {DAY}",
        "session_high": f"max(high) OVER {DAY}",
        "session_low": f"min(low) OVER {DAY}",
        "bars_in_session": f"count(*) OVER {DAY}",
        "n": f"sum((high + low + close) / 3 * volume) OVER {DAY}",
    },
    {"session_range": "session_high - session_low", "session_vwap": f"n / (session_volume + {EPS})", "session_volume_rate": "session_volume / bars_in_session"},
    {"session_position": f"(close - session_low) / (session_range + {EPS})", "session_vwap_dist": "(close - session_vwap) / nullif(session_vwap, 0) * 100"},
]
SESC = ["session_volume", "session_high", "session_low", "session_range", "session_vwap", "session_volume_rate", "session_position", "session_vwap_dist"]
add("vwap_session", on_bars(M.session_metrics, SESC, ["bars_in_session"]), statement(SES, SESC, ["bars_in_session"]))
OFI = [
    {
        "buy_volume": f"volume * ((close - low) / (high - low + {EPS}))",
        "sell_volume": f"volume * (1 - (close - low) / (high - low + {EPS}))",
        "trade_pressure": f"(close - open) / (high - low + {EPS})",
        "sell_pressure": f"(high - close) / (high - low + {EPS})",
        "tick_volume": f"sign(close - {lag('close')}) * volume",
    },
    {"ofi": "buy_volume - sell_volume", "pv": "trade_pressure * volume"},
    {
        "ofi_ma10": roll("avg", "ofi", 10),
        "ofi_ma20": roll("avg", "ofi", 20),
        "cum_ofi": running("sum", "ofi"),
        "pressure_ma10": roll("avg", "pv", 10),
        "cum_tick_volume": running("sum", "tick_volume"),
    },
]
OFIC = ["buy_volume", "sell_volume", "trade_pressure", "sell_pressure", "ofi", "ofi_ma10", "ofi_ma20", "cum_ofi", "pressure_ma10", "cum_tick_volume"]
add("ofi_proxy", on_bars(M.order_flow, OFIC), statement(OFI, OFIC))

# ---- calendar, lags, interactions
H, MI, D = "hour(ts)", "minute(ts)", "day(ts)"
CAL = {
    "quarter": "quarter(ts)",
    "week_of_year": "weekofyear(ts)",
    **{f"{n}_{f}": f"{f}(2 * pi() * {x} / {p})" for n, x, p in (("hour", H, 24), ("dow", "(isodow(ts) - 1)", 7), ("month", "month(ts)", 12)) for f in ("sin", "cos")},
    "turn_of_month": flag(f"{D} <= 3 OR {D} >= 28"),
    "first_half_month": flag(f"{D} <= 15"),
    "month_start": flag(f"{D} = 1"),
    "month_end": flag(f"{D} = day(last_day(ts))"),
    "is_rth": flag(f"({H} = 8 AND {MI} >= 30) OR ({H} >= 9 AND {H} < 15) OR ({H} = 15 AND {MI} = 0)"),
    "is_opening_hour": flag(f"{H} = 8 OR {H} = 9"),
    "is_closing_hour": flag(f"{H} = 14 OR {H} = 15"),
}
CALF = [c for c in CAL if c.endswith(("_sin", "_cos"))]
CALI = [c for c in CAL if c not in CALF]
add("calendar_cyclic", on_bars(C.calendar_columns, CALF, CALI), statement([CAL], CALF, CALI))
LAGS = {f"return_1_lag_{k}": lag("return_1", k) for k in (1, 2, 3, 5, 10)}
ROLLS = {}
for n in (10, 20):
    ROLLS |= {f"return_1_mean_{n}": roll("avg", "return_1", n), f"return_1_std_{n}": roll("stddev_samp", "return_1", n)}
    ROLLS |= {f"return_1_min_{n}": roll("min", "return_1", n), f"return_1_max_{n}": roll("max", "return_1", n), f"v{n}": f"{frame_list('return_1', n)}"}
RANKS = {f"return_1_rank_{n}": f"CASE WHEN {over_count} = {n} THEN (len(list_filter(v{n}, lambda q: q < return_1)) + (len(list_filter(v{n}, lambda q: q = return_1)) + 1) / 2) / {n}.0 END" for n, over_count in ((10, f"count(return_1) {over(10)}"), (20, f"count(return_1) {over(20)}"))}
LAGC = [*LAGS, *[c for c in ROLLS if c[0] == "r"], *RANKS]
add(
    "lagged_stats",
    on_bars(lambda b: C.rolling_statistics(C.lagged(P.returns(b, (1,)), ["return_1"]), "return_1"), LAGC),
    statement([{"return_1": ret(1)}, LAGS | ROLLS, RANKS], LAGC),
)
RSI14 = f"100 - 100 / (1 + {roll('avg', 'g', 14)} / ({roll('avg', 'l', 14)} + {EPS}))"
ITX = [
    {"return_1": ret(1), "rel_volume_20": f"volume / ({roll('avg', 'volume', 20)} + {EPS})", "d": f"close - {lag('close')}", "hour_sin": f"sin(2 * pi() * {H} / 24)"},
    {"g": "CASE WHEN d > 0 THEN d ELSE 0.0 END", "l": "CASE WHEN d < 0 THEN -d ELSE 0.0 END"},
    {"rsi_14": RSI14},
    {
        "volume_x_return": "rel_volume_20 * return_1",
        "volume_x_rsi": "rel_volume_20 * (rsi_14 - 50) / 50",
        "time_x_return": "hour_sin * return_1",
        "oversold_x_volume": f"{flag('rsi_14 < 30')} * rel_volume_20",
        "overbought_x_volume": f"{flag('rsi_14 > 70')} * rel_volume_20",
    },
]
add(
    "interactions",
    on_bars(lambda b: C.interactions(C.calendar_columns(T.rsi(T.volume_profile(P.returns(b, (1,))), (14,)))), list(ITX[3])),
    statement(ITX, list(ITX[3])),
)

# ---- regimes
DAILY = (
    BARS
    + """,
daily AS (SELECT symbol, date_trunc('day', ts) AS ts, arg_max(close, bars.ts) / 10 AS vol, max(high) / 10 AS front, sum(close) / count(*) / 10 AS second
  FROM bars GROUP BY symbol, date_trunc('day', ts))"""
)


def daily_levels(spark, sf_dir):
    d = F.date_trunc("day", "ts").cast("timestamp_ntz")
    return hour_bars(spark, sf_dir).groupBy("symbol", d.alias("day")).agg(
        (F.max_by("close", "ts") / 10).alias("vol"), (F.max("high") / 10).alias("front"), (F.sum("close") / F.count(F.lit(1)) / 10).alias("second")
    ).withColumnRenamed("day", "ts")


LEVEL = [
    {"v": frame_list("vol", 20), "a": flag("vol > 20"), "ch": f"vol / nullif({lag('vol')}, 0) - 1"},
    {
        "level_low": flag("vol < 10"),
        "level_mid": flag("vol >= 10 AND vol < 15"),
        "level_high": flag("vol >= 15 AND vol < 25"),
        "level_extreme": flag("vol >= 25"),
        "level_percentile": below_share("vol", "v", 20, "100"),
        **{f"level_roc_{k}": f"vol / nullif({lag('vol', k)}, 0) - 1" for k in (1, 5, 10)},
        "level_momentum_5": f"vol - {roll('avg', 'vol', 5)}",
        "level_zscore": f"(vol - {roll('avg', 'vol', 20)}) / ({roll('stddev_samp', 'vol', 20)} + {EPS})",
        "level_above_sma21": flag(f"vol > {roll('avg', 'vol', 21)}"),
        "level_spike": flag("ch > 0.10"),
        "level_spike_size": "CASE WHEN ch IS NOT NULL THEN greatest(ch, 0.0) END",
        "level_contraction": flag("ch < -0.05"),
        "level_range_5": f"{roll('max', 'vol', 5)} - {roll('min', 'vol', 5)}",
        "level_days_above": roll("sum", "a", 21),
    },
]
LEVI = ["level_low", "level_mid", "level_high", "level_extreme", "level_above_sma21", "level_spike", "level_contraction"]
LEVF = [c for c in LEVEL[1] if c not in LEVI]
add(
    "volatility_levels",
    lambda s, d: shown(R.level_columns(daily_levels(s, d), "vol", 10, 15, 25, n=20), LEVF, LEVI),
    statement(LEVEL, LEVF, LEVI, base=DAILY, first="daily"),
)
TERM = [
    {
        "basis": "vol - front", "basis_pct": "(vol - front) / nullif(vol, 0)", "contango": flag("front > vol"), "backwardation": flag("vol > front"),
        "term_spread": "front - second", "term_slope": "(front - second) / nullif(vol, 0)",
    },
    {"v": frame_list("basis", 10)},
    {"basis_percentile": below_share("basis", "v", 10, "100")},
]
TERF, TERI = ["basis", "basis_pct", "term_spread", "term_slope", "basis_percentile"], ["contango", "backwardation"]
add("term_structure", lambda s, d: shown(R.term_structure(daily_levels(s, d), "vol", "front", "second", n=10), TERF, TERI), statement(TERM, TERF, TERI, base=DAILY, first="daily"))
RULES = [
    {"r": f"ln(close / nullif({lag('close')}, 0))", "t": f"abs(close / nullif({lag('close', 21)}, 0) - 1)"},
    {"vv": f"{roll('stddev_samp', 'r', 21)} * sqrt(252.0)"},
    {"vm": quantile("vv", 63, 0.5), "tm": quantile("t", 63, 0.5)},
    {
        "regime": "CASE WHEN coalesce(vv > vm * 1.2, false) AND coalesce(t > tm, false) THEN 2 WHEN coalesce(vv > vm * 1.2, false) THEN 3 "
        "WHEN coalesce(vv < vm * 0.8, false) AND coalesce(t > tm, false) THEN 0 ELSE 1 END"
    },
    {"regime_change": f"CASE WHEN {lag('regime')} IS NULL OR {lag('regime')} <> regime THEN 1 ELSE 0 END"},
    {"g": running("sum", "regime_change")},
    {"regime_duration": "row_number() OVER (PARTITION BY symbol, g ORDER BY ts)"},
    {f"regime_{n}": flag(f"regime = {k}") for n, k in (("low_trend", 0), ("low_range", 1), ("high_trend", 2), ("high_chaos", 3))},
]
RULI = ["regime", "regime_change", "regime_duration", *RULES[7]]
add("regime_rules", on_bars(lambda b: R.rule_regimes(b, 21, 63), [], RULI), statement(RULES, [], RULI))
add(
    "markov_transitions",
    lambda s, d: R.transitions(R.rule_regimes(hour_bars(s, d), 21, 63), "regime").select("symbol", F.col("state").cast("int"), F.col("next").cast("int"), "n", F.round("p", 6).alias("p")),
    "WITH q AS ("
    + statement(RULES, [], RULI)
    + "), p AS (SELECT symbol, regime AS state, lead(regime) OVER (PARTITION BY symbol ORDER BY ts) AS next FROM q) "
    "SELECT symbol, state, next, n, round(n / sum(n) OVER (PARTITION BY symbol, state), 6) AS p FROM "
    "(SELECT symbol, state, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY symbol, state, next)",
)
MARKOV = (
    "WITH q AS ("
    + statement(RULES, [], RULI)
    + "), p AS (SELECT symbol, regime AS state, lead(regime) OVER (PARTITION BY symbol ORDER BY ts) AS next FROM q), "
    "c AS (SELECT symbol, state, next, count(*) AS n FROM p WHERE next IS NOT NULL GROUP BY symbol, state, next), "
    "m AS (SELECT symbol, state, next, n / sum(n) OVER (PARTITION BY symbol, state) AS p FROM c), "
    "m2 AS (SELECT a.symbol, a.state, b.next, sum(a.p * b.p) AS p FROM m a JOIN m b ON a.symbol = b.symbol AND a.next = b.state GROUP BY ALL) "
    "SELECT a.symbol, a.state, b.next, round(sum(a.p * b.p), 6) AS p FROM m2 a JOIN m b ON a.symbol = b.symbol AND a.next = b.state GROUP BY ALL"
)
add(
    "markov_forecast",
    lambda s, d: R.forecast(R.transitions(R.rule_regimes(hour_bars(s, d), 21, 63), "regime"), 3).select(
        "symbol", F.col("state").cast("int"), F.col("next").cast("int"), F.round("p", 6).alias("p")
    ),
    MARKOV,
)
add(
    "regime_emissions",
    lambda s, d: R.emissions(P.returns(R.rule_regimes(hour_bars(s, d), 21, 63), (1,)), "regime", "return_1").select(
        "symbol", F.col("regime").cast("int"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "n"
    ),
    "WITH q AS ("
    + statement([{"return_1": ret(1)}, *RULES], ["return_1"], ["regime"]).replace("round(CAST(return_1 AS DOUBLE) + 1.3e-7, 6)", "return_1")
    + ") SELECT symbol, regime, round(avg(return_1), 6) AS mean, round(stddev_samp(return_1), 6) AS std, count(return_1) AS n FROM q GROUP BY symbol, regime",
)
AUTO = [
    {"return_1": ret(1)},
    {"p": lag("return_1")},
    {"autocorr_21": f"CASE WHEN count(return_1) {over(21)} = 21 THEN corr(return_1, p) {over(20)} END"},
]
add("rolling_autocorr", on_bars(lambda b: R.autocorrelation(P.returns(b, (1,)), "return_1"), ["autocorr_21"]), statement(AUTO, ["autocorr_21"]))
add("mixture_regimes", lambda s, d: shown(R.mixture_regimes(T.realised_volatility(hour_bars(s, d)), ["rv_5", "rv_10", "rv_21", "parkinson_21"]), ["mixture_p"], ["mixture"]))

# ---- markets and timeframes
OTHERS = ("error", "purchase", "signup", "view")
PAIRS = BARS + ",\npaired AS (SELECT p.*, " + ", ".join(f"c_{s}.close AS close_{s}" for s in OTHERS) + " FROM (SELECT * FROM bars WHERE symbol = 'click') p"
for other in OTHERS:
    PAIRS += f" ASOF LEFT JOIN (SELECT ts, close FROM bars WHERE symbol = '{other}') c_{other} ON p.ts >= c_{other}.ts"
PAIRS += ")"
RETS = {"ret": ret(1)} | {f"ret_{s}": f"close_{s} / nullif({lag(f'close_{s}')}, 0) - 1" for s in OTHERS}


def paired(spark, sf_dir):
    return X.paired(hour_bars(spark, sf_dir), "click", list(OTHERS))


def corr(a: str, b: str, n: int) -> str:
    both = f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 END"
    return f"(CASE WHEN count({both}) {over(n)} = {n} THEN corr({a}, {b}) {over(n)} END)"


def on_pairs(operator, floats, ints=()):
    return lambda s, d: shown(operator(paired(s, d)), floats, ints)


def pair_sql(layers, floats, ints=()):
    return statement([RETS, *layers], floats, ints, base=PAIRS, first="paired")


COR = {f"corr_{s}_{n}": corr("ret", f"ret_{s}", n) for s in OTHERS for n in (10, 20, 50)} | {
    f"corr_change_{s}": f"{corr('ret', f'ret_{s}', 5)} - {corr('ret', f'ret_{s}', 20)}" for s in OTHERS
}
add("cross_symbol_corr", on_pairs(lambda p: X.correlations(p, list(OTHERS)), list(COR)), pair_sql([COR], list(COR)))
LEAD = [
    {f"o{k}": lag("ret_error", k) for k in (1, 5, 10)} | {f"p{k}": lag("ret", k) for k in (1, 5, 10)},
    {f"lead_{k}": corr("ret", f"o{k}", 20) for k in (1, 5, 10)} | {f"lag_{k}": corr("ret_error", f"p{k}", 20) for k in (1, 5, 10)},
    {
        "best_lag": "CASE WHEN lead_1 IS NOT NULL AND lead_5 IS NOT NULL AND lead_10 IS NOT NULL THEN CASE WHEN abs(lead_1) >= abs(lead_5) AND abs(lead_1) >= abs(lead_10) "
        "THEN 1 WHEN abs(lead_5) >= abs(lead_10) THEN 5 ELSE 10 END END"
    },
]
add("lead_lag_corr", on_pairs(lambda p: X.lead_lag(p, "error"), list(LEAD[1]), ["best_lag"]), pair_sql(LEAD, list(LEAD[1]), ["best_lag"]))
SPR = [
    {"spread": "ret - ret_error"},
    {
        "spread_ma5": roll("avg", "spread", 5),
        "spread_zscore": f"(spread - {roll('avg', 'spread', 20)}) / ({roll('stddev_samp', 'spread', 20)} + {EPS})",
        "risk_on": flag(f"{roll('avg', 'spread', 5)} > 0"),
        "flight": flag("ret < 0 AND ret_error > 0"),
    },
]
add("return_spread_z", on_pairs(lambda p: X.spreads(p, "error"), ["spread", "spread_ma5", "spread_zscore"], ["risk_on", "flight"]), pair_sql(SPR, ["spread", "spread_ma5", "spread_zscore"], ["risk_on", "flight"]))
RS = [
    {"rs": "close / nullif(close_error, 0)"},
    {"rs_mom5": f"rs / nullif({lag('rs', 5)}, 0) - 1", "rs_mom20": f"rs / nullif({lag('rs', 20)}, 0) - 1", "rs_vs_ma20": f"rs / nullif({roll('avg', 'rs', 20)}, 0)"},
]
add("relative_strength", on_pairs(lambda p: X.relative_strength(p, "error"), ["rs", *RS[1]]), pair_sql(RS, ["rs", *RS[1]]))
CR = [
    {f"c_{s}": corr("ret", f"ret_{s}", 20) for s in OTHERS},
    {"avg_corr": f"list_avg(list_filter([{', '.join(f'c_{s}' for s in OTHERS)}], lambda q: q IS NOT NULL))"},
    {"d": f"avg_corr - {lag('avg_corr', 5)}"},
    {"sd": roll("stddev_samp", "d", 20)},
    {"high_corr": flag("avg_corr > 0.7"), "low_corr": flag("avg_corr < 0.3"), "corr_spike_up": flag("d > sd * 2"), "corr_spike_down": flag("d < -sd * 2")},
]
add("corr_regime", on_pairs(lambda p: X.correlation_regimes(p, list(OTHERS)), ["avg_corr"], list(CR[4])), pair_sql(CR, ["avg_corr"], list(CR[4])))


def timeframe_sql(name: str, minutes: int) -> str:
    step = "date_trunc('day', ts)" if minutes == 1440 else f"time_bucket(INTERVAL {minutes // 60} HOUR, ts, TIMESTAMP '2000-01-01')"
    made = {
        "sma_20": roll("avg", "close", 20),
        "trend_up": flag("d > 0"),
        "higher_high": flag(f"high > {lag('high')}"),
        "lower_low": flag(f"low < {lag('low')}"),
        "rsi_14": RSI14,
        "roc_5": f"close / nullif({lag('close', 5)}, 0) - 1",
        "atr_14": "a",
        "atr_expansion": flag(f"a > {roll('avg', 'a', 14)}"),
        "range_pct": "(high - low) / nullif(close, 0)",
        "rel_volume": f"volume / ({roll('avg', 'volume', 20)} + {EPS})",
    }
    columns = ", ".join(f"{e} AS tf{minutes}_{n}" for n, e in made.items())
    late = ", ".join(f"lag(tf{minutes}_{n}) {over()} AS tf{minutes}_{n}" for n in made)
    return f"""{name}0 AS (SELECT symbol, {step} AS b, arg_min(open, bars.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, bars.ts) AS close, sum(volume) AS volume
  FROM bars GROUP BY symbol, {step}),
{name}1 AS (SELECT * EXCLUDE (b), b AS ts FROM {name}0),
{name}2 AS (SELECT *, close - {lag('close')} AS d, {TR} AS tr FROM {name}1),
{name}3 AS (SELECT *, CASE WHEN d > 0 THEN d ELSE 0.0 END AS g, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS l, {roll('avg', 'tr', 14)} AS a FROM {name}2),
{name}4 AS (SELECT symbol, ts, {columns} FROM {name}3),
{name} AS (SELECT symbol, ts, {late} FROM {name}4)"""


def last_known(minutes: int, names: list[str]) -> str:
    """Null values do not replace earlier ones."""
    return ", ".join(f"last_value(tf{minutes}_{n} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts) AS tf{minutes}_{n}" for n in names)


TFN = ["sma_20", "trend_up", "higher_high", "lower_low", "rsi_14", "roc_5", "atr_14", "atr_expansion", "range_pct", "rel_volume"]
MTF_BASE = f"""{BARS},
{timeframe_sql('tfa', 240)}, {timeframe_sql('tfb', 1440)},
tfa_f AS (SELECT symbol, ts, {last_known(240, TFN)} FROM tfa), tfb_f AS (SELECT symbol, ts, {last_known(1440, TFN)} FROM tfb),
mtf AS (SELECT p.*, a.* EXCLUDE (symbol, ts), b.* EXCLUDE (symbol, ts) FROM bars p ASOF LEFT JOIN tfa_f a ON p.symbol = a.symbol AND p.ts >= a.ts
  ASOF LEFT JOIN tfb_f b ON p.symbol = b.symbol AND p.ts >= b.ts)"""


def mean_of(xs: list[str]) -> str:
    return f"list_avg(list_filter([{', '.join(xs)}], lambda q: q IS NOT NULL))"


TRENDS = ["CAST(b0 AS DOUBLE)", "tf240_trend_up", "tf1440_trend_up"]
MTF = [
    {"b0": flag(f"close > {lag('close')}")},
    {
        "trend_agreement": mean_of(TRENDS),
        "all_up": flag(f"list_sum(list_filter([{', '.join(TRENDS)}], lambda q: q IS NOT NULL)) = 3"),
        "all_down": flag(f"list_sum(list_filter([{', '.join(TRENDS)}], lambda q: q IS NOT NULL)) = 0"),
        "base_vs_coarse": f"b0 - {mean_of(TRENDS[1:])}",
        "rsi_mean": mean_of(["tf240_rsi_14", "tf1440_rsi_14"]),
        "rsi_std": "CASE WHEN tf240_rsi_14 IS NOT NULL AND tf1440_rsi_14 IS NOT NULL THEN list_stddev_samp([tf240_rsi_14, tf1440_rsi_14]) END",
        "expansion": mean_of(["tf240_atr_expansion", "tf1440_atr_expansion"]),
    },
]
MTFF = [f"tf{m}_{n}" for m in (240, 1440) for n in ("sma_20", "rsi_14", "roc_5", "atr_14", "range_pct", "rel_volume")] + ["trend_agreement", "base_vs_coarse", "rsi_mean", "rsi_std", "expansion"]
MTFI = [f"tf{m}_{n}" for m in (240, 1440) for n in ("trend_up", "higher_high", "lower_low", "atr_expansion")] + ["all_up", "all_down"]
add("mtf_asof", on_bars(lambda b: X.multi_timeframe(b, [240, 1440]), MTFF, MTFI), statement(MTF, MTFF, MTFI, base=MTF_BASE, first="mtf"))

# ---- joins
CLICKS = "(SELECT ts, value FROM events WHERE event_type = 'error')"


def error_events(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'error'")


add(
    "asof_backward",
    lambda s, d: shown(J.asof(hour_bars(s, d), error_events(s, d).select(F.col("event_type").alias("_t"), "ts", "value").drop("_t"), ["value"], by=()), ["close", "value"]),
    f"WITH {BARS} SELECT symbol, bars.ts AS ts, round(close + 1.3e-7, 6) AS close, round(e.value + 1.3e-7, 6) AS value FROM bars ASOF LEFT JOIN {CLICKS} e ON bars.ts >= e.ts",
)
DAYS = "daily_errors AS (SELECT CAST(ts AS DATE) AS date, avg(value) AS err_mean, CAST(count(*) AS DOUBLE) AS err_count FROM events WHERE event_type = 'error' GROUP BY 1)"


def daily_errors(spark, sf_dir):
    rows = error_events(spark, sf_dir)
    return rows.groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("err_mean"), F.count(F.lit(1)).cast("double").alias("err_count"))


FULL = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
REST = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
add(
    "daily_prev_day_join",
    lambda s, d: shown(J.previous_day(hour_bars(s, d), daily_errors(s, d), ["err_mean", "err_count"]), ["err_mean", "err_count"]),
    f"""WITH {BARS}, {DAYS}, j AS (SELECT bars.symbol, bars.ts, e.err_mean, e.err_count FROM bars LEFT JOIN daily_errors e ON e.date = CAST(bars.ts AS DATE) - 1)
    SELECT symbol, ts, """
    + ", ".join(f"round(coalesce(last_value({c} IGNORE NULLS) {FULL}, first_value({c} IGNORE NULLS) {REST}, 0.0) + 1.3e-7, 6) AS {c}" for c in ("err_mean", "err_count"))
    + " FROM j",
)
add(
    "same_day_ffill",
    lambda s, d: shown(J.same_day(hour_bars(s, d), daily_errors(s, d), ["err_mean"]), ["err_mean"]),
    f"WITH {BARS}, {DAYS}, j AS (SELECT bars.symbol, bars.ts, e.err_mean FROM bars LEFT JOIN daily_errors e ON e.date = CAST(bars.ts AS DATE)) "
    f"SELECT symbol, ts, round(last_value(err_mean IGNORE NULLS) {FULL} + 1.3e-7, 6) AS err_mean FROM j",
)
add(
    "event_window_sentiment",
    lambda s, d: shown(J.event_windows(hour_bars(s, d), error_events(s, d), 240, 5, "value", decay=0.95).withColumn("score", F.round("score", 4)), ["score"], ["events"]),
    f"""WITH {BARS}, j AS (SELECT b.symbol, b.ts, count(e.ts) AS events,
      sum(e.value * pow(0.95, date_diff('microsecond', e.ts, b.ts) / 6e7)) / nullif(sum(pow(0.95, date_diff('microsecond', e.ts, b.ts) / 6e7)), 0) AS score
      FROM bars b LEFT JOIN {CLICKS} e ON e.ts >= b.ts - INTERVAL 245 MINUTE AND e.ts < b.ts - INTERVAL 5 MINUTE GROUP BY b.symbol, b.ts)
    SELECT symbol, ts, round(score, 4) AS score, CAST(events AS INTEGER) AS events FROM j""",
)
add(
    "event_window_weighted",
    lambda s, d: shown(
        J.event_windows(hour_bars(s, d), error_events(s, d).withColumn("k", F.get_json_object("props", "$.k").cast("double")), 60, 5, "value", weight="k"), ["score", "weight"], ["events"]
    ),
    f"""WITH {BARS}, e AS (SELECT ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events WHERE event_type = 'error'),
    j AS (SELECT b.symbol, b.ts, count(e.ts) AS events, sum(e.value * k) / nullif(sum(k), 0) AS score, coalesce(sum(k), 0.0) AS weight
      FROM bars b LEFT JOIN e ON e.ts >= b.ts - INTERVAL 65 MINUTE AND e.ts < b.ts - INTERVAL 5 MINUTE GROUP BY b.symbol, b.ts)
    SELECT symbol, ts, round(score + 1.3e-7, 6) AS score, round(weight + 1.3e-7, 6) AS weight, CAST(events AS INTEGER) AS events FROM j""",
)
FOLDS = [(i, f"2024-01-{3 + 5 * i:02d} 06:00:00", f"2024-01-{8 + 5 * i - (i == 2):02d} 06:00:00") for i in range(4)]


def schedule(spark):
    rows = spark.createDataFrame(FOLDS, "fold int, a string, b string")
    return rows.select("fold", F.col("a").cast("timestamp_ntz").alias("valid_from"), F.col("b").cast("timestamp_ntz").alias("valid_until"))


add(
    "valid_fold_lookup",
    lambda s, d: shown(J.valid_fold(hour_bars(s, d), schedule(s)), [], ["fold"]),
    f"WITH {BARS}, f(fold, a, b) AS (VALUES "
    + ", ".join(f"({i}, TIMESTAMP '{a}', TIMESTAMP '{b}')" for i, a, b in FOLDS)
    + ") SELECT symbol, ts, CAST(coalesce(fold, 3) AS INTEGER) AS fold FROM bars LEFT JOIN f ON ts >= a AND ts < b",
)
add(
    "outer_daily_merge",
    lambda s, d: J.outer_by_day(daily_errors(s, d), _daily_views(s, d)).select("date", *[F.round(c, 6).alias(c) for c in ("err_mean", "err_count", "view_mean")]),
    f"""WITH {DAYS}, v AS (SELECT CAST(ts AS DATE) AS date, avg(value) AS view_mean FROM events WHERE event_type = 'view' GROUP BY 1),
    j AS (SELECT coalesce(e.date, v.date) AS date, err_mean, err_count, view_mean FROM daily_errors e FULL JOIN v ON e.date = v.date)
    SELECT date, """
    + ", ".join(f"round(last_value({c} IGNORE NULLS) OVER (ORDER BY date), 6) AS {c}" for c in ("err_mean", "err_count", "view_mean"))
    + " FROM j",
)


def _daily_views(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'view'")
    return rows.groupBy(F.to_date("ts").alias("date")).agg(F.avg("value").alias("view_mean"))


add(
    "ffill_bfill",
    lambda s, d: B.densify_days(daily_errors(s, d).withColumn("k", F.lit("error")), "k", "date", "err_mean").select("k", "date", F.round("err_mean", 6).alias("err_mean")),
    f"""WITH {DAYS}, r AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS date FROM daily_errors)
    SELECT 'error' AS k, CAST(r.date AS DATE) AS date, round(last_value(err_mean IGNORE NULLS) OVER (ORDER BY r.date), 6) AS err_mean
    FROM r LEFT JOIN daily_errors e ON e.date = CAST(r.date AS DATE)""",
)

# ---- structure
PYR0 = {"pc": lag("close"), "tr": TR, "r": ret(1)}
PYR1 = {"a14": roll("avg", "tr", 14), "vol": roll("stddev_samp", "r", 20), "up": flag("r > 0"), "s10": roll("avg", "close", 10)}
PYR2 = {}
for n in (5, 10, 20):
    PYR2 |= {f"f{n}": f"({before('max', 'high', n)} - pc) / (pc + {EPS})", f"a{n}": f"(pc - {before('min', 'low', n)}) / (pc + {EPS})"}
PYR3 = {"pyramid_calm": flag(f"vol < {roll('avg', 'vol', 50)}")}
for n in (5, 10, 20):
    PYR3 |= {f"pyramid_rr_{n}": f"f{n} / (a{n} + {EPS})", f"pyramid_long_{n}": flag(f"f{n} > 0.005 AND a{n} < 0.003"), f"pyramid_short_{n}": flag(f"a{n} > 0.005 AND f{n} < 0.003")}
for k in (1, 2, 3):
    PYR3 |= {f"pyramid_add_{k}_long": flag(f"close < s10 - a14 * {0.5 * k}"), f"pyramid_add_{k}_short": flag(f"close > s10 + a14 * {0.5 * k}")}
for n in (10, 20):
    PYR3 |= {f"trend_consistency_{n}": f"{roll('sum', 'up', n)} / {n}", f"pyramid_momentum_{n}": ret(n)}
PYR4 = {f"trend_accel_{n}": f"pyramid_momentum_{n} - {lag(f'pyramid_momentum_{n}')}" for n in (10, 20)}
PYRF = [c for c in [*PYR3, *PYR4] if c.startswith(("trend_", "pyramid_momentum", "pyramid_rr"))]
PYRI = [c for c in PYR3 if c not in PYRF]
add("pyramiding", on_bars(lambda b: U.pyramiding(b).withColumns({f"pyramid_rr_{n}": F.least(F.col(f"pyramid_rr_{n}"), F.lit(1e6)) for n in (5, 10, 20)}), PYRF, PYRI),
    statement([PYR0, PYR1, PYR2, {k: (f"least({v}, 1e6)" if "_rr_" in k else v) for k, v in PYR3.items()}, PYR4], PYRF, PYRI))
DD0 = {"tr": TR}
DD1 = {"a14": roll("avg", "tr", 14)} | {f"range_position_{n}": f"(close - {roll('min', 'low', n)}) / ({roll('max', 'high', n)} - {roll('min', 'low', n)} + {EPS})" for n in (20, 50)}
DD2 = {"atr_from_high": f"({roll('max', 'high', 20)} - close) / (a14 + {EPS})", "atr_from_low": f"(close - {roll('min', 'low', 20)}) / (a14 + {EPS})"}
for n in (20, 50):
    p = f"range_position_{n}"
    DD2 |= {f"buy_zone_{n}": flag(f"{p} < 0.3"), f"strong_buy_{n}": flag(f"{p} < 0.15"), f"sell_zone_{n}": flag(f"{p} > 0.7"), f"strong_sell_{n}": flag(f"{p} > 0.85")}
DD3 = {f"{side}_level_{k}": flag(f"atr_from_{far} >= {k}") for k in (1, 2, 3) for side, far in (("buy", "high"), ("sell", "low"))}
for n in (10, 20):
    DD3 |= {
        f"buy_pattern_{n}": flag(f"{lag('buy_zone_20', n)} = 1 AND {lag('close')} > {lag('close', n)}"),
        f"sell_pattern_{n}": flag(f"{lag('sell_zone_20', n)} = 1 AND {lag('close')} < {lag('close', n)}"),
    }
DD4 = {f"{side}_effect_{n}": roll("avg", f"{side}_pattern_{n}", 50) for n in (10, 20) for side in ("buy", "sell")}
DDF = ["range_position_20", "range_position_50", "atr_from_high", "atr_from_low", *DD4]
DDI = [c for c in [*DD2, *DD3] if c not in DDF]
add("ddca_zones", on_bars(U.averaging_zones, DDF, DDI), statement([DD0, DD1, DD2, DD3, DD4], DDF, DDI))
PV0 = {"pivot_high": flag(f"{lag('high', 5)} >= {before('max', 'high', 15)}"), "pivot_low": flag(f"{lag('low', 5)} <= {before('min', 'low', 15)}")}
PV1 = {
    "last_high": f"last_value(CASE WHEN pivot_high = 1 THEN high END IGNORE NULLS) {FULL}",
    "last_low": f"last_value(CASE WHEN pivot_low = 1 THEN low END IGNORE NULLS) {FULL}",
    "wu": "high - greatest(open, close)", "wd": "least(open, close) - low", "bd": "abs(close - open)",
    "ph": before("max", "high", 20), "pl": before("min", "low", 20),
}
PV2 = {
    "to_resistance": "(last_high - close) / nullif(close, 0) * 100",
    "to_support": "(close - last_low) / nullif(close, 0) * 100",
    "rz": flag("abs(high - last_high) / nullif(last_high, 0) < 0.002"),
    "sz": flag("abs(low - last_low) / nullif(last_low, 0) < 0.002"),
    "upper_wick": f"wu / (bd + wu + wd + {EPS})",
    "lower_wick": f"wd / (bd + wu + wd + {EPS})",
}
PV3 = {
    "near_resistance": flag("abs(to_resistance) < 0.2"), "near_support": flag("abs(to_support) < 0.2"),
    "resistance_touches": roll("sum", "rz", 50), "support_touches": roll("sum", "sz", 50),
    "rejection_high": flag("pivot_high = 1 AND upper_wick > 0.5"), "rejection_low": flag("pivot_low = 1 AND lower_wick > 0.5"),
    "breakout_high": flag("close > ph"), "breakout_low": flag("close < pl"),
    "failed_high": flag(f"{lag('close')} > {lag('ph')} AND close < ph"), "failed_low": flag(f"{lag('close')} < {lag('pl')} AND close > pl"),
}
PVF = ["last_high", "last_low", "to_resistance", "to_support", "upper_wick", "lower_wick", "resistance_touches", "support_touches"]
PVI = ["pivot_high", "pivot_low", *[c for c in PV3 if c not in PVF]]
add("pivots_sr", on_bars(U.confirmed_pivots, PVF, PVI), statement([PV0, PV1, PV2, PV3], PVF, PVI))
LV0 = {"h": roll("max", "high", 20), "lo": roll("min", "low", 20), "c1": lag("close")}
LV1 = {"pivot_point": "(h + lo + c1) / 3", "w": "h - lo"}
LV2 = {"s1": "2 * pivot_point - h", "s2": "pivot_point - w", "s3": "lo - 2 * (h - pivot_point)", "r1": "2 * pivot_point - lo", "r2": "pivot_point + w", "r3": "h + 2 * (pivot_point - lo)"}
for i, k in enumerate((0.382, 0.618, 1.0), 1):
    LV2 |= {f"fib_s{i}": f"pivot_point - {k} * w", f"fib_r{i}": f"pivot_point + {k} * w"}
for i, k in enumerate((12, 6, 4), 1):
    LV2 |= {f"cam_s{i}": f"c1 - w * 1.1 / {k}", f"cam_r{i}": f"c1 + w * 1.1 / {k}"}
LV3 = {"to_pivot": "(close - pivot_point) / nullif(pivot_point, 0) * 100", "above_pivot": flag("close > pivot_point"), "above_r1": flag("close > r1"), "below_s1": flag("close < s1")}
LVF = ["pivot_point", *LV2, "to_pivot"]
add("pivot_levels", on_bars(U.pivot_levels, LVF, ["above_pivot", "above_r1", "below_s1"]), statement([LV0, LV1, LV2, LV3], LVF, ["above_pivot", "above_r1", "below_s1"]))

# ---- sentiment
POS, NEG = ["the", "was", "und", "que"], ["with", "der", "de", "la"]
KW = "SELECT doc_id, list_distinct(regexp_split_to_array(lower(coalesce(text, '')), '\\s+')) AS w FROM documents"
add(
    "keyword_sentiment",
    lambda s, d: S.keyword_score(table(s, d, "documents"), "text", POS, NEG).select(
        "doc_id", F.col("positive_hits").cast("int"), F.col("negative_hits").cast("int"), F.round("keyword_score", 6).alias("keyword_score")
    ),
    f"""WITH k AS ({KW}), h AS (SELECT doc_id, len(list_intersect(w, {POS})) AS p, len(list_intersect(w, {NEG})) AS n FROM k)
    SELECT doc_id, CAST(p AS INTEGER) AS positive_hits, CAST(n AS INTEGER) AS negative_hits, round(CASE WHEN p + n > 0 THEN (p - n) / (p + n) ELSE 0.0 END, 6) AS keyword_score FROM h""",
)
add(
    "title_extract",
    lambda s, d: S.titles(table(s, d, "pages")).select("page_id", F.explode_outer("titles").alias("title")),
    """WITH t AS (SELECT page_id, list_filter(regexp_extract_all(html, '<title>(.*?)</title>', 1, 'si')[1:20], lambda x: length(x) > 10) AS ts FROM pages)
    SELECT page_id, unnest(CASE WHEN len(ts) = 0 THEN [NULL] ELSE ts END) AS title FROM t""",
)
BRE = (
    BARS
    + f""",
updown AS (SELECT *, close - {lag('close')} AS d FROM bars),
breadth AS (SELECT 'all' AS symbol, ts, count(*) FILTER (WHERE d > 0) AS ups, count(*) FILTER (WHERE d < 0) AS downs FROM updown GROUP BY ts),
steps AS (SELECT *, CAST(ups - downs AS DOUBLE) AS net, row_number() OVER (ORDER BY ts) AS rn FROM breadth),
walk AS (SELECT rn, net AS s19, 1.0::DOUBLE AS w19, net AS s39, 1.0::DOUBLE AS w39 FROM steps WHERE rn = 1
  UNION ALL SELECT t.rn, s19 * 0.9 + t.net, w19 * 0.9 + 1, s39 * 0.95 + t.net, w39 * 0.95 + 1 FROM walk w JOIN steps t ON t.rn = w.rn + 1)"""
)


def breadth_rows(spark, sf_dir):
    fr = Frames()
    moves = hour_bars(spark, sf_dir).withColumn("d", F.col("close") - fr.lag("close"))
    return moves.groupBy("ts").agg(F.count_if(F.col("d") > 0).alias("ups"), F.count_if(F.col("d") < 0).alias("downs")).withColumn("symbol", F.lit("all"))


add(
    "breadth_mcclellan",
    lambda s, d: shown(S.breadth(breadth_rows(s, d), "ups", "downs"), ["ad_ratio", "ad_line", "mcclellan"]),
    f"""WITH RECURSIVE {BRE} SELECT symbol, ts, round(ups / (downs + {EPS}) + 1.3e-7, 6) AS ad_ratio, round(sum(net) OVER (ORDER BY ts) + 1.3e-7, 6) AS ad_line,
    round(s19 / w19 - s39 / w39 + 1.3e-7, 6) AS mcclellan FROM steps JOIN walk USING (rn)""",
)
FG0 = {"q90": quantile("vol", 10, 0.9), "lo": roll("min", "vol", 10), "hi": roll("max", "vol", 10)}
FG1 = {"composite": f"100 * (0.7 * ((vol - lo) / (hi - lo + {EPS})) + 0.3 * {flag('vol > ' + roll('avg', 'vol', 10))})"}
FG2 = {"fear": flag("composite < 25"), "greed": flag("composite > 75"), "extreme_quantile": flag("vol > q90")}
add("fear_greed", lambda s, d: shown(S.fear_greed(daily_levels(s, d), "vol", 10), ["composite"], list(FG2)), statement([FG0, FG1, FG2], ["composite"], list(FG2), base=DAILY, first="daily"))
PO = [
    {"v": frame_list("vol", 10)},
    {
        "position_change": f"vol - {lag('vol')}",
        "position_percentile": rank_share("vol", "v", 10),
        "position_zscore": f"(vol - {roll('avg', 'vol', 10)}) / ({roll('stddev_samp', 'vol', 10)} + {EPS})",
    },
]
add("positioning", lambda s, d: shown(S.positioning(daily_levels(s, d), "vol", 10), list(PO[1])), statement(PO, list(PO[1]), base=DAILY, first="daily"))
MAC = {"vol_yoy": f"(vol / nullif({lag('vol', 14)}, 0) - 1) * 100", "vol_mom": f"(vol / nullif({lag('vol', 7)}, 0) - 1) * 100", "vol_diff": f"vol - {lag('vol')}"}
add("macro_transforms", lambda s, d: shown(S.macro_transforms(daily_levels(s, d), "vol", 14, 7), list(MAC)), statement([MAC], list(MAC), base=DAILY, first="daily"))
add(
    "contrarian_snapshot",
    lambda s, d: shown(
        S.broadcast_snapshot(hour_bars(s, d), error_events(s, d).agg((F.avg("value") / 100).alias("index_now"))).withColumn("contrarian", S.contrarian(F.col("index_now"), 0.4)),
        ["index_now"], ["contrarian"],
    ),
    f"""WITH {BARS}, i AS (SELECT avg(value) / 100 AS x FROM events WHERE event_type = 'error')
    SELECT symbol, ts, round(x + 1.3e-7, 6) AS index_now, CAST(CASE WHEN x > 0.4 THEN -1 WHEN x < -0.4 THEN 1 ELSE 0 END AS INTEGER) AS contrarian FROM bars, i""",
)
