"""Queries over hourly bars: prices, returns and indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bars as B
from tidemark.operators import price as P
from tidemark.operators import technical as T
from tidemark.plans.catalog import add, hour_bars, on_bars, shown
from tidemark.plans.sql import BARS, ema_ctes, flag, lag, over, quantile, roll, running, statement

OHLC = ["open", "high", "low", "close"]
TR = f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')}))"
EPS = "1e-10"


def ret(k: int) -> str:
    return f"close / nullif({lag('close', k)}, 0) - 1"


add("bars_1h", on_bars(lambda b: b, OHLC, ["volume"]), statement([], OHLC, ["volume"]))
add(
    "bars_4h_from_1h",
    on_bars(lambda b: B.resample(b, 240).withColumn("ts", F.col("ts").cast("timestamp_ntz")), OHLC, ["volume"]),
    f"""WITH {BARS} SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2000-01-01') AS ts, round(arg_min(open, bars.ts) + 1.3e-7, 6) AS open,
    round(max(high) + 1.3e-7, 6) AS high, round(min(low) + 1.3e-7, 6) AS low, round(arg_max(close, bars.ts) + 1.3e-7, 6) AS close, CAST(sum(volume) AS INTEGER) AS volume
    FROM bars GROUP BY symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '2000-01-01')""",
)
add(
    "bars_1d_from_1h",
    on_bars(lambda b: B.resample(b, 1440).withColumn("ts", F.col("ts").cast("timestamp_ntz")), OHLC, ["volume"]),
    f"""WITH {BARS}, d AS (SELECT *, date_trunc('day', ts) AS day FROM bars)
    SELECT symbol, day AS ts, round(arg_min(open, ts) + 1.3e-7, 6) AS open, round(max(high) + 1.3e-7, 6) AS high, round(min(low) + 1.3e-7, 6) AS low,
    round(arg_max(close, ts) + 1.3e-7, 6) AS close, CAST(sum(volume) AS INTEGER) AS volume FROM d GROUP BY symbol, day""",
)
MINUTE = "(hour(ts) * 60 + minute(ts))"
add(
    "session_filter",
    on_bars(B.session_filter, OHLC, ["volume"]),
    statement([], OHLC, ["volume"], where=f"{MINUTE} >= 570 AND {MINUTE} < 960 AND isodow(ts) <= 5"),
)
add(
    "resample_statistics",
    lambda s, d: B.resample_statistics(hour_bars(s, d), 60, 390, 210).withColumn("bars_per_day", F.round("bars_per_day", 6)),
    f"""WITH {BARS} SELECT symbol, count(*) AS bars, count(DISTINCT CAST(ts AS DATE)) AS days,
    round(count(*) / count(DISTINCT CAST(ts AS DATE)), 6) AS bars_per_day, CAST(6 AS BIGINT) AS expected_per_day, CAST(210 AS BIGINT) AS embargo_bars
    FROM bars GROUP BY symbol""",
)
LEVELS = {"mid": "(high + low) / 2", "typical": "(high + low + close) / 3", "weighted_close": "(high + low + 2 * close) / 4", "ohlc_avg": "(open + high + low + close) / 4"}
add("price_levels", on_bars(P.price_levels, list(LEVELS)), statement([LEVELS], list(LEVELS)))
RETURNS = {f"return_{k}": ret(k) for k in (1, 2, 3, 5, 10, 20, 60)}
add("returns_multi", on_bars(P.returns, list(RETURNS)), statement([RETURNS], list(RETURNS)))
LOGS = {f"log_return_{k}": f"ln(close / nullif({lag('close', k)}, 0))" for k in (1, 5, 20)}
add("log_returns", on_bars(P.log_returns, list(LOGS)), statement([LOGS], list(LOGS)))
RATIOS = {
    "high_low_ratio": "high / nullif(low, 0)",
    "close_open_ratio": "close / nullif(open, 0)",
    "gap": f"open / nullif({lag('close')}, 0) - 1",
    "close_position": f"(close - low) / (high - low + {EPS})",
    **{f"close_to_sma_{n}": f"close / nullif({roll('avg', 'close', n)}, 0) - 1" for n in (10, 20, 50)},
}
add("price_ratios", on_bars(P.price_ratios, list(RATIOS)), statement([RATIOS], list(RATIOS)))
ATRS = {f"atr_{n}": roll("avg", "true_range", n) for n in (7, 14, 20)}
add("atr_multi", on_bars(P.atr, ["true_range", *ATRS]), statement([{"true_range": TR}, ATRS], ["true_range", *ATRS]))
SHAPE = {
    "range_pct": "(high - low) / nullif(close, 0)",
    "body": "abs(close - open)",
    "upper_shadow": "high - greatest(open, close)",
    "lower_shadow": "least(open, close) - low",
    "body_ratio": f"abs(close - open) / (high - low + {EPS})",
}
FRAME20 = "list(range_pct) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
add(
    "range_shape",
    on_bars(P.range_shape, [*SHAPE, "range_percentile_20"]),
    statement(
        [
            SHAPE,
            {"v": FRAME20},
            {"range_percentile_20": "CASE WHEN len(v) = 20 THEN (len(list_filter(v, lambda x: x < range_pct)) + (len(list_filter(v, lambda x: x = range_pct)) + 1) / 2) / 20.0 END"},
        ],
        [*SHAPE, "range_percentile_20"],
    ),
)
STATS = {
    **{f"return_lag_{k}": lag("return_1", k) for k in (1, 2, 3, 5)},
    "cum_return_20": roll("sum", "return_1", 20),
    "return_vol_20": roll("stddev_samp", "return_1", 20),
    "sharpe_20": f"{roll('avg', 'return_1', 20)} / ({roll('stddev_samp', 'return_1', 20)} + {EPS})",
}
add("return_statistics", on_bars(P.return_statistics, list(STATS)), statement([{"return_1": ret(1)}, STATS], list(STATS)))

PERIODS = (5, 10, 20, 50, 100, 200)
SMA = {f"sma_{n}": roll("avg", "close", n) for n in PERIODS}
SMA2 = {f"sma_{n}_dist": f"close / nullif(sma_{n}, 0) - 1" for n in PERIODS} | {f"sma_{n}_slope": f"sma_{n} / nullif({lag(f'sma_{n}', 5)}, 0) - 1" for n in PERIODS}
add("sma_dist_slope", on_bars(T.moving_averages, [*SMA, *SMA2]), statement([SMA, SMA2], [*SMA, *SMA2]))
CROSS = {
    "golden_cross": flag("f > s AND pf <= ps"),
    "death_cross": flag("f < s AND pf >= ps"),
    "above_fast": flag("close > f"),
    "above_slow": flag("close > s"),
    "fast_above_slow": flag("f > s"),
}
add(
    "ma_cross",
    on_bars(lambda b: T.crosses(b, 10, 30), [], list(CROSS)),
    statement([{"f": roll("avg", "close", 10), "s": roll("avg", "close", 30)}, {"pf": lag("f"), "ps": lag("s")}, CROSS], [], list(CROSS)),
)
EMAS = {f"ema_{n}": ("close", n) for n in (10, 20, 50)}
add(
    "ema_multi",
    on_bars(lambda b: T.ema_columns(b, (10, 20, 50)), list(EMAS)),
    statement([], list(EMAS), base=BARS + ",\n" + ema_ctes(BARS, "bars", EMAS, "em"), first="em"),
)
MACD_BASE = ",\n".join(
    [
        BARS,
        ema_ctes(BARS, "bars", {"ef": ("close", 12), "es": ("close", 26)}, "m1"),
        "m2 AS (SELECT * EXCLUDE (rn), ef - es AS macd FROM m1)",
        ema_ctes(BARS, "m2", {"macd_signal": ("macd", 9)}, "m3"),
    ]
)
MACD = {
    "macd_hist": "macd - macd_signal",
    "macd_norm": "macd / nullif(close, 0)",
    "macd_cross_up": flag(f"macd > macd_signal AND {lag('macd')} <= {lag('macd_signal')}"),
    "macd_cross_down": flag(f"macd < macd_signal AND {lag('macd')} >= {lag('macd_signal')}"),
}
add(
    "macd",
    on_bars(T.macd, ["macd", "macd_signal", "macd_hist", "macd_norm"], ["macd_cross_up", "macd_cross_down"]),
    statement([MACD], ["macd", "macd_signal", "macd_hist", "macd_norm"], ["macd_cross_up", "macd_cross_down"], base=MACD_BASE, first="m3"),
)
ADX = [
    {"up": f"high - {lag('high')}", "down": f"{lag('low')} - low", "tr": TR},
    {"pdm": "CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END", "mdm": "CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END"},
    {
        "plus_di_14": f"100 * {roll('avg', 'pdm', 14)} / ({roll('avg', 'tr', 14)} + {EPS})",
        "minus_di_14": f"100 * {roll('avg', 'mdm', 14)} / ({roll('avg', 'tr', 14)} + {EPS})",
    },
    {"dx": f"100 * abs(plus_di_14 - minus_di_14) / (plus_di_14 + minus_di_14 + {EPS})"},
    {"adx_14": roll("avg", "dx", 14)},
]
add("adx_14", on_bars(lambda b: T.adx(b, (14,)), ["plus_di_14", "minus_di_14", "adx_14"]), statement(ADX, ["plus_di_14", "minus_di_14", "adx_14"]))


def frame_list(x: str, n: int) -> str:
    return f"list({x}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


AROON = [
    {"hs": frame_list("high", 25), "ls": frame_list("low", 25)},
    {
        "aroon_up": "CASE WHEN len(hs) = 25 THEN list_position(hs, list_max(hs)) / 25.0 * 100 END",
        "aroon_down": "CASE WHEN len(ls) = 25 THEN list_position(ls, list_min(ls)) / 25.0 * 100 END",
    },
    {"aroon_osc": "aroon_up - aroon_down"},
]
add("aroon_25", on_bars(T.aroon, ["aroon_up", "aroon_down", "aroon_osc"]), statement(AROON, ["aroon_up", "aroon_down", "aroon_osc"]))
RSI = [
    {"d": f"close - {lag('close')}"},
    {"g": "CASE WHEN d > 0 THEN d ELSE 0.0 END", "l": "CASE WHEN d < 0 THEN -d ELSE 0.0 END"},
    {f"rsi_{n}": f"100 - 100 / (1 + {roll('avg', 'g', n)} / ({roll('avg', 'l', n)} + {EPS}))" for n in (7, 14, 21)},
    {f"rsi_{n}_high": flag(f"rsi_{n} > 70") for n in (7, 14, 21)} | {f"rsi_{n}_low": flag(f"rsi_{n} < 30") for n in (7, 14, 21)},
]
add("rsi_multi", on_bars(T.rsi, list(RSI[2]), list(RSI[3])), statement(RSI, list(RSI[2]), list(RSI[3])))
STOCH = [
    {"lo": roll("min", "low", 14), "hi": roll("max", "high", 14)},
    {"stoch_k": f"100 * (close - lo) / (hi - lo + {EPS})"},
    {"stoch_d": roll("avg", "stoch_k", 3), "stoch_high": flag("stoch_k > 80"), "stoch_low": flag("stoch_k < 20")},
]
add("stochastic", on_bars(T.stochastic, ["stoch_k", "stoch_d"], ["stoch_high", "stoch_low"]), statement(STOCH, ["stoch_k", "stoch_d"], ["stoch_high", "stoch_low"]))
CCI = [
    {"t": "(high + low + close) / 3"},
    {"m": roll("avg", "t", 20), "v": frame_list("t", 20)},
    {"dev": "list_sum(list_transform(v, lambda x: abs(x - m))) / 20.0"},
    {"cci_20": f"(t - m) / (0.015 * dev + {EPS})"},
]
add("cci_20", on_bars(T.cci, ["cci_20"]), statement(CCI, ["cci_20"]))
ROC = {f"roc_{k}": f"100 * ({ret(k)})" for k in (5, 10, 20)} | {
    "williams_r_14": f"-100 * ({roll('max', 'high', 14)} - close) / ({roll('max', 'high', 14)} - {roll('min', 'low', 14)} + {EPS})"
}
add("roc_williams", on_bars(T.momentum, list(ROC)), statement([ROC], list(ROC)))
BOLL = [
    {"bb_mid": roll("avg", "close", 20), "sd": roll("stddev_samp", "close", 20)},
    {"bb_upper": "bb_mid + 2 * sd", "bb_lower": "bb_mid - 2 * sd"},
    {"bb_pct": f"(close - bb_lower) / (bb_upper - bb_lower + {EPS})", "bb_width": "(bb_upper - bb_lower) / nullif(bb_mid, 0)"},
    {"bb_squeeze": flag(f"bb_width < {roll('avg', 'bb_width', 50)}")},
]
BB = ["bb_mid", "bb_upper", "bb_lower", "bb_pct", "bb_width"]
add("bollinger", on_bars(T.bollinger, BB, ["bb_squeeze"]), statement(BOLL, BB, ["bb_squeeze"]))
KELT = [
    {"tr": TR},
    {"a": roll("avg", "tr", 20)},
    {"kc_upper": "kc_mid + 2 * a", "kc_lower": "kc_mid - 2 * a"},
    {"kc_position": f"(close - kc_lower) / (kc_upper - kc_lower + {EPS})"},
]
KC = ["kc_mid", "kc_upper", "kc_lower", "kc_position"]
add(
    "keltner",
    on_bars(T.channels, KC),
    statement(KELT, KC, base=BARS + ",\n" + ema_ctes(BARS, "bars", {"kc_mid": ("close", 20)}, "kb"), first="kb"),
)
DON = [{"dc_upper": roll("max", "high", 20), "dc_lower": roll("min", "low", 20)}, {"dc_position": f"(close - dc_lower) / (dc_upper - dc_lower + {EPS})"}]
DC = ["dc_upper", "dc_lower", "dc_position"]
add("donchian", on_bars(T.donchian, DC), statement(DON, DC))
OBV = [
    {"d": f"coalesce(sign(close - {lag('close')}) * volume, 0.0)"},
    {"obv": running("sum", "d")},
    {"obv_sma": roll("avg", "obv", 20)},
    {"obv_above": flag("obv > obv_sma")},
]
add("obv", on_bars(T.obv, ["obv", "obv_sma"], ["obv_above"]), statement(OBV, ["obv", "obv_sma"], ["obv_above"]))
VWAP = [
    {"tv": "(high + low + close) / 3 * volume"},
    {f"vwap_{n}": f"{roll('sum', 'tv', n)} / ({roll('sum', 'volume', n)} + {EPS})" for n in (20, 50)}
    | {"vwap_cum": f"{running('sum', 'tv')} / ({running('sum', 'volume')} + {EPS})"},
    {f"vwap_{n}_dist": f"close / nullif(vwap_{n}, 0) - 1" for n in (20, 50)},
]
VW = ["vwap_20", "vwap_50", "vwap_cum", "vwap_20_dist", "vwap_50_dist"]
add("vwap_roll", on_bars(T.vwap, VW), statement(VWAP, VW))
FLOW = [
    {"f": f"((close - low) - (high - close)) / (high - low + {EPS}) * volume", "t": "(high + low + close) / 3"},
    {"up": f"t - {lag('t')}"},
    {"p": "CASE WHEN up > 0 THEN t * volume ELSE 0.0 END", "n": "CASE WHEN up < 0 THEN t * volume ELSE 0.0 END"},
    {
        "cmf_21": f"{roll('sum', 'f', 21)} / ({roll('sum', 'volume', 21)} + {EPS})",
        "mfi_14": f"100 - 100 / (1 + {roll('sum', 'p', 14)} / ({roll('sum', 'n', 14)} + {EPS}))",
    },
    {"mfi_high": flag("mfi_14 > 80"), "mfi_low": flag("mfi_14 < 20")},
]
add("cmf_mfi", on_bars(T.money_flow, ["cmf_21", "mfi_14"], ["mfi_high", "mfi_low"]), statement(FLOW, ["cmf_21", "mfi_14"], ["mfi_high", "mfi_low"]))
VOLUME = [
    {
        "rel_volume_20": f"volume / ({roll('avg', 'volume', 20)} + {EPS})",
        "volume_roc_5": f"volume / nullif({lag('volume', 5)}, 0) - 1",
        "volume_trend": f"{roll('avg', 'volume', 5)} / ({roll('avg', 'volume', 20)} + {EPS})",
        "pv": f"({ret(1)}) * volume",
    },
    {"pvt": f"round({running('sum', 'pv')}, 3)"},
]
VP = ["rel_volume_20", "volume_roc_5", "volume_trend", "pvt"]
add("volume_profile", on_bars(lambda b: T.volume_profile(b).withColumn("pvt", F.round("pvt", 3)), VP), statement(VOLUME, VP))
RV = [
    {"r": f"ln(close / nullif({lag('close')}, 0))", "hl": "pow(ln(high / nullif(low, 0)), 2)"},
    {f"rv_{n}": f"{roll('stddev_samp', 'r', n)} * sqrt(252.0)" for n in (5, 10, 21, 63)}
    | {f"parkinson_{n}": f"sqrt({roll('avg', 'hl', n)} / (4 * ln(2.0)))" for n in (5, 10, 21, 63)},
]
add("rv_parkinson", on_bars(lambda b: T.realised_volatility(b, (5, 10, 21, 63)), list(RV[1])), statement(RV, list(RV[1])))
QUANT = {"q25": quantile("close", 20, 0.25), "q50": quantile("close", 20, 0.5), "q90": quantile("close", 20, 0.9)}
add(
    "rolling_percentile",
    on_bars(lambda b: b.withColumns({n: T.FRAMES.quantile("close", 20, p) for n, p in (("q25", 0.25), ("q50", 0.5), ("q90", 0.9))}), list(QUANT)),
    statement([QUANT], list(QUANT)),
)
HURST = (20, 50, 100)


def hurst_sql() -> str:
    """Rescaled ranges of the prefixes of each window, and the slope of their logarithms."""
    steps = [f"v{n} AS (SELECT symbol, ts, CASE WHEN count(r) {over(n)} = {n} THEN list(r) {over(n)} END AS v FROM r)" for n in HURST]
    for n in HURST:
        steps += [
            f"p{n} AS (SELECT symbol, ts, k, v[1:k] AS part FROM (SELECT *, unnest(range(8, {n + 1}, 4)) AS k FROM v{n} WHERE v IS NOT NULL))",
            f"w{n} AS (SELECT *, list_transform(range(1, k + 1), lambda i: list_sum(part[1:i]) - i * list_avg(part)) AS walk FROM p{n})",
            f"s{n} AS (SELECT symbol, ts, ln(k) AS a, ln((list_max(walk) - list_min(walk)) / list_stddev_pop(part)) AS b FROM w{n} WHERE list_stddev_pop(part) > 0 AND list_max(walk) > list_min(walk))",
            f"h{n} AS (SELECT symbol, ts, CASE WHEN count(*) >= 3 THEN least(greatest(regr_slope(b, a), 0.0), 1.0) END AS hurst_{n} FROM s{n} GROUP BY symbol, ts)",
        ]
    joins = " ".join(f"LEFT JOIN h{n} USING (symbol, ts)" for n in HURST)
    return f"WITH {BARS}, r AS (SELECT *, {ret(1)} AS r FROM bars), " + ", ".join(steps) + f" SELECT symbol, ts, {', '.join(f'round(hurst_{n} + 1.3e-7, 6) AS hurst_{n}' for n in HURST)} FROM bars {joins}"


add("hurst", on_bars(T.hurst, [f"hurst_{n}" for n in HURST]), hurst_sql())


def flagship(spark, sf_dir):
    """Hourly bars with true range, ATR, RSI and returns in one pass."""
    df = P.returns(P.atr(T.rsi(hour_bars(spark, sf_dir), (14,)), (14,)), (1,))
    return shown(df, ["close", "true_range", "atr_14", "rsi_14", "return_1"])


add(
    "bars_atr_rsi",
    flagship,
    statement(
        [{"true_range": TR, "d": f"close - {lag('close')}", "return_1": ret(1)}, *[RSI[1]], {"atr_14": roll("avg", "true_range", 14), "rsi_14": RSI[2]["rsi_14"]}],
        ["close", "true_range", "atr_14", "rsi_14", "return_1"],
    ),
)
