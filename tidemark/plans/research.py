"""Queries for labels, splits, signals, simulated trades and metrics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from tidemark.operators import labels as L
from tidemark.operators import metrics as G
from tidemark.operators import price as P
from tidemark.operators import quality as Q
from tidemark.operators import signals as X
from tidemark.operators import simulations as M
from tidemark.operators import splits as V
from tidemark.operators import technical as T
from tidemark.plans.catalog import TIE_SHIFT, add, hour_bars, on_bars, shown, table
from tidemark.plans.indicators import EPS, TR, ret
from tidemark.plans.sql import BARS, ahead, flag, lag, over, quantile, resample, roll, statement, uniform

LEADC = lambda k: f"lead(close, {k}) OVER (PARTITION BY symbol ORDER BY ts)"

# ---- labels
VT0 = {"r": ret(1), "tr": TR, "hl": "pow(ln(high / nullif(low, 0)), 2)"}
VT1, VT2 = {}, {}
for h in (5, 10, 20):
    VT1 |= {f"now_{h}": f"{roll('stddev_samp', 'r', h)} * sqrt(19656.0)", f"future_rv_{h}": f"{ahead('stddev_samp', 'r', h)} * sqrt(19656.0)", f"future_atr_{h}": ahead("avg", "tr", h)}
    VT1 |= {f"future_parkinson_{h}": f"sqrt({ahead('avg', 'hl', h)} / (4 * ln(2.0)))"}
    VT2 |= {f"vol_expansion_{h}": flag(f"future_rv_{h} > now_{h} * 1.2"), f"vol_contraction_{h}": flag(f"future_rv_{h} < now_{h} / 1.2")}
VT1 |= {"rv": roll("stddev_samp", "r", 20), "frv": ahead("stddev_samp", "r", 20)}
VT2 |= {"q1": quantile("rv", 19656, 0.33), "q2": quantile("rv", 19656, 0.67)}
VT3 = {"future_regime": "CASE WHEN frv <= q1 THEN 0 WHEN frv <= q2 THEN 1 ELSE 2 END"}
VTF = [c for c in VT1 if c.startswith("future")]
VTI = [c for c in VT2 if c.startswith("vol_")] + ["future_regime"]
add("targets_vol", on_bars(L.volatility_targets, VTF, VTI), statement([VT0, VT1, VT2, VT3], VTF, VTI))
#: The same over a frame that the hourly series here fill.
VT2S = VT2 | {"q1": quantile("rv", 100, 0.33), "q2": quantile("rv", 100, 0.67)}
add("targets_vol_100", on_bars(lambda b: L.volatility_targets(b, regime_rows=100), VTF, VTI), statement([VT0, VT1, VT2S, VT3], VTF, VTI))
TT = {}
for h in (10, 20, 30):
    r = f"(({LEADC(h)} - close) / nullif(close, 0))"
    TT |= {
        f"future_return_{h}": r,
        f"trend_dir_{h}": f"CASE WHEN {r} > 0.001 THEN 1 WHEN {r} < -0.001 THEN 0 END",
        f"trend_strength_{h}": f"abs({r})",
        f"trend_persist_{h}": flag(f"coalesce(close - {lag('close', h)} > 0, false) = coalesce({r} > 0, false)"),
        f"mfe_up_{h}": f"({ahead('max', 'high', h)} - close) / nullif(close, 0)",
        f"mfe_down_{h}": f"(close - {ahead('min', 'low', h)}) / nullif(close, 0)",
    }
TTI = [c for c in TT if "dir" in c or "persist" in c]
TTF = [c for c in TT if c not in TTI]
add("targets_trend", on_bars(L.trend_targets, TTF, TTI), statement([TT], TTF, TTI))
PT0, PT1, PT2 = {"tr": TR}, {"a": roll("avg", "tr", 14)}, {}
for h in (5, 10, 20):
    PT1 |= {f"top{h}": ahead("max", "high", h), f"bot{h}": ahead("min", "low", h), f"ph{h}": roll("max", "high", h), f"pl{h}": roll("min", "low", h)}
    PT2 |= {f"new_high_{h}": flag(f"top{h} > ph{h}"), f"new_low_{h}": flag(f"bot{h} < pl{h}"), f"upside_{h}": f"(top{h} - close) / nullif(close, 0)", f"downside_{h}": f"(close - bot{h}) / nullif(close, 0)"}
    for m in (1, 2):
        PT2 |= {f"reach_up_{m}_{h}": flag(f"top{h} >= close + {m} * a"), f"reach_down_{m}_{h}": flag(f"bot{h} <= close - {m} * a")}
PT3 = {f"rr_ratio_{h}": f"upside_{h} / (downside_{h} + 0.0001)" for h in (5, 10, 20)}
PTF = [c for c in PT2 if "side" in c] + list(PT3)
PTI = [c for c in PT2 if "side" not in c]
add("targets_price", on_bars(lambda b: L.price_targets(b, (1.0, 2.0), (5, 10, 20)), PTF, PTI), statement([PT0, PT1, PT2, PT3], PTF, PTI))
R5 = f"({LEADC(5)} / nullif(close, 0) - 1)"
PP = {f"target_direction_{h}": flag(f"{LEADC(h)} > close") for h in (1, 5)}
PP |= {"target_class_3": f"CASE WHEN {R5} <= -0.005 THEN 0 WHEN {R5} <= 0.005 THEN 1 WHEN {R5} > 0.005 THEN 2 END"}
PP |= {f"target_return_{h}": f"{LEADC(h)} / nullif(close, 0) - 1" for h in (1, 5, 10, 20)}
for h in (5, 10):
    PP |= {f"target_mfe_{h}": f"({ahead('max', 'high', h)} - close) / nullif(close, 0)", f"target_mae_{h}": f"({ahead('min', 'low', h)} - close) / nullif(close, 0)"}
PPI = ["target_direction_1", "target_direction_5", "target_class_3"]
PPF = [c for c in PP if c not in PPI]
add("targets_pipeline", on_bars(L.pipeline_targets, PPF, PPI), statement([PP], PPF, PPI))
add(
    "targets_complete",
    on_bars(lambda b: L.complete(L.trend_targets(b), TTF + TTI), TTF, TTI),
    "SELECT * FROM (" + statement([TT], TTF, TTI) + ") WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in TTF + TTI),
)
BAL = ["target_direction_1", "target_class_3", "target_return_5"]
add(
    "label_balance",
    lambda s, d: L.target_summary(L.pipeline_targets(hour_bars(s, d)), BAL).select("target", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "distinct"),
    "WITH t AS (" + statement([PP], [], []).replace("SELECT symbol, ts FROM", "SELECT * FROM") + ") "
    + " UNION ALL ".join(f"SELECT '{c}' AS target, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, count(DISTINCT {c}) AS \"distinct\" FROM t" for c in BAL),
)


def barrier_sql(b: L.Barriers, side: str = "1", event: str = "true") -> str:
    """First touches by a join of each bar with the bars ahead of it."""
    width = "a" if b.in_atr else "close"
    return f"""WITH {BARS}, b0 AS (SELECT *, {TR} AS tr, row_number() {over()} AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars),
b1 AS (SELECT *, {roll("avg", "tr", b.atr_rows)} AS a FROM b0),
b2 AS (SELECT *, {side} AS side, {event} AS event FROM b1),
b3 AS (SELECT *, CASE WHEN side >= 0 THEN close + {b.upper} * {width} ELSE close - {b.upper} * {width} END AS up,
  CASE WHEN side >= 0 THEN close - {b.lower} * {width} ELSE close + {b.lower} * {width} END AS down FROM b2),
hits AS (SELECT e.symbol, e.rn, min(CASE WHEN (e.side >= 0 AND f.high >= e.up) OR (e.side < 0 AND f.low <= e.up) THEN f.rn END) AS p,
  min(CASE WHEN (e.side >= 0 AND f.low <= e.down) OR (e.side < 0 AND f.high >= e.down) THEN f.rn END) AS q, arg_max(f.close, f.rn) AS last_close
  FROM b3 e JOIN b3 f ON f.symbol = e.symbol AND f.rn > e.rn AND f.rn <= e.rn + {b.holding} GROUP BY e.symbol, e.rn),
b4 AS (SELECT b3.*, p, q, last_close, least(coalesce(p, 1000000000), coalesce(q, 1000000000)) AS t, coalesce(rn + {b.holding} <= n AND a IS NOT NULL AND event, false) AS known FROM b3 LEFT JOIN hits USING (symbol, rn)),
b5 AS (SELECT *, ((CASE WHEN t = 1000000000 THEN last_close WHEN p = t THEN up ELSE down END) - close) / nullif(close, 0) * (CASE WHEN side >= 0 THEN 1 ELSE -1 END) AS g FROM b4)
SELECT symbol, ts, CAST(CASE WHEN NOT known THEN 0 WHEN t < 1000000000 THEN CASE WHEN p = t THEN 1 ELSE -1 END WHEN abs(g) < {b.flat} THEN 0 WHEN g > 0 THEN 1 ELSE -1 END AS INTEGER) AS tb_label,
  CAST(CASE WHEN NOT known OR t = 1000000000 THEN 0 WHEN p = t THEN 1 ELSE -1 END AS INTEGER) AS tb_barrier,
  CAST(CASE WHEN NOT known THEN 0 WHEN t < 1000000000 THEN t - rn ELSE {b.holding} END AS INTEGER) AS tb_holding,
  round(CASE WHEN known THEN g ELSE 0.0 END + 1.3e-7, 6) AS tb_return, round(CASE WHEN known THEN up ELSE 0.0 END + 1.3e-7, 6) AS tb_upper, round(CASE WHEN known THEN down ELSE 0.0 END + 1.3e-7, 6) AS tb_lower FROM b5"""


TBF, TBI = ["tb_return", "tb_upper", "tb_lower"], ["tb_label", "tb_barrier", "tb_holding"]
for name, preset in L.PRESETS.items():
    add(f"triple_barrier_{name}", on_bars(lambda b, p=preset: L.triple_barrier(b, p), TBF, TBI), barrier_sql(preset))
SIDED = L.Barriers(0.5, 0.25, 12, in_atr=False)
add(
    "triple_barrier_sided",
    on_bars(lambda b: L.triple_barrier(b.withColumns({"s": F.when(F.col("close") > F.col("open"), -1).otherwise(1), "e": F.col("volume") % 2 == 0}), SIDED, "s", "e"), TBF, TBI),
    barrier_sql(SIDED, "CASE WHEN close > open THEN -1 ELSE 1 END", "volume % 2 = 0"),
)
add(
    "meta_labels",
    on_bars(lambda b: L.meta_labels(L.triple_barrier(b).withColumn("pred", F.when(F.col("close") > F.col("open"), 1).otherwise(-1)), "pred"), [], ["tb_label", "meta_label"]),
    f"""WITH q AS ({barrier_sql(L.PRESETS["standard"])}), b AS (WITH {BARS} SELECT * FROM bars)
    SELECT q.symbol, q.ts, tb_label, CAST((tb_label = 1 AND close > open) OR (tb_label = -1 AND close <= open) AS INTEGER) AS meta_label FROM q JOIN b USING (symbol, ts)""",
)
SIZES = [("size_linear", "linear"), ("size_kelly", "kelly"), ("size_sqrt", "sqrt")]
add(
    "meta_sizing",
    on_bars(lambda b: b.withColumn("p", (F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + 1e-10)).withColumns({n: X.meta_size("p", m) for n, m in SIZES}), ["p", *[n for n, _ in SIZES]]),
    statement(
        [
            {"p": f"(close - low) / (high - low + {EPS})"},
            {n: f"CASE WHEN p >= 0.55 THEN least(greatest({e}, 0.0), 1.0) ELSE 0.0 END" for n, e in (("size_linear", "(p - 0.5) * 2"), ("size_kelly", "2 * p - 1"), ("size_sqrt", "sqrt(greatest((p - 0.5) * 2, 0.0))"))},
        ],
        ["p", *[n for n, _ in SIZES]],
    ),
)

# ---- splits
NUM = f"{BARS}, n AS (SELECT symbol, ts, row_number() {over()} - 1 AS row_no, count(*) OVER (PARTITION BY symbol) AS n FROM bars)"


def numbered(spark, sf_dir):
    return V.numbered(hour_bars(spark, sf_dir).select("symbol", "ts"))


def members(df):
    return df.select("symbol", "ts", F.col("fold").cast("int"), "role")


def fold_sql(folds: str, first: str, train: str, test: str) -> str:
    """Rows against a list of folds ``f`` and the bounds that follow from its number."""
    return f"""WITH {NUM}, k AS (SELECT n.*, f.fold, {first} AS size FROM n, ({folds}) f(fold))
    SELECT symbol, ts, CAST(fold AS INTEGER) AS fold, CASE WHEN {train} THEN 'train' ELSE 'test' END AS role FROM k WHERE ({train}) OR ({test})"""


RANGE = lambda k: f"SELECT unnest(range({k}))"
add("walk_forward_rolling", lambda s, d: members(V.rolling(numbered(s, d), 200, 50, 20)),
    fold_sql(RANGE(40), "50", "fold * 50 + 270 <= n AND row_no >= fold * 50 AND row_no < fold * 50 + 200", "fold * 50 + 270 <= n AND row_no >= fold * 50 + 220 AND row_no < fold * 50 + 270"))
WF = "size * (2 + fold) + 10"
add("walk_forward_folds", lambda s, d: members(V.walk_forward(numbered(s, d), 5, 10)),
    fold_sql(RANGE(5), "n // 6", f"{WF} + size <= n AND row_no < {WF} - 10", f"{WF} + size <= n AND row_no >= {WF} AND row_no < {WF} + size"))
add("walk_forward_sliding", lambda s, d: members(V.walk_forward(numbered(s, d), 5, 10, expanding=False)),
    fold_sql(RANGE(5), "n // 6", f"{WF} + size <= n AND row_no < {WF} - 10 AND row_no >= greatest(0, {WF} - 10 - 2 * size)", f"{WF} + size <= n AND row_no >= {WF} AND row_no < {WF} + size"))
add("purged_kfold", lambda s, d: members(V.purged(numbered(s, d), 5, 10, 20)),
    fold_sql(RANGE(5), "n // 5", "row_no < size * fold - 10 OR row_no >= size * (fold + 1) + 20", "row_no >= size * fold AND row_no < size * (fold + 1)"))
PICKS = list(combinations(range(6), 2))
CP = f"""WITH {NUM}, c(fold, a, b) AS (VALUES {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(PICKS))}),
k AS (SELECT n.*, c.*, n // 6 AS size, least(row_no // (n // 6), 5) AS g, least(row_no + 12, n - 1) AS t1, CAST(floor(n * 0.01) AS BIGINT) AS emb FROM n, c),
m AS (SELECT *, g = a OR g = b AS test, NOT (g = a OR g = b) AND t1 <= size * a AS kept FROM k),
s AS (SELECT symbol, fold, min(row_no) AS lo, max(row_no) AS hi FROM m WHERE kept GROUP BY symbol, fold),
j AS (SELECT m.*, lo, hi, (CASE WHEN b < 5 THEN size * (b + 1) ELSE n END) - 1 AS last FROM m LEFT JOIN s USING (symbol, fold))"""
add(
    "cpcv_membership",
    lambda s, d: members(V.combinatorial(numbered(s, d).withColumn("t1", F.least(F.col("row_no") + 12, F.col("rows") - 1)), 6, 2, "t1", 0.01)),
    CP + " SELECT symbol, ts, CAST(fold AS INTEGER) AS fold, CASE WHEN test THEN 'test' ELSE 'train' END AS role FROM j "
    "WHERE (test AND NOT coalesce(row_no < hi AND t1 > lo, false)) OR (kept AND NOT (row_no > last AND row_no <= last + emb))",
)
add(
    "cpcv_exact_purge",
    lambda s, d: members(V.exact_backward_purge(V.combinatorial(numbered(s, d), 6, 2, None, 0.01, 0.01).withColumn("t1", F.least(F.col("row_no") + 12, F.col("rows") - 1)), "t1")),
    CP.replace("NOT (g = a OR g = b) AND t1 <= size * a AS kept", "NOT (g = a OR g = b) AND NOT (row_no >= size * a - emb AND row_no < size * a) AS kept")
    + """, tr AS (SELECT symbol, fold, row_no FROM j WHERE kept AND NOT (row_no > last AND row_no <= last + emb))
    SELECT symbol, ts, CAST(fold AS INTEGER) AS fold, 'train' AS role FROM j WHERE kept AND NOT (row_no > last AND row_no <= last + emb)
    UNION ALL SELECT symbol, ts, CAST(fold AS INTEGER) AS fold, 'test' AS role FROM j WHERE test AND NOT EXISTS
      (SELECT 1 FROM tr WHERE tr.symbol = j.symbol AND tr.fold = j.fold AND tr.row_no >= j.row_no AND tr.row_no <= j.t1)""",
)
add(
    "cpcv_weights",
    lambda s, d: V.appearance_weights(V.purged(numbered(s, d), 5, 10, 20)).select("symbol", "ts", F.col("fold").cast("int"), F.round("weight", 6).alias("weight")),
    f"""WITH m AS ({fold_sql(RANGE(5), "n // 5", "row_no < size * fold - 10 OR row_no >= size * (fold + 1) + 20", "false")}),
    a AS (SELECT *, count(*) OVER (PARTITION BY symbol, ts) AS c FROM m), b AS (SELECT *, max(c) OVER (PARTITION BY symbol) * 1.0 / c AS w FROM a)
    SELECT symbol, ts, fold, round(w / sum(w) OVER (PARTITION BY symbol, fold) * count(*) OVER (PARTITION BY symbol, fold), 6) AS weight FROM b""",
)
add(
    "calendar_folds",
    lambda s, d: members(V.day_folds(hour_bars(s, d), 10, 5)),
    f"""WITH {NUM}, q AS (SELECT *, date_diff('day', min(CAST(ts AS DATE)) OVER (PARTITION BY symbol), CAST(ts AS DATE)) AS d,
      date_diff('day', min(CAST(ts AS DATE)) OVER (PARTITION BY symbol), max(CAST(ts AS DATE)) OVER (PARTITION BY symbol)) + 1 AS dn FROM n),
    k AS (SELECT q.*, f.fold FROM q, ({RANGE(10)}) f(fold))
    SELECT symbol, ts, CAST(fold AS INTEGER) AS fold, CASE WHEN d < fold * 5 + 10 THEN 'train' ELSE 'test' END AS role FROM k WHERE fold * 5 + 15 <= dn AND d >= fold * 5 AND d < fold * 5 + 15""",
)
add(
    "temporal_holdout",
    lambda s, d: V.holdout(numbered(s, d), 0.2).select("symbol", "ts", "role"),
    f"WITH {NUM} SELECT symbol, ts, CASE WHEN row_no < floor(n * (1 - 0.2::DOUBLE)) THEN 'train' ELSE 'test' END AS role FROM n",
)
add(
    "sequence_windows",
    lambda s, d: V.sequences(hour_bars(s, d), ["close", "volume"], 10).select("symbol", "ts", F.size("sequence").alias("steps"), F.round(F.aggregate("sequence", F.lit(0.0), lambda a, x: a + x[0] * x[1]), 4).alias("checksum")),
    f"""WITH {BARS}, q AS (SELECT symbol, ts, count(*) {over(10)} AS steps, sum(close * volume) {over(10)} AS c FROM bars)
    SELECT symbol, ts, CAST(steps AS INTEGER) AS steps, round(c, 4) AS checksum FROM q WHERE steps = 10""",
)

STRATEGY = [
    {"r": ret(1)},
    {
        "strategy_vol_expansion": flag(f"{ahead('stddev_samp', 'r', 10)} > {roll('stddev_samp', 'r', 10)} * 1.2"),
        "strategy_direction": flag(f"{LEADC(10)} > close"),
        "strategy_breakout_up": flag(f"{ahead('max', 'high', 10)} > {roll('max', 'high', 20)}"),
        "strategy_breakout_down": flag(f"{ahead('min', 'low', 10)} < {roll('min', 'low', 20)}"),
    },
]
add("targets_strategy", on_bars(L.strategy_targets, [], list(STRATEGY[1])), statement(STRATEGY, [], list(STRATEGY[1])))
add(
    "column_pick",
    lambda s, d: shown(Q.pick(L.strategy_targets(T.moving_averages(hour_bars(s, d), (5, 20))), ["close"], ("strategy_",), 20).select("symbol", "ts", "close", "sma_20", *STRATEGY[1]), ["close", "sma_20"], list(STRATEGY[1])),
    statement([{"sma_20": roll("avg", "close", 20)}, *STRATEGY], ["close", "sma_20"], list(STRATEGY[1])),
)
add(
    "label_ends",
    lambda s, d: L.label_ends(numbered(s, d), ["vol_expansion_5", "new_high_10", "new_low_10"]).select("symbol", "ts", F.col("t1").cast("int").alias("t1")),
    f"WITH {BARS} SELECT symbol, ts, CAST(least(row_number() {over()} - 1 + 10, count(*) OVER (PARTITION BY symbol) - 1) AS INTEGER) AS t1 FROM bars",
)
add(
    "cpcv_by_bars",
    lambda s, d: members(V.combinatorial(numbered(s, d), 6, 2, None, 0.01, 0.01)),
    CP.replace("NOT (g = a OR g = b) AND t1 <= size * a AS kept", "NOT (g = a OR g = b) AND NOT (row_no >= size * a - emb AND row_no < size * a) AS kept")
    + " SELECT symbol, ts, CAST(fold AS INTEGER) AS fold, CASE WHEN test THEN 'test' ELSE 'train' END AS role FROM j WHERE test OR (kept AND NOT (row_no > last AND row_no <= last + emb))",
)

# ---- signals and trades
RULES = X.Rules(min_vol=0.40, min_breakout=0.45, tp_atr=2.5, sl_atr=1.25, base_contracts=2, max_contracts=5)  # the served model's


def scored(spark, sf_dir):
    """Bars with stand-in probabilities from their own shapes."""
    b = P.atr(T.rsi(hour_bars(spark, sf_dir), (14,)), (14, 7))
    return b.withColumns(
        {
            "vol_p": (F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + 1e-10),
            "sent_p": F.col("rsi_14") / 100,
            "up_p": (100 - F.col("rsi_14")) / 100,
            "down_p": F.col("rsi_14") / 100,
        }
    )


SCORED = [
    {"tr": TR, "d": f"close - {lag('close')}"},
    {"g": "CASE WHEN d > 0 THEN d ELSE 0.0 END", "l": "CASE WHEN d < 0 THEN -d ELSE 0.0 END", "atr_14": roll("avg", "tr", 14), "atr_7": roll("avg", "tr", 7)},
    {"rsi_14": f"100 - 100 / (1 + {roll('avg', 'g', 14)} / ({roll('avg', 'l', 14)} + {EPS}))"},
    {"vol_p": f"(close - low) / (high - low + {EPS})", "sent_p": "rsi_14 / 100", "up_p": "(100 - rsi_14) / 100", "down_p": "rsi_14 / 100"},
]


def signals(spark, sf_dir, method="weighted"):
    return X.resolve_signals(scored(spark, sf_dir), RULES, "vol_p", "up_p", "down_p", "atr_7", "atr_14", "sent_p", method)


def signal_layers(method: str) -> list[dict[str, str]]:
    gates = {
        "agreement": ("vol_p >= 0.40 AND sent_p >= 0.55", "CASE WHEN vol_p IS NULL OR sent_p IS NULL THEN coalesce(vol_p, sent_p) ELSE least(vol_p, sent_p) END"),
        "weighted": ("0.6::DOUBLE * vol_p + 0.4::DOUBLE * sent_p >= 0.40", "0.6::DOUBLE * vol_p + 0.4::DOUBLE * sent_p"),
        "either": ("vol_p >= 0.40 OR sent_p >= 0.55", "CASE WHEN vol_p IS NULL OR sent_p IS NULL THEN coalesce(vol_p, sent_p) ELSE greatest(vol_p, sent_p) END"),
    }
    gate, mixed = gates[method]
    return [
        *SCORED,
        {"combined_vol": mixed, "direction": f"CASE WHEN ({gate}) AND up_p >= 0.45 AND (down_p < 0.45 OR up_p > down_p) THEN 1 WHEN ({gate}) AND down_p >= 0.45 THEN -1 ELSE 0 END"},
        {
            "breakout_prob": "CASE direction WHEN 1 THEN up_p WHEN -1 THEN down_p END",
            "contracts": f"CASE WHEN direction <> 0 THEN CAST(least(greatest(floor(2 * least(greatest(atr_7 / (atr_14 + {EPS}), 0.5), 2.0)), 1), 5) AS INTEGER) ELSE 0 END",
            "tp_offset": "CASE WHEN direction <> 0 THEN 2.5 * atr_14 * direction END",
            "sl_offset": "CASE WHEN direction <> 0 THEN -1.25 * atr_14 * direction END",
        },
    ]


SGF, SGI = ["combined_vol", "breakout_prob", "tp_offset", "sl_offset"], ["direction", "contracts"]
for method in ("agreement", "weighted", "either"):
    add(f"signal_resolve_{method}", lambda s, d, m=method: shown(signals(s, d, m), SGF, SGI), statement(signal_layers(method), SGF, SGI))
SIMULATED = (
    statement(signal_layers("weighted"), [], [])
    .replace("SELECT symbol, ts FROM l5", f"""SELECT 1), s AS (SELECT *, row_number() {over()} AS rn, close + tp_offset AS tp, close + sl_offset AS sl FROM l5),
hits AS (SELECT e.symbol, e.rn, max(f.rn) AS last, arg_max(f.close, f.rn) AS last_close,
  min(CASE WHEN (e.direction = 1 AND f.high >= e.tp) OR (e.direction = -1 AND f.low <= e.tp) THEN f.rn END) AS p,
  min(CASE WHEN (e.direction = 1 AND f.low <= e.sl) OR (e.direction = -1 AND f.high >= e.sl) THEN f.rn END) AS q
  FROM s e JOIN s f ON f.symbol = e.symbol AND f.rn > e.rn AND f.rn <= e.rn + 20 WHERE e.direction <> 0 GROUP BY e.symbol, e.rn),
t AS (SELECT s.*, last, CASE WHEN p IS NULL AND q IS NULL THEN last ELSE least(coalesce(p, 1000000000), coalesce(q, 1000000000)) END AS x,
  CASE WHEN p IS NULL AND q IS NULL THEN 'time' WHEN p IS NOT NULL AND (q IS NULL OR p <= q) THEN 'tp' ELSE 'sl' END AS exit_reason, last_close FROM s JOIN hits USING (symbol, rn)),
u AS (SELECT t.*, e.ts AS exit_time, CASE exit_reason WHEN 'time' THEN t.last_close WHEN 'tp' THEN t.tp ELSE t.sl END AS exit_price FROM t JOIN s e ON e.symbol = t.symbol AND e.rn = t.x),
trades AS (SELECT symbol, ts AS entry_time, exit_time, CASE direction WHEN 1 THEN 'LONG' ELSE 'SHORT' END AS direction, contracts, close AS entry_price, exit_price,
  (exit_price - close) * direction * 50.0 * contracts AS gross_pnl, 1.29 * 2 * contracts AS commission, 0.5 * 0.25 * 50.0 * 2 * contracts AS slippage, exit_reason, x - rn AS bars_held FROM u)""")
)
# the first bracket closes a layer that the statement opened
SIMULATED = SIMULATED.replace("\nSELECT 1), s AS", ",\ns AS")
MONEY = ["entry_price", "exit_price", "gross_pnl", "commission", "slippage", "net_pnl"]
add(
    "trade_sim_vector",
    lambda s, d: X.independent_trades(signals(s, d), RULES).select(
        "symbol", "entry_time", "exit_time", "direction", F.col("contracts").cast("int"), *[F.round(c, 6).alias(c) for c in MONEY], "exit_reason", F.col("bars_held").cast("int")
    ),
    SIMULATED
    + " SELECT symbol, entry_time, exit_time, direction, contracts, "
    + ", ".join(f"round({'gross_pnl - commission - slippage' if c == 'net_pnl' else c}, 6) AS {c}" for c in MONEY)
    + ", exit_reason, CAST(bars_held AS INTEGER) AS bars_held FROM trades",
)
add(
    "trade_excursions",
    lambda s, d: X.excursions(X.independent_trades(signals(s, d), RULES), hour_bars(s, d), RULES).select(
        "symbol", "entry_time", "exit_time", "direction", *[F.round(c, 4).alias(c) for c in ("mfe", "mae", "mfe_ticks", "mae_ticks")]
    ),
    SIMULATED
    + """, ex AS (SELECT t.symbol, entry_time, exit_time, direction, contracts, entry_price, max(b.high) AS h, min(b.low) AS lo FROM trades t
      JOIN bars b ON b.symbol = t.symbol AND b.ts >= entry_time AND b.ts <= exit_time GROUP BY ALL),
    ey AS (SELECT *, greatest(CASE direction WHEN 'LONG' THEN h - entry_price ELSE entry_price - lo END, 0.0) AS f, greatest(CASE direction WHEN 'LONG' THEN entry_price - lo ELSE h - entry_price END, 0.0) AS a FROM ex)
    SELECT symbol, entry_time, exit_time, direction, round(f * 50 * contracts, 4) AS mfe, round(a * 50 * contracts, 4) AS mae, round(f / 0.25, 4) AS mfe_ticks, round(a / 0.25, 4) AS mae_ticks FROM ey""",
)
add(
    "trade_sim_fixed_horizon",
    lambda s, d: X.fixed_horizon_trades(signals(s, d), 10, RULES).select(
        "symbol", "entry_time", F.col("direction").cast("int"), F.col("contracts").cast("int"), *[F.round(c, 4).alias(c) for c in ("entry_price", "exit_price", "net_pnl")]
    ),
    "WITH q AS (" + statement(signal_layers("weighted"), [], []).replace("SELECT symbol, ts FROM l5", f"""SELECT symbol, ts AS entry_time, direction, contracts, close AS entry_price,
      coalesce({LEADC(10)}, last_value(close) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS exit_price FROM l5""")
    + """) SELECT symbol, entry_time, CAST(direction AS INTEGER) AS direction, contracts, round(entry_price, 4) AS entry_price, round(exit_price, 4) AS exit_price,
    round((exit_price - entry_price) * direction * 50.0 * contracts - 1.29 * 2 * contracts - 0.5 * 0.25 * 50.0 * 2 * contracts, 4) AS net_pnl FROM q WHERE direction <> 0""",
)
# ---- one position at a time: recursive steps along the bars of each series
WALKED = statement(signal_layers("weighted"), [], []).rsplit("\nSELECT", 1)[0] + f",\nb AS (SELECT *, row_number() {over()} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM l5)"
TRADED = ["entry_price", "exit_price", "gross_pnl", "net_pnl"]
SESSION = (570, 960)


def one_position_sql(session: tuple[int, int] | None) -> str:
    x = X.Limits()
    is_open = f"(hour(b.ts) * 60 + minute(b.ts) >= {session[0]} AND hour(b.ts) * 60 + minute(b.ts) < {session[1]} AND isodow(b.ts) <= 5)" if session else "true"
    slip = RULES.slippage_ticks * RULES.tick
    moved = "(close - entry) * side"
    return f"""{WALKED},
w AS (
  SELECT DISTINCT symbol, -1::BIGINT AS i, 0 AS side, 0.0::DOUBLE AS entry, 0::BIGINT AS bar, NULL::TIMESTAMP AS since, 0.0::DOUBLE AS top, 0.0::DOUBLE AS bottom, NULL::DATE AS today, 0 AS taken, 0.0::DOUBLE AS lost, 0 AS streak,
    NULL::VARCHAR AS reason, NULL::TIMESTAMP AS closed, 0.0::DOUBLE AS price, 0.0::DOUBLE AS net, 0 AS was, 0.0::DOUBLE AS entered, 0::BIGINT AS held, NULL::TIMESTAMP AS opened, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down FROM b
  UNION ALL
  SELECT symbol, i, CASE WHEN why IS NOT NULL THEN 0 WHEN goes <> 0 THEN goes ELSE side END, CASE WHEN goes <> 0 THEN close + {slip} * goes ELSE entry END, CASE WHEN goes <> 0 THEN i ELSE bar END,
    CASE WHEN goes <> 0 THEN ts ELSE since END, CASE WHEN goes <> 0 THEN high ELSE greatest(top, high) END, CASE WHEN goes <> 0 THEN low ELSE least(bottom, low) END,
    CAST(ts AS DATE), taken + abs(goes), lost + CASE WHEN why IS NOT NULL THEN least(0.0, result) ELSE 0.0 END, CASE WHEN why IS NULL THEN streak WHEN result < 0 THEN streak + 1 ELSE 0 END,
    why, ts, close - {slip} * side, result, side, entry, i - bar, since, greatest(top, high) - entry, entry - least(bottom, low)
  FROM (
    SELECT *, ((close - {slip} * side) - entry) * side * {RULES.point_value} - {RULES.commission} * 2 - {slip} * {RULES.point_value} * 2 AS result,
      CASE WHEN side = 0 AND is_open AND taken < {x.max_daily_trades} AND abs(lost) < {x.max_daily_loss} AND streak < {x.max_consecutive_losses} AND abs(vol_p - 0.5) >= {x.min_strength}
        THEN CASE WHEN vol_p > {x.long_above} THEN 1 WHEN vol_p < {x.short_below} THEN -1 ELSE 0 END ELSE 0 END AS goes,
      CASE WHEN side <> 0 AND is_open THEN CASE WHEN {moved} <= {-x.stop_ticks * RULES.tick} THEN 'stop' WHEN i - bar >= {x.hold_bars} THEN 'hold' WHEN {moved} >= {x.target_ticks * RULES.tick} THEN 'target' END END AS why
    FROM (SELECT w.symbol, b.i, w.side, w.entry, w.bar, w.since, w.top, w.bottom, w.streak, b.ts, b.close, b.high, b.low, b.vol_p, {is_open} AS is_open,
        CASE WHEN w.today = CAST(b.ts AS DATE) THEN w.taken ELSE 0 END AS taken, CASE WHEN w.today = CAST(b.ts AS DATE) THEN w.lost ELSE 0.0 END AS lost
      FROM w JOIN b ON b.symbol = w.symbol AND b.i = w.i + 1 WHERE b.i < b.n - {x.hold_bars + 1}) q) p)
SELECT symbol, opened AS entry_time, closed AS exit_time, CASE WHEN was > 0 THEN 'LONG' ELSE 'SHORT' END AS direction, round(entered, 6) AS entry_price, round(price, 6) AS exit_price,
  round((price - entered) * was * {RULES.point_value}, 6) AS gross_pnl, round(net, 6) AS net_pnl, reason AS exit_reason, CAST(held AS INTEGER) AS bars_held,
  round(greatest(0.0, CASE WHEN was > 0 THEN up ELSE down END) * {RULES.point_value}, 4) AS mfe, round(greatest(0.0, CASE WHEN was > 0 THEN down ELSE up END) * {RULES.point_value}, 4) AS mae
FROM w WHERE reason IS NOT NULL"""


for name, session in (("trade_sim_one_position", None), ("trade_sim_session", SESSION)):
    add(
        name,
        lambda s, d, k=session: X.one_position_trades(scored(s, d).withColumn("score", F.col("vol_p")), X.Limits(session=k), RULES).select(
            "symbol", "entry_time", "exit_time", "direction", *[F.round(c, 6).alias(c) for c in TRADED], "exit_reason", "bars_held", *[F.round(c, 4).alias(c) for c in ("mfe", "mae")]
        ),
        one_position_sql(session),
    )
add(
    "trade_sim_reentry",
    lambda s, d: X.reentry_trades(signals(s, d).withColumn("atr", F.col("atr_14")), RULES).select(
        "symbol", "entry_time", "exit_time", "direction", *[F.round(c, 6).alias(c) for c in TRADED], "exit_reason", "bars_held"
    ),
    f"""{WALKED},
w AS (
  SELECT DISTINCT symbol, -1::BIGINT AS i, 0 AS side, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS tp, 0.0::DOUBLE AS sl, 0::BIGINT AS bar, NULL::TIMESTAMP AS since,
    NULL::VARCHAR AS reason, NULL::TIMESTAMP AS closed, 0.0::DOUBLE AS price, 0 AS was, 0.0::DOUBLE AS entered, 0::BIGINT AS held, NULL::TIMESTAMP AS opened FROM b
  UNION ALL
  SELECT symbol, i, CASE WHEN goes THEN direction WHEN why IS NOT NULL THEN 0 ELSE side END, CASE WHEN goes THEN close ELSE entry END,
    CASE WHEN goes THEN close + {RULES.tp_atr} * atr_14 * direction ELSE tp END, CASE WHEN goes THEN close - {RULES.sl_atr} * atr_14 * direction ELSE sl END, CASE WHEN goes THEN i ELSE bar END,
    CASE WHEN goes THEN ts ELSE since END, why, ts, CASE why WHEN 'tp' THEN tp WHEN 'sl' THEN sl ELSE close END, side, entry, i - bar, since
  FROM (SELECT *, (side = 0 OR why IS NOT NULL) AND direction <> 0 AND atr_14 IS NOT NULL AND i < n - 1 AS goes
    FROM (SELECT w.symbol, b.i, b.n, b.ts, b.close, b.direction, b.atr_14, w.side, w.entry, w.tp, w.sl, w.bar, w.since,
        CASE WHEN w.side = 0 THEN NULL WHEN (w.side > 0 AND b.high >= w.tp) OR (w.side < 0 AND b.low <= w.tp) THEN 'tp' WHEN (w.side > 0 AND b.low <= w.sl) OR (w.side < 0 AND b.high >= w.sl) THEN 'sl'
          WHEN b.i - w.bar >= {RULES.holding} THEN 'time' END AS why
      FROM w JOIN b ON b.symbol = w.symbol AND b.i = w.i + 1) q) p)
SELECT symbol, opened AS entry_time, closed AS exit_time, CASE WHEN was > 0 THEN 'LONG' ELSE 'SHORT' END AS direction, round(entered, 6) AS entry_price, round(price, 6) AS exit_price,
  round((price - entered) * was * {RULES.point_value}, 6) AS gross_pnl,
  round((price - entered) * was * {RULES.point_value} - {RULES.commission} * 2 - {RULES.slippage_ticks * RULES.tick * RULES.point_value} * 2, 6) AS net_pnl, reason AS exit_reason, CAST(held AS INTEGER) AS bars_held
FROM w WHERE reason IS NOT NULL""",
)
#: Pairs of a volatility and a breakout threshold: fixed values.
THRESHOLDS = (0.40, 0.45, 0.50, 0.55, 0.60)
GRID = [(i, v, b) for i, (v, b) in enumerate((v, b) for v in THRESHOLDS for b in THRESHOLDS)]


def grid_returns(spark, sf_dir):
    grid = spark.createDataFrame(GRID, "strategy int, min_vol double, min_breakout double")
    return X.strategy_grid_returns(scored(spark, sf_dir).withColumns({"atr": F.col("atr_7"), "predicted_atr": F.col("atr_14")}), grid)


_R = X.GridRules()
_LEAVES = f"(l1 <= entry * (1 - CASE WHEN side > 0 THEN {_R.stop_atr} ELSE {_R.target_atr} END * atr / entry) OR h1 >= entry * (1 + CASE WHEN side > 0 THEN {_R.target_atr} ELSE {_R.stop_atr} END * atr / entry) OR hold + 1 >= {_R.hold_bars})"
GRID_RETURNS = f"""{WALKED},
nx AS (SELECT *, lead(close) {over()} AS c1, lead(high) {over()} AS h1, lead(low) {over()} AS l1 FROM b),
g(strategy, min_vol, min_breakout) AS (VALUES {", ".join(f"({i}, {v}::DOUBLE, {b}::DOUBLE)" for i, v, b in GRID)}),
w AS (
  SELECT DISTINCT symbol, strategy, min_vol, min_breakout, -1::BIGINT AS i, NULL::TIMESTAMP AS ts, 0 AS side, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS atr, 0 AS hold, 1.0::DOUBLE AS scale, 0.0::DOUBLE AS ret FROM b, g
  UNION ALL
  SELECT symbol, strategy, min_vol, min_breakout, i, ts, CASE WHEN side = 0 THEN goes WHEN leaves THEN 0 ELSE side END, CASE WHEN side = 0 THEN close ELSE entry END, CASE WHEN side = 0 THEN atr_7 ELSE atr END,
    CASE WHEN side = 0 THEN 0 ELSE hold + 1 END, CASE WHEN side = 0 AND goes <> 0 THEN size ELSE scale END,
    CASE WHEN i = n - 1 THEN CASE WHEN side <> 0 THEN -{_R.cost} * scale / 2 ELSE 0.0 END WHEN side = 0 THEN CASE WHEN goes <> 0 THEN -{_R.cost} * size / 2 ELSE 0.0 END
      ELSE side * scale * (c1 / close - 1) - CASE WHEN leaves THEN {_R.cost} * scale / 2 ELSE 0.0 END END
  FROM (SELECT w.symbol, w.strategy, w.min_vol, w.min_breakout, nx.i, nx.n, nx.ts, w.side, w.entry, w.atr, w.hold, w.scale, nx.close, nx.c1, nx.atr_7, coalesce({_LEAVES}, false) AS leaves,
      least(greatest(floor({_R.base_contracts} * least(greatest(nx.atr_7 / (nx.atr_14 + {EPS}), 0.5), 2.0)), 1), {_R.max_contracts}) / {_R.base_contracts}.0 AS size,
      CASE WHEN nx.i < nx.n - 1 AND nx.vol_p >= w.min_vol AND nx.atr_7 IS NOT NULL AND nx.atr_14 IS NOT NULL
        THEN CASE WHEN nx.up_p >= w.min_breakout AND (nx.down_p < w.min_breakout OR nx.up_p > nx.down_p) THEN 1 WHEN nx.down_p >= w.min_breakout THEN -1 ELSE 0 END ELSE 0 END AS goes
    FROM w JOIN nx ON nx.symbol = w.symbol AND nx.i = w.i + 1) q)"""
add(
    "strategy_grid_returns",
    lambda s, d: grid_returns(s, d).select("symbol", "strategy", "ts", F.round(F.col("ret") + TIE_SHIFT, 6).alias("ret")),
    GRID_RETURNS + " SELECT symbol, strategy, ts, round(ret + 1.3e-7, 6) AS ret FROM w WHERE i >= 0",
)

# ---- metrics on a ledger made of orders
LEDGER = """m AS (SELECT avg(o_totalprice) AS a FROM orders),
trades AS (SELECT o_orderpriority AS model, o_orderkey AS trade_id, o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR AS entry_time,
  o_orderdate + (o_orderkey % 24 + o_orderkey % 7) * INTERVAL 1 HOUR AS exit_time, CASE WHEN o_orderkey % 2 = 0 THEN 'LONG' ELSE 'SHORT' END AS direction,
  CAST(1 + o_orderkey % 3 AS INTEGER) AS contracts, round(o_totalprice - m.a + 500, 2) AS net_pnl, 2.58::DOUBLE * (1 + o_orderkey % 3) AS commission, 12.5::DOUBLE * (1 + o_orderkey % 3) AS slippage,
  round(o_totalprice - m.a + 500, 2) + (2.58::DOUBLE + 12.5::DOUBLE) * (1 + o_orderkey % 3) AS gross_pnl, (o_orderkey % 100) / 100.0::DOUBLE AS prob FROM orders, m)"""


def ledger(spark, sf_dir):
    """A trade ledger: one trade for each order, its result the distance from the mean price, and 500."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    mean = o.agg(F.avg("o_totalprice").alias("a"))  # one row
    hours = lambda n: F.make_dt_interval(hours=n.cast("int"))
    rows = o.join(F.broadcast(mean)).withColumn("net_pnl", F.round(F.col("o_totalprice") - F.col("a") + 500, 2))
    size = (1 + k % 3).cast("int")
    return rows.select(
        F.col("o_orderpriority").alias("model"), k.alias("trade_id"), (F.col("o_orderdate") + hours(k % 24)).alias("entry_time"),
        (F.col("o_orderdate") + hours(k % 24 + k % 7)).alias("exit_time"), F.when(k % 2 == 0, "LONG").otherwise("SHORT").alias("direction"), size.alias("contracts"),
        "net_pnl", (2.58 * size).alias("commission"), (12.5 * size).alias("slippage"), (F.col("net_pnl") + (2.58 + 12.5) * size).alias("gross_pnl"), ((k % 100) / 100.0).alias("prob"),
    )


def rounded(df, keys, floats, places=2):
    return df.select(*keys, *[F.round(c, places).alias(c) for c in floats])


def rsql(floats, places=2):
    return ", ".join(f"round({c}, {places}) AS {c}" for c in floats)


add(
    "trade_metrics",
    lambda s, d: G.trade_metrics(ledger(s, d)).select(
        "model", "total_trades", "winning_trades", "losing_trades", "long_trades", "short_trades", "long_winners", "short_winners", "trading_days",
        *[F.round(c, 2).alias(c) for c in ("gross_pnl", "net_pnl", "commission", "slippage", "avg_win", "avg_loss", "max_win", "max_loss", "expectancy")],
        *[F.round(c, 6).alias(c) for c in ("win_rate", "profit_factor", "payoff", "trades_per_day")],
    ),
    f"""WITH {LEDGER} SELECT model, count(*) AS total_trades, count(*) FILTER (WHERE net_pnl > 0) AS winning_trades, count(*) FILTER (WHERE net_pnl < 0) AS losing_trades,
    count(*) FILTER (WHERE direction = 'LONG') AS long_trades, count(*) FILTER (WHERE direction <> 'LONG') AS short_trades,
    count(*) FILTER (WHERE direction = 'LONG' AND net_pnl > 0) AS long_winners, count(*) FILTER (WHERE direction <> 'LONG' AND net_pnl > 0) AS short_winners,
    count(DISTINCT CAST(entry_time AS DATE)) AS trading_days, round(sum(gross_pnl), 2) AS gross_pnl, round(sum(net_pnl), 2) AS net_pnl, round(sum(commission), 2) AS commission, round(sum(slippage), 2) AS slippage,
    round(avg(net_pnl) FILTER (WHERE net_pnl > 0), 2) AS avg_win, round(avg(net_pnl) FILTER (WHERE net_pnl < 0), 2) AS avg_loss, round(max(net_pnl), 2) AS max_win, round(min(net_pnl), 2) AS max_loss,
    round(avg(net_pnl), 2) AS expectancy, round(count(*) FILTER (WHERE net_pnl > 0) / count(*), 6) AS win_rate,
    round(sum(net_pnl) FILTER (WHERE net_pnl > 0) / -sum(net_pnl) FILTER (WHERE net_pnl < 0), 6) AS profit_factor,
    round(abs(avg(net_pnl) FILTER (WHERE net_pnl > 0) / avg(net_pnl) FILTER (WHERE net_pnl < 0)), 6) AS payoff,
    round(count(*) / count(DISTINCT CAST(entry_time AS DATE)), 6) AS trades_per_day FROM trades GROUP BY model""",
)
SEQ = "OVER (PARTITION BY model ORDER BY entry_time, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
CURVE = f"{LEDGER}, c0 AS (SELECT *, sum(net_pnl) {SEQ} AS equity FROM trades), c1 AS (SELECT *, greatest(0.0, max(equity) {SEQ}) AS peak FROM c0), curve AS (SELECT *, peak - equity AS drawdown FROM c1)"
add(
    "equity_drawdown",
    lambda s, d: rounded(G.equity(ledger(s, d)), ["model", "trade_id", "entry_time"], ["equity", "peak", "drawdown"]),
    f"WITH {CURVE} SELECT model, trade_id, entry_time, {rsql(['equity', 'peak', 'drawdown'])} FROM curve",
)
add(
    "drawdown_metrics",
    lambda s, d: rounded(G.drawdown_metrics(G.equity(ledger(s, d))), ["model"], ["max_drawdown", "avg_drawdown", "max_runup", "max_drawdown_share"]),
    f"""WITH {CURVE} SELECT model, round(max(drawdown), 2) AS max_drawdown, round(avg(drawdown) FILTER (WHERE drawdown > 0), 2) AS avg_drawdown, round(max(equity), 2) AS max_runup,
    round(CASE WHEN max(peak) > 0 THEN max(drawdown) / max(peak) END, 2) AS max_drawdown_share FROM curve GROUP BY model""",
)
add(
    "dd_duration",
    lambda s, d: G.drawdown_runs(G.equity(ledger(s, d))).select("model", "start", "trades", F.round("depth", 2).alias("depth"), F.col("recovered").cast("int")),
    f"""WITH {CURVE}, g AS (SELECT *, sum(CASE WHEN drawdown > 0 THEN 0 ELSE 1 END) {SEQ} AS grp, lead(1) OVER (PARTITION BY model ORDER BY entry_time, trade_id) IS NULL AS lastrow FROM curve)
    SELECT model, min(entry_time) AS start, count(*) AS trades, round(max(drawdown), 2) AS depth, CAST(min(CASE WHEN lastrow THEN 0 ELSE 1 END) AS INTEGER) AS recovered FROM g WHERE drawdown > 0 GROUP BY model, grp""",
)
add(
    "streaks",
    lambda s, d: G.streaks(ledger(s, d)),
    f"""WITH {LEDGER}, a AS (SELECT *, net_pnl > 0 AS w, row_number() OVER (PARTITION BY model ORDER BY entry_time, trade_id) - row_number() OVER (PARTITION BY model, net_pnl > 0 ORDER BY entry_time, trade_id) AS g FROM trades),
    r AS (SELECT model, w, g, count(*) AS n FROM a GROUP BY ALL) SELECT model, max(n) FILTER (WHERE w) AS max_wins, max(n) FILTER (WHERE NOT w) AS max_losses FROM r GROUP BY model""",
)
DAYPNL = f"""{LEDGER}, days AS (SELECT model, CAST(entry_time AS DATE) AS date, sum(net_pnl) AS pnl, count(*) AS trades, count(*) FILTER (WHERE net_pnl > 0) / count(*) AS win_rate FROM trades GROUP BY ALL),
cum AS (SELECT *, sum(pnl) OVER (PARTITION BY model ORDER BY date) AS cumulative FROM days)"""
add(
    "daily_pnl",
    lambda s, d: G.daily_pnl(ledger(s, d)).select("model", "date", "trades", *[F.round(c, 2).alias(c) for c in ("pnl", "cumulative")], F.round("win_rate", 6).alias("win_rate")),
    f"WITH {DAYPNL} SELECT model, date, trades, {rsql(['pnl', 'cumulative'])}, round(win_rate, 6) AS win_rate FROM cum",
)
add(
    "daily_sharpe",
    lambda s, d: G.daily_ratios(ledger(s, d)).select("model", "days", "winning_days", "losing_days", *[F.round(c, 2).alias(c) for c in ("avg_day", "best_day", "worst_day")], *[F.round(c, 6).alias(c) for c in ("sharpe", "sortino", "calmar")]),
    f"""WITH {DAYPNL}, dd AS (SELECT *, greatest(0.0, max(cumulative) OVER (PARTITION BY model ORDER BY date)) - cumulative AS dd FROM cum)
    SELECT model, count(*) AS days, count(*) FILTER (WHERE pnl > 0) AS winning_days, count(*) FILTER (WHERE pnl < 0) AS losing_days, round(avg(pnl), 2) AS avg_day, round(max(pnl), 2) AS best_day, round(min(pnl), 2) AS worst_day,
    round(avg(pnl) / stddev_samp(pnl) * sqrt(252), 6) AS sharpe, round(avg(pnl) / (stddev_samp(pnl) FILTER (WHERE pnl < 0)) * sqrt(252), 6) AS sortino,
    round(sum(pnl) / (count(*) / 252.0) / max(dd), 6) AS calmar FROM dd GROUP BY model""",
)
add(
    "ledger_validators",
    lambda s, d: G.validators(ledger(s, d)).withColumn("losing_day_share", F.round("losing_day_share", 6)),
    f"""WITH {DAYPNL}, l AS (SELECT model, round(count(*) FILTER (WHERE pnl < 0) / count(*), 6) AS losing_day_share FROM days GROUP BY model)
    SELECT t.model, count(*) FILTER (WHERE NOT (hour(entry_time) * 60 + minute(entry_time) >= 570 AND hour(entry_time) * 60 + minute(entry_time) < 960 AND isodow(entry_time) <= 5)) AS out_of_session,
    count(*) FILTER (WHERE exit_time < entry_time) AS exit_before_entry, count(*) FILTER (WHERE abs(net_pnl) > 1e5) AS huge_results, count(*) FILTER (WHERE contracts <= 0) AS no_contracts,
    any_value(losing_day_share) AS losing_day_share FROM trades t JOIN l USING (model) GROUP BY t.model""",
)
REG = {"year": "CAST(year(entry_time) AS VARCHAR)", "quarter": "year(entry_time) || 'Q' || quarter(entry_time)", "side": "direction"}
add(
    "regime_grouping_sets",
    lambda s, d: G.regime_metrics(
        ledger(s, d).withColumns({"year": F.year("entry_time"), "quarter": F.concat(F.year("entry_time"), F.lit("Q"), F.quarter("entry_time")), "side": F.col("direction")}), list(REG)
    ).select("regime", "value", "trades", *[F.round(c, 2).alias(c) for c in ("net_pnl", "avg_trade")], *[F.round(c, 6).alias(c) for c in ("win_rate", "profit_factor", "trade_share", "pnl_share")]),
    f"WITH {LEDGER}, r AS ("
    + " UNION ALL ".join(f"SELECT '{n}' AS regime, {e} AS value, net_pnl FROM trades" for n, e in REG.items())
    + """), a AS (SELECT regime, value, count(*) AS trades, sum(net_pnl) AS net_pnl, avg(net_pnl) AS avg_trade, count(*) FILTER (WHERE net_pnl > 0) / count(*) AS win_rate,
      sum(net_pnl) FILTER (WHERE net_pnl > 0) / -sum(net_pnl) FILTER (WHERE net_pnl < 0) AS profit_factor FROM r GROUP BY ALL)
    SELECT regime, value, trades, round(net_pnl, 2) AS net_pnl, round(avg_trade, 2) AS avg_trade, round(win_rate, 6) AS win_rate, round(profit_factor, 6) AS profit_factor,
    round(trades / sum(trades) OVER (PARTITION BY regime), 6) AS trade_share, round(net_pnl / sum(net_pnl) OVER (PARTITION BY regime), 6) AS pnl_share FROM a""",
)
W30 = "OVER (PARTITION BY model ORDER BY entry_time, trade_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
add(
    "worst_windows_topk",
    lambda s, d: rounded(G.worst_windows(ledger(s, d)), ["model", "start", "end"], ["window_pnl", "win_rate"]),
    f"""WITH {LEDGER}, w AS (SELECT model, first_value(entry_time) {W30} AS start, entry_time AS "end", trade_id, count(*) {W30} AS n, sum(net_pnl) {W30} AS window_pnl, avg(CASE WHEN net_pnl > 0 THEN 1 ELSE 0 END) {W30} AS win_rate FROM trades)
    SELECT model, start, "end", round(window_pnl, 2) AS window_pnl, round(win_rate, 2) AS win_rate FROM w WHERE n = 30 ORDER BY w.window_pnl, model, "end", trade_id LIMIT 10""",
)
#: 81 settings, as many as the usual search has.
SETTINGS = [(p / 10, t, q) for p in range(9) for t in (0.8, 1.0, 1.2) for q in (0.8, 1.0, 1.2)]


def settings(spark):
    return spark.createDataFrame(SETTINGS, "min_prob double, tp_scale double, sl_scale double")


SENS = f"""{LEDGER}, g(min_prob, tp_scale, sl_scale) AS (VALUES {", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE)" for a, b, c in SETTINGS)}),
p AS (SELECT model, g.*, CASE WHEN net_pnl > 0 THEN net_pnl * tp_scale ELSE net_pnl * sl_scale END AS x FROM trades JOIN g ON prob >= min_prob),
s AS (SELECT model, min_prob, tp_scale, sl_scale, count(*) AS trades, sum(x) AS net_pnl, count(*) FILTER (WHERE x > 0) / count(*) AS win_rate, avg(x) / (stddev_samp(x) + {EPS}) AS trade_sharpe FROM p GROUP BY ALL)"""
KEYS = ["model", "min_prob", "tp_scale", "sl_scale"]
add(
    "sensitivity_grid",
    lambda s, d: G.sensitivity(ledger(s, d), settings(s)).select(*KEYS, "trades", F.round("net_pnl", 2).alias("net_pnl"), *[F.round(c, 6).alias(c) for c in ("win_rate", "trade_sharpe")]),
    f"WITH {SENS} SELECT model, min_prob, tp_scale, sl_scale, trades, round(net_pnl, 2) AS net_pnl, round(win_rate, 6) AS win_rate, round(trade_sharpe, 6) AS trade_sharpe FROM s",
)
add(
    "grid_best",
    lambda s, d: G.best_setting(G.sensitivity(ledger(s, d), settings(s)), "net_pnl", KEYS[1:]).withColumn("net_pnl", F.round("net_pnl", 2)),
    f"WITH {SENS}, r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY net_pnl DESC, min_prob, tp_scale, sl_scale) AS k FROM s) SELECT model, min_prob, tp_scale, sl_scale, round(net_pnl, 2) AS net_pnl FROM r WHERE k = 1",
)
add(
    "grid_robustness",
    lambda s, d: rounded(G.robustness(G.sensitivity(ledger(s, d), settings(s)), "net_pnl"), ["model"], ["cv", "profitable"], 6),
    f"WITH {SENS} SELECT model, round(stddev_samp(net_pnl) / (abs(avg(net_pnl)) + {EPS}), 6) AS cv, round(count(*) FILTER (WHERE net_pnl > 0) / count(*), 6) AS profitable FROM s GROUP BY model",
)
LEVELS = (1.0, 2.0, 3.0, 5.0)


def slippage_levels(spark, sf_dir):
    out = None
    for level in LEVELS:
        one = G.stress(ledger(spark, sf_dir), "slippage", level).select("model", F.lit(level).alias("level"), "trades", F.round("net_pnl", 2).alias("net_pnl"))
        out = one if out is None else out.unionByName(one)
    return out


add(
    "slippage_stress",
    slippage_levels,
    f"WITH {LEDGER} " + " UNION ALL ".join(f"SELECT model, {x}::DOUBLE AS level, count(*) AS trades, round(sum(net_pnl - slippage * {x - 1}::DOUBLE), 2) AS net_pnl FROM trades GROUP BY model" for x in LEVELS),
)
SIMS, STRESS_SIMS = 10_000, 5_000
CENT_SHIFT = 0.0001303  # means and quantiles of cents often end in half a cent, which engines round to different sides
SUMMED = ["mean", "std", "median", "ci_low", "ci_high", "min", "max"]


def summary_of(runs):
    return lambda s, d: G.simulation_summary(runs(ledger(s, d))).select("model", *[F.round(F.col(c) + CENT_SHIFT, 2).alias(c) for c in SUMMED], F.round("prob_positive", 6).alias("prob_positive"))


SUMMARY = (
    "SELECT model, "
    + ", ".join(
        f"round({x} + {CENT_SHIFT}, 2) AS {c}"
        for c, x in zip(SUMMED, ("avg(x)", "stddev_pop(x)", "quantile_cont(x, 0.5)", "quantile_cont(x, 0.025)", "quantile_cont(x, 0.975)", "min(x)", "max(x)"))
    )
    + ", round(count(*) FILTER (WHERE x > 0) / count(*), 6) AS prob_positive FROM r GROUP BY model"
)


def runs_sql(k: M.Shocks, sims: int = SIMS) -> str:
    """The ledger's runs as ``r(model, sim, x)``."""
    u = lambda j: uniform(k.seed + j, "nth", "sim")
    pnl = "net_pnl"
    if k.cost:
        pnl += "".join(f" - {c} * (2 * {u(j)} - 1) * {m}::DOUBLE" for j, (c, m) in enumerate(zip(("slippage", "commission"), k.cost), 1))
    if k.dropout:
        low, high = k.dropout
        pnl = f"CASE WHEN {u(4)} > {low}::DOUBLE + {high - low}::DOUBLE * {uniform(k.seed + 3, '0', 'sim')} THEN {pnl} END"
    draws = resample(k.seed) if k.resample else "d AS (SELECT model, nth, sim, nth AS pick FROM num, sims)"
    return f"""{LEDGER}, num AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY trade_id) - 1 AS nth, count(*) OVER (PARTITION BY model) AS n FROM trades),
    sims AS (SELECT unnest(range({sims})) AS sim), {draws}, o AS (SELECT d.model, d.sim, d.nth, p.net_pnl, p.slippage, p.commission FROM d JOIN num p ON p.model = d.model AND p.nth = d.pick),
    r AS (SELECT model, sim, sum({pnl}) AS x FROM o GROUP BY model, sim)"""


for name, shocks in (("bootstrap", M.BOOTSTRAP), ("missed", M.MISSED), ("costs", M.COSTS), ("combined", M.COMBINED)):
    add(f"monte_carlo_{name}", summary_of(lambda t, k=shocks: M.runs(t, SIMS, k)), f"WITH RECURSIVE {runs_sql(shocks)} {SUMMARY}")
_U = lambda j: uniform(7 + j, "trade_id", "sim")
STRESSES = {
    "dropout": (0.2, f"CASE WHEN {_U(0)} >= 0.2 THEN net_pnl END"),
    "adverse": (0.1, f"CASE WHEN net_pnl <= 0 OR {_U(0)} >= 0.1 THEN net_pnl END"),
    "swan": (0.001, f"CASE WHEN {_U(0)} < 0.001 THEN -10 * abs(net_pnl) ELSE net_pnl END"),
    "combined": (0.1, f"CASE WHEN {_U(1)} >= 0.3 AND (net_pnl <= 0 OR {_U(2)} >= 0.2) THEN CASE WHEN {_U(0)} < 0.1 THEN -10 * abs(net_pnl - slippage * 2) ELSE net_pnl - slippage * 2 END END"),
}
for kind, (level, expression) in STRESSES.items():
    add(
        f"stress_{kind}" if kind == "combined" else f"monte_carlo_{kind}",
        summary_of(lambda t, k=kind, v=level: G.stress(t, k, v, STRESS_SIMS)),
        f"WITH {LEDGER}, r AS (SELECT model, sim, sum({expression}) AS x FROM trades, (SELECT unnest(range({STRESS_SIMS})) AS sim) GROUP BY model, sim) {SUMMARY}",
    )
