"""Queries for composite columns, model inputs, intervals and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.tables import Table
from tidemark.operators import composites as K
from tidemark.operators import labels as L
from tidemark.operators import metrics as G
from tidemark.operators import ranking as A
from tidemark.operators import signals as X
from tidemark.operators import simulations as M
from tidemark.operators import splits as V
from tidemark.operators import validation as S
from tidemark.operators import vectors
from tidemark.operators.boosting import boosted_scores
from tidemark.plans.catalog import add, hour_bars, on_bars, shown
from tidemark.plans.features import DAILY, below_share, daily_levels, mean_of
from tidemark.plans.indicators import EPS, TR, frame_list, ret
from tidemark.plans.research import CENT_SHIFT, DAYPNL, GRID, LEDGER, RULES, SIMS, ledger, runs_sql, scored
from tidemark.plans.sql import flag, lag, resample, roll, statement
from tidemark.plans.statistics import FEAT, MODEL, featured

CLIP = lambda x, a, b: f"least(greatest({x}, {a}), {b})"
DS = [
    {"v": frame_list("vol", 10)},
    {
        "vix_ma5": roll("avg", "vol", 5), "vix_ma10": roll("avg", "vol", 10), "vix_vs_ma10": f"vol / nullif({roll('avg', 'vol', 10)}, 0)", "vix_percentile": below_share("vol", "v", 10),
        "vix_fear": flag("vol > 25"), "vix_extreme_fear": flag("vol > 30"), "vix_calm": flag("vol < 15"), "vix_change": f"vol / nullif({lag('vol')}, 0) - 1",
        "vix_sentiment": f"-{CLIP('(vol - 20) / 15', -1.0, 1.0)}", "pcr_total": f"0.6::DOUBLE + 0.7::DOUBLE * {CLIP('(vol - 12) / 25', 0.0, 1.0)}",
    },
    {"vix_spike": flag("vix_change > 0.15"), "bearish": "25 + coalesce(vix_percentile, 0.5) * 30", "bullish": "50 - coalesce(vix_percentile, 0.5) * 30"},
    {
        "neutral": "100 - bullish - bearish", "survey_spread": "bullish - bearish", "bull_deviation": "bullish - 37.5", "bear_deviation": "bearish - 31.0", "extreme_bullish": flag("bullish > 50"),
        "extreme_bearish": flag("bearish > 50"), "survey_contrarian": "(bearish - bullish) / 100", "pcr_ma5": roll("avg", "pcr_total", 5), "pcr_put_heavy": flag("pcr_total > 1.1"),
        "pcr_call_heavy": flag("pcr_total < 0.8"), "pcr_contrarian": CLIP("(pcr_total - 0.95::DOUBLE) / 0.35::DOUBLE", -1.0, 1.0),
    },
    {
        "composite_contrarian": mean_of(["vix_sentiment", "survey_contrarian", "pcr_contrarian"]), "fear_regime": flag("vix_fear = 1 OR extreme_bearish = 1 OR pcr_put_heavy = 1"),
        "greed_regime": flag("vix_calm = 1 OR extreme_bullish = 1 OR pcr_call_heavy = 1"),
    },
]
DSALL = [c for layer in DS[1:] for c in layer]
DSI = ["vix_fear", "vix_extreme_fear", "vix_calm", "vix_spike", "extreme_bullish", "extreme_bearish", "pcr_put_heavy", "pcr_call_heavy", "fear_regime", "greed_regime"]
DSF = [c for c in DSALL if c not in DSI]
add("daily_sentiment", lambda s, d: shown(K.daily_sentiment(daily_levels(s, d), "vol", 10), DSF, DSI), statement(DS, DSF, DSI, base=DAILY, first="daily"))
MS = {
    "yield_curve": "vol - second", "curve_inverted": flag("vol - second < 0"), "credit_spread": "front - vol", "real_rate": "vol - second / 2", "rate_mom_5": f"vol - {lag('vol', 5)}", "rate_mom_20": f"vol - {lag('vol', 20)}",
}
MSF = [c for c in MS if c != "curve_inverted"]
add(
    "macro_spreads",
    lambda s, d: shown(K.macro_spreads(daily_levels(s, d).withColumn("half", F.col("second") / 2), "vol", "second", "front", "half"), MSF, ["curve_inverted"]),
    statement([MS], MSF, ["curve_inverted"], base=DAILY, first="daily"),
)
SZ = [
    {"r": ret(1), "g": "close / 4", "news": "(close - open) / 100", "posts": "volume"},
    {
        "zone_extreme_fear": flag("g < 25"), "zone_fear": flag("g >= 25 AND g < 45"), "zone_neutral_zone": flag("g >= 45 AND g < 55"), "zone_greed": flag("g >= 55 AND g < 75"), "zone_extreme_greed": flag("g >= 75"),
        "score_share": "g / 100", "news_divergence": f"CASE WHEN coalesce({roll('avg', 'r', 20)} > 0, false) THEN -news ELSE news END", "social_intensity": f"posts / ({roll('stddev_samp', 'r', 20)} * 10000 + 1)",
    },
]
SZF = ["score_share", "news_divergence", "social_intensity"]
SZI = [c for c in SZ[1] if c.startswith("zone")]
add(
    "snapshot_zones",
    on_bars(lambda b: K.snapshot_zones(b.withColumns({"g": F.col("close") / 4, "news": (F.col("close") - F.col("open")) / 100, "posts": F.col("volume")}), "g", "news", "posts"), SZF, SZI),
    statement(SZ, SZF, SZI),
)
CS = [
    {"tr": TR, "p": f"(close - low) / (high - low + {EPS})", "v": frame_list("close", 20)},
    {"a": roll("avg", "tr", 14), "x": below_share("close", "v", 20)},
    {"signal": "CASE WHEN p > 0.55 AND x > 0.7 THEN 1 WHEN p > 0.55 AND x < 0.3 THEN -1 ELSE 0 END"},
    {
        "size": "CASE WHEN signal <> 0 THEN least(greatest(floor(1 + (p - 0.55::DOUBLE) * 4), 1), 3) ELSE 0 END",
        "tp_price": "CASE WHEN signal <> 0 THEN close + signal * 2.0 * a ELSE 0.0 END", "sl_price": "CASE WHEN signal <> 0 THEN close - signal * 1.0 * a ELSE 0.0 END",
    },
]


def crowd(spark, sf_dir):
    from tidemark.functions.frames import Frames
    from tidemark.operators import price as P

    b = P.atr(hour_bars(spark, sf_dir), (14,))
    return b.withColumns({"p": (F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + 1e-10), "x": Frames().below_share("close", 20)})


add("contrarian_signals", lambda s, d: shown(K.contrarian_signals(crowd(s, d), "p", "x", "atr_14"), ["tp_price", "sl_price"], ["signal", "size"]), statement(CS, ["tp_price", "sl_price"], ["signal", "size"]))
MV0 = {"tr": TR, "r": ret(1), "d": f"close - {lag('close')}"}
MV1 = {"g": "CASE WHEN d > 0 THEN d ELSE 0.0 END", "l": "CASE WHEN d < 0 THEN -d ELSE 0.0 END"}
MV2 = {f"return_lag{k}": ret(k) for k in (1, 2, 3, 5, 10, 20)}
for p in (5, 10, 14, 20):
    MV2 |= {f"rv_{p}": roll("stddev_samp", "r", p), f"atr_{p}": roll("avg", "tr", p), f"atr_pct_{p}": f"{roll('avg', 'tr', p)} / nullif(close, 0)"}
for p in (10, 20, 50):
    top, low = roll("max", "high", p), roll("min", "low", p)
    MV2 |= {f"close_vs_high_{p}": f"(close - {top}) / nullif(close, 0)", f"close_vs_low_{p}": f"(close - {low}) / nullif(close, 0)", f"range_pct_{p}": f"({top} - {low}) / nullif(close, 0)"}
for p in (5, 10, 20):
    MV2 |= {f"momentum_{p}": ret(p), f"ma_dist_{p}": f"close / nullif({roll('avg', 'close', p)}, 0) - 1"}
for p in (7, 14):
    MV2[f"rsi_{p}"] = f"100 - 100 / (1 + {roll('avg', 'g', p)} / ({roll('avg', 'l', p)} + {EPS}))"
MV2["bb_pct_20"] = f"(close - ({roll('avg', 'close', 20)} - 2 * {roll('stddev_samp', 'close', 20)})) / (4 * {roll('stddev_samp', 'close', 20)} + {EPS})"
for p in (5, 10, 20):
    MV2 |= {f"volume_sma_{p}": roll("avg", "volume", p), f"volume_ratio_{p}": f"volume / ({roll('avg', 'volume', p)} + 1)"}
add("model_vector_42", on_bars(vectors.model_vector, vectors.VECTOR), statement([MV0, MV1, MV2], vectors.VECTOR))
BI = [
    {"d": f"close - {lag('close')}", "c1": lag("close")} | {f"k{k}": ret(k) for k in (1, 2, 3, 5, 10)} | {f"m{p}": roll("avg", "close", p) for p in (10, 20)},
    MV1,
    {f"s{p}": f"100 - 100 / (1 + {roll('avg', 'g', p)} / (CASE WHEN {roll('avg', 'l', p)} = 0 THEN {EPS} ELSE {roll('avg', 'l', p)} END))" for p in (7, 14)},
    {f"return_late{k}": lag(f"k{k}") for k in (1, 2, 3, 5, 10)}
    | {f"momentum_late{p}": f"c1 / nullif({lag('close', p + 1)}, 0) - 1" for p in (5, 10, 20)}
    | {f"to_ma_late{p}": f"c1 / nullif({lag(f'm{p}')}, 0) - 1" for p in (10, 20)}
    | {f"rsi_late{p}": lag(f"s{p}") for p in (7, 14)}
    | {"bars_since_open": "(hour(ts) - 9) * 12 + minute(ts) // 5"},
]
BIF = [c for c in BI[3] if c != "bars_since_open"]
add("barrier_inputs", on_bars(vectors.barrier_inputs, BIF, ["bars_since_open"]), statement(BI, BIF, ["bars_since_open"]))
add(
    "holding_statistics",
    lambda s, d: K.holding_statistics(ledger(s, d)).select("model", *[F.round(c, 6).alias(c) for c in ("avg_minutes", "min_minutes", "max_minutes", "avg_contracts")], "max_contracts", "total_contracts", F.col("total_days").cast("long")),
    f"""WITH {LEDGER}, t AS (SELECT *, date_diff('microsecond', entry_time, exit_time) / 6e7 AS mi FROM trades)
    SELECT model, round(avg(mi), 6) AS avg_minutes, round(min(mi), 6) AS min_minutes, round(max(mi), 6) AS max_minutes, round(avg(contracts), 6) AS avg_contracts, max(contracts) AS max_contracts,
    CAST(sum(contracts) AS BIGINT) AS total_contracts, date_diff('day', CAST(min(entry_time) AS DATE), CAST(max(entry_time) AS DATE)) + 1 AS total_days FROM t GROUP BY model""",
)
add(
    "fold_summary",
    lambda s, d: S.fold_summary(A.auc(featured(s, d), "close", "target_direction_1", ("symbol",)), "auc").select(*[F.round(c, 6).alias(c) for c in ("mean", "std", "t", "ci_low", "ci_high")], "folds"),
    f"""WITH {FEAT}, r AS (SELECT symbol, y, rank() OVER (PARTITION BY symbol ORDER BY close) + (count(*) OVER (PARTITION BY symbol, close) - 1) / 2 AS k FROM f),
    a AS (SELECT symbol, (sum(k) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) AS auc FROM r GROUP BY symbol),
    m AS (SELECT avg(auc) AS mean, stddev_samp(auc) AS std, count(auc) AS folds FROM a)
    SELECT round(mean, 6) AS mean, round(std, 6) AS std, round((mean - 0.5) / (std / sqrt(folds)), 6) AS t, round(mean - 1.96 * std / sqrt(folds), 6) AS ci_low, round(mean + 1.96 * std / sqrt(folds), 6) AS ci_high, folds FROM m""",
)
add(
    "bootstrap_sharpe",
    lambda s, d: K.bootstrap_sharpe(G.daily_pnl(ledger(s, d)), "pnl", SIMS).select("model", *[F.round(c, 6).alias(c) for c in ("sharpe", "ci_low", "ci_high")]),
    f"""WITH RECURSIVE {DAYPNL}, num AS (SELECT model, pnl, row_number() OVER (PARTITION BY model ORDER BY date) - 1 AS nth, count(*) OVER (PARTITION BY model) AS n FROM days),
    sims AS (SELECT unnest(range({SIMS})) AS sim), {resample(42)},
    r AS (SELECT d.model, sim, avg(pnl) / (stddev_pop(pnl) + {EPS}) * sqrt(252) AS x FROM d JOIN num p ON p.model = d.model AND p.nth = d.pick GROUP BY ALL),
    t AS (SELECT model, avg(pnl) / (stddev_pop(pnl) + {EPS}) * sqrt(252) AS sharpe FROM days GROUP BY model)
    SELECT model, round(any_value(sharpe), 6) AS sharpe, round(quantile_cont(x, 0.025), 6) AS ci_low, round(quantile_cont(x, 0.975), 6) AS ci_high FROM r JOIN t USING (model) GROUP BY model""",
)
add(
    "bootstrap_total",
    lambda s, d: K.bootstrap_total(ledger(s, d), SIMS).select("model", *[F.round(F.col(c) + CENT_SHIFT, 2).alias(c) for c in ("net_pnl", "ci_low", "ci_high")]),
    f"""WITH RECURSIVE {runs_sql(M.BOOTSTRAP)}, t AS (SELECT model, sum(net_pnl) AS net_pnl FROM trades GROUP BY model)
    SELECT model, round(any_value(net_pnl) + {CENT_SHIFT}, 2) AS net_pnl, round(quantile_cont(x, 0.025) + {CENT_SHIFT}, 2) AS ci_low, round(quantile_cont(x, 0.975) + {CENT_SHIFT}, 2) AS ci_high FROM r JOIN t USING (model) GROUP BY model""",
)
add("direction_leak", lambda s, d: A.direction_leak(V.holdout(V.numbered(featured(s, d)), 0.3).withColumn("fold", F.lit(0)), MODEL, "target_direction_1").select("direction", "auc"))


#: Targets of the full validation and the horizon of the longest, in bars: fixed values.
VALIDATED, LONGEST = {"vol_expansion_5": "vol_p", "new_high_10": "up_p", "new_low_10": "down_p"}, 10


def full_validation(spark, sf_dir):
    """15 purged folds of 6 choose 2 for three targets in one fit, 25 strategies over their scores, 1,000 overfit trials, the deflated Sharpe ratio, and the gates."""
    bars = scored(spark, sf_dir)
    f = V.numbered(L.price_targets(L.volatility_targets(bars, (5,), regime_rows=100), (1.0,), (LONGEST,))).withColumn("t1", F.col("row_no") + LONGEST)
    members = V.combinatorial(f, 6, 2, t1="t1", embargo_share=0.01, purge_share=0.01)
    scores = Table(boosted_scores(members, ["rsi_14", "atr_14", "atr_7", "volume"], list(VALIDATED)), "scores").rows
    folds = S.fold_summary(A.auc(scores, "score", "label", ("target", "fold")), "auc", ("target",))
    wide = scores.groupBy("symbol", "ts").pivot("target", list(VALIDATED)).agg(F.avg("score")).withColumnsRenamed(VALIDATED)
    held = bars.select("symbol", "ts", "high", "low", "close", F.col("atr_7").alias("atr"), F.col("atr_14").alias("predicted_atr")).join(wide, ["symbol", "ts"], "left").na.fill(0.0, list(VALIDATED.values()))
    grid = spark.createDataFrame(GRID, "strategy int, min_vol double, min_breakout double")
    returns = Table(X.strategy_grid_returns(held, grid), "returns").rows
    hours = returns.groupBy("strategy", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("period")).agg(F.sum("ret").alias("ret"))
    chosen = hours.where(F.col("strategy") == next(i for i, v, b in GRID if (v, b) == (0.5, 0.5)))
    deflated = S.deflated(S.moments(chosen, "ret", ("strategy",), 252.0 * 24), len(GRID), ("strategy",))
    return S.gated(folds, S.random_half_overfit(hours), deflated, "vol_expansion_5", {"new_high_10": "high_auc", "new_low_10": "low_auc"})


add("full_validation", full_validation)


def ensemble(spark, sf_dir):
    """Scores of a volatility and two breakout models, resolved to signals and simulated."""
    f = L.price_targets(L.volatility_targets(scored(spark, sf_dir), (5,), regime_rows=100), (1.0,), (10,))
    members = V.walk_forward(V.numbered(f), 5, 10)
    p = K.ensemble_scores(members, ["rsi_14", "atr_14", "vol_p", "volume"], {"m_vol": "vol_expansion_5", "m_up": "new_high_10", "m_down": "new_low_10"})
    bars = scored(spark, sf_dir).select("symbol", "ts", "open", "high", "low", "close", "volume", "atr_7", "atr_14")
    tested = bars.join(p.select("symbol", "ts", "m_vol", "m_up", "m_down"), ["symbol", "ts"])
    return X.independent_trades(X.resolve_signals(tested, RULES, "m_vol", "m_up", "m_down", "atr_7", "atr_14"), RULES)


add("ensemble_backtest", ensemble)

