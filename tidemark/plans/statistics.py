"""Queries for validation statistics, quality scans, ranking and models."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions import normal
from tidemark.operators import labels as L
from tidemark.operators import metrics as G
from tidemark.operators import price as P
from tidemark.operators import quality as Q
from tidemark.operators import ranking as A
from tidemark.operators import splits as V
from tidemark.operators import technical as T
from tidemark.operators import validation as S
from tidemark.plans.catalog import add, hour_bars, table
from tidemark.plans.indicators import EPS, TR, ret
from tidemark.plans.research import DAYPNL, GRID_RETURNS, LEDGER, grid_returns, ledger
from tidemark.plans.sql import BARS, lag, normal_tail, over, roll, statement, uniform

RET = "r AS (SELECT *, " + ret(1) + " AS return_1 FROM bars)"


def returned(spark, sf_dir):
    return P.returns(hour_bars(spark, sf_dir), (1,)).where("return_1 is not null")


def daily(spark, sf_dir):
    return G.daily_pnl(ledger(spark, sf_dir))


# ---- dependence
LAGS = 10
ACF = f"""{DAYPNL}, c AS (SELECT model, date, pnl - avg(pnl) OVER (PARTITION BY model) AS d FROM days),
l AS (SELECT *, {", ".join(f"lag(d, {k}) OVER (PARTITION BY model ORDER BY date) AS l{k}" for k in range(1, LAGS + 1))} FROM c),
a AS ({" UNION ALL ".join(f"SELECT model, {k} AS lag, count(*) AS n, sum(d * l{k}) / sum(d * d) AS acf FROM l GROUP BY model" for k in range(1, LAGS + 1))})"""


def acf(spark, sf_dir):
    return S.autocorrelations(daily(spark, sf_dir), "pnl", LAGS, ("model",), "date")


add(
    "acf",
    lambda s, d: acf(s, d).select("model", "lag", "n", F.round("acf", 6).alias("acf"), F.round("z", 4).alias("z"), "significant"),
    f"WITH {ACF} SELECT model, lag, n, round(acf, 6) AS acf, round(acf * sqrt(n), 4) AS z, CAST(abs(acf * sqrt(n)) > 1.96 AS INTEGER) AS significant FROM a",
)
add(
    "ljung_box",
    lambda s, d: S.ljung_box(acf(s, d), ("model",)).select("model", "lags", F.round("q", 4).alias("q"), F.round("p_value", 6).alias("p_value")),
    f"""WITH {ACF}, b AS (SELECT model, max(lag) AS lags, any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - lag)) AS q FROM a GROUP BY model)
    SELECT model, lags, round(q, 4) AS q, round(greatest(0, 1 - list_sum(list_transform(range(0, 400), lambda k: exp((lags / 2 + k) * ln(q / 2) - q / 2 - lgamma(lags / 2 + k + 1))))), 6) AS p_value FROM b""",
)
add(
    "embargo_suggestion",
    lambda s, d: S.suggested_embargo(acf(s, d), ("model",)),
    f"WITH {ACF} SELECT model, coalesce(max(lag) FILTER (WHERE abs(acf * sqrt(n)) > 1.96), 1) AS embargo FROM a GROUP BY model",
)
MOM = """count(pnl) AS n, avg(pnl) AS mean, stddev_samp(pnl) AS std, avg(pnl) AS m1, avg(pnl * pnl) AS m2, avg(pnl * pnl * pnl) AS m3, avg(pnl * pnl * pnl * pnl) AS m4"""
MOMENTS = f"""{DAYPNL}, c AS (SELECT model, pnl, pnl - avg(pnl) OVER (PARTITION BY model) AS e FROM days),
mo AS (SELECT model, count(*) AS n, avg(pnl) AS mean, stddev_samp(pnl) AS std, avg(e * e * e) / pow(avg(e * e), 1.5) AS skew, avg(e * e * e * e) / pow(avg(e * e), 2) - 3 AS kurtosis FROM c GROUP BY model)"""


def moment_rows(spark, sf_dir):
    return S.moments(daily(spark, sf_dir), "pnl", ("model",))


add(
    "sharpe_moments",
    lambda s, d: moment_rows(s, d).select("model", "n", *[F.round(c, 2).alias(c) for c in ("mean", "std")], *[F.round(c, 6).alias(c) for c in ("skew", "kurtosis", "sharpe")]),
    f"WITH {MOMENTS} SELECT model, n, round(mean, 2) AS mean, round(std, 2) AS std, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(mean / std * sqrt(252), 6) AS sharpe FROM mo",
)
TRIALS = 81
_TOP = S.expected_max_sharpe(TRIALS)
_ROOT = (2 * math.log(TRIALS)) ** 0.5
_LOGS = _ROOT - (normal.EULER + math.log(2 * math.log(TRIALS))) / (2 * _ROOT)
for name, run, top, error in (
    ("deflated_sharpe", S.deflated, _TOP, "sqrt(greatest(v, 1e-10))"),
    ("deflated_sharpe_logs", S.deflated_by_logs, _LOGS, f"(sqrt(v) + {EPS})"),
):
    add(
        name,
        lambda s, d, f=run: f(moment_rows(s, d), TRIALS, ("model",)).select("model", *[F.round(c, 6).alias(c) for c in ("sharpe", "expected_max", "statistic", "p_value")]),
        f"""WITH {MOMENTS}, s AS (SELECT *, mean / std * sqrt(252) AS sr FROM mo), v AS (SELECT *, (1 + 0.5 * sr * sr - skew * sr + kurtosis / 4 * sr * sr) / (n - 1) AS v FROM s),
        t AS (SELECT model, sr, (sr - {top!r}::DOUBLE) / {error} AS x FROM v)
        SELECT model, round(sr, 6) AS sharpe, round({top!r}::DOUBLE, 6) AS expected_max, round(x, 6) AS statistic, round({normal_tail("x")}, 6) AS p_value FROM t""",
    )
add(
    "deflated_sharpe_bound",
    lambda s, d: S.deflated_by_bound(moment_rows(s, d), TRIALS, ("model",)).select("model", *[F.round(c, 6).alias(c) for c in ("sharpe", "expected_max", "statistic", "p_value")]),
    f"""WITH {MOMENTS}, s AS (SELECT *, mean / std AS sr FROM mo), v AS (SELECT *, (1 + 0.5 * sr * sr - skew * sr + kurtosis / 4 * sr * sr) / n AS v, {_ROOT!r}::DOUBLE / sr AS top FROM s),
    t AS (SELECT model, sr, top, (sr - top / sqrt(252)) / sqrt(v) AS x FROM v)
    SELECT model, round(sr * sqrt(252), 6) AS sharpe, round(top, 6) AS expected_max, round(x, 6) AS statistic, round({normal_tail("x")}, 6) AS p_value FROM t""",
)
BLK = f"""{DAYPNL}, k AS (SELECT model, pnl, row_number() OVER (PARTITION BY model ORDER BY date) - 1 AS r, count(*) OVER (PARTITION BY model) AS nn FROM days),
b AS (SELECT model, CAST(r // (nn // 16) AS INTEGER) AS block, count(*) AS n, sum(pnl) AS s, sum(pnl * pnl) AS ss FROM k WHERE r // (nn // 16) < 16 GROUP BY 1, 2)"""
add(
    "return_blocks",
    lambda s, d: S.blocks(daily(s, d), "pnl", 16, ("model",), "date").select("model", "block", "n", F.round("s", 2).alias("s")),
    f"WITH {BLK} SELECT model, block, n, round(s, 2) AS s FROM b",
)
add(
    "cscv",
    lambda s, d: S.symmetric_splits(S.blocks(daily(s, d), "pnl", 16, ("model",), "date"), 16, ("model",)).withColumn("p_overfit", F.round("p_overfit", 6)),
    f"""WITH {BLK}, h AS (SELECT m FROM (SELECT unnest(range(65536)) AS m) WHERE bit_count(m) = 8),
    x AS (SELECT model, m, (m >> block) & 1 AS i, sum(n) AS n, sum(s) AS s, sum(ss) AS ss FROM b, h GROUP BY ALL),
    y AS (SELECT model, m, i, (s / n) / (sqrt(greatest((ss - s * s / n) / (n - 1), 0)) + {EPS}) AS sr FROM x),
    z AS (SELECT model, m, max(sr) FILTER (WHERE i = 1) > max(sr) FILTER (WHERE i = 0) AS w FROM y GROUP BY model, m)
    SELECT model, round(avg(CASE WHEN w THEN 1 ELSE 0 END), 6) AS p_overfit, count(*) AS splits FROM z GROUP BY model""",
)
add(
    "stability_ratio",
    lambda s, d: S.stability(daily(s, d).withColumn("year", F.year("date")), "pnl", "year", ("model",)).select("model", *[F.round(c, 6).alias(c) for c in ("positive_share", "cv")], "periods", "stable"),
    f"""WITH {DAYPNL}, y AS (SELECT model, year(date) AS year, avg(pnl) / nullif(stddev_samp(pnl), 0) * sqrt(252) AS sr FROM days GROUP BY 1, 2),
    a AS (SELECT model, avg(CASE WHEN sr > 0 THEN 1 ELSE 0 END) AS ps, stddev_samp(sr) / (abs(avg(sr)) + {EPS}) AS cv, count(*) AS periods FROM y WHERE sr IS NOT NULL GROUP BY model)
    SELECT model, round(ps, 6) AS positive_share, round(cv, 6) AS cv, periods, CAST(ps >= 0.8 AND cv < 0.5 AS INTEGER) AS stable FROM a""",
)
add(
    "stationarity",
    lambda s, d: S.stationarity(hour_bars(s, d), "close").withColumn("statistic", F.round("statistic", 6)),
    f"""WITH {BARS}, c AS (SELECT symbol, {lag("close")} AS b, close - {lag("close")} AS c FROM bars)
    SELECT symbol, round(corr(b, c) * sqrt(count(*)), 6) AS statistic, CAST(corr(b, c) * sqrt(count(*)) < -2.86 AS INTEGER) AS stationary FROM c WHERE b IS NOT NULL GROUP BY symbol""",
)
add(
    "rank_overfit",
    lambda s, d: S.rank_overfit(_yearly(s, d), "year", "model", "inside", "outside").select(*[F.round(c, 6).alias(c) for c in ("pbo", "mean_logit")], "paths"),
    f"""WITH {DAYPNL}, y AS (SELECT year(date) AS year, model, avg(pnl) FILTER (WHERE month(date) <= 6) AS inside, avg(pnl) FILTER (WHERE month(date) > 6) AS outside FROM days GROUP BY 1, 2),
    k AS (SELECT *, row_number() OVER (PARTITION BY year ORDER BY inside DESC, model) AS i, rank() OVER (PARTITION BY year ORDER BY outside) AS o, count(*) OVER (PARTITION BY year) AS n FROM y WHERE inside IS NOT NULL AND outside IS NOT NULL),
    b AS (SELECT o / (n + 1) AS w FROM k WHERE i = 1)
    SELECT round(avg(CASE WHEN w <= 0.5 THEN 1 ELSE 0 END), 6) AS pbo, round(avg(ln(w / (1 - w))), 6) AS mean_logit, count(*) AS paths FROM b""",
)


def _yearly(spark, sf_dir):
    half = F.month("date") <= 6
    return daily(spark, sf_dir).groupBy(F.year("date").alias("year"), "model").agg(F.avg(F.when(half, F.col("pnl"))).alias("inside"), F.avg(F.when(~half, F.col("pnl"))).alias("outside")).dropna()


HALVES = f"""{GRID_RETURNS},
p AS (SELECT strategy, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS period, sum(ret) AS ret FROM w WHERE i >= 0 GROUP BY ALL),
tr AS (SELECT trial, strategy, ret, {uniform(11, "period", "trial")} < 0.5 AS inside FROM p, (SELECT unnest(range(1000)) AS trial)),
pf AS (SELECT trial, strategy, round(avg(ret) FILTER (WHERE inside) / (stddev_pop(ret) FILTER (WHERE inside) + {EPS}), 9) AS a, round(avg(ret) FILTER (WHERE NOT inside) / (stddev_pop(ret) FILTER (WHERE NOT inside) + {EPS}), 9) AS b FROM tr GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY trial ORDER BY a DESC, strategy) AS i, rank() OVER (PARTITION BY trial ORDER BY b) AS o, count(*) OVER (PARTITION BY trial) AS n FROM pf),
bs AS (SELECT o / (n + 1) AS x FROM rk WHERE i = 1)"""


def halves(spark, sf_dir):
    by_day = grid_returns(spark, sf_dir).groupBy("strategy", F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("long").alias("period"))
    return S.random_half_overfit(by_day.agg(F.sum("ret").alias("ret")))


add(
    "random_half_overfit",
    lambda s, d: halves(s, d).select(*[F.round(c, 6).alias(c) for c in ("pbo", "mean_logit")], "paths"),
    HALVES + " SELECT round(avg(CASE WHEN x <= 0.5 THEN 1 ELSE 0 END), 6) AS pbo, round(avg(ln(x / (1 - x))), 6) AS mean_logit, count(*) AS paths FROM bs",
)

# ---- quality
OK = "high >= low AND high >= open AND high >= close AND low <= open AND low <= close"
add(
    "ohlc_quality",
    lambda s, d: Q.bar_quality(hour_bars(s, d)).withColumn("null_share", F.round("null_share", 6)),
    f"""WITH {BARS} SELECT symbol, count(*) AS rows, 0.0::DOUBLE AS null_share, count(*) FILTER (WHERE NOT ({OK})) AS broken, 0::BIGINT AS repeated,
    count(*) FILTER (WHERE volume < 0) AS negative_volume, count(*) FILTER (WHERE volume = 0) AS no_volume FROM bars GROUP BY symbol""",
)
add(
    "bar_profile",
    lambda s, d: Q.profile(hour_bars(s, d)),
    f"""WITH {BARS} SELECT symbol, count(*) AS rows, min(ts) AS first, max(ts) AS last, count(DISTINCT CAST(ts AS DATE)) AS days, min(low) AS lowest, max(high) AS highest,
    count(*) FILTER (WHERE close IS NULL) AS null_close FROM bars GROUP BY symbol""",
)
add(
    "gap_profile",
    lambda s, d: Q.gaps(hour_bars(s, d), 60).select("symbol", "gaps", *[F.round(c, 6).alias(c) for c in ("longest_minutes", "missing_bars")]),
    f"""WITH {BARS}, g AS (SELECT symbol, date_diff('minute', {lag("ts")}, ts) AS m FROM bars)
    SELECT symbol, count(*) AS gaps, round(max(m)::DOUBLE, 6) AS longest_minutes, round(sum(m / 60.0 - 1)::DOUBLE, 6) AS missing_bars FROM g WHERE m > 60 GROUP BY symbol""",
)
FEATURES = ["open", "high", "low", "close", "volume", "atr_14", "return_1"]


def featured(spark, sf_dir):
    return L.pipeline_targets(P.returns(P.atr(hour_bars(spark, sf_dir), (14,)), (1,)))


FEAT = f"""{BARS}, f0 AS (SELECT *, {TR} AS tr, {ret(1)} AS return_1, CAST(coalesce(lead(close) OVER (PARTITION BY symbol ORDER BY ts) > close, false) AS INTEGER) AS y,
  lead(close) OVER (PARTITION BY symbol ORDER BY ts) / nullif(close, 0) - 1 AS next_return FROM bars),
f AS (SELECT *, {roll("avg", "tr", 14)} AS atr_14 FROM f0)"""
add(
    "feature_quality",
    lambda s, d: Q.feature_quality(featured(s, d), FEATURES, "target_direction_1").select("feature", *[F.round(c, 6).alias(c) for c in ("null_share", "largest_z", "target_corr")], "constant", "outlier", "class"),
    f"WITH {FEAT}, q AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, 1 - count({c}) / count(*) AS null_share, var_samp({c}) AS v, greatest((max({c}) - avg({c})) / sqrt(var_samp({c})), (avg({c}) - min({c})) / sqrt(var_samp({c}))) AS z, corr({c}, y) AS r FROM f"
        for c in FEATURES
    )
    + """) SELECT feature, round(null_share, 6) AS null_share, round(z, 6) AS largest_z, round(r, 6) AS target_corr, CAST(v < 1e-10 AS INTEGER) AS constant, CAST(z > 10 AS INTEGER) AS outlier,
    CASE WHEN abs(r) > 0.95 THEN 'leakage' WHEN abs(r) > 0.8 THEN 'likely' WHEN abs(r) > 0.5 THEN 'suspicious' ELSE 'legitimate' END AS class FROM q""",
)
add(
    "perfect_predictors",
    lambda s, d: Q.perfect_predictors(featured(s, d).withColumn("copy", F.col("target_direction_1") * 2), ["volume", "copy"], "target_direction_1"),
    f"WITH {FEAT}, q AS (SELECT 'volume' AS feature, volume AS x, y FROM f UNION ALL SELECT 'copy', y * 2, y FROM f), "
    "k AS (SELECT feature, x, count(DISTINCT y) AS k FROM q GROUP BY 1, 2) SELECT feature, max(k) AS classes, count(*) AS \"values\", CAST(max(k) = 1 AS INTEGER) AS perfect FROM k GROUP BY feature",
)
add(
    "class_spread",
    lambda s, d: Q.class_spread(featured(s, d).withColumn("flat", F.lit(1.0)), ["close", "flat"], "target_direction_1").select("feature", F.col("target_direction_1").alias("y"), F.round("std", 6).alias("std"), "degenerate"),
    f"WITH {FEAT}, q AS (SELECT 'close' AS feature, close AS x, y FROM f UNION ALL SELECT 'flat', 1.0, y FROM f) "
    "SELECT feature, y, round(stddev_samp(x), 6) AS std, CAST(stddev_samp(x) < 1e-10 AS INTEGER) AS degenerate FROM q GROUP BY feature, y",
)
SCAN = ["close", "atr_14", "return_1"]
add(
    "leakage_scan",
    lambda s, d: Q.lookahead_scan(featured(s, d), SCAN, "return_1").select("feature", *[F.round(c, 6).alias(c) for c in ("past", "future")], "suspicious"),
    f"WITH {FEAT}, n AS (SELECT *, lead(return_1) OVER (PARTITION BY symbol ORDER BY ts) AS nx FROM f) "
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr({c}, return_1), 6) AS past, round(corr({c}, nx), 6) AS future, CAST(coalesce(abs(corr({c}, nx)) > 0.3, false) AS INTEGER) AS suspicious FROM n" for c in SCAN),
)

# ---- ranking
add(
    "impute_median",
    lambda s, d: A.impute_median(featured(s, d), ["atr_14", "return_1"]).select("symbol", "ts", *[F.round(c, 6).alias(c) for c in ("atr_14", "return_1")]),
    f"WITH {FEAT}, m AS (SELECT median(atr_14) AS a, median(return_1) AS r FROM f) SELECT symbol, ts, round(coalesce(atr_14, a), 6) AS atr_14, round(coalesce(return_1, r), 6) AS return_1 FROM f, m",
)
PRUNED = ["open", "high", "low", "close", "volume", "atr_14"]
PAIRS = [(a, b) for i, a in enumerate(PRUNED) for b in PRUNED[i + 1 :]]
add(
    "corr_prune_matrix",
    lambda s, d: A.correlation_matrix(featured(s, d), PRUNED).withColumn("corr", F.round("corr", 6)),
    f"WITH {FEAT}, c AS (SELECT * FROM f WHERE atr_14 IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM c" for a, b in PAIRS),
)


def pruned_columns(spark, sf_dir):
    keep = A.prune(A.impute_median(featured(spark, sf_dir), PRUNED), PRUNED, "target_direction_1", 0.8)
    return spark.createDataFrame([(c,) for c in keep], "feature string")


add("corr_prune", pruned_columns)
add(
    "spearman_rank",
    lambda s, d: A.spearman(featured(s, d).where("target_return_1 is not null"), ["close", "volume", "return_1"], "target_return_1").withColumn("score", F.round("score", 6)),
    f"WITH {FEAT}, q AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, next_return AS y FROM f WHERE next_return IS NOT NULL AND {c} IS NOT NULL" for c in ("close", "volume", "return_1"))
    + """), r AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS rx,
      rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2 AS ry FROM q) SELECT feature, round(corr(rx, ry), 6) AS score FROM r GROUP BY feature""",
)
add(
    "rank_auc",
    lambda s, d: A.auc(featured(s, d), "close", "target_direction_1", ("symbol",)).withColumn("auc", F.round("auc", 6)),
    f"""WITH {FEAT}, r AS (SELECT symbol, y, rank() OVER (PARTITION BY symbol ORDER BY close) + (count(*) OVER (PARTITION BY symbol, close) - 1) / 2 AS k FROM f)
    SELECT symbol, round((sum(k) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2) / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 6) AS auc FROM r GROUP BY symbol""",
)
SC = "(close - low) / (high - low + 1e-10)"
add(
    "classification_metrics",
    lambda s, d: A.classification_metrics(featured(s, d).withColumn("p", F.expr(SC)), "p", "target_direction_1", ("symbol",)).select(
        "symbol", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("logloss", "brier", "accuracy", "precision", "recall", "f1", "auc")]
    ),
    f"""WITH {FEAT}, q AS (SELECT symbol, y, {SC} AS p, least(greatest({SC}, 1e-15), 1 - 1e-15) AS s FROM f),
    r AS (SELECT *, rank() OVER (PARTITION BY symbol ORDER BY p) + (count(*) OVER (PARTITION BY symbol, p) - 1) / 2 AS k FROM q),
    c AS (SELECT symbol, count(*) FILTER (WHERE p >= 0.5 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND y = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND y = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND y = 0) AS tn,
      avg(CASE WHEN y = 1 THEN -ln(s) ELSE -ln(1 - s) END) AS logloss, avg(pow(p - y, 2)) AS brier, sum(k) FILTER (WHERE y = 1) AS u, sum(y) AS np, count(*) - sum(y) AS nq FROM r GROUP BY symbol)
    SELECT symbol, tp, fp, fn, tn, round(logloss, 6) AS logloss, round(brier, 6) AS brier, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision,
    round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((u - np * (np + 1) / 2) / (np * nq), 6) AS auc FROM c""",
)
MODEL = ["return_1", "atr_14", "volume", "close"]
LONG = ", ".join(["q AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, y FROM f WHERE {c} IS NOT NULL" for c in MODEL) + ")"])
INFO = f"""{FEAT}, {LONG}, bk AS (SELECT feature, y, (rank() OVER (PARTITION BY feature ORDER BY x) - 1) * 16 // count(*) OVER (PARTITION BY feature) AS b FROM q),
nb AS (SELECT feature, b, y, count(*)::DOUBLE AS n FROM bk GROUP BY ALL), pb AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, b) AS l, sum(n) OVER (PARTITION BY feature, y) AS r FROM nb),
info AS (SELECT feature, sum(n / t * ln(n * t / (l * r))) AS score FROM pb GROUP BY feature)"""
add(
    "mutual_information",
    lambda s, d: A.mutual_information(featured(s, d), MODEL, "target_direction_1").withColumn("score", F.round("score", 6)),
    f"WITH {INFO} SELECT feature, round(score, 6) AS score FROM info",
)
add(
    "f_test_rank",
    lambda s, d: A.f_scores(featured(s, d), MODEL, "target_direction_1").withColumn("score", F.round("score", 4)),
    f"WITH {FEAT}, q AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, y FROM f WHERE {c} IS NOT NULL" for c in MODEL)
    + """), d AS (SELECT *, avg(x) OVER (PARTITION BY feature) AS gm, avg(x) OVER (PARTITION BY feature, y) AS cm FROM q)
    SELECT feature, round((sum((cm - gm) * (cm - gm)) / (count(DISTINCT y) - 1)) / (sum((x - cm) * (x - cm)) / (count(*) - count(DISTINCT y))), 4) AS score FROM d GROUP BY feature""",
)
add("forest_importance", lambda s, d: A.forest_importance(featured(s, d), MODEL, "target_direction_1"))
add(
    "mean_rank",
    lambda s, d: A.mean_rank([A.spearman(featured(s, d), MODEL, "target_direction_1"), A.mutual_information(featured(s, d), MODEL, "target_direction_1")]),
    f"""WITH {INFO}, sr AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2 AS ry FROM q),
    a AS (SELECT feature, abs(corr(rx, ry)) AS s, 0 AS m FROM sr GROUP BY feature UNION ALL SELECT feature, abs(score), 1 FROM info),
    k AS (SELECT feature, rank() OVER (PARTITION BY m ORDER BY s DESC) AS r FROM a) SELECT feature, avg(r) AS mean_rank FROM k GROUP BY feature""",
)


def folds(spark, sf_dir):
    f = featured(spark, sf_dir)
    return V.walk_forward(V.numbered(f), 5, 10)


for kind in ("gbt", "logistic"):
    add(f"walk_forward_{kind}_auc", lambda s, d, k=kind: A.auc(A.fold_scores(folds(s, d), MODEL, "target_direction_1", k), "score", "target_direction_1", ("fold",)))
