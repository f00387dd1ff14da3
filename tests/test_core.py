import json
import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.functions import normal
from tidemark.functions.frames import Frames
from tidemark.operators import labels as L
from tidemark.operators import price as P
from tidemark.operators import quality as Q
from tidemark.operators import signals as X
from tidemark.operators import splits as V
from tidemark.operators import technical as T
from tidemark.operators import validation as S
from tidemark.operators import vectors
from tidemark.operators.recursive import ema, hurst_of
from tidemark.plans import ORACLES, QUERIES
from tidemark.plans.catalog import hour_bars
from tidemark.functions.rows import row_numbers
from tidemark.plans.halo import chunked
from tidemark.sources import files
from tidemark.sources.series import DailySeries
from tidemark.streaming import bars as SB
from tidemark.streaming import serving

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def comparable(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        df[c] = df[c].astype(float).round(5) + 0.0 if df[c].dtype.kind in "fiu" else df[c].astype(str)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    got, want = comparable(QUERIES[name](spark, sf).toPandas()), comparable(duck.execute(ORACLES[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    for c in got:
        same = (got[c] == want[c]) | (got[c].isna() & want[c].isna())
        if got[c].dtype.kind == "f":
            same |= np.isclose(got[c].astype(float), want[c].astype(float), rtol=1e-6, atol=2e-5)
        assert same.all(), (c, got[~same].head(2), want[~same].head(2))


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


#: Queries of fitted models: what must hold for each result.
FITTED = {
    "mixture_regimes": lambda df: set(df.mixture) <= {0, 1, 2, 3} and df.mixture.nunique() >= 2 and df.mixture_p.between(0.25, 1.000001).all(),
    "corr_prune": lambda df: {"volume", "atr_14"} <= set(df.feature) < {"open", "high", "low", "close", "volume", "atr_14"},
    "forest_importance": lambda df: abs(df.score.sum() - 1) < 1e-9 and (df.score >= 0).all(),
    "direction_leak": lambda df: set(df.direction) == {"forward", "reverse"} and df.auc.between(0, 1).all(),
    # closes are independent draws, so a high one is mostly followed by a lower one: five in six at best
    "walk_forward_gbt_auc": lambda df: df.auc.between(0.7, 0.9).all(),
    "walk_forward_logistic_auc": lambda df: df.auc.between(0.7, 0.9).all(),
    "full_validation": lambda df: len(df) == 1 and (df.overall_pass == (df.cpcv_pass & df.pbo_pass & df.dsr_pass)).all() and df.trials.eq(1000).all() and df.folds.between(5, 15).all(),
    "ensemble_backtest": lambda df: (df.exit_time > df.entry_time).all() and set(df.exit_reason) <= {"tp", "sl", "time"},
}


def test_all_queries_have_sql_or_a_check():
    assert set(QUERIES) - set(ORACLES) == set(FITTED)


@pytest.mark.parametrize("name", sorted(FITTED))
def test_fitted_queries(spark, sf, name):
    out = QUERIES[name](spark, "/root/testdata/sf0.01" if "walk" in name or "ensemble" in name else sf).toPandas()
    assert len(out) and FITTED[name](out)


def series(spark, n=120, symbols=("a", "b"), seed=1):
    rng = random.Random(seed)
    rows = []
    for s in symbols:
        price = 100.0
        for i in range(n):
            o, price = price, max(1.0, price + rng.gauss(0, 1))
            rows.append((s, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), o, max(o, price) + rng.random(), min(o, price) - rng.random(), price, rng.randrange(1, 50)))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "ts", "open", "high", "low", "close", "volume"]))


def wide(b):
    return T.rsi(T.bollinger(P.atr(T.moving_averages(b, (5, 20))), squeeze=20))


def test_later_bars_never_change_earlier_values(spark):
    full = series(spark)
    cut = full.where("ts < '2024-01-04'")
    early = wide(full).where("ts < '2024-01-04'").toPandas()
    assert comparable(early).equals(comparable(wide(cut).toPandas()))


def test_row_order_and_other_symbols_do_not_matter(spark):
    b = series(spark)
    assert comparable(wide(b.orderBy(F.rand(3))).toPandas()).equals(comparable(wide(b).toPandas()))
    assert comparable(wide(b.where("symbol = 'a'")).toPandas()).equals(comparable(wide(b).where("symbol = 'a'").toPandas()))


def test_feature_plans_do_not_look_ahead(spark):
    b = series(spark)
    assert not Q.looks_ahead(wide(b)) and not Q.looks_ahead(vectors.model_vector(b))
    assert Q.looks_ahead(L.trend_targets(b))
    assert Q.suspect_names(["rsi_14", "future_rv", "target_x"]) == ["future_rv", "target_x"]


def test_pandas_semantics(spark):
    b = series(spark, symbols=("a",))
    p = b.toPandas().sort_values("ts")
    got = T.rsi(P.atr(b, (14,)), (14,)).withColumn("sd", Frames().std("close", 10)).toPandas().sort_values("ts")
    prev = p.close.shift(1)
    tr = pd.concat([p.high - p.low, (p.high - prev).abs(), (p.low - prev).abs()], axis=1).max(axis=1)
    assert np.allclose(got.atr_14, tr.rolling(14).mean(), equal_nan=True)
    assert np.allclose(got.sd, p.close.rolling(10).std(), equal_nan=True)
    d = p.close.diff()
    gain, loss = d.where(d > 0, 0).rolling(14).mean(), (-d.where(d < 0, 0)).rolling(14).mean()
    assert np.allclose(got.rsi_14, 100 - 100 / (1 + gain / (loss + 1e-10)), equal_nan=True)


@pytest.mark.parametrize(("rows", "long"), [(7, False), (1000, False), (9, True)])
def test_ema_in_chunks_is_the_whole_fold(spark, rows, long):
    b = series(spark).withColumn("x", F.when((F.col("ts") < "2024-01-01 03:00:00") | (F.col("volume") % 7 == 0), None).otherwise(F.col("close")))
    got = ema(b, {"e": ("x", 12), "f": ("close", 5)}, chunk_rows=rows, long_series=long).toPandas().sort_values(["symbol", "ts"])
    for _, g in got.groupby("symbol"):
        assert np.allclose(g.f, g.close.ewm(span=5, adjust=False).mean())
        want, last = [], np.nan
        for v in g.x:
            last = last if v != v else v if last != last else last + (v - last) * 2 / 13
            want.append(last)
        assert np.allclose(g.e, want, equal_nan=True)


def test_hurst_of_a_walk_and_of_noise():
    rng = np.random.default_rng(0)
    assert hurst_of(np.ones(50)) != hurst_of(np.ones(50))  # undefined
    assert 0 <= hurst_of(rng.normal(size=100)) <= 1


def test_halo_chunks_equal_whole_series(spark):
    b = series(spark, 150)
    op = lambda df, fr: T.bollinger(P.atr(df, (14,), fr), 20, 2.0, 20, fr)
    assert comparable(chunked(b, op, 60, 61).toPandas()).equals(comparable(op(b, Frames()).toPandas()))
    n = row_numbers(b, ("symbol",), "ts").toPandas().sort_values(["symbol", "ts"])
    assert n.groupby("symbol")["_row"].apply(list).tolist() == [list(range(150))] * 2


def walk_labels(rows, b):
    """First touch by a plain loop."""
    out = []
    for i, (h, l, c, a) in enumerate(rows):
        if i >= len(rows) - b.holding or a is None or a != a:
            out.append((0, 0))
            continue
        for j in range(i + 1, i + b.holding + 1):
            if rows[j][0] >= c + b.upper * a:
                out.append((1, j - i))
                break
            if rows[j][1] <= c - b.lower * a:
                out.append((-1, j - i))
                break
        else:
            r = rows[i + b.holding][2] / c - 1
            out.append((0 if abs(r) < b.flat else 1 if r > 0 else -1, b.holding))
    return out


def test_triple_barrier_is_the_loop(spark):
    b = series(spark, 200)
    for preset in L.PRESETS.values():
        got = L.triple_barrier(P.atr(b, (14,)), preset).toPandas().sort_values(["symbol", "ts"])
        for _, g in got.groupby("symbol"):
            rows = list(zip(g.high, g.low, g.close, g.atr_14))
            assert list(zip(g.tb_label, g.tb_holding)) == walk_labels(rows, preset)


def test_splits_do_not_leak(spark):
    n = V.numbered(series(spark, 120).select("symbol", "ts"))
    horizon = 6
    n = n.withColumn("t1", F.least(F.col("row_no") + horizon, F.col("rows") - 1))
    for members in (V.rolling(n, 40, 10, 5), V.walk_forward(n, 4, 5), V.purged(n, 4, horizon, 5), V.combinatorial(n, 6, 2, "t1", 0.02)):
        pdf = members.where("symbol = 'a'").toPandas()
        assert len(pdf)
        for _, f in pdf.groupby("fold"):
            train, test = set(f[f.role == "train"].row_no), set(f[f.role == "test"].row_no)
            assert not train & test
    pdf = V.purged(n, 4, horizon, 5).where("symbol = 'a'").toPandas()
    for _, f in pdf.groupby("fold"):
        first = f[f.role == "test"].row_no.min()
        assert not ((f.role == "train") & (f.row_no < first) & (f.row_no >= first - horizon)).any()
    assert V.embargo_rows(10, 200) == 200 and V.embargo_rows(10, 20, 5, 390, 1) == 78


def test_one_position_at_a_time():
    rng = random.Random(2)
    n = 400
    ts = pd.date_range("2024-01-01", periods=n, freq="5min")
    close = np.cumsum([rng.gauss(0, 1) for _ in range(n)]) + 1000
    frame = pd.DataFrame({"ts": ts, "close": close, "high": close + 1, "low": close - 1, "score": [rng.random() for _ in range(n)]})
    limits = X.Limits(hold_bars=5, max_daily_trades=4, stop_ticks=8, target_ticks=12)
    trades = X.walk_one_position(frame, limits, X.Rules())
    assert trades and all(a["exit_time"] <= b["entry_time"] for a, b in zip(trades, trades[1:]))
    assert all(t["bars_held"] <= 5 and t["mfe"] >= 0 and t["mae"] >= 0 for t in trades)
    days = pd.Series([t["entry_time"].date() for t in trades]).value_counts()
    assert days.max() <= 4
    again = X.walk_reentry(frame.assign(direction=[1 if s > 0.9 else 0 for s in frame.score], atr=1.0), 10, 2.0, 1.0, X.Rules())
    assert all(t["exit_reason"] in ("tp", "sl", "time") for t in again) and again


def test_closed_forms():
    assert abs(normal.chi2_tail(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(normal.chi2_tail(18.307038053275146, 10) - 0.05) < 1e-9
    assert abs(normal.student_tail(2.228138851964939, 10) - 0.05) < 1e-6
    assert S.expected_max_sharpe(1) == 0 and S.expected_max_sharpe(100) > S.expected_max_sharpe(10) > 0
    assert S.deflated_sharpe(3.0, 81, 500).p_value < S.deflated_sharpe(2.5, 81, 500).p_value
    assert S.deflated_sharpe_log(2.0, 256, 500, 0.0, 0.0).p_value > 0
    assert S.verdict(0.2, 0.01, True, 0.9) == "robust" and S.verdict(0.9, 0.5, False, 0.1) == "overfit"


def test_model_vector_has_its_contract(spark):
    out = vectors.model_vector(series(spark))
    assert len(vectors.VECTOR) == 42 and set(vectors.VECTOR) <= set(out.columns)
    assert out.dropna(subset=vectors.VECTOR).count() == 2 * (120 - 49)
    late = vectors.barrier_inputs(series(spark)).where("symbol = 'a'").toPandas().sort_values("ts")
    assert np.allclose(late.momentum_late5, late.close.shift(1) / late.close.shift(6) - 1, equal_nan=True)


def test_files(spark, tmp_path):
    (tmp_path / "m.txt").write_text("20240102 083000;1;2;0.5;1.5;10\n20240702 083000;1;2;0.5;1.5;10\n")
    rows = files.minute_text(spark, f"file://{tmp_path}/m.txt", "ES").orderBy("ts").collect()
    assert [str(r.ts) for r in rows] == ["2024-01-02 14:30:00", "2024-07-02 13:30:00"]
    (tmp_path / "t.txt").write_text("20181220 000001 8960000;10.5;2\n20181220 000001 12;10.5;2\n20181220 000001;10.5;2\n")
    ticks = files.tick_text(spark, f"file://{tmp_path}/t.txt", "ES", "UTC").orderBy("ts").collect()
    assert [r.ts.microsecond for r in ticks] == [0, 120000, 896000]
    (tmp_path / "b.csv").write_text("TS_Event,O,H,L,C,V\n2024-01-02T00:00:00,1,2,0,1,5\n2024-01-03T00:00:00,x,2,0,1,5\n")
    assert files.bar_csv(spark, f"file://{tmp_path}/b.csv", "ES").count() == 1
    assert files.first_available(spark, [("csv", f"file://{tmp_path}/none.csv"), ("csv", f"file://{tmp_path}/b.csv")], "ES").count() == 1
    with pytest.raises(FileNotFoundError):
        files.first_available(spark, [("csv", f"file://{tmp_path}/none.csv")], "ES")
    (tmp_path / "p.csv").write_text("some words\nmore\nTrade Date,Call Volume,Put Volume,Total Volume\n1/2/2024,100,50,150\n1/3/2024,0,50,50\nbad,,,\n")
    pcr = files.put_call_csv(spark, f"file://{tmp_path}/p.csv").collect()
    assert [(str(r.date), r.pcr_total) for r in pcr] == [("2024-01-02", 0.5)]
    (tmp_path / "d.csv").write_text("Date,Adj Close\n2024-01-02 00:00:00,13.5\n")
    assert files.daily_csv(spark, f"file://{tmp_path}/d.csv", "vix").first().vix == 13.5
    b = series(spark)
    files.write_bars(b, f"file://{tmp_path}/bars")
    back = files.read_bars(spark, f"file://{tmp_path}/bars", ["a"], "2024-01-02", "2024-01-03")
    assert back.count() == 48
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "symbol" in plan.split("PartitionFilters")[1].split("]")[0]


def test_series_source(spark):
    spark.dataSource.register(DailySeries)
    df = spark.read.format("daily_series").option("series", "vix").option("first", 2020).option("last", 2021).load()
    assert df.count() == 366 + 365 and df.where("value < 9").count() == 0


def stamped(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp"), F.col("value").alias("price"))


def test_stream_of_ticks_gives_the_batch_bars(spark, sf, tmp_path):
    ticks = stamped(spark, sf)
    src = f"file://{tmp_path}/ticks"
    ticks.orderBy("ts").repartitionByRange(6, "ts").write.parquet(src)
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 2).parquet(src)
    q = SB.bar_stream(stream, 60, "40 days").writeStream.format("memory").queryName("bars_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("bars_out").toPandas()
    want = SB.batch_bars(ticks, 60).toPandas()
    assert comparable(got).equals(comparable(want))


def test_rolling_columns_over_a_stream_equal_batch(spark, tmp_path):
    b = series(spark, 90)
    src, out = f"file://{tmp_path}/bars", f"file://{tmp_path}/out"
    for i in range(3):
        b.where((F.hour("ts") + 24 * F.dayofmonth("ts") - 24).between(30 * i, 30 * i + 29)).coalesce(1).write.mode("append").parquet(src)
    rolling = SB.RollingColumns(lambda df: P.atr(df, (14,)), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/{n}"), f"file://{tmp_path}/state", rows=20, only_full=False)
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(src)
    q = stream.writeStream.foreachBatch(rolling).option("checkpointLocation", f"file://{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    got = spark.read.parquet(*[f"{out}/{i}" for i in range(3)]).toPandas()
    assert comparable(got).equals(comparable(P.atr(b, (14,)).toPandas()))


def test_warm_up_counts_over_batches(spark, tmp_path):
    b = series(spark, 30)
    src = f"file://{tmp_path}/bars"
    b.where("ts < '2024-01-01 12:00:00'").coalesce(1).write.parquet(src)
    b.where("ts >= '2024-01-01 12:00:00'").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = serving.warm_up(stream, 20).writeStream.format("memory").queryName("warm").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("warm").where("symbol = 'a'").orderBy("seen").collect()
    assert [r.seen for r in rows] == list(range(1, 31)) and sum(r.ready for r in rows) == 11


def test_requests_and_decisions(spark):
    bar = {"type": "BAR_UPDATE", "symbol": "a", "close": 1.0, "position": 1}
    lines = [json.dumps(bar), json.dumps(bar | {"position": -1}), json.dumps(bar | {"features": [1.0] * 41}), '{"type": "HEARTBEAT", "timestamp": "t"}', '{"type": "STATUS"}', '{"type": "X"}', "no json"]
    df = serving.parsed(spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "n int, value string"))
    answered = serving.responses(df, {"vol": F.lit(0.6), "up": F.lit(0.7), "down": F.lit(0.2)})
    got = [json.loads(r.response) for r in answered.orderBy("n").collect()]
    assert [g.get("action") for g in got[:3]] == ["FLAT", "LONG", "FLAT"] and got[0]["reason"] == "already long" and "42" in got[2]["reason"]
    assert [g["type"] for g in got[3:]] == ["HEARTBEAT_ACK", "STATUS", "ERROR", "ERROR"]
    assert {r.reason: r.n for r in serving.rejections(answered).collect()} == {"already long": 1, "expected 42 features": 1}
    assert serving.gap_alerts(series(spark).where("hour(ts) not in (5, 6)")).count() > 0


def test_constant_prices_have_defined_columns(spark):
    rows = [("a", pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), 5.0, 5.0, 5.0, 5.0, 0) for i in range(60)]
    b = spark.createDataFrame(pd.DataFrame(rows, columns=["symbol", "ts", "open", "high", "low", "close", "volume"]))
    last = wide(b).orderBy(F.desc("ts")).first()
    assert last.rsi_14 == 0.0 and last.atr_14 == 0.0 and math.isfinite(last.bb_pct)


def test_queries_named_for_boosting_fit_it(spark, sf, monkeypatch):
    from tidemark.operators import composites, ranking

    class Found(Exception):
        pass

    def boosted(*_, **__):
        raise Found("gbt")

    def other(kind, *_):
        raise Found(kind)

    monkeypatch.setattr(ranking, "boosted_scores", boosted)
    monkeypatch.setattr(composites, "boosted_scores", boosted)
    monkeypatch.setattr(ranking, "pipeline", other)
    for name, kind in (("walk_forward_gbt_auc", "gbt"), ("walk_forward_logistic_auc", "logistic"), ("ensemble_backtest", "gbt")):
        with pytest.raises(Found, match=f"^{kind}$"):
            QUERIES[name](spark, sf)


def test_draws_are_even_and_equal_their_sql(spark, duck):
    from tidemark.functions.draws import uniform
    from tidemark.plans.sql import uniform as uniform_sql

    got = spark.range(200).select(F.col("id").alias("r"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("s")).select("r", "s", uniform(7, "r", "s").alias("u")).toPandas()
    want = duck.execute(f"SELECT r, s, {uniform_sql(7, 'r', 's')} AS u FROM (SELECT unnest(range(200)) AS r), (SELECT unnest(range(100)) AS s)").df()
    both = got.merge(want, on=["r", "s"])
    assert len(both) == 20_000 and (both.u_x == both.u_y).all()
    assert ((both.u_x >= 0) & (both.u_x < 1)).all() and abs(np.histogram(both.u_x, 20, (0, 1))[0] - 1000).max() < 150
    wide = got.pivot(index="r", columns="s", values="u").to_numpy()
    assert abs(np.corrcoef(wide[:, 0], wide[:, 1])[0, 1]) < 0.25 and abs(np.corrcoef(wide[:, 3], np.arange(200))[0, 1]) < 0.25


def test_ranks_by_pieces_equal_ranks_of_whole_groups(spark):
    from tidemark.functions.rows import sums_before, value_ranks

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(40) / 4 if rng.random() > 0.1 else None) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, x double")
    got = {(r.k, r.x): (r.n, r.before) for r in value_ranks(df, ("k",), "x", pieces=7).collect()}
    low = lambda x: -1 if x is None else x
    for k, x in set(rows):
        assert got[k, x] == (rows.count((k, x)), sum(a == k and low(b) < low(x) for a, b in rows))
    assert sums_before(df.limit(0), ("k",), "x", F.lit(1), "n").count() == 0


def test_exponential_averages_equal_a_plain_loop(spark):
    from tidemark.operators.recursive import fold

    rng = np.random.default_rng(3)
    for span in (1, 2, 9, 200):
        for start in (None, 5.0):
            x = rng.normal(size=700)
            x[rng.random(700) < 0.2] = np.nan
            x[:3] = np.nan
            alpha, last, want = 2 / (span + 1), np.nan if start is None else start, []
            for v in x:
                if v == v:
                    last = v if last != last else alpha * v + (1 - alpha) * last
                want.append(last)
            assert np.allclose(fold(x, alpha, start), want, rtol=1e-11, atol=1e-12, equal_nan=True)
    assert len(fold(np.array([]), 0.5, None)) == 0 and np.isnan(fold(np.array([np.nan]), 0.5, None)).all()


def plain_positions(rows, min_vol, least, k):
    """Bar by bar: what the threshold strategies return."""
    out, held, n = [], None, len(rows)
    for i, r in enumerate(rows):
        gain = 0.0
        if i == n - 1:
            out.append(-k.cost * held["scale"] / 2 if held else 0.0)
            break
        if held:
            nxt = rows[i + 1]
            held["bars"] += 1
            s, e, a = held["side"], held["entry"], held["atr"]
            gain = s * held["scale"] * (nxt["close"] / r["close"] - 1)
            worst, best = (nxt["low"], nxt["high"]) if s > 0 else (-nxt["high"], -nxt["low"])
            if worst <= s * e - k.stop_atr * a or best >= s * e + k.target_atr * a or held["bars"] >= k.hold_bars:
                gain -= k.cost * held["scale"] / 2
                held = None
        elif r["vol_p"] >= min_vol:
            up, down = r["up_p"] >= least, r["down_p"] >= least
            side = (1 if r["up_p"] > r["down_p"] else -1) if up and down else int(up) - int(down)
            if side:
                scale = max(1, min(k.max_contracts, int(k.base_contracts * min(2.0, max(0.5, r["atr"] / (r["predicted_atr"] + 1e-10))))))
                held = {"side": side, "entry": r["close"], "atr": r["atr"], "bars": 0, "scale": scale / k.base_contracts}
                gain = -k.cost * held["scale"] / 2
        out.append(gain)
    return out


def test_grid_returns_equal_a_bar_by_bar_walk():
    from tidemark.operators import signals as X

    rng = random.Random(5)
    for trial in range(30):
        price, rows = 100.0, []
        for _ in range(rng.choice((1, 2, 40, 200))):
            price += rng.gauss(0, 1)
            rows.append({"close": price, "high": price + rng.random(), "low": price - rng.random(), "atr": 0.5 + rng.random(), "predicted_atr": 0.5 + rng.random(), "vol_p": rng.random(), "up_p": rng.random(), "down_p": rng.random()})
        k = X.GridRules(base_contracts=1 + trial % 2, hold_bars=(3, 30)[trial % 2])
        frame = pd.DataFrame(rows).assign(min_vol=0.4, min_breakout=0.6)
        assert np.allclose(X.grid_positions(frame, k), plain_positions(rows, 0.4, 0.6, k), atol=1e-12)


def test_excursions_keep_every_trade(spark):
    from tidemark.operators import signals as X

    t = lambda x: pd.Timestamp(x).to_pydatetime()
    trade = ("a", t("2024-01-01 01:00"), t("2024-01-01 03:00"), "LONG", 2, 100.0)
    trades = spark.createDataFrame([trade, trade, ("b", *trade[1:])], "symbol string, entry_time timestamp, exit_time timestamp, direction string, contracts int, entry_price double")
    bars = spark.createDataFrame([("a", t(f"2024-01-01 0{h}:00"), 100.0 + h, 99.0 - h) for h in range(6)], "symbol string, ts timestamp, high double, low double")
    got = sorted((r.symbol, r.mfe, r.mae_ticks) for r in X.excursions(trades, bars, X.Rules()).collect())
    assert got == [("a", 300.0, 16.0), ("a", 300.0, 16.0), ("b", None, None)]


def test_resamples_have_the_ledgers_size_and_mean(spark):
    from tidemark.operators import simulations as M

    rows = [("m", i, float(i % 7 - 3), 1.0, 2.0) for i in range(300)]
    trades = spark.createDataFrame(rows, "model string, trade_id long, net_pnl double, slippage double, commission double")
    out = M.runs(trades, 400, M.BOOTSTRAP).toPandas()
    total = sum(r[2] for r in rows)
    assert (out.trades == 300).all() and abs(out.net_pnl.mean() - total) < 6 and abs(out.net_pnl.std() - 2.0 * 300**0.5) < 4
    missed = M.runs(trades, 400, M.MISSED).toPandas()
    assert 0.9 < missed.trades.mean() / 300 < 0.95 and missed.trades.min() > 230
    costs = M.runs(trades, 400, M.COSTS).toPandas()
    assert (costs.trades == 300).all() and abs(costs.net_pnl - total).max() < 300 * (0.25 + 0.2)
    both = M.runs(trades, 400, M.COMBINED).toPandas()
    assert both.trades.max() <= 300 and both.net_pnl.std() > costs.net_pnl.std()


def test_splits_of_a_resample_are_binomial(spark):
    from tidemark.functions.draws import uniform, uniform_array
    from tidemark.operators import simulations as M

    n, sims = 5 * M.BLOCK + 77, np.arange(4000)
    draws = np.array([M.block_draws(n, b, 42, sims) for b in range(6)])
    assert (draws.sum(0) == n).all()
    for k, share in zip(draws, [M.BLOCK / n] * 5 + [77 / n]):
        sd = (n * share * (1 - share)) ** 0.5
        assert abs(k.mean() - n * share) < 5 * sd / 4000**0.5 and abs(k.std() / sd - 1) < 0.05
        assert abs(np.quantile(k, 0.975) - (n * share + 1.96 * sd)) < 0.15 * sd + 1
    assert abs(np.corrcoef(draws[0], draws[1])[0, 1] + 1 / 5.07) < 0.07  # a draw in one block is none in another
    frame = spark.createDataFrame([(r, s) for r in (-5, 0, 3, 2**31 - 1, 2**40 + 1) for s in (0, 1, 9999)], "r long, s long").select("r", "s", uniform(7, "r", "s").alias("u")).toPandas()
    assert np.array_equal(uniform_array(7, frame.r.values, frame.s.values), frame.u.values)
    rng = np.random.default_rng(1)
    pnl = rng.normal(1, 10, 3000)
    trades = spark.createDataFrame([(None, i, float(x)) for i, x in enumerate(pnl)] + [("one", 1, 2.0)], "model string, trade_id long, net_pnl double")
    out = M.runs(trades, 500, M.BOOTSTRAP).toPandas()
    many = out[out.model.isna()]
    plain = np.array([rng.choice(pnl, 3000).sum() for _ in range(500)])
    assert (many.trades == 3000).all() and (out[out.model == "one"].net_pnl == 2.0).all()
    assert abs(many.net_pnl.mean() - plain.mean()) < 4 * plain.std() * (2 / 500) ** 0.5 and abs(many.net_pnl.std() / plain.std() - 1) < 0.15
    assert M.runs(trades.limit(0), 10, M.BOOTSTRAP).count() == 0


def test_gaps_of_daily_series_are_filled(spark):
    from tidemark.operators import bars as B
    from tidemark.operators import joins as J

    day = lambda n: (pd.Timestamp("2024-01-01") + pd.Timedelta(days=n)).to_pydatetime()
    daily = spark.createDataFrame([(day(0).date(), 1.0), (day(3).date(), 4.0)], "date date, v double")
    hours = spark.createDataFrame([("a", day(n)) for n in range(5)], "symbol string, ts timestamp")
    back = {r.ts.day: r.v for r in J.previous_day(hours, daily, ["v"]).collect()}
    assert back == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 4.0}
    same = {r.ts.day: r.v for r in J.same_day(hours, daily, ["v"]).collect()}
    assert same == {1: 1.0, 2: 1.0, 3: 1.0, 4: 4.0, 5: 4.0}
    dense = B.densify_days(daily.withColumn("k", F.lit("x")), "k", "date", "v").orderBy("date").collect()
    assert [r.v for r in dense] == [1.0, 1.0, 1.0, 4.0]


def test_made_series(spark):
    from tidemark.sources import synthetic

    x = synthetic.mean_reverting(spark, 1500).orderBy("date").toPandas().close
    assert len(x) == 1500 and x.min() >= 9 and 16 < x.mean() < 24 and 0.9 < x.autocorr() < 1
    walk = synthetic.random_walk(spark, 800, noise=2.0).orderBy("date").toPandas().value
    assert 1.8 < walk.diff().std() < 2.2 and abs(walk.diff().mean()) < 0.3


def plain_boosting(x, y, train, cuts, trees, depth, rate, l2):
    """One model, row by row in numpy."""
    b = np.stack([(x[:, k][:, None] > np.array(c)[None]).sum(1) for k, c in enumerate(cuts)], 1)
    p = y[train].mean()
    raw = np.full(len(y), np.log(p / (1 - p)))
    for _ in range(trees):
        q = 1 / (1 + np.exp(-raw))
        g, h, node = q - y, q * (1 - q), np.ones(len(y), int)
        for _ in range(depth):
            below, leaf = 2 * node, {}
            for k in np.unique(node[train]):
                m = train[node[train] == k]
                gt, ht, best = g[m].sum(), h[m].sum(), (0, None)
                for f in range(b.shape[1]):
                    for c in np.unique(b[m, f]):
                        left = m[b[m, f] <= c]
                        gl, hl = g[left].sum(), h[left].sum()
                        if min(hl, ht - hl) >= 1e-3:
                            gain = round(gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2), 9)
                            best = max(best, (gain, (f, c, gl, hl)), key=lambda z: z[0])
                leaf[2 * k] = leaf[2 * k + 1] = -gt / (ht + l2)
                if best[1]:
                    f, c, gl, hl = best[1]
                    below[node == k] = 2 * k + (b[node == k, f] > c)
                    leaf[2 * k], leaf[2 * k + 1] = -gl / (hl + l2), -(gt - gl) / (ht - hl + l2)
            node = below
        raw += rate * np.array([leaf.get(k, 0.0) for k in node])
    return 1 / (1 + np.exp(-raw))


def test_boosting_of_all_folds_equals_single_models(spark):
    from tidemark.operators import boosting as B

    rng = np.random.default_rng(1)
    n = 300
    x = rng.normal(size=(n, 2))
    ys = {"y1": (x[:, 0] * x[:, 1] > 0).astype(int), "y2": (x[:, 1] + rng.normal(size=n) / 2 > 0).astype(int)}
    rows = [("a", i, f, "test" if i % 3 == f else "train", *map(float, x[i]), *(int(y[i]) for y in ys.values())) for i in range(n) for f in (0, 1)]
    rows += [("a", n, 0, "train", None, 1.0, 1, 1), ("a", n + 1, 0, "train", 1.0, 1.0, None, None), *[("a", n + 2 + k, 7, ("train", "test")[k], 1.0, 1.0, 1, 1) for k in (0, 1)]]
    members = spark.createDataFrame(rows, "symbol string, ts long, fold int, role string, a double, b double, y1 int, y2 int").repartition(5)
    cuts = {c: np.quantile(x[:, k], np.arange(1, 12) / 12).tolist() for k, c in enumerate("ab")}
    out = B.boosted_scores(members, ["a", "b"], list(ys), trees=3, depth=3, rate=0.3, cuts=cuts).toPandas()
    assert set(out.fold) == {0, 1}  # a fold of one class has no scores
    for (fold, target), got in out.groupby(["fold", "target"]):
        train = np.array([i for i in range(n) if i % 3 != fold])
        want = plain_boosting(x, ys[target], train, list(cuts.values()), 3, 3, 0.3, 1.0)
        assert len(got) == n // 3 and np.abs(got.score.values - want[got.ts.values]).max() < 1e-9
        assert (got.label.values == ys[target][got.ts.values]).all()


def test_boosting_stores_rows_once_and_sends_cells(spark, monkeypatch):
    from tidemark.operators import boosting as B

    written = []
    table = B.Table
    monkeypatch.setattr(B, "Table", lambda df, name: written.append(name) or table(df, name))
    rows = [("a", i, 0, ("train", "test")[i % 2], float(i % 7), i % 3 % 2) for i in range(200)]
    members = spark.createDataFrame(rows, "symbol string, ts long, fold int, role string, a double, y int")
    out = B.boosted_scores(members, ["a"], ["y"], trees=5, cuts={"a": [1.0, 3.0, 5.0]})
    assert out.count() == 100 and written == ["boosted"]


def test_both_directions_are_one_fit(spark, monkeypatch):
    from tidemark.operators import boosting as B
    from tidemark.operators import ranking as A

    fits = []
    fit = A.boosted_scores
    monkeypatch.setattr(A, "boosted_scores", lambda *a, **k: fits.append(1) or fit(*a, **k, trees=3))
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(int)
    rows = [("a", i, i % 2, "train" if i < 250 else "test", *map(float, x[i]), int(y[i])) for i in range(400)]
    members = spark.createDataFrame(rows, "symbol string, ts long, fold int, role string, a double, b double, y int")
    got = {r.direction: r.auc for r in A.direction_leak(members, ["a", "b"], "y").collect()}
    assert len(fits) == 1
    cuts = B.cut_points(members, ["a", "b"])
    swapped = members.withColumn("role", F.when(F.col("role") == "train", "test").otherwise("train"))
    for way, m in (("forward", members), ("reverse", swapped)):
        want = A.auc(B.boosted_scores(m, ["a", "b"], ["y"], cuts=cuts, trees=3), "score", "label").first().auc
        assert abs(got[way] - want) < 1e-12


def test_positions_look_no_further_than_they_are_held():
    from tidemark.operators import signals as X

    class Counted(np.ndarray):
        seen = 0

        def __array_ufunc__(self, ufunc, method, *args, **kwargs):
            args = [np.asarray(a) for a in args]
            Counted.seen += max(a.size for a in args)
            return getattr(ufunc, method)(*args, **kwargs)

    rules = X.GridRules()
    flat = np.full(100_000, 100.0).view(Counted)
    assert X._held_bars(1, 100.0, 1.0, flat, flat, rules) == rules.hold_bars
    assert 0 < Counted.seen < 10 * rules.hold_bars


@pytest.mark.parametrize("odd", [0, 2])
def test_random_halves_equal_the_plain_form(spark, odd):
    from tidemark.functions.draws import uniform
    from tidemark.functions.frames import EPS
    from tidemark.operators import validation as S

    rng = np.random.default_rng(4)
    rows = [(s, p, float(rng.normal(0.1 * s, 1)) if s < 4 else 0.25 * (s - 4)) for s in range(6) for p in range(-3, 60)]
    rows += [(0, 5, 0.3), (1, None, 9.0), (2, 7, None), (7, 1, 0.5)]
    rows += [(0, 11, math.nan), (1, 12, math.inf)][:odd]
    returns = spark.createDataFrame(rows, "strategy int, period long, ret double").repartition(4)
    got = S.random_half_overfit(returns, trials=60).first()
    all_trials = returns.withColumn("trial", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long")))).withColumn("_in", uniform(11, "period", "trial") < 0.5)
    ratio = lambda half: F.round(F.avg(F.when(half, F.col("ret"))) / (F.stddev_pop(F.when(half, F.col("ret"))) + EPS), 9)
    want = S.rank_overfit(all_trials.groupBy("trial", "strategy").agg(ratio(F.col("_in")).alias("inside"), ratio(~F.col("_in")).alias("outside")), "trial", "strategy", "inside", "outside").first()
    assert (got.pbo, got.paths) == (want.pbo, want.paths) and abs(got.mean_logit - want.mean_logit) < 1e-12
    assert "Generate" not in S.random_half_overfit(returns)._jdf.queryExecution().executedPlan().toString()  # no row for each trial


def test_gates_of_the_full_validation(spark):
    from tidemark.operators import validation as S

    folds = spark.createDataFrame([("v", 0.6, 0.05, 15, 7.7, 0.57, 0.63), ("h", 0.55, 0.1, 15, 1.9, 0.5, 0.6)], "target string, mean double, std double, folds long, t double, ci_low double, ci_high double")
    overfit = spark.createDataFrame([(0.2, 1.0, 1000)], "pbo double, mean_logit double, paths long")
    for p, passes in ((0.02, True), (0.3, False), (None, False)):
        row = S.gated(folds, overfit, spark.createDataFrame([(2.0, 1.9, 1.2, p)], "sharpe double, expected_max double, statistic double, p_value double"), "v", {"h": "high_auc"}).first()
        assert (row.cpcv_pass, row.pbo_pass, row.dsr_pass, row.overall_pass) == (True, True, passes, passes) and row.high_auc == 0.55
    weak = folds.withColumn("ci_low", F.lit(0.49))
    assert not S.gated(weak, overfit, spark.createDataFrame([(2.0, 1.9, 1.2, 0.01)], "sharpe double, expected_max double, statistic double, p_value double"), "v", {}).first().overall_pass


def test_sliding_quantiles_equal_those_of_frames(spark):
    from tidemark.functions.frames import Frames
    from tidemark.functions.sliding import sliding_quantiles

    bars = series(spark, 400).withColumn("x", F.when(F.col("close") % 7 > 0.1, F.round("close", 1)))
    want = bars.withColumns({"a": Frames().quantile("x", 30, 0.33), "b": Frames().quantile("x", 30, 0.9)}).orderBy("symbol", "ts").toPandas()
    for chunk in (30, 64, 0):
        got = sliding_quantiles(bars, "x", 30, {"a": 0.33, "b": 0.9}, chunk_rows=chunk).orderBy("symbol", "ts").toPandas()
        assert list(got.columns) == list(want.columns) and len(got) == len(want)
        for c in ("a", "b"):
            assert (got[c].isna() == want[c].isna()).all() and np.nanmax(np.abs(got[c] - want[c])) < 1e-9
    assert want.a.notna().sum() > 100


def test_sliding_quantiles_of_a_long_frame(spark):
    from tidemark.functions.sliding import sliding_quantiles

    n = 60_000
    x = np.random.default_rng(2).normal(size=n)
    frame = spark.createDataFrame(pd.DataFrame({"symbol": "a", "ts": np.arange(n), "x": x}))
    got = sliding_quantiles(frame, "x", 19_656, {"q": 0.67}, chunk_rows=20_000).orderBy("ts").toPandas()
    for at in (19_655, 20_000, 39_999, 40_000, 59_999):
        assert abs(got.q[at] - np.quantile(x[at - 19_655 : at + 1], 0.67)) < 1e-12
    assert got.q[:19_655].isna().all() and got.q[19_655:].notna().all()


def test_grids_hold_the_same_draws():
    from tidemark.functions.draws import PRIME, Grid, first_draw, uniform_array

    sims, rows = np.array([0, 1, 2, 777, 9999]), np.array([0, 3, 2**31 - 1, 2**40 + 1, -5, 123456789])
    grid = Grid(sims, 10)
    for seed in (7, 42, 46):
        grid.at(rows)
        want = uniform_array(seed, rows[:, None], sims[None])
        assert np.array_equal((grid.whole(seed) - np.uint64(1)) / float(PRIME), want) and np.array_equal(grid.floats(seed), want * PRIME + 1)
        for size in (1, 77, 1000, 1023, 1024):
            assert np.array_equal(grid.picks(seed, size), np.floor(want * size))
        for share in (0.0, 0.1, float(want[2, 3]), 1.0):
            assert np.array_equal(grid.reach(seed, first_draw(share)), want >= share) and np.array_equal(grid.reach(seed, first_draw(share, above=True)), want > share)
    grid = Grid(np.arange(2000), 500)
    for at in range(0, 20_000, 500):  # ten million more
        grid.at(np.arange(at, at + 500))
        assert np.array_equal((grid.whole(42) - np.uint64(1)) / float(PRIME), uniform_array(42, np.arange(at, at + 500)[:, None], np.arange(2000)[None]))


def test_runs_equal_draws_made_one_by_one(spark):
    """A grid's corners, a block that is not full, a null trade, and how many draws a task holds at a time."""
    from tidemark.functions.draws import uniform_array
    from tidemark.operators import simulations as M

    n, sims = M.BLOCK + 37, 7
    pnl = np.round(np.random.default_rng(3).normal(0, 90, n), 2)
    cost = np.arange(n) % 3 + 1.0
    trades = spark.createDataFrame([("m", i, None if i in (5, n - 1) else float(x), float(c), float(2 * c)) for i, (x, c) in enumerate(zip(pnl, cost))], "model string, trade_id long, net_pnl double, slippage double, commission double")
    held = np.where(np.isin(np.arange(n), (5, n - 1)), np.nan, pnl)
    held_at_once = []
    for k in (M.BOOTSTRAP, M.MISSED, M.COSTS, M.COMBINED):
        got = M.runs(trades, sims, k).toPandas().set_index("sim")
        for s in range(sims):
            if k.resample:
                own = [M.block_draws(n, b, k.seed, np.array([s]))[0] for b in (0, 1)]
                row = np.concatenate([b * M.ROOM + np.arange(c) for b, c in enumerate(own)])
                size = np.repeat([M.BLOCK, 37], own)
                pick = (row // M.ROOM * M.BLOCK + np.floor(uniform_array(k.seed, row, np.array(s)) * size)).astype(int)
            else:
                row = pick = np.arange(n)
            x = held[pick]
            for j, most in enumerate(k.cost or (), 1):
                x = x - cost[pick] * j * (2 * uniform_array(k.seed + j, row, np.array(s)) - 1) * most
            if k.dropout:
                rate = k.dropout[0] + (k.dropout[1] - k.dropout[0]) * uniform_array(k.seed + 3, np.array(0), np.array(s))
                x = x[uniform_array(k.seed + 4, row, np.array(s)) > rate]
            assert got.trades[s] == (~np.isnan(x)).sum() and abs(got.net_pnl[s] - np.nansum(x)) < 1e-6, (k, s)
    for first, last, grid, rows in M._grids(10_000):  # no array of a task leaves a core's cache
        held_at_once.append((last - first) * rows)
    assert max(held_at_once) <= M.AT_ONCE <= 1 << 15


def test_shares_are_the_draws_and_half_a_step():
    from tidemark.functions.draws import PRIME, places, row_terms, shares, sim_terms, uniform_array

    def drawn(seed, sims, rows):
        by_sim, by_row = sim_terms(sims), row_terms(seed, rows)
        return shares(by_sim, by_row, np.empty((len(sims), len(rows))), np.empty((len(sims), len(rows))))

    sims, rows = np.array([0, 1, 2, 777, 9999, 2**31 - 40]), np.array([0, 3, 2**31 - 1, 2**40 + 1, -5, 123456789])
    edges = 0
    for seed, sims, rows in ((7, sims, rows), (42, sims, rows), (42, np.arange(2000), np.arange(1 << 24, (1 << 24) + 5000)), (46, np.arange(8000, 10_000), np.arange(5000))):
        want = uniform_array(seed, rows[None], sims[:, None])
        whole = np.rint(want * PRIME)
        got = drawn(seed, sims, rows)
        assert np.abs(got * PRIME - whole - 0.5).max() < 0.17
        edges += ((whole % 2**21 == 2**21 - 1) | (whole % 2**21 == 0)).sum()
        for size in (1024, 1023, 77, 1):
            assert np.array_equal(np.floor(places(got.copy(), size)), np.floor(want * size)), (seed, size)
    assert edges > 5  # draws one step from the next trade


def _resampled_one_by_one(M, k, n, block, trade, sims):
    """Sums and numbers of each run's draws from a block, each draw by itself."""
    from tidemark.functions.draws import uniform_array

    size = len(trade["x"])
    for s in range(sims):
        row = block * M.ROOM + np.arange(M.block_draws(n, block, k.seed, np.array([s]))[0])
        pick = np.floor(uniform_array(k.seed, row, np.array(s)) * size).astype(int)
        x = trade["x"][pick]
        for j, c in enumerate(("slippage", "commission") if k.cost else (), 1):
            x = x - trade[c][pick] * (uniform_array(k.seed + j, row, np.array(s)) * M.PRIME + 1)
        if k.dropout:
            rate = k.dropout[0] + (k.dropout[1] - k.dropout[0]) * uniform_array(k.seed + 3, np.array(0), np.array(s))
            x = x[uniform_array(k.seed + 4, row, np.array(s)) > rate]
        x = x[~np.isnan(x)]
        yield x.sum(), len(x), (x * x).sum()


def test_ledgers_share_the_draws_of_a_block(monkeypatch):
    """Made once for all, as often for five ledgers as for one, and right for each: lengths differ, trades are null or endless."""
    from tidemark.operators import simulations as M

    calls = []
    make = M.shares
    monkeypatch.setattr(M, "shares", lambda *a: calls.append(1) or make(*a))
    rng, sims = np.random.default_rng(5), 70
    for size, block, lengths in ((M.BLOCK, 1, (3 * M.BLOCK, 3 * M.BLOCK + 900, 5 * M.BLOCK + 1, 2 * M.BLOCK, 9 * M.BLOCK)), (37, 2, (2 * M.BLOCK + 37,) * 5), (5, 0, (5,) * 5)):
        trades = [{"x": np.round(rng.normal(5, 90, size), 2), "slippage": rng.integers(1, 4, size) / M.PRIME, "commission": rng.random(size) / M.PRIME} for _ in lengths]
        trades[1]["x"][3] = np.nan
        trades[2]["commission"][1] = np.nan
        for k in (M.BOOTSTRAP, M.COMBINED):
            mine = [{c: x for c, x in t.items() if k.cost or c == "x"} for t in trades]
            made = []
            for at in ([0], [0, 1, 2, 3, 4], [3, 2]):
                calls.clear()
                got = M.Blocks(k, sims, squares=not k.cost).moments(block, [lengths[i] for i in at], [mine[i] for i in at])
                made.append(len(calls))
                for ledger, i in enumerate(at):
                    want = np.array(list(_resampled_one_by_one(M, k, lengths[i], block, mine[i], sims))).T
                    assert np.array_equal(got[1][ledger], want[1]) and np.abs(got[0][ledger] - want[0]).max() < 1e-6, (size, k, at)
                    assert k.cost or np.abs(got[2][ledger] - want[2]).max() < 1e-4
            assert len(set(made)) == 1
    endless = {"x": np.where(np.arange(M.BLOCK) == 9, np.inf, np.where(np.arange(M.BLOCK) == 700, -np.inf, 1.0))}
    got = M.Blocks(M.BOOTSTRAP, sims, squares=True).moments(1, [3 * M.BLOCK], [endless])
    with np.errstate(invalid="ignore"):
        want = np.array(list(_resampled_one_by_one(M, M.BOOTSTRAP, 3 * M.BLOCK, 1, endless, sims))).T
    assert np.array_equal(got[:, 0], want[[0, 1, 2]], equal_nan=True) and {np.inf, -np.inf} < set(want[0])


def test_runs_of_many_ledgers_equal_those_of_each(spark):
    from tidemark.operators import simulations as M

    rows = [(None if m == 4 else f"m{m}", 10 * i, float((i * (m + 3)) % 17 - 8) if i != 7 else None, 1.0 + i % 3, 2.0) for m in range(11) for i in range((40 if m > 3 else 1500) + 90 * m)]
    trades = spark.createDataFrame(rows, "model string, trade_id long, net_pnl double, slippage double, commission double")
    got = M.runs(trades, 40, M.COMBINED)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_group" in plan  # a task has a block's number in all ledgers of a group
    assert "lambdafunction" not in plan  # as a session's first query it failed over a column that an inferred filter named
    got = got.toPandas()
    assert len(got) == 11 * 40
    for m in ("m1", "m3", "m10", None):
        own = M.runs(trades.where(F.col("model").eqNullSafe(m)), 40, M.COMBINED).toPandas().set_index("sim").sort_index()
        both = got[got.model.isna() if m is None else got.model == m].set_index("sim").sort_index()
        assert (own.trades == both.trades).all() and np.abs(own.net_pnl - both.net_pnl).max() < 1e-6
