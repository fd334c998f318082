"""Helpers against pandas, literal cases, sources, streams and odd rows."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradeloom.functions import columns as C
from tradeloom.operators import asof as A
from tradeloom.operators import bars as B
from tradeloom.operators import calibration as K
from tradeloom.operators import joins as J
from tradeloom.operators import learning as M
from tradeloom.operators import logs as L
from tradeloom.operators import performance as P
from tradeloom.operators import quality as Q
from tradeloom.operators import recursive as R
from tradeloom.operators import scans as N
from tradeloom.operators import windows as W
from tradeloom.functions import rules as rules_of
from tradeloom.sources import staging
from tradeloom.sources import tables as T
from tradeloom.streaming import streams as X

T0 = dt.datetime(2024, 1, 1)


def walk(spark, n=2_000, symbols=("A", "B"), minutes=5):
    rng = np.random.default_rng(42)
    parts = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.001, n)))
        parts.append(pd.DataFrame({"symbol": s, "ts": [T0 + dt.timedelta(minutes=minutes * k) for k in range(n)], "open": close, "high": close * 1.001, "low": close * 0.999, "close": close, "volume": rng.integers(100, 1000, n).astype(float)}))
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf).repartition(4)


def test_indicators_match_pandas(spark):
    pdf, df = walk(spark)
    got = N.with_indicators(df).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    for s, g in pdf.groupby("symbol"):
        tr = pd.concat([g.high - g.low, (g.high - g.close.shift()).abs(), (g.low - g.close.shift()).abs()], axis=1).max(axis=1)
        want = tr.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean().to_numpy()
        mine = got[got.symbol == s]
        assert np.allclose(mine.atr, want, equal_nan=True, atol=1e-12)
        macd = g.close.ewm(span=12, adjust=False, min_periods=12).mean() - g.close.ewm(span=26, adjust=False, min_periods=26).mean()
        assert np.allclose(mine.macd, macd, equal_nan=True, atol=1e-10)
        assert mine.rsi.dropna().between(0, 100).all() and mine.adx.dropna().between(0, 100).all()


def test_rolling_features_match_pandas(spark):
    pdf, df = walk(spark, 600)
    got = W.with_volume_multiple(df, 100, "vm").select("symbol", "ts", W.sma("close", 20).alias("sma"), "vm", W.zscore("volume", 50, 10).alias("z"), W.channel_high("high", 20).alias("ch")).toPandas().sort_values(["symbol", "ts"], ignore_index=True)
    for s, g in pdf.groupby("symbol"):
        mine = got[got.symbol == s]
        assert np.allclose(mine.sma, g.close.rolling(20).mean(), equal_nan=True, atol=1e-10)
        assert np.allclose(mine.vm, g.volume / g.volume.rolling(100, min_periods=10).median(), equal_nan=True, atol=1e-10)
        r = g.volume.rolling(50, min_periods=10)
        assert np.allclose(mine.z, (g.volume - r.mean()) / (r.std() + 1e-12), equal_nan=True, atol=1e-9)
        assert np.allclose(mine.ch, g.high.rolling(20).max().shift(), equal_nan=True)


def test_right_resample_puts_midnight_on_the_day_before(spark):
    df = spark.createDataFrame([("A", T0 + dt.timedelta(hours=h), 1.0, float(h), 0.0, 1.0, 1.0) for h in (0, 1, 24, 25)], "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    got = {r["ts"]: r["high"] for r in B.resample(df, "1d", right=True).collect()}
    assert got == {T0: 0.0, T0 + dt.timedelta(days=1): 24.0, T0 + dt.timedelta(days=2): 25.0}
    assert C.timeframe_seconds("15m") == 900
    with pytest.raises(ValueError):
        C.timeframe_seconds("15")


def test_open_interest_case(spark):
    n = 288 * 8
    rows = [("A", T0 + dt.timedelta(minutes=5 * i), 100 + math.sin(i / 50), 1000 * 1.01 ** (i // 288), 0.0) for i in range(n)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, close double, open_interest double, funding_rate double")
    out = W.with_derivatives(df, 12, 288, eps=7.908e-05, low=0.534149823784828, high=1.9565849494934076)
    last = out.orderBy(F.desc("ts")).first()
    assert (last["funding_code"], last["oi_code"], last["s3"]) == (0, -1, 3)


def test_staleness(spark):
    rows = [("A", T0 + dt.timedelta(minutes=5 * i), 1.0 if i == 0 else None) for i in range(20)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, x double")
    got = [r["s"] for r in df.select("ts", B.is_stale("x", "30m").alias("s")).orderBy("ts").collect()]
    assert got == [False] * 7 + [True] * 13


def test_recent_win_rate_case(spark):
    day = lambda k: T0 + dt.timedelta(days=k)
    outcomes = spark.createDataFrame([("A", day(1), 1), ("A", day(2), 0), ("A", day(3), 1)], "symbol string, ts timestamp, win int")
    asked = spark.createDataFrame([("A", day(4)), ("A", day(3)), ("A", day(0)), ("B", day(9))], "symbol string, ts timestamp")
    got = {(r["symbol"], r["ts"]): r["win_rate_20"] for r in W.with_recent_win_rate(asked, outcomes).collect()}
    assert got == {("A", day(4)): 0.5, ("A", day(3)): 1.0, ("A", day(0)): 0.25, ("B", day(9)): 0.25}


@pytest.mark.parametrize(("value", "want"), [("1", True), ("1.0", True), ("0", False), ("2", False), ("true", False), (None, False), ("nan", False)])
def test_scope(spark, value, want):
    df = spark.createDataFrame([(value,)], "risk_on_1 string")
    test, missing = C.scope_ok("RISK_ON_1", df.columns)
    assert (df.select(test).first()[0], missing) == (want, False)
    assert C.scope_ok("RISK_ON_1", ["x"])[1]
    assert df.select(C.scope_ok("", [])[0], C.scope_ok("OTHER", ["risk_on"])[0]).first() == (True, False)


def test_size_multiplier_and_chain(spark):
    one = spark.range(1)
    m = lambda h, cap=None: one.select(C.size_multiplier(F.lit(0.65), F.lit(h), cap=cap)).first()[0]
    assert math.isclose(m(-0.1), 0.75) and math.isclose(m(0.1, 1.3), 1.3)
    up = C.sizing_chain(F.lit(2000.0), F.lit(1), F.lit(1), F.lit(1.0), F.lit(1.7), F.lit(50.0), F.lit(49.5), mode="percent", risk_pct=0.01)
    r = one.select(*[v.alias(k) for k, v in up.items()]).first()
    assert not r["skipped"] and math.isclose(r["risk_usd"], 34) and math.isclose(r["qty"], 40.0)
    assert one.select(C.sizing_chain(F.lit(1.0), F.lit(0), F.lit(1), F.lit(1.0), F.lit(None), F.lit(1.0), F.lit(2.0))["skipped"]).first()[0]


def test_log_lines(spark):
    line = "x META_DECISION bundle=b symbol=AUSDT decision_ts=2026-02-15T00:05:00Z schema_ok={} p_cal=0.3676 pstar=0.42 pstar_scope=RISK_ON_1 risk_on_1=1 risk_on=1 scope_val=1 scope_src=s scope_ok=True meta_ok=False strat_ok={} reason={} err={}"
    rows = [(0, line.format("True", "True", "below_pstar", "None")), (1, line.format("False", "False", "schema_fail", "missing_required:['a b', 'c']").replace("AUSDT", "BUSDT")), (2, line.format("False", "False", "schema_fail", "missing_required=x, y").replace("AUSDT", "BUSDT")), (3, "noise META_DECISION"), (4, None)]
    df = L.with_reasons(L.latest_decisions(L.parse_decisions(spark.createDataFrame(rows, "n int, value string"), keep=("n",)), ["n"]))
    got = {r["symbol"]: r for r in df.withColumn("fields", C.missing_from_error(F.col("err"))).collect()}
    assert set(got) == {"AUSDT", "BUSDT"} and got["AUSDT"]["reason_canonical"] == "meta_prob" and got["AUSDT"]["p_cal"] == 0.3676 and got["AUSDT"]["decision"] == "skipped"
    assert got["BUSDT"]["n"] == 2 and got["BUSDT"]["fields"] == ["x", "y"] and got["BUSDT"]["reason_canonical"] == "schema_fail"
    quoted = spark.createDataFrame([("missing_required:['a b', 'c']",)], "e string").select(C.missing_from_error(F.col("e"))).first()[0]
    assert quoted == ["a b", "c"]


def test_markov_separates_variances(spark):
    rng = np.random.default_rng(1)
    state = np.repeat([0, 1, 0, 1], 100)
    r = rng.normal(0, np.where(state, 0.03, 0.005))
    close = 100 * np.cumprod(1 + r)
    df = spark.createDataFrame(pd.DataFrame({"symbol": "A", "ts": [T0 + dt.timedelta(days=k) for k in range(400)], "close": close}))
    out = R.markov_regime(df, 50, up=False).toPandas().sort_values("ts")
    assert ((out["prob"] > 0.5).to_numpy() == (state[1:] == 0)).mean() > 0.9
    assert R.markov_regime(df.limit(10), 50, up=True).count() == 0
    p, mean, var = R.switching_filter(r)
    assert np.allclose(p.sum(1), 1) and np.allclose(sorted(np.sqrt(var)), [0.005, 0.03], rtol=0.2)


def test_order_index_and_folds(spark):
    df = spark.range(1_001).select((F.col("id") % 7).alias("a"), "id")
    got = W.with_order_index(df, ["a", "id"]).toPandas().sort_values(["a", "id"])
    assert list(got.order_idx) == list(range(1_001))
    folds = K.purged_folds(W.with_order_index(df, ["a", "id"]), 4, 10).toPandas()
    for k, g in folds.groupby("fold"):
        test, train = g[g.role == "test"].order_idx, g[g.role == "train"].order_idx
        assert len(test) == (251 if k == 0 else 250) and not ((train >= test.min() - 10) & (train <= test.max() + 10)).any()


def test_calibrators(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0.05, 0.95, 3_000)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": (rng.uniform(size=3_000) < p**2).astype(int)}))
    name, report = M.choose_calibrator(df)
    by = {r["name"]: r for r in report}
    assert name == "platt" and by["platt"]["ece"] < by["raw"]["ece"]
    assert M.monotone([1, 3, 2, 4], [1, 1, 1, 1]) == [1, 2.5, 2.5, 4]
    x = [-2.5, -0.3, 0.0, 0.7, 3.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").select(K.erf(F.col("x"))).collect()]
    assert np.allclose(got, [math.erf(v) for v in x], atol=2e-7)


def test_greedy_match_uses_each_position_once(spark):
    rows = [("A", 1, T0, 10, 5.0), ("A", 1, T0, 11, 9.0), ("A", 2, T0 + dt.timedelta(hours=1), 10, 1.0), ("A", 2, T0 + dt.timedelta(hours=1), 11, 2.0), ("A", 3, T0 + dt.timedelta(hours=2), 10, 1.0)]
    got = R.greedy_match(spark.createDataFrame(rows, "symbol string, statement_id long, closed_at timestamp, position_id long, gap double")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 10), (2, 11)]
    s = spark.createDataFrame([("A", T0, 1), ("A", T0 + dt.timedelta(seconds=50), 2), ("A", T0 + dt.timedelta(seconds=100), 3)], "symbol string, ts timestamp, id long")
    assert sorted((r["id"], r["accepted"]) for r in R.accepted_signals(s, 60).collect()) == [(1, True), (2, False), (3, True)]


def test_split_groups_give_the_same_matches_and_signals(spark):
    """Chains of candidates and runs of signals against one pass over each symbol's rows; nulls, ties and empty tables."""
    rng = np.random.default_rng(7)
    n = 600
    base = pd.DataFrame({"symbol": rng.choice(["A", "B"], n), "statement_id": rng.integers(0, 150, n), "position_id": rng.integers(0, 200, n)})
    base = base.drop_duplicates(["statement_id", "position_id"])
    base["symbol"] = np.where(base.statement_id % 2 == 0, "A", "B")
    base["position_id"] = base.position_id * 2 + (base.symbol == "B")
    base["entry"], base["entry_price"] = (base.statement_id % 30).astype(float), (base.position_id % 30).astype(float)
    base = base[(base.entry - base.entry_price).abs() <= 2]
    base["closed_at"] = [T0 + dt.timedelta(minutes=int(s) % 40) for s in base.statement_id]
    base["gap"] = (base.statement_id * 7 + base.position_id * 3).mod(11).astype(float)
    df = spark.createDataFrame(base).repartition(3)
    got = [sorted(tuple(r) for r in R.greedy_match(df, spans).collect()) for spans in ((), (("entry", "entry_price"),), (("entry", "entry_price"), ("entry", "entry_price")))]
    assert got[0] and got[0] == got[1] == got[2]
    assert R.greedy_match(df.where("false"), (("entry", "entry_price"),)).count() == 0
    times = [None, None, *[T0 + dt.timedelta(seconds=int(x)) for x in np.sort(rng.integers(0, 20_000, 300))]]
    signals = [("A" if k % 3 else "B", t, k) for k, t in enumerate(times)]
    want, last = {}, {}
    for s, t, k in sorted((r for r in signals if r[1]), key=lambda r: (r[1], r[2])):
        want[k] = s not in last or (t - last[s]).total_seconds() >= 60
        last[s] = t if want[k] else last[s]
    found = R.accepted_signals(spark.createDataFrame(signals, "symbol string, ts timestamp, id long").repartition(3), 60).collect()
    assert {r["id"]: r["accepted"] for r in found} == {**want, 0: False, 1: False} and len(found) == len(signals)


def test_universe_cases(spark):
    rows = [("BTCUSDT", "BTC", "USDT", "USDT", True, True, True), ("", "PEPE", "USDT", "USDT", True, True, True), ("ETHUSDC", "ETH", "USDC", "USDC", True, True, True), ("XUSDT", "X", "USDT", "USDT", False, True, True), ("YUSDT", "Y", "USDT", "USDT", True, True, False)]
    df = spark.createDataFrame(rows, "id string, base string, quote string, settle string, swap boolean, linear boolean, active boolean")
    assert sorted(r[0] for r in Q.usdt_perps(df).collect()) == ["BTCUSDT", "PEPEUSDT"]
    assert Q.column_difference(["a", "b"], ["b", "c"]) == (["c"], ["a"])
    metrics = spark.createDataFrame([("baseline", 0.6, 0.20), ("x", 0.61, 0.19), ("y", 0.5, 0.25)], "feature string, auc double, brier double")
    assert {r["feature"]: r["disable"] for r in Q.ablation(metrics, "baseline", 0.0, 0.005).collect()} == {"x": True, "y": False}


def test_multipliers_at_their_ends(spark):
    rows = [(None, None, None), (0.4, 0.001, -5.0), (0.6, -0.015, 5.0), (0.9, 0.5, float("nan"))]
    df = spark.createDataFrame(rows, "share double, gap double, x double")
    one = [{"feature": "x", "default": 2.0, "in_min": 0, "in_max": 4, "mult_min": 1, "mult_max": 3}]
    got = df.select(C.stack_multiplier(F.col("share"), F.col("gap"), low=1.0, high=2.0), C.scaler_product(one), C.scaler_product(one * 2, 2.0, 5.0), C.scaler_product([])).collect()
    assert np.allclose([list(r) for r in got], [[1.0, 2.0, 4.0, 1.0], [1.0, 1.0, 2.0, 1.0], [1.7, 3.0, 5.0, 1.0], [2.0, 2.0, 4.0, 1.0]])


def test_enrichment_extract_is_written_as_csv(spark, tmp_path):
    trades = spark.createDataFrame([(1, "A", T0), (2, "B", T0)], "id long, symbol string, opened_at timestamp")
    series = spark.createDataFrame([("A", T0 - dt.timedelta(hours=2), 10.0), ("A", T0 - dt.timedelta(hours=1), 12.0)], "symbol string, ts timestamp, value double")
    out = J.enrichment_extract(trades, series, series, f"file://{tmp_path}/extract")
    back = spark.read.option("header", True).schema(out.schema).csv(f"file://{tmp_path}/extract")
    assert back.columns == ["id", "symbol", "opened_at", "funding_last_at_entry", "oi_last_at_entry", "oi_delta_pct_win"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, out.collect())) and back.where("id = 1").first()["oi_delta_pct_win"] == pytest.approx(0.2)


def test_sources(spark, tmp_path):
    (tmp_path / "o.jsonl").write_text('{"ts":"2024-01-01T00:00:00Z","win":1,"pnl":2.0}\nbad\n{"ts":"2024-01-03T00:00:00Z","win":0,"pnl":-1.0}\n{"ts":"2024-01-02T00:00:00Z","win":1,"pnl":1.0}\n')
    assert [r["ts"].day for r in T.read_outcomes(spark, f"file://{tmp_path}/o.jsonl", 2).collect()] == [3, 2]
    (tmp_path / "s.csv").write_text('Market,Order Quantity,Entry Price,Exit Price,Realized P&L,Trade time\nbtcusdt,-0.5,"40,000.5",41000,-3.5,2024-01-02 03:04:05\nethusdt,1,2,3,4,03:04 2024-01-02\n')
    got = {r["symbol"]: r for r in T.read_statement(spark, f"file://{tmp_path}/s.csv", 60).collect()}
    assert got["BTCUSDT"]["entry"] == 40000.5 and got["BTCUSDT"]["qty"] == 0.5 and got["ETHUSDT"]["closed_at"] == dt.datetime(2024, 1, 2, 2, 4)
    (tmp_path / "u.txt").write_text("# list\nbtcusdt # main\n\nETHUSDT\nbtcusdt\n")
    assert sorted(r[0] for r in T.read_symbols(spark, f"file://{tmp_path}/u.txt").collect()) == ["BTCUSDT", "ETHUSDT"]
    signals = spark.createDataFrame([("001", 1.0), ("B", 2.0)], "symbol string, x double")
    T.write_signals(signals, f"file://{tmp_path}/signals")
    back = T.read_signals(spark, f"file://{tmp_path}/signals", ["B"])
    assert [(r["symbol"], r["x"]) for r in back.collect()] == [("B", 2.0)]
    _, df = walk(spark, 50)
    df.write.parquet(f"file://{tmp_path}/bars")
    plan = T.read_bars(spark, f"file://{tmp_path}/bars", ["symbol", "close"], ["A"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(symbol), EqualTo(symbol,A)]" in plan.replace("In(symbol, [A])", "EqualTo(symbol,A)") and "ReadSchema: struct<symbol:string,close:double>" in plan
    T.write_csv(T.window_export(spark.createDataFrame([(1, T0)], "id int, closed_at timestamp"), "2024-01-01", "2024-01-02", ["id"]), f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 1
    lines = T.read_lines(spark, f"file://{tmp_path}/u.txt").collect()
    assert [r["value"] for r in sorted(lines, key=lambda r: r["line"])][0] == "# list"


def test_streams(spark, tmp_path):
    ticks = spark.createDataFrame([("A", T0 + dt.timedelta(minutes=m), m, float(m + 1), 1.0) for m in (0, 2, 4, 5, 7, 11, 40)], "symbol string, ts timestamp, seq int, price double, volume double")
    ticks.coalesce(1).write.parquet(f"file://{tmp_path}/ticks")
    stream = spark.readStream.schema(ticks.schema).parquet(f"file://{tmp_path}/ticks")

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    got = run(X.closed_bars(stream, "5m", "1 minute"), "append", "closed").collect()
    assert sorted((r["ts"].minute, r["open"], r["close"]) for r in got) == [(0, 1.0, 5.0), (5, 6.0, 8.0), (10, 12.0, 12.0)]
    slid = run(X.sliding_turnover(stream.withColumnRenamed("price", "close"), "10 minutes", "5 minutes", "1 minute"), "append", "slid")
    assert slid.count() >= 3
    outcomes = spark.createDataFrame([("A", T0 + dt.timedelta(hours=k), k % 2) for k in range(60)], "symbol string, ts timestamp, win int")
    outcomes.coalesce(1).write.parquet(f"file://{tmp_path}/outcomes")
    state = run(X.outcome_state(spark.readStream.schema(outcomes.schema).parquet(f"file://{tmp_path}/outcomes")), "update", "state").collect()
    assert state[-1]["n"] == 50 and state[-1]["win_rate_20"] == 0.5
    d = spark.createDataFrame([("A", T0, 1), ("A", T0, 2), ("B", T0, 3)], "symbol string, decision_ts timestamp, n int")
    d.coalesce(1).write.parquet(f"file://{tmp_path}/d")
    assert run(X.first_decisions(spark.readStream.schema(d.schema).parquet(f"file://{tmp_path}/d"), "1 hour"), "append", "firsts").count() == 2
    late = spark.createDataFrame([("A", T0, 1, "x"), ("A", T0, 3, "z"), ("A", T0, 2, "y"), ("B", T0, 3, "b")], "symbol string, decision_ts timestamp, n int, reason string")
    late.coalesce(1).write.parquet(f"file://{tmp_path}/late")
    newest = run(X.latest_decisions(spark.readStream.schema(late.schema).parquet(f"file://{tmp_path}/late"), "1 hour", "n", ["n", "reason"]), "update", "newest").collect()
    assert sorted((r["symbol"], r["reason"]) for r in newest) == [("A", "z"), ("B", "b")]
    schema = "symbol string, tf string, ts timestamp, close double"
    spark.sql(f"CREATE TABLE series_of_stream ({schema}) USING parquet PARTITIONED BY (symbol, tf)")
    columns = spark.table("series_of_stream").columns
    to_table = X.upsert_to(lambda: spark.table("series_of_stream"), lambda df: df.select(columns).write.mode("overwrite").insertInto("series_of_stream"), 2)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    to_table(spark.createDataFrame([(s, "1h", T0 + dt.timedelta(hours=k), float(k)) for k in range(3) for s in "AB"], schema), 0)
    to_table(spark.createDataFrame([("A", "1h", T0 + dt.timedelta(hours=2), 9.0)], schema), 1)
    assert sorted((r["symbol"], r["close"]) for r in spark.table("series_of_stream").collect()) == [("A", 1.0), ("A", 9.0), ("B", 1.0), ("B", 2.0)]
    spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    spark.sql("DROP TABLE series_of_stream")
    kept = {}
    up = X.upsert_to(lambda: kept.get("t", spark.createDataFrame([], "symbol string, tf string, ts timestamp, close double")), lambda df: kept.update(t=spark.createDataFrame(df.collect(), df.schema)), 2)
    up(spark.createDataFrame([("A", "1h", T0 + dt.timedelta(hours=k), float(k)) for k in range(3)], "symbol string, tf string, ts timestamp, close double"), 0)
    up(spark.createDataFrame([("A", "1h", T0 + dt.timedelta(hours=2), 9.0)], "symbol string, tf string, ts timestamp, close double"), 1)
    assert sorted(r["close"] for r in kept["t"].collect()) == [1.0, 9.0]


def test_rules_of_short_series_and_missing_context(spark):
    """Too few bars: false; context that is missing counts as 0, too young, or long ago."""
    _, df = walk(spark, 30)
    short = df.limit(3).withColumns({"level": F.lit(None).cast("double"), "mean": F.lit(None).cast("double"), "atr": F.lit(None).cast("double"), "touched": F.lit(True)})
    rules = [rules_of.RULES[n](**a) for n, a in {
        "channel_breakout": {"period": 5}, "pullback_under_ma": {"mean": "mean", "period": 5}, "volume_surge": {"win": 5}, "trend_filter_ema": {"fast": "mean", "slow": "mean", "period": 5},
        "micro_vol_filter": {"atr": "atr"}, "pullback_retest_close_above_break": {"level": "level", "touched": "touched", "lookback": 5}, "volume_median_multiple": {"median": "mean", "least": 5}, "channel_breakout_daily_confirm": {"level": "level"},
    }.items()]
    for frame in (short, short.where("false")):
        assert not any(v for r in frame.select(*[c.alias(f"c{k}") for k, c in enumerate(rules)]).collect() for v in r)
    none = spark.createDataFrame([("A", T0, None, None, None, None, None, None, None)], "symbol string, ts timestamp, last_exit timestamp, age_days int, eth_macd double, eth_macd_signal double, eth_macd_hist double, rs_pct double, liquidity double")
    context = {"blacklist_symbol": {"symbols": []}, "cooldown_hours": {"hours": 3}, "min_listing_age_days": {"days": 0}, "eth_macd_hist_above": {}, "eth_macd_bull": {}, "universe_rs_pct_gte": {}, "liquidity_median_24h_usd_gte": {}}
    assert list(none.select(*[rules_of.RULES[n](**a).alias(n) for n, a in context.items()]).first()) == [True, True, False, True, False, True, False]


def test_assets_meet_rows_across_days_without_bars(spark):
    """As of the last bar before, also when it is days old; null before the first bar and after the least of the last times."""
    at = lambda d, h: T0 + dt.timedelta(days=d, hours=h)
    bars = spark.createDataFrame([("BTC", at(0, 3), 1.0), ("BTC", at(0, 9), 2.0), ("BTC", at(4, 1), 3.0), ("BTC", at(9, 0), 4.0), ("ETH", at(1, 0), 5.0), ("ETH", at(8, 0), None)], "symbol string, ts timestamp, close double")
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([at(0, 1), at(0, 3), at(2, 5), at(4, 0), at(4, 2), at(7, 0), at(8, 1)])], "k int, ts timestamp")
    got = sorted(tuple(r) for r in J.with_assets(rows, bars, ["BTC", "ETH"], ["close"]).select("k", "btc_close", "eth_close").collect())
    assert got == [(0, None, None), (1, 1.0, None), (2, 2.0, 5.0), (3, 2.0, 5.0), (4, 3.0, 5.0), (5, 3.0, 5.0), (6, None, None)]


def test_live_lines(spark):
    lines = ["x OPENED SHORT BTCUSDT now", "Signal for ABC vetoed: GAP, ADX", "META_DECISION bundle=a symbol=XYZ decision_ts=2026-02-15T00:05:00+00:00 schema_ok=True p_cal=0.5 reason=meta_prob err=none", "Checking 1INCH...", "nothing", None]
    got = {tuple(r) for r in L.live_lines(spark.createDataFrame([(x,) for x in lines], "value string")).select("kind", "symbol", "detail").collect()}
    assert got == {("open", "BTCUSDT", "SHORT"), ("veto", "ABC", "GAP, ADX"), ("decision", "XYZ", "meta_prob"), ("check", "1INCH", "")}


def test_no_machine_local_staging_on_a_cluster():
    class Frame:
        class sparkSession:
            conf = type("C", (), {"get": staticmethod(lambda key, default=None: None)})
            sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        staging.staged(Frame, "x")


def test_odd_rows(spark):
    """Empty tables, one row, nulls and ties give results, not errors."""
    _, df = walk(spark, 30)
    none = df.where("false")
    for b in (none, df.limit(1), df.withColumn("close", F.lit(None).cast("double")), df.withColumn("volume", F.lit(0.0))):
        assert W.with_vwap_stack(b).count() == b.count()
        assert W.with_relative_strength(b).count() == b.count()
        assert N.with_indicators(b).count() == b.count()
        B.resample(b, "1h").collect()
    trades = spark.createDataFrame([], "id long, symbol string, tag string, side string, size double, entry double, opened_at timestamp, closed_at timestamp, pnl double, risk_usd double, mae_usd double, mfe_usd double, fees double, p double, y int, r double")
    for t in (trades, spark.createDataFrame([(1, "A", "T", "long", 1.0, 1.0, T0, T0, 0.0, 0.0, None, None, None, 0.5, 1, None)], trades.schema)):
        P.summary(t, ["tag"]).collect()
        curve = P.drawdowns(P.equity_curve(t, ["tag"], 0.0, ["closed_at", "id"]), ["tag"], ["closed_at", "id"])
        P.curve_metrics(curve, ["tag"], "closed_at").collect()
        P.daily_metrics(P.daily_equity(curve, ["tag"], "closed_at", True), ["tag"]).collect()
        assert W.streaks(t, ["tag"], ["closed_at", "id"]).count() == 0
        assert K.sweep(t, [0.1, 0.9]).count() == 2
        K.auc_brier(t, "p", "y").collect()
        K.rank_bins(t, "p", "y", "id", 5).collect()
        K.value_bins(t, "p", "y", 5).collect()
        assert J.trade_extremes(t, none).count() == 0


def test_quantiles_of_groups_match_the_built_in(spark):
    rows = [(k, float(i * 7 % 11) if i % 5 else None, float(i)) for k, n in (("a", 90), ("b", 1), (None, 7), ("c", 2)) for i in range(n)] + [("d", None, math.nan), ("d", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    at = [0.0, 0.05, 0.5, 0.77, 1.0]
    q = F.array(*[F.lit(v) for v in at])
    for by in (["k"], []):
        want = df.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("x", q).alias("qx"), F.percentile("y", q).alias("qy"))
        got = W.with_quantiles(df.groupBy(*by).agg(F.count("*").alias("n")), df, {"qx": F.col("x"), "qy": F.col("y")}, at, by)
        plain = lambda d: sorted([str([None if v is None else [round(u, 9) for u in v] if isinstance(v, list) else v for v in r]) for r in d.collect()])
        assert plain(got) == plain(want) and got.columns == want.columns
    none = W.with_quantiles(df.limit(0).agg(F.count("*").alias("n")), df.limit(0), {"qx": F.col("x")}, at)
    assert [tuple(r) for r in none.collect()] == [(0, None)]
