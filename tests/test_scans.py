"""Scans, medians, range aggregates and touches against plain forms, with one symbol that holds all rows."""

import datetime as dt
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradeloom.functions import rules as rules_of
from tradeloom.operators import joins as J
from tradeloom.operators import scans as N
from tradeloom.operators import windows as W

T0 = dt.datetime(2024, 1, 1)


def one_symbol(spark, n, gaps=False):
    rng = np.random.default_rng(8)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.002, n)))
    spread = rng.uniform(0.0005, 0.002, n)
    pdf = pd.DataFrame({"symbol": "A", "ts": [T0 + dt.timedelta(minutes=5 * k) for k in range(n)], "open": close, "high": close * (1 + spread), "low": close * (1 - spread), "close": close, "volume": rng.integers(1, 90, n).astype(float)})
    if gaps:  # missing values at the start, inside, and for a whole block
        for a, b in ((0, 3), (50, 55), (288, 576), (1_000, 1_001)):
            pdf.loc[a : b - 1, "close"] = np.nan
    return pdf, spark.createDataFrame(pdf).withColumn("close", F.when(~F.isnan("close"), F.col("close"))).repartition(4)


def plain_indicators(g, span=20, n=14, slope=3):
    wilder = lambda x: x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
    mean = lambda x, s: x.ewm(span=s, adjust=False, min_periods=s).mean()
    before = g.close.shift()
    atr = wilder(pd.concat([g.high - g.low, (g.high - before).abs(), (g.low - before).abs()], axis=1).max(axis=1))
    move, up, down = g.close.diff(), g.high.diff(), -g.low.diff()
    gain, loss = wilder(move.clip(lower=0)), wilder(-move.clip(upper=0))
    plus, minus = wilder(up.where((up > down) & (up > 0), 0.0)), wilder(down.where((down > up) & (down > 0), 0.0))
    adx = wilder((100 * (plus - minus).abs() / (plus + minus).where(plus + minus != 0)).fillna(0.0).where(plus.notna()))
    macd = mean(g.close, 12) - mean(g.close, 26)
    hist = macd - mean(macd, 9)
    rsi = (100 - 100 / (1 + gain / loss.where(loss != 0))).where(loss != 0, 100.0).where(gain.notna())
    return pd.DataFrame({"ema": g.close.ewm(span=span, adjust=False).mean(), "atr": atr, "rsi": rsi, "adx": adx, "macd": macd, "macd_signal": macd - hist, "macd_hist": hist, "macd_slope": hist.diff(slope)})


@pytest.mark.parametrize("gaps", [False, True])
@pytest.mark.parametrize("block", ["10m", "1d", "30d"])
def test_means_of_one_symbol_over_many_blocks(spark, block, gaps):
    pdf, df = one_symbol(spark, 1_500, gaps)
    out = N.with_indicators(df, block=block)
    got = out.toPandas().sort_values("ts", ignore_index=True)
    want = plain_indicators(pdf)
    for c in N.INDICATORS:
        assert np.allclose(got[c].astype(float), want[c], rtol=1e-9, atol=1e-9, equal_nan=True), c
    means = N.with_means(df, {"m": ("close", 0.01), "t": ("true_range", 0.3)}, block).toPandas().sort_values("ts", ignore_index=True)
    assert np.allclose(means["m"].astype(float), pdf.close.ewm(alpha=0.01, adjust=False).mean(), rtol=1e-9, equal_nan=True)


def test_no_group_holds_a_symbol(spark):
    """The last pass maps over blocks of a day at most; no plan groups rows by symbol."""
    _, df = one_symbol(spark, 8_640)
    blocks = N._blocks(df, "1d")
    assert blocks.count() == 30 and blocks.agg(F.max(F.size("ts"))).first()[0] == 288
    plan = N.with_indicators(df, block="1d")._jdf.queryExecution().toString()
    assert "FlatMapGroupsInPandas" not in plan and "Window" not in plan and "MapInArrow" in plan


def test_medians(spark):
    rng = random.Random(3)
    rows = [(s, T0 + dt.timedelta(minutes=k), rng.choice([None, float(rng.randrange(9)), rng.random()]), k) for s in ("A", "B") for k in range(400)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, x double, k int").repartition(5)
    for n in (None, 1, 2, 37):
        got = {(r["symbol"], r["k"]): r["m"] for r in N.with_median(df, "x", "m", n, least=3).collect()}
        for s in ("A", "B"):
            values = [r[2] for r in rows if r[0] == s]
            for k in range(400):
                held = [v for v in values[0 if n is None else max(0, k - n + 1) : k + 1] if v is not None]
                want = statistics.median(held) if len(held) >= 3 else None
                assert got[s, k] == want or abs(got[s, k] - want) < 1e-12
    assert N.with_median(df.where("false"), "x", "m").count() == 0


def test_long_frames(spark):
    """30 days of five minutes, and an expanding median of 200,000 rows, of one symbol."""
    pdf, df = one_symbol(spark, 30_000)
    got = W.with_volume_multiple(df).toPandas().sort_values("ts", ignore_index=True)
    assert np.allclose(got["volume_multiple"].astype(float), pdf.volume / pdf.volume.rolling(8_640, min_periods=864).median(), equal_nan=True)
    many = spark.range(200_000).select(F.lit("A").alias("symbol"), F.timestamp_seconds(F.col("id") * 300).alias("ts"), (F.col("id") * 7_919 % 100_003).cast("double").alias("x"), "id")
    last = N.with_median(many, "x", "m").where("id = 199999").first()["m"]
    assert last == statistics.median([k * 7_919 % 100_003 for k in range(200_000)])


def test_rules_at_their_defaults(spark):
    """The retest and the volume rule at the full 288 and 8,640 bars, against plain windows."""
    pdf, df = one_symbol(spark, 9_000)
    df = df.withColumn("level", F.round(F.lit(100.0) + F.floor(F.unix_timestamp("ts") / 86_400) % 7, 1))
    pdf["level"] = 100.0 + np.array([int((t - dt.datetime(1970, 1, 1)).total_seconds()) // 86_400 % 7 for t in pdf.ts])
    df = N.with_median(W.with_touch(df, "level"), "volume", "median", 8_640)
    got = df.select("ts", "touched", rules_of.RULES["pullback_retest_close_above_break"](level="level").alias("retest"), rules_of.RULES["volume_median_multiple"](median="median").alias("surge")).toPandas().sort_values("ts", ignore_index=True)
    low, high, level = pdf.low.to_numpy(), pdf.high.to_numpy(), pdf.level.to_numpy()
    touched = np.array([((low[max(0, k - 287) : k + 1] <= level[k] * 1.003) & (high[max(0, k - 287) : k + 1] >= level[k] * 0.997)).any() for k in range(len(pdf))])
    assert (got.touched == touched).all() and touched.any() and not touched.all()
    assert (got.retest == (touched & (pdf.close > level) & (np.arange(len(pdf)) >= 292))).all()
    assert (got.surge == ((pdf.volume >= 2 * pdf.volume.rolling(8_640, min_periods=1).median()) & (np.arange(len(pdf)) >= 99))).all()


def test_touch_of_levels_that_change_at_each_bar(spark):
    rng = random.Random(6)
    rows = [("A", T0 + dt.timedelta(minutes=k), *sorted([rng.random(), rng.random()]), rng.choice([None, rng.random(), 0.5])) for k in range(300)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, low double, high double, level double")
    got = {r["ts"]: r["touched"] for r in W.with_touch(df, "level", 0.01, 4).collect()}
    for k, (_, ts, _, _, level) in enumerate(rows):
        want = level is not None and any(lo <= level * 1.01 and hi >= level * 0.99 for _, _, lo, hi, _ in rows[max(0, k - 3) : k + 1])
        assert got[ts] == want
    assert W.with_touch(df.where("false"), "level").count() == 0


def test_trades_of_any_length_read_few_cells(spark):
    pdf, bars = one_symbol(spark, 110_000)  # more than a year
    rng = random.Random(2)
    trades = []
    for k in range(300):
        a = T0 + dt.timedelta(seconds=rng.randrange(110_000 * 300))
        trades.append((k, "A" if k % 50 else "B", a, a + dt.timedelta(seconds=rng.choice([0, 1, 299, 300, 3_600, 90_000, rng.randrange(40_000_000)]))))
    trades += [(900, "A", T0, T0), (901, "A", T0 + dt.timedelta(hours=2), T0), (902, "A", None, T0), (903, "A", T0 - dt.timedelta(days=900), T0 + dt.timedelta(days=900))]
    t = spark.createDataFrame(trades, "id long, symbol string, opened_at timestamp, closed_at timestamp")
    got = {r["id"]: (r["lo"], r["hi"], r["n_bars"]) for r in J.trade_extremes(t, bars).collect()}
    want = {}
    for k, s, a, b in trades:
        if s == "A" and a and a <= b:
            held = pdf[(pdf.ts >= a) & (pdf.ts <= b)]
            if len(held):
                want[k] = (held.low.min(), held.high.max(), len(held))
    assert got == want and len(want) > 200
    read = J.trade_cells(t, 15).groupBy("id").count().agg(F.max("count")).first()[0]
    assert read <= 32


def test_one_long_chain_of_signals(spark):
    """100,000 signals of one symbol, with ties, against one pass."""
    rng = random.Random(4)
    at, rows = 0, []
    for k in range(100_000):
        at += rng.choice([0, 1, 7, 30, 61, 60, 500])
        rows.append((at, k))
    df = spark.createDataFrame(rows, "s long, id long").select(F.lit("A").alias("symbol"), F.timestamp_seconds("s").alias("ts"), "id").repartition(8)
    last, want = None, set()
    for s, k in rows:
        if last is None or s - last >= 60:
            want.add(k)
            last = s
    from tradeloom.operators import recursive as R

    found = R.accepted_signals(df, 60)
    assert {r["id"] for r in found.where("accepted").collect()} == want and found.count() == len(rows)
    one = spark.createDataFrame([(None, T0, 1), (None, T0, 2), ("B", None, 3)], "symbol string, ts timestamp, id long")
    assert sorted((r["id"], r["accepted"]) for r in R.accepted_signals(one, 60).collect()) == [(1, True), (2, False), (3, False)]
    assert R.accepted_signals(one, 0).where("accepted").count() == 2 and R.accepted_signals(one.where("false"), 60).count() == 0


def test_curve_of_one_account(spark):
    from tradeloom.operators import performance as P

    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"tag": rng.choice(["x", "y"], 5_000), "at": rng.permutation(5_000), "pnl": np.round(rng.normal(0, 50, 5_000), 2)})
    df = spark.createDataFrame(pdf).withColumn("pnl", F.when(F.col("at") > 2, F.col("pnl"))).repartition(7)
    for by in ([], ["tag"]):
        want = P.drawdowns(P.equity_curve(df, by, 1_000.0, ["at"]), by, ["at"]).toPandas().sort_values("at")
        got = P.account_curve(df, by, 1_000.0, ["at"]).toPandas().sort_values("at")
        assert list(got.columns) == list(want.columns)
        for c in ("equity", "peak", "dd"):
            assert np.allclose(got[c].astype(float), want[c].astype(float), atol=1e-8, equal_nan=True)
    assert P.account_curve(df.where("false"), [], 0.0, ["at"]).count() == 0


def test_positions_over_jdbc(spark, tmp_path):
    """Eight reads by ranges of time from an embedded database; filters and columns reach it."""
    from tradeloom.sources import tables as T

    url, driver = f"jdbc:derby:{tmp_path}/positions;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    rows = spark.range(800).select("id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 3_600).alias("opened_at"), F.when(F.col("id") % 3 == 0, "OPEN").otherwise("CLOSED").alias("status"), (F.col("id") * 0.5).alias("pnl"))
    rows.coalesce(1).write.format("jdbc").option("url", url).option("driver", driver).option("dbtable", "positions").option("createTableColumnTypes", "status VARCHAR(16)").save()
    got = T.read_positions(spark, url, "positions", ("2024-01-01", "2024-02-03"), 8, driver=driver)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert got.rdd.getNumPartitions() == 8 and len(sizes) == 8 and sum(sizes) == 800
    plain = lambda df: sorted(tuple(r) for r in df.collect())
    kept = T.closed_positions(got, "2024-01-05", "2024-01-20").select("id", "pnl")
    assert plain(kept) == plain(T.closed_positions(rows, "2024-01-05", "2024-01-20").select("id", "pnl"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*" in plan and "STATUS" in plan.upper() and "*GreaterThanOrEqual" in plan


def plain_switching(r, steps):
    """The same model, one row after another."""
    order = np.argsort(np.abs(r - r.mean()), kind="stable")
    half, n = len(r) // 2, len(r)
    var = np.array([r[order[:half]].var(), r[order[half:]].var()]) + 1e-12
    mean, trans, start = np.full(2, r.mean()), np.array([[0.95, 0.05], [0.05, 0.95]]), np.full(2, 0.5)
    for step in range(steps + 1):
        density = np.exp(-0.5 * (r[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
        alpha = np.empty((n, 2))
        beta = np.ones((n, 2))
        for k in range(n):
            a = (start if k == 0 else alpha[k - 1] @ trans) * density[k]
            alpha[k] = a / a.sum()
        if step == steps:
            return alpha, mean, var
        for k in range(n - 2, -1, -1):
            b = trans @ (density[k + 1] * beta[k + 1])
            beta[k] = b / b.sum()
        smooth = alpha * beta
        smooth /= smooth.sum(1, keepdims=True)
        moves = np.zeros((2, 2))
        for k in range(n - 1):
            j = alpha[k][:, None] * trans * (density[k + 1] * beta[k + 1])[None]
            moves += j / j.sum()
        mean = (smooth * r[:, None]).sum(0) / smooth.sum(0)
        var = (smooth * (r[:, None] - mean) ** 2).sum(0) / smooth.sum(0) + 1e-12
        trans, start = moves / moves.sum(1, keepdims=True), smooth[0]


@pytest.mark.parametrize("steps", [0, 1, 20])
def test_switching_filter_against_rows_in_turn(steps):
    from tradeloom.operators import recursive as R

    rng = np.random.default_rng(5)
    calm = np.repeat(rng.integers(0, 2, 25), 20)
    r = rng.normal(0, np.where(calm, 0.01, 0.05))
    got, want = R.switching_filter(r, steps), plain_switching(r, steps)
    assert all(np.allclose(a, b, rtol=1e-6, atol=1e-9) for a, b in zip(got, want, strict=True))
    assert R.filter_pass(r[:1], np.zeros(2), np.ones(2), np.full((2, 2), 0.5), np.full(2, 0.5))[0].tolist() == [[0.5, 0.5]]


def test_isotonic_fit(spark):
    """Against pooling in one pass, with ties, rising and falling data, and values between and beyond the blocks."""
    from tradeloom.operators import learning as M

    rng = random.Random(8)
    for draw in (lambda p: rng.random() < p, lambda p: rng.random() < 1 - p, lambda p: p > 0.5):
        rows = [(rng.randrange(400) / 400, 0) for _ in range(3_000)]
        rows = [(p, int(draw(p))) for p, _ in rows]
        df = spark.createDataFrame(rows, "p double, y int").repartition(4)
        xs = sorted({p for p, _ in rows})
        n = [sum(p == x for p, _ in rows) for x in xs]
        means = M.monotone([sum(y for p, y in rows if p == x) / k for x, k in zip(xs, n, strict=True)], n)
        blocks = M.isotonic_blocks(df)
        at = spark.createDataFrame([(x,) for x in [*xs, -0.5, 1.5, 0.00125, 0.50125, None]], "p double")
        got = {r["p"]: r["p_cal"] for r in M.apply_isotonic(at, blocks).collect()}
        assert len(got) == at.count() and got[None] is None
        assert np.allclose([got[x] for x in [*xs, -0.5, 1.5, 0.00125, 0.50125]], np.interp([*xs, -0.5, 1.5, 0.00125, 0.50125], xs, means), atol=1e-12)
    assert M.isotonic_blocks(df.where("false")).count() == 0
