"""Right rows where tables are large: ties of rounding, dense windows, resampling by blocks, matches in dense lists."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tradeloom.plans import catalog

T0 = dt.datetime(2024, 1, 2)


def duck_rows(sf, name):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in ("lineitem", "events", "orders"):
        try:
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
        except duckdb.IOException:
            pass
    out = c.execute(catalog.ORACLE_SQL[name])
    return [d[0] for d in out.description], out.fetchall()


def test_results_that_lie_between_two_cents_round_as_in_sql(spark, tmp_path):
    source = "/root/testdata/sf0.1/lineitem.parquet"
    duckdb.execute(f"COPY (SELECT * FROM '{source}' WHERE l_orderkey IN (20727, 2298, 60773)) TO '{tmp_path}/lineitem.parquet'")
    names, want = duck_rows(tmp_path, "exit_consistency")
    got = catalog.QUERIES["exit_consistency"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(tuple(r) for r in got) == sorted(want) and len(want) > 3


def test_bootstrap_draws_in_blocks_are_one_draw_at_a_time(spark):
    """Weights against the formula with whole numbers; AUC over scores that fill several ranges (or are one score, or unknown) against one replicate at a time; no row is copied for a replicate."""
    from tradeloom.operators import calibration as K

    rng = np.random.default_rng(4)
    for scores in (np.round(rng.random(3_000), 2), rng.random(3_000), np.full(300, 0.5)):
        rows = [(k, None if k % 97 == 0 else float(p), int(rng.random() < 0.4)) for k, p in enumerate(scores)]
        df = spark.createDataFrame(rows, "id long, p double, y int").repartition(3)
        s = np.array([r[0] for r in df.orderBy("id").select(F.pmod(K.row_hash("id"), F.lit(K.DRAWS))).collect()])
        w = np.array([[sum(((int(x) * (rep * 1_103_515_245 % K.DRAWS + 1) % K.DRAWS) + 0.5) / K.DRAWS > c for c in K.POISSON_STEPS) for x in s] for rep in range(1, 41)])
        assert (K.poisson_weights(s, 1, 40) == w).all()
        p, y = np.array([-1.0 if r[1] is None else r[1] for r in rows]), np.array([r[2] for r in rows])
        more = (p[:, None] > p[None, :]) + 0.5 * (p[:, None] == p[None, :])
        auc = [(a * y) @ more @ (a * (1 - y)) / ((a * y).sum() * (a * (1 - y)).sum()) for a in w]
        known = p >= 0
        brier = [(a[known] @ (p - y)[known] ** 2) / a.sum() for a in w]
        for one, each in ((K.bootstrap_auc, auc), (K.bootstrap, brier)):
            got = one(df, "p", "y", "id", 40).first()
            assert np.allclose([got["low"], got["mid"], got["high"]], np.quantile(each, [0.025, 0.5, 0.975]), atol=1e-12)
    assert "Generate" not in K.bootstrap(df, "p", "y", "id", 40)._jdf.queryExecution().toString()



def test_windows_of_time_make_no_pairs(spark):
    """Enrichment and exchange checks where one window holds thousands of rows: values against one window at a time, and no operator gives more rows than it was given."""
    from tradeloom.operators import joins as J

    rng = np.random.default_rng(5)
    at = lambda s: T0 + dt.timedelta(seconds=int(s))
    oi = [("A" if k % 3 else "B", at(s), float(s % 53)) for k, s in enumerate(rng.choice(40 * 3_600, 3_000, replace=False))]
    funding = [("A", at(s), float(s)) for s in (0, 8 * 3_600, 30 * 3_600)]
    opens = [*rng.integers(-3_600, 60 * 3_600, 300), 0, 8 * 3_600, 16 * 3_600, 16 * 3_600 + 1]
    trades = [(k, "C" if k % 50 == 49 else "AB"[k % 2], None if k == 7 else at(s)) for k, s in enumerate(opens)]
    kinds = "symbol string, ts timestamp, value double"
    df = spark.createDataFrame(trades, "id long, symbol string, opened_at timestamp")
    out = J.window_enrichment(df, spark.createDataFrame(oi, kinds), spark.createDataFrame(funding, kinds))
    got = {r["id"]: (r["oi_last"], r["oi_delta"], r["funding_last"]) for r in out.collect()}
    seen = lambda rows, s, t: sorted((x, v) for k, x, v in rows if t and k == s and t - dt.timedelta(hours=8) <= x <= t)
    assert len(got) == len(trades)
    for k, s, t in trades:
        o, f = seen(oi, s, t), seen(funding, s, t)
        delta = o[-1][1] / o[0][1] - 1 if len(o) > 1 and o[0][1] else None
        assert got[k] == (o[-1][1] if o else None, delta, f[-1][1] if f else None)

    size = lambda r: float(r % 7 + 1)
    x = [("A" if k % 4 else "B", at(s), "buy" if k % 2 else "sell", size(s), 2.0 + int(s) % 3) for k, s in enumerate(rng.integers(0, 7_200, 2_000))]
    held = [(k, "ABC"[k % 3], 3.0, "long" if k % 2 else "SHORT", at(s), None if k == 5 else at(s + 1_000)) for k, s in enumerate(rng.integers(-2_000, 9_000, 90))]
    positions = spark.createDataFrame(held, "id long, symbol string, size double, side string, opened_at timestamp, closed_at timestamp")
    exchange = spark.createDataFrame(x, "symbol string, ts timestamp, trade_side string, amount double, price double")
    found = {(r["id"], r["kind"]): (r["found"], r["vwap"]) for r in J.exchange_check(positions, exchange, "15m", -1.0).collect()}
    want = {}
    for k, s, _, side, a, b in held:
        for kind, t, buys in (("ENTRY_SIZE_MISMATCH", a, "long"), ("EXIT_SIZE_MISMATCH", b, "short")):
            side_wanted = "buy" if side.lower() == buys else "sell"
            near = [(q, p) for y, u, d, q, p in x if t and y == s and d == side_wanted and abs((u - t).total_seconds()) <= 900]
            if s != "C":
                want[k, kind] = (sum(q for q, _ in near), pytest.approx(sum(q * p for q, p in near) / sum(q for q, _ in near)) if near else None)
    assert found == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "timestamp_micros" not in plan


@pytest.mark.parametrize("n, ones", [(2_000, 700), (50, 50), (30, 1), (5, 0)])
def test_the_kth_place_of_each_shuffle(spark, n, ones):
    """Places hashed in blocks against hashlib; the k-th place and the sum up to it against all places in order."""
    import hashlib

    from tradeloom.operators.shuffles import kth_places

    rows = [(7 * 10 ** (k % 12) + k, k / 2) for k in range(n)]
    got = {r["rep"]: (r["h"], r["id"], r["s1"]) for r in kth_places(spark.createDataFrame(rows, "id long, r double").repartition(3), "id", "r", 30, n, ones).collect()}
    want = {}
    for rep in range(1, 31):
        order = sorted((int(hashlib.md5(f"{i}:{rep}".encode()).hexdigest()[:15], 16), i, r) for i, r in rows)[:ones]
        if order:
            want[rep] = (*order[-1][:2], sum(r for _, _, r in order))
    assert got == want


def test_streaks_run_across_ranges(spark):
    """Losses in a row that cross many ranges, whole ranges of losses, unknown results, two keys; no task holds a key."""
    from tradeloom.operators import windows as W

    rng = np.random.default_rng(8)
    for share in (0.3, 0.9, 1.0):
        rows = [(k, "AB"[k % 5 == 0], None if k % 211 == 210 else float(-1 if rng.random() < share else k % 2)) for k in range(2_000)]
        df = spark.createDataFrame(rows, "at long, symbol string, pnl double").repartition(5)
        for k in (3, 50, 150):
            want, run = {}, {}
            for at, s, pnl in rows:
                run[s] = run.get(s, 0) + 1 if pnl is not None and pnl < 0 else 0
                if run[s] >= k:
                    want.setdefault(s, at)
            out = W.loss_streak_times(df, ["symbol"], ["at"], k)
            assert {r["symbol"]: r["at"] for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert all("_part" in line for line in plan.splitlines() if "Window [" in line) and "Window [" in plan


def test_equal_spans_are_looked_up_once(spark):
    from tradeloom.operators import joins as J

    bars = spark.createDataFrame([("A", T0 + dt.timedelta(hours=k), float(k), float(k + 1)) for k in range(200)], "symbol string, ts timestamp, low double, high double")
    spans = [(T0 + dt.timedelta(hours=k % 7), T0 + dt.timedelta(hours=k % 7 + 60)) for k in range(5_000)]
    out = J.trade_extremes(spark.createDataFrame([(k, "A", *s) for k, s in enumerate(spans)], "id long, symbol string, opened_at timestamp, closed_at timestamp"), bars)
    assert {tuple(r) for r in out.collect()} == {(k, float(k % 7), float(k % 7 + 61), 61) for k in range(5_000)}
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_matches_without_candidates_are_those_of_candidates(spark):
    """Nearest and greedy matches against all candidates: equal times and ids in any order, sizes of 0, negative and at the edge of the tolerance, unknown values; the plan joins no pairs."""
    from tradeloom.operators import joins as J
    from tradeloom.operators import matches as X
    from tradeloom.operators import recursive as R

    rng = np.random.default_rng(11)
    sizes = [0.0, 1.0, 49.0, 50.0, -49.0, -50.0, 100.0, 102.0, 104.0]
    at = lambda: T0 + dt.timedelta(hours=int(rng.integers(0, 30)))
    pick = lambda k: None if k % 199 == 198 else float(rng.choice(sizes))
    price = lambda k: -1.0 if k % 97 == 96 else float(np.round(np.exp(rng.normal(4, 0.2)), 2))
    s = [(k, "AB"[k % 2], pick(k), price(k), None if k % 150 == 149 else at()) for k in range(400)]
    p = [(int(i), "AB"[k % 2], pick(k), price(k), at()) for k, i in enumerate(rng.permutation(1_500))]
    s = spark.createDataFrame(s, "statement_id long, symbol string, qty double, entry double, closed_at timestamp").repartition(3)
    p = spark.createDataFrame(p, "position_id long, symbol string, size double, entry_price double, opened_at timestamp").repartition(3)
    c = J.match_candidates(s, p, 0.02).cache()
    near, greedy = X.nearest_of(s, p, 0.02), X.greedy_of(s, p, 0.02)
    want = {tuple(r) for r in J.nearest_match(c).select("statement_id", "position_id", "gap").collect()}
    assert {tuple(r) for r in near.collect()} == want and len(want) > 150
    want = {tuple(r) for r in R.greedy_match(c).collect()}
    assert {tuple(r) for r in greedy.collect()} == want and len(want) > 150
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_of_many_that_just_do_not_fit(spark, monkeypatch):
    """50,000 newer positions a little out of the tolerance are not looked through one by one; dense sizes, ties of time and prices on the edge give the matches of candidates."""
    from tradeloom.operators import joins as J
    from tradeloom.operators import matches as X

    rng = np.random.default_rng(12)
    asks, below = [], X._Levels.below
    monkeypatch.setattr(X._Levels, "below", lambda self, first, end, limit: asks.append(len(first)) or below(self, first, end, limit))
    n, m = 50_000, 300
    price = np.where(np.arange(n) == 0, 101.0, 102.9)
    one = lambda x, k: np.full(k, x)
    best = X._nearest(one(10.0, n), price, np.arange(n), one(10.0, m), one(100.0, m), one(n + 5, m), 0.02)
    assert (best == 0).all() and asks == [m]
    size = np.exp(rng.normal(3, 0.3, n))  # no two alike
    asks.clear()
    best = X._nearest(size, price, np.arange(n), size[:m], one(104.0, m), one(n + 5, m), 0.02)
    fits = lambda k: np.flatnonzero((np.abs(size - size[k]) <= 0.02 * np.maximum(size, size[k])) & (np.abs(price - 104.0) <= 0.02 * 104.0))
    assert [int(b) for b in best] == [int(fits(k).max(initial=-1)) for k in range(m)] and sum(asks) <= 2 * n.bit_length() * m

    edge = lambda k: [100.0, 98.0, 100 / 0.98, 97.99999999999999, 102.0, 102.04081632653062, 0.0][k % 7]
    s = [(k, "A", float(edge(k)), float(edge(k // 7) or 1.0), T0 + dt.timedelta(hours=int(rng.integers(0, 5)))) for k in range(200)]
    p = [(int(i), "A", float(edge(k // 7)), float(edge(k) or 1.0), T0 + dt.timedelta(hours=int(rng.integers(0, 5)))) for k, i in enumerate(rng.permutation(300))]
    s = spark.createDataFrame(s, "statement_id long, symbol string, qty double, entry double, closed_at timestamp")
    p = spark.createDataFrame(p, "position_id long, symbol string, size double, entry_price double, opened_at timestamp")
    want = {tuple(r) for r in J.nearest_match(J.match_candidates(s, p, 0.02)).select("statement_id", "position_id", "gap").collect()}
    assert {tuple(r) for r in X.nearest_of(s, p, 0.02).collect()} == want and len(want) > 100
