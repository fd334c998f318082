"""Queries over rule predicates, live lines, and what trades and statements leave open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import rules as X
from ..operators import asof as A
from ..operators import calibration as K
from ..operators import joins as J
from ..operators import logs as L
from ..operators import matches
from ..operators import performance as P
from ..operators import recursive as R
from ..operators import scans as N
from ..operators import windows as W
from ..sources import tables as ST
from . import domain as D
from . import trade_queries as T
from .domain import rounded, sql
from .registry import query

S = SparkSession
BY = "PARTITION BY symbol ORDER BY ts"

_BARS = f"""b AS (SELECT *, row_number() OVER ({BY}) AS k, greatest(high - low, coalesce(abs(high - lag(close) OVER ({BY})), 0), coalesce(abs(low - lag(close) OVER ({BY})), 0)) AS tr,
  max(high) OVER ({BY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS hh, avg(volume) OVER ({BY} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS mv, quantile_cont(volume, 0.5) OVER ({BY} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS med FROM bars),
e AS (SELECT symbol, k, close AS f, close AS s, tr AS a FROM b WHERE k = 1 UNION ALL SELECT b.symbol, b.k, e.f + (b.close - e.f) * 2 / 11, e.s + (b.close - e.s) * 2 / 31, e.a + (b.tr - e.a) / 14 FROM e JOIN b ON b.symbol = e.symbol AND b.k = e.k + 1),
r AS (SELECT *, list({{'low': low, 'high': high}}) OVER ({BY} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS recent FROM b JOIN e USING (symbol, k))
SELECT symbol, ts, k >= 12 AND close > hh AS breakout, coalesce(k >= 35 AND s > 0 AND (s - close) / s BETWEEN 0 AND 0.5, false) AS pullback, coalesce(k >= 15 AND mv > 0 AND volume >= 1.2 * mv, false) AS surge, k >= 35 AND f > s AS trend,
  k >= 19 AND a / close >= 0.9 AS lively, coalesce(k >= 29 AND close > hh AND len(list_filter(recent, lambda x: x.low <= hh * 1.1 AND x.high >= hh * 0.9)) > 0, false) AS retest, k >= 30 AND CASE WHEN med > 0 THEN volume / med ELSE 0 END >= 1.1 AS over_median FROM r"""


@query(sql("bars", _BARS).replace("WITH ", "WITH RECURSIVE ", 1))
def bar_rules(spark: S, sf: str) -> DataFrame:
    bars = N.with_means(D.bars(spark, sf), {"fast": ("close", 2 / 11), "slow": ("close", 2 / 31), "atr": ("true_range", 1 / 14)})
    bars = bars.withColumn("level", F.max("high").over(X.bars().rowsBetween(-10, -1)))
    bars = N.with_median(W.with_touch(bars, "level", band=0.1, lookback=24), "volume", "median", 48)
    rules = {
        "breakout": X.RULES["channel_breakout"](period=10),
        "pullback": X.RULES["pullback_under_ma"](mean="slow", period=30, most=0.5),
        "surge": X.RULES["volume_surge"](win=10, times=1.2),
        "trend": X.RULES["trend_filter_ema"](fast="fast", slow="slow", period=30),
        "lively": X.RULES["micro_vol_filter"](atr="atr", least=0.9),
        "retest": X.RULES["pullback_retest_close_above_break"](level="level", lookback=24),
        "over_median": X.RULES["volume_median_multiple"](median="median", times=1.1, least=30),
    }
    return bars.select("symbol", "ts", *[c.alias(n) for n, c in rules.items()])


@query(sql("bars days", f"l AS (SELECT symbol, CAST(ts AS DATE) AS d, CASE WHEN row_number() OVER ({BY}) >= 7 THEN max(high) OVER ({BY} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) END AS lv FROM days), j AS (SELECT b.*, last_value(l.lv IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS UNBOUNDED PRECEDING) AS lv FROM bars b LEFT JOIN l ON l.symbol = b.symbol AND l.d = CAST(b.ts AS DATE)) SELECT symbol, ts, lv AS daily_level, coalesce(close > lv, false) AS confirmed, coalesce(close > CASE WHEN hour(ts) % 6 = 0 THEN open ELSE lv END, false) AS confirmed_injected FROM j"))
def daily_confirm(spark: S, sf: str) -> DataFrame:
    bars = W.with_daily_level(D.bars(spark, sf), D.bars(spark, sf, "1d"), 5).withColumn("brought", F.when(F.hour("ts") % 6 == 0, F.col("open")).otherwise(F.lit(float("inf"))))
    rule = X.RULES["channel_breakout_daily_confirm"]
    return bars.select("symbol", "ts", "daily_level", rule().alias("confirmed"), rule(injected="brought").alias("confirmed_injected"))


@query(sql("decisions", "x AS (SELECT *, CASE WHEN id % 7 <> 0 THEN day(ts) END AS age, CASE WHEN id % 5 <> 0 THEN ts - to_hours(CAST(id % 20 AS INTEGER)) END AS ex, p - 0.4 AS h, p * 100 AS rs, id % 1000 * 1000.0 AS liq FROM decisions), y AS (SELECT id, symbol IN ('S3') AS bad, symbol <> 'S5' AS ok0, coalesce(ts - ex >= INTERVAL 6 HOUR, true) AS ok1, coalesce(age >= 3, false) AS ok2, h >= 0 AS ok3, rs >= 30 AS ok4, liq >= 100000 AS ok5, p > 0.5 AND h > 0 AS ok6 FROM x) SELECT id, NOT bad AND ok0 AND ok1 AND ok2 AND ok3 AND (ok4 OR ok5 OR ok6) AS should_enter, array_to_string(list_filter([CASE WHEN bad THEN 'veto:symbol_is' END, CASE WHEN ok0 THEN 'blacklist_symbol' END, CASE WHEN ok1 THEN 'cooldown_hours' END, CASE WHEN ok2 THEN 'min_listing_age_days' END, CASE WHEN ok3 THEN 'eth_macd_hist_above' END, CASE WHEN ok4 THEN 'universe_rs_pct_gte' END, CASE WHEN ok5 THEN 'liquidity_median_24h_usd_gte' END, CASE WHEN ok6 THEN 'eth_macd_bull' END], lambda v: v IS NOT NULL), ',') AS tags FROM y"))
def context_rules(spark: S, sf: str) -> DataFrame:
    d = D.decisions(spark, sf).withColumns({
        "age_days": F.when(F.col("id") % 7 != 0, F.day("ts")),
        "last_exit": F.when(F.col("id") % 5 != 0, F.timestamp_micros(F.unix_micros("ts") - F.col("id") % 20 * 3_600_000_000)),
        "eth_macd_hist": F.col("p") - 0.4, "eth_macd": F.col("p"), "eth_macd_signal": F.lit(0.5), "rs_pct": F.col("p") * 100, "liquidity": F.col("id") % 1000 * 1000.0,
    })
    spec = {
        "veto": {"any": [{"symbol_is": {"op": "==", "value": "S3"}}]},
        "entry": {
            "all": [{"blacklist_symbol": {"symbols": ["S5"]}}, {"cooldown_hours": {"hours": 6}}, {"min_listing_age_days": {"days": "@age"}}, {"eth_macd_hist_above": {"least": 0.0}}],
            "any": [{"universe_rs_pct_gte": {"least": 30}}, {"liquidity_median_24h_usd_gte": {"least": 100_000}}, "eth_macd_bull"],
        },
    }
    enter, tags = C.evaluate_rules(spec, X.RULES | {"symbol_is": lambda op, value: C.compare(F.col("symbol"), op, value)}, {"age": 3})
    return d.select("id", enter.alias("should_enter"), F.concat_ws(",", tags).alias("tags"))


_COMPARED = {"==": (0.3, "x = 0.3"), "!=": (0.3, "x <> 0.3"), "<": (0.3, "x < 0.3"), "<=": (0.3, "x <= 0.3"), ">": (0.6, "x > 0.6"), ">=": (0.6, "x >= 0.6"), "outside": ([0.2, 0.8], "x < 0.2 OR x > 0.8"), "is_true": (None, "x <> 0"), "is_false": (None, "x = 0")}


@query(sql("decisions", "t AS (SELECT id, CASE WHEN id % 9 <> 0 THEN CASE WHEN id % 10 = 0 THEN 0 ELSE p END END AS x FROM decisions) SELECT id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{op}' END" for op, (_, c) in _COMPARED.items()) + "], lambda v: v IS NOT NULL), ' ') AS holds FROM t"))
def comparisons(spark: S, sf: str) -> DataFrame:
    x = F.when(F.col("id") % 9 != 0, F.when(F.col("id") % 10 == 0, 0.0).otherwise(F.col("p")))
    return D.decisions(spark, sf).select("id", F.concat_ws(" ", *[F.when(C.compare(x, op, v), op) for op, (v, _) in _COMPARED.items()]).alias("holds"))


_LINES = {
    0: ("'Checking S' || u || '...'", "check"),
    1: ("'OHLCV_LIMIT symbol=S' || u || ' base_tf=5m x base_limit=' || e", "ohlcv_limit"),
    2: ("'ENTRY_QUAL_BACKFILL symbol=S' || u || ' from=' || e || ' to=' || (e + 5)", "backfill"),
    3: ("'Signal for S' || u || ' vetoed: too new'", "veto"),
    4: ("'SIGNAL S' || u || ' @ 1.5 | regime=RISK_ON | wp=' || e || '%'", "signal"),
    5: ("'OPENED LONG S' || u || ' at ' || e", "open"),
    6: ("'WATCHDOG symbol=S' || u || ' stage=fetch_bars age=' || e || 's'", "watchdog"),
    7: ("'OHLCV_INSUFFICIENT symbol=S' || u || ' tf=1h have=' || e || ' need=99'", "ohlcv_insufficient"),
    8: ("'SCAN_SKIP symbol=S' || u || ' stage=gate:meta n=' || e", "scan_skip"),
    9: ("'FEATURE_MISSING symbol=S' || u || ' missing=[a, b]'", "feature_missing"),
    10: ("'unrelated ' || e", None),
}
_CASE = "CASE e % 11 " + " ".join(f"WHEN {k} THEN {text}" for k, (text, _) in _LINES.items()) + " END"
_KIND = "CASE e % 11 " + " ".join(f"WHEN {k} THEN '{kind}'" for k, (_, kind) in _LINES.items() if kind) + " END"
_VALUE = "CASE e % 11 WHEN 1 THEN '' || e WHEN 2 THEN '' || (e + 5) WHEN 3 THEN 'too new' WHEN 4 THEN '' || e WHEN 5 THEN 'LONG' WHEN 6 THEN '' || e WHEN 7 THEN '' || e WHEN 8 THEN 'gate:meta' WHEN 9 THEN 'a, b' ELSE '' END"


@query(f"WITH x AS (SELECT event_id AS e, user_id % 8 AS u FROM events) SELECT 'S' || u AS symbol, {_KIND} AS kind, count(*) AS n, max({_VALUE}) AS last_value FROM x WHERE e % 11 <> 10 GROUP BY ALL")
def live_lines(spark: S, sf: str) -> DataFrame:
    lines = D.table(spark, sf, "events").select(F.col("event_id").alias("e"), (F.col("user_id") % 8).alias("u")).select(F.expr(_CASE).alias("value"))
    return L.live_lines(lines).groupBy("symbol", "kind").agg(F.count("*").alias("n"), F.max("detail").alias("last_value"))


@query(sql("trades", T.MATCH.replace("entry * 1.001 AS entry", "CASE WHEN id % 8 = 0 THEN entry * 50 ELSE entry * 1.001 END AS entry") + " SELECT statement_id, symbol, qty FROM st WHERE statement_id NOT IN (SELECT statement_id FROM cand)"))
def unmatched_statements(spark: S, sf: str) -> DataFrame:
    t = D.trades(spark, sf)
    entry = F.when(F.col("id") % 8 == 0, F.col("entry") * 50).otherwise(F.col("entry") * 1.001)
    s = t.where("id % 4 = 0").select(F.col("id").alias("statement_id"), "symbol", F.col("size").alias("qty"), entry.alias("entry"), "closed_at")
    c = matches.nearest_of(s, t.select(F.col("id").alias("position_id"), "symbol", "size", F.col("entry").alias("entry_price"), "opened_at"), 0.02)
    return J.unmatched(s, c).select("statement_id", "symbol", "qty")


_EXIT = "x AS (SELECT id, symbol, CASE WHEN id % 5 = 0 THEN size / 2 ELSE size END AS amount, CASE side WHEN 'long' THEN 'sell' ELSE 'buy' END AS trade_side, closed_at + to_minutes(10) AS ts FROM trades WHERE symbol <> 'S7'), h AS (SELECT p.id, sum(x.amount) AS f FROM trades p JOIN x ON p.symbol = x.symbol AND CASE p.side WHEN 'short' THEN 'buy' ELSE 'sell' END = x.trade_side AND x.ts BETWEEN p.closed_at - INTERVAL 15 MINUTE AND p.closed_at + INTERVAL 15 MINUTE GROUP BY p.id)"


@query(sql("trades", _EXIT + " SELECT p.id, p.size AS expected, coalesce(h.f, 0) AS found FROM trades p LEFT JOIN h USING (id) WHERE p.symbol <> 'S7' AND abs(p.size - coalesce(h.f, 0)) > 0.001"))
def exchange_exit_mismatches(spark: S, sf: str) -> DataFrame:
    t = D.trades(spark, sf)
    at = F.timestamp_seconds(F.unix_timestamp("closed_at") + 600)
    x = t.where("symbol <> 'S7'").select("symbol", at.alias("ts"), F.when(F.col("side") == "long", "sell").otherwise("buy").alias("trade_side"), F.when(F.col("id") % 5 == 0, F.col("size") / 2).otherwise(F.col("size")).alias("amount"), F.col("entry").alias("price"))
    return J.exchange_check(t, x, "15m", 0.001).where("kind = 'EXIT_SIZE_MISMATCH'").select("id", "expected", "found")


@query(sql("trades", T.CURVE + ", g AS (SELECT tag, count(*) AS n, avg(r) AS ar, min(dd) AS m, arg_min(equity, (closed_at, id)) AS a, arg_max(equity, (closed_at, id)) AS b, greatest(1, (epoch_us(max(closed_at)) - epoch_us(min(closed_at))) / 86400e6) AS d FROM dd GROUP BY tag), h AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN pow(b / a, 365 / d) - 1 END AS c FROM g) SELECT tag, n, round(ar, 6) AS avg_r, round(m, 6) AS max_dd, round(c, 5) AS cagr, round(c / nullif(abs(m), 0), 4) AS mar, row_number() OVER (ORDER BY round(c / nullif(abs(m), 0), 4) DESC NULLS LAST, tag) AS rank FROM h"))
def leaderboard_growth(spark: S, sf: str) -> DataFrame:
    """Variants ranked by return over drawdown: one curve, one aggregation; the ranking window holds one row for each variant."""
    from pyspark.sql import Window

    curve = T._curve(spark, sf)
    out = P.curve_metrics(curve, ["tag"], "closed_at").join(curve.groupBy("tag").agg(F.count("*").alias("n"), F.avg("r").alias("avg_r")), "tag")
    out = rounded(rounded(rounded(out, 6, "avg_r", "max_dd"), 5, "cagr"), 4, "mar")
    best = Window.orderBy(F.col("mar").desc_nulls_last(), "tag")
    return out.select("tag", "n", "avg_r", "max_dd", "cagr", "mar", F.row_number().over(best).alias("rank"))


@query(sql("trades", "t AS (SELECT k / 20 AS threshold FROM generate_series(0, 20) g(k)), s AS (SELECT threshold, count(*) AS n, round(sum(pnl), 2) AS net FROM trades JOIN t ON p >= threshold GROUP BY threshold) SELECT round(threshold, 4) AS threshold, n, net FROM s WHERE n >= 20 ORDER BY net DESC, threshold LIMIT 1"))
def threshold_by_net_pnl(spark: S, sf: str) -> DataFrame:
    return K.best_by_net(D.trades(spark, sf), "p", "pnl", [k / 20 for k in range(21)], 20)


_U = "CAST('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 15) AS BIGINT)"
_STEPS = " + ".join(f"CAST(u > {s!r} AS INTEGER)" for s in K.POISSON_STEPS)


@query(sql("trades", f"s AS (SELECT p, y, {_U} % 2147483647 AS s FROM trades), u AS (SELECT p, y, rep, (s * (rep * 1103515245 % 2147483647 + 1) % 2147483647 + 0.5) / 2147483647 AS u FROM s, generate_series(1, 2000) g(rep)), w AS (SELECT *, {_STEPS} AS w FROM u), b AS (SELECT rep, sum(w * pow(p - y, 2)) / sum(w) AS brier FROM w GROUP BY rep) SELECT 'brier' AS metric, round(quantile_cont(brier, 0.025), 6) AS low, round(quantile_cont(brier, 0.5), 6) AS mid, round(quantile_cont(brier, 0.975), 6) AS high FROM b"))
def bootstrap_brier(spark: S, sf: str) -> DataFrame:
    return rounded(K.bootstrap(D.trades(spark, sf), "p", "y", "id", 2_000), 6, "low", "mid", "high")


@query(sql("trades", f"s AS (SELECT p, y, {_U} % 2147483647 AS s FROM trades), u AS (SELECT p, y, rep, (s * (rep * 1103515245 % 2147483647 + 1) % 2147483647 + 0.5) / 2147483647 AS u FROM s, generate_series(1, 2000) g(rep)), w AS (SELECT *, {_STEPS} AS w FROM u), c AS (SELECT rep, p, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM w GROUP BY rep, p), x AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY rep ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c), b AS (SELECT rep, sum(pos * (below + 0.5 * neg)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM x GROUP BY rep) SELECT 'auc' AS metric, round(quantile_cont(auc, 0.025), 6) AS low, round(quantile_cont(auc, 0.5), 6) AS mid, round(quantile_cont(auc, 0.975), 6) AS high FROM b"))
def bootstrap_auc(spark: S, sf: str) -> DataFrame:
    return rounded(K.bootstrap_auc(D.trades(spark, sf), "p", "y", "id", 2_000), 6, "low", "mid", "high")


@query(sql("trades", "o AS (SELECT r, row_number() OVER (ORDER BY r, id) - 1 AS i FROM trades WHERE r IS NOT NULL), d AS (SELECT trial, step, CAST('0x' || substr(md5(trial || ':' || step), 1, 15) AS BIGINT) % (SELECT count(*) FROM o) AS i FROM generate_series(0, 4999) a(trial), generate_series(1, 200) b(step)), e AS (SELECT trial, step, f, 1 + f * r AS g FROM d JOIN o USING (i), (SELECT round(0.25 + 0.05 * k, 2) AS f FROM generate_series(0, 15) h(k)) v), l AS (SELECT *, sum(ln(greatest(g, 1e-12))) OVER (PARTITION BY f, trial ORDER BY step) AS a FROM e), m AS (SELECT *, 1 - exp(a - greatest(0, max(a) OVER (PARTITION BY f, trial ORDER BY step))) AS dd FROM l), b AS (SELECT f, trial, max(CAST(g <= 0 OR dd > 0.5 AS INTEGER)) AS b FROM m GROUP BY f, trial) SELECT CAST(f AS DOUBLE) AS f, round(avg(b), 6) AS breach FROM b GROUP BY f"))
def drawdown_breach(spark: S, sf: str) -> DataFrame:
    return rounded(K.drawdown_breach(D.trades(spark, sf), "r", "id", [round(0.25 + 0.05 * k, 2) for k in range(16)], 5_000, 200, 0.5), 6, "breach")


@query(sql("trades", "c AS (SELECT p, count(*) AS n FROM trades GROUP BY p), k AS (SELECT p, coalesce(sum(n) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS r FROM c), t AS (SELECT id, y, k.r FROM trades JOIN k USING (p)), b AS (SELECT count(*) AS n, sum(y) AS k, sum(r * y) AS s FROM t), h AS (SELECT t.r, rep, row_number() OVER (PARTITION BY rep ORDER BY CAST('0x' || substr(md5(id || ':' || rep), 1, 15) AS BIGINT), id) AS place FROM t, generate_series(1, 200) g(rep)), s AS (SELECT rep, sum(h.r) AS s1 FROM h, b WHERE place <= b.k GROUP BY rep) SELECT round((b.s - b.k * (b.k + 1) / 2) / (b.k * (b.n - b.k)), 6) AS auc, round((SELECT avg(CAST(s1 >= b.s AS INTEGER)) FROM s), 6) AS p_value FROM b"))
def shuffle_test(spark: S, sf: str) -> DataFrame:
    from ..operators import learning as M

    return rounded(M.shuffle_p_value(D.trades(spark, sf), "id", 200), 6, "auc", "p_value")


_FLAGS = "x AS (SELECT *, CASE exit_reason WHEN 'SL' THEN 'STOP' WHEN 'TL' THEN 'TIME' ELSE exit_reason END AS rec, pnl < 0 AS lose, abs(abs(mae_usd) - risk_usd) <= 0.15 * greatest(abs(mae_usd), abs(risk_usd)) AS near FROM trades)"


@query(sql("trades", _FLAGS + " SELECT id, rec AS recorded, CASE WHEN r >= 2.0 * (1 - 0.1) THEN 'TP' WHEN r <= -1.0 * (1 - 0.1) THEN 'STOP' WHEN lose AND near THEN 'STOP' WHEN lose AND mae_usd < 0.5 * risk_usd THEN 'TIME' ELSE 'OTHER' END AS inferred, CASE WHEN rec <> 'TP' AND r >= 2.0 * (1 - 0.1) THEN 'tp_not_recorded' WHEN rec = 'TIME' AND lose AND near THEN 'time_near_stop' WHEN rec = 'STOP' AND lose AND mae_usd < 0.5 * risk_usd THEN 'stop_far_from_stop' END AS flag FROM x"))
def exit_bands(spark: S, sf: str) -> DataFrame:
    rec = C.recorded_exit(F.col("exit_reason"))
    args = (F.col("r"), F.col("pnl"), F.col("mae_usd"), F.col("risk_usd"))
    inferred = C.exit_by_result(*args, stop_r=-1.0, tp_r=2.0, tolerance=0.1)
    return D.trades(spark, sf).select("id", rec.alias("recorded"), inferred.alias("inferred"), C.exit_flag(rec, *args, tp_r=2.0, tolerance=0.1).alias("flag"))


_ATR = f"tr AS (SELECT symbol, ts, greatest(high - low, coalesce(abs(high - lag(close) OVER ({BY})), 0), coalesce(abs(low - lag(close) OVER ({BY})), 0)) AS tr FROM bars), atr AS (SELECT symbol, ts, CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END AS atr FROM tr WINDOW w AS ({BY} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))"


@query(sql("trades bars", _ATR + ", t AS (SELECT *, CASE WHEN id % 6 = 0 THEN closed_at ELSE closed_at + to_hours(5) END AS deadline, risk_usd * 377.77319137 AS risk FROM trades), m AS (SELECT t.*, a.atr FROM t ASOF LEFT JOIN (SELECT * FROM atr WHERE atr IS NOT NULL) a ON t.symbol = a.symbol AND t.opened_at >= a.ts), e AS (SELECT t.id, min(b.low) AS lo, max(b.high) AS hi FROM t JOIN bars b ON t.symbol = b.symbol AND b.ts BETWEEN t.opened_at AND t.closed_at GROUP BY t.id), x AS (SELECT m.*, lo, hi, entry * 0.001 AS tol, entry - CASE side WHEN 'long' THEN risk / size ELSE -risk / size END AS stop, entry + CASE side WHEN 'long' THEN 3.01317391 ELSE -3.01317391 END * atr AS tp FROM m LEFT JOIN e USING (id)) SELECT id, round(stop, 2) AS implied_stop, round(tp, 2) AS tp_proxy, CASE WHEN lo IS NULL THEN 'UNKNOWN' WHEN CASE side WHEN 'long' THEN lo <= stop + tol ELSE hi >= stop - tol END THEN 'SL' WHEN abs(epoch_us(closed_at) - epoch_us(deadline)) <= 60000000 THEN 'TL' WHEN CASE side WHEN 'long' THEN hi >= tp - tol ELSE lo <= tp + tol END THEN 'TP' ELSE 'UNKNOWN' END AS exit_from_bars FROM x"))
def exits_from_bars(spark: S, sf: str) -> DataFrame:
    bars = D.bars(spark, sf)
    before = F.lag("close").over(X.bars())
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    atr = bars.withColumn("tr", true_range).withColumn("atr", W.sma("tr", 14)).select("symbol", "ts", "atr")
    deadline = F.when(F.col("id") % 6 == 0, F.col("closed_at")).otherwise(F.timestamp_micros(F.unix_micros("closed_at") + 5 * 3_600_000_000))
    t = D.trades(spark, sf).withColumns({"exit_deadline": deadline, "risk_usd": F.col("risk_usd") * 377.77319137})
    return rounded(J.exits_from_bars(t, bars, atr, 3.01317391, 10.0), 2, "implied_stop", "tp_proxy").select("id", "implied_stop", "tp_proxy", "exit_from_bars")


_REGIMES = "d AS (SELECT symbol, ts, CASE WHEN close > open THEN 1 ELSE 0 END AS trend FROM days WHERE ts < TIMESTAMP '2024-01-25'), h AS (SELECT symbol, ts, CASE WHEN date_part('hour', ts) % 5 <> 0 THEN close END AS level FROM bars WHERE ts < TIMESTAMP '2024-01-27'), x AS (SELECT z.id, z.ts, z.symbol, d.trend, d.ts AS dts FROM decisions z ASOF LEFT JOIN d ON z.symbol = d.symbol AND z.ts >= d.ts), y AS (SELECT x.*, h.level FROM x ASOF LEFT JOIN h ON x.symbol = h.symbol AND x.ts >= h.ts), e AS (SELECT symbol, max(ts) AS de FROM d GROUP BY symbol), f AS (SELECT symbol, max(ts) AS he FROM h GROUP BY symbol), w AS (SELECT y.*, coalesce(y.ts <= de AND trend IS NOT NULL, false) AS a, coalesce(y.ts <= he AND level IS NOT NULL, false) AS b FROM y LEFT JOIN e USING (symbol) LEFT JOIN f USING (symbol))"


@query(sql("days bars decisions", _REGIMES + " SELECT id, CASE WHEN a AND b THEN trend END AS trend, CASE WHEN a AND b THEN round(level, 4) END AS level, CASE WHEN NOT (a AND b) THEN concat_ws(',', CASE WHEN NOT a THEN 'daily' END, CASE WHEN NOT b THEN '4h' END) END AS lacks FROM w"))
def merged_regimes(spark: S, sf: str) -> DataFrame:
    daily = D.bars(spark, sf, "1d").where("ts < timestamp'2024-01-25'").select("symbol", "ts", (F.col("close") > F.col("open")).cast("int").alias("trend"))
    level = F.when(F.hour("ts") % 5 != 0, F.col("close")).alias("level")
    hourly = D.bars(spark, sf).where("ts < timestamp'2024-01-27'").select("symbol", "ts", level)
    kept, rejected = A.both_regimes(D.decisions(spark, sf).select("id", "symbol", "ts"), daily, hourly, ["trend"], ["level"], ["symbol"])
    return kept.select("id", "trend", F.round("level", 4).alias("level")).unionByName(rejected.select("id", "lacks"), allowMissingColumns=True)


@query(sql("trades", "e AS (SELECT list_distinct(quantile_cont(mfe_usd, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e, avg(y) AS base FROM trades), b AS (SELECT CAST(greatest(1, len(list_filter(e, lambda v: v < mfe_usd))) - 1 AS INTEGER) AS bin, mfe_usd AS x, y, pnl, base FROM trades, e) SELECT bin, count(*) AS n, round(min(x), 4) AS x_low, round(max(x), 4) AS x_high, round(avg(y), 6) AS win_rate, round(avg(pnl), 6) AS mean_result, round(avg(y) / nullif(min(base), 0), 6) AS lift FROM b GROUP BY bin"))
def feature_bins(spark: S, sf: str) -> DataFrame:
    out = K.feature_bins(D.trades(spark, sf), "mfe_usd", "y", "pnl", 5)
    return rounded(rounded(out, 4, "x_low", "x_high"), 6, "win_rate", "mean_result", "lift")


_RANK = "i AS (SELECT p, y, row_number() OVER (ORDER BY p, id) - 1 AS i, count(*) OVER () AS n FROM trades), b AS (SELECT CAST(greatest(0, (i * 10 + greatest(1, n - 1) - 1) // greatest(1, n - 1) - 1) AS INTEGER) AS bin, p, y FROM i), t AS (SELECT count(*) AS n, avg(p) AS c, avg(y) AS a FROM b GROUP BY bin), u AS (SELECT greatest(0, least(9, floor(p * 10))) AS bin, count(*) AS n, round(avg(p), 4) AS c, round(avg(y), 4) AS a FROM trades GROUP BY 1)"


@query(sql("trades", _RANK + " SELECT 'rank10' AS rule, round(sum(n * abs(a - c)) / sum(n), 6) AS ece FROM t UNION ALL SELECT 'table', round(sum(n * abs(a - c)) / sum(n), 6) FROM u"))
def calibration_error_of_tables(spark: S, sf: str) -> DataFrame:
    """By equal-count rank bins, and from a table of bins as reports hold it (means rounded to four places)."""
    t = D.trades(spark, sf)
    by_rank = K.ece_of_bins(K.rank_bins(t, "p", "y", "id", 10), "n", "x_mean", "y_rate")
    report = rounded(t.groupBy(K.width_bin(F.col("p"), 10, False).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("c"), F.avg("y").alias("a")), 4, "c", "a")
    one = lambda name, df: df.select(F.lit(name).alias("rule"), F.round("ece", 6).alias("ece"))
    return one("rank10", by_rank).unionByName(one("table", K.ece_of_bins(report, "n", "c", "a")))


@query(sql("bars", _ATR + f", r AS (SELECT symbol, ts, atr, CASE WHEN count(high) OVER w = 12 THEN max(high) OVER w - min(low) OVER w END AS range FROM bars JOIN atr USING (symbol, ts) WINDOW w AS ({BY} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT symbol, ts, round(range / nullif(atr, 0), 6) AS congestion FROM r"))
def prebreak_congestion(spark: S, sf: str) -> DataFrame:
    before = F.lag("close").over(X.bars())
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    bars = D.bars(spark, sf).withColumn("tr", true_range).withColumn("atr", W.sma("tr", 14))
    return bars.select("symbol", "ts", F.round(W.congestion(12), 6).alias("congestion"))


@query(sql("trades", "SELECT id, symbol, opened_at FROM trades WHERE id % 3 <> 0 AND opened_at >= TIMESTAMP '2024-01-05' AND opened_at < TIMESTAMP '2024-01-15'"))
def closed_positions(spark: S, sf: str) -> DataFrame:
    t = D.trades(spark, sf).withColumn("status", F.when(F.col("id") % 3 == 0, "OPEN").otherwise("CLOSED"))
    return ST.closed_positions(t, "2024-01-05", "2024-01-15").select("id", "symbol", "opened_at")
