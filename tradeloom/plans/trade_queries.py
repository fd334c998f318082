"""Queries over trades, fills, statements and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import calibration as K
from ..operators import fits
from ..operators import joins as J
from ..operators import learning as M
from ..operators import matches as X
from ..operators import performance as P
from ..operators import quality as Q
from ..operators import windows as W
from ..sources import tables as T
from ..sources.staging import staged
from . import domain as D
from .domain import rounded, sql
from .registry import query

S = SparkSession


@query(sql("trades", "SELECT tag, count(*) AS n, round(avg(CAST(pnl > 0 AS DOUBLE)), 6) AS win_rate, round(coalesce(sum(pnl) FILTER (pnl > 0), 0), 2) AS gross_profit, round(-coalesce(sum(pnl) FILTER (pnl < 0), 0), 2) AS gross_loss, round(sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0), 6) AS profit_factor, round(avg(pnl), 8) AS expectancy, round(avg(pnl) FILTER (pnl > 0) / -avg(pnl) FILTER (pnl < 0), 6) AS payoff, round(avg(mae_usd), 4) AS avg_mae, round(avg(mfe_usd), 4) AS avg_mfe, round(avg((epoch_us(closed_at) - epoch_us(opened_at)) / 60e6), 4) AS avg_hold_min, round(sum(fees), 2) AS fees, round(sum(pnl), 2) AS net FROM trades GROUP BY tag"))
def performance_summary(spark: S, sf: str) -> DataFrame:
    df = rounded(P.summary(D.trades(spark, sf), ["tag"]), 6, "win_rate", "profit_factor", "payoff")
    return rounded(rounded(rounded(df, 4, "avg_mae", "avg_mfe", "avg_hold_min"), 8, "expectancy"), 2, "gross_profit", "gross_loss", "fees", "net")


SESSION = "CASE WHEN hour(opened_at) < 8 THEN 'ASIA' WHEN hour(opened_at) < 16 THEN 'EUROPE' ELSE 'US' END"


@query(sql("trades", f"x AS (SELECT pnl, {SESSION} AS session, CAST(isodow(opened_at) - 1 AS VARCHAR) AS dow, CAST(hour(opened_at) AS VARCHAR) AS hour FROM trades) SELECT CASE WHEN session IS NOT NULL THEN 'session' WHEN dow IS NOT NULL THEN 'dow' ELSE 'hour' END AS segment, coalesce(session, dow, hour) AS value, count(*) AS n, round(avg(pnl), 8) AS avg_pnl, round(sum(pnl), 2) AS sum_pnl FROM x GROUP BY GROUPING SETS ((session), (dow), (hour)) HAVING count(*) >= 10"))
def segment_performance(spark: S, sf: str) -> DataFrame:
    c = C.calendar(F.col("opened_at"))
    df = P.segments(D.trades(spark, sf).withColumns({k: c[k] for k in ("session", "dow", "hour")}), ["session", "dow", "hour"])
    return rounded(rounded(df, 8, "avg_pnl"), 2, "sum_pnl")


@query(sql("trades", "h AS (SELECT * FROM (VALUES ('6h', 6), ('1d', 24), ('7d', 168), ('365d', 8760)) t(period, h)) SELECT period, count(*) AS n, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, round(sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0), 6) AS profit_factor FROM trades JOIN h ON closed_at > TIMESTAMP '2024-01-20' - to_hours(h) AND closed_at <= TIMESTAMP '2024-01-20' GROUP BY period"))
def period_report(spark: S, sf: str) -> DataFrame:
    now = F.lit("2024-01-20").cast("timestamp")
    return rounded(P.periods(D.trades(spark, sf), now, {"6h": 6, "1d": 24, "7d": 168, "365d": 8760}), 6, "profit_factor")


@query(sql("trades", "l AS (SELECT symbol, pnl FROM trades QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY closed_at DESC, id DESC) <= 50) SELECT symbol, count(*) AS n, round(sum(pnl), 2) AS net FROM l GROUP BY symbol"))
def last_fifty_trades(spark: S, sf: str) -> DataFrame:
    return rounded(T.recent(D.trades(spark, sf), "symbol", ["closed_at", "id"], 50).groupBy("symbol").agg(F.count("*").alias("n"), F.sum("pnl").alias("net")), 2, "net")


@query(sql("trades", "SELECT symbol, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, count(*) FILTER (pnl = 0) AS flats, round(count(*) FILTER (pnl > 0) / count(*) FILTER (pnl <> 0), 6) AS decisive_win_rate FROM trades GROUP BY symbol"))
def decisive_win_rate(spark: S, sf: str) -> DataFrame:
    return rounded(P.decisive(D.trades(spark, sf), ["symbol"]), 6, "decisive_win_rate")


@query(sql("trades", "SELECT symbol, " + ", ".join(f"round(avg({c}), 4) AS {c}_mean, round(quantile_cont({c}, 0.5), 4) AS {c}_p50, round(quantile_cont({c}, 0.95), 4) AS {c}_p95" for c in ("mae_usd", "mfe_usd")) + " FROM trades GROUP BY symbol"))
def excursion_distribution(spark: S, sf: str) -> DataFrame:
    return rounded(P.distribution(D.trades(spark, sf), ["mae_usd", "mfe_usd"], ["symbol"]), 4, *[f"{c}_{k}" for c in ("mae_usd", "mfe_usd") for k in ("mean", "p50", "p95")])


@query(sql("trades", "SELECT tag, count(*) AS n, round(avg(r) / stddev_samp(r) * sqrt(count(*)), 6) AS sqn FROM trades GROUP BY tag HAVING count(*) >= 10 AND stddev_samp(r) > 0"))
def system_quality(spark: S, sf: str) -> DataFrame:
    return rounded(P.sqn(D.trades(spark, sf), "r", ["tag"]), 6, "sqn")


@query(sql("trades", "g AS (SELECT tag, quantile_cont(mfe_usd, 0.5) AS a, quantile_cont(abs(mae_usd), 0.5) AS b FROM trades GROUP BY tag) SELECT tag, round(a, 4) AS mfe_p50, round(b, 4) AS mae_p50, round(a / b, 6) AS e_ratio FROM g WHERE a > 0 AND b > 0"))
def e_ratio(spark: S, sf: str) -> DataFrame:
    return rounded(rounded(P.e_ratio(D.trades(spark, sf), ["tag"]), 4, "mfe_p50", "mae_p50"), 6, "e_ratio")


@query(sql("trades", "SELECT symbol, round(avg(CAST(mae_usd > 0.95 * risk_usd AS DOUBLE)) FILTER (pnl > 0), 6) AS winners_near_stop, round(avg(CAST(mae_usd < 0.5 * risk_usd AS DOUBLE)) FILTER (pnl < 0), 6) AS losers_far_from_stop, round(quantile_cont(pnl / mfe_usd, 0.5) FILTER (pnl > 0 AND mfe_usd > 0), 6) AS capture_p50, round(quantile_cont(mae_usd, 0.8), 4) AS mae_p80, round(quantile_cont(mfe_usd, 0.5), 4) AS mfe_p50, round(quantile_cont(mfe_usd, 0.7), 4) AS mfe_p70 FROM trades WHERE risk_usd > 0 GROUP BY symbol"))
def stop_diagnostics(spark: S, sf: str) -> DataFrame:
    return rounded(rounded(P.stop_diagnostics(D.trades(spark, sf), ["symbol"]), 6, "winners_near_stop", "losers_far_from_stop", "capture_p50"), 4, "mae_p80", "mfe_p50", "mfe_p70")


@query(sql("trades", "SELECT id, round(r, 6) AS r, round(CASE WHEN pnl < 0 THEN -pnl / risk_usd END, 6) AS adequacy, round(CASE WHEN mfe_usd > 0 THEN pnl / mfe_usd END, 6) + 0.0 AS harvest, round(CASE WHEN mfe_usd > 0 THEN 1 - pnl / mfe_usd END, 6) + 0.0 AS waste, CASE WHEN exit_reason = 'SL' AND r > -0.5 THEN 'sl_far_from_stop' WHEN exit_reason = 'TP' AND r <= 0 THEN 'tp_without_gain' WHEN exit_reason = 'TL' AND r <= -0.95 THEN 'tl_at_stop' END AS mismatch FROM trades"))
def exit_consistency(spark: S, sf: str) -> DataFrame:
    return rounded(P.exit_consistency(D.trades(spark, sf)).select("id", "r", "adequacy", "harvest", "waste", "mismatch"), 6, "r", "adequacy", "harvest", "waste")


def _near(a: str, b: str) -> str:
    return f"coalesce(abs({a} - {b}) <= 5e-3 OR abs({a} - {b}) / greatest(abs({a}), abs({b}), 5e-3) <= 0.15, false)"


INFERRED = f"""x AS (SELECT *, CASE WHEN id % 9 = 0 THEN closed_at + to_minutes(2) ELSE closed_at + to_hours(5) END AS deadline, CASE WHEN id % 2 = 0 THEN 0.0008 / 0.0004 * risk_usd END AS tp FROM trades),
inf AS (SELECT *, CASE WHEN abs(epoch_us(closed_at) - epoch_us(deadline)) <= 180e6 THEN 'TL' WHEN pnl <= 0 AND ({_near('mae_usd', 'risk_usd')} OR {_near('abs(pnl)', 'risk_usd')}) THEN 'SL' WHEN pnl > 0 AND ({_near('mfe_usd', 'tp')} OR {_near('pnl', 'tp * 0.9')} OR (mfe_usd > 0 AND pnl / mfe_usd >= 0.7)) THEN 'TP' WHEN abs(pnl) <= 5e-3 THEN 'MANUAL' ELSE 'UNKNOWN' END AS inferred FROM x)"""


def _inferred(spark: S, sf: str) -> DataFrame:
    deadline = F.timestamp_seconds(F.unix_timestamp("closed_at") + F.when(F.col("id") % 9 == 0, 120).otherwise(18_000))
    tp = F.when(F.col("id") % 2 == 0, 0.0008 / 0.0004 * F.col("risk_usd"))
    return D.trades(spark, sf).withColumn("inferred", C.exit_reason(F.col("pnl"), F.col("mae_usd"), F.col("mfe_usd"), F.col("risk_usd"), tp, F.col("closed_at"), deadline))


@query(sql("trades", INFERRED + " SELECT id, inferred FROM inf"))
def inferred_exit_reason(spark: S, sf: str) -> DataFrame:
    return _inferred(spark, sf).select("id", "inferred")


@query(sql("trades", INFERRED + " SELECT exit_reason, " + ", ".join(f"count(*) FILTER (inferred = '{v}') AS {v}" for v in ("SL", "TP", "TL", "MANUAL", "UNKNOWN")) + " FROM inf GROUP BY exit_reason"))
def exit_reason_confusion(spark: S, sf: str) -> DataFrame:
    return P.confusion(_inferred(spark, sf), "exit_reason", "inferred", ["SL", "TP", "TL", "MANUAL", "UNKNOWN"])


CURVE = "e AS (SELECT *, 10000 + sum(pnl) OVER (PARTITION BY tag ORDER BY closed_at, id ROWS UNBOUNDED PRECEDING) AS equity FROM trades), dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY tag ORDER BY closed_at, id ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM e)"


def _curve(spark: S, sf: str) -> DataFrame:
    return P.drawdowns(P.equity_curve(D.trades(spark, sf), ["tag"], 10_000.0, ["closed_at", "id"]), ["tag"], ["closed_at", "id"])


@query(sql("trades", CURVE + " SELECT id, tag, round(equity, 2) AS equity, round(dd, 6) + 0.0 AS dd FROM dd"))
def equity_and_drawdown(spark: S, sf: str) -> DataFrame:
    return rounded(rounded(_curve(spark, sf).select("id", "tag", "equity", "dd"), 2, "equity"), 6, "dd")


@query(sql("trades", CURVE + ", g AS (SELECT tag, min(dd) AS m, sqrt(avg(pow(dd * 100, 2))) AS u, arg_min(equity, (closed_at, id)) AS a, arg_max(equity, (closed_at, id)) AS b, greatest(1, (epoch_us(max(closed_at)) - epoch_us(min(closed_at))) / 86400e6) AS d FROM dd GROUP BY tag), h AS (SELECT *, CASE WHEN a > 0 AND b > 0 THEN pow(b / a, 365 / d) - 1 END AS c FROM g) SELECT tag, round(m, 6) AS max_dd, round(u, 5) AS ulcer, round(c, 5) AS cagr, round(c / nullif(abs(m), 0), 4) AS mar FROM h"))
def curve_metrics(spark: S, sf: str) -> DataFrame:
    return rounded(rounded(rounded(P.curve_metrics(_curve(spark, sf), ["tag"], "closed_at"), 6, "max_dd"), 5, "ulcer", "cagr"), 4, "mar")


_ACCOUNT = "c AS (SELECT *, 10000 + sum(pnl) OVER (ORDER BY closed_at, id) AS equity FROM trades), k AS (SELECT *, max(equity) OVER (ORDER BY closed_at, id) AS peak FROM c), dd AS (SELECT *, equity / nullif(peak, 0) - 1 AS dd FROM k)"


@query(sql("trades", _ACCOUNT + " SELECT id, round(equity, 2) AS equity, round(peak, 2) AS peak, round(dd, 6) + 0.0 AS dd FROM dd"))
def account_drawdown(spark: S, sf: str) -> DataFrame:
    curve = P.account_curve(D.trades(spark, sf).select("id", "closed_at", "pnl"), [], 10_000.0, ["closed_at", "id"])
    return rounded(rounded(curve.select("id", "equity", "peak", "dd"), 2, "equity", "peak"), 6, "dd")


@query(sql("trades", "t AS (SELECT *, CASE WHEN pnl > 0 THEN 'with' ELSE 'against' END AS kind, tag AS rule, id % 3 * 10 + 20 AS len, p > 0.5 AS up FROM trades) SELECT symbol, kind, rule, len, up, count(*) AS n, round(sum(pnl), 2) AS net, round(avg(CAST(pnl > 0 AS DOUBLE)), 6) AS win_rate, round(sum(pnl) FILTER (pnl > 0) / nullif(-sum(pnl) FILTER (pnl < 0), 0), 6) AS profit_factor FROM t GROUP BY ROLLUP (symbol, kind, rule, len, up)"))
def results_by_entry(spark: S, sf: str) -> DataFrame:
    t = D.trades(spark, sf).select("symbol", F.when(F.col("pnl") > 0, "with").otherwise("against").alias("kind"), F.col("tag").alias("rule"), (F.col("id") % 3 * 10 + 20).alias("len"), (F.col("p") > 0.5).alias("up"), "pnl")
    return rounded(rounded(P.rollup_summary(t, ["symbol", "kind", "rule", "len", "up"]), 2, "net"), 6, "win_rate", "profit_factor")


@query(sql("trades", "SELECT id, closed_at, opened_at, row_number() OVER (ORDER BY coalesce(CASE WHEN id % 5 <> 0 THEN closed_at END, opened_at), id) - 1 AS place FROM trades"))
def trade_list(spark: S, sf: str) -> DataFrame:
    t = D.trades(spark, sf).withColumn("at", F.coalesce(F.when(F.col("id") % 5 != 0, F.col("closed_at")), F.col("opened_at")))
    return W.with_order_index(t.select("id", "closed_at", "opened_at", "at"), ["at", "id"], "place").drop("at")


DAYS = CURVE + ", day AS (SELECT tag, CAST(closed_at AS DATE) AS day, arg_max(equity, (closed_at, id)) AS equity FROM dd GROUP BY ALL)"


@query(sql("trades", DAYS + ", r AS (SELECT *, equity / lag(equity) OVER (PARTITION BY tag ORDER BY day) - 1 AS r FROM day) SELECT tag, count(*) AS n_days, round(CASE WHEN stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(365) END, 5) AS sharpe, round(exp(sum(ln(1 + r))) - 1, 6) AS twr FROM r GROUP BY tag"))
def daily_sharpe(spark: S, sf: str) -> DataFrame:
    days = P.daily_equity(_curve(spark, sf), ["tag"], "closed_at", fill=False)
    return rounded(rounded(P.daily_metrics(days, ["tag"]), 5, "sharpe"), 6, "twr")


@query(sql("trades", DAYS + ", c AS (SELECT tag, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM day GROUP BY tag) SELECT c.tag, CAST(c.day AS DATE) AS day, round(d.equity, 2) AS equity FROM c ASOF JOIN day d ON c.tag = d.tag AND c.day >= d.day"))
def daily_equity_filled(spark: S, sf: str) -> DataFrame:
    return rounded(P.daily_equity(_curve(spark, sf), ["tag"], "closed_at", fill=True), 2, "equity")


@query(sql("trades", DAYS + ", r AS (SELECT *, equity / lag(equity) OVER (PARTITION BY tag ORDER BY day) - 1 AS r FROM day), v AS (SELECT *, CASE WHEN count(r) OVER w >= 5 THEN stddev_samp(r) OVER w * sqrt(365) END AS vol FROM r WINDOW w AS (PARTITION BY tag ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)), l AS (SELECT *, coalesce(greatest(0, CASE WHEN vol IS NULL OR vol = 0 THEN NULL ELSE least(3, 0.2 / vol) END), 0) AS lev FROM v) SELECT tag, day, round(lev, 5) AS leverage, round(exp(sum(ln(1 + lev * coalesce(r, 0))) OVER (PARTITION BY tag ORDER BY day ROWS UNBOUNDED PRECEDING)), 5) AS shadow FROM l"))
def vol_target_shadow(spark: S, sf: str) -> DataFrame:
    days = P.daily_equity(_curve(spark, sf), ["tag"], "closed_at", fill=False)
    return rounded(P.shadow_equity(days, ["tag"], 0.2, 3.0, 5).select("tag", "day", "leverage", "shadow"), 5, "leverage", "shadow")


@query(sql("trades", CURVE + ", s AS (SELECT tag, closed_at, equity / lag(equity) OVER w - 1 AS r, (epoch_us(closed_at) - lag(epoch_us(closed_at)) OVER w) / 1e6 AS step FROM dd WINDOW w AS (PARTITION BY tag ORDER BY closed_at, id)), g AS (SELECT tag, count(r) AS n, list_sort(list(step) FILTER (step IS NOT NULL))[count(step) // 2 + 1] AS step_s, avg(r) AS m, stddev_samp(r) AS sd FROM s GROUP BY tag) SELECT tag, n, step_s, round(CASE WHEN sd > 0 AND step_s > 0 THEN m / sd * sqrt(365 * 86400 / step_s) END, 4) AS sharpe FROM g"))
def step_sharpe(spark: S, sf: str) -> DataFrame:
    return rounded(P.step_sharpe(_curve(spark, sf), ["tag"], "closed_at"), 4, "sharpe")


@query(sql("trades", "s AS (SELECT tag, closed_at, id, CAST(sign(pnl) AS INTEGER) AS s FROM trades), c AS (SELECT *, CAST(s IS DISTINCT FROM lag(s) OVER (PARTITION BY tag ORDER BY closed_at, id) AS INTEGER) AS n FROM s), g AS (SELECT *, sum(n) OVER (PARTITION BY tag ORDER BY closed_at, id ROWS UNBOUNDED PRECEDING) AS k FROM c), r AS (SELECT tag, k, s, count(*) AS l FROM g WHERE s <> 0 GROUP BY ALL) SELECT tag, max(l) FILTER (s = 1) AS longest_win, max(l) FILTER (s = -1) AS longest_loss FROM r GROUP BY tag"))
def streaks(spark: S, sf: str) -> DataFrame:
    runs = W.streaks(D.trades(spark, sf), ["tag"], ["closed_at", "id"])
    return runs.groupBy("tag").agg(F.max(F.when(F.col("sign") == 1, F.col("length"))).alias("longest_win"), F.max(F.when(F.col("sign") == -1, F.col("length"))).alias("longest_loss"))


@query(sql("trades", "r AS (SELECT *, sum(CAST(pnl >= 0 AS INTEGER)) OVER (PARTITION BY symbol ORDER BY closed_at, id ROWS UNBOUNDED PRECEDING) AS g FROM trades), l AS (SELECT symbol, closed_at, sum(CAST(pnl < 0 AS INTEGER)) OVER (PARTITION BY symbol, g ORDER BY closed_at, id ROWS UNBOUNDED PRECEDING) AS n FROM r) SELECT symbol, min(closed_at) AS at FROM l WHERE n >= 5 GROUP BY symbol"))
def kill_switch(spark: S, sf: str) -> DataFrame:
    return W.loss_streak_times(D.trades(spark, sf), ["symbol"], ["closed_at", "id"], 5)


@query(sql("trades", "SELECT id, CAST(row_number() OVER (ORDER BY opened_at, symbol, id) - 1 AS BIGINT) AS order_idx FROM trades"))
def order_index(spark: S, sf: str) -> DataFrame:
    return W.with_order_index(D.trades(spark, sf).select("id", "symbol", "opened_at"), ["opened_at", "symbol", "id"]).select("id", "order_idx")


FOLD = "o AS (SELECT id, row_number() OVER (ORDER BY opened_at, symbol, id) - 1 AS i FROM trades), n AS (SELECT count(*) AS n FROM o), b AS (SELECT k AS fold, k * (n // 5) + least(k, n % 5) AS lo, k * (n // 5) + least(k, n % 5) + n // 5 - 1 + CAST(k < n % 5 AS INTEGER) AS hi FROM n, (SELECT unnest(range(5)) AS k))"


@query(sql("trades", FOLD + ", f AS (SELECT fold, CASE WHEN i BETWEEN lo AND hi THEN 'test' WHEN i < lo - 50 OR i > hi + 50 THEN 'train' END AS role, id FROM o, b) SELECT CAST(fold AS INTEGER) AS fold, role, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM f WHERE role IS NOT NULL GROUP BY ALL"))
def purged_folds(spark: S, sf: str) -> DataFrame:
    o = W.with_order_index(D.trades(spark, sf).select("id", "symbol", "opened_at"), ["opened_at", "symbol", "id"])
    return K.purged_folds(o, 5, 50).groupBy("fold", "role").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query(sql("trades", "t AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9, 1.5]) AS threshold) SELECT threshold, count(id) AS n, round(avg(CAST(pnl > 0 AS DOUBLE)), 6) AS win_rate, round(avg(pnl), 8) AS avg_pnl, round(coalesce(sum(pnl), 0), 2) AS sum_pnl FROM t LEFT JOIN trades ON p >= threshold GROUP BY threshold"))
def threshold_sweep(spark: S, sf: str) -> DataFrame:
    out = K.sweep(D.trades(spark, sf), [0.1, 0.3, 0.5, 0.7, 0.9, 1.5]).withColumn("n", F.col("n").cast("long"))
    return rounded(rounded(rounded(out, 6, "win_rate"), 8, "avg_pnl"), 2, "sum_pnl")


EV = "t AS (SELECT unnest([0.2, 0.4, 0.6, 0.8]) AS threshold), g AS (SELECT threshold, count(*) AS n, avg(CAST(r > 0 AS DOUBLE)) AS w, avg(r) FILTER (r > 0) AS g, avg(-r) FILTER (r <= 0) AS l FROM t JOIN trades ON p >= threshold GROUP BY threshold), ev AS (SELECT threshold, n, w, w * coalesce(g, 0) - (1 - w) * coalesce(l, 0) AS ev_r FROM g)"


@query(sql("trades", EV + " SELECT threshold, n, round(w, 6) AS win_rate, round(ev_r, 6) AS ev_r FROM ev"))
def ev_curve(spark: S, sf: str) -> DataFrame:
    return rounded(K.ev_curve(D.trades(spark, sf), [0.2, 0.4, 0.6, 0.8]), 6, "win_rate", "ev_r")


_KNOWN = "k AS (SELECT p, pnl, CASE WHEN p < 0.9 THEN r END AS r FROM trades), g AS (SELECT unnest([0.0, 0.3, 0.6, 0.9, 1.5]) AS threshold)"


@query(sql("trades", _KNOWN + " SELECT CAST(threshold AS DOUBLE) AS threshold, count(p) AS n, round(CASE WHEN count(r) > 0 THEN avg(CAST(coalesce(r > 0, false) AS INTEGER)) FILTER (p IS NOT NULL) ELSE avg(CAST(pnl > 0 AS INTEGER)) END, 6) AS win_rate, round(avg(p) * avg(r) FILTER (r > 0) + (1 - avg(p)) * avg(r) FILTER (r <= 0), 6) AS ev_r FROM g LEFT JOIN k ON p >= threshold GROUP BY threshold"))
def cost_aware_sweep(spark: S, sf: str) -> DataFrame:
    known = D.trades(spark, sf).withColumn("r", F.when(F.col("p") < 0.9, F.col("r")))
    return rounded(K.cost_aware_sweep(known, [0.0, 0.3, 0.6, 0.9, 1.5]), 6, "win_rate", "ev_r")


@query(sql("trades", EV + " SELECT threshold, n, round(ev_r, 6) AS ev_r FROM ev WHERE n >= 50 ORDER BY ev.ev_r DESC, threshold LIMIT 1"))
def suggested_threshold(spark: S, sf: str) -> DataFrame:
    return rounded(K.best_threshold(K.ev_curve(D.trades(spark, sf), [0.2, 0.4, 0.6, 0.8]), "ev_r", 50).select("threshold", "n", "ev_r"), 6, "ev_r")


@query(sql("trades", "SELECT opened_at AS entry_ts, symbol, round(avg(p), 6) AS p, arg_min(y, id) AS y FROM trades GROUP BY ALL"))
def prediction_dedup(spark: S, sf: str) -> DataFrame:
    return rounded(K.dedup_mean(D.trades(spark, sf).withColumnRenamed("opened_at", "entry_ts")), 6, "p")


@query(sql("trades", "k AS (SELECT p, y, row_number() OVER (ORDER BY p, id) AS r, count(*) OVER () AS n FROM trades), b AS (SELECT CAST(greatest(0, ((r - 1) * 10 + n - 2) // (n - 1) - 1) AS INTEGER) AS bin, p, y FROM k) SELECT bin, count(*) AS n, round(avg(p), 6) AS x_mean, round(avg(y), 6) AS y_rate, round(avg(y) / ((SELECT avg(y) FROM k) + 1e-9), 6) AS lift FROM b GROUP BY bin"))
def calibration_by_rank(spark: S, sf: str) -> DataFrame:
    out = K.rank_bins(D.trades(spark, sf), "p", "y", "id", 10)
    return rounded(out, 6, "x_mean", "y_rate", "lift")


@query(sql("trades", "e AS (SELECT list_distinct(quantile_cont(p, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM trades), b AS (SELECT CAST(greatest(1, len(list_filter(e, lambda v: v < p))) - 1 AS INTEGER) AS bin, p, y FROM trades, e) SELECT bin, count(*) AS n, round(avg(p), 6) AS p_mean, round(avg(y), 6) AS y_rate FROM b GROUP BY bin"))
def reliability_bins(spark: S, sf: str) -> DataFrame:
    return rounded(K.value_bins(D.trades(spark, sf), "p", "y", 10), 6, "p_mean", "y_rate")


def _ece_sql(cell: str) -> str:
    return f"SELECT sum(n * abs(a - c)) / sum(n) AS e FROM (SELECT count(*) AS n, avg(p) AS c, avg(y) AS a FROM trades GROUP BY {cell})"


@query(sql("trades", f"a AS ({_ece_sql('greatest(0, least(9, floor(p * 10)))')}), b AS ({_ece_sql('greatest(0, least(14, ceil(p * 15) - 1))')}) SELECT 'left10' AS rule, round(e, 6) AS ece FROM a UNION ALL SELECT 'right15', round(e, 6) FROM b"))
def calibration_error(spark: S, sf: str) -> DataFrame:
    t = D.trades(spark, sf)
    one = lambda name, bins, right: K.ece(t, "p", "y", K.width_bin(F.col("p"), bins, right)).select(F.lit(name).alias("rule"), F.round("ece", 6).alias("ece"))
    return one("left10", 10, False).unionByName(one("right15", 15, True))


@query(sql("trades", "SELECT CAST(least(4, greatest(0, floor(p * 5))) AS INTEGER) AS bucket, count(*) AS n, round(avg(p), 6) AS p_mean, round(avg(y), 6) AS y_rate FROM trades GROUP BY 1"))
def coarse_buckets(spark: S, sf: str) -> DataFrame:
    t = D.trades(spark, sf).groupBy(K.width_bin(F.col("p"), 5, False).alias("bucket")).agg(F.count("*").alias("n"), F.avg("p").alias("p_mean"), F.avg("y").alias("y_rate"))
    return rounded(t, 6, "p_mean", "y_rate")


@query(sql("trades", "k AS (SELECT p, y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS r FROM trades), s AS (SELECT count(*) AS n, sum(y) AS k, sum(r * y) AS r, avg(pow(p - y, 2)) AS b, avg(CAST((p >= 0.5) = (y = 1) AS DOUBLE)) AS h FROM k) SELECT round((r - k * (k + 1) / 2) / (k * (n - k)), 6) AS auc, round(b, 6) AS brier, round(k / n * (1 - k / n), 6) AS brier_base, round(h, 6) AS accuracy FROM s"))
def auc_and_brier(spark: S, sf: str) -> DataFrame:
    return rounded(K.auc_brier(D.trades(spark, sf), "p", "y"), 6, "auc", "brier", "brier_base", "accuracy")


@query(sql("trades", "c AS (SELECT p, 1 / (1 + exp(-(0.5 * ln(greatest(1e-6, least(1 - 1e-6, p)) / (1 - greatest(1e-6, least(1 - 1e-6, p)))) + 0.1))) AS q FROM trades) SELECT round(stddev_pop(q) / stddev_pop(p), 6) AS std_ratio, round(count(DISTINCT round(q, 6)) / count(DISTINCT round(p, 6)), 6) AS unique_ratio FROM c"))
def calibrated_resolution(spark: S, sf: str) -> DataFrame:
    t = D.trades(spark, sf).withColumn("q", C.platt(F.col("p"), 0.5, 0.1))
    return rounded(K.resolution(t, "p", "q"), 6, "std_ratio", "unique_ratio")


@query(sql("trades", "SELECT id, round(abs(size) * entry, 4) AS notional, round(abs(size) * entry * 6 / 1e4, 9) AS fee_est, round(abs(size) * entry * 0.0001 * ((epoch_us(closed_at) - epoch_us(opened_at)) / 3600e6) / 8, 12) AS funding_est FROM trades"))
def cost_audit(spark: S, sf: str) -> DataFrame:
    t = P.cost_audit(D.trades(spark, sf).withColumn("funding_last", F.lit(0.0001)), 6.0)
    return rounded(rounded(rounded(t.select("id", "notional", "fee_est", "funding_est"), 4, "notional"), 9, "fee_est"), 12, "funding_est")


@query(sql("trades bars", "SELECT t.id, min(b.low) AS lo, max(b.high) AS hi, count(*) AS n_bars FROM trades t JOIN bars b ON t.symbol = b.symbol AND b.ts BETWEEN t.opened_at AND t.closed_at GROUP BY t.id"))
def trade_bar_extremes(spark: S, sf: str) -> DataFrame:
    return J.trade_extremes(D.trades(spark, sf), D.bars(spark, sf))


@query(sql("trades bars", "e AS (SELECT t.id, min(b.low) AS lo, max(b.high) AS hi FROM trades t JOIN bars b ON t.symbol = b.symbol AND b.ts BETWEEN t.opened_at AND t.closed_at GROUP BY t.id) SELECT id, round(greatest(0, CASE side WHEN 'short' THEN hi - entry ELSE entry - lo END) * size, 4) AS mae_usd, round(greatest(0, CASE side WHEN 'short' THEN entry - lo ELSE hi - entry END) * size, 4) AS mfe_usd FROM trades JOIN e USING (id)"))
def trade_excursions(spark: S, sf: str) -> DataFrame:
    t = D.trades(spark, sf)
    return rounded(J.excursions(t, J.trade_extremes(t, D.bars(spark, sf))).select("id", "mae_usd", "mfe_usd"), 4, "mae_usd", "mfe_usd")


@query(sql("trades oi funding", "o AS (SELECT t.id, arg_max(value, ts) AS l, arg_min(value, ts) AS f, count(*) AS n FROM trades t JOIN oi o ON t.symbol = o.symbol AND o.ts BETWEEN t.opened_at - INTERVAL 8 HOUR AND t.opened_at GROUP BY t.id), g AS (SELECT t.id, arg_max(value, ts) AS v FROM trades t JOIN funding o ON t.symbol = o.symbol AND o.ts BETWEEN t.opened_at - INTERVAL 8 HOUR AND t.opened_at GROUP BY t.id) SELECT t.id, round(o.l, 4) AS oi_last, round(g.v, 9) AS funding_last, round(CASE WHEN o.n >= 2 THEN o.l / nullif(o.f, 0) - 1 END, 6) AS oi_delta FROM trades t LEFT JOIN o USING (id) LEFT JOIN g USING (id)"))
def window_enrichment(spark: S, sf: str) -> DataFrame:
    out = J.window_enrichment(D.trades(spark, sf).select("id", "symbol", "opened_at"), D.series(spark, sf, "view"), D.series(spark, sf, "error"))
    return out.select("id", F.round("oi_last", 4).alias("oi_last"), F.round("funding_last", 9).alias("funding_last"), F.round("oi_delta", 6).alias("oi_delta"))


@query(sql("trades oi funding", "o AS (SELECT t.id, arg_max(value, ts) AS l, arg_min(value, ts) AS f, count(*) AS n FROM trades t JOIN oi o ON t.symbol = o.symbol AND o.ts BETWEEN t.opened_at - INTERVAL 8 HOUR AND t.opened_at GROUP BY t.id), g AS (SELECT t.id, arg_max(value, ts) AS v FROM trades t JOIN funding o ON t.symbol = o.symbol AND o.ts BETWEEN t.opened_at - INTERVAL 8 HOUR AND t.opened_at GROUP BY t.id) SELECT t.id, t.symbol, t.opened_at, round(g.v, 9) AS funding_last_at_entry, round(o.l, 4) AS oi_last_at_entry, round(CASE WHEN o.n >= 2 THEN o.l / nullif(o.f, 0) - 1 END, 6) AS oi_delta_pct_win FROM trades t LEFT JOIN o USING (id) LEFT JOIN g USING (id)"))
def enrichment_extract(spark: S, sf: str) -> DataFrame:
    out = J.enrichment_extract(D.trades(spark, sf), D.series(spark, sf, "view"), D.series(spark, sf, "error"))
    return rounded(rounded(rounded(out, 9, "funding_last_at_entry"), 4, "oi_last_at_entry"), 6, "oi_delta_pct_win")


@query(sql("trades", "SELECT a.id, a.p, b.pnl FROM trades a JOIN trades b ON a.id = b.id WHERE a.id % 3 = 0"))
def predictions_with_trades(spark: S, sf: str) -> DataFrame:
    t = D.trades(spark, sf)
    return J.one_to_one(t.where("id % 3 = 0").select("id", "p"), t.select("id", "pnl"), ["id"])[0]


@query(sql("trades", "d AS (SELECT symbol, opened_at FROM trades GROUP BY ALL HAVING count(*) > 1) SELECT symbol, opened_at, 'left' AS side, count(*) AS n FROM trades GROUP BY symbol, opened_at HAVING count(*) > 1 UNION ALL SELECT symbol, opened_at, 'right', count(*) FROM trades WHERE side = 'short' GROUP BY symbol, opened_at HAVING count(*) > 1"))
def repeated_keys(spark: S, sf: str) -> DataFrame:
    t = D.trades(spark, sf).select("symbol", "opened_at", "side")
    return J.one_to_one(t.drop("side"), t.where("side = 'short'").drop("side"), ["symbol", "opened_at"])[1]


MATCH = "st AS (SELECT id AS statement_id, symbol, size AS qty, entry * 1.001 AS entry, closed_at FROM trades WHERE id % 4 = 0), cand AS (SELECT s.statement_id, s.symbol, s.closed_at, t.id AS position_id, abs(epoch_us(s.closed_at) - epoch_us(t.opened_at)) / 1e6 AS gap FROM st s JOIN trades t ON s.symbol = t.symbol AND abs(s.qty - t.size) <= 0.02 * greatest(abs(s.qty), abs(t.size)) AND abs(s.entry - t.entry) <= 0.02 * greatest(abs(s.entry), abs(t.entry)) AND t.opened_at <= s.closed_at)"


def _both_sides(spark: S, sf: str) -> tuple[DataFrame, DataFrame]:
    t = D.trades(spark, sf)
    s = t.where("id % 4 = 0").select(F.col("id").alias("statement_id"), "symbol", F.col("size").alias("qty"), (F.col("entry") * 1.001).alias("entry"), "closed_at")
    return s, t.select(F.col("id").alias("position_id"), "symbol", "size", F.col("entry").alias("entry_price"), "opened_at")


@query(sql("trades", MATCH + " SELECT statement_id, position_id, gap FROM cand QUALIFY row_number() OVER (PARTITION BY statement_id ORDER BY gap, position_id) = 1"))
def nearest_statement_match(spark: S, sf: str) -> DataFrame:
    return X.nearest_of(*_both_sides(spark, sf), 0.02)


GREEDY = """, sk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY closed_at, statement_id) AS k FROM (SELECT symbol, statement_id, closed_at, list(position_id ORDER BY gap, position_id) AS ps FROM cand GROUP BY ALL)),
walk AS (SELECT DISTINCT symbol, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS statement_id, CAST(NULL AS BIGINT) AS position_id, CAST([] AS BIGINT[]) AS used FROM cand
UNION ALL SELECT symbol, k, statement_id, p, CASE WHEN p IS NULL THEN used ELSE list_append(used, p) END FROM (SELECT s.symbol, s.k, s.statement_id, w.used, list_filter(s.ps, lambda v: NOT list_contains(w.used, v))[1] AS p FROM walk w JOIN sk s ON s.symbol = w.symbol AND s.k = w.k + 1))"""


@query(sql("trades", MATCH + GREEDY + " SELECT statement_id, position_id FROM walk WHERE position_id IS NOT NULL").replace("WITH ", "WITH RECURSIVE ", 1))
def greedy_statement_match(spark: S, sf: str) -> DataFrame:
    return X.greedy_of(*_both_sides(spark, sf), 0.02)


@query(sql("trades", "x AS (SELECT id, symbol, size, CASE WHEN id % 5 = 0 THEN size / 2 ELSE size END AS amount, side, opened_at + to_minutes(10) AS ts FROM trades WHERE symbol <> 'S7'), h AS (SELECT p.id, sum(x.amount) AS f, sum(x.amount * p.entry) / sum(x.amount) AS v FROM trades p JOIN x ON p.symbol = x.symbol AND CASE p.side WHEN 'long' THEN 'buy' ELSE 'sell' END = CASE x.side WHEN 'long' THEN 'buy' ELSE 'sell' END AND x.ts BETWEEN p.opened_at - INTERVAL 15 MINUTE AND p.opened_at + INTERVAL 15 MINUTE GROUP BY p.id) SELECT p.id, p.size AS expected, coalesce(h.f, 0) AS found FROM trades p LEFT JOIN h USING (id) WHERE p.symbol <> 'S7' AND abs(p.size - coalesce(h.f, 0)) > 0.001"))
def exchange_entry_mismatches(spark: S, sf: str) -> DataFrame:
    t = D.trades(spark, sf)
    at = F.timestamp_seconds(F.unix_timestamp("opened_at") + 600)
    x = t.where("symbol <> 'S7'").select("symbol", at.alias("ts"), F.when(F.col("side") == "long", "buy").otherwise("sell").alias("trade_side"), F.when(F.col("id") % 5 == 0, F.col("size") / 2).otherwise(F.col("size")).alias("amount"), F.col("entry").alias("price"))
    return J.exchange_check(t, x, "15m", 0.001).where("kind = 'ENTRY_SIZE_MISMATCH'").select("id", "expected", "found")


FILLS = "SELECT l_orderkey AS position_id, 'ENTRY' AS fill_type, l_extendedprice / l_quantity AS price, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS qty FROM lineitem WHERE l_linenumber < 6"


@query(f"WITH f AS ({FILLS}), g AS (SELECT position_id, sum(abs(qty)) AS q, sum(abs(qty) * price) / sum(abs(qty)) AS p FROM f GROUP BY 1) SELECT o_orderkey AS id, round(coalesce(CASE WHEN o_orderkey % 2 = 0 THEN 7.0 END, q), 4) AS size, round(coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 9.0 END, p), 4) AS entry_price FROM orders LEFT JOIN g ON position_id = o_orderkey")
def entry_backfill(spark: S, sf: str) -> DataFrame:
    f = D.table(spark, sf, "lineitem").where("l_linenumber < 6").select(F.col("l_orderkey").alias("position_id"), F.lit("ENTRY").alias("fill_type"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("qty"))
    o = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, 7.0).alias("size"), F.when(F.col("o_orderkey") % 3 == 0, 9.0).alias("entry_price"))
    return rounded(J.backfill_entry(o, f), 4, "size", "entry_price")


@query(sql("li", "c AS (SELECT l_orderkey AS id, l_linenumber AS seq, q AS qty, x / q AS price, x * 0.001 AS fee, TIMESTAMP '2024-01-01' + to_hours(CAST(l_linenumber AS INTEGER)) AS ts FROM li), n AS (SELECT id, sum(qty) * 0.6 AS size FROM c GROUP BY id), u AS (SELECT c.*, greatest(0, least(qty, size - coalesce(sum(qty) OVER (PARTITION BY c.id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS used FROM c JOIN n ON c.id = n.id) SELECT id, round(sum(used), 4) AS exit_qty, round(sum(used * price) / sum(used), 4) AS exit_price, round(sum(fee * used / qty), 7) AS exit_fees, max(ts) AS exit_at FROM u WHERE used > 0 GROUP BY id"))
def fifo_exit_allocation(spark: S, sf: str) -> DataFrame:
    li = D.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("qty"), F.max("l_extendedprice").alias("x"))
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01").cast("timestamp")) + F.col("l_linenumber") * 3600)
    c = li.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("seq"), "qty", (F.col("x") / F.col("qty")).alias("price"), (F.col("x") * 0.001).alias("fee"), at.alias("ts"))
    out = J.allocate_exits(c.groupBy("id").agg((F.sum("qty") * 0.6).alias("size")), c)
    return rounded(rounded(out, 4, "exit_qty", "exit_price"), 7, "exit_fees")


SIZE = "m AS (SELECT id, entry, risk_usd, size, p, side, greatest(0, least(1, (p - 0.4) / 0.5)) + 1 AS lin, CASE WHEN id % 3 = 0 THEN 0.5 ELSE 1 END AS dn, CASE WHEN id % 4 = 0 THEN 0 ELSE 1 END AS up, CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END AS ron FROM trades), z AS (SELECT *, CASE WHEN ron <> 1 THEN least(least(lin * dn, 1.8), 0.25) ELSE least(lin * dn, 1.8) END AS mult FROM m), q AS (SELECT *, 20 * mult AS risk, entry * 0.05 AS dist FROM z)"


@query(sql("trades", SIZE + " SELECT id, up = 0 AS skipped, round(CASE WHEN up = 0 THEN 0 ELSE mult END, 6) AS size_mult, round(CASE WHEN up = 0 THEN 0 ELSE risk END, 6) AS risk_usd, round(CASE WHEN up = 0 THEN 0 WHEN risk / dist * entry > 300 THEN 300 / entry ELSE risk / dist END, 6) AS qty FROM q"))
def sizing_chain(spark: S, sf: str) -> DataFrame:
    t = D.trades(spark, sf)
    mult = C.size_multiplier(F.col("p"), F.when(F.col("id") % 3 == 0, -1.0).otherwise(1.0), cap=1.8)
    parts = C.sizing_chain(F.lit(300.0), F.when(F.col("id") % 4 == 0, 0).otherwise(1), F.when(F.col("id") % 5 == 0, 0).otherwise(1), mult, F.lit(None).cast("double"), F.col("entry"), F.col("entry") * 0.95, risk_cash=20.0, probe=0.25)
    return rounded(t.select("id", *[v.alias(k) for k, v in parts.items()]), 6, "size_mult", "risk_usd", "qty")


@query(sql("trades", "SELECT id, CASE WHEN p < 0.4 THEN 0.5 WHEN p < 0.7 THEN 1.0 ELSE 1.5 END AS step, round(CASE WHEN p <= 0.2 THEN 0.5 WHEN p <= 0.6 THEN 0.5 + (p - 0.2) * ((1.0 - 0.5) / (0.6 - 0.2)) WHEN p <= 0.9 THEN 1 + (p - 0.6) * ((2.0 - 1.0) / (0.9 - 0.6)) ELSE 2 END, 6) AS line, round(0.5 + greatest(0, least(1, (p - 0.1) / (0.9 - 0.1))) * 1.5, 6) AS clipped FROM trades"))
def sizing_curves(spark: S, sf: str) -> DataFrame:
    p = F.col("p")
    out = D.trades(spark, sf).select("id", C.curve_lookup(p, [(0.0, 0.4, 0.5), (0.4, 0.7, 1.0), (0.7, 1.0, 1.5)]).alias("step"), C.interpolate(p, [(0.2, 0.5), (0.6, 1.0), (0.9, 2.0)]).alias("line"), C.clip_linear(p, 0.1, 0.9, 0.5, 2.0).alias("clipped"))
    return rounded(out, 6, "line", "clipped")


@query(sql("trades", "SELECT id, round(CASE side WHEN 'short' THEN entry - entry * 1.01 ELSE entry * 1.01 - entry END * size - fees, 4) AS net, CAST((epoch_us(closed_at) - epoch_us(opened_at)) / 60e6 AS BIGINT) AS hold_min FROM trades"))
def trade_results(spark: S, sf: str) -> DataFrame:
    net = C.trade_pnl(F.col("side"), F.col("entry"), F.col("entry") * 1.01, F.col("size"), F.col("fees"))
    hold = ((F.unix_micros("closed_at") - F.unix_micros("opened_at")) / 60e6).cast("long")
    return rounded(D.trades(spark, sf).select("id", net.alias("net"), hold.alias("hold_min")), 4, "net")


@query(sql("trades", "SELECT id, substr('DON' || symbol || side || strftime(opened_at, '%Y%m%d%H%M') || substr(sha1('DON|' || symbol || '|' || side || '|' || strftime(opened_at, '%Y%m%d%H%M')), 1, 8), 1, 36) AS client_id FROM trades"))
def client_ids(spark: S, sf: str) -> DataFrame:
    return D.trades(spark, sf).select("id", C.client_id(F.lit("DON"), F.col("symbol"), F.col("side"), F.col("opened_at")).alias("client_id"))


@query(sql("trades", "a AS (SELECT unnest(['p', 'pnl', 'mfe_usd']) AS name) SELECT name, (SELECT count(*) FROM trades) AS n, CASE name WHEN 'p' THEN (SELECT round(avg(CAST(id % 10 = 0 AS DOUBLE)), 6) FROM trades) ELSE 0.0 END AS missing, CASE name WHEN 'p' THEN (SELECT round(avg(p), 8) FROM trades WHERE id % 10 <> 0) WHEN 'pnl' THEN (SELECT round(avg(pnl), 8) FROM trades) ELSE (SELECT round(avg(mfe_usd), 8) FROM trades) END AS mean, CASE name WHEN 'p' THEN (SELECT round(quantile_cont(p, 0.1), 4) FROM trades WHERE id % 10 <> 0) WHEN 'pnl' THEN (SELECT round(quantile_cont(pnl, 0.1), 4) FROM trades) ELSE (SELECT round(quantile_cont(mfe_usd, 0.1), 4) FROM trades) END AS p10, CASE name WHEN 'p' THEN (SELECT round(quantile_cont(p, 0.9), 4) FROM trades WHERE id % 10 <> 0) WHEN 'pnl' THEN (SELECT round(quantile_cont(pnl, 0.9), 4) FROM trades) ELSE (SELECT round(quantile_cont(mfe_usd, 0.9), 4) FROM trades) END AS p90 FROM a"))
def dataset_audit(spark: S, sf: str) -> DataFrame:
    t = D.trades(spark, sf).withColumn("p", F.when(F.col("id") % 10 != 0, F.col("p")))
    return rounded(rounded(Q.column_audit(t, ["p", "pnl", "mfe_usd"]), 6, "missing").withColumn("mean", F.round("mean", 8)), 4, "p10", "p90")


@query(sql("trades", "SELECT y, count(*) AS n, round(count(*) / (SELECT count(*) FROM trades), 6) AS share FROM trades GROUP BY y"))
def class_balance(spark: S, sf: str) -> DataFrame:
    return rounded(Q.class_balance(D.trades(spark, sf), "y"), 6, "share")


@query(sql("trades", "SELECT 'p' AS name, count(*) FILTER (id % 10 = 0) AS nulls, min(opened_at) AS first_ts, max(opened_at) AS last_ts FROM trades UNION ALL SELECT 'pnl', 0, min(opened_at), max(opened_at) FROM trades"))
def feature_contract(spark: S, sf: str) -> DataFrame:
    t = D.trades(spark, sf).withColumn("p", F.when(F.col("id") % 10 != 0, F.col("p")))
    return Q.contract(t, ["p", "pnl", "absent"], "opened_at")[1]


@query(sql("trades", "SELECT 'p' AS name, count(*) FILTER (id % 7 = 0) AS bad FROM trades UNION ALL SELECT 'side', count(*) FILTER (side <> 'long') FROM trades"))
def schema_validation(spark: S, sf: str) -> DataFrame:
    t = D.trades(spark, sf).withColumn("p", F.when(F.col("id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("p")))
    return Q.schema_check(t, ["p"], {"side": ["long"]})[1]


@query(sql("trades", "SELECT 'p' AS name, count(*) AS n, count(*) FILTER (id % 6 = 0) AS differ, round(max(CASE WHEN id % 6 = 0 THEN 0.001 ELSE 0 END), 6) AS worst FROM trades"))
def score_parity(spark: S, sf: str) -> DataFrame:
    t = D.trades(spark, sf)
    other = t.select("id", (F.col("p") + F.when(F.col("id") % 6 == 0, 0.001).otherwise(0.0)).alias("p"))
    return rounded(Q.parity(t.select("id", "p"), other, ["id"], ["p"]), 6, "worst")


@query(sql("trades", "g AS (SELECT exit_reason, count(mae_usd) AS n, quantile_cont(mae_usd, [0.01, 0.1, 0.5, 0.9, 0.99]) AS q FROM trades GROUP BY 1) SELECT exit_reason, 'mae_usd' AS driver, n, round(q[1], 4) AS q01, round(q[2], 4) AS q10, round(q[3], 4) AS q50, round(q[4], 4) AS q90, round(q[5], 4) AS q99 FROM g"))
def category_drivers(spark: S, sf: str) -> DataFrame:
    d = Q.drivers(D.trades(spark, sf), "exit_reason", ["mae_usd"])
    return d.select("exit_reason", "driver", "n", *[F.round(F.col("q")[k], 4).alias(f"q{n}") for k, n in enumerate(("01", "10", "50", "90", "99"))])


@query(sql("trades", "g AS (SELECT tag, exit_reason, count(DISTINCT side) AS k FROM trades GROUP BY ALL) SELECT count(*) AS tuples, max(k) AS most FROM g"))
def functional_dependency(spark: S, sf: str) -> DataFrame:
    return Q.functional_dependency(D.trades(spark, sf), ["tag", "exit_reason"], "side")


@query(sql("trades", "x AS (SELECT symbol, opened_at, id, p, 0.3 * p + 0.7 * lag(p) OVER (PARTITION BY symbol ORDER BY id) AS y FROM trades), a AS (SELECT symbol, (y - lag(y) OVER (PARTITION BY symbol ORDER BY id)) / nullif(p - lag(y) OVER (PARTITION BY symbol ORDER BY id), 0) AS a FROM x) SELECT symbol, round(quantile_cont(a, 0.5), 5) AS alpha FROM a WHERE a > 0 AND a < 1 GROUP BY symbol"))
def ewm_alpha(spark: S, sf: str) -> DataFrame:
    from pyspark.sql import Window

    prev = F.lag("p").over(Window.partitionBy("symbol").orderBy("id"))
    t = D.trades(spark, sf).withColumn("y", 0.3 * F.col("p") + 0.7 * prev)
    return rounded(Q.ewm_alpha(t, "p", "y", ["symbol"], "id"), 5, "alpha")


@query(sql("trades", "SELECT round(greatest(quantile_cont(abs(r) / 1000, 0.2), 1e-8), 9) AS funding_eps, round(quantile_cont(p, 0.33), 6) AS oi_q33, round(quantile_cont(p, 0.66), 6) AS oi_q66, round(quantile_cont(mfe_usd, 0.66), 4) AS vol_high FROM trades"))
def regime_cut_points(spark: S, sf: str) -> DataFrame:
    t = D.trades(spark, sf).select((F.col("r") / 1000).alias("funding_rate"), F.col("p").alias("oi_z_7d"), F.col("p").alias("oi_pct_1d"), F.col("mfe_usd").alias("vol_level"))
    return Q.cut_points(t).select(F.round("funding_eps", 9).alias("funding_eps"), F.round("oi_q33", 6).alias("oi_q33"), F.round("oi_q66", 6).alias("oi_q66"), F.round("vol_high", 4).alias("vol_high"))


@query(sql("trades", "SELECT symbol, side, count(*) AS n, round(sum(pnl), 2) AS net FROM trades GROUP BY ROLLUP (symbol, side)"))
def results_rollup(spark: S, sf: str) -> DataFrame:
    return rounded(D.trades(spark, sf).rollup("symbol", "side").agg(F.count("*").alias("n"), F.sum("pnl").alias("net")), 2, "net")


@query(sql("trades", DAYS + ", r AS (SELECT *, equity / lag(equity) OVER (PARTITION BY tag ORDER BY day) - 1 AS r FROM day), s AS (SELECT tag, avg(r) / stddev_samp(r) * sqrt(365) AS sharpe FROM r GROUP BY tag), g AS (SELECT tag, count(*) AS n, avg(CAST(pnl > 0 AS DOUBLE)) AS w, sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0) AS pf, avg(r) AS ar, min(dd) AS m FROM dd GROUP BY tag) SELECT tag, n, round(w, 6) AS win_rate, round(pf, 6) AS profit_factor, round(ar, 6) AS avg_r, round(m, 6) AS max_dd, round(sharpe, 5) AS sharpe FROM g JOIN s USING (tag)"))
def leaderboard(spark: S, sf: str) -> DataFrame:
    curve = _curve(spark, sf)
    one = P.summary(D.trades(spark, sf), ["tag"]).select("tag", "n", "win_rate", "profit_factor")
    r = D.trades(spark, sf).groupBy("tag").agg(F.avg("r").alias("avg_r"))
    dd = P.curve_metrics(curve, ["tag"], "closed_at").select("tag", "max_dd")
    daily = P.daily_metrics(P.daily_equity(curve, ["tag"], "closed_at", fill=False), ["tag"]).select("tag", "sharpe")
    out = one.join(r, "tag").join(dd, "tag").join(daily, "tag")
    return rounded(rounded(out, 6, "win_rate", "profit_factor", "avg_r", "max_dd"), 5, "sharpe")


@query(sql("trades", "SELECT id, symbol, side, size, round(entry, 6) AS entry, opened_at, closed_at, pnl, round(fees, 9) AS fees, exit_reason FROM trades WHERE closed_at >= TIMESTAMP '2024-01-10' AND closed_at < TIMESTAMP '2024-01-12'"))
def windowed_export(spark: S, sf: str) -> DataFrame:
    return rounded(T.window_export(D.trades(spark, sf), "2024-01-10", "2024-01-12").withColumn("fees", F.round("fees", 9)), 6, "entry")


@query(sql("trades", "SELECT count(*) AS n, round(sum(pnl), 2) AS net FROM trades WHERE CAST(closed_at AS DATE) = DATE '2024-01-15'"))
def day_report(spark: S, sf: str) -> DataFrame:
    return rounded(T.day_report(D.trades(spark, sf), "2024-01-15").agg(F.count("*").alias("n"), F.sum("pnl").alias("net")), 2, "net")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE date_trunc('minute', o_orderdate) - INTERVAL 60 MINUTE END AS closed_at FROM orders")
def statement_times(spark: S, sf: str) -> DataFrame:
    at, k = F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(at, "yyyy-MM-dd HH:mm:ss")).when(k == 1, F.date_format(at, "HH:mm yyyy-MM-dd")).when(k == 2, F.date_format(at, "dd/MM/yyyy HH:mm")).otherwise("yesterday")
    return D.table(spark, sf, "orders").select("o_orderkey", T.parse_trade_time(text, 60).alias("closed_at"))


@query(sql("trades", "SELECT id, replace(symbol || '|' || side, '|', '\\|') AS cell FROM trades"))
def markdown_cells(spark: S, sf: str) -> DataFrame:
    return D.trades(spark, sf).select("id", C.markdown_cell(F.concat_ws("|", "symbol", "side")).alias("cell"))


_ERF = "{c} * (1 - t * exp(-x * x + -1.26551223 + t * (1.00002368 + t * (0.37409196 + t * (0.09678418 + t * (-0.18628806 + t * (0.27886807 + t * (-1.13520398 + t * (1.48851587 + t * (-0.82215223 + t * 0.17087277))))))))))"


@query(sql("trades", "s AS (SELECT tag, count(*) AS n, avg(r) / stddev_samp(r) AS sharpe FROM trades GROUP BY tag HAVING count(*) >= 10 AND stddev_samp(r) > 0), x AS (SELECT *, sharpe * sqrt(n - 1) / sqrt(2) AS x, 1 / (1 + 0.5 * abs(sharpe * sqrt(n - 1) / sqrt(2))) AS t FROM s), p AS (SELECT tag, n, sharpe, 0.5 * (1 + " + _ERF.format(c="sign(x)") + ") AS psr FROM x) SELECT tag, n, round(sharpe, 6) AS sharpe, round(psr, 6) AS psr, round(greatest(0, 1 - (1 - psr) * 10), 6) AS dsr FROM p"))
def deflated_sharpe(spark: S, sf: str) -> DataFrame:
    return rounded(K.deflated_sharpe(D.trades(spark, sf), "r", ["tag"], 10), 6, "sharpe", "psr", "dsr")


FEATURES = ["p", "hour_sin", "hour_cos", "oi_delta", "funding_last", "notional"]


def _training(spark: S, sf: str, keep: list[str] | None = None) -> DataFrame:
    """The training set; of its columns those that are learnt from, or `keep`."""
    return M.training_set(D.trades(spark, sf), D.series(spark, sf, "view"), D.series(spark, sf, "error"), keep=keep or ["y", *FEATURES])


@query(sql("trades", "SELECT id, y, CAST(row_number() OVER (ORDER BY opened_at, symbol, id) - 1 AS BIGINT) AS order_idx, round(abs(size) * entry * 6 / 1e4, 9) AS fee_est FROM trades"))
def training_set(spark: S, sf: str) -> DataFrame:
    return rounded(_training(spark, sf, ["y", "fee_est"]).select("id", "y", "order_idx", "fee_est"), 9, "fee_est")


@query()
def out_of_fold_scores(spark: S, sf: str) -> DataFrame:
    return rounded(M.out_of_fold(_training(spark, sf), FEATURES, 3, 50, ["id", "y"]), 6, "p")


@query(sql("trades", SIZE + ", e AS (SELECT abs(CASE WHEN up = 0 THEN 0 ELSE risk END - CASE WHEN up = 0 THEN 0 ELSE risk * CASE WHEN id % 10 = 0 THEN 1.01 ELSE 1 END END) AS d FROM q) SELECT count(*) AS n, round(avg(d), 6) AS mean_error, round(quantile_cont(d, 0.9), 6) AS p90_error, round(max(d), 6) AS max_error FROM e"))
def sizing_parity(spark: S, sf: str) -> DataFrame:
    a = sizing_chain(spark, sf).select("id", "risk_usd")
    b = a.select("id", (F.col("risk_usd") * F.when(F.col("id") % 10 == 0, 1.01).otherwise(1.0)).alias("other"))
    gap = F.abs(F.col("risk_usd") - F.col("other"))
    both = a.join(b, "id").select(gap.alias("gap"))
    one = both.agg(F.count("*").alias("n"), F.avg("gap").alias("mean_error"), F.max("gap").alias("max_error"))
    out = W.with_quantiles(one, both, {"q": F.col("gap")}, [0.9]).withColumn("p90_error", F.col("q")[0]).drop("q")
    return rounded(out, 6, "mean_error", "p90_error", "max_error")


@query()
def calibrated_scores(spark: S, sf: str) -> DataFrame:
    t = staged(D.trades(spark, sf).select("id", "p", "y"), "calibration-rows")  # read by each calibrator and each of its figures
    known = M.calibrators(t)
    name, _ = M.choose_calibrator(t, found=known)
    out = known[name](t) if name != "raw" else t.withColumn("p_cal", F.col("p"))
    return rounded(out.select("id", "p_cal", F.lit(name).alias("calibrator")), 6, "p_cal")


@query(sql("trades", "v AS (SELECT p, count(*) AS n, sum(y) AS s FROM trades GROUP BY p), c AS (SELECT p, sum(n) OVER (ORDER BY p) AS cn, sum(s) OVER (ORDER BY p) AS cs, n, s FROM v), f AS (SELECT j.p, min((j.cs - i.cs + i.s) / CAST(j.cn - i.cn + i.n AS DOUBLE)) OVER (PARTITION BY i.p ORDER BY j.p DESC) AS low FROM c i JOIN c j ON j.p >= i.p), g AS (SELECT p, max(low) AS v FROM f GROUP BY p) SELECT id, round(v, 6) AS p_cal FROM trades JOIN g USING (p)"))
def isotonic_scores(spark: S, sf: str) -> DataFrame:
    t = D.trades(spark, sf).select("id", "p", "y")
    return rounded(M.apply_isotonic(t, M.isotonic_blocks(t)).select("id", "p_cal"), 6, "p_cal")


@query()
def feature_ablation(spark: S, sf: str) -> DataFrame:
    m = M.drop_one(_training(spark, sf), FEATURES, 5, 50)
    return rounded(Q.ablation(m, "baseline", 0.0, 0.005), 6, "auc", "brier", "d_auc", "d_brier")


@query()
def refit_shuffle_test(spark: S, sf: str) -> DataFrame:
    return rounded(fits.refit_p_value(fits.refit_shuffle(_training(spark, sf), FEATURES, 5, 50, 200)), 6, "auc", "brier", "p_value")


SINGLE = ["p", "size", "fees_seen"]
_SINGLE = (
    "o AS (SELECT *, CASE WHEN id % 10 <> 0 THEN fees END AS fees_seen, row_number() OVER (ORDER BY opened_at, symbol, id) - 1 AS i FROM trades), "
    "f AS (SELECT k AS fold, k * (n // 3) + least(k, n % 3) AS lo, (k + 1) * (n // 3) + least(k + 1, n % 3) - 1 AS hi FROM generate_series(0, 2) g(k), (SELECT count(*) AS n FROM trades)), "
    "v AS (" + " UNION ALL ".join(f"SELECT y, i, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM o" for c in SINGLE) + "), "
    "t AS (SELECT v.*, fold FROM v JOIN f ON i < lo - 50 OR i > hi + 50), "
    "m AS (SELECT fold, feature, median(x) AS med FROM t GROUP BY fold, feature), c AS (SELECT fold, feature, y, coalesce(x, med) AS x FROM t JOIN m USING (fold, feature)), "
    "s AS (SELECT fold, feature, avg(x) AS mu, stddev_samp(x) AS sd, count(*) AS n FROM c GROUP BY fold, feature), z AS (SELECT fold, feature, y, (x - mu) / sd AS z FROM c JOIN s USING (fold, feature)), "
    "w(step, fold, feature, a, b) AS (SELECT 0, fold, feature, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM s UNION ALL "
    "SELECT step + 1, fold, feature, a + (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), b + (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) FROM ("
    "SELECT step, fold, feature, a, b, avg(y - p) AS g0, avg((y - p) * z) - 0.01 * b AS g1, avg(p * (1 - p)) AS h00, avg(p * (1 - p) * z) AS h01, avg(p * (1 - p) * z * z) + 0.01 AS h11 "
    "FROM (SELECT w.*, y, z, 1 / (1 + exp(-(a + b * z))) AS p FROM w JOIN z USING (fold, feature) WHERE step < 12) GROUP BY step, fold, feature, a, b)) "
    "SELECT feature AS model, CAST(fold AS INTEGER) AS fold, n AS rows, unnest(['intercept', feature]) AS feature, round(unnest([a, b]), 6) AS value FROM w JOIN s USING (fold, feature) WHERE step = 12"
)


@query(sql("trades", _SINGLE).replace("WITH ", "WITH RECURSIVE ", 1))
def single_feature_fits(spark: S, sf: str) -> DataFrame:
    seen = D.trades(spark, sf).withColumn("fees_seen", F.when(F.col("id") % 10 != 0, F.col("fees")))
    t = W.with_order_index(seen.select("opened_at", "symbol", "id", "y", *SINGLE), ["opened_at", "symbol", "id"])
    m = fits.fit_all(fits.packed_rows(t, SINGLE, F.array("y")), SINGLE, [fits.Variant(c, (c,)) for c in SINGLE], 3, 50)
    return rounded(fits.coefficients(spark, m), 6, "value")
