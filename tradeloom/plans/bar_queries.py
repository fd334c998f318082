"""Queries over bars, series, decisions and log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import asof as A
from ..operators import bars as B
from ..operators import joins as J
from ..operators import logs as L
from ..operators import quality as Q
from ..operators import recursive as R
from ..operators import scans as N
from ..operators import windows as W
from . import domain as D
from .domain import rounded, sql
from .registry import query

S = SparkSession
BY = "PARTITION BY symbol ORDER BY ts"


def last(n: int) -> str:
    return f"OVER ({BY} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int, least: int | None = None) -> str:
    return f"CASE WHEN count({x}) {last(n)} >= {least or n} THEN {agg}({x}) {last(n)} END"


@query(sql("days", f"c AS (SELECT symbol, ts, close, CASE WHEN count(high) OVER w = 5 THEN max(high) OVER w END AS level FROM days WINDOW w AS ({BY} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)) SELECT symbol, ts, close, level, coalesce(close > level, false) AS is_break, round(epoch_us(ts) / 86400e6 - max(CASE WHEN close > level THEN epoch_us(ts) END) OVER ({BY}) / 86400e6, 6) AS days_since_break FROM c"))
def daily_channel_breaks(spark: S, sf: str) -> DataFrame:
    df = D.bars(spark, sf, "1d").withColumn("level", W.channel_high("high", 5))
    df = df.withColumn("is_break", F.coalesce(F.col("close") > F.col("level"), F.lit(False)))
    return rounded(df.withColumn("days_since_break", W.days_since(F.col("is_break"))), 6, "days_since_break").select("symbol", "ts", "close", "level", "is_break", "days_since_break")


@query(sql("bars", "SELECT symbol, ts, open, high, low, close, volume FROM bars"))
def bars_from_ticks(spark: S, sf: str) -> DataFrame:
    return D.bars(spark, sf)


@query(sql("bars", "SELECT symbol, ts, close FROM bars WHERE symbol IN ('S1', 'S3')"))
def bars_of_symbols(spark: S, sf: str) -> DataFrame:
    return D.bars(spark, sf).where(F.col("symbol").isin("S1", "S3")).select("symbol", "ts", "close")


@query(sql("ticks", "SELECT symbol, date_trunc('day', ts) AS day, max(seq) AS seq, arg_max(price, seq) AS price FROM ticks GROUP BY ALL"))
def dedup_keep_last(spark: S, sf: str) -> DataFrame:
    t = D.ticks(spark, sf).withColumn("day", F.date_trunc("day", "ts"))
    return B.keep_last(t, ["symbol", "day"], ["seq"]).select("symbol", "day", "seq", "price")


@query(sql("bars", "SELECT symbol, ts, close FROM bars WHERE ts + INTERVAL 1 HOUR <= TIMESTAMP '2024-01-20 12:30:00'"))
def drop_incomplete(spark: S, sf: str) -> DataFrame:
    return B.complete(D.bars(spark, sf), "1h", F.lit("2024-01-20 12:30:00").cast("timestamp")).select("symbol", "ts", "close")


@query(sql("bars", "SELECT symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS ts, arg_min(open, bars.ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, bars.ts) AS close, sum(volume) AS volume FROM bars GROUP BY symbol, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01')"))
def resample_left(spark: S, sf: str) -> DataFrame:
    return B.resample(D.bars(spark, sf), "4h")


@query(sql("bars", "b AS (SELECT *, make_timestamp(CAST(ceil(epoch_us(ts) / 86400000000) AS BIGINT) * 86400000000) AS d FROM bars) SELECT symbol, d AS ts, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume FROM b GROUP BY symbol, d"))
def resample_right(spark: S, sf: str) -> DataFrame:
    return B.resample(D.bars(spark, sf), "1d", right=True)


@query(sql("bars", f"g AS (SELECT symbol, (epoch_us(ts) - lag(epoch_us(ts)) OVER ({BY})) / 1e6 AS gap FROM bars) SELECT symbol, CAST(CASE WHEN count(*) < 10 OR coalesce(quantile_cont(gap, 0.5), 0) <= 0 THEN 288 ELSE round(86400 / quantile_cont(gap, 0.5)) END AS BIGINT) AS bars_per_day FROM g GROUP BY symbol"))
def bars_per_day(spark: S, sf: str) -> DataFrame:
    return B.bars_per_day(D.bars(spark, sf))


@query(sql("bars", f"SELECT symbol, ts, round(avg(CAST(volume = 0 AS DOUBLE)) {last(100)}, 6) AS stale_share, round(avg(CAST(volume = 0 AS DOUBLE)) {last(100)}, 6) > 0.25 AS is_stale FROM bars"))
def illiquid_bars(spark: S, sf: str) -> DataFrame:
    share = F.round(B.stale_share(), 6)
    return D.bars(spark, sf).select("symbol", "ts", share.alias("stale_share"), (share > 0.25).alias("is_stale"))


GRID = "grid AS (SELECT b.symbol, b.ts, b.close, arg_max(o.value, o.ts) AS open_interest FROM bars b LEFT JOIN oi o ON o.symbol = b.symbol AND date_trunc('hour', o.ts) = b.ts GROUP BY b.symbol, b.ts, b.close)"


def _grid(spark: S, sf: str) -> DataFrame:
    oi = D.series(spark, sf, "view").groupBy("symbol", F.date_trunc("hour", "ts").alias("h")).agg(F.max_by("value", "ts").alias("open_interest")).withColumnRenamed("h", "ts")
    return D.bars(spark, sf).select("symbol", "ts", "close").join(oi, ["symbol", "ts"], "left")


@query(sql("bars oi", GRID + f" SELECT symbol, ts, round(last_value(open_interest IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING), 6) AS oi, (epoch_us(ts) - max(CASE WHEN open_interest IS NOT NULL THEN epoch_us(ts) END) OVER ({BY} ROWS UNBOUNDED PRECEDING)) / 1e6 AS age_s, coalesce((epoch_us(ts) - max(CASE WHEN open_interest IS NOT NULL THEN epoch_us(ts) END) OVER ({BY} ROWS UNBOUNDED PRECEDING)) / 1e6 > 14400, true) AS stale FROM grid"))
def fill_and_staleness(spark: S, sf: str) -> DataFrame:
    return _grid(spark, sf).select("symbol", "ts", F.round(B.forward_fill("open_interest"), 6).alias("oi"), B.age_seconds("open_interest").alias("age_s"), B.is_stale("open_interest", "4h").alias("stale"))


@query("SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS dow, round(sin(hour(ts) * 2 * pi() / 24), 9) + 0.0 AS hour_sin, round(cos(hour(ts) * 2 * pi() / 24), 9) + 0.0 AS hour_cos, CASE WHEN hour(ts) < 8 THEN 'ASIA' WHEN hour(ts) < 16 THEN 'EUROPE' ELSE 'US' END AS session FROM events")
def calendar_features(spark: S, sf: str) -> DataFrame:
    c = C.calendar(F.col("ts"))
    df = D.table(spark, sf, "events").select("event_id", *[v.alias(k) for k, v in c.items()])
    return rounded(df.withColumn("dow", F.col("dow").cast("long")).withColumn("hour", F.col("hour").cast("long")), 9, "hour_sin", "hour_cos")


@query("SELECT p_partkey, TRY_CAST(nullif(trim(CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'nan' WHEN 2 THEN ' ' || p_size ELSE 'x' END), '') AS DOUBLE) AS v FROM (SELECT * FROM part) t WHERE p_size % 4 <> 1 UNION ALL SELECT p_partkey, NULL FROM part WHERE p_size % 4 = 1")
def numeric_coercion(spark: S, sf: str) -> DataFrame:
    k = F.col("p_size") % 4
    text = F.when(k == 0, "").when(k == 1, "nan").when(k == 2, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise("x")
    return D.table(spark, sf, "part").select("p_partkey", C.to_number(text).alias("v"))


@query(sql("bars decisions", "SELECT d.id, d.symbol, d.ts, b.close, b.ts AS bar_ts FROM decisions d ASOF LEFT JOIN bars b ON d.symbol = b.symbol AND d.ts >= b.ts"))
def asof_join(spark: S, sf: str) -> DataFrame:
    return A.asof_join(D.decisions(spark, sf).drop("p"), D.bars(spark, sf), ["symbol"], ["close"], right_time="bar_ts")


@query(sql("bars oi", "m AS (SELECT symbol, time_bucket(INTERVAL 5 MINUTE, ts, TIMESTAMP '1970-01-01') AS ts, avg(value) AS value FROM oi GROUP BY ALL) SELECT b.symbol, b.ts, CASE WHEN b.ts - m.ts <= INTERVAL 2 HOUR THEN round(m.value, 6) END AS value FROM bars b ASOF LEFT JOIN m ON b.symbol = m.symbol AND b.ts >= m.ts"))
def asof_with_tolerance(spark: S, sf: str) -> DataFrame:
    m = A.rounded_mean(D.series(spark, sf, "view"), ["symbol"], ["value"], "5m")
    return rounded(A.asof_join(D.bars(spark, sf).select("symbol", "ts"), m, ["symbol"], ["value"], tolerance="2h"), 6, "value")


@query(sql("decisions oi funding", "SELECT d.id, d.symbol, d.ts, round(o.value, 6) AS oi, round(f.value, 9) AS funding FROM decisions d ASOF LEFT JOIN oi o ON d.symbol = o.symbol AND d.ts >= o.ts ASOF LEFT JOIN funding f ON d.symbol = f.symbol AND d.ts >= f.ts"))
def asof_many_series(spark: S, sf: str) -> DataFrame:
    out = A.asof_many(D.decisions(spark, sf).drop("p"), {"oi": D.series(spark, sf, "view"), "funding": D.series(spark, sf, "error")}, ["symbol"])
    return out.withColumns({"oi": F.round("oi", 6), "funding": F.round("funding", 9)})


@query(sql("days decisions", "t AS (SELECT symbol, ts, close, CAST(close > open AS INTEGER) AS code FROM days WHERE ts < TIMESTAMP '2024-01-25'), e AS (SELECT symbol, max(ts) AS e FROM t GROUP BY symbol) SELECT d.id, d.ts, coalesce(d.ts <= e.e AND t.close IS NOT NULL, false) AS truth_ok, CASE WHEN d.ts <= e.e THEN t.close END AS close, CASE WHEN d.ts <= e.e THEN t.code END AS code FROM decisions d ASOF LEFT JOIN t ON d.symbol = t.symbol AND d.ts >= t.ts LEFT JOIN e ON d.symbol = e.symbol"))
def truth_lookup(spark: S, sf: str) -> DataFrame:
    truth = D.bars(spark, sf, "1d").where("ts < timestamp'2024-01-25'").select("symbol", "ts", "close", (F.col("close") > F.col("open")).cast("int").alias("code"))
    return A.truth_lookup(D.decisions(spark, sf).select("id", "symbol", "ts"), truth, ["symbol"], ["close", "code"]).drop("symbol")


@query(sql("bars days", "SELECT b.symbol, b.ts, b.close, d.open AS day_open FROM bars b JOIN days d ON b.symbol = d.symbol AND b.ts = d.ts"))
def exact_lookup(spark: S, sf: str) -> DataFrame:
    d = D.bars(spark, sf, "1d").select("symbol", "ts", F.col("open").alias("day_open"))
    return D.bars(spark, sf).select("symbol", "ts", "close").join(d, ["symbol", "ts"])


@query(sql("bars decisions", "e AS (SELECT min(e) AS e FROM (SELECT max(ts) AS e FROM bars WHERE symbol IN ('S0', 'S1') GROUP BY symbol)) SELECT d.id, CASE WHEN d.ts <= e THEN a.close END AS s0_close, CASE WHEN d.ts <= e THEN b.close END AS s1_close FROM decisions d ASOF LEFT JOIN (SELECT * FROM bars WHERE symbol = 'S0') a ON d.ts >= a.ts ASOF LEFT JOIN (SELECT * FROM bars WHERE symbol = 'S1') b ON d.ts >= b.ts CROSS JOIN e"))
def cross_asset_context(spark: S, sf: str) -> DataFrame:
    return J.with_assets(D.decisions(spark, sf).select("id", "ts"), D.bars(spark, sf), ["S0", "S1"], ["close"]).drop("ts")


@query(sql("bars", f"f AS (SELECT symbol, min(ts) AS f FROM bars GROUP BY symbol), l AS (SELECT 'S' || n_nationkey AS symbol, TIMESTAMP '2023-12-01' + to_days(n_nationkey) AS listed_at FROM nation WHERE n_nationkey < 5) SELECT b.symbol, b.ts, CAST(greatest(0, floor((epoch_us(b.ts) - epoch_us(coalesce(l.listed_at, f.f))) / 86400e6)) AS BIGINT) AS age_days FROM bars b JOIN f USING (symbol) LEFT JOIN l USING (symbol)"))
def listing_age(spark: S, sf: str) -> DataFrame:
    b = D.bars(spark, sf)
    listed = D.table(spark, sf, "nation").where("n_nationkey < 5").select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("symbol"), F.expr("timestamp'2023-12-01' + make_interval(0, 0, 0, n_nationkey)").alias("listed_at"))
    return J.with_listing_age(b.select("symbol", "ts"), listed, b.groupBy("symbol").agg(F.min("ts").alias("first_ts"))).select("symbol", "ts", "age_days")


@query(sql("bars", f"SELECT symbol, ts, round({full('avg', 'close', 20)}, 6) AS sma20, round({full('avg', 'close', 3)} - {full('avg', 'close', 10)}, 6) AS osc, round({full('avg', 'close', 20)} + 2 * {full('stddev_pop', 'close', 20)}, 6) AS bb_up, round({full('avg', 'close', 20)} - 2 * {full('stddev_pop', 'close', 20)}, 6) AS bb_low FROM bars"))
def moving_averages(spark: S, sf: str) -> DataFrame:
    bb = W.bollinger("close")
    return rounded(D.bars(spark, sf).select("symbol", "ts", W.sma("close", 20).alias("sma20"), W.oscillator("close").alias("osc"), bb["bb_up"].alias("bb_up"), bb["bb_low"].alias("bb_low")), 6, "sma20", "osc", "bb_up", "bb_low")


@query(sql("bars", f"a AS (SELECT *, {full('avg', 'close', 8)} AS s, lag(close) OVER ({BY}) AS pc FROM bars) SELECT symbol, ts, round({full('avg', 's', 8)}, 6) AS tma, round(greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)), 6) AS tr FROM a"))
def triangular_and_true_range(spark: S, sf: str) -> DataFrame:
    return rounded(W.with_tma(D.bars(spark, sf), "close", 8).select("symbol", "ts", "tma", W.true_range().alias("tr")), 6, "tma", "tr")


@query(sql("days bars", f"c AS (SELECT symbol, CAST(ts AS DATE) AS d, CASE WHEN count(high) OVER w = 3 THEN max(high) OVER w END AS ch FROM days WINDOW w AS ({BY} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)) SELECT b.symbol, b.ts, last_value(c.ch IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS UNBOUNDED PRECEDING) AS channel FROM bars b LEFT JOIN c ON b.symbol = c.symbol AND CAST(b.ts AS DATE) = c.d"))
def channel_on_grid(spark: S, sf: str) -> DataFrame:
    return W.daily_channel_on_grid(D.bars(spark, sf), D.bars(spark, sf, "1d"), 3).select("symbol", "ts", "channel")


@query(sql("bars", f"a AS (SELECT *, lag(close) OVER ({BY}) AS pc, greatest(high - low, 0.01) AS atr FROM bars), b AS (SELECT *, ln(close / pc) AS lr FROM a) SELECT symbol, ts, round(close / lag(close, 24) OVER ({BY}) - 1, 6) AS prior_1d_ret, round({full('stddev_samp', 'lr', 72)}, 6) AS rv_3d, round(({full('max', 'high', 12)} - {full('min', 'low', 12)}) / atr, 4) AS consolidation_atr, round((close - {full('avg', 'close', 24)}) / atr, 4) AS gap_from_1d_ma, round({full('stddev_samp', 'lr', 20)} * sqrt(20), 6) AS rv20 FROM b"))
def entry_quality(spark: S, sf: str) -> DataFrame:
    df = D.bars(spark, sf).withColumns({"atr": F.greatest(F.col("high") - F.col("low"), F.lit(0.01)), "log_ret": W.log_return("close")})
    df = df.withColumns(W.entry_quality(24) | {"rv20": W.realized_vol()})
    return rounded(rounded(df, 6, "prior_1d_ret", "rv_3d", "rv20"), 4, "consolidation_atr", "gap_from_1d_ma").select("symbol", "ts", "prior_1d_ret", "rv_3d", "consolidation_atr", "gap_from_1d_ma", "rv20")


@query(sql("days", f"c AS (SELECT symbol, ts, close > max(high) OVER ({BY} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AND count(*) OVER ({BY} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 3 AS b FROM days) SELECT symbol, ts, date_diff('day', last_value(CASE WHEN b THEN CAST(ts AS DATE) END IGNORE NULLS) OVER ({BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(ts AS DATE)) AS days_since_prev FROM c"))
def days_since_previous_break(spark: S, sf: str) -> DataFrame:
    d = D.bars(spark, sf, "1d").withColumn("b", F.col("close") > W.channel_high("high", 3))
    return d.select("symbol", "ts", W.calendar_days_since_prior(F.col("b")).cast("long").alias("days_since_prev"))


VW = f"a AS (SELECT *, (high + low + close) / 3 * volume AS pv FROM bars), v AS (SELECT *, CASE WHEN count(pv) {last(12)} >= 12 THEN sum(pv) {last(12)} / nullif(sum(volume) {last(12)}, 0) END AS vwap FROM a), i AS (SELECT *, CAST(abs(close / vwap - 1) <= 0.05 AS DOUBLE) AS inb FROM v)"
PRIOR12 = f"OVER ({BY} ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"


@query(sql("bars", VW + f" SELECT symbol, ts, round(vwap, 6) AS vwap, round(coalesce(CASE WHEN count(inb) {PRIOR12} >= 12 THEN avg(inb) {PRIOR12} END, 0), 6) AS vwap_share, round(coalesce(abs(close / vwap - 1), 0), 6) AS vwap_dist, round(coalesce((vwap - lag(vwap, 11) OVER ({BY})) / lag(vwap, 11) OVER ({BY}) / 11, 0), 6) AS vwap_slope FROM i"))
def vwap_stack(spark: S, sf: str) -> DataFrame:
    return rounded(W.with_vwap_stack(D.bars(spark, sf), 12, 0.05).select("symbol", "ts", "vwap", "vwap_share", "vwap_dist", "vwap_slope"), 6, "vwap", "vwap_share", "vwap_dist", "vwap_slope")


_STACK = f"s AS (SELECT symbol, ts, volume, vwap, coalesce(CASE WHEN count(inb) {PRIOR12} >= 12 THEN avg(inb) {PRIOR12} END, 0) AS share, coalesce(abs(close / vwap - 1), 0) AS gap FROM i), k AS (SELECT *, greatest(0, least(1, (share - 0.5) / 0.2)) AS a, greatest(0, least(1, (gap - 0.006) / 0.009)) AS b FROM s)"


@query(sql("bars", VW + ", " + _STACK + " SELECT symbol, ts, round(0.8 + (0.6 * a + 0.4 * b) * 0.7, 6) AS stack_mult, round(least(1.2, greatest(0.5, (0.6 + 0.9 * greatest(0, least(1, (coalesce(vwap, 50) - 40) / 20))) * least(1.1, 0.8 + greatest(0, least(1, volume / 200)) * 0.5))), 6) AS scaled FROM k"))
def stack_multipliers(spark: S, sf: str) -> DataFrame:
    bars = W.with_vwap_stack(D.bars(spark, sf), 12, 0.05)
    scalers = [{"feature": "vwap", "default": 50, "in_min": 40, "in_max": 60, "mult_min": 0.6, "mult_max": 1.5}, {"feature": "volume", "in_max": 200, "mult_min": 0.8, "mult_max": 1.3, "cap_max": 1.1}]
    both = (C.stack_multiplier(F.col("vwap_share"), F.col("vwap_dist"), low=0.8, high=1.5).alias("stack_mult"), C.scaler_product(scalers, 0.5, 1.2).alias("scaled"))
    return rounded(bars.select("symbol", "ts", *both), 6, "stack_mult", "scaled")


@query(sql("bars", f"SELECT symbol, ts, round(volume / nullif(CASE WHEN count(volume) {last(50)} >= 5 THEN quantile_cont(volume, 0.5) {last(50)} END, 0), 6) AS vol_mult, coalesce(volume >= 2 * CASE WHEN count(volume) {PRIOR12} >= 12 THEN avg(volume) {PRIOR12} END, false) AS surge FROM bars"))
def volume_features(spark: S, sf: str) -> DataFrame:
    return rounded(W.with_volume_multiple(D.bars(spark, sf), 50, "vol_mult").select("symbol", "ts", "vol_mult", W.volume_surge(12, 2.0).alias("surge")), 6, "vol_mult")


def _z(x: str, n: int, least: int) -> str:
    return f"({x} - {full('avg', x, n, least)}) / ({full('stddev_samp', x, n, least)} + 1e-12)"


DERIV = f"""fg AS (SELECT b.symbol, b.ts, b.close, b.open_interest, arg_max(f.value, f.ts) AS fr FROM grid b LEFT JOIN funding f ON f.symbol = b.symbol AND date_trunc('hour', f.ts) = b.ts GROUP BY ALL),
x AS (SELECT symbol, ts, close, last_value(open_interest IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS oi, last_value(fr IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING) AS fr FROM fg),
c AS (SELECT *, oi / nullif(lag(oi, 1) OVER ({BY}), 0) - 1 AS c1, oi / nullif(lag(oi, 4) OVER ({BY}), 0) - 1 AS c4, oi / nullif(lag(oi, 24) OVER ({BY}), 0) - 1 AS c24, close / nullif(lag(close, 1) OVER ({BY}), 0) - 1 AS p1 FROM x),
z AS (SELECT *, {_z('c24', 168, 24)} AS oz, {_z('fr', 168, 24)} AS fz, {full('sum', 'fr', 72, 24)} AS f3 FROM c)"""


@query(sql("bars oi funding", GRID + ", " + DERIV + " SELECT symbol, ts, round(oi * close, 4) AS oi_notional, round(c1, 6) AS oi_pct_1h, round(c4, 6) AS oi_pct_4h, round(c24, 6) AS oi_pct_1d, round(oz, 5) AS oi_z_7d, round(c1 - p1, 6) + 0.0 AS oi_price_div, round(fz, 5) AS funding_z_7d, round(f3, 9) AS funding_sum_3d, round((abs(oz) + 0.5) * (abs(fz) + 0.5), 4) AS est_leverage, CASE WHEN fr <= -0.0001 THEN -1 WHEN fr >= 0.0001 THEN 1 WHEN fr IS NOT NULL THEN 0 END AS funding_code, CASE WHEN oz <= -0.4 THEN -1 WHEN oz >= 0.4 THEN 1 WHEN oz IS NOT NULL THEN 0 END AS oi_code FROM z"))
def derivatives_block(spark: S, sf: str) -> DataFrame:
    fr = D.series(spark, sf, "error").groupBy("symbol", F.date_trunc("hour", "ts").alias("h")).agg(F.max_by("value", "ts").alias("funding_rate")).withColumnRenamed("h", "ts")
    df = W.with_derivatives(_grid(spark, sf).join(fr, ["symbol", "ts"], "left"), 1, 24, eps=0.0001, low=-0.4, high=0.4)
    df = df.withColumns({"oi_notional": F.round("oi_notional", 4), "est_leverage": F.round("est_leverage", 4), "funding_sum_3d": F.round("funding_sum_3d", 9), "oi_z_7d": F.round("oi_z_7d", 5), "funding_z_7d": F.round("funding_z_7d", 5)})
    return rounded(df, 6, "oi_pct_1h", "oi_pct_4h", "oi_pct_1d", "oi_price_div").select("symbol", "ts", "oi_notional", "oi_pct_1h", "oi_pct_4h", "oi_pct_1d", "oi_z_7d", "oi_price_div", "funding_z_7d", "funding_sum_3d", "est_leverage", "funding_code", "oi_code")


@query(sql("days", f"l AS (SELECT *, CASE WHEN count(high) OVER w = 3 THEN max(high) OVER w END AS lv FROM days WINDOW w AS ({BY} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)), b AS (SELECT *, CAST(close > lv AS INTEGER) AS br, CASE WHEN close > lv THEN CAST(min(close) OVER ({BY} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) < lv AS INTEGER) ELSE 0 END AS fl FROM l), s AS (SELECT symbol, ts, CAST(coalesce(sum(br) OVER w, 0) AS BIGINT) AS breaks, CAST(coalesce(sum(fl) OVER w, 0) AS BIGINT) AS failed FROM b WINDOW w AS ({BY} ROWS BETWEEN 12 PRECEDING AND 2 PRECEDING)) SELECT *, round(failed / nullif(breaks, 0), 6) AS fail_rate FROM s"))
def breakout_history(spark: S, sf: str) -> DataFrame:
    return rounded(W.with_breakout_history(D.bars(spark, sf, "1d"), 3, 10, 2).select("symbol", "ts", "breaks", "failed", "fail_rate"), 6, "fail_rate")


@query(sql("days", f"t AS (SELECT *, {full('avg', 'close', 3)} AS s FROM days), u AS (SELECT *, {full('avg', 's', 3)} AS tma, high - low AS atr FROM t), n AS (SELECT *, CASE WHEN close > tma + 0.1 * atr THEN 'BULL' WHEN close < tma - 0.1 * atr THEN 'BEAR' END AS now FROM u) SELECT symbol, ts, coalesce(last_value(now IGNORE NULLS) OVER ({BY} ROWS UNBOUNDED PRECEDING), first_value(now IGNORE NULLS) OVER ({BY} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS trend FROM n"))
def trend_regime(spark: S, sf: str) -> DataFrame:
    d = W.with_tma(D.bars(spark, sf, "1d"), "close", 3).withColumn("atr", F.col("high") - F.col("low"))
    return W.with_trend_regime(d, 0.1).select("symbol", "ts", "trend")


@query(sql("days", f"a AS (SELECT symbol, ts, close, close * volume AS turnover, coalesce(close / nullif(lag(close, 7) OVER ({BY}), 0) - 1, 0) AS rs FROM days), b AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY rs, symbol) - 1 AS k, count(*) OVER (PARTITION BY ts) AS n FROM a) SELECT symbol, ts, round(rs, 6) AS rs_ret, round(CASE WHEN n > 1 THEN 100.0 * k / (n - 1) ELSE 100.0 END, 6) AS rs_pct, round((rs - avg(rs) OVER (PARTITION BY ts)) / CASE WHEN stddev_pop(rs) OVER (PARTITION BY ts) > 0 THEN stddev_pop(rs) OVER (PARTITION BY ts) ELSE 1 END, 4) AS rs_ret_z, round((turnover - avg(turnover) OVER (PARTITION BY ts)) / CASE WHEN stddev_pop(turnover) OVER (PARTITION BY ts) > 0 THEN stddev_pop(turnover) OVER (PARTITION BY ts) ELSE 1 END, 4) AS turnover_z FROM b"))
def relative_strength(spark: S, sf: str) -> DataFrame:
    d = W.with_relative_strength(D.bars(spark, sf, "1d")).withColumn("turnover", F.col("close") * F.col("volume"))
    out = rounded(W.with_cross_zscore(d, ["rs_ret", "turnover"]), 4, "rs_ret_z", "turnover_z")
    return rounded(out, 6, "rs_ret", "rs_pct").select("symbol", "ts", "rs_ret", "rs_pct", "rs_ret_z", "turnover_z")


@query(sql("bars", f"t AS (SELECT symbol, ts, {full('sum', '(close * volume)', 24)} AS v FROM bars), k AS (SELECT * FROM t WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 7) SELECT symbol, round(quantile_cont(v, 0.5), 4) AS liquidity FROM k GROUP BY symbol"))
def liquidity(spark: S, sf: str) -> DataFrame:
    return rounded(W.liquidity(D.bars(spark, sf)), 4, "liquidity")


@query(sql("bars", f"SELECT symbol, ts, close > 1.5 AND volume > 20 AS should_enter, list_filter([CASE WHEN volume < 5 THEN 'veto:thin' END, CASE WHEN close > 1.5 THEN 'price' END, CASE WHEN volume > 20 THEN 'volume' END], lambda y: y IS NOT NULL) AS tags FROM (SELECT symbol, ts, close, volume FROM bars)"))
def rule_set(spark: S, sf: str) -> DataFrame:
    registry = {"thin": lambda at: F.col("volume") < at, "price": lambda at: F.col("close") > at, "volume": lambda at: F.col("volume") > at}
    spec = {"veto": {"any": [{"thin": {"at": 5}}]}, "entry": {"all": [{"price": {"at": "@floor"}}, {"volume": {"at": 20}}]}}
    enter, tags = C.evaluate_rules(spec, registry, {"floor": 1.5})
    return D.bars(spark, sf).select("symbol", "ts", enter.alias("should_enter"), tags.alias("tags"))


@query(sql("bars", "SELECT symbol, ts, array_to_string(list_filter([CASE WHEN volume <= 50 THEN 'GAP' END, CASE WHEN day(ts) < 5 THEN 'AGE_TOO_NEW' END, CASE WHEN day(ts) > 25 THEN 'AGE_TOO_OLD' END, CASE WHEN NOT (close BETWEEN 2 AND 40) THEN 'RSI_RANGE' END, CASE WHEN high > 60 THEN 'STRUCTURAL_TREND' END, CASE WHEN NOT (low BETWEEN 1 AND 30) THEN 'ADX' END, CASE WHEN hour(ts) >= 20 THEN 'MAX_OPEN' END, CASE WHEN open < 1.5 THEN 'LOW_EQUITY' END], lambda y: y IS NOT NULL), ',') AS vetoes FROM bars"))
def veto_list(spark: S, sf: str) -> DataFrame:
    v = C.vetoes(F.col("volume") > 50, F.day("ts"), F.col("close"), F.col("high"), F.col("low"), F.hour("ts"), F.col("open"), min_age=5, max_age=25, rsi_range=(2, 40), max_ret=60, adx_range=(1, 30), max_open=20, min_equity=1.5)
    return D.bars(spark, sf).select("symbol", "ts", F.concat_ws(",", v).alias("vetoes"))


@query(sql("decisions", "SELECT id, CASE WHEN id % 5 = 0 THEN 'schema_fail' WHEN id % 11 = 0 THEN 'no_prob_gate' WHEN id % 3 = 0 THEN 'scope_fail:RISK_ON_1' WHEN id % 13 = 0 THEN 'prob_invalid_no_gate' WHEN p >= 0.42 THEN 'ok' ELSE 'below_pstar' END AS reason, NOT (id % 5 = 0) AND (id % 11 = 0 OR (id % 3 <> 0 AND (id % 13 = 0 OR p >= 0.42))) AS meta_ok FROM decisions"))
def meta_gate(spark: S, sf: str) -> DataFrame:
    d = D.decisions(spark, sf).withColumn("risk_on_1", F.when(F.col("id") % 3 == 0, "0").otherwise("1"))
    scope, _ = C.scope_ok("RISK_ON_1", d.columns)
    p, pstar = F.when(F.col("id") % 13 != 0, F.col("p")), F.when(F.col("id") % 11 != 0, F.lit(0.42))
    ok, reason = C.meta_decision(F.col("id") % 5 != 0, scope, p, pstar, scope="RISK_ON_1")
    return d.select("id", reason.alias("reason"), ok.alias("meta_ok"))


@query(sql("decisions", "SELECT id, CASE WHEN v <= -0.4 THEN -1 WHEN v >= 0.4 THEN 1 ELSE 0 END AS way, CASE WHEN v <= -0.1 THEN -1 WHEN v >= 0.1 THEN 1 ELSE 0 END AS sign, CASE WHEN v >= 0.3 AND p >= 0.3 THEN 1 WHEN v >= 0.3 AND p <= 0.1 THEN -1 ELSE 0 END AS crowd, CASE WHEN id % 2 = 1 AND v > 0 AND p < 0.5 THEN 1 ELSE 0 END AS risk_on, (CASE WHEN v <= -0.1 THEN -1 WHEN v >= 0.1 THEN 1 ELSE 0 END + 1) * 3 + CASE WHEN v <= -0.4 THEN -1 WHEN v >= 0.4 THEN 1 ELSE 0 END + 1 AS s3 FROM (SELECT *, p * 2 - 1 AS v FROM decisions)"))
def regime_codes(spark: S, sf: str) -> DataFrame:
    v = F.col("p") * 2 - 1
    way, sign = C.three_way(v, -0.4, 0.4), C.sign_code(v, 0.1)
    return D.decisions(spark, sf).select("id", way.alias("way"), sign.alias("sign"), C.crowd_side(v, F.col("p"), 0.3, 0.1).alias("crowd"), C.risk_on(F.col("id") % 2, v, F.col("p"), 0.5).alias("risk_on"), C.crossed_code(sign, way).alias("s3"))


@query(sql("log", "SELECT line, symbol, decision_ts, schema_ok, p_cal, 0.42 AS pstar, meta_ok, strat_ok, reason FROM log"))
def parse_log(spark: S, sf: str) -> DataFrame:
    return L.parse_decisions(D.log_lines(spark, sf), keep=("line",)).select("line", "symbol", "decision_ts", "schema_ok", "p_cal", "pstar", "meta_ok", "strat_ok", "reason")


def _decisions(spark: S, sf: str) -> DataFrame:
    return L.with_reasons(L.latest_decisions(L.parse_decisions(D.log_lines(spark, sf), keep=("line",)), ["line"]))


CANON = "r AS (SELECT *, CASE WHEN meta_ok AND strat_ok THEN 'taken' ELSE 'skipped' END AS decision, CASE WHEN NOT schema_ok THEN 'schema_fail' WHEN reason = 'below_pstar' THEN 'meta_prob' WHEN meta_ok AND NOT strat_ok THEN 'strategy_fail' ELSE 'ok' END AS canon FROM logs)"


@query(sql("log logs", CANON + " SELECT reason AS reason_raw, canon AS reason_canonical, count(*) AS n FROM r GROUP BY ALL"))
def reason_mapping(spark: S, sf: str) -> DataFrame:
    return L.reason_mapping(_decisions(spark, sf))


@query(sql("log logs", CANON + " SELECT count(*) AS n, round(avg(CAST(reason = canon AS DOUBLE)), 6) AS same FROM r"))
def reason_agreement(spark: S, sf: str) -> DataFrame:
    return rounded(L.agreement(_decisions(spark, sf), {"same": ("reason_raw", "reason_canonical")}), 6, "same")


@query(sql("log logs", "SELECT count(*) AS n, count(*) FILTER (NOT schema_ok) AS failures, round(avg(CAST(NOT schema_ok AS DOUBLE)), 6) AS fail_rate, count(*) FILTER (fields = ['days_since_prev_break']) AS warm_up_only FROM logs"))
def schema_fail_rates(spark: S, sf: str) -> DataFrame:
    return rounded(L.fail_rates(_decisions(spark, sf)), 6, "fail_rate")


@query(sql("log logs", "f AS (SELECT symbol, unnest(fields) AS field FROM logs), n AS (SELECT symbol, field, count(*) AS n FROM f GROUP BY ALL) SELECT symbol, field, n, CAST(row_number() OVER (PARTITION BY symbol ORDER BY n DESC, field) AS INTEGER) AS rank FROM n QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, field) <= 2"))
def missing_field_ranks(spark: S, sf: str) -> DataFrame:
    return L.missing_counts(_decisions(spark, sf), ["symbol"], 2)


@query(sql("log logs", "f AS (SELECT unnest(fields) AS field FROM logs) SELECT field, count(*) AS n FROM f WHERE field <> 'days_since_prev_break' GROUP BY field HAVING count(*) >= 3"))
def incident_fields(spark: S, sf: str) -> DataFrame:
    return L.incidents(_decisions(spark, sf))


@query(sql("log logs", "SELECT symbol, decision_ts, CASE WHEN schema_ok THEN 'unknown' WHEN fields <> ['days_since_prev_break'] THEN 'integration_defect' WHEN CAST(substr(symbol, 2) AS INTEGER) >= 6 THEN 'unknown' WHEN floor((epoch_us(decision_ts) - epoch_us(TIMESTAMP '2023-12-20')) / 86400e6) <= 20 THEN 'warmup_expected' ELSE 'integration_defect' END AS schema_fail_class FROM logs"))
def schema_fail_classes(spark: S, sf: str) -> DataFrame:
    meta = D.table(spark, sf, "nation").where("n_nationkey < 6").select(F.concat(F.lit("S"), F.col("n_nationkey").cast("string")).alias("symbol"), F.lit("2023-12-20").cast("timestamp").alias("listed_at"))
    return L.with_listing(_decisions(spark, sf), meta, 20).select("symbol", "decision_ts", "schema_fail_class")


@query(sql("log", "SELECT symbol, arg_max(p_cal, line) FILTER (p_cal IS NOT NULL) AS p_cal, arg_max(reason, line) AS reason, count(*) AS n_events FROM log GROUP BY symbol"))
def latest_symbol_state(spark: S, sf: str) -> DataFrame:
    return L.latest_state(L.parse_decisions(D.log_lines(spark, sf), keep=("line",)), ["symbol"], F.col("line"), ["p_cal", "reason"])


@query(sql("decisions", "SELECT id, p, round(abs(p - 0.42), 6) AS gap, CASE WHEN p >= 0.42 THEN 'ABOVE' ELSE 'BELOW' END AS side FROM decisions ORDER BY abs(p - 0.42), ts LIMIT 25"))
def closest_to_threshold(spark: S, sf: str) -> DataFrame:
    return rounded(Q.closest(D.decisions(spark, sf), "p", 0.42, "ts", 25), 6, "gap").select("id", "p", "gap", "side")


@query(sql("bars", "SELECT symbol, ts, close FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts) <= 3 OR row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 3"))
def head_and_tail(spark: S, sf: str) -> DataFrame:
    return Q.head_tail(D.bars(spark, sf).select("symbol", "ts", "close"), "symbol", ["ts"], 3)


@query(sql("bars", "m AS (SELECT ts, arg_min(close, symbol) AS close, arg_min(volume, symbol) AS volume FROM bars GROUP BY ts) SELECT date_trunc('day', ts) AS bucket, arg_min(close, ts) AS close, arg_min(volume, ts) AS volume FROM m GROUP BY 1"))
def macro_reduce(spark: S, sf: str) -> DataFrame:
    return Q.macro_reduce(D.bars(spark, sf), ["close", "volume"], "1d")


@query(sql("bars days", "SELECT count(*) AS n, round(avg(abs(b.close - d.open)), 4) AS mae, round(max(abs(b.close - d.open)), 4) AS worst, round(avg(CAST((b.volume > 50) IS NOT DISTINCT FROM (d.volume > 500) AS DOUBLE)), 6) AS accuracy FROM bars b JOIN days d ON b.symbol = d.symbol AND b.ts = d.ts"))
def compare_series(spark: S, sf: str) -> DataFrame:
    a = D.bars(spark, sf).select("symbol", "ts", F.col("close").alias("v"), (F.col("volume") > 50).alias("c"))
    b = D.bars(spark, sf, "1d").select("symbol", "ts", F.col("open").alias("v"), (F.col("volume") > 500).alias("c"))
    return rounded(rounded(Q.compare_series(a, b, ["symbol", "ts"], "v", "c"), 4, "mae", "worst"), 6, "accuracy")


@query(sql("bars", f"d AS (SELECT symbol, ts, close - lag(close) OVER ({BY}) AS slope, close - lag(close) OVER ({BY}) AS c, open - lag(open) OVER ({BY}) AS o, high - lag(high) OVER ({BY}) AS h FROM bars) SELECT 'close' AS base, round(avg(abs(c - slope)), 4) AS mae FROM d UNION ALL SELECT 'open', round(avg(abs(o - slope)), 4) FROM d UNION ALL SELECT 'high', round(avg(abs(h - slope)), 4) FROM d"))
def slope_source(spark: S, sf: str) -> DataFrame:
    b = D.bars(spark, sf).withColumn("slope", F.col("close") - F.lag("close").over(W.by_symbol()))
    return rounded(Q.slope_source(b, "slope", ["close", "open", "high"]), 4, "mae")


@query(sql("bars decisions", "o AS (SELECT symbol, ts, CAST(close > open AS INTEGER) AS win FROM bars), w AS (SELECT symbol, ts, avg(win) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS w20, avg(win) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS w50 FROM o) SELECT d.id, round(coalesce(w20, 0.25), 6) AS win_rate_20, round(coalesce(w50, 0.25), 6) AS win_rate_50 FROM decisions d ASOF LEFT JOIN w ON d.symbol = w.symbol AND d.ts > w.ts"))
def recent_win_rate(spark: S, sf: str) -> DataFrame:
    o = D.bars(spark, sf).select("symbol", "ts", (F.col("close") > F.col("open")).cast("int").alias("win"))
    return rounded(W.with_recent_win_rate(D.decisions(spark, sf), o), 6, "win_rate_20", "win_rate_50").select("id", "win_rate_20", "win_rate_50")


@query(sql("bars", f"n AS (SELECT *, row_number() OVER ({BY}) AS k FROM bars), t AS (SELECT symbol, ts, k, greatest(high - low, coalesce(abs(high - lag(close) OVER ({BY})), 0), coalesce(abs(low - lag(close) OVER ({BY})), 0)) AS tr, close FROM n), e AS (SELECT symbol, ts, list(close) OVER w AS c, list(tr) OVER w AS r, k FROM t WINDOW w AS ({BY} ROWS UNBOUNDED PRECEDING)) SELECT symbol, ts, round(list_reduce(c, lambda a, x: a * (1 - 2.0 / 21) + x * 2.0 / 21), 4) AS ema, CASE WHEN k >= 14 THEN round(list_reduce(r, lambda a, x: a * (1 - 1.0 / 14) + x / 14.0), 4) END AS atr FROM e"))
def exponential_indicators(spark: S, sf: str) -> DataFrame:
    return rounded(N.with_indicators(D.bars(spark, sf)).select("symbol", "ts", "ema", "atr"), 4, "ema", "atr")


def _ewm(values: str, alpha: str) -> str:
    return f"list_reduce({values}, lambda a, x: a * (1 - {alpha}) + x * {alpha})"


MOMENTUM = f"""n AS (SELECT *, row_number() OVER ({BY}) AS k, close - lag(close) OVER ({BY}) AS mv, high - lag(high) OVER ({BY}) AS up, lag(low) OVER ({BY}) - low AS dn FROM bars),
t AS (SELECT symbol, ts, k, list(close) OVER w AS c, list(greatest(mv, 0)) FILTER (k > 1) OVER w AS g, list(greatest(-mv, 0)) FILTER (k > 1) OVER w AS l, list(CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END) OVER w AS p, list(CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END) OVER w AS m FROM n WINDOW w AS ({BY} ROWS UNBOUNDED PRECEDING)),
s AS (SELECT symbol, ts, k, CASE WHEN k >= 26 THEN {_ewm("c", "(2.0 / 13)")} - {_ewm("c", "(2.0 / 27)")} END AS macd, CASE WHEN k >= 15 THEN {_ewm("g", "(1.0 / 14)")} END AS gain, CASE WHEN k >= 15 THEN {_ewm("l", "(1.0 / 14)")} END AS loss, {_ewm("p", "(1.0 / 14)")} AS plus, {_ewm("m", "(1.0 / 14)")} AS minus FROM t),
u AS (SELECT symbol, ts, k, macd, CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END AS rsi, list(coalesce(100 * abs(plus - minus) / nullif(plus + minus, 0), 0)) FILTER (k >= 14) OVER w AS d, list(macd) FILTER (k >= 26) OVER w AS y FROM s WINDOW w AS ({BY} ROWS UNBOUNDED PRECEDING)),
v AS (SELECT symbol, ts, rsi, macd, CASE WHEN k >= 27 THEN {_ewm("d", "(1.0 / 14)")} END AS adx, CASE WHEN k >= 34 THEN {_ewm("y", "0.2")} END AS signal FROM u)
SELECT symbol, ts, round(rsi, 4) AS rsi, round(adx, 4) AS adx, round(macd, 4) + 0.0 AS macd, round(signal, 4) + 0.0 AS macd_signal, round(macd - signal, 4) + 0.0 AS macd_hist, round(macd - signal - lag(macd - signal, 3) OVER ({BY}), 4) + 0.0 AS macd_slope FROM v"""


@query(sql("bars", MOMENTUM))
def momentum_indicators(spark: S, sf: str) -> DataFrame:
    names = ["rsi", "adx", "macd", "macd_signal", "macd_hist", "macd_slope"]
    return N.with_indicators(D.bars(spark, sf)).select("symbol", "ts", *[(F.round(c, 4) + 0.0).alias(c) for c in names])


_DENSITY = "exp(-0.5 * r * r / {v}) / sqrt(2 * pi() * {v}) + 1e-300"


@query(sql("bars", f"a AS (SELECT symbol, ts, close / lag(close) OVER ({BY}) - 1 AS r FROM bars), b AS (SELECT *, {_DENSITY.format(v=0.04)} AS d0, {_DENSITY.format(v=4.0)} AS d1, row_number() OVER ({BY}) AS k FROM a WHERE r IS NOT NULL AND isfinite(r)), f AS (SELECT symbol, ts, k, 0.5 * d1 / (0.5 * d0 + 0.5 * d1) AS q FROM b WHERE k = 1 UNION ALL SELECT b.symbol, b.ts, b.k, (0.1 + 0.8 * q) * d1 / ((0.9 - 0.8 * q) * d0 + (0.1 + 0.8 * q) * d1) FROM f JOIN b ON b.symbol = f.symbol AND b.k = f.k + 1) SELECT symbol, ts, round(q, 6) AS prob FROM f").replace("WITH ", "WITH RECURSIVE ", 1))
def switching_states(spark: S, sf: str) -> DataFrame:
    return rounded(R.filtered_states(D.bars(spark, sf), [0.0, 0.0], [0.04, 4.0], 0.9), 6, "prob")


@query()
def markov_regime_4h(spark: S, sf: str) -> DataFrame:
    return R.markov_regime(D.bars(spark, sf, "4h"), 80, up=True)


@query()
def markov_regime_hourly_volatility(spark: S, sf: str) -> DataFrame:
    return R.markov_regime(D.bars(spark, sf), 50, up=False)


@query(sql("decisions", "acc AS (SELECT symbol, min({'t': ts, 'i': id}) AS k FROM decisions GROUP BY symbol UNION ALL SELECT d.symbol, min({'t': d.ts, 'i': d.id}) FROM acc a JOIN decisions d ON d.symbol = a.symbol AND d.ts >= a.k.t + INTERVAL 6 HOUR GROUP BY d.symbol) SELECT d.symbol, d.ts, d.id, a.k IS NOT NULL AS accepted FROM decisions d LEFT JOIN acc a ON a.symbol = d.symbol AND a.k.t = d.ts AND a.k.i = d.id").replace("WITH ", "WITH RECURSIVE ", 1))
def accepted_signals(spark: S, sf: str) -> DataFrame:
    return R.accepted_signals(D.decisions(spark, sf), 6 * 3600)


@query(sql("decisions bars", "x AS (SELECT DISTINCT symbol, ts FROM bars WHERE close > 60), o AS (SELECT DISTINCT symbol, ts FROM bars WHERE close < 3) SELECT d.id, coalesce(d.ts - x.ts < INTERVAL 4 HOUR, false) AS cooling, coalesce(d.ts - o.ts < INTERVAL 2 HOUR, false) AS duplicate FROM decisions d ASOF LEFT JOIN x ON d.symbol = x.symbol AND d.ts >= x.ts ASOF LEFT JOIN o ON d.symbol = o.symbol AND d.ts > o.ts"))
def throughput_guards(spark: S, sf: str) -> DataFrame:
    b = D.bars(spark, sf)
    return W.guards(D.decisions(spark, sf), b.where("close > 60").select("symbol", "ts"), b.where("close < 3").select("symbol", "ts"), "4h", "2h").select("id", "cooling", "duplicate")


@query(sql("bars", "n AS (SELECT symbol, '1h' AS tf, ts, close + CASE WHEN hour(ts) % 5 = 0 THEN 1000 ELSE 0 END AS close FROM bars) SELECT symbol, tf, ts, close FROM n QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) <= 40"))
def upsert_bars(spark: S, sf: str) -> DataFrame:
    old = D.bars(spark, sf).select("symbol", F.lit("1h").alias("tf"), "ts", "close")
    new = old.where(F.hour("ts") % 5 == 0).withColumn("close", F.col("close") + 1000)
    return B.upsert(old, new, 40)


@query("WITH t AS (SELECT DISTINCT 'C' || c_custkey AS symbol FROM customer WHERE c_custkey % 3 <> 0), e AS (SELECT DISTINCT 'C' || o_custkey AS symbol FROM orders WHERE o_custkey % 2 = 0) SELECT coalesce(t.symbol, e.symbol) AS symbol, CASE WHEN e.symbol IS NULL THEN 'added' WHEN t.symbol IS NULL THEN 'removed' ELSE 'kept' END AS state FROM t FULL JOIN e ON t.symbol = e.symbol")
def universe_sync(spark: S, sf: str) -> DataFrame:
    t = D.table(spark, sf, "customer").where("c_custkey % 3 <> 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"))
    e = D.table(spark, sf, "orders").where("o_custkey % 2 = 0").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("symbol"))
    return Q.universe_sync(t, e)


@query("SELECT DISTINCT upper(regexp_replace(CASE WHEN p_partkey % 3 = 0 THEN p_brand || 'USDT' ELSE p_brand || '/USDT' END, '[^A-Za-z0-9]', '', 'g')) AS symbol FROM part WHERE p_size % 2 = 0 AND p_type <> 'ECONOMY'")
def usdt_universe(spark: S, sf: str) -> DataFrame:
    p = D.table(spark, sf, "part")
    m = p.select(F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.concat("p_brand", F.lit("/USDT"))).alias("id"), F.col("p_brand").alias("base"), F.lit("USDT").alias("quote"), F.lit(None).cast("string").alias("settle"), (F.col("p_size") % 2 == 0).alias("swap"), (F.col("p_type") != "ECONOMY").alias("linear"), F.lit(True).alias("active"))
    return Q.usdt_perps(m)


@query("SELECT 'C' || c_custkey AS symbol FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AND c_mktsegment <> 'HOUSEHOLD'")
def tradable_universe(spark: S, sf: str) -> DataFrame:
    name = lambda c: F.concat(F.lit("C"), F.col(c).cast("string")).alias("symbol")
    c = D.table(spark, sf, "customer").select(name("c_custkey"), F.array(F.lower("c_mktsegment")).alias("categories"))
    bad = D.table(spark, sf, "orders").where("o_orderstatus = 'F'").select(name("o_custkey"))
    return J.universe(c.select("symbol"), bad, c, ["HOUSEHOLD"])


@query(sql("bars", f"a AS (SELECT *, (high + low + close) / 3 * volume AS pv FROM bars), v AS (SELECT *, close - CASE WHEN count(pv) {last(12)} >= 12 THEN sum(pv) {last(12)} / nullif(sum(volume) {last(12)}, 0) END AS dev FROM a), z AS (SELECT *, dev / nullif(CASE WHEN count(dev) {PRIOR12} >= 12 THEN stddev_samp(dev) {PRIOR12} END, 0) AS z FROM v), q AS (SELECT *, CAST(abs(z) <= 2 AS INTEGER) AS q FROM z) SELECT symbol, ts, round(dev, 6) + 0.0 AS vwap_dev, round(z, 5) + 0.0 AS vwap_z, coalesce(CASE WHEN count(q) OVER ({BY} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) >= 3 THEN min(q) OVER ({BY} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) END = 1, false) AS vwap_consolidated FROM q"))
def vwap_deviation(spark: S, sf: str) -> DataFrame:
    df = W.with_vwap_deviation(D.bars(spark, sf), 12, 3, 2.0).select("symbol", "ts", "vwap_dev", "vwap_z", "vwap_consolidated")
    return rounded(rounded(df, 6, "vwap_dev"), 5, "vwap_z")


@query(sql("days", f"d AS (SELECT *, (high - low) / nullif(close, 0) AS sh, {full('avg', 'close', 3)} - {full('avg', 'close', 6)} AS sp FROM days), m AS (SELECT *, CASE WHEN count(sh) OVER w >= 5 THEN quantile_cont(sh, 0.5) OVER w END AS med, sp - lag(sp) OVER ({BY}) AS sl FROM d WINDOW w AS ({BY} ROWS UNBOUNDED PRECEDING)) SELECT symbol, ts, round(lag(sh / nullif(med, 0)) OVER ({BY}), 6) AS vol_level, round(lag(sl) OVER ({BY}), 6) + 0.0 AS trend_slope FROM m"))
def asset_context(spark: S, sf: str) -> DataFrame:
    d = D.bars(spark, sf, "1d").withColumn("atr", F.col("high") - F.col("low"))
    return rounded(W.with_context(d, 3, 6, 5).select("symbol", "ts", "vol_level", "trend_slope"), 6, "vol_level", "trend_slope")


@query(sql("bars", f"a AS (SELECT symbol, ts, {full('avg', 'close', 3)} AS f, {full('avg', 'close', 9)} AS s FROM bars) SELECT symbol, ts, round(100 * (f - s) / nullif(s, 0), 6) + 0.0 AS ema_spread_pct, CAST(f < s AS INTEGER) AS crossed_down FROM a"))
def entry_features(spark: S, sf: str) -> DataFrame:
    from ..operators.learning import entry_features as features

    df = D.bars(spark, sf).withColumns({"ema_fast": W.sma("close", 3), "ema_slow": W.sma("close", 9)})
    return rounded(features(df).select("symbol", "ts", "ema_spread_pct", "crossed_down"), 6, "ema_spread_pct")


@query(sql("log", "SELECT symbol, 'decision' AS event, count(*) AS n, max(line) AS last_line FROM log GROUP BY symbol"))
def live_events(spark: S, sf: str) -> DataFrame:
    return L.events(D.log_lines(spark, sf)).groupBy("symbol", "event").agg(F.count("*").alias("n"), F.max("line").alias("last_line"))


@query(sql("decisions", "SELECT id, array_to_string(list_filter([CASE WHEN id % 3 = 0 THEN 'p' END, CASE WHEN id % 5 = 0 THEN 'q' END], lambda y: y IS NOT NULL), ',') AS missing FROM decisions"))
def missing_required(spark: S, sf: str) -> DataFrame:
    p = F.when(F.col("id") % 3 != 0, F.col("p"))
    q = F.when(F.col("id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("p"))
    return D.decisions(spark, sf).select("id", F.concat_ws(",", C.missing_fields({"p": p, "q": q})).alias("missing"))


@query(sql("decisions", "SELECT id, CASE id % 4 WHEN 0 THEN 2 WHEN 1 THEN CASE WHEN p >= 0.5 THEN 1 ELSE 0 END WHEN 2 THEN CAST(id % 7 AS INTEGER) END AS code FROM decisions"))
def code_fallback(spark: S, sf: str) -> DataFrame:
    k = F.col("id") % 4
    code = C.first_code(F.when(k == 0, " bull"), {"BULL": 2, "BEAR": 0}, F.when(k == 1, F.col("p")), F.when(k == 2, F.col("id") % 7))
    return D.decisions(spark, sf).select("id", code.alias("code"))


@query("SELECT event_id, " + ", ".join(f"CAST(isodow(ts) - 1 = {d} AS INTEGER) AS dow_{d}" for d in range(7)) + " FROM events")
def weekday_one_hot(spark: S, sf: str) -> DataFrame:
    return D.table(spark, sf, "events").select("event_id", *C.weekday_flags(F.col("ts")))


@query(sql("bars", "SELECT symbol, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS ts, round(sum(close * volume), 4) AS turnover FROM bars GROUP BY ALL"))
def daily_turnover(spark: S, sf: str) -> DataFrame:
    return rounded(D.bars(spark, sf).groupBy("symbol", B.bucket(F.col("ts"), "1d").alias("d")).agg(F.sum(F.col("close") * F.col("volume")).alias("turnover")).withColumnRenamed("d", "ts"), 4, "turnover")
