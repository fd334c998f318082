"""Domain tables derived from the given tables, in Spark and in SQL.

ticks, bars and series come from `events`; trades and exchange trades from `lineitem` and `orders`, placed in January 2024 so that they
meet the bars; decisions and log lines from `events`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars as B
from ..sources.tables import utc

PLACES = {"money": 2, "share": 6}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return utc(spark.read.parquet(f"{sf}/{name}.parquet"))


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    symbol = F.concat(F.lit("S"), (F.col("user_id") % 8).cast("string"))
    return e.select(symbol.alias("symbol"), "ts", F.col("event_id").alias("seq"), (1 + F.col("value")).alias("price"), F.get_json_object("props", "$.k").cast("double").alias("volume"), "event_type")


def bars(spark: SparkSession, sf: str, tf: str = "1h") -> DataFrame:
    return B.ticks_to_bars(ticks(spark, sf), tf)


def series(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """(symbol, ts, value): open interest from views, funding from errors."""
    value = F.col("price") * 100 if kind == "view" else (F.col("price") - 51) / 1e5
    return ticks(spark, sf).where(F.col("event_type") == kind).select("symbol", "ts", value.alias("value"))


def binary_round(x: Column, places: int) -> Column:
    """x rounded as the SQL's round does a double: the product with 10^places to the nearest whole, halves away from 0.  F.round goes by decimal digits, so it lifts 0.285 where 28.499999999999996 falls."""
    scale = float(10**places)
    return F.round(x * scale) / scale


def trades(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")])
    key = F.col("l_orderkey") * 37 + F.col("l_linenumber") * 11
    base = F.lit("2024-01-02 00:00:00").cast("timestamp")
    hours = lambda t, h: F.timestamp_seconds(F.unix_timestamp(t) + h * 3600)
    df = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.concat(F.lit("S"), (F.col("l_suppkey") % 8).cast("string")).alias("symbol"),
        F.concat(F.lit("T"), (F.col("l_partkey") % 16).cast("string")).alias("tag"),
        F.when(F.col("l_returnflag") == "R", "short").otherwise("long").alias("side"),
        F.col("l_quantity").alias("size"),
        (F.col("l_extendedprice") / F.col("l_quantity") / 20).alias("entry"),
        hours(base, key % 600).alias("opened_at"),
        hours(base, key % 600 + F.col("l_partkey") % 48 + 1).alias("closed_at"),
        binary_round(F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax")) / 100, 2).alias("pnl"),
        (F.col("l_extendedprice") * 0.0004).alias("risk_usd"),
        (F.col("l_extendedprice") * 0.0001 * F.col("l_linenumber")).alias("mae_usd"),
        (F.col("l_extendedprice") * 0.0002 * (F.col("l_partkey") % 5)).alias("mfe_usd"),
        (F.col("l_extendedprice") * 0.00005).alias("fees"),
        F.element_at(F.array(*[F.lit(x) for x in ("SL", "TP", "TL", "MANUAL")]), (F.col("l_partkey") % 4 + 1).cast("int")).alias("exit_reason"),
        ((key % 1000) / 1000).alias("p"),
    )
    return df.withColumns({"y": (F.col("pnl") > 0).cast("int"), "r": F.col("pnl") / F.col("risk_usd")})


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decision times: the clicks, with a probability by their number."""
    t = ticks(spark, sf).where("event_type = 'click'")
    return t.select("symbol", "ts", F.col("seq").alias("id"), ((F.col("seq") * 37 % 1000) / 1000).alias("p"))


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(value, line): decision lines written from all events, some schema failures, some repeated, some other lines."""
    e = table(spark, sf, "events")
    k = F.col("event_id")
    at = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    bad = k % 7 == 0
    err = F.when(k % 14 == 0, "missing_required:['days_since_prev_break']").otherwise("missing_required:['oi_z_7d', 'atr_1h']")
    value = F.when(k % 11 == 0, F.concat(F.lit("INFO nothing here "), k.cast("string"))).otherwise(
        F.concat_ws(
            " ", F.lit("2024-01-01 INFO META_DECISION bundle=b1"), F.concat(F.lit("symbol=S"), (F.col("user_id") % 8).cast("string")), F.concat(F.lit("decision_ts="), at),
            F.concat(F.lit("schema_ok="), F.when(bad, "False").otherwise("True")), F.concat(F.lit("p_cal="), F.when(k % 13 == 0, "nan").otherwise((k * 37 % 1000 / 1000).cast("string"))),
            F.lit("pstar=0.42 pstar_scope=RISK_ON_1"), F.concat(F.lit("risk_on_1="), (k % 2).cast("string")), F.lit("risk_on=1.0 scope_val=1 scope_src=risk_on_1 scope_ok=True"),
            F.concat(F.lit("meta_ok="), F.when(bad | (k * 37 % 1000 < 420), "False").otherwise("True")), F.concat(F.lit("strat_ok="), F.when(k % 3 == 0, "True").otherwise("False")),
            F.concat(F.lit("reason="), F.when(bad, "schema_fail").when(k * 37 % 1000 < 420, "below_pstar").otherwise("ok")), F.concat(F.lit("err="), F.when(bad, err).otherwise("none")),
        )
    )
    return e.select(value.alias("value"), k.alias("line"))


def rounded(df: DataFrame, places: int, *columns: str) -> DataFrame:
    return df.withColumns({c: binary_round(F.col(c), places) for c in columns})


def money(*columns: str) -> list[Column]:
    return [binary_round(F.col(c), 2).alias(c) for c in columns]


SQL = {
    "ticks": "SELECT 'S' || (user_id % 8) AS symbol, ts, event_id AS seq, 1 + value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume, event_type FROM events",
    "bars": "SELECT symbol, date_trunc('hour', ts) AS ts, arg_min(price, ticks.ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ticks.ts) AS close, sum(volume) AS volume FROM ticks GROUP BY symbol, date_trunc('hour', ts)",
    "days": "SELECT symbol, date_trunc('day', ts) AS ts, arg_min(price, ticks.ts) AS open, max(price) AS high, min(price) AS low, arg_max(price, ticks.ts) AS close, sum(volume) AS volume FROM ticks GROUP BY symbol, date_trunc('day', ts)",
    "oi": "SELECT symbol, ts, price * 100 AS value FROM ticks WHERE event_type = 'view'",
    "funding": "SELECT symbol, ts, (price - 51) / 1e5 AS value FROM ticks WHERE event_type = 'error'",
    "li": "SELECT l_orderkey, l_linenumber, max(l_partkey) AS pk, max(l_suppkey) AS sk, max(l_quantity) AS q, max(l_extendedprice) AS x, max(l_discount) AS d, max(l_tax) AS t, max(l_returnflag) AS f, l_orderkey * 37 + l_linenumber * 11 AS k FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "trades0": """SELECT l_orderkey * 10 + l_linenumber AS id, 'S' || (sk % 8) AS symbol, 'T' || (pk % 16) AS tag, CASE WHEN f = 'R' THEN 'short' ELSE 'long' END AS side, q AS size, x / q / 20 AS entry,
      TIMESTAMP '2024-01-02' + to_hours(CAST(k % 600 AS INTEGER)) AS opened_at, TIMESTAMP '2024-01-02' + to_hours(CAST(k % 600 + pk % 48 + 1 AS INTEGER)) AS closed_at,
      round(x * (d - t) / 100, 2) AS pnl, x * 0.0004 AS risk_usd, x * 0.0001 * l_linenumber AS mae_usd, x * 0.0002 * (pk % 5) AS mfe_usd, x * 0.00005 AS fees,
      ['SL', 'TP', 'TL', 'MANUAL'][pk % 4 + 1] AS exit_reason, (k % 1000) / 1000 AS p FROM li""",
    "trades": "SELECT *, CAST(pnl > 0 AS INTEGER) AS y, pnl / risk_usd AS r FROM trades0",
    "decisions": "SELECT symbol, ts, seq AS id, (seq * 37 % 1000) / 1000 AS p FROM ticks WHERE event_type = 'click'",
    "log": """SELECT event_id AS line, 'S' || (user_id % 8) AS symbol, date_trunc('hour', ts) AS decision_ts, event_id % 7 <> 0 AS schema_ok,
      CASE WHEN event_id % 13 = 0 THEN NULL ELSE (event_id * 37 % 1000) / 1000 END AS p_cal, NOT (event_id % 7 = 0 OR event_id * 37 % 1000 < 420) AS meta_ok, event_id % 3 = 0 AS strat_ok,
      CASE WHEN event_id % 7 = 0 THEN 'schema_fail' WHEN event_id * 37 % 1000 < 420 THEN 'below_pstar' ELSE 'ok' END AS reason,
      CASE WHEN event_id % 14 = 0 THEN ['days_since_prev_break'] WHEN event_id % 7 = 0 THEN ['oi_z_7d', 'atr_1h'] ELSE [] END AS fields FROM events WHERE event_id % 11 <> 0""",
    "logs": "SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY symbol, decision_ts ORDER BY line DESC) = 1",
}
_NEEDS = {"bars": ["ticks"], "days": ["ticks"], "oi": ["ticks"], "funding": ["ticks"], "trades0": ["li"], "trades": ["trades0"], "decisions": ["ticks"], "logs": ["log"]}


def sql(tables: str, select: str) -> str:
    """select over domain tables (names divided by blanks) as one statement; select may begin with more tables, `name AS (...), ... SELECT`."""
    wanted: list[str] = []

    def need(name: str) -> None:
        for n in _NEEDS.get(name, []):
            need(n)
        if name not in wanted:
            wanted.append(name)

    for name in tables.split():
        need(name)
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
    return f"WITH {head}{', ' if not select.lstrip().upper().startswith('SELECT') else ' '}{select}"
