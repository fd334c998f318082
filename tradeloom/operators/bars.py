"""Bars: ticks to bars, deduplication, completeness, resampling, filling, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import timeframe_seconds


def bucket(ts: Column, tf: str, right: bool = False) -> Column:
    """Left: [t, t + tf) labelled t.  Right: (t - tf, t] labelled t."""
    width = timeframe_seconds(tf) * 1_000_000
    micros = F.unix_micros(ts)
    edge = F.ceil(micros / width) if right else F.floor(micros / width)
    return F.timestamp_micros((edge * width).cast("long"))


def ticks_to_bars(ticks: DataFrame, tf: str) -> DataFrame:
    """(symbol, ts, open, high, low, close, volume) from (symbol, ts, seq, price, volume); seq orders ticks of one time."""
    at = F.struct("ts", "seq")
    return ticks.groupBy("symbol", bucket(F.col("ts"), tf).alias("bar")).agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume")).withColumnRenamed("bar", "ts")


def resample(bars: DataFrame, tf: str, right: bool = False) -> DataFrame:
    """Bars of a longer timeframe; empty buckets do not appear."""
    out = bars.groupBy("symbol", bucket(F.col("ts"), tf, right).alias("bar")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"))
    return out.withColumnRenamed("bar", "ts")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows of one key, the last by order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def keep_newest(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The newest n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def upsert(old: DataFrame, new: DataFrame, keep: int, keys: tuple[str, ...] = ("symbol", "tf")) -> DataFrame:
    """old with the rows of new in place of those of the same (keys, ts); then the newest `keep` of each key."""
    both = old.withColumn("_from", F.lit(0)).unionByName(new.withColumn("_from", F.lit(1)))
    return keep_newest(keep_last(both, [*keys, "ts"], ["_from"]).drop("_from"), list(keys), "ts", keep)


def complete(bars: DataFrame, tf: str, asof: Column) -> DataFrame:
    """Bars that have ended by asof."""
    return bars.where(F.unix_micros("ts") + timeframe_seconds(tf) * 1_000_000 <= F.unix_micros(asof))


def bars_per_day(bars: DataFrame, fallback: int = 288) -> DataFrame:
    """(symbol, bars_per_day) from the median spacing; fallback for fewer than ten bars."""
    w = Window.partitionBy("symbol").orderBy("ts")
    gap = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / 1e6
    each = bars.withColumn("gap", gap).groupBy("symbol").agg(F.count("*").alias("n"), F.percentile("gap", F.lit(0.5)).alias("gap"))
    return each.select("symbol", F.when((F.col("n") < 10) | (F.coalesce("gap", F.lit(0)) <= 0), fallback).otherwise(F.round(86_400 / F.col("gap"))).cast("long").alias("bars_per_day"))


def stale_share(n: int = 100) -> Column:
    """Share of bars without volume among the last n."""
    w = Window.partitionBy("symbol").orderBy("ts").rowsBetween(1 - n, 0)
    return F.avg((F.col("volume") == 0).cast("double")).over(w)


def forward_fill(col: str, keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> Column:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(col, ignorenulls=True).over(w)


def backward_fill(col: str, keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> Column:
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    return F.first(col, ignorenulls=True).over(w)


def age_seconds(col: str, keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> Column:
    """Seconds since the last row where col is known; null before the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(F.when(F.col(col).isNotNull(), F.unix_micros(order))).over(w)
    return (F.unix_micros(order) - seen) / 1e6


def is_stale(col: str, max_age: str, keys: tuple[str, ...] = ("symbol",), order: str = "ts") -> Column:
    """Whether col was never known or its last value is older than max_age."""
    return F.coalesce(age_seconds(col, keys, order) > timeframe_seconds(max_age), F.lit(True))
