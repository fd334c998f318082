"""As-of joins by union and one window: a shuffle and a sort by key, no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import timeframe_seconds


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], columns: list[str], *, on: str = "ts", tolerance: str | None = None, strict: bool = False, right_time: str | None = None) -> DataFrame:
    """left with the columns of the last right row of its keys at or before its time (before it, if strict).

    tolerance: older right rows count as none.  right_time: also return the right row's time by this name.  A right row
    counts as a whole, nulls included.  Right rows of one key and time must be unique.
    """
    value = F.struct(F.col(on).alias("_at"), *columns)
    r = right.select(*keys, on, value.alias("_r"), F.lit(1 if strict else 0).alias("_side"))
    l = left.select(*keys, on, F.struct(*left.columns).alias("_l"), F.lit(0 if strict else 1).alias("_side"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_l is not null")
    if tolerance:
        young = F.unix_micros(on) - F.unix_micros("_r._at") <= timeframe_seconds(tolerance) * 1_000_000
        out = out.withColumn("_r", F.when(young, F.col("_r")))
    extra = [F.col("_r._at").alias(right_time)] if right_time else []
    return out.select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in columns], *extra)


def asof_many(left: DataFrame, rights: dict[str, DataFrame], keys: list[str], on: str = "ts") -> DataFrame:
    """left with one value column for each right table (keys, on, value), all in one shuffle."""
    sides = [t.select(*keys, on, F.col("value").alias(f"_{name}"), F.lit(0).alias("_side")) for name, t in rights.items()]
    both = left.select(*keys, on, F.struct(*left.columns).alias("_l"), F.lit(1).alias("_side"))
    for s in sides:
        both = both.unionByName(s, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.select("_l", *[F.last(f"_{name}", ignorenulls=True).over(w).alias(name) for name in rights])
    return out.where("_l is not null").select("_l.*", *rights)


def truth_lookup(left: DataFrame, truth: DataFrame, keys: list[str], columns: list[str], on: str = "ts") -> DataFrame:
    """As-of values that fail closed: null past the end of each key's truth, or where any value is null."""
    ends = truth.groupBy(*keys).agg(F.max(on).alias("_end"))
    out = asof_join(left, truth, keys, columns, on=on).join(ends, keys, "left")
    ok = F.col(on) <= F.col("_end")
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return out.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumns({c: F.when(F.col("_ok"), F.col(c)) for c in columns}).drop("_end").withColumnRenamed("_ok", "truth_ok")


def both_regimes(left: DataFrame, daily: DataFrame, four_hourly: DataFrame, daily_columns: list[str], four_hourly_columns: list[str], keys: list[str], on: str = "ts") -> tuple[DataFrame, DataFrame]:
    """(rows with all regimes as of their time, rejected rows with what they lack): a row that lacks either regime goes no further."""
    out = truth_lookup(left, daily, keys, daily_columns, on).withColumnRenamed("truth_ok", "daily_ok")
    out = truth_lookup(out, four_hourly, keys, four_hourly_columns, on).withColumnRenamed("truth_ok", "four_hourly_ok")
    ok = F.col("daily_ok") & F.col("four_hourly_ok")
    lacks = F.concat_ws(",", F.when(~F.col("daily_ok"), "daily"), F.when(~F.col("four_hourly_ok"), "4h"))
    return out.where(ok).drop("daily_ok", "four_hourly_ok"), out.where(~ok).withColumn("lacks", lacks).select(*left.columns, "lacks")


def rounded_mean(df: DataFrame, keys: list[str], columns: list[str], tf: str, on: str = "ts") -> DataFrame:
    """Times rounded down to tf, values of one key and time averaged; makes a right side unique."""
    from .bars import bucket

    return df.withColumn(on, bucket(F.col(on), tf)).groupBy(*keys, on).agg(*[F.avg(c).alias(c) for c in columns])
