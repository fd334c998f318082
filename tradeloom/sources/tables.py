"""Sources and sinks: bars, signals, positions, statements, outcomes, logs, universes, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = T.StructType([T.StructField("symbol", T.StringType()), T.StructField("tf", T.StringType()), T.StructField("ts", T.TimestampType()), *[T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]])
OUTCOMES = "ts string, win int, pnl double"
EXPORT = ["id", "symbol", "side", "size", "entry", "opened_at", "closed_at", "pnl", "fees", "exit_reason"]
# The time formats that statements use.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "HH:mm yyyy-MM-dd", "dd/MM/yyyy HH:mm", "MM/dd/yyyy HH:mm:ss")


def utc(df: DataFrame) -> DataFrame:
    """Times without zone become UTC timestamps (the session's zone must be UTC)."""
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)})


def read_bars(spark: SparkSession, path: str, columns: list[str] | None = None, symbols: list[str] | None = None) -> DataFrame:
    """Bars with the wanted columns and symbols only; both reach the scan."""
    df = utc(spark.read.parquet(path))
    df = df.where(F.col("symbol").isin(symbols)) if symbols is not None else df
    return df.select(*columns) if columns else df


def write_signals(signals: DataFrame, path: str) -> None:
    """Parquet in folders by symbol, one file for each task's symbols at most."""
    signals.repartition("symbol").write.mode("overwrite").partitionBy("symbol").parquet(path)


def read_signals(spark: SparkSession, path: str, symbols: list[str] | None = None) -> DataFrame:
    """Signals; symbol comes from the folders and prunes them."""
    df = spark.read.parquet(path).withColumn("symbol", F.col("symbol").cast("string"))
    return df.where(F.col("symbol").isin(symbols)) if symbols is not None else df


def closed_positions(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Closed positions opened in [start, end), by time of opening, then id."""
    df = df.where("status = 'CLOSED'")
    df = df.where(F.col("opened_at") >= F.lit(start).cast("timestamp")) if start else df
    df = df.where(F.col("opened_at") < F.lit(end).cast("timestamp")) if end else df
    return df.orderBy("opened_at", "id")


def read_positions(spark: SparkSession, url: str, table: str, bounds: tuple[str, str], partitions: int, **options: str) -> DataFrame:
    """Positions over JDBC, read in parallel by ranges of opened_at; needs the database's driver on the class path."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.option("partitionColumn", "opened_at").option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def parse_trade_time(s: Column, offset_minutes: int = 0) -> Column:
    """A statement's time in any of TIME_FORMATS, less its zone's offset."""
    at = F.coalesce(*[F.try_to_timestamp(F.trim(s), F.lit(f)) for f in TIME_FORMATS])
    return F.timestamp_micros(F.unix_micros(at) - offset_minutes * 60_000_000)


def read_statement(spark: SparkSession, path: str, offset_minutes: int = 0) -> DataFrame:
    """(symbol, qty, entry, exit, pnl, closed_at) of a closed-profit CSV."""
    raw = spark.read.option("header", True).csv(path)
    number = lambda c: F.regexp_replace(F.col(c), "[, ]", "").try_cast("double")
    return raw.select(F.upper(F.trim("Market")).alias("symbol"), F.abs(number("Order Quantity")).alias("qty"), number("Entry Price").alias("entry"), number("Exit Price").alias("exit"), number("Realized P&L").alias("pnl"), parse_trade_time(F.col("Trade time"), offset_minutes).alias("closed_at"))


def read_outcomes(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(ts, win, pnl) of JSON lines; bad lines are skipped; the newest `most` stay."""
    raw = spark.read.schema(OUTCOMES + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    df = raw.where("_bad is null").withColumn("ts", F.col("ts").try_cast("timestamp")).where("ts is not null").select("ts", "win", "pnl")
    return df.orderBy(F.desc("ts")).limit(most) if most else df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, line): text lines with the file and the position in it, so that later lines can win."""
    df = spark.read.text(path)
    return df.select("value", F.col("_metadata.file_name").alias("file"), (F.col("_metadata.file_block_start") * (1 << 20) + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 33))).alias("line"))


def read_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(symbol) of a list with # comments, upper-cased, each once."""
    name = F.upper(F.trim(F.regexp_replace("value", "#.*$", "")))
    return spark.read.text(path).select(name.alias("symbol")).where("symbol <> ''").distinct()


def day_report(positions: DataFrame, day: str) -> DataFrame:
    """Positions closed on a day (UTC)."""
    start = F.lit(day).cast("timestamp")
    return positions.where((F.col("closed_at") >= start) & (F.col("closed_at") < start + F.expr("interval 1 day")))


def window_export(positions: DataFrame, start: str, end: str, columns: list[str] = EXPORT) -> DataFrame:
    return positions.where((F.col("closed_at") >= F.lit(start).cast("timestamp")) & (F.col("closed_at") < F.lit(end).cast("timestamp"))).select(*columns)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def recent(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
