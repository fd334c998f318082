"""Rolling, channel, volume, derivative and rank features: window columns over (symbol, ts).

All of one symbol's columns share one partitioning and order, so Spark takes one shuffle and one sort for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import finite, ratio
from ..sources.staging import staged
from .bars import forward_fill


def by_symbol():
    return Window.partitionBy("symbol").orderBy("ts")


def last_rows(n: int):
    return by_symbol().rowsBetween(1 - n, 0)


def prior_rows(n: int):
    return by_symbol().rowsBetween(-n, -1)


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rolling(agg, x, n: int, least: int | None = None, prior: bool = False) -> Column:
    """agg(x) over the last n rows (the n before this one, if prior); null until `least` of them are known."""
    w = prior_rows(n) if prior else last_rows(n)
    x = _col(x)
    return F.when(F.count(x).over(w) >= (n if least is None else least), agg(x).over(w))


def sma(x, n: int) -> Column:
    return rolling(F.avg, x, n)


def oscillator(x, fast: int = 3, slow: int = 10) -> Column:
    return sma(x, fast) - sma(x, slow)


def bollinger(x, n: int = 20, k: float = 2.0) -> dict[str, Column]:
    """Mean and bands of k population deviations."""
    mid, dev = sma(x, n), rolling(F.stddev_pop, x, n)
    return {"bb_mid": mid, "bb_up": mid + k * dev, "bb_low": mid - k * dev}


def with_tma(df: DataFrame, x: str, n: int, name: str = "tma") -> DataFrame:
    """Triangular mean: the mean of the mean."""
    return df.withColumn("_sma", sma(x, n)).withColumn(name, sma("_sma", n)).drop("_sma")


def true_range() -> Column:
    close = F.lag("close").over(by_symbol())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - close), F.abs(F.col("low") - close))


def pct_change(x, n: int) -> Column:
    return ratio(_col(x), F.lag(_col(x), n).over(by_symbol())) - 1


def log_return(x, n: int = 1) -> Column:
    return F.log(_col(x) / F.lag(_col(x), n).over(by_symbol()))


def zscore(x, n: int, least: int) -> Column:
    return (_col(x) - rolling(F.avg, x, n, least)) / (rolling(F.stddev_samp, x, n, least) + 1e-12)  # 0 where nothing varies


def channel_high(x, n: int) -> Column:
    """Highest of the n rows before this one."""
    return rolling(F.max, x, n, prior=True)


def days_since(condition: Column) -> Column:
    """Days since condition last held, now included; null before."""
    seen = F.last(F.when(condition, F.unix_micros("ts")), ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))
    return (F.unix_micros("ts") - seen) / 86_400e6


def calendar_days_since_prior(condition: Column) -> Column:
    """Calendar days since condition held on an earlier row."""
    seen = F.last(F.when(condition, F.to_date("ts")), ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, -1))
    return F.datediff(F.to_date("ts"), seen)


def daily_channel_on_grid(bars: DataFrame, daily: DataFrame, n: int) -> DataFrame:
    """bars with `channel`, the highest daily high of the n days before the row's day, carried over days without daily bars."""
    levels = daily.withColumn("channel", channel_high("high", n)).select("symbol", F.to_date("ts").alias("_day"), "channel")
    return bars.withColumn("_day", F.to_date("ts")).join(levels, ["symbol", "_day"], "left").drop("_day").withColumn("channel", forward_fill("channel"))


def with_daily_level(bars: DataFrame, daily: DataFrame, n: int = 20, name: str = "daily_level") -> DataFrame:
    """bars with the highest daily high of the n full days before the row's day, carried over days without daily bars; null until a symbol has n + 2 daily bars."""
    enough = F.row_number().over(by_symbol()) >= n + 2
    levels = daily.withColumn(name, F.when(enough, channel_high("high", n))).select("symbol", F.to_date("ts").alias("_day"), name)
    return bars.withColumn("_day", F.to_date("ts")).join(levels, ["symbol", "_day"], "left").drop("_day").withColumn(name, forward_fill(name))


def with_touch(bars: DataFrame, level: str, band: float = 0.003, lookback: int = 288, name: str = "touched") -> DataFrame:
    """bars with whether one of the last `lookback` bars, this one included, touched the band around the row's level.

    Each run of one level (cut where it grows longer than eight lookbacks) meets the bars of its own rows and of the lookback before it, about two rows a bar where
    levels hold for a lookback; the newest touch so far, a running maximum, then tells whether it is recent enough.
    """
    row = F.row_number().over(by_symbol())
    same = F.col(level).eqNullSafe(F.lag(level).over(by_symbol()))
    df = bars.withColumns({"_row": row.cast("long"), "_new": F.when(same & (row % (8 * lookback) != 1), 0).otherwise(1)})
    df = staged(df.withColumn("_run", F.sum("_new").over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))).drop("_new"), "level-runs")
    runs = df.groupBy("symbol", "_run").agg(F.min("_row").alias("_from"), F.max("_row").alias("_to"), F.first(level).alias("_level")).where("_level is not null")
    bucket = lambda c: F.floor(c / lookback)
    runs = runs.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_from") - lookback + 1), bucket(F.col("_to")))))
    seen = df.select("symbol", "_row", "low", "high", F.col("_run").alias("_own"), bucket(F.col("_row")).alias("_bucket"))
    met = seen.join(runs, ["symbol", "_bucket"]).where(F.col("_row").between(F.col("_from") - lookback + 1, F.col("_to")))
    touch = (F.col("low") <= F.col("_level") * (1 + band)) & (F.col("high") >= F.col("_level") * (1 - band))
    newest = F.max(F.when(touch, F.col("_row"))).over(Window.partitionBy("symbol", "_run").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    found = met.withColumn("_newest", newest).where(F.col("_own") == F.col("_run")).select("symbol", "_row", "_newest")
    out = df.join(found, ["symbol", "_row"], "left").withColumn(name, F.coalesce(F.col("_newest") > F.col("_row") - lookback, F.lit(False)))
    return out.select(*bars.columns, name)


def entry_quality(per_day: int, atr: str = "atr") -> dict[str, Column]:
    """Prior one-day return, three-day volatility, range of 12 bars and gap from the one-day mean in ATRs."""
    return {
        "prior_1d_ret": pct_change("close", per_day),
        "rv_3d": rolling(F.stddev_samp, "log_ret", 3 * per_day),
        "consolidation_atr": ratio(rolling(F.max, "high", 12) - rolling(F.min, "low", 12), F.col(atr)),
        "gap_from_1d_ma": ratio(F.col("close") - sma("close", per_day), F.col(atr)),
    }


def congestion(n: int, atr: str = "atr") -> Column:
    return ratio(rolling(F.max, "high", n) - rolling(F.min, "low", n), F.col(atr))


def with_vwap_stack(bars: DataFrame, n: int = 12, band: float = 0.005, hours: float = 1.0) -> DataFrame:
    """Rolling VWAP of typical prices, share of the n rows before within the band, distance and slope for each hour; zeros where unknown."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = bars.withColumn("_pv", typical * F.col("volume"))
    df = df.withColumn("vwap", ratio(rolling(F.sum, "_pv", n), rolling(F.sum, "volume", n)))
    df = df.withColumn("_in", (F.abs(F.col("close") / F.col("vwap") - 1) <= band).cast("double"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    back = F.lag("vwap", n - 1).over(by_symbol())
    return df.withColumns({"vwap_share": zero(rolling(F.avg, "_in", n, prior=True)), "vwap_dist": zero(F.abs(ratio(F.col("close"), F.col("vwap")) - 1)), "vwap_slope": zero(ratio(F.col("vwap") - back, back) / ((n - 1) * hours))}).drop("_pv", "_in")


def with_vwap_deviation(bars: DataFrame, n: int, k: int, z_most: float) -> DataFrame:
    """Deviation from the VWAP, its z-score against the n rows before, and whether |z| stayed within z_most for the k rows before."""
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = bars.withColumn("_pv", typical * F.col("volume"))
    df = df.withColumn("vwap_dev", F.col("close") - ratio(rolling(F.sum, "_pv", n), rolling(F.sum, "volume", n)))
    df = df.withColumn("vwap_z", ratio(F.col("vwap_dev"), rolling(F.stddev_samp, "vwap_dev", n, prior=True)))
    quiet = (F.abs("vwap_z") <= z_most).cast("int")
    return df.withColumn("_q", quiet).withColumn("vwap_consolidated", F.coalesce(rolling(F.min, "_q", k, prior=True) == 1, F.lit(False))).drop("_pv", "_q")


def with_volume_multiple(bars: DataFrame, n: int = 8_640, name: str = "volume_multiple", least: int | None = None) -> DataFrame:
    """bars with the volume against the median of the last n rows (30 days of five minutes)."""
    from .scans import with_median

    df = with_median(bars, "volume", "_median", n, max(5, n // 10) if least is None else least)
    return df.withColumn(name, ratio(F.col("volume"), F.col("_median"))).drop("_median")


def volume_surge(n: int, k: float) -> Column:
    return F.coalesce(F.col("volume") >= k * rolling(F.avg, "volume", n, prior=True), F.lit(False))


def with_derivatives(grid: DataFrame, hour: int, day: int, *, eps: float, low: float, high: float) -> DataFrame:
    """Open-interest and funding block on a grid of (symbol, ts, close, open_interest, funding_rate); hour and day count its rows.

    Sparse series are carried forward; changes over a zero base are null.
    """
    from ..functions.columns import crossed_code, sign_code, three_way

    df = grid.withColumns({"oi_level": forward_fill("open_interest"), "funding_rate": forward_fill("funding_rate")})
    df = df.withColumns({"oi_notional": F.col("oi_level") * F.col("close"), "oi_pct_1h": pct_change("oi_level", hour), "oi_pct_4h": pct_change("oi_level", 4 * hour), "oi_pct_1d": pct_change("oi_level", day), "_price_1h": pct_change("close", hour)})
    df = df.withColumns({
        "oi_z_7d": zscore("oi_pct_1d", 7 * day, day),
        "oi_chg_norm": F.col("oi_pct_1h") / (F.abs("_price_1h") + 1e-12),
        "oi_price_div": F.col("oi_pct_1h") - F.col("_price_1h"),
        "funding_abs": F.abs("funding_rate"),
        "funding_z_7d": zscore("funding_rate", 7 * day, day),
        "funding_sum_3d": rolling(F.sum, "funding_rate", 3 * day, day),
    })
    funding_code, oi_code = sign_code(F.col("funding_rate"), eps), three_way(F.col("oi_z_7d"), low, high)
    return df.withColumns({
        "funding_oi_div": F.col("funding_z_7d") * F.col("oi_z_7d"),
        "est_leverage": (F.abs("oi_z_7d") + 0.5) * (F.abs("funding_z_7d") + 0.5),
        "funding_code": funding_code,
        "oi_code": oi_code,
        "s3": crossed_code(funding_code, oi_code),
    }).drop("_price_1h")


def with_context(daily: DataFrame, fast: int = 20, slow: int = 50, least: int = 50) -> DataFrame:
    """ATR share against its expanding median and the slope of the means' spread, both as of the day before; needs `atr`."""
    from .scans import with_median

    df = with_median(daily.withColumn("_share", ratio(F.col("atr"), F.col("close"))), "_share", "_median", least=least)
    df = df.withColumns({"_level": ratio(F.col("_share"), F.col("_median")), "_spread": sma("close", fast) - sma("close", slow)})
    df = df.withColumn("_slope", F.col("_spread") - F.lag("_spread").over(by_symbol()))
    return df.withColumns({"vol_level": F.lag("_level").over(by_symbol()), "trend_slope": F.lag("_slope").over(by_symbol())}).drop("_share", "_median", "_level", "_spread", "_slope")


def realized_vol(n: int = 20) -> Column:
    return rolling(F.stddev_samp, "log_ret", n) * n**0.5


def with_breakout_history(daily: DataFrame, n: int, window: int = 60, ahead: int = 3) -> DataFrame:
    """Breaks of the channel in the `window` rows before, and the share that closed below its level within `ahead` rows.

    A break counts only once its `ahead` rows have passed.
    """
    df = daily.withColumn("_level", channel_high("high", n)).withColumn("_break", (F.col("close") > F.col("_level")).cast("int"))
    lowest = F.min("close").over(by_symbol().rowsBetween(1, ahead))
    df = df.withColumn("_failed", F.when(F.col("_break") == 1, (lowest < F.col("_level")).cast("int")).otherwise(0))
    w = by_symbol().rowsBetween(-window - ahead, -ahead)
    df = df.withColumns({"breaks": F.coalesce(F.sum("_break").over(w), F.lit(0)), "failed": F.coalesce(F.sum("_failed").over(w), F.lit(0))})
    return df.withColumn("fail_rate", ratio(F.col("failed"), F.col("breaks"))).drop("_level", "_break", "_failed")


def with_trend_regime(daily: DataFrame, k: float) -> DataFrame:
    """BULL above tma + k ATR, BEAR below tma - k ATR, the state before kept between; rows before the first take the first."""
    from .bars import backward_fill

    now = F.when(F.col("close") > F.col("tma") + k * F.col("atr"), "BULL").when(F.col("close") < F.col("tma") - k * F.col("atr"), "BEAR")
    df = daily.withColumn("_now", now)
    df = df.withColumn("_fwd", forward_fill("_now"))
    return df.withColumn("trend", F.coalesce("_fwd", backward_fill("_fwd"))).drop("_now", "_fwd")


# across symbols


def with_relative_strength(daily: DataFrame, n: int = 7) -> DataFrame:
    """n-row return (0 if short) and its percentile among the day's symbols: 100 rank / (N - 1), ties by symbol."""
    df = daily.withColumn("rs_ret", F.coalesce(pct_change("close", n), F.lit(0.0)))
    day = Window.partitionBy("ts")
    rank = F.row_number().over(day.orderBy("rs_ret", "symbol")) - 1
    count = F.count("*").over(day)
    return df.withColumn("rs_pct", F.when(count > 1, 100.0 * rank / (count - 1)).otherwise(100.0))


def with_cross_zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Population z-scores among the symbols of one time; a deviation of 0 counts as 1."""
    day = Window.partitionBy("ts")
    dev = lambda c: F.when(F.stddev_pop(c).over(day) > 0, F.stddev_pop(c).over(day)).otherwise(1.0)
    return df.withColumns({f"{c}_z": (F.col(c) - F.avg(c).over(day)) / dev(c) for c in columns})


def liquidity(bars: DataFrame, n: int = 24, newest: int = 7) -> DataFrame:
    """(symbol, liquidity): median of the newest rolling sums of turnover."""
    from .bars import keep_newest

    df = bars.withColumn("turnover", rolling(F.sum, F.col("close") * F.col("volume"), n))
    return keep_newest(df.where("turnover is not null"), ["symbol"], "ts", newest).groupBy("symbol").agg(F.percentile("turnover", F.lit(0.5)).alias("liquidity"))


def with_recent_win_rate(decisions: DataFrame, outcomes: DataFrame, sizes: tuple[int, ...] = (20, 50), cold: float = 0.25) -> DataFrame:
    """decisions with win rates of the last outcomes strictly before each, the newest one left out; `cold` where there is none."""
    from .asof import asof_join

    w = Window.partitionBy("symbol").orderBy("ts")
    rated = outcomes.select("symbol", "ts", *[F.avg("win").over(w.rowsBetween(-n, -1)).alias(f"win_rate_{n}") for n in sizes])
    out = asof_join(decisions, rated, ["symbol"], [f"win_rate_{n}" for n in sizes], strict=True)
    return out.withColumns({f"win_rate_{n}": F.coalesce(f"win_rate_{n}", F.lit(cold)) for n in sizes})


# order


def with_running(df: DataFrame, order: list[str], values: dict[str, Column]) -> DataFrame:
    """df with sums of values over all rows before each one in global order, without one task for all rows.

    The rows are staged in ranges of the order; each range's sums give the next ones' offsets (as many rows as ranges),
    and a window inside each range does the rest.  Order must be unique.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).withColumns({"_part": F.spark_partition_id(), **{f"_{n}": v for n, v in values.items()}})
    ranged = staged(ranged, "ranges")
    sums = ranged.groupBy("_part").agg(*[F.sum(f"_{n}").alias(f"_{n}_all") for n in values])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_part", *[F.coalesce(F.sum(f"_{n}_all").over(ahead), F.lit(0)).alias(f"_{n}_off") for n in values])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(offsets), "_part")
    return placed.withColumns({n: F.col(f"_{n}_off") + F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)) for n in values}).select(*df.columns, *values)


def with_order_index(df: DataFrame, order: list[str], name: str = "order_idx") -> DataFrame:
    """0 .. N-1 in global order; order must be unique."""
    return with_running(df, order, {name: F.lit(1).cast("long")})


def with_quantiles(base: DataFrame, df: DataFrame, values: dict[str, Column], at: list[float], by: list[str] | None = None) -> DataFrame:
    """base, which has one row for each group of df by `by`, with one array for each of values: its exact quantiles, interpolated as F.percentile does.

    F.percentile keeps a group's distinct values in one buffer.  Here equal values are counted first, their places come from `with_running` over all groups at
    once, and a quantile is the largest value that starts no later than its place: partial maxima, however large a group is.
    Nulls do not count, NaN is the largest value, a null key is a group; a group without values gets null.
    """
    by = by or []
    parts = F.array(*[F.struct(F.struct(*by, F.lit(n).alias("_name")).alias("_g"), x.cast("double").alias("_v")) for n, x in values.items()])
    counts = df.select(F.inline(parts)).where("_v is not null").groupBy("_g", "_v").agg(F.count("*").alias("_n"))
    placed = with_running(counts, ["_g", "_v"], {"_at": F.col("_n")})
    # one row a group; staged, so that Spark knows whether it can be broadcast and no group's values meet in one task
    placed = staged(placed, "quantile-places")
    spans = staged(placed.groupBy("_g").agg(F.min("_at").alias("_from"), F.sum("_n").alias("_all")), "quantile-groups")

    def quantile(q: float) -> Column:
        place = F.lit(q) * (F.col("_all") - 1)
        value = lambda i: F.max(F.when(F.col("_at") - F.col("_from") <= i, F.col("_v")))
        low, high = value(F.floor(place)), value(F.ceil(place))
        share = F.max(place - F.floor(place))
        return F.when(low == high, low).otherwise((1 - share) * low + share * high)

    found = placed.join(spans, "_g").groupBy("_g").agg(F.array(*[quantile(q) for q in at]).alias("_q"))
    wide = found.groupBy(*([F.struct(*[F.col("_g")[c].alias(c) for c in by]).alias("_key")] if by else [])).agg(*[F.first(F.when(F.col("_g._name") == n, F.col("_q")), ignorenulls=True).alias(n) for n in values])
    if not by:
        return base.crossJoin(F.broadcast(wide))  # one row
    return base.withColumn("_key", F.struct(*by)).join(wide, "_key", "left").drop("_key")


def streaks(df: DataFrame, keys: list[str], order: list[str], pnl: str = "pnl") -> DataFrame:
    """Runs of wins and losses: (keys, sign, length, first, last); a zero ends a run and starts none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    sign = F.signum(F.coalesce(F.col(pnl), F.lit(0.0))).cast("int")
    df = df.withColumn("_sign", sign).withColumn("_new", (F.coalesce(F.lag("_sign").over(w), F.lit(9)) != F.col("_sign")).cast("int"))
    df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = order[0]
    return df.where("_sign != 0").groupBy(*keys, "_run").agg(F.first("_sign").alias("sign"), F.count("*").alias("length"), F.min(first).alias("first"), F.max(first).alias("last")).drop("_run")


def loss_streak_times(df: DataFrame, keys: list[str], order: list[str], k: int, pnl: str = "pnl") -> DataFrame:
    """(keys, at): the first time of k losses in a row; a result of 0 or more, or an unknown one, starts anew.

    Rows are staged in ranges of (keys, order), which must be unique; the losses in a row that a range ends with are carried into the next ranges of the key, so that
    no task sorts all rows of one.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.struct(*keys).alias("_key"), *order, F.coalesce(F.col(pnl) < 0, F.lit(False)).alias("_lost"))
    ranged = staged(rows.repartitionByRange(parts, "_key", *order).withColumn("_part", F.spark_partition_id()), "streak-ranges")
    inside = Window.partitionBy("_key", "_part").orderBy(*order)
    ranged = ranged.withColumn("_row", F.row_number().over(inside))
    ends = ranged.groupBy("_key", "_part").agg(F.count("*").alias("_all"), F.max(F.when(~F.col("_lost"), F.col("_row"))).alias("_last"))  # a row for each key and range
    over = Window.partitionBy("_key").orderBy("_part")
    ends = ends.withColumn("_run", F.count("_last").over(over)).withColumn("_tail", F.sum(F.col("_all") - F.coalesce("_last", F.lit(0))).over(Window.partitionBy("_key", "_run").orderBy("_part")))
    carried = staged(ends.select("_key", "_part", F.coalesce(F.lag("_tail").over(over), F.lit(0)).alias("_carried")), "streak-ends")
    last = F.max(F.when(~F.col("_lost"), F.col("_row"))).over(inside)
    found = ranged.withColumn("_last", last).join(carried, ["_key", "_part"]).where(F.col("_row") - F.coalesce("_last", -F.col("_carried")) >= k)
    return found.groupBy("_key").agg(F.min(order[0]).alias("at")).select("_key.*", "at")


def guards(signals: DataFrame, exits: DataFrame, opens: DataFrame, cooldown: str, dedup: str) -> DataFrame:
    """signals with `cooling` (an exit of the symbol within cooldown before) and `duplicate` (an open within dedup before), against all rows given."""
    from ..functions.columns import timeframe_seconds
    from .asof import asof_join

    marked = lambda t, name: t.groupBy("symbol", "ts").agg(F.max("ts").alias(name))
    out = asof_join(signals, marked(exits, "last_exit"), ["symbol"], ["last_exit"])
    out = asof_join(out, marked(opens, "last_open"), ["symbol"], ["last_open"], strict=True)
    within = lambda c, tf: F.coalesce(F.unix_micros("ts") - F.unix_micros(c) < timeframe_seconds(tf) * 1_000_000, F.lit(False))
    return out.withColumns({"cooling": within("last_exit", cooldown), "duplicate": within("last_open", dedup)})


def clean(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and infinities become null."""
    return df.withColumns({c: finite(F.col(c)) for c in columns})
