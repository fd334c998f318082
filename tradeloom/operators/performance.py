"""Performance of closed trades: summaries, segments, equity, drawdown, ratios, exit consistency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..sources.staging import staged
from .windows import with_quantiles


def summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, win share, profit factor (null without a loss), expectancy, payoff, excursions, holding, fees, net; one row for each group.

    df: pnl, fees, mae_usd, mfe_usd, opened_at, closed_at.
    """
    win, loss = F.col("pnl") > 0, F.col("pnl") < 0
    profit, lost = F.coalesce(F.sum(F.when(win, F.col("pnl"))), F.lit(0.0)), -F.coalesce(F.sum(F.when(loss, F.col("pnl"))), F.lit(0.0))
    hold = (F.unix_micros("closed_at") - F.unix_micros("opened_at")) / 60e6
    return df.groupBy(*(by or [])).agg(
        F.count("*").alias("n"),
        F.avg(win.cast("double")).alias("win_rate"),
        profit.alias("gross_profit"),
        lost.alias("gross_loss"),
        ratio(profit, lost).alias("profit_factor"),
        F.avg("pnl").alias("expectancy"),
        ratio(F.avg(F.when(win, F.col("pnl"))), -F.avg(F.when(loss, F.col("pnl")))).alias("payoff"),
        F.avg("mae_usd").alias("avg_mae"),
        F.avg("mfe_usd").alias("avg_mfe"),
        F.avg(hold).alias("avg_hold_min"),
        F.sum("fees").alias("fees"),
        F.sum("pnl").alias("net"),
    )


def segments(df: DataFrame, columns: list[str], least: int = 10) -> DataFrame:
    """(segment, value, n, avg_pnl, sum_pnl) of each column's values with at least `least` trades, all columns in one pass."""
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("segment"), F.col(c).cast("string").alias("value")) for c in columns]))
    each = df.select("pnl", parts.alias("x")).groupBy("x.segment", "x.value").agg(F.count("*").alias("n"), F.avg("pnl").alias("avg_pnl"), F.sum("pnl").alias("sum_pnl"))
    return each.where(F.col("n") >= least)


def periods(df: DataFrame, now: Column, hours: dict[str, int]) -> DataFrame:
    """(period, n, wins, losses, profit_factor) of trades closed in the hours before now, for each period."""
    spans = F.explode(F.array(*[F.struct(F.lit(k).alias("period"), F.lit(h).alias("h")) for k, h in hours.items()]))
    rows = df.withColumn("x", spans).where((F.unix_micros("closed_at") > F.unix_micros(now) - F.col("x.h") * 3_600_000_000) & (F.col("closed_at") <= now))
    up, down = F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), -F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))
    return rows.groupBy("x.period").agg(F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"), F.count_if(F.col("pnl") < 0).alias("losses"), ratio(up, down).alias("profit_factor"))


def decisive(df: DataFrame, by: list[str]) -> DataFrame:
    """Wins, losses, flats and the win share of those that were decided."""
    wins, losses = F.count_if(F.col("pnl") > 0), F.count_if(F.col("pnl") < 0)
    return df.groupBy(*by).agg(wins.alias("wins"), losses.alias("losses"), F.count_if(F.col("pnl") == 0).alias("flats"), ratio(wins.cast("double"), (wins + losses).cast("double")).alias("decisive_win_rate"))


def distribution(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean, median and 95th percentile of each column."""
    means = df.groupBy(*(by or [])).agg(*[F.avg(c).alias(f"{c}_mean") for c in columns])
    out = with_quantiles(means, df, {f"_q_{c}": F.col(c) for c in columns}, [0.5, 0.95], by)
    return out.select(*(by or []), *[x for c in columns for x in (f"{c}_mean", F.col(f"_q_{c}")[0].alias(f"{c}_p50"), F.col(f"_q_{c}")[1].alias(f"{c}_p95"))])


def sqn(df: DataFrame, x: str, by: list[str], least: int = 10) -> DataFrame:
    """mean / deviation * sqrt(n)."""
    out = df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(x).alias("_m"), F.stddev_samp(x).alias("_s"))
    return out.where((F.col("n") >= least) & (F.col("_s") > 0)).select(*by, "n", (F.col("_m") / F.col("_s") * F.sqrt("n")).alias("sqn"))


def e_ratio(df: DataFrame, by: list[str]) -> DataFrame:
    """Median MFE against median |MAE|; groups where either is not positive are left out."""
    out = with_quantiles(df.select(*by).distinct(), df, {"_f": F.col("mfe_usd"), "_a": F.abs("mae_usd")}, [0.5], by)
    out = out.select(*by, F.col("_f")[0].alias("mfe_p50"), F.col("_a")[0].alias("mae_p50"))
    return out.where("mfe_p50 > 0 and mae_p50 > 0").withColumn("e_ratio", F.col("mfe_p50") / F.col("mae_p50"))


def stop_diagnostics(df: DataFrame, by: list[str]) -> DataFrame:
    win, loss = F.col("pnl") > 0, F.col("pnl") < 0
    share = lambda of, test: F.avg(F.when(of, test.cast("double")))
    df = df.where("risk_usd > 0")
    shares = df.groupBy(*by).agg(
        share(win, F.col("mae_usd") > 0.95 * F.col("risk_usd")).alias("winners_near_stop"),
        share(loss, F.col("mae_usd") < 0.5 * F.col("risk_usd")).alias("losers_far_from_stop"),
    )
    capture = F.when(win & (F.col("mfe_usd") > 0), F.col("pnl") / F.col("mfe_usd"))
    out = with_quantiles(shares, df, {"_c": capture, "_a": F.col("mae_usd"), "_f": F.col("mfe_usd")}, [0.5, 0.7, 0.8], by)
    picked = {"capture_p50": F.col("_c")[0], "mae_p80": F.col("_a")[2], "mfe_p50": F.col("_f")[0], "mfe_p70": F.col("_f")[1]}
    return out.withColumns(picked).drop("_c", "_a", "_f")


def exit_consistency(df: DataFrame) -> DataFrame:
    """df with adequacy (loss / risk), waste (mfe - pnl) / mfe, harvest (pnl / mfe) and a flag for reasons that R contradicts."""
    r = ratio(F.col("pnl"), F.col("risk_usd"))
    reason = F.upper("exit_reason")
    flag = F.when((reason == "SL") & (r > -0.5), "sl_far_from_stop").when((reason == "TP") & (r <= 0), "tp_without_gain").when((reason == "TL") & (r <= -0.95), "tl_at_stop")
    return df.withColumns({"r": r, "adequacy": F.when(F.col("pnl") < 0, ratio(-F.col("pnl"), F.col("risk_usd"))), "harvest": F.when(F.col("mfe_usd") > 0, F.col("pnl") / F.col("mfe_usd")), "waste": F.when(F.col("mfe_usd") > 0, 1 - F.col("pnl") / F.col("mfe_usd")), "mismatch": flag})


def confusion(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of row values by column values."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0, values)


def rollup_summary(df: DataFrame, keys: list[str]) -> DataFrame:
    """n, net, win_rate and profit_factor of each prefix of keys, from all of them to none; a key that is rolled up is null."""
    won = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")))
    lost = -F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))
    return df.rollup(*keys).agg(F.count("*").alias("n"), F.sum("pnl").alias("net"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), ratio(won, lost).alias("profit_factor"))


def equity_curve(df: DataFrame, by: list[str], start: float, order: list[str]) -> DataFrame:
    """df with equity: start and all net results so far in order."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("equity", F.lit(start) + F.sum("pnl").over(w))


def drawdowns(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with peak and dd = equity / peak - 1."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("peak", F.max("equity").over(w)).withColumn("dd", ratio(F.col("equity"), F.col("peak")) - 1)


def account_curve(df: DataFrame, by: list[str], start: float, order: list[str]) -> DataFrame:
    """df with equity, peak and dd as `equity_curve` and `drawdowns` give them, for keys that hold too many rows for one task, such as one account (`by` empty).

    Rows are staged in ranges of (by, order), which must be unique; each range's sum, then its greatest equity, gives what the next ranges of the key start from,
    and windows inside the ranges do the rest.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*[F.col(c) for c in by], F.lit(0).alias("_"))
    ranged = staged(df.repartitionByRange(parts, *by, *order).withColumns({"_part": F.spark_partition_id(), "_key": key}), "curve-ranges")
    ahead = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_key", "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy("_key", "_part").agg(F.sum("pnl").alias("_sum"))  # a row for each key and range
    sums = sums.select("_key", "_part", F.coalesce(F.sum("_sum").over(ahead), F.lit(0.0)).alias("_before"))
    # before the first result there is no equity, as in a window's sum over nulls
    seen = F.when(F.col("_before") != 0, F.coalesce(F.sum("pnl").over(inside), F.lit(0.0))).otherwise(F.sum("pnl").over(inside))
    held = staged(ranged.join(sums, ["_key", "_part"]).withColumn("equity", F.lit(start) + F.col("_before") + seen).drop("_before"), "curve-equity")
    peaks = held.groupBy("_key", "_part").agg(F.max("equity").alias("_top"))
    peaks = peaks.select("_key", "_part", F.max("_top").over(ahead).alias("_top"))
    out = held.join(peaks, ["_key", "_part"]).withColumn("peak", F.greatest("_top", F.max("equity").over(inside)))
    return out.withColumn("dd", ratio(F.col("equity"), F.col("peak")) - 1).drop("_key", "_part", "_top")


def curve_metrics(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """max_dd, ulcer, cagr (365-day years, one day at least) and mar of curves with equity and dd."""
    days = F.greatest(F.lit(1.0), (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 86_400e6)
    order = F.struct(at, "id")
    out = df.groupBy(*by).agg(F.min("dd").alias("max_dd"), F.sqrt(F.avg(F.pow(F.col("dd") * 100, F.lit(2)))).alias("ulcer"), F.min_by("equity", order).alias("_a"), F.max_by("equity", order).alias("_b"), days.alias("_days"))
    cagr = F.when((F.col("_a") > 0) & (F.col("_b") > 0), F.pow(F.col("_b") / F.col("_a"), 365 / F.col("_days")) - 1)
    return out.withColumn("cagr", cagr).withColumn("mar", ratio(F.col("cagr"), F.abs("max_dd"))).drop("_a", "_b", "_days")


def daily_equity(df: DataFrame, by: list[str], at: str, fill: bool) -> DataFrame:
    """(by, day, equity): the last of each day; with fill, days without trades carry the last one on."""
    order = F.struct(at, "id")
    days = df.groupBy(*by, F.to_date(at).alias("day")).agg(F.max_by("equity", order).alias("equity"))
    if not fill:
        return days
    w = Window.partitionBy(*by).orderBy("day")
    until = F.coalesce(F.date_sub(F.lead("day").over(w), 1), F.col("day"))
    return days.withColumn("_until", until).select(*by, F.explode(F.sequence("day", "_until")).alias("day"), "equity")


def daily_metrics(days: DataFrame, by: list[str]) -> DataFrame:
    """n_days, Sharpe * sqrt(365) and compounded return of daily equity."""
    w = Window.partitionBy(*by).orderBy("day")
    r = ratio(F.col("equity"), F.lag("equity").over(w)) - 1
    each = days.withColumn("r", r)
    out = each.groupBy(*by).agg(F.count("*").alias("n_days"), F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s"), (F.exp(F.sum(F.log1p(F.when(F.col("r") > -1, F.col("r"))))) - 1).alias("twr"))
    return out.select(*by, "n_days", F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * 365**0.5).alias("sharpe"), "twr")


def step_sharpe(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """Sharpe of irregular steps, annualized by the upper median step."""
    w = Window.partitionBy(*by).orderBy(at, "id")
    each = df.withColumns({"r": ratio(F.col("equity"), F.lag("equity").over(w)) - 1, "step": (F.unix_micros(at) - F.lag(F.unix_micros(at)).over(w)) / 1e6})
    # the row of the upper median by counts of equal steps, so that no list of a key's steps is held
    counts = each.where("step is not null").groupBy(*by, "step").agg(F.count("*").alias("_c"))
    up = Window.partitionBy(*by).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumns({"_to": F.sum("_c").over(up), "_all": F.sum("_c").over(Window.partitionBy(*by))})
    median = reached.where(F.col("_to") > F.floor(F.col("_all") / 2)).groupBy(*by).agg(F.min("step").alias("step_s"))
    out = each.groupBy(*by).agg(F.count("r").alias("n"), F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s")).join(median, by, "left")
    return out.select(*by, "n", "step_s", F.when((F.col("_s") > 0) & (F.col("step_s") > 0), F.col("_m") / F.col("_s") * F.sqrt(365 * 86_400 / F.col("step_s"))).alias("sharpe"))


def shadow_equity(days: DataFrame, by: list[str], target: float, cap: float, n: int = 20) -> DataFrame:
    """Daily equity as if leverage had followed the volatility of the n days before: clip(target / annual volatility, 0, cap), unknown: 0."""
    w = Window.partitionBy(*by).orderBy("day")
    df = days.withColumn("r", ratio(F.col("equity"), F.lag("equity").over(w)) - 1)
    prior = w.rowsBetween(-n, -1)
    vol = F.when(F.count("r").over(prior) >= n, F.stddev_samp("r").over(prior) * 365**0.5)
    wanted = ratio(F.lit(target), vol)
    lever = F.when(wanted.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(cap), wanted)))  # least and greatest skip nulls
    df = df.withColumn("leverage", lever)
    grown = F.sum(F.log1p(F.greatest(F.lit(-0.999999), F.col("leverage") * F.coalesce("r", F.lit(0.0))))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("shadow", F.exp(grown))


def cost_audit(df: DataFrame, bps: float) -> DataFrame:
    """notional, fee and funding of each trade; missing parts count as 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    notional = F.abs(zero("size")) * zero("entry")
    hours = (F.unix_micros("closed_at") - F.unix_micros("opened_at")) / 3_600e6
    return df.withColumns({"notional": notional, "fee_est": notional * bps / 1e4, "funding_est": notional * zero("funding_last") * F.coalesce(hours, F.lit(0.0)) / 8})
