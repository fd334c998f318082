"""Rule predicates over bars and over a decision's context, as columns for `evaluate_rules`.

Bars: one row for each (symbol, ts); a predicate looks at its row and the rows before it, and is false while there are too few.
Context: missing values count as 0, a missing listing age as too young, a missing exit as long ago.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .columns import finite


def bars() -> WindowSpec:
    """A symbol's bars in order of time."""
    return Window.partitionBy("symbol").orderBy("ts")


def _seen(least: int) -> Column:
    """Whether the series has that many bars so far."""
    return F.row_number().over(bars()) >= least


def _held(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def channel_break(period: int = 55, direction: str = "up") -> Column:
    """The close leaves the channel of the `period` bars before."""
    before = bars().rowsBetween(-period, -1)
    out = F.col("close") > F.max("high").over(before) if direction == "up" else F.col("close") < F.min("low").over(before)
    return _held(_seen(period + 2) & out)


def pullback_under_mean(mean: str, period: int, most: float = 0.02) -> Column:
    """The close is at most that part below the moving mean in column `mean`, and not above it."""
    gap = (F.col(mean) - F.col("close")) / F.col(mean)
    return _held(_seen(period + 5) & (F.col(mean) > 0) & gap.between(0, most))


def volume_surge(win: int = 50, times: float = 1.5) -> Column:
    """The volume is at least `times` the mean of the `win` bars before."""
    mean = F.avg("volume").over(bars().rowsBetween(-win, -1))
    return _held(_seen(win + 5) & (mean > 0) & (F.col("volume") >= times * mean))


def trend_of_means(fast: str, slow: str, period: int, direction: str = "up") -> Column:
    """The fast moving mean is above the slow one (up), or below it (down)."""
    return _held(_seen(period + 5) & (F.col(fast) > F.col(slow) if direction == "up" else F.col(fast) < F.col(slow)))


def micro_volatility(atr: str, period: int = 14, least: float = 0.0001) -> Column:
    """The average true range in column `atr` is at least that part of the close."""
    return _held(_seen(period + 5) & (F.when(F.col("close") > 0, F.col(atr) / F.col("close")).otherwise(0.0) >= least))


def pullback_retest(level: str, touched: str = "touched", lookback: int = 288) -> Column:
    """One of the last `lookback` bars touched the break level's band (column `touched`, as `windows.with_touch` makes it), and the close is above the level."""
    return _held(_seen(lookback + 5) & F.col(touched) & (F.col("close") > F.col(level)))


def volume_over_median(median: str, times: float = 2.0, least: int = 100) -> Column:
    """The volume is at least `times` the median in column `median` (`scans.with_median` over the last bars, this one included)."""
    return _held(_seen(least) & (F.when(F.col(median) > 0, F.col("volume") / F.col(median)).otherwise(0.0) >= times))


def daily_channel_confirm(level: str = "daily_level", injected: str | None = None) -> Column:
    """The close is above the highest high of the full days before (column `level`, as `windows.with_daily_level` makes it); a finite level that the decision brought along comes first."""
    known = F.col(level) if injected is None else F.coalesce(finite(F.col(injected)), F.col(level))
    return _held(F.col("close") > known)


def not_blacklisted(symbols: list[str]) -> Column:
    return ~F.col("symbol").isin(symbols) if symbols else F.lit(True)


def cooled_down(hours: float, last_exit: str = "last_exit", now: str = "ts") -> Column:
    """The last exit is at least so many hours ago."""
    if hours <= 0:
        return F.lit(True)
    return F.coalesce(F.unix_micros(now) - F.unix_micros(last_exit) >= hours * 3_600_000_000, F.lit(True))


def listed_for(days: int, age: str = "age_days") -> Column:
    return _held(F.col(age) >= days)


def _at_least(column: str, least: float) -> Column:
    return F.coalesce(F.col(column), F.lit(0.0)) >= least


def macd_bull(macd: str = "eth_macd", signal: str = "eth_macd_signal", hist: str = "eth_macd_hist") -> Column:
    """The MACD is above its signal and the histogram above 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return (zero(macd) > zero(signal)) & (zero(hist) > 0)


#: Names by which rule sets call the predicates.
RULES: dict[str, Callable[..., Column]] = {
    "channel_breakout": channel_break,
    "channel_breakout_daily_confirm": daily_channel_confirm,
    "pullback_under_ma": pullback_under_mean,
    "volume_surge": volume_surge,
    "trend_filter_ema": trend_of_means,
    "micro_vol_filter": micro_volatility,
    "pullback_retest_close_above_break": pullback_retest,
    "volume_median_multiple": volume_over_median,
    "blacklist_symbol": not_blacklisted,
    "cooldown_hours": cooled_down,
    "min_listing_age_days": listed_for,
    "eth_macd_hist_above": lambda least=0.0: _at_least("eth_macd_hist", least),
    "eth_macd_bull": macd_bull,
    "universe_rs_pct_gte": lambda least=0.0: _at_least("rs_pct", least),
    "liquidity_median_24h_usd_gte": lambda least=5e5: _at_least("liquidity", least),
}
