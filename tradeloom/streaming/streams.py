"""Streams: closed bars, latest state, bounded outcome state, deduplication, upserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..functions.columns import timeframe_seconds
from ..operators import bars as B
from ..operators import logs as L
from ..sources.staging import staged


def closed_bars(ticks: DataFrame, tf: str, late: str) -> DataFrame:
    """Bars of tumbling windows, sent once the watermark has passed their end; later ticks are dropped.

    ticks: symbol, ts, seq, price, volume.
    """
    at = F.struct("ts", "seq")
    w = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", f"{B.timeframe_seconds(tf)} seconds").alias("w"))
    out = w.agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def sliding_turnover(bars: DataFrame, width: str, step: str, late: str) -> DataFrame:
    """Turnover of sliding windows."""
    w = bars.withWatermark("ts", late).groupBy("symbol", F.window("ts", width, step).alias("w"))
    return w.agg(F.sum(F.col("close") * F.col("volume")).alias("turnover")).select("symbol", F.col("w.end").alias("ts"), "turnover")


def latest_state(lines: DataFrame, order: str, fields: list[str]) -> DataFrame:
    """Last known fields of each symbol over a stream of parsed lines; update mode."""
    return L.latest_state(lines, ["symbol"], F.col(order), fields)


def first_decisions(decisions: DataFrame, late: str) -> DataFrame:
    """The first decision of each symbol and time within the watermark; see upsert_to for the latest."""
    return decisions.withWatermark("decision_ts", late).dropDuplicatesWithinWatermark(["symbol", "decision_ts"])


def latest_decisions(decisions: DataFrame, late: str, order: str, fields: list[str]) -> DataFrame:
    """The latest line of each symbol and time (by `order`), given again whenever a later one arrives; state goes with the watermark; update mode."""
    newest = F.max_by(F.struct(*fields), order).alias("_newest")
    return decisions.withWatermark("decision_ts", late).groupBy("symbol", "decision_ts").agg(newest).select("symbol", "decision_ts", "_newest.*")


def outcome_state(outcomes: DataFrame, most: int = 50, span: int = 20) -> DataFrame:
    """(symbol, n, win_rate_20, win_rate_50, ewm) after each batch; a symbol's state is its newest `most` outcomes.

    outcomes: symbol, ts, win.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = pd.DataFrame({"ts": state.get[0], "win": state.get[1]}) if state.exists else pd.DataFrame({"ts": [], "win": []})
        new = pd.concat([pd.DataFrame({"ts": b["ts"].astype("datetime64[us]").astype("int64"), "win": b["win"].astype(float)}) for b in batches])
        rows = pd.concat([old, new]).sort_values("ts", kind="stable").tail(most)
        state.update(([int(t) for t in rows["ts"]], [float(w) for w in rows["win"]]))
        win = rows["win"]
        yield pd.DataFrame({"symbol": [key[0]], "n": [len(win)], "win_rate_20": [win.tail(20).mean()], "win_rate_50": [win.tail(50).mean()], "ewm": [win.ewm(span=span, adjust=False).mean().iloc[-1]]})

    return outcomes.groupBy("symbol").applyInPandasWithState(run, "symbol string, n long, win_rate_20 double, win_rate_50 double, ewm double", "ts array<long>, win array<double>", "update", GroupStateTimeout.NoTimeout)


_OUTCOMES = "symbol string, n long, win_rate_20 double, win_rate_50 double, ewm double"


def expiring_outcome_state(outcomes: DataFrame, late: str, keep: str, most: int = 50, span: int = 20) -> DataFrame:
    """outcome_state whose symbols are forgotten once the watermark is `keep` (such as 7d) past their newest outcome; such a symbol is given once more, with n = 0.

    Needs the RocksDB state store; outcomes later than the watermark are dropped.
    """
    hold = timeframe_seconds(keep) * 1_000

    class Newest(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.newest = handle.getListState("newest", "ts long, win double")

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
            old = pd.DataFrame(list(self.newest.get()) if self.newest.exists() else [], columns=["ts", "win"])
            new = [pd.DataFrame({"ts": b["ts"].astype("datetime64[us]").astype("int64"), "win": b["win"].astype(float)}) for b in rows]
            held = pd.concat([f for f in [old, *new] if len(f)]).sort_values("ts", kind="stable").tail(most)
            self.newest.put([(int(t), float(w)) for t, w in zip(held["ts"], held["win"], strict=True)])
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(held["ts"].iloc[-1]) // 1_000 + hold)
            win = held["win"]
            yield pd.DataFrame({"symbol": [key[0]], "n": [len(win)], "win_rate_20": [win.tail(20).mean()], "win_rate_50": [win.tail(50).mean()], "ewm": [win.ewm(span=span, adjust=False).mean().iloc[-1]]})

        def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
            self.newest.clear()
            yield pd.DataFrame({"symbol": [key[0]], "n": [0], "win_rate_20": [float("nan")], "win_rate_50": [float("nan")], "ewm": [float("nan")]})

        def close(self) -> None:
            pass

    return outcomes.withWatermark("ts", late).groupBy("symbol").transformWithStateInPandas(Newest(), _OUTCOMES, "update", "eventTime")


def upsert_to(read: Callable[[], DataFrame], write: Callable[[DataFrame], None], keep: int, keys: tuple[str, ...] = ("symbol", "tf")) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the batch's rows replace those of the same keys and time in the table that read and write reach.

    Only the series that the batch holds are read and written; write replaces the series of its rows and no others, as an
    insertInto under spark.sql.sources.partitionOverwriteMode=dynamic does on a table partitioned by the keys.  What is written is staged before, so the
    table is no longer read then.
    """

    def run(batch: DataFrame, _: int) -> None:
        new = batch.withColumn("_seq", F.monotonically_increasing_id())
        old = read().join(batch.select(*keys).distinct(), list(keys), "left_semi")
        write(staged(B.upsert(old, B.keep_last(new, [*keys, "ts"], ["_seq"]).drop("_seq"), keep, keys), "upsert"))

    return run
