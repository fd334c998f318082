"""The few per-symbol recursions: a two-state switching filter, sequential guards, greedy matching.

The filter runs by applyInPandas on one symbol's rows, with the needed columns only.  A symbol has at most 288 bars a day at five
minutes, so a group stays small (1.5 million rows for 14 years).  Signals are joined to those that may follow them; match candidates are cut into
groups that cannot affect each other, which stream through mapInPandas in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

def prefix_products(m: np.ndarray) -> np.ndarray:
    """m_0, m_0 m_1, m_0 m_1 m_2, ... of (n, 2, 2) matrices, each scaled to a largest entry of 1; by doubling, log n array operations."""
    out = m / m.max(axis=(1, 2), keepdims=True)
    step = 1
    while step < len(out):
        both = out[:-step] @ out[step:]
        out = np.concatenate([out[:step], both / both.max(axis=(1, 2), keepdims=True)])
        step *= 2
    return out


def filter_pass(r: np.ndarray, mean: np.ndarray, var: np.ndarray, trans: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(filtered, ahead, steps): probabilities of two normal states given the returns so far, and one step ahead; steps are the matrices trans * density.

    A state's probability is the start's row times the product of all steps so far, so no row waits for the one before it.
    """
    density = np.exp(-0.5 * (r[:, None] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var) + 1e-300
    steps = trans[None] * density[:, None, :]
    steps = steps / steps.max(axis=(1, 2), keepdims=True)
    first = start * density[0]
    row = np.concatenate([first[None], first @ prefix_products(steps[1:])]) if len(r) > 1 else first[None]
    filtered = row / row.sum(axis=1, keepdims=True)
    return filtered, np.concatenate([start[None], filtered[:-1] @ trans]), steps


def switching_filter(r: np.ndarray, steps: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Filtered probabilities (n, 2), means and variances of a two-state normal switching model, by expectation maximization from a fixed start."""
    order = np.argsort(np.abs(r - r.mean()), kind="stable")
    half = len(r) // 2
    var = np.array([r[order[:half]].var(), r[order[half:]].var()]) + 1e-12
    mean, trans, start = np.full(2, r.mean()), np.array([[0.95, 0.05], [0.05, 0.95]]), np.full(2, 0.5)
    for _ in range(steps):
        filtered, ahead, moved = filter_pass(r, mean, var, trans, start)
        # what is to come, seen from each row: the product of the steps after it, from the last one back
        later = prefix_products(moved[:0:-1].transpose(0, 2, 1))[::-1].sum(axis=1) if len(r) > 1 else np.zeros((0, 2))
        smooth = filtered * np.concatenate([later, np.ones((1, 2))])
        smooth = smooth / smooth.sum(axis=1, keepdims=True)
        moves = filtered[:-1].T @ (smooth[1:] / ahead[1:]) * trans
        weight = smooth.sum(0) + 1e-12
        mean = (smooth * r[:, None]).sum(0) / weight
        var = (smooth * (r[:, None] - mean) ** 2).sum(0) / weight + 1e-12
        trans = moves / (moves.sum(1, keepdims=True) + 1e-300)
        start = smooth[0]
    return filter_pass(r, mean, var, trans, start)[0], mean, var


def filtered_states(bars: DataFrame, mean: list[float], var: list[float], stay: float) -> DataFrame:
    """(symbol, ts, prob): probability of the second state given a symbol's plain returns so far, for fixed parameters; no row for a return that is not known."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts", ignore_index=True)
        r = g["close"].pct_change().to_numpy()
        known = np.isfinite(r)
        if not known.any():
            return g.iloc[:0].assign(prob=0.0)[["symbol", "ts", "prob"]]
        trans = np.array([[stay, 1 - stay], [1 - stay, stay]])
        p = filter_pass(r[known], np.array(mean), np.array(var), trans, np.full(2, 0.5))[0]
        return g[known][["symbol", "ts"]].assign(prob=p[:, 1])

    return bars.select("symbol", "ts", "close").groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp, prob double")


def markov_regime(bars: DataFrame, least: int, up: bool, alpha: float = 0.2) -> DataFrame:
    """(symbol, ts, prob, state).  up: prob is the smoothed probability of the state of lower weighted mean log return; else of the state of lower variance of plain returns.

    Series of fewer than `least` returns give nothing.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts", ignore_index=True)
        r = (np.log(g["close"]).diff() if up else g["close"].pct_change()).to_numpy()
        known = np.isfinite(r)
        if known.sum() < least:
            return g.iloc[:0].assign(prob=0.0, state=0)[["symbol", "ts", "prob", "state"]]
        p, mean, var = switching_filter(r[known])
        weighted = (p * r[known][:, None]).sum(0) / np.maximum(p.sum(0), 1e-12)
        pick = int(np.argmin(weighted)) if up else int(np.argmin(var))
        prob = pd.Series(np.nan, index=g.index)
        prob[known] = p[:, pick]
        prob = prob.ffill()
        if up:
            prob = prob.ewm(alpha=alpha, adjust=False).mean()
        out = pd.DataFrame({"symbol": g["symbol"], "ts": g["ts"], "prob": prob})
        return out.dropna().assign(state=lambda d: (d["prob"] > 0.5).astype("int32"))

    return bars.select("symbol", "ts", "close").groupBy("symbol").applyInPandas(run, "symbol string, ts timestamp, prob double, state int")


def _in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with equal keys in one partition, one after another in order; the sort spills, so no group is held."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def next_signals(times: DataFrame, cooldown: int) -> DataFrame:
    """(symbol, t, to): for each distinct time t (microseconds) the symbol's first one at least `cooldown` later, null if none.

    Time is cut into cells of the cooldown.  What is sought lies in the next cell, or is the first time of the first cell after it that holds any; so the windows
    are over one cell's times, and over one row for each cell that holds any.
    """
    at = times.withColumn("cell", F.floor(F.col("t") / cooldown))
    w = Window.partitionBy("symbol").orderBy("cell")
    cells = at.groupBy("symbol", "cell").agg(F.min("t").alias("first"))
    cells = cells.select("symbol", "cell", *[F.lead(c, k).over(w).alias(f"{c}{k}") for k in (1, 2) for c in ("cell", "first")])
    asks = at.select("symbol", (F.col("cell") + 1).alias("cell"), (F.col("t") + cooldown).alias("at"), F.lit(1).alias("asks"), "t")
    tells = at.select("symbol", "cell", F.col("t").alias("at"), F.lit(0).alias("asks"), "t")
    later = Window.partitionBy("symbol", "cell").orderBy(F.desc("at"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    near = asks.unionByName(tells).withColumn("near", F.min(F.when(F.col("asks") == 0, F.col("at"))).over(later)).where("asks = 1")
    found = near.select("symbol", (F.col("cell") - 1).alias("cell"), "t", "near").join(cells, ["symbol", "cell"])
    to = F.when(F.col("cell1") > F.col("cell") + 1, F.col("first1")).otherwise(F.coalesce("near", "first2"))
    return found.select("symbol", "t", to.alias("to"))


def accepted_signals(signals: DataFrame, cooldown_s: float) -> DataFrame:
    """(symbol, ts, id, accepted): a signal is accepted if the last accepted one of its symbol is cooldown_s away; without a time never.

    The accepted ones are the chain from a symbol's first signal along `next_signals`, found by pointer doubling: a round adds as many as are known, with pointers of
    twice the length, so a chain of n takes log n rounds of joins on staged tables and no task follows it.  Of signals of one time the first by id counts.
    """
    rows = signals.select("symbol", "ts", "id")
    first = F.row_number().over(Window.partitionBy("symbol", "ts").orderBy("id")) == 1
    known = rows.where("ts is not null").select(F.struct("symbol").alias("symbol"), F.unix_micros("ts").alias("t")).distinct()  # as a struct a null symbol is equal to itself
    cooldown = round(cooldown_s * 1_000_000)
    if cooldown <= 0:
        return rows.withColumn("accepted", F.col("ts").isNotNull())
    jump = staged(next_signals(known, cooldown).where("to is not null"), "signal-next")
    reached = staged(known.groupBy("symbol").agg(F.min("t").alias("t")), "signals-reached")
    while True:
        more = staged(reached.join(jump, ["symbol", "t"]).select("symbol", F.col("to").alias("t")), "signals-more")
        if more.isEmpty():
            break
        reached = reached.unionByName(more)
        onward = jump.select("symbol", F.col("t").alias("to"), F.col("to").alias("further"))
        jump = staged(jump.join(onward, ["symbol", "to"]).select("symbol", "t", F.col("further").alias("to")), "signal-next")
    taken = reached.select("symbol", "t", F.lit(True).alias("taken"))
    placed = rows.withColumn("first", first).withColumns({"key": F.struct("symbol"), "t": F.unix_micros("ts")})
    out = placed.join(taken.withColumnRenamed("symbol", "key"), ["key", "t"], "left")
    return out.select("symbol", "ts", "id", (F.col("first") & F.coalesce("taken", F.lit(False))).alias("accepted"))


def _chains(rows: DataFrame, keys: list[str], lo: Column, hi: Column, name: str) -> DataFrame:
    """rows with the number of their chain of overlapping [lo, hi] among rows of equal keys; rows of different chains share no value."""
    w = Window.partitionBy(*keys).orderBy("_lo")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = rows.withColumns({"_lo": lo, "_hi": hi})
    df = df.withColumn("_gap", F.coalesce((F.col("_lo") > F.max("_hi").over(before)).cast("int"), F.lit(0)))
    return df.withColumn(name, F.sum("_gap").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_lo", "_hi", "_gap")


def greedy_match(candidates: DataFrame, spans: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """(statement_id, position_id): statements in order of close time take the nearest position that is still free.

    candidates: symbol, statement_id, closed_at, position_id, gap (seconds).  spans: pairs of columns, one of the statement's own values and the
    position's own, such as the two prices: candidates compete only through a shared statement or position, hence inside chains of overlapping
    [least, greatest], and any task can take a chain.  A task reads its chains in order and holds the ids that the present chain has used.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, done = None, set(), set()
        for g in batches:
            out = []
            for *key, s, p in g.itertuples(index=False, name=None):
                if key != now:
                    now, used, done = key, set(), set()
                if s not in done and p not in used:
                    done.add(s)
                    used.add(p)
                    out.append((s, p))
            yield pd.DataFrame(out, columns=["statement_id", "position_id"], dtype="int64")

    keys, rows = ["symbol"], candidates.select("symbol", "statement_id", "closed_at", "position_id", "gap", *dict.fromkeys(c for pair in spans for c in pair))
    for k, (own, other) in enumerate(spans):
        rows = _chains(rows, keys, F.least(own, other), F.greatest(own, other), f"_chain{k}")
        keys = [*keys, f"_chain{k}"]
    ordered = _in_order(rows, keys, ["closed_at", "statement_id", "gap", "position_id"])
    return ordered.select(*keys, "statement_id", "position_id").mapInPandas(run, "statement_id long, position_id long")
