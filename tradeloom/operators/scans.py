"""Exponential means as scans of affine maps, running and sliding medians in order of time.

Means.  A symbol's rows are cut into blocks of time, each kept as one row of arrays and staged.  A mean over a block is an affine map of the mean before it,
y -> a * y + b; a pass over the blocks gives their maps, which are composed over each symbol's blocks (a few numbers a block), and the next pass finishes inside
the blocks.  Means of means are a second level: their inputs are known once the first level's starts are.  The rows move once, when
the blocks are made; a symbol's blocks lie over all tasks.
Medians.  Rows stream in order of (symbol, ts) through a task; an expanding median keeps two heaps, a sliding one a sorted list that the row leaving the frame is
taken from.  Only the frame's values are held, or all values of the symbol at hand where the frame has no start.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator
from heapq import heappush, heappushpop

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import timeframe_seconds
from ..sources.staging import staged

COLUMNS = ["symbol", "ts", "open", "high", "low", "close", "volume"]
INDICATORS = ["ema", "atr", "rsi", "adx", "macd", "macd_signal", "macd_hist", "macd_slope"]
#: Time that a block spans: 8,640 rows of five minutes.
BLOCK = "30d"
#: name -> (values, alpha, rows until it shows).
Inputs = dict[str, tuple[np.ndarray, float, int]]
Level = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], Inputs]


# affine maps


def block_map(x: np.ndarray, alpha: float) -> list[float]:
    """(first value, rows before it, a, b, values, rows after the last): y at the first value becomes a * y + b at the block's end.

    Missing values do not move a mean, but age it: after a gap of g rows the old mean weighs (1 - alpha)^g against alpha.
    """
    known = np.flatnonzero(~np.isnan(x))
    if not len(known):
        return [np.nan, len(x), 1.0, 0.0, 0, len(x)]
    old = (1 - alpha) ** np.diff(known)
    rest = x[known[0] :].copy()
    rest[0] = 0.0
    end = pd.Series(rest).ewm(alpha=alpha, adjust=False).mean().iloc[-1]
    return [x[known[0]], known[0], float(np.prod(old / (old + alpha))), end, len(known), len(x) - 1 - known[-1]]


def _first_mean(state: list[float], x: float, rows: float, alpha: float) -> float:
    """The mean at a block's first value, `rows` rows into it; state: (mean, values so far, rows since the last)."""
    if not state[1]:
        return x
    old = (1 - alpha) ** (state[2] + rows + 1)
    return (old * state[0] + alpha * x) / (old + alpha)


def after_block(state: list[float], of: list[float], alpha: float) -> list[float]:
    """The state behind a block of that map."""
    first, lead, a, b, known, trail = of
    if not known:
        return [state[0], state[1], state[2] + lead]
    return [a * _first_mean(state, first, lead, alpha) + b, state[1] + known, trail]


def mean_in_block(x: np.ndarray, alpha: float, least: int, state: list[float]) -> np.ndarray:
    known = ~np.isnan(x)
    out = np.full(len(x), state[0] if state[1] else np.nan)
    if known.any():
        f = int(known.argmax())
        rest = x[f:].copy()
        rest[0] = _first_mean(state, x[f], f, alpha)
        out[f:] = pd.Series(rest).ewm(alpha=alpha, adjust=False).mean()
    out[state[1] + np.cumsum(known) < least] = np.nan
    return out


# blocks


def _blocks(bars: DataFrame, block: str) -> DataFrame:
    """(symbol, block, COLUMNS as arrays in order of ts), and as `before` the last close, high and low of the symbol's block before."""
    rows = bars.select(*COLUMNS).withColumn("block", F.floor(F.unix_micros("ts") / (timeframe_seconds(block) * 1_000_000)))
    s = rows.groupBy("symbol", "block").agg(F.array_sort(F.collect_list(F.struct("ts", *COLUMNS[2:]))).alias("s"))  # no more rows than a block's time has
    s = s.select("symbol", "block", *[F.col(f"s.{c}").alias(c) for c in COLUMNS[1:]])
    return staged(s, "bar-blocks")


def _starts(blocks: DataFrame) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("block")
    last = F.array(*[F.element_at(c, -1).cast("double") for c in ("close", "high", "low")])
    return staged(blocks.select("symbol", "block", last.alias("last")).select("symbol", "block", F.lag("last").over(w).alias("before")), "block-starts")


class _Block:
    """One block's columns and what was carried into it."""

    def __init__(self, values: dict[str, np.ndarray], before: list[float] | None) -> None:
        close, high, low = before or [np.nan] * 3
        lagged = lambda x, first: np.concatenate([[np.nan if first is None else first], x[:-1]])
        self.x = values | {"close_before": lagged(values["close"], close), "high_before": lagged(values["high"], high), "low_before": lagged(values["low"], low)}
        tr = np.stack([values["high"] - values["low"], np.abs(values["high"] - self.x["close_before"]), np.abs(values["low"] - self.x["close_before"])])
        self.x["true_range"] = np.fmax.reduce(tr)
        self.means: dict[str, np.ndarray] = {}

    def run(self, levels: list[Level], carried: list[list[float]]) -> None:
        for level, states in zip(levels, carried, strict=True):
            inputs = level(self.x, self.means)
            self.means |= {n: mean_in_block(x, alpha, least, states[3 * k : 3 * k + 3]) for k, (n, (x, alpha, least)) in enumerate(inputs.items())}


def _each_block(b: pa.RecordBatch, levels: list[Level], carried: list[str]) -> Iterator[_Block]:
    ends = np.cumsum(b.column("ts").value_lengths().to_numpy(zero_copy_only=False))
    flat = {c: b.column(c).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for c in COLUMNS[2:]}
    rows = zip(np.r_[0, ends[:-1]], ends, b.column("before").to_pylist(), *(b.column(c).to_pylist() for c in carried), strict=True)
    for start, end, before, *states in rows:
        block = _Block({c: v[start:end] for c, v in flat.items()}, before)
        block.run(levels, states)
        yield block


def _carry(blocks: DataFrame, carried: DataFrame, of: Callable[[_Block], list[float]], levels: list[Level], names: list[str], compose: Callable, empty: list[float], name: str) -> DataFrame:
    """carried with one more array: what comes into each block, composed from `of` the blocks before."""

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[float(v) for v in of(block)] for block in _each_block(b, levels, names)]
            yield pa.RecordBatch.from_arrays([b.column("symbol"), b.column("block"), pa.array(found, pa.list_(pa.float64()))], ["symbol", "block", "part"])

    def scan(g: pd.DataFrame) -> pd.DataFrame:
        g, states, state = g.sort_values("block"), [], list(empty)
        for part in g["part"]:
            states.append(state)
            state = compose(state, list(part))
        return pd.DataFrame({"symbol": g["symbol"], "block": g["block"], name: states})

    symbol = blocks.schema["symbol"].dataType.simpleString()
    parts = blocks.join(carried, ["symbol", "block"]).mapInArrow(summarize, f"symbol {symbol}, block long, part array<double>")
    states = parts.groupBy("symbol").applyInPandas(scan, f"symbol {symbol}, block long, {name} array<double>")  # a few numbers a block
    return staged(carried.join(states, ["symbol", "block"]), f"carried-{name}")


def _compose_level(inputs: Inputs) -> Callable:
    alphas = [alpha for _, alpha, _ in inputs.values()]
    return lambda state, maps: [v for k, alpha in enumerate(alphas) for v in after_block(state[3 * k : 3 * k + 3], maps[6 * k : 6 * k + 6], alpha)]


def scan_means(bars: DataFrame, levels: list[Level], finish: Callable[[dict, dict, list[float]], dict[str, np.ndarray]], names: list[str], tail: tuple[Callable[[dict], np.ndarray], int] | None = None, block: str = BLOCK) -> DataFrame:
    """COLUMNS of bars and `names` as finish(columns, means, last values of `tail` before the block) gives them."""
    blocks = _blocks(bars, block)
    carried, held = _starts(blocks), []
    none = _Block({c: np.zeros(0) for c in COLUMNS[2:]}, None)
    for k, level in enumerate(levels):
        inputs = level(none.x, none.means)
        none.means |= {n: np.zeros(0) for n in inputs}
        of = lambda b, level=level: [v for x, alpha, _ in level(b.x, b.means).values() for v in block_map(x, alpha)]
        carried = _carry(blocks, carried, of, levels[:k], list(held), _compose_level(inputs), [np.nan, 0.0, 0.0] * len(inputs), f"level{k}")
        held.append(f"level{k}")
    if tail:
        value, n = tail
        carried = _carry(blocks, carried, lambda b: list(value(b.means)[-n:]), levels, held, lambda state, part: (state + part)[-n:], [np.nan] * n, "tail")

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = b.column("tail").to_pylist() if tail else [None] * b.num_rows
            found = [finish(x.x, x.means, t) for x, t in zip(_each_block(b, levels, held), last, strict=True)]
            if not found:
                continue
            symbol = b.column("symbol").take(pa.array(np.repeat(np.arange(b.num_rows), b.column("ts").value_lengths().to_numpy(zero_copy_only=False))))
            new = [pa.array(np.concatenate([f[n] for f in found]), pa.float64(), from_pandas=True) for n in names]
            yield pa.RecordBatch.from_arrays([symbol, *[b.column(c).flatten() for c in COLUMNS[1:]], *new], [*COLUMNS, *names])

    schema = T.StructType([*[bars.schema[c] for c in COLUMNS], *[T.StructField(c, T.DoubleType()) for c in names]])
    return blocks.join(carried, ["symbol", "block"]).mapInArrow(finished, schema)


def with_means(bars: DataFrame, means: dict[str, tuple[str, float]], block: str = BLOCK) -> DataFrame:
    """bars of COLUMNS with exponential means: name -> (column or true_range, alpha), started at the first value."""
    level = lambda x, _: {n: (x[c], alpha, 1) for n, (c, alpha) in means.items()}
    return scan_means(bars, [level], lambda x, m, _: m, list(means), block=block)


def with_indicators(bars: DataFrame, span: int = 20, n: int = 14, slope: int = 3, block: str = BLOCK) -> DataFrame:
    """bars of COLUMNS with INDICATORS: EMA(span), ATR, RSI and ADX of n, MACD(12, 26, 9) with its histogram's change over `slope` rows; null until each has its rows."""
    of_span = lambda s: 2 / (s + 1)

    def first(x: dict, _: dict) -> Inputs:
        move = x["close"] - x["close_before"]
        up, down = x["high"] - x["high_before"], x["low_before"] - x["low"]
        wilder = {"atr": x["true_range"], "gain": np.maximum(move, 0), "loss": np.maximum(-move, 0), "plus": np.where((up > down) & (up > 0), up, 0.0), "minus": np.where((down > up) & (down > 0), down, 0.0)}
        return {"ema": (x["close"], of_span(span), 1), **{k: (v, 1 / n, n) for k, v in wilder.items()}, "fast": (x["close"], of_span(12), 12), "slow": (x["close"], of_span(26), 26)}

    def second(_: dict, m: dict) -> Inputs:
        total = m["plus"] + m["minus"]
        share = np.where(total > 0, 100 * np.abs(m["plus"] - m["minus"]) / np.where(total > 0, total, 1.0), 0.0)
        return {"macd_signal": (m["fast"] - m["slow"], of_span(9), 9), "adx": (np.where(np.isnan(m["plus"]), np.nan, share), 1 / n, n)}

    hist = lambda m: m["fast"] - m["slow"] - m["macd_signal"]

    def finish(_: dict, m: dict, last: list[float]) -> dict[str, np.ndarray]:
        gain, loss, h = m["gain"], m["loss"], hist(m)
        rsi = np.where(loss != 0, 100 - 100 / (1 + gain / np.where(loss != 0, loss, 1.0)), 100.0)
        earlier = np.concatenate([[np.nan if v is None else v for v in last], h])[: len(h)]
        return m | {"rsi": np.where(np.isnan(gain), np.nan, rsi), "macd": m["fast"] - m["slow"], "macd_hist": h, "macd_slope": h - earlier}

    return scan_means(bars, [first, second], finish, INDICATORS, (hist, slope), block)


# medians


class ExpandingMedian:
    """Two heaps: the lower half turned over, and the upper half; each value costs the logarithm of their size."""

    def __init__(self) -> None:
        self.low: list[float] = []
        self.high: list[float] = []

    def add(self, x: float) -> None:
        if len(self.low) > len(self.high):
            heappush(self.high, -heappushpop(self.low, -x))
        else:
            heappush(self.low, -heappushpop(self.high, x))

    def value(self) -> float:
        return -self.low[0] if len(self.low) > len(self.high) else (self.high[0] - self.low[0]) / 2

    def __len__(self) -> int:
        return len(self.low) + len(self.high)


class SlidingMedian:
    """The values of the last n rows in order; the one that leaves is found by bisection."""

    def __init__(self, n: int) -> None:
        self.n, self.rows, self.sorted = n, deque(), []

    def add(self, x: float | None) -> None:
        if len(self.rows) == self.n and (old := self.rows.popleft()) is not None:
            del self.sorted[bisect_left(self.sorted, old)]
        self.rows.append(x)
        if x is not None:
            insort(self.sorted, x)

    def value(self) -> float:
        k = len(self.sorted)
        return self.sorted[k // 2] if k % 2 else (self.sorted[k // 2 - 1] + self.sorted[k // 2]) / 2

    def __len__(self) -> int:
        return len(self.sorted)


def with_median(df: DataFrame, x: str | Column, name: str, n: int | None = None, least: int = 1) -> DataFrame:
    """df with the median of x over the symbol's last n rows (all so far if None), this one included; null until `least` values are known.

    Nulls and NaN are no values.  Rows stream in order; what is held is one symbol's frame.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, held = None, None
        for b in batches:
            out: list[float | None] = []
            for s, v in zip(b.column("symbol").to_pylist(), b.column("_x").to_pylist(), strict=True):
                if held is None or s != symbol:
                    symbol, held = s, ExpandingMedian() if n is None else SlidingMedian(n)
                v = None if v is None or v != v else v
                if n is not None or v is not None:
                    held.add(v)
                out.append(held.value() if len(held) >= max(1, least) else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.float64())], schema=pa.schema([*list(b.schema)[:-1], pa.field(name, pa.float64())]))

    x = F.col(x) if isinstance(x, str) else x
    sorted_rows = df.withColumn("_x", x.cast("double")).repartition("symbol").sortWithinPartitions("symbol", "ts")
    return sorted_rows.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))
