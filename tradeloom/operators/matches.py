"""Matches of statements and positions without a row for each pair: both meet in blocks of size and price, where a statement's nearest position is found by bits of the order of time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of a block of prices or sizes, and of a list of prices inside a chain, in tolerances.
_BLOCK, _LIST = 8, 0.5
#: Statements that are looked up together.
_ASKS = 1 << 16
_KIND = "statement_id long, position_id long, gap long"
_SCHEMA = pa.schema([("statement_id", pa.int64()), ("position_id", pa.int64()), ("gap", pa.int64())])


def _sides(statements: DataFrame, positions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides by the same columns: symbol, side, id, size, price, time in microseconds."""
    s = statements.where("entry > 0 and qty is not null and symbol is not null and closed_at is not null").select("symbol", F.lit(1).alias("side"), F.col("statement_id").cast("long").alias("id"), F.col("qty").cast("double").alias("size"), F.col("entry").cast("double").alias("price"), F.unix_micros("closed_at").alias("at"))
    p = positions.where("entry_price > 0 and size is not null and symbol is not null and opened_at is not null").select("symbol", F.lit(0).alias("side"), F.col("position_id").cast("long").alias("id"), F.col("size").cast("double").alias("size"), F.col("entry_price").cast("double").alias("price"), F.unix_micros("opened_at").alias("at"))
    return s, p


class _Lists:
    """One group's positions in lists by price, each in order of time, of equal times the least id last."""

    def __init__(self, ids: np.ndarray, size: np.ndarray, price: np.ndarray, at: np.ndarray, tol: float):
        self.tol, self.width = tol, _LIST * tol
        cell = self.cell(price)
        order = np.lexsort((-ids, at, cell))
        self.id, self.size, self.price, self.at, cell = ids[order], size[order], price[order], at[order], cell[order]
        self.cells, self.first = np.unique(cell, return_index=True)
        self.end = np.append(self.first[1:], len(cell))
        # a place in the order of time, the same in all lists, so that one search finds a statement's place in any of them
        self.times, self.rank = np.unique(self.at, return_inverse=True)
        self.key = np.searchsorted(self.cells, cell) * (len(self.times) + 1) + self.rank

    def cell(self, price: np.ndarray) -> np.ndarray:
        return np.floor(np.log(price) / self.width).astype(np.int64)

    def starts(self, price: np.ndarray, time: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each list that prices within the tolerance can lie in, from the own one outwards: its beginning, and its last position up to the time (before the beginning: none)."""
        own, reach = self.cell(price), int(np.ceil((self.tol + 2 * self.tol**2) / self.width)) + 1
        now = np.searchsorted(self.times, time, side="right")
        for d in sorted(range(-reach, reach + 1), key=abs):
            k = np.minimum(np.searchsorted(self.cells, own + d), len(self.cells) - 1)
            there = self.cells[k] == own + d
            yield self.first[k], np.where(there, np.searchsorted(self.key, k * (len(self.times) + 1) + now) - 1, self.first[k] - 1)


def _span(values: np.ndarray, x: np.ndarray, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """First and end of the values, in order, that fit x by the very test of candidates."""
    fits = lambda i, k: np.abs(values[i] - x[k]) <= tol * np.maximum(np.abs(values[i]), np.abs(x[k]))
    near, far = x * (1 - tol), x / (1 - tol)
    low, high = np.minimum(near, far), np.maximum(near, far)
    first = np.searchsorted(values, low - 1e-15 * np.abs(low))
    end = np.searchsorted(values, high + 1e-15 * np.abs(high), side="right")
    for at, last, step in ((first, 0, 1), (end, -1, -1)):  # what rounding let in at either end
        todo = np.flatnonzero(first < end)
        while len(todo):
            todo = todo[~fits(at[todo] + last, todo)]
            at[todo] += step
            todo = todo[first[todo] < end[todo]]
    return first, end


class _Levels:
    """Different numbers below n, dealt by one bit after the other: the largest one below a limit among any places next to each other, in as many steps as n has bits."""

    def __init__(self, numbers: np.ndarray, n: int):
        self.levels = []
        for bit in reversed(range(n.bit_length())):
            one = (numbers >> bit) & 1 == 1
            self.levels.append((bit, np.concatenate([[0], np.cumsum(~one)]).astype(np.int32)))
            numbers = np.concatenate([numbers[~one], numbers[one]])

    def below(self, first: np.ndarray, end: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """-1 where there is none."""
        count, a, b = np.zeros(len(first), np.int64), first, end
        for bit, zeros in self.levels:  # how many are below the limit
            up, za, zb = (limit >> bit) & 1 == 1, zeros[a], zeros[b]
            count += np.where(up, zb - za, 0)
            a, b = np.where(up, zeros[-1] + a - za, za), np.where(up, zeros[-1] + b - zb, zb)
        out, left, a, b = np.zeros(len(first), np.int64), count - 1, first, end
        for bit, zeros in self.levels:  # the last one of them
            za, zb = zeros[a], zeros[b]
            up = left >= zb - za
            out |= up.astype(np.int64) << bit
            left = np.where(up, left - (zb - za), left)
            a, b = np.where(up, zeros[-1] + a - za, za), np.where(up, zeros[-1] + b - zb, zb)
        return np.where(count > 0, out, -1)


def _nearest(psize: np.ndarray, pprice: np.ndarray, pat: np.ndarray, size: np.ndarray, price: np.ndarray, time: np.ndarray, tol: float) -> np.ndarray:
    """Index of the last of the positions, which are in order of time, that fits each statement and is no later; -1 where none fits.

    Sizes that fit are at most two nodes of each level of a tree over all sizes; inside a node, prices that fit are next to each other.  So the work for a statement grows with the logarithm
    of the group, whatever sizes, prices and times it holds.
    """
    (sizes, s), (prices, p) = np.unique(psize, return_inverse=True), np.unique(pprice, return_inverse=True)
    (left, right), (low, high) = _span(sizes, size, tol), _span(prices, price, tol)
    limit, best, level = np.searchsorted(pat, time, side="right"), np.full(len(size), -1), 0
    todo = np.flatnonzero((left < right) & (low < high) & (limit > 0))
    while len(todo):
        odd = [todo[left[todo] & 1 == 1], todo[right[todo] & 1 == 1]]
        nodes = [left[odd[0]], right[odd[1]] - 1]
        asked = np.zeros((len(sizes) >> level) + 1, bool)
        asked[np.concatenate(nodes)] = True
        at = np.flatnonzero(asked[s >> level])
        if len(at):
            key = (s[at] >> level) * len(prices) + p[at]
            order = np.argsort(key, kind="stable")
            key, levels = key[order], _Levels(at[order], len(pat))
            for ask, node in zip(odd, nodes, strict=True):
                for i in range(0, len(ask), _ASKS):
                    k, base = ask[i : i + _ASKS], node[i : i + _ASKS] * len(prices)
                    best[k] = np.maximum(best[k], levels.below(np.searchsorted(key, base + low[k]), np.searchsorted(key, base + high[k]), limit[k]))
        left, right, level = (left + 1) >> 1, right >> 1, level + 1
        todo = todo[left[todo] < right[todo]]
    return best


def _grouped(rows: DataFrame, keys: list[str], of_group) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        side, ids, size, price, at = (table.column(c).to_numpy() for c in ("side", "id", "size", "price", "at"))
        s = side == 1
        if s.all() or not s.any():
            return _SCHEMA.empty_table()
        return pa.table(of_group(ids[~s], size[~s], price[~s], at[~s], ids[s], size[s], price[s], at[s]), _SCHEMA)

    return rows.groupBy(*keys).applyInArrow(run, _KIND)


def nearest_of(statements: DataFrame, positions: DataFrame, tol: float) -> DataFrame:
    """(statement_id, position_id, gap): the position that `nearest_match` takes from `match_candidates`, with the gap in seconds.

    Both sides meet in blocks of size and price, some eight tolerances wide; a statement whose tolerance reaches into more blocks goes to each, and a position to one.
    """

    def of_group(pid, psize, pprice, pat, sid, size, price, at):
        order = np.lexsort((-pid, pat))  # of equal times the least id last
        pid, pat = pid[order], pat[order]
        best = _nearest(psize[order], pprice[order], pat, size, price, at, tol)
        found = best >= 0
        return [pa.array(sid[found]), pa.array(pid[best[found]]), pa.array(at[found] - pat[best[found]])]

    block = lambda x: F.coalesce(F.floor(F.log(F.abs(x)) / (_BLOCK * tol)), F.lit(-(1 << 62)))
    around = lambda x: F.explode(F.array_distinct(F.array(block(x), block(x * (1 - tol) * (1 - 1e-9)), block(x / (1 - tol) * (1 + 1e-9)))))
    s, p = _sides(statements, positions)
    s = s.withColumn("_b", around(F.col("price"))).withColumn("_c", around(F.col("size")))
    rows = s.unionByName(p.withColumns({"_b": block(F.col("price")), "_c": block(F.col("size"))}))
    each = _grouped(rows, ["symbol", "_b", "_c"], of_group)
    best = each.groupBy("statement_id").agg(F.min(F.struct("gap", "position_id")).alias("_x"))
    return best.select("statement_id", "_x.position_id", (F.col("_x.gap") / 1e6).alias("gap"))


def _value_chains(rows: DataFrame, keys: list[str], value: Column, tol: float, name: str) -> DataFrame:
    """rows with the chain of their value: a chain ends where the next value is further away than the tolerance allows, so rows of different chains never fit."""
    rows = rows.withColumn("_v", value)
    values = rows.select(*keys, "_v").distinct()
    w = Window.partitionBy(*keys).orderBy("_v")
    far = F.abs(F.col("_v") - F.lag("_v").over(w)) > 1.0001 * tol * F.greatest(F.abs("_v"), F.abs(F.lag("_v").over(w)))
    marked = values.withColumn("_new", F.coalesce(far.cast("int"), F.lit(0)))
    return rows.join(marked.withColumn(name, F.sum("_new").over(w)).drop("_new"), [*keys, "_v"]).drop("_v")


def greedy_of(statements: DataFrame, positions: DataFrame, tol: float) -> DataFrame:
    """(statement_id, position_id) as `greedy_match` takes them from `match_candidates`, without a row for each candidate.

    Statements compete only through sizes and then prices within the tolerance, hence inside chains of such values; a chain is walked in order of close time, and a position that is
    taken is left out of its list.
    """

    def of_group(pid, psize, pprice, pat, sid, size, price, at):
        lists = _Lists(pid, psize, pprice, pat, tol)
        order = np.lexsort((sid, at))
        sid, size, price, at = sid[order], size[order], price[order], at[order]
        starts = [(b.tolist(), e.tolist()) for b, e in lists.starts(price, at)]
        ids, times, sizes, prices = (x.tolist() for x in (lists.id, lists.at, lists.size, lists.price))
        before = list(range(-1, len(ids)))  # before[i + 1]: the last free position up to i
        out = []

        def free(i: int) -> int:
            root = i
            while before[root + 1] != root:
                root = before[root + 1]
            while before[i + 1] != root:
                before[i + 1], i = root, before[i + 1]
            return root

        for n, (statement, q, e) in enumerate(zip(sid.tolist(), size.tolist(), price.tolist(), strict=True)):
            best = -1
            for begin, end in starts:
                i = free(end[n])
                while i >= begin[n] and (best < 0 or (times[i], -ids[i]) > (times[best], -ids[best])):
                    if abs(q - sizes[i]) <= tol * max(abs(q), abs(sizes[i])) and abs(e - prices[i]) <= tol * max(abs(e), abs(prices[i])):
                        best = i
                        break
                    i = free(i - 1)
            if best >= 0:
                before[best + 1] = best - 1
                out.append((statement, ids[best]))
        return [pa.array([r[c] for r in out], pa.int64()) for c in (0, 1)] + [pa.nulls(len(out), pa.int64())]

    s, p = _sides(statements, positions)
    rows = _value_chains(s.unionByName(p), ["symbol"], F.col("size"), tol, "_c")
    rows = _value_chains(rows, ["symbol", "_c"], F.col("price"), tol, "_b")
    return _grouped(rows, ["symbol", "_c", "_b"], of_group).select("statement_id", "position_id")
