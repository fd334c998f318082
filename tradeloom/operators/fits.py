"""Many logistic models at once: folds, left-out features and shuffled labels are columns of one Newton step over the table.

Each round is one pass: a task keeps, for every model, the sums of gradient and curvature over its rows, and only those sums (models x coefficients^2
numbers, whatever the number of rows) are added up and solved.  Rows are never copied for a model or a fold: medians are found by counts of leading bits,
means and deviations are put together from the spans between the folds' ends, and each fold's scaling is a linear map of features that all models share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .shuffles import drawn, with_draws

#: Newton rounds at most; ridge models of standardized features need some three.
ROUNDS = 60
TOLERANCE = 1e-11
#: Rows of one block of products, so that a block of all models stays in the cache.
_BLOCK = 1_000
#: Leading bits of a value that one pass counts, until all 64 are known.
_BITS = (13, 13, 13, 13, 12)
#: Scores that meet in one task of the ranks, and rows whose scores tell where to cut them.
_CELL = 500_000
_CUT_ROWS = 10_000
#: Scores that lie on the disk at a time, and models whose scores do so in any case.
_TURN_SCORES, _TURN_VARIANTS = 50_000_000, 8


@dataclass(frozen=True)
class Variant:
    """A model to be fitted in every fold: the features that it uses, and which of the row's labels."""

    name: str
    features: tuple[str, ...]
    label: int = 0


@dataclass
class Fitted:
    """Models by fold: what fills and scales the features, and coefficients (intercept first, one column a variant); a constant in `share` where a training part has one class.

    cuts: what reads the rows' labels, where they are shuffles.
    """

    features: list[str]
    variants: list[Variant]
    bounds: list[tuple[int, int]]
    embargo: int
    center: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    rows: np.ndarray
    beta: np.ndarray
    share: np.ndarray
    rounds: int = 0
    cuts: tuple[np.ndarray, np.ndarray] | None = None


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """rows x width of a list column whose lists all have this width; nulls become NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), width)


def _labels(b: pa.RecordBatch, cuts: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """rows x labels: lists, or shuffles with their cuts."""
    y = b.column("_y")
    if cuts is None:
        return _matrix(y, len(y[0]) if len(y) else 0)
    return drawn(y, b.column("_i").to_numpy(), cuts)


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(values).ravel()))


def _design(x: np.ndarray, m: Fitted, fold: int) -> np.ndarray:
    """1 and the filled, standardized features; a feature unknown or constant in the fold's training part is 0."""
    filled = np.where(np.isnan(x), m.center[fold], x)
    scale = m.scale[fold]
    z = np.where(scale > 0, (filled - m.mean[fold]) / np.where(scale > 0, scale, 1.0), 0.0)
    return np.column_stack([np.ones(len(x)), z])


def _sigmoid(t: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-t)), in place."""
    np.negative(t, out=t)
    with np.errstate(over="ignore"):  # infinity gives 0
        np.exp(t, out=t)
    t += 1.0
    return np.reciprocal(t, out=t)


def fold_bounds(n: int, folds: int) -> list[tuple[int, int]]:
    """First and last order index of each contiguous test fold; the first n % folds ones hold one row more."""
    size, more = divmod(n, folds)
    return [(k * size + min(k, more), (k + 1) * size + min(k + 1, more) - 1) for k in range(folds)]


def _spans(bounds: list[tuple[int, int]], embargo: int) -> tuple[np.ndarray, np.ndarray]:
    """Where spans of the order index begin (the first before all), so that a span lies in a fold's training part or outside of it; folds x spans, whether it lies inside."""
    cuts = np.unique([c for lo, hi in bounds for c in (lo - embargo, hi + embargo + 1)])
    first = np.concatenate([[cuts[0] - 1], cuts])
    return cuts, np.array([(first < lo - embargo) | (first > hi + embargo) for lo, hi in bounds])


def packed_rows(df: DataFrame, features: list[str], labels: Column, index: str = "order_idx", keep: list[str] = ()) -> DataFrame:
    """(_i, _x, _y, keep): the order index, the features (NaN and infinities are missing) and the labels of each row, staged for the passes to come."""
    clean = [F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double")) for c in features]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(index).cast("long").alias("_i"), F.array(*clean).alias("_x"), labels.cast("array<tinyint>").alias("_y"), *keep)
    return staged(rows.repartition(parts), "fit-rows")  # dealt evenly: each pass takes every row through every model


def _ordered(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of x."""
    u = (x + 0.0).view(np.uint64)  # -0 is 0
    return np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))


def _value(u: int) -> float:
    return float(np.array([u & ~(1 << 63) if u >> 63 else ~u & (2**64 - 1)], np.uint64).view(np.float64)[0])


def _scales(rows: DataFrame, features: list[str], bounds: list[tuple[int, int]], embargo: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Medians, means and deviations of the filled features, and rows, of each fold's training part; means, deviations and known values of each feature in all rows.

    A pass counts the values of each span and feature by some more of their leading bits, below the bits that are known of the folds' two middle values; the first
    pass sums values as well, the second one squares about the mean.  At most 8,192 counts for each span and pair of known bits reach the driver.
    """
    d, folds = len(features), len(bounds)
    cuts, inside = _spans(bounds, embargo)
    spans = len(cuts) + 1
    center, mean, scale, n = np.zeros((folds, d)), np.zeros((folds, d)), np.zeros((folds, d)), np.zeros(folds)
    all_mean, all_scale, known_all = np.zeros(d), np.zeros(d), np.zeros(d)
    known, sums, squares = np.zeros((spans, d)), np.zeros((spans, d)), np.zeros((spans, d))
    wanted: dict[tuple[int, int], list] = {}  # (feature, fold): bits and remaining place of the lower and of the upper middle value
    top, done = [[0] for _ in range(d)], 0
    for turn, bits in enumerate(_BITS):
        shift, mask = 64 - done - bits, (1 << bits) - 1

        def part(batches: Iterator[pa.RecordBatch], turn=turn, bits=bits, shift=shift, mask=mask, done=done, top=top, about=all_mean.copy()) -> Iterator[pa.RecordBatch]:
            counts = [np.zeros(len(t) * spans << bits, np.int64) for t in top]
            at_all, more = np.zeros(spans, np.int64), np.zeros((spans, d))
            for b in batches:
                if not b.num_rows:
                    continue
                span, x = np.searchsorted(cuts, b.column("_i").to_numpy(), side="right"), _matrix(b.column("_x"), d)
                at_all += np.bincount(span, minlength=spans)
                for j in range(d):
                    there = ~np.isnan(x[:, j])
                    s, v = span[there], x[there, j]
                    if turn < 2:
                        more[:, j] += np.bincount(s, v if turn == 0 else (v - about[j]) ** 2, minlength=spans)
                    u = _ordered(v)
                    if turn:
                        lead = (u >> np.uint64(64 - done)).astype(np.int64)
                        slot = np.minimum(np.searchsorted(top[j], lead), len(top[j]) - 1)
                        hit = np.asarray(top[j])[slot] == lead
                        s, u, slot = s[hit], u[hit], slot[hit]
                    else:
                        slot = 0
                    place = ((slot * spans + s) << bits) + ((u >> np.uint64(shift)) & np.uint64(mask)).astype(np.int64)
                    if len(place):
                        counts[j] += np.bincount(place, minlength=len(counts[j]))
            kinds, at, c, v = [], [], [], []
            for j in range(d):
                found = np.flatnonzero(counts[j])
                kinds.append(np.full(len(found), j)), at.append(found), c.append(counts[j][found]), v.append(np.zeros(len(found)))
                kinds.append(np.full(spans, -2 - j)), at.append(np.arange(spans)), c.append(np.zeros(spans, np.int64)), v.append(more[:, j])
            kinds.append(np.full(spans, -1)), at.append(np.arange(spans)), c.append(at_all), v.append(np.zeros(spans))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)) for a in (kinds, at, c, v)], ["kind", "at", "c", "v"])

        out = rows.select("_i", "_x").mapInArrow(part, "kind long, at long, c long, v double").groupBy("kind", "at").agg(F.sum("c").alias("c"), F.sum("v").alias("v"))
        counts = [np.zeros((len(t), spans, 1 << bits), np.int64) for t in top]
        for r in out.collect():
            if r["kind"] >= 0:
                counts[r["kind"]].reshape(-1)[r["at"]] = r["c"]
            elif r["kind"] == -1:
                n = n + inside[:, r["at"]] * r["c"] if turn == 0 else n
            elif turn < 2:
                (sums if turn == 0 else squares)[r["at"], -2 - r["kind"]] = r["v"]
        if turn == 0:
            for j in range(d):
                known[:, j] = counts[j][0].sum(axis=1)
            known_all = known.sum(axis=0)
            all_mean = sums.sum(axis=0) / np.maximum(known_all, 1)
            for j in range(d):
                for k in range(folds):
                    size = int(known[inside[k], j].sum())
                    wanted[j, k] = [[0, (size - 1) // 2], [0, size // 2]] if size else []
        for (j, k), two in wanted.items():
            for w in two:
                up = np.cumsum(counts[j][top[j].index(w[0])][inside[k]].sum(axis=0))
                cell = int(np.searchsorted(up, w[1], side="right"))
                w[0], w[1] = (w[0] << bits) | cell, w[1] - (int(up[cell - 1]) if cell else 0)
        done += bits
        top = [sorted({w[0] for k in range(folds) for w in wanted[j, k]}) or [0] for j in range(d)]
    all_scale = np.sqrt(squares.sum(axis=0) / np.maximum(known_all - 1, 1))
    for (j, k), two in wanted.items():
        if not two:
            continue
        low, high = (_value(w[0]) for w in two)
        center[k, j] = low if low == high else 0.5 * low + 0.5 * high
        size, missing = known[inside[k], j].sum(), n[k] - known[inside[k], j].sum()
        # sums about the mean of all rows, in which filled values count as well
        off = sums[inside[k], j].sum() - size * all_mean[j] + missing * (center[k, j] - all_mean[j])
        square = squares[inside[k], j].sum() + missing * (center[k, j] - all_mean[j]) ** 2
        mean[k, j] = all_mean[j] + off / n[k]
        scale[k, j] = np.sqrt(max(0.0, square - off * off / n[k]) / (n[k] - 1)) if n[k] > 1 else 0.0
    # deviations that are rounding only: the feature is constant
    scale[scale <= 1e-12 * np.maximum(1.0, np.abs(mean))] = 0.0
    all_scale[all_scale <= 1e-12 * np.maximum(1.0, np.abs(all_mean))] = 0.0
    return center, mean, scale, n, all_mean, all_scale, known_all


@dataclass
class _Shared:
    """The features that all folds share: 1, features by their mean and deviation in all rows (unknown: 0), and whether a feature is unknown, for those that are in some row."""

    mean: np.ndarray
    scale: np.ndarray
    gaps: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        away = np.isnan(x)
        v = np.where(away | (self.scale == 0), 0.0, (x - self.mean) / np.where(self.scale > 0, self.scale, 1.0))
        return np.column_stack([np.ones(len(x)), v, away[:, self.gaps]])

    def fold(self, m: Fitted, k: int) -> np.ndarray:
        """What makes the fold's own design of these features: coefficients x features here."""
        d = len(m.features)
        used = m.scale[k] > 0
        per = np.where(used, 1.0 / np.where(used, m.scale[k], 1.0), 0.0)
        out = np.zeros((d + 1, 1 + d + len(self.gaps)))
        out[0, 0] = 1.0
        out[1:, 0] = (self.mean - m.mean[k]) * per
        out[np.arange(1, d + 1), np.arange(1, d + 1)] = self.scale * per
        out[1 + self.gaps, 1 + d + np.arange(len(self.gaps))] = (m.center[k] - self.mean)[self.gaps] * per[self.gaps]
        return out


def _sums(rows: DataFrame, m: Fitted, shared: _Shared, left: list[list[int]] | None) -> np.ndarray:
    """folds x variants x (gradient, upper triangle of the curvature) of the shared features at the present coefficients, for the variants left in each fold.

    left: None: sums of label times feature, and the triangle of the features themselves.
    """
    d, count, label = len(m.features), len(m.variants), np.array([v.label for v in m.variants])
    size = 1 + d + len(shared.gaps)
    upper = np.triu_indices(size)
    width, folds = size + len(upper[0]), len(m.bounds)
    cuts, inside = _spans(m.bounds, m.embargo)
    betas = [shared.fold(m, k).T @ m.beta[k] for k in range(folds)]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((folds, count, width))
        for b in batches:
            for i in range(0, b.num_rows, _BLOCK):
                some = b.slice(i, _BLOCK)
                train = inside[:, np.searchsorted(cuts, some.column("_i").to_numpy(), side="right")].astype(np.float64)
                u, y = shared.of(_matrix(some.column("_x"), d)), _labels(some, m.cuts).astype(np.float64)
                uu = u[:, upper[0]] * u[:, upper[1]]
                for k in range(folds):
                    at = train[k][:, None]
                    if left is None:
                        total[k, :, :size] += (y.T @ (u * at))[label]
                        total[k, :, size:] += train[k] @ uu
                    elif left[k]:
                        p = _sigmoid(u @ betas[k][:, left[k]])
                        total[k, left[k], :size] += (y[:, label[left[k]]] - p).T @ (u * at)
                        total[k, left[k], size:] += (p - p * p).T @ (uu * at)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(folds * count), pa.int32()), _lists(total.reshape(-1, width))], ["fit", "sums"])

    each = rows.select("_i", "_x", "_y").mapInArrow(part, "fit int, sums array<double>")
    out = np.zeros((folds * count, width))
    for r in each.groupBy("fit").agg(F.array(*[F.sum(F.col("sums")[j]) for j in range(width)]).alias("sums")).collect():  # one row a model
        out[r["fit"]] = r["sums"]
    return out.reshape(folds, count, width)


def fit_all(rows: DataFrame, features: list[str], variants: list[Variant], folds: int, embargo: int, strength: float = 0.01, cuts: tuple[np.ndarray, np.ndarray] | None = None) -> Fitted:
    """All variants fitted in all folds on `packed_rows`: mean log loss plus strength / 2 times the squared coefficients, the intercept free.

    A training part of one class gets its share as a constant, one without rows null.  Models start at the share; a step after which the gradient is longer is halved.
    """
    total = rows.count()
    bounds = fold_bounds(total, folds)
    center, mean, scale, n, all_mean, all_scale, known = _scales(rows, features, bounds, embargo)
    d = len(features) + 1
    m = Fitted(features, variants, bounds, embargo, center, mean, scale, n, np.zeros((folds, d, len(variants))), np.full((folds, len(variants)), np.nan), cuts=cuts)
    shared = _Shared(all_mean, all_scale, np.flatnonzero(known < total))
    maps = [shared.fold(m, k) for k in range(folds)]
    used = [[0, *[1 + features.index(c) for c in v.features]] for v in variants]
    size = 1 + len(features) + len(shared.gaps)
    upper = np.triu_indices(size)
    ridge = np.diag([0.0] + [strength] * (d - 1))
    best, step = np.full((folds, len(variants)), np.inf), np.zeros((folds, d, len(variants)))
    open_ = {(k, g) for k in range(folds) for g in range(len(variants))}
    for _ in range(ROUNDS):
        left = [[g for g in range(len(variants)) if (k, g) in open_] for k in range(folds)]
        sums = _sums(rows, m, shared, left if m.rounds else None)
        m.rounds += 1
        for k, g in sorted(open_):
            first, curve = sums[k, g, :size].copy(), np.zeros((size, size))
            curve[upper] = sums[k, g, size:]
            curve = np.triu(curve) + np.triu(curve, 1).T
            if m.rounds == 1:
                share = m.share[k, g] = first[0] / n[k] if n[k] else np.nan
                if not n[k] or first[0] in (0.0, n[k]):
                    open_.discard((k, g))
                    continue
                m.beta[k, 0, g] = np.log(share / (1 - share))
                first -= share * curve[0]
                curve *= share * (1 - share)
            at = [0] + [j for j in used[g][1:] if scale[k, j - 1] > 0]
            b = m.beta[k, :, g]
            gradient = (maps[k] @ first / n[k] - ridge @ b)[at]
            length = float(np.sqrt(gradient @ gradient))
            if length > best[k, g] + 1e-13:
                step[k, :, g] /= 2
                m.beta[k, :, g] -= step[k, :, g]
                if np.abs(step[k, :, g]).max() < TOLERANCE:
                    open_.discard((k, g))
                continue
            best[k, g] = length
            h = maps[k] @ curve @ maps[k].T / n[k] + ridge
            step[k, :, g] = 0.0
            step[k, at, g] = np.linalg.solve(h[np.ix_(at, at)], gradient)
            m.beta[k, :, g] += step[k, :, g]
            if np.abs(step[k, :, g]).max() < TOLERANCE:
                open_.discard((k, g))
        if not open_:
            break
    return m


def _scores(index: np.ndarray, x: np.ndarray, m: Fitted) -> np.ndarray:
    """rows x variants: scores by the models of the fold that tests a row; NaN where its training part had no rows."""
    p = np.full((len(index), len(m.variants)), np.nan)
    for k, (lo, hi) in enumerate(m.bounds):
        at = np.flatnonzero((index >= lo) & (index <= hi))
        if len(at):
            constant = (m.share[k] == 0.0) | (m.share[k] == 1.0) | np.isnan(m.share[k])
            p[at] = np.where(constant, m.share[k], _sigmoid(_design(x[at], m, k) @ m.beta[k]))
    return p


def score_all(rows: DataFrame, m: Fitted, keep: list[str] = ()) -> DataFrame:
    """(keep, _y, _p): for each row the scores of all variants by the models of the fold that tests it; NaN where its training part had no rows."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = _scores(b.column("_i").to_numpy(), _matrix(b.column("_x"), len(m.features)), m)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], _lists(p)], [*kept, "_p"])

    kept = [*keep, "_y"]
    kinds = dict(rows.dtypes)
    return rows.select("_i", "_x", *kept).mapInArrow(part, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", _p array<double>")


def _sorted_bytes(v: np.ndarray, n: np.ndarray) -> tuple[int, bytes]:
    """Scores in order with their counts, as compressed differences: of scores that lie close, the leading bytes vanish, and so do counts of 1."""
    steps = np.diff(v.view(np.int64), prepend=np.int64(0))
    planes = np.concatenate([steps.view(np.uint8).reshape(-1, 8).T.ravel(), n.astype(np.int32).view(np.uint8).reshape(-1, 4).T.ravel()])
    return len(v), pa.compress(planes, codec="zstd", asbytes=True)


def _sorted_values(sizes: list[int], packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Scores and counts of many arrays, one after another."""
    found = [(np.empty(0), np.empty(0, np.int32))]
    for size, x in zip(sizes, packed, strict=True):
        planes = np.frombuffer(pa.decompress(x, 12 * size, codec="zstd"), np.uint8)
        steps, n = planes[: 8 * size].reshape(8, size), planes[8 * size :].reshape(4, size)
        found.append((np.cumsum(np.ascontiguousarray(steps.T).view(np.int64).ravel()).view(np.float64), np.ascontiguousarray(n.T).view(np.int32).ravel()))
    return np.concatenate([v for v, _ in found]), np.concatenate([n for _, n in found]).astype(np.float64)


def _cell_figures(rows: DataFrame, m: Fitted, cuts: np.ndarray) -> DataFrame:
    """(variant, cell, ones, zeros, wins, b): counts of both labels, pairs in order and squared errors inside each variant's cells of scores."""
    count, d, label = len(m.variants), len(m.features), np.array([v.label for v in m.variants])
    kind, names = "variant int, cell int, n1 int, p1 binary, n0 int, p0 binary, b double", ["variant", "cell", "n1", "p1", "n0", "p0", "b"]

    def block(index: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        p, made = _scores(index, x, m), []
        for g in range(count):
            there = ~np.isnan(p[:, g])
            v, one = p[there, g], y[there, g] == 1
            loss, sides = float(((v - one) ** 2).sum()), []
            for s in (one, ~one):
                side = np.sort(v[s])
                new = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]])) if len(side) else np.empty(0, np.int64)
                side, n = side[new], np.diff(np.append(new, len(side)))
                sides.append((side, n, np.concatenate([[0], np.searchsorted(side, cuts[g]), [len(side)]])))
            for c in range(cuts.shape[1] + 1):
                packed = [(side[e[c] : e[c + 1]], n[e[c] : e[c + 1]]) for side, n, e in sides]
                if len(packed[0][0]) or len(packed[1][0]):
                    made.append((g, c, *_sorted_bytes(*packed[0]), *_sorted_bytes(*packed[1]), loss))
                    loss = 0.0
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.float64()))], names)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, held, n = max(10_000, 4_000_000 // count), [], 0

        def out() -> Iterator[pa.RecordBatch]:
            yield from block(*[np.concatenate(a) for a in zip(*held, strict=True)])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("_i").to_numpy(), _matrix(batch.column("_x"), d), _labels(batch, m.cuts)[:, label]))
                n += batch.num_rows
            if n >= most:
                yield from out()
                held, n = [], 0
        if n:
            yield from out()

    def cell(t: pa.Table) -> pa.Table:
        (v1, n1), (v0, n0) = (_sorted_values(t.column(f"n{s}").to_pylist(), t.column(f"p{s}").to_pylist()) for s in (1, 0))
        order = np.argsort(v0)
        v0, below = v0[order], np.concatenate([[0.0], np.cumsum(n0[order])])
        wins = float(n1 @ (below[np.searchsorted(v0, v1)] + below[np.searchsorted(v0, v1, side="right")]) / 2)
        return pa.table({"variant": t.column("variant")[:1], "cell": t.column("cell")[:1], "ones": [float(n1.sum())], "zeros": [float(n0.sum())], "wins": [wins], "b": [float(np.sum(t.column("b").to_numpy()))]})

    return rows.select("_i", "_x", "_y").mapInArrow(part, kind).groupBy("variant", "cell").applyInArrow(cell, "variant int, cell int, ones double, zeros double, wins double, b double")


def figures(rows: DataFrame, m: Fitted) -> DataFrame:
    """(variant, auc, brier) over the test rows of all folds, scores of no value left out; ties of scores count half.

    A task gives out the scores of a block of rows as sorted arrays, for each variant, label and cell of its scores, equal scores counted.  A cell's arrays meet in one task, and
    cells are added up in order.  Where cells are cut comes from the scores of some 10,000 rows; it moves work only.  Variants go in turns, and the scores of a turn leave the disk with it.
    """
    count = len(m.variants)
    total = m.bounds[-1][1] + 1
    some = rows.where(F.col("_i") % max(1, total // _CUT_ROWS) == 0).select("_i", "_x").collect() if total > _CELL else []
    cells, cuts = -(-total // _CELL), np.empty((count, 0))
    if some:
        p = _scores(np.array([r["_i"] for r in some]), np.array([[np.nan if v is None else v for v in r["_x"]] for r in some]), m)
        cuts = np.sort(p, axis=0)[(np.arange(1, cells) * len(p)) // cells].T.copy()
    turn, each = max(_TURN_VARIANTS, _TURN_SCORES // max(total, 1)), None
    for g in range(0, count, turn):
        at = slice(g, g + turn)
        now = _cell_figures(rows, replace(m, variants=m.variants[at], beta=m.beta[:, :, at], share=m.share[:, at]), cuts[at])
        now = staged(now.withColumn("variant", F.col("variant") + g), "fit-figures")
        each = now if each is None else each.unionByName(now)
    below = F.coalesce(F.sum("zeros").over(Window.partitionBy("variant").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sums = each.withColumn("wins", F.col("wins") + F.col("ones") * below).groupBy("variant").agg(*[F.sum(c).alias(c) for c in ("ones", "zeros", "wins", "b")])
    name = F.array(*[F.lit(v.name) for v in m.variants])[F.col("variant")]
    auc = F.when(F.col("ones") * F.col("zeros") > 0, F.col("wins") / (F.col("ones") * F.col("zeros")))
    return sums.select(name.alias("variant"), auc.alias("auc"), (F.col("b") / (F.col("ones") + F.col("zeros"))).alias("brier"))


def shuffled_labels(df: DataFrame, y: str, index: str, replicates: int) -> DataFrame:
    """df with `labels`: the label, and `replicates` shuffles of it, each with just as many ones."""
    rows, cuts = with_draws(df.withColumn("_at", F.col(index).cast("long")), y, "_at", replicates, "labels")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                labels = drawn(b.column("labels"), b.column("_at").to_numpy(), cuts)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], _lists(labels.astype(np.int8))], [*kept, "labels"])

    kept, kinds = [c for c in df.columns if c != "labels"], dict(df.dtypes)
    return rows.mapInArrow(part, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", labels array<tinyint>")


def refit_shuffle(df: DataFrame, features: list[str], folds: int, embargo: int, replicates: int = 200, y: str = "y", index: str = "order_idx", strength: float = 0.01) -> DataFrame:
    """(trial, auc, brier): out-of-fold figures of the real labels (trial 0) and of models fitted anew on each shuffle of them."""
    base = packed_rows(df, features, F.array(y), index).select("_i", "_x", F.col("_y")[0].alias("_y"))
    rows, cuts = with_draws(base, "_y", "_i", replicates, "_y")
    m = fit_all(rows, features, [Variant(str(r), tuple(features), r) for r in range(replicates + 1)], folds, embargo, strength, cuts)
    return figures(rows, m).select(F.col("variant").cast("int").alias("trial"), "auc", "brier")


def refit_p_value(trials: DataFrame) -> DataFrame:
    """(auc, brier, shuffles, p_value): the share of shuffles whose AUC reaches the real one."""
    one = trials.agg(*[F.max(F.when(F.col("trial") == 0, F.col(c))).alias(f"_{c}") for c in ("auc", "brier")])
    each = trials.where("trial > 0").crossJoin(F.broadcast(one))  # one row
    return each.agg(F.first("_auc").alias("auc"), F.first("_brier").alias("brier"), F.count("*").alias("shuffles"), F.avg((F.col("auc") >= F.col("_auc")).cast("double")).alias("p_value"))


def coefficients(spark, m: Fitted) -> DataFrame:
    """(model, fold, rows, feature, value): standardized coefficients, `intercept` first; a constant's intercept is the log odds of its share, null for one class."""
    out = []
    for g, v in enumerate(m.variants):
        for k in range(len(m.bounds)):
            known = 0.0 < m.share[k, g] < 1.0
            named = [("intercept", 0), *[(c, 1 + m.features.index(c)) for c in v.features]]
            out += [(v.name, k, int(m.rows[k]), c, float(m.beta[k, j, g]) if known else None) for c, j in named]
    return spark.createDataFrame(out, "model string, fold int, rows long, feature string, value double")
