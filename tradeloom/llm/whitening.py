"""Whitening of embeddings from a blockwise QR and a bidiagonal qd solver.

1. Entries become long x = floor(64 * entry) + 1000000.  The fit list is each distinct vector x once; its size n and sums S are exact.
2. Blockwise QR.  Each task reduces its centred rows (n * x - S) / n, block after block, to one triangle R of d rows; triangles
   meet FAN at a time until one is left.  V = R'R / n is never formed, so no digits are lost by squaring.
3. The triangle, d x d whatever the table's size, is solved by the driver: Householder reflections make it bidiagonal, dqds finds the
   squared singular values to high relative accuracy, a twisted factorization for each gives its vector, and vectors of close values
   are found by inverse iteration against those before them.
4. Every row is projected by the first components, in tasks; the covariance of what comes out is summed over the fit list.

Defined results: rows whose vector is null or holds null, NaN or infinite entries go; so do vectors of another length than the most common
(of equally common ones the longest), which have no place in one covariance.  Repeated rows come out once for each row, null ids as they are.  x is held
within +-2^53.  Where fewer than `components` eigenvalues are above 1e-13 of the largest, only those have components (a table of one
distinct vector has none).  A deviation beyond a long is null.  Columns besides id and vector are ignored, whatever their names.  An empty table gives an
empty result.  A component's sign: its largest entry is positive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import packed, staged

COMPONENTS = 16
SCALE, SHIFT, MOST = 64, 1_000_000, 1 << 53
#: Rows of a block; triangles that meet in one task.
BLOCK_ROWS, FAN = 4_096, 16
#: Eigenvalues below this part of the largest have no component.
LEAST_SHARE = 1e-13
#: Neighbours closer than this part of their size are orthogonalized against each other.
CLOSE = 1e-3
_EPS = np.finfo(float).eps


def whole_entries(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, x) of the rows whose vector is whole and of the common length."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = packed(vectors, id=F.col(id_col), v=F.col(vec_col).cast("array<double>")).select("id", "v").where(F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", fine))
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    whole = lambda c: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c * SCALE))
    return rows.where(F.size("v") == (lengths["d"] if lengths else 0)).select("id", F.transform("v", lambda c: F.floor(whole(c)) + SHIFT).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S / n: the difference n * x - S is exact where it fits a long, and in the digits of S / n beyond."""
    if float(np.abs(x).max(initial=0)) * n < 2**62:
        return (n * x - sums) / n
    low = sums // n
    return (x - low).astype(float) - (sums - low * n).astype(float) / n


def _triangles(batches: Iterator[pa.RecordBatch], centred) -> Iterator[pa.RecordBatch]:
    """The triangle of all rows of a task, as rows (part, row, r)."""
    held, waiting, rows = None, [], 0
    reduce = lambda parts: np.linalg.qr(np.vstack(parts), mode="r")
    part = 0
    for b in batches:
        if b.num_rows:
            part = b.column("part")[0].as_py()
            waiting.append(centred(_matrix(b.column("r"))))
            rows += b.num_rows
        if rows >= BLOCK_ROWS:
            held, waiting, rows = reduce(([] if held is None else [held]) + waiting), [], 0
    if waiting:
        held = reduce(([] if held is None else [held]) + waiting)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([part] * len(held), pa.int32()), pa.array(list(held), pa.list_(pa.float64()))], ["part", "r"])


def triangle(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the fit list's centred rows; the rows of a level's triangles are d for each task, and the last level has one task of FAN * d rows at most."""
    s = np.array(sums, dtype=np.int64 if max(map(abs, sums)) < 2**62 else object)
    parts = fit.rdd.getNumPartitions()
    level = fit.select(F.spark_partition_id().alias("part"), F.col("x").alias("r")).mapInArrow(lambda it: _triangles(it, lambda x: _centred(x, n, s)), "part int, r array<double>")
    while parts > 1:
        parts = -(-parts // FAN)
        level = level.repartition(parts, F.floor(F.col("part") / FAN)).withColumn("part", F.floor(F.col("part") / FAN).cast("int"))
        level = level.sortWithinPartitions("part").mapInArrow(_by_part, "part int, r array<double>")
    rows = [r["r"] for r in level.collect()]
    return np.linalg.qr(np.array(rows), mode="r")


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One triangle for each part of the level above; the parts of a task come one after another."""
    held: dict[int, list[np.ndarray]] = {}
    for b in batches:
        part = b.column("part").to_numpy()
        m = _matrix(b.column("r"))
        for p in np.unique(part):
            held.setdefault(int(p), []).append(m[part == p])
            done = [q for q in held if q < p]
            for q in done:
                yield _as_rows(q, held.pop(q))
    for q in list(held):
        yield _as_rows(q, held.pop(q))


def _as_rows(part: int, blocks: list[np.ndarray]) -> pa.RecordBatch:
    r = np.linalg.qr(np.vstack(blocks), mode="r")
    return pa.RecordBatch.from_arrays([pa.array([part] * len(r), pa.int32()), pa.array(list(r), pa.list_(pa.float64()))], ["part", "r"])


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, upper diagonal, W) with r = U B W' by Householder reflections from both sides."""
    a = np.zeros((r.shape[1], r.shape[1]))
    a[: len(r)] = r
    d = len(a)
    w = np.eye(d)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        size = np.linalg.norm(x)
        if size == 0:
            return None
        v = x / size
        v[0] += math.copysign(1.0, v[0])
        return v / np.linalg.norm(v)

    for k in range(d):
        if (v := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k < d - 2 and (v := reflector(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, falling.

    Each pass is a differential qd transform shifted by less than the smallest value, so that all quantities stay positive; a shift that is too large
    shows by a negative one and is taken back.  Where an off-diagonal quantity has vanished the array is cut there.
    """
    found: list[float] = []
    todo = [(list(map(float, diagonal**2)), list(map(float, upper**2)), 0.0)]
    while todo:
        q, e, sigma = todo.pop()
        guess = 0.0
        while len(q) > 1:
            least = _EPS * _EPS
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= least * (sigma + q[k]) or e[k] <= least * (sigma + q[k + 1])), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], sigma))
                q, e, guess = q[cut + 1 :], e[cut + 1 :], 0.0
                continue
            if q[-1] == 0 or any(x == 0 for x in q):
                guess = 0.0
            shift = guess
            while (step := _qd_step(q, e, shift)) is None:
                shift = shift / 4 if shift > 1e-3 * guess else 0.0
            q, e, low = step
            sigma += shift
            guess = low if low > 0 else 0.0
            guess *= 1 - min(0.5, 2 * math.sqrt(e[-1] / (q[-1] + e[-1]))) if q[-1] + e[-1] > 0 else 0.0
        found += [x + sigma for x in q]
    return np.sort(np.maximum(np.array(found), 0.0))[::-1]


def _qd_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One transform; the least of the differential quantities bounds what the next shift may be.  None if the shift was too large."""
    d = q[0] - shift
    low, new_q, new_e = d, [], []
    for k, off in enumerate(e):
        if d < 0:
            return None
        top = d + off
        new_q.append(top)
        if top == 0:
            ratio, d = 0.0, q[k + 1] - shift
        else:
            ratio = q[k + 1] / top
            d = d * ratio - shift
        new_e.append(off * ratio)
        low = min(low, d)
    if d < 0:
        return None
    return [*new_q, d], new_e, low


def twisted(diagonal: np.ndarray, upper: np.ndarray, value: float) -> np.ndarray:
    """Unit vector of B'B at an eigenvalue: factor B'B - value from the top and from the bottom, twist where the remainder is least."""
    d = len(diagonal)
    main = diagonal**2
    main[1:] += upper**2
    off = diagonal[:-1] * upper
    tiny = _EPS * max(float(main.max(initial=0.0)), np.finfo(float).tiny)
    down, up = np.empty(d), np.empty(d)
    safe = lambda x: x if abs(x) > tiny else math.copysign(tiny, x)
    down[0], up[-1] = main[0] - value, main[-1] - value
    for k in range(1, d):
        down[k] = main[k] - value - off[k - 1] ** 2 / safe(down[k - 1])
    for k in range(d - 2, -1, -1):
        up[k] = main[k] - value - off[k] ** 2 / safe(up[k + 1])
    at = int(np.argmin(np.abs(down + up - (main - value))))
    z = np.zeros(d)
    z[at] = 1.0
    for k in range(at - 1, -1, -1):
        z[k] = -off[k] * z[k + 1] / safe(down[k])
    for k in range(at + 1, d):
        z[k] = -off[k - 1] * z[k - 1] / safe(up[k])
    return z / np.linalg.norm(z)


def _inverse_iteration(diagonal: np.ndarray, upper: np.ndarray, value: float, z: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
    """z made an eigenvector that stands upright on those of close values found before it."""
    main = diagonal**2
    main[1:] += upper**2
    t = np.diag(main) + np.diag(diagonal[:-1] * upper, 1) + np.diag(diagonal[:-1] * upper, -1)
    shifted = t - (value + _EPS * max(value, float(main.max()) * _EPS)) * np.eye(len(main))
    shifted += np.diag(np.where(np.diag(shifted) == 0, _EPS * main.max(), 0.0))
    for _ in range(3):
        for _ in range(2):
            for y in before:
                z = z - (y @ z) * y
        z = z / np.linalg.norm(z)
        try:
            z = np.linalg.solve(shifted, z)
        except np.linalg.LinAlgError:
            z = np.linalg.lstsq(shifted + 4 * _EPS * main.max() * np.eye(len(main)), z, rcond=None)[0]
        z = z / np.linalg.norm(z)
    for _ in range(2):
        for y in before:
            z = z - (y @ z) * y
    return z / np.linalg.norm(z)


def principal(r: np.ndarray, n: int, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, float]:
    """(vectors as columns, eigenvalues of R'R / n, trace) of the largest components."""
    diagonal, upper, w = bidiagonal(r)
    size = max(float(np.abs(diagonal).max(initial=0.0)), float(np.abs(upper).max(initial=0.0)))
    if size == 0:
        return np.zeros((r.shape[1], 0)), np.zeros(0), 0.0
    diagonal, upper = diagonal / size, upper / size
    values = dqds(diagonal, upper)
    kept = values[: min(components, len(values))]
    kept = kept[kept > LEAST_SHARE * values[0]]
    rng = np.random.default_rng(0)
    vectors: list[np.ndarray] = []
    for k, value in enumerate(kept):
        close = [vectors[j] for j in range(k) if kept[j] - value <= CLOSE * kept[j]]
        z = twisted(diagonal, upper, value) if not close else rng.standard_normal(len(diagonal))
        vectors.append(_inverse_iteration(diagonal, upper, value, z, close))
    basis = w @ np.array(vectors).T
    basis *= np.sign(basis[np.abs(basis).argmax(axis=0), range(basis.shape[1])])
    return basis, kept * size**2 / n, float((r**2).sum()) / n


def _projected(x: np.ndarray, n: int, sums: np.ndarray, basis: np.ndarray, values: np.ndarray) -> np.ndarray:
    return _centred(x, n, sums) @ basis / np.sqrt(values)


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum of (n x - S)^2 in whole numbers; null beyond a long."""
    far = float(n) * (np.abs(x).max(initial=0) + 1) + float(max(map(abs, sums), default=0))
    if far < 2**62:
        apart = n * x - sums
        if float((apart.astype(float) ** 2).sum(axis=1).max(initial=0)) < 2**62:
            return pa.array((apart * apart).sum(axis=1), pa.int64())
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    return pa.array([v if v < 2**63 else None for v in exact], pa.int64())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row for each whole vector and component."""
    spark = vectors.sparkSession
    rows = whole_entries(vectors, id_col, vec_col)
    fit = staged(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "whitening-fit")
    id_type = vectors.schema[id_col].dataType.simpleString()
    schema = f"id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    each = fit.select(F.posexplode("x").alias("j", "x")).groupBy("j").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).orderBy("j").collect()
    if not each:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    n, sums = each[0]["n"], [int(r["s"]) for r in each]
    basis, values, trace = principal(triangle(fit, n, sums), n, components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    s = np.array(sums, dtype=np.int64 if max(map(abs, sums)) < 2**62 else object)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            if b.num_rows:
                y = _projected(_matrix(b.column("x")), n, s, basis, values)
                total[0] += y.sum(axis=0)
                total[1:] += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["at", "v"])

    summed = fit.mapInArrow(moments, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    total = np.array([r["v"] for r in summed]).reshape(k + 1, k)
    mean = total[0] / n
    error = float(np.abs(total[1:] / n - np.outer(mean, mean) - np.eye(k)).max())
    share = values / trace

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("x"))
            y, m = _projected(x, n, s, basis, values), b.num_rows
            again = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays([
                b.column("id").take(again), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, dtype=np.int64)), _deviations(x, n, s).take(again),
                pa.array(y.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
            ], ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(projected, schema).withColumnRenamed("id", id_col)
