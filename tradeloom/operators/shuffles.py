"""Shuffles of labels: a row's place in a replicate is 60 bits of MD5 over key and replicate, and the k first places get label 1."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Places are below 2^60.
PLACES = 1 << 60
# MD5's additive constants and rotations (RFC 1321).
_ADD = [np.array(int(abs(math.sin(i + 1)) * 2**32), np.uint32) for i in range(64)]
_TURN = [np.array(s, np.uint32) for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_BACK = [np.array(32 - int(s), np.uint32) for s in _TURN]
_ROWS = 10_000


def prefix(key: str):
    """What stands before the replicate in the hashed text; as in `row_hash`, an unknown key leaves no colon."""
    return F.coalesce(F.concat(F.col(key).cast("string"), F.lit(":")), F.lit(""))


def _digests(words: list) -> np.ndarray:
    """First 60 bits of the MD5 of one-block messages, given by their sixteen words (arrays, or one number for all)."""
    start = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    n = next(len(w) for w in words if w.ndim)
    a, b, c, d = (np.full(n, x) for x in start)
    f, turned = np.empty_like(a), np.empty_like(a)
    for i in range(64):  # in place: the arrays of a block stay in the cache
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            g = 7 * i % 16
        f += a
        f += _ADD[i]
        if words[g].ndim or words[g]:
            f += words[g]
        np.left_shift(f, _TURN[i], out=turned)
        f >>= _BACK[i]
        turned |= f
        turned += b
        a, d, c, b, turned = d, c, b, turned, a
    a += start[0]
    b += start[1]
    return ((a.byteswap().astype(np.uint64) << np.uint64(32)) | b.byteswap()) >> np.uint64(4)


class Places:
    """Places of rows with the given prefixes in any replicate; texts of one length are hashed together."""

    def __init__(self, prefixes: pa.Array):
        self.n, texts = len(prefixes), [t.encode() for t in prefixes.to_pylist()]
        lengths = np.array([len(t) for t in texts], np.int64)
        self.long = [(i, texts[i]) for i in np.flatnonzero(lengths > 40)]
        self.groups = []
        for size in np.unique(lengths[lengths <= 40]):
            at = np.flatnonzero(lengths == size)
            block = np.zeros((len(at), 64), np.uint8)
            if size:
                block[:, :size] = np.frombuffer(b"".join(texts[i] for i in at), np.uint8).reshape(len(at), size)
            self.groups.append((at, int(size), np.ascontiguousarray(block.view("<u4").T)))

    def of(self, rep: int) -> np.ndarray:
        out, tail = np.empty(self.n, np.int64), str(rep).encode()
        for at, size, block in self.groups:
            end = np.zeros(64, np.uint8)
            end[size : size + len(tail) + 1] = list(tail + b"\x80")
            end[56:] = list((8 * (size + len(tail))).to_bytes(8, "little"))
            end = end.view("<u4")
            words = [block[g] | end[g] if g == 0 or 4 * g < size else np.array(end[g]) for g in range(16)]
            out[at] = _digests(words)
        for i, text in self.long:
            out[i] = int(hashlib.md5(text + tail).hexdigest()[:15], 16)
        return out


def kth_places(rows: DataFrame, key: str, r: str, replicates: int, n: int, k: int) -> DataFrame:
    """(rep, h, key, s1): the k-th place of each replicate, its row's key, and the sum of r over the first k places; rows of one place go by key.

    Hashes are uniform, so the k-th of n lies within eight deviations of k / n of all places: a task adds up what lies before and gives out only the rows in between.
    Where that fails for a replicate, all rows are given out.
    """
    share = k / n if n else 0.0
    kind = dict(rows.dtypes)[key]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.col(key), prefix(key).alias("_prefix"), F.col(r).cast("double").alias("_r")).repartition(parts).sortWithinPartitions(F.length("_prefix"))  # each row is hashed `replicates` times, with those of its length
    for lo, hi in _near(share, n):

        def part(batches: Iterator[pa.RecordBatch], lo: int = lo, hi: int = hi) -> Iterator[pa.RecordBatch]:
            ahead = np.zeros((replicates, 2))
            for b in batches:
                for i in range(0, b.num_rows, _ROWS):
                    some = b.slice(i, _ROWS)
                    places, value = Places(some.column("_prefix")), some.column("_r").to_numpy()
                    reps, hs, at = [], [], []
                    for rep in range(1, replicates + 1):
                        h = places.of(rep)
                        before = h < lo
                        ahead[rep - 1] += before.sum(), value[before].sum()
                        inside = np.flatnonzero(~before & (h < hi))
                        reps.append(np.full(len(inside), rep, np.int32))
                        hs.append(h[inside])
                        at.append(inside)
                    take = pa.array(np.concatenate(at))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(reps)), pa.array(np.concatenate(hs)), some.column(key).take(take), some.column("_r").take(take), pa.nulls(len(take), pa.int64())], ["rep", "h", key, "r", "n"])
            none = pa.nulls(replicates, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, replicates + 1), pa.int32()), none, pa.nulls(replicates, key_type), pa.array(ahead[:, 1]), pa.array(ahead[:, 0].astype(np.int64))], ["rep", "h", key, "r", "n"])

        key_type = pa.string() if kind == "string" else {"bigint": pa.int64(), "int": pa.int32()}[kind]
        found = staged(dealt.mapInArrow(part, f"rep int, h long, `{key}` {kind}, r double, n long"), "shuffle-places")
        cuts = _kth(found, key, k)
        if k <= 0 or cuts.count() == replicates:
            break
    return cuts


def _kth(found: DataFrame, key: str, k: int) -> DataFrame:
    """(rep, h, key, s1) from rows near the k-th place (n null) and the counts and sums before them."""
    ahead = found.where("n is not null").groupBy("rep").agg(F.sum("n").alias("_n"), F.sum("r").alias("_before"))  # a row a replicate
    w = Window.partitionBy("rep").orderBy("h", key).rowsBetween(Window.unboundedPreceding, 0)
    placed = found.where("n is null").withColumns({"_place": F.row_number().over(Window.partitionBy("rep").orderBy("h", key)), "_sum": F.sum("r").over(w)})
    return staged(placed.join(F.broadcast(ahead), "rep").where(F.col("_place") == k - F.col("_n")).select("rep", "h", key, (F.col("_before") + F.col("_sum")).alias("s1")), "shuffle-cuts")


def _near(share: float, n: int) -> tuple[tuple[int, int], ...]:
    """Bounds that the k-th of n uniform places lies within, eight deviations on either side; then all places."""
    reach = 8 * math.sqrt(share * (1 - share) / max(n, 1)) + 64 / max(n, 1)
    return tuple((max(0, int((share - r) * PLACES)), min(PLACES, int((share + r) * PLACES))) for r in (reach, 1.0))


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of the bytes of values, cut at ends."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, and the length of each row's."""
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], np.diff(ends)


#: A replicate in which a row lies near the k-th place, and its place.
_OPEN = np.dtype([("rep", "<u4"), ("h", "<i8")])


def drawn(column: pa.Array, keys: np.ndarray, cuts: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """rows x labels (the real one first) of a column that `with_draws` made, by the last place and key that each replicate takes."""
    if not len(column):
        return np.zeros((0, len(cuts[0])), np.uint8)
    labels = np.unpackbits(_bytes(column.field("bits"))[0].reshape(len(column), -1), axis=1, count=len(cuts[0]))
    left, sizes = _bytes(column.field("left"))
    left, at = left.view(_OPEN), np.repeat(np.arange(len(column)), sizes // _OPEN.itemsize)
    last, key = (c[left["rep"]] for c in cuts)
    labels[at, left["rep"]] = (left["h"] < last) | ((left["h"] == last) & (keys[at] <= key))
    return labels


def with_draws(rows: DataFrame, y: str, key: str, replicates: int, name: str) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray]]:
    """Staged rows with the label and `replicates` shuffles of it in column `name`, and what `drawn` needs to read it.

    A shuffle gives label 1 to the rows of the k first places.  Each place is hashed once: far from the k-th place it decides the label, which is kept as a bit; the places near it are
    kept as they are, and the k-th one is found among them.  Where that fails for a replicate, all places are kept.
    """
    n, k = rows.agg(F.count("*"), F.sum(y)).first()  # one row
    k = int(k or 0)
    kept, kinds = [c for c in rows.columns if c != name], dict(rows.dtypes)
    dealt = rows.select(*kept, F.col(y).cast("tinyint").alias("_one"), prefix(key).alias("_prefix"))
    kind = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", `{name}` struct<bits: binary, left: binary>"
    for lo, hi in _near(k / n if n else 0.0, n):

        def part(batches: Iterator[pa.RecordBatch], lo: int = lo, hi: int = hi) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, _ROWS):
                    some = b.slice(i, _ROWS)
                    places, labels = Places(some.column("_prefix")), np.zeros((replicates + 1, some.num_rows), np.uint8)
                    labels[0] = some.column("_one").to_numpy(zero_copy_only=False)
                    near = []
                    for rep in range(1, replicates + 1):
                        h = places.of(rep)
                        labels[rep] = h < lo
                        at = np.flatnonzero((h >= lo) & (h < hi))
                        left = np.empty(len(at), _OPEN)
                        left["rep"], left["h"] = rep, h[at]
                        near.append((at, left))
                    at = np.concatenate([a for a, _ in near])
                    left = np.concatenate([x for _, x in near])[np.argsort(at, kind="stable")]
                    bits, sizes = np.packbits(labels, axis=0).T, np.bincount(at, minlength=some.num_rows) * _OPEN.itemsize
                    made = pa.StructArray.from_arrays([_packed(bits, np.arange(1, some.num_rows + 1) * bits.shape[1]), _packed(left, np.cumsum(sizes))], ["bits", "left"])
                    yield pa.RecordBatch.from_arrays([*[some.column(c) for c in kept], made], [*kept, name])

        def near_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ahead, names = np.zeros(replicates + 1, np.int64), ["rep", "h", key, "r", "n"]
            for b in batches:
                if not b.num_rows:
                    continue
                column, keys = b.column(name), b.column(key).to_numpy()
                ahead += np.unpackbits(_bytes(column.field("bits"))[0].reshape(len(column), -1), axis=1, count=replicates + 1).sum(axis=0, dtype=np.int64)
                left, sizes = _bytes(column.field("left"))
                left, at = left.view(_OPEN), np.repeat(np.arange(len(column)), sizes // _OPEN.itemsize)
                yield pa.RecordBatch.from_arrays([pa.array(left["rep"].astype(np.int32)), pa.array(left["h"].copy()), pa.array(keys[at]), pa.array(np.zeros(len(at))), pa.nulls(len(at), pa.int64())], names)
            none = pa.nulls(replicates, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, replicates + 1), pa.int32()), none, none, pa.array(np.zeros(replicates)), pa.array(ahead[1:])], names)

        out = staged(dealt.mapInArrow(part, kind), "fit-shuffles")
        cuts = np.full(replicates + 1, -1, np.int64), np.full(replicates + 1, -1, np.int64)
        if k <= 0:
            break
        found = staged(out.select(key, name).mapInArrow(near_places, f"rep int, h long, `{key}` long, r double, n long"), "shuffle-places")
        known = _kth(found, key, k).collect()  # one row a replicate
        for r in known:
            cuts[0][r["rep"]], cuts[1][r["rep"]] = r["h"], r[key]
        if len(known) == replicates:
            break
    return out, cuts
