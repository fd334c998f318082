"""Near-duplicate embeddings by a pivot-permutation index.

1. Pivots are up to MOST_PIVOTS vectors of the table, taken by hash and far from each other; a table's size sets their number.
   A vector is described by its DEPTH nearest pivots, in order.
2. Inverted lists.  A list stands for a pair of pivots and holds the vectors that have both among their NEAREST ones, so two vectors meet in a list
   if they share at least two of these; each task names a vector once, however many copies it reads.  Lists of more than BLOCK entries are dealt to pairs of parts.
3. Shared-pivot counts.  In a list only pairs go on that share enough of their DEPTH pivots (LEAST_SHARED), and only in the first list that both stand in.
   What leaves the step is the entries that have such a partner, not the pairs.
4. Verifying.  Vectors come to the lists that still need them; a pair links if its cosine, in double precision, is at least 0.9.  A task returns
   how many vectors each one is linked to, and a star for each group that it found, so the rows that leave grow with the lists and not with the pairs in them.
5. Stars are joined to components.

The links found are links; some with a cosine close to 0.9 may be missed, since near vectors need not share pivots (`tests/llm` measures the recall on
pairs of cosine 0.9 to 0.93; above 0.95 nearly none is missed).  m different vectors that all stand in one list are compared in m^2 / 2 products.

Defined results: vectors that are null, empty, zero, or hold null, NaN or infinite entries link with nothing and are their own component.  A vector shorter than
the longest counts as if it ended in zeros.  Equal vectors are linked, repeated rows and repeated ids too; null ids are smallest nowhere, and a component of null
ids alone has a null id and keeps all of its rows.  Columns besides id and vector are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import give_back, packed, staged

LEAST_COSINE = 0.9
#: Pivots by how many of DEPTH a pair must share: fewer vectors share as many of a larger set, so that counts that unlike pairs seldom reach are lower there.
LEAST_SHARED = {128: 9, 256: 8, 512: 8, 1_024: 7}
#: A pivot for VECTORS_EACH vectors, as far as LEAST_SHARED goes; a pivot's id has PIVOT_BITS bits.
MOST_PIVOTS, VECTORS_EACH, PIVOT_BITS = 1_024, 100, 10
#: Nearest pivots whose pairs name lists; nearest pivots that are compared.
NEAREST, DEPTH = 6, 18
#: Two pivots' cosine is below this where the sample allows it.
APART = 0.5
#: Entries of a part of a list; pairs looked at in one go.
BLOCK, PAIRS = 1_024, 100_000
_PAIRS_OF = np.array(list(combinations(range(NEAREST), 2)))


def _whole(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v, f1, f2): v is null where the row links with nothing, else f1 and f2 are its digest."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    kind = dict(vectors.dtypes)[vec_col]
    rows = packed(vectors, id=F.col(id_col), v=F.col(vec_col) if kind == "array<float>" else F.col(vec_col).cast("array<double>")).drop("doc")
    ok = F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("v", F.when(ok, F.col("v")))
    return rows.withColumns({k: F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(seed), "v")) for k, seed in (("f1", 1), ("f2", 2))})


def _units(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors as rows, filled up with zeros; scaled first, so that no square is lost."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    if len(flat) == len(column) * dim:
        m = flat.reshape(-1, dim)
    else:
        m = np.zeros((len(column), dim))
        for k, part in enumerate(np.split(flat, ends[:-1])):
            m[k, : len(part)] = part
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def choose_pivots(rows: DataFrame, dim: int, count: int) -> np.ndarray:
    """count unit vectors: of 4 * count rows, the smallest by digest, those that are apart from the ones before; then random ones."""
    held = rows.orderBy("f1", "f2").select("v").limit(4 * count).toArrow().column("v").combine_chunks()
    sample = _units(held, dim) if len(held) else np.zeros((0, dim))
    chosen: list[np.ndarray] = []
    for u in sample:
        if len(chosen) < count and (not chosen or (np.array(chosen) @ u).max() < APART):
            chosen.append(u)
    more = np.random.default_rng(0).standard_normal((count - len(chosen), dim))
    return np.vstack([*chosen, more / np.linalg.norm(more, axis=1, keepdims=True)]) if chosen or len(more) else more


def _described(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The DEPTH nearest pivots of each row, nearest first; of equally near ones the first."""
    score = units @ pivots.T
    near = np.argpartition(-score, DEPTH, axis=1)[:, : DEPTH + 1]
    near.sort(axis=1)
    order = np.argsort(-np.take_along_axis(score, near, axis=1), axis=1, kind="stable")[:, :DEPTH]
    return np.take_along_axis(near, order, axis=1)


def _list_keys(described: np.ndarray) -> np.ndarray:
    """The lists of each row: pairs (a, b), a < b, of its NEAREST pivots, as a << PIVOT_BITS | b."""
    top = np.sort(described[:, :NEAREST], axis=1)
    return (top[:, _PAIRS_OF[:, 0]] << PIVOT_BITS) | top[:, _PAIRS_OF[:, 1]]


def _codes(described: np.ndarray) -> list[np.ndarray]:
    """The DEPTH pivots in three numbers, six of PIVOT_BITS bits each."""
    return [(described[:, k : k + 6] << np.arange(6) * PIVOT_BITS).sum(axis=1) for k in range(0, DEPTH, 6)]


def _decoded(codes: list[np.ndarray]) -> np.ndarray:
    return np.hstack([(q[:, None] >> np.arange(6) * PIVOT_BITS) & ((1 << PIVOT_BITS) - 1) for q in codes]).astype(np.int16)


def postings(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """(key, f1, f2, q1, q2, q3): a row for each list of each vector; a task names a vector once."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            f1, f2 = (b.column(c).to_numpy() for c in ("f1", "f2"))
            new = [k for k, f in enumerate(zip(f1.tolist(), f2.tolist(), strict=True)) if f not in seen and not seen.add(f)]
            if not new:
                continue
            d = _described(_units(b.column("v").take(pa.array(new)), pivots.shape[1]), pivots)
            cols = [_list_keys(d).ravel(), *(np.repeat(x, len(_PAIRS_OF)) for x in (f1[new], f2[new], *_codes(d)))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["key", "f1", "f2", "q1", "q2", "q3"])

    return rows.select("v", "f1", "f2").mapInArrow(name, "key long, f1 long, f2 long, q1 long, q2 long, q3 long")


def _dealt(entries: DataFrame, long_lists: DataFrame) -> DataFrame:
    """entries with (p, i, j): their part of the list, and each pair of parts that it belongs to.  There are at most MOST_PIVOTS^2 / 2 lists, so tasks get the long ones by broadcast."""
    entries = entries.join(F.broadcast(long_lists), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    entries = entries.withColumn("p", F.pmod("f2", "parts").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return entries.withColumns({"i": F.least("p", "o").cast("int"), "j": F.greatest("p", "o").cast("int")}).drop("parts", "o")


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 20_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups (key, i, j), which come sorted, with the row where each group starts."""
    held: list[pa.RecordBatch] = []

    def starts_of(t: pa.Table) -> np.ndarray:
        cols = [t.column(c).to_numpy() for c in ("key", "i", "j")]
        return np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)])

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            t = pa.Table.from_batches(held)
            starts = starts_of(t)
            if len(starts) > 1:
                yield t.slice(0, starts[-1]), starts[:-1]
                held = t.slice(starts[-1]).combine_chunks().to_batches()
    if held:
        t = pa.Table.from_batches(held)
        yield t, starts_of(t)


def _pairs(starts: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (left, right) of all pairs inside groups, some PAIRS at a time."""
    ends = np.r_[starts[1:], n]
    after = np.repeat(ends, ends - starts) - np.arange(n) - 1  # partners that come later in the group
    upto = np.cumsum(after)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, side="right")))
        left = np.repeat(np.arange(at, to), after[at:to])
        first = np.repeat(np.cumsum(after[at:to]) - after[at:to], after[at:to])
        yield left, left + 1 + np.arange(len(left)) - first
        at = to


def _is_first_list(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether key is the first list of those that rows of nearest pivots a and b share."""
    low, high = key >> PIVOT_BITS, key & ((1 << PIVOT_BITS) - 1)
    common = (a[:, :, None] == b[:, None, :]).any(axis=2)
    return (common & (a < high[:, None]) & (a != low[:, None])).sum(axis=1) == 0


def _with_partners(batches: Iterator[pa.RecordBatch], shared: int) -> Iterator[pa.RecordBatch]:
    """The entries that share `shared` pivots with another one of their list and part pair."""
    for t, starts in _whole_groups(batches):
        n = t.num_rows
        key, f1, f2, p, i, j = (t.column(c).to_numpy() for c in ("key", "f1", "f2", "p", "i", "j"))
        d = _decoded([t.column(c).to_numpy() for c in ("q1", "q2", "q3")])
        needed = np.zeros(n, bool)
        for left, right in _pairs(starts, n):
            keep = ((f1[left] != f1[right]) | (f2[left] != f2[right])) & ((i[left] == j[left]) | (p[left] != p[right]))
            left, right = left[keep], right[keep]
            keep = (d[left][:, :, None] == d[right][:, None, :]).sum(axis=(1, 2)) >= shared
            left, right = left[keep], right[keep]
            keep = _is_first_list(d[left][:, :NEAREST], d[right][:, :NEAREST], key[left])
            needed[left[keep]] = needed[right[keep]] = True
        if needed.any():
            yield t.select(["key", "i", "j", "p", "f1", "f2"]).filter(pa.array(needed)).combine_chunks().to_batches()[0]
    give_back()


def _stars(linked: np.ndarray) -> np.ndarray:
    """The smallest row that each row of a symmetric link matrix reaches."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verified(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, least: float) -> Iterator[pa.RecordBatch]:
    """(f1, f2, g1, g2, links): for each entry the vectors it links to in this list and part pair, copies counted, and its star's middle."""
    for t, starts in _whole_groups(batches, 2_000):
        units = _units(t.column("v").combine_chunks(), pivots.shape[1])
        key, f1, f2, p, i, j, n = (t.column(c).to_numpy() for c in ("key", "f1", "f2", "p", "i", "j", "n"))
        d = _described(units, pivots)[:, :NEAREST]
        for s, e in zip(starts, np.r_[starts[1:], len(units)], strict=True):
            _, once = np.unique(np.stack([f1[s:e], f2[s:e]]), axis=1, return_index=True)
            at = s + np.sort(once)
            close = np.triu(units[at] @ units[at].T >= least, 1)
            left, right = np.nonzero(close)
            a, b = at[left], at[right]
            keep = ((i[a] == j[a]) | (p[a] != p[b])) & _is_first_list(d[a], d[b], key[a])
            left, right = left[keep], right[keep]
            if not len(left):
                continue
            linked = np.zeros((len(at), len(at)), bool)
            linked[left, right] = linked[right, left] = True
            links, middle = linked @ n[at], at[_stars(linked)]
            has = linked.any(axis=1)
            cols = [f1[at][has], f2[at][has], f1[middle][has], f2[middle][has], links[has]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["f1", "f2", "g1", "g2", "links"])
    give_back()


def _node(x: str, y: str):
    return F.concat_ws(":", F.col(x).cast("string"), F.col(y).cast("string"))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = LEAST_COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) for each row."""
    every = _whole(vectors, id_col, vec_col)
    rows = every.where("v is not null")
    # a class is all rows of one vector; its vector moves once for each task that has it
    stats = staged(rows.groupBy("f1", "f2").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.max(F.size("v")).alias("dim")), "vector-classes")
    count, dim = stats.agg(F.count("*"), F.max("dim")).first()
    if count:
        linked = staged(_links(rows, dim, next((p for p in LEAST_SHARED if p * VECTORS_EACH >= count), MOST_PIVOTS), least), "vector-links")
        degrees = linked.groupBy("f1", "f2").agg(F.sum("links").alias("links"))
        labels = connected_components(linked.select(_node("f1", "f2").alias("a"), _node("g1", "g2").alias("b")))
        named = stats.withColumn("node", _node("f1", "f2")).join(labels, "node")
        named = named.join(named.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("f1", "f2", "component_id")
        stats = stats.join(degrees, ["f1", "f2"], "left").join(named, ["f1", "f2"], "left")
        stats = stats.select("f1", "f2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    else:
        stats = stats.select("f1", "f2", F.col("n").alias("n_links"), F.col("least").alias("component_id"))
    found = rows.select("id", "f1", "f2").join(stats, ["f1", "f2"]).select("id", "n_links", "component_id")
    alone = every.where("v is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = found.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(rows: DataFrame, dim: int, count: int, least: float) -> DataFrame:
    pivots = choose_pivots(rows, dim, count)
    entries = postings(rows, pivots)
    lists = entries.groupBy("key").count().where(F.col("count") > BLOCK)
    long_lists = staged(lists.select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("parts")), "long-lists")
    dealt = _dealt(entries, long_lists).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    needs = staged(dealt.mapInArrow(lambda it: _with_partners(it, LEAST_SHARED[count]), "key long, i int, j int, p int, f1 long, f2 long").distinct(), "vector-needs")
    needed = needs.select("f1", "f2").distinct()
    whole = rows.join(needed, ["f1", "f2"], "left_semi").groupBy("f1", "f2").agg(F.first("v").alias("v"), F.count("*").alias("n"))
    met = needs.join(whole, ["f1", "f2"]).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return met.mapInArrow(lambda it: _verified(it, pivots, least), "f1 long, f2 long, g1 long, g2 long, links long")
