"""N-gram Jaccard self-join with set-relation skipping.

A row's set is its distinct word n-grams, as 64-bit hashes (a set's identity is 128 bits over them).  Rows of equal sets
are one set from the start.  Two sets link when 100 * intersection >= percent * union; the result is exact up to
collisions of these hashes.

Prefix index.  Under one order of all tokens, rare ones first, linked sets share a token among the first few positions of
both; the number follows from the set's size, and is smaller for the set that is not the larger of the two.

1. Candidates.  Document frequencies of one in `counted_every` tokens (by hash; a sixth at 90 %) order these before all others.  A set whose prefix
   holds only tokens of its own links with nothing.  The rest, mostly copies, go on with their whole sets.
2. Index lists.  Frequencies of all tokens of the candidates give the full order; each token's list holds the sets with
   this token in their prefix, by position.  Lists are cut into blocks by position, and pairs of blocks whose positions leave too few
   tokens to overlap are skipped whole.  Within a pair of blocks, positions, sizes and parity bitmaps (whose distance never
   exceeds the sets' difference) leave out what cannot link.
3. Answers.  A set's answer comes first from the most similar set before it in its part of the list: one edge for each set, not all
   pairs of a group; two pivots of each list visit all its parts.  Edges are verified on the whole sets, and what they connect shares
   its answer from then on: the second pass looks only at pairs of different components, all of which it verifies, and sets of a list's
   largest component meet only those outside of it.

No list or group is capped: long lists become many parts, which are spread over tasks.

Defined results: null or empty text, or only white space: an empty set, linked with nothing, each row its own component.  Fewer
words than n: the whole sequence is the one n-gram.  Repeated rows and ids get one result each; a null id never is a component's
id unless all its ids are null.  Columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import SALTS, digest_of, give_back, kept_rows, staged, whole_text

#: Sets of a list that are compared at once.
BLOCK = 1_000
CHUNK_BYTES = 2_000_000
#: Bits of a set's parity bitmap.
BITS = 512
#: Consecutive sets of a list that are skipped together.
SKIPPED = 128
#: Sets of a part that are compared as a whole with each pivot of another part.
OF_PIVOT = 3
#: Pairs that are looked at at once.
PAIRS = 500_000
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = _mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_SPACE = np.isin(np.arange(256), [0x20, *range(9, 14)])
_BASE = 0xD6E8FEB86659FD93


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, _BASE, dtype=_U)
    down = np.full(n + 1, pow(_BASE, -1, 1 << 64), dtype=_U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def shingle_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text (A-Z lower-cased, words between ASCII white space)."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join([b"", *raw, b""]), dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw])
    space = _SPACE[data]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    stop = np.flatnonzero(~space[:-1] & space[1:]) + 1
    up, down = _powers(len(data))
    total = np.concatenate((np.zeros(1, dtype=_U), np.add.accumulate(_BYTE[data] * up[:-1])))
    word = _mix((total[stop] - total[start]) * down[start] + (stop - start).astype(_U))
    factor = _mix(np.arange(101, 101 + n, dtype=_U))
    first = np.searchsorted(start, np.concatenate(([0], ends)))
    gram = np.zeros(max(0, len(word) - n + 1), dtype=_U)
    for k in range(n):
        gram += word[k : k + len(gram)] * factor[k]
    gram = _mix(gram)
    out = []
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= n:
            out.append(np.unique(gram[lo : hi - n + 1]))
        elif hi > lo:
            out.append(_mix(np.array([np.add.reduce(word[lo:hi] * factor[: hi - lo]) + _U(hi - lo)], dtype=_U)))
        else:
            out.append(np.zeros(0, dtype=_U))
    return out


def _identity(s: np.ndarray) -> bytes:
    return np.array([np.add.reduce(_mix(s ^ _U(0x5851F42D4C957F2D))), np.add.reduce(_mix(s + _U(0x14057B7EF767814F)))], dtype=_U).tobytes()


def parity_bitmap(s: np.ndarray) -> bytes:
    """Bit b is the parity of the tokens that fall on b, so two bitmaps differ in no more bits than their sets in tokens."""
    return np.packbits(np.bincount((s >> _U(20)).astype(np.int64) % BITS, minlength=BITS).astype(np.uint8) & 1).tobytes()


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    flat = np.concatenate([*arrays, np.zeros(0, dtype=_U)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(a) for a in arrays]).astype(np.int32)), pa.array(flat))


def counted_every(percent: int) -> int:
    """One token in so many is counted to find the candidates: well more tokens than a prefix has."""
    return max(1, 60 // max(1, 100 - percent))


def probe_length(n: Column, percent: int) -> Column:
    """Prefix of a set that meets smaller or equal ones: n - ceil(percent * n / 100) + 1."""
    return n - F.expr(f"({percent} * n + 99) div 100") + 1


def index_length(n: Column, percent: int) -> Column:
    """Prefix of a set that meets larger or equal ones."""
    return n - F.expr(f"({2 * percent} * n + {99 + percent}) div {100 + percent}") + 1


def _sets(docs: DataFrame, n_words: int, percent: int, whole: bool) -> DataFrame:
    """whole: (fp, n, toks, bits); else (id, digest if docs has it, fp, n, toks that are counted, rest: further tokens of the prefix by hash)."""
    id_type = docs.schema["id"].dataType.simpleString()
    digest = ["digest"] if "digest" in docs.columns and not whole else []
    every = _U(counted_every(percent))
    schema = "fp binary, n int, toks array<long>, bits binary" if whole else f"id {id_type}, {'digest binary, ' if digest else ''}fp binary, n int, toks array<long>, rest array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column(1).to_pylist(), batch.column(0)
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK_BYTES):
                    size += len(texts[hi])
                    hi += 1
                with np.errstate(over="ignore"):
                    sets = shingle_sets(texts[lo:hi], n_words)
                    fp = pa.array([_identity(s) for s in sets], pa.binary())
                n = pa.array([len(s) for s in sets], pa.int32())
                if whole:
                    columns = [fp, n, _lists(sets), pa.array([parity_bitmap(s) for s in sets], pa.binary())]
                else:
                    counted = [s % every == 0 for s in sets]
                    inside = [s[c] for s, c in zip(sets, counted, strict=True)]
                    short = [max(0, len(s) + (-percent * len(s) // 100) + 1 - len(i)) for s, i in zip(sets, inside, strict=True)]
                    columns = [ids[lo:hi], *[batch.column(2)[lo:hi] for _ in digest], fp, n, _lists(inside), _lists([s[~c][:k] for s, c, k in zip(sets, counted, short, strict=True)])]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(*x) for x in zip([y.split()[0] for y in schema.split(", ")], [c.type for c in columns], strict=True)]))
                lo = hi
        give_back()

    return docs.select("id", "text", *digest).mapInArrow(run, schema)


def _shared_tokens(sets: DataFrame) -> DataFrame:
    """(row, df, t): the tokens of each set that other sets have as well."""
    each = sets.select("row", F.explode("toks").alias("t"))
    common = staged(each.groupBy("t").agg(F.count("*").alias("df")).where("df > 1"), "tokens-shared")
    return each.join(common, "t")


def _candidates(first: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(id, fp) of one row of each set whose prefix holds a token that another set may have."""
    chosen = staged(first.join(classes.select("row"), "row", "left_semi"), "sets-distinct").where("n > 0")
    held = _shared_tokens(chosen).groupBy("row").agg(F.count("*").alias("shared"))
    p = probe_length(F.col("n"), percent)
    narrow = chosen.select("row", "id", "fp", "n", F.size("toks").alias("counted"))
    out = narrow.where(100 * F.col("n") >= percent * (F.col("n") + 1)).join(held, "row", "left")  # smaller sets link with equal ones only
    out = out.where(F.col("counted") - F.coalesce("shared", F.lit(0)) < p)
    return out.select("id", "fp")


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """(t, row, n, pos, indexed, bits): the prefix tokens that several candidates have, with their positions."""
    ranked = _shared_tokens(sets).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("by_df"))
    own = F.col("n") - F.size("by_df")
    take = F.greatest(F.lit(0), probe_length(F.col("n"), percent) - own)
    wide = sets.select("row", "n", "bits").join(ranked, "row").where(take > 0).select("row", "n", "bits", own.alias("own"), F.posexplode(F.slice("by_df", 1, take)).alias("k", "x"))
    pos = F.col("own") + F.col("k")
    return wide.select(F.col("x.t").alias("t"), "row", "n", pos.alias("pos"), (pos < index_length(F.col("n"), percent)).alias("indexed"), "bits")


def _to_parts(postings: DataFrame) -> DataFrame:
    """Postings for the first pass: a list of m sets has m / BLOCK parts, filled by hash, and each set goes to its own part only.

    Two sets of each list, its pivots, visit all parts, so that what the parts connect can be connected across them.
    """
    order = F.struct(F.xxhash64("row").alias("hash"), "row")
    lists = postings.groupBy("t").agg(F.count("*").alias("m"), F.max("indexed").alias("any_indexed"), F.min(order).alias("first"), F.max(order).alias("last"))
    lists = lists.where("m > 1 and any_indexed").select("t", F.expr(f"cast((m - 1) div {BLOCK} + 1 as int)").alias("parts"), F.array("first.row", "last.row").alias("pivots"))
    dealt = postings.join(staged(lists, "lists"), "t").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    visits = F.when(F.array_contains("pivots", F.col("row")), F.expr("sequence(0, parts - 1)")).otherwise(F.array("part"))
    return dealt.withColumn("i", F.explode(visits)).select("t", "i", F.col("i").alias("j"), "part", "row", "n", "pos", "indexed", "label", "bits")


def _to_pairs(postings: DataFrame) -> DataFrame:
    """Postings for the second pass, dealt to pairs of parts of their lists, so that no task holds a long list.

    Sets of a list's commonest label need not meet each other.  They fill the first parts and the others the last ones, BLOCK sets each;
    others go to all pairs that their part is in, the former only to pairs with a part of the latter.  So a list of m sets with u
    of other labels costs m + u * m / BLOCK rows.  Lists of up to BLOCK sets are one part; lists of one label are left out.
    """
    labels = postings.groupBy("t", "label").agg(F.count("*").alias("held"), F.max("indexed").alias("any_indexed"))
    top = F.max(F.struct("held", "label"))
    lists = labels.groupBy("t").agg(F.sum("held").alias("m"), F.max("any_indexed").alias("any_indexed"), F.count("*").alias("labels"), top.alias("top")).where("labels > 1 and any_indexed")
    parts = lambda n: f"cast(({n} + {BLOCK - 1}) div {BLOCK} as int)"
    short = f"m <= {BLOCK}"
    lists = lists.select("t", F.col("top.label").alias("main"), F.expr(f"if({short}, 0, {parts('top.held')})").alias("mains"), F.expr(f"if({short}, 1, {parts('(m - top.held)')})").alias("others"))
    dealt = postings.join(staged(lists, "lists"), "t").withColumn("is_main", (F.col("label") == F.col("main")) & (F.col("mains") > 0))
    own = F.expr("cast(if(is_main, pmod(xxhash64(row), mains), mains + pmod(xxhash64(row), others)) as int)")
    pairs = dealt.withColumn("part", own).withColumn("other", F.explode(F.expr("sequence(if(is_main, mains, 0), mains + others - 1)")))
    return pairs.select("t", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "row", "n", "pos", "indexed", "label", "bits")


class _Lists:
    """The postings of some whole lists (or pairs of parts), in order of list, position and row."""

    def __init__(self, table: pa.Table, percent: int):
        self.percent = percent
        get = lambda c: table.column(c).to_numpy()
        self.t, self.i, self.j, self.part, self.row, self.label = (get(c) for c in ("t", "i", "j", "part", "row", "label"))
        self.n, self.pos, self.indexed = get("n").astype(np.int64), get("pos").astype(np.int64), get("indexed").astype(bool)
        self.bits = np.frombuffer(b"".join(table.column("bits").to_pylist()), dtype=_U).reshape(-1, BITS // 64)
        new = (self.t[1:] != self.t[:-1]) | (self.i[1:] != self.i[:-1]) | (self.j[1:] != self.j[:-1])
        self.bounds = np.concatenate(([0], np.flatnonzero(new) + 1, [len(self.t)]))

    def need(self, na, nb):
        """Least intersection of linked sets of these sizes."""
        return -(-self.percent * (na + nb) // (100 + self.percent))

    def _later_with_earlier(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (later, earlier) of each list; whole blocks that positions and sizes rule out are skipped."""
        later, earlier, held = [], [], 0
        for lo, hi in zip(self.bounds[:-1], self.bounds[1:], strict=True):
            cuts = [(c, min(c + SKIPPED, hi)) for c in range(lo, hi, SKIPPED)]
            if len(cuts) > 1:
                least, most = (f.reduceat(self.n[lo:hi], np.arange(0, hi - lo, SKIPPED)) for f in (np.minimum, np.maximum))
                left = np.maximum.reduceat(self.n[lo:hi] - self.pos[lo:hi], np.arange(0, hi - lo, SKIPPED))
            for b, (b0, b1) in enumerate(cuts):
                for a, (a0, a1) in enumerate(cuts[: b + 1]):
                    if len(cuts) > 1:
                        need = self.need(least[a], least[b])
                        if min(left[a], left[b]) < need or 100 * min(most[a], most[b]) < self.percent * max(least[a], least[b]):
                            continue
                    if a == b:
                        y, x = np.tril_indices(b1 - b0, -1)
                    else:
                        y, x = (v.ravel() for v in np.indices((b1 - b0, a1 - a0)))
                    later.append(y + b0)
                    earlier.append(x + a0)
                    held += len(y)
                    if held >= PAIRS:
                        yield np.concatenate(later), np.concatenate(earlier)
                        later, earlier, held = [], [], 0
        if later:
            yield np.concatenate(later), np.concatenate(earlier)

    def edges(self, all_pairs: bool) -> tuple[np.ndarray, np.ndarray]:
        """Rows of pairs that may link; unless all_pairs, of each later set the nearest earlier one, and the sets nearest to each visiting pivot."""
        ys, xs, fars = [], [], []
        for y, x in self._later_with_earlier():
            nx, ny = self.n[x], self.n[y]
            need = self.need(nx, ny)
            ok = (np.minimum(nx - self.pos[x], ny - self.pos[y]) >= need) & (np.minimum(nx, ny) >= need) & (self.row[x] != self.row[y]) & (self.label[x] != self.label[y])
            ok &= np.where(nx < ny, self.indexed[x], np.where(ny < nx, self.indexed[y], self.indexed[x] | self.indexed[y]))
            ok &= (self.i[x] == self.j[x]) | (self.part[x] != self.part[y])
            y, x, most = y[ok], x[ok], (nx + ny - 2 * need)[ok]
            far = np.bitwise_count(self.bits[x] ^ self.bits[y]).sum(axis=1, dtype=np.int64)
            ok = far <= most
            ys.append(y[ok])
            xs.append(x[ok])
            fars.append(far[ok])
        y, x, far = (np.concatenate([np.zeros(0, dtype=np.int64), *v]) for v in (ys, xs, fars))
        if not all_pairs and len(y):
            visits = self.part != self.i
            guest = visits[x] | visits[y]
            pivot, host = np.where(visits[x], x, y)[guest], np.where(visits[x], y, x)[guest]
            later = _nearest(y[~guest], x[~guest], far[~guest], 1)
            met = _nearest(pivot, host, far[guest], OF_PIVOT)
            y, x = (np.concatenate(v) for v in zip(later, met, strict=True))
        a, b = self.row[x], self.row[y]
        both = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1) if len(a) else np.zeros((2, 0), dtype=np.int64)
        return both[0], both[1]


def _nearest(of: np.ndarray, to: np.ndarray, far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each number in `of`, its k pairs of the smallest `far`."""
    order = np.lexsort((to, far, of))
    of, to = of[order], to[order]
    start = np.flatnonzero(np.concatenate((np.ones(min(1, len(of)), dtype=bool), of[1:] != of[:-1])))
    rank = np.arange(len(of)) - np.repeat(start, np.diff(np.append(start, len(of))))
    return of[rank < k], to[rank < k]


def _list_edges(postings: DataFrame, percent: int, all_pairs: bool) -> DataFrame:
    """(a, b) with a < b: for each set of a list the nearest set before it, or all pairs of different labels that may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # the last list of a batch may go on in the next one
            names = [batch.column(c).to_numpy() for c in ("t", "i", "j")]
            same = np.logical_and.reduce([x == x[-1] for x in names])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if held:
                last = held[-1]
                if cut == 0 and all(last.column(c)[-1].as_py() == batch.column(c)[0].as_py() for c in ("t", "i", "j")):
                    held.append(batch)
                    continue
            table = pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held) if held or cut else None
            held = [batch.slice(cut)]
            if table is not None:
                a, b = _Lists(table, percent).edges(all_pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if held:
            a, b = _Lists(pa.Table.from_batches(held), percent).edges(all_pairs)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        give_back()

    return postings.repartition("t", "i", "j").sortWithinPartitions("t", "i", "j", "pos", "row").mapInArrow(run, "a long, b long").distinct()


def _verified(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges whose whole sets link."""
    left = sets.select(F.col("row").alias("a"), F.col("n").alias("n_a"), F.col("toks").alias("toks_a"))
    right = sets.select(F.col("row").alias("b"), F.col("n").alias("n_b"), F.col("toks").alias("toks_b"))
    both = edges.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("toks_a", "toks_b"))
    return staged(both.withColumn("shared", shared).where(100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared"))).select("a", "b"), "links")


def join_components(docs: DataFrame, n_words: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, n_shingles, component_id) for each row; fp is the set's identity, component_id the smallest id reachable by links."""
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    out = _joined(texts, n_words, percent, F.col("id"))
    out = out.select("id", "fp", "n", F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("least")).alias("component_id"))
    return out.select(F.col("id").alias(id_col), "fp", F.col("n").cast("long").alias("n_shingles"), "component_id")


def _joined(texts: DataFrame, n_words: int, percent: int, key: Column) -> DataFrame:
    """(the columns of _sets, least: the smallest key of the row's component) for each row of (id, text[, digest])."""
    first = staged(_sets(texts, n_words, percent, whole=False).withColumn("row", F.monotonically_increasing_id()), "sets-first")
    classes = staged(first.groupBy("fp", "n").agg(F.min("row").alias("row"), F.min(key).alias("least")), "sets-classes")
    wanted = staged(_candidates(first, classes, percent), "sets-candidates")

    again = texts.join(wanted.select(F.col("id").alias("wanted_id")).distinct().hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("wanted_id")), "left_semi")
    sets = _sets(again, n_words, percent, whole=True).where("n > 0")
    sets = staged(sets.withColumn("row", F.monotonically_increasing_id()), "sets-whole")

    postings = staged(_postings(sets, percent), "postings")
    postings = postings.withColumn("label", F.col("row"))
    near = staged(_list_edges(_to_parts(postings), percent, all_pairs=False), "edges-near")
    links = _verified(near, sets, percent)
    label = staged(connected_components(links), "components-near").withColumnsRenamed({"node": "row", "label": "found"})
    labelled = staged(postings.join(label, "row", "left").withColumn("label", F.coalesce("found", "row")).drop("found"), "postings-labelled")
    rest = staged(_list_edges(_to_pairs(labelled), percent, all_pairs=True), "edges-rest")
    links = links.unionByName(_verified(rest.join(near, ["a", "b"], "left_anti"), sets, percent))

    names = sets.select("row", "fp")
    of_set = connected_components(links).withColumnRenamed("node", "row").join(names, "row").select("fp", "label").distinct()
    grouped = staged(classes.join(of_set, "fp", "left"), "components")
    # one label may stand for a third of all sets: its least key goes to SALTS parts, and sets without links stay out of the join
    linked = grouped.where("label is not null")
    reached = linked.groupBy("label").agg(F.min("least").alias("reached")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = linked.select("fp", "label", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt")).join(reached, ["label", "salt"])
    ids = staged(dealt.select("fp", F.col("reached").alias("least")).unionByName(grouped.where("label is null").select("fp", "least")), "components-ids")
    return first.join(ids, "fp")


def keep_one(docs: DataFrame, n_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of docs (of the smallest id, then of the smallest digest), and all rows without words; all columns of docs.

    A null id comes after all others.  Rows are told apart by id and text, so an id that repeats loses only the texts that are copies.
    """
    texts = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"), digest_of(whole_text(text_col)).alias("digest"))
    out = _joined(texts, n_words, percent, F.struct(F.col("id").isNull().alias("none"), "id", "digest")).where("n > 0")
    once = F.col("id").eqNullSafe(F.col("least.id")) & (F.col("digest") == F.col("least.digest"))
    marked = out.groupBy("id", "digest", once.alias("once")).agg(F.count("*").alias("rows"))
    return kept_rows(docs, id_col, text_col, staged(marked.where("not once or rows > 1").drop("rows"), "near-marked"))
