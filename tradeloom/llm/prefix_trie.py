"""Prefix trie of conversations from double arrays, one for each shard of prefixes.

1. Rebuilding.  Turns stand in order inside their conversation; each conversation takes its first turns from the one whose id ends its hundred.
   A turn is named by the first 16 bytes of the SHA-256 of its role and text, so texts do not move.
2. Classes.  Conversations of the same turns are one class with a count and its smallest id; Spark combines them before the shuffle.
3. Shards.  Classes are counted by their prefixes of 0, 1, 2, 4, ... turns; a class lies in the shard of its shortest prefix with at most `limit` turns
   below it, so that a first turn that a third of all conversations share is split further on.  A class whose prefixes are all overfull ends in no shard:
   all its nodes are upper nodes.
4. Double arrays.  In a shard turns have dense ids, numbered as the levels are met.  Level by level the children of a node are packed at BASE[node] + id,
   where CHECK names their parent; conversations walk down the arrays, and counts, children, leaves and tokens are summed on the way back up.
5. Merging.  Nodes at or above a shard's prefix may lie over several shards: their parts meet by path digest, in partial sums.  Sums over
   subtrees of upper nodes go up by pointer doubling, in as many rounds as the logarithm of the deepest upper node.
6. Digests of members.  Ids of a class are sorted in ranges and joined in pieces; one stream over a class's pieces, in order, makes its SHA-256.

Defined results: rows of a null conv_id belong to no conversation.  Null role or text is empty, a null turn comes first; turns of one number follow each other by their
digest, and repeated rows are turns of their own.  A rebuilt conversation without turns is a member of the root alone.  Columns besides the four are ignored,
whatever their names.  An empty table has no nodes, not even the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import packed, staged, whole_text

#: Turns that a rebuilt conversation takes over at most; conversations of one group.
MOST_HEAD, GROUP = 5, 100
#: Turns below a shard's prefix.
SHARD_TURNS = 20_000
#: Ids in a piece of a class's list.
PIECE = 4_096
#: Offsets that are tried before a node's children go to the end of the arrays.
TRIED = 64
EMPTY = hashlib.sha256(b"").hexdigest()
_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, f1 long, f2 long"
_UPPER = "node binary, parent binary, depth long, least long, n_convs long, tokens long, children long, leaves long, saved long, f1 long, f2 long"


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(c) of all conversations; (c, d, key, len) of their rebuilt turns, d from 1."""
    role, text = whole_text(role_col), whole_text(text_col)
    key = F.substring(F.unhex(F.sha2(F.encode(F.concat_ws(":", F.length(role).cast("string"), F.concat(role, text)), "UTF-8"), 256)), 1, 16)
    own = packed(turns, c=F.col(conv_col).cast("long"), turn=F.col(turn_col), key=key, len=F.length(text).cast("long")).drop("doc").where("c is not null")
    own = own.withColumn("base", F.col("c") - F.col("c") % GROUP)
    order = Window.partitionBy("base", "c").orderBy(F.asc_nulls_first("turn"), "key")
    own = own.repartition("base").withColumn("i", F.row_number().over(order)).select("base", "c", "i", "key", "len")
    own = staged(own.withColumn("h", (F.crc32(F.encode(F.col("c").cast("string"), "UTF-8")) % (MOST_HEAD + 1)).cast("int")), "trie-turns")
    heads = own.where((F.col("c") == F.col("base")) & (F.col("i") <= MOST_HEAD)).groupBy("base").agg(F.array_sort(F.collect_list(F.struct("i", "key", "len"))).alias("head"))  # five at most
    convs = own.where("i = 1").select("base", "c", "h")
    first = convs.join(heads, "base").select("c", F.posexplode(F.slice("head", F.lit(1), F.col("h"))).alias("p", "x")).select("c", (F.col("p") + 1).alias("d"), "x.key", "x.len")
    later = own.where(F.col("i") > F.col("h")).join(heads.select("base", F.size("head").alias("n")), "base", "left")
    later = later.select("c", (F.col("i") - F.col("h") + F.least("h", F.coalesce("n", F.lit(0)))).alias("d"), "key", "len")
    return convs.select("c"), first.unionByName(later)


def _cuts(keys: Column) -> Column:
    """(p, prefix) of the prefixes of 0, 1, 2, 4, ... keys."""
    depths = F.filter(F.array(*[F.lit(p) for p in (0, *[1 << k for k in range(30)])]), lambda p: p <= F.size(keys))
    prefix = lambda p: F.struct(F.xxhash64(F.lit(1), F.slice(keys, F.lit(1), p)).alias("x"), F.xxhash64(F.lit(2), F.slice(keys, F.lit(1), p)).alias("y"))
    return F.transform(depths, lambda p: F.struct(p.cast("int").alias("p"), prefix(p).alias("prefix")))


def classes_of(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(c, f1, f2) of each conversation; (f1, f2, keys, lens, n, least, cuts) of each class."""
    seqs = turns.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("d", "key", "len"))).alias("s"))
    empty = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    seqs = convs.join(seqs, "c", "left").select("c", F.coalesce("s.key", empty("binary")).alias("keys"), F.coalesce("s.len", empty("bigint")).alias("lens"))
    seqs = staged(seqs.withColumns({"f1": F.xxhash64(F.lit(1), "keys"), "f2": F.xxhash64(F.lit(2), "keys")}), "trie-sequences")
    classes = seqs.groupBy("f1", "f2").agg(F.first(F.struct("keys", "lens")).alias("s"), F.count("*").alias("n"), F.min("c").alias("least"))
    return seqs.select("c", "f1", "f2"), staged(classes.select("f1", "f2", "s.keys", "s.lens", "n", "least").withColumn("cuts", _cuts(F.col("keys"))), "trie-classes")


def in_shards(classes: DataFrame, limit: int) -> DataFrame:
    """classes with `top`, the depth of their shard's prefix, and `shard`, its digest (their own where no prefix will do)."""
    below = classes.select("f1", "f2", F.size("keys").alias("m"), F.inline("cuts").alias("p", "prefix"))
    full = below.groupBy("p", "prefix").agg(F.sum(F.col("m") - F.col("p")).alias("held")).where(F.col("held") <= limit).select("p", "prefix")
    fits = below.join(full, ["p", "prefix"]).groupBy("f1", "f2").agg(F.min(F.struct("p", "prefix")).alias("at"))
    own = F.struct(F.size("keys").alias("p"), F.struct(F.col("f1").alias("x"), F.col("f2").alias("y")).alias("prefix"))
    placed = classes.drop("cuts").join(fits, ["f1", "f2"], "left").withColumn("at", F.coalesce("at", own))
    return placed.select("f1", "f2", "keys", "lens", "n", "least", F.col("at.p").alias("top"), F.xxhash64("at").alias("shard"))


class DoubleArray:
    """BASE and CHECK of a trie over dense ids: the child of node s by id c is t = BASE[s] + c where CHECK[t] = s."""

    def __init__(self) -> None:
        self.base, self.check, self.end, self.free = np.zeros(64, np.int64), np.full(64, -1, np.int64), 1, 1
        self.check[0] = 0

    def _room(self, size: int) -> None:
        while size > len(self.check):
            self.base = np.concatenate([self.base, np.zeros_like(self.base)])
            self.check = np.concatenate([self.check, np.full_like(self.check, -1)])

    def pack(self, node: int, ids: np.ndarray) -> None:
        """Place the children of a node, rising ids, at the first offset where all their cells are free."""
        span = int(ids[-1] - ids[0]) + 1
        self._room(self.end + span)
        tried = range(self.free, min(self.free + TRIED, self.end))
        at = next((a for a in tried if self.check[a] < 0 and (self.check[a + ids - ids[0]] < 0).all()), self.end)
        self.base[node] = at - ids[0]
        self.check[at + ids - ids[0]] = node
        self.end = max(self.end, at + span)
        while self.free < self.end and self.check[self.free] >= 0:
            self.free += 1

    def pack_single(self, nodes: np.ndarray, ids: np.ndarray) -> None:
        """The same for nodes of one child each: cells at the end, all at once."""
        at = self.end + np.arange(len(nodes))
        self._room(self.end + len(nodes))
        self.base[nodes], self.check[at] = at - ids, nodes
        self.end += len(nodes)

    def step(self, nodes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        at = self.base[nodes] + ids
        if not (self.check[at] == nodes).all():
            raise AssertionError("a walk left the trie")
        return at


def _dense(level: np.ndarray, seen: dict[bytes, int]) -> np.ndarray:
    """Dense ids of the turns of one level, those met first numbered on."""
    return np.fromiter((seen.setdefault(k, len(seen) + 1) for k in level), np.int64, len(level))


def shard_nodes(keys: list[list[bytes]], lens: list[list[int]], n: np.ndarray, least: np.ndarray, top: int) -> dict[str, np.ndarray]:
    """The nodes of one shard, its top first: depth below the top, parent's place, least, n, children, leaves, saved, end (a class's place or -1)."""
    trie, seen = DoubleArray(), {}
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__))  # siblings, met one after another, get ids side by side
    sizes = np.array([len(keys[k]) - top for k in order])
    at = np.zeros(len(order), np.int64)
    depth_of, tokens_of = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
    slots = [np.zeros(1, np.int64)]
    walks = [(at.copy(), np.arange(len(order)))]
    for level in range(int(sizes.max(initial=0))):
        live = np.flatnonzero(sizes > level)
        ids = _dense([keys[order[k]][top + level] for k in live], seen)
        _, first = np.unique(at[live] * (len(seen) + 1) + ids, return_index=True)  # the edges, by parent and id
        above, below = at[live][first], ids[first]
        parents, starts, counts = np.unique(above, return_index=True, return_counts=True)
        one = counts == 1
        trie.pack_single(parents[one], below[starts[one]])
        for p, s, m in zip(parents[~one], starts[~one], counts[~one], strict=True):
            trie.pack(int(p), below[s : s + m])
        at[live] = trie.step(at[live], ids)
        slots.append(trie.step(above, below))
        depth_of.append(np.full(len(first), level + 1))
        tokens_of.append(np.array([lens[order[live[f]]][top + level] for f in first], dtype=np.int64))
        walks.append((at[live], live))
    slot, depth, tokens = np.concatenate(slots), np.concatenate(depth_of), np.concatenate(tokens_of)
    size = trie.end
    total, low, end = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.full(size, -1)
    for where, who in walks:
        np.add.at(total, where, n[order[who]])
        np.minimum.at(low, where, least[order[who]])
    end[at] = order
    children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, np.int64)
    saved[slot] = (total[slot] - 1) * tokens
    for k in range(len(slots) - 1, 0, -1):  # from the deepest level up
        s = slots[k]
        leaves[s] += children[s] == 0
        up = trie.check[s]
        np.add.at(children, up, 1)
        np.add.at(leaves, up, leaves[s])
        np.add.at(saved, up, saved[s])
    return {"depth": depth, "parent": trie.check[slot], "slot": slot, "least": low[slot], "above": low[trie.check[slot]], "n": total[slot], "children": children[slot], "leaves": leaves[slot], "saved": saved[slot], "end": end[slot]}


def _path(keys: list[bytes]) -> list[bytes]:
    """Digests of the nodes on the way down: of the root and each prefix."""
    out = [hashlib.blake2b(b"", digest_size=16).digest()]
    for k in keys:
        out.append(hashlib.blake2b(out[-1] + k, digest_size=16).digest())
    return out


def _of_shard(group: list[dict]) -> pa.RecordBatch:
    """The nodes below a shard's top, ready; and parts of those at and above it: the top's with what lies below, the others' with counts alone."""
    top = group[0]["top"]
    n, least = (np.array([g[c] for g in group], dtype=np.int64) for c in ("n", "least"))
    keys, lens = [g["keys"] for g in group], [g["lens"] for g in group]
    f = shard_nodes(keys, lens, n, least, top)
    inner = np.arange(1, len(f["slot"]))
    ends = f["end"][inner]
    f1, f2 = (pa.array([group[e][c] if e >= 0 else None for e in ends], pa.int64()) for c in ("f1", "f2"))
    m = len(inner)
    lower = [pa.array(f["least"][inner]), pa.array(f["depth"][inner] + top), pa.array(f["above"][inner]), *[pa.array(f[c][inner]) for c in ("n", "children", "leaves", "saved")], f1, f2]
    lower_type = pa.struct([(c.split()[0], pa.int64()) for c in _NODE.split(", ")])
    lower = pa.StructArray.from_arrays(lower, fields=list(lower_type))
    path = _path(keys[0][:top])
    end = int(f["end"][0])
    upper = [{
        "node": path[d], "parent": path[d - 1] if d else None, "depth": d, "least": int(least.min()), "n_convs": int(n.sum()), "tokens": lens[0][d - 1] if d else 0,
        "children": int(f["children"][0]) if d == top else 0, "leaves": int(f["leaves"][0]) if d == top else 0, "saved": int(f["saved"][0]) if d == top else 0,
        "f1": group[end]["f1"] if d == top and end >= 0 else None, "f2": group[end]["f2"] if d == top and end >= 0 else None,
    } for d in range(top + 1)]
    upper_type = pa.struct([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in _UPPER.split(", ")])
    upper = pa.array(upper, upper_type)
    none = lambda k, kind: pa.nulls(k, kind)
    both = [pa.concat_arrays([lower, none(len(upper), lower_type)]), pa.concat_arrays([none(m, upper_type), upper])]
    return pa.RecordBatch.from_arrays(both, ["lower", "upper"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shard after shard of a task's rows, which come sorted by shard and class."""
    group: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if group and (row["shard"], row["top"]) != (group[0]["shard"], group[0]["top"]):
                yield _of_shard(group)
                group = []
            group.append(row)
    if group:
        yield _of_shard(group)


def _upper_sums(upper: DataFrame) -> DataFrame:
    """_NODE of the nodes whose parts are given."""
    sums = {c: F.sum(c) for c in ("n_convs", "children", "leaves", "saved")}
    merged = upper.groupBy("node").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("parent", "depth", "tokens", "f1", "f2")], F.min("least").alias("least"), *[v.alias(c) for c, v in sums.items()])
    merged = staged(merged, "trie-upper")
    kids = merged.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    nodes = merged.join(kids, "node", "left").withColumn("n_children", F.col("children") + F.coalesce("kids", F.lit(0)))
    nodes = nodes.withColumns({"leaves": F.col("leaves") + (F.col("n_children") == 0).cast("long"), "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("tokens")})
    nodes = staged(nodes.select("node", "parent", "depth", "least", "n_convs", "n_children", "leaves", "saved", "f1", "f2", F.col("parent").alias("jump")), "trie-own")
    deepest, reach = nodes.agg(F.max("depth")).first()[0] or 0, 1
    while reach <= deepest:  # sums within `reach` levels go to the ancestor that many levels up
        given = nodes.where("jump is not null").groupBy(F.col("jump").alias("node")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        next_jump = nodes.where("jump is not null").select(F.col("node").alias("jump"), F.col("jump").alias("next"))
        nodes = nodes.join(given, "node", "left").join(next_jump, "jump", "left")
        nodes = nodes.withColumns({"leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)), "jump": F.col("next")})
        nodes, reach = staged(nodes.drop("more_leaves", "more_saved", "next"), "trie-doubled"), reach * 2
    above = nodes.select(F.col("node").alias("parent"), F.col("least").alias("parent_conv_id"))
    out = nodes.join(above, "parent", "left")
    return out.select(F.col("least").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), "f1", "f2")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of ids sorted by class and id: joined pieces of at most PIECE."""
    held: list[str] = []
    of, first = None, None

    def piece() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([of[0]], pa.int64()), pa.array([of[1]], pa.int64()), pa.array([first], pa.int64()), pa.array([",".join(held)])], ["f1", "f2", "first", "ids"])

    for b in batches:
        for f1, f2, c in zip(*(b.column(k).to_pylist() for k in ("f1", "f2", "c")), strict=True):
            if held and ((f1, f2) != of or len(held) >= PIECE):
                yield piece()
                held = []
            if not held:
                of, first = (f1, f2), c
            held.append(str(c))
    if held:
        yield piece()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each class, which come in order; only the running digest is held."""
    of, running = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([of[0]], pa.int64()), pa.array([of[1]], pa.int64()), pa.array([running.hexdigest()])], ["f1", "f2", "sha"])

    for b in batches:
        for f1, f2, ids in zip(*(b.column(k).to_pylist() for k in ("f1", "f2", "ids")), strict=True):
            if (f1, f2) != of:
                if of is not None:
                    yield done()
                of, running = (f1, f2), hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
    if of is not None:
        yield done()


def _ends(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(f1, f2, sha) of each class: of one member at once, of more from their sorted ids."""
    single = classes.where("n = 1").select("f1", "f2", F.sha2(F.encode(F.col("least").cast("string"), "UTF-8"), 256).alias("sha"))
    many = members.join(classes.where("n > 1").select("f1", "f2"), ["f1", "f2"])
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = many.repartitionByRange(parts, "f1", "f2", "c").sortWithinPartitions("f1", "f2", "c").mapInArrow(_pieces, "f1 long, f2 long, first long, ids string")
    digests = pieces.repartition("f1", "f2").sortWithinPartitions("f1", "f2", "first").mapInArrow(_digests, "f1 long, f2 long, sha string")
    return single.unionByName(digests)


def conversation_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", limit: int = SHARD_TURNS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): a row for each node."""
    members, classes = classes_of(*rebuilt(turns, conv_col, turn_col, role_col, text_col))
    placed = in_shards(classes, limit).repartition("shard").sortWithinPartitions("shard", "top", "f1", "f2")
    parts = staged(placed.mapInArrow(_shards, f"lower struct<{_NODE.replace(' ', ':').replace(',:', ',')}>, upper struct<{_UPPER.replace(' ', ':').replace(',:', ',')}>"), "trie-parts")
    nodes = parts.where("lower is not null").select("lower.*").unionByName(_upper_sums(parts.where("upper is not null").select("upper.*")))
    ending = nodes.where("f1 is not null").join(_ends(members, classes), ["f1", "f2"]).withColumnRenamed("sha", "ends_sha256")
    passing = nodes.where("f1 is null").withColumn("ends_sha256", F.lit(EMPTY))
    return ending.unionByName(passing).drop("f1", "f2")
