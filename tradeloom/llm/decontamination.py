"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

1. Words are runs of letters and digits, lower-cased; shingles are five words in a row (fewer words: the whole sequence).
   Similarity is weighted Jaccard over shingle sets: a shingle of the benchmark weighs ln(1 + items / items that have it), in items
   as in windows, where items of the same words count once; any other weighs as much as the rarest can.
2. Similarity of 0.8 needs common shingles.  The scan drops what a bitmap of the benchmark's shingles (2^20 bits, three for each) rules
   out, and the rest meets the benchmark's postings in a join.  A text and an item whose common shingles weigh less than the
   threshold's share of the item go no further; for the others, windows of the item's size are cut
   around each alignment (place in text minus place in item).  None of this loses a match.
3. Each window and each item has a 64-bit SimHash.  Multi-index blocks: RADIUS + 1 blocks of bits, so that fingerprints
   within RADIUS bits agree on one block at least.  Under one order of all shingles, heavy ones first, a window and an item that
   reach the threshold have their first common shingle among the heaviest few of both (what follows weighs less than the threshold's
   share), so windows meet the items of their size by (prefix shingle, block, bits), and unlike ones hardly ever; the Hamming
   distance is then taken exactly.  Texts meet items by the items' prefix shingles too, so a passage that many items share pairs nothing.
4. What lies within RADIUS is verified by the exact weighted similarity; so is each window with the item that it was cut for, since
   SimHash alone may miss a match close to the threshold (`simhash_share` tells how many it finds).

Defined results: null or empty texts and items match nothing.  An item of fewer than five words matches only a text that is the
same few words.  Repeated rows are reported once for each row; repeated items once for each item.  Columns besides id
and text are ignored, whatever their names.  Ties between windows: the earliest start.  Empty tables give an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bound, digest_of, packed, staged, whole_text, without_rows

SHINGLE = 5
LEAST_SIMILARITY = 0.8
#: At similarity 0.8 the expected distance is 9.7 bits with a deviation of 2.9.
RADIUS = 18
BITS = 64
#: 64-bit words of the bitmap of the benchmark's shingles, 2^WORD_BITS: 128 KB in the plan, whatever the benchmark's size.
WORD_BITS = 14
#: Taken off the threshold before sums of weights are compared with it: similarities are rounded to six places.
MARGIN = 2e-6
#: Starts next to an alignment that are tried as well, for words put in or left out.
SLACK = 1


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: Column) -> Column:
    """64-bit hashes of each five words in a row; of fewer words, one."""
    n = F.size(words)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), n - (SHINGLE - 1)))
    each = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
    return F.when(n > 0, each).otherwise(F.expr("cast(array() as array<bigint>)"))


def _lane_sum(j: int):
    return lambda acc, h: acc + F.call_function("shiftrightunsigned", h, F.lit(j)).bitwiseAND(F.lit(1 << 32 | 1))


def _with_simhash(df: DataFrame, hashes: str) -> DataFrame:
    """df with `print`, the 64-bit SimHash of an array of hashes: 32 sums of two 32-bit lanes count its bits."""
    df = df.withColumn("sums", F.array(*[F.aggregate(hashes, F.lit(0).cast("long"), _lane_sum(j)) for j in range(32)]))
    bits = []
    for j in range(32):
        for lane in range(2):
            count = F.call_function("shiftrightunsigned", F.col("sums")[j], F.lit(32 * lane)).bitwiseAND(F.lit(0xFFFFFFFF))
            value = 1 << (32 * lane + j)
            bits.append(F.when(count * 2 > F.size(hashes), F.lit(value if value < 1 << 63 else value - (1 << 64)).cast("long")).otherwise(F.lit(0).cast("long")))
    return df.withColumn("print", reduce(lambda a, b: a.bitwiseOR(b), bits)).drop("sums")


#: Where a shingle's hash names its three bits of the bitmap: shifts of the word's number and of the bit's.
_PLACES = [(0, 58), (WORD_BITS, 52), (2 * WORD_BITS, 46)]


def _bitmap(hashes: DataFrame) -> list[int]:
    """The bitmap of the column h as 64-bit words; only this, of a fixed size, comes to the driver."""
    part = lambda shift, bits: F.call_function("shiftrightunsigned", F.col("h"), F.lit(shift)).bitwiseAND(F.lit((1 << bits) - 1))
    places = hashes.select(F.inline(F.array(*[F.struct(part(w, WORD_BITS).alias("word"), part(b, 6).alias("bit")) for w, b in _PLACES])))
    words = [0] * (1 << WORD_BITS)
    for r in places.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit").cast("int"))).alias("bits")).collect():
        words[r["word"]] = r["bits"]
    return words


def _hits(words: list[int]) -> Column:
    """(p, h) of the shingles in the column hashes whose three bits the bitmap has; the bitmap stands in the plan once."""
    table = "array(" + ",".join(f"{w}L" if w != -(1 << 63) else "bigint(-9223372036854775808)" for w in words) + ")"
    part = lambda shift, bits: f"cast({f'shiftrightunsigned(h, {shift})' if shift else 'h'} & {(1 << bits) - 1}L as int)"
    known = " and ".join(f"bit_get(t[{part(w, WORD_BITS)}], {part(b, 6)}) = 1" for w, b in _PLACES)
    return F.expr(f"transform(array({table}), t -> filter(transform(hashes, (h, i) -> if({known}, struct(i as p, h as h), null)), x -> x is not null))[0]")


def _blocks(print_: Column) -> Column:
    """RADIUS + 1 blocks of the fingerprint's bits, each as (block, bits)."""
    edges = [BITS * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    cut = [F.struct(F.lit(k).alias("block"), F.call_function("shiftrightunsigned", print_, F.lit(lo)).bitwiseAND(F.lit((1 << (hi - lo)) - 1)).alias("value")) for k, (lo, hi) in enumerate(zip(edges, edges[1:], strict=False))]
    return F.explode(F.array(*cut))


def _prefix(x: Column, least: Column) -> Column:
    """Of (weight, h) in rising order, the heaviest ones: all but the lightest that weigh less than `least` together."""
    more = lambda a, e: F.struct((a["sum"] + e["weight"]).alias("sum"), (a["light"] + (a["sum"] + e["weight"] < least).cast("int")).alias("light"))
    light = F.aggregate(x, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("light")), more)["light"]
    return F.slice(x, light + 1, F.greatest(F.lit(1), F.size(x)))["h"]


def _items(benchmark: DataFrame, item_col: str, text_col: str, least: float) -> tuple[DataFrame, DataFrame, float]:
    """(key, item, n, hashes, set, weights, total, prefix, print) of each item that has words; (h, weight) of their shingles; the weight of a shingle that no item has."""
    words = benchmark.select(F.col(item_col).alias("item"), words_of(whole_text(text_col)).alias("words"))
    items = words.select("item", bound(F.col("words"), shingles_of).alias("hashes"))
    items = staged(items.where(F.size("hashes") > 0).withColumn("set", F.array_sort(F.array_distinct("hashes"))).withColumn("n", F.size("hashes")).withColumn("key", F.monotonically_increasing_id()), "items-cut")
    texts = staged(items.groupBy("hashes").agg(F.first("set").alias("set")), "items-distinct")
    n_texts = texts.count()
    weights = staged(texts.select(F.explode("set").alias("h")).groupBy("h").agg(F.log1p(n_texts / F.count("*")).alias("weight")), "items-weights")
    weighed = items.select("key", F.explode("set").alias("h")).join(weights, "h").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("h", "weight"))).alias("x"))
    out = items.join(weighed, "key").select("key", "item", "n", "hashes", "set", F.col("x.weight").alias("weights"))
    out = out.withColumn("total", F.aggregate("weights", F.lit(0.0), lambda a, w: a + w))
    rising = F.array_sort(F.zip_with("weights", "set", lambda w, h: F.struct(w.alias("weight"), h.alias("h"))))
    out = out.withColumn("prefix", _prefix(rising, (least - MARGIN) * F.col("total")))
    return staged(_with_simhash(out, "hashes"), "items"), weights, math.log1p(n_texts)


def find_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST_SIMILARITY) -> DataFrame:
    """(id, item, similarity, start): for each row and each item the most similar window, from `least` up; start counts words from 0."""
    best = _best(_scored(docs, benchmark, id_col, text_col, item_col, item_text_col, least))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "similarity", "start")


def simhash_share(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST_SIMILARITY) -> float:
    """Of the matches (row, item) found, the share that the SimHash blocks propose."""
    scored = _scored(docs, benchmark, id_col, text_col, item_col, item_text_col, least)
    n, found = scored.groupBy("row", "key").agg(F.max("near").cast("int").alias("near")).agg(F.count("*"), F.sum("near")).first()
    return (found or 0) / n if n else 1.0


def _windows(docs: DataFrame, items: DataFrame, weights: DataFrame, id_col: str, text_col: str, least: float) -> tuple[DataFrame, DataFrame]:
    """(w, row, id, digest, n, s, window, print) of the windows worth a look; (w, key) of the items that they were cut for."""
    text = whole_text(text_col)
    row = F.monotonically_increasing_id().alias("row")  # beside a column of this kind, Spark doesn't move later filters before it and so takes no shingle twice
    cut = docs.select(F.col(id_col).alias("id"), digest_of(text).alias("digest"), bound(words_of(text), shingles_of).alias("hashes"), row)
    hits = _hits(_bitmap(weights))
    held = staged(cut.select("*", hits.alias("hits"), F.monotonically_increasing_id().alias("again")).where(F.size("hits") > 0).drop("again"), "texts-hit")
    places = held.select("row", F.size("hashes").alias("m"), F.inline("hits").alias("p", "h")).join(weights, "h")
    places = staged(places.select("row", "m", "p", "h", "weight"), "texts-places")

    postings = items.select("key", "n", F.posexplode("hashes").alias("at", "h"))
    once = places.select("row", "h", "weight").distinct()
    pairs = once.select("row", "h").join(items.select("key", F.explode("prefix").alias("h")), "h").select("row", "key").distinct()
    met = pairs.join(items.select("key", "total", F.explode("set").alias("h")), "key").join(once, ["row", "h"])
    enough = met.groupBy("row", "key").agg(F.sum("weight").alias("common"), F.first("total").alias("total")).where(F.col("common") >= (least - MARGIN) * F.col("total"))
    start = F.explode(F.sequence(F.col("p") - F.col("at") - SLACK, F.col("p") - F.col("at") + SLACK))
    aligned = enough.select("row", "key").join(postings, "key").join(places.select("row", "m", "p", "h"), ["row", "h"]).select("row", "key", "m", "n", start.alias("s"))
    starts = staged(aligned.select("row", "key", "n", F.greatest(F.lit(0), F.least(F.col("s"), F.col("m") - F.least("n", "m"))).alias("s")).distinct(), "windows-of-items")
    windows = held.join(starts.select("row", "n", "s").distinct(), "row").select("id", "digest", "row", "n", "s", F.slice("hashes", F.col("s") + 1, F.col("n")).alias("window"))
    windows = staged(_with_simhash(windows, "window").withColumn("w", F.monotonically_increasing_id()), "windows")
    return windows, windows.select("w", "row", "n", "s").join(starts, ["row", "n", "s"]).select("w", "key")


def _blocks_met(windows: DataFrame, items: DataFrame, weights: DataFrame, rarest: float, least: float) -> DataFrame:
    """(w, key, p, q) with the prints of a window and an item of its size, for each prefix shingle and block of bits that they share."""
    known = windows.select("w", F.explode(F.array_distinct("window")).alias("h")).join(weights, "h")
    known = known.groupBy("w").agg(F.array_sort(F.collect_list(F.struct("weight", "h"))).alias("x"), F.sum("weight").alias("held"))
    total = F.col("held") + (F.size(F.array_distinct("window")) - F.size("x")) * F.lit(rarest)
    heavy = windows.select("w", "n", "window", "print").join(known, "w").withColumn("least", (least - MARGIN) * total).where(F.col("held") >= F.col("least"))
    heavy = heavy.select("w", "n", F.col("print").alias("p"), F.explode(_prefix(F.col("x"), F.col("least"))).alias("h"))
    heads = items.select("key", "n", F.col("print").alias("q"), F.explode("prefix").alias("h"))
    return heavy.select("*", _blocks(F.col("p")).alias("b")).join(heads.select("*", _blocks(F.col("q")).alias("b")), ["n", "h", "b"]).select("w", "key", "p", "q")


def _scored(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, least: float) -> DataFrame:
    """(row, key, id, digest, item, s, similarity, near) of the windows and items from `least` up; near: SimHash proposes the pair."""
    items, weights, rarest = _items(benchmark, item_col, item_text_col, least)
    windows, cut_for = _windows(docs, items, weights, id_col, text_col, least)
    met = _blocks_met(windows, items, weights, rarest, least)
    near = met.where(F.bit_count(F.col("p").bitwiseXOR(F.col("q"))) <= RADIUS).select("w", "key")
    proposed = near.withColumn("near", F.lit(True)).unionByName(cut_for.withColumn("near", F.lit(False))).groupBy("w", "key").agg(F.max("near").alias("near"))
    both = windows.join(proposed, "w").join(items.select("key", "item", "set", "weights", "total"), "key")
    common = F.aggregate(F.zip_with("set", "weights", lambda h, x: F.when(F.array_contains("window", h), x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    lightest = weights.agg(F.min("weight")).first()[0] or 0.0
    like = lambda other: F.round(F.col("common") / (F.col("total") + other), 6)
    pairs = both.select("w", "key", "row", "s", "id", "digest", "item", "total", "near", common.alias("common"), F.array_except("window", "set").alias("others"))
    pairs = staged(pairs.where(like(F.size("others") * F.lit(lightest)) >= least), "pairs")  # the rest is too unlike, whatever its other shingles weigh
    # what a window's shingles outside the item weigh less than the rarest, where other items have them
    less = pairs.select("w", "key", F.explode("others").alias("h")).join(weights, "h").groupBy("w", "key").agg(F.sum(F.lit(rarest) - F.col("weight")).alias("less"))
    other = F.size("others") * F.lit(rarest) - F.coalesce("less", F.lit(0.0))
    return pairs.join(less, ["w", "key"], "left").withColumn("similarity", like(other)).where(F.col("similarity") >= least)


def _best(scored: DataFrame) -> DataFrame:
    best = scored.groupBy("row", "key").agg(F.max(F.struct("similarity", (-F.col("s")).alias("late"))).alias("x"), *[F.first(c).alias(c) for c in ("id", "digest", "item")])
    return best.select("id", "digest", "item", F.col("x.similarity").alias("similarity"), (-F.col("x.late")).cast("long").alias("start"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST_SIMILARITY) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    found = _scored(docs, benchmark, id_col, text_col, item_col, item_text_col, least)
    lost = staged(found.select("id", "digest").distinct(), "contaminated")
    return without_rows(packed(docs, id=F.col(id_col), digest=digest_of(whole_text(text_col))), lost).select("doc.*")
