"""Exact deduplication through an extendible-hash index on shared files.

1. Directory.  Buckets are prefixes of a text's 64-bit hash.  Distinct hashes are counted by fine prefix (2^FINE_BITS at most);
   starting from one bucket, the directory doubles as long as some bucket holds more than `capacity` hashes, and
   only overfull buckets split on another bit.  Its size is bounded, so tasks get it whole by broadcast.
2. Index.  The directory gives each row its bucket.  Classes are found inside a bucket: rows are grouped by (bucket, hash, text), so
   texts of one hash are chained and their bytes compared.  Spark combines copies before the shuffle, so a text that a third of all rows
   repeat moves once for each task.  Classes go to shared files, each a key range of buckets that one owner task writes in hash order.
3. Look-up.  Rows go through the directory to their bucket and meet its entries by hash and digest.  Entries of more than
   1 / HOT_SHARE of all rows (at most HOT_SHARE) are dealt to SALTS parts with their rows.

Defined results: null counts as empty text; all empty texts are one class.  The row with the largest id stays; a null
id stays only in a class of null ids, and repeated ids share their fate (both rows of a kept id say kept).  Columns besides id and
text are ignored, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SALTS, packed, staged, whole_text

#: Distinct hashes that a bucket may hold before it splits; more where the table would need over MOST_OWNERS buckets.
CAPACITY = 50_000
MOST_OWNERS = 4_096
#: Bits of the prefixes that are counted.
FINE_BITS = 16
#: Entries of more than this part of all rows are dealt to several parts.
HOT_SHARE = 1_000


def hash_prefix(hash64: Column, bits: int) -> Column:
    """The first bits of a 64-bit hash as a number."""
    return F.call_function("shiftrightunsigned", hash64, F.lit(64 - bits))


def directory(fine: DataFrame, bits: int, capacity: int) -> DataFrame:
    """(prefix, depth, bucket): for each fine prefix of `bits` bits, with its number n of hashes, the bucket that it lies in.

    A bucket of depth d splits if it holds more than `capacity` hashes and d < bits; a bucket is named by its depth and prefix.
    A prefix's depth is the number of its ancestors that split.  There are at most 2^bits nodes that split, so tasks get them by broadcast.
    """
    depths = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("depth")
    over = lambda depth: F.call_function("shiftright", F.col("prefix"), (F.lit(bits) - depth).cast("int"))
    up = fine.select("prefix", "n", depths).withColumn("over", over(F.col("depth")))
    splits = staged(up.groupBy("depth", "over").agg(F.sum("n").alias("held")).where(F.col("held") > capacity).select("depth", "over"), "dedup-splits")
    depth = up.join(F.broadcast(splits), ["depth", "over"]).groupBy("prefix").agg(F.count("*").cast("int").alias("depth"))
    found = fine.select("prefix").join(depth, "prefix", "left").select("prefix", F.coalesce("depth", F.lit(0)).alias("depth"))
    return found.select("prefix", "depth", F.concat_ws(":", F.col("depth").cast("string"), over(F.col("depth")).cast("string")).alias("bucket"))


def build_directory(docs: DataFrame, text_col: str = "text", capacity: int = CAPACITY, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The directory of docs' texts: at most 2^FINE_BITS rows (prefix, depth, bucket)."""
    hashes = docs.select(hash_of(whole_text(text_col)).alias("hash")).distinct()
    fine = staged(hashes.groupBy(hash_prefix(F.col("hash"), FINE_BITS).alias("prefix")).agg(F.count("*").alias("n")), "dedup-prefixes")
    n = fine.agg(F.sum("n")).first()[0] or 0
    return staged(directory(fine, FINE_BITS, max(capacity, -(-n // MOST_OWNERS))), "dedup-directory")


def in_buckets(rows: DataFrame, at: DataFrame) -> DataFrame:
    """rows with the depth and bucket of their hash; the directory has a bounded size."""
    return rows.withColumn("prefix", hash_prefix(F.col("hash"), FINE_BITS)).join(F.broadcast(at), "prefix").drop("prefix")


def build_index(docs: DataFrame, at: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """The index: (bucket, depth, hash, digest, keep_id, group_size), one row for each distinct text, in files by key range."""
    text = whole_text(text_col)
    rows = in_buckets(docs.select(F.col(id_col).alias("id"), text.alias("text"), hash_of(text).alias("hash")), at)
    classes = rows.groupBy("bucket", "depth", "hash", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    classes = staged(classes.select("bucket", "depth", "hash", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"), "keep_id", "group_size"), "dedup-classes")
    owners = max(1, at.select("bucket").distinct().count())
    return staged(classes.repartitionByRange(owners, "bucket", "hash").sortWithinPartitions("bucket", "hash"), "dedup-index")


def look_up(docs: DataFrame, at: DataFrame, index: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(id, hash, digest, keep_id, group_size) for each row of docs whose bucket holds its text."""
    text = whole_text(text_col)
    rows = in_buckets(docs.select(F.col(id_col).alias("id"), hash_of(text).alias("hash"), F.sha2(F.encode(text, "UTF-8"), 256).alias("digest")), at)
    is_hot = F.col("hash").isin(_hot_hashes(index))
    rows = rows.withColumn("salt", F.when(is_hot, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0).cast("int"))
    parts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    keys = ["bucket", "hash", "digest", "salt"]
    return rows.join(index.withColumn("salt", F.explode(parts)).select(*keys, "keep_id", "group_size"), keys).select("id", "hash", "digest", "keep_id", "group_size")


def _hot_hashes(index: DataFrame) -> list[int]:
    """Hashes of the texts that more than 1 / HOT_SHARE of all rows repeat, so at most HOT_SHARE."""
    total = index.agg(F.sum("group_size")).first()[0] or 0
    return [r["hash"] for r in index.where(F.col("group_size") > max(SALTS, total / HOT_SHARE)).select("hash").distinct().collect()]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for each row."""
    at = build_directory(docs, text_col, capacity, hash_of)
    found = look_up(docs, at, build_index(docs, at, id_col, text_col, hash_of), id_col, text_col, hash_of)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row of each distinct text (of the largest id, null ids last), with all its columns; which of rows of one id and text stays is not stated.

    Rows are grouped in their buckets as for the index, but the row that stays is carried along, so no look-up has to move the texts again.
    """
    at = build_directory(docs, text_col, capacity, hash_of)
    text = whole_text(text_col)
    rows = in_buckets(packed(docs, text=text, hash=hash_of(text), last=F.struct(F.col(id_col).isNotNull(), F.col(id_col))), at)
    return rows.groupBy("bucket", "hash", "text").agg(F.max_by("doc", "last").alias("doc")).select("doc.*")
