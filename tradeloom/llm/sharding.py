"""Sharding by extendible hashing: every shard fits its byte limit.

The directory is indexed by the first bits of a row's hash.  A bucket whose texts exceed the limit splits on another
bit, as long as it holds rows of two hashes; the others stay as they are.  Sums of bytes for fine prefixes decide this: the first
round counts prefixes as long as the table's bytes need, and each later round looks at ROUND_BITS more bits of the buckets
that are still too large, and of no others, up to all HASH_BITS.

What no bit can split is one hash: a single text larger than the limit is a shard of its own, marked oversize; rows that share
one hash (an id that repeats) fill pages by their running bytes.

The hash is the first 60 bits of MD5 over the row's id.

Defined results: null text: 0 bytes.  Null ids hash as an empty string.  Repeated rows are placed one by one (equal rows may lie in
different pages).  Columns besides id and text are ignored, whatever their names.  An empty table gives no shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import staged, whole_text

HASH_BITS = 60
#: Bits of the first round's prefixes beyond those that an even spread would need, and bits that each later round adds.
SPARE_BITS = 3
ROUND_BITS = 8


def row_hash(id_col: str) -> Column:
    """60 bits as a positive number; from MD5 of the id alone, so any engine can repeat it."""
    return F.conv(F.substring(F.md5(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(bits: Column | int) -> Column:
    """The first bits of a row's hash."""
    return F.call_function("shiftright", F.col("hash"), (F.lit(HASH_BITS) - bits).cast("int"))


def assign_shards(docs: DataFrame, limit_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, depth, shard, shard_bytes, oversize) for each row.

    shard: `depth:prefix`, with `.page` where rows of one hash had to be paged.  shard_bytes <= limit_bytes unless oversize.
    """
    rows = staged(docs.select(F.col(id_col).alias("id"), F.octet_length(whole_text(text_col)).cast("long").alias("n_bytes"), row_hash(id_col).alias("hash"), F.monotonically_increasing_id().alias("row")), "shard-rows")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    low, high = 0, min(HASH_BITS, (total // limit_bytes + 1).bit_length() + SPARE_BITS)
    left, placed = rows, None
    while True:
        fine = left.groupBy(_prefix(high).alias("prefix")).agg(F.sum("n_bytes").alias("n_bytes"), F.min("hash").alias("least"), F.max("hash").alias("most"))
        at = staged(_buckets(fine, low, high, limit_bytes), "shard-directory")
        here = left.withColumn("prefix", _prefix(high)).join(at, "prefix")
        part = here.where("depth is not null").select("id", "n_bytes", "row", "depth", "over", "held", "one")
        placed = part if placed is None else placed.unionByName(part)
        if high == HASH_BITS or at.where("depth is null").isEmpty():
            break
        left = staged(here.where("depth is null").select(*rows.columns), "shard-left")
        low, high = high + 1, min(HASH_BITS, high + ROUND_BITS)
    placed = staged(placed.withColumn("bucket", F.concat_ws(":", F.col("depth").cast("string"), F.col("over").cast("string"))), "shard-buckets")
    fits = placed.where(F.col("held") <= limit_bytes).select("id", "n_bytes", "depth", F.col("bucket").alias("shard"), F.col("held").alias("shard_bytes"))
    cut = staged(_pages(placed.where(F.col("held") > limit_bytes), limit_bytes), "shard-pages")
    sizes = staged(cut.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes")), "shard-sizes")
    out = fits.unionByName(cut.join(sizes, "shard").select(*fits.columns))
    return out.select(F.col("id").alias(id_col), "n_bytes", F.col("depth").cast("int").alias("depth"), "shard", "shard_bytes", (F.col("shard_bytes") > limit_bytes).alias("oversize"))


def _buckets(fine: DataFrame, low: int, high: int, limit_bytes: int) -> DataFrame:
    """(prefix, depth, over, held, one): for each prefix of `high` bits the bucket of least depth, from `low` on, that no longer splits; null if all do."""
    depth = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
    up = fine.select("*", depth).withColumn("over", F.call_function("shiftright", F.col("prefix"), (F.lit(high) - F.col("depth")).cast("int")))
    sums = up.groupBy("depth", "over").agg(F.sum("n_bytes").alias("held"), (F.min("least") == F.max("most")).alias("one"))
    met = up.select("prefix", "depth", "over").join(sums, ["depth", "over"])
    final = (F.col("held") <= limit_bytes) | F.col("one")
    first = met.groupBy("prefix").agg(F.min(F.when(final, F.struct("depth", "over", "held", "one"))).alias("at"))
    return first.select("prefix", "at.*")


def _pages(rows: DataFrame, limit_bytes: int) -> DataFrame:
    """(id, n_bytes, depth, shard) of rows in buckets of one hash: a row alone in its bucket keeps its name; rows of at least half a limit stand alone, smaller ones fill pages.

    A bucket's small rows are dealt to parts of about eight limits each, so that one hot id is not one task;
    half a limit of a part's running bytes makes a page, which rows below half a limit cannot overfill.
    """
    half = max(1, limit_bytes // 2)
    parts = F.floor(F.col("held") / (8 * limit_bytes)).cast("long") + 1
    single = rows.groupBy("bucket").agg(F.count("*").alias("rows")).where("rows = 1").select("bucket")
    alone = rows.join(single, "bucket", "left_semi").select("id", "n_bytes", "depth", F.col("bucket").alias("shard"))
    many = rows.join(single, "bucket", "left_anti")
    large = many.where(F.col("n_bytes") > half).withColumn("page", F.lit(1 << 62) + F.col("row"))
    w = Window.partitionBy("bucket", "part").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    small = many.where(F.col("n_bytes") <= half).withColumn("part", F.pmod(F.xxhash64("row"), parts))
    small = small.withColumn("page", F.col("part") * (1 << 32) + F.floor((F.sum("n_bytes").over(w) - F.col("n_bytes")) / half).cast("long"))
    paged = large.unionByName(small.select(*large.columns)).select("id", "n_bytes", "depth", F.concat("bucket", F.lit("."), F.col("page").cast("string")).alias("shard"))
    return alone.unionByName(paged)
