"""Helpers that the training-data operators share: the cluster's shared folder and staged tables."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts that rows of one id and text are dealt to.
SALTS = 32
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset, one of our own, on a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tradeloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def _freeing_shuffles(spark: SparkSession):
    """Shuffle files go when the query that made them ends, not when the driver collects its garbage."""
    before = spark.conf.get(_FREE_SHUFFLES, None)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_FREE_SHUFFLES)
        else:
            spark.conf.set(_FREE_SHUFFLES, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df into the shared folder and read it again: lineage ends there, and no executor's loss costs more than the step at hand."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _freeing_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(col: str) -> Column:
    """The text itself; a null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """A-Z only, as the contracts ask; other letters keep their case."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bound(value: Column, body) -> Column:
    """body(value) with value taken once, however often body names it and wherever the optimizer moves it."""
    return F.transform(F.array(value), body)[0]


def digest_of(text: Column) -> Column:
    """32 bytes that stand for a text."""
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def packed(docs: DataFrame, **named: Column) -> DataFrame:
    """(doc, the named columns): doc is the whole row as one column, so that no column of docs can clash with one of ours."""
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    return docs.select(row.alias("doc"), *[value.alias(name) for name, value in named.items()])


def without_rows(rows: DataFrame, lost: DataFrame) -> DataFrame:
    """The rows (doc, id, digest) whose id and digest are not in lost (id, digest); null ids are equal.

    lost grows with the table, so it is never broadcast: the plan, and what it moves, is the same at every size.
    """
    lost = lost.select(F.col("id").alias("lost_id"), F.col("digest").alias("lost_digest")).hint("merge")
    return rows.join(lost, F.col("id").eqNullSafe(F.col("lost_id")) & (F.col("digest") == F.col("lost_digest")), "left_anti")


def kept_rows(docs: DataFrame, id_col: str, text_col: str, marked: DataFrame) -> DataFrame:
    """docs without the rows of `marked` (id, digest, once), but one row of each (id, digest) that is marked once; null ids are equal."""
    tie = F.xxhash64(*[F.col("`" + c.replace("`", "``") + "`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    rows = packed(docs, id=F.col(id_col), digest=digest_of(whole_text(text_col)), tie=tie, salt=F.floor(F.rand(1) * SALTS).cast("int"))
    kept = without_rows(rows, marked).select("doc")
    again = marked.where("once")
    if not again.isEmpty():
        # rows of one id and text may be a large part of the table: salted, so that each task gives one row at most
        salted = again.select(F.col("id").alias("again_id"), F.col("digest").alias("again_digest"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("again_salt"))
        found = rows.join(salted, F.col("id").eqNullSafe(F.col("again_id")) & (F.col("digest") == F.col("again_digest")) & (F.col("salt") == F.col("again_salt")), "left_semi")
        kept = kept.unionByName(found.groupBy("id", "digest").agg(F.min_by("doc", "tie").alias("doc")).select("doc"))
    return kept.select("doc.*")


def give_back() -> None:
    """At a task's end: Python workers live on and serve later steps, so memory that is free goes back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
