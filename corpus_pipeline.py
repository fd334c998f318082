"""The corpus pipeline: five stages from documents to token ids, each written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeloom.llm import bpe, decontamination, exact_dedup, ngram_join, toxicity
from tradeloom.llm.shared import staged

TOKENIZER = "byte_bpe_50k.json"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learned from all labels that are not held out, of the documents at hand.

    Null and empty texts score by the bias alone; without labels of both kinds every score is their share, so nothing goes for want of labels.
    """
    machine = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, machine)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, one row, of the largest id; null counts as empty, and a null id comes after all others."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked by at least 80 % common five-word shingles, one row, of the smallest id; rows without words all stay."""
    return ngram_join.keep_one(docs, n_words=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage that is at least 80 % similar to a benchmark item; without items, all of them."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and whether decoding gives the text again; null and empty texts have no ids."""
    rows = docs.select(F.struct("doc_id", "lang", "source").alias("key"), "text")
    out = bpe.encode_checked(rows, public_tokenizers.path(TOKENIZER), id_col="key")
    return out.select("key.doc_id", "key.lang", "key.source", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("BPE encoding and decoding", encode),
]

#: A learned score, and SimHash windows, are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-").lower())
    return docs
