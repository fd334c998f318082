"""Token counts through a digest cache.

A row's key is the SHA-256 of its content with the digest of the tokenizer's own file.  The rows' distinct keys are
joined with the counts that the cache (a Parquet folder) holds already; only distinct misses are encoded, and their
counts are appended to the cache.  Counts then come back to all rows by key.

Copies meet before any text moves: what is shuffled by content digest is (digest, smallest id), combined before the
shuffle, so a text that a third of all rows repeat is one row for each task.  Texts of misses are found by their row's
id, which spreads evenly; rows that repeat id and text meet in one task, which encodes one of them.

Defined results: null or empty text: 0 bytes and 0 tokens.  Repeated rows and ids keep one result each; a null id is
kept.  Columns besides id and text are ignored, whatever their names.  Whole texts are encoded, of any length.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, ByteBpe, Tables, chunks, read_tables
from .shared import give_back, new_path, staged, whole_text

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: Longer runs without a break go past the regular expressions of the fast library, which limit their stack.
LONG_RUN = 20_000


class Counter:
    """Counts one tokenizer's tokens; kind and content come from the driver, so executors need no file."""

    def __init__(self, kind: str, content: bytes):
        if kind == "model":
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_proto=content)
            self.count = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        data = json.loads(content)
        before = data.get("pre_tokenizer") or {}
        plain = data["model"]["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not data.get("normalizer") and all(not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in data.get("added_tokens", []))
        if not plain:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(content.decode())
            t.no_truncation()
            t.no_padding()
            self.count = lambda texts: [len(x) for x in t.encode_batch_fast(texts, add_special_tokens=False)]
            return
        import tiktoken

        tables = read_tables(content.decode())
        own, at = ByteBpe(tables), tables.start.tolist()
        ranks = {tables.raw[lo:hi]: i for i, (lo, hi) in enumerate(zip(at, at[1:], strict=False)) if hi > lo and i not in tables.special.values()}
        fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=tables.special)
        by_rank = _ids_follow_merges(tables)

        def count(texts: list[str]) -> list[int]:
            out = []
            for t in texts:
                if by_rank and not _long_white(t):
                    out.append(len(fast.encode(t, allowed_special="all")))
                else:
                    out.append(len(own.encode_batch([t])[0]))
            return out

        self.count = count


def _ids_follow_merges(tables: Tables) -> bool:
    """Whether a merge of lower rank always makes a token of lower id, as counting by ids needs."""
    ranks = tables.made[tables.made >= 0].tolist()  # by id
    return ranks == sorted(ranks)


def _long_white(text: str) -> bool:
    return len(text) > LONG_RUN and any(not text[i : i + LONG_RUN // 2].strip() for i in range(0, len(text) - LONG_RUN // 2, LONG_RUN // 2))


@functools.cache
def loaded(kind: str, content: bytes) -> Counter:
    return Counter(kind, content)


def encode_counts(texts: DataFrame, kind: str, content, id_type: str = "binary") -> DataFrame:
    """(digest, n_tokens) of (digest, text) rows; a task encodes each digest once, however many of its rows have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, seen = loaded(kind, content.value), set()
        for batch in batches:
            digests = batch.column(0).to_pylist()
            batch = batch.take(pa.array([k for k, d in enumerate(digests) if d not in seen and not seen.add(d)], pa.int32()))
            strings = batch.column(1).to_pylist()
            n = [c for lo, hi in chunks(list(map(len, strings))) for c in counter.count(strings[lo:hi])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["digest", "n_tokens"])
        give_back()

    return texts.mapInArrow(run, f"digest {id_type}, n_tokens long")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row.

    tokenizer_path: .json (tokenizers) or .model (sentencepiece), read by the driver.  cache_path: a Parquet folder that
    outlives the call; None: a new one in the shared folder.  limit: over_limit is n_tokens > limit.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, "rb") as f:
        content = f.read()
    version = hashlib.sha256(content).hexdigest()
    cache_path = cache_path or new_path(spark, "token-cache")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"))

    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    missing = rows.groupBy("digest").agg(F.min("id").alias("id")).join(stored, "digest", "left_anti")
    firsts = missing.select(F.col("id").alias("first_id"), F.col("digest").alias("first_digest"))
    misses = rows.join(firsts.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("first_id")) & (F.col("digest") == F.col("first_digest")), "left_semi")
    counted = encode_counts(misses.select("digest", "text"), "model" if tokenizer_path.endswith(".model") else "json", spark.sparkContext.broadcast(content))
    fresh = staged(counted.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens")), "token-counts")
    fresh.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)

    known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    known = staged(known, "token-counts-known")  # a plain scan below the join, so that AQE can split a digest that many rows share
    counts = rows.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")).join(known, "digest")
    return counts.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
