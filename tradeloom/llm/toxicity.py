"""Toxicity by a factorization machine over hashed terms.

Terms are a text's words and the character n-grams inside them, A-Z and other letters lower-cased, hashed to 2^18 buckets; a text
has for each of its buckets half a point for having it and up to half for how often, against the text's number of words.  Training takes at most `sample_rows` labelled ids (by their hash; all labels when there are
fewer) with one row for each (of rows that repeat an id, the one whose terms have the smallest hash), keeps the `TERMS` buckets that tell the labels apart best by chi-square and the COMMON_TERMS buckets that most rows have (a term
that alone says nothing may still say much beside another), and fits bias, weights and FACTORS latent
factors for each bucket by logistic loss: score = sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>).  The pairwise part
learns that two terms together mean more, or less, than each alone.  The fit is deterministic.

The sample's terms stay in a staged table; Spark counts them, and what reaches the driver is the chosen buckets and the sampled
rows' values in them.  All texts are scored whole in Arrow batches, without a shuffle.

Defined results: null or empty text scores by the bias alone.  Rows without label, or whose label is null, do not train; repeated labels of one id count once,
as the largest.  Without both labels in the sample, every score is the sample's share of label 1 (0 without labels).
Repeated rows get one result each; columns besides id and text are ignored, whatever their names.
"""

from __future__ import annotations

import collections
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import give_back, staged, whole_text

BUCKETS = 1 << 18
TERMS = 500
COMMON_TERMS = 700
FACTORS = 4
STEPS = 200
SAMPLE_ROWS = 12_000
GRAM = 5
THRESHOLD = 0.3
REMEMBERED_WORDS = 150_000
_WORDS = re.compile(r"[^\W_]+").findall


@functools.lru_cache(maxsize=REMEMBERED_WORDS)
def term_buckets(word: str) -> tuple[int, ...]:
    """Buckets of a word and of its character n-grams; each distinct one once."""
    grams = {word[i : i + GRAM] for i in range(len(word) - GRAM + 1)} if len(word) > GRAM else ()
    return (zlib.crc32(b"w" + word.encode()) % BUCKETS, *{zlib.crc32(b"g" + g.encode()) % BUCKETS for g in grams})


def text_buckets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """A text's buckets with the value of each."""
    words = collections.Counter(_WORDS(text.lower()))
    n: collections.Counter[int] = collections.Counter()
    for w, k in words.items():
        for b in term_buckets(w):
            n[b] += k
    at = np.array(sorted(n), dtype=np.int32)
    return at, values(np.array([n[b] for b in at.tolist()], dtype=float), sum(words.values()))


def values(counts: np.ndarray, n_words: int) -> np.ndarray:
    return (0.5 + 0.5 * np.minimum(1.0, np.sqrt(counts * 20 / max(1, n_words)))).astype(np.float32)


class FactorizationMachine:
    """Weights over the chosen buckets."""

    def __init__(self, buckets: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.bias, self.weights, self.factors = float(bias), weights, factors
        self.place = {int(b): k for k, b in enumerate(buckets)}

    @classmethod
    def fit(cls, chosen: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> FactorizationMachine:
        """chosen: the buckets that count; rows: for each text the buckets it has and their values (others are left out)."""
        share = float(labels.mean()) if len(labels) else 0.0
        if share in (0.0, 1.0):
            return cls(np.zeros(0), np.clip(np.log(max(share, 1e-6) / max(1 - share, 1e-6)), -14, 14), np.zeros(0), np.zeros((0, FACTORS)))
        chosen = np.sort(chosen)
        x = np.zeros((len(rows), len(chosen)), dtype=np.float32)
        for k, (buckets, value) in enumerate(rows):
            at = np.searchsorted(chosen, buckets)
            known = np.append(chosen, -1)[at] == buckets
            x[k, at[known]] = value[known]
        y = labels.astype(np.float32)
        rng = np.random.default_rng(7)
        params = [np.array([np.log(share / (1 - share))], np.float32), np.zeros(len(chosen), np.float32), (rng.standard_normal((len(chosen), FACTORS)) * 0.01).astype(np.float32)]
        mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        decay = (0.0, 3e-5, 1e-4)
        for step in range(1, STEPS + 1):
            b, w, v = params
            grads = [np.zeros_like(p) for p in params]
            for lo in range(0, len(x), 2_000):  # so that no second matrix of the sample's size is held
                part = x[lo : lo + 2_000]
                part2, xv = part**2, part @ v
                z = b[0] + part @ w + 0.5 * ((xv**2).sum(1) - part2 @ (v**2).sum(1))
                g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[lo : lo + 2_000]) / len(y)
                grads[0] += g.sum()
                grads[1] += part.T @ g
                grads[2] += part.T @ (g[:, None] * xv) - v * (part2.T @ g)[:, None]
            for k, grad in enumerate(grads):
                grad = grad + decay[k] * params[k]
                mean[k] = 0.9 * mean[k] + 0.1 * grad
                square[k] = 0.999 * square[k] + 0.001 * grad**2
                params[k] = params[k] - 0.05 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
        return cls(chosen, params[0][0], params[1].astype(np.float64), params[2].astype(np.float64))

    def forget(self) -> None:
        """Drop what scores() remembers of words."""
        self.__dict__.pop("known", None)

    def scores(self, texts: list[str]) -> np.ndarray:
        place, known = self.place, self.__dict__.setdefault("known", {})
        out = np.full(len(texts), self.bias)
        for k, text in enumerate(texts):
            found: dict[int, int] = {}
            words = _WORDS(text.lower())
            for w, n in collections.Counter(words).items():
                at = known.get(w)
                if at is None:
                    if len(known) >= REMEMBERED_WORDS:
                        known.clear()
                    at = known[w] = tuple(place[b] for b in _fresh_buckets(w) if b in place)
                for i in at:
                    found[i] = found.get(i, 0) + n
            if found:
                i = np.array(sorted(found))
                x = values(np.array([found[j] for j in i.tolist()], dtype=float), len(words)).astype(float)
                v = self.factors[i] * x[:, None]
                out[k] += (self.weights[i] * x).sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum())
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


_fresh_buckets = term_buckets.__wrapped__


def tell_apart(terms: DataFrame, n_terms: int, n_common: int) -> list[int]:
    """The buckets of (y, buckets) rows whose presence differs most by label, by chi-square, and the n_common that most rows have; of ties the smaller bucket.

    Counted in Spark; buckets that fewer than five rows have do not count.
    """
    totals = terms.agg(F.avg("y").alias("share"))
    n = terms.select("y", F.explode("buckets").alias("b")).groupBy("b").agg(F.count("*").alias("n"), F.sum("y").alias("one")).where("n >= 5")
    gap, spread = F.col("one") - F.col("n") * F.col("share"), F.col("n") * F.col("share") * (1 - F.col("share"))
    chi = n.crossJoin(F.broadcast(totals)).withColumn("chi", gap * gap / F.greatest(spread, F.lit(1e-9)))  # one row
    first = staged(chi.select("b", "n", "chi"), "toxicity-buckets")
    return sorted({r["b"] for key, most in (("chi", n_terms), ("n", n_common)) for r in first.orderBy(F.desc(key), "b").limit(most).collect()})


def held_out(id_col: str) -> Column:
    """Rows kept from training: the crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """The machine, fitted on labelled rows that are not held out."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("known_id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen = staged(known.orderBy(F.xxhash64("known_id"), "known_id").limit(sample_rows), "toxicity-labels")
    sample = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("known_id")).select("id", "y", "text")  # at most sample_rows ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                found = [text_buckets(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([b for b, _ in found], pa.list_(pa.int32())), pa.array([v for _, v in found], pa.list_(pa.float32()))], ["id", "y", "buckets", "values"])
        term_buckets.cache_clear()
        give_back()

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, y int, buckets array<int>, values array<float>"
    once = sample.mapInArrow(run, schema).groupBy("id").agg(F.min_by(F.struct("y", "buckets", "values"), F.xxhash64("buckets", "values")).alias("x"))  # an id may have any number of rows
    terms = staged(once.select("id", "x.*"), "toxicity-terms")
    chosen = tell_apart(terms, TERMS, COMMON_TERMS)
    held = F.filter(F.arrays_zip("buckets", "values"), lambda x: x["buckets"].isin(chosen) if chosen else F.lit(False))
    rows = terms.select("y", held["buckets"].alias("b"), held["values"].alias("v"), F.xxhash64("id", "y", "buckets").alias("order")).toArrow()  # sample_rows rows of at most TERMS + COMMON_TERMS values
    rows = rows.take(pa.compute.sort_indices(rows["order"])).combine_chunks()
    lists = [(b.values.to_numpy().astype(np.int64), v.values.to_numpy().astype(np.float32)) for b, v in zip(rows["b"], rows["v"], strict=True)]
    return FactorizationMachine.fit(np.array(chosen, dtype=np.int64), lists, rows["y"].to_numpy().astype(float))


def score_toxicity(docs: DataFrame, machine: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for each row."""
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # TERMS + COMMON_TERMS buckets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(shared.value.scores(batch.column(1).to_pylist()), 6))], ["id", "score"])
        shared.value.forget()
        give_back()

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def keep_clean(docs: DataFrame, machine: FactorizationMachine, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(np.round(shared.value.scores(texts), 6) < threshold, pa.bool_()))
        shared.value.forget()
        give_back()

    return docs.mapInArrow(run, docs.schema)
