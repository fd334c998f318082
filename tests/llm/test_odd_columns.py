"""Stages and operators on columns that clash with the operators' own names, forced hash collisions, repeated and null ids."""

import random

import pytest
from pyspark.sql import functions as F

from tradeloom.llm import decontamination, exact_dedup, ngram_join, sharding, shared

CLASHING = ["lost_id", "lost_digest", "lost_hash", "lost_content", "again_id", "salt", "doc", "id", "digest", "hash", "tie", "row", "bucket", "label", "a.b", "n"]


def kept_rows(df):
    return sorted([(r["doc_id"], r["text"]) for r in df.collect()], key=str)


@pytest.fixture(scope="module")
def clashing(spark):
    rng = random.Random(2)
    text = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    long, item = text(60), text(40)
    rows = [(1, " ".join(long)), (2, " ".join(long)), (3, " ".join([*long[:-1], "other"])), (4, " ".join(text(9) + item + text(9))), (5, None), (None, "x y"), (None, "x y"), (6, ""), (6, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.withColumns({c: F.lit(f"of {c}") for c in CLASHING}), spark.createDataFrame([(9, " ".join(item), "q")], "item_id long, text string, label string")


def test_columns_that_clash(clashing):
    docs, items = clashing
    first = exact_dedup.keep_first(docs)
    single = ngram_join.keep_one(docs)
    left = decontamination.drop_contaminated(docs, items)
    for out in (first, single, left):
        assert out.columns == docs.columns and all(r[c] == f"of {c}" for r in out.collect() for c in CLASHING)
    assert [i for i, _ in kept_rows(first)] == [2, 3, 4, 6, 6, None]
    assert [i for i, _ in kept_rows(single)] == [1, 4, 5, 6, 6, None]
    assert [i for i, _ in kept_rows(left)] == [1, 2, 3, 5, 6, 6, None, None]
    assert exact_dedup.exact_dedup(docs).count() == sharding.assign_shards(docs, 100).count() == ngram_join.join_components(docs).count() == docs.count()


@pytest.mark.parametrize("hash_of", [lambda c: F.lit(7).cast("long"), lambda c: (F.length(c) % 2).cast("long") * (1 << 62)])
def test_exact_dedup_under_collisions(spark, hash_of):
    """Texts of one hash are chained: none is lost to another, with or without copies."""
    for rows in ([(1, "aaa"), (2, "aaa"), (3, "bbb")], [(1, "aaa"), (2, "aaa"), (3, "bbb"), (5, "bbb"), (None, "bbb"), (4, "cc"), (6, None), (7, "")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        last = {}
        for i, t in rows:
            last[t or ""] = max(i or -1, last.get(t or "", -1))
        got = exact_dedup.exact_dedup(docs, capacity=1, hash_of=hash_of).collect()
        assert sorted((r["doc_id"], r["keep_id"]) for r in got if r["doc_id"]) == sorted((i, last[t or ""]) for i, t in rows if i)
        kept = [(i, t or "") for i, t in kept_rows(exact_dedup.keep_first(docs, capacity=1, hash_of=hash_of))]
        assert kept == sorted([(i, t) for t, i in last.items()], key=str)


def test_rows_meet_their_bucket_only(spark):
    """What the directory says decides: rows of a bucket that it leaves out, or sends elsewhere, find nothing."""
    docs = spark.createDataFrame([(k, f"text {k % 150}") for k in range(300)], "doc_id long, text string")
    at = exact_dedup.build_directory(docs, capacity=20)
    index = exact_dedup.build_index(docs, at)
    assert exact_dedup.look_up(docs, at, index).count() == 300
    bucket = at.select("bucket").orderBy("bucket").first()[0]
    inside = {r["id"] for r in exact_dedup.look_up(docs, at.where(F.col("bucket") != bucket), index).collect()}
    assert 0 < len(inside) < 300
    held = index.where(F.col("bucket") == bucket).agg(F.sum("group_size")).first()[0]
    assert len(inside) == 300 - held
    moved = at.withColumn("bucket", F.when(F.col("bucket") == bucket, "elsewhere").otherwise(F.col("bucket")))
    assert {r["id"] for r in exact_dedup.look_up(docs, moved, index).collect()} == inside


def brute_shards(rows, limit):
    """depth:prefix of each (hash, bytes): split while a bucket is too large and holds two hashes."""
    out = {}

    def split(part, depth):
        if sum(n for _, _, n in part) <= limit or len({h for _, h, _ in part}) == 1:
            out.update({i: (depth, part[0][1] >> (60 - depth)) for i, _, _ in part})
            return
        for bit in (0, 1):
            half = [x for x in part if x[1] >> (59 - depth) & 1 == bit]
            if half:
                split(half, depth + 1)

    split(rows, 0)
    return out


@pytest.mark.parametrize("limit", [20, 300, 5_000])
def test_shards_split_on_any_bit(spark, limit):
    """Against a recursive splitting, with hashes that differ in late bits only and one hash of many rows."""
    import hashlib

    rng = random.Random(3)
    rows = [(k, "x" * rng.randrange(1, 60)) for k in range(200)] + [(500, "y" * 30)] * 40 + [(501, "z" * 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    h = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16)
    want = brute_shards([(i, h(i), len(t)) for i, t in rows], limit)
    got = sharding.assign_shards(docs, limit).collect()
    assert len(got) == len(rows)
    for r in got:
        depth, prefix = want[r["doc_id"]]
        assert r["shard"].split(".")[0] == f"{depth}:{prefix}" and r["depth"] == depth
        assert r["shard_bytes"] <= limit or r["oversize"] and r["n_bytes"] > limit
        assert ("." in r["shard"]) == (r["doc_id"] == 500 and limit < 40 * 30)


def test_shards_need_bits_beyond_the_first_round(spark, monkeypatch):
    """Hashes that share their first 50 bits are split all the same."""
    monkeypatch.setattr(sharding, "row_hash", lambda c: F.col(c))
    rows = [((1 << 50) * 5 + k, "x" * 10) for k in range(64)] + [(1 << 58, "y")]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 40).collect()
    want = brute_shards([(i, i, len(t)) for i, t in rows], 40)
    assert {r["doc_id"]: (r["depth"], r["shard"]) for r in got} == {i: (d, f"{d}:{p}") for i, (d, p) in want.items()}


def test_no_machine_local_folder_on_a_cluster():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Session)
