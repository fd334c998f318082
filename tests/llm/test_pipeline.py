"""The pipeline's stages against brute force on planted rows, each on its own input."""

import random
import re

import pytest

from tradeloom.llm import queries, toxicity

from . import brute

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents of the smallest table with exact and near copies and benchmark passages put in."""
    rng = random.Random(11)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(900))
    docs = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = {r["item_id"]: r["text"] for r in queries.table(spark, SF, "benchmark").collect()}
    texts = []
    for _ in range(10):
        base = [word() for _ in range(200)]
        near = list(base)
        near[rng.randrange(200)] = word()
        texts += [" ".join(base)] * 3 + [" ".join(near)]
    texts += [" ".join(word() for _ in range(50)) + " " + t + " " + " ".join(word() for _ in range(50)) for t in list(items.values())[:8]]
    docs += [(10_000 + k, t, "en", "planted", len(t)) for k, t in enumerate(texts)] + [(20_000, None, None, None, None), (20_001, "", "en", "x", 0)]
    sf = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{sf}/documents.parquet")
    for t in ("labels", "benchmark"):
        queries.table(spark, SF, t).write.parquet(f"file://{sf}/{t}.parquet")
    return f"file://{sf}", items


def rows(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def test_stages(spark, planted):
    sf, items = planted
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]

    clean = stages["toxicity"](spark, docs, sf)
    machine = toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = {r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, machine).collect()}
    assert set(rows(clean)) == {i for i, s in score.items() if s < 0.3} and clean.columns == docs.columns

    distinct = stages["exact dedup"](spark, docs, sf)
    last = {}
    for i, t in rows(docs).items():
        last[t] = max(i, last.get(t, i))
    assert set(rows(distinct)) == set(last.values()) and distinct.columns == docs.columns

    single = stages["n-gram Jaccard join"](spark, docs, sf)
    data = [(i, brute.shingles(t, 5)) for i, t in rows(docs).items()]
    comp = brute.components(data, 80)
    want = {i for k, (i, s) in enumerate(data) if not s or comp[k] == i}
    assert set(rows(single)) == want and single.columns == docs.columns

    left = stages["benchmark decontamination"](spark, docs, sf)
    words = lambda t: " ".join(w for w in re.split(r"[\W_]+", t.lower()) if w)
    holds = {i for i, t in rows(docs).items() if any(f" {words(x)} " in f" {words(t)} " for x in items.values())}
    assert not holds & set(rows(left)) and len(holds) >= 8 and left.columns == docs.columns
    assert set(rows(docs)) - set(rows(left)) == holds

    ids = stages["BPE encoding and decoding"](spark, docs, sf).collect()
    assert len(ids) == docs.count() and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in ids)


def test_run_applies_all(spark, planted):
    sf, items = planted
    out = corpus_pipeline.run(spark, sf)
    kept = {r["doc_id"] for r in out.collect()}
    assert len(kept) == out.count() and {20_000, 20_001} & kept and max(k for k in kept if k < 20_000) < 10_040


def test_run_on_empty_and_odd_tables(spark, tmp_path):
    """No documents, labels or items; and repeated rows, null ids and null texts, with columns that clash with the stages' own."""
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    texts = ["one two three four five six seven", None, "", "x", "é ü"]
    odd = [(None if k % 4 == 0 else k % 7, texts[k % 5], "en", "s", 1) for k in range(60)]
    for name, rows in (("none", []), ("odd", odd)):
        sf = f"file://{tmp_path}/{name}"
        docs = spark.createDataFrame(rows, schema).withColumns({"lost_id": F.lit(1), "h": F.lit("h")})
        docs.write.parquet(f"{sf}/documents.parquet")
        queries.table(spark, SF, "labels").where("false").write.parquet(f"{sf}/labels.parquet")
        queries.table(spark, SF, "benchmark").where("false").write.parquet(f"{sf}/benchmark.parquet")
        out = corpus_pipeline.run(spark, sf).collect()
        assert len(out) == (len({t or "" for t in texts}) if rows else 0)
        assert all(r["round_trip"] for r in out)
