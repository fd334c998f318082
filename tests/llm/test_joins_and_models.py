"""Joins and models: against brute force on planted copies, and on rows that are odd in every way."""

import random
import zlib

import pytest

from tradeloom.llm import decontamination, ngram_join, queries, toxicity
from tradeloom.llm.components import connected_components

from . import brute
from .test_contracts import ODD, SF

pytest.importorskip("public_tokenizers")


def planted(seed=3):
    """Texts with groups of near copies: edited words, chains of edits, texts inside texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(400))
    common = [word() for _ in range(60)]
    out = []
    for size in (1, 2, 3, 9, 11, 12, 14, 20, 40, 80, 160, 400):
        base = [word() for _ in range(size)]
        out += [base, base, base + [word()]]
        chain = list(base)
        for _ in range(12):
            chain = list(chain)
            chain[rng.randrange(len(chain))] = word()
            out.append(chain)
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = word()
            out.append(copy + common * rng.randrange(2))
    out += [common + [word() for _ in range(rng.randrange(1, 30))] for _ in range(40)]
    texts = [rng.choice([" ", "\n", "\t "]).join(w.upper() if rng.random() < 0.1 else w for w in t) for t in out]
    rng.shuffle(texts)
    return texts


@pytest.fixture(scope="module")
def rows(spark):
    texts = planted() + ODD
    rows = [(1000 - k, t, "x", None) for k, t in enumerate(texts)] + [(None, "a", None, 1), (None, planted()[0], None, 2), (1000, texts[0], None, 1), (1000, texts[0], None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, label string, n long").repartition(5)


@pytest.mark.parametrize(("n_words", "percent"), [(3, 90), (5, 80), (1, 60), (2, 95)])
def test_ngram_join(rows, n_words, percent):
    got = ngram_join.join_components(rows, n_words, percent).collect()
    data = [(r["doc_id"], brute.shingles(r["text"], n_words)) for r in rows.collect()]
    big = 1 << 60
    comp = brute.components([(big if i is None else i, s) for i, s in data], percent)
    want = sorted([(i, len(s), None if comp[k] == big else comp[k]) for k, (i, s) in enumerate(data)], key=str)
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=str) == want
    assert len({c for _, _, c in want}) < len(want) - 60


def test_ngram_join_of_tables(spark, rows):
    docs = queries.table(spark, SF, "documents")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op9_ngram_jaccard_join(spark, SF).collect()}
    data = [(r["doc_id"], brute.shingles(r["text"])) for r in docs.collect()]
    comp = brute.components(data)
    assert got == {i: (len(s), comp[k]) for k, (i, s) in enumerate(data)}
    assert ngram_join.join_components(rows.where("false")).count() == 0
    kept = ngram_join.keep_one(rows)
    assert kept.columns == rows.columns


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 560)] + [(7, 3), (3, 7), (9, 9)]
    got = {r["node"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 161), 100), **dict.fromkeys(range(500, 560), 500), 7: 3, 3: 3}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def contaminated(docs, items):
    import re

    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    cut = lambda w: [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    items = [(i, cut(words(t))) for i, t in items]
    df = {}
    for _, s in items:
        for x in set(s):
            df[x] = df.get(x, 0) + 1
    from math import log1p

    n_items = sum(bool(s) for _, s in items)
    out = []
    for i, t in docs:
        s = cut(words(t))
        for k, item in items:
            best = 0
            for a in range(max(1, len(s) - len(item) + 1)) if s and set(s) & set(item) else ():
                w = set(s[a : a + len(item)])
                both = sum(log1p(n_items / df[x]) for x in w & set(item))
                best = max(best, both / (sum(log1p(n_items / df[x]) for x in set(item)) + log1p(n_items) * len(w - set(item))))
            if best >= 0.8:
                out.append((i, k, round(best, 4)))
    return sorted(out, key=str)


def test_decontamination(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + str(rng.randrange(300))
    items = [[word() for _ in range(n)] for n in (3, 5, 6, 12, 30, 60, 200)] + [[]]
    items.append(items[4][:20] + [word() for _ in range(10)])
    docs = [" ".join(items[0]), " ".join(items[0] + ["x"]), "", None, " ".join(word() for _ in range(500))]
    for item in items[1:]:
        for edits in (0, 0, 1, 2, 3):
            t = list(item)
            for _ in range(min(edits, len(t))):
                k = rng.randrange(len(t))
                t[k : k + 1] = rng.choice([[], [word()], [t[k], word()]])
            pad = [word() for _ in range(rng.randrange(100))]
            docs.append(" ".join(pad) + "... " + ", ".join(x.upper() for x in t) + "! " + " ".join(pad[::-1]))
    d = spark.createDataFrame([(k, t, 1) for k, t in enumerate(docs + ODD)] + [(None, docs[10], 2)], "doc_id long, text string, n int").repartition(3)
    b = spark.createDataFrame([(k, " ".join(t), 1) for k, t in enumerate(items)] + [(99, None, 1), (98, " ".join(items[4]), 1)], "item_id long, text string, n int")
    rows = [(r["doc_id"], r["text"]) for r in d.collect()]
    want = contaminated(rows, [(r["item_id"], r["text"]) for r in b.collect()])
    got = decontamination.find_contaminated(d, b)
    assert sorted([(r["doc_id"], r["item_id"], round(r["similarity"], 4)) for r in got.collect()], key=str) == want and len(want) > 15
    left = decontamination.drop_contaminated(d, b)
    assert left.columns == d.columns
    assert sorted([r["doc_id"] for r in left.collect()], key=str) == sorted([i for i, _ in rows if i not in {x[0] for x in want}], key=str)
    assert decontamination.find_contaminated(d.where("false"), b).count() == 0
    assert decontamination.find_contaminated(d, b.where("false")).count() == 0


def test_toxicity_on_held_out_rows(spark):
    """Learns from three quarters of the labels; the other quarter shows what it learned."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in queries.table(spark, sf, "labels").collect()}
    got = queries.op7_toxicity(spark, sf).collect()
    assert len(got) == 10_000
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["score"], labels[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in labels]
    one, zero = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    auc = sum((a > b) + 0.5 * (a == b) for a in one for b in zero) / (len(one) * len(zero))
    assert auc > 0.95
    assert sum(p for _, y, p in held if y) > 0.75 * len(one) and sum(p for _, y, p in held if not y) < 0.01 * len(zero)


def test_toxicity_of_odd_rows(spark):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(ODD)] + [(None, "a", "y"), (3, "b", None)], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(10)] + [(None, 1, "x"), (3, None, "x"), (4, 1, "x"), (4, 0, "x")], "doc_id long, toxic int, text string")
    for left in (labels, labels.where("false"), labels.where("toxic = 1")):
        machine = toxicity.fit_toxicity(docs, left)
        out = toxicity.score_toxicity(docs, machine).collect()
        assert sorted([r["doc_id"] for r in out], key=str) == sorted([r["doc_id"] for r in docs.collect()], key=str)
        assert all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score_toxicity(docs.where("false"), machine).count() == 0
    assert toxicity.keep_clean(docs, machine, threshold=1.1).count() == docs.count()


def test_pairwise_terms_are_learned():
    """A pair of terms that only together mean label 1, as no additive weights can tell."""
    rng = random.Random(1)
    texts = [" ".join(rng.sample(["rude", "group"], rng.randrange(3)) + [rng.choice("abcdef") * 3 for _ in range(6)]) for _ in range(2_000)]
    y = [float("rude" in t and "group" in t) for t in texts]
    import numpy as np

    rows = [toxicity.text_buckets(t) for t in texts]
    machine = toxicity.FactorizationMachine.fit(np.unique(np.concatenate([b for b, _ in rows])), rows, np.array(y))
    s = machine.scores(["rude group aaa", "rude aaa bbb", "group aaa bbb", "aaa bbb"])
    assert s[0] > 0.5 > max(s[1:])


def test_keep_one_of_null_and_repeated_ids(spark):
    """Kept rows as a multiset against brute force: null ids, ids of two texts, repeated rows, components of null ids only."""
    rng = random.Random(8)
    text = lambda: [f"w{rng.randrange(10_000)}" for _ in range(60)]
    near = lambda t: [*t[:-1], "other"]
    a, b, c, d, e, f = (text() for _ in range(6))
    made = [(1, a), (None, near(a)), (None, b), (None, c), (2, d), (3, near(d)), (3, e), (1, a), (1, a), (None, f), (None, f), (None, near(f)), (9, text()), (9, text())]
    rows = [(i, " ".join(t), k) for k, (i, t) in enumerate(made)] + [(None, "", 90), (None, None, 91), (4, " ", 92), (4, " ", 92)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(5)
    big = 1 << 60
    sets = [brute.shingles(t or "", 5) for _, t, _ in rows]
    # components over row numbers, so that null and repeated ids do not merge any
    comp = brute.components(list(enumerate(sets)), 80)
    groups = {}
    for k, s in enumerate(sets):
        if s:
            groups.setdefault(comp[k], []).append(k)
    least = [min(big if rows[k][0] is None else rows[k][0] for k in g) for g in groups.values()]
    want = sorted([None if i == big else i for i in least] + [rows[k][0] for k, s in enumerate(sets) if not s], key=str)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    assert sorted([i for i, _, _ in got], key=str) == want
    assert sorted([comp[n] for _, _, n in got if n < 90]) == sorted(groups) and set(got) <= set(rows)


def weighted_jaccard(window, item, benchmark):
    """Jaccard of two texts' shingles, each weighing ln(1 + texts / texts that have it), over the benchmark's distinct texts."""
    from math import log

    grams = lambda t: {" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    texts = [grams(t) for t in set(benchmark)]
    weight = lambda g: log(1 + len(texts) / max(1, sum(g in t for t in texts)))
    a, b = grams(window), grams(item)
    return sum(map(weight, a & b)) / sum(map(weight, a | b))


def test_decontamination_of_repeated_and_overlapping_items(spark):
    """Copies of an item do not lower its weights, and shingles of other items weigh in windows what they weigh in items."""
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    often, shared, single = text(64), text(40), text(100)
    benchmark = [" ".join(often)] * 40 + [" ".join(shared + text(12)) for _ in range(30)] + [" ".join(single)] + [" ".join(text(30)) for _ in range(40)]
    passages = [often[:-5] + text(5), single[:-12] + shared[:12]]  # 55 of 60 shingles; 84 of 96, and of the others 8 are those of 30 items
    docs = [" ".join(text(20) + p + text(20)) for p in passages] + [" ".join(text(200))]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(benchmark)), "item_id long, text string")
    want = {}
    for i, doc in enumerate(docs):
        words = doc.split()
        for k, item in enumerate(benchmark):
            n = len(item.split())
            best = max(weighted_jaccard(" ".join(words[s : s + n]), item, benchmark) for s in range(len(words) - n + 1)) if set(words) & set(item.split()) else 0
            if best >= 0.8:
                want[i, k] = round(best, 4)
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 4) for r in decontamination.find_contaminated(d, b).collect()}
    assert got == want and set(want) == {(0, k) for k in range(40)} | {(1, 70)}


def test_scores_against_brute_force():
    """score = sigmoid(w0 + sum of w_i x_i + sum over pairs of <v_i, v_j> x_i x_j), pair by pair."""
    import numpy as np

    rng = np.random.default_rng(3)
    texts = [None, "", "You are rude, RUDE to the group!", "the the the", "été größe 12", " ".join(f"w{k}" for k in range(3000))]
    texts = [t or "" for t in texts]
    buckets = sorted({int(b) for t in texts for b in toxicity.text_buckets(t)[0]})[::2]
    machine = toxicity.FactorizationMachine(np.array(buckets), -0.3, rng.standard_normal(len(buckets)) * 0.1, rng.standard_normal((len(buckets), 3)) * 0.1)
    want = []
    for t in texts:
        x = {machine.place[b]: float(v) for b, v in zip(*(a.tolist() for a in toxicity.text_buckets(t)), strict=True) if b in machine.place}
        at = np.array(sorted(x), dtype=int)
        xs = np.array([x[i] for i in at])
        pairs = machine.factors[at] @ machine.factors[at].T * np.outer(xs, xs)
        z = machine.bias + (machine.weights[at] * xs).sum() + (np.triu(pairs, 1).sum() if len(at) else 0)
        want.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    assert np.allclose(machine.scores(texts), want, atol=1e-6)


def test_a_pair_of_terms_that_mean_nothing_alone(spark):
    """Label 1 where both or none of two words stand: chi-square sees neither, the fitted machine tells them apart."""
    rng = random.Random(6)
    texts, y = [], []
    for _ in range(3_000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = ["insult"] * a + ["group"] * b + [rng.choice("abcdefghij") * 3 for _ in range(6)]
        rng.shuffle(words)
        texts.append(" ".join(words))
        y.append(int(a == b))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    machine = toxicity.fit_toxicity(docs, spark.createDataFrame(list(enumerate(y)), "doc_id long, toxic int"))
    held = [k for k in range(3_000) if zlib.crc32(str(k).encode()) % 4 == 2]
    right = [(s >= 0.5) == y[k] for k, s in zip(held, machine.scores([texts[k] for k in held]), strict=True)]
    assert len(held) > 600 and sum(right) > 0.95 * len(right)


def test_share_that_simhash_proposes(spark):
    """Passages at similarities from 0.8 on: all are found, SimHash alone proposes nearly all of them."""
    rng = random.Random(9)
    text = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    items = [text(rng.randrange(40, 90)) for _ in range(40)]
    docs = []
    for item in items:
        n = len(item) - 4
        cut = min(int(n * 0.11), len(item) - 5)  # that many shingles of each side differ
        docs += [text(15) + item[: len(item) - cut] + text(cut) + text(15), text(15) + item + text(9)]
    d = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.find_contaminated(d, b).collect()}
    assert got == {(k, k // 2) for k in range(len(docs))}
    assert decontamination.simhash_share(d, b) >= 0.98


def test_toxicity_takes_one_row_of_a_labelled_id(spark, monkeypatch):
    """One labelled id on 30,000 rows: the driver still sees sample_rows rows at most."""
    docs = spark.createDataFrame([(1, f"hot text {k % 9}") for k in range(30_000)] + [(k, f"text w{k}") for k in range(2, 120)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 120)], "doc_id long, toxic int")
    seen, fit = [], toxicity.FactorizationMachine.fit.__func__
    monkeypatch.setattr(toxicity.FactorizationMachine, "fit", classmethod(lambda cls, chosen, rows, y: seen.append(len(rows)) or fit(cls, chosen, rows, y)))
    toxicity.fit_toxicity(docs, labels, sample_rows=50)
    toxicity.fit_toxicity(docs, labels)
    assert 30 < seen[0] <= 50 and 80 < seen[1] <= 119


def test_unlike_windows_and_items_do_not_meet(spark):
    """A window among many unrelated items of its size meets few of them by prefix shingle and block, however common their phrases are."""
    rng = random.Random(11)
    boilerplate = "choose the best answer to the question below".split()
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [boilerplate + words(32) for _ in range(2_000)]
    texts = [" ".join(words(60) + items[k] + words(60)) for k in range(40)] + [" ".join(boilerplate + words(150)) for _ in range(200)]
    b = spark.createDataFrame([(f"b{k}", " ".join(t)) for k, t in enumerate(items)], "item_id string, text string")
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held, weights, rarest = decontamination._items(b, "item_id", "text", 0.8)
    windows, cut_for = decontamination._windows(d, held, weights, "doc_id", "text", 0.8)
    n = windows.count()
    assert n >= 40 and cut_for.count() <= 2 * n
    met = decontamination._blocks_met(windows, held, weights, rarest, 0.8).select("w", "key").distinct()
    assert met.count() < 5 * n
    found = decontamination.find_contaminated(d, b)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} >= {(k, f"b{k}") for k in range(40)}
    assert decontamination.simhash_share(d, b) >= 0.95


def test_long_lists_of_the_ngram_join(rows, monkeypatch):
    """Lists of many parts, with sets of several components in each: the same links as by brute force."""
    monkeypatch.setattr(ngram_join, "BLOCK", 7)
    monkeypatch.setattr(ngram_join, "SKIPPED", 3)
    got = ngram_join.join_components(rows, 3, 80).collect()
    data = [(r["doc_id"], brute.shingles(r["text"], 3)) for r in rows.collect()]
    big = 1 << 60
    comp = brute.components([(big if i is None else i, s) for i, s in data], 80)
    want = sorted([(i, len(s), None if comp[k] == big else comp[k]) for k, (i, s) in enumerate(data)], key=str)
    assert sorted([(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got], key=str) == want


def test_near_copies_are_dealt_once(spark, monkeypatch):
    """6,000 near copies of one text: neither pass deals twice the postings, and all are one component."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(6_000):
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(200)] = f"v{rng.randrange(10_000)}"
        texts.append((k, " ".join(copy)))
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(8)
    seen = []

    def counted(name):
        deal = getattr(ngram_join, name)

        def run(postings):
            dealt = deal(postings)
            seen.append((postings.count(), dealt.count()))
            return dealt

        monkeypatch.setattr(ngram_join, name, run)

    counted("_to_parts")
    counted("_to_pairs")
    out = ngram_join.join_components(d)
    assert {r["component_id"] for r in out.select("component_id").distinct().collect()} == {0}
    assert len(seen) == 2 and all(dealt < 2 * postings for postings, dealt in seen), seen
