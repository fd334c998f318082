"""The prefix trie, the pivot index and whitening against brute force: on the small tables given, and on rows that are odd in every way."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from tradeloom.llm import pivot_index, prefix_trie, queries, whitening

SF = "/root/testdata/sf0.001"
CLASHING = ["c", "d", "key", "doc", "id", "v", "x", "base", "n", "least"]


def clash(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"of {c}") for c in CLASHING})


def brute_trie(rows):
    """rows: (conv_id, turn, role, text); turns of one number by the digest that the operator states."""
    key = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).digest()[:16]
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), key(role or "", text or ""), (role or "", text or "")))
    own = {c: [x[2] for x in sorted(v)] for c, v in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append((c, len(seq)))
    kids, leaves, saved = {}, {}, {}
    for p in nodes:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, m in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
            saved[p[:d]] = saved.get(p[:d], 0) + ((len(m) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, m in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c, n in m if n == len(p)))
        up = min(c for c, _ in nodes[p[:-1]]) if p else None
        out.append((min(m)[0], len(p), up, len(m), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_turns():
    rng = random.Random(4)
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, 1, "user", "é\U0001f600"), (7, 1, "user", "é\U0001f600"), (7, 1, "assistant", ""), (300, 0, "user", "x" * 50_000)]
    for c in range(100, 260):  # a first part that most share, long common parts, short ends below them, and copies
        stem = [("user", f"hot {k}") for k in range(rng.choice([1, 2, 3, 6, 6, 13, 40]))]
        stem += [("user", f"end {rng.randrange(30)}") for _ in range(rng.randrange(3))]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(stem)]
    return rows + [(200_000 + c, k, "u", f"copy {k}") for c in range(0, 40) for k in range(4)] + [(10**12, 5, "u", "far")]


@pytest.mark.parametrize("limit", [2, 40, 20_000])
def test_trie(spark, limit, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    odd = spark.createDataFrame(odd_turns(), "conv_id long, turn long, role string, text string").repartition(5)
    given = queries.table(spark, SF, "conversations")
    for df in (odd, given, odd.where("false")):
        want = brute_trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])
        got = prefix_trie.conversation_trie(clash(df), limit=limit)
        cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=str) == want


def test_double_array_packs_and_walks():
    rng = random.Random(1)
    seqs = sorted({tuple(rng.randrange(6) for _ in range(rng.randrange(7))) for _ in range(400)})
    keys = [[bytes([k]) for k in s] for s in seqs]
    ones = np.ones(len(seqs), np.int64)
    f = prefix_trie.shard_nodes(keys, [[1] * len(k) for k in keys], ones, np.arange(len(seqs)), 0)
    prefixes = {s[:d] for s in seqs for d in range(len(s) + 1)}
    assert len(f["slot"]) == len(prefixes) == len(set(f["slot"]))
    assert sorted(f["n"]) == sorted(sum(s[: len(p)] == p for s in seqs) for p in prefixes)
    assert f["leaves"][0] + (f["children"][0] == 0) == sum(not any(q[: len(p)] == p and q != p for q in prefixes) for p in prefixes)


def brute_links(rows, least=0.9):
    """(n_links, component) of each (id, vector or None); rows of equal ids stay apart."""
    dim = max((len(v) for _, v in rows if v), default=0)
    usable = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.array([[*rows[k][1], *[0.0] * (dim - len(rows[k][1]))] for k in usable], dtype=float).reshape(len(usable), dim)
    m = m / np.abs(m).max(axis=1, keepdims=True) if len(m) else m
    m = m / np.linalg.norm(m, axis=1, keepdims=True) if len(m) else m
    close = m @ m.T >= least
    same = {k: k for k in range(len(rows))}

    def find(k):
        while same[k] != k:
            k = same[k]
        return k

    links = [0] * len(rows)
    for a, k in enumerate(usable):
        for b in np.flatnonzero(close[a]):
            if b != a:
                links[k] += 1
                same[find(usable[b])] = find(k)
    ids = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(k)] = min(i, ids.get(find(k), i))
    return sorted(((rows[k][0], links[k], ids.get(find(k))) for k in range(len(rows))), key=str)


def got_links(df):
    out = df.collect()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)
    return sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in out), key=str)


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)


def test_near_embeddings_of_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    unit = lambda: (lambda v: v / np.linalg.norm(v))(rng.standard_normal(16))
    rows = [(1, None), (2, []), (3, [0.0] * 16), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1e-300, 0.0]), (8, [1.0]), (9, [1e300]), (None, [1.0]), (None, None), (9, [-1.0]), (9, [-1.0])]
    base = unit()
    hot = [(100 + k, (base + 0.05 * unit()).tolist()) for k in range(150)]  # one group of near copies
    exact = [(1_000 + k, unit().tolist()) for k in range(3)]
    rows += hot + [(k + 10 * j, v) for k, v in exact for j in range(20)] + [(2_000 + k, unit().tolist()) for k in range(100)]
    monkeypatch.setattr(pivot_index, "BLOCK", 40)
    assert got_links(pivot_index.near_duplicates(clash(vectors(spark, rows)))) == brute_links(rows)
    assert got_links(pivot_index.near_duplicates(vectors(spark, rows[:4]))) == brute_links(rows[:4])
    assert pivot_index.near_duplicates(vectors(spark, rows).where("false")).count() == 0


def test_recall_at_the_threshold(spark):
    """Pairs of cosine 0.9 to 0.93, where an index misses most."""
    rng = np.random.default_rng(5)
    rows, pairs = [], 1_500
    for k in range(pairs):
        a, u = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        u -= (u @ a) * a
        u /= np.linalg.norm(u)
        c = rng.uniform(0.9001, 0.93)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * u).tolist())]
    got = got_links(pivot_index.near_duplicates(vectors(spark, rows)))
    found = sum(n for _, n, _ in got)
    assert found <= 2 * pairs and found >= 0.9 * 2 * pairs
    assert all(c == i - i % 2 for i, n, c in got if n)


def test_near_embeddings_of_the_table(spark):
    df = queries.table(spark, SF, "embeddings")
    assert got_links(queries.op12_near_embeddings(spark, SF)) == brute_links([(r["vec_id"], list(r["embedding"])) for r in df.collect()])


def brute_whitened(rows, components=16):
    """(n, deviations by row, eigenvalues, vectors, whitened by row) in whole numbers and NumPy."""
    kept = [(i, [int(np.floor(64 * x)) + 1_000_000 for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = lambda x: np.array([(n * a - s) / n for a, s in zip(x, sums, strict=True)])
    m = np.array([centred(x) for x in fit])
    e, w = np.linalg.eigh(m.T @ m / n)
    e, w = e[::-1], w[:, ::-1]
    k = min(components, int((e > 1e-9 * e[0]).sum()))
    out = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)), centred(x) @ w[:, :k] / np.sqrt(e[:k])) for i, x in kept]
    return n, e, k, out


def check_whitened(df, rows):
    n, e, k, want = brute_whitened(rows)
    got = {}
    for r in df.collect():
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r)
    assert sum(len(x) for c in got.values() for x in c.values()) == k * len(want)
    sign = None
    for i, dev, y in want:
        mine = got[(i, dev)]
        assert sorted(mine) == list(range(1, k + 1))
        z = np.array([mine[c][0]["whitened"] for c in range(1, k + 1)])
        sign = np.sign(z * y) if sign is None and (np.abs(y) > 1e-3).all() else sign
        assert np.allclose(np.abs(z), np.abs(y), atol=1e-6) if sign is None else np.allclose(z * sign, y, atol=1e-6)
        r = mine[1][0]
        assert r["n"] == n and r["identity_error"] < 1e-9 and abs(r["explained"] - e[0] / e.sum()) < 1e-9
    return sign


def test_whitening(spark):
    rng = np.random.default_rng(7)
    data = rng.standard_normal((400, 24)) * np.linspace(3, 0.5, 24)
    rows = [(k, v.tolist()) for k, v in enumerate(data)] + [(1, data[0].tolist()), (None, data[1].tolist())] + [(900 + k, data[2].tolist()) for k in range(120)]
    odd = [(500, None), (501, [None] * 24), (502, [float("nan")] * 24), (503, [float("-inf"), *[0.0] * 23]), (504, []), (505, [1.0])]
    df = clash(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(40))
    assert check_whitened(whitening.whiten(df), rows) is not None
    assert whitening.whiten(df.where("vec_id is null and vec_id > 0")).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert whitening.whiten(one).count() == 0
    far = [(k, [1e290 * (-1) ** k, float(k)]) for k in range(4)]
    got = whitening.whiten(spark.createDataFrame(far, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 4 and all(r["deviation"] is None and r["identity_error"] < 1e-4 for r in got)


def test_whitening_of_the_table(spark):
    df = queries.table(spark, SF, "embeddings")
    check_whitened(queries.op13_whitening(spark, SF), [(r["vec_id"], list(r["embedding"])) for r in df.collect()])


@pytest.mark.parametrize("kind", ["equal", "graded", "cut", "pairs", "thin"])
def test_bidiagonal_solver(kind):
    rng = np.random.default_rng(9)
    q = np.linalg.qr(rng.standard_normal((40, 40)))[0]
    a = {
        "equal": np.vstack([q, -q]), "graded": rng.standard_normal((200, 40)) * np.logspace(0, -9, 40), "cut": np.diag(np.arange(40.0)),
        "pairs": np.linalg.qr(rng.standard_normal((200, 40)))[0] * np.r_[np.ones(20), 1 + 1e-10 * np.arange(20)], "thin": rng.standard_normal((200, 3)) @ rng.standard_normal((3, 40)),
    }[kind]
    r = np.linalg.qr(a, mode="r")
    diagonal, upper, w = whitening.bidiagonal(r)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    got = whitening.dqds(diagonal, upper)
    big = want > 1e-20 * want[0]
    assert np.allclose(got[big], want[big], rtol=1e-6 if kind == "graded" else 1e-10)
    basis, e, trace = whitening.principal(r, len(a))
    assert np.abs(basis.T @ basis - np.eye(len(e))).max() < 1e-12 and abs(trace - (a**2).sum() / len(a)) < 1e-9 * trace
    assert np.abs(r.T @ (r @ basis) / len(a) - basis * e).max() < 1e-12 * e[0]
