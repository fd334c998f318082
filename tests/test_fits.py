"""Batched logistic models against one fit at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradeloom.operators import fits as T
from tradeloom.operators import learning as M
from tradeloom.operators.calibration import auc_brier

FEATURES = ["a", "b", "c"]


def table(n=600, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 5.0, 100.0] + [0.0, 2.0, -40.0]
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.8 * x[:, 0] - 0.2 * (x[:, 1] - 2))))).astype(int)
    x[rng.random((n, 3)) < 0.1] = np.nan
    return x, y


def frame(spark, x, y):
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "order_idx long, a double, b double, c double, y int").repartition(5)


def fitted(x, y, used, strength=0.01):
    """One model by Newton steps; (center, mean, deviation, coefficients)."""
    center = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in x.T])
    full = np.where(np.isnan(x), center, x)
    mean, sd = full.mean(axis=0), full.std(axis=0, ddof=1)
    z = np.column_stack([np.ones(len(x)), ((full - mean) / np.where(sd > 0, sd, 1))[:, used]])
    b, ridge = np.zeros(z.shape[1]), strength * np.eye(z.shape[1])
    ridge[0, 0] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ b))
        b = b + np.linalg.solve((z.T * (p * (1 - p))) @ z / len(z) + ridge, z.T @ (y - p) / len(z) - ridge @ b)
    return center, mean, np.where(sd > 0, sd, 1), b


def brute(x, y, used, folds, embargo):
    index, out = np.arange(len(x)), np.full(len(x), np.nan)
    for lo, hi in T.fold_bounds(len(x), folds):
        train = (index < lo - embargo) | (index > hi + embargo)
        test = (index >= lo) & (index <= hi)
        if y[train].min() == y[train].max():
            out[test] = y[train].mean()
            continue
        center, mean, sd, b = fitted(x[train], y[train], used)
        z = ((np.where(np.isnan(x[test]), center, x[test]) - mean) / sd)[:, used]
        out[test] = 1 / (1 + np.exp(-(b[0] + z @ b[1:])))
    return out


def auc(y, p):
    d = p[y == 1][:, None] - p[y == 0][None, :]
    return ((d > 0) + 0.5 * (d == 0)).mean()


def test_out_of_fold_is_one_fit_at_a_time(spark):
    x, y = table()
    got = {r["order_idx"]: r["p"] for r in M.out_of_fold(frame(spark, x, y), FEATURES, 4, 20, ["order_idx"]).collect()}
    assert np.allclose([got[i] for i in range(len(y))], brute(x, y, [0, 1, 2], 4, 20), atol=1e-9)


def test_drop_one_is_one_fit_at_a_time(spark):
    x, y = table(400)
    got = {r["feature"]: (r["auc"], r["brier"]) for r in M.drop_one(frame(spark, x, y), FEATURES, 5, 10).collect()}
    for name, used in {"baseline": [0, 1, 2], "a": [1, 2], "b": [0, 2], "c": [0, 1]}.items():
        p = brute(x, y, used, 5, 10)
        assert got[name] == pytest.approx((auc(y, p), ((p - y) ** 2).mean()), abs=1e-8)


def test_refit_shuffle_is_one_fit_at_a_time(spark):
    x, y = table(300)
    df = frame(spark, x, y)
    labels = {r["order_idx"]: r["labels"] for r in T.shuffled_labels(df, "y", "order_idx", 6).collect()}
    every = np.array([labels[i] for i in range(len(y))])
    assert (every[:, 0] == y).all() and (every.sum(axis=0) == y.sum()).all()
    assert len({tuple(c) for c in every.T}) == 7
    trials = T.refit_shuffle(df, FEATURES, 3, 10, 6)
    got = {r["trial"]: (r["auc"], r["brier"]) for r in trials.collect()}
    want = {}
    for t in range(7):
        p = brute(x, every[:, t], [0, 1, 2], 3, 10)
        want[t] = (auc(every[:, t], p), ((p - every[:, t]) ** 2).mean())
        assert got[t] == pytest.approx(want[t], abs=1e-8)
    one = T.refit_p_value(trials).first()
    assert one["shuffles"] == 6 and one["p_value"] == np.mean([want[t][0] >= want[0][0] for t in range(1, 7)])


def test_one_class_constant_and_unknown_features(spark):
    """A training part of one class scores its share; a feature that is constant or without values counts for nothing; separable labels still end."""
    x, y = table(120)
    x[:, 1], x[:, 2] = 7.0, np.nan
    y[:60], y[60:] = 0, 1
    got = {r["order_idx"]: r["p"] for r in M.out_of_fold(frame(spark, x, y), FEATURES, 2, 0, ["order_idx"]).collect()}
    assert [got[i] for i in range(120)] == [1.0] * 60 + [0.0] * 60
    x, y = table(120)
    x[:, 1], x[:, 2] = 7.0, np.nan
    y = (np.nan_to_num(x[:, 0]) > 0).astype(int)
    got = {r["order_idx"]: r["p"] for r in M.out_of_fold(frame(spark, x, y), FEATURES, 3, 2, ["order_idx"]).collect()}
    assert np.allclose([got[i] for i in range(120)], brute(x, y, [0], 3, 2), atol=1e-8)


def test_rounds_do_not_grow_with_models(spark):
    """Many models take the passes of the slowest one, not one after another."""
    x, y = table(300)
    rows = T.packed_rows(frame(spark, x, y), FEATURES, F.array("y"))
    m = T.fit_all(rows, FEATURES, [T.Variant(str(g), tuple(FEATURES[: 1 + g % 3])) for g in range(30)], 5, 10)
    assert m.rounds <= 10


def test_groups_of_scores_are_groups_of_their_own(spark):
    rng = np.random.default_rng(5)
    rows = [(f"g{i % 3}", float(rng.integers(0, 20)) / 20, int(rng.random() < 0.4)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, p double, y int")
    got = {r["g"]: r["auc"] for r in auc_brier(df, "p", "y", ["g"]).collect()}
    for g in got:
        at = [(p, y) for h, p, y in rows if h == g]
        assert got[g] == pytest.approx(auc(np.array([y for _, y in at]), np.array([p for p, _ in at])), abs=1e-12)


def staged_names(monkeypatch, spark):
    """Names and rows of the tables that fits and its steps stage from now on."""
    from tradeloom.operators import shuffles, windows
    from tradeloom.sources import staging

    found = []

    def seen(df, name):
        out = staging.staged(df, name)
        found.append((name, out.count()))
        return out

    for module in (T, windows, shuffles):
        monkeypatch.setattr(module, "staged", seen)
    return found


def test_scales_are_exact_and_write_no_rows(spark, monkeypatch):
    """medians, means and deviations of each fold's training part without a row for each fold and feature."""
    rng = np.random.default_rng(9)
    x = np.column_stack([rng.normal(size=500) * 1e-8 + 1e3, rng.integers(-2, 3, 500) * 0.5, -np.exp(rng.normal(size=500) * 40)])
    x[rng.random((500, 3)) < 0.2] = np.nan
    x[:7, 1] = -0.0
    rows = T.packed_rows(frame(spark, x, np.zeros(500, int)), FEATURES, F.array("y"))
    found = staged_names(monkeypatch, spark)
    bounds = T.fold_bounds(500, 4)
    center, mean, scale, n = T._scales(rows, FEATURES, bounds, 15)[:4]
    assert found == []
    index = np.arange(500)
    for k, (lo, hi) in enumerate(bounds):
        t = x[(index < lo - 15) | (index > hi + 15)]
        want = np.nanmedian(t, axis=0)
        full = np.where(np.isnan(t), want, t)
        assert n[k] == len(t) and center[k] == pytest.approx(want, rel=1e-15)
        assert mean[k] == pytest.approx(full.mean(axis=0), rel=1e-12)
        assert scale[k] == pytest.approx(full.std(axis=0, ddof=1), rel=1e-5)


def test_figures_over_cells_are_those_of_pairs(spark, monkeypatch):
    """F4, F8: scores with ties, cut into many cells, no row for a score."""
    x, y = table(700, 11)
    x[:, 0] = np.round(x[:, 0])
    x[:, 1:] = 1.0
    monkeypatch.setattr(T, "_CELL", 60)
    monkeypatch.setattr(T, "_CUT_ROWS", 150)
    rows = T.packed_rows(frame(spark, x, y), FEATURES, F.array("y", F.expr("1 - y")))
    used = [T.Variant("a", ("a",)), T.Variant("turned", ("a",), 1), T.Variant("none", ())]
    got = {r["variant"]: (r["auc"], r["brier"]) for r in T.figures(rows, T.fit_all(rows, FEATURES, used, 4, 5)).collect()}
    for name, labels, at in (("a", y, [0]), ("turned", 1 - y, [0]), ("none", y, [])):
        p = brute(x, labels, at, 4, 5)
        assert got[name] == pytest.approx((auc(labels, np.round(p, 12)), ((p - labels) ** 2).mean()), abs=1e-9)


def test_shuffles_are_those_of_the_hashes_and_copy_no_row(spark, monkeypatch):
    """F8: labels by MD5 places, as bits of one row each; what is staged grows with rows, not with rows times shuffles."""
    import hashlib

    x, y = table(4_000, 4)
    df = frame(spark, x, y)
    place = lambda i, rep: (int(hashlib.md5(f"{i}:{rep}".encode()).hexdigest()[:15], 16), i)
    labels = {r["order_idx"]: r["labels"] for r in T.shuffled_labels(df, "y", "order_idx", 3).collect()}
    for rep in (1, 2, 3):
        first = set(sorted(range(len(y)), key=lambda i: place(i, rep))[: y.sum()])
        assert {i for i in labels if labels[i][rep]} == first
    found = staged_names(monkeypatch, spark)
    assert T.refit_shuffle(df, FEATURES, 3, 10, 3).count() == 4
    assert max(n for name, n in found if name != "shuffle-places") == len(y) and ("fit-shuffles", len(y)) in found


def test_scores_leave_the_disk_turn_by_turn(spark, monkeypatch):
    """figures of models taken two at a time are those of all at once, and a staged table leaves no shuffle file behind."""
    import time

    x, y = table(400, 6)
    x[:, 0] = np.round(x[:, 0])
    df = frame(spark, x, y)
    want = {r["trial"]: (r["auc"], r["brier"]) for r in T.refit_shuffle(df, FEATURES, 3, 10, 4).collect()}
    monkeypatch.setattr(T, "_TURN_SCORES", 0)
    monkeypatch.setattr(T, "_TURN_VARIANTS", 2)
    found = staged_names(monkeypatch, spark)
    got = {r["trial"]: (r["auc"], r["brier"]) for r in T.refit_shuffle(df, FEATURES, 3, 10, 4).collect()}
    assert got == {t: pytest.approx(v, abs=1e-12) for t, v in want.items()} and len(got) == 5
    assert [n for name, n in found if name == "fit-figures"] == [2, 2, 1]

    def shuffle_files():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}

    from tradeloom.sources.staging import staged

    before = shuffle_files()
    staged(df.repartition(7), "rows")
    end = time.time() + 20
    while shuffle_files() - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files() - before


def test_the_last_place_where_none_lies_near(spark, monkeypatch):
    """where a k-th place lies outside of the bounds, all places are kept, and labels are those of the hashes; labels of one kind stay so."""
    import hashlib

    from tradeloom.operators import shuffles

    near = shuffles._near
    monkeypatch.setattr(shuffles, "_near", lambda share, n: ((0, 1), near(share, n)[1]))
    df = frame(spark, *table(200, 8))
    for ones in (0, 60, 200):
        some = df.withColumn("y", (df["order_idx"] < ones).cast("int"))
        labels = {r["order_idx"]: r["labels"] for r in T.shuffled_labels(some, "y", "order_idx", 2).collect()}
        for rep in (1, 2):
            order = sorted(range(200), key=lambda i: (int(hashlib.md5(f"{i}:{rep}".encode()).hexdigest()[:15], 16), i))  # noqa: B023
            assert {i for i in labels if labels[i][rep]} == set(order[:ones])
