"""Forests whose trees stay on the cluster."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import forest


def table(spark, n=600):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((n, 3))
    y = (x[:, 0] > 0).astype(int) + (x[:, 1] + 0.5 * rng.standard_normal(n) > 0.5)
    return spark.createDataFrame([(k, int(b), *map(float, a)) for k, (a, b) in enumerate(zip(x, y))], "id long, y int, a double, b double, c double")


def judged(df, **other):
    model = forest.fit(df.where("id % 3 > 0"), "y", ["a", "b", "c"], 12, 1, 30, "id", **other)
    return model, {r["id"]: (r["y_hat"], r["probability"]) for r in model.predict(df.where("id % 3 = 0"), ["id", "y"]).collect()}


def test_trees_grow_the_same_in_one_task_and_in_many(spark, monkeypatch):
    df = table(spark)
    model, want = judged(df.coalesce(1))
    assert model.tops == {} and len(want) == 200 and all(math.isclose(sum(p), 1) for _, p in want.values())
    # large nodes are split by summed histograms, over other partitions and blocks
    monkeypatch.setattr(forest, "LOCAL_ROWS", 40)
    monkeypatch.setattr(forest, "TEST_ROWS", 7)
    spread, got = judged(df.repartition(5))
    assert len(spread.tops) == 12 and max(len(t.feature) for t in spread.tops.values()) > 10
    assert got == want and np.allclose(spread.importances, model.importances)
    assert model.importances[2] < model.importances[0] and abs(model.importances.sum() - 1) < 1e-9


def test_best_split_is_the_best(spark):
    rng = np.random.default_rng(5)
    for _ in range(30):
        x, y = rng.integers(0, 6, (40, 2)).astype(np.uint8), rng.integers(0, 3, 40)
        (feature, at, left, counts), _ = forest.grown(x, y, np.ones(40), 3, forest.tree_hash(0, 0), 0, 1)
        allowed = forest.drawn(forest.tree_hash(0, 0), 2)[0]

        def cost(f, b):
            parts = [y[x[:, f] <= b], y[x[:, f] > b]]
            return sum(len(p) - (np.bincount(p) ** 2).sum() / len(p) for p in parts) if all(map(len, parts)) else np.inf

        want = min(cost(f, b) for f in range(2) if allowed[f] for b in range(6))
        assert math.isclose(cost(feature[0], at[0]), want) and counts.sum() == 40 and len(feature) == 3


def test_trees_fit_their_bag_and_stop_at_the_depth(spark):
    rng = np.random.default_rng(7)
    x, y = rng.permutation(32).astype(np.uint8)[:, None], rng.integers(0, 2, 32)
    feature, at, left, counts = forest.grown(x, y, np.ones(32), 2, forest.tree_hash(0, 0), 0, 30)[0]
    last = forest.walk(feature, at, left, x)
    assert (counts[last].argmax(axis=1) == y).all() and (counts[feature < 0].min(axis=1) == 0).all()
    shallow = forest.grown(x, y, np.ones(32), 2, forest.tree_hash(0, 0), 0, 2)[0]
    assert len(shallow[0]) <= 7


def test_missing_values_and_empty_tables(spark):
    df = table(spark, 60)
    for bad in (df.withColumn("a", F.when(F.col("id") != 4, F.col("a"))), df.withColumn("y", F.when(F.col("id") != 4, F.col("y")))):
        with pytest.raises(Exception, match="no value of a|not a class number"):
            judged(bad)
    model, _ = judged(df)
    assert model.predict(df.limit(0), ["id"]).count() == 0


def test_cells_are_counted_of_the_drawn_features_only(spark):
    rng = np.random.default_rng(11)
    x, y, w, of = rng.integers(0, 32, (300, 9)).astype(np.uint8), rng.integers(0, 5, 300), rng.integers(1, 13, 300), rng.integers(0, 4, 300)
    names = forest.children(np.array([7, 9], np.uint64))
    features = forest.taken(names, 9)
    assert features.shape == (4, 3) and (np.diff(features, axis=1) > 0).all()
    total = np.stack([np.bincount(y[of == k], w[of == k], 5) for k in range(4)]).astype(np.int64)
    got = forest.counted(forest.packed(x, y, w), np.arange(300), of, features, total)
    want = []
    for k in range(4):
        for f in features[k]:
            for b in np.unique(x[of == k, f]):
                low = (of == k) & (x[:, f] <= b)
                below = np.bincount(y[low], w[low], 5)
                want.append((k, f, b, below.sum(), (below**2).sum(), ((total[k] - below) ** 2).sum()))
    assert list(zip(*(c.tolist() for c in got))) == want


def test_rows_judged_where_the_trees_grow_are_judged_the_same(spark, monkeypatch):
    df = table(spark)
    train, test = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    want = judged(df)[1]
    args = ("y", ["a", "b", "c"], 12, 1, 30, ["id", "y"], "id")
    at_once = lambda rows: {r["id"]: (r["y_hat"], r["probability"]) for r in forest.fit_and_predict(rows, test, *args).collect()}
    monkeypatch.setattr(forest, "_fitted", None)  # no tree is written
    assert at_once(train.repartition(3)) == want
    # blocks, packs of several trees and slices of few rows change nothing
    for name, value in (("TEST_ROWS", 7), ("TASKS", 5), ("WALKED_ROWS", 10)):
        monkeypatch.setattr(forest, name, value)
    assert at_once(train.repartition(3)) == want
    assert forest.fit_and_predict(train, test.limit(0), *args).count() == 0
    monkeypatch.undo()
    # more rows than a task takes: in two steps
    monkeypatch.setattr(forest, "LOCAL_ROWS", 40)
    assert at_once(train.repartition(3)) == want


def test_both_ways_to_count_find_the_same_splits(monkeypatch):
    rng = np.random.default_rng(13)
    for d, classes, n in ((1, 2, 50), (5, 3, 400), (9, 40, 700)):
        x, y, w = rng.integers(0, 32, (n, d)).astype(np.uint8), rng.integers(0, classes, n), rng.integers(1, 13, n)
        found = []
        for dense, block in ((4, 1 << 14), (0, 1 << 14), (0, 9), (1 << 20, 100)):
            monkeypatch.setattr(forest, "DENSE", dense)
            monkeypatch.setattr(forest, "BLOCK", block)
            monkeypatch.setattr(forest, "COUNTED_ROWS", block)
            nodes, gains = forest.grown(x, y, w, classes, forest.tree_hash(2, 3), 0, 30)
            found.append([a.tolist() for a in (*nodes, gains)])
        assert all(f == found[0] for f in found)
        feature, at, left, counts = nodes
        last = forest.walk(feature, at, left, x)
        assert (np.stack([np.bincount(y[last == k], w[last == k], classes) for k in range(len(feature))]) == counts).all()


def test_cells_of_large_counts(spark):
    # sums that do not fit side by side in 64 bits
    n = 30_000
    rng = np.random.default_rng(17)
    x, y, w = rng.integers(0, 4, (n, 1)).astype(np.uint8), rng.integers(0, 2, n), rng.integers(1, 13, n)
    total = np.bincount(y, w, 2)[None].astype(np.int64)
    got = forest.counted(forest.packed(x, y, w), np.arange(n), np.zeros(n, np.int64), np.zeros((1, 1), np.int64), total)
    below = np.stack([np.bincount(y[x[:, 0] <= b], w[x[:, 0] <= b], 2) for b in range(4)]).astype(np.int64)
    assert got.rows.tolist() == below.sum(axis=1).tolist() and got.below.tolist() == (below**2).sum(axis=1).tolist()
    assert got.above.tolist() == ((total - below) ** 2).sum(axis=1).tolist()
