"""The index of the nearest vectors: tables of more rows than its sample and its blocks."""

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import ann
from tests.llm.test_order import brute_nearest


def table(spark, ids, x):
    rows = pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array([list(map(float, v)) for v in x], pa.list_(pa.float64()))})
    return spark.createDataFrame(rows).repartition(4)


def answers(df, **how):
    got = {}
    for r in sorted(ann.nearest(df, **how).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return got


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_recall_on_random_directions(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((9000, 24))
    ids = np.arange(9000)
    got, want = answers(table(spark, ids, x)), brute_nearest(ids, x, 10, 100)
    assert {q: len(v) for q, v in got.items()} == {q: 10 for q in want} and recall(got, want) >= 0.9


def test_clusters_are_searched_alone(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 512)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((60, 32))
    x = centres[rng.integers(0, 60, 9000)] + 0.05 * rng.standard_normal((9000, 32))
    ids = np.arange(9000)
    df = table(spark, ids, x)
    got, want = answers(df), brute_nearest(ids, x, 10, 100)
    assert recall(got, want) >= 0.9
    _, routes, bins = ann.candidates(df)
    searched = routes.join(bins.select("bin", "n").distinct(), "bin").selectExpr("sum(n)").first()[0]
    assert searched < 0.2 * 90 * 9000


def test_hot_copies_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 256)
    monkeypatch.setattr(ann, "QUERY_ROWS", 16)
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 100)
    rng = np.random.default_rng(7)
    x = np.concatenate([np.tile(rng.standard_normal(8), (1500, 1)), rng.standard_normal((1500, 8)), np.tile(rng.standard_normal(8), (900, 1))])
    ids = np.r_[np.arange(3000), np.full(900, 7777)]
    got = answers(table(spark, ids, x))
    for q in range(0, 1500, 100):
        assert got[q] == [(i, 0.0) for i in range(11) if i != q][:10]
    # a row that occurs 900 times is a neighbour as often as there is room
    near = answers(table(spark, np.r_[ids, 8000], np.concatenate([x, x[-1:] + 1e-3])))[8000]
    assert [i for i, _ in near] == [7777] * 10


def test_dimensions_without_a_pivot_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 8)
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(8)
    x = [rng.standard_normal(3 + k % 40) for k in range(1600)]
    got = answers(table(spark, range(1600), x), every=50)
    hits = total = 0
    for q in range(0, 1600, 50):
        same = [k for k in range(1600) if len(x[k]) == len(x[q]) and k != q]
        d = {k: float(np.sqrt(((x[k] - x[q]) ** 2).sum())) for k in same}
        want = sorted(same, key=lambda k: (d[k], k))[:10]
        assert len(got[q]) == 10 and all(s == pytest.approx(d[k], rel=1e-12) for k, s in got[q])
        hits, total = hits + len({k for k, _ in got[q]} & set(want)), total + 10
    assert hits >= 0.9 * total


def test_windows_of_growing_radius_count_as_one_window():
    rng = np.random.default_rng(9)
    x, q = rng.standard_normal((700, 16)), rng.standard_normal((5, 16))
    block = ann.Block(np.arange(700), x)
    bounds = np.array([np.sort(ann.distances(x, v))[9] for v in q])
    p, c = x @ block.axes, q @ block.axes
    for t, (d, rows) in enumerate(block.search_all(np.full(5, -1), q, bounds, 700)):
        near = (np.abs(p - c[t]) <= bounds[t] * (1 + 1e-9)).sum(axis=1) >= ann.THRESHOLD
        want = np.flatnonzero(near & (ann.distances(x, q[t]) <= bounds[t]))
        assert sorted(rows.tolist()) == want.tolist() and (np.diff(d) >= 0).all()
    assert 0 < block.verified < 5 * 700
