"""Repeated passages against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import passages
from tessera.llm.queries import op13_passage_dedup
from tests.llm.conftest import rows, text_of


def brute(table, window=50):
    least = {}
    split = [(d, (t or "").encode().split()) for d, t in table]
    for d, w in split:
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            least[x] = min(least.get(x, 1 << 63), 1 << 63 if d is None else d)
    out = []
    for d, w in split:
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k:k + window])] < (1 << 63 if d is None else d):
                gone.update(range(k, k + window))
        out.append((d, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect()), key=str)


def shared(rng, n, words=12):
    """Texts of few words that share pieces of each other."""
    pool = [" ".join(rng.choice("abcdefghijkl"[:words]) for _ in range(rng.randrange(4, 40))) for _ in range(12)]
    return [(rng.choice([k, k, k // 2, None]), " ".join(rng.choice(pool) for _ in range(rng.randrange(5)))) for k in range(n)]


@pytest.mark.parametrize("window,anchor,hot,cell_bytes", [(10, 3, 4096, 16), (10, 10, 4096, 1 << 30), (7, 1, 0, 16), (12, 5, 3, 1 << 30)])
def test_pieces_of_each_other(spark, window, anchor, hot, cell_bytes):
    table = shared(random.Random(window + hot), 90)
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    assert got(passages.without_passages(df, window, anchor, hot, cell_bytes)) == brute(table, window)


@pytest.mark.parametrize("hot", [2, 4096])
def test_awkward_rows(docs, no_docs, hot):
    table = [(d, t) for d, t, *_ in rows()]
    assert got(passages.without_passages(docs, hot=hot)) == brute(table)
    assert passages.without_passages(no_docs).count() == 0


def test_long_periodic_copied_and_repeated_texts(spark):
    rng = random.Random(8)
    base, other = text_of(rng, 5000), text_of(rng, 70)
    table = [(k, base) for k in range(3, 40)] + [(2, base[3000:20000]), (1, "same " * 9000), (7, "same " * 200), (0, "same " * 49), (5, "same\t" * 50)]
    table += [(100 + k, f"{text_of(rng, 30)} {other} {text_of(rng, 30)}") for k in range(300)] + [(50, other)] * 5 + [(None, other), (None, base)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(6)
    want = brute(table)
    for hot in (20, 4096):
        assert got(passages.without_passages(df, hot=hot)) == want


def test_sketch_never_falls_short():
    rng = np.random.default_rng(1)
    low = rng.integers(0, 400, 3000).astype(np.uint64)
    whole = {}
    for part in np.array_split(low, 7):
        sketch = passages.CountMin(256)
        sketch.add(part)
        out = sketch.take()
        for cell, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist()):
            whole[cell] = whole.get(cell, 0) + n
    for x, n in zip(*np.unique(low, return_counts=True)):
        estimate = min(whole[int(passages.cells(np.array([x]), r, 256)[0]) * passages.DEPTH + r] for r in range(passages.DEPTH))
        assert estimate >= n


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 50])
def test_sequence_hashes_follow_the_words(n):
    rng = np.random.default_rng(n)
    h = rng.integers(0, 3, 400).astype(np.uint64)
    out = passages.sequences(h, n)
    assert len(out) == len(h) - n + 1
    seen = {}
    for k, x in enumerate(out.tolist()):
        assert seen.setdefault(x, h[k:k + n].tolist()) == h[k:k + n].tolist()
    assert len(seen) == len({tuple(h[k:k + n].tolist()) for k in range(len(out))})
    assert len(passages.sequences(h[: n - 1], n)) == 0 or n == 1


def test_query_returns_digests(spark, docs, scratch):
    docs.write.parquet(f"{scratch}/documents.parquet")
    out = sorted((tuple(r) for r in op13_passage_dedup(spark, scratch).collect()), key=str)
    want = [(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute([(d, t) for d, t, *_ in rows()])]
    assert out == sorted(want, key=str)
