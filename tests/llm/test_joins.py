"""Shingle joins and repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import common, jaccard, suffix
from tessera.session import cut_lineage
from tests.llm.conftest import rows, text_of


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(table):
    sets = [(d, shingles(t)) for d, t, *_ in table]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return [(d, len(s), None if d is None else find(d)) for d, s in sets]


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def test_components_on_awkward_rows(docs):
    assert got(jaccard.join_components(docs)) == sorted(brute_components(rows()), key=str)


def test_components_of_many_near_copies(spark):
    rng = random.Random(9)
    base, table = text_of(rng, 150).split(), []
    for k in range(160):
        w = list(base)
        for _ in range(rng.randrange(14)):
            w[rng.randrange(len(w))] = f"n{k}"
        table.append((k, " ".join(w)))
    table += [(1000 + k, text_of(rng, rng.randrange(1, 60))) for k in range(60)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    assert got(jaccard.join_components(df)) == sorted(brute_components(table), key=str)


def test_an_id_with_two_texts_unites_them(spark):
    rng = random.Random(3)
    a, b = text_of(rng, 50), text_of(rng, 50)
    df = spark.createDataFrame([(1, a), (5, a), (5, b), (9, b), (12, "z")], "doc_id long, text string")
    out = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(df).collect()}
    assert out == {1: 1, 5: 1, 9: 1, 12: 12}


def test_components_of_nothing(no_docs):
    assert jaccard.join_components(no_docs).count() == 0


@pytest.mark.parametrize("n", [5, 20, 111, 300])
def test_linked_sets_always_share_a_probed_entry(n):
    """The filter is exact: any pair at the threshold meets, whatever is frequent."""
    rng = np.random.default_rng(n)
    low = jaccard.bands(10_000)
    for trial in range(60):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        drop, add = rng.integers(0, n // 4 + 1, 2)
        y = np.unique(np.r_[x[int(drop):], rng.integers(0, 2**63, int(add)).astype(np.uint64)])
        frequent = np.sort(rng.choice(x, len(x) // 2, replace=False)) if trial % 2 else x[:0]
        weight = rng.integers(12, 500, len(frequent))
        a, pa = jaccard.entries(x, low, frequent, weight)
        b, pb = jaccard.entries(y, low, frequent, weight)
        meets = bool(np.intersect1d(a[pa], b).size or np.intersect1d(a, b[pb]).size)
        assert meets or not jaccard.linked(x, y)


def brute_removed(table):
    bodies = [(t or "").encode() for _, t, *_ in table]
    seen = Counter(b[i:i + 200] for b in bodies for i in range(len(b) - 199))
    out = []
    for (d, *_), b in zip(table, bodies):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\x01" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_shard", [2048, 2])
def test_removed_strings_on_awkward_rows(docs, per_shard, monkeypatch):
    """With two contexts a shard, the merge across shards decides."""
    monkeypatch.setattr(suffix, "SHARD_CONTEXTS", per_shard)
    out = sorted((tuple(r) for r in suffix.suffix_dedup(docs).collect()), key=str)
    assert out == brute_removed(rows())


def test_removed_strings_of_nothing(no_docs):
    assert suffix.suffix_dedup(no_docs).count() == 0


def test_removed_strings_across_documents(spark):
    rng = random.Random(2)
    parts = [text_of(rng, n) for n in (60, 80, 45, 200)]
    table = [(k, " ".join(rng.choice(parts)[rng.randrange(40):] for _ in range(4))) for k in range(40)] + [(99, "q" * 199), (100, "q" * 200), (101, "\x00" * 450)]
    out = sorted((tuple(r) for r in suffix.suffix_dedup(spark.createDataFrame(table, "doc_id long, text string")).collect()), key=str)
    assert out == brute_removed(table)


def test_rewritten_text_keeps_other_columns(docs):
    out = suffix.without_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("doc_id = 0").first()["text"] is None


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    for size in (1, 7, 300):
        bodies = [bytes(rng.integers(0, 3, rng.integers(1, size + 1)).astype(np.uint8)) for _ in range(4)]
        text = np.frombuffer(b"".join(bodies), np.uint8)
        end = np.cumsum([len(b) for b in bodies])
        left = np.repeat(end, [len(b) for b in bodies]) - np.arange(len(text))
        sa = suffix.suffix_array(text, left)
        own = [bytes(text[i:i + left[i]]) for i in sa]
        assert own == sorted(own)
        before = np.full(len(sa), -1)
        before[sa[1:]] = sa[:-1]
        size = np.array([len(b) for b in bodies])
        lcp = suffix.common_prefixes(end - size, size, before, text, left, limit=10**6)
        for k in range(1, len(sa)):
            a, b = own[k - 1], own[k]
            assert lcp[sa[k]] == next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))




def test_components_of_few_edges_need_no_shuffle(spark, monkeypatch):
    pairs = [(k, k + 1) for k in range(0, 40) if k % 7] + [(100 - k, 100) for k in range(1, 20)] + [(5, 5), (3, 4), (4, 3)]
    want: dict[int, int] = {}
    for a, b in pairs:
        if a != b:
            x, y = want.setdefault(a, a), want.setdefault(b, b)
            want = {n: min(x, y) if c in (x, y) else c for n, c in want.items()}
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    plans = []

    def cut(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(df)

    found = {r["node"]: r["component"] for r in common.components(edges, cut).collect()}
    assert found == {n: c for n, c in want.items() if n != c}
    assert len(plans) > 2 and not any("hashpartitioning" in p for p in plans)
    monkeypatch.setattr(common, "COMPONENT_EDGES", 10)
    assert {r["node"]: r["component"] for r in common.components(edges, cut_lineage).collect()} == found
