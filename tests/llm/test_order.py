"""Mixing and neighbour search against brute force; the pipeline as a whole."""

import hashlib

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import ann, mixing, pieces
from tests.llm.test_joins import brute_components


def edf(shares):
    """Slots of one period, earliest deadline first over released blocks."""
    d, done, out = sum(shares), [0] * len(shares), []
    for t in range(d):
        ready = [(-(-(done[i] + 1) * d // a), i) for i, a in enumerate(shares) if done[i] < a and done[i] * d // a <= t]
        out.append(min(ready)[1])
        done[out[-1]] += 1
    return out


@pytest.mark.parametrize("weights", [[1], [1, 1, 1], [50, 30, 15, 5], [97, 1, 1, 1], [7, 11, 13, 17, 19]])
def test_schedule_is_earliest_deadline_first(spark, weights):
    share = spark.createDataFrame([(f"s{k:02}", w) for k, w in enumerate(weights)], "src string, a long")
    rows = sorted(mixing.schedule(share).collect(), key=lambda r: r["slot"])
    assert [int(r["src"][1:]) for r in rows] == edf(weights)
    d = sum(weights)
    for k, w in enumerate(weights):
        taken = 0
        for t, r in enumerate(rows):
            taken += r["src"] == f"s{k:02}"
            assert abs(taken - w * (t + 1) / d) < 1


def test_mix_places_every_row_once(docs, no_docs):
    out = mixing.mix_sources(docs, block_rows=2)
    assert out.count() == docs.count() and out.select("_m_position").distinct().count() == docs.count()
    assert out.where("_m_slot < _m_release or _m_slot >= _m_deadline").isEmpty()
    assert mixing.interleaved(docs).columns == docs.columns and mixing.interleaved(docs).count() == docs.count()
    assert mixing.mix_sources(no_docs).count() == 0


def test_mix_follows_target_weights(spark):
    rows = [(k, "abc"[k % 3]) for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    out = mixing.mix_sources(df, {"a": 0.7, "b": 0.2, "c": 0.1}, block_rows=4).orderBy("_m_position").limit(1000).groupBy("source").count().collect()
    got = {r["source"]: r["count"] for r in out}
    assert abs(got["a"] - 700) <= 4 and abs(got["b"] - 200) <= 4 and abs(got["c"] - 100) <= 4
    with pytest.raises(ValueError):
        mixing.mix_sources(df, slots=2)


def brute_nearest(ids, x, k, every):
    hit = {}
    for i, q in zip(ids, x):
        if i % every == 0:
            d = np.sqrt(((x - q) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
            hit[i] = [(int(ids[j]), float(d[j])) for j in order]
    return hit


def test_recall_of_nearest_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    t = df.select("vec_id", "embedding").toArrow()
    ids, x = t.column(0).to_numpy(), np.array(t.column(1).to_pylist(), np.float64)
    want = brute_nearest(ids, x, 10, 100)
    found = {}
    for r in sorted(ann.nearest(df).collect(), key=lambda r: r["rank"]):
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    hits = sum(len(set(found[q]) & {i for i, _ in w}) for q, w in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_nearest_on_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    rows = [(int(k), [float(v) for v in rng.normal(size=3)]) for k in range(1, 60)]
    rows += [(0, [1.0, 2.0, 3.0]), (100, [1.0, 2.0, 3.0]), (200, [1.0, 2.0, 3.0]), (300, None), (400, [0.0, 0.0, 0.0]), (500, [nan, 1.0, 1.0]),
             (600, [inf, 1.0, 1.0]), (700, [None, 1.0, 1.0]), (800, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (900, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as rank", "2 as score")
    good = [(i, v) for i, v in rows if i is not None and v and len(v) == 3 and all(e is not None and np.isfinite(e) for e in v) and any(v)]
    want = brute_nearest(np.array([i for i, _ in good]), np.array([v for _, v in good], np.float32).astype(np.float64), 10, 100)
    out = {}
    for r in sorted(ann.nearest(df).collect(), key=lambda r: r["rank"]):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert {q: [i for i, _ in v] for q, v in out.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(np.allclose([s for _, s in out[q]], [s for _, s in want[q]], rtol=1e-15) for q in want)
    assert ann.nearest(df.limit(0)).count() == 0


def brute_pipeline(rows):
    """The pipeline's last stage by document, in plain Python."""
    def bad(text):
        w = (text or "").encode().split()
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        seen = {}
        for g in grams:
            seen[g] = seen.get(g, 0) + 1
        hit = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
        return len(w) < 10 or 100 * len(hit) > 20 * len(w)

    kept = [(d, t) for d, t in rows if not bad(t)]
    root = {d: c for d, _, c in brute_components(kept)}
    kept = [(d, t) for d, t in kept if root[d] == d]
    seen = {}
    bodies = {d: t.encode() for d, t in kept}
    for b in bodies.values():
        for i in range(len(b) - 199):
            seen[b[i:i + 200]] = seen.get(b[i:i + 200], 0) + 1
    out = {}
    with open(pieces.MODEL, "rb") as f:
        enc = pieces.Encoder(pieces.Pieces(f.read()))
    for d, b in bodies.items():
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = True
        text = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore")
        if text:
            found = enc.encode(text, pieces.NBEST)
            ids, scores = found[0][0], [x for _, x in found]
            out[d] = (hashlib.sha256(ids).hexdigest(), scores)
    return out


def test_pipeline_against_brute_force(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert {r["doc_id"]: (r["ids_sha256"], r["nbest_scores"]) for r in out} == brute_pipeline(rows)
    assert len(out) == len({r["doc_id"] for r in out}) and all(r["round_trip"] for r in out)


def test_stages_take_awkward_rows(spark, docs, no_docs):
    for table in (docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, "")
            assert out.columns == table.columns, name
            assert out.count() <= table.count()
    gone = corpus_pipeline.near_duplicates(spark, docs, "")
    ids = [r["doc_id"] for r in gone.select("doc_id").collect()]
    assert 9 in ids and 10 not in ids and ids.count(None) == 2
