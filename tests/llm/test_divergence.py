"""Source divergence against a plain version, and the transducer against a dictionary."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import divergence
from tests.llm.conftest import rows


def terms_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plainly(table, min_docs, top=50):
    """``table``: (lang, source, text)."""
    table = [(a or "", b or "", terms_of(t)) for a, b, t in table]
    out = []
    for lang in {a for a, _, _ in table}:
        own = [(b, t) for a, b, t in table if a == lang]
        docs = Counter(t for _, ts in own for t in set(ts))
        kept = sorted((t for t in docs if docs[t] >= min_docs), key=lambda t: t.encode())
        sources = sorted({b for b, _ in own})
        n = {s: Counter(t for b, ts in own if b == s for t in ts if t in set(kept)) for s in sources}

        def shares(c):
            total = sum(c.values()) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}

        p = {s: shares(n[s]) for s in sources}
        q = shares(sum(n.values(), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            above = [(p[s][t] - q[t], t) for t in kept if n[s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", above)):
                found = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def test_transducer_numbers_terms_in_order():
    rng = random.Random(2)
    for size in (1, 2, 40, 3000):
        terms = sorted({"".join(rng.choice("abcdé漢") for _ in range(rng.randrange(1, 9))).encode() for _ in range(size)})
        t = divergence.Transducer(terms).ready()
        assert t.n_terms == len(terms) and t.table_bytes() > 0
        other = ["".join(rng.choice("abcdé漢x") for _ in range(rng.randrange(1, 12))).encode() for _ in range(2000)]
        place = {x: k for k, x in enumerate(terms)}
        for x in (terms, other):
            ends = np.cumsum([len(y) for y in x])
            starts = ends - [len(y) for y in x]
            data = np.frombuffer(b"".join(x), np.uint8)
            zero = np.zeros(len(x), np.int64)
            assert t.ordinals(data, starts, ends, zero, zero).tolist() == [place.get(y, -1) for y in x]


def test_transducer_is_minimal():
    # words of one length over two letters: every state but the last is shared by level
    terms = sorted("".join(x).encode() for x in __import__("itertools").product("ab", repeat=10))
    t = divergence.Transducer(terms)
    assert len(t.final) == 11 and len(t.add) == 20
    assert len(divergence.Transducer([b"tap", b"taps", b"top", b"tops"]).final) == 5
    assert divergence.Transducer([]).n_terms == 0


def many(rng):
    words = [f"{a}{b}" for a in "bcdfgé漢" for b in ("a", "E", "io", "ü", "aa", "aaa")]
    table = []
    for k in range(400):
        skew = words[: 10 + 8 * (k % 4)]
        table.append((["en", "fr", None, "de", ""][k % 5], ["s0", "s1", "s2", None, "hot", "hot", "hot"][k % 7], " ".join(rng.choice(skew) + rng.choice(["", "-", " 7", "\n"]) for _ in range(rng.randrange(40)))))
    table += [("xx", "alone", "word"), ("yy", "a", None), ("yy", "b", ""), ("yy", "c", "1 2 3"), ("en", "long", "Word" * 40_000), ("en", "s0", "a" * 9)]
    return table


@pytest.mark.parametrize("shard,pack,cells,chunk", [(1 << 18, 96 << 20, 1 << 20, 2 << 20), (30, 3000, 40, 500), (1, 1, 1, 50)])
def test_audit_equals_the_plain_version(spark, monkeypatch, shard, pack, cells, chunk):
    for name, value in (("PACK_BYTES", pack), ("BLOCK_CELLS", cells)):
        monkeypatch.setattr(divergence, name, value)
    monkeypatch.setattr(divergence, "_shards", limited(divergence._shards, "SHARD_BYTES", shard))
    monkeypatch.setattr(divergence, "_document_terms", limited(divergence._document_terms, "_CHUNK", chunk))
    table = many(random.Random(3))
    df = spark.createDataFrame(table, "lang string, source string, text string").repartition(3)
    got = sorted(tuple(r) for r in divergence.divergence(df, min_docs=12 if shard > 1 else 25, top=7).collect())
    want = plainly(table, 12 if shard > 1 else 25, 7)
    assert got == want and {r[2] for r in want} == {"pair", "term"}


def limited(fn, name, value):
    """``fn`` with a constant of its module set in the task."""

    def run(batches):
        old = getattr(divergence, name)
        setattr(divergence, name, value)
        try:
            yield from fn(batches)
        finally:
            setattr(divergence, name, old)

    return run


def test_awkward_rows(spark, docs, no_docs):
    got = sorted(tuple(r) for r in divergence.divergence(docs, min_docs=3).collect())
    assert got == plainly([(a, s, t) for _, t, a, s, *_ in rows()], 3)
    assert divergence.divergence(no_docs).count() == 0


def test_large_counts_are_exact(spark):
    n = 8_900_000_000_000_000
    df = spark.createDataFrame([(n, n + 77)], "n long, total long").select(divergence._share("n", "total"))
    assert df.first()[0] == 1 + 1_000_000_000 * (n + 5) // (n + 77)
