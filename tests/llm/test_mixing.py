"""The schedule of the mix against a plain one, block by block."""

import heapq
import math
import random
from fractions import Fraction

import pytest

from tessera.llm import mixing


def plain(sources):
    """{(source, block): slot}: each slot goes to the released block that is due first, by a heap."""
    d = sum(a for _, a, _ in sources)
    later = [(0, i, 0) for i, (_, _, n) in enumerate(sources) if n]
    ready, out, slot = [], {}, 0
    while later or ready:
        if not ready:
            slot = max(slot, later[0][0])
        while later and later[0][0] <= slot:
            release, i, j = heapq.heappop(later)
            heapq.heappush(ready, (-(-(j + 1) * d // sources[i][1]), sources[i][0], j, i))
        due, name, j, i = heapq.heappop(ready)
        assert slot < due
        out[name, j] = slot
        if j + 1 < sources[i][2]:
            heapq.heappush(later, ((j + 1) * d // sources[i][1], i, j + 1))
        slot += 1
    return out


CASES = {
    "all end together": [(f"s{k}", a, a * 9) for k, a in enumerate((7, 11, 13, 17, 19))],
    "one goes on": [("a", 10, 40), ("b", 3, 300), ("c", 1, 2)],
    "rare": [("a", 100_000, 900), ("b", 3, 1), ("c", 99_997, 500)],
    "beyond long": [("a", 10**17 + 1, 300), ("b", 10**17, 700), ("c", 3 * 10**16, 11)],
    "many": [(f"s{k:03}", random.Random(k).randrange(1, 50), random.Random(-k).randrange(1, 12)) for k in range(150)],
    "one": [("a", 1, 5)],
    "none": [],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("length", [4, 1024])
def test_schedule_is_the_plain_one(spark, monkeypatch, case, length):
    # segments of a few slots take over most of their blocks, and many first guesses are wrong
    monkeypatch.setattr(mixing, "SEGMENT", length)
    share = spark.createDataFrame([(s, str(a), n) for s, a, n in CASES[case]], "src string, a string, blocks long").selectExpr("src", "cast(a as decimal(38,0)) a", "blocks")
    rows = mixing.schedule(share).collect()
    assert {(r["src"], r["j"]): r["slot"] for r in rows} == plain(CASES[case]) and len(rows) == len(plain(CASES[case]))
    assert all(r["release"] <= r["slot"] < r["due"] for r in rows)


def test_weights_too_far_apart_are_refused(spark):
    share = spark.createDataFrame([("a", str(10**36), 5), ("b", "1", 50)], "src string, a string, blocks long").selectExpr("src", "cast(a as decimal(38,0)) a", "blocks")
    with pytest.raises(ValueError):
        mixing.schedule(share)


def test_mix_is_the_plain_schedule_of_its_blocks(spark, monkeypatch):
    """Exact weights, sources without one at the end, few rows in a block; places packed by bucket or joined."""
    rng = random.Random(3)
    rows = [(k if rng.random() > 0.1 else None, rng.choice(["a", "a", "a", "b", None, "c", "d"])) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"a": Fraction(1, 3), None: 0.25, "b": Fraction(1, 7), "d": 0}
    scale = math.lcm(3, 4, 7)
    n = {s: -(-sum(1 for _, x in rows if x == s) // 4) for s in ("a", "b", "c", "d", None)}
    want = {(s, j): t for (s, j), t in plain([("-", scale // 4, n[None]), ("sa", scale // 3, n["a"]), ("sb", scale // 7, n["b"])]).items()}
    start = max(want.values()) + 1
    want |= {k: t + start for k, t in plain([("sc", 1, n["c"]), ("sd", 1, n["d"])]).items()}
    out = mixing.mix_sources(df, weights, block_rows=4)
    key = lambda r: ("-" if r["source"] is None else "s" + r["source"], r["_m_block"])
    got = out.collect()
    assert len(got) == 900 and {key(r): r["_m_slot"] for r in got} == want
    assert len({r["_m_position"] for r in got}) == 900
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(mixing, "PACKED_ROWS", 0)
    joined = mixing.mix_sources(df, weights, block_rows=4).where("doc_id is not null").collect()
    place = lambda r: (r["doc_id"], r["source"], *(r[c] for c in mixing.PLACED))
    assert sorted(map(place, joined), key=str) == sorted((place(r) for r in got if r["doc_id"] is not None), key=str)
