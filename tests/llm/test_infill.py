"""Fill-in-the-middle against a plain version, and the index of multibyte characters."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import infill
from tessera.llm.queries import op12_fill_in_middle
from tests.llm.conftest import rows


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(doc_id, text, unit="line", rate=100, spm_rate=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text) if unit == "line" else list(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    if h4 % 100 < spm_rate:
        return doc_id, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def mixed_text(rng, n):
    return "".join(rng.choice("ab \n<>PSM\r\u0085é漢😀 ́") for _ in range(n))


@pytest.mark.parametrize("seed", range(30))
def test_index_converts_both_ways(seed):
    rng = random.Random(seed)
    text = mixed_text(rng, rng.randrange(200)) if seed else ""
    index = infill.MultibyteIndex(np.frombuffer(text.encode(), np.uint8))
    points = np.arange(len(text) + 1)
    places = np.array([len(text[:k].encode()) for k in points])
    assert (index.points(places) == points).all() and (index.bytes(points) == places).all()


def test_ascii_has_no_exceptions():
    assert len(infill.MultibyteIndex(np.frombuffer(b"plain text\n" * 99, np.uint8)).byte) == 0


@pytest.mark.parametrize("unit,rate,spm_rate", [("line", 100, 50), ("char", 100, 50), ("line", 30, 100), ("char", 60, 0)])
def test_transform_equals_the_plain_version(spark, unit, rate, spm_rate):
    rng = random.Random(4)
    table = [(d, t) for d, t, *_ in rows()]
    table += [(1000 + k, mixed_text(rng, rng.randrange(60))) for k in range(300)]
    table += [(2000, "a<P>b"), (2001, "<"), (2002, "x<S"), (2003, "\n"), (2004, "\n\n"), (2005, "😀"), (2006, "a\n" * 300_000), (2007, "é" * 500_000), (-5, "minus\none")]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    out = infill.fill_in_middle(df, unit, rate, spm_rate).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in out), key=str) == sorted((plainly(d, t, unit, rate, spm_rate) for d, t in table), key=str)
    assert sorted((str(r["doc_id"]), r["back"]) for r in out) == sorted((str(d), t or "") for d, t in table)


def test_query_returns_digests(spark, docs, scratch):
    docs.write.parquet(f"{scratch}/documents.parquet")
    got = sorted((tuple(r) for r in op12_fill_in_middle(spark, scratch).collect()), key=str)
    want = []
    for d, t, *_ in rows():
        *head, output = plainly(d, t)
        want.append((*head, digest(output), digest(t or "")))
    assert got == sorted(want, key=str)


def test_nothing_and_bad_parameters(spark, no_docs):
    assert infill.fill_in_middle(no_docs).count() == 0
    with pytest.raises(ValueError):
        infill.fill_in_middle(no_docs, unit="word")
    with pytest.raises(ValueError):
        infill.fill_in_middle(no_docs, markers=("<P>", "<P>", "<M>"))
