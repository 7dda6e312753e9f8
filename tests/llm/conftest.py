"""Small tables with awkward rows, and brute-force versions of the operators."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, class_id string, score string, key string"


def text_of(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def rows() -> list[tuple]:
    """Documents with nulls, empty and long texts, copies, near copies, repeated rows,
    a shared passage, periodic text, odd bytes and columns whose names clash with results."""
    rng = random.Random(5)
    base = text_of(rng, 90)
    words = base.split()
    passage = text_of(rng, 60)
    texts = [None, "", "   \n\t ", "one", "One two\x00three", "é ünï ☃ 漢字 ▁x", "a" * 700, "ab " * 300, "x\n" * 50]
    texts += [base, base, base.upper(), base.replace(" ", "  \n")]
    for k in range(12):
        copy = list(words)
        for _ in range(k // 3):
            copy[rng.randrange(len(copy))] = f"changed{k}"
        texts.append(" ".join(copy))
    texts += [text_of(rng, 40) + " " + passage + " " + text_of(rng, 30) for _ in range(5)]
    texts += [text_of(rng, n) for n in (5, 6, 7, 9, 10, 11, 400, 3000)]
    texts += ["the same line again and again and more\n" * 8 + text_of(rng, 20), "# * $ % & | < > words here " * 6]
    out = []
    for k, t in enumerate(texts):
        out.append((k, t, ["en", "fr", None][k % 3], ["s0", "s0", "s1", None, "s2"][k % 5], None if t is None else len(t), 7, "c", None, "k"))
    out.append((None, base, "en", "s0", 1, None, None, None, None))
    out.append((None, None, None, None, None, None, None, None, None))
    out += [out[20], out[20]]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA).withColumn("x", F.lit(1))
