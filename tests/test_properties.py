"""Randomised properties: cut == rank <= k, distributed quantiles == numpy."""

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators.bins import exact_quantiles
from tessera.operators.rank import hash_cut, hash_rank

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(n=st.integers(1, 400), strata=st.integers(1, 5), share=st.floats(0.0, 1.2), seed=st.integers(0, 99))
def test_cut_equals_rank_prefix(spark, n, strata, share, seed):
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % strata).alias("s"))
    k_of = lambda size: F.ceil(F.lit(share) * size)
    cut = hash_cut(df, "k", seed, {"sel": k_of}, by=["s"], digits=1)
    rank = hash_rank(df, "k", seed, by=["s"], size_col="n", digits=1)
    j = cut.join(rank, ["k", "s"])
    assert j.where(F.col("sel") != (F.col("rank") <= F.ceil(F.lit(share) * F.col("n")))).count() == 0


@SETTINGS
@given(values=st.lists(st.integers(-5, 5), min_size=1, max_size=300))
def test_exact_quantiles_match_numpy(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    probs = (0.0, 1 / 6, 1 / 3, 0.5, 2 / 3, 5 / 6, 1.0)
    got = exact_quantiles(df, ["x"], probs)["x"]
    want = np.quantile(np.array(values, dtype=float), probs, method="linear")
    assert np.allclose(got, want, rtol=0, atol=1e-9)


PIECES = ["a", "é", "Z", "1", "42", ":", "[", "]", " ", "  ", "\n", "\n\n", "\t", "\x0b", "\x1c", "\x85", "\xa0",
          " ", " ", "http://", "https:", "//", "\\", "\\\\", "x.y", "?q=1&r", "â€", "™", "\"", "œ", "#", "~"]


@SETTINGS
@given(parts=st.lists(st.lists(st.sampled_from(PIECES), max_size=25), min_size=1, max_size=40))
def test_clean_text_minimal_form_equals_steps(spark, parts):
    from tessera.functions.text import clean_text, clean_text_steps
    df = spark.createDataFrame([("".join(p),) for p in parts], "t string")
    assert df.where(clean_text("t") != clean_text_steps("t")).count() == 0
