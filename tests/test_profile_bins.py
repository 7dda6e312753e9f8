import pytest
from pyspark.sql import functions as F

from tessera.operators import bins as Q
from tessera.operators import profile as A


def test_class_weights_g2(spark):
    df = spark.createDataFrame([(0,), (0,), (0,), (1,)], "y int")
    w = {r.y: r.weight for r in A.class_weights(df, "y").collect()}
    assert abs(w[0] - 4 / 6) < 1e-12 and abs(w[1] - 2.0) < 1e-12
    v = A.class_weight_vector(df, "y", 2).first().class_weights
    assert [round(x, 6) for x in v] == [0.666667, 2.0]


def test_class_weight_vector_missing_class_is_error(spark):
    df = spark.createDataFrame([(0,), (2,)], "y int")
    with pytest.raises(Exception):
        A.class_weight_vector(df, "y", 3).collect()


def test_report_summary_g7(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 0.0), ("b", 4.0)], "metric string, value double")
    r = {x.metric: x for x in A.report_summary(df).collect()}
    assert abs(r["a"].geo_mean - 2.0) < 1e-12 and abs(r["a"].stdev - 2.121320) < 1e-6
    assert r["b"].geo_mean == 0.0


def test_value_counts_one_scan_keeps_null(spark):
    df = spark.createDataFrame([("x", 1), ("x", None), (None, 1)], "a string, b int")
    got = {(r.field, r.value): r.n for r in A.value_counts(df, "a", "b").collect()}
    assert got == {("a", "x"): 2, ("a", None): 1, ("b", "1"): 2, ("b", None): 1}
    plan = A.value_counts(df, "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_what_if_single_total(spark):
    df = spark.createDataFrame([(1.0,)] * 3 + [(3.0,)], "y double")
    r = {x.y: x.percent for x in A.what_if_distribution(df, "y", {3.0: 2}).collect()}
    assert abs(r[1.0] - 60.0) < 1e-9 and abs(r[3.0] - 40.0) < 1e-9


def test_quantile_bins_g3(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 13)], "v double")
    edges = Q.exact_quantiles(df, ["v"])["v"]
    assert [round(e, 4) for e in edges] == [1.0, 2.8333, 4.6667, 6.5, 8.3333, 10.1667, 12.0]
    got = {r.v: r.tercile_v for r in Q.quantile_bins(df, "v").collect()}
    labels = Q.SIX_LABELS
    for i in range(1, 13):
        assert got[float(i)] == labels[(i - 1) // 2]


def test_quantile_bins_equal_edges_error(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 1.0, 1.0, 1.0, 2.0, 3.0)], "v double")
    with pytest.raises(ValueError):
        Q.quantile_bins(df, "v")


def test_exact_quantiles_match_percentile(spark):
    df = spark.range(1000).select((F.col("id") % 37 * 1.5).alias("a"), (F.col("id") * 0.01).alias("b"))
    mine = Q.exact_quantiles(df, ["a", "b"])
    ref = df.agg(*[F.percentile(c, list(Q.SIX_PROBS)).alias(c) for c in ("a", "b")]).first()
    for c in ("a", "b"):
        assert all(abs(x - y) < 1e-9 for x, y in zip(mine[c], ref[c]))
