"""Profiles, weights and summaries.

Everything is one grouped aggregation with map-side partial combine; the
only windows run over aggregated results whose size is the number of
groups x classes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tessera.operators.small import join_small, null_safe_on


def value_counts(df: DataFrame, *cols: str, by=(), keep_null: bool = True) -> DataFrame:
    """A1: frequency of each value of several columns in ONE scan and one shuffle:
    unpivot to (field, value) and group. Output (by..., field, value, n)."""
    by = list(by)
    long = df.select(*by, *[F.col(c).cast("string").alias(c) for c in cols]) \
        .unpivot(by, list(cols), "field", "value")
    if not keep_null:
        long = long.where(F.col("value").isNotNull())
    return long.groupBy(*by, "field", "value").agg(F.count(F.lit(1)).alias("n"))


def cross_counts(df: DataFrame, c1: str, c2: str) -> DataFrame:
    """A2: joint frequency of two columns, null keys dropped (pandas value_counts)."""
    return df.where(F.col(c1).isNotNull() & F.col(c2).isNotNull()) \
        .groupBy(c1, c2).agg(F.count(F.lit(1)).alias("n"))


def split_distribution(df: DataFrame, labels, fold: str = "fold", part: str = "part") -> DataFrame:
    """A3: label frequencies per fold x part x label column."""
    labels = [labels] if isinstance(labels, str) else list(labels)
    return value_counts(df, *labels, by=[fold, part])


def split_sizes(df: DataFrame, fold: str = "fold", part: str = "part") -> DataFrame:
    """A4: rows per fold x part and their share of the fold."""
    c = df.groupBy(fold, part).agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy(fold))
    return c.withColumn("share", F.col("n") / tot)


def expected_sizes(df: DataFrame, test: float = 0.2, val: float = 0.15, by=()) -> DataFrame:
    """A4: planned part sizes of a covering split: test ``floor(test*n)``, val
    ``floor(val*n)``, train the rest (one row per group)."""
    n = F.count(F.lit(1))
    g = df.groupBy(*by).agg(n.alias("n"))
    t = F.floor(F.lit(float(test)) * F.col("n").cast("double"))
    v = F.floor(F.lit(float(val)) * F.col("n").cast("double"))
    return g.select(*by, "n", t.alias("test_size"), v.alias("val_size"), (F.col("n") - t - v).alias("train_size"))


def class_weights(df: DataFrame, label: str, by=()) -> DataFrame:
    """A5: ``n / (n_classes * freq)`` per class (and per group ``by``)."""
    by = list(by)
    c = df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("freq"))
    w = Window.partitionBy(*by)
    return c.withColumn("weight", F.sum("freq").over(w) / (F.count(F.lit(1)).over(w) * F.col("freq")))


def with_class_weight(df: DataFrame, label: str, weight_col: str = "weight", by=()) -> DataFrame:
    """A5 applied: attach each row's class weight (for ``weightCol`` in pyspark.ml). A null
    group is a group like any other; a null label has no class, hence a null weight.
    The weight table has one row per group and class."""
    on = [*by, label]
    names = [f"_a_k{k}" for k in range(len(on))]
    w = class_weights(df, label, by).select(*[F.col(c).alias(n) for c, n in zip(on, names)], F.col("weight").alias(weight_col))
    return join_small(df, w, on=null_safe_on(on, names), how="left").drop(*names)


def class_weight_vector(df: DataFrame, label: str, n_classes: int, by=()) -> DataFrame:
    """Weights in class order 0..n-1 as one array per group; a missing class is an error."""
    by = list(by)
    w = class_weights(df, label, by)
    arr = F.array_sort(F.collect_list(F.struct(F.col(label).cast("int").alias("c"), F.col("weight").alias("w"))))
    g = w.groupBy(*by).agg(arr.alias("_a"))
    ok = (F.size("_a") == n_classes) & F.forall(
        F.col("_a"), lambda x: (x["c"] >= 0) & (x["c"] < n_classes))
    vec = F.when(ok, F.transform("_a", lambda x: x["w"])).otherwise(
        F.raise_error(F.lit(f"class weights need every class 0..{n_classes - 1} exactly")))
    return g.select(*by, vec.alias("class_weights"))


def what_if_distribution(df: DataFrame, label: str, multipliers: dict | None = None, by=()) -> DataFrame:
    """Class shares in percent after scaling some classes' counts, ascending by
    frequency. One total after scaling (fixes the reference's moving total)."""
    by = list(by)
    c = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("freq"))
    m = F.lit(1).cast("double")
    for cls, factor in (multipliers or {}).items():
        m = F.when(F.col(label) == F.lit(cls), F.lit(float(factor))).otherwise(m)
    c = c.withColumn("scaled", F.col("freq") * m)
    c = c.withColumn("percent", F.col("scaled") / F.sum("scaled").over(Window.partitionBy(*by)) * 100.0)
    # ascending by frequency, as printed by the reference (a small aggregated table)
    return c.orderBy(*by, "freq", label)


def agreement_count(df: DataFrame, cols, by=()) -> DataFrame:
    """Rows whose binned scores are not all equal."""
    cols = list(cols)
    same = F.lit(True)
    for a, b in zip(cols, cols[1:]):
        same = same & F.col(a).eqNullSafe(F.col(b))
    return df.groupBy(*by).agg(F.count_if(~same).alias("n_different"), F.count(F.lit(1)).alias("n"))


def fold_average(metrics: DataFrame, by=("model", "part", "metric"), value: str = "value") -> DataFrame:
    """Mean of a metric over folds per (model, part, metric)."""
    return metrics.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n_folds"))


def report_summary(metrics: DataFrame, by=("metric",), value: str = "value") -> DataFrame:
    """A10: geometric mean and sample stdev per overall metric.
    Any zero gives 0 (Python's statistics), a negative value is an error."""
    x = F.col(value)
    gm = (F.when(F.min(x) < 0, F.raise_error(F.lit("geometric mean of a negative value")))
          .when(F.min(x) == 0, F.lit(0.0))
          .otherwise(F.exp(F.avg(F.ln(x)))))
    return metrics.groupBy(*by).agg(gm.alias("geo_mean"), F.stddev_samp(x).alias("stdev"),
                                    F.count(F.lit(1)).alias("n"))


def class_report_summary(metrics: DataFrame, by=("label", "metric"), value: str = "value") -> DataFrame:
    """Arithmetic mean and sample stdev per class x metric."""
    return metrics.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("stdev"),
                                    F.count(F.lit(1)).alias("n"))
