"""Baseline predictors (M1, M2) as joins with a per-group class table.

The class table has one row per group (e.g. fold) holding the sorted
training classes, so it is tiny and AQE broadcasts it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import order_hash
from tessera.operators.small import join_small, null_safe_on


def _hash_int(key, seed, *salt):
    # 52-bit non-negative integer from the first 13 hex digits of the order hash
    return F.conv(F.substring(order_hash(key, seed, *salt), 1, 13), 16, 10).cast("long")


def _per_group(rows: DataFrame, table: DataFrame, by) -> DataFrame:
    """``rows`` with the columns of the one-row-per-group ``table``; a null group is a group."""
    named = table.select(*[F.col(b).alias("_m_" + b) if b in by else F.col(b) for b in table.columns])
    return join_small(rows, named, null_safe_on(by, ["_m_" + b for b in by]), "left").drop(*["_m_" + b for b in by])


def uniform_baseline(train: DataFrame, test: DataFrame, label: str, key: str, seed, by=(),
                     out: str = "y_hat") -> DataFrame:
    """M1: predict a training class chosen uniformly per row (seeded by the row key)."""
    by = list(by)
    classes = train.where(F.col(label).isNotNull()).groupBy(*by) \
        .agg(F.array_sort(F.collect_set(label)).alias("_m_classes"))
    if by:
        j = _per_group(test, classes, by)
    else:  # one list of classes: a bounded, tiny result
        j = test.withColumn("_m_classes", F.lit(classes.first()["_m_classes"]))
    pick = F.element_at(F.col("_m_classes"), (_hash_int(key, seed, "uniform") % F.size("_m_classes") + 1).cast("int"))
    return j.withColumn(out, pick).drop("_m_classes")


def majority_baseline(train: DataFrame, test: DataFrame, label: str, by=(), out: str = "y_hat") -> DataFrame:
    """M2: predict the most frequent training class; the smallest label wins ties."""
    by = list(by)
    c = train.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count(F.lit(1)).alias("_m_n"))
    # two steps, so that labels of any type can break ties: the smallest label per
    # count, then the largest count
    least = c.groupBy(*by, "_m_n").agg(F.min(label).alias(out))
    top = least.groupBy(*by).agg(F.max_by(F.col(out), F.col("_m_n")).alias(out))
    if by:
        return _per_group(test, top, by)
    return test.withColumn(out, F.lit(top.first()[out]))
