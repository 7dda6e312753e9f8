"""Quantile binning (Q1): right-closed bins at exact quantile edges.

Exact quantiles at scale without funnelling a column into one task:

1. unpivot the columns to (column, value) and pre-aggregate to distinct
   (column, value, count) rows -- a hot value becomes one row;
2. a distributed sort of the distinct rows and a weighted position per row
   (:func:`sequential_rank`);
3. only the rows covering the 2 x |probs| target positions per column are
   collected (a fixed, tiny result); edges use linear interpolation at
   ``p * (n - 1)``, like Spark ``percentile`` and SQL ``quantile_cont``.

``method="approx"`` swaps steps 1-3 for ``percentile_approx``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.rank import sequential_rank

# The reference's six score bins.
SIX_PROBS = (0.0, 1 / 6, 1 / 3, 0.5, 2 / 3, 5 / 6, 1.0)
SIX_LABELS = ("very low", "low", "medium-low", "medium-high", "high", "very high")


def exact_quantiles(df: DataFrame, cols, probs=SIX_PROBS) -> dict:
    """{column: [edge per prob]} with linear interpolation, computed distributed."""
    cols = list(cols)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot([], cols, "column", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    vc = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    # the ranking materialises the distinct (column, value, count) rows once; the
    # sizes and the target rows are then read from that table, not from the input
    r = sequential_rank(vc, ["column", "value"], weight="cnt", rank_col="_q_end", start_col="_q_start")
    sizes = {row["column"]: row["n"] for row in r.groupBy("column").agg(F.sum("cnt").alias("n")).collect()}
    missing = [c for c in cols if not sizes.get(c)]
    if missing:
        raise ValueError(f"no values to bin in {missing}")
    # global positions run over columns in name order
    start, targets = 0, {}
    col_start = {}
    for c in sorted(cols):
        n = sizes[c]
        col_start[c] = start
        for p in probs:
            pos = p * (n - 1)
            for t in {math.floor(pos), math.ceil(pos)}:
                targets.setdefault(c, set()).add(start + t + 1)
        start += n
    want = F.array(*[F.lit(t) for c in cols for t in sorted(targets[c])])
    hits = r.where(F.exists(want, lambda t: (t >= F.col("_q_start")) & (t <= F.col("_q_end")))) \
        .select("column", "value", "_q_start", "_q_end").collect()

    def at(c, t):  # value at 0-based position t of column c
        g = col_start[c] + t + 1
        for h in hits:
            if h["column"] == c and h["_q_start"] <= g <= h["_q_end"]:
                return h["value"]
        raise AssertionError("quantile position not found")

    out = {}
    for c in cols:
        n, edges = sizes[c], []
        for p in probs:
            pos = p * (n - 1)
            lo, hi = math.floor(pos), math.ceil(pos)
            vlo, vhi = at(c, lo), at(c, hi)
            edges.append(vlo if lo == hi else vlo + (vhi - vlo) * (pos - lo))
        out[c] = edges
    return out


def approx_quantiles(df: DataFrame, cols, probs=SIX_PROBS, accuracy: int = 100_000) -> dict:
    aggs = [F.percentile_approx(F.col(c).cast("double"), list(probs), accuracy).alias(c) for c in cols]
    row = df.agg(*aggs).collect()[0]
    return {c: list(row[c]) for c in cols}


def bin_column(c, edges, labels) -> "F.Column":
    """Right-closed bins; the lowest edge is included; values outside the edges get null."""
    x = F.col(c) if isinstance(c, str) else c
    expr = F.when(x.isNull() | (x < F.lit(edges[0])) | (x > F.lit(edges[-1])), F.lit(None).cast("string"))
    for e, lab in zip(edges[1:], labels):
        expr = expr.when(x <= F.lit(e), F.lit(lab))
    return expr


def quantile_bins(df: DataFrame, cols, probs=SIX_PROBS, labels=SIX_LABELS, prefix: str = "tercile_",
                  method: str = "exact") -> DataFrame:
    """Q1: one label column ``prefix + col`` per score column; equal edges are an error (pandas qcut)."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    if len(labels) != len(probs) - 1:
        raise ValueError("need one label per bin")
    edges = exact_quantiles(df, cols, probs) if method == "exact" else approx_quantiles(df, cols, probs)
    for c in cols:
        if len(set(edges[c])) != len(edges[c]):
            raise ValueError(f"bin edges must be unique for {c}: {edges[c]}")
    return df.select("*", *[bin_column(F.col(c).cast("double"), edges[c], labels).alias(prefix + c) for c in cols])
