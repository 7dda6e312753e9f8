"""Evaluation as distributed aggregations.

Every classification metric comes from one confusion aggregation
``groupBy(by, y, y_hat).count()`` (map-side combined; at most groups x k x k
rows), followed by arithmetic on that tiny table. Predictions are never
collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tessera.operators.small import join_small, null_safe_on


def _safe_div(a: Column, b: Column) -> Column:
    # zero division gives 0, like the reference's metric library
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b.cast("double"))


def confusion(df: DataFrame, y: str = "y", y_hat: str = "y_hat", by=(), n: str | None = None) -> DataFrame:
    """Counts per gold x predicted label; with ``n`` a row stands for so many."""
    return df.groupBy(*by, F.col(y).alias("y"), F.col(y_hat).alias("y_hat")).agg((F.count(F.lit(1)) if n is None else F.sum(n)).alias("n"))


def per_class(df: DataFrame, y: str = "y", y_hat: str = "y_hat", by=(), n: str | None = None) -> DataFrame:
    """tp, predicted and support per class; classes = labels in gold or prediction."""
    by = list(by)
    c = confusion(df, y, y_hat, by, n)
    both = c.select(*by, F.explode(F.array(
        F.struct(F.col("y").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("y") == F.col("y_hat"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("tp")),
        F.struct(F.col("y_hat").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("tp")))).alias("s")).select(*by, "s.*")
    g = both.groupBy(*by, "cls").agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("predicted"),
                                     F.sum("support").alias("support"))
    return g.select(*by, "cls", "tp", "predicted", "support",
                    _safe_div(F.col("tp"), F.col("predicted")).alias("precision"),
                    _safe_div(F.col("tp"), F.col("support")).alias("recall"),
                    _safe_div(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1_score"))


def _restrict_classes(pc: DataFrame, labels, by) -> DataFrame:
    """Keep the listed classes only, adding zero rows for listed classes that never occur."""
    want = F.array(*[F.lit(v) for v in labels])
    groups = pc.select(*by).distinct() if by else pc.sparkSession.range(1).select()
    grid = groups.select(*by, F.explode(want).alias("cls"))
    kept = grid.join(pc, on=[*by, "cls"], how="left").na.fill(0, ["tp", "predicted", "support"])
    return kept.na.fill(0.0, ["precision", "recall", "f1_score"])


def classification_report(df: DataFrame, y: str = "y", y_hat: str = "y_hat", by=(), labels=None, with_accuracy: bool = False) -> DataFrame:
    """Per-class precision, recall, F1, support plus 'macro avg' and 'weighted avg' rows.
    Output (by..., label, precision, recall, f1_score, support); label is a string.
    ``labels`` (e.g. ``[1, 0]``) fixes the classes reported and averaged; a
    listed class that never occurs gets zeros. ``with_accuracy`` adds the
    'accuracy' row (its value in all three columns)."""
    by = list(by)
    pc = per_class(df, y, y_hat, by)
    if labels is not None:
        pc = _restrict_classes(pc, labels, by)
    rows = pc.select(*by, F.col("cls").cast("string").alias("label"), "precision", "recall", "f1_score",
                     F.col("support").cast("long").alias("support"))
    macro = pc.groupBy(*by).agg(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                                F.avg("recall").alias("recall"), F.avg("f1_score").alias("f1_score"),
                                F.sum("support").cast("long").alias("support"))
    tot = F.sum("support")
    weighted = pc.groupBy(*by).agg(
        F.lit("weighted avg").alias("label"),
        _safe_div(F.sum(F.col("precision") * F.col("support")), tot).alias("precision"),
        _safe_div(F.sum(F.col("recall") * F.col("support")), tot).alias("recall"),
        _safe_div(F.sum(F.col("f1_score") * F.col("support")), tot).alias("f1_score"),
        tot.cast("long").alias("support"))
    out = rows.unionByName(macro).unionByName(weighted)
    if with_accuracy:
        share = _safe_div(F.sum("tp"), tot)
        out = out.unionByName(pc.groupBy(*by).agg(F.lit("accuracy").alias("label"), share.alias("precision"), share.alias("recall"),
                                                  share.alias("f1_score"), tot.cast("long").alias("support")))
    return out


def accuracy(df: DataFrame, y: str = "y", y_hat: str = "y_hat", by=()) -> DataFrame:
    """Share of correct predictions; a null prediction or label is wrong, as in
    :func:`summary`."""
    return df.groupBy(*by).agg(F.avg(F.coalesce(F.col(y) == F.col(y_hat), F.lit(False)).cast("double")).alias("accuracy"))


def macro_prf(df: DataFrame, y: str = "y", y_hat: str = "y_hat", by=()) -> DataFrame:
    """Macro precision, recall and F1."""
    pc = per_class(df, y, y_hat, by)
    return pc.groupBy(*by).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
                               F.avg("f1_score").alias("macro_f1"))


def summary(df: DataFrame, y: str = "y", y_hat: str = "y_hat", by=()) -> DataFrame:
    """E3 + E4 from one per-class table: macro precision, recall, F1 and accuracy
    (sum of true positives over sum of support)."""
    pc = per_class(df, y, y_hat, by)
    return pc.groupBy(*by).agg(F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
                               F.avg("f1_score").alias("macro_f1"),
                               (F.sum("tp") / F.sum("support")).alias("accuracy"))


def binary_prf(df: DataFrame, y: str = "y", y_hat: str = "y_hat", by=(), positive=1) -> DataFrame:
    """E5: precision, recall and F1 of the positive class (0 when it never occurs)."""
    by = list(by)
    t, p = F.col(y) == F.lit(positive), F.col(y_hat) == F.lit(positive)
    g = df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(p).alias("pp"), F.count_if(t).alias("ap"))
    return g.select(*by, _safe_div(F.col("tp"), F.col("pp")).alias("pos_precision"),
                    _safe_div(F.col("tp"), F.col("ap")).alias("pos_recall"),
                    _safe_div(2 * F.col("tp"), F.col("pp") + F.col("ap")).alias("pos_f1"))


def balanced_accuracy(df: DataFrame, y: str = "y", y_hat: str = "y_hat", by=()) -> DataFrame:
    """Mean recall over the classes present in gold."""
    pc = per_class(df, y, y_hat, by)
    return pc.where(F.col("support") > 0).groupBy(*by).agg(F.avg("recall").alias("balanced_accuracy"))


def _above(p: str, t: Column) -> Column:
    # a null or NaN score is above nothing (Spark orders NaN above all numbers)
    return F.coalesce(~F.isnan(F.col(p).cast("double")) & (F.col(p) > t), F.lit(False))


# The threshold grid i * 0.01 for i = 10..89.
THRESHOLD_STEPS = range(10, 90)


def best_threshold(df: DataFrame, y: str = "y", p: str = "p", by=()) -> DataFrame:
    """F1 of ``p > t`` for t = 0.10 .. 0.89; strict improvement, so the lowest
    threshold wins ties; (0, 0) when no threshold gives F1 above 0.

    Histogram form: every row is counted once under j = number of grid
    thresholds strictly below p (81 values); true/false positives at
    threshold m are suffix sums over j > m, computed on <= 81 rows per group.
    A null or NaN score is above no threshold.
    """
    by = list(by)
    grid = F.array(*[F.lit(i * 0.01) for i in THRESHOLD_STEPS])
    j = F.size(F.filter(grid, lambda t: _above(p, t)))
    h = df.groupBy(*by, j.alias("j")).agg(F.count_if(F.col(y) == 1).alias("pos"),
                                         F.count_if(F.col(y) != 1).alias("neg"))
    n = len(THRESHOLD_STEPS)
    # dense j = 0..n per group, so that every threshold has a row
    zero = F.lit(0).cast("long")
    dense = h.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0), F.lit(n))).alias("j"), zero.alias("pos"), zero.alias("neg"))
    # a union and a sum instead of a join: a null group is a group
    full = dense.unionByName(h).groupBy(*by, "j").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    w = Window.partitionBy(*by).orderBy(F.col("j").desc()).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(*by)
    s = full.select(*by, "j", F.sum("pos").over(w).alias("tp"), F.sum("neg").over(w).alias("fp"),
                    F.sum("pos").over(tot).alias("P"))
    # threshold m (0-based) predicts positive for j > m: tp(m) = suffix sum at j = m + 1
    s = s.where(F.col("j") >= 1).withColumn("m", F.col("j") - 1)
    s = s.withColumn("f1", _safe_div(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("P")))
    best = s.groupBy(*by).agg(F.max_by(F.struct("f1", "m"), F.struct(F.col("f1"), -F.col("m"))).alias("b"))
    t = (F.col("b.m") + THRESHOLD_STEPS[0]).cast("double") * F.lit(0.01)
    return best.select(*by, F.when(F.col("b.f1") > 0, t).otherwise(F.lit(0.0)).alias("threshold"),
                       F.when(F.col("b.f1") > 0, F.col("b.f1")).otherwise(F.lit(0.0)).alias("f1"))


def apply_threshold(df: DataFrame, fitted: DataFrame, p: str = "p", by=(), out: str = "y_hat") -> DataFrame:
    """predicted = p > threshold, with the threshold fitted per group (one row per group)."""
    by = list(by)
    if not by:
        raise ValueError("apply_threshold needs the group columns the thresholds were fitted on")
    th = fitted.select(*[F.col(b).alias("_t_" + b) for b in by], F.col("threshold").alias("_t"))
    j = join_small(df, th, on=null_safe_on(by, ["_t_" + b for b in by]), how="left")
    return j.withColumn(out, _above(p, F.col("_t")).cast("int")).drop("_t", *["_t_" + b for b in by])


def mse(df: DataFrame, y: str = "y", p: str = "p", by=()) -> DataFrame:
    """Mean squared error."""
    d = F.col(y) - F.col(p)
    return df.groupBy(*by).agg(F.avg(d * d).alias("mse"))


def _r2(y: Column, p: Column) -> Column:
    # ss_tot = var_pop * count over the rows that have both values: one aggregation
    y, p = y.cast("double"), p.cast("double")
    both = F.when(y.isNotNull() & p.isNotNull(), y)
    return 1 - F.sum((y - p) * (y - p)) / (F.var_pop(both) * F.count(both))


def r2(df: DataFrame, y: str = "y", p: str = "p", by=()) -> DataFrame:
    """1 - ss_res / ss_tot, row-wise (not the squared correlation)."""
    return df.groupBy(*by).agg(_r2(F.col(y), F.col(p)).alias("r2"))


def pearson(df: DataFrame, y: str = "y", p: str = "p", by=()) -> DataFrame:
    """Pearson correlation of prediction and gold."""
    return df.groupBy(*by).agg(F.corr(p, y).alias("pearson"))


def regression_report(df: DataFrame, y: str = "y", p: str = "p", by=()) -> DataFrame:
    """E9-E11 in one aggregation: MSE, row-wise R2 and Pearson correlation."""
    d = F.col(y) - F.col(p)
    return df.groupBy(*by).agg(F.avg(d * d).alias("mse"), _r2(F.col(y), F.col(p)).alias("r2"),
                               F.corr(F.col(p).cast("double"), F.col(y).cast("double")).alias("pearson"))


# Fixed value: the smallest probability a log loss takes (the logarithm of a
# smaller one would leave the double range of a softmax).
MIN_PROBABILITY = 2.2250738585072014e-308


def weighted_log_loss(df: DataFrame, probs: str, y: str = "y", weight: str = "weight", by=()) -> DataFrame:
    """Class-weighted cross-entropy normalised by the sum of weights. A probability
    of 0 counts as the smallest normal double, so a wrong certainty costs about 708. A row
    without a label, a probability of it or a weight is in neither sum; a group of
    such rows has a null loss."""
    p = F.element_at(F.col(probs), F.col(y).cast("int") + 1)
    cost = F.when(p.isNotNull(), -F.col(weight) * F.ln(F.greatest(p, F.lit(MIN_PROBABILITY))))
    return df.groupBy(*by).agg(F.try_divide(F.sum(cost), F.sum(F.when(cost.isNotNull(), F.col(weight)))).alias("log_loss"))


def batch_metric_mean(df: DataFrame, batch: str = "batch_id", y: str = "y", y_hat: str = "y_hat", by=()) -> DataFrame:
    """Per-batch accuracy and macro F1, averaged over batches (divides by batches);
    both come from one per-class table."""
    by = list(by)
    return summary(df, y, y_hat, by=[*by, batch]).groupBy(*by).agg(
        F.avg("accuracy").alias("mean_batch_accuracy"), F.avg("macro_f1").alias("mean_batch_macro_f1"),
        F.count(F.lit(1)).alias("n_batches"))


def batch_regression_mean(df: DataFrame, batch: str = "batch_id", y: str = "y", p: str = "p", by=()) -> DataFrame:
    """E13, regression: per-batch R2 and Pearson correlation, averaged over batches (a
    batch without a defined value leaves that average)."""
    by = list(by)
    per = regression_report(df, y, p, by=[*by, batch])
    return per.groupBy(*by).agg(F.avg("r2").alias("mean_batch_r2"), F.avg("pearson").alias("mean_batch_pearson"),
                                F.count(F.lit(1)).alias("n_batches"))


def evaluate(df: DataFrame, y: str = "y", y_hat: str | None = None, p: str | None = None, threshold: float = 0.5,
             by=(), positive=1, n: str | None = None) -> DataFrame:
    """Accuracy, balanced accuracy, macro and positive-class precision, recall and F1 in
    one confusion aggregation. With ``p`` (a score) the prediction is ``p > threshold``; with
    ``n`` a row stands for so many."""
    by = list(by)
    x = df if p is None else df.withColumn("_e_hat", F.when(_above(p, F.lit(float(threshold))), F.lit(positive)).otherwise(F.lit(0)))
    pc = per_class(x, y, y_hat if p is None else "_e_hat", by, n)
    of_positive = lambda c: F.coalesce(F.max(F.when(F.col("cls") == F.lit(positive), F.col(c))), F.lit(0.0))
    return pc.groupBy(*by).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1_score").alias("macro_f1"),
        of_positive("precision").alias("pos_precision"), of_positive("recall").alias("pos_recall"), of_positive("f1_score").alias("pos_f1"))
