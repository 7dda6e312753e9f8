"""The reference's three workflows composed from the operators.

A: build the corpus from per-language sources, clean, de-duplicate, split into
   stratified folds and write the fold table and its label distributions.
B: score baselines (forest, uniform, majority) on every fold's val and test
   parts and average over folds.
C: k-fold text classification with out-of-fold predictions, per-fold reports
   and a summary over folds; and the summary of a directory of run reports.

Each is one lazy plan per materialised table; only model fits loop (over k).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clean_text
from tessera.operators import crossfit as X
from tessera.operators import metrics as E
from tessera.operators import models as MD
from tessera.operators.baselines import majority_baseline, uniform_baseline
from tessera.operators.filters import drop_sentinels, require
from tessera.operators.profile import class_report_summary, fold_average, report_summary
from tessera.operators.sets import dedupe_first, union_parts, union_tagged
from tessera.operators.splits import stratified_fold_table
from tessera.session import cut_lineage
from tessera.sources.files import read_reports, write_distributions, write_splits


# --- A ------------------------------------------------------------------------
def build_corpus(sources: dict, text: str = "translation", sentinel_col: str = "UniqueID", sentinel=1,
                 tag_col: str = "orig_lang", out: str = "cleaned_comment") -> DataFrame:
    """F3 per source, U1 tagged union, T6 cleaning (stateless, one projection)."""
    tagged = union_tagged({tag: drop_sentinels(df, sentinel_col, sentinel) for tag, df in sources.items()}, tag_col)
    return tagged.withColumn(out, clean_text(text))


def split_corpus(corpus: DataFrame, key: str, label: str, order: str, k: int = 5, seed=42, val: float = 0.25,
                 text: str = "cleaned_comment") -> DataFrame:
    """F1 on text and label, U3 first row per text, K3 folds; returns the wide
    (fold, part) views. The narrow fold table is materialised once."""
    base = dedupe_first(require(corpus, text, label), text, order)
    folds = cut_lineage(stratified_fold_table(base, key, label, k, seed, val).drop(label))
    return base.join(folds, on=key, how="inner")


def write_corpus_splits(views: DataFrame, out: str, labels, fmt: str = "parquet") -> None:
    """S5 fold table (partitioned by fold and part) and S8 label distributions."""
    write_splits(views, f"{out.rstrip('/')}/splits", fmt=fmt)
    write_distributions(views, labels, f"{out.rstrip('/')}/distributions")


# --- B ------------------------------------------------------------------------
def baseline_report(views: DataFrame, label: str, key: str, features=MD.SCORE_FEATURES, k: int = 5,
                    num_trees: int = 1000, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Per fold: one forest fit on train, applied to val and test (the reference
    fits twice), the folds side by side; uniform and majority baselines for all folds in one plan.
    Returns (metrics per model x fold x part, averages over folds)."""
    train = views.where(F.col("part") == "train")
    evals = views.where(F.col("part") != "train")
    preds = [majority_baseline(train, evals, label, by=["fold"]).withColumn("model", F.lit("majority")),
             uniform_baseline(train, evals, label, key, seed, by=["fold"]).withColumn("model", F.lit("uniform")),
             X.forests_over_folds(views, label, key, features, k, num_trees, seed).withColumn("model", F.lit("forest"))]
    return _averaged(preds, key, label)


def stacked_report(views: DataFrame, label: str, key: str, features, k: int = 5, num_trees: int = 1000,
                   seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Per fold: the forest on scores and class probabilities (``features``, as J1, J3 and T10
    attach them); metrics and their averages as in ``baseline_report``."""
    return _averaged([X.forests_over_folds(views, label, key, features, k, num_trees, seed).withColumn("model", F.lit("stacked"))], key, label)


def _averaged(preds: list[DataFrame], key: str, label: str) -> tuple[DataFrame, DataFrame]:
    cols = [key, "fold", "part", label, "y_hat", "model"]
    by = ["model", "fold", "part"]
    m = E.summary(union_parts(*[p.select(*cols) for p in preds]), label, "y_hat", by=by) \
        .unpivot(by, ["macro_precision", "macro_recall", "macro_f1", "accuracy"], "metric", "value")
    return m, fold_average(m)


# --- C ------------------------------------------------------------------------
def kfold_text_evaluation(df: DataFrame, key: str, label: str, text: str = "cleaned_comment", k: int = 5,
                          seed=42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M10 with the M7 text classifier; E2 report per fold; A10 summary of the
    per-fold accuracy and macro scores. Returns (predictions, reports, summary)."""
    oof = cut_lineage(X.text_out_of_fold(df, key, label, text, k, seed))
    reports = E.classification_report(oof, label, "y_hat", by=["fold"])
    per_fold = E.summary(oof, label, "y_hat", by=["fold"]) \
        .unpivot(["fold"], ["macro_precision", "macro_recall", "macro_f1", "accuracy"], "metric", "value")
    return oof, reports, report_summary(per_fold)


# --- report directories ---------------------------------------------------------
def summarize_reports(spark, root: str) -> tuple[DataFrame, DataFrame]:
    """S4 over a directory of runs, then A10 per split x overall metric
    (geometric mean, sample stdev over runs) and A11 per split x class x metric."""
    r = read_reports(spark, root)
    overall = report_summary(r.where(F.col("label") == "all"), by=["split", "metric"])
    per_class = class_report_summary(r.where((F.col("label") != "all") & (F.col("metric") != "support")),
                                     by=["split", "label", "metric"])
    return overall, per_class
