"""Binding of the corpus model to the driver's tables and the
end-to-end plans built from the operators.

corpus := documents LEFT JOIN labels ON doc_id. Key parts: UniqueID = doc_id,
small_gr = doc_id % 5, nr = doc_id % 7, sequence = doc_id % 3, name = source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import clean_text
from tessera.operators.filters import require
from tessera.operators.profile import class_weights
from tessera.operators.sets import dedupe_first
from tessera.operators.splits import stratified_fold_table
from tessera.session import cut_lineage
from tessera.sources.tables import table

SEED = 42
KEY_PARTS = ("UniqueID", "small_gr", "nr", "sequence", "name")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    l = table(spark, sf_dir, "labels")
    return d.join(l, on="doc_id", how="left")


def corpus_with_key_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return c.select("*",
                    F.col("doc_id").cast("string").alias("UniqueID"),
                    (F.col("doc_id") % 5).alias("small_gr"),
                    (F.col("doc_id") % 7).alias("nr"),
                    (F.col("doc_id") % 3).alias("sequence"),
                    F.col("source").alias("name"))


def cleaned_corpus(spark: SparkSession, sf_dir: str, label: str = "quality", keep=None) -> DataFrame:
    """F1 on text and label, T6 into cleaned_comment, U3 first row per cleaned text
    (only ``keep`` columns of the winners when given: one aggregation pass)."""
    c = require(corpus(spark, sf_dir), "text", label)
    c = c.withColumn("cleaned_comment", clean_text("text"))
    return dedupe_first(c, "cleaned_comment", "doc_id", keep=keep)


def fold_label_profile(spark: SparkSession, sf_dir: str, label: str = "quality", k: int = 5) -> DataFrame:
    """Flagship: label distribution and class weights per fold x part of the
    cleaned, de-duplicated corpus (F1 -> T6 -> U3 -> K3 -> A3 -> A5)."""
    base = cleaned_corpus(spark, sf_dir, label, keep=[label]).select("doc_id", label)
    # the cleaning + de-duplication runs once; the ranks read this narrow table
    base = cut_lineage(base)
    split = stratified_fold_table(base, "doc_id", label, k=k, seed=SEED)
    w = class_weights(split, label, by=["fold", "part"])
    return w.select("fold", "part", label, F.col("freq").alias("n"), "weight")
