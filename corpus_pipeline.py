"""The corpus pipeline: quality rules, near-duplicate removal, repeated strings,
source mixing and piece encoding, each stage on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
stage as Parquet in the shared folder and reads it again as the next one's
input. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, mixing, pieces, quality, suffix
from tessera.session import checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents: the one with the smallest id.

    Documents without an id or without words stay. Of several rows that share the kept id
    those with other words stay too, and of rows with the same shingles the one with the
    smallest text: no row goes but for one that has its words."""
    named = jaccard.join_components(docs).select("doc_id", "component_id").distinct()
    gone = named.where("component_id <> doc_id").select("doc_id")
    return jaccard.survivors(docs, gone)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated 200-byte strings; ``n_chars`` follows the text,
    and a document of which nothing is left goes."""
    cut = suffix.without_repeats(docs)
    changed = cut.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return changed.where("text is null or text <> ''")


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mix."""
    return mixing.interleaved(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of the best segmentations of every document and their digests, counts and scores,
    with its place in the mix: rows in the order of (mix_file, mix_row) are in the order in which
    the stage before wrote them (null if ``docs`` is not read from files)."""
    try:
        place = {"mix_file": F.col("_metadata.file_name"), "mix_row": F.col("_metadata.row_index")}
        docs.select(*place.values())
    except AnalysisException:
        place = {"mix_file": F.lit(None).cast("string"), "mix_row": F.lit(None).cast("long")}
    return pieces.encode_pieces(docs, keep=place, both=True)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("source mixing", mixed_sources),
    ("SentencePiece encoding", encoded),
]

#: SQL cannot express the suffix arrays and the piece lattice; the result is tested
#: against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = f"{base}/stage{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_SQL: dict[str, str] = {}
