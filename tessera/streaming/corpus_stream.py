"""Structured Streaming form of the stateless corpus steps.

F1, X1 and the T1-T7 text functions are pure column expressions, so the
same code cleans a stream of arriving documents. The only state kept is
the per-label running count (A1), whose size is the number of labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tessera.functions.keys import composite_key
from tessera.functions.text import clean_text, word_count
from tessera.operators.filters import require


def read_corpus_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 64,
                       glob: str | None = None) -> DataFrame:
    """Parquet files arriving in the folder ``path`` as a stream (explicit schema,
    bounded batches); ``glob`` keeps only matching file names."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.parquet(path)


def clean_corpus_stream(stream: DataFrame, text: str = "text", label: str | None = None,
                        key_parts=None) -> DataFrame:
    """F1 on text (and label), T6 into ``cleaned_comment``, T7 word count, optional X1 key."""
    req = [text] + ([label] if label else [])
    out = require(stream, *req).withColumn("cleaned_comment", clean_text(text)) \
        .withColumn("n_words", word_count("cleaned_comment"))
    if key_parts:
        out = out.withColumn("ID", composite_key(key_parts))
    return out


def label_counts_stream(stream: DataFrame, label: str, by=()) -> DataFrame:
    """Running label frequencies (A1/A2 on a stream); state = one row per label group."""
    return stream.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))


def start_clean_sink(cleaned: DataFrame, path: str, checkpoint: str, trigger_once: bool = True) -> StreamingQuery:
    """Write cleaned rows to Parquet; ``checkpoint`` must be on shared storage so a
    restarted query resumes exactly once."""
    w = cleaned.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()
