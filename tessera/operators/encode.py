"""Label and sequence encoding, prediction vectors and text composition
(T8, T10, T13, T14)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions._util import guard
from tessera.operators.joins import attach_scores
from tessera.operators.small import join_small
from tessera.session import cut_lineage


def fit_label_encoder(df: DataFrame, col: str, index_col: str = "index") -> DataFrame:
    """T13 fit: sorted distinct labels -> 0..k-1 (numeric labels sort numerically,
    strings alphabetically). One row per class, so the window runs on a tiny table."""
    d = df.where(F.col(col).isNotNull()).select(col).distinct()
    return d.select(col, (F.row_number().over(Window.orderBy(col)) - 1).cast("int").alias(index_col))


def encode_labels(df: DataFrame, mapping: DataFrame, col: str, out: str = "label_index",
                  index_col: str = "index") -> DataFrame:
    """T13 transform: unseen labels are an error (raised inside the tasks)."""
    m = mapping.select(F.col(col).alias("_e_v"), F.col(index_col).alias(out))
    j = join_small(df, m, F.col(col) == F.col("_e_v"), "left")
    msg = F.concat(F.lit("unseen label "), F.col(col).cast("string"))
    return j.withColumn(out, guard(F.col(col).isNotNull() & F.col(out).isNull(), msg, F.col(out))).drop("_e_v")


def decode_labels(df: DataFrame, mapping: DataFrame, col: str, index: str = "label_index",
                  index_col: str = "index") -> DataFrame:
    """T13 inverse: index back to the original label."""
    m = mapping.select(F.col(index_col).alias("_e_i"), F.col(col).alias(col))
    return join_small(df, m, F.col(index) == F.col("_e_i"), "left").drop("_e_i")


# Special token ids of the word-level encoder.
PAD, UNK, CLS, SEP = 0, 1, 2, 3
FIRST_WORD_ID = 4


def tokens(text_col) -> "F.Column":
    """Word tokens of a cleaned text: lower-cased, split on single spaces, empty pieces dropped."""
    t = F.split(F.lower(F.col(text_col) if isinstance(text_col, str) else text_col), " ", -1)
    return F.filter(t, lambda w: w != "")


def build_vocabulary(df: DataFrame, text: str, size: int) -> DataFrame:
    """Top ``size`` words by frequency over the whole texts (ties by word), ids from 4.
    Counting is a map-side-combined aggregation; only the top ``size`` rows
    (a fixed bound) leave it, through TakeOrderedAndProject."""
    words = df.select(F.explode(tokens(text)).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
    top = counts.orderBy(F.col("freq").desc(), F.col("word")).limit(size)
    return top.select("word", "freq", (F.row_number().over(Window.orderBy(F.col("freq").desc(), F.col("word")))
                                       - 1 + FIRST_WORD_ID).cast("int").alias("id"))


#: Words in a bucket of the lookup table, and bytes of a table that goes into the plan.
BUCKET_WORDS, LOOKUP_BYTES = 2, 16 << 20


def word_lookup(vocab: DataFrame, max_bytes: int = LOOKUP_BYTES):
    """The vocabulary as a constant of the plan: a function from a word Column to its id (null
    for a word that it lacks), or None where the table would take more than ``max_bytes``.

    Words are filed by xxhash64 in an array of small buckets, so a lookup is one array access
    and one or two comparisons inside the expression. Rows and bytes are counted before
    anything is collected."""
    vocab = cut_lineage(vocab.where("word is not null").select("word", "id"))
    rows, size = vocab.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("word") + 16), F.lit(0))).first()
    if size > max_bytes:
        return None
    buckets = max(1, rows // BUCKET_WORDS)
    bucket = lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int")
    table = [[] for _ in range(buckets)]
    for r in vocab.select("word", "id", bucket(F.col("word")).alias("b")).collect():
        table[r["b"]].append({"w": r["word"], "i": r["id"]})
    # a constant expression: the optimiser reads it once
    filed = F.from_json(F.lit(json.dumps(table)), "array<array<struct<w: string, i: int>>>")

    def lookup(word):
        found = F.filter(F.get(filed, bucket(word)), lambda x: x["w"] == word)
        return F.get(found, F.lit(0))["i"]

    return lookup


def encode_sequences(df: DataFrame, text: str, key: str, vocab: DataFrame, max_len: int,
                     out: str = "input_ids", max_bytes: int = LOOKUP_BYTES) -> DataFrame:
    """[CLS] + ids of the first ``max_len - 2`` words + [SEP], post-padded with 0.

    Words beyond the cut are dropped first; the others are looked up inside the array
    expression (``word_lookup``), so no row is exploded or moved and ``key`` may
    repeat or be null. A vocabulary of more than ``max_bytes`` is joined instead."""
    lookup = word_lookup(vocab, max_bytes)
    words = F.slice(tokens(text), 1, max_len - 2)
    if lookup is None:
        return _encode_by_join(df, words, vocab, max_len, out)
    return df.withColumn(out, _padded(F.transform(words, lambda w: F.coalesce(lookup(w), F.lit(UNK))), max_len))


def _padded(ids, max_len: int):
    body = F.concat(F.array(F.lit(CLS)), F.coalesce(ids, F.array().cast("array<int>")), F.array(F.lit(SEP)))
    return F.concat(body, F.array_repeat(F.lit(PAD), F.lit(max_len) - F.size(body)))


def _encode_by_join(df: DataFrame, words, vocab: DataFrame, max_len: int, out: str) -> DataFrame:
    """T14 with a vocabulary of any size: one row per word meets its id in a join. The input is
    materialised once with a row number, so cleaning and tokenising run once."""
    rows = cut_lineage(df.withColumn("_e_row", F.monotonically_increasing_id()))
    pos = rows.select("_e_row", F.posexplode(words).alias("p", "word"))
    v = vocab.select(F.col("word").alias("_e_word"), "id")
    ids = join_small(pos, v, F.col("word") == F.col("_e_word"), "left").select("_e_row", "p", F.coalesce("id", F.lit(UNK)).alias("id"))
    seq = ids.groupBy("_e_row").agg(F.array_sort(F.collect_list(F.struct("p", "id"))).alias("_s"))
    seq = seq.select("_e_row", F.transform("_s", lambda s: s["id"]).alias("_ids"))
    return rows.join(seq, on="_e_row", how="left").withColumn(out, _padded(F.col("_ids"), max_len)).drop("_ids", "_e_row")


def explode_probs(df: DataFrame, vec: str, n: int, prefix: str = "prediction_class") -> DataFrame:
    """One column per class probability; a null vector or one of another length is an error."""
    v = guard(F.col(vec).isNull() | (F.size(vec) != n), f"prediction vectors must have {n} entries", F.col(vec))
    cols = [v[i].alias(f"{prefix}{i}") for i in range(n)]
    return df.select(*[c for c in df.columns], *cols)


# The text template of composed score labels.
COMPOSE_TEMPLATE = "cogency is %s [SEP] effectiveness is %s [SEP] reasonableness is %s [SEP] overall quality is %s [SEP] %s"


def compose_text(df: DataFrame, bins, text: str, out: str = "AQ") -> DataFrame:
    """Score labels and text in one string (a missing label prints as nan)."""
    parts = [F.coalesce(F.col(b).cast("string"), F.lit("nan")) for b in bins]
    return df.withColumn(out, F.format_string(COMPOSE_TEMPLATE, *parts, F.col(text)))


def compose_with_lookup(df: DataFrame, binned: DataFrame, key: str, order: str, bins, text: str,
                        out: str = "AQ", on_missing: str = "error") -> DataFrame:
    """T8 as in the reference: J1 lookup of the binned scores by ID, then compose. A row
    without scores is an error, or prints ``nan`` labels with ``on_missing='null'``."""
    j = attach_scores(df, binned, key, order, list(bins), on_missing=on_missing)
    return compose_text(j, bins, text, out)
