"""Rare-class augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions._util import guard
from tessera.functions.text import word_count
from tessera.operators.joins import on_rank
from tessera.operators.rank import hash_rank


def augmentation_candidates(df: DataFrame, label: str, value, text: str = "cleaned_comment",
                            key: str = "ID", order: str = "doc_id", min_words: int = 5) -> DataFrame:
    """(sent, ID) pairs to send to an augmenter.

    Rows of the class with at least ``min_words`` words; each ID is claimed by
    its first such row (shorter rows do not claim it); a text repeated under
    several IDs keeps the last claiming ID.
    """
    q = df.where((F.col(label) == F.lit(value)) & (word_count(text) >= min_words))
    first = q.groupBy(key).agg(F.min_by(F.struct(F.col(text).alias("sent"), F.col(order).alias("_o")),
                                        F.col(order)).alias("_f"))
    first = first.select(key, "_f.sent", "_f._o")
    return first.groupBy("sent").agg(F.max_by(F.col(key), F.col("_o")).alias(key))


def augment_training(train: DataFrame, aug: DataFrame, label: str, value, key: str = "ID",
                     row_key: str = "doc_id", text: str = "cleaned_comment", sent: str = "sent",
                     seed=42, by=("fold",), marker: str = "AUGMENTED",
                     marker_col: str = "UniqueID") -> DataFrame:
    """Append one new row per augmented sentence of each training row's ID.

    The new rows copy a donor training row drawn without replacement (seeded,
    per group ``by``; a null group is one like any other), take the sentence as text, ``value`` as label and
    ``marker`` as ``marker_col``; ``augmented_from`` keeps the donor's key.
    Fewer training rows than sentences in a group is an error. ``train`` is
    read several times (sentences, donors, the union): pass a materialised
    table when it is expensive to recompute.
    """
    by = list(by)
    # a sentence that occurs n times for an ID is appended n times
    a = aug.groupBy(F.col(key).alias("_a_key"), F.col(sent).alias("_a_sent")).agg(F.count(F.lit(1)).cast("int").alias("_a_times"))
    sents = train.select(*by, row_key, key).join(a, F.col(key) == F.col("_a_key"), "inner") \
        .withColumn("_a_k", F.explode(F.sequence(F.lit(1), F.col("_a_times")))) \
        .select(*by, F.concat_ws("\u0001", F.col(row_key).cast("string"), F.col("_a_sent"),
                                 F.when(F.col("_a_k") > 1, F.col("_a_k").cast("string"))).alias("_a_id"),
                F.col("_a_sent"))
    sents = hash_rank(sents, "_a_id", seed, by=by, salt=["sentence"], rank_col="_a_rank", size_col="_a_m")
    donors = hash_rank(train, row_key, seed, by=by, salt=["donor"], rank_col="_a_rank", size_col="_a_n")
    pair = on_rank(donors, sents.select(*by, "_a_rank", "_a_sent", "_a_m"), by, "_a_rank")
    donor = guard(F.col("_a_n") < F.col("_a_m"), "more augmented sentences than training rows",
                  F.col(row_key).cast("string"))
    new = pair.select(*[c for c in train.columns if c not in (text, label, marker_col)],
                      F.col("_a_sent").alias(text), F.lit(value).cast(train.schema[label].dataType).alias(label),
                      F.lit(marker).alias(marker_col), donor.alias("augmented_from"))
    new = new.select(*train.columns, "augmented_from")
    old = train.withColumn("augmented_from", F.lit(None).cast("string"))
    return old.unionByName(new)
