"""Chat formatting by perspective rotation.

For every participant of a conversation the dialogue is rendered once with
that speaker as ``assistant`` and the others as named users; the loss mask
covers what the assistant says, its end marker included. System turns are
context: they belong to no participant and are never trained on.

The result has one row per turn and perspective, with character offsets in
the dialogue, so that no dialogue has to fit into one task; turns are numbered
within runs of turn numbers first and then shifted by the totals of the runs
before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Turn numbers of a run that one task orders.
RUN_TURNS = 512


def perspectives(conv: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, seq, speaker, rendered, start, n_chars, mask_start,
    mask_end (characters of the dialogue, end exclusive; null where not trained on).

    A null role speaks as ``unknown``, a null text is empty, null turns come first,
    turns with the same number are ordered by role and text, repeated rows are
    repeated turns, rows without a conversation id form one conversation. Markers
    inside a text are broken up with a space. A conversation without participants
    (system turns only) gives no rows, an empty table none."""
    role = F.coalesce(F.col("role"), F.lit("unknown"))
    body = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"<\|(im_start|im_end)\|>", "< |$1|>")
    turns = conv.select(
        "conv_id", "turn", role.alias("speaker"), body.alias("body"),
        F.coalesce(F.concat(F.lit("s"), F.col("conv_id").cast("string")), F.lit("-")).alias("ckey"),
        F.coalesce(F.floor(F.col("turn") / RUN_TURNS), F.lit(-(1 << 60))).alias("run"))
    cast = turns.where("speaker <> 'system'").select("ckey", F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    head = (F.when(own, F.lit(f"{START}assistant\n")).when(F.col("speaker") == "system", F.lit(f"{START}system\n"))
            .otherwise(F.concat(F.lit(f"{START}user name="), "speaker", F.lit("\n"))))
    rows = (turns.join(cast, "ckey").withColumn("own", own).withColumn("head", head)
            .withColumn("rendered", F.concat("head", "body", F.lit(f"{END}\n")))
            .withColumn("n_chars", F.length("rendered").cast("long")))
    key = ["ckey", "perspective", "run"]
    order = [F.col("turn").asc_nulls_first(), F.col("speaker"), F.col("body")]
    inside = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).withColumn("upto", F.sum("n_chars").over(inside))
    before = Window.partitionBy("ckey", "perspective").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    totals = (rows.groupBy(*key).agg(F.count("*").alias("c"), F.sum("n_chars").alias("s"))
              .select(*key, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("s0")))
    start = F.col("s0") + F.col("upto") - F.col("n_chars")
    return (rows.join(totals, key).select(
        "conv_id", "perspective", "turn", (F.col("c0") + F.col("k")).alias("seq"), "speaker", "rendered", start.alias("start"), "n_chars",
        F.when(F.col("own"), start + F.length("head")).alias("mask_start"),
        F.when(F.col("own"), start + F.col("n_chars") - 1).alias("mask_end")))
