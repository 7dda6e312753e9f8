"""Set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions._util import guard


def union_tagged(sources: dict, tag_col: str = "orig_lang") -> DataFrame:
    """Stack sources by column name, tagging each with its name; missing columns are null."""
    frames = [df.withColumn(tag_col, F.lit(tag)) for tag, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_parts(*dfs: DataFrame) -> DataFrame:
    """Stack frames by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def dedupe_first(df: DataFrame, subset, order, keep=None) -> DataFrame:
    """One row per ``subset`` value, the one with the smallest ``order`` (a column or a
    list of columns: first in file order).

    A null order comes after all others, and nulls of ``subset`` are a value like any other.
    ``order`` must tell the rows of a group apart: where its smallest value occurs twice in
    a group, the row is an error.

    Skew-safe form: ``min(order)`` per group is pre-aggregated map-side (a text
    repeated a million times ships one partial row per map task), then the
    winners (one per group, by its xxhash64) select their rows in one join, whose
    partitioning also serves the check for ties. Groups are hashed with xxhash64 first so
    that the hash aggregate compares long texts only on hash equality.

    With ``keep`` (the columns needed downstream) the winners' values come
    straight out of the aggregation, a single pass with no join; output is
    ``subset + order + keep``.
    """
    subset = [subset] if isinstance(subset, str) else list(subset)
    order = [order] if isinstance(order, str) else list(order)
    # nulls last, in a struct that is never null itself
    position = F.struct(*[c for k, o in enumerate(order) for c in (F.col(o).isNull().alias(f"n{k}"), F.col(o).alias(f"o{k}"))])
    group = F.xxhash64(*[F.col(c) for c in subset])
    if keep is not None:
        keep = [c for c in keep if c not in subset and c not in order]
        # min over one struct: all values come from the same row, whatever ties
        pick = F.min(F.struct(position.alias("at"), *[F.col(c).alias(f"v{k}") for k, c in enumerate(keep)])).alias("_u_v")
        return df.groupBy(group.alias("_u_h"), *[F.col(c) for c in subset]).agg(pick).select(
            *subset, *[F.col(f"_u_v.at.o{k}").alias(o) for k, o in enumerate(order)], *[F.col(f"_u_v.v{k}").alias(c) for k, c in enumerate(keep)])
    # one order column: its minimum fits a hash aggregate, and is null only if all of the group are
    place = F.col(order[0]) if len(order) == 1 else position
    winners = df.groupBy(group.alias("_u_h"), *[F.col(c) for c in subset]).agg(F.min(place).alias("_u_o")).select("_u_h", "_u_o")
    rows = df.withColumn("_u_g", group).withColumn("_u_p", place)
    first = rows.join(winners, (F.col("_u_g") == F.col("_u_h")) & F.col("_u_p").eqNullSafe(F.col("_u_o")), "left_semi")
    tied = F.count(F.lit(1)).over(Window.partitionBy("_u_g", "_u_p")) > 1
    message = F.concat(F.lit("order value occurs twice: "), F.concat_ws(", ", *[F.coalesce(F.col(o).cast("string"), F.lit("null")) for o in order]))
    checked = first.withColumn("_u_g", guard(tied, message, F.col("_u_g")))
    # a filter that keeps the checked column: nothing prunes it
    return checked.where(F.col("_u_g").isNotNull()).select(*[F.col(f"`{c}`") for c in df.columns])
