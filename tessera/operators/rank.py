"""Deterministic, exact, distributed ranks.

``hash_rank`` orders rows by ``md5(seed:key)`` (a seeded shuffle) inside
optional strata. Only the narrow ``(strata, key)`` projection is ranked: it is
materialised once, cut into ``16**digits`` buckets per stratum by the leading hex
digits of the hash, one table of bucket counts gives each bucket its offset
(in two levels, so that no window runs over all buckets), and ``row_number``
runs per (stratum, bucket). Strata and buckets are non-null keys, so the window
and the join with the offsets share one exchange; wide rows meet their rank in
one join.

``sequential_rank`` orders rows by arbitrary columns (values, lengths):
a range-partitioned sort (the partitioner samples the full sort key, so a
hot value is split when a tie-break column follows it), then per-partition
offsets from a count table with one row per partition.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions._util import as_col, guard
from tessera.functions.keys import order_hash
from tessera.operators.small import join_small
from tessera.session import cut_lineage

_H, _B, _S, _RN, _C, _OFF, _ID = "_rk_h", "_rk_b", "_rk_s", "_rk_rn", "_rk_c", "_rk_off", "_rk_id"

#: Rows wanted in a hash bucket of a single stratum.
BUCKET_ROWS = 50_000


def bucket_digits(rows: int) -> int:
    """Hex digits of a bucket so that ``rows`` rows of one stratum make buckets of about
    BUCKET_ROWS. The result of a rank or cut does not depend on it."""
    return max(1, math.ceil(math.log(max(rows / BUCKET_ROWS, 1), 16)))


def _struct(cols):
    # a struct is never null and equal structs have equal fields, nulls included
    return F.struct(*[F.col(c) for c in cols]) if cols else F.struct(F.lit(0).alias("all"))


class _Buckets:
    """The narrow ``(strata, key, hash)`` projection of a frame and its bucket counts,
    each materialised once."""

    def __init__(self, df: DataFrame, key: str, seed, by, salt, digits: int | None):
        self.key, self.by = key, list(by)
        rows = cut_lineage(df.select(*self.by, key).withColumn(_H, order_hash(key, seed, *salt)))
        self.digits = digits or bucket_digits(rows.count())
        self.rows = rows.withColumn(_S, _struct(self.by)).withColumn(_B, F.substring(_H, 1, self.digits))
        self.counts = cut_lineage(self.rows.groupBy(_S, _B).agg(F.count(F.lit(1)).alias(_C)))

    def sizes(self) -> DataFrame:
        """(stratum, _rk_n): one row per stratum."""
        return self.counts.groupBy(_S).agg(F.sum(_C).alias("_rk_n"))

    def offsets(self) -> DataFrame:
        """(stratum, bucket, count, rows before it in its stratum)."""
        half = max(1, self.digits // 2)
        c = self.counts.withColumn("_rk_g", F.substring(_B, 1, half))
        inside = Window.partitionBy(_S, "_rk_g").orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
        before = Window.partitionBy(_S).orderBy("_rk_g").rowsBetween(Window.unboundedPreceding, -1)
        groups = (c.groupBy(_S, "_rk_g").agg(F.sum(_C).alias("_rk_gc"))
                  .select(F.col(_S).alias("_rk_s2"), F.col("_rk_g").alias("_rk_g2"), F.coalesce(F.sum("_rk_gc").over(before), F.lit(0)).alias("_rk_go")))
        own = c.withColumn("_rk_io", F.coalesce(F.sum(_C).over(inside), F.lit(0)))
        return (own.join(groups, (F.col(_S) == F.col("_rk_s2")) & (F.col("_rk_g") == F.col("_rk_g2")))
                .select(_S, _B, _C, (F.col("_rk_go") + F.col("_rk_io")).alias(_OFF)))


def hash_rank(df: DataFrame, key: str, seed, *, by=(), salt=(), digits: int | None = None, rank_col: str = "rank",
              size_col: str | None = None, start_col: str | None = None) -> DataFrame:
    """Attach the exact 1-based rank of each row ordered by ``(md5(seed[:salt]:key), key)``
    within the strata ``by``. ``size_col`` (optional) receives the stratum size,
    ``start_col`` the number of rows in all strata ordered before this one.

    ``key`` must be unique within a stratum; a repeated key raises inside the task.

    Data movement: the narrow projection once by (stratum, bucket), bucket counts
    (map-side combined), and one join that brings ranks to wide rows. The input
    is read twice: for the projection and for the rows.
    """
    by = list(by)
    b = _Buckets(df, key, seed, by, salt, digits)
    w = Window.partitionBy(_S, _B).orderBy(F.col(_H), F.col(key))
    # equal keys hash equally, so a duplicate sits next to its twin in this window
    dup = F.lag(F.col(key)).over(w).eqNullSafe(F.col(key)) & (F.row_number().over(w) > 1)
    ranked = b.rows.withColumn(_RN, guard(dup, F.concat(F.lit("duplicate key in rank: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))),
                                          F.row_number().over(w)))
    off = b.offsets().select(F.col(_S).alias("_rk_os"), F.col(_B).alias("_rk_ob"), _OFF)
    out = ranked.join(off, (F.col(_S) == F.col("_rk_os")) & (F.col(_B) == F.col("_rk_ob")))
    cols = [(F.col(_OFF) + F.col(_RN)).cast("long").alias(rank_col)]
    if size_col or start_col:
        # one row per stratum
        before = Window.orderBy(_S).rowsBetween(Window.unboundedPreceding, -1)
        per = b.sizes().select(F.col(_S).alias("_rk_ps"), F.col("_rk_n").cast("long").alias(size_col or "_rk_size"),
                               F.coalesce(F.sum("_rk_n").over(before), F.lit(0)).cast("long").alias(start_col or "_rk_start"))
        out = join_small(out, per, F.col(_S) == F.col("_rk_ps"), "inner")
        cols += [F.col(c) for c in (size_col, start_col) if c]
    narrow = by + [key]
    if set(df.columns) == set(narrow):
        return out.select(*[F.col(c) for c in df.columns], *cols)
    ranks = out.select(_struct(narrow).alias("_rk_rid"), *cols)
    return df.withColumn(_ID, _struct(narrow)).join(ranks, F.col(_ID) == F.col("_rk_rid")).drop(_ID, "_rk_rid")


def sequential_rank(df: DataFrame, order, *, weight: str | None = None,
                    rank_col: str = "rank", start_col: str | None = None,
                    checkpoint: bool = True) -> DataFrame:
    """Global 1-based rank of rows by ``order`` (columns giving a total order).

    With ``weight`` every row stands for ``weight`` consecutive positions;
    ``rank_col`` is then its last position and ``start_col`` its first.
    The offset table has one row per sorted partition, so its broadcast is
    bounded by the partition count, not by the data.
    """
    order = [as_col(o) for o in order]
    w = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    s = df.orderBy(*order) \
        .withColumn("_sq_w", w) \
        .withColumn("_sq_pid", F.spark_partition_id()) \
        .withColumn("_sq_mid", F.monotonically_increasing_id())
    if checkpoint:
        s = cut_lineage(s)  # fixes partition ids and row order for the two uses below
    if weight:
        within = Window.partitionBy("_sq_pid").orderBy("_sq_mid").rowsBetween(Window.unboundedPreceding, 0)
        s = s.withColumn("_sq_cum", F.sum("_sq_w").over(within))
    else:
        s = s.withColumn("_sq_cum", F.col("_sq_mid") - F.shiftleft(F.col("_sq_pid").cast("long"), 33) + 1)
    parts = s.groupBy("_sq_pid").agg(F.sum("_sq_w").alias("_sq_pw"))
    before = Window.orderBy("_sq_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_sq_pid", F.coalesce(F.sum("_sq_pw").over(before), F.lit(0)).alias("_sq_off"))
    out = s.join(F.broadcast(parts), on="_sq_pid", how="inner")
    pos = (F.col("_sq_off") + F.col("_sq_cum")).cast("long")
    out = out.withColumn(rank_col, pos)
    if start_col:
        out = out.withColumn(start_col, pos - F.col("_sq_w") + 1)
    return out.drop("_sq_w", "_sq_pid", "_sq_mid", "_sq_cum", "_sq_off")


def hash_cut(df: DataFrame, key: str, seed, cuts: dict, *, by=(), salt=(), digits: int | None = None) -> DataFrame:
    """Mark the first ``k`` rows of every stratum in seeded hash order, without ranking.

    ``cuts`` maps an output column name to ``k``: a function of the stratum
    size Column (it may also use the ``by`` columns). The new boolean column is
    true exactly where :func:`hash_rank` would give ``rank <= k``. A cut that would
    fall between rows of one key raises.

    Only narrow data moves: one materialised projection and one table of bucket
    counts give sizes, offsets and the bucket that holds position ``k``; a window
    over those buckets gives the cutoff ``(hash, key)``, and the rows are compared
    with a table of one row per stratum. The input is read twice and not shuffled.
    """
    by = list(by)
    b = _Buckets(df, key, seed, by, salt, digits)
    sizes = cut_lineage(b.sizes())
    c = b.offsets().join(sizes.withColumnRenamed(_S, "_ct_s"), F.col(_S) == F.col("_ct_s"))
    c = c.select(_S, _B, _C, _OFF, "_rk_n", *[F.col(f"{_S}.`{x}`").alias(x) for x in by])
    targets = None
    for name, k_of in cuts.items():
        k = k_of(F.col("_rk_n"))
        t = c.where((k > F.col(_OFF)) & (k <= F.col(_OFF) + F.col(_C))) \
            .select(F.col(_S).alias("_ct_s"), F.col(_B).alias("_ct_b"), (k - F.col(_OFF)).cast("long").alias("_ct_r"), F.lit(name).alias("_ct_cut"))
        targets = t if targets is None else targets.unionByName(t)
    targets = cut_lineage(targets)  # strata x cuts rows
    same = (F.col(_S) == F.col("_ct_s")) & (F.col(_B) == F.col("_ct_b"))
    inb = join_small(b.rows.select(_S, _B, _H, key), targets.select("_ct_s", "_ct_b").distinct(), same, "left_semi")
    w = Window.partitionBy(_S, _B).orderBy(F.col(_H), F.col(key))
    split = F.lead(F.struct(_H, key)).over(w) == F.struct(_H, key)
    inb = inb.withColumn(_RN, F.row_number().over(w)).withColumn("_ct_split", F.coalesce(split, F.lit(False)))
    hit = inb.join(targets, same & (F.col(_RN) == F.col("_ct_r")))
    safe = guard(F.col("_ct_split"), F.concat(F.lit("duplicate key at a cut: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))), F.col(_H))
    cutoffs = hit.select(F.col(_S).alias("_ct_s"), "_ct_cut", F.struct(safe.alias("h"), F.col(key).alias("k")).alias("_ct_at"))
    # one row per stratum: its size and a cutoff per cut
    per = sizes.join(cutoffs.groupBy("_ct_s").pivot("_ct_cut", list(cuts)).agg(F.first("_ct_at")), F.col(_S) == F.col("_ct_s"), "left")
    per = per.select(F.col(_S).alias("_ct_ps"), F.col("_rk_n"), *[F.col(f"`{name}`").alias("_ct_c_" + name) for name in cuts])
    rows = df.withColumn(_H, order_hash(key, seed, *salt)).withColumn(_S, _struct(by))
    out = join_small(rows, per, F.col(_S) == F.col("_ct_ps"), "left")
    n = F.col("_rk_n")
    for name, k_of in cuts.items():
        k, at = k_of(n), F.col("_ct_c_" + name)
        inside = F.struct(F.col(_H).alias("h"), F.col(key).alias("k")) <= at
        out = out.withColumn(name, F.when(k >= n, F.lit(True)).when(k <= 0, F.lit(False)).otherwise(F.coalesce(inside, F.lit(False))))
    return out.drop(_H, _S, "_ct_ps", "_rk_n", *["_ct_c_" + name for name in cuts])
