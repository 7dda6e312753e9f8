"""Deterministic splitting, sampling and batching (K1-K8).

Randomness is the seeded md5 order of :func:`hash_rank`; sizes are exact
(the reference's ``ceil``/``floor`` rules) and independent of partitioning.
Fold layouts are produced as a narrow assignment table ``(key, fold, part)``
so that only keys are multiplied by the number of folds; wide rows are
joined back once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions._util import guard
from tessera.functions.keys import order_hash
from tessera.operators.rank import hash_cut, hash_rank, sequential_rank


def _ceil_share(share: float, n: Column) -> Column:
    # double arithmetic on purpose: equals ceil(share * n) of the reference
    return F.ceil(F.lit(float(share)) * n.cast("double"))


def _floor_share(share: float, n: Column) -> Column:
    return F.floor(F.lit(float(share)) * n.cast("double"))


def holdout(df: DataFrame, key: str, seed, test: float = 0.2, by=(), part_col: str = "part") -> DataFrame:
    """K1: exact-size random split; the first ``ceil(test * n)`` rows (per stratum) in
    seeded hash order are 'test'. A cut, not a rank: the input rows are not shuffled."""
    c = hash_cut(df, key, seed, {"_k_t": lambda n: _ceil_share(test, n)}, by=by)
    return c.withColumn(part_col, F.when(F.col("_k_t"), "test").otherwise("train")).drop("_k_t")


def train_val_test(df: DataFrame, key: str, seed, test: float = 0.2, val: float = 0.25,
                   part_col: str = "part") -> DataFrame:
    """K2: K1, then ``ceil(val * n_rest)`` of the remaining rows become 'val' (60/20/20 by default)."""
    a = holdout(df, key, seed, test=test, part_col="_k_p1")
    c = hash_cut(a, key, seed, {"_k_v": lambda n: _ceil_share(val, n)}, by=["_k_p1"], salt=["val"])
    part = (F.when(F.col("_k_p1") == "test", "test")
            .when(F.col("_k_v"), "val")
            .otherwise("train"))
    return c.withColumn(part_col, part).drop("_k_p1", "_k_v")


def assign_folds(df: DataFrame, key: str, label: str, k: int, seed, fold_col: str = "test_fold") -> DataFrame:
    """K3 core: ``test_fold`` in 0..k-1 with equal class shares.

    Rows of a class take consecutive hash ranks; each class starts where the
    previous one ended, so fold sizes differ by at most one per class and
    overall.
    """
    r = hash_rank(df, key, seed, by=[label], rank_col="_k_rank", start_col="_k_start")
    return r.withColumn(fold_col, ((F.col("_k_rank") - 1 + F.col("_k_start")) % k).cast("int")) \
        .drop("_k_rank", "_k_start")


def _explode_folds(df: DataFrame, k: int) -> DataFrame:
    return df.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def stratified_fold_table(df: DataFrame, key: str, label: str, k: int = 5, seed=42,
                          val: float = 0.25, stratify_val: bool = False) -> DataFrame:
    """K3 as a narrow table ``(key, label, fold, part)``: every key is 'test' in exactly one fold;
    of the rest, ``ceil(val * n_rest)`` rows per fold are 'val' -- not stratified, as in the
    reference, unless ``stratify_val`` (then ``ceil(val * n_rest_class)`` per class)."""
    a = assign_folds(df.select(key, label), key, label, k, seed).select(key, label, "test_fold")
    e = _explode_folds(a, k).withColumn("_k_test", F.col("test_fold") == F.col("fold"))
    strata = ["fold", "_k_test"] + ([label] if stratify_val else [])
    r = hash_cut(e, key, seed, {"_k_v": lambda n: _ceil_share(val, n)}, by=strata, salt=["val", F.col("fold")])
    part = (F.when(F.col("_k_test"), "test")
            .when(F.col("_k_v"), "val")
            .otherwise("train"))
    return r.select(key, label, F.col("fold").cast("int").alias("fold"), part.alias("part"))


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 5, seed=42, val: float = 0.25,
                     stratify_val: bool = False) -> DataFrame:
    """K3: all k fold views of ``df`` with ``fold`` and ``part`` columns (k x n rows).
    Only the narrow key table is multiplied by k; wide rows are joined once."""
    return with_fold_table(df, stratified_fold_table(df, key, label, k, seed, val, stratify_val).drop(label), key)


def with_fold_table(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``df`` joined to a fold table (key, fold, part); a null key is a key like any other."""
    # a struct is never null, and equal where its fields are
    t = table.select(F.struct(F.col(key).alias("k")).alias("_k_tid"), "fold", "part")
    return (df.withColumn("_k_id", F.struct(F.col(key).alias("k"))).join(t, F.col("_k_id") == F.col("_k_tid"))
            .select(key, *[F.col(f"`{c}`") for c in df.columns if c != key], "fold", "part"))


def covering_fold_table(df: DataFrame, key: str, k: int = 10, test: float = 0.2, val: float = 0.15,
                        seed=42) -> DataFrame:
    """K4 as ``(key, fold, part)``: k shuffled blocks, block f is in fold f's test part,
    topped up to ``floor(test*n)`` rows by random other rows; ``floor(val*n)`` rows are 'val'.
    Blocks larger than ``floor(test*n)`` are an error."""
    r = hash_rank(df.select(key), key, seed, rank_col="_k_rank", size_col="_k_n")
    n, rk = F.col("_k_n"), F.col("_k_rank")
    q, rem = F.floor(n / k), n % k
    edge = rem * (q + 1)
    block = F.when(rk <= edge, F.floor((rk - 1) / (q + 1))).otherwise(rem + F.floor((rk - 1 - edge) / q))
    a = r.select(key, n.alias("_k_n"), block.cast("int").alias("_k_block"))
    e = _explode_folds(a, k).withColumn("_k_in", F.col("_k_block") == F.col("fold"))
    total = F.col("_k_n")  # constant, carried as a stratum column so the cuts can use it
    block_size = F.when(F.col("fold") < total % k, F.floor(total / k) + 1).otherwise(F.floor(total / k))
    extra = _floor_share(test, total) - block_size
    val_size = _floor_share(val, total)
    e = hash_cut(e, key, seed, {"_k_t2": lambda _: extra, "_k_v2": lambda _: extra + val_size},
                 by=["fold", "_k_in", "_k_n"], salt=["cover", F.col("fold")])
    part = (F.when(F.col("_k_in") | F.col("_k_t2"), "test")
            .when(F.col("_k_v2"), "val")
            .otherwise("train"))
    part = guard(extra < 0, "a block is larger than the test part: use more folds or a larger test share", part)
    return e.select(key, F.col("fold").cast("int").alias("fold"), part.alias("part"))


def covering_splits(df: DataFrame, key: str, k: int = 10, test: float = 0.2, val: float = 0.15, seed=42) -> DataFrame:
    """K4: all k views of ``df``; every key is in some test part at least once."""
    return with_fold_table(df, covering_fold_table(df, key, k, test, val, seed), key)


def sample_n(df: DataFrame, n: int, key: str, seed, strict: bool = True) -> DataFrame:
    """K5: exactly ``n`` rows without replacement; ``n`` above the row count is an error
    (unless not ``strict``). A hash cut at every size: the rows are not shuffled."""
    if strict:
        have = df.count()  # cheap: a count reads no columns
        if have < n:
            raise ValueError(f"cannot sample {n} rows from {have}")
    c = hash_cut(df, key, seed, {"_k_in": lambda size: F.lit(n).cast("long")})
    return c.where(F.col("_k_in")).drop("_k_in")


def shuffle(df: DataFrame, key: str, seed, rank_col: str = "shuffle_rank", physical: bool = False) -> DataFrame:
    """K6: a full random order as an explicit rank column; ``physical`` also lays
    the rows out in that order (range partitions, sorted within)."""
    r = hash_rank(df, key, seed, rank_col=rank_col)
    return r.repartitionByRange(rank_col).sortWithinPartitions(rank_col) if physical else r


def batches(df: DataFrame, size: int, key: str, seed=None, order=None, batch_col: str = "batch_id") -> DataFrame:
    """K7: fixed-size batches; shuffled by ``seed`` or sequential by ``order`` (+ key).
    ``(order, key)`` must be unique (a total order)."""
    if seed is not None:
        r = hash_rank(df, key, seed, rank_col="_k_rank")
    else:
        # rank the narrow (order, key) projection only; the wide rows meet their
        # rank in one null-safe join instead of being sorted and materialised themselves
        r = _ranked_by(df, key, list(order or []))
    return r.withColumn(batch_col, F.floor((F.col("_k_rank") - 1) / size).cast("long")).drop("_k_rank")


def _ranked_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``df`` with ``_k_rank`` by (order, key); a null is a value like any other."""
    cols = list(dict.fromkeys([*order, key]))
    ranks = sequential_rank(df.select(*cols), cols, rank_col="_k_rank")
    ident = F.struct(*[F.col(c) for c in cols])  # never null, and equal where all fields are
    ranks = ranks.select(ident.alias("_k_rid"), "_k_rank")
    return df.withColumn("_k_id", ident).join(ranks, F.col("_k_id") == F.col("_k_rid")).drop("_k_id", "_k_rid")


def length_bucketed_batches(df: DataFrame, length_col: str, size: int, key: str, seed, batch_col: str = "batch_id") -> DataFrame:
    """K8: batches of equal length as far as possible: order by (length, seeded hash, key), then cut."""
    b = df.withColumn("_k_h", order_hash(key, seed))
    r = _ranked_by(b, key, [length_col, "_k_h"])
    return r.withColumn(batch_col, F.floor((F.col("_k_rank") - 1) / size).cast("long")).drop("_k_rank", "_k_h")
