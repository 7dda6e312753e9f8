"""Equality lookups.

The reference does these as per-row linear scans; here each is one
equi-join. The lookup side is reduced to one row per key first, so a join
can never multiply the left side, and AQE picks broadcast or sort-merge
from the measured size at run time (no unchecked broadcast hint).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions._util import guard
from tessera.operators.rank import hash_rank
from tessera.operators.small import join_small, null_safe_on
from tessera.session import cut_lineage

SCORE_COLS = ("cogency", "effectiveness", "reasonableness", "overall")


def first_per_key(right: DataFrame, key: str, order, cols) -> DataFrame:
    """One row per key: the values of the row with the smallest ``order`` (first match).
    ``order`` is a column or a list of columns compared left to right (the reference's
    "first" is file order). Where rows tie on ``order`` the one with the smallest
    ``cols`` is taken, so that the values come from one row and do not depend on
    the partitioning."""
    cols = list(cols)
    order = [order] if isinstance(order, str) else list(order)
    o = [F.col(c) for c in order]
    s = F.min(F.struct(*[c.alias(f"o{k}") for k, c in enumerate(o)], *[F.col(c).alias(f"v{k}") for k, c in enumerate(cols)])).alias("_j_v")
    return right.groupBy(key).agg(s).select(key, *[F.col(f"_j_v.v{k}").alias(c) for k, c in enumerate(cols)])


#: Rows of one left key that a join task takes; a key with more is spread over tasks.
HOT_ROWS = 200_000


def spread_hot(left: DataFrame, right: DataFrame, left_key: str, right_key: str, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equality join with columns ``_j_kh`` (hash of the key) and ``_j_salt`` to join on
    as well: left rows of a key that has more than ``hot_rows`` are dealt to as many salts as keep
    within it, and the right rows of such a key are copied to each. Other keys have salt 0.

    The counts are a narrow map-side combined aggregation; hot keys are at most
    rows / ``hot_rows``, and joined as a table of checked size. A row is counted by the hash of
    its key: a clash makes two keys share their salts, nothing else."""
    left = left.withColumn("_j_kh", F.xxhash64(F.col(left_key)))
    right = right.withColumn("_j_kh", F.xxhash64(F.col(right_key)))
    hot = left.where(F.col(left_key).isNotNull()).groupBy("_j_kh").agg(F.count(F.lit(1)).alias("_j_n")).where(F.col("_j_n") > hot_rows)
    hot = cut_lineage(hot.select(F.col("_j_kh").alias("_j_hot"), F.ceil(F.col("_j_n") / hot_rows).cast("int").alias("_j_salts")))
    salted = join_small(left, hot, F.col("_j_kh") == F.col("_j_hot"), "left")
    dealt = F.pmod(F.monotonically_increasing_id(), F.coalesce("_j_salts", F.lit(1))).cast("int")
    copies = join_small(right, hot, F.col("_j_kh") == F.col("_j_hot"), "left")
    copied = F.explode(F.sequence(F.lit(0), F.coalesce("_j_salts", F.lit(1)) - 1))
    return (salted.withColumn("_j_salt", dealt).drop("_j_hot", "_j_salts"), copies.withColumn("_j_salt", copied).drop("_j_hot", "_j_salts"))


def _attach(left, reduced, left_key, right_key, cols, on_missing, hot_rows=None):
    names = left.columns
    r = reduced.withColumnRenamed(right_key, "_j_key").withColumn("_j_hit", F.lit(True))
    if hot_rows is None:
        cond = left[left_key] == r["_j_key"]
    else:
        left, r = spread_hot(left, r, left_key, "_j_key", hot_rows)
        cond = (left["_j_kh"] == r["_j_kh"]) & (left["_j_salt"] == r["_j_salt"]) & (left[left_key] == r["_j_key"])
    out = left.join(r, cond, "left")
    vals = [F.col(c) for c in cols]
    if on_missing == "error":
        msg = F.concat(F.lit("no match for key "), left[left_key].cast("string"))
        vals[0] = guard(F.col("_j_hit").isNull(), msg, vals[0]).alias(cols[0])
    elif on_missing != "null":
        raise ValueError("on_missing must be 'error' or 'null'")
    return out.select(*[left[c] for c in names], *vals)


def attach_scores(left: DataFrame, right: DataFrame, key: str, order: str, cols=SCORE_COLS,
                  right_key: str | None = None, on_missing: str = "error") -> DataFrame:
    """Per left row, the ``cols`` of the first right row (by ``order``) with the same key.
    A missing match raises inside the tasks (``on_missing='error'``) or gives nulls."""
    right_key = right_key or key
    reduced = first_per_key(right, right_key, order, cols)
    return _attach(left, reduced, key, right_key, cols, on_missing)


def attach_scores_by_text(left: DataFrame, right: DataFrame, text: str, order: str, cols=SCORE_COLS,
                          on_missing: str = "error", hot_rows: int = HOT_ROWS) -> DataFrame:
    """J1 keyed by a long text. Joins on (xxhash64(text), salt, text): the hash
    partitions and compares first, the text only settles hash matches, and a text
    that very many left rows share is spread over tasks (``spread_hot``)."""
    reduced = first_per_key(right, text, order, cols)
    return _attach(left, reduced, text, text, cols, on_missing, hot_rows)


def attach_predictions(left: DataFrame, preds: DataFrame, key: str, vec: str = "predictions",
                       file_col: str = "file", pos_col: str = "pos", on_missing: str = "null") -> DataFrame:
    """Map key -> probability vector over all prediction files; a later
    (file, position) overwrites an earlier one."""
    last = preds.groupBy(key).agg(F.max_by(F.col(vec), F.struct(F.col(file_col), F.col(pos_col))).alias(vec))
    return _attach(left, last, key, key, [vec], on_missing)


def match_augmented(train: DataFrame, aug: DataFrame, key: str = "ID", aug_key: str = "ID",
                    sent: str = "sent", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every augmented sentence of each training row's key (1:N; duplicate
    training keys multiply, as in the reference). The training rows of a key that has
    very many are spread over tasks, its sentences copied to each."""
    names = train.columns
    a = aug.select(F.col(aug_key).alias("_j_key"), F.col(sent).alias("_j_sent"))
    t, a = spread_hot(train, a, key, "_j_key", hot_rows)
    out = t.join(a, (t["_j_kh"] == a["_j_kh"]) & (t["_j_salt"] == a["_j_salt"]) & (t[key] == a["_j_key"]), "inner")
    return out.select(*[t[c] for c in names if c != sent], F.col("_j_sent").alias(sent))


def pair_by_rank(left: DataFrame, right: DataFrame, left_key: str, right_key: str, seed,
                 by=(), rank_col: str = "pair_rank") -> DataFrame:
    """Pair the n-th row of ``left`` with the n-th row of ``right`` (seeded
    order, per stratum ``by``; a null stratum is one like any other); unmatched rows drop out."""
    by = list(by)
    l = hash_rank(left, left_key, seed, by=by, salt=["left"], rank_col=rank_col)
    r = hash_rank(right, right_key, seed, by=by, salt=["right"], rank_col=rank_col)
    return on_rank(l, r, by, rank_col)


def on_rank(left: DataFrame, right: DataFrame, by, rank_col: str) -> DataFrame:
    """Rows of equal stratum and rank; null strata are equal."""
    on = [*by, rank_col]
    names = [f"_j_r{k}" for k in range(len(on))]
    renamed = right.select(*[F.col(c).alias(n) for c, n in zip(on, names)], *[F.col(c) for c in right.columns if c not in on])
    return left.join(renamed, null_safe_on(on, names), "inner").drop(*names)


def exclude_keys(df: DataFrame, keys: DataFrame, key: str, keys_key: str | None = None) -> DataFrame:
    """Rows whose key is not in ``keys`` (left anti join)."""
    k = keys.select(F.col(keys_key or key).alias(key))
    return df.join(k, on=key, how="left_anti")


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """J7 rows: distinct keys of ``a`` that also occur in ``b`` (left semi join)."""
    return a.select(key).distinct().join(b.select(key), on=key, how="left_semi")


def overlap_count(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Leak audit, the number of keys present in both sets (one row)."""
    return overlap(a, b, key).agg(F.count(F.lit(1)).alias("n_overlap"))
