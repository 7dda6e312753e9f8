"""Joins against tables whose size is bounded by construction (one row per
class, stratum, fold or group).

The small side is materialised once on shared storage, its rows and
bytes are counted, and it is broadcast only below both bounds; beyond that the join is
a plain shuffle join. Without this, the planner sees no statistics for an
aggregate and plans a sort-merge join that shuffles the wide side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import cut_lineage

MAX_BROADCAST_ROWS = 500_000
#: Bytes of a checked table, as rows times the width of its plan's row.
MAX_BROADCAST_BYTES = 64 << 20
#: Fits that run side by side on the cluster; the driver only waits for them.
PARALLEL_FITS = 4


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left",
               max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    small = cut_lineage(small)
    # read from the materialised table, not the source
    rows, size = small.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*small.columns)))), F.lit(0))).first()
    side = F.broadcast(small) if rows <= max_rows and size <= MAX_BROADCAST_BYTES else small
    return big.join(side, on=on, how=how)


def null_safe_on(left_cols, right_cols) -> Column:
    conds = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left_cols, right_cols)]
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


def side_by_side(tasks: Sequence[Callable], parallelism: int = PARALLEL_FITS) -> list:
    """Results of the tasks in their order; up to ``parallelism`` run at a time."""
    spark = SparkSession.getActiveSession()

    def call(task):
        return task()

    with ThreadPool(max(1, min(parallelism, len(tasks)))) as pool:
        return pool.map(inheritable_thread_target(spark)(call), tasks)
