from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def guard(cond: Column, message, value: Column) -> Column:
    """``value``, but raise inside the task when ``cond`` holds.

    The check lives in a column that is kept in the output, so column
    pruning cannot remove it.
    """
    msg = F.lit(message) if isinstance(message, str) else message
    return F.when(cond, F.raise_error(msg)).otherwise(value)
