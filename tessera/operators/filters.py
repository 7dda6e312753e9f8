"""Projections and row filters (F1-F6). All plain predicates, pushed to the scan by Catalyst."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require(df: DataFrame, *cols: str) -> DataFrame:
    """keep rows where every given column (text, target) is present."""
    return df.na.drop(how="any", subset=list(cols))


def require_all(df: DataFrame) -> DataFrame:
    """drop rows with a null in any column."""
    return df.na.drop(how="any")


def drop_sentinels(df: DataFrame, col: str, value) -> DataFrame:
    """drop rows whose ``col`` equals ``value``; null values are kept (pandas ``!=``)."""
    return df.where(~F.col(col).eqNullSafe(F.lit(value)))


def exclude_flagged(df: DataFrame, flag) -> DataFrame:
    """drop flagged rows (e.g. moderator comments); a null flag counts as not flagged."""
    c = F.col(flag) if isinstance(flag, str) else flag
    return df.where(~F.coalesce(c, F.lit(False)))


# Task name -> (target column, optional base predicate). Fixed values of the
# moderation corpus; callers may pass their own table.
MODERATION_TASKS = {
    "moderation": ("MODERATED", None),
    "quality": ("MODFORQUALITY", None),
}


def select_task(df: DataFrame, task: str, tasks: dict | None = None, label_col: str = "label") -> DataFrame:
    """pick the target column (and base filter, a Column or SQL predicate string)
    by task name; unknown task is an error."""
    tasks = tasks if tasks is not None else MODERATION_TASKS
    if task not in tasks:
        raise ValueError(f"unknown task {task!r}; known: {sorted(tasks)}")
    target, pred = tasks[task]
    out = df if pred is None else df.where(pred)
    return out.withColumn(label_col, F.col(target))


def model_view(df: DataFrame, text: str, label: str, text_as: str = "text", label_as: str = "label") -> DataFrame:
    """project to (text, label) with canonical names; Catalyst prunes the scan."""
    return df.select(F.col(text).alias(text_as), F.col(label).alias(label_as))
