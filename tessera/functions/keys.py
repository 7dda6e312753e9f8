"""Key construction (X1) and the seeded order hash used by every split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions._util import as_col


def composite_key(parts, sep: str = "#", missing: str = "nan") -> Column:
    """X1 as a Column: parts cast to string, null rendered as ``missing``, joined by ``sep``.

    ``concat_ws`` alone would silently skip nulls and let two keys collide.
    """
    return F.concat_ws(sep, *[F.coalesce(as_col(p).cast("string"), F.lit(missing)) for p in parts])


def with_id(df: DataFrame, parts, name: str = "ID", sep: str = "#") -> DataFrame:
    """Attach the composite business key."""
    return df.withColumn(name, composite_key(parts, sep))


def order_hash(key, seed, *salt) -> Column:
    """md5 hex of ``seed[:salt...]:key``; the same string in Spark and DuckDB."""
    # salts: plain values are literals, Columns (e.g. the fold) are evaluated per row
    pieces = [F.lit(str(seed))] + [F.lit(str(s)) if isinstance(s, (str, int, float)) else s.cast("string") for s in salt]
    return F.md5(F.concat_ws(":", *pieces, as_col(key).cast("string")))
