"""tessera: labelled-text corpus analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` or
``Column -> Column``. Randomness is always seeded and keyed (an md5 of
``seed:key``), so results repeat under any partitioning and can be
checked against SQL.
"""

from tessera.session import get_spark, checkpoint_dir, cut_lineage

__all__ = ["get_spark", "checkpoint_dir", "cut_lineage"]
