"""Running numbers within groups of any size: a group that holds most rows is spread over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.storage import written

#: Offsets up to this number (one for each partition, and one more for each group) are broadcast; beyond, joined by a shuffle.
BROADCAST_OFFSETS = 1_000_000
_ROW_BITS = 33  # of monotonically_increasing_id


def numbered(df: DataFrame, group: str, order: Sequence[str], out_col: str) -> DataFrame:
    """``df`` with ``out_col``: 1, 2, ... within each value of ``group`` in the order of ``order``, which must tell rows apart.

    Rows are sorted by range, numbered where they lie, and the partitions' counts summed up
    to offsets. Nulls are a group; an empty table gives no rows."""
    keys = [group, *order]
    place = F.monotonically_increasing_id()
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", place)
    rows = written(rows, "numbered").withColumn("_part", F.shiftright("_at", _ROW_BITS))
    firsts = rows.groupBy("_part", group).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(firsts.select("_part", F.col(group).alias("_group"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")), "offsets")
    small = F.broadcast(offsets) if offsets.count() <= BROADCAST_OFFSETS else offsets
    joined = rows.withColumnRenamed("_part", "_own").join(small, (F.col("_own") == F.col("_part")) & F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(out_col, F.col("_at") - F.col("_first") + 1 + F.col("_before")).select(*df.columns, out_col)
