"""Distributed prefix sums over a total order, within groups of any size.

Rows are range-partitioned by (group, order), so one group may span many
partitions. The sums of each (group, partition) are small - at most partitions
plus groups - and their running total gives every partition its offset; a
window inside the partition adds the rest. No task sees more than its range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.plans.staging import stage


def prefix_sums(df: DataFrame, order: list[str], sums: dict[str, str], group: str | None = None, name: str = "prefix") -> DataFrame:
    """Add for each ``sums`` entry (new column: value column) the sum over all earlier rows.

    ``order`` should decide between all rows that differ; rows equal in it may
    take either place. ``group`` must not be null. The frame is staged, since
    partition ids and ties must not change between the two reads.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [group] if group else []
    placed = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    placed = stage(placed.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), name)
    totals = placed.groupBy(*keys, "_part").agg(*[F.sum(value).alias(f"_t_{new}") for new, value in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_t_{new}").over(before), F.lit(0)).alias(f"_o_{new}") for new in sums])
    inside = Window.partitionBy(*keys, "_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumns({new: F.coalesce(F.sum(value).over(inside), F.lit(0)) for new, value in sums.items()})
    out = summed.join(offsets, [*keys, "_part"])
    return out.withColumns({new: F.col(new) + F.col(f"_o_{new}") for new in sums}).select(*df.columns, *sums)
