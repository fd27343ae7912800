"""Running offsets over an ordered table, without a window that holds the whole of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..storage import materialize


def running_offsets(sizes: DataFrame, order: Sequence[str], size: str, name: str) -> DataFrame:
    """Add `name`: the sum of `size` over all rows that come before in `order`, which must name each row.

    Rows are dealt to ranges of the order; a window holds one range, and the ranges' own offsets come from their
    sums, of which there are as many as partitions.
    """
    ranged = sizes.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")  # once written, the ranges stay the same whenever they are read
    total, starts = 0, []
    for row in ranged.groupBy("__range").agg(F.sum(size).alias("n")).orderBy("__range").collect():  # a row for each partition
        starts.append((row["__range"], total))
        total += row.n
    starts = sizes.sparkSession.createDataFrame(starts, "__range int, __start long")
    before = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.withColumn(name, F.coalesce(F.sum(size).over(before), F.lit(0)))
    return out.join(F.broadcast(starts), "__range").withColumn(name, F.col(name) + F.col("__start")).drop("__range", "__start")
