"""Dense numbering of a whole table in a given order, without one task seeing it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def dense_order(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: the row's place in the order of the columns ``order``,
    from 0 and without gaps.

    Rows are dealt to range partitions and written once with their partition's
    number (ranges are sampled, so a second run could cut elsewhere); each row's
    place is its place in the partition plus the rows of the partitions before.
    The window over those counts has a row for each partition, not for each row of
    ``df``. Rows that are equal in all of ``order`` are numbered in any order."""
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
                   .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ordered")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))  # a row for each partition
    shift = counts.select("_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    # Increasing ids are consecutive within a partition.
    return rows.join(shift, "_part").withColumn(name, F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
