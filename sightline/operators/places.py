"""Places of rows in an order, without bringing all rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sightline.sources.checkpoints import use_checkpoints

#: monotonically_increasing_id: the partition stands above so many bits, the row in it below.
ROW_BITS = 33


def numbered(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """``df`` with each row's place from 0 in the order of these columns, equal rows in any order.

    Rows are dealt to partitions by range and sorted there; places are those within the
    partition plus the rows of the partitions before, a table of one row a partition.
    """
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    use_checkpoints(df.sparkSession)
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Range bounds come from a sample, so that the numbers are fixed before they are used twice.
    rows = dealt.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", ROW_BITS)).checkpoint()
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", (before - F.col("_first")).alias("_shift"))
    return rows.join(F.broadcast(starts), "_part").withColumn(name, F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")
