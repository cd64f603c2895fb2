"""Places of rows in an order, counted per range: no task and no driver holds more than a range, or a count per range."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visagelake.operators import tables


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with rank, their place from 0 in ascending order. Rows that are equal in all columns of order stay in one range."""
    sorted_ranges = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = tables.save(sorted_ranges.withColumns({"part": F.spark_partition_id(), "inside": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ordered")
    counts = sorted((r.part, r.n) for r in placed.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a range
    before, offsets = 0, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    found = placed.sparkSession.createDataFrame(offsets, "part int, before long")
    return placed.join(F.broadcast(found), "part").withColumn("rank", F.col("before") + F.col("inside")).drop("part", "inside", "before")
