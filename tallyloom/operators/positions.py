"""Global positions of rows in a sort order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.session import partitions_for, write_shared


def with_positions(df: DataFrame, order: list[str | Column], partitions: int | None = None, name: str = "position") -> DataFrame:
    """df with a column of consecutive positions from 0 in the order of the given columns, NULLs first unless a column says
    otherwise.

    The rows are range-partitioned, sorted within partitions and written to the shared folder, so that the partitions'
    borders are fixed before positions are derived: place in the partition plus the number of rows in those before it.
    One narrow shuffle, in as many partitions as the table's size calls for; the only global step is a running sum over one
    row per partition. df is read twice, as ranges are sampled first: give a stored table where it is dear to compute. Rows
    equal in all order columns may trade places between runs, so give an order without ties where that matters. Order
    columns that all hold equal values cannot be split: include an identifier.
    """
    n = partitions or partitions_for(df)
    parts = (
        (df.repartitionByRange(n, *order) if n else df.repartitionByRange(*order))
        .sortWithinPartitions(*order)
        .withColumn("_p", F.spark_partition_id())
        .withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    stored = write_shared(parts, "positions")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # over one row per partition
    starts = stored.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    starts = F.broadcast(starts)  # a row per partition, of which there are at most some 100,000: about 2 MB
    return stored.join(starts, "_p").withColumn(name, F.col("_i") + F.col("_o")).drop("_p", "_i", "_o")
