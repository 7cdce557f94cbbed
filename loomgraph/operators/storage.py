"""Settling a plan in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.session import scratch

#: Rows of a range, about, when rows are numbered.
RANGE_ROWS = 500_000


def settled(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends here, and lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[str], within: list[str] | None = None) -> DataFrame:
    """Adds place (from 0, in order, within each group) and size (the group's rows).

    Rows are sorted over ranges; a row's place is the number of its group's rows in earlier ranges and its place in its
    own range. So no window holds a whole group, however few the groups are.
    """
    groups = within or []
    ranges = 1 + rows.count() // RANGE_ROWS
    dealt = settled(rows.repartitionByRange(ranges, *groups, *order).withColumn("range", F.spark_partition_id()), "ranges")
    per_range = dealt.groupBy("range", *groups).agg(F.count("*").alias("in_range"))
    # a row for each range and group
    before = Window.partitionBy(*groups).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_range.withColumn("start", F.coalesce(F.sum("in_range").over(before), F.lit(0))).withColumn("size", F.sum("in_range").over(Window.partitionBy(*groups)))
    own = F.row_number().over(Window.partitionBy("range", *groups).orderBy(*order)) - 1
    return dealt.withColumn("own", own).join(starts.drop("in_range"), ["range", *groups]).withColumn("place", F.col("start") + F.col("own")).drop("range", "own", "start")
