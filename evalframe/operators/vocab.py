"""Dense positions of ordered values, for value sets of any size.

Nothing is collected and no task sorts a whole column: distinct values are
range-partitioned in their order, counted by partition, and a partition's
offset plus the place inside it is the position.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalframe.operators._keys import as_list, join_on_keys
from evalframe.session import cut_lineage


def dense_positions(df: DataFrame, keys, order_cols, out: str = "position") -> DataFrame:
    """``df`` with ``out``: 0-based position of each row within ``keys`` in the order of
    ``order_cols`` (which make rows unique within ``keys``; nulls first).

    The ranges are cut by Spark's own sample of the data, so a group that holds
    most rows is spread over partitions; where the cuts lie does not change the
    positions.  The dealt rows are written once (checkpoint): a partition number
    must not move between the count and its use.
    """
    keys, order_cols = as_list(keys), as_list(order_cols)
    dealt = cut_lineage(df.repartitionByRange(*keys, *order_cols).withColumn("__part", F.spark_partition_id()))
    # one row for each group in each partition
    counts = dealt.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*keys or [F.lit(0)]).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    within = Window.partitionBy(*keys, "__part").orderBy(*order_cols)
    placed = dealt.withColumn("__place", F.row_number().over(within))
    return join_on_keys(placed, starts, [*keys, "__part"]).withColumn(
        out, (F.col("__start") + F.col("__place") - 1).cast("long")).drop("__part", "__start", "__place")


def value_index(df: DataFrame, columns) -> DataFrame:
    """(column, value, position): the distinct non-null text values of each column, in order from 0."""
    columns = as_list(columns)
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    distinct = long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return dense_positions(distinct.drop("n"), ["column"], ["value"])


def with_positions(df: DataFrame, index: DataFrame, columns, prefix: str) -> DataFrame:
    """``df`` with ``{prefix}{c}``: the position of each column's value in ``index`` (null if it is not there)."""
    for c in as_list(columns):
        side = index.where(F.col("column") == c).select(F.col("value").alias("__value"),
                                                        F.col("position").alias(f"{prefix}{c}"))
        df = df.join(side, F.col(c).cast("string") == F.col("__value"), "left").drop("__value")
    return df
