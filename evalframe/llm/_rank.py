"""Distributed prefix sums over hash-random keys.

A window over a whole group would put a hot group into one task.  The key is
a uniform hash, so cutting its range into equal buckets gives buckets of about
equal size; sums of whole buckets are added up first, then the rows of a
bucket among themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 50_000   # rows that one task sorts; the bucket count follows the input


def unit_hash(*cols: Column | str) -> Column:
    """A reproducible pseudo-random double in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") * F.lit(2.0 ** -53)


def prefix_sums(df: DataFrame, groups: list[str], key: str, weight: Column, out: str,
                n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET, ties: list[str] = ()) -> DataFrame:
    """Add ``out``: the sum of ``weight`` over the rows before this one in its
    group, in the order of ``key`` (a double in [0, 1)), then ``ties``.

    ``df`` is read twice (store it first); ``groups`` must not be null.
    """
    n_buckets = max(1, -(-n_rows // rows_per_bucket))
    df = df.withColumn("_bucket", F.floor(F.col(key) * n_buckets)).withColumn("_weight", weight)
    by = [*groups, "_bucket"]
    above = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (df.groupBy(*by).agg(F.sum("_weight").alias("_sum"))
               .withColumn("_offset", F.coalesce(F.sum("_sum").over(above), F.lit(0))).drop("_sum"))
    within = Window.partitionBy(*by).orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (df.join(offsets, by)
            .withColumn(out, F.col("_offset") + F.coalesce(F.sum("_weight").over(within), F.lit(0)))
            .drop("_bucket", "_weight", "_offset"))
