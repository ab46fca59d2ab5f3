"""Skew-tolerant running sums and ranks.

``Window.partitionBy(run).orderBy(x)`` sends a whole run to one task.  When a
run holds a third of all rows that task becomes the job.  The helpers here
split the ordered domain into monotone buckets:

1. the caller has already aggregated rows to distinct ``(keys, order value)``;
2. per ``(keys, bucket)`` totals are computed (tiny);
3. a window over ``keys`` on the totals gives each bucket its offset;
4. the offsets are joined back and a window on ``(keys, bucket)`` finishes
   the running sum inside each bucket.

Where the order is a number, ``ranked_sums`` cuts it at quantiles of the data
(a sketch), so buckets are even whatever range the values lie in.

The result is exact: it equals the plain window (see tests).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.operators._keys import as_list, join_on_keys

CUTS = 256             # the order is cut into so many ranges at most
CUT_ACCURACY = 10      # sketch samples per range


def below(cuts: Column, x: Column) -> Column:
    """How many entries of the sorted array ``cuts`` (fewer than CUTS) are less than ``x``."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range((CUTS - 1).bit_length()))])
    # the largest position whose entry is still less, found bit by bit; beyond the end is null
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.try_element_at(cuts, at + step) < x, at + step).otherwise(at))


def range_cuts(df: DataFrame, order: str, size: Column | None = None, out: str = "__cuts") -> DataFrame:
    """One row: about sqrt(n) - 1 quantiles (at most CUTS - 1) of the non-null values of ``order``;
    n is ``size``, an aggregate (the number of values if it is not given).

    Taken over all groups at once: quantiles are weighed by rows, so a range
    holds about n / CUTS rows at most, however the rows of it are grouped and
    however narrow a group's values are."""
    probs = [i / CUTS for i in range(1, CUTS)]
    value = F.col(order).cast("double")
    g = df.agg((F.count(order) if size is None else size).alias("__rows"),
               F.percentile_approx(value, probs, CUTS * CUT_ACCURACY).alias("__quantiles"))
    ranges = F.least(F.ceil(F.sqrt("__rows")), F.lit(CUTS)).cast("int")
    at = F.transform(F.sequence(F.lit(1), F.greatest(ranges - 1, F.lit(1))), lambda i: F.floor(i * CUTS / ranges).cast("int"))
    return g.select(F.when(ranges > 1, F.transform(at, lambda i: F.element_at("__quantiles", i))).alias(out))


def ranked_sums(df: DataFrame, keys, order: str, value_cols, suffix: str = "_below", cuts: DataFrame | None = None) -> DataFrame:
    """``prefix_sums`` over a numeric ``order`` column, split at quantiles of the data.

    One way at every size.  ``order`` is unique within ``keys``; a null order
    comes first.  ``cuts`` (of ``range_cuts``) may come from the table that
    ``df`` was made of, where that saves computing ``df`` once more.
    """
    keys = as_list(keys)
    one_row = range_cuts(df, order) if cuts is None else cuts
    j = df.withColumn("__cuts", one_row.scalar())
    bucket = F.when(F.col(order).isNotNull(), F.coalesce(below(F.col("__cuts"), F.col(order).cast("double")), F.lit(0)) + 1
                    ).otherwise(F.lit(0))
    placed = j.withColumn("__range", bucket).drop("__cuts")
    return prefix_sums(placed, keys, order, value_cols, F.col("__range"), suffix).drop("__range")


def hex_prefix_bucket(c: Column | str, digits: int = 3) -> Column:
    """Monotone bucket of a lower-case hex string (e.g. an md5): its first digits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.conv(F.substring(c, 1, digits), 16, 10).cast("long")


def prefix_sums(df: DataFrame, keys, order_cols, value_cols, bucket: Column | None,
                suffix: str = "_below") -> DataFrame:
    """Add ``<v><suffix>`` = sum of ``v`` over earlier rows of the same keys.

    ``order_cols`` must make rows unique within ``keys`` and ``bucket`` must be
    non-decreasing in that order.  ``bucket=None`` uses one window per key
    group (the plain, non-split form; used to test equivalence).
    """
    keys = as_list(keys)
    order_cols = as_list(order_cols)
    value_cols = as_list(value_cols)
    before = Window.unboundedPreceding
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order_cols).rowsBetween(before, -1)
        return df.select("*", *[F.coalesce(F.sum(v).over(w), F.lit(0)).alias(v + suffix)
                                for v in value_cols])
    b = df.withColumn("__bucket", bucket)
    totals = b.groupBy(*keys, "__bucket").agg(*[F.sum(v).alias(f"__t_{v}") for v in value_cols])
    wb = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(before, -1)
    offsets = totals.select(*keys, "__bucket",
                            *[F.coalesce(F.sum(f"__t_{v}").over(wb), F.lit(0)).alias(f"__o_{v}")
                              for v in value_cols])
    j = join_on_keys(b, offsets, keys + ["__bucket"])
    wi = Window.partitionBy(*keys, "__bucket").orderBy(*order_cols).rowsBetween(before, -1)
    out = j.select(*df.columns,
                   *[(F.col(f"__o_{v}") + F.coalesce(F.sum(v).over(wi), F.lit(0))).alias(v + suffix)
                     for v in value_cols])
    return out


def running_max(df: DataFrame, keys, order_cols, value: str, out: str, bucket: Column | None) -> DataFrame:
    """Add ``out`` = max of ``value`` over rows of the same keys up to and
    including the current row (``value`` may be a struct: max by its fields
    in order).  Same bucketed scheme as ``prefix_sums``: exact, and a hot key
    is spread over its buckets."""
    keys = as_list(keys)
    order_cols = as_list(order_cols)
    upto = Window.currentRow
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, upto)
        return df.withColumn(out, F.max(value).over(w))
    b = df.withColumn("__bucket", bucket)
    totals = b.groupBy(*keys, "__bucket").agg(F.max(value).alias("__t"))
    wb = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "__bucket", F.max("__t").over(wb).alias("__o"))
    j = join_on_keys(b, offsets, keys + ["__bucket"])
    wi = Window.partitionBy(*keys, "__bucket").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, upto)
    within = F.max(value).over(wi)
    best = F.when(F.col("__o").isNull(), within).when(within.isNull(), F.col("__o")) \
            .otherwise(F.greatest(F.col("__o"), within))
    return j.select(*df.columns, best.alias(out))
