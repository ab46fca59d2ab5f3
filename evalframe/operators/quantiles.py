"""Exact quantiles and modes without holding a group in one task.

Spark's exact ``percentile``/``median`` and ``mode`` aggregates keep a
value -> count map of the whole group in one buffer.  Here a quantile is
selected in two passes over the input, the same way at every size:

1. a sketch (``percentile_approx``) gives each group brackets of falling width
   around each wanted rank; the narrowest that is still wider than the
   sketch's error and two positions is taken (a small group's is everything);
2. one aggregate counts the rows below the bracket as one and those inside it
   by value, so only a bracket's distinct values are shuffled.

The distinct values of a bracket (at most about 30, or 4 / ACCURACY of the
group's) are then ranked in a window that sorts and spills, and the two
neighbours of the wanted position are interpolated linearly, as NumPy and
pandas do.  The input is neither cached nor checkpointed.

The mode is a distributed ``groupBy(keys, value).count()`` followed by a hash
aggregate ``min_by`` that keeps the most frequent, smallest value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.functions.columns import nan_to_null
from evalframe.operators._keys import as_list, join_on_keys

ACCURACY = 10_000      # the sketch's rank error is at most n / ACCURACY
WIDEN = 4.0            # ratio of the widths of two brackets


def _widths(accuracy: int) -> list[float]:
    """Half widths of the brackets, from twice the sketch's error up."""
    first = 2.0 / accuracy
    return [first * WIDEN ** j for j in range(max(1, math.ceil(math.log(1.0 / first, WIDEN))))]


def _bracket(q: Column, n: Column, probs: list[float], k: int, accuracy: int) -> tuple[Column, Column]:
    """(lower, upper) bound of the ``k``-th wanted value, infinite where the bracket ends beyond
    the group.  ``q`` holds, for each probability and width, the two ends."""
    widths = _widths(accuracy)
    low, high = F.lit(-math.inf), F.lit(math.inf)
    for j in reversed(range(len(widths))):
        fits = n * (widths[j] - 1.0 / accuracy) >= 2        # two positions of margin beyond the error
        at = 2 * (k * len(widths) + j)
        lo = q[at] if probs[k] - widths[j] > 0 else F.lit(-math.inf)
        hi = q[at + 1] if probs[k] + widths[j] < 1 else F.lit(math.inf)
        low, high = F.when(fits, lo).otherwise(low), F.when(fits, hi).otherwise(high)
    return low, high


def exact_quantiles(df: DataFrame, keys, value: str, probs, names=None, accuracy: int = ACCURACY,
                    carry=(), deal_by=None) -> DataFrame:
    """One row per group: ``keys``, the aggregates ``carry`` (taken in the first pass, over all
    rows of the group) and one column per probability (linear interpolation between the order
    statistics at floor/ceil of (n-1)p).  NULL and NaN values are ignored; a group without
    values gets NULLs.  ``deal_by``: some of the keys, by which the caller aggregates next."""
    keys = as_list(keys)
    probs = [float(p) for p in probs]
    names = list(names) if names else [f"q{int(round(p * 100))}" for p in probs]
    carry = list(carry)
    v = nan_to_null(F.col(value).cast("double"))
    ends = [min(1.0, max(0.0, p + side * w)) for p in probs for w in _widths(accuracy) for side in (-1, 1)]
    stats = df.groupBy(*keys).agg(*carry, F.count(v).alias("__n"), F.percentile_approx(v, ends, accuracy).alias("__q"))
    carried = [c for c in stats.columns if c not in (*keys, "__n", "__q")]
    bounds = [_bracket(F.col("__q"), F.col("__n"), probs, k, accuracy) for k in range(len(probs))]
    # what is known of a group travels with its few bracket rows, so that it is computed once
    known = stats.select(*keys, *carried, "__n", *[b.alias(f"__{side}{k}") for k, pair in enumerate(bounds)
                                                   for side, b in zip(("lo", "hi"), pair)])
    j = join_on_keys(df.select(*keys, v.alias("__v")), known, keys)
    nothing = F.lit(None).cast("double")
    place = lambda k, x: F.struct(F.lit(k).alias("k"), x.alias("v"))
    # below the bracket: counted without its value; above it: not needed; a group without values stays
    places = F.array(*[F.when((F.col("__v") < F.col(f"__lo{k}")) | ((F.col("__n") == 0) & (k == 0)), place(k, nothing))
                       .when(F.col("__v") <= F.col(f"__hi{k}"), place(k, F.col("__v"))) for k in range(len(probs))])
    of_group = [*keys, *carried, "__n"]
    met = (j.select(*of_group, F.explode(F.filter(places, lambda x: x.isNotNull())).alias("__p"))
            .groupBy(*of_group, F.col("__p.k").alias("__k"), F.col("__p.v").alias("__v")).agg(F.count(F.lit(1)).alias("__c")))
    # dealt by group once: the window and both aggregates below need no exchange of their own
    deal_by = keys if deal_by is None else as_list(deal_by)
    met = met.repartition(*deal_by) if deal_by else met.repartition(1)
    earlier = Window.partitionBy(*keys, "__k").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("__c").over(earlier), F.lit(0))
    position = (F.col("__n") - 1) * F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("__k") + 1)
    ranked = met.select(*of_group, "__k", "__v", first.alias("__first"), (first + F.col("__c") - 1).alias("__last"),
                        F.floor(position).alias("__at"), F.ceil(position).alias("__next"), (position - F.floor(position)).alias("__frac"))
    own = lambda at: F.when(F.col("__v").isNotNull() & (F.col("__first") <= F.col(at)) & (F.col(at) <= F.col("__last")), F.col("__v"))
    picked = ranked.groupBy(*of_group, "__k").agg(F.max(own("__at")).alias("__vlo"), F.max(own("__next")).alias("__vhi"),
                                                  F.max("__frac").alias("__frac"))
    q = F.when(F.col("__frac") == 0, F.col("__vlo")).otherwise(
        F.col("__vlo") + (F.col("__vhi") - F.col("__vlo")) * F.col("__frac"))
    missed = (F.col("__n") > 0) & (F.col("__vlo").isNull() | F.col("__vhi").isNull())
    q = F.when(missed, F.raise_error(F.lit("quantile bracket missed the wanted rank")).cast("double")).otherwise(q)
    return picked.groupBy(*of_group).agg(*[F.max(F.when(F.col("__k") == k, q)).alias(n) for k, n in enumerate(names)]
                                         ).select(*keys, *carried, *names)


def mode(df: DataFrame, keys, value: str, out: str = "mode") -> DataFrame:
    """Most frequent non-null value per group, smallest on ties; NULL for a group without values."""
    keys = as_list(keys)
    c = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    seen = F.col(value).isNotNull()
    best = F.min_by(F.when(seen, F.col(value)), F.when(seen, F.struct((-F.col("__c")).alias("neg"), F.col(value).alias("v"))))
    return c.groupBy(*keys).agg(best.alias(out))


def wide_quantiles(df: DataFrame, keys, cols, probs, names, carry=()) -> DataFrame:
    """``exact_quantiles`` of several columns at once: the columns are unpivoted (column name as
    one more key) and pivoted back to ``names[i].format(col=c)`` columns, one row per group.

    ``carry``: (name with ``{col}``, function of a column) pairs, aggregates of each column taken
    in the same pass."""
    keys = as_list(keys)
    cols = list(cols)
    long = df.select(*keys, *[nan_to_null(F.col(c).cast("double")).alias(c) for c in cols]).unpivot(keys, cols, "__col", "__val")
    q = exact_quantiles(long, keys + ["__col"], "__val", probs, names=[f"__q{i}" for i in range(len(probs))],
                        deal_by=keys, carry=[f(F.col("__val")).alias(f"__a{i}") for i, (_, f) in enumerate(carry)])
    own = lambda c, x: F.max(F.when(F.col("__col") == c, F.col(x)))
    return q.groupBy(*keys).agg(*[own(c, f"__q{i}").alias(n.format(col=c)) for c in cols for i, n in enumerate(names)],
                                *[own(c, f"__a{i}").alias(n.format(col=c)) for c in cols for i, (n, _) in enumerate(carry)])
