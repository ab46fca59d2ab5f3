"""Small helpers for key handling shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_list(keys) -> list[str]:
    if keys is None:
        return []
    if isinstance(keys, str):
        return [keys]
    return list(keys)


def join_on_keys(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` that treats NULL keys as equal (``<=>``), keeping
    one copy of each key column.  With no keys both sides are one group."""
    keys = as_list(keys)
    if not keys:
        # one global group: the right side is a single aggregate row, so it is
        # broadcast (size bounded by construction) and attached on a constant key
        r1 = F.broadcast(right.withColumn("__all", F.lit(0)))
        out = left.withColumn("__all", F.lit(0)).join(r1, "__all", how)
        return out.drop("__all")
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys])
    out = left.join(r, cond, how)
    if how in ("left_semi", "left_anti"):
        return out
    if how in ("right", "right_outer"):
        for k in keys:
            out = out.withColumn(k, F.col(f"__r_{k}"))
    elif how in ("full", "outer", "full_outer"):
        for k in keys:
            out = out.withColumn(k, F.coalesce(left[k], F.col(f"__r_{k}")))
    return out.drop(*[f"__r_{k}" for k in keys])
