"""The next document in the order of ids, without one task that sorts them all.

Ids are cut into ranges at approximate percentiles; each range is one window.
The first rows of a range are also sent, as guests, to the end of the range
before it, so that the last row there sees its successor.  Where the cuts lie
depends on a sketch, the result does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm._rank import unit_hash

ROWS_PER_RANGE = 2_000
MAX_RANGES = 16_384        # bound of the cuts that each task holds; beyond it ranges grow
NO_ID = -(1 << 63)         # null ids come after all others


def _numbers(values: list[int]) -> Column:
    """A constant array of longs."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def _below(cuts: Column, x: Column, n: int, inclusive: bool) -> Column:
    """How many of the ``n`` sorted ``cuts`` are less than ``x`` (or equal), by bisection."""
    def halve(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        at = F.element_at(cuts, F.least(mid + 1, F.lit(n)))
        right = (acc["lo"] < acc["hi"]) & ((at <= x) if inclusive else (at < x))
        return F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"),
                        F.when(right | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid).alias("hi"))
    steps = F.sequence(F.lit(1), F.lit(n.bit_length() + 1))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi")), halve, lambda acc: acc["lo"])


def in_ranges(docs: DataFrame, id_col: str, text_col: str, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(bucket, pos, guest, id, text, next_text): descending ids, dealt out by range.

    Null text is empty.  Rows of one id stand in the order of a hash of their
    text, so a repeated or null id that fills whole ranges is split by that
    hash; equal rows are interchangeable.  After the last row comes the first
    one again.  ``pos`` numbers the rows of a bucket; ``guest`` rows belong to
    another bucket, stand last and are there to be seen.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    n = docs.count()
    n_ranges = max(1, min(MAX_RANGES, -(-n // rows_per_range)))
    cuts = []
    if n_ranges > 1:
        shares = [i / n_ranges for i in range(1, n_ranges)]
        cuts = sorted(docs.agg(F.percentile_approx(key, shares, 10 * n_ranges)).first()[0])
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), key.alias("key"))
    rows = rows.withColumn("tie", unit_hash("text"))
    if cuts:
        at = _numbers(cuts)
        low, high = _below(at, F.col("key"), len(cuts), False), _below(at, F.col("key"), len(cuts), True)
        rows = rows.withColumns({"low": low, "high": high}).withColumn("bucket", F.when(
            F.col("low") == F.col("high"), F.col("low")).otherwise(
            F.col("low") + F.floor(F.col("tie") * (F.col("high") - F.col("low") + 1)).cast("int"))).drop("low", "high")
    else:
        rows = rows.withColumn("bucket", F.lit(0))
    # at most MAX_RANGES numbers
    tops = {r["bucket"]: r["key"] for r in rows.groupBy("bucket").agg(F.max("key").alias("key")).collect()}
    order = sorted(tops)
    before = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}   # the range that ends where b begins
    top = F.element_at(_numbers([tops.get(b, 0) for b in range(n_ranges)]), F.col("bucket") + 1)
    goes_to = F.element_at(_numbers([before.get(b, 0) for b in range(n_ranges)]), F.col("bucket") + 1).cast("int")
    own = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    seen = F.struct(goes_to.alias("bucket"), F.lit(True).alias("guest"))
    rows = rows.withColumn("place", F.explode(F.when(F.col("key") == top, F.array(own, seen)).otherwise(F.array(own))))
    rows = rows.select("place.bucket", "place.guest", "id", "text", "key", "tie")
    order_by = Window.partitionBy("bucket").orderBy("guest", F.desc("key"), F.desc("tie"), F.desc("text"))
    return rows.select("bucket", F.row_number().over(order_by).alias("pos"), "guest", "id", "text",
                       F.lead("text").over(order_by).alias("next_text"))
