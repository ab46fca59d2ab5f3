"""How filters interact: what each removes, in every order of applying them.

Texts fail filters or not, whatever the order: a mask.  Rows are counted by
part and mask (32 masks for five filters), so what follows is small.  Per part
the mask matrix (0 where a mask fails a filter, infinite elsewhere) is
combined with the inverse-permutation matrix (the position of each filter in
each order) by a min-plus product: the least position of a failed filter is
the step that removes the mask in this order.  Weighted scatter counts over
these steps give what each step removes and what earlier steps took from it.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
NEVER = 1 << 20           # beyond every position
SALTS = 1_024
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def orders(filters: str = FILTERS) -> list[str]:
    return ["".join(p) for p in itertools.permutations(filters)]


def removal_steps(fails: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Min-plus product: ``fails`` (masks x filters, boolean), ``position`` (filters x
    orders, from 0).  Result (masks x orders): the step that removes, NEVER if none."""
    cost = np.where(fails, 0, NEVER)
    return (cost[:, :, None] + position[None, :, :]).min(1)


def audit_counts(mask: np.ndarray, weights: dict[str, np.ndarray], filters: str = FILTERS) -> pd.DataFrame:
    """One row per order and step.  ``mask``: bit f is set where filter f fails;
    ``weights``: n (rows), good, toxic of each mask."""
    names = orders(filters)
    k, m = len(filters), len(names)
    at = np.array([[filters.index(c) for c in o] for o in names])         # orders x steps: the filter
    position = np.argsort(at, axis=1).T                                   # filters x orders: its step
    fails = (mask[:, None] >> np.arange(k)) & 1 == 1
    step = removal_steps(fails, position)
    gone = step < NEVER

    def scatter(weight):
        out = np.zeros((m, k + 1), np.int64)
        where = np.where(gone, step, k)
        np.add.at(out, (np.broadcast_to(np.arange(m), where.shape), where), weight[:, None])
        return out[:, :k]

    n = weights["n"]
    removed = scatter(n)
    fail_count = (fails * n[:, None]).sum(0)
    alone = (fails * (n * (fails.sum(1) == 1))[:, None]).sum(0)
    # the position of a filter is its step: what it removes is counted there
    shapley = np.array([removed[np.arange(m), position[f]].sum() for f in range(k)])
    return pd.DataFrame({
        "filter_order": np.repeat(names, k), "step": np.tile(np.arange(1, k + 1, dtype=np.int32), m),
        "kept": (n.sum() - removed.cumsum(1)).ravel(), "removed": removed.ravel(),
        "redundant": (fail_count[at] - removed).ravel(), "unique_fails": alone[at].ravel(),
        "good_lost": scatter(weights["good"]).ravel(), "toxic_lost": scatter(weights["toxic"]).ravel(),
        "shapley": shapley[at].ravel()})


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, counts) from ``masks`` (part, mask, good, toxic; one row a document).

    Rows are counted by part and mask before they meet; a task gets at most
    2^filters rows of a part.  No rows, no parts.
    """
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"),
                                               F.sum(F.col("toxic").cast("long")).alias("toxic"))

    def one_part(frame: pd.DataFrame) -> pd.DataFrame:
        out = audit_counts(frame["mask"].to_numpy(), {c: frame[c].to_numpy() for c in ("n", "good", "toxic")}, filters)
        out.insert(0, "part", frame["part"].iloc[0])
        return out

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return counts.groupBy("part").applyInPandas(one_part, schema)


def text_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic) for each row of ``docs``.

    Failures: A under 100 words, B fewer than 80 % of the words distinct, C
    more than 10 % capitals A-Z, D any of ``#$%&*|``, E the text of a row with
    a smaller id.  Null text is empty, a null part "".  A null id is larger
    than all others and has no labels; rows that share the smallest id of
    their text are no copies of each other.  Several labels of one id count
    if any is 1; labels without a document count nothing.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    thin = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       text.alias("text"))
    thin = thin.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    n_words, n_distinct = F.size("words"), F.size(F.array_distinct("words"))
    failed = [n_words < 100, n_distinct.cast("long") * 100 < n_words.cast("long") * 80,
              F.regexp_count("text", F.lit("[A-Z]")).cast("long") * 100 > F.length("text").cast("long") * 10,
              F.col("text").rlike("[#$%&*|]")]
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(failed)), F.lit(0))
    # rows without an id are dealt out by a salt of their own: they meet nothing by it
    salt = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("text"), F.lit(SALTS)) + 1).otherwise(F.lit(0))
    thin = thin.select("part", bits.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"),
                       F.coalesce("id", F.lit(0)).alias("id"), salt.alias("salt"))
    # the first row of each text: copies are counted away before the shuffle
    lowest = (thin.groupBy("digest").agg(F.min(F.when(F.col("salt") == 0, F.col("id"))).alias("low"))
              .select("digest", F.coalesce("low", F.lit(0)).alias("id"), F.col("low").isNull().alias("no_id"),
                      F.lit(True).alias("is_first")))
    met = thin.withColumn("no_id", F.col("salt") > 0).join(lowest, ["digest", "id", "no_id"], "left")
    marks = (labels.select(F.col(id_col).cast("long").alias("id"), "quality", "toxic").filter(F.col("id").isNotNull())
             .groupBy("id").agg(F.max((F.coalesce("quality", F.lit(0)) == 1).cast("int")).alias("good"),
                                F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("int")).alias("toxic"))
             .withColumn("salt", F.lit(0).cast("long")))
    out = met.withColumn("mask", F.col("mask") + F.when(F.col("is_first"), F.lit(0)).otherwise(F.lit(16)))
    return out.withColumn("salt", F.col("salt").cast("long")).join(marks, ["id", "salt"], "left").select(
        "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
