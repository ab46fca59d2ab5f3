"""Mix sources to target weights at an exact budget of words.

Every document gets a hash-random key.  Within a source the documents stand
in the order of their keys; distributed prefix sums of their sizes show where
the source's budget ends.  A budget above the source's size runs through the
whole source first and then starts over (epochs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm._rank import prefix_sums, unit_hash
from evalframe.llm._store import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)   # of the sources in order, repeating
SHARE = 1.5                 # of all words
MAX_EPOCHS = 2.0            # a source gives at most so many times its words


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """``sizes`` (source, source_size; one row each) with ``target`` and ``source_key``.

    Water filling: a source stops at ``max_epochs`` times its size and what it
    can't take is shared again by weight.  With the sources in the order of
    cap / weight, the first so many stop and the others share the rest; the
    level follows from prefix sums over this one-row-a-source table.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("int"))
    s = (sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(max_epochs))
         .withColumn("ratio", F.col("cap") / F.col("weight")))
    rising = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = (s.withColumn("caps_below", F.coalesce(F.sum("cap").over(
            rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
         .withColumn("weight_left", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("level", (F.lit(share) * F.sum("source_size").over(everything) - F.col("caps_below"))
                     / F.col("weight_left"))
         # the level is right at the first source that it doesn't fill up; later ones only get lower
         .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everything)))
    level = F.coalesce("level", F.max("ratio").over(everything))
    return s.select("source", "source_size", F.least(F.col("cap"), level * F.col("weight")).alias("target"),
                    _source_key(F.col("source")).alias("source_key"))


def _source_key(source):
    return F.when(source.isNull(), "null").otherwise(F.concat(F.lit("="), source))


def sizes_of(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def mix(sized: DataFrame, id_col: str = "doc_id", source: str = "source", seed: int = 0, **kw) -> DataFrame:
    """Rows of ``sized`` with ``source_size``, ``target``, ``taken`` and ``before``.

    ``taken`` is how many words of the document the mix takes, repeats
    counted: whole epochs, and in the last one what lies before the cut, so
    that a source's sum is its target rounded down.  ``sized`` has a long
    column ``size`` and is read three times (store it first).  Null sources
    are one source; null ids, size 0 and repeated rows are fine (equal keys
    stand in the order of size, ids that are equal too are interchangeable).
    """
    sized = sized.drop("source_size", "target", "taken", "before")
    per_source = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"),
                                                                 F.count("*").alias("_n"))
    plan = stored(targets(per_source.drop("_n"), **kw), "mix-targets")
    keyed = sized.withColumns({"_source_key": _source_key(F.col(source)),
                               "_key": unit_hash(F.col(id_col).cast("string"), F.lit(seed))})
    plan = plan.select(F.col("source_key").alias("_source_key"), "source_size", "target")
    ordered = prefix_sums(keyed, ["_source_key"], "_key", F.col("size"), "before",
                          n_rows=sized.count(), ties=[id_col, "size"])
    out = ordered.join(plan, "_source_key")
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size")
    last = F.least(F.greatest(rest - F.col("before"), F.lit(0)), F.col("size"))
    return out.withColumn("taken", (epochs * F.col("size") + last).cast("long")).drop("_source_key", "_key")


def materialise(mixed: DataFrame) -> DataFrame:
    """One row for each time the mix takes a document.

    Documents stay whole: the one at the cut goes in when at least half of it
    lies before the cut.  Documents without words take no budget and stay once.
    """
    times = F.when(F.col("size") == 0, 1).otherwise(F.floor((F.col("taken") / F.col("size")) + 0.5)).cast("int")
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), times))).drop("_copy")
