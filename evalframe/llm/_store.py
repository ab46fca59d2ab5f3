"""Intermediate tables in the shared scratch folder of the session."""

from __future__ import annotations

import uuid
from contextlib import contextmanager, nullcontext
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.session import ensure_checkpoint_dir


_steps: list[list[str]] = []     # paths stored inside each open ``settled`` call


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage: an executor lost later costs a reread, not a recompute,
    and expressions such as row ids are fixed from here on.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with swept_shuffles(spark):
        df.write.parquet(path)
    if _steps:
        _steps[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str, rows: int | None = None) -> DataFrame:
    """``stored(make())``; the tables that ``make`` stored on its way are removed then.
    ``rows`` sets the Arrow batch of the last table alone.

    Only for tables that nothing but the result reads: no DataFrame on them
    may be used afterwards.
    """
    _steps.append([])
    try:
        result = make()
    finally:
        done = _steps.pop()
    with small_batches(spark, rows) if rows else nullcontext():
        out = stored(result, name)
    for path in done:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return out


@contextmanager
def swept_shuffles(spark: SparkSession):
    """Jobs of this block remove their shuffle files as soon as they end.

    A table that is written or a number that is fetched needs them no more;
    else they stay until the driver happens to collect its garbage.  For
    actions of one run only: a DataFrame that is made in the block and run
    twice would repeat its map stages.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


BROADCAST_BYTES = 32 << 20     # text that every executor may hold a copy of


def with_texts(pairs: DataFrame, texts: DataFrame, text: str, spread: bool = False) -> DataFrame:
    """``pairs`` (a, b) with the texts of both ends as ``{text}_a``, ``{text}_b``.

    ``texts`` is (id, ``text``), stored.  Its size is measured: a small table
    is broadcast, so that no text travels once for each pair; a bigger one is
    joined by shuffles.  ``spread`` deals broadcast pairs out to all tasks: a
    file of pairs is small for the work that it holds.
    """
    with swept_shuffles(texts.sparkSession):
        size = texts.agg(F.sum(F.octet_length(text))).first()[0] or 0
    side = lambda c: texts.select(F.col("id").alias(c), F.col(text).alias(f"{text}_{c}"))
    a, b = side("a"), side("b")
    if size <= BROADCAST_BYTES:
        a, b = F.broadcast(a), F.broadcast(b)
        if spread:
            pairs = pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pairs.join(a, "a").join(b, "b")


FEW_ROWS = 256                 # pairs of texts in an Arrow batch


@contextmanager
def small_batches(spark: SparkSession, rows: int = FEW_ROWS):
    """Fewer rows in an Arrow batch, for what is computed inside the block:
    pairs of long texts must not meet in one batch by the ten thousand."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)
