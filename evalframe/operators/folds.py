"""Stratified k-fold assignment (W1, W2), fold persistence (S3) and fold
selection (J1).

A fold is a deterministic function of (seed, row id): rows of each class are
ordered by ``md5(seed|id)`` and dealt round-robin into k folds, so per-class
fold sizes differ by at most one.  The dense position inside a class is a
bucketed running count (``ranking.prefix_sums``), so one huge class is split
across 4096 hash-prefix buckets instead of one task.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.operators._keys import as_list, join_on_keys
from evalframe.operators.ranking import hex_prefix_bucket, prefix_sums
from evalframe.session import cut_lineage
from evalframe.sources import paths


def fold_hash(id_col: str, seed: int) -> F.Column:
    """Portable ordering key: md5 of 'seed|id' (same hex text in any SQL engine)."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def stratified_folds(df: DataFrame, label: str = "y_true", id_col: str = "row_id", k: int = 5,
                     seed: int = 42, keys=(), out: str = "outer_fold",
                     buckets: int | None = 3) -> DataFrame:
    """(keys, id, label, fold) with fold in 1..k, stratified by label."""
    if k < 2:
        raise ValueError("k must be at least 2")
    keys = as_list(keys)
    base = df.select(*keys, id_col, label).withColumn("_h", fold_hash(id_col, seed)).withColumn("_one", F.lit(1))
    bucket = hex_prefix_bucket("_h", buckets) if buckets else None
    ranked = prefix_sums(base, keys + [label], ["_h", id_col], "_one", bucket)
    return ranked.select(*keys, id_col, label,
                         (F.pmod(F.col("_one_below"), F.lit(k)) + 1).cast("int").alias(out))


def inner_folds(outer: DataFrame, label: str = "y_true", id_col: str = "row_id", k_outer: int = 5,
                k_inner: int = 3, seed: int = 42, keys=(), outer_col: str = "outer_fold",
                out: str = "inner_fold", only: int | None = None) -> DataFrame:
    """For every outer fold f, stratified inner folds over the rows whose
    outer fold is not f.  Output (keys, outer_fold, id, label, inner_fold);
    each row appears k_outer - 1 times (once per outer training set).
    ``only=f`` computes the inner folds of outer fold f alone."""
    keys = as_list(keys)
    chosen = [only] if only is not None else range(1, k_outer + 1)
    folds = F.array(*[F.lit(f) for f in chosen])
    train_of = F.filter(folds, lambda f: f != F.col(outer_col))
    exploded = outer.select(*keys, id_col, label, F.explode(train_of).alias("_of")) \
                    .withColumnRenamed("_of", outer_col)
    return stratified_folds(exploded, label, id_col, k_inner, seed, keys + [outer_col], out)


def fold_split(examples: DataFrame, folds: DataFrame, fold: int, id_col: str = "row_id",
               fold_col: str = "outer_fold", keys=()) -> tuple[DataFrame, DataFrame]:
    """(train, test) rows of one outer fold: equi-join on the row id.

    The joined table is written once (checkpoint): both sides, and the several
    passes of a fit over the training side, read it instead of joining again."""
    keys = as_list(keys)
    f = folds.select(*keys, id_col, fold_col)
    j = cut_lineage(join_on_keys(examples, f, keys + [id_col]))
    return j.where(F.col(fold_col) != fold), j.where(F.col(fold_col) == fold)


SPEC = "_spec"       # beside the data; Spark skips names that start with _


def save_folds(folds: DataFrame, path: str, partition_by=("dataset", "outer_fold"), buckets: int | None = None,
               id_col: str = "row_id") -> str:
    """S3: persist fold assignment as Parquet partitioned by dataset and fold, so a reload of
    one fold reads only its partition.  With ``buckets`` the rows of a partition
    are dealt into that many buckets by ``id_col`` and sorted, so that a join on
    the row id with a table of as many buckets needs no exchange."""
    cols = [c for c in as_list(partition_by) if c in folds.columns]
    return save_rows(folds, path, buckets, id_col, cols)


def save_rows(rows: DataFrame, path: str, buckets: int | None = None, id_col: str = "row_id", partition_by=()) -> str:
    """Write a keyed table (fold assignment or examples), bucketed by its id if ``buckets`` is given."""
    writer = rows.write.mode("errorifexists").format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if not buckets:
        writer.save(path)
        return path
    spark, name = rows.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    # the catalog entry is only how Spark writes buckets: the folder stays when it goes
    writer.bucketBy(buckets, id_col).sortBy(id_col).option("path", path).saveAsTable(name)
    spark.sql(f"drop table {name}")
    spec = json.dumps({"buckets": buckets, "id": id_col, "partition_by": list(partition_by),
                       "columns": [[f.name, f.dataType.simpleString()] for f in rows.schema.fields]})
    spark.createDataFrame([(spec,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/{SPEC}")
    return path


def load_rows(spark: SparkSession, path: str) -> DataFrame:
    """Read what ``save_rows`` wrote; a missing path is an error.  A bucketed table is
    entered into the session's catalog under a name derived from its path, which is
    how Spark learns of the buckets."""
    if not paths.exists(spark, f"{path.rstrip('/')}/{SPEC}"):
        return spark.read.parquet(path)      # raises when the path does not exist
    spec = json.loads(spark.read.text(f"{path.rstrip('/')}/{SPEC}").first()[0])
    name = "bucketed_" + hashlib.md5(path.encode()).hexdigest()
    if not spark.catalog.tableExists(name):
        parts = f"partitioned by ({', '.join(f'`{c}`' for c in spec['partition_by'])}) " if spec["partition_by"] else ""
        spark.sql(f"create table {name} ({', '.join(f'`{c}` {t}' for c, t in spec['columns'])}) using parquet {parts}"
                  f"clustered by (`{spec['id']}`) sorted by (`{spec['id']}`) into {spec['buckets']} buckets location '{path}'")
        if spec["partition_by"]:
            spark.sql(f"alter table {name} recover partitions")
    return spark.table(name)


def load_folds(spark: SparkSession, path: str, dataset: str | None = None,
               fold: int | None = None) -> DataFrame:
    """S3: reload fold assignment; a missing path is an error (folds are
    never regenerated mid-experiment).  Filters prune partitions."""
    df = load_rows(spark, path)
    if dataset is not None:
        df = df.where(F.col("dataset") == dataset)
    if fold is not None:
        df = df.where(F.col("outer_fold") == fold)
    return df
