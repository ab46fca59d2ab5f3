"""Sources and sinks.

Readers take explicit schemas (no inference on the hot path); writers never
overwrite the path they read from; everything stays a lazy DataFrame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalframe.functions.columns import lower_trim, parse_number
from evalframe.operators._keys import as_list
from evalframe.session import cut_lineage

ROW_ID = "row_id"


# --- S1 ---------------------------------------------------------------------

SPLIT = ("__file", "__start")


def with_position(df: DataFrame, name: str = ROW_ID) -> DataFrame:
    """Dense 0-based position of each row of a file source in file order.

    Files in the order of their paths, splits of a file by their start, rows
    as they stand.  A split is read by one task from its start to its end, so
    a row's place in it is its running id minus the split's least one; the
    splits before it are counted in a table of one row per split.  ``df`` is
    a file scan with column operations at most (no filter, join or shuffle,
    which would lose the file's order).  It is written once (checkpoint), so
    that ids and counts are of the same reading.
    """
    from pyspark.sql import Window
    read = cut_lineage(df.select(*df.columns, F.col("_metadata.file_path").alias("__file"),
                                 F.col("_metadata.file_block_start").alias("__start"),
                                 F.monotonically_increasing_id().alias("__id")))
    splits = read.groupBy(*SPLIT).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy(*SPLIT).rowsBetween(Window.unboundedPreceding, -1)      # one row per split
    starts = splits.select(*SPLIT, (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    return read.join(starts, list(SPLIT)).withColumn(name, F.col("__id") + F.col("__shift")).drop(*SPLIT, "__id", "__shift")


def load_examples(spark: SparkSession, features, target, schema: StructType | None = None,
                  target_schema: StructType | None = None, target_col: str | None = None,
                  key: str | None = None, fmt: str = "csv") -> DataFrame:
    """Features + target -> one table with ``row_id``, features, ``y_true``.

    ``features``/``target`` are DataFrames or paths (both required).  With a
    ``key`` column present on both sides they are joined on it; otherwise both
    must be file scans and their rows are paired by position (a different
    number of rows is an error).  Only the first target column is used unless
    ``target_col`` names one."""
    if features is None or target is None:
        raise ValueError("both features and target are required")

    def _read(x, sch):
        if isinstance(x, DataFrame):
            return x
        r = spark.read.option("header", True)
        r = r.schema(sch) if sch is not None else r.option("inferSchema", True)
        return r.format(fmt).load(x)

    X, y = _read(features, schema), _read(target, target_schema)
    tcol = target_col or [c for c in y.columns if c != key][0]
    if key:
        t = y.select(F.col(key).alias(ROW_ID), F.col(tcol).alias("y_true"))
        return X.withColumnRenamed(key, ROW_ID).join(t, ROW_ID)
    Xp, yp = with_position(X), with_position(y.select(F.col(tcol).alias("y_true")))
    n_x, n_y = (p.agg(F.max(ROW_ID)).first()[0] for p in (Xp, yp))
    if n_x != n_y:
        raise ValueError(f"features and target differ in length: last positions {n_x} and {n_y}")
    return Xp.join(yp, ROW_ID)


# --- S2 / S4 ----------------------------------------------------------------

def write_table(df: DataFrame, path: str, partition_by=None, fmt: str = "parquet",
                mode: str = "overwrite") -> str:
    """Write a table.  Refuses to write over a path the plan reads from."""
    from urllib.parse import urlparse

    def _norm(p: str) -> str:
        return (urlparse(p).path or p).rstrip("/")

    target = _norm(path)
    if any(f == target or f.startswith(target + "/") for f in map(_norm, df.inputFiles())):
        raise ValueError(f"refusing to overwrite {path}: the frame reads from it")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*as_list(partition_by))
    if fmt == "csv":
        w = w.option("header", True)
    w.format(fmt).save(path)
    return path


def write_results(df: DataFrame, path: str, fmt: str = "csv", partition_by=None) -> str:
    """Results sink (CSV, JSON or Parquet); an empty result is an error."""
    if df.isEmpty():
        raise ValueError("no results to write")
    return write_table(df, path, partition_by, fmt)


# --- S5 ---------------------------------------------------------------------

def coerce_results(df: DataFrame, key_cols=("dataset", "model", "optimizer"),
                   numeric_cols=(), fold_col: str | None = "outer_fold") -> DataFrame:
    """Lower-case/trim the key columns, numbers -> double (bad -> NULL),
    fold -> int; a fold that is missing or not an integer fails the job."""
    out = df
    for c in as_list(key_cols):
        if c in df.columns:
            out = out.withColumn(c, lower_trim(c))
    for c in as_list(numeric_cols):
        out = out.withColumn(c, parse_number(c))
    if fold_col:
        v = parse_number(fold_col)
        ok = v.isNotNull() & (v == F.floor(v))
        out = out.withColumn(fold_col, F.when(ok, v.cast("int")).otherwise(
            F.raise_error(F.concat(F.lit(f"{fold_col} is not numeric: "),
                                   F.coalesce(F.col(fold_col).cast("string"), F.lit("NULL")))).cast("int")))
    return out


def read_results(spark: SparkSession, path: str, numeric_cols=(), fold_col="outer_fold",
                 key_cols=("dataset", "model", "optimizer")) -> DataFrame:
    """CSV results with every column read as text, header names stripped
    and lower-cased, then coerced with ``coerce_results``."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    renamed = raw.toDF(*[c.strip().lower() for c in raw.columns])
    return coerce_results(renamed, key_cols, numeric_cols, fold_col)


def check_metrics(df: DataFrame, metric_cols) -> DataFrame:
    """V7: metric columns without a single usable number (one aggregate)."""
    cols = as_list(metric_cols)
    agg = df.agg(*[F.count(parse_number(c)).alias(c) for c in cols])
    stacked = agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("n_usable")) for c in cols])).alias("s"))
    return stacked.select("s.*").where(F.col("n_usable") == 0)


# --- S6 ---------------------------------------------------------------------

def union_results(*dfs: DataFrame) -> DataFrame:
    """Union by column name; columns missing on one side become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


# --- S7 ---------------------------------------------------------------------

def params_to_json(c) -> F.Column:
    """A map or struct of parameters as JSON text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_json(c)


def parse_params(c, names=None, as_double: bool = True):
    """JSON text -> map<string,string>; with ``names``, also one column per
    parameter (numbers written plain or quoted both parse; bad -> NULL)."""
    c = F.col(c) if isinstance(c, str) else c
    m = F.from_json(c, "map<string,string>")
    if not names:
        return m
    out = {}
    for n in names:
        v = m[n]
        out[n] = parse_number(v) if as_double else v
    return m, out


# --- S8 ---------------------------------------------------------------------

def search_documents(trials: DataFrame, keys, iteration: str = "iteration", history: str = "history",
                     trials_per_document: int = 4096) -> DataFrame:
    """S8 writer: one document per run, its trials as an array in the order of ``iteration``.

    ``keys`` + ``part`` + ``history`` (all other columns of a trial).  A run
    with more than ``trials_per_document`` trials is continued in documents
    with ``part`` 1, 2, ..., so that no document and no task holds an
    unbounded run."""
    keys = as_list(keys)
    rest = [iteration] + [c for c in trials.columns if c not in (*keys, iteration)]
    part = F.floor((F.col(iteration) - 1) / trials_per_document).cast("int")
    return (trials.groupBy(*keys, part.alias("part"))
            .agg(F.array_sort(F.collect_list(F.struct(*rest)), lambda a, b: a[iteration] - b[iteration]).alias(history)))


def write_search_documents(documents: DataFrame, path: str) -> str:
    """One JSON object per document and line; null fields are written, so every trial keeps its shape."""
    documents.write.mode("errorifexists").option("ignoreNullFields", False).json(path)
    return path


def read_search_documents(spark: SparkSession, path: str, schema: StructType | None = None,
                          multi_line: bool = True) -> DataFrame:
    """S8 source: one JSON document per file (``multi_line``) or per line; with the writer's
    ``schema`` nothing is inferred and every type comes back."""
    r = spark.read.option("multiLine", multi_line)
    return (r.schema(schema) if schema is not None else r).json(path)


def explode_history(doc: DataFrame, keys=(), history: str = "history") -> DataFrame:
    """One row per trial of a search document's ``history`` array."""
    keys = as_list(keys)
    return doc.select(*keys, F.explode(history).alias("h")).select(*keys, "h.*")
