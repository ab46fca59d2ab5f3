"""Data-quality checks (V1-V10) and column profiling.

Every check returns violation rows: an empty result means the check passed.
Checks read metadata where that is enough and otherwise run one aggregation
with map-side combine; none collects data to the driver.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, LongType, StringType, StructField, StructType

from evalframe.operators._keys import as_list, join_on_keys


# --- V1 ---------------------------------------------------------------------

def check_shape(df: DataFrame, name: str, expected_rows: int | None = None,
                expected_features: int | None = None, exclude=()) -> DataFrame:
    """V1: row count and feature count against the expected registry values.
    Returns (dataset, check, expected, actual) for each mismatch."""
    spark = df.sparkSession
    n_feat = len([c for c in df.columns if c not in set(as_list(exclude))])
    actual = df.agg(F.count(F.lit(1)).alias("rows"))
    checks = []
    if expected_rows is not None:
        checks.append(F.struct(F.lit("rows").alias("check"), F.lit(expected_rows).cast("long").alias("expected"),
                               F.col("rows").cast("long").alias("actual")))
    if expected_features is not None:
        checks.append(F.struct(F.lit("features").alias("check"),
                               F.lit(expected_features).cast("long").alias("expected"),
                               F.lit(n_feat).cast("long").alias("actual")))
    if not checks:
        schema = "dataset string, check string, expected bigint, actual bigint"
        return spark.createDataFrame([], schema)
    out = actual.select(F.explode(F.array(*checks)).alias("c")).select(
        F.lit(name).alias("dataset"), "c.*")
    return out.where(F.col("expected") != F.col("actual"))


def check_row_match(features: DataFrame, target: DataFrame, name: str) -> DataFrame:
    """V1: feature and target tables must have the same number of rows."""
    a = features.agg(F.count(F.lit(1)).alias("n"))
    b = target.agg(F.count(F.lit(1)).alias("m"))
    j = join_on_keys(a, b, [])
    return j.where(F.col("n") != F.col("m")).select(
        F.lit(name).alias("dataset"), F.lit("feature_target_rows").alias("check"),
        F.col("n").cast("long").alias("expected"), F.col("m").cast("long").alias("actual"))


# --- V2 ---------------------------------------------------------------------

def check_domain(df: DataFrame, col: str, allowed) -> DataFrame:
    """V2: values of ``col`` outside ``allowed`` with their counts; NULL is
    always a violation."""
    spark = df.sparkSession
    counts = df.groupBy(F.col(col).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ok = spark.createDataFrame([(str(v),) for v in allowed], "value string")
    return counts.join(F.broadcast(ok), "value", "left_anti")  # allowed list is a parameter


# --- V3 ---------------------------------------------------------------------

def check_columns(df: DataFrame, required) -> list[str]:
    """V3: required columns that are missing (schema only, no job)."""
    have = set(df.columns)
    return sorted(c for c in required if c not in have)


# --- V4 ---------------------------------------------------------------------

def check_dimension(df: DataFrame, col: str, expected) -> DataFrame:
    """V4: found values must equal expected values.  Returns (value, problem)
    with problem 'missing' (expected, not found) or 'unexpected'."""
    spark = df.sparkSession
    found = df.select(F.col(col).cast("string").alias("value")).distinct().withColumn("_f", F.lit(True))
    exp = spark.createDataFrame([(str(v),) for v in expected], "value string").withColumn("_e", F.lit(True))
    j = join_on_keys(found, exp, ["value"], "full")
    return j.where(F.col("_f").isNull() | F.col("_e").isNull()).select(
        "value", F.when(F.col("_f").isNull(), "missing").otherwise("unexpected").alias("problem"))


# --- V5 ---------------------------------------------------------------------

def find_duplicates(df: DataFrame, keys) -> DataFrame:
    """V5: every row whose key occurs more than once (all copies), with the
    number of copies.  Aggregate-then-join: partial aggregation absorbs hot
    keys and AQE splits a skewed join partition."""
    keys = as_list(keys)
    dup = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("dup_count"))
             .where(F.col("dup_count") > 1))
    return join_on_keys(df, dup, keys)


# --- V6 ---------------------------------------------------------------------

def check_grid(df: DataFrame, dims: dict, study_keys=()) -> DataFrame:
    """V6: every combination of the expected dimension values must occur
    exactly once per study.  Returns (study keys, dims, n, problem) with
    problem 'missing' (n = 0), 'duplicate' (n > 1) or 'unexpected' (a cell
    outside the expected grid).

    The expected grid is a parameter (product of the given value lists); it
    is generated per study with ``explode`` of a literal array, so no join
    fans out rows."""
    study_keys = as_list(study_keys)
    names = list(dims)
    counts = df.groupBy(*study_keys, *names).agg(F.count(F.lit(1)).alias("n"))
    cells = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, combo)])
             for combo in itertools.product(*[dims[n] for n in names])]
    studies = df.select(*study_keys).distinct() if study_keys else df.sparkSession.range(1).select()
    grid = (studies.select(*study_keys, F.explode(F.array(*cells)).alias("cell"))
            .select(*study_keys, "cell.*").withColumn("_g", F.lit(True)))
    found = counts.select(*study_keys, *[F.col(n).cast(grid.schema[n].dataType).alias(n) for n in names], "n")
    j = join_on_keys(grid, found, study_keys + names, "full")
    j = j.withColumn("n", F.coalesce(F.col("n"), F.lit(0)).cast("long"))
    problem = (F.when(F.col("_g").isNull(), "unexpected").when(F.col("n") == 0, "missing")
               .when(F.col("n") > 1, "duplicate"))
    return j.withColumn("problem", problem).where(F.col("problem").isNotNull()).select(
        *study_keys, *names, "n", "problem")


def distinct_groups(df: DataFrame, keys) -> DataFrame:
    """Number of distinct experiment groups."""
    return df.select(*as_list(keys)).distinct().agg(F.count(F.lit(1)).alias("n_groups"))


# --- V9 ---------------------------------------------------------------------

def null_audit(df: DataFrame, cols=None) -> DataFrame:
    """V9: NULL (and NaN for floating columns) count per column, one scan."""
    cols = as_list(cols) or df.columns
    exprs = []
    for c in cols:
        t = df.schema[c].dataType
        miss = F.col(c).isNull()
        if isinstance(t, (DoubleType, FloatType)):
            miss = miss | F.isnan(c)
        exprs.append(F.sum(F.when(miss, 1).otherwise(0)).cast("long").alias(c))
    agg = df.agg(*exprs)
    return agg.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in cols])).alias("s")).select("s.*")


# --- V10 --------------------------------------------------------------------

def coverage(plan: DataFrame, results: DataFrame, keys, result_keys=None) -> DataFrame:
    """Planned vs completed experiments: (planned, completed, missing)."""
    keys = as_list(keys)
    rk = as_list(result_keys) or keys
    done = results.select(*[F.col(a).alias(b) for a, b in zip(rk, keys)]).distinct().withColumn("_done", F.lit(1))
    p = plan.select(*keys).distinct()
    j = join_on_keys(p, done, keys, "left")
    return j.agg(F.count(F.lit(1)).cast("long").alias("planned"),
                 F.count("_done").cast("long").alias("completed"),
                 F.count_if(F.col("_done").isNull()).cast("long").alias("missing"))


# --- G6 ---------------------------------------------------------------------

def profile_categoricals(df: DataFrame, cols, k: int = 20, salt_buckets: int = 64) -> DataFrame:
    """Top-k most frequent values per column (NULL included as a value),
    ties broken by value (NULL last).

    Exact two-stage top-k: rank inside (column, hash(value) % salt) first,
    keep k per bucket, then rank the <= salt*k survivors per column.  A
    column with billions of distinct values never sorts them in one task."""
    cols = as_list(cols)
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols]))
        .alias("s")).select("s.*")
    counts = stacked.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("n").desc(), F.col("value").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("value"), F.lit(salt_buckets))
    w1 = Window.partitionBy("column_name", salt).orderBy(*order)
    cand = counts.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= k).drop("_r")
    w2 = Window.partitionBy("column_name").orderBy(*order)
    return cand.withColumn("rank", F.row_number().over(w2).cast("int")).where(F.col("rank") <= k)


# --- G7 ---------------------------------------------------------------------

def describe_columns(df: DataFrame) -> DataFrame:
    """(position, column_name, data_type, role) from the schema alone."""
    from evalframe.operators.prep import feature_roles
    roles = feature_roles(df.schema)
    rows = [(i, f.name, f.dataType.simpleString(), roles.get(f.name, "dropped"))
            for i, f in enumerate(df.schema.fields)]
    schema = StructType([StructField("position", LongType()), StructField("column_name", StringType()),
                         StructField("data_type", StringType()), StructField("role", StringType())])
    return df.sparkSession.createDataFrame(rows, schema)

