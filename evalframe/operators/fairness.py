"""Sensitive attribute and fairness configuration.

The configuration is a dimension table with one row per dataset (a few
rows, bounded by the number of configured datasets), so it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIM_SCHEMA = ("dataset string, enabled boolean, sensitive_attribute string, "
              "privileged_group string, unprivileged_group string, positive_label string")

# Status and methodology texts of the fairness reports.
STATUS_CONFIGURED = "Configured (Sensitive Attribute: {attr})"
STATUS_NOT_CONFIGURED = "Not Configured (Sensitive Attribute: None)"
NOTE_CONFIGURED = "Valid fairness metric computed against sensitive attribute '{attr}'."
NOTE_NOT_CONFIGURED = ("Metric value 0.0 reflects lack of sensitive attribute tracking, "
                       "NOT proof of absence of bias.")


def fairness_dim(spark: SparkSession, rows) -> DataFrame:
    """The per-dataset fairness configuration as a small DataFrame.
    ``rows`` are tuples or dicts in ``DIM_SCHEMA`` order."""
    return spark.createDataFrame(list(rows), DIM_SCHEMA)


def split_sensitive(df: DataFrame, column: str | None, out: str = "sensitive") -> DataFrame:
    """Move the sensitive attribute out of the model features into
    ``out`` (kept for auditing).  A configured column that is missing is an
    error; no column configured -> ``out`` is NULL."""
    if column is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    if column not in df.columns:
        raise ValueError(f"sensitive attribute '{column}' not found in columns {df.columns}")
    return df.withColumn(out, F.col(column).cast("string")).drop(column)


def split_sensitive_by_config(df: DataFrame, dim: DataFrame, dataset: str,
                              out: str = "sensitive") -> DataFrame:
    """P7 driven by the configuration row of ``dataset`` (enabled -> its column)."""
    rows = dim.where((F.col("dataset") == dataset) & F.col("enabled")).select("sensitive_attribute").take(2)
    return split_sensitive(df, rows[0][0] if rows else None, out)


def _fmt(template: str, attr: F.Column) -> F.Column:
    head, tail = template.split("{attr}")
    return F.concat(F.lit(head), attr, F.lit(tail))


def flag_fairness(results: DataFrame, dim: DataFrame, dataset_col: str = "dataset") -> DataFrame:
    """Add ``fairness_applicable``, ``fairness_status``, ``methodology_note``
    from the configuration (left join; unknown datasets are not applicable)."""
    d = dim.select(F.col("dataset").alias("_ds"), F.col("enabled").alias("_en"),
                   F.col("sensitive_attribute").alias("_attr"))
    j = results.join(F.broadcast(d), results[dataset_col] == F.col("_ds"), "left")
    app = F.coalesce(F.col("_en"), F.lit(False)) & F.col("_attr").isNotNull()
    return (j.withColumn("fairness_applicable", app)
             .withColumn("fairness_status", F.when(app, _fmt(STATUS_CONFIGURED, F.col("_attr")))
                         .otherwise(F.lit(STATUS_NOT_CONFIGURED)))
             .withColumn("methodology_note", F.when(app, _fmt(NOTE_CONFIGURED, F.col("_attr")))
                         .otherwise(F.lit(NOTE_NOT_CONFIGURED)))
             .drop("_ds", "_en", "_attr"))
