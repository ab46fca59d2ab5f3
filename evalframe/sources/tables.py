"""Access to the driver's parquet tables (one file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazily scan ``{sf_dir}/{name}.parquet``; Catalyst prunes and pushes down."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
