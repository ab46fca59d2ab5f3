"""From raw documents to sharded training data, in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written as Parquet and read again as the next one's ``docs``.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm import decontam, language, mixing, near_dedup, sharding
from evalframe.llm._store import settled
from evalframe.sources.tables import read_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter, and those long enough to tell that no
    language explains them better than letters at random."""
    parser = language.fit(docs.filter(F.col("doc_id").isNotNull() & ~language.held_out("doc_id")))
    scored = language.predict(docs, parser, foreign="_foreign")
    return scored.filter((F.col("lang_pred") != language.UNKNOWN) & ~F.col("_foreign")).select(*docs.columns)


def near_dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, 0.8)."""
    return near_dedup.drop_near_duplicates(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark window."""
    found = decontam.find_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return found.filter(F.size("hit_words") == 0).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or cut the sources to their target weights."""
    return mixing.materialise(mixing.mix(mixing.sizes_of(docs))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Balanced shards, repeats of a text together."""
    return sharding.shard_documents(docs)


STAGES = [("language", identify_language), ("near_dedup", near_dedup_documents), ("decontaminate", drop_contaminated),
          ("mix", mix_sources), ("shard", shard)]

# language ID and near-duplicate components are not SQL; tests compare with brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        made = functools.partial(stage, spark, docs, sf_dir)
        docs = settled(spark, made, f"pipeline-{name}") if k < len(STAGES) - 1 else made()
    return docs
