"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalframe.llm import (ann, clustering, decontam, filter_audit, imatch, language, license_scan, line_dedup, mixing,
                           near_dedup, oracles, pii, secret_scan, sharding)
from evalframe.llm._order import in_ranges
from evalframe.llm._spans import joined
from evalframe.llm._store import stored
from evalframe.sources.tables import read_table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document: (doc_id, n_licenses, licenses, best_containment)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = license_scan.scan_licenses(docs)
    return out.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"),
                      F.array_join(F.transform("licenses", lambda x: x["license"]), ",").alias("licenses"),
                      F.array_max(F.transform("licenses", lambda x: x["containment"])).alias("best_containment"))


def _count(spans: str, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and the terms that disclose it, in every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.find_pii(docs)
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*pii.KINDS))
    return out.select("doc_id", *[_count("pii_spans", k) for k in pii.KINDS],
                      F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, through the blob ledger."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out, _ = secret_scan.scan(docs)
    spans = joined(F.col("secret_spans"))
    return out.select("doc_id", *[_count("secret_spans", r.name) for r in secret_scan.RULES],
                      F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"), "blob")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 shards of equally many documents, equal texts together where that is possible."""
    return sharding.shard_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontam.find_contamination(docs, read_table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"),
                      F.size("hit_items").cast("long").alias("n_items"),
                      F.sha2(F.array_join(F.array_sort("hit_items"), ","), 256).alias("items_sha256"),
                      (F.size("hit_words") > 0).alias("contaminated"),
                      F.array_join(F.transform("removal_spans", lambda s: F.concat_ws(
                          ":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("removal_spans"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents on 2-word shingles."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, shingle=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learnt from two thirds of the ids."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = docs.filter(F.col("doc_id").isNotNull() & ~language.held_out("doc_id"))
    out = language.predict(docs.select("doc_id", "text"), language.fit(learn))
    return out.select("doc_id", language.held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th one."""
    return ann.nearest(read_table(spark, sf_dir, "embeddings"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line, exactly or within two edits."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"),
                      F.coalesce(F.array_join(F.transform("removed", lambda r: F.concat_ws(
                          ":", r["line_no"].cast("string"), r["first_doc"].cast("string"), r["first_line"].cast("string"))),
                          ","), F.lit("")).alias("removed"),
                      F.crc32(F.encode("text", "UTF-8")).alias("kept_crc32"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    sized = stored(mixing.sizes_of(docs).select("doc_id", "source", "size"), "mix-sizes")
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "taken")


def op11_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I-Match fingerprints of every document and of its edited text (second half from the next document)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = imatch.fit_lexicon(docs)
    rows = in_ranges(docs, "doc_id", "text")
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.when(~F.col("guest"), F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("bucket", "pos", "guest", "id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("edited_sha256", F.sha2("edited", 256))
    fps = imatch.fingerprint(rows, lexicon, ["bucket", "pos"], {"fp": "text", "edited_fp": "edited"})
    fps = fps.withColumn("next_fp", F.lead("fp").over(Window.partitionBy("bucket").orderBy("pos"))).filter(~F.col("guest"))
    return fps.select(F.col("id").alias("doc_id"), "n_chars", "edited_sha256", imatch.shown(F.col("fp")).alias("fingerprint"),
                      imatch.shown(F.col("edited_fp")).alias("edited_fingerprint"),
                      imatch.likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
                      imatch.likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 clusters of all embeddings after three rounds."""
    assigned, centroids = clustering.cluster(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return clustering.describe(assigned, centroids).select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of each language, in all 120 orders."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filter_audit.audit(filter_audit.text_masks(docs, read_table(spark, sf_dir, "labels")))


QUERIES = {f.__name__: f for f in (
    op1_license_scan, op2_pii, op3_secret_scan, op4_sharding, op5_decontaminate, op6_near_dedup, op7_language, op8_ann,
    op9_line_dedup, op10_mixing, op11_imatch, op12_clusters, op13_filter_audit)}
ORACLES: dict[str, str] = {"op12_clusters": oracles.CLUSTERS, "op13_filter_audit": oracles.FILTER_AUDIT}
