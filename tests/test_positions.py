"""Positional pairing of files, and search documents."""

import pytest
from pyspark.sql import functions as F

from evalframe.sources import ingest as IN


def write_csv(path, header, rows, files):
    path.mkdir()
    per = -(-len(rows) // files)
    for i in range(files):
        # later files are larger on disk: Spark packs splits by size, which must not matter
        body = [",".join(map(str, r)) for r in rows[i * per:(i + 1) * per]]
        (path / f"part-{i:03d}.csv").write_text("\n".join([header] + body) + "\n")


@pytest.mark.parametrize("max_bytes", ["128m", "700"])
def test_rows_of_many_files_and_splits_are_paired(spark, tmp_path, max_bytes):
    n = 1000
    write_csv(tmp_path / "x", "a,b", [(i, "x" * (i % 50)) for i in range(n)], 7)
    write_csv(tmp_path / "y", "label,other", [(f"l{i}", i) for i in range(n)], 3)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", max_bytes)
    try:
        got = IN.load_examples(spark, str(tmp_path / "x"), str(tmp_path / "y")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r["row_id"], r["a"], r["y_true"]) for r in got) == [(i, i, f"l{i}") for i in range(n)]


def test_unequal_lengths_are_an_error(spark, tmp_path):
    write_csv(tmp_path / "x", "a", [(i,) for i in range(10)], 2)
    write_csv(tmp_path / "y", "label", [(i,) for i in range(9)], 2)
    with pytest.raises(ValueError, match="differ in length"):
        IN.load_examples(spark, str(tmp_path / "x"), str(tmp_path / "y"))


def test_parquet_row_groups_keep_their_order(spark, tmp_path):
    df = spark.range(0, 5000, 1, 4).select("id", (F.col("id") * 2).alias("v"))
    df.write.option("parquet.block.size", 4096).parquet(str(tmp_path / "p"))
    read = spark.read.parquet(str(tmp_path / "p"))
    got = IN.with_position(read).collect()
    assert sorted(r["row_id"] for r in got) == list(range(5000))
    files = {}
    for r in read.select("id", "_metadata.file_path").collect():
        files.setdefault(r["file_path"], []).append(r["id"])
    want = [i for f in sorted(files) for i in sorted(files[f])]
    assert [r["id"] for r in sorted(got, key=lambda r: r["row_id"])] == want


def test_search_documents_round_trip(spark, tmp_path):
    rows = [("a", i, None if i == 3 else i / 7, '{"k": 1}') for i in range(1, 11)] + [("b", 1, 0.5, None)]
    trials = spark.createDataFrame(rows, "run string, iteration int, objective_score double, params string")
    docs = IN.search_documents(trials, ["run"], trials_per_document=4)
    assert sorted((r["run"], r["part"], len(r["history"])) for r in docs.collect()) == [("a", 0, 4), ("a", 1, 4), ("a", 2, 2), ("b", 0, 1)]
    assert all([h["iteration"] for h in r["history"]] == sorted(h["iteration"] for h in r["history"]) for r in docs.collect())
    path = IN.write_search_documents(docs, str(tmp_path / "docs"))
    back = IN.explode_history(IN.read_search_documents(spark, path, docs.schema, multi_line=False), ["run"])
    assert sorted(map(str, (tuple(r) for r in back.select(trials.columns).collect()))) == sorted(map(str, rows))
