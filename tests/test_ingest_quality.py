import json
import tempfile

import pytest
from pyspark.sql import functions as F

from evalframe.operators import quality as Q
from evalframe.operators.labels import check_binary
from evalframe.sources import ingest as IN


def _tmp():
    return tempfile.mkdtemp(prefix="evalframe-test-", dir="/tmp")


def test_load_examples_by_position(spark):
    d = _tmp()
    with open(f"{d}/features.csv", "w") as f:
        f.write("a,b\n1,x\n2,y\n3,z\n")
    with open(f"{d}/target.csv", "w") as f:
        f.write("label,other\nno,1\nyes,2\nno,3\n")
    ex = IN.load_examples(spark, f"{d}/features.csv", f"{d}/target.csv")
    rows = sorted((r["row_id"], r["a"], r["y_true"]) for r in ex.collect())
    assert rows == [(0, 1, "no"), (1, 2, "yes"), (2, 3, "no")]
    with pytest.raises(ValueError):
        IN.load_examples(spark, None, f"{d}/target.csv")


def test_write_table_refuses_its_own_input_and_results_need_rows(spark):
    d = _tmp()
    spark.range(3).write.parquet(f"{d}/t")
    df = spark.read.parquet(f"{d}/t")
    with pytest.raises(ValueError, match="refusing"):
        IN.write_table(df, f"{d}/t")
    IN.write_table(df, f"{d}/copy", fmt="csv")
    assert spark.read.option("header", True).csv(f"{d}/copy").count() == 3
    with pytest.raises(ValueError, match="no results"):
        IN.write_results(df.where("id < 0"), f"{d}/empty")
    IN.write_results(df.withColumn("dataset", F.lit("a")), f"{d}/res", fmt="json", partition_by="dataset")
    assert spark.read.json(f"{d}/res").count() == 3


def test_read_results_coerces_and_rejects_bad_folds(spark):
    d = _tmp()
    with open(f"{d}/r.csv", "w") as f:
        f.write(" Dataset ,Model,optimizer,outer_fold,accuracy\n ADULT ,RF,random,1,0.5\nwdbc,xgb,random,2.0,n/a\n")
    r = IN.read_results(spark, f"{d}/r.csv", numeric_cols=["accuracy"])
    rows = sorted(tuple(x) for x in r.select("dataset", "model", "outer_fold", "accuracy").collect())
    assert rows == [("adult", "rf", 1, 0.5), ("wdbc", "xgb", 2, None)]
    with open(f"{d}/bad.csv", "w") as f:
        f.write("dataset,model,optimizer,outer_fold\na,b,c,one\n")
    with pytest.raises(Exception, match="not numeric"):
        IN.read_results(spark, f"{d}/bad.csv").collect()
    assert [r["metric"] for r in IN.check_metrics(r.withColumn("x", F.lit("bad")), ["accuracy", "x"]).collect()] == ["x"]


def test_parse_params_reads_plain_and_quoted_numbers(spark):
    df = spark.createDataFrame([('{"n_estimators": 100, "max_depth": "10"}',), ('{"max_depth": null}',)], ["p"])
    _, cols = IN.parse_params("p", ["n_estimators", "max_depth"])
    got = df.select(cols["n_estimators"].alias("n"), cols["max_depth"].alias("d")).collect()
    assert [tuple(r) for r in got] == [(100.0, 10.0), (None, None)]
    m = df.select(IN.params_to_json(IN.parse_params("p")).alias("j")).first()["j"]
    assert json.loads(m) == {"n_estimators": "100", "max_depth": "10"}


def test_explode_history(spark):
    d = _tmp()
    doc = {"best_params": {"n_estimators": 50}, "best_objective_score": 0.7,
           "history": [{"iteration": 1, "optimizer": "random", "n_estimators": 50, "objective_score": 0.6},
                       {"iteration": 2, "optimizer": "random", "n_estimators": 100, "objective_score": 0.7}]}
    with open(f"{d}/doc.json", "w") as f:
        json.dump(doc, f, indent=2)
    h = IN.explode_history(IN.read_search_documents(spark, f"{d}/doc.json"))
    assert [(r["iteration"], r["objective_score"]) for r in h.orderBy("iteration").collect()] == [(1, 0.6), (2, 0.7)]


def test_union_results_is_ragged(spark):
    a = spark.createDataFrame([(1, 0.5)], "id int, x double")
    b = spark.createDataFrame([(2, "s")], "id int, y string")
    rows = sorted(tuple(r) for r in IN.union_results(a, b).collect())
    assert rows == [(1, 0.5, None), (2, None, "s")]


def test_check_columns_and_describe(spark):
    df = spark.createDataFrame([(1, "a", True, 0.5)], "id long, s string, b boolean, d double")
    assert Q.check_columns(df, ["id", "zz", "s"]) == ["zz"]
    roles = {r["column_name"]: r["role"] for r in Q.describe_columns(df).collect()}
    assert roles == {"id": "numeric", "s": "categorical", "b": "categorical", "d": "numeric"}


def test_check_domain_counts_null_as_invalid(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,), ("c",)], "v string")
    got = sorted((r["value"] or "", r["n"]) for r in Q.check_domain(df, "v", ["a", "b"]).collect())
    assert got == [("", 1), ("c", 1)]


def test_check_grid_reports_missing_duplicate_unexpected(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 3)], "ds string, f int")
    got = sorted(tuple(r) for r in Q.check_grid(df, {"ds": ["a", "b"], "f": [1, 2]}).collect())
    assert got == [("a", 1, 2, "duplicate"), ("a", 2, 0, "missing"), ("b", 1, 0, "missing"),
                   ("b", 2, 0, "missing"), ("b", 3, 1, "unexpected")]


def test_find_duplicates_lists_every_copy(spark):
    df = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "k int, v string")
    got = sorted((r["k"], r["v"], r["dup_count"]) for r in Q.find_duplicates(df, ["k"]).collect())
    assert got == [(1, "x", 2), (1, "y", 2)]


def test_profile_top_k_ties_by_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",), (None,)], "v string")
    got = [(r["value"], r["n"]) for r in Q.profile_categoricals(df, ["v"], k=3).orderBy("rank").collect()]
    assert got == [("c", 2), ("a", 1), ("b", 1)]


def test_check_binary_flags_bad_runs(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "a", "a"), (3, "a", "b"), (3, "c", "a")],
                               "run int, y_true string, y_pred string")
    assert sorted((r["run"], r["n_labels"]) for r in check_binary(df, ["run"]).collect()) == [(2, 1), (3, 3)]
