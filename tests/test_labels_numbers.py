"""Labels of mixed types, missing labels, numbers as text, parameters and proposals."""

import pytest
from pyspark.errors import PySparkException

from evalframe.functions.columns import clean_number
from evalframe.operators import metrics as M
from evalframe.operators import models as MO
from evalframe.operators import search as SE
from evalframe.operators.labels import check_binary


def test_int_and_double_labels_are_one_label(spark):
    df = spark.createDataFrame([(1, 1, 1.0, "a", .9), (1, 0, 0.0, "b", .2), (1, 1, 0.0, "a", .4), (1, 0, 0.0, "b", .1)],
                               "run int, y_true int, y_pred double, sensitive string, y_prob double")
    row = M.evaluate(df, ["run"]).first()
    assert row["accuracy"] == 0.75
    assert check_binary(df, ["run"]).isEmpty()


def test_missing_label_is_a_violation(spark):
    df = spark.createDataFrame([(1, 1, 1, "a", .9), (1, 0, 0, "b", .2), (1, None, 1, "a", .4)],
                               "run int, y_true int, y_pred int, sensitive string, y_prob double")
    assert [tuple(r) for r in check_binary(df, ["run"]).collect()] == [(1, 3)]
    with pytest.raises(PySparkException, match="exactly two labels"):
        M.evaluate(df, ["run"]).collect()


def test_only_decimal_numbers_are_numbers(spark):
    texts = ["1.5", " 2 ", "-3e2", ".5", "7.", "1.5d", "3f", "0x1p3", "abc", "", "inf", "nan", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(clean_number("t")).collect()]
    assert got == [1.5, 2.0, -300.0, 0.5, 7.0] + [None] * 8


def test_parameters_are_applied_or_refused():
    assert MO.spark_params("random_forest", {"min_samples_split": 10, "min_samples_leaf": 2})["minInstancesPerNode"] == 5
    with pytest.raises(ValueError, match="unknown"):
        MO.spark_params("random_forest", {"depth": 3})
    with pytest.raises(ValueError, match="beyond"):
        MO.spark_params("xgboost", {"max_depth": 31})


def test_proposals_are_distinct_and_keep_null_and_text_parameters(spark):
    history = spark.createDataFrame([(50, None, "sqrt", .7), (60, 5, "log2", .8), (70, 10, "sqrt", .6), (80, 5, "sqrt", .9)],
                                    "n int, depth int, mf string, objective_score double")
    cands = spark.createDataFrame([(55, None, "sqrt"), (55, None, "sqrt"), (50, None, "sqrt"), (65, 5, "log2"),
                                   (65, 5, "sqrt"), (90, 10, None)], "n int, depth int, mf string")
    got = [(r["n"], r["depth"], r["mf"]) for r in SE.propose(history, cands, ["n", "depth", "mf"], k=10).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(55.0, None, "sqrt"), (65.0, 5.0, "log2"), (65.0, 5.0, "sqrt"),
                                                     (90.0, 10.0, None)]))
