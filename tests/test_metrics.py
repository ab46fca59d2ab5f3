import math

import pytest
from pyspark.sql import functions as F

from evalframe.operators import metrics as M
from evalframe.operators.labels import canonical_predictions, positive_labels
from evalframe.operators.ranking import below, prefix_sums, range_cuts, ranked_sums
from evalframe.plans import fixtures as fx
from tests.conftest import SF_MID

# The reference's hand-checked 8-row example.
EXAMPLE = [
    (1, 0, 0, 0.10, "A"), (2, 0, 0, 0.20, "A"), (3, 1, 1, 0.80, "A"), (4, 1, 1, 0.90, "A"),
    (5, 0, 0, 0.30, "B"), (6, 1, 1, 0.70, "B"), (7, 0, 1, 0.60, "B"), (8, 1, 1, 0.95, "B"),
]
COLS = ["row_id", "y_true", "y_pred", "y_prob", "sensitive"]


def _one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0].asDict()


def test_eight_row_example(spark):
    df = spark.createDataFrame(EXAMPLE, COLS).withColumn("run", F.lit("r"))
    r = _one(M.evaluate(df, ["run"]))
    assert r["accuracy"] == pytest.approx(0.875)
    assert r["balanced_accuracy"] == pytest.approx(0.875)
    assert r["f1"] == pytest.approx(8 / 9)
    assert r["roc_auc"] == pytest.approx(1.0)
    assert r["demographic_parity_difference"] == pytest.approx(0.25)
    assert r["equal_opportunity_difference"] == pytest.approx(0.0)


def test_no_keys_and_no_sensitive(spark):
    df = spark.createDataFrame(EXAMPLE, COLS).drop("sensitive")
    r = _one(M.evaluate(df, []))
    assert r["accuracy"] == pytest.approx(0.875)
    assert r["demographic_parity_difference"] == 0.0
    assert r["equal_opportunity_difference"] == 0.0


def test_one_class_truth_gives_null_auc_and_single_recall(spark):
    rows = [(1, "no", "no", 0.1, "A"), (2, "no", "yes", 0.7, "B"), (3, "no", "no", 0.2, "B")]
    df = spark.createDataFrame(rows, COLS).withColumn("run", F.lit(1))
    r = _one(M.evaluate(df, ["run"]))
    assert r["roc_auc"] is None
    assert r["balanced_accuracy"] == pytest.approx(2 / 3)  # only the class present in y_true
    assert r["f1"] == 0.0                                  # zero division -> 0
    assert r["equal_opportunity_difference"] == 0.0        # no group has actual positives


def test_null_sensitive_is_not_a_group(spark):
    rows = [(1, "1", "1", 0.9, "A"), (2, "0", "0", 0.1, "A"), (3, "1", "0", 0.4, None),
            (4, "0", "1", 0.6, None)]
    df = spark.createDataFrame(rows, COLS).withColumn("run", F.lit(1))
    r = _one(M.evaluate(df, ["run"]))
    assert r["demographic_parity_difference"] == 0.0  # one real group only


def test_missing_score_gives_null_auc(spark):
    rows = [(1, 1, 1, 0.9, "A"), (2, 0, 0, None, "A")]
    df = spark.createDataFrame(rows, "row_id long, y_true int, y_pred int, y_prob double, sensitive string")
    r = _one(M.roc_auc(df.withColumn("run", F.lit(1)), ["run"]))
    assert r["roc_auc"] is None


def test_ties_count_half(spark):
    rows = [(1, 1, 1, 0.5, "A"), (2, 0, 1, 0.5, "A"), (3, 0, 0, 0.1, "A")]
    df = spark.createDataFrame(rows, COLS)
    r = _one(M.roc_auc(df, []))
    assert r["roc_auc"] == pytest.approx(0.75)


@pytest.mark.parametrize("labels,expected", [
    (["<=50K", ">50K"], ">50K"),
    (["no", "yes"], "yes"),
    (["b", "a"], "b"),
    (["M", "B"], "M"),
    (["1", "2"], "2"),      # text labels: no '1 wins' rule, larger text wins
])
def test_positive_label_rule_text(spark, labels, expected):
    df = spark.createDataFrame([(labels[0], labels[1])], ["y_true", "y_pred"])
    r = _one(positive_labels(df, [], numeric=False))
    assert r["positive_label"] == expected
    assert r["negative_label"] == [x for x in labels if x != expected][0]


def test_positive_label_numeric_one_wins_and_numeric_order(spark):
    df = spark.createDataFrame([(1, 0), (0, 1)], "y_true int, y_pred int")
    c, numeric = canonical_predictions(df)
    assert numeric
    assert _one(positive_labels(c, [], numeric))["positive_label"] == "1"
    df2 = spark.createDataFrame([(2, 10)], "y_true int, y_pred int")
    c2, _ = canonical_predictions(df2)
    assert _one(positive_labels(c2, [], True))["positive_label"] == "10"
    df3 = spark.createDataFrame([(True, False)], "y_true boolean, y_pred boolean")
    c3, n3 = canonical_predictions(df3)
    assert _one(positive_labels(c3, [], n3))["positive_label"] == "1"


def test_three_labels_fail(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "a")], ["y_true", "y_pred"])
    with pytest.raises(Exception, match="exactly two labels"):
        positive_labels(df, [], numeric=False).collect()


def _shifted(df, how):
    """Scores in one narrow range, outside [0, 1], or spread over many magnitudes."""
    p = F.col("y_prob")
    return df.withColumn("y_prob", {"plain": p, "narrow": 0.7 + p * 1e-9, "outside": p * 2e6 - 1e6,
                                    "magnitudes": F.exp((p - 0.5) * 400)}[how])


@pytest.mark.parametrize("how", ["plain", "narrow", "outside", "magnitudes"])
def test_ranked_sums_equal_the_plain_window(spark, how):
    df = _shifted(fx.predictions_fx(spark, SF_MID), how)
    hot = df.where("run_id = '1-URGENT'").withColumn("y_prob", F.col("y_prob") + F.col("row_id") * 1e-13)
    per = (df.unionByName(hot).withColumn("run_id", F.when(F.col("run_id") != "5-LOW", F.col("run_id")))
           .groupBy("run_id", "y_prob").agg(F.count(F.lit(1)).alias("neg")))
    per = per.unionByName(spark.createDataFrame([("alone", 0.5, 3), ("none", None, 2), ("1-URGENT", None, 7)],
                                                "run_id string, y_prob double, neg long"))
    plain = prefix_sums(per, ["run_id"], "y_prob", "neg", None)
    split = ranked_sums(per, ["run_id"], "y_prob", "neg")
    key = lambda r: (str(r["run_id"]), r["y_prob"] is not None, r["y_prob"] or 0)     # noqa: E731
    assert sorted(split.collect(), key=key) == sorted(plain.collect(), key=key)


def test_ranges_are_even_whatever_the_scores(spark):
    df = spark.range(40_000).select((F.col("id") % 3).alias("k"), F.exp(F.randn(3) * 20).alias("v"))
    cuts = range_cuts(df, "v", out="cuts").first()["cuts"]
    n = df.groupBy(below(F.lit(cuts), F.col("v")).alias("b")).count().toPandas()["count"]
    assert len(n) == 200 and n.max() < 4 * 200          # sqrt(n) ranges of about sqrt(n) values
    # a hot group in one narrow range gets its share of the cuts
    df = df.unionByName(spark.range(40_000).select(F.lit(7).alias("k"), (0.5 + F.col("id") * 1e-12).alias("v")))
    cuts = range_cuts(df, "v", out="cuts").first()["cuts"]
    n = df.groupBy("k", below(F.lit(cuts), F.col("v")).alias("b")).count().toPandas()["count"]
    assert n.max() < 2.5 * 80_000 / 256


@pytest.mark.parametrize("how", ["plain", "narrow", "outside"])
def test_auc_by_pairs(spark, how):
    df = _shifted(fx.predictions_fx(spark, SF_MID).where("row_id % 40 = 0"), how)
    rows = df.collect()
    for r in M.roc_auc(df, ["run_id"]).collect():
        pos = [x["y_prob"] for x in rows if x["run_id"] == r["run_id"] and x["y_true"] == ">50K"]
        neg = [x["y_prob"] for x in rows if x["run_id"] == r["run_id"] and x["y_true"] != ">50K"]
        want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert r["roc_auc"] == pytest.approx(want, rel=1e-12) and not math.isnan(want)


def test_label_column_of_many_values_is_counted_not_collected(spark):
    df = spark.range(20_000).select(F.lit("r").alias("run"), F.concat(F.lit("v"), "id").alias("y_true"),
                                    F.lit("v1").alias("y_pred"), F.lit(0.5).alias("y_prob"))
    with pytest.raises(Exception, match="has 20000"):
        M.evaluate(df, ["run"]).collect()
    assert "collect_set" not in M.evaluate(df, ["run"])._jdf.queryExecution().optimizedPlan().toString()


def test_evaluate_scans_its_input_twice_at_most(spark, tmp_path):
    fx.predictions_fx(spark, SF_MID).write.parquet(str(tmp_path / "p"))
    out = M.evaluate(spark.read.parquet(str(tmp_path / "p")), ["run_id"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan") <= 2


def test_given_positive_label(spark):
    df = spark.createDataFrame(EXAMPLE, COLS).withColumn("run", F.lit("r"))
    r = _one(M.evaluate(df, ["run"], positive="0"))
    assert r["f1"] == pytest.approx(6 / 7)
    assert r["roc_auc"] == pytest.approx(0.0)   # scores rank class 1, so class 0 gets 1 - 1.0
    assert r["accuracy"] == pytest.approx(0.875)
