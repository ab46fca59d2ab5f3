from pyspark.sql import functions as F

from evalframe.operators import folds as FO
from evalframe.operators import models as MO
from evalframe.plans import fixtures as fx
from tests.conftest import SF_MID


def test_refit_outer_learns_planted_signal(spark):
    ex = fx.features_fx(spark, SF_MID)
    outer = FO.stratified_folds(ex, "y_true", "row_id", k=5, seed=42)
    preds, metrics = MO.refit_outer("random_forest", {"n_estimators": 20, "max_depth": 6}, ex, outer, 1,
                                    sensitive="cat_b")
    m = metrics.first()
    assert m["roc_auc"] > 0.8
    r = preds.agg(F.min("y_prob"), F.max("y_prob"), F.count(F.lit(1)), F.count_distinct("sensitive")).first()
    assert 0.0 <= r[0] <= r[1] <= 1.0
    assert r[2] == outer.where("outer_fold = 1").count()      # only held-out rows are scored
    assert r[3] > 1                                            # the sensitive column is kept for auditing


def test_param_mapping():
    assert MO.spark_params("random_forest", {"n_estimators": 50, "max_depth": None, "max_features": "log2"}) == \
        {"numTrees": 50, "maxDepth": 30, "featureSubsetStrategy": "log2"}
    g = MO.spark_params("xgboost", {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.05,
                                    "colsample_bytree": 0.8, "min_child_weight": 3})
    assert g == {"maxIter": 10, "maxDepth": 3, "stepSize": 0.05, "featureSubsetStrategy": "0.8",
                 "minInstancesPerNode": 3}


def test_probability_is_for_the_resolved_positive_label(spark):
    # 'yes' is the positive label by rule, but it sorts before 'zzz', so the
    # model's class-1 probability belongs to 'zzz' and must be flipped
    rows = [(i, float(i % 10), "yes" if i % 10 >= 5 else "zzz") for i in range(400)]
    ex = spark.createDataFrame(rows, "row_id long, x double, y_true string")
    train = ex.where("row_id % 4 != 0")
    test = ex.where("row_id % 4 = 0")
    fold = MO.prepare_split(train, test)
    assert fold.mapping.first()["positive_label"] == "yes"
    preds = MO.predict(MO.fit_model("random_forest", {"n_estimators": 10, "max_depth": 3}, fold), fold)
    hi = preds.where("y_true = 'yes'").agg(F.avg("y_prob")).first()[0]
    lo = preds.where("y_true = 'zzz'").agg(F.avg("y_prob")).first()[0]
    assert hi > 0.8 and lo < 0.2


def test_decode_and_positive_probability(spark):
    from pyspark.ml.linalg import Vectors, VectorUDT
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    from evalframe.operators.labels import decode_predictions, positive_probability
    schema = StructType([StructField("run", IntegerType()), StructField("prediction", DoubleType()),
                         StructField("probability", VectorUDT())])
    df = spark.createDataFrame([(1, 1.0, Vectors.dense([0.3, 0.7])), (1, 0.0, Vectors.dense([0.9, 0.1]))], schema)
    mapping = spark.createDataFrame([(1, "no", "yes")], "run int, label_0 string, label_1 string")
    out = positive_probability(decode_predictions(df, mapping, ["run"])).orderBy("prediction").collect()
    assert [(r["y_pred"], r["y_prob"]) for r in out] == [("no", 0.1), ("yes", 0.7)]
