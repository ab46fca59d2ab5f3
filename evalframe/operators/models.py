"""Model jobs on Spark ML.

The driver only orchestrates: a handful of folds times tens of configurations.
Every fit, prediction and metric is a distributed Spark job.  Work that does
not depend on hyperparameters (folds, imputation, one-hot, label encoding)
is done once per fold and stored, then shared by all configurations; the
predictions of all inner folds of a configuration are evaluated with one
grouped ``evaluate``.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.operators import folds as FO
from evalframe.operators import metrics as M
from evalframe.operators import prep as PR
from evalframe.operators._keys import as_list
from evalframe.operators.labels import encode_target, label_is_numeric, positive_labels
from evalframe.session import cut_lineage

MAX_TREE_DEPTH = 30   # Spark ML's limit
# parameters that are applied, and two that only steer how a fit runs
KNOWN = {"random_forest": {"n_estimators", "max_depth", "min_samples_split", "min_samples_leaf", "max_features",
                           "random_state", "n_jobs"},
         "xgboost": {"n_estimators", "max_depth", "learning_rate", "subsample", "colsample_bytree", "min_child_weight",
                     "random_state", "n_jobs"}}


def _depth(depth) -> int:
    """Unlimited (None) is the deepest tree that Spark grows; more is an error."""
    if depth is None:
        return MAX_TREE_DEPTH
    if int(depth) > MAX_TREE_DEPTH:
        raise ValueError(f"max_depth {depth} is beyond {MAX_TREE_DEPTH}, the limit of Spark's trees")
    return int(depth)


def spark_params(model: str, params: dict) -> dict:
    """Map the reference's hyperparameter names onto Spark ML estimator
    parameters.  A split of ``min_samples_split`` rows is enforced by half of
    them in each child.  Unknown names are an error."""
    unknown = set(params or {}) - KNOWN.get("xgboost" if model == "gbt" else model, set(params or {}))
    if unknown:
        raise ValueError(f"unknown parameters of {model}: {sorted(unknown)}")
    p = {k: v for k, v in (params or {}).items() if v is not None or k == "max_depth"}
    if model == "random_forest":
        out = {"numTrees": int(p.get("n_estimators", 100))}
        depth = p.get("max_depth")
        out["maxDepth"] = _depth(depth)
        leaf, split = int(p.get("min_samples_leaf") or 1), int(p.get("min_samples_split") or 2)
        if p.get("min_samples_leaf") is not None or p.get("min_samples_split") is not None:
            out["minInstancesPerNode"] = max(leaf, -(-split // 2))
        mf = p.get("max_features", "sqrt")
        out["featureSubsetStrategy"] = str(mf) if mf in ("sqrt", "log2", "all", "onethird", "auto") else str(float(mf))
        return out
    if model in ("xgboost", "gbt"):
        out = {"maxIter": int(p.get("n_estimators", 100))}
        depth = p.get("max_depth", 6)
        out["maxDepth"] = _depth(depth)
        if p.get("learning_rate") is not None:
            out["stepSize"] = float(p["learning_rate"])
        if p.get("subsample") is not None:
            out["subsamplingRate"] = float(p["subsample"])
        cs = p.get("colsample_bytree")
        if cs is not None and float(cs) < 1.0:
            out["featureSubsetStrategy"] = str(float(cs))
        if p.get("min_child_weight") is not None:
            out["minInstancesPerNode"] = max(1, int(round(float(p["min_child_weight"]))))
        return out
    raise ValueError(f"no estimator for model {model!r}")


def build_estimator(model: str, params: dict, seed: int = 1000, features: str = "features",
                    label: str = "label"):
    """M5 / M6: a Spark ML classifier for the reference's model names."""
    from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
    kw = spark_params(model, params)
    if model == "random_forest":
        return RandomForestClassifier(featuresCol=features, labelCol=label, seed=seed, **kw)
    return GBTClassifier(featuresCol=features, labelCol=label, seed=seed, **kw)


@dataclass
class PreparedFold:
    """Training and scoring rows of one split, prepared once and cached."""
    train: DataFrame        # row_id, features, label, y_true
    score: DataFrame        # row_id, features, y_true, sensitive
    mapping: DataFrame      # label_0, label_1 (+ positive_label)


def prepare_split(train: DataFrame, score: DataFrame, id_col: str = "row_id", label: str = "y_true",
                  sensitive: str | None = None, exclude=()) -> PreparedFold:
    """Fit imputation / one-hot / label encoding on ``train`` only (M1-M4,
    P4) and apply to both sides; the sensitive column is never a feature."""
    skip = {id_col, label, "sensitive", *as_list(exclude)}
    if sensitive:
        skip.add(sensitive)
    roles = PR.feature_roles(train.schema, exclude=skip)
    num = [c for c, r in roles.items() if r == "numeric"]
    cat = [c for c, r in roles.items() if r == "categorical"]
    model = PR.fit_prep(train, num, cat, one_hot=True)
    keep_tr = [id_col, label]
    keep_sc = [id_col, label] + ([sensitive] if sensitive else [])
    tr = PR.encode_features(model, train, keep=keep_tr)
    sc = PR.encode_features(model, score, keep=keep_sc)
    tr_enc, _, mapping = encode_target(tr.select(id_col, label, "features"), None, [], label, "label")
    numeric = label_is_numeric(train, label)
    pos = positive_labels(mapping.select(F.col("label_0").alias("y_true"), F.col("label_1").alias("y_pred")),
                          [], numeric)
    mapping = mapping.withColumn("__k", F.lit(0)).join(
        pos.select("positive_label").withColumn("__k", F.lit(0)), "__k").drop("__k")
    sc = sc.withColumnRenamed(sensitive, "sensitive") if sensitive else sc.withColumn("sensitive", F.lit(None).cast("string"))
    # reliable checkpoints: short plans for every fit, and a lost executor
    # does not replay fold assignment and preparation
    return PreparedFold(cut_lineage(tr_enc), cut_lineage(sc), cut_lineage(mapping))


def predict(fitted, fold: PreparedFold, keys: dict | None = None, id_col: str = "row_id",
            label: str = "y_true") -> DataFrame:
    """M7 + P5 + P6: prediction rows (keys, row_id, y_true, y_pred, y_prob,
    sensitive); y_prob is the probability of the resolved positive label."""
    from pyspark.ml.functions import vector_to_array
    out = fitted.transform(fold.score)
    arr = vector_to_array(F.col("probability"))
    m = fold.mapping.select("label_0", "label_1", "positive_label")
    j = out.withColumn("__k", F.lit(0)).join(F.broadcast(m.withColumn("__k", F.lit(0))), "__k").drop("__k")
    y_pred = F.when(F.col("prediction") == 1.0, F.col("label_1")).otherwise(F.col("label_0"))
    p1 = F.when(F.size(arr) == 2, arr[1])
    y_prob = F.when(F.col("positive_label") == F.col("label_1"), p1).otherwise(F.lit(1.0) - p1)
    key_cols = [F.lit(v).alias(k) for k, v in (keys or {}).items()]
    return j.select(*key_cols, F.col(id_col).alias("row_id"), F.col(label).cast("string").alias("y_true"),
                    y_pred.alias("y_pred"), y_prob.alias("y_prob"), F.col("sensitive").cast("string").alias("sensitive"))


def fit_model(model: str, params: dict, fold: PreparedFold, seed: int = 1000):
    """M5 / M6: fit on the prepared training rows."""
    return build_estimator(model, params, seed).fit(fold.train)


def inner_splits(examples: DataFrame, outer: DataFrame, outer_fold: int, k_inner: int = 3, seed: int = 42,
                 id_col: str = "row_id", label: str = "y_true", sensitive: str | None = None) -> list:
    """W2 + J1 + prep: the prepared (inner-train, inner-validation) pairs of
    one outer fold.  Done once and shared by every configuration."""
    # written once to the checkpoint folder: every later plan starts from it
    inner = cut_lineage(FO.inner_folds(outer, label, id_col, k_inner=k_inner, seed=seed, only=outer_fold)
                        .select(id_col, "inner_fold"))

    def one(i: int) -> PreparedFold:
        tr = examples.join(inner.where(F.col("inner_fold") != i).select(id_col), id_col, "left_semi")
        va = examples.join(inner.where(F.col("inner_fold") == i).select(id_col), id_col, "left_semi")
        return prepare_split(tr, va, id_col, label, sensitive)

    # the inner folds are independent jobs: plan and run them concurrently
    with ThreadPoolExecutor(max_workers=k_inner) as pool:
        return list(pool.map(one, range(1, k_inner + 1)))


def evaluate_config(model: str, params: dict, splits: list, config_id: int = 1, seed: int = 1000) -> DataFrame:
    """M8: fit and predict on every inner split, then one grouped evaluate
    over all inner folds and the mean over folds (A10): one row per config."""
    def one(i_fold):
        i, fold = i_fold
        return predict(fit_model(model, params, fold, seed), fold, {"config_id": config_id, "inner_fold": i})

    with ThreadPoolExecutor(max_workers=len(splits)) as pool:   # independent fits
        parts = list(pool.map(one, enumerate(splits, start=1)))
    preds = parts[0]
    for p in parts[1:]:
        preds = preds.unionByName(p)
    # scored once and cut from the model lineage: evaluate reads the
    # predictions twice (counts and scores) and plans many joins over them
    preds = cut_lineage(preds)
    per_fold = M.evaluate(preds, ["config_id", "inner_fold"])
    return M.mean_over_folds(per_fold, ["config_id"])


def refit_outer(model: str, params: dict, examples: DataFrame, outer: DataFrame, outer_fold: int,
                seed: int = 1000, id_col: str = "row_id", label: str = "y_true",
                sensitive: str | None = None, keys: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """M9: fit the chosen configuration on the whole outer-training part and
    evaluate on the untouched outer fold.  Returns (predictions, metrics)."""
    folds = cut_lineage(outer.select(id_col, "outer_fold"))
    train, test = FO.fold_split(examples, folds, outer_fold, id_col)
    fold = prepare_split(train.drop("outer_fold"), test.drop("outer_fold"), id_col, label, sensitive)
    fitted = fit_model(model, params, fold, seed)
    keys = dict(keys or {"outer_fold": outer_fold})
    preds = cut_lineage(predict(fitted, fold, keys))
    return preds, M.evaluate(preds, list(keys))
