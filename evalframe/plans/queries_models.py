"""Model-job queries (rows-only checks: fitted models have no SQL oracle).
They run the nested cross-validation of the reference on the feature table
derived from ``part`` and the trial history derived from ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evalframe.operators import folds as FO
from evalframe.operators import models as MO
from evalframe.operators import search as SE
from evalframe.operators import trials as TR
from evalframe.operators.schedule import PLAN_KEYS, Dataset, PlanStore, run_plan
from evalframe.plans import fixtures as fx
from evalframe.plans.catalog import register
from evalframe.session import ensure_checkpoint_dir
from evalframe.sources.ingest import parse_params
from evalframe.sources.tables import read_table

RF_PARAMS = {"n_estimators": 20, "max_depth": 5, "min_samples_leaf": 1, "max_features": "sqrt"}
GBT_PARAMS = {"n_estimators": 10, "max_depth": 3, "learning_rate": 0.1, "subsample": 1.0}


def _examples(spark, sf):
    ex = fx.features_fx(spark, sf)
    outer = FO.stratified_folds(ex, "y_true", "row_id", k=5, seed=42)
    return ex, outer


@register("evaluate_config")
def q_evaluate_config(spark, sf):
    """M8: inner 3-fold CV of one random-forest configuration on outer fold 1."""
    ex, outer = _examples(spark, sf)
    splits = MO.inner_splits(ex, outer, 1, sensitive="cat_b")
    return MO.evaluate_config("random_forest", RF_PARAMS, splits, 1)


@register("refit_outer")
def q_refit_outer(spark, sf):
    """M9 (+M5, M7): refit on outer-train of fold 1, evaluate on the held-out fold."""
    ex, outer = _examples(spark, sf)
    _, metrics = MO.refit_outer("random_forest", RF_PARAMS, ex, outer, 1, sensitive="cat_b")
    return metrics


@register("predict_gbt")
def q_predict_gbt(spark, sf):
    """M6 + M7 + P5 + P6: gradient-boosted trees, prediction rows of fold 2."""
    ex, outer = _examples(spark, sf)
    preds, _ = MO.refit_outer("xgboost", GBT_PARAMS, ex, outer, 2, sensitive="cat_b")
    return preds


RF_SPACE = {
    "n_estimators": {"type": "integer", "low": 3, "high": 12},
    "max_depth": {"type": "integer", "low": 1, "high": 6},
    "min_samples_leaf": {"type": "integer", "low": 1, "high": 20},
    "max_features": {"type": "categorical", "values": ["sqrt", "log2", "all"]},
}


def _parts(spark, sf) -> Dataset:
    ex, outer = _examples(spark, sf)
    return Dataset(ex, outer, "cat_b")


def _customers(spark, sf) -> Dataset:
    """Second data set: customers, whether their balance is above the middle of its range."""
    c = read_table(spark, sf, "customer")
    ex = c.select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("num_a"),
                  (F.col("c_acctbal") / 100 + F.col("c_custkey") % 40).alias("num_b"), F.col("c_mktsegment").alias("cat_b"),
                  F.when(F.col("c_acctbal") > 4500, "yes").otherwise("no").alias("y_true"))
    return Dataset(ex, FO.stratified_folds(ex, "y_true", "row_id", k=5, seed=42), "cat_b")


@register("run_search")
def q_run_search(spark, sf):
    """Random search on outer fold 1, refit of the best."""
    d = _parts(spark, sf)
    cand = TR.sample_space(spark, RF_SPACE, 50, 42).drop("candidate")
    return SE.run_search(d.examples, d.outer, 1, "random_forest", cand, "random", n_trials=4, sensitive=d.sensitive,
                         dataset="part").result


@register("search_history")
def q_search_history(spark, sf):
    """M10 + H6: the trials of a guided search over 200 candidates, with the incumbent (W3) of
    each and the chosen trial (W4)."""
    d = _parts(spark, sf)
    cand = TR.sample_space(spark, RF_SPACE, 200, 42).drop("candidate")
    found = SE.run_search(d.examples, d.outer, 1, "random_forest", cand, "guided", n_trials=9, batch=3, n_initial=3,
                          sensitive=d.sensitive, dataset="part")
    keys = ["dataset", "outer_fold", "model", "optimizer"]
    sofar = TR.incumbents(found.trials, keys, bucket_size=None).drop("objective_score")
    best = TR.best_trial(found.trials, keys).select(*keys, F.col("iteration").alias("best_iteration"))
    return (found.trials.join(sofar, [*keys, "iteration"]).join(best, keys)
            .select(*keys, "iteration", "origin", "params", "mean_balanced_accuracy", "objective_score", "best_so_far",
                    "incumbent_iteration", (F.col("iteration") == F.col("best_iteration")).alias("chosen")))


@register("run_plan")
def q_run_plan(spark, sf):
    """A plan over two data sets and one that can't be loaded; one row per plan row
    with its result or its error."""
    sources = {"part": _parts, "customer": _customers}
    plan = spark.createDataFrame([("part", 1, "xgboost", "random"), ("customer", 2, "random_forest", "guided"),
                                  ("missing", 1, "random_forest", "random")],
                                 "dataset string, outer_fold int, model string, optimizer string")
    spaces = {"xgboost": [{"n_estimators": 3, "max_depth": 2}, {"n_estimators": 5, "max_depth": 3}],
              "random_forest": [{"n_estimators": n, "max_depth": d} for n in (3, 5) for d in (2, 5)]}
    store = PlanStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/plan-{uuid.uuid4().hex}")
    run_plan(plan, lambda name: sources[name](spark, sf), lambda row: spaces[row["model"]], store, parallel=2,
             n_trials=2, batch=2)
    keys = list(PLAN_KEYS)
    trials = store.history().groupBy("dataset", "outer_fold", "model", "optimizer").agg(F.count(F.lit(1)).alias("n_trials"))
    return (plan.join(store.results().drop("runtime_seconds"), keys, "left")
            .join(store.failures().select(*keys, "error"), keys, "left").join(trials, keys, "left"))


@register("propose")
def q_propose(spark, sf):
    """H6: surrogate-guided proposals over the trial history of ``events``."""
    hist = fx.trials_fx(spark, sf)
    _, cols = parse_params("params", ["k"])
    hist = hist.withColumn("k", cols["k"])
    cand = TR.sample_space(spark, {"k": {"type": "integer", "low": 0, "high": 200}}, 400, 7)
    return SE.propose(hist, cand, ["k"], k=5)
