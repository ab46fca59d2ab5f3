"""Experiment plans: data set per row, isolated failures, restart."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from evalframe.operators import folds as FO
from evalframe.operators.schedule import PLAN_KEYS, Dataset, PlanStore, open_rows, run_plan
from evalframe.operators.search import SearchResult
from evalframe.plans import fixtures as fx
from tests.conftest import SF_MID

PLAN = [(d, f, "rf", o) for d in ("one", "two") for f in (1, 2) for o in ("random", "guided")] + [("bad", 1, "rf", "random")]
SCHEMA = "dataset string, outer_fold int, model string, optimizer string"


class Fake:
    """A search that reads its data set and counts how often it ran."""

    def __init__(self, stop_at=None, broken=()):
        self.ran, self.stop_at, self.broken, self.pools, self.lock = [], stop_at, broken, set(), threading.Lock()

    def __call__(self, examples, outer, outer_fold, model, configs, optimizer, sensitive, dataset, store, run):
        spark = examples.sparkSession
        with self.lock:
            self.ran.append((dataset, outer_fold, model, optimizer))
            self.pools.add(spark.sparkContext.getLocalProperty("spark.scheduler.pool"))
            if len(self.ran) == self.stop_at:
                raise KeyboardInterrupt
        if (dataset, outer_fold) in self.broken:
            raise RuntimeError(f"no fit on {dataset} {outer_fold}")
        value = examples.agg(F.sum("x")).first()[0] * 10.0 + outer_fold
        store.append(spark.createDataFrame([(1, value)], "iteration int, objective_score double"), run, 0)
        row = spark.createDataFrame([(dataset, outer_fold, model, optimizer, value)], SCHEMA + ", accuracy double")
        return SearchResult(row, store.trials(run), {})


def resolve(spark):
    def of(name):
        if name == "bad":
            raise FileNotFoundError("no such data set: bad")
        x = spark.createDataFrame([(1 if name == "one" else 2,)], "x int")
        return Dataset(x, x, "s")
    return of


def collected(store):
    return sorted(tuple(r) for r in store.results().select(*PLAN_KEYS, "accuracy").collect())


def test_each_row_runs_on_its_own_data_set(spark, tmp_path):
    fake, store = Fake(broken={("two", 2)}), PlanStore(spark, str(tmp_path))
    run_plan(spark.createDataFrame(PLAN, SCHEMA), resolve(spark), lambda row: [], store, parallel=3, search=fake)
    got = collected(store)
    assert got == sorted((d, f, m, o, (10.0 if d == "one" else 20.0) + f) for d, f, m, o in PLAN if d != "bad" and (d, f) != ("two", 2))
    failed = {(r["dataset"], r["outer_fold"]): r["error"] for r in store.failures().collect()}
    assert failed == {("bad", 1): "no such data set: bad", ("two", 2): "no fit on two 2"}
    assert len(fake.pools) == len(fake.ran) == 8                 # one pool for each row that got its data
    assert store.history().count() == 6 and store.history().select("experiment").distinct().count() == 6


def test_killed_plan_resumes_to_equal_results(spark, tmp_path):
    plan = spark.createDataFrame(PLAN, SCHEMA)
    whole = PlanStore(spark, str(tmp_path / "whole"))
    run_plan(plan, resolve(spark), lambda row: [], whole, parallel=1, search=Fake())
    store = PlanStore(spark, str(tmp_path / "killed"))
    with pytest.raises(KeyboardInterrupt):
        run_plan(plan, resolve(spark), lambda row: [], store, parallel=1, search=Fake(stop_at=4))
    done = collected(store)
    assert 0 < len(done) < 8
    # a result that was being written when the driver was lost has no mark: the row is open
    torn = tmp_path / "killed" / "results" / "experiment=torn"
    torn.mkdir()
    (torn / "part-00000.parquet").write_bytes(b"torn")
    assert open_rows(plan, store).count() == len(PLAN) - len(done)
    fake = Fake()
    run_plan(plan, resolve(spark), lambda row: [], store, parallel=2, search=fake)
    assert not {r[:4] for r in done} & set(fake.ran)             # nothing runs twice
    assert collected(store) == collected(whole)


def test_failures_are_retried_or_left(spark, tmp_path):
    plan, store = spark.createDataFrame(PLAN[:2], SCHEMA), PlanStore(spark, str(tmp_path))
    run_plan(plan, resolve(spark), lambda row: [], store, search=Fake(broken={("one", 1)}))
    assert store.results() is None and store.failures().count() == 2
    again = Fake()
    run_plan(plan, resolve(spark), lambda row: [], store, retry_failures=False, search=again)
    assert again.ran == []
    run_plan(plan, resolve(spark), lambda row: [], store, search=again)
    assert store.failures().isEmpty() and store.results().count() == 2


def test_real_search_in_a_plan(spark, tmp_path):
    ex = fx.features_fx(spark, SF_MID)
    data = Dataset(ex, FO.stratified_folds(ex, "y_true", "row_id", k=5, seed=42), "cat_b")
    plan = spark.createDataFrame([("part", 1, "random_forest", "random"), ("part", 1, "no_such_model", "random")], SCHEMA)
    store = run_plan(plan, lambda name: data, lambda row: [{"n_estimators": 3, "max_depth": d} for d in (1, 6)],
                     PlanStore(spark, str(tmp_path)), batch=2)
    best = store.results().first()
    assert 0.5 < best["roc_auc"] <= 1
    assert "no estimator for model" in store.failures().first()["error"]
    trials = store.history().collect()
    assert {(t["dataset"], t["outer_fold"], t["model"]) for t in trials} == {("part", 1, "random_forest")}
    top = max(trials, key=lambda t: (t["objective_score"], -t["iteration"]))
    assert len(trials) == 2 and top["objective_score"] == best["best_objective_score"]
    assert json.loads(top["params"]) == json.loads(best["best_params"])
