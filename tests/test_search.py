"""Guided search over a growing trial table, and its store."""

import json
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evalframe.operators import search as SE
from evalframe.operators import trials as TR
from evalframe.operators.search import TrialStore
from evalframe.operators.vocab import dense_positions, value_index, with_positions

SPACE = {"x": {"type": "real", "low": 0.0, "high": 1.0}, "n": {"type": "integer", "low": 0, "high": 20},
         "kind": {"type": "categorical", "values": ["a", "b", "c"]}}


def candidates(spark, n=600):
    return TR.sample_space(spark, SPACE, n, 3).drop("candidate")


def planted(batch):
    """One narrow peak at x = 0.8, n = 5, kind = b."""
    s = (F.lit(1.0) - F.pow(F.col("x") - 0.8, 2) * 2 - F.pow((F.col("n") - 5) / 20.0, 2)
         - F.when(F.col("kind") == "b", 0.0).otherwise(0.3))
    return batch.select("iteration", s.alias("mean_balanced_accuracy"))


def run(spark, tmp_path, method, n=20, name="r", evaluate=planted, **kw):
    return SE.search(candidates(spark), list(SPACE), evaluate, n, method, batch=4,
                     store=TrialStore(spark, str(tmp_path / "store")), run=name, **kw)


def test_guided_beats_random_on_a_planted_optimum(spark, tmp_path):
    guided = run(spark, tmp_path, "guided", 20, "g")
    random = run(spark, tmp_path, "random", 4, "r")
    top = guided.agg(F.max("objective_score")).first()[0]
    # what 20 random trials reach, over 2000 random searches of the same candidates
    scores = np.array([r[1] for r in planted(candidates(spark).withColumn("iteration", F.lit(0))).collect()])
    rng = np.random.default_rng(1)
    reach = np.array([scores[rng.choice(len(scores), 20, replace=False)].max() for _ in range(2000)])
    assert top > reach.mean()
    later = guided.where("iteration > 8").agg(F.avg("objective_score")).first()[0]
    assert later > scores.mean()
    rows = guided.orderBy("iteration").collect()
    assert [r["iteration"] for r in rows] == list(range(1, 21))
    assert len({r["params"] for r in rows}) == 20                       # never the same configuration twice
    assert [r["origin"] for r in rows] == ["random"] * 4 + ["guided"] * 16
    # the first batch is the same as that of the random search
    assert {r["params"] for r in rows[:4]} == {r["params"] for r in random.where("iteration <= 4").collect()}
    # the trial table feeds the incumbent and best-trial operators
    t = guided.withColumn("run", F.lit(1))
    top = TR.best_trial(t, ["run"]).first()
    assert top["objective_score"] == max(r["objective_score"] for r in rows)
    last = TR.incumbents(t, ["run"]).orderBy(F.desc("iteration")).first()
    assert last["best_so_far"] == top["objective_score"] and last["incumbent_iteration"] == top["iteration"]


def test_killed_search_goes_on_where_it_stopped(spark, tmp_path):
    whole = {(r["iteration"], r["params"], r["objective_score"]) for r in run(spark, tmp_path, "guided", 12, "whole").collect()}
    calls = []

    def dies(batch):
        calls.append(batch.count())
        if len(calls) == 3:
            raise KeyboardInterrupt
        return planted(batch)

    with pytest.raises(KeyboardInterrupt):
        run(spark, tmp_path, "guided", 12, "killed", dies)
    assert len(TrialStore(spark, str(tmp_path / "store")).batches("killed")) == 2
    # a batch that was being written when the driver was lost has no mark
    half = tmp_path / "store" / "run=killed" / "batch=000002"
    half.mkdir()
    (half / "part-00000.parquet").write_bytes(b"torn")
    calls.clear()
    calls.extend([0, 0, 0])
    got = run(spark, tmp_path, "guided", 12, "killed", dies)
    assert len(calls) == 4                                              # one batch was left to do
    assert {(r["iteration"], r["params"], r["objective_score"]) for r in got.collect()} == whole


def test_batch_spreads(spark):
    cand = spark.range(0, 1001).select((F.col("id") / 1000.0).alias("x"))
    hist = spark.createDataFrame([(i / 10.0, 1.0 - abs(i / 10.0 - 0.5)) for i in range(11)], "x double, objective_score double")
    near = [r["x"] for r in SE.propose_batch(hist, cand, ["x"], 5, kappa=0.5, spread=1e-6).collect()]
    far = [r["x"] for r in SE.propose_batch(hist, cand, ["x"], 5, kappa=0.5, spread=0.3).collect()]
    assert len(set(near)) == len(set(far)) == 5
    gap = lambda v: min(abs(a - b) for i, a in enumerate(v) for b in v[:i])     # noqa: E731
    assert gap(far) > 0.05 > gap(near)
    assert near[0] == far[0]                                            # the first pick is the best one


def test_search_ends_with_the_candidates_and_scores_failures_last(spark, tmp_path):
    cand = SE.as_candidates(spark, [{"k": 1}, {"k": 2}, {"k": None}, {"k": 2}])
    some = lambda b: b.where("k is not null").select("iteration", F.col("k").cast("double").alias("mean_balanced_accuracy"))
    got = SE.search(cand, ["k"], some, 10, "guided", batch=2, store=TrialStore(spark, str(tmp_path)), run="r").collect()
    assert sorted(json.loads(r["params"]).get("k", 0) for r in got) == [0, 1, 2]
    assert {r["k"]: r["objective_score"] for r in got} == {1: 1.0, 2: 2.0, None: float("-inf")}
    with pytest.raises(ValueError):
        SE.search(cand.limit(0), ["k"], some, 1, store=TrialStore(spark, str(tmp_path)), run="none")
    with pytest.raises(ValueError):
        SE.search(cand, ["k"], some, 0)
    with pytest.raises(ValueError):
        SE.search(cand, ["k"], some, 1, method="grid")


def test_text_parameters_become_numbers_where_all_are(spark):
    df = spark.createDataFrame([("1", "0.5", "x", None), ("20", "2", "3", None)], "a string, b string, c string, d string")
    assert dict(SE.typed_params(df, df.columns).dtypes) == {"a": "bigint", "b": "double", "c": "string", "d": "bigint"}


def test_value_index_is_ordered_for_many_values(spark):
    df = spark.range(20_000).select(F.concat(F.lit("v"), F.col("id").cast("string")).alias("a"),
                                    F.when(F.col("id") % 3 > 0, F.col("id") % 7).cast("string").alias("b"))
    index = value_index(df, ["a", "b"])
    got = {c: [r["value"] for r in index.where(F.col("column") == c).orderBy("position").collect()] for c in ("a", "b")}
    assert got["a"] == sorted(f"v{i}" for i in range(20_000)) and got["b"] == list("0123456")
    assert [r[0] for r in index.where("column = 'b'").orderBy("position").select("position").collect()] == list(range(7))
    placed = with_positions(spark.createDataFrame([("v0", None), ("no", "6")], "a string, b string"), index, ["a", "b"], "p_")
    assert {(r["a"], r["p_a"], r["p_b"]) for r in placed.collect()} == {("v0", 0, None), ("no", None, 6)}


def test_dense_positions_of_a_hot_group(spark):
    df = spark.range(5000).selectExpr("case when id < 4500 then 'hot' when id < 4990 then 'warm' end as g", "pmod(hash(id), 100000) * 10000 + id as v")
    rows = dense_positions(df, ["g"], ["v"]).collect()
    for g in ("hot", "warm", None):
        own = sorted((r["v"], r["position"]) for r in rows if r["g"] == g)
        assert [p for _, p in own] == list(range(len(own)))
    assert dense_positions(df.limit(0), ["g"], ["v"]).isEmpty()


def test_surrogate_fit_is_dealt_out(spark, monkeypatch):
    """A long history is fitted by several tasks, half of it copies of one trial; no row is lost."""
    from pyspark.ml.regression import RandomForestRegressor
    monkeypatch.setattr(SE, "FIT_ROWS", 500, raising=False)
    monkeypatch.setattr(SE, "SAME_ROWS", 30, raising=False)
    seen, fit = [], RandomForestRegressor.fit

    def spy(self, df, *args):
        seen.extend(df.select("label", F.spark_partition_id().alias("at")).collect())
        return fit(self, df, *args)

    monkeypatch.setattr(RandomForestRegressor, "fit", spy)
    rows = [(0, 1.0)] * 2000 + [(i % 50, float(i % 400)) for i in range(2000)] + [(3, None)]
    history = spark.createDataFrame(rows, "k long, objective_score double")
    got = SE.propose(history, spark.createDataFrame([(k,) for k in range(40, 70)], "k long"), ["k"], k=5).collect()
    tasks = Counter(r["at"] for r in seen)
    print("rows by task", sorted(tasks.values()))
    assert Counter(r["label"] for r in seen) == Counter(s for _, s in rows if s is not None)
    assert len(tasks) >= 4 and max(tasks.values()) <= 1200
    assert len(got) == 5 and all(r["k"] >= 50 for r in got)
