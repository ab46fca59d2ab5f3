import pytest
from pyspark.sql import functions as F

from evalframe.operators import folds as FO
from evalframe.operators import prep as PR
from evalframe.operators import trials as TR
from evalframe.plans import fixtures as fx
from tests.conftest import SF_MID


def test_stratified_folds_disjoint_covering_balanced(spark):
    ex = fx.features_fx(spark, SF_MID)
    w = FO.stratified_folds(ex, "y_true", "row_id", k=5, seed=42)
    assert w.count() == ex.count() == w.select("row_id").distinct().count()
    sizes = w.groupBy("y_true", "outer_fold").count().groupBy("y_true").agg(
        (F.max("count") - F.min("count")).alias("spread"), F.count(F.lit(1)).alias("k")).collect()
    assert all(r["spread"] <= 1 and r["k"] == 5 for r in sizes)
    plain = FO.stratified_folds(ex, "y_true", "row_id", k=5, seed=42, buckets=None)
    assert sorted(w.collect()) == sorted(plain.collect())


def test_inner_folds_only_on_outer_train(spark):
    ex = fx.features_fx(spark, SF_MID)
    w = FO.stratified_folds(ex, "y_true", "row_id", k=5, seed=42)
    inner = FO.inner_folds(w, k_outer=5, k_inner=3)
    j = inner.join(w.select("row_id", F.col("outer_fold").alias("own")), "row_id")
    assert j.where(F.col("own") == F.col("outer_fold")).count() == 0
    assert inner.count() == 4 * ex.count()


def test_save_and_load_folds_prunes_partitions(spark):
    import tempfile
    d = tempfile.mkdtemp(prefix="evalframe-folds-", dir="/tmp") + "/folds"
    ex = fx.features_fx(spark, SF_MID)
    w = FO.stratified_folds(ex, "y_true", "row_id", k=5).withColumn("dataset", F.lit("part"))
    FO.save_folds(w, d)
    one = FO.load_folds(spark, d, "part", 3)
    assert one.count() == w.where("outer_fold = 3").count()
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "partition" in plan.lower()
    with pytest.raises(Exception):
        FO.load_folds(spark, d + "_missing").count()


def test_bucketed_folds_join_without_an_exchange(spark, tmp_path):
    ex = fx.features_fx(spark, SF_MID)
    w = FO.stratified_folds(ex, "y_true", "row_id", k=5).drop("y_true").withColumn("dataset", F.lit("part"))
    FO.save_folds(w, str(tmp_path / "folds"), buckets=8)
    FO.save_rows(ex, str(tmp_path / "examples"), buckets=8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        folds = FO.load_folds(spark, str(tmp_path / "folds"), "part", 3)
        joined = FO.load_rows(spark, str(tmp_path / "examples")).join(folds, "row_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert "PartitionFilters: [isnotnull(dataset" in plan and "outer_fold" in plan.split("PartitionFilters")[-1]
        got = sorted(r["row_id"] for r in joined.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == sorted(r["row_id"] for r in w.where("outer_fold = 3").collect())
    # round trip of everything, and a second load of the same path
    assert sorted(map(str, FO.load_rows(spark, str(tmp_path / "examples")).collect())) == sorted(map(str, ex.collect()))
    assert FO.load_folds(spark, str(tmp_path / "folds")).count() == w.count()


def test_sparse_features_of_a_large_vocabulary(spark):
    train = spark.range(3000).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"),
                                     F.format_string("v%05d", "id").alias("big"), F.lit("only").alias("one"),
                                     F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), (F.col("id") % 2).cast("string"))).alias("small"))
    test = spark.createDataFrame([(1, 0.5, "v00000", "only", "s1"), (2, None, "new", "new", "new"), (3, 0.0, "v02999", None, None)],
                                 "row_id long, x double, big string, one string, small string")
    m = PR.fit_prep(train, ["x"], ["big", "one", "small"])
    assert m.sizes == {"big": 3000, "one": 1, "small": 2}
    with pytest.raises(ValueError, match="use vectors"):
        PR.feature_columns(m)
    v = {r["row_id"]: r["features"] for r in PR.encode_features(m, test, keep=["row_id"]).collect()}
    assert {v[i].size for i in v} == {1 + 2999 + 1}
    active = lambda x: {int(i): float(x[int(i)]) for i in range(x.size) if x[int(i)]}
    assert active(v[1]) == {0: 0.5, 3000: 1.0}          # first category of big: no entry
    assert active(v[2]) == {0: 1499.5}                  # median; unknown values: no entry
    assert active(v[3]) in ({2999: 1.0}, {2999: 1.0, 3000: 1.0})
    assert active(v[3]) == {2999: 1.0}                  # the mode of small is s0 (ties: smaller), its first category


def test_prep_learns_on_train_only_and_unknown_is_zero(spark):
    train = spark.createDataFrame([(1, 1.0, "a", True), (2, None, "b", False), (3, 3.0, None, True)],
                                  "row_id long, x double, c string, f boolean")
    test = spark.createDataFrame([(4, None, "zz", False)], "row_id long, x double, c string, f boolean")
    roles = PR.feature_roles(train.schema, exclude=["row_id"])
    assert roles == {"x": "numeric", "c": "categorical", "f": "categorical"}
    m = PR.fit_prep(train, ["x"], ["c", "f"])
    assert m.vocabulary() == {"c": ["a", "b"], "f": ["0", "1"]}
    out = PR.apply_prep(m, test, keep=["row_id"]).first().asDict()
    assert out["x"] == 2.0               # median of the training values
    assert out["c_b"] == 0.0             # unknown -> all zeros (first category dropped)
    assert out["f_1"] == 0.0
    assert PR.feature_columns(m) == ["x", "c_b", "f_1"]
    filled = PR.apply_prep(PR.fit_prep(train, [], ["c"], one_hot=False), train, keep=["row_id"])
    assert {r["row_id"]: r["c"] for r in filled.collect()}[3] == "a"   # mode, smallest on tie


def test_random_configs_distinct_and_capped(spark):
    space = {"a": [1, 2, 3], "b": ["x", None]}
    df = TR.random_configs(spark, space, 10, 42)
    rows = df.collect()
    assert len(rows) == 6 and len({(r["a"], r["b"]) for r in rows}) == 6
    with pytest.raises(ValueError):
        TR.random_configs(spark, space, 0)
    studies = spark.range(50).withColumnRenamed("id", "s")
    per = TR.random_configs(spark, space, 4, 42, studies, ["s"])
    assert per.count() == 200
    assert per.groupBy("s").agg(F.count_distinct("config_index").alias("n")).where("n != 4").count() == 0


@pytest.mark.parametrize("grid", [1, 2, 3, 7, 106, 211, 432, 1009])
def test_permutation_of_any_grid(spark, grid):
    j = spark.range(grid).withColumn("key", F.lit("k"))
    got = [r[0] for r in j.select(TR._permuted(F.col("id"), grid, F.col("key"))).collect()]
    assert sorted(got) == list(range(grid))
    if grid > 100:
        assert sum(a + 1 == b for a, b in zip(got, got[1:])) < grid / 10      # no run of neighbours, as a fixed step has


def test_random_configs_are_uniform(spark):
    """Chi-square over 4000 studies: each cell as first draw, and each pair of first draws."""
    studies = spark.range(4000).withColumnRenamed("id", "s")
    space = {"a": [1, 2, 3, 4, 5], "b": [1, 2, 3, 4, 5, 6, 7]}
    rows = TR.random_configs(spark, space, 2, 42, studies, ["s"]).select("s", "config_rank", "config_index").collect()
    first = {r["s"]: r["config_index"] for r in rows if r["config_rank"] == 1}
    second = {r["s"]: r["config_index"] for r in rows if r["config_rank"] == 2}
    count = lambda values, n: [sum(v == i for v in values) for i in range(n)]     # noqa: E731
    chi2 = lambda seen: sum((o - sum(seen) / len(seen)) ** 2 / (sum(seen) / len(seen)) for o in seen)
    assert chi2(count(first.values(), 35)) < 65.2 and chi2(count(second.values(), 35)) < 65.2    # 34 degrees, 0.1 %
    # the step from the first to the second draw takes every value (a fixed walk has one per study)
    steps = count([(second[s] - first[s]) % 35 for s in first], 35)[1:]
    assert min(steps) > 0 and chi2(steps) < 63.9                                                # 33 degrees, 0.1 %


def test_sample_space_ranges(spark):
    space = {"n": {"type": "integer", "low": 3, "high": 5},
             "lr": {"type": "real", "low": 0.01, "high": 0.2, "prior": "log-uniform"},
             "c": {"type": "categorical", "values": ["p", "q"]}}
    r = TR.sample_space(spark, space, 500, 1).agg(F.min("n"), F.max("n"), F.min("lr"), F.max("lr"),
                                                  F.count_distinct("c")).first()
    assert (r[0], r[1]) == (3, 5) and 0.01 <= r[2] < r[3] <= 0.2 and r[4] == 2
    with pytest.raises(ValueError, match="no known type"):
        TR.sample_space(spark, {"z": {"type": "weird"}}, 3)


def test_default_and_space_tables(spark):
    d = {(r["model"], r["param"]): r["value"] for r in TR.default_configs(spark).collect()}
    assert d[("random_forest", "max_depth")] is None and d[("xgboost", "max_depth")] == "6"
    st = TR.space_table(spark)
    assert st.where("kind = 'discrete'").count() == 11 and st.where("kind = 'real'").count() == 3


def test_incumbents_keep_earliest_on_ties(spark):
    t = spark.createDataFrame([(1, 1, None), (1, 2, 0.5), (1, 3, 0.5), (1, 4, 0.7), (1, 5, float("nan"))],
                              "run int, iteration int, objective_score double")
    got = [(r["best_so_far"], r["incumbent_iteration"])
           for r in TR.incumbents(t, ["run"], bucket_size=2).orderBy("iteration").collect()]
    assert got == [(None, None), (0.5, 2), (0.5, 2), (0.7, 4), (0.7, 4)]
    b = TR.best_trial(t, ["run"], carry=()).first()
    assert (b["iteration"], b["error"]) == (4, None)
    none = spark.createDataFrame([(2, 1, None)], "run int, iteration int, objective_score double")
    assert TR.best_trial(none, ["run"], carry=()).first()["error"]


def test_objective_score_rules(spark):
    t = spark.createDataFrame([(0.8, 0.1, None), (None, 0.1, 0.2)],
                              "mean_balanced_accuracy double, mean_demographic_parity_difference double, "
                              "mean_equal_opportunity_difference double")
    got = [r["objective_score"] for r in TR.objective_score(t, "mean_balanced_accuracy", 0.5).collect()]
    assert got[0] == pytest.approx(0.75) and got[1] == float("-inf")
    with pytest.raises(ValueError):
        TR.objective_score(t, "accuracy")


def test_bucketed_incumbents_and_numbering_equal_plain(spark):
    t = fx.trials_fx(spark, SF_MID)
    a = TR.incumbents(t, ["run_id"], bucket_size=8)
    b = TR.incumbents(t, ["run_id"], bucket_size=None)
    assert sorted(a.collect()) == sorted(b.collect())
    ev = spark.read.parquet(f"{SF_MID}/events.parquet").select(F.col("user_id").alias("run_id"), "event_id", "ts")
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).cast("long")
    x = TR.number_trials(ev, ["run_id"], ["ts", "event_id"], bucket=hour)
    y = TR.number_trials(ev, ["run_id"], ["ts", "event_id"])
    assert sorted(x.collect()) == sorted(y.collect())
    first = x.join(t.select("run_id", "event_id", "iteration").withColumnRenamed("iteration", "ref"),
                   ["run_id", "event_id"])
    assert first.where("iteration != ref").count() == 0
