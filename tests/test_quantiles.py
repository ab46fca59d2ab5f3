import pytest
from pyspark.sql import functions as F

from evalframe.operators.quantiles import exact_quantiles, mode
from evalframe.plans import fixtures as fx
from tests.conftest import SF_MID


@pytest.mark.parametrize("accuracy", [10000, 50])
def test_exact_quantiles_equal_spark_percentile(spark, accuracy):
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet")
    ours = exact_quantiles(li, ["l_returnflag"], "l_extendedprice", [0.25, 0.5, 0.75, 0.9], accuracy=accuracy)
    ref = li.groupBy("l_returnflag").agg(*[F.percentile("l_extendedprice", p).alias(n) for p, n in
                                           ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.9, "q90"))])
    a = {r["l_returnflag"]: r for r in ours.collect()}
    b = {r["l_returnflag"]: r for r in ref.collect()}
    assert set(a) == set(b)
    for k in a:
        for n in ("q25", "q50", "q75", "q90"):
            assert a[k][n] == pytest.approx(b[k][n], rel=1e-12)


def test_exact_quantiles_heavy_ties_and_global_group(spark):
    # l_quantity has 50 distinct values over 60k rows: every bracket is all ties
    li = spark.read.parquet(f"{SF_MID}/lineitem.parquet")
    a = exact_quantiles(li, [], "l_quantity", [0.5, 0.33], names=["m", "t"], accuracy=20).first()
    b = li.agg(F.median("l_quantity").alias("m"), F.percentile("l_quantity", 0.33).alias("t")).first()
    assert (a["m"], a["t"]) == pytest.approx((b["m"], b["t"]))
    empty = spark.createDataFrame([("g", None)], "k string, v double")
    assert exact_quantiles(empty, ["k"], "v", [0.5]).first()["q50"] is None


def test_mode_smallest_on_ties(spark):
    f = fx.features_fx(spark, SF_MID)
    ours = mode(f, [], "cat_a").first()["mode"]
    ref = f.agg(F.mode("cat_a", deterministic=True)).first()[0]
    assert ours == ref
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "v string")
    assert mode(df, [], "v").first()["mode"] == "a"


def test_exact_quantiles_small_groups(spark):
    rows = [("a", 1.0), ("a", 5.0), ("a", 3.0), ("b", 2.0), ("c", 7.0), ("c", 7.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["q90"], r["q50"]) for r in exact_quantiles(df, ["k"], "v", [0.9, 0.5], accuracy=1).collect()}
    ref = {r["k"]: (r["a"], r["b"]) for r in df.groupBy("k").agg(
        F.percentile("v", 0.9).alias("a"), F.percentile("v", 0.5).alias("b")).collect()}
    assert set(got) == set(ref)
    for k in ref:
        assert got[k] == pytest.approx(ref[k])


@pytest.mark.parametrize("accuracy", [200, 10000])
def test_exact_quantiles_at_every_size(spark, accuracy):
    # group g has about 3^g rows: some take the narrowest bracket, some all of the group, some one in between
    df = spark.range(1, 200_000).select(F.floor(F.log(F.col("id").cast("double")) / F.log(F.lit(3.0))).alias("k"),
                                        F.when(F.col("id") % 50 > 0, F.exp(F.randn(7) * 5)).alias("v"))
    df = df.unionByName(spark.createDataFrame([(99, float("nan")), (99, None)], "k long, v double"))
    probs = [0.0, 0.001, 0.5, 0.75, 1.0]
    ours = exact_quantiles(df, ["k"], "v", probs, names=list("abcde"), accuracy=accuracy, carry=[F.count(F.lit(1)).alias("n")])
    ref = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[
        F.percentile(F.when(~F.isnan("v"), F.col("v")), p).alias(c) for p, c in zip(probs, "abcde")])
    a, b = ({r["k"]: r for r in x.collect()} for x in (ours, ref))
    assert set(a) == set(b)
    for k in b:
        assert a[k]["n"] == b[k]["n"]
        for c in "abcde":
            assert a[k][c] == (None if b[k][c] is None else pytest.approx(b[k][c], rel=1e-12))


def test_exact_quantiles_neither_cache_nor_checkpoint(spark):
    q = exact_quantiles(spark.range(1000).selectExpr("id % 3 as k", "rand(1) as v"), ["k"], "v", [0.5])
    text = q._jdf.queryExecution().analyzed().toString()
    assert "InMemoryRelation" not in text and "LogicalRDD" not in text
