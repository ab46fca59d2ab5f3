"""Driver-table fixtures (FIXTURES.md part B).

Each fixture is built twice from the same parquet tables: with the DataFrame
API (what the queries run) and as a DuckDB SQL text (what the oracle runs).
Both must give identical values; doubles are produced only by operations that
are exact or correctly rounded in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.sources.tables import read_table


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


# --- B1: predictions over orders x customer --------------------------------

def predictions_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _t(spark, sf_dir, "orders")
    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    is_f = F.col("o_orderstatus") == "F"
    shifted = F.col("o_totalprice") + F.when(is_f, F.lit(100000)).otherwise(F.lit(0))
    prob = F.floor(shifted / 10000).cast("double") / F.lit(100.0)
    o = o.select(F.col("o_orderpriority").alias("run_id"), F.col("o_orderkey").alias("row_id"),
                 F.when(is_f, ">50K").otherwise("<=50K").alias("y_true"),
                 prob.alias("y_prob"), "o_custkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    return j.select("run_id", "row_id", "y_true",
                    F.when(F.col("y_prob") >= 0.3, ">50K").otherwise("<=50K").alias("y_pred"),
                    "y_prob", F.col("c_mktsegment").alias("sensitive"))


PREDICTIONS_FX_SQL = """
select o.run_id, o.row_id, o.y_true,
       case when o.y_prob >= 0.3 then '>50K' else '<=50K' end as y_pred,
       o.y_prob, c.c_mktsegment as sensitive
from (select o_orderpriority as run_id, o_orderkey as row_id, o_custkey,
             case when o_orderstatus = 'F' then '>50K' else '<=50K' end as y_true,
             cast(floor((o_totalprice + case when o_orderstatus = 'F' then 100000 else 0 end) / 10000)
                  as double) / cast(100 as double) as y_prob
      from orders) o
join customer c on o.o_custkey = c.c_custkey
"""


def predictions_fold_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions_fx(spark, sf_dir).withColumn(
        "inner_fold", (F.col("row_id") % 3 + 1).cast("int"))


PREDICTIONS_FOLD_FX_SQL = f"""
select *, cast(row_id % 3 + 1 as integer) as inner_fold from ({PREDICTIONS_FX_SQL}) pf
"""


# --- B2: document predictions, one hot run, unbalanced small groups ---------

def doc_predictions_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = _t(spark, sf_dir, "labels")
    doc = _t(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    j = lab.join(doc, "doc_id")
    return j.select(F.lit("documents").alias("run_id"), F.col("doc_id").alias("row_id"),
                    F.col("quality").alias("y_true"), (F.lit(1) - F.col("toxic")).alias("y_pred"),
                    (F.col("n_chars").cast("double") / F.lit(20000.0)).alias("y_prob"),
                    F.col("lang").alias("sensitive"))


DOC_PREDICTIONS_FX_SQL = """
select 'documents' as run_id, l.doc_id as row_id, l.quality as y_true, 1 - l.toxic as y_pred,
       cast(d.n_chars as double) / cast(20000 as double) as y_prob, d.lang as sensitive
from labels l join documents d on l.doc_id = d.doc_id
"""


# --- B3: fold-level experiment results, 60 rows at every scale --------------

def _exact_avg(c: str) -> F.Column:
    # two-decimal values summed exactly as integer hundredths, then two
    # correctly rounded divisions: the same double in every engine (no
    # decimal rounding: a round at a halfway point differs between engines)
    cents = F.sum(F.round(F.col(c) * 100).cast("long")).cast("double")
    return cents / F.count(F.lit(1)) / F.lit(100.0)


def results_fx(spark: SparkSession, sf_dir: str, study: bool = False) -> DataFrame:
    li = _t(spark, sf_dir, "lineitem")
    dims = [F.col("l_returnflag").alias("dataset"),
            F.when(F.col("l_linestatus") == "F", "random_forest").otherwise("xgboost").alias("model"),
            F.when(F.col("l_linenumber") % 2 == 0, "random").otherwise("bayesian").alias("optimizer"),
            (F.col("l_suppkey") % 5 + 1).cast("int").alias("outer_fold")]
    if study:
        dims = [(F.col("l_partkey") % 16).alias("study")] + dims
    g = li.groupBy(*dims).agg(
        _exact_avg("l_discount").alias("accuracy"),
        _exact_avg("l_tax").alias("balanced_accuracy"),
        (_exact_avg("l_quantity") / F.lit(100.0)).alias("f1"),
        (F.lit(1.0) - _exact_avg("l_discount")).alias("roc_auc"),
        _exact_avg("l_tax").alias("demographic_parity_difference"),
        _exact_avg("l_discount").alias("equal_opportunity_difference"),
        F.sum("l_quantity").alias("runtime_seconds"),
    )
    return g


def _results_sql(study: bool) -> str:
    s = "l_partkey % 16 as study, " if study else ""
    g = "1, 2, 3, 4, 5" if study else "1, 2, 3, 4"
    avg = "cast(sum(cast(round({c} * 100) as bigint)) as double) / count(*) / cast(100 as double)"
    return f"""
select {s}l_returnflag as dataset,
       case when l_linestatus = 'F' then 'random_forest' else 'xgboost' end as model,
       case when l_linenumber % 2 = 0 then 'random' else 'bayesian' end as optimizer,
       cast(l_suppkey % 5 + 1 as integer) as outer_fold,
       {avg.format(c='l_discount')} as accuracy,
       {avg.format(c='l_tax')} as balanced_accuracy,
       {avg.format(c='l_quantity')} / cast(100 as double) as f1,
       cast(1 as double) - {avg.format(c='l_discount')} as roc_auc,
       {avg.format(c='l_tax')} as demographic_parity_difference,
       {avg.format(c='l_discount')} as equal_opportunity_difference,
       sum(l_quantity) as runtime_seconds
from lineitem group by {g}
"""


RESULTS_FX_SQL = _results_sql(False)
RESULTS_STUDY_FX_SQL = _results_sql(True)

# Fairness-applicable datasets of the results fixture (the dimension of P8).
RESULTS_FAIRNESS_DIM = (("A", True, "sensitive", "group_1", "group_0", "1"),)


# --- B4: trials over events -------------------------------------------------

def trials_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    from evalframe.operators.trials import number_trials
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3_600_000_000)).cast("long")
    ev = number_trials(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], bucket=hour)
    return ev.select(F.col("user_id").alias("run_id"), "iteration", F.col("event_id"),
                     F.when(F.col("event_type") == "error", F.lit(None).cast("double"))
                      .otherwise(F.col("value")).alias("objective_score"),
                     F.col("props").alias("params"))


TRIALS_FX_SQL = """
select user_id as run_id,
       cast(row_number() over (partition by user_id order by ts, event_id) as integer) as iteration,
       event_id,
       case when event_type = 'error' then cast(null as double) else value end as objective_score,
       props as params
from events
"""


# --- B5: feature table over part -------------------------------------------

def features_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _t(spark, sf_dir, "part")
    econ = F.when(F.col("p_type").like("ECONOMY%"), F.lit(20)).otherwise(F.lit(0))
    return p.select(
        F.col("p_partkey").alias("row_id"),
        F.when(F.col("p_partkey") % 11 == 0, F.lit(None).cast("int")).otherwise(F.col("p_size")).alias("num_a"),
        F.col("p_retailprice").alias("num_b"),
        F.when(F.col("p_partkey") % 13 == 0, F.lit(None).cast("string")).otherwise(F.col("p_brand")).alias("cat_a"),
        F.col("p_type").alias("cat_b"),
        (F.col("p_partkey") % 2 == 0).alias("flag"),
        F.when(econ + F.col("p_size") > 30, "yes").otherwise("no").alias("y_true"),
    )


FEATURES_FX_SQL = """
select p_partkey as row_id,
       case when p_partkey % 11 = 0 then null else p_size end as num_a,
       p_retailprice as num_b,
       case when p_partkey % 13 = 0 then null else p_brand end as cat_a,
       p_type as cat_b,
       p_partkey % 2 = 0 as flag,
       case when (case when p_type like 'ECONOMY%' then 20 else 0 end) + p_size > 30
            then 'yes' else 'no' end as y_true
from part
"""


# --- B6: dirty labels over customer -----------------------------------------

def dirty_labels_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _t(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("row_id"),
                    F.when(F.col("c_custkey") % 17 == 0, F.lit(None).cast("string"))
                     .otherwise(F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(". "))).alias("label"))


DIRTY_LABELS_FX_SQL = """
select c_custkey as row_id,
       case when c_custkey % 17 = 0 then null else '  ' || c_mktsegment || '. ' end as label
from customer
"""
