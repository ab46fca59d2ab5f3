"""Checked queries: ingest, coercion, quality checks, folds and feature prep."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from evalframe.functions.columns import clean_number, normalize_label
from evalframe.operators import folds as FO
from evalframe.operators import prep as PR
from evalframe.operators import quality as Q
from evalframe.operators.fairness import fairness_dim, flag_fairness, split_sensitive
from evalframe.operators.labels import check_binary, decode_predictions, encode_target, positive_probability
from evalframe.plans import fixtures as fx
from evalframe.plans.catalog import register
from evalframe.session import ensure_checkpoint_dir
from evalframe.sources import ingest as IN
from evalframe.sources.tables import read_table

FEAT = fx.FEATURES_FX_SQL
DIRTY = fx.DIRTY_LABELS_FX_SQL
SEGMENTS_OK = ("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")


def _norm_sql(c):
    return f"regexp_replace(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'), '\\.+$', '')"


@register("normalize_labels", f"select row_id, {_norm_sql('label')} as label from ({DIRTY}) d")
def q_normalize_labels(spark, sf):
    d = fx.dirty_labels_fx(spark, sf)
    return d.select("row_id", normalize_label("label", strip_dots=True).alias("label"))


@register("check_domain", f"""
select label as value, count(*) as n from (select {_norm_sql('label')} as label from ({DIRTY}) d) x
where label is null or label not in ({', '.join(f"'{s}'" for s in SEGMENTS_OK)}) group by label""")
def q_check_domain(spark, sf):
    d = fx.dirty_labels_fx(spark, sf).select(normalize_label("label", strip_dots=True).alias("label"))
    return Q.check_domain(d, "label", SEGMENTS_OK)


def _coerce_src(spark, sf):
    c = read_table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("row_id"),
        F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(". ")).alias("dataset"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("c_acctbal").cast("string")).alias("value"),
        F.lit("missing").alias("unusable"),
        (F.col("c_nationkey") % 5 + 1).cast("string").alias("outer_fold"))


_COERCE_SRC_SQL = """
select c_custkey as row_id, '  ' || c_mktsegment || '. ' as dataset,
       case when c_custkey % 7 = 0 then 'n/a' else cast(c_acctbal as varchar) end as value,
       'missing' as unusable, cast(c_nationkey % 5 + 1 as varchar) as outer_fold
from customer"""


@register("coerce_results", f"""
select row_id, lower(regexp_replace(dataset, '^\\s+|\\s+$', '', 'g')) as dataset,
       try_cast(value as double) as value, try_cast(unusable as double) as unusable,
       cast(outer_fold as integer) as outer_fold
from ({_COERCE_SRC_SQL}) s""")
def q_coerce_results(spark, sf):
    return IN.coerce_results(_coerce_src(spark, sf), ["dataset"], ["value", "unusable"], "outer_fold")


@register("check_metrics", f"""
select metric, n_usable from (
  select 'value' as metric, cast(count(try_cast(value as double)) as bigint) as n_usable from ({_COERCE_SRC_SQL}) a
  union all
  select 'unusable', cast(count(try_cast(unusable as double)) as bigint) from ({_COERCE_SRC_SQL}) b) u
where n_usable = 0""")
def q_check_metrics(spark, sf):
    return IN.check_metrics(_coerce_src(spark, sf), ["value", "unusable"])


@register("ragged_union", """
select c_custkey as id, c_acctbal as acctbal, c_mktsegment as segment from customer
union all by name
select s_suppkey as id, s_acctbal as acctbal, s_name as name from supplier""")
def q_ragged_union(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("acctbal"),
                                                 F.col("c_mktsegment").alias("segment"))
    s = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("acctbal"),
                                                 F.col("s_name").alias("name"))
    return IN.union_results(c, s)


@register("parse_params", """
select event_id, try_cast(json_extract_string(props, '$.k') as double) as k from events""")
def q_parse_params(spark, sf):
    ev = read_table(spark, sf, "events")
    _, cols = IN.parse_params("props", ["k"])
    return ev.select("event_id", cols["k"].alias("k"))


@register("clean_number", """
select event_id,
  case when isfinite(try_cast(t as double)) then try_cast(t as double) end as value_clean
from (select event_id, case when event_type = 'error' then 'n/a' when event_type = 'signup' then 'inf'
                            else cast(value as varchar) end as t from events) e""")
def q_clean_number(spark, sf):
    ev = read_table(spark, sf, "events")
    t = (F.when(F.col("event_type") == "error", "n/a").when(F.col("event_type") == "signup", "inf")
         .otherwise(F.col("value").cast("string")))
    return ev.select("event_id", clean_number(t).alias("value_clean"))


@register("check_shape", """
select * from (
  select 'customer' as dataset, 'rows' as "check", cast(1000 as bigint) as expected,
         cast(count(*) as bigint) as actual from customer
  union all
  select 'customer', 'features', cast(5 as bigint), cast(5 as bigint)) s
where expected != actual""")
def q_check_shape(spark, sf):
    return Q.check_shape(read_table(spark, sf, "customer"), "customer", expected_rows=1000,
                         expected_features=5)


@register("check_dimension", f"""
with found as (select distinct dataset as value from ({fx.RESULTS_FX_SQL}) r),
exp as (select unnest(['A', 'N', 'X']) as value)
select coalesce(f.value, e.value) as value, case when f.value is null then 'missing' else 'unexpected' end as problem
from found f full outer join exp e on f.value = e.value where f.value is null or e.value is null""")
def q_check_dimension(spark, sf):
    return Q.check_dimension(fx.results_fx(spark, sf), "dataset", ["A", "N", "X"])


_ORD_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"


@register("find_duplicates", f"""
with u as (select {_ORD_COLS} from orders union all select {_ORD_COLS} from orders where o_orderkey % 100 = 0),
d as (select o_orderkey, count(*) as dup_count from u group by o_orderkey having count(*) > 1)
select u.*, d.dup_count from u join d on u.o_orderkey = d.o_orderkey""")
def q_find_duplicates(spark, sf):
    o = read_table(spark, sf, "orders").select(*[c.strip() for c in _ORD_COLS.split(",")])
    u = o.unionByName(o.where(F.col("o_orderkey") % 100 == 0))
    return Q.find_duplicates(u, ["o_orderkey"])


GRID = {"dataset": ["A", "N", "R"], "model": ["random_forest", "xgboost"],
        "optimizer": ["random", "bayesian"], "outer_fold": [1, 2, 3, 4, 5, 6]}


@register("check_grid", f"""
with r as ({fx.RESULTS_STUDY_FX_SQL}),
c as (select study, dataset, model, optimizer, outer_fold, count(*) as n from r group by all),
g as (select s.study, d.dataset, m.model, o.optimizer, f.outer_fold
      from (select distinct study from r) s,
           (select unnest(['A', 'N', 'R']) as dataset) d,
           (select unnest(['random_forest', 'xgboost']) as model) m,
           (select unnest(['random', 'bayesian']) as optimizer) o,
           (select unnest([1, 2, 3, 4, 5, 6]) as outer_fold) f)
select coalesce(g.study, c.study) as study, coalesce(g.dataset, c.dataset) as dataset,
       coalesce(g.model, c.model) as model, coalesce(g.optimizer, c.optimizer) as optimizer,
       coalesce(g.outer_fold, c.outer_fold) as outer_fold, cast(coalesce(c.n, 0) as bigint) as n,
       case when g.study is null then 'unexpected' when c.n is null then 'missing' else 'duplicate' end as problem
from g full outer join c on g.study = c.study and g.dataset = c.dataset and g.model = c.model
     and g.optimizer = c.optimizer and g.outer_fold = c.outer_fold
where g.study is null or c.n is null or c.n > 1""")
def q_check_grid(spark, sf):
    return Q.check_grid(fx.results_fx(spark, sf, study=True), GRID, ["study"])


@register("distinct_groups", f"""
select cast(count(*) as bigint) as n_groups from (select distinct dataset, model, optimizer
from ({fx.RESULTS_FX_SQL}) r) d""")
def q_distinct_groups(spark, sf):
    return Q.distinct_groups(fx.results_fx(spark, sf), ["dataset", "model", "optimizer"])


_FEAT_COLS = ["row_id", "num_a", "num_b", "cat_a", "cat_b", "flag", "y_true"]


@register("null_audit", " union all ".join(
    f"select '{c}' as column_name, cast(sum(case when {c} is null"
    f"{' or isnan(' + c + ')' if c == 'num_b' else ''} then 1 else 0 end) as bigint) as n_null from ({FEAT}) f"
    for c in _FEAT_COLS))
def q_null_audit(spark, sf):
    return Q.null_audit(fx.features_fx(spark, sf))


@register("coverage", """
select cast(count(*) as bigint) as planned, cast(count(e.id) as bigint) as completed,
       cast(count(*) - count(e.id) as bigint) as missing
from (select distinct o_orderkey as id from orders) p
left join (select distinct event_id as id from events) e on p.id = e.id""")
def q_coverage(spark, sf):
    plan = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    res = read_table(spark, sf, "events").select(F.col("event_id").alias("id"))
    return Q.coverage(plan, res, ["id"])


@register("value_counts", f"""
with s as (select 'cat_a' as column_name, cast(cat_a as varchar) as value from ({FEAT}) a
           union all select 'cat_b', cast(cat_b as varchar) from ({FEAT}) b
           union all select 'flag', cast(flag as varchar) from ({FEAT}) c),
c as (select column_name, value, count(*) as n from s group by all),
r as (select *, cast(row_number() over (partition by column_name order by n desc, value asc nulls last)
             as integer) as rank from c)
select * from r where rank <= 20""")
def q_value_counts(spark, sf):
    return Q.profile_categoricals(fx.features_fx(spark, sf), ["cat_a", "cat_b", "flag"], k=20)


# --- folds ------------------------------------------------------------------

_W1_SQL = f"""
select row_id, y_true,
  cast((row_number() over (partition by y_true
        order by md5(concat_ws('|', '42', cast(row_id as varchar))), row_id) - 1) % 5 + 1 as integer) as outer_fold
from ({FEAT}) f"""


@register("stratified_folds", _W1_SQL)
def q_stratified_folds(spark, sf):
    return FO.stratified_folds(fx.features_fx(spark, sf), "y_true", "row_id", k=5, seed=42)


@register("fold_membership", f"""
select outer_fold, y_true, cast(count(*) as bigint) as n from ({_W1_SQL}) w group by all""")
def q_fold_membership(spark, sf):
    w = FO.stratified_folds(fx.features_fx(spark, sf), "y_true", "row_id", k=5, seed=42)
    return w.groupBy("outer_fold", "y_true").agg(F.count(F.lit(1)).alias("n"))


@register("fold_store", f"""
select f.row_id, f.num_a, f.cat_b, w.outer_fold from ({FEAT}) f join ({_W1_SQL}) w on f.row_id = w.row_id
where w.outer_fold = 2""")
def q_fold_store(spark, sf):
    """S3 + J1: examples and folds stored in as many buckets, one fold read back and joined."""
    ex = fx.features_fx(spark, sf)
    w = FO.stratified_folds(ex, "y_true", "row_id", k=5, seed=42)
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/folds-{uuid.uuid4().hex}"
    FO.save_folds(w.drop("y_true").withColumn("dataset", F.lit("part")), f"{at}/folds", buckets=8)
    FO.save_rows(ex.select("row_id", "num_a", "cat_b"), f"{at}/examples", buckets=8)
    folds = FO.load_folds(spark, f"{at}/folds", "part", 2)
    return FO.load_rows(spark, f"{at}/examples").join(folds, "row_id").select("row_id", "num_a", "cat_b", "outer_fold")


@register("inner_folds", f"""
with o as ({_W1_SQL}),
x as (select o.row_id, o.y_true, f.f as outer_fold from o, (select unnest([1, 2, 3, 4, 5]) as f) f
      where f.f != o.outer_fold)
select outer_fold, row_id, y_true,
  cast((row_number() over (partition by outer_fold, y_true
        order by md5(concat_ws('|', '42', cast(row_id as varchar))), row_id) - 1) % 3 + 1 as integer) as inner_fold
from x""")
def q_inner_folds(spark, sf):
    o = FO.stratified_folds(fx.features_fx(spark, sf), "y_true", "row_id", k=5, seed=42)
    return FO.inner_folds(o, "y_true", "row_id", 5, 3, 42)


@register("fold_split", f"""
with w as ({_W1_SQL})
select f.row_id, f.num_a, f.cat_b, case when w.outer_fold = 1 then 'test' else 'train' end as split
from ({FEAT}) f join w on f.row_id = w.row_id""")
def q_fold_split(spark, sf):
    ex = fx.features_fx(spark, sf)
    w = FO.stratified_folds(ex, "y_true", "row_id", k=5, seed=42)
    train, test = FO.fold_split(ex.drop("y_true"), w, 1)
    cols = ["row_id", "num_a", "cat_b"]
    return train.select(*cols, F.lit("train").alias("split")).unionByName(
        test.select(*cols, F.lit("test").alias("split")))


# --- feature prep (fit on outer-train of fold 1, apply to every row) -------

def _prep_fit(spark, sf, one_hot):
    ex = fx.features_fx(spark, sf)
    w = FO.stratified_folds(ex, "y_true", "row_id", k=5, seed=42)
    train, _ = FO.fold_split(ex, w, 1)
    model = PR.fit_prep(train, ["num_a", "num_b"], ["cat_a", "cat_b", "flag"], one_hot=one_hot)
    return ex, model


_TRAIN_SQL = f"select f.* from ({FEAT}) f join ({_W1_SQL}) w on f.row_id = w.row_id where w.outer_fold != 1"


@register("impute_median", f"""
with t as ({_TRAIN_SQL}), m as (select median(num_a) as ma, median(num_b) as mb from t)
select row_id, coalesce(cast(num_a as double), ma) as num_a, coalesce(num_b, mb) as num_b
from ({FEAT}) f, m""")
def q_impute_median(spark, sf):
    ex, model = _prep_fit(spark, sf, one_hot=False)
    return PR.apply_prep(model, ex, keep=["row_id"]).select("row_id", "num_a", "num_b")


@register("impute_mode", f"""
with t as ({_TRAIN_SQL}),
c as (select cat_a as v, count(*) as n from t where cat_a is not null group by cat_a),
m as (select v from (select v, row_number() over (order by n desc, v) as r from c) x where r = 1)
select row_id, coalesce(cat_a, m.v) as cat_a from ({FEAT}) f, m""")
def q_impute_mode(spark, sf):
    ex, model = _prep_fit(spark, sf, one_hot=False)
    return PR.apply_prep(model, ex, keep=["row_id"]).select("row_id", "cat_a")


_CAT_A = [f"Brand#{i}" for i in range(1, 26)]
_CAT_B = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@register("one_hot", f"""
with t as ({_TRAIN_SQL}),
c as (select cat_a as v, count(*) as n from t where cat_a is not null group by cat_a),
m as (select v from (select v, row_number() over (order by n desc, v) as r from c) x where r = 1),
g as (select f.*, coalesce(f.cat_a, m.v) as a, (select min(v) from c) as first_a from ({FEAT}) f, m)
select row_id, {', '.join(f"case when a = '{v}' and a != first_a and a in (select v from c) then 1.0::double else 0.0::double end as hot_{v[6:]}" for v in _CAT_A)},
       {', '.join(f"cast(case when cat_b = '{v}' then 1 else 0 end as double) as cat_b_{v}" for v in _CAT_B[1:])},
       cast(case when cast(flag as integer) = 1 then 1 else 0 end as double) as flag_1
from g""")
def q_one_hot(spark, sf):
    ex, model = _prep_fit(spark, sf, one_hot=True)
    out = PR.apply_prep(model, ex, keep=["row_id"])
    # a column for every possible brand: those the training rows lack, and their first one, are all zero
    hot = [(F.col(f"`cat_a_{v}`") if f"cat_a_{v}" in out.columns else F.lit(0.0)).alias(f"hot_{v[6:]}") for v in _CAT_A]
    return out.select("row_id", *hot, *[c for c in out.columns if c.startswith("cat_b_") or c.startswith("flag_")])


_CUST_SQL = """select c_custkey as row_id, c_acctbal as num, c_name as name, c_mktsegment as segment,
    case when c_custkey % 5 = 0 then 'test' else 'train' end as split from customer"""


@register("one_hot_sparse", f"""
with f as ({_CUST_SQL}),
p as (select 1 as c, name as v, row_number() over (order by name) - 1 as pos from (select distinct name from f where split = 'train')
      union all
      select 2, segment, row_number() over (order by segment) - 1 from (select distinct segment from f where split = 'train')),
k as (select count(*) filter (c = 1) as k1, count(*) filter (c = 2) as k2 from p),
e as (select row_id, split, num, a.pos as a, b.pos as b, k1, k2 from f left join p a on a.c = 1 and a.v = f.name
      left join p b on b.c = 2 and b.v = f.segment cross join k)
select row_id, split, k1 - 1 + k2 - 1 + 1 as n_features, num,
       concat_ws(',', case when a > 0 then cast(a as varchar) end, case when b > 0 then cast(k1 - 1 + b as varchar) end) as active
from e""")
def q_one_hot_sparse(spark, sf):
    """M3 + M4 with one category per customer (unseen in the test rows) as sparse vectors."""
    c = read_table(spark, sf, "customer")
    rows = c.select(F.col("c_custkey").alias("row_id"), F.col("c_acctbal").alias("num"), F.col("c_name").alias("name"),
                    F.col("c_mktsegment").alias("segment"),
                    F.when(F.col("c_custkey") % 5 == 0, "test").otherwise("train").alias("split"))
    model = PR.fit_prep(rows.where("split = 'train'"), ["num"], ["name", "segment"])
    out = PR.encode_features(model, rows, keep=["row_id", "split"])
    v = F.from_json(F.to_json(F.struct("features")), "features struct<type: int, size: int, indices: array<int>, values: array<double>>")
    n = 1 + sum(k - 1 for k in model.sizes.values())
    pairs = F.filter(F.arrays_zip(F.col("v.indices").alias("i"), F.col("v.values").alias("x")), lambda p: p["x"] != 0.0)
    # the number is slot 0; the others are indicators
    number = F.coalesce(F.get(F.transform(F.filter(pairs, lambda p: p["i"] == 0), lambda p: p["x"]), 0), F.lit(0.0))
    active = F.array_join(F.transform(F.filter(pairs, lambda p: p["i"] > 0), lambda p: p["i"].cast("string")), ",")
    return out.withColumn("v", v["features"]).select(
        "row_id", "split", F.lit(n).cast("long").alias("n_features"), number.alias("num"), active.alias("active"))


@register("split_sensitive", f"select row_id, num_a, num_b, cat_a, flag, y_true, cat_b as sensitive from ({FEAT}) f")
def q_split_sensitive(spark, sf):
    return split_sensitive(fx.features_fx(spark, sf), "cat_b")


@register("load_examples", f"""
select f.row_id, f.num_a, f.num_b, f.cat_a, f.cat_b, f.flag, t.y_true
from ({FEAT}) f join (select row_id, y_true from ({FEAT}) g) t on f.row_id = t.row_id""")
def q_load_examples(spark, sf):
    ex = fx.features_fx(spark, sf)
    return IN.load_examples(spark, ex.drop("y_true"), ex.select("row_id", "y_true"), key="row_id")


@register("load_examples_positional", """
with f as (select row_number() over (order by o_orderkey) - 1 as row_id, o_custkey, o_totalprice, o_orderdate from orders),
t as (select row_number() over (order by o_orderkey) - 1 as row_id, o_orderstatus as y_true from orders)
select f.row_id, f.o_custkey, f.o_totalprice, t.y_true from f join t using (row_id)""")
def q_load_examples_positional(spark, sf):
    """S1 without a key: rows of two scans are paired by their place (``orders`` is stored by o_orderkey)."""
    o = read_table(spark, sf, "orders")
    return IN.load_examples(spark, o.select("o_custkey", "o_totalprice"), o.select("o_orderstatus"))


@register("encode_target", f"""
with w as ({_W1_SQL}),
m as (select min(y_true) as l0, max(y_true) as l1 from ({FEAT}) f join w using (row_id, y_true) where w.outer_fold != 1)
select w.row_id, case when w.outer_fold = 1 then 'test' else 'train' end as split,
       cast(case when w.y_true = m.l1 then 1 else 0 end as double) as label
from w, m""")
def q_encode_target(spark, sf):
    ex = fx.features_fx(spark, sf)
    w = FO.stratified_folds(ex, "y_true", "row_id", k=5, seed=42)
    train, test = FO.fold_split(ex, w, 1)
    tr, te, _ = encode_target(train, test, [], "y_true", "label")
    return tr.select("row_id", F.lit("train").alias("split"), "label").unionByName(
        te.select("row_id", F.lit("test").alias("split"), "label"))


@register("flag_fairness", f"""
select r.*, r.dataset = 'A' as fairness_applicable,
  case when r.dataset = 'A' then 'Configured (Sensitive Attribute: sensitive)'
       else 'Not Configured (Sensitive Attribute: None)' end as fairness_status,
  case when r.dataset = 'A' then 'Valid fairness metric computed against sensitive attribute ''sensitive''.'
       else 'Metric value 0.0 reflects lack of sensitive attribute tracking, NOT proof of absence of bias.' end
    as methodology_note
from ({fx.RESULTS_FX_SQL}) r""")
def q_flag_fairness(spark, sf):
    dim = fairness_dim(spark, fx.RESULTS_FAIRNESS_DIM)
    return flag_fairness(fx.results_fx(spark, sf), dim)


# --- operators between the tables and the model jobs ---------------------------

_NUMERIC = ["accuracy", "balanced_accuracy", "f1", "roc_auc", "demographic_parity_difference",
            "equal_opportunity_difference", "runtime_seconds"]


@register("write_results", f"select * replace (lower(dataset) as dataset) from ({fx.RESULTS_FX_SQL}) r")
def q_write_results(spark, sf):
    """S2 + S4 + S5: results written as CSV and read back as numbers."""
    at = f"{ensure_checkpoint_dir(spark).rstrip('/')}/results-{uuid.uuid4().hex}"
    results = fx.results_fx(spark, sf)
    back = IN.read_results(spark, IN.write_results(results, at), _NUMERIC)
    return back.select(results.columns)


@register("label_violations", """
with l as (select user_id as run_id, event_type as v from events
           union select user_id, case when event_id % 7 = 0 then 'click' else event_type end from events)
select run_id, count(*) as n_labels from l group by run_id having count(*) != 2""")
def q_label_violations(spark, sf):
    """V8: users whose observed and predicted event types are not exactly two values."""
    ev = read_table(spark, sf, "events")
    preds = ev.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("y_true"),
                      F.when(F.col("event_id") % 7 == 0, "click").otherwise(F.col("event_type")).alias("y_pred"))
    return check_binary(preds, ["run_id"])


@register("decode_predictions", f"""
with p as ({fx.PREDICTIONS_FX_SQL}),
m as (select run_id, min(y_true) as l0, max(y_true) as l1 from p group by run_id)
select p.run_id, p.row_id, case when y_prob >= 0.5 then l1 else l0 end as y_pred, y_prob
from p join m on p.run_id = m.run_id""")
def q_decode_predictions(spark, sf):
    """P5 + P6: model output (class number, probability vector) back to labels and the probability of class 1."""
    from pyspark.ml.functions import array_to_vector
    p = fx.predictions_fx(spark, sf)
    _, _, mapping = encode_target(p.select("run_id", "y_true"), None, ["run_id"], "y_true")
    scored = p.select("run_id", "row_id", F.when(F.col("y_prob") >= 0.5, 1.0).otherwise(0.0).alias("prediction"),
                      array_to_vector(F.array(1.0 - F.col("y_prob"), F.col("y_prob"))).alias("probability"))
    out = positive_probability(decode_predictions(scored, mapping, ["run_id"]))
    return out.select("run_id", "row_id", "y_pred", "y_prob")


_ROLES = {"num_a": "numeric", "num_b": "numeric", "cat_a": "categorical", "cat_b": "categorical", "flag": "categorical"}


@register("feature_roles", " union all ".join(
    f"select '{c}' as name, '{r}' as role, count({c}) as n_values, count(distinct {c}) as n_distinct from ({FEAT}) f"
    for c, r in _ROLES.items()))
def q_feature_roles(spark, sf):
    """The role of each feature column, with its values counted as that role reads them."""
    ex = fx.features_fx(spark, sf)
    roles = PR.feature_roles(ex.schema, exclude=["row_id", "y_true"])
    long = ex.select(*[F.col(c).cast("string").alias(c) for c in roles]).unpivot([], list(roles), "name", "value")
    role = F.element_at(F.create_map(*[F.lit(x) for pair in roles.items() for x in pair]), F.col("name"))
    per = long.groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("name").agg(F.sum(F.when(F.col("value").isNotNull(), F.col("n")).otherwise(0)).cast("long").alias("n_values"),
                                   F.count("value").alias("n_distinct")).select("name", role.alias("role"), "n_values", "n_distinct")
