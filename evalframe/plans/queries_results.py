"""Checked queries over fold-level experiment results: summaries, outliers,
chart data, paired joins and paired tests.  The oracles use self-joins and
unsplit windows, the library uses conditional aggregation and ranks by ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from evalframe.functions.columns import nan_to_null
from evalframe.functions.pvalues import t_pvalue_udf
from evalframe.operators import pairs as PA
from evalframe.operators import summary as S
from evalframe.operators.fairness import fairness_dim
from evalframe.plans import fixtures as fx
from evalframe.plans.catalog import register, round_doubles, round_sql

RES = fx.RESULTS_FX_SQL
RES_S = fx.RESULTS_STUDY_FX_SQL
DIMS = ["dataset", "model", "optimizer"]
ALL = list(S.ALL_METRICS)
PERF = list(S.PERFORMANCE_METRICS)
FAIR = list(S.FAIRNESS_METRICS)
STAT_SQL = {"count": "cast(count({v}) as bigint)", "mean": "avg({v})", "std": "stddev_samp({v})",
            "median": "median({v})", "min": "min({v})", "max": "max({v})"}


def _doubles(cols):
    return [c for c in cols if not c.endswith("_count")]


_SUMMARY_COLS = [f"{m}_{s}" for m in ALL for s in S.STATS]


@register("summary", round_sql(f"""
select study, dataset, model, optimizer,
  {', '.join(STAT_SQL[s].format(v=m) + f' as {m}_{s}' for m in ALL for s in S.STATS)}
from ({RES_S}) r group by all""", _doubles(_SUMMARY_COLS)))
def q_summary(spark, sf):
    return round_doubles(S.summarize(fx.results_fx(spark, sf, study=True), ["study"] + DIMS))


def _fair_dim(spark):
    return fairness_dim(spark, fx.RESULTS_FAIRNESS_DIM)


_FS_COLS = [f"{m}_{s}" for m in FAIR for s in S.STATS]
_FS_SQL = f"""
select dataset, model, optimizer, dataset = 'A' as fairness_applicable,
  case when dataset = 'A' then 'Configured (Sensitive Attribute: sensitive)'
       else 'Not Configured (Sensitive Attribute: None)' end as fairness_status,
  case when dataset = 'A' then 'Valid fairness metric computed against sensitive attribute ''sensitive''.'
       else 'Metric value 0.0 reflects lack of sensitive attribute tracking, NOT proof of absence of bias.' end
    as methodology_note,
  {', '.join(
      (f"cast(case when dataset = 'A' then count({m}) else count(*) end as bigint) as {m}_count" if s == 'count'
       else STAT_SQL[s].format(v=f"case when dataset = 'A' then {m} end") + f' as {m}_{s}')
      for m in FAIR for s in S.STATS)}
from ({RES}) r group by dataset, model, optimizer"""


@register("fairness_summary", round_sql(_FS_SQL, _doubles(_FS_COLS)))
def q_fairness_summary(spark, sf):
    return round_doubles(S.fairness_summary(fx.results_fx(spark, sf), _fair_dim(spark)))


_Q_SQL = f"""
q as (select dataset, model, optimizer, cast(count(*) as bigint) as count, avg(runtime_seconds) as m,
        stddev_samp(runtime_seconds) as sd, median(runtime_seconds) as med, min(runtime_seconds) as mn,
        max(runtime_seconds) as mx, quantile_cont(runtime_seconds, 0.25) as q1,
        quantile_cont(runtime_seconds, 0.75) as q3
      from ({RES}) r group by all),
qq as (select *, q3 - q1 as iqr, q3 + 1.5 * (q3 - q1) as ub, q1 - 1.5 * (q3 - q1) as lb from q)"""
_RP_COLS = ["mean_seconds", "std_seconds", "median_seconds", "min_seconds", "max_seconds", "q1_seconds",
            "q3_seconds", "iqr_seconds", "upper_bound_seconds"]


@register("runtime_profile", round_sql(f"""
with {_Q_SQL},
o as (select r.dataset, r.model, r.optimizer, cast(sum(case when r.runtime_seconds > qq.ub then 1 else 0 end) as bigint)
        as outlier_count from ({RES}) r join qq using (dataset, model, optimizer) group by all)
select qq.dataset, qq.model, qq.optimizer, qq.count, m as mean_seconds, sd as std_seconds, med as median_seconds,
       mn as min_seconds, mx as max_seconds, q1 as q1_seconds, q3 as q3_seconds, iqr as iqr_seconds,
       ub as upper_bound_seconds, o.outlier_count
from qq join o using (dataset, model, optimizer)""", _RP_COLS))
def q_runtime_profile(spark, sf):
    return round_doubles(S.runtime_profile(fx.results_fx(spark, sf)))


_EXTREME_SQL = "r.dataset = 'A' and r.model = 'xgboost' and r.optimizer = 'bayesian' and r.outer_fold = 5"


@register("iqr_outliers", round_sql(f"""
with {_Q_SQL}
select r.dataset, r.model, r.optimizer, r.outer_fold, r.runtime_seconds, qq.q3 as group_q3, qq.iqr as group_iqr,
  qq.ub as iqr_upper_bound, case when qq.ub > 0 then r.runtime_seconds / qq.ub end as exceeds_upper_bound_ratio,
  case when {_EXTREME_SQL} then 'Extreme Runtime Outlier' else 'Runtime Outlier' end as anomaly_category,
  coalesce({_EXTREME_SQL}, false) as is_extreme,
  case when {_EXTREME_SQL}
    then 'Extreme runtime observation of ' || printf('%.3f', r.runtime_seconds) || 's (~'
         || printf('%.2f', r.runtime_seconds / 3600.0) || 'h) substantially exceeding IQR threshold ('
         || printf('%.3f', qq.ub) || 's).'
    else 'Runtime of ' || printf('%.3f', r.runtime_seconds) || 's exceeds IQR upper bound ('
         || printf('%.3f', qq.ub) || 's).' end as description
from ({RES}) r join qq using (dataset, model, optimizer) where r.runtime_seconds > qq.ub""",
    ["group_q3", "group_iqr", "iqr_upper_bound", "exceeds_upper_bound_ratio"]))
def q_iqr_outliers(spark, sf):
    extreme = ((F.col("dataset") == "A") & (F.col("model") == "xgboost")
               & (F.col("optimizer") == "bayesian") & (F.col("outer_fold") == 5))
    out = S.iqr_outliers(fx.results_fx(spark, sf), extreme=extreme)
    return round_doubles(out)


def _unpivot_sql(src, ids, metrics):
    return (f"(select {', '.join(ids)}, metric, value from (select {', '.join(ids)}, "
            f"{', '.join(f'cast({m} as double) as {m}' for m in metrics)} from ({src}) s0) s1 "
            f"unpivot include nulls (value for metric in ({', '.join(metrics)})))")


def _compare_sql(factor, left, right):
    cmp_metrics = PERF + ["runtime_seconds"]
    lv = f"case when {factor} = '{left}' then value end"
    rv = f"case when {factor} = '{right}' then value end"
    return f"""
select dataset, metric, avg({lv}) as {left}_mean, stddev_samp({lv}) as {left}_std, median({lv}) as {left}_median,
  avg({rv}) as {right}_mean, stddev_samp({rv}) as {right}_std, median({rv}) as {right}_median,
  avg({rv}) - avg({lv}) as diff_mean, median({rv}) - median({lv}) as diff_median
from {_unpivot_sql(RES, ['dataset', factor], cmp_metrics)} u group by dataset, metric"""


_CMP_COLS = ["{l}_mean", "{l}_std", "{l}_median", "{r}_mean", "{r}_std", "{r}_median", "diff_mean", "diff_median"]


@register("compare_models", round_sql(_compare_sql("model", "random_forest", "xgboost"),
                                      [c.format(l="random_forest", r="xgboost") for c in _CMP_COLS]))
def q_compare_models(spark, sf):
    return round_doubles(S.compare_methods(fx.results_fx(spark, sf), "model", "random_forest", "xgboost"))


@register("compare_optimizers", round_sql(_compare_sql("optimizer", "random", "bayesian"),
                                          [c.format(l="random", r="bayesian") for c in _CMP_COLS]))
def q_compare_optimizers(spark, sf):
    return round_doubles(S.compare_methods(fx.results_fx(spark, sf), "optimizer", "random", "bayesian"))


@register("bar_data", round_sql(f"""
select dataset, model, metric, cast(count(value) as bigint) as n, avg(value) as mean, stddev_samp(value) as sd
from {_unpivot_sql(RES, ['dataset', 'model'], PERF)} u group by all""", ["mean", "sd"]))
def q_bar_data(spark, sf):
    return round_doubles(S.bar_data(fx.results_fx(spark, sf), "dataset", "model", PERF))


@register("box_data", round_sql(f"""
with {_Q_SQL},
w as (select r.dataset, r.model, r.optimizer,
        min(case when r.runtime_seconds between qq.lb and qq.ub then r.runtime_seconds end) as whisker_low,
        max(case when r.runtime_seconds between qq.lb and qq.ub then r.runtime_seconds end) as whisker_high,
        cast(sum(case when r.runtime_seconds between qq.lb and qq.ub then 0 else 1 end) as bigint) as n_outside
      from ({RES}) r join qq using (dataset, model, optimizer) group by all)
select qq.dataset, qq.model, qq.optimizer, qq.count, q1, med as median, q3, iqr, lb as lower_bound,
       ub as upper_bound, whisker_low, whisker_high, n_outside
from qq join w using (dataset, model, optimizer)""", ["q1", "median", "q3", "iqr", "lower_bound", "upper_bound"]))
def q_box_data(spark, sf):
    return round_doubles(S.box_data(fx.results_fx(spark, sf), DIMS, "runtime_seconds"))


@register("scatter_data", round_sql(f"""
select dataset, model, optimizer, outer_fold, runtime_seconds as value,
  case when runtime_seconds > 0 then log10(runtime_seconds) end as log10_value,
  dataset || chr(10) || model || chr(10) || '(' || optimizer || ')' as group_label
from ({RES}) r""", ["log10_value"]))
def q_scatter_data(spark, sf):
    return round_doubles(S.scatter_data(fx.results_fx(spark, sf)))


# --- pairs and tests ----------------------------------------------------------

@register("paired_join", f"""
with u as {_unpivot_sql(RES_S, ['study', 'dataset', 'model', 'optimizer', 'outer_fold'], ALL)}
select l.study, l.metric, l.dataset, l.optimizer, l.outer_fold, l.value as left_value, r.value as right_value
from u l join u r on l.study = r.study and l.metric = r.metric and l.dataset = r.dataset
  and l.optimizer = r.optimizer and l.outer_fold = r.outer_fold
where l.model = 'random_forest' and r.model = 'xgboost'
  and l.value is not null and r.value is not null and not isnan(l.value) and not isnan(r.value)""")
def q_paired_join(spark, sf):
    return PA.paired(fx.results_fx(spark, sf, study=True), "model", "random_forest", "xgboost",
                     ["dataset", "optimizer", "outer_fold"], ALL, ["study"])


def _pairs_sql(src, study):
    s = "study, " if study else ""
    u = _unpivot_sql(src, ([f"study"] if study else []) + ["dataset", "model", "optimizer", "outer_fold"], ALL)
    fair = ", ".join(f"'{m}'" for m in FAIR)
    parts = []
    for factor, left, right, other in (("model", "random_forest", "xgboost", "optimizer"),
                                       ("optimizer", "random", "bayesian", "model")):
        on = " and ".join(f"l.{k} = r.{k}" for k in (["study"] if study else []) + ["metric", "dataset", other,
                                                                                       "outer_fold"])
        parts.append(f"""
select {'l.study, ' if study else ''}case when l.metric in ({fair}) then 'fairness_{factor}' else '{factor}' end
         as comparison, l.metric, '{left}' as left_method, '{right}' as right_method,
       l.dataset as pair_dataset, '{other}' as other_name, l.value as left_value, r.value as right_value
from u l join u r on {on}
where l.{factor} = '{left}' and r.{factor} = '{right}' and (l.metric not in ({fair}) or l.dataset = 'A')
  and l.value is not null and r.value is not null and not isnan(l.value) and not isnan(r.value)""")
    return f"""u as {u},
p as ({' union all '.join(parts)}),
sp as (select {s}comparison, 'all_datasets' as scope, metric, left_method, right_method,
              'dataset + ' || other_name || ' + outer_fold' as pairing, left_value, right_value
       from p where comparison in ('model', 'optimizer')
       union all
       select {s}comparison, pair_dataset as scope, metric, left_method, right_method,
              other_name || ' + outer_fold' as pairing, left_value, right_value from p),
f as (select * from sp where isfinite(left_value) and isfinite(right_value))"""


_TK = "comparison, scope, metric, left_method, right_method, pairing"


def _tests_sql(src, study, with_w=True):
    s = "study, " if study else ""
    tk = s + _TK
    on = " and ".join(f"t.{k.strip()} = w.{k.strip()}" for k in tk.split(","))
    w_cte = f""",
d as (select {tk}, round(right_value - left_value, 12) as d from f),
nz as (select {tk}, d, abs(d) as a from d where d != 0),
rk as (select *, rank() over (partition by {tk} order by a)
                 + cast(count(*) over (partition by {tk}, a) - 1 as double) / 2 as r from nz),
w as (select {tk}, count(*) as m, least(sum(case when d > 0 then r else 0 end),
                                        sum(case when d < 0 then r else 0 end)) as w from rk group by all)"""
    return f"""with {_pairs_sql(src, study)},
t as (select {tk}, cast(count(*) as bigint) as n, avg(left_value) as mean_left, avg(right_value) as mean_right,
        avg(right_value - left_value) as mean_difference, median(right_value - left_value) as median_difference,
        stddev_samp(right_value - left_value) as sd from f group by all){w_cte if with_w else ''}
select t.*, case when n >= 2 and sd > 0 then (cast(0 as double) - mean_difference) / (sd / sqrt(n)) end
    as t_statistic,
  case when n >= 2 and sd > 0 then mean_difference / sd end as cohens_dz
  {', case when w.m is null then 0.0 when w.m >= 2 then w.w end as wilcoxon_statistic' if with_w else ''}
from t {f'left join w on {on}' if with_w else ''}"""


_T_DOUBLES = ["mean_left", "mean_right", "mean_difference", "median_difference", "t_statistic", "cohens_dz"]


# the oracles round differences to 12 decimals, as engines add doubles in different orders
TIES = 12


def _families(spark, sf, study=True):
    r = fx.results_fx(spark, sf, study=study)
    return PA.comparison_pairs(r, F.col("dataset") == "A", ["study"] if study else [])


_TKEYS = ["study"] + list(PA.TEST_KEYS)


@register("paired_summary", round_sql(f"""
select study, {_TK}, n, mean_left, mean_right, mean_difference, median_difference
from ({_tests_sql(RES_S, True, False)}) x""", _T_DOUBLES[:4]))
def q_paired_summary(spark, sf):
    s = PA.paired_summary(_families(spark, sf), _TKEYS)
    return round_doubles(s.select(*_TKEYS, "n", "mean_left", "mean_right", "mean_difference", "median_difference"))


@register("paired_t", round_sql(f"select study, {_TK}, n, t_statistic from ({_tests_sql(RES_S, True, False)}) x",
                                ["t_statistic"]))
def q_paired_t(spark, sf):
    return round_doubles(PA.paired_summary(_families(spark, sf), _TKEYS).select(*_TKEYS, "n", "t_statistic"))


@register("cohens_dz", round_sql(f"select study, {_TK}, cohens_dz from ({_tests_sql(RES_S, True, False)}) x",
                                 ["cohens_dz"]))
def q_cohens_dz(spark, sf):
    return round_doubles(PA.paired_summary(_families(spark, sf), _TKEYS).select(*_TKEYS, "cohens_dz"))


@register("wilcoxon_w", f"select study, {_TK}, wilcoxon_statistic from ({_tests_sql(RES_S, True, True)}) x")
def q_wilcoxon_w(spark, sf):
    return PA.wilcoxon(_families(spark, sf), _TKEYS, TIES).select(*_TKEYS, "wilcoxon_statistic")


@register("comparison_families", round_sql(f"""
select {_TK}, n, mean_left, mean_right, mean_difference, median_difference, t_statistic, wilcoxon_statistic, cohens_dz
from ({_tests_sql(RES, False, True)}) x""", _T_DOUBLES))
def q_comparison_families(spark, sf):
    t = PA.run_comparisons(fx.results_fx(spark, sf), F.col("dataset") == "A", tie_decimals=TIES)
    return round_doubles(t.drop("t_pvalue", "wilcoxon_pvalue"))


# Student's t for whole degrees of freedom: the finite cosine series of its distribution function
_T_TAIL_SQL = f"""
with t as (select study, {_TK}, n, t_statistic as t from ({_tests_sql(RES_S, True, False)}) x),
a as (select *, n - 1 as df, atan(abs(t) / sqrt(n - 1)) as x from t),
b as (select *, case when df % 2 = 1
    then 2 / pi() * (x + sin(x) * coalesce(list_sum(list_transform(range(0, (df - 1) // 2), lambda j:
           sqrt(pi()) / 2 * exp(lgamma(j + 1.0::double) - lgamma(j + 1.5::double)) * pow(cos(x), 2 * j + 1))), 0))
    else sin(x) * list_sum(list_transform(range(0, df // 2), lambda j:
           exp(lgamma(j + 0.5::double) - lgamma(j + 1.0::double)) / sqrt(pi()) * pow(cos(x), 2 * j))) end as inner_mass
  from a)
select study, {_TK}, n, 1 - inner_mass as t_pvalue from b"""


@register("t_pvalues", round_sql(_T_TAIL_SQL, ["t_pvalue"]))
def q_t_pvalues(spark, sf):
    """T3 per test and study."""
    t = PA.paired_summary(_families(spark, sf), _TKEYS)
    p = t_pvalue_udf(F.col("t_statistic"), (F.col("n") - 1).cast("double"))
    return round_doubles(t.select(*_TKEYS, "n", nan_to_null(p).alias("t_pvalue")))


# exact tests: the number of sign assignments per rank sum, one rank after the other; the others:
# the normal tail by the series of the error function
_W_TAIL_SQL = f"""
with recursive {_pairs_sql(RES_S, True)},
d as (select study, {_TK}, round(right_value - left_value, 12) as d from f),
tests as (select row_number() over () as tid, x.* from (
  select study, {_TK}, count(*) as n, count(*) filter (d != 0) as m from d group by all) x),
rk as (select tid, d, cast(2 * rank() over (partition by tid order by abs(d)) as bigint)
                      + count(*) over (partition by tid, abs(d)) - 1 as r2
       from d join tests using (study, {_TK}) where d != 0),
w as (select tid, least(sum(r2) filter (d > 0), sum(r2) filter (d < 0), coalesce(sum(r2) filter (d > 0), 0),
                        coalesce(sum(r2) filter (d < 0), 0)) as w2 from rk group by tid),
ties as (select tid, sum(c * c * c - c) as tie_term, max(c) > 1 as tied from (
  select tid, r2, count(*)::double as c from rk group by tid, r2) x group by tid),
t as (select tests.*, w2, tie_term, (n = m and not tied and n <= 50) or n <= 13 as exact
      from tests left join w using (tid) left join ties using (tid)),
ranks as (select tid, r2, row_number() over (partition by tid order by r2) as i from rk join t using (tid) where exact and m >= 2),
dp as (
  select tid, 0::bigint as i, 0::bigint as s, 1::double as c from t where exact and m >= 2
  union all
  select tid, i, s, sum(c) from (
    select dp.tid, ranks.i, dp.s + x * ranks.r2 as s, dp.c from dp join ranks on ranks.tid = dp.tid and ranks.i = dp.i + 1
    cross join (values (0::bigint), (1::bigint)) sign(x)) step group by tid, i, s),
exact_p as (select t.tid, least(1.0, 2 * sum(c) / pow(2, any_value(m))) as p
            from t join dp on dp.tid = t.tid and dp.i = t.m and dp.s <= t.w2 group by t.tid),
z as (select tid, abs(w2 / 2.0 - m * (m + 1) / 4.0) / sqrt(m * (m + 1) * (2 * m + 1) / 24.0 - tie_term / 48.0) / sqrt(2) as x
      from t where not exact and m >= 2),
normal_p as (select tid, case when x = 0 then 1.0 else 1 - exp(-x * x) * x * list_sum(list_transform(range(0, 300),
               lambda k: exp(2 * k * ln(x) - lgamma(k + 1.5::double)))) end as p from z)
select study, {_TK}, cast(n as bigint) as n,
       cast(case when m = 0 then 1.0 when m >= 2 then coalesce(exact_p.p, normal_p.p) end as double) as wilcoxon_pvalue
from t left join exact_p using (tid) left join normal_p using (tid)"""


@register("wilcoxon_pvalues", round_sql(_W_TAIL_SQL, ["wilcoxon_pvalue"]))
def q_wilcoxon_pvalues(spark, sf):
    """T6 per test and study."""
    pairs = _families(spark, sf)
    n = pairs.groupBy(*_TKEYS).agg(F.count(F.lit(1)).alias("n"))
    return round_doubles(n.join(PA.wilcoxon(pairs, _TKEYS, TIES), _TKEYS).select(*_TKEYS, "n", "wilcoxon_pvalue"))


@register("paired_pvalues", round_sql(f"""
select a.*, b.wilcoxon_pvalue from ({_T_TAIL_SQL}) a
join (select study, {_TK}, wilcoxon_pvalue from ({_W_TAIL_SQL}) w) b using (study, {_TK})""", ["t_pvalue", "wilcoxon_pvalue"]))
def q_paired_pvalues(spark, sf):
    """T3 + T6 per test and study, from one table of paired tests."""
    t = PA.paired_tests(_families(spark, sf), _TKEYS, TIES)
    return round_doubles(t.select(*_TKEYS, "n", "t_pvalue", "wilcoxon_pvalue"))


@register("effect_label", round_sql(f"""
select study, {_TK}, cohens_dz as effect_size, 'Cohen''s dz' as effect_size_name,
  case when cohens_dz is null or isnan(cohens_dz) or isinf(cohens_dz) then 'not estimable'
       when abs(cohens_dz) < 0.2 then 'negligible' when abs(cohens_dz) < 0.5 then 'small'
       when abs(cohens_dz) < 0.8 then 'medium' else 'large' end as effect_interpretation
from ({_tests_sql(RES_S, True, False)}) x""", ["effect_size"]))
def q_effect_label(spark, sf):
    s = PA.paired_summary(_families(spark, sf), _TKEYS)
    return round_doubles(PA.effect_sizes(s, PA.TEST_KEYS))


@register("report_rows")
def q_report_rows(spark, sf):
    """P13 (rows-only: lines carry p-values, which have no SQL oracle)."""
    from evalframe.operators.report import report_rows
    t = PA.run_comparisons(fx.results_fx(spark, sf), F.col("dataset") == "A", tie_decimals=TIES)
    return report_rows(t, PA.effect_sizes(t))
