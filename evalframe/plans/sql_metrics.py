"""DuckDB oracle texts for the metric operators, written independently of
the DataFrame code: plain joins, GROUP BY and unsplit windows."""

from __future__ import annotations

from evalframe.operators.labels import POSITIVE_CANDIDATES


def _k(keys):
    return ", ".join(keys)


def _on(keys, a, b):
    return " and ".join(f"{a}.{k} = {b}.{k}" for k in keys)


def labelled_sql(src: str, keys, numeric: bool) -> str:
    """CTEs: ``src_t`` (canonical text labels), ``pos`` (labels per run), ``j``
    (rows with t_pos / p_pos flags)."""
    k = _k(keys)
    rank_case = " ".join(f"when '{c}' then {i}" for i, c in enumerate(POSITIVE_CANDIDATES, 1))
    unrank_case = " ".join(f"when {i} then '{c}'" for i, c in enumerate(POSITIVE_CANDIDATES, 1))
    num_cols = (", min(case when try_cast(label as double) = 1 then label end) as one_lbl,"
                " arg_max(label, try_cast(label as double)) as max_num") if numeric else ""
    fallback = "max_num" if numeric else "max_text"
    first = "one_lbl, " if numeric else ""
    return f"""
src_t as (select * replace (cast(y_true as varchar) as y_true, cast(y_pred as varchar) as y_pred) from ({src}) s0),
lbl as (select {k}, y_true as label from src_t where y_true is not null
        union select {k}, y_pred as label from src_t where y_pred is not null),
lagg as (select {k}, count(*) as n_labels, min(case label {rank_case} end) as rk,
                max(label) as max_text, min(label) as min_text{num_cols}
         from lbl group by {k}),
pos as (select {k}, n_labels,
               coalesce({first}case rk {unrank_case} end, {fallback}) as positive_label,
               max_text, min_text from lagg),
pos2 as (select {k}, n_labels, positive_label,
                case when positive_label = max_text then min_text else max_text end as negative_label from pos),
j as (select s.*, s.y_true = p.positive_label as t_pos, s.y_pred = p.positive_label as p_pos
      from src_t s join pos2 p on {_on(keys, 's', 'p')})
"""


def _ratio(num, den):
    return f"case when ({den}) != 0 then cast({num} as double) / cast({den} as double) end"


def confusion_cte(keys) -> str:
    k = _k(keys)
    return f"""
conf as (select {k},
  cast(sum(case when t_pos and p_pos then 1 else 0 end) as bigint) as tp,
  cast(sum(case when not t_pos and p_pos then 1 else 0 end) as bigint) as fp,
  cast(sum(case when not t_pos and not p_pos then 1 else 0 end) as bigint) as tn,
  cast(sum(case when t_pos and not p_pos then 1 else 0 end) as bigint) as fn,
  cast(count(*) as bigint) as n
  from j group by {k})
"""


def binary_cte(keys) -> str:
    k = _k(keys)
    tpr = _ratio("tp", "tp + fn")
    tnr = _ratio("tn", "tn + fp")
    return f"""
bin as (select {k}, {_ratio('tp + tn', 'n')} as accuracy,
  case when ({tpr}) is not null and ({tnr}) is not null then (({tpr}) + ({tnr})) / 2
       else coalesce({tpr}, {tnr}) end as balanced_accuracy,
  coalesce({_ratio('2 * tp', '2 * tp + fp + fn')}, 0.0) as f1
  from conf)
"""


def groups_cte(keys) -> str:
    k = _k(keys)
    return f"""
grp as (select {k}, sensitive, cast(count(*) as bigint) as n,
  {_ratio('sum(case when p_pos then 1 else 0 end)', 'count(*)')} as selection_rate,
  {_ratio('sum(case when t_pos and p_pos then 1 else 0 end)', 'sum(case when t_pos then 1 else 0 end)')} as tpr
  from j where sensitive is not null group by {k}, sensitive),
disp as (select {k},
  case when count(selection_rate) >= 2 then max(selection_rate) - min(selection_rate) else 0.0 end
    as demographic_parity_difference,
  case when count(tpr) >= 2 then max(tpr) - min(tpr) else 0.0 end as equal_opportunity_difference
  from grp group by {k})
"""


def auc_cte(keys) -> str:
    k = _k(keys)
    d = "decimal(38,0)"
    return f"""
sc as (select {k}, y_prob, sum(case when t_pos then 1 else 0 end) as pos,
              sum(case when not t_pos then 1 else 0 end) as neg
       from j where y_prob is not null and not isnan(y_prob) group by {k}, y_prob),
rk as (select *, coalesce(sum(neg) over (partition by {k} order by y_prob
                 rows between unbounded preceding and 1 preceding), 0) as neg_below from sc),
tot as (select {k}, sum(cast(pos as {d}) * (cast(neg_below as {d}) * 2 + cast(neg as {d}))) as num,
               sum(pos) as p, sum(neg) as q from rk group by {k}),
miss as (select {k}, sum(case when y_prob is null or isnan(y_prob) then 1 else 0 end) as miss
         from j group by {k}),
auc as (select m.{keys[0]}{''.join(', m.' + x for x in keys[1:])},
  case when m.miss = 0 and t.p > 0 and t.q > 0
       then cast(t.num as double) / cast(cast(t.p as {d}) * cast(t.q as {d}) * 2 as double) end as roc_auc
  from miss m left join tot t on {_on(keys, 'm', 't')})
"""


METRIC_COLS = ("accuracy", "balanced_accuracy", "f1", "roc_auc",
               "demographic_parity_difference", "equal_opportunity_difference")


def evaluate_sql(src: str, keys, numeric: bool) -> str:
    k = _k(keys)
    return f"""with {labelled_sql(src, keys, numeric)}, {confusion_cte(keys)}, {binary_cte(keys)},
{groups_cte(keys)}, {auc_cte(keys)}
select b.{keys[0]}{''.join(', b.' + x for x in keys[1:])}, b.accuracy, b.balanced_accuracy, b.f1, a.roc_auc,
  coalesce(d.demographic_parity_difference, 0.0) as demographic_parity_difference,
  coalesce(d.equal_opportunity_difference, 0.0) as equal_opportunity_difference
from bin b join auc a on {_on(keys, 'b', 'a')} left join disp d on {_on(keys, 'b', 'd')}
"""


def confusion_sql(src, keys, numeric):
    return f"with {labelled_sql(src, keys, numeric)}, {confusion_cte(keys)} select * from conf"


def binary_metrics_sql(src, keys, numeric):
    return f"with {labelled_sql(src, keys, numeric)}, {confusion_cte(keys)}, {binary_cte(keys)} select * from bin"


def roc_auc_sql(src, keys, numeric):
    return f"with {labelled_sql(src, keys, numeric)}, {auc_cte(keys)} select * from auc"


def group_rates_sql(src, keys, numeric):
    return f"with {labelled_sql(src, keys, numeric)}, {groups_cte(keys)} select * from grp"


def disparity_sql(src, keys, numeric, col):
    k = _k(keys)
    return f"""with {labelled_sql(src, keys, numeric)}, {groups_cte(keys)}
select p.{keys[0]}{''.join(', p.' + x for x in keys[1:])}, coalesce(d.{col}, 0.0) as {col}
from pos2 p left join disp d on {_on(keys, 'p', 'd')}"""


def positive_label_sql(src, keys, numeric):
    return f"with {labelled_sql(src, keys, numeric)} select * from pos2"
