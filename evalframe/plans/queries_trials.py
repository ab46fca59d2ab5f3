"""Checked queries: objective score, trial numbering, incumbents, best
trial, random and mixed-space configurations per study, experiment plan."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from evalframe.operators import trials as TR
from evalframe.plans import fixtures as fx
from evalframe.plans.catalog import register, round_doubles, round_sql
from evalframe.session import ensure_checkpoint_dir
from evalframe.sources import ingest as IN
from evalframe.sources.tables import read_table

TRI = fx.TRIALS_FX_SQL
RUN = ["run_id"]


def _objective_src(spark, sf):
    ev = read_table(spark, sf, "events")
    return ev.select(
        "event_id", F.col("user_id").alias("run_id"),
        F.when(F.col("event_type") == "error", F.lit(None).cast("double")).otherwise(F.col("value") / 100)
         .alias("mean_balanced_accuracy"),
        (F.col("value") / 1000).alias("mean_demographic_parity_difference"),
        F.when(F.col("event_type") == "view", F.lit(None).cast("double")).otherwise(-F.col("value") / 2000)
         .alias("mean_equal_opportunity_difference"))


@register("objective_score", """
with e as (select event_id, user_id as run_id,
             case when event_type = 'error' then cast(null as double) else value / 100 end as m,
             value / 1000 as dpd, case when event_type = 'view' then cast(null as double) else -value / 2000 end as eod
           from events)
select event_id, run_id, m as mean_balanced_accuracy, dpd as mean_demographic_parity_difference,
       eod as mean_equal_opportunity_difference,
       case when m is null then cast('-inf' as double)
            else m - 0.5 * (abs(coalesce(dpd, 0.0)) + abs(coalesce(eod, 0.0))) end as objective_score
from e""")
def q_objective_score(spark, sf):
    return TR.objective_score(_objective_src(spark, sf), "mean_balanced_accuracy", 0.5)


@register("number_trials", """
select user_id as run_id, event_id,
       cast(row_number() over (partition by user_id order by ts, event_id) as integer) as iteration from events""")
def q_number_trials(spark, sf):
    ev = read_table(spark, sf, "events").select(F.col("user_id").alias("run_id"), "event_id", "ts")
    return TR.number_trials(ev, RUN, ["ts", "event_id"]).drop("ts")


_VALID = "objective_score is not null and not isnan(objective_score) and objective_score != cast('-inf' as double)"


@register("incumbents", f"""
with t as ({TRI}),
v as (select *, case when {_VALID} then objective_score end as s from t),
p as (select *, max(s) over (partition by run_id order by iteration rows between unbounded preceding and current row)
                  as best_so_far,
                max(s) over (partition by run_id order by iteration rows between unbounded preceding and 1 preceding)
                  as prev from v),
q as (select *, max(case when s is not null and (prev is null or s > prev) then iteration end)
                  over (partition by run_id order by iteration rows between unbounded preceding and current row)
                  as incumbent_iteration from p)
select run_id, iteration, objective_score, best_so_far, incumbent_iteration from q""")
def q_incumbents(spark, sf):
    return TR.incumbents(fx.trials_fx(spark, sf), RUN, bucket_size=16)


@register("best_trial", f"""
with t as ({TRI}),
r as (select *, row_number() over (partition by run_id order by objective_score desc, iteration) as rn
      from t where {_VALID})
select a.run_id, r.iteration, r.objective_score, r.params,
       case when r.run_id is null then 'search did not produce a valid configuration' end as error
from (select distinct run_id from t) a left join (select * from r where rn = 1) r on a.run_id = r.run_id""")
def q_best_trial(spark, sf):
    return TR.best_trial(fx.trials_fx(spark, sf), RUN)


# --- configurations per study (one study per trial run) -----------------------

# a grid of 106 = 2 x 53 cells has no divisor near its root: the permutation walks over 11 x 10
_SPACE_H1 = {"n_estimators": list(range(10, 540, 10)), "max_features": ["sqrt", "log2"]}
_N_H1 = 20


def _sql_list(vals):
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in vals) + "]"


_RANDOM_CONFIGS_SQL = f"""
with recursive s as (select distinct user_id as run_id from events),
w as (
  select run_id, j, j // 10 as l, j % 10 as r, 0 as i, false as done from s cross join range(0, {_N_H1}) t(j)
  union all
  select run_id, j, case when i = 8 then l else case when i % 2 = 0 then (l + ('0x' || substr(h, 1, 12))::bigint % 11) % 11 else l end end,
         case when i = 8 then r else case when i % 2 = 1 then (r + ('0x' || substr(h, 1, 12))::bigint % 10) % 10 else r end end,
         case when i = 8 then 0 else i + 1 end, i = 8 and l * 10 + r < 106
  from (select *, md5(concat_ws('|', '42', cast(run_id as varchar), cast(i as varchar),
                                cast(case when i % 2 = 0 then r else l end as varchar))) as h from w) x
  where not done)
select run_id, cast(j + 1 as integer) as config_rank, cast(l * 10 + r as bigint) as config_index,
       {_sql_list(list(range(10, 540, 10)))}[(l * 10 + r) // 2 + 1] as n_estimators,
       ['sqrt', 'log2'][(l * 10 + r) % 2 + 1] as max_features
from w where done"""


@register("random_configs", _RANDOM_CONFIGS_SQL)
def q_random_configs(spark, sf):
    studies = read_table(spark, sf, "events").select(F.col("user_id").alias("run_id"))
    return TR.random_configs(spark, _SPACE_H1, _N_H1, 42, studies, RUN)


_SPACE_H2 = {
    "n_estimators": {"type": "integer", "low": 50, "high": 150},
    "max_depth": {"type": "integer", "low": 3, "high": 10},
    "learning_rate": {"type": "real", "low": 0.01, "high": 0.2, "prior": "log-uniform"},
    "subsample": {"type": "real", "low": 0.8, "high": 1.0},
    "max_features": {"type": "categorical", "values": ["sqrt", "log2"]},
}
_N_H2 = 10


def _sample_space_sql():
    def u(p):
        return (f"(('0x' || substr(md5(concat_ws('|', '42', cast(run_id as varchar), '{p}', "
                f"cast(candidate as varchar))), 1, 13))::bigint / cast({2 ** 52} as double))")
    cols = []
    for p, spec in _SPACE_H2.items():
        if spec["type"] == "integer":
            lo, hi = spec["low"], spec["high"]
            cols.append(f"cast({lo} + floor({u(p)} * {hi - lo + 1}) as bigint) as {p}")
        elif spec["type"] == "real" and spec.get("prior") == "log-uniform":
            a, b = math.log(spec["low"]), math.log(spec["high"]) - math.log(spec["low"])
            cols.append(f"exp({a!r} + {u(p)} * {b!r}) as {p}")
        elif spec["type"] == "real":
            lo, hi = float(spec["low"]), float(spec["high"])
            cols.append(f"{lo!r} + {u(p)} * {hi - lo!r} as {p}")
        else:
            vals = spec["values"]
            cols.append(f"{_sql_list(vals)}[cast(floor({u(p)} * {len(vals)}) as integer) + 1] as {p}")
    return round_sql(f"""
with s as (select distinct user_id as run_id from events),
c as (select run_id, cast(unnest(range(0, {_N_H2})) as integer) as candidate from s)
select run_id, candidate, {', '.join(cols)} from c""", ["learning_rate", "subsample"])


@register("sample_space", _sample_space_sql())
def q_sample_space(spark, sf):
    studies = read_table(spark, sf, "events").select(F.col("user_id").alias("run_id"))
    return round_doubles(TR.sample_space(spark, _SPACE_H2, _N_H2, 42, studies, RUN))


_FOLDS, _MODELS, _METHODS = (1, 2, 3, 4, 5), ("random_forest", "xgboost"), ("random", "bayesian")


def _plan_sql():
    cells = [(i, f, m, k) for i, (f, m, k) in enumerate((f, m, k) for f in _FOLDS for m in _MODELS for k in _METHODS)]
    values = ", ".join(f"({i}, {f}, '{m}', '{k}')" for i, f, m, k in cells)
    return f"""
with d as (select distinct dataset from ({fx.RESULTS_FX_SQL}) r),
r as (select dataset, dense_rank() over (order by dataset) as rk from d),
c as (select * from (values {values}) v(cell, outer_fold, model, optimizer))
select cast((rk - 1) * {len(cells)} + cell + 1 as integer) as experiment_id, dataset, outer_fold, model, optimizer
from r, c"""


@register("experiment_plan", _plan_sql())
def q_experiment_plan(spark, sf):
    return TR.experiment_plan(fx.results_fx(spark, sf), _FOLDS, _MODELS, _METHODS)


@register("search_documents", f"""
select run_id, iteration, event_id, objective_score, params from ({TRI}) t""")
def q_search_documents(spark, sf):
    """Trials folded into one JSON document per run, written, read back and unfolded."""
    trials = fx.trials_fx(spark, sf)
    documents = IN.search_documents(trials, RUN, trials_per_document=16)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/search-documents-{uuid.uuid4().hex}"
    IN.write_search_documents(documents, path)
    return IN.explode_history(IN.read_search_documents(spark, path, documents.schema, multi_line=False), RUN)
