"""Registry of checked queries: name -> (DataFrame builder, DuckDB oracle SQL).

Every query reads the driver tables (through a fixture) and runs the library
operator over the whole table.  Oracle SQL is written independently with
plain joins, GROUP BY and unsplit windows.  Doubles that come out of sums of
doubles (whose order differs between engines) are snapped to a 2^-30 grid on
both sides, in the query only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from evalframe.operators import metrics as M
from evalframe.operators.labels import canonical_predictions, positive_labels
from evalframe.plans import fixtures as fx
from evalframe.plans import sql_metrics as sm

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SNAP_BITS = 30          # query-side grid: 2^-30 (about 1e-9)
SNAP_LIMIT = 2.0 ** 20  # larger magnitudes are left as computed


def register(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _snap(c):
    """Snap a double onto the 2^-30 grid: scaling by a power of two, adding
    one half and flooring are exact, so equal inputs give equal outputs in
    every engine, and unlike a decimal round there are no decimal ties
    (values such as 0.2577734375 that engines break differently).  Also turns
    -0.0 into 0.0."""
    scale = float(2 ** SNAP_BITS)
    snapped = F.floor(c * scale + 0.5).cast("double") / scale
    return F.when(F.abs(c) < SNAP_LIMIT, snapped).otherwise(c)


def round_doubles(df: DataFrame) -> DataFrame:
    """Snap every double column (query-side only, for engine-independent
    hashes of values computed by sums in different orders)."""
    return df.select(*[_snap(F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f.name)
                       for f in df.schema.fields])


def round_sql(sql: str, cols) -> str:
    """Wrap an oracle so the named double columns are snapped like ``round_doubles``."""
    scale = f"cast({2 ** SNAP_BITS} as double)"
    lim = f"cast({int(SNAP_LIMIT)} as double)"
    repl = ", ".join(
        f"case when abs({c}) < {lim} then floor({c} * {scale} + 0.5) / {scale} else {c} end as {c}"
        for c in cols)
    return f"select * replace ({repl}) from ({sql}) r"


# --- A1-A10 over predictions_fx (run_id) and doc_predictions_fx ------------

PF = fx.PREDICTIONS_FX_SQL
DF_ = fx.DOC_PREDICTIONS_FX_SQL
RUN = ["run_id"]


@register("evaluate", sm.evaluate_sql(PF, RUN, False))
def q_evaluate(spark, sf):
    """A9 flagship: six metrics per run over orders x customer predictions."""
    return M.evaluate(fx.predictions_fx(spark, sf), RUN)


@register("evaluate_docs", sm.evaluate_sql(DF_, RUN, True))
def q_evaluate_docs(spark, sf):
    """A9 on integer labels, one run holding every row, unbalanced language groups."""
    return M.evaluate(fx.doc_predictions_fx(spark, sf), RUN)


@register("confusion", sm.confusion_sql(PF, RUN, False))
def q_confusion(spark, sf):
    return M.confusion(fx.predictions_fx(spark, sf), RUN)


@register("binary_metrics", sm.binary_metrics_sql(PF, RUN, False))
def q_binary_metrics(spark, sf):
    return M.binary_metrics(fx.predictions_fx(spark, sf), RUN)


@register("roc_auc", sm.roc_auc_sql(PF, RUN, False))
def q_roc_auc(spark, sf):
    return M.roc_auc(fx.predictions_fx(spark, sf), RUN)


@register("roc_auc_docs", sm.roc_auc_sql(DF_, RUN, True))
def q_roc_auc_docs(spark, sf):
    return M.roc_auc(fx.doc_predictions_fx(spark, sf), RUN)


@register("group_rates", sm.group_rates_sql(PF, RUN, False))
def q_group_rates(spark, sf):
    return M.group_rates(fx.predictions_fx(spark, sf), RUN)


@register("demographic_parity", sm.disparity_sql(PF, RUN, False, "demographic_parity_difference"))
def q_demographic_parity(spark, sf):
    return M.demographic_parity(fx.predictions_fx(spark, sf), RUN)


@register("equal_opportunity", sm.disparity_sql(DF_, RUN, True, "equal_opportunity_difference"))
def q_equal_opportunity(spark, sf):
    return M.equal_opportunity(fx.doc_predictions_fx(spark, sf), RUN)


@register("positive_label", sm.positive_label_sql(PF, RUN, False))
def q_positive_label(spark, sf):
    canon, numeric = canonical_predictions(fx.predictions_fx(spark, sf))
    return positive_labels(canon, RUN, numeric)


_MOF_KEYS = ["run_id", "inner_fold"]
_MOF_SQL = round_sql(f"""
select run_id, {', '.join(f'avg(case when isnan({m}) then null else {m} end) as mean_{m}' for m in sm.METRIC_COLS)}
from ({sm.evaluate_sql(fx.PREDICTIONS_FOLD_FX_SQL, _MOF_KEYS, False)}) e group by run_id
""", [f"mean_{m}" for m in sm.METRIC_COLS])


@register("mean_over_folds", _MOF_SQL)
def q_mean_over_folds(spark, sf):
    per_fold = M.evaluate(fx.predictions_fold_fx(spark, sf), _MOF_KEYS)
    return round_doubles(M.mean_over_folds(per_fold, RUN))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLES.items() if k in QUERIES}


# registrations in the sibling modules (imported for their side effect)
from evalframe.plans import queries_data  # noqa: E402,F401
from evalframe.plans import queries_results  # noqa: E402,F401
from evalframe.plans import queries_trials  # noqa: E402,F401
from evalframe.plans import queries_models  # noqa: E402,F401
