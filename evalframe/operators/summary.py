"""Grouped summaries of experiment results.

Each is two aggregations over the results table, plus a join back to the fact
rows where a per-group fence is needed (G3, G4, G10).  Percentiles are exact
(linear interpolation as pandas and NumPy) and selected by
``quantiles.exact_quantiles``, whose first pass takes the other statistics
too; no group is held in one task and nothing is cached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions.columns import fixed, nan_to_null
from evalframe.operators._keys import as_list, join_on_keys
from evalframe.operators.fairness import flag_fairness
from evalframe.operators.quantiles import exact_quantiles, wide_quantiles

# Metric families of the results table.
PERFORMANCE_METRICS = ("accuracy", "balanced_accuracy", "f1", "roc_auc")
FAIRNESS_METRICS = ("demographic_parity_difference", "equal_opportunity_difference")
RUNTIME_METRIC = "runtime_seconds"
ALL_METRICS = PERFORMANCE_METRICS + FAIRNESS_METRICS + (RUNTIME_METRIC,)

STATS = ("count", "mean", "std", "median", "min", "max")


_AGGREGATES = {
    "count": lambda c: F.count(c).cast("long"),
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
}


def _statistics(rows: DataFrame, keys, metrics, stats) -> DataFrame:
    """``{metric}_{stat}`` columns, one row per group."""
    carry = [(f"{{col}}_{s}", _AGGREGATES[s]) for s in stats if s != "median"]
    probs = [0.5] if "median" in stats else []
    if probs:
        return wide_quantiles(rows, keys, metrics, probs, ["{col}_median"], carry)
    return rows.groupBy(*keys).agg(*[f(nan_to_null(F.col(m).cast("double"))).alias(n.format(col=m))
                                     for m in metrics for n, f in carry])


def summarize(results: DataFrame, keys=("dataset", "model", "optimizer"), metrics=ALL_METRICS,
              stats=STATS) -> DataFrame:
    """G1: ``<metric>_<stat>`` for count, mean, sample std, median, min, max."""
    keys = as_list(keys)
    return _statistics(results, keys, metrics, stats).select(*keys, *[f"{m}_{s}" for m in metrics for s in stats])


def fairness_summary(results: DataFrame, dim: DataFrame, keys=("dataset", "model", "optimizer"),
                     metrics=FAIRNESS_METRICS, stats=STATS) -> DataFrame:
    """G1 statistics of the fairness metrics where the dataset is
    fairness-applicable; elsewhere every statistic is NULL except the count,
    which is the group size."""
    keys = as_list(keys)
    flagged = flag_fairness(results, dim)
    app = F.col("fairness_applicable")
    gkeys = keys + ["fairness_applicable", "fairness_status", "methodology_note"]
    # the group size rides along as a metric of its own: it is there for every row
    rows = flagged.select(*gkeys, *[F.when(app, F.col(m).cast("double")).alias(m) for m in metrics],
                          F.lit(1.0).alias("__rows"))
    out = _statistics(rows, gkeys, [*metrics, "__rows"], [*stats, *(["count"] if "count" not in stats else [])])
    size = F.col("__rows_count")
    return out.select(*gkeys, *[F.when(app, F.col(f"{m}_{s}")).otherwise(size).alias(f"{m}_{s}") if s == "count"
                                else F.col(f"{m}_{s}") for m in metrics for s in stats])


def _quartiles(results: DataFrame, keys, value: str) -> DataFrame:
    """Per group: count (of rows), mean, std, min, max, Q1, median, Q3, IQR and fences."""
    v = nan_to_null(F.col(value).cast("double"))
    base = [F.count(F.lit(1)).cast("long").alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
            F.min(v).alias("min"), F.max(v).alias("max")]
    q = exact_quantiles(results, keys, value, [0.25, 0.5, 0.75], names=["q1", "median", "q3"], carry=base)
    return (q.withColumn("iqr", F.col("q3") - F.col("q1"))
             .withColumn("upper_bound", F.col("q3") + F.lit(1.5) * F.col("iqr"))
             .withColumn("lower_bound", F.col("q1") - F.lit(1.5) * F.col("iqr")))


def runtime_profile(results: DataFrame, keys=("dataset", "model", "optimizer"),
                    value: str = RUNTIME_METRIC, unit: str = "seconds") -> DataFrame:
    """Count (group size), mean, std, median, min, max, Q1, Q3, IQR,
    upper fence Q3 + 1.5 IQR and the number of values strictly above it."""
    keys = as_list(keys)
    q = _quartiles(results, keys, value)
    j = join_on_keys(results.select(*keys, value), q.select(*keys, "upper_bound"), keys)
    n_out = j.groupBy(*keys).agg(F.count_if(F.col(value) > F.col("upper_bound")).cast("long").alias("outlier_count"))
    out = join_on_keys(q, n_out, keys)
    return out.select(*keys, "count",
                      *[F.col(s).alias(f"{s}_{unit}") for s in
                        ("mean", "std", "median", "min", "max", "q1", "q3", "iqr", "upper_bound")],
                      "outlier_count")


# Outlier category names and description texts.
EXTREME_CATEGORY = "Extreme Runtime Outlier"
OUTLIER_CATEGORY = "Runtime Outlier"


def iqr_outliers(results: DataFrame, keys=("dataset", "model", "optimizer"), value: str = RUNTIME_METRIC,
                 extreme: Column | None = None, keep=("outer_fold",)) -> DataFrame:
    """Rows strictly above their group's upper fence, with the group's
    Q3, IQR, fence, value/fence ratio (NULL when the fence is not positive),
    category (``extreme`` is the caller's predicate) and a description."""
    keys = as_list(keys)
    keep = [c for c in as_list(keep) if c not in keys]
    q = _quartiles(results, keys, value)
    q = q.select(*keys, F.col("q3").alias("group_q3"), F.col("iqr").alias("group_iqr"),
                 F.col("upper_bound").alias("iqr_upper_bound"))
    j = join_on_keys(results, q, keys).where(F.col(value) > F.col("iqr_upper_bound"))
    is_ext = extreme if extreme is not None else F.lit(False)
    v, ub = F.col(value), F.col("iqr_upper_bound")
    # Description texts of the anomaly table.
    desc = F.when(F.col("is_extreme"), F.concat(
        F.lit("Extreme runtime observation of "), fixed(v, 3), F.lit("s (~"), fixed(v / 3600.0, 2),
        F.lit("h) substantially exceeding IQR threshold ("), fixed(ub, 3), F.lit("s)."))).otherwise(F.concat(
        F.lit("Runtime of "), fixed(v, 3), F.lit("s exceeds IQR upper bound ("), fixed(ub, 3), F.lit("s).")))
    return (j.withColumn("is_extreme", F.coalesce(is_ext, F.lit(False)))
             .select(*keys, *keep, v, "group_q3", "group_iqr", "iqr_upper_bound",
                     F.when(ub > 0, v / ub).alias("exceeds_upper_bound_ratio"),
                     F.when(F.col("is_extreme"), EXTREME_CATEGORY).otherwise(OUTLIER_CATEGORY).alias("anomaly_category"),
                     "is_extreme", desc.alias("description")))


def unpivot_metrics(results: DataFrame, ids, metrics, var: str = "metric", val: str = "value") -> DataFrame:
    """(ids..., metric, value) with metric values as double (one row per metric)."""
    ids = as_list(ids)
    return results.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        ids, list(metrics), var, val)


def compare_methods(results: DataFrame, factor: str, left: str, right: str, by=("dataset",),
                    metrics=PERFORMANCE_METRICS + (RUNTIME_METRIC,)) -> DataFrame:
    """Per (by, metric): mean, sample std and median of each method and
    the right-minus-left differences of means and medians."""
    by = as_list(by)
    long = unpivot_metrics(results.where(F.col(factor).isin(left, right)), by + [factor], metrics)
    v = nan_to_null(F.col("value"))
    per_side = exact_quantiles(long, by + ["metric", factor], "value", [0.5], names=["median"], deal_by=by + ["metric"],
                               carry=[F.avg(v).alias("mean"), F.stddev_samp(v).alias("std")])
    g = per_side.groupBy(*by, "metric").agg(*[
        F.max(F.when(F.col(factor) == side, F.col(s))).alias(f"{side}_{s}") for side in (left, right)
        for s in ("mean", "std", "median")])
    # a group with neither method has a row too
    groups = unpivot_metrics(results.select(*by, *metrics).groupBy(*by).agg(*[F.lit(0.0).alias(m) for m in metrics]),
                             by, metrics).drop("value")
    g = join_on_keys(groups, g, by + ["metric"], "left")
    return (g.withColumn("diff_mean", F.col(f"{right}_mean") - F.col(f"{left}_mean"))
             .withColumn("diff_median", F.col(f"{right}_median") - F.col(f"{left}_median")))


def bar_data(results: DataFrame, x: str, hue: str, metrics, where: Column | None = None) -> DataFrame:
    """Bar heights and error bars: mean and sample sd per (x, hue, metric)."""
    r = results if where is None else results.where(where)
    long = unpivot_metrics(r, [x, hue], metrics)
    v = nan_to_null(F.col("value"))
    return long.groupBy(x, hue, "metric").agg(F.count(v).cast("long").alias("n"), F.avg(v).alias("mean"),
                                              F.stddev_samp(v).alias("sd"))


def box_data(results: DataFrame, keys, value: str) -> DataFrame:
    """Box plot numbers per group: Q1, median, Q3, whiskers (most extreme
    values within 1.5 IQR of the box) and the count beyond them."""
    keys = as_list(keys)
    q = _quartiles(results, keys, value)
    j = join_on_keys(results.select(*keys, value), q.select(*keys, "lower_bound", "upper_bound"), keys)
    v = F.col(value)
    inside = (v >= F.col("lower_bound")) & (v <= F.col("upper_bound"))
    w = j.groupBy(*keys).agg(F.min(F.when(inside, v)).alias("whisker_low"),
                             F.max(F.when(inside, v)).alias("whisker_high"),
                             F.count_if(~inside).cast("long").alias("n_outside"))
    return join_on_keys(q.select(*keys, "count", "q1", "median", "q3", "iqr", "lower_bound", "upper_bound"), w, keys)


# Fixed value: group label of the fold-level scatter (dataset, model, optimizer).
def group_label(dataset="dataset", model="model", optimizer="optimizer") -> Column:
    return F.concat(F.col(dataset), F.lit("\n"), F.col(model), F.lit("\n("), F.col(optimizer), F.lit(")"))


def scatter_data(results: DataFrame, value: str = RUNTIME_METRIC, x: str = "outer_fold") -> DataFrame:
    """One point per fold: x, value, log10(value) and the group label."""
    return results.select("dataset", "model", "optimizer", x, F.col(value).alias("value"),
                          F.when(F.col(value) > 0, F.log10(F.col(value))).alias("log10_value"),
                          group_label().alias("group_label"))
