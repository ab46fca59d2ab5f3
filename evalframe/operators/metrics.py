"""Classification and fairness metrics per run (A1-A10).

One aggregation over the prediction table does the heavy work, with map-side
partial aggregation so that a hot run never lands whole in one task: the count
table ``(keys, y_true, y_pred, sensitive, y_prob) -> n``.  From its shuffled
rows come both

* the contingency table ``(keys, y_true, y_pred, sensitive) -> n``: labels,
  confusion counts, accuracy, balanced accuracy, F1, group selection rates,
  demographic parity and equal opportunity;
* the score table ``(keys, y_prob) -> pos, neg``: the exact ROC AUC through
  running sums over ranges cut at quantiles of the scores
  (``ranking.ranked_sums``).

The two labels of a run are found by counting its distinct labels, so a label
column that is not binary costs a count and an error, not a set in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.functions.columns import nan_to_null
from evalframe.operators._keys import as_list, join_on_keys
from evalframe.operators.labels import canonical_predictions, positive_labels
from evalframe.operators.ranking import range_cuts, ranked_sums

METRICS = (
    "accuracy", "balanced_accuracy", "f1", "roc_auc",
    "demographic_parity_difference", "equal_opportunity_difference",
)


def _ratio(num, den):
    """num / den as double, NULL when den is 0 (identical in every engine:
    one IEEE division of two exact integers)."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def contingency(preds: DataFrame, keys, sensitive: str | None = "sensitive", score: bool = False) -> DataFrame:
    """(keys, y_true, y_pred, sensitive[, y_prob]) -> n.  Rows are canonical text labels."""
    keys = as_list(keys)
    has = sensitive and sensitive in preds.columns
    p = preds.withColumn("sensitive", F.col(sensitive).cast("string") if has else F.lit(None).cast("string"))
    if score:
        p = p.withColumn("y_prob", nan_to_null(F.col("y_prob").cast("double")))
    return p.groupBy(*keys, "y_true", "y_pred", "sensitive", *(["y_prob"] if score else [])).agg(
        F.count(F.lit(1)).alias("n"))


def _labels(counts: DataFrame, keys, numeric: bool, positive: str | None) -> DataFrame:
    """One row per run: positive_label and negative_label; an error for a run that has not
    exactly two labels (a missing one is a third)."""
    found = positive_labels(counts, keys, numeric, weight="n")
    if positive is None:
        return found
    given = F.lit(str(positive))
    other = F.when(F.col("negative_label") == given, F.col("positive_label")).otherwise(F.col("negative_label"))
    return found.withColumn("negative_label", other).withColumn(
        "positive_label", F.when(F.col("positive_label").isNotNull(), given))


def _runs(preds: DataFrame, keys, positive: str | None, sensitive: str | None, score: bool = False):
    """Count table -> labels of each run -> per (run, group) counts -> per run counts,
    rates and disparities.

    Returns (count table, labels, per-group table, per-run table)."""
    keys = as_list(keys)
    canon, numeric = canonical_predictions(preds)
    counts = contingency(canon, keys, sensitive, score)
    ct = counts
    if score:
        ct = counts.groupBy(*keys, "y_true", "y_pred", "sensitive").agg(F.sum("n").alias("n"))
    labels = _labels(counts, keys, numeric, positive)
    # a run's few counts are dealt by run once: the aggregates below need no exchange of their own
    j = join_on_keys(ct.repartition(*keys) if keys else ct.repartition(1), labels, keys)
    pos = F.col("positive_label")
    j = j.withColumns({"t_pos": F.col("y_true") == pos, "p_pos": F.col("y_pred") == pos})
    n, t, p = F.col("n"), F.col("t_pos"), F.col("p_pos")

    def _sum(cond):
        return F.sum(F.when(cond, n).otherwise(0)).cast("long")

    groups = j.groupBy(*keys, "sensitive").agg(
        F.sum(n).cast("long").alias("group_n"), _sum(p).alias("pred_pos"), _sum(t).alias("actual_pos"),
        _sum(t & p).alias("tp"), _sum(~t & p).alias("fp"), _sum(~t & ~p).alias("tn"), _sum(t & ~p).alias("fn"))
    real = F.col("sensitive").isNotNull()
    rate = F.when(real, _ratio(F.col("pred_pos"), F.col("group_n")))
    tpr = F.when(real, _ratio(F.col("tp"), F.col("actual_pos")))
    runs = groups.groupBy(*keys).agg(
        *[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "tn", "fn")],
        F.sum("group_n").cast("long").alias("n"),
        F.count(rate).alias("_n_rate"), (F.max(rate) - F.min(rate)).alias("_dpd"),
        F.count(tpr).alias("_n_tpr"), (F.max(tpr) - F.min(tpr)).alias("_eod"))
    runs = runs.select(
        *keys, "tp", "fp", "tn", "fn", "n",
        F.when(F.col("_n_rate") >= 2, F.col("_dpd")).otherwise(0.0).alias("demographic_parity_difference"),
        F.when(F.col("_n_tpr") >= 2, F.col("_eod")).otherwise(0.0).alias("equal_opportunity_difference"))
    return counts, labels, groups, runs


def confusion(preds: DataFrame, keys, positive: str | None = None) -> DataFrame:
    """A1: TP, FP, TN, FN and n per run."""
    keys = as_list(keys)
    _, _, _, runs = _runs(preds, keys, positive, None)
    return runs.select(*keys, "tp", "fp", "tn", "fn", "n")


def _binary_from_confusion(c: DataFrame, keys, extra=()) -> DataFrame:
    tp, fp, tn, fn, n = (F.col(x) for x in ("tp", "fp", "tn", "fn", "n"))
    tpr = _ratio(tp, tp + fn)
    tnr = _ratio(tn, tn + fp)
    bal = (F.when(tpr.isNotNull() & tnr.isNotNull(), (tpr + tnr) / 2.0)
           .otherwise(F.coalesce(tpr, tnr)))
    f1 = F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0))
    return c.select(*keys, _ratio(tp + tn, n).alias("accuracy"), bal.alias("balanced_accuracy"),
                    f1.alias("f1"), *extra)


def binary_metrics(preds: DataFrame, keys, positive: str | None = None) -> DataFrame:
    """A2-A4: accuracy, balanced accuracy (mean recall over classes present in
    y_true), F1 of the positive label (0 when undefined)."""
    keys = as_list(keys)
    _, _, _, runs = _runs(preds, keys, positive, None)
    return _binary_from_confusion(runs, keys)


def group_rates(preds: DataFrame, keys, positive: str | None = None,
                sensitive: str = "sensitive") -> DataFrame:
    """Per run and sensitive group: n, selection rate, TPR (NULL without
    actual positives).  NULL sensitive values form no group."""
    keys = as_list(keys)
    _, _, groups, _ = _runs(preds, keys, positive, sensitive)
    g = groups.where(F.col("sensitive").isNotNull())
    return g.select(*keys, "sensitive", F.col("group_n").alias("n"),
                    _ratio(F.col("pred_pos"), F.col("group_n")).alias("selection_rate"),
                    _ratio(F.col("tp"), F.col("actual_pos")).alias("tpr"))


def demographic_parity(preds: DataFrame, keys, positive: str | None = None,
                       sensitive: str = "sensitive") -> DataFrame:
    """Max - min selection rate over non-null groups; fewer than two groups -> 0.0."""
    keys = as_list(keys)
    _, _, _, runs = _runs(preds, keys, positive, sensitive)
    return runs.select(*keys, "demographic_parity_difference")


def equal_opportunity(preds: DataFrame, keys, positive: str | None = None,
                      sensitive: str = "sensitive") -> DataFrame:
    """Max - min TPR over groups that have actual positives; fewer than two -> 0.0."""
    keys = as_list(keys)
    _, _, _, runs = _runs(preds, keys, positive, sensitive)
    return runs.select(*keys, "equal_opportunity_difference")


def _auc(counts: DataFrame, labels: DataFrame, keys) -> DataFrame:
    """Exact ROC AUC, ties counted half:
    sum_s pos(s) * (2 * neg_below(s) + neg(s)) / (2 * P * N).
    NULL when a run has one class in y_true or any missing score."""
    j = join_on_keys(counts, labels.select(*keys, "positive_label"), keys)
    # one chain: rows without a score stay as their own (NULL) score group,
    # contribute nothing to the running sums and are counted as missing
    has = F.col("y_prob").isNotNull()
    is_pos = F.col("y_true") == F.col("positive_label")
    per_score = (j.groupBy(*keys, "y_prob")
                  .agg(F.sum(F.when(is_pos, F.col("n")).otherwise(0)).cast("long").alias("pos"),
                       F.sum(F.when(~is_pos, F.col("n")).otherwise(0)).cast("long").alias("neg"))
                  .withColumn("neg_nn", F.when(has, F.col("neg")).otherwise(F.lit(0).cast("long"))))
    # the cuts are taken from the count table, whose shuffled rows are at hand
    ranked = ranked_sums(per_score, keys, "y_prob", "neg_nn", cuts=range_cuts(counts, "y_prob", F.sum("n")))
    dec = "decimal(38,0)"
    term = F.col("pos").cast(dec) * (F.col("neg_nn_below").cast(dec) * 2 + F.col("neg").cast(dec))
    t = ranked.groupBy(*keys).agg(
        F.sum(F.when(has, term)).alias("_num"),
        F.sum(F.when(has, F.col("pos"))).alias("_p"), F.sum(F.when(has, F.col("neg"))).alias("_n"),
        F.sum(F.when(~has, F.col("pos") + F.col("neg")).otherwise(0)).alias("_miss"))
    den = (F.col("_p").cast(dec) * F.col("_n").cast(dec) * 2)
    auc = F.when((F.col("_miss") == 0) & (F.col("_p") > 0) & (F.col("_n") > 0),
                 F.col("_num").cast("double") / den.cast("double"))
    return t.select(*keys, auc.alias("roc_auc"))


def roc_auc(preds: DataFrame, keys, positive: str | None = None) -> DataFrame:
    """A5: exact ROC AUC per run."""
    keys = as_list(keys)
    canon, numeric = canonical_predictions(preds)
    counts = contingency(canon, keys, None, score=True)
    return _auc(counts, _labels(counts, keys, numeric, positive), keys)


def evaluate(preds: DataFrame, keys, positive: str | None = None, sensitive: str | None = "sensitive") -> DataFrame:
    """The six metrics of every run.

    ``preds`` has the key columns, ``y_true``, ``y_pred``, ``y_prob`` (may be
    NULL -> roc_auc NULL) and optionally the ``sensitive`` column (absent ->
    disparities 0.0).
    """
    keys = as_list(keys)
    if sensitive and sensitive not in preds.columns:
        sensitive = None
    counts, labels, _, runs = _runs(preds, keys, positive, sensitive, score=True)
    binary = _binary_from_confusion(runs, keys, ["demographic_parity_difference", "equal_opportunity_difference"])
    return join_on_keys(binary, _auc(counts, labels, keys), keys).select(*keys, *METRICS)


def mean_over_folds(run_metrics: DataFrame, keys, metrics=METRICS, prefix: str = "mean_") -> DataFrame:
    """A10: mean of each metric over the folds of a run; NaN and NULL skipped."""
    keys = as_list(keys)
    return run_metrics.groupBy(*keys).agg(
        *[F.avg(nan_to_null(F.col(m))).alias(prefix + m) for m in metrics])
