"""Paired comparisons of two methods.

Pairs are built with one unpivot and one conditional aggregation (no
self-join): rows of the two methods meet in the same group of the
experimental identity.  Tests group pairs by any test keys, so one job runs
every comparison family of every study.  Signed ranks use running counts over
ranges cut at each test's own quantiles, so a test with millions of pairs is
spread over many tasks; only the
exact Wilcoxon branch collects ranks, and only for tests with n <= 50.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.functions.columns import effect_label, nan_to_null
from evalframe.functions.pvalues import t_pvalue_udf, wilcoxon_p_udf
from evalframe.operators._keys import as_list, join_on_keys
from evalframe.operators.quantiles import exact_quantiles
from evalframe.operators.ranking import ranked_sums
from evalframe.operators.summary import FAIRNESS_METRICS, PERFORMANCE_METRICS, RUNTIME_METRIC, unpivot_metrics

EXACT_MAX_N = 50          # no ties and no zeros: exact distribution up to this n
ENUMERATE_MAX_N = 13      # ties or zeros: full enumeration up to this n


def paired(results: DataFrame, factor: str, left: str, right: str, pair_keys, metrics,
           study_keys=(), on_duplicate: str = "error") -> DataFrame:
    """One row per (study, metric, pair keys) with ``left_value`` and
    ``right_value``; same answer as an inner one-to-one join of the two
    methods, with NULL/NaN sides dropped.  A duplicated pair key on either
    side fails the job (``on_duplicate='error'``) or is kept with counts
    (``'keep'``)."""
    study_keys, pair_keys = as_list(study_keys), as_list(pair_keys)
    r = results.where(F.col(factor).isin(left, right))
    long = unpivot_metrics(r, study_keys + pair_keys + [factor], metrics)
    v = nan_to_null(F.col("value"))
    is_l, is_r = F.col(factor) == left, F.col(factor) == right
    g = long.groupBy(*study_keys, "metric", *pair_keys).agg(
        F.max(F.when(is_l, v)).alias("left_value"), F.max(F.when(is_r, v)).alias("right_value"),
        F.count_if(is_l).alias("_nl"), F.count_if(is_r).alias("_nr"))
    if on_duplicate == "error":
        dup = (F.col("_nl") > 1) | (F.col("_nr") > 1)
        msg = F.concat(F.lit(f"duplicate pair key in {factor} comparison: "),
                       F.to_json(F.struct(*study_keys, "metric", *pair_keys)))
        g = g.withColumn("left_value", F.when(dup, F.raise_error(msg).cast("double")).otherwise(F.col("left_value")))
        g = g.drop("_nl", "_nr")
    else:
        g = g.withColumnRenamed("_nl", "n_left").withColumnRenamed("_nr", "n_right")
    return g.where(F.col("left_value").isNotNull() & F.col("right_value").isNotNull())


def pair_count_violations(pairs: DataFrame, test_keys, expected: int) -> DataFrame:
    """Tests whose number of pairs differs from the design's expectation."""
    keys = as_list(test_keys)
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs")).where(F.col("n_pairs") != expected)


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def paired_summary(pairs: DataFrame, test_keys) -> DataFrame:
    """N, means, mean and median of right - left, t statistic
    (left - right convention, so t = -dz * sqrt(n)) and Cohen's dz; t and dz
    are NULL unless n >= 2 and the sd of the differences is > 0."""
    keys = as_list(test_keys)
    p = pairs.where(_finite(F.col("left_value")) & _finite(F.col("right_value")))
    p = p.select(*keys, "left_value", "right_value", (F.col("right_value") - F.col("left_value")).alias("_d"))
    base = [F.count(F.lit(1)).cast("long").alias("n"),
            F.avg("left_value").alias("mean_left"), F.avg("right_value").alias("mean_right"),
            F.avg("_d").alias("mean_difference"), F.stddev_samp("_d").alias("_sd")]
    g = exact_quantiles(p, keys, "_d", [0.5], names=["median_difference"], carry=base)
    g = g.select(*keys, "n", "mean_left", "mean_right", "mean_difference", "median_difference", "_sd")
    ok = (F.col("n") >= 2) & (F.col("_sd") > 0)
    # 0 - mean (not -mean): a zero mean gives t = +0.0, as left - right does
    t = (F.lit(0.0) - F.col("mean_difference")) / (F.col("_sd") / F.sqrt(F.col("n")))
    return (g.withColumn("t_statistic", F.when(ok, t))
             .withColumn("cohens_dz", F.when(ok, F.col("mean_difference") / F.col("_sd")))
             .drop("_sd"))


def signed_ranks(pairs: DataFrame, test_keys, tie_decimals: int | None = None) -> DataFrame:
    """T5: Wilcoxon signed-rank statistic per test.

    Differences right - left (rounded to ``tie_decimals`` if given, before the zero and
    tie tests; ``None`` keeps them as computed).  Zeros are dropped, tied
    |d| share their average rank, W = min(W+, W-).  Output per test: n, m
    (non-zero count), w2 (= 2 W, an exact integer), tie_term (sum t^3 - t),
    ties flag and the exact flag."""
    keys = as_list(test_keys)
    p = pairs.where(_finite(F.col("left_value")) & _finite(F.col("right_value")))
    d = F.col("right_value") - F.col("left_value")
    if tie_decimals is not None:
        d = F.round(d, tie_decimals)
    # one aggregate per distinct |d| (zeros included as a = 0); zeros add
    # nothing to the running count, so non-zero ranks start at 1
    per_abs = p.groupBy(*keys, F.abs(d).alias("a")).agg(
        F.count(F.lit(1)).cast("long").alias("cnt"), F.count_if(d > 0).cast("long").alias("cnt_pos"))
    nz = F.col("a") != 0
    per_abs = per_abs.withColumn("cnt_nz", F.when(nz, F.col("cnt")).otherwise(F.lit(0).cast("long")))
    ranked = ranked_sums(per_abs, keys, "a", "cnt_nz")
    rank2 = F.col("cnt_nz_below") * 2 + F.col("cnt") + 1          # twice the average rank
    ranked = ranked.withColumn("rank2", F.when(nz, rank2))
    out = ranked.groupBy(*keys).agg(
        F.sum("cnt").cast("long").alias("n"),
        F.sum("cnt_nz").cast("long").alias("m"),
        F.sum(F.col("cnt_pos") * F.col("rank2")).cast("long").alias("_wp2"),
        F.sum((F.col("cnt") - F.col("cnt_pos")) * F.col("rank2")).cast("long").alias("_wm2"),
        F.coalesce(F.sum(F.when(nz, F.pow(F.col("cnt"), 3) - F.col("cnt"))), F.lit(0.0)).alias("tie_term"),
        F.coalesce(F.max(F.when(nz, F.col("cnt"))) > 1, F.lit(False)).alias("ties"))
    m = F.col("m")
    exact = (((m == F.col("n")) & ~F.col("ties") & (F.col("n") <= EXACT_MAX_N)) | (F.col("n") <= ENUMERATE_MAX_N))
    out = out.select(*keys, "n", "m", F.least("_wp2", "_wm2").alias("w2"), "tie_term", "ties",
                     exact.alias("exact"))
    # doubled ranks with multiplicity, collected only for exact tests (n bounded)
    small = out.where(F.col("exact") & (F.col("n") <= EXACT_MAX_N) & (F.col("m") >= 2)).select(*keys)
    rk = join_on_keys(ranked.where(nz).select(*keys, "rank2", "cnt"), small, keys, "left_semi")
    lists = rk.groupBy(*keys).agg(F.flatten(F.collect_list(F.array_repeat("rank2", F.col("cnt").cast("int"))))
                                  .alias("ranks2"))
    return join_on_keys(out, lists, keys, "left")


def wilcoxon(pairs: DataFrame, test_keys, tie_decimals: int | None = None) -> DataFrame:
    """T5 + T6: W and its two-sided p per test.  All differences zero -> W 0,
    p 1; a single non-zero difference -> NULL."""
    keys = as_list(test_keys)
    s = signed_ranks(pairs, keys, tie_decimals)
    p = wilcoxon_p_udf(F.col("m"), F.col("w2"), F.col("tie_term"), F.col("exact"), F.col("ranks2"))
    return s.select(
        *keys,
        F.when(F.col("m") == 0, F.lit(0.0)).when(F.col("m") >= 2, F.col("w2") / 2.0).alias("wilcoxon_statistic"),
        F.when(F.col("m") == 0, F.lit(1.0)).when(F.col("m") >= 2, nan_to_null(p)).alias("wilcoxon_pvalue"))


def paired_tests(pairs: DataFrame, test_keys, tie_decimals: int | None = None) -> DataFrame:
    """T1-T6 in one table per test."""
    keys = as_list(test_keys)
    summ = paired_summary(pairs, keys)
    summ = summ.withColumn("t_pvalue", nan_to_null(t_pvalue_udf(F.col("t_statistic"),
                                                                (F.col("n") - 1).cast("double"))))
    w = wilcoxon(pairs, keys, tie_decimals)
    out = join_on_keys(summ, w, keys, "left")
    return out.select(*keys, "n", "mean_left", "mean_right", "mean_difference", "median_difference",
                      "t_statistic", "t_pvalue", "wilcoxon_statistic", "wilcoxon_pvalue", "cohens_dz")


# --- T7: comparison families ----------------------------------------------

ALL_SCOPE = "all_datasets"


def comparison_pairs(results: DataFrame, fairness_datasets: Column | None = None, study_keys=(),
                     models=("random_forest", "xgboost"), optimizers=("random", "bayesian"),
                     metrics=PERFORMANCE_METRICS + (RUNTIME_METRIC,), fairness_metrics=FAIRNESS_METRICS,
                     dataset: str = "dataset", fold: str = "outer_fold", model: str = "model",
                     optimizer: str = "optimizer") -> DataFrame:
    """T7 pairs: model and optimizer comparisons over all datasets and per
    dataset, plus fairness comparisons on fairness-applicable datasets only.

    One pass: every unpivoted result row fans out to its two factor views
    (model view paired on the optimizer, optimizer view paired on the model)
    and a single conditional aggregation meets the two sides of every pair.
    A second fixed fan-out gives each pair its two scopes."""
    study_keys = as_list(study_keys)
    applicable = fairness_datasets if fairness_datasets is not None else F.lit(False)
    all_metrics = list(metrics) + list(fairness_metrics)
    r = results.withColumn("_app", applicable)
    long = unpivot_metrics(r, study_keys + [dataset, model, optimizer, fold, "_app"], all_metrics)
    views = F.array(
        F.struct(F.lit("model").alias("factor"), F.col(model).alias("side"), F.col(optimizer).alias("other"),
                 F.lit(models[0]).alias("left"), F.lit(models[1]).alias("right"), F.lit(optimizer).alias("other_name")),
        F.struct(F.lit("optimizer").alias("factor"), F.col(optimizer).alias("side"), F.col(model).alias("other"),
                 F.lit(optimizers[0]).alias("left"), F.lit(optimizers[1]).alias("right"),
                 F.lit(model).alias("other_name")))
    is_fair = F.col("metric").isin(*fairness_metrics)
    x = (long.where(~is_fair | F.col("_app"))
             .select(*study_keys, dataset, fold, "metric", "value", F.explode(views).alias("v"))
             .select(*study_keys, dataset, fold, "metric", "value", "v.*")
             .where(F.col("side").isin(F.col("left"), F.col("right"))))
    v = nan_to_null(F.col("value"))
    is_l, is_r = F.col("side") == F.col("left"), F.col("side") == F.col("right")
    g = x.groupBy(*study_keys, "factor", "left", "right", "other_name", "metric", dataset, "other", fold).agg(
        F.max(F.when(is_l, v)).alias("left_value"), F.max(F.when(is_r, v)).alias("right_value"),
        F.count_if(is_l).alias("_nl"), F.count_if(is_r).alias("_nr"))
    dup = (F.col("_nl") > 1) | (F.col("_nr") > 1)
    msg = F.concat(F.lit("duplicate pair key in comparison: "),
                   F.to_json(F.struct(*study_keys, "factor", "metric", dataset, "other", fold)))
    g = g.withColumn("left_value", F.when(dup, F.raise_error(msg).cast("double")).otherwise(F.col("left_value")))
    g = g.where(F.col("left_value").isNotNull() & F.col("right_value").isNotNull())
    fair = F.col("metric").isin(*fairness_metrics)
    comp = F.when(fair, F.concat(F.lit("fairness_"), F.col("factor"))).otherwise(F.col("factor"))
    scopes = F.when(fair, F.array(F.col(dataset))).otherwise(F.array(F.lit(ALL_SCOPE), F.col(dataset)))
    out = g.select(*study_keys, comp.alias("comparison"), F.explode(scopes).alias("scope"), "metric",
                   F.col("left").alias("left_method"), F.col("right").alias("right_method"), "other_name",
                   F.col(dataset).alias("pair_dataset"), F.col("other").alias("pair_group"),
                   F.col(fold).alias("pair_fold"), "left_value", "right_value")
    pairing = F.when(F.col("scope") == ALL_SCOPE,
                     F.concat(F.lit(f"{dataset} + "), F.col("other_name"), F.lit(f" + {fold}"))) \
               .otherwise(F.concat(F.col("other_name"), F.lit(f" + {fold}")))
    return out.withColumn("pairing", pairing).drop("other_name")


TEST_KEYS = ("comparison", "scope", "metric", "left_method", "right_method", "pairing")


def run_comparisons(results: DataFrame, fairness_datasets: Column | None = None, study_keys=(),
                    tie_decimals: int | None = None, **kw) -> DataFrame:
    """Every paired test of every family (44 per study in the reference design)."""
    study_keys = as_list(study_keys)
    pairs = comparison_pairs(results, fairness_datasets, study_keys, **kw)
    return paired_tests(pairs, study_keys + list(TEST_KEYS), tie_decimals)


def effect_sizes(tests: DataFrame, keys=TEST_KEYS) -> DataFrame:
    """Cohen's dz with its name and magnitude label."""
    keys = as_list(keys)
    extra = [k for k in tests.columns if k not in keys and k in ("study",)]
    return tests.select(*extra, *keys, F.col("cohens_dz").alias("effect_size"),
                        F.lit("Cohen's dz").alias("effect_size_name"),
                        effect_label("cohens_dz").alias("effect_interpretation"))
