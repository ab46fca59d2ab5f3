"""Report rows (P13): one text line per paired test, the rows behind the
statistical summary.  Formatting is JVM-side (``functions.columns.fixed``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.functions.columns import fmt_number, fmt_p
from evalframe.operators.pairs import ALL_SCOPE

# Section titles of the comparisons.
SECTION_TITLES = {
    "model": "Random Forest vs XGBoost",
    "optimizer": "Random Search vs Bayesian Optimization",
    "fairness_model": "Fairness Analysis",
    "fairness_optimizer": "Fairness Analysis",
}


def report_rows(tests: DataFrame, effects: DataFrame | None = None) -> DataFrame:
    """(comparison, scope, metric, section, line).

    All-dataset rows name both methods and their means; per-dataset rows add
    the effect label (joined from ``effects``); fairness rows name the
    comparison."""
    t = tests
    if effects is not None and "effect_interpretation" in effects.columns:
        e = effects.select("comparison", "scope", "metric", "effect_interpretation")
        t = t.join(e, ["comparison", "scope", "metric"], "left")
    else:
        t = t.withColumn("effect_interpretation", F.lit(None).cast("string"))
    tail = F.concat(F.lit("mean difference = "), fmt_number("mean_difference"),
                    F.lit(", Wilcoxon p = "), fmt_p("wilcoxon_pvalue"),
                    F.lit(", Cohen's dz = "), fmt_number("cohens_dz"))
    overall = F.concat(F.lit("- **"), F.col("metric"), F.lit("**: "), F.col("left_method"), F.lit(" mean = "),
                       fmt_number("mean_left"), F.lit(", "), F.col("right_method"), F.lit(" mean = "),
                       fmt_number("mean_right"), F.lit(", "), tail, F.lit("."))
    per_dataset = F.concat(F.lit("- "), F.col("metric"), F.lit(": "), tail, F.lit(" ("),
                           F.coalesce(F.col("effect_interpretation"), F.lit("see effect_sizes.csv")), F.lit(")."))
    fairness = F.concat(F.lit("- **"), F.col("comparison"), F.lit(" / "), F.col("metric"), F.lit("**: "), tail,
                        F.lit("."))
    is_fair = F.col("comparison").startswith("fairness_")
    line = F.when(is_fair, fairness).when(F.col("scope") == ALL_SCOPE, overall).otherwise(per_dataset)
    section = F.element_at(F.create_map(*[x for k, v in SECTION_TITLES.items() for x in (F.lit(k), F.lit(v))]),
                           F.col("comparison"))
    return t.select("comparison", "scope", "metric", F.coalesce(section, F.col("comparison")).alias("section"),
                    line.alias("line"))
