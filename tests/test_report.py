from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from evalframe.operators import pairs as PA
from evalframe.operators.report import report_rows

GOLD = Path(__file__).parent / "golden"

# Lines of the published statistical summary (all-dataset model comparison).
PUBLISHED = [
    "- **accuracy**: random_forest mean = 0.9054, xgboost mean = 0.9138, mean difference = 0.0084, "
    "Wilcoxon p = <0.001, Cohen's dz = 0.7669.",
    "- **runtime_seconds**: random_forest mean = 386.9720, xgboost mean = 1933.5200, mean difference = "
    "1546.5479, Wilcoxon p = <0.001, Cohen's dz = 0.1638.",
    "- **accuracy**: random mean = 0.9088, bayesian mean = 0.9103, mean difference = 0.0015, "
    "Wilcoxon p = 0.0321, Cohen's dz = 0.2616.",
    "- **f1**: random mean = 0.7073, bayesian mean = 0.7139, mean difference = 0.0066, "
    "Wilcoxon p = 0.0074, Cohen's dz = 0.5364.",
]


def test_report_lines_match_published(spark):
    res = spark.createDataFrame(pd.read_csv(GOLD / "benchmark_results.csv"))
    tests = PA.run_comparisons(res, F.col("dataset") == "adult", tie_decimals=None)
    rows = report_rows(tests, PA.effect_sizes(tests)).collect()
    lines = {r["line"] for r in rows}
    for line in PUBLISHED:
        assert line in lines
    per_ds = [r["line"] for r in rows if r["scope"] == "wdbc" and r["comparison"] == "model"]
    assert all(line.endswith(").") and "(see effect" not in line for line in per_ds)
    assert len(rows) == 44
