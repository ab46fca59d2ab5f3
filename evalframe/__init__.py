"""evalframe — grouped evaluation and experiment analytics on Spark DataFrames.

Every operator is a function ``f(DataFrame, keys=[...], ...) -> DataFrame``.
Runs, studies, folds and comparisons are grouping keys, so one call evaluates
any number of them in the same distributed job.
"""

__version__ = "0.1.0"
