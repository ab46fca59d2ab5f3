"""Search bookkeeping: objective score (P11), trial numbering (W5),
incumbents (W3), best trial (W4), and search spaces and plans (H1-H5).

Configuration tables are generated by arithmetic on row indices, never by
joining value lists against each other: random configurations are the first
entries of a keyed random permutation of the grid index, decoded digit by
digit, so they are distinct and none is likelier than another.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.functions.columns import nan_to_null
from evalframe.operators._keys import as_list
from evalframe.operators.ranking import prefix_sums, running_max
from evalframe.operators.vocab import dense_positions

# --- P11 --------------------------------------------------------------------

DISPARITY_COLUMNS = ("mean_demographic_parity_difference", "mean_equal_opportunity_difference")


def objective_score(trials: DataFrame, metric: str = "balanced_accuracy", fairness_weight: float = 0.0,
                    out: str = "objective_score") -> DataFrame:
    """Metric - w * (|DPD| + |EOD|) when w > 0; a NULL/NaN metric scores
    -inf; a missing (absent or NULL) disparity counts as 0; an unknown metric
    is an error."""
    if metric not in trials.columns:
        raise ValueError(f"the trials have no metric column {metric!r}")
    m = nan_to_null(F.col(metric).cast("double"))
    score = F.coalesce(m, F.lit(float("-inf")))
    if fairness_weight > 0:
        pen = F.lit(0.0)
        for c in DISPARITY_COLUMNS:
            if c in trials.columns:
                pen = pen + F.abs(F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(0.0)))
        score = F.when(m.isNull(), score).otherwise(m - F.lit(float(fairness_weight)) * pen)
    return trials.withColumn(out, score)


# --- W5 ---------------------------------------------------------------------

def number_trials(df: DataFrame, keys, order_cols, out: str = "iteration",
                  bucket: Column | None = None) -> DataFrame:
    """1-based trial number per run in the given order (``order_cols``
    must be unique per run).  A hot run is numbered across many tasks: by the
    ranges of ``dense_positions``, or by ``bucket`` where the caller knows one
    that is monotone in the order (it saves writing the rows once)."""
    if bucket is None:
        return dense_positions(df, keys, order_cols, "__at").withColumn(out, (F.col("__at") + 1).cast("int")).drop("__at")
    one = df.withColumn("__one", F.lit(1))
    r = prefix_sums(one, keys, order_cols, "__one", bucket)
    return r.withColumn(out, (F.col("__one_below") + 1).cast("int")).drop("__one", "__one_below")


# --- W3 ---------------------------------------------------------------------

def _valid(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & (score != F.lit(float("-inf")))


def incumbents(trials: DataFrame, keys, iteration: str = "iteration", score: str = "objective_score",
               bucket_size: int | None = 4096) -> DataFrame:
    """Best score so far and the iteration that set it (strict
    improvement, so the earliest of equal scores stays incumbent); NULL until
    the first valid trial."""
    keys = as_list(keys)
    s = F.col(score).cast("double")
    v = F.when(_valid(s), F.struct(s.alias("s"), (-F.col(iteration)).alias("neg_it")))
    t = trials.withColumn("__v", v)
    bucket = None if not bucket_size else F.floor(F.col(iteration) / bucket_size).cast("long")
    r = running_max(t, keys, [iteration], "__v", "__best", bucket)
    return r.select(*keys, iteration, score, F.col("__best.s").alias("best_so_far"),
                    (-F.col("__best.neg_it")).cast("int").alias("incumbent_iteration"))


# --- W4 ---------------------------------------------------------------------

def best_trial(trials: DataFrame, keys, iteration: str = "iteration", score: str = "objective_score",
               carry=("params",)) -> DataFrame:
    """The trial with the highest valid score per run, earliest on ties
    (hash aggregate with ``min_by``, no sort).  Runs without a valid trial
    come back with NULLs and an ``error`` text."""
    keys = as_list(keys)
    carry = [c for c in as_list(carry) if c in trials.columns]
    s = F.col(score).cast("double")
    order = F.when(_valid(s), F.struct((-s).alias("neg"), F.col(iteration).alias("it")))
    best = F.min_by(F.struct(F.col(iteration).alias("i"), s.alias("s"), *[F.col(c) for c in carry]), order)
    g = trials.groupBy(*keys).agg(best.alias("__b"), F.count(order).alias("__n"))
    return g.select(*keys, F.col("__b.i").alias(iteration), F.col("__b.s").alias(score),
                    *[F.col(f"__b.{c}").alias(c) for c in carry],
                    F.when(F.col("__n") == 0, F.lit("search did not produce a valid configuration")).alias("error"))


# --- H1 ---------------------------------------------------------------------

ROUNDS = 8


def _halves(grid: int) -> tuple[int, int]:
    """a x b cells that cover the grid: exactly where it has a divisor near its root, else the
    next rectangle (fewer than a cells too many)."""
    root = math.isqrt(grid)
    exact = next((d for d in range(root, 0, -1) if grid % d == 0), 1)
    if exact * exact * 16 >= grid:
        return exact, grid // exact
    a = root + (root * root < grid)
    return a, -(-grid // a)


def _permuted(index: Column, grid: int, key: Column) -> Column:
    """A keyed permutation of 0 .. grid-1: a Feistel network whose halves are counted modulo a
    and b, walked on while it points beyond the grid.

    The walk stays on one cycle of the permutation of all a x b cells, of which
    fewer than a lie beyond the grid, so that many steps always suffice."""
    a, b = _halves(grid)

    def mix(i, x, size):
        h = F.md5(F.concat_ws("|", key, i.cast("string"), x.cast("string")))
        return F.pmod(F.conv(F.substring(h, 1, 12), 16, 10).cast("long"), F.lit(size))

    def turn(acc, i):
        left = F.pmod(acc["l"] + mix(i, acc["r"], a), F.lit(a))
        right = F.pmod(acc["r"] + mix(i, acc["l"], b), F.lit(b))
        return F.when(i % 2 == 0, F.struct(left.alias("l"), acc["r"].alias("r"))).otherwise(
            F.struct(acc["l"].alias("l"), right.alias("r")))

    def step(x):
        start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, F.lit(b)).cast("long").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: acc["l"] * b + acc["r"])

    x = step(index.cast("long"))
    if a * b == grid:
        return x
    return F.aggregate(F.sequence(F.lit(1), F.lit(a * b - grid)), x, lambda acc, _: F.when(acc >= grid, step(acc)).otherwise(acc))


def _text(v) -> str | None:
    return None if v is None else str(v)


def random_configs(spark: SparkSession, space: dict, n: int, seed: int = 42,
                   studies: DataFrame | None = None, keys=()) -> DataFrame:
    """H1: ``n`` distinct configurations of a discrete grid per study, drawn
    without replacement (n is capped at the grid size; n <= 0 is an error).
    Output: keys, ``config_rank`` 1..n, ``config_index`` in the grid, one text
    column per parameter."""
    if n <= 0:
        raise ValueError("at least one configuration must be drawn")
    keys = as_list(keys)
    names = list(space)
    sizes = [len(space[p]) for p in names]
    grid = math.prod(sizes)
    take = min(n, grid)
    base = studies.select(*keys).distinct() if studies is not None else spark.range(1).select()
    key = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    rows = base.select(*keys, key.alias("__key"), F.explode(F.sequence(F.lit(0), F.lit(take - 1))).alias("__j"))
    idx = _permuted(F.col("__j"), grid, F.col("__key"))
    rows = rows.select(*keys, (F.col("__j") + 1).cast("int").alias("config_rank"), idx.alias("config_index"))
    stride = 1
    cols = {}
    for p, size in reversed(list(zip(names, sizes))):
        vals = F.array(*[F.lit(_text(v)).cast("string") for v in space[p]])
        digit = F.pmod(F.floor(F.col("config_index") / stride), F.lit(size))
        cols[p] = F.element_at(vals, (digit + 1).cast("int"))
        stride *= size
    return rows.select(*keys, "config_rank", "config_index", *[cols[p].alias(p) for p in names])


# --- H2 ---------------------------------------------------------------------

def _uniform(seed: int, keys, param: str, i: Column) -> Column:
    """Hash-uniform in [0, 1): 52 bits of md5(seed|keys|param|i), exact as a double."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.lit(param),
                          i.cast("string")))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2 ** 52))


def sample_space(spark: SparkSession, space: dict, n: int, seed: int = 42,
                 studies: DataFrame | None = None, keys=()) -> DataFrame:
    """H2: ``n`` candidate configurations of a mixed space per study:
    ``integer`` uniform on [low, high] inclusive, ``real`` uniform or
    log-uniform (``prior``), ``categorical`` uniform over ``values``.
    Unknown kinds are an error."""
    if n <= 0:
        raise ValueError("at least one candidate must be drawn")
    keys = as_list(keys)
    base = studies.select(*keys).distinct() if studies is not None else spark.range(1).select()
    rows = base.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("candidate"))
    cols = []
    for p, spec in space.items():
        kind = spec.get("type")
        u = _uniform(seed, keys, p, F.col("candidate"))
        if kind == "integer":
            lo, hi = int(spec["low"]), int(spec["high"])
            cols.append((F.lit(lo) + F.floor(u * (hi - lo + 1))).cast("long").alias(p))
        elif kind == "real":
            lo, hi = float(spec["low"]), float(spec["high"])
            if spec.get("prior", "uniform") in ("log-uniform", "log_uniform", "log"):
                cols.append(F.exp(F.lit(math.log(lo)) + u * F.lit(math.log(hi) - math.log(lo))).alias(p))
            else:
                cols.append((F.lit(lo) + u * F.lit(hi - lo)).alias(p))
        elif kind == "categorical":
            vals = F.array(*[F.lit(_text(v)).cast("string") for v in spec["values"]])
            cols.append(F.element_at(vals, (F.floor(u * len(spec["values"])) + 1).cast("int")).alias(p))
        else:
            raise ValueError(f"parameter {p!r} has no known type: {kind!r}")
    return rows.select(*keys, F.col("candidate").cast("int").alias("candidate"), *cols)


# --- H3 / H4: fixed configuration tables -------------------------------------

# Default configurations per model.
DEFAULT_PARAMS = {
    "random_forest": {"n_estimators": 100, "max_depth": None, "min_samples_split": 2, "min_samples_leaf": 1,
                      "max_features": "sqrt"},
    "xgboost": {"n_estimators": 100, "max_depth": 6, "learning_rate": 0.1, "subsample": 1.0,
                "colsample_bytree": 1.0},
}

# Search spaces per model and method.
SEARCH_SPACES = {
    ("random_forest", "random"): {
        "n_estimators": [50, 100], "max_depth": [None, 5, 10, 20], "min_samples_split": [2, 5, 10],
        "min_samples_leaf": [1, 2, 4], "max_features": ["sqrt", "log2"]},
    ("random_forest", "bayesian"): {
        "n_estimators": {"type": "integer", "low": 50, "high": 100},
        "max_depth": {"type": "integer", "low": 3, "high": 20},
        "min_samples_split": {"type": "integer", "low": 2, "high": 10},
        "min_samples_leaf": {"type": "integer", "low": 1, "high": 4}},
    ("xgboost", "random"): {
        "n_estimators": [50, 100], "max_depth": [3, 5, 7], "learning_rate": [0.03, 0.05, 0.1],
        "subsample": [0.8, 1.0], "colsample_bytree": [0.8, 1.0], "min_child_weight": [1, 3, 5]},
    ("xgboost", "bayesian"): {
        "n_estimators": {"type": "integer", "low": 50, "high": 100},
        "max_depth": {"type": "integer", "low": 3, "high": 7},
        "learning_rate": {"type": "real", "low": 0.03, "high": 0.1},
        "subsample": {"type": "real", "low": 0.8, "high": 1.0},
        "colsample_bytree": {"type": "real", "low": 0.8, "high": 1.0},
        "min_child_weight": {"type": "integer", "low": 1, "high": 5}},
}


def default_configs(spark: SparkSession) -> DataFrame:
    """H3: (model, param, value text) rows of the default configurations."""
    rows = [(m, p, _text(v)) for m, ps in DEFAULT_PARAMS.items() for p, v in ps.items()]
    return spark.createDataFrame(rows, "model string, param string, value string")


def space_table(spark: SparkSession, spaces: dict | None = None) -> DataFrame:
    """H4: (model, method, param, kind, low, high, prior, values) rows."""
    rows = []
    for (model, method), space in (spaces or SEARCH_SPACES).items():
        for p, spec in space.items():
            if isinstance(spec, dict):
                rows.append((model, method, p, spec["type"], _num(spec.get("low")), _num(spec.get("high")),
                             spec.get("prior"), [_text(v) for v in spec.get("values", [])] or None))
            else:
                rows.append((model, method, p, "discrete", None, None, None, [_text(v) for v in spec]))
    return spark.createDataFrame(rows, "model string, method string, param string, kind string, low double, "
                                       "high double, prior string, values array<string>")


def _num(v):
    return None if v is None else float(v)


# --- H5 ---------------------------------------------------------------------

def experiment_plan(datasets: DataFrame, folds=(1, 2, 3, 4, 5), models=("random_forest", "xgboost"),
                    methods=("random", "bayesian"), dataset: str = "dataset") -> DataFrame:
    """H5: datasets x folds x models x methods, numbered in nested-loop order
    (dataset, fold, model, method).  Each dataset fans out to the fixed
    folds x models x methods cells with ``explode``; the number is computed
    from the dataset's rank and the cell's position.  No datasets is an error."""
    from pyspark.sql import Window
    cells = [F.struct(F.lit(i).alias("_cell"), F.lit(f).alias("outer_fold"), F.lit(m).alias("model"),
                      F.lit(k).alias("optimizer"))
             for i, (f, m, k) in enumerate((f, m, k) for f in folds for m in models for k in methods)]
    ds = datasets.select(F.col(dataset).alias("dataset")).distinct()
    if ds.isEmpty():
        raise ValueError("no datasets configured")
    # the distinct dataset list is configuration-sized: ranking it is cheap
    ranked = ds.withColumn("_rank", F.dense_rank().over(Window.orderBy("dataset")))
    rows = ranked.select("dataset", "_rank", F.explode(F.array(*cells)).alias("c")).select("dataset", "_rank", "c.*")
    eid = ((F.col("_rank") - 1) * len(cells) + F.col("_cell") + 1).cast("int")
    return rows.select(eid.alias("experiment_id"), "dataset", "outer_fold", "model", "optimizer")
