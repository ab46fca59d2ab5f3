"""Search loops over a growing trial table.

A search is a sequence of batches.  Each batch takes new configurations from a
candidate table (any size, distributed), evaluates all of them in one grouped
job and appends its trials to a store; the next batch reads what is stored.
So the store is the search's whole state: a search that was killed goes on
after its last complete batch and ends with the same trials.

``random`` takes candidates in a seeded hash order.  ``guided`` starts that
way, then fits a random-forest surrogate on the trials so far and picks by
mean plus ``kappa`` times deviation; within a batch each pick lowers the
acquisition around it (local penalty), so that a batch spreads.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.operators import metrics as M
from evalframe.operators import models as MO
from evalframe.operators._keys import as_list
from evalframe.operators.trials import best_trial, objective_score
from evalframe.operators.vocab import value_index, with_positions
from evalframe.session import cut_lineage, ensure_checkpoint_dir
from evalframe.sources import paths

METHODS = ("random", "guided", "bayesian")     # bayesian: the guided search under its usual name
NO_SCORE = float("-inf")
FIT_ROWS = 500_000     # trials that one task of the surrogate's fit reads, on average
SAME_ROWS = 10_000     # equal trials that go to one task together


# --- trial store --------------------------------------------------------------

class TrialStore:
    """Trials as Parquet, one folder for each batch of a run: written whole, then marked.

    A batch that a lost driver left half written has no mark, is not read and
    is written anew."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, run: str, batch: int) -> str:
        return f"{self.path}/run={run}/batch={batch:06d}"

    def append(self, trials: DataFrame, run: str, batch: int) -> None:
        trials.write.mode("overwrite").parquet(self._folder(run, batch))

    def batches(self, run: str) -> list[str]:
        """Folders of the complete batches of a run, up to the first gap."""
        done = []
        while paths.is_complete(self.spark, self._folder(run, len(done))):
            done.append(self._folder(run, len(done)))
        return done

    def trials(self, run: str) -> DataFrame | None:
        """All trials of a run; None before its first batch."""
        done = self.batches(run)
        return self.spark.read.option("mergeSchema", True).parquet(*done) if done else None


# --- candidates ---------------------------------------------------------------

def typed_params(candidates: DataFrame, cols) -> DataFrame:
    """Text parameters whose values are all whole numbers become longs, all numbers doubles."""
    cols = [c for c in as_list(cols) if dict(candidates.dtypes)[c] == "string"]
    if not cols:
        return candidates
    bad = candidates.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(f"{c}__{t}")
                           for c in cols for t in ("bigint", "double")]).first()
    for c in cols:
        kind = next((t for t in ("bigint", "double") if not bad[f"{c}__{t}"]), None)
        if kind:
            candidates = candidates.withColumn(c, F.col(c).try_cast(kind))
    return candidates


def as_candidates(spark: SparkSession, configs) -> DataFrame:
    """A list of parameter dicts (or a DataFrame, unchanged) as a table with one column per parameter."""
    if isinstance(configs, DataFrame):
        return configs
    names = sorted({k for c in configs for k in c})
    kinds = {}
    for n in names:
        values = [c[n] for c in configs if c.get(n) is not None]
        kinds[n] = ("long" if all(isinstance(v, int) for v in values) else
                    "double" if all(isinstance(v, (int, float)) for v in values) else "string")
    py = {"long": int, "double": float, "string": str}
    rows = [tuple(None if c.get(n) is None else py[kinds[n]](c[n]) for n in names) for c in configs]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {kinds[n]}" for n in names))


def _params(cols) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in cols]))


def _order(cols, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), _params(cols)))


def _untried(candidates: DataFrame, history: DataFrame | None, cols) -> DataFrame:
    """Distinct candidates that the history does not hold (equal parameters, nulls included)."""
    left = candidates.select(*cols).distinct().withColumn("__params", _params(cols))
    if history is None:
        return left
    return left.join(history.select(F.col("params").alias("__params")).distinct(), "__params", "left_anti")


# --- surrogate ------------------------------------------------------------------

def _valid(score: str) -> Column:
    s = F.col(score).cast("double")
    return s.isNotNull() & ~F.isnan(s) & (s != F.lit(NO_SCORE))


def _training_rows(rows: DataFrame) -> DataFrame:
    """The same rows, dealt to tasks of about ``FIT_ROWS`` in an order that only the rows decide.

    Equal rows travel as one row with a count, in pieces of ``SAME_ROWS``, and
    are copies again where they arrive: neither a long history nor a trial
    repeated millions of times meets in one task."""
    cols = rows.columns
    counted = cut_lineage(rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")))
    n = counted.agg(F.sum("__n")).first()[0] or 0
    pieces = counted.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {SAME_ROWS}"))))
    dealt = pieces.repartition(max(1, -(-n // FIT_ROWS)), *cols, "__piece")
    copies = F.least(F.lit(SAME_ROWS).cast("long"), F.col("__n") - F.col("__piece") * SAME_ROWS).cast("int")
    return dealt.select(*cols, F.explode(F.array_repeat(F.lit(True), copies))).select(*cols).sortWithinPartitions(*cols)


def surrogate_scores(history: DataFrame, candidates: DataFrame, cols, kappa: float, score: str, num_trees: int,
                     seed: int) -> DataFrame:
    """``candidates`` with surrogate_mean, surrogate_sd, acquisition, and the inputs ``__x_{c}``.

    The surrogate is a random forest over the valid trials; mean and deviation
    are those of its trees.  Text values enter as their positions among all
    values seen (ranked by Spark, any number of them); a null is a value of
    its own.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor
    kinds = dict(candidates.dtypes)
    text = [c for c in cols if kinds[c] == "string"]
    valid = history.where(_valid(score))
    index = (cut_lineage(value_index(candidates.select(*text).unionByName(valid.select(*text)), text)) if text else None)

    def encoded(df: DataFrame) -> DataFrame:
        if text:
            df = with_positions(df, index, text, "__i_")
        value = lambda c: (F.col(f"__i_{c}") if c in text else F.col(c)).cast("double")
        out = df.withColumns({f"__x_{c}": F.coalesce(value(c), F.lit(-1.0)) for c in cols}
                             | {f"__null_{c}": F.col(c).isNull().cast("double") for c in cols})
        return out.drop(*[f"__i_{c}" for c in text])

    inputs = [f"__{kind}_{c}" for c in cols for kind in ("x", "null")]
    va = VectorAssembler(inputCols=inputs, outputCol="__features", handleInvalid="error")
    # fixed partitions in a fixed order make the fit repeatable (up to FIT_ROWS trials to the
    # last bit: one task sums them; beyond, tasks' sums may meet in another order)
    train = va.transform(_training_rows(encoded(valid.withColumn("label", F.col(score).cast("double"))).select(
        *inputs, "label")))
    rf = RandomForestRegressor(numTrees=num_trees, maxDepth=8, seed=seed, featureSubsetStrategy="all",
                               featuresCol="__features", subsamplingRate=1.0, bootstrap=True).fit(train)
    scored = va.transform(encoded(candidates))
    for i, tree in enumerate(rf.trees):
        scored = tree.setFeaturesCol("__features").setPredictionCol(f"__t{i}").transform(scored)
    votes = F.array(*[F.col(f"__t{i}") for i in range(num_trees)])
    n = float(num_trees)
    scored = scored.withColumn("surrogate_mean", F.aggregate(votes, F.lit(0.0), lambda a, x: a + x) / n)
    var = F.aggregate(votes, F.lit(0.0), lambda a, x: a + (x - F.col("surrogate_mean")) * (x - F.col("surrogate_mean"))) / n
    return (scored.withColumn("surrogate_sd", F.sqrt(var))
            .withColumn("acquisition", F.col("surrogate_mean") + F.lit(float(kappa)) * F.col("surrogate_sd"))
            .drop("__features", *[f"__t{i}" for i in range(num_trees)], *[f"__null_{c}" for c in cols]))


def propose(history: DataFrame, candidates: DataFrame, param_cols, k: int = 5, kappa: float = 1.96,
            score: str = "objective_score", num_trees: int = 20, seed: int = 7) -> DataFrame:
    """H6: the ``k`` distinct untried candidates with the highest acquisition.

    ``history`` has the parameter columns and ``score``; trials without a
    valid score are not fitted but count as tried."""
    cols = as_list(param_cols)
    as_given = {c: F.col(c).cast("double") for c in cols if dict(candidates.dtypes)[c] != "string"}
    cand = candidates.withColumns(as_given).dropDuplicates(cols)
    tried = history.withColumns(as_given).select(*[F.col(c).alias(f"__h_{c}") for c in cols]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__h_{c}")) for c in cols])
    scored = surrogate_scores(history.withColumns(as_given), cand.join(tried, same, "left_anti"), cols, kappa, score,
                              num_trees, seed)
    return scored.drop(*[f"__x_{c}" for c in cols]).orderBy(F.col("acquisition").desc(), *cols).limit(k)


def propose_batch(history: DataFrame, candidates: DataFrame, param_cols, k: int, kappa: float = 1.0,
                  spread: float = 0.1, score: str = "objective_score", num_trees: int = 20, seed: int = 7) -> DataFrame:
    """H6 for batches: ``k`` distinct candidates, each pick lowering the acquisition near it.

    The acquisition above its least value is multiplied by ``1 - exp(-d^2 / (2 spread^2))``
    for every earlier pick at distance d (root mean square over the
    parameters: numbers on a 0 to 1 scale of the candidates, texts 0 or 1).  A
    pick is one aggregate over the scored candidates; ties go to the larger
    hash.  ``candidates`` are untried already.  Result: parameters, ``rank`` from 1.
    """
    cols = as_list(param_cols)
    kinds = dict(candidates.dtypes)
    scored = surrogate_scores(history, candidates, cols, kappa, score, num_trees, seed)
    scored = cut_lineage(scored.withColumn("__hash", _order(cols, seed)))
    numbers = [c for c in cols if kinds[c] != "string"]
    edge = scored.agg(F.min("acquisition").alias("least"),
                      *[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in numbers for n, f in (("lo", F.min), ("hi", F.max))]
                      ).first()
    chosen = []
    while len(chosen) < k:
        gain = F.col("acquisition") - F.lit(edge["least"])
        for p in chosen:
            d2 = F.lit(0.0)
            for c in cols:
                width = (edge[f"hi_{c}"] or 0.0) - (edge[f"lo_{c}"] or 0.0) if c in numbers else 0.0
                apart = F.when(F.col(c).eqNullSafe(F.lit(p[c]).cast(kinds[c])), 0.0).otherwise(1.0)
                if c in numbers and p[c] is not None and width > 0:
                    apart = F.coalesce(F.pow((F.col(c).cast("double") - F.lit(float(p[c]))) / F.lit(width), 2), F.lit(1.0))
                d2 = d2 + apart
            gain = gain * (F.lit(1.0) - F.exp(-d2 / F.lit(2.0 * len(cols) * spread * spread)))
        left = scored.where(~F.col("__hash").isin([p["__hash"] for p in chosen])) if chosen else scored
        row = left.agg(F.max_by(F.struct(*cols, "__hash"), F.struct(gain.alias("g"), F.col("__hash"))).alias("p")).first()
        if row is None or row["p"] is None:
            break
        chosen.append(row["p"])
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in cols) + ", rank int"
    return candidates.sparkSession.createDataFrame([(*[p[c] for c in cols], i) for i, p in enumerate(chosen, 1)], schema)


# --- the loop -------------------------------------------------------------------

def search(candidates: DataFrame, param_cols, evaluate: Callable[[DataFrame], DataFrame], n_trials: int,
           method: str = "guided", batch: int = 4, n_initial: int | None = None,
           metric: str = "mean_balanced_accuracy", fairness_weight: float = 0.0, seed: int = 42, kappa: float = 1.0,
           spread: float = 0.1, store: TrialStore | None = None, run: str = "search",
           tags: dict | None = None) -> DataFrame:
    """M10's loop: the trial table (``tags`` as columns, iteration, optimizer, origin, params, parameters, metrics, objective_score).

    ``evaluate`` maps the rows of a batch (``iteration`` and the parameters) to
    rows of ``iteration`` and metrics, in one job for the whole batch.  Ends
    after ``n_trials`` trials or when the candidates run out.  With the same
    arguments a stored run is continued, not repeated.
    """
    if n_trials <= 0:
        raise ValueError("a search needs at least one trial")
    if method not in METHODS:
        raise ValueError(f"method {method!r} is none of {METHODS}")
    cols = as_list(param_cols)
    spark = candidates.sparkSession
    if store is None:
        store = TrialStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/trials-{time.time_ns()}")
    n_initial = max(batch, len(cols) + 1) if n_initial is None else n_initial
    while True:
        history = store.trials(run)
        n, valid = history.agg(F.count(F.lit(1)), F.count_if(_valid("objective_score"))).first() if history else (0, 0)
        if n >= n_trials:
            return history
        k = min(batch, n_trials - n)
        rest = _untried(candidates, history, cols)
        guided = method != "random" and n >= n_initial and valid >= 2
        if guided:
            picks = propose_batch(history, rest.drop("__params"), cols, k, kappa, spread, seed=seed + n)
        else:
            first = rest.select(*cols, _order(cols, seed).alias("__hash")).orderBy("__hash").limit(k).collect()
            picks = spark.createDataFrame([(*r[:-1], i) for i, r in enumerate(first, 1)],
                                          ", ".join(f"`{c}` {t}" for c, t in candidates.select(*cols).dtypes) + ", rank int")
        picks = picks.select((F.col("rank") + n).cast("int").alias("iteration"), *cols)
        if picks.isEmpty():
            if history is None:
                raise ValueError("a search needs at least one candidate")
            return history
        scored = objective_score(evaluate(picks), metric, fairness_weight)
        metrics = [c for c in scored.columns if c != "iteration"]
        trials = picks.join(scored, "iteration", "left").select(
            *[F.lit(v).alias(k) for k, v in (tags or {}).items()], "iteration", F.lit(method).alias("optimizer"), F.lit("guided" if guided else "random").alias("origin"),
            _params(cols).alias("params"), *cols,
            *[F.coalesce(F.col(c), F.lit(NO_SCORE)).alias(c) if c == "objective_score" else F.col(c) for c in metrics])
        store.append(trials.coalesce(1).sortWithinPartitions("iteration"), run, len(store.batches(run)))


# --- model search -----------------------------------------------------------------

def model_evaluator(model: str, splits: list, param_cols, seed: int = 1000, parallel: int = 4):
    """M8 for a batch: every configuration is fitted on every inner split (independent
    jobs), and all predictions are evaluated in one grouped job."""
    cols = as_list(param_cols)

    def evaluate(batch: DataFrame) -> DataFrame:
        rows = batch.collect()         # the batch: a handful of configurations

        def one(job):
            r, i, fold = job
            params = {c: r[c] for c in cols}
            return MO.predict(MO.fit_model(model, params, fold, seed), fold, {"iteration": r["iteration"], "inner_fold": i})

        jobs = [(r, i, fold) for r in rows for i, fold in enumerate(splits, 1)]
        with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
            preds = cut_lineage(reduce(DataFrame.unionByName, pool.map(one, jobs)))
        return M.mean_over_folds(M.evaluate(preds, ["iteration", "inner_fold"]), ["iteration"])
    return evaluate


@dataclass
class SearchResult:
    result: DataFrame          # one row: the chosen configuration on the outer fold
    trials: DataFrame          # one row for each trial
    best_params: dict


def run_search(examples: DataFrame, outer: DataFrame, outer_fold: int, model: str, configs, optimizer: str = "random",
               n_trials: int | None = None, batch: int = 4, metric: str = "mean_balanced_accuracy",
               fairness_weight: float = 0.0, sensitive: str | None = None, seed: int = 1000, parallel: int = 4,
               dataset: str = "dataset", store: TrialStore | None = None, run: str = "search", **kw) -> SearchResult:
    """Search on the inner folds of one outer fold (trials scored by P11), pick the best
    (W4), refit it on the outer training part and evaluate it on the outer fold (M9).

    ``configs``: candidate table or list of parameter dicts; without
    ``n_trials`` every candidate is tried.
    """
    t0 = time.time()
    spark = examples.sparkSession
    candidates = as_candidates(spark, configs)
    cols = candidates.columns
    candidates = typed_params(candidates, cols)
    n_trials = n_trials or candidates.distinct().count()
    splits = MO.inner_splits(examples, outer, outer_fold, sensitive=sensitive)
    trials = search(candidates, cols, model_evaluator(model, splits, cols, seed, parallel), n_trials, optimizer, batch,
                    metric=metric, fairness_weight=fairness_weight, store=store, run=run,
                    tags={"dataset": dataset, "outer_fold": outer_fold, "model": model}, **kw)
    best = best_trial(trials.withColumn("run", F.lit(1)), ["run"]).first()
    if best["error"]:
        raise RuntimeError(best["error"])
    chosen = trials.where(F.col("iteration") == best["iteration"]).select(*cols).first()
    params = {c: chosen[c] for c in cols}
    _, outer_metrics = MO.refit_outer(model, params, examples, outer, outer_fold, seed, sensitive=sensitive)
    result = outer_metrics.select(
        F.lit(dataset).alias("dataset"), F.lit(outer_fold).alias("outer_fold"), F.lit(model).alias("model"),
        F.lit(optimizer).alias("optimizer"), *[F.col(m) for m in M.METRICS],
        F.lit(float(best["objective_score"])).alias("best_objective_score"),
        F.lit(json.dumps(params)).alias("best_params"))
    return SearchResult(result.withColumn("runtime_seconds", F.lit(time.time() - t0)), trials, params)
