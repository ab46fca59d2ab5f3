"""Running an experiment plan (M11): many searches, isolated failures, restart.

Each plan row runs in a scheduler pool of its own, so that with
``spark.scheduler.mode=FAIR`` the searches share the executors evenly.  A row
that ends leaves its result (or its error) in the store at once; a plan that
was killed is given again and runs only the rows without a result.
"""

from __future__ import annotations

import hashlib
import json
import threading
import traceback
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.operators.search import SearchResult, TrialStore, run_search
from evalframe.sources import paths

PLAN_KEYS = ("dataset", "outer_fold", "model", "optimizer")
KEY_SCHEMA = "dataset string, outer_fold int, model string, optimizer string"
FAILURE_SCHEMA = f"{KEY_SCHEMA}, error string, trace string"


@dataclass
class Dataset:
    """What a search needs of a data set; ``outer`` has row id, label and outer_fold."""
    examples: DataFrame
    outer: DataFrame
    sensitive: str | None = None


class PlanStore:
    """Results, failures and trials, one folder for each plan row and kind.

    Rows write to folders of their own: two that end at the same moment can't
    disturb each other, and running a row again replaces what it left.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.trials = TrialStore(spark, f"{self.path}/trials")

    @staticmethod
    def name(row: dict) -> str:
        return hashlib.md5(json.dumps([str(row[k]) for k in PLAN_KEYS]).encode()).hexdigest()

    def put(self, kind: str, row: dict, table: DataFrame) -> None:
        table.write.mode("overwrite").parquet(f"{self.path}/{kind}/experiment={self.name(row)}")

    def _complete(self, kind: str) -> list[str]:
        return [p for p in paths.children(self.spark, f"{self.path}/{kind}") if paths.is_complete(self.spark, p)]

    def results(self) -> DataFrame | None:
        done = self._complete("results")
        return self.spark.read.parquet(*done) if done else None

    def failures(self) -> DataFrame:
        """Rows whose last run failed (a later result takes the failure away)."""
        done = self._complete("failures")
        failed = self.spark.read.schema(FAILURE_SCHEMA).parquet(*done) if done else self.spark.createDataFrame([], FAILURE_SCHEMA)
        ok = self.results()
        return failed if ok is None else failed.join(ok.select(*PLAN_KEYS), list(PLAN_KEYS), "left_anti")

    def history(self) -> DataFrame | None:
        """The trials of all plan rows; parameters as JSON (spaces differ between models)."""
        folders = [b for run in paths.children(self.spark, self.trials.path)
                   for b in self.trials.batches(run.rsplit("run=", 1)[1])]
        if not folders:
            return None
        return (self.spark.read.option("mergeSchema", True).option("basePath", self.trials.path).parquet(*folders)
                .withColumnRenamed("run", "experiment").drop("batch"))


def open_rows(plan: DataFrame, store: PlanStore, retry_failures: bool = True) -> DataFrame:
    """Plan rows that have no stored result (nor, without ``retry_failures``, a stored failure)."""
    rows = plan.withColumn("outer_fold", F.col("outer_fold").cast("int"))
    done = store.results()
    if done is not None:
        rows = rows.join(done.select(*PLAN_KEYS), list(PLAN_KEYS), "left_anti")
    if not retry_failures:
        rows = rows.join(store.failures().select(*PLAN_KEYS), list(PLAN_KEYS), "left_anti")
    return rows


def run_plan(plan: DataFrame, resolve: Callable[[str], Dataset], configs_for: Callable[[dict], object], store: PlanStore,
             parallel: int = 2, retry_failures: bool = True, search: Callable[..., SearchResult] = run_search,
             **kw) -> PlanStore:
    """Run every open row of ``plan`` (dataset, outer_fold, model, optimizer).

    ``resolve`` gives the data set of a name and is asked once for each;
    ``configs_for`` the candidates of a plan row (a plain dict).  What either
    of them, the search or a fit raises becomes a row of ``store.failures()``
    and the others go on.  ``parallel`` rows run at a time; ``kw`` goes to
    ``search``.  The plan itself is a small table (datasets x folds x models x
    methods).
    """
    spark = plan.sparkSession
    todo = [r.asDict() for r in open_rows(plan, store, retry_failures).orderBy(*PLAN_KEYS).collect()]
    datasets: dict[str, Dataset] = {}
    locks = {r["dataset"]: threading.Lock() for r in todo}

    def dataset_of(name: str) -> Dataset:
        with locks[name]:                      # rows of one data set wait for its first load
            if name not in datasets:
                datasets[name] = resolve(name)
            return datasets[name]

    def one(row: dict) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", store.name(row))
        try:
            data = dataset_of(row["dataset"])
            found = search(data.examples, data.outer, row["outer_fold"], row["model"], configs_for(row),
                           optimizer=row["optimizer"], sensitive=data.sensitive, dataset=row["dataset"],
                           store=store.trials, run=store.name(row), **kw)
            store.put("results", row, found.result.coalesce(1))
        except Exception as e:  # noqa: BLE001 - isolation is the feature
            failure = (*[row[k] for k in PLAN_KEYS], str(e), traceback.format_exc())
            store.put("failures", row, spark.createDataFrame([failure], FAILURE_SCHEMA).coalesce(1))
        finally:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", None)

    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(one), row) for row in todo]
        try:
            for job in jobs:
                job.result()                   # only what is no Exception gets here: the plan was stopped
        except BaseException:
            for job in jobs:
                job.cancel()
            raise
    return store
