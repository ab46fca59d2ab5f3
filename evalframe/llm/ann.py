"""Nearest neighbours by inner product: inverted lists, adaptive dimension scan.

Largest inner product becomes smallest distance with one more component,
sqrt(M^2 - |x|^2) for rows and 0 for queries (M: the largest norm).  Vectors
are rotated at random, so that after ``d`` of ``D`` components the partial
distance times D / d estimates the whole.  Rows lie in lists around centroids
fitted on a bounded sample.  How many of them a query reads follows from the
data: for a bounded set of queries the true nearest are found by brute force,
and as many lists are probed as hold ``RECALL`` of them.  The first ``PROBES`` give
each query a score to beat, so that the others return few rows.  Within each
probed list the columns are read in blocks, and after each block a candidate is given up when its scaled partial
distance is beyond the query's k-th best by more than the test allows.
What remains is scored exactly on the original vectors.

Equal vectors are one entry that knows its ``k + 1`` smallest ids, which is
all that any query can return of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm._store import stored

K = 20
ROWS_PER_LIST = 400        # lists grow in number with the table
MAX_LISTS = 4096           # bound of the centroids that are broadcast
PROBES = 24                # lists read first for each query, and the fewest
RECALL = 0.95              # share of the true nearest that the probed lists hold; the column test may lose a little more
MEASURED = 256             # queries that it is measured on
SAMPLE_ROWS = 50_000       # bound of the sample the centroids are fitted on
COLUMNS = 16               # components read between two tests
EPSILON = 2.1              # of the test: larger gives up fewer near ones
CHUNK_ROWS = 20_000        # rows of a list that one group holds
CHUNK_QUERIES = 2_000      # queries that one group holds


def clean(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): finite, non-zero vectors of the most common length (ties: the longer)."""
    v = F.col(vec_col).cast("array<double>")
    ok = (F.col(id_col).isNotNull() & v.isNotNull()
          & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0))
    rows = vectors.filter(F.coalesce(ok, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("v") == (length["d"] if length else 0))


def _rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(97).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _centroids(x: np.ndarray, n_lists: int, rounds: int = 8) -> np.ndarray:
    """k-means on the sample."""
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), n_lists, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c, 1)[:, 0]
        n = np.bincount(near, minlength=n_lists)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int32)
    for at in range(0, len(x), 4096):
        d = (c * c).sum(1) - 2 * x[at:at + 4096] @ c.T
        if k < len(c):
            d_at = np.argpartition(d, k - 1, axis=1)[:, :k]
        else:
            d_at = np.tile(np.arange(len(c)), (len(d), 1))
        out[at:at + 4096] = np.take_along_axis(d_at, np.take_along_axis(d, d_at, 1).argsort(1, kind="stable"), 1)
    return out


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed from left to right."""
    s = np.zeros(len(q))
    for j in range(q.shape[1]):
        s += q[:, j] * x[:, j]
    return s


def _scan(rows: np.ndarray, queries: np.ndarray, k: int, width: np.ndarray,
          limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) pairs that may be among a query's ``k`` nearest in this list.

    ``width``: ids that an entry stands for, so that the k-th best counts copies.
    ``limit``: squared distance beyond which a row is of no use to a query.
    """
    dim = rows.shape[1]
    n = len(rows)
    first = min(n, max(4 * k, 256))
    # the k-th best of the first rows, read in full, is where each query starts
    d = ((queries * queries).sum(1)[:, None] - 2 * queries @ rows[:first].T + (rows[:first] ** 2).sum(1))
    d = np.maximum(d, 0)
    bar = np.minimum(_kth(d, width[:first], k), limit)
    q_at, r_at = [np.nonzero(d <= bar[:, None])[0]], [np.nonzero(d <= bar[:, None])[1]]
    for at in range(first, n, 4096):
        block = rows[at:at + 4096]
        part = np.zeros((len(queries), len(block)))
        qi = ri = None
        for col in range(0, dim, COLUMNS):
            to = min(col + COLUMNS, dim)
            if qi is None:
                a, b = queries[:, col:to], block[:, col:to]
                part += np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)
                limit = bar * (to / dim) * (1 + EPSILON / np.sqrt(to)) ** 2 if to < dim else bar
                qi, ri = np.nonzero(part <= limit[:, None])
                part = part[qi, ri]
            else:
                diff = queries[qi, col:to] - block[ri, col:to]
                part = part + np.einsum("ij,ij->i", diff, diff)
                limit = bar * (to / dim) * (1 + EPSILON / np.sqrt(to)) ** 2 if to < dim else bar
                stay = part <= limit[qi] * (1 + 1e-9)
                qi, ri, part = qi[stay], ri[stay], part[stay]
        q_at.append(qi)
        r_at.append(ri + at)
        # survivors are fully measured: they tighten the bar of their queries for the next rows
        if len(qi) and at + 4096 < n:
            by = np.argsort(qi, kind="stable")
            for q, own in zip(*_groups(qi[by], by)):
                kept = np.concatenate(([bar[q]], part[own]))
                if width[ri[own] + at].sum() >= k:
                    bar[q] = min(bar[q], _kth(kept[None, 1:], width[ri[own] + at], k)[0])
    return np.concatenate(q_at), np.concatenate(r_at)


def _groups(keys: np.ndarray, values: np.ndarray):
    cut = np.flatnonzero(np.diff(keys)) + 1
    return keys[np.concatenate(([0], cut))], np.split(values, cut)


def _kth(d: np.ndarray, width: np.ndarray, k: int) -> np.ndarray:
    """The distance within which each row of ``d`` has k ids; infinite if there are fewer."""
    if int(width.sum()) < k:
        return np.full(len(d), np.inf)
    order = np.argsort(d, axis=1, kind="stable")
    reach = (np.cumsum(width[order], axis=1) >= k).argmax(axis=1)
    return np.take_along_axis(d, np.take_along_axis(order, reach[:, None], 1), 1)[:, 0] * (1 + 1e-9) + 1e-12


def _group_search(k: int, top: float):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"qvec": [], "ids": [], "score": []}).astype({"qvec": "int64", "score": "float64"})
        rows = np.stack(left["r"].to_numpy())
        queries = np.stack(right["r"].to_numpy())
        ids = left["ids"].to_numpy()
        x, q = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        beat = right["beat"].to_numpy()
        size = (q * q).sum(1) + top             # the distance of a score is size - 2 * score
        qi, ri = _scan(rows, queries, k, np.array([len(i) for i in ids]), size - 2 * beat + 1e-9 * size)
        score = _exact(q[qi], x[ri])
        useful = score >= beat[qi]
        qi, ri, score = qi[useful], ri[useful], score[useful]
        if not qi.size:
            return pd.DataFrame({"qvec": [], "ids": [], "score": []}).astype({"qvec": "int64", "score": "float64"})
        # of a query's pairs only its best k can be in the result
        by = np.lexsort((ri, -score, qi))
        qi, ri, score = qi[by], ri[by], score[by]
        start = np.maximum.accumulate(np.where(np.r_[True, qi[1:] != qi[:-1]], np.arange(qi.size), 0))
        nth = np.arange(qi.size) - start
        last = score[np.minimum(start + k - 1, qi.size - 1)]
        stay = (nth < k) | ((score == last) & (qi == qi[np.minimum(start + k - 1, qi.size - 1)]))
        return pd.DataFrame({"qvec": right["qvec"].to_numpy()[qi[stay]], "ids": ids[ri[stay]], "score": score[stay]})
    return run


def _best_entries(qvec: np.ndarray, queries: np.ndarray, k: int):
    """(of, qvec, n, list, score): each query's best entries of a batch, by brute force."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                s = queries @ np.stack(b["v"].to_numpy()).T
                top = min(k, len(b))
                at = np.argpartition(-s, top - 1, axis=1)[:, :top]
                own = at.ravel()
                yield pd.DataFrame({"of": np.repeat(qvec, top), "qvec": b["qvec"].to_numpy()[own],
                                    "n": b["n"].to_numpy()[own], "list": b["list"].to_numpy()[own],
                                    "score": np.take_along_axis(s, at, 1).ravel()})
    return run


def _probes_needed(true: pd.DataFrame, qvec: np.ndarray, order: np.ndarray, k: int) -> int:
    """The fewest lists that hold ``RECALL`` of the ``k`` nearest ids of the measured queries.

    ``order``: for each of them all lists, nearest first.
    """
    row = {q: i for i, q in enumerate(qvec.tolist())}
    rank = np.argsort(order, axis=1)
    held = np.zeros(order.shape[1] + 1)
    for of, own in true.sort_values(["of", "score", "qvec"], ascending=[True, False, True]).groupby("of"):
        n = own["n"].to_numpy() - (own["qvec"].to_numpy() == of)      # one id of its own entry is the query
        n = np.minimum(n, np.maximum(k - (np.cumsum(n) - n), 0))
        np.add.at(held, rank[row[of], own["list"].to_numpy()] + 1, n)
    reached = np.cumsum(held)
    return int(np.argmax(reached >= RECALL * reached[-1]))


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20, k: int = K,
            probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest inner product
    for each row whose id is divisible by ``every``, among all others.

    Null, zero and non-finite vectors and those of another length than most
    take no part.  Ties go to the smaller id.  A row that repeats an id and
    its vector counts once.  An empty table has no result.  At least
    ``probes`` lists are read for a query, more where the measured recall
    needs more.
    """
    spark = vectors.sparkSession
    rows = clean(vectors, id_col, vec_col).distinct()
    by_vec = Window.partitionBy("v").orderBy("id")
    # only the k + 1 smallest ids of equal vectors can be returned; the limit is applied before the shuffle
    few = rows.withColumn("nth", F.row_number().over(by_vec)).filter(F.col("nth") <= k + 1)
    entries = stored(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
                     .withColumn("qvec", F.monotonically_increasing_id()), "ann-entries")
    n = entries.count()
    result = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], result)
    norm2 = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x)
    dim, top = entries.agg(F.max(F.size("v")), F.max(norm2(F.col("v")))).first()
    share = min(1.0, SAMPLE_ROWS / n)
    cut = int(share * 2 ** 31)
    sample = entries.filter(F.pmod(F.xxhash64("v"), F.lit(2 ** 31)) < cut).select("v").toPandas()
    if sample.empty:
        sample = entries.select("v").limit(1).toPandas()

    turn = _rotation(dim + 1)

    def rotated(v: np.ndarray, rows: bool) -> np.ndarray:
        extra = np.sqrt(np.maximum(top - (v * v).sum(1), 0)) if rows else np.zeros(len(v))
        return np.column_stack((v, extra)) @ turn

    x = rotated(np.stack(sample["v"].to_numpy()), True)
    n_lists = int(min(MAX_LISTS, len(x), max(1, -(-n // ROWS_PER_LIST))))
    shared = spark.sparkContext.broadcast(_centroids(x, n_lists))     # at most MAX_LISTS vectors
    probes = min(probes, n_lists)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                r = rotated(np.stack(b["v"].to_numpy()), True)
                yield b.assign(list=_nearest(r, shared.value, 1)[:, 0], r=list(r))

    is_query = F.col("id") % every == 0
    queries_of = stored(rows.filter(is_query).join(entries.select("v", "qvec"), "v").select("id", "qvec"), "ann-queries")
    asked = entries.join(queries_of.select("qvec").distinct(), "qvec", "left_semi")
    placed = stored(entries.mapInPandas(
        assign, "v array<double>, ids array<long>, qvec long, list int, r array<double>"), "ann-placed")
    if probes < n_lists:
        some = asked.orderBy(F.xxhash64("v"), "qvec").limit(MEASURED).select("qvec", "v").toPandas()
        if len(some):
            qvec, v = some["qvec"].to_numpy(), np.stack(some["v"].to_numpy())
            by_score = Window.partitionBy("of").orderBy(F.desc("score"), F.col("qvec"))
            true = (placed.select("v", "qvec", F.size("ids").alias("n"), "list")
                    .mapInPandas(_best_entries(qvec, v, k + 1), "of long, qvec long, n long, list int, score double")
                    .withColumn("nth", F.row_number().over(by_score)).filter(F.col("nth") <= k + 1).toPandas())
            order = _nearest(rotated(v, False), shared.value, n_lists)
            probes = max(probes, _probes_needed(true, qvec, order, k))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                r = rotated(np.stack(b["v"].to_numpy()), False)
                yield b.assign(r=list(r), lists=list(_nearest(r, shared.value, probes)))

    # a query's vectors are stored once, however many lists it reads
    probed = stored(asked.select("qvec", "v").mapInPandas(
        probe, "qvec long, v array<double>, r array<double>, lists array<int>"), "ann-probed")
    best = Window.partitionBy("qvec").orderBy(F.desc("score"), F.col("vec_id"))

    def best_of(found: DataFrame) -> DataFrame:
        # of k + 1 ids one may be the query's own
        return found.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1).drop("nth")

    def search(probed: DataFrame) -> DataFrame:
        """(qvec, score, vec_id) from the lists in ``probed`` (qvec, v, r, beat, lists), of scores that reach ``beat``."""
        probed = probed.withColumn("list", F.explode("lists")).drop("lists")
        # big lists in chunks of rows, and their queries in chunks: every pair of chunks is one group
        chunks = (placed.groupBy("list").agg(F.count("*").alias("n_rows"))
                  .join(probed.groupBy("list").agg(F.count("*").alias("n_queries")), "list")
                  .select("list", F.ceil(F.col("n_rows") / CHUNK_ROWS).cast("int").alias("row_chunks"),
                          F.ceil(F.col("n_queries") / CHUNK_QUERIES).cast("int").alias("query_chunks")))
        left = (placed.join(chunks, "list")
                .withColumn("rc", F.pmod(F.xxhash64("qvec"), "row_chunks").cast("int"))
                .withColumn("qc", F.explode(F.sequence(F.lit(0), F.col("query_chunks") - 1)))
                .select("list", "rc", "qc", "ids", "v", "r"))
        right = (probed.join(chunks, "list")
                 .withColumn("qc", F.pmod(F.xxhash64("qvec"), "query_chunks").cast("int"))
                 .withColumn("rc", F.explode(F.sequence(F.lit(0), F.col("row_chunks") - 1)))
                 .select("list", "rc", "qc", "qvec", "v", "r", "beat"))
        key = ["list", "rc", "qc"]
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
            _group_search(k + 1, top), "qvec long, ids array<long>, score double")
        return best_of(found.select("qvec", "score", F.explode("ids").alias("vec_id")))

    first = min(probes, PROBES)
    found = search(probed.withColumns({"beat": F.lit(float("-inf")), "lists": F.slice("lists", 1, first)}))
    if probes > first:
        found = stored(found, "ann-first")
        reached = found.groupBy("qvec").agg(F.when(F.count("*") > k, F.min("score")).alias("beat"))
        rest = (probed.join(reached, "qvec", "left").withColumn("beat", F.coalesce("beat", F.lit(float("-inf"))))
                .withColumn("lists", F.slice("lists", first + 1, probes - first)))
        found = best_of(found.unionByName(search(rest)))
    per_query = Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id"))
    return (queries_of.withColumnRenamed("id", "query_id").join(found, "qvec").filter("query_id <> vec_id")
            .withColumn("rank", F.row_number().over(per_query)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
