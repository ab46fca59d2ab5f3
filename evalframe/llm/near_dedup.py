"""Near-duplicate documents: MinHash bands, Bayesian pruning, exact check.

Documents are sets of word shingles.  Signatures of ``BANDS * ROWS`` MinHash
values are cut into bands; documents that agree on a band are candidates.  A
candidate pair is verified in sequence: signature values are compared batch by
batch, and with ``m`` of ``n`` equal the similarity has (uniform prior) a
Beta(m + 1, n - m + 1) posterior; the pair is dropped as soon as the
probability that it reaches the threshold falls below ``MISS``.  What survives
is checked on the full sets of both texts.

At similarity 0.8 a pair misses all 26 bands of 4 with probability
(1 - 0.8^4)^26 = 1.1e-6.
"""

from __future__ import annotations

import functools
import math
import re
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm._graph import linked_components
from evalframe.llm._store import FEW_ROWS, settled, stored, with_texts

BANDS, ROWS = 26, 4
BATCH = 13                # signature values compared at a time
MISS = 1e-7               # posterior probability below which a pair is dropped
BROADCAST_ROWS = 100_000  # (id, text key) pairs: under 10 MB
SHINGLE_BLOCK = 1 << 18   # shingles hashed at a time
CELLS = 8                 # sketch bits for each shingle of a set, at least
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased, as UTF-8."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER))


def shingle_set(text: str | None, size: int) -> set[bytes]:
    """Distinct shingles; fewer words than ``size`` are one shingle."""
    w = words(text) if text is not None else []
    if not w:
        return set()
    if len(w) <= size:
        return {b" ".join(w)}
    return set(map(b" ".join, zip(*(w[k:] for k in range(size)))))


@functools.cache
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    n = BANDS * ROWS
    return (rng.integers(1, 2 ** 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2 ** 63, n, dtype=np.uint64))


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, by prefix sums of a polynomial over the bytes."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    if not b.size:
        return np.empty(0, np.uint64)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not start.size:
        return np.empty(0, np.uint64)
    power, inverse = _powers(b.size + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[:b.size])))
    return _mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse; grown on demand."""
    if not _POWERS or _POWERS[0].size < n:
        size = max(1 << 17, 1 << (n - 1).bit_length())
        base = 0x9E3779B97F4A7C15
        made = []
        for x in (base, pow(base, -1, 2 ** 64)):
            with np.errstate(over="ignore"):
                f = np.full(size, x, np.uint64)
                f[0] = 1
                made.append(np.cumprod(f))
        _POWERS[:] = made
    return _POWERS[0][:n], _POWERS[1][:n]


def _shingle_hashes(text: str, size: int) -> np.ndarray:
    """Distinct 64-bit shingle hashes of a text."""
    w = _word_hashes(text)
    if w.size == 0:
        return w
    k = min(size, w.size)
    h = np.zeros(w.size - k + 1, np.uint64)
    for j in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j:w.size - k + 1 + j]
    return np.unique(_mix(h + np.uint64(k)))


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash signatures (uint32, one row for each non-empty set)."""
    a, b = _seeds()
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([s.size for s in sets])[:-1]))
    out = np.empty((len(sets), a.size), np.uint32)
    for j in range(a.size):
        out[:, j] = np.minimum.reduceat((flat * a[j] + b[j]) >> np.uint64(32), starts)
    return out


def _low_bits(sig: np.ndarray) -> list[np.ndarray]:
    """Two bits of each signature value, 32 values in a long."""
    out = []
    for at in range(0, sig.shape[1], 32):
        part = sig[:, at:at + 32].astype(np.uint64) & np.uint64(3)
        out.append((part << (np.arange(part.shape[1], dtype=np.uint64) * np.uint64(2))).sum(axis=1, dtype=np.uint64).view(np.int64))
    return out


LOW = [f"low{k}" for k in range(-(-BANDS * ROWS // 32))]


@functools.cache
def most_low_mismatches(similarity: float, miss: float) -> int:
    """How many of the two-bit values may differ: a pair at the threshold
    differs in more with probability ``miss`` at most (each differs with 3/4
    of one minus the similarity)."""
    n, p = BANDS * ROWS, 0.75 * (1 - similarity)
    tail, k = 0.0, n
    while k > 0:
        tail += math.comb(n, k) * p ** k * (1 - p) ** (n - k)
        if tail > miss:
            return k
        k -= 1
    return 0


def _features(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, sets = [], []
            pending = 0

            def flush():
                sig = _signatures(sets)
                bands = np.zeros((len(sets), BANDS), np.uint64)
                for r in range(ROWS):
                    bands = bands * np.uint64(0x9E3779B97F4A7C15) + _mix(sig[:, r::ROWS][:, :BANDS].astype(np.uint64) + np.uint64(r))
                bands = _mix(bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)
                return pd.DataFrame({
                    "text_key": [k[0] for k in keys], "doc_id": [k[1] for k in keys],
                    "n": [s.size for s in sets], "sig": [r.tobytes() for r in sig], "bands": list(bands),
                    **{f"low{k}": v for k, v in enumerate(_low_bits(sig))}})

            for key, doc, text in zip(batch["text_key"], batch["doc_id"], batch["text"]):
                h = _shingle_hashes(text, size) if text is not None else np.empty(0, np.uint64)
                if h.size:
                    keys.append((key, doc))
                    sets.append(h)
                    pending += h.size
                if pending >= SHINGLE_BLOCK:
                    yield flush()
                    keys, sets, pending = [], [], 0
            if sets:
                yield flush()
    return run


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Parities of how many hashes fall into each cell, 64 cells in a long.

    A hash that only one of two sets holds flips one cell, so two sketches
    differ in no more cells than the sets differ in hashes.  The cells are the
    least power of two that gives ``CELLS`` to each hash (64 at least); halves
    of a sketch, one xor the other, are the sketch of half as many cells.
    """
    cells = max(64, 1 << (CELLS * hashes.size - 1).bit_length())
    odd = np.bincount((hashes & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sketch_rows(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "sketch": [parity_sketch(_shingle_hashes(t, size)) for t in batch["text"]]})
    return run


@functools.cache
def fewest_matches(similarity: float, miss: float) -> tuple[int, ...]:
    """For n = 0, 1, ... compared values: the fewest equal ones with which
    P(similarity >= threshold) is still at least ``miss``.

    The tail of Beta(m + 1, n - m + 1) above t is P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(BANDS * ROWS + 1):
        tail, m = 0.0, 0
        while True:
            tail += math.comb(n + 1, m) * similarity ** m * (1 - similarity) ** (n + 1 - m)
            if tail >= miss or m >= n:
                break
            m += 1
        out.append(m)
    return tuple(out)


def _prune(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        need = fewest_matches(similarity, MISS)
        for batch in batches:
            if batch.empty:
                continue
            x = np.frombuffer(b"".join(batch["sig_a"]), np.uint32).reshape(len(batch), -1)
            y = np.frombuffer(b"".join(batch["sig_b"]), np.uint32).reshape(len(batch), -1)
            alive, equal = np.arange(len(batch)), np.zeros(len(batch), np.int64)
            for at in range(0, x.shape[1], BATCH):
                to = min(at + BATCH, x.shape[1])
                equal = equal + (x[alive, at:to] == y[alive, at:to]).sum(axis=1)
                stay = equal >= need[to]
                alive, equal = alive[stay], equal[stay]
            yield batch.iloc[alive][["a", "b"]]
    return run


def _confirm(size: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last_set = None, None
        for batch in batches:
            ok = []
            for b, ta, tb in zip(batch["b"], batch["text_a"], batch["text_b"]):
                if b != last_key:   # pairs of a hub come one after the other
                    last_key, last_set = b, shingle_set(tb, size)
                x = shingle_set(ta, size)
                both = len(x & last_set)
                ok.append(100 * both >= percent * (len(x) + len(last_set) - both))
            yield batch.loc[np.array(ok, dtype=bool), ["a", "b"]]
    return run


def _in_components(docs: DataFrame, shingle: int, percent: int, id_col: str, text: str) -> DataFrame:
    """The result of ``near_duplicates`` with ``_text_key`` and ``_component``:
    a number of the component whatever its ids are, null for no shingles."""
    docs = docs.drop("_component").drop("n_shingles", "component_id", "kept", "_text_key").withColumn("_text_key", F.md5(text))
    raw = docs.select(F.col("_text_key").alias("text_key"), F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    features = stored(raw.mapInPandas(
        _features(shingle), f"text_key string, doc_id {id_type}, n long, sig binary, bands array<long>, "
        + ", ".join(f"{c} long" for c in LOW)), "near-features")
    classes = stored(features.groupBy("text_key").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"),
        F.first("bands").alias("bands"), *[F.first(c).alias(c) for c in LOW]).withColumn("id", F.monotonically_increasing_id()), "near-classes")
    members = classes.select(F.posexplode("bands").alias("band", "hash"), "id").select(
        F.xxhash64("band", "hash").alias("key"), "id")
    mates = members.join(members.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key"),
                         "key", "left_semi")
    shared = stored(mates.join(classes.select("id", "n", *LOW), "id").select("key", "id", "n", *LOW), "near-buckets")

    def possible(i, p):
        """First look inside the join: sizes, and two bits of each signature value."""
        differ = F.lit(0)
        for c in LOW:
            x = i(c).bitwiseXOR(p(c))
            differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        return ((100 * F.least(i("n"), p("n")) >= percent * F.greatest(i("n"), p("n"))) & (i("id") != p("id"))
                & (differ <= most_low_mismatches(percent / 100, MISS)))

    def texts_of(ids: DataFrame) -> DataFrame:
        """(id, text) of classes.  Few ids are broadcast, so that the texts of
        all others stay where they are; many are joined by a shuffle."""
        keys = stored(ids.join(classes.select("id", "text_key"), "id"), "near-keys")
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
        return raw.select("text_key", "text").join(keys, "text_key").dropDuplicates(["id"]).select("id", "text")

    def sketches(ids: DataFrame) -> DataFrame:
        """(id, sketch): see ``parity_sketch``.  The sets of a family just below
        the threshold agree in signatures and in their rarest shingles: a bound
        on the difference of the whole sets tells them apart at any size."""
        return texts_of(ids).mapInPandas(_sketch_rows(shingle), "id long, sketch array<long>")

    def agree(i, p):
        """The cells that differ leave enough in common for the threshold.  No
        link fails; sizes apart by more than one halving of cells are not judged."""
        def as_short(x, like):
            half = (F.size(x) / 2).cast("int")
            return F.when(F.size(x) > F.size(like), F.zip_with(
                F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))).otherwise(x)

        x, y = as_short(i("sketch"), p("sketch")), as_short(p("sketch"), i("sketch"))
        differ = F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda n, k: n + k)
        return F.coalesce(differ * (100 + percent) <= (i("n") + p("n")) * (100 - percent), F.lit(True))

    def verify(pairs: DataFrame) -> DataFrame:
        return settled(docs.sparkSession, lambda: compared(pairs), "near-links", rows=FEW_ROWS)

    def compared(pairs: DataFrame) -> DataFrame:
        sig = classes.select("id", "sig")
        pairs = (pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), "a")
                 .join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sig_b")), "b"))
        left = stored(pairs.mapInPandas(_prune(percent / 100), "a long, b long"), "near-pruned")
        full = stored(texts_of(left.select("a").union(left.select("b")).distinct().withColumnRenamed("a", "id")), "near-texts")
        return with_texts(left, full, "text").mapInPandas(_confirm(shingle, percent), "a long, b long")

    comp = linked_components(shared, shared, possible, verify, sketches, agree)
    named = classes.select("id", "text_key", "n", "doc_id").join(comp, "id", "left").withColumn(
        "comp", F.coalesce("comp", "id"))
    smallest = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    verdict = named.join(smallest, "comp").select(
        F.col("text_key").alias("_text_key"), F.col("n").alias("n_shingles"), F.col("comp").alias("_component"), "component_id")
    out = docs.join(verdict, "_text_key", "left")
    return (out.withColumn("n_shingles", F.coalesce("n_shingles", F.lit(0)).cast("long"))
            .withColumn("component_id", F.coalesce("component_id", id_col))
            .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"),
                                           F.col(id_col).isNull() & F.col("component_id").isNull())))


def near_duplicates(docs: DataFrame, shingle: int = 2, percent: int = 80, id_col: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """``docs`` with ``n_shingles``, ``component_id`` and ``kept``.

    Two documents are linked when 100 * intersection >= ``percent`` * union of
    their shingle sets; ``component_id`` is the smallest id in the connected
    component, ``kept`` says that the row has it.  Equal texts are one class
    throughout and never compared.  Null text, no words: no shingles, no
    links, a component of its own.  Rows with equal ids and texts are all kept
    or all not (``drop_near_duplicates`` leaves one).
    """
    return _in_components(docs, shingle, percent, id_col, text).drop("_text_key", "_component")


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id",
                         text: str = "text") -> DataFrame:
    """One document of each group, with the columns of ``docs``.

    Documents that share an id, or have none, are as different as their texts:
    one row of each component is left.  Texts without words are no group; there
    only rows that repeat id and text count once.
    """
    cols = docs.columns
    kept = _in_components(docs, shingle, percent, id_col, text).filter("kept")
    # only rows that repeat an id are left more than once
    repeated = docs.groupBy(id_col).agg(F.count("*").alias("_n")).filter("_n > 1")
    if not repeated.isEmpty():
        alone = F.col("_component").isNull()
        kept = kept.withColumns({"_id": F.when(alone, F.col(id_col)), "_key": F.when(alone, F.col("_text_key"))})
        kept = kept.dropDuplicates(["_component", "_id", "_key"])
    return kept.select(*cols)
