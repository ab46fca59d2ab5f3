"""I-Match, vantage-point clustering and the filter audit against plain Python."""

import hashlib
import itertools
import math
import re
import struct
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evalframe.llm import _order, clustering, filter_audit, imatch, oracles, queries
from evalframe.sources.tables import read_table
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in read_table(spark, SF_SMALL, "documents").select("doc_id", "text").collect()}


# --- I-Match ----------------------------------------------------------------

def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def term_hash(word):
    return signed(xxhash.xxh64(word.encode(), seed=42).intdigest())


def list_hash(longs):
    h = 42
    for x in longs:
        h = xxhash.xxh64(struct.pack("<q", x), seed=h).intdigest()
    return f"{h & 0xFFFFFFFF:08x}"


def term_set(text):
    return {term_hash(w) for w in re.split(imatch.NO_WORD, (text or "").lower()) if w}


def plain_fingerprint(text, lexicon):
    own = term_set(text)
    met = sorted(own & lexicon)
    if met:
        hashes = [list_hash(met)]
    else:
        hashes = [list_hash(sorted(own)) if own else f"{xxhash.xxh64((text or '').encode(), seed=42).intdigest() & 0xFFFFFFFF:08x}"]
    for s in range(imatch.LEVELS + 1):
        for c in range(min(imatch.CLASSES, 1 << s)):
            if s:
                # the subset's place among 2^s equal ranges of the hashes
                part = [x for x in met if (x + (1 << 63)) >> (64 - s) == c]
                hashes.append(list_hash(part) if part else "")
    return len(met), hashes


def plain_likeness(a, b):
    if a == b:
        return 1.0
    level = min(max(math.ceil(math.log2(max(a[0], b[0], 1) / imatch.DENSE)), 0), imatch.LEVELS)
    first = sum(min(imatch.CLASSES, 1 << s) for s in range(level))
    pairs = [(x, y) for x, y in zip(a[1][first:], b[1][first:]) if x or y]
    return sum(x == y for x, y in pairs) / len(pairs) if pairs else 0.0


def plain_lexicon(texts):
    n = len(texts)
    df = Counter(t for text in texts for t in term_set(text))
    return {t for t, c in df.items() if n > 1 and imatch.BAND[0] <= math.log(n / c) / math.log(max(n, 2)) <= imatch.BAND[1]}


def check_fingerprints(got, rows):
    """``rows``: (doc_id, text) in the order of the contract."""
    lexicon = plain_lexicon([t for _, t in rows])
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, (doc_id, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r, own = by_id[doc_id], plain_fingerprint(text, lexicon)
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == f"{own[0]}:{','.join(own[1])}"
        other = plain_fingerprint(edited, lexicon)
        assert r["edited_fingerprint"] == f"{other[0]}:{','.join(other[1])}"
        assert r["near_edited"] == pytest.approx(plain_likeness(own, other), abs=1e-12)
        assert r["near_next"] == pytest.approx(plain_likeness(own, plain_fingerprint(after, lexicon)), abs=1e-12)


@pytest.mark.parametrize("per_range", [7, 2_000])
def test_imatch_against_plain(spark, texts, monkeypatch, per_range):
    monkeypatch.setattr(_order.in_ranges, "__defaults__", (per_range,))
    got = queries.op11_imatch(spark, SF_SMALL).collect()
    check_fingerprints(got, sorted(texts.items(), key=lambda x: -x[0]))


def test_imatch_large_lexicon_is_joined_by_shuffles(spark, texts, monkeypatch):
    monkeypatch.setattr(imatch, "BROADCAST_TERMS", 0)
    got = queries.op11_imatch(spark, SF_SMALL)
    check_fingerprints(got.collect(), sorted(texts.items(), key=lambda x: -x[0]))


def test_imatch_keeps_partitions_of_the_order(spark):
    plan = queries.op11_imatch(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    final = plan.split("Initial Plan")[-1]
    assert final.count("Exchange hashpartitioning") == 1


def test_imatch_likeness_falls_with_the_edit(spark, texts):
    got = queries.op11_imatch(spark, SF_SMALL).filter("n_chars > 400").collect()
    assert np.mean([r["near_edited"] > r["near_next"] for r in got]) > 0.95
    copies = {}
    for r in queries.op11_imatch(spark, SF_SMALL).collect():
        assert copies.setdefault(texts[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1


MESSY = [(5, "Same words here"), (5, "Same words here"), (5, "other words"), (None, "no id one"), (None, "no id two"), (7, None),
         (8, ""), (9, "!!! ..."), (10, "word " * 50_000), (11, "x" * 200_000), (12, "É—“quoted” 漢字。漢字")]


@pytest.mark.parametrize("per_range", [1, 3, 100])
def test_order_with_ties_and_nulls(spark, per_range):
    df = spark.createDataFrame(MESSY, "doc_id long, text string")
    rows = _order.in_ranges(df, "doc_id", "text", per_range).filter("not guest").collect()
    assert len(rows) == len(MESSY)
    follows = Counter((r["id"], r["text"], r["next_text"]) for r in rows)
    tie = lambda t: (xxhash.xxh64(t.encode(), seed=42).intdigest() >> 11, t)
    order = sorted(((i, t or "") for i, t in MESSY),
                   key=lambda r: (r[0] is not None, r[0] or 0, *tie(r[1])), reverse=True)
    want = Counter((i, t, order[(k + 1) % len(order)][1]) for k, (i, t) in enumerate(order))
    assert follows == want


def test_order_hot_id_is_split(spark):
    df = spark.range(4000).selectExpr("case when id < 3000 then 17 else id end as doc_id", "concat('t', id) as text")
    rows = _order.in_ranges(df, "doc_id", "text", 100)
    assert rows.groupBy("bucket").count().agg(F.max("count")).first()[0] < 400


def test_imatch_messy_and_empty(spark):
    df = spark.createDataFrame(MESSY, "doc_id long, text string").withColumns(
        {"n_terms": F.lit("x"), "fp": F.lit(1), "row": F.lit(2), "term": F.lit(3), "rid": F.monotonically_increasing_id()})
    df = spark.createDataFrame(df.collect(), df.schema)
    lexicon = imatch.fit_lexicon(df)
    out = imatch.fingerprint(df, lexicon, ["rid"], {"fp": "text"}).collect()
    assert len(out) == len(MESSY) and {r["term"] for r in out} == {3} and {r["row"] for r in out} == {2}
    lex = plain_lexicon([t for _, t in MESSY])
    assert Counter((r["doc_id"], r["fp"]["n_terms"], tuple(r["fp"]["hashes"])) for r in out) == Counter(
        (i, n, tuple(h)) for i, t in MESSY for n, h in [plain_fingerprint(t, lex)])
    empty = df.limit(0)
    assert imatch.fingerprint(empty, imatch.fit_lexicon(empty), ["rid"], {"fp": "text"}).isEmpty()
    assert _order.in_ranges(empty, "doc_id", "text").isEmpty()
    one = _order.in_ranges(df.filter("doc_id = 12"), "doc_id", "text").filter("not guest").first()
    assert one["text"] == one["next_text"]


# --- clustering ---------------------------------------------------------------

def plain_clusters(rows, k, rounds):
    """rows: (id, list of ints); seeds by hash."""
    order = sorted(rows, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [list(v) for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(cents))

    for _ in range(rounds):
        groups = {}
        for _, v in rows:
            groups.setdefault(near(v)[1], []).append(v)
        for i, g in groups.items():
            cents[i] = [sum(x) // len(g) for x in zip(*g)]
    return [(i, *reversed(near(v))) for i, v in rows], cents


def test_clusters_against_plain(spark):
    emb = read_table(spark, SF_SMALL, "embeddings").select("vec_id", "embedding")
    rows = [(r[0], [math.floor(64 * x) for x in r[1]]) for r in emb.collect()]
    want, cents = plain_clusters(rows, 16, 3)
    got = queries.op12_clusters(spark, SF_SMALL).collect()
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted(want)
    sums = Counter()
    for _, c, d in want:
        sums[c] += d
    for r in got:
        assert r["cluster_inertia"] == sums[r["cluster"]] and r["inertia"] == sum(sums.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, cents[r["cluster"]])).encode()).hexdigest()


def test_clusters_equal_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{SF_SMALL}/embeddings.parquet')")
    got = queries.op12_clusters(spark, SF_SMALL).toPandas()
    want = con.execute(oracles.CLUSTERS).df()
    by = list(want.columns)
    assert (got[by].sort_values("vec_id").values.tolist()) == (want.sort_values("vec_id").values.tolist())


@pytest.mark.parametrize("k,spread", [(1, 5), (7, 2), (300, 40), (300, 2), (1000, 1 << 27)])
def test_tree_search_is_exact_with_ties(k, spread):
    rng = np.random.default_rng(k + spread)
    cents = rng.integers(-spread, spread + 1, (k, 4 if spread < 10 else 64))     # few values: many equal centroids and ties
    x = rng.integers(-spread, spread + 1, (500, cents.shape[1]))
    x[:min(k, 100)] = cents[:min(k, 100)]
    number, best, work = clustering.search(clustering.build_tree(cents), cents, x)
    d = ((x[:, None, :] - cents[None]) ** 2).sum(2)
    assert (best == d.min(1)).all() and (number == d.argmin(1)).all()
    assert work <= len(x) * k


def test_tree_prunes_clustered_centroids():
    rng = np.random.default_rng(5)
    cents = rng.integers(-10_000, 10_000, (512, 3))
    x = cents[rng.integers(0, 512, 1000)] + rng.integers(-3, 4, (1000, 3))
    _, _, work = clustering.search(clustering.build_tree(cents), cents, x)
    assert work < 0.15 * 512 * 1000


def test_clusters_messy(spark):
    good = [float(i) / 7 for i in range(64)]
    rows = [(1, good), (1, good), (None, good), (2, [-x for x in good]), (3, None), (4, good[:63]), (5, good + [0.0]),
            (6, [float("nan")] + good[1:]), (7, [float("inf")] + good[1:]), (8, [None] + good[1:]), (9, [1e300] + good[1:]),
            (10, [-1e300] + good[1:]), (11, [0.0] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x"))
    out, cents = clustering.cluster(df)
    got = clustering.describe(out, cents).collect()
    assert len(got) == 7 and len(cents) == 7 and all(r["distance"] >= 0 and r["inertia"] >= r["cluster_inertia"] for r in got)
    out, cents = clustering.cluster(df.filter("vec_id = 3"))
    assert clustering.describe(out, cents).isEmpty()
    two, cents = clustering.cluster(spark.createDataFrame([(i, [float(i % 2)] * 64) for i in range(50)],
                                                          "vec_id long, embedding array<double>"), k=2)
    assert two.groupBy("cluster").count().count() <= 2 and two.agg(F.sum("distance")).first()[0] >= 0
    with pytest.raises(ValueError):
        clustering.cluster(df, k=0)


# --- filter audit ---------------------------------------------------------------

def plain_audit(docs, labels):
    """docs: (doc_id, text, lang); rows by applying the filters one after another."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)

    def fails(i, t):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = t in first and (i is None or first[t] < i)
        return {c for c, bad in zip("ABCDE", (len(words) < 100, 100 * len(set(words)) < 80 * len(words),
                100 * sum("A" <= x <= "Z" for x in t) > 10 * len(t), bool(re.search("[#$%&*|]", t)), copy)) if bad}

    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    parts = {}
    for i, t, lang in docs:
        parts.setdefault(lang or "", []).append((i, fails(i, t)))
    out = {}
    for part, rows in parts.items():
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left, gone = rows, []
            for step, c in enumerate(order, 1):
                hit = [r for r in left if c in r[1]]
                left = [r for r in left if c not in r[1]]
                shapley[c] += len(hit)
                out[part, order, step] = [len(left), len(hit), sum(c in f for _, f in gone), sum(f == {c} for _, f in rows),
                                          sum(i in good for i, _ in hit), sum(i in toxic for i, _ in hit)]
                gone += hit
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, c in enumerate(order, 1):
                out[part, order, step].append(shapley[c])
    return out


def as_dict(rows):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in filter_audit.COUNTS] for r in rows}


def test_audit_against_plain_and_sql(spark):
    docs = read_table(spark, SF_SMALL, "documents").select("doc_id", "text", "lang")
    labels = read_table(spark, SF_SMALL, "labels").select("doc_id", "quality", "toxic")
    got = queries.op13_filter_audit(spark, SF_SMALL).collect()
    assert as_dict(got) == plain_audit([tuple(r) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    want = con.execute(oracles.FILTER_AUDIT).df()
    assert as_dict(got) == as_dict(want.to_dict("records"))


def test_audit_messy(spark):
    long = "Word " * 30_000
    docs = [(1, None, "en"), (2, "", "en"), (2, "", "en"), (3, "", None), (None, "", ""), (None, "x", "de"), (None, "x", "de"),
            (4, long, "fr"), (5, long, "fr"), (6, "A" * 100_000, "fr"), (7, " ".join(map(str, range(200))), "en"), (8, "100 % é", "")]
    labels = [(1, 1, 0), (1, 0, 1), (4, 1, None), (None, 1, 1), (99, 1, 1), (7, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns(
        {c: F.lit("x") for c in ("part", "mask", "good", "salt", "digest", "id", "words")})
    l = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit("x"))
    got = filter_audit.audit(filter_audit.text_masks(d, l)).collect()
    assert as_dict(got) == plain_audit(docs, labels)
    assert len(got) == 4 * 600
    assert filter_audit.audit(filter_audit.text_masks(d.limit(0), l)).isEmpty()
    assert len(filter_audit.audit(filter_audit.text_masks(d, l.limit(0))).collect()) == 4 * 600


def test_removal_steps_are_a_min_plus_product():
    fails = np.array([[True, False, True], [False, False, False], [False, True, False]])
    position = np.array([[0, 2], [1, 1], [2, 0]])
    assert filter_audit.removal_steps(fails, position).tolist() == [[0, 0], [filter_audit.NEVER] * 2, [1, 1]]
