"""Each operator against a brute-force version, and on messy and empty tables."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalframe.llm import (_graph, ann, decontam, language, license_scan, line_dedup, mixing, near_dedup, pii, queries,
                           secret_scan, sharding)
from evalframe.sources.tables import read_table
from tests.conftest import SF_SMALL
from tests.llm import brute

MESSY = [(1, "Mail bob@example.com or +1 (415) 555-0100, ip 10.0.0.1 and 300.1.1.1", "en", "a"),
         (1, "Mail bob@example.com or +1 (415) 555-0100, ip 10.0.0.1 and 300.1.1.1", "en", "a"),
         (2, None, None, None), (3, "", "en", "a"), (4, "ÀÉ x@y.zz_u@v.ww 4111 1111 1111 1111", None, "b"),
         (None, "token = abcdef12\npassword:ab", "de", None), (5, "9 8 7\n\n", "en", "b"),
         (6, "word " * 30000, "en", "a"), (7, "word " * 30000 + "end", "en", "a"), (8, "7" * 5000 + " " + "a" * 5000 + "@", "de", "c")]


@pytest.fixture(scope="module")
def docs(spark):
    return read_table(spark, SF_SMALL, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def messy(spark):
    """Nulls, empty and long texts, repeated rows, and columns that clash with results."""
    df = spark.createDataFrame(MESSY, "doc_id long, text string, lang string, source string")
    return df.withColumns({"size": F.lit("x"), "score": F.lit("x"), "kept": F.lit("x"), "blob": F.lit("x"), "licenses": F.lit(1)})


def test_pii_base_spans(spark, texts):
    for r in queries.op2_pii(spark, SF_SMALL).collect():
        assert r["base_sha256"] == brute.sha(brute.digest(brute.spans(brute.PII, texts[r["doc_id"]])))


def test_pii_disclosing_terms(spark):
    rows = [(i, f"note {i}: agent zorblax {'met' if i else 'saw'} bob@example.com at noon") for i in range(3)]
    rows += [(i, f"note {i}: agent nobody met at noon") for i in range(10, 40)]
    out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id < 3").collect()
    for r in out:
        assert [s["value"] for s in r["pii_spans"] if s["kind"] == "remove"] == ["zorblax"]
        assert "bob@" not in r["pii_text"] and "zorblax" not in r["pii_text"] and "agent" in r["pii_text"]


def test_pii_messy(messy):
    got = pii.find_pii(messy).collect()
    assert len(got) == len(MESSY)
    for r in got:
        base = [(s["start"], s["rank"], s["kind"], s["end"]) for s in r["pii_spans"] if s["kind"] in pii.KINDS]
        assert base == brute.spans(brute.PII, r["text"])


def test_secrets(spark, texts, messy):
    for r in queries.op3_secret_scan(spark, SF_SMALL).collect():
        assert r["spans"] == brute.digest(brute.spans(brute.SECRETS, texts[r["doc_id"]]))
    for r in secret_scan.scan(messy)[0].collect():
        assert [(s["start"], s["rank"], s["kind"], s["end"]) for s in r["secret_spans"]] == brute.spans(brute.SECRETS, r["text"])


def test_ledger_scans_only_unseen_pairs(messy):
    first, ledger = secret_scan.scan(messy)
    ledger = ledger.cache()
    again, more = secret_scan.scan(messy, ledger)
    assert more.isEmpty()
    assert sorted(map(str, again.select("doc_id", "secret_spans").collect())) == sorted(
        map(str, first.select("doc_id", "secret_spans").collect()))
    newer = tuple(secret_scan.Rule(r.name, 2 if r.name == "hex" else r.version, r.pattern, r.screen, r.keep)
                  for r in secret_scan.RULES)
    _, more = secret_scan.scan(messy, ledger, rules=newer)
    assert {(r["rule"], r["version"]) for r in more.collect()} == {("hex", 2)}


def test_ledger_table(spark, messy, tmp_path):
    path = str(tmp_path / "ledger")
    pairs = lambda: sorted((r["blob"], r["rule"]) for r in spark.read.parquet(path).collect())
    spans = lambda df: sorted(map(str, df.select("doc_id", "secret_spans").collect()))
    secret_scan.scan_with_ledger(messy.limit(3), path)
    few = pairs()
    out = secret_scan.scan_with_ledger(messy, path)
    blobs = {r["blob"] for r in out.select("blob").collect()}
    assert spans(out) == spans(secret_scan.scan(messy)[0])
    assert 0 < len(few) < len(pairs()) == len(set(pairs())) == len(blobs) * len(secret_scan.RULES)
    assert spans(secret_scan.scan_with_ledger(messy, path)) == spans(out) and len(pairs()) == len(set(pairs()))


def test_sharding(spark, docs, messy):
    got = sharding.shard_documents(docs).toPandas()
    counts = got.groupby("shard").size()
    assert len(counts) == 16 and counts.max() - counts.min() <= 1
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    groups = got.groupby("text_crc32")["shard"].agg(["size", "nunique"])
    assert ((groups["size"] > 1) & (groups["nunique"] > 1)).sum() <= 3
    small = sharding.shard_documents(messy).toPandas()
    assert len(small) == len(MESSY) and small.groupby("shard").size().max() == 1


def test_sharding_few_copies(spark):
    """0.1% copies: every pair ends in one shard."""
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.when(
        F.col("id") < 20, (F.col("id") / 2).cast("long")).otherwise(F.col("id")).cast("string")).alias("text"))
    got = sharding.shard_documents(df).toPandas()
    counts = got.groupby("shard").size()
    assert len(counts) == 16 and counts.max() == counts.min()
    pairs = got[got["doc_id"] < 20].assign(pair=lambda g: g["doc_id"] // 2).groupby("pair")["shard"].nunique()
    print("split pairs", (pairs > 1).sum(), "of", len(pairs))
    assert (pairs == 1).all()


def test_decontamination(spark, docs, messy):
    bench = [(r["item_id"], r["text"]) for r in read_table(spark, SF_SMALL, "benchmark").collect()]
    rows = docs.orderBy("doc_id").collect()
    want = brute.decontaminate([r["text"] for r in rows], bench)
    got = {r["doc_id"]: r for r in queries.op5_decontaminate(spark, SF_SMALL).collect()}
    for r, (n, hit, items) in zip(rows, want):
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"]) == (n, hit, len(items), brute.sha(",".join(items)))
    items = [(1, "word word word"), (2, "bob example com or"), (3, None), (None, "x"), (4, "...")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    want = brute.decontaminate([m[1] for m in MESSY], items)
    got = decontam.find_contamination(messy, bench).collect()
    assert sorted((r["n_words"], len(r["hit_words"]), tuple(sorted(r["hit_items"]))) for r in got) == sorted(
        (n, h, tuple(i)) for n, h, i in want)
    assert decontam.find_contamination(messy, bench.limit(0)).filter(F.size("hit_words") > 0).isEmpty()


def test_fm_index_equals_search():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(0, 5, 3000), 0)
    text = np.concatenate((text, text[:500], [0]))
    index = decontam.FMIndex(text)
    phrases = rng.integers(1, 5, (200, 4))
    lo, hi = index.search(phrases, np.full(200, 4))
    for p, a, b in zip(phrases, lo, hi):
        want = [i for i in range(text.size - 3) if (text[i:i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_near_duplicates(spark, texts, messy):
    want = brute.near_duplicates(list(texts.items()))
    for r in queries.op6_near_dedup(spark, SF_SMALL).collect():
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])
    got = near_dedup.near_duplicates(messy).collect()
    assert len(got) == len(MESSY)
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert by_id[2] == 2 and by_id[3] == 3 and by_id[7] == 7     # one shingle against two


def test_drop_near_duplicates_null_and_shared_ids(spark):
    words = lambda w: " ".join(f"{w}{i}" for i in range(30))
    rows = [(None, words("a")), (None, words("b")), (None, words("b") + " more"), (5, words("c")), (5, words("d")),
            (5, words("d")), (6, words("e")), (7, words("e")), (8, ""), (8, ""), (9, ""), (None, None)]
    got = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = sorted((r["doc_id"] or 0, (r["text"] or "")[:2]) for r in got)
    print("left", left)
    assert left == [(0, ""), (0, "a0"), (0, "b0"), (5, "c0"), (5, "d0"), (6, "e0"), (8, ""), (9, "")]


def test_posterior_bound():
    need = near_dedup.fewest_matches(0.8, near_dedup.MISS)
    assert need[0] == 0 and list(need) == sorted(need) and need[-1] < 0.8 * len(need)


def test_language(spark, docs, messy):
    got = queries.op7_language(spark, SF_SMALL).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.95
    out = language.predict(messy, language.fit(docs)).collect()
    for r in out:
        assert (r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        assert 0 <= r["score"] <= 1
    assert {r["lang_pred"] for r in language.predict(messy, language.fit(messy.limit(0))).collect()} == {"und"}


def test_language_stage_keeps_clean_documents(spark, docs):
    short = [(-1, "A."), (-2, "A.\nAll rights reserved."), (-3, "mail bob.k@example.org, token 40d78a45c41"), (-4, "Q Xz")]
    foreign = [(-5, "".join(chr(0x4E00 + 37 * i) for i in range(60))), (-6, "12 34")]
    df = docs.select("doc_id", "text", "lang").unionByName(
        spark.createDataFrame([(i, t, None) for i, t in short + foreign], "doc_id long, text string, lang string"))
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, df, SF_SMALL).select("doc_id").collect()}
    want = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")} | {i for i, _ in short}
    print("lost", sorted(want - kept))
    assert kept == want


def test_ann_recall(spark):
    e = read_table(spark, SF_SMALL, "embeddings").toPandas()
    x, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    got = queries.op8_ann(spark, SF_SMALL).toPandas()
    found = 0
    for q in ids[ids % 20 == 0]:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        near = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        mine = got[got["query_id"] == q].sort_values("rank")
        assert len(mine) == 20 and mine["score"].is_monotonic_decreasing
        found += len(set(near) & set(mine["vec_id"]))
    assert found >= 0.9 * 20 * (ids % 20 == 0).sum()


def test_ann_recall_many_lists(spark, monkeypatch):
    """300 lists of random unit vectors, of which the fewest probes read 24."""
    monkeypatch.setattr(ann, "ROWS_PER_LIST", 40)
    x = np.random.default_rng(8).standard_normal((12_000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)}),
                               "vec_id long, embedding array<double>")
    got = ann.nearest(df, every=60).toPandas().groupby("query_id")["vec_id"].agg(set)
    assert len(got) == 200
    found = 0
    for q, mine in got.items():
        s = x @ x[q]
        s[q] = -np.inf
        found += len(mine & set(np.argpartition(-s, 20)[:20].tolist()))
    print("recall", found / (20 * len(got)))
    assert found >= 0.9 * 20 * len(got)


def test_ann_messy(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]),
            (6, [0.5, None]), (None, [1.0, 1.0]), (7, [0.0, 2.0]), (20, [1.0, 1.0]), (20, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 1.0), (0, 3, 7, 0.0), (20, 1, 7, 2.0), (20, 2, 0, 1.0), (20, 3, 1, 1.0)]
    assert ann.nearest(df.limit(0)).isEmpty()


def test_line_dedup(spark, texts, messy):
    want = brute.repeated_lines(list(texts.items()), 2, 24, lambda a, b: brute.edit_distance(a, b) <= 2)
    got = {}
    for r in queries.op9_line_dedup(spark, SF_SMALL).collect():
        for x in filter(None, r["removed"].split(",")):
            no, doc, line = map(int, x.split(":"))
            got[r["doc_id"], no] = (doc, line)
    assert got == want
    out = line_dedup.dedup_lines(messy).collect()
    assert len(out) == len(MESSY) and all(r["text"] is None for r in out if r["doc_id"] == 2)


def test_line_rule_over_all_lengths(spark):
    """Against brute force that leaves no line out: two edits, both lines of 24 characters."""
    base = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, base[:n]) for i, n in enumerate(range(1, 27))]
    rows += [(100 + i, t) for i, t in enumerate(["And.", "On.", "Con.", "And.", base[1:25], base[:23] + "!", base[2:] + "!"])]
    near = lambda a, b: min(len(a), len(b)) >= 24 and brute.edit_distance(a, b) <= 2
    want = brute.repeated_lines(rows, 2, 1, near)
    got = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["line_no"]): (r["first_doc"], r["first_line"]) for r in got} == want


def test_banded_edit_distance():
    rng = np.random.default_rng(5)
    pairs = []
    for _ in range(400):
        a = list(rng.choice(list("abcé"), rng.integers(24, 60)))
        b = list(a)
        for _ in range(rng.integers(0, 5)):
            at = int(rng.integers(0, len(b)))
            b[at:at + int(rng.integers(0, 2))] = list(rng.choice(list("abcé"), rng.integers(0, 2)))
        pairs.append(("".join(a), "".join(b)))
    got = line_dedup.within([a for a, _ in pairs], [b for _, b in pairs], 2)
    assert got.tolist() == [brute.edit_distance(a, b) <= 2 for a, b in pairs]


def test_licenses(spark, texts, messy):
    templates = [(k, re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower())) for k, t in license_scan.TEMPLATES]
    grams = lambda w: {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    for r in queries.op1_license_scan(spark, SF_SMALL).collect():
        have = grams(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", texts[r["doc_id"]].lower()))
        full = {k for k, t in templates if grams(t) <= have}
        assert full <= set(filter(None, r["licenses"].split(",")))
        some = {k for k, t in templates if len(grams(t) & have) >= 0.8 * len(grams(t))}
        assert set(filter(None, r["licenses"].split(","))) <= some
    assert len(license_scan.scan_licenses(messy).collect()) == len(MESSY)


def test_near_duplicates_of_a_family_just_below_the_threshold(spark):
    """Texts of 60 words with 3 of them changed, each: nearly all pairs are just below 0.8, few are linked."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(150):
        t = [f"w{k}" for k in range(60)]
        for at in rng.choice(60, 3, replace=False):
            t[at] = f"x{rng.integers(10 ** 6)}"
        rows.append((i, " ".join(t)))
    rows += [(200 + i, rows[i][1].replace("w7 ", "y7 ")) for i in range(0, 150, 10)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    want = brute.near_duplicates(rows, 2, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def _family(rng, count: int, size: int, change: int) -> list[str]:
    out = []
    for _ in range(count):
        t = [f"w{k}" for k in range(size)]
        for at in rng.choice(size, change, replace=False):
            t[at] = f"x{rng.integers(10 ** 6)}"
        out.append(" ".join(t))
    return out


def test_near_duplicates_of_long_texts_just_below_the_threshold(spark, monkeypatch):
    """Texts of 300 words, 10 of them changed: nearly all pairs share a bucket and few are linked; only those become rows."""
    monkeypatch.setattr(_graph, "HUB_ROUNDS", 0)        # leaves the pairs to the last step
    texts = _family(np.random.default_rng(6), 120, 300, 10)
    rows = list(enumerate(texts)) + [(200 + i, texts[i].replace("w7 ", "y7 ")) for i in range(0, 120, 10)]
    counts, stored = {}, near_dedup.stored

    def counted(df, name):
        out = stored(df, name)
        if name == "near-pruned":
            counts[len(counts)] = out.count()
        return out

    monkeypatch.setattr(near_dedup, "stored", counted)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()
    want = brute.near_duplicates(rows, 2, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    print("pairs compared in each step", counts)
    assert counts[len(counts) - 1] <= 400      # of 132 * 131 / 2 pairs


def test_parity_sketches_never_exceed_the_difference():
    """Sketches of sets differ in at most as many cells as the sets do, at equal and halved sizes."""
    rng = np.random.default_rng(7)
    bits = lambda x: int(np.bitwise_count(x.view(np.uint64)).sum())
    for n in (1, 7, 8, 9, 100, 128, 129, 1000, 5000):
        a = np.unique(rng.integers(0, 2 ** 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[n // 9:], rng.integers(0, 2 ** 63, n // 8, dtype=np.uint64))))
        x, y = sorted((near_dedup.parity_sketch(a), near_dedup.parity_sketch(b)), key=len)
        while y.size > x.size:
            y = y[:y.size // 2] ^ y[y.size // 2:]
        differ = len(np.setxor1d(a, b))
        assert 0.9 * differ <= bits(x ^ y) <= differ
    assert near_dedup.parity_sketch(np.empty(0, np.uint64)).tolist() == [0]


def test_license_scan_of_a_long_dotted_token(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    df = spark.createDataFrame([(1, notice + " " + ".".join(["1"] * 100_000)), (2, notice), (3, "-".join(["a1"] * 50_000))],
                               "doc_id long, text string")
    got = {r["doc_id"]: [x["license"] for x in r["licenses"]] for r in license_scan.scan_licenses(df).collect()}
    assert got == {1: ["Apache-2.0"], 2: ["Apache-2.0"], 3: []}


def test_mixing(spark, docs, messy):
    got = queries.op10_mixing(spark, SF_SMALL).join(docs.select("doc_id", "source"), "doc_id").toPandas()
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (per["taken"] - per["target"]).abs().max() <= 1
    assert (got["taken"] <= 2 * got["size"]).all()
    assert abs(per["target"].sum() - 1.5 * got["size"].sum()) < 1
    out = mixing.mix(mixing.sizes_of(messy.drop("size"))).toPandas()
    assert len(out) == len(MESSY) and (out["taken"] <= 2 * out["size"]).all()


@pytest.mark.parametrize("run", [
    lambda d: pii.find_pii(d), lambda d: secret_scan.scan(d)[0], lambda d: sharding.shard_documents(d),
    lambda d: near_dedup.near_duplicates(d), lambda d: line_dedup.dedup_lines(d), lambda d: license_scan.scan_licenses(d),
    lambda d: mixing.mix(mixing.sizes_of(d))])
def test_empty_tables(docs, run):
    assert run(docs.limit(0)).isEmpty()


def test_pipeline_against_plain_steps(spark, texts, docs):
    kept = near_dedup.drop_near_duplicates(docs, 5, 80)
    want = {i for i, (_, c) in brute.near_duplicates(list(texts.items()), 5).items() if i == c}
    assert {r["doc_id"] for r in kept.collect()} == want
    bench = [(r["item_id"], r["text"]) for r in read_table(spark, SF_SMALL, "benchmark").collect()]
    ids = sorted(want)
    clean = [i for i, (_, hit, _) in zip(ids, brute.decontaminate([texts[i] for i in ids], bench)) if not hit]
    out = corpus_pipeline.run(spark, SF_SMALL).toPandas()
    assert set(out["doc_id"]) <= set(clean)
    counts = out.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and out.groupby("doc_id").size().max() <= 2
    assert isinstance(out, pd.DataFrame)
