"""License notices in text: MinHash bands over overlapping windows.

Windows as long as a template (plus a stride) slide over the words; MinHash
bands of a window's word shingles retrieve templates, and the exact
containment of the template's shingles in the window decides.  The number of
bands is derived, so that a window that holds the required share of a template
collides with it with probability 1 - ``MISS`` at least, whatever the
template's length.

Only windows around anchors are formed: every shingle of a template holds an
anchor (two adjacent words), so a window without any holds no shingle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalframe.llm._store import stored

SHINGLE = 5
CONTAINMENT = 0.8
ROWS = 2
MISS = 1e-6
MAX_TEMPLATES = 2_000      # bound of the template table, which is broadcast
WORD = r"[a-z0-9]++(?:[.\x2D][a-z0-9]++)*+"     # possessive: a long dotted token is one loop, no recursion

# short notices that name a license
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES), "license string, text string")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def shingles(w: Column) -> Column:
    """Distinct word shingles as strings; fewer words are one shingle, none are none."""
    n = F.size(w)
    several = F.transform(F.sequence(F.lit(1), n - (SHINGLE - 1)), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))
    return (F.when(n >= SHINGLE, F.array_distinct(several)).when(n > 0, F.array(F.array_join(w, " ")))
            .otherwise(F.expr("cast(array() as array<string>)")))


def _stride(length: int) -> int:
    return max(1, length // 4)


def n_bands(length: int) -> int:
    """Bands with which a window of enough of a template is retrieved with probability 1 - MISS."""
    t = max(1, length - SHINGLE + 1)
    need = math.ceil(CONTAINMENT * t)
    window = max(1, length + _stride(length) - 1 - SHINGLE + 1)
    similarity = need / (t + max(window, need) - need)
    p = similarity ** ROWS
    return 1 if p >= 1 else math.ceil(math.log(MISS) / math.log(1 - p))


def _band_keys(sh: Column, length: Column, bands: Column) -> Column:
    """One hash for each band of the MinHash signature of shingle hashes ``sh``."""
    low = lambda seed: F.array_min(F.transform(sh, lambda x: F.xxhash64(x, seed)))
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda b: F.xxhash64(
        length, b, *[low(b * ROWS + r) for r in range(ROWS)]))


def _anchors(texts: list[list[str]]) -> list[list[str]]:
    """For each template (a list of words) pairs of adjacent words that hit all
    its shingles: the one in most uncovered shingles first, longer ones before
    shorter.  A template of one word is its own anchor."""
    out = []
    for w in texts:
        pairs = [" ".join(w[i:i + 2]) for i in range(max(1, len(w) - 1))]
        open_ = [set(pairs[i:i + SHINGLE - 1]) for i in range(max(1, len(w) - SHINGLE + 1))]
        chosen = []
        while open_:
            best = max(sorted(set().union(*open_)), key=lambda x: (sum(x in s for s in open_), len(x)))
            chosen.append(best)
            open_ = [s for s in open_ if best not in s]
        out.append(chosen)
    return out


def scan_licenses(docs: DataFrame, templates: DataFrame | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``licenses``: an array of (license, containment,
    first_word, n_words) by license, the best window of each; a match that
    overlaps a fuller one of another license is left out.

    ``templates`` has (license, text); null or empty ones are left out, more
    than MAX_TEMPLATES are an error.  Null text, or text without words: an
    empty array.  Equal texts are scanned once; clashing columns are replaced.
    """
    spark = docs.sparkSession
    empty = F.expr("cast(array() as array<struct<license:string,containment:double,first_word:int,n_words:int>>)")
    docs = docs.drop("licenses", "_text_key").withColumn("_text_key", F.md5(text))
    templates = default_templates(spark) if templates is None else templates
    rows = (templates.select("license", words(F.col("text")).alias("w")).filter(
        F.col("license").isNotNull() & (F.size("w") > 0)).distinct().limit(MAX_TEMPLATES + 1).collect())
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    if not rows:
        return docs.drop("_text_key").withColumn("licenses", empty)
    anchors = _anchors([r["w"] for r in rows])
    known = spark.createDataFrame(
        [(k, r["license"], r["w"], len(r["w"]), n_bands(len(r["w"]))) for k, r in enumerate(rows)],
        "template int, license string, w array<string>, length int, bands int")
    known = known.withColumn("t_shingles", shingles(F.col("w"))).drop("w")
    hashes = lambda s: F.transform(s, lambda x: F.xxhash64(x))
    known_bands = F.broadcast(known.withColumn(
        "key", F.explode(_band_keys(hashes(F.col("t_shingles")), F.col("length"), F.col("bands"))))
        .select("template", "license", "t_shingles", "key"))

    by_length: dict[int, tuple[int, set[str]]] = {}
    for r, a in zip(rows, anchors):
        length = len(r["w"])
        by_length[length] = (n_bands(length), by_length.get(length, (0, set()))[1] | set(a))
    body = F.lower(F.col("t"))
    screen = F.lit(False)
    for anchor in sorted(set().union(*(a for _, a in by_length.values()))):
        has = F.lit(True)
        for word in sorted(anchor.split(" "), key=len, reverse=True):
            has = has & F.contains(body, F.lit(word))
        screen = screen | has
    texts = docs.select("_text_key", F.col(text).alias("t")).filter(screen).dropDuplicates(["_text_key"])
    texts = texts.select("_text_key", words(F.col("t")).alias("w"))
    texts = stored(texts.withColumn("pairs", F.transform("w", lambda x, i: F.concat_ws(
        " ", x, F.get("w", i + 1)))), "license-texts")

    windows = None
    for length, (bands, own) in sorted(by_length.items()):
        stride = _stride(length)
        size = length + stride - 1
        single = [a for a in own if " " not in a]
        at = F.filter(F.transform("pairs", lambda x, i: F.when(
            x.isin(sorted(own)) | F.get("w", i).isin(single), i)), lambda i: i.isNotNull())
        # windows start at multiples of the stride; those with an anchor inside
        starts = F.array_distinct(F.flatten(F.transform(at, lambda p: F.sequence(
            F.ceil(F.greatest(p - (size - 1), F.lit(0)) / stride).cast("int"), F.floor(p / stride).cast("int")))))
        part = (texts.select("_text_key", "w", F.explode(starts).alias("_n"))
                .select("_text_key", (F.col("_n") * stride).alias("first_word"),
                        F.slice("w", F.col("_n") * stride + 1, size).alias("v"))
                .select("_text_key", "first_word", F.size("v").alias("n_words"), shingles(F.col("v")).alias("sh"),
                        F.lit(length).alias("length"), F.lit(bands).alias("bands")))
        windows = part if windows is None else windows.union(part)
    found = (windows.withColumn("key", F.explode(_band_keys(hashes(F.col("sh")), F.col("length"), F.col("bands"))))
             .join(known_bands, "key"))
    share = F.size(F.array_intersect("t_shingles", "sh")) / F.size("t_shingles")
    best = (found.withColumn("containment", share).filter(F.col("containment") >= CONTAINMENT)
            .groupBy("_text_key", "license").agg(F.max_by(
                F.struct("containment", "first_word", "n_words"),
                F.struct(F.col("containment"), -F.col("n_words"), -F.col("first_word"))).alias("b"))
            .groupBy("_text_key").agg(F.array_sort(F.collect_list(F.struct("license", "b.*"))).alias("licenses")))
    # notices of one family differ in a word or two: of overlapping matches the fuller one counts
    best = best.withColumn("licenses", F.filter("licenses", lambda x: ~F.exists("licenses", lambda y: (
        (y["containment"] > x["containment"]) & (y["first_word"] < x["first_word"] + x["n_words"])
        & (x["first_word"] < y["first_word"] + y["n_words"])))))
    out = docs.join(best, "_text_key", "left").drop("_text_key")
    return out.withColumn("licenses", F.coalesce("licenses", empty))
