"""Document fingerprints by I-Match over randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency lies in a band:
terms that are in most texts say nothing, terms that are in few texts are
often slips.  The fingerprint of a text is one hash for each subset of the
lexicon: of the sorted distinct terms that the text has in this subset.  The
first subset is the whole lexicon (plain I-Match: equal hash, equal terms).
The others are random samples of it, halved from level to level: a small
change spares most of the sparse subsets, so the share of equal hashes tells
how alike two texts are, for short and long texts alike.

A term stands as the 64-bit hash of its lower-cased characters.  The subsets
of a level are equal ranges of hashes, so in a sorted list of terms each
subset is a slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm._store import stored

BAND = (0.25, 0.6)             # of log(n / df) / log(n): 0 is in every text, 1 in one
LEVELS = 14                    # subsets of level s hold 1 / 2^s of the lexicon
CLASSES = 16                   # subsets on each level, at most
BROADCAST_TERMS = 1_000_000    # a larger lexicon is joined by shuffles
DENSE = 2                      # terms a subset holds on average where two texts are compared
# not in a term: ASCII and Latin-1 signs, general punctuation, signs of unspaced scripts
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\xA9\xAB-\xB4\xB6-\xB9\xBB-\xBF\u2000-\u206F\u3000-\u303F]+"


def _subsets() -> list[int]:
    return [min(CLASSES, 1 << s) for s in range(LEVELS + 1)]


def terms(text: Column) -> Column:
    """Distinct terms of a text as 64-bit hashes; null text has none."""
    words = F.coalesce(F.split(F.lower(text), NO_WORD), F.array().cast("array<string>"))
    return F.array_remove(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def fit_lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """(term, df): the terms in the band, counted over all of ``docs``; stored.

    An empty table or a single document has an empty lexicon.
    """
    n = float(docs.count())
    counts = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    share = F.log(F.lit(n) / F.col("df")) / F.log(F.lit(max(n, 2.0)))
    return stored(counts.filter((F.lit(n) > 1) & (share >= band[0]) & (share <= band[1])), "imatch-lexicon")


def _ranges() -> list[tuple[int, int]]:
    """(least hash, least hash beyond) of each subset, the whole lexicon first."""
    low = -(1 << 63)
    return [(low + (c << 64 - s), low + (c + 1 << 64 - s)) for s, n in enumerate(_subsets()) for c in range(n)]


def _hashes(found: Column, whole: Column) -> Column:
    """The hash of each subset, "" where the text has no term of it."""
    top = (1 << 63) - 1
    ranges = [(lo, min(hi, top)) for lo, hi in _ranges()]     # the very last hash belongs to no subset but that
    cuts = sorted({x for r in ranges for x in r})
    at = {x: i + 1 for i, x in enumerate(cuts)}

    def numbers(values, kind):
        return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")

    def shown(x):
        return F.lpad(F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")

    def slices(a, below):
        def one(lo, hi):
            start, end = F.element_at(below, lo), F.element_at(below, hi)
            return F.when(end > start, shown(F.xxhash64(F.slice(a, (start + 1).cast("int"), (end - start).cast("int"))))
                          ).otherwise(F.lit(""))
        return F.zip_with(numbers([at[lo] for lo, _ in ranges[1:]], "int"), numbers([at[hi] for _, hi in ranges[1:]], "int"), one)

    def placed(a):
        # the cuts sorted in among the terms: how many terms stand before each
        merged = F.sort_array(F.concat(a, numbers(cuts, "bigint")))
        return F.transform(F.array(merged), lambda m: F.transform(
            numbers(cuts, "bigint"), lambda cut, i: F.array_position(m, cut) - 1 - i))[0]

    everything = F.when(F.size(found) > 0, F.xxhash64(F.sort_array(found))).otherwise(whole)
    # arrays of one element bind what is read many times
    rest = F.transform(F.array(F.sort_array(found)), lambda a: F.transform(
        F.array(placed(a)), lambda below: slices(a, below))[0])[0]
    return F.concat(F.array(shown(everything)), rest)


def fingerprint(rows: DataFrame, lexicon: DataFrame, keys: list[str], texts: dict[str, str]) -> DataFrame:
    """``rows`` with a struct (n_terms, hashes) for each entry output: text column of ``texts``.

    ``keys`` name a row (not null, stored or otherwise the same on each run);
    rows that are already dealt out by some of them are not shuffled again
    while the lexicon is small enough to be broadcast.  The text columns are
    dropped; an output replaces a column of its name.  A text without a term
    of the lexicon (null and empty ones too) has n_terms 0 and in place of the
    first hash that of all its words, or of the text if there are none: equal
    texts have equal fingerprints in any case.
    """
    outs = list(texts)
    thin = [c for c in rows.columns if c not in (*keys, *outs, *texts.values())]
    made = rows.select(*keys, *thin, *[F.coalesce(F.col(t), F.lit("")).alias(f"_t{i}") for i, t in enumerate(texts.values())])
    made = made.withColumns({f"_s{i}": terms(F.col(f"_t{i}")) for i in range(len(outs))})
    whole = [F.when(F.size(f"_s{i}") > 0, F.xxhash64(F.sort_array(f"_s{i}"))).otherwise(F.xxhash64(f"_t{i}")).alias(f"w{i}")
             for i in range(len(outs))]
    made = made.withColumn("_row", F.struct(*[F.col(c) for c in thin], *whole))
    row_type = made.schema["_row"].dataType
    # one entry without a term carries the row, so that no row is lost and no other entry is wide
    entries = [F.array(F.struct(F.lit(-1).alias("which"), F.xxhash64(*keys).alias("term"), F.col("_row").alias("row")))]


    def entry(i):
        return lambda x: F.struct(F.lit(i).alias("which"), x.alias("term"), F.lit(None).cast(row_type).alias("row"))

    entries += [F.transform(f"_s{i}", entry(i)) for i in range(len(outs))]
    spread = made.select(*keys, F.explode(F.concat(*entries)).alias("_e")).select(*keys, "_e.which", "_e.term", "_e.row")
    known = lexicon.select("term", F.lit(True).alias("known"))
    if lexicon.count() <= BROADCAST_TERMS:
        known = F.broadcast(known)
    met = spread.join(known, "term", "left").filter("known or which < 0")
    sets = met.groupBy(*keys).agg(
        F.first("row", ignorenulls=True).alias("row"),
        *[F.collect_list(F.when(F.col("which") == i, F.col("term"))).alias(f"_f{i}") for i in range(len(outs))])
    return sets.select(*keys, *[F.col(f"row.{c}").alias(c) for c in thin],
                       *[F.struct(F.size(f"_f{i}").alias("n_terms"),
                                  _hashes(F.col(f"_f{i}"), F.col(f"row.w{i}")).alias("hashes")).alias(out)
                         for i, out in enumerate(outs)])


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the share of equal hashes among the subsets that either text has terms of.

    Only levels count whose subsets hold ``DENSE`` terms of the longer text at
    most on average: denser ones differ after the least change.  Equal
    fingerprints have 1.
    """
    sizes = _subsets()
    first = F.array(*[F.lit(1 + sum(sizes[:s])) for s in range(LEVELS + 1)])
    longer = F.greatest(a["n_terms"], b["n_terms"])
    level = F.least(F.greatest(F.ceil(F.log2(F.greatest(longer, F.lit(1)) / F.lit(float(DENSE)))), F.lit(0)), F.lit(LEVELS))
    at = F.element_at(first, (level + 1).cast("int"))
    pairs = F.filter(F.arrays_zip(F.slice(a["hashes"], at, sum(sizes)).alias("x"),
                                  F.slice(b["hashes"], at, sum(sizes)).alias("y")),
                     lambda p: (p["x"] != "") | (p["y"] != ""))
    same = F.transform(F.array(pairs), lambda p: F.when(F.size(p) == 0, 0.0).otherwise(
        F.size(F.filter(p, lambda q: q["x"] == q["y"])) / F.size(p)))[0]
    return F.when(a == b, 1.0).otherwise(same)


def shown(fp: Column) -> Column:
    return F.concat_ws(":", fp["n_terms"].cast("string"), F.array_join(fp["hashes"], ","))
