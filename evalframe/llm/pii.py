"""Personal data: pattern spans, and terms that would give an entity away.

Pattern spans (email, ip, card, phone) are the protected entities.  Masking
them is not enough when a term beside them points to the same entity, so the
corpus is asked how much a term tells: with documents as the unit,

    PMI(term; entity) = log2( N * n(term, entity) / (n(term) * n(entity)) )
    IC(entity)        = log2( N / n(entity) )

A context term (one of ``context_words`` words on either side of the entity)
is generalised when PMI >= ``alpha`` * IC, and removed when PMI >=
``alpha_remove`` * IC, i.e. when nearly every document with the term has the
entity beside it.  One text is no evidence: a pair needs ``min_texts``
different texts.

Everything runs on SQL expressions; text is read once for patterns and once
for corpus term counts, and only narrow rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalframe.llm._spans import SPAN_TYPE, find_spans
from evalframe.llm._store import stored

KINDS = ("email", "ip", "card", "phone")
TERM_RANK = len(KINDS)
TERM = r"[\p{L}\p{N}]+"
MAX_BROADCAST_TERMS = 100_000   # below this many candidate terms the corpus count joins before it shuffles


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    backwards = F.reverse(_digits(v))

    def add(total, i):
        d = F.substring(backwards, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(backwards)), F.lit(0), add) % 10 == 0


def _octet(p: Column) -> Column:
    short = F.regexp_replace(p, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


def base_spans(text: Column) -> Column:
    """Pattern spans of all kinds, by start and kind.

    Matches can only start at the first character of a run (or where the last
    match ended), which the lookbehinds say outright so that a long run is
    read once; possessive quantifiers do the same for failing tails.
    """
    local = "[A-Za-z0-9._%+-]"
    email = find_spans(text, "email", 0, rf"(?:(?<!{local})|\G){local}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
                       lambda v: F.lit(True), F.contains(text, F.lit("@")))
    ip = find_spans(text, "ip", 1, r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
                    lambda v: F.forall(F.split(v, r"\."), _octet), text.rlike(r"[0-9]\.[0-9]"))
    card = find_spans(text, "card", 2, r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+",
                      lambda v: (F.length(_digits(v)) <= 19) & _luhn(v), text.rlike(r"(?:[0-9][\x20-]?){11}[0-9]"))
    phone = find_spans(text, "phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]",
                       lambda v: F.length(_digits(v)).between(9, 15),
                       F.contains(text, F.lit("+")) & text.rlike(r"\+[0-9]"))
    return F.array_sort(F.concat(email, ip, card, phone))


def _context_terms(text: Column, spans: Column, words: int, reach: int) -> Column:
    """Terms within ``words`` words of an entity, outside every span, as
    (entity, term, start, end); ``reach`` code points hold the words."""
    def near(s):
        left_at = F.greatest(s["start"] - reach, F.lit(0))
        left = F.substring(text, left_at + 1, s["start"] - left_at)
        right = F.substring(text, s["end"] + 1, F.lit(reach))
        ok = lambda v: F.length(v) >= 2
        before = find_spans(left, "term", TERM_RANK, TERM, ok, F.lit(True))
        # the first word of the left part and the last of the right part may be cut: leave those at the edge out
        before = F.filter(before, lambda t: (t["start"] > 0) | (left_at == 0))
        after = F.filter(find_spans(right, "term", TERM_RANK, TERM, ok, F.lit(True)),
                         lambda t: (t["end"] < reach))
        before = F.when(F.size(before) > words, F.slice(before, -words, words)).otherwise(before)
        after = F.slice(after, 1, words)
        place = lambda at: lambda t: F.struct(
            F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity"), F.lower(t["value"]).alias("term"),
            (t["start"] + at).alias("start"), (t["end"] + at).alias("end"))
        return F.concat(F.transform(before, place(left_at)), F.transform(after, place(s["end"])))

    terms = F.flatten(F.transform(spans, near))
    return F.filter(terms, lambda t: ~F.exists(spans, lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"])))


def find_pii(docs: DataFrame, text: str = "text", alpha: float = 0.85, alpha_remove: float = 0.98,
             min_texts: int = 2, context_words: int = 4, context_reach: int = 80) -> DataFrame:
    """``docs`` with ``pii_spans`` (array of start, rank, kind, end, value) and
    ``pii_text`` (the text with every span masked).

    Kinds are email, ip, card, phone, and ``generalise`` / ``remove`` for
    disclosing terms.  Null text: no spans, null ``pii_text``.  Empty tables
    and repeated rows pass through; columns that clash with the two results
    are replaced, others are kept.
    """
    docs = docs.drop("pii_spans", "pii_text", "_text_key").withColumn("_text_key", F.md5(text))
    body = F.col(text)
    found = stored(
        docs.select("_text_key", body.alias("t")).withColumn("spans", base_spans(F.col("t")))
        .filter(F.size("spans") > 0)
        .select("_text_key", "spans", _context_terms(F.col("t"), F.col("spans"), context_words, context_reach)
                .alias("terms")), "pii-found")
    per_text = stored(found.groupBy("_text_key").agg(
        F.first("spans").alias("spans"), F.first("terms").alias("terms"), F.count("*").alias("copies")), "pii-texts")

    entity = F.concat_ws(":", F.col("s.kind"), F.lower("s.value"))
    n_entity = (per_text.select("copies", F.explode("spans").alias("s"), "_text_key")
                .select("_text_key", "copies", entity.alias("entity")).distinct()
                .groupBy("entity").agg(F.sum("copies").alias("n_e")))
    context = per_text.select("_text_key", "copies", F.explode("terms").alias("c")).select("_text_key", "copies", "c.*")
    n_pair = (context.select("_text_key", "copies", "entity", "term").distinct()
              .groupBy("entity", "term").agg(F.sum("copies").alias("n_te"), F.count("*").alias("n_texts"))
              .filter(F.col("n_texts") >= min_texts))
    n_pair = stored(n_pair, "pii-pairs")
    n_term = _corpus_counts(docs.select(body.alias("t")), n_pair.select("term").distinct())
    n_docs = docs.count()

    pmi = F.log2(F.lit(float(n_docs)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    info = F.log2(F.lit(float(n_docs)) / F.col("n_e"))
    disclosing = (n_pair.join(n_entity, "entity").join(n_term, "term")
                  .filter((info > 0) & (pmi >= alpha * info))
                  .select("entity", "term", F.when(pmi >= alpha_remove * info, "remove").otherwise("generalise")
                          .alias("action")))
    hits = (context.join(disclosing, ["entity", "term"])
            .groupBy("_text_key", "start", "end", "term").agg(F.max("action").alias("action"))
            .select("_text_key", F.struct(
                F.col("start"), F.lit(TERM_RANK).alias("rank"), F.col("action").alias("kind"), F.col("end"),
                F.col("term").alias("value")).alias("x"))
            .groupBy("_text_key").agg(F.collect_list("x").cast(SPAN_TYPE).alias("extra")))
    marks = (per_text.select("_text_key", "spans").join(hits, "_text_key", "left")
             .select("_text_key", F.array_sort(F.concat("spans", F.coalesce(
                 "extra", F.expr(f"cast(array() as {SPAN_TYPE})")))).alias("pii_spans")))
    out = docs.join(marks, "_text_key", "left").drop("_text_key")
    out = out.withColumn("pii_spans", F.coalesce("pii_spans", F.expr(f"cast(array() as {SPAN_TYPE})")))
    return out.withColumn("pii_text", masked(body, F.col("pii_spans")))


def _corpus_counts(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """In how many of ``texts`` does each of ``terms`` occur."""
    words = texts.select(F.explode(F.array_distinct(F.split(F.lower("t"), r"[^\p{L}\p{N}]+"))).alias("term"))
    if terms.count() <= MAX_BROADCAST_TERMS:
        words = words.join(F.broadcast(terms), "term", "left_semi")
        return words.groupBy("term").agg(F.count("*").alias("n_t"))
    return words.groupBy("term").agg(F.count("*").alias("n_t")).join(terms, "term", "left_semi")


def masked(text: Column, spans: Column) -> Column:
    """Replace spans by their class; overlapping spans go as one."""
    label = lambda s: (F.when(s["kind"] == "remove", "")
                       .when(s["kind"] == "generalise", F.when(s["value"].rlike("^[0-9]+$"), "[NUMBER]").otherwise("[TERM]"))
                       .otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
    state = F.aggregate(
        spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
        .otherwise(F.struct(s["end"].alias("at"), F.concat(
            acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), label(s)).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(text.isNull(), F.lit(None)).when(F.size(spans) == 0, text).otherwise(state)
