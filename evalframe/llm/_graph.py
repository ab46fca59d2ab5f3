"""Connected components and bucket-wise links, as Spark joins."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm._store import settled, stored, swept_shuffles

HUB_ROUNDS = 4      # how often hubs are drawn anew at most, before all remaining pairs are tried
NEW_LINKS = 0.05    # a round that links less than this share of the pairs it tries is the last


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every node of ``edges`` (a, b); comp is the smallest id
    that can be reached.

    Alternates large-star and small-star steps: each node links its larger
    (then smaller) neighbours to its smallest one.  Both are an aggregate and
    a join on the node, so that the hub of a big component is summed before it
    is shuffled and split by skew handling, never gathered in a list.  Ends
    when every node hangs on a root.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
               "cc-start")
    k = 0
    while not _is_star(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).distinct())
        e = stored(small, f"cc{k}")
        k += 1
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(
        e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def _is_star(e: DataFrame) -> bool:
    child = e.groupBy("u").agg(F.count("*").alias("n"))
    with swept_shuffles(e.sparkSession):
        if not child.filter("n > 1").isEmpty():
            return False
        return e.join(child.select("u").withColumnRenamed("u", "v"), "v", "left_semi").isEmpty()


def linked_components(index: DataFrame, probe: DataFrame, possible, verify: Callable[[DataFrame], DataFrame],
                      sketches: Callable[[DataFrame], DataFrame] | None = None, agree=None) -> DataFrame:
    """Components of all verified links between bucket mates.

    ``index`` and ``probe`` have (key, id, *facts): a link (i, p) can only be
    between an index and a probe entry of one key.  ``possible(i, p)`` is a
    cheap necessary condition on the facts of two aliases, ``verify`` maps
    distinct pairs (a, b) to the linked ones.  ``sketches`` may give, for a
    table of ids, (id, sketch), and ``agree(i, p)`` a necessary condition on
    these; they keep step 3 from forming pairs just below the threshold.

    Pairs are tried in three steps, and a pair whose ends are connected
    already is never tried: (1) every entry with one hub of its buckets, the
    one that its family agrees on; (2) with a hub that is drawn anew for each
    bucket, again while that still finds links; (3) all that is left within
    buckets that still hold several components.  A big family of copies is one
    component after (1) and (2), so its pairs are hardly ever formed; yet no
    pair that could join two components is left out.
    """
    facts = [c for c in index.columns if c not in ("key", "id")]
    i_hub = lambda c: F.col(f"hub.{c}")
    p_own = lambda c: F.col(c)

    def star(*draw):
        hub = index.groupBy("key").agg(F.min_by(F.struct("id", *facts), F.xxhash64("id", *draw)).alias("hub"))
        return (probe.join(hub, "key").filter((F.col("id") != F.col("hub.id")) & possible(i_hub, p_own))
                .select(F.col("id").alias("a"), F.col("hub.id").alias("b")).distinct())

    spark = index.sparkSession
    links = stored(verify(star().groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("b"))), "link-first")
    comp = settled(spark, lambda: components(links), "link-comp")
    for draw in range(HUB_ROUNDS):
        tried = stored(_across(star("key", F.lit(draw)), comp), f"link-star{draw}")
        found = stored(verify(tried), f"link-hub{draw}")
        n_found = found.count()
        if n_found:
            links = links.union(found)
            comp = settled(spark, lambda: components(links), "link-comp")
        if n_found <= NEW_LINKS * tried.count():
            break
    # (3) pairs without a hub: only keys with further index entries, in buckets of several components
    own = F.coalesce("comp", "id").alias("comp")
    wide = index.join(comp, "id", "left").select("key", "id", *facts, own)
    open_probe = (probe.join(wide.select("key").distinct(), "key", "left_semi")
                  .join(comp, "id", "left").select("key", "id", *facts, own))
    mixed = (wide.select("key", "comp").union(open_probe.select("key", "comp")).groupBy("key")
             .agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key"))
    wide, open_probe = wide.join(mixed, "key", "left_semi"), open_probe.join(mixed, "key", "left_semi")
    if sketches is not None:
        wide, open_probe = stored(wide, "link-index"), stored(open_probe, "link-probe")
        sketch = stored(sketches(wide.select("id").union(open_probe.select("id")).distinct()), "link-sketch")
        wide, open_probe = wide.join(sketch, "id"), open_probe.join(sketch, "id")
    # a pair counts under the smallest key that it shares, so that it comes once
    keys = lambda df: df.groupBy("id").agg(F.collect_set("key").alias("keys"))
    i, p = wide.join(keys(wide), "id").alias("i"), open_probe.join(keys(open_probe), "id").alias("p")
    i_row = lambda c: F.col(f"i.{c}")
    p_row = lambda c: F.col(f"p.{c}")
    left = (i.join(p, (F.col("i.key") == F.col("p.key")) & (F.col("i.comp") != F.col("p.comp"))
                   & possible(i_row, p_row) & (F.col("i.key") == F.array_min(F.array_intersect("i.keys", "p.keys")))
                   & (agree(i_row, p_row) if agree else F.lit(True)))
            .select(F.greatest("i.id", "p.id").alias("a"), F.least("i.id", "p.id").alias("b")).distinct())
    third = stored(verify(left), "link-third")
    if third.isEmpty():
        return comp
    return components(links.union(third))


def _across(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """Pairs whose ends are not in one component."""
    a = comp.select(F.col("id").alias("a"), F.col("comp").alias("_ca"))
    b = comp.select(F.col("id").alias("b"), F.col("comp").alias("_cb"))
    return (pairs.join(a, "a", "left").join(b, "b", "left")
            .filter(F.coalesce("_ca", "a") != F.coalesce("_cb", "b")).select("a", "b"))
