"""Shards by balanced label propagation.

Documents that belong to a group (here: equal texts) should share a shard,
and all shards should hold the same number of documents.  From a random,
even start each round lets documents move to the shard where most of their
group is, but only so many from shard i to shard j as come back from j to i:
members of groups that want the opposite move, and documents of j without a
group, which lose nothing.  Rounds go on as long as they bring group members
to where most of their group is.  A last step makes the counts exactly even.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalframe.llm._rank import prefix_sums, unit_hash
from evalframe.llm._store import stored


STALLED = 3       # rounds without progress after which the rest counts as stuck


def propagate(nodes: DataFrame, n_shards: int) -> DataFrame:
    """``nodes`` (group: string or null, u: double in [0, 1), any others) with ``shard``.

    Each round is one join of the nodes with their groups' shard counts; what
    reaches the driver is the shard-to-shard table of wished moves
    (``n_shards`` squared).  Quotas are kept on average, by comparing a fresh
    hash of the node with the admitted share.  A move never takes a member from
    the shard that holds most of its group, so the wished moves only get fewer;
    it ends when none is left, none is admitted, or ``STALLED`` rounds in a row
    bring no fewer.
    """
    nodes = stored(nodes.withColumn("shard", F.least(F.floor(F.col("u") * n_shards), F.lit(n_shards - 1)).cast("int")),
                   "shard-start")
    linked = (nodes.filter(F.col("group").isNotNull()).groupBy("group").agg(F.count("*").alias("n"))
              .filter(F.col("n") > 1).select("group"))
    nodes = stored(nodes.join(linked.withColumn("linked", F.lit(True)), "group", "left")
                   .withColumn("linked", F.coalesce("linked", F.lit(False))), "shard-linked")
    fewest, stalled = None, 0
    for k in itertools.count():
        held = nodes.filter("linked").groupBy("group", "shard").agg(F.count("*").alias("n"))
        # most members first; equal counts go by a hash, the same for all members
        wish = held.groupBy("group").agg(F.max_by(
            "shard", F.struct(F.col("n"), F.xxhash64("group", "shard"))).alias("wish"))
        wishing = stored(nodes.join(wish, "group", "left").withColumn("wish", F.coalesce("wish", "shard")),
                         f"shard-round{k}")
        counts = {(r["shard"], r["wish"], r["linked"]): r["n"] for r in
                  wishing.groupBy("shard", "wish", "linked").agg(F.count("*").alias("n")).collect()}
        moves = {(i, j): c for (i, j, linked), c in counts.items() if linked and i != j}
        left = sum(moves.values())
        stalled = stalled + 1 if fewest is not None and left >= fewest else 0
        fewest = left if fewest is None else min(left, fewest)
        if not left or stalled == STALLED:
            break
        free = {i: counts.get((i, i, False), 0) for i in range(n_shards)}
        admitted, swaps = _quotas(moves, free, n_shards)
        if not any(admitted.values()):
            break
        go = F.lit(None)
        u = unit_hash(F.col("u"), F.col("group"), F.lit(k))
        for i in range(n_shards):
            per_target = F.lit(None)
            for j in range(n_shards):
                if (i, j) in moves:
                    per_target = F.when(F.col("wish") == j, F.when(u < admitted[i, j] / moves[i, j], j)).otherwise(per_target)
            sent, at = F.lit(None), 0.0
            for j, c in swaps.get(i, ()):
                sent = F.when((u >= at) & (u < at + c / free[i]), j).otherwise(sent)
                at += c / free[i]
            go = F.when(F.col("shard") == i, F.when(F.col("linked"), per_target).otherwise(sent)).otherwise(go)
        nodes = stored(wishing.withColumn("shard", F.coalesce(go.cast("int"), F.col("shard"))).drop("wish"),
                       f"shard-moved{k}")
    return nodes


def _quotas(moves: dict, free: dict, n_shards: int) -> tuple[dict, dict]:
    """Admitted moves (i, j), and for each j the free documents it sends to i."""
    admitted = {k: min(c, moves.get((k[1], k[0]), 0)) for k, c in moves.items()}
    swaps: dict[int, list] = {}
    for j in range(n_shards):
        excess = {i: moves[i, j] - admitted[i, j] for i in range(n_shards) if (i, j) in moves}
        total = sum(excess.values())
        if not total or not free[j]:
            continue
        part = min(1.0, free[j] / total)
        swaps[j] = [(i, c * part) for i, c in excess.items() if c]
        for i, c in swaps[j]:
            admitted[i, j] += c
    return admitted, swaps


def even_out(nodes: DataFrame, n_shards: int) -> DataFrame:
    """Counts at most one apart, and ``slot`` (gapless from 0 in each shard).

    Each shard gives its surplus, documents without a group first, in the
    order of ``u``; the surplus fills the gaps of the others in one line.
    """
    order = F.when(F.col("linked"), F.lit(0.5) + F.col("u") / 2).otherwise(F.col("u") / 2)
    nodes = nodes.withColumn("_order", order)
    count = {r["shard"]: r["n"] for r in nodes.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    n = sum(count.values())
    ranked = prefix_sums(nodes, ["shard"], "_order", F.lit(1), "_rank", n_rows=n,
                         ties=[c for c in ("doc_id", "size", "crc") if c in nodes.columns])
    have = [count.get(i, 0) for i in range(n_shards)]
    want = [n // n_shards + (i < n % n_shards) for i in range(n_shards)]
    surplus = [max(0, h - w) for h, w in zip(have, want)]
    first = [sum(surplus[:i]) for i in range(n_shards)]
    line, shard, slot = F.lit(None), F.lit(None), F.lit(None)
    for i in range(n_shards):
        line = F.when((F.col("shard") == i) & (F.col("_rank") < surplus[i]), F.col("_rank") + first[i]).otherwise(line)
    at = 0
    for j in range(n_shards):
        gap = max(0, want[j] - have[j])
        if gap:
            inside = (F.col("_line") >= at) & (F.col("_line") < at + gap)
            shard = F.when(inside, j).otherwise(shard)
            slot = F.when(inside, F.col("_line") - at + have[j]).otherwise(slot)
            at += gap
    kept_slot = F.col("_rank")
    for i in range(n_shards):
        if surplus[i]:
            kept_slot = F.when(F.col("shard") == i, F.col("_rank") - surplus[i]).otherwise(kept_slot)
    return (ranked.withColumn("_line", line)
            .withColumns({"slot": F.when(F.col("_line").isNull(), kept_slot).otherwise(slot).cast("long"),
                          "shard": F.when(F.col("_line").isNull(), F.col("shard")).otherwise(shard).cast("int")})
            .drop("_line", "_rank", "_order"))


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for all ``docs``.

    Law ``rows``: the shards' counts are at most one apart.  Size is the UTF-8
    bytes of the text plus 1 (null text: 1, no checksum, no group).  A group
    (equal texts) is cut only where the counts demand it.  Repeated rows, null
    ids and empty tables are fine; columns beyond id and text are not used.
    """
    nodes = docs.select(
        F.col(id_col).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.encode(F.col(text), "UTF-8")).alias("crc"), F.md5(text).alias("group"))
    nodes = nodes.withColumn("u", unit_hash(F.col("doc_id").cast("string"), F.col("group")))
    placed = even_out(propagate(nodes, n_shards), n_shards)
    return placed.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"),
                         "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
