"""Lines that repeat, or nearly: a segment-partition edit-distance join.

Two lines within ``EDITS`` edits share at least one of EDITS + 1 segments of
the shorter one, at a position shifted by no more than the edits allow.  So
every line is indexed by its segments under its length, and probes the indexes
of its own length and the up to EDITS smaller ones with the few substrings
that can match (the multi-match-aware windows of Pass-Join).  A parity
signature of the characters (an edit flips two bits at most) drops nearly all
chance meetings inside the join; the rest is verified by a banded
bit-parallel edit distance.

Lines are near copies when both have ``MIN_CHARS`` characters and at most
``EDITS`` edits between them (2 in 24).  Shorter ones are classes of equal lines
only: two edits make another word of them, and classes are transitive.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evalframe.llm._graph import linked_components
from evalframe.llm._store import BROADCAST_BYTES, FEW_ROWS, settled, stored, with_texts

EDITS = 2
MIN_CHARS = 24
BROADCAST_ROWS = 500_000     # ids: 4 MB
LOOK = 16                    # columns of the edit distance between two looks at what can still match
_BASE = 0x9E3779B97F4A7C15
_MAX_BLOCK = 1 << 21        # characters hashed at a time
_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 20, 1 << (n - 1).bit_length())
    if size not in _cache:
        _cache.clear()
        made = []
        for x in (_BASE, pow(_BASE, -1, 2 ** 64)):
            f = np.full(size, x, np.uint64)
            f[0] = 1
            made.append(np.cumprod(f))
        _cache[size] = tuple(made)
    return _cache[size]


def segments(length: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of edits + 1 even segments (the last ones are longer), a column each."""
    parts = edits + 1
    short = length // parts
    longer = length - short * parts
    size = short[:, None] + (np.arange(parts) >= parts - longer[:, None])
    return np.cumsum(size, axis=1) - size, size


def probes(length: int, shorter: int, edits: int) -> list[tuple[int, int, int]]:
    """(segment, start, size) of the substrings of a line of ``length`` that can
    match a segment of a line shorter by ``shorter``."""
    start, size = segments(np.array([length - shorter]), edits)
    out = []
    for i in range(edits + 1):
        p, s = int(start[0, i]), int(size[0, i])
        # left: at most i edits before the segment; right: at most edits - i after it
        lo = max(0, p - i, p + shorter - (edits - i))
        hi = min(length - s, p + i, p + shorter + (edits - i))
        out += [(i, x, s) for x in range(lo, hi + 1)]
    return out


def _pieces(edits: int, min_chars: int):
    """Index and probe entries of lines (id, line)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines, ids = batch["line"].to_numpy(), batch["id"].to_numpy()
            sizes = np.fromiter(map(len, lines), np.int64, len(lines))
            use = np.flatnonzero(sizes >= min_chars)
            total = np.cumsum(sizes[use])
            while use.size:
                m = max(1, int(np.searchsorted(total, (total[0] - sizes[use[0]]) + _MAX_BLOCK, side="right")))
                yield from _block(lines[use[:m]], ids[use[:m]], sizes[use[:m]])
                use, total = use[m:], total[m:]

    def _block(lines, ids, sizes):
        c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        up, down = _power(c.size + 1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((c + np.uint64(1)) * up[:c.size])))
        first = np.cumsum(sizes) - sizes
        parity = np.bitwise_xor.reduceat(np.uint64(1) << (c * np.uint64(0x9E3779B1) >> np.uint64(7) & np.uint64(31)), first).astype(np.uint32)

        def entries(at, size, segment, length, row, is_index):
            h = (sums[first[row] + at + size] - sums[first[row] + at]) * down[first[row] + at]
            tag = (length.astype(np.uint64) * np.uint64(edits + 1) + segment.astype(np.uint64)) * np.uint64(0xD1B54A32D192ED03)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + tag
            h ^= h >> np.uint64(29)
            return pd.DataFrame({"key": h.view(np.int64), "entry": 2 * ids[row] + is_index, "sig": parity[row].view(np.int32)})

        start, size = segments(sizes, edits)
        rows = np.arange(sizes.size)
        for i in range(edits + 1):
            yield entries(start[:, i], size[:, i], np.full(rows.size, i), sizes, rows, 1)
        # the windows depend on the length alone: lines of one length together
        order = np.argsort(sizes, kind="stable")
        cut = np.flatnonzero(np.diff(sizes[order])) + 1
        todo: dict[tuple, list] = {}
        for own in np.split(order, cut):
            length = int(sizes[own[0]])
            for shorter in range(edits + 1):
                if length - shorter >= min_chars:
                    for i, x, s in probes(length, shorter, edits):
                        if not shorter and x == start[own[0], i]:
                            continue           # the index entry itself
                        todo.setdefault((i, shorter), []).append((own, x, s))
        for (i, shorter), parts in todo.items():
            row = np.concatenate([p[0] for p in parts])
            at = np.concatenate([np.full(p[0].size, p[1]) for p in parts])
            size_ = np.concatenate([np.full(p[0].size, p[2]) for p in parts])
            yield entries(at, size_, np.full(row.size, i), sizes[row] - shorter, row, 0)
    return run


def within(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Which pairs are at most ``edits`` edits apart.

    Bit-parallel columns (Myers) in a band of 2 * edits + 1 diagonals, which
    moves down one row a column (Hyyro); all pairs run side by side.  A pair
    leaves when its length is done, or at the next look (every ``LOOK``
    columns) after all of its band is beyond ``edits``: it can't come back.
    """
    n = len(a)
    if not n:
        return np.empty(0, bool)
    la, lb = np.fromiter(map(len, a), np.int64, n), np.fromiter(map(len, b), np.int64, n)
    out = np.zeros(n, bool)
    out[(lb == 0) & (la <= edits)] = True
    pair = np.flatnonzero((np.abs(la - lb) <= edits) & (lb > 0))
    pair = pair[np.argsort(-lb[pair], kind="stable")]
    la, lb = la[pair], lb[pair]
    flat = lambda x: np.frombuffer("".join(x[i] for i in pair).encode("utf-32-le", "surrogatepass"), np.uint32)
    fa, fb = np.append(flat(a), np.uint32(0)), flat(b)
    sa, sb = np.cumsum(la) - la, np.cumsum(lb) - lb
    # row r of the band at column j is a[j - edits + r]; dist[r] is D[j - edits + r, j]
    width = 2 * edits + 1
    top = np.uint64(1 << (width - 1))
    vp = np.full(pair.size, sum(1 << r for r in range(edits, width)), np.uint64)    # column 0: rows count up from row 0
    vn = np.zeros(pair.size, np.uint64)
    at = np.full(pair.size, edits, np.int64)          # D of the band's lowest row, which is row j + edits
    one, band = np.uint64(1), np.uint64((1 << width) - 1)

    def upward(own):
        """(band row, D there) from the lowest row up."""
        d = at[own].copy()
        for r in range(width - 1, -1, -1):
            yield r, d
            if r:
                bit = np.uint64(r - 1)
                d = d - (((vp[own] >> bit) & one).astype(np.int64) - ((vn[own] >> bit) & one).astype(np.int64))

    def only(keep):
        return [x[keep] for x in (pair, la, lb, sa, sb, vp, vn, at)]

    j = 0
    while pair.size:
        ch = fb[sb + j]
        eq = np.zeros(pair.size, np.uint64)
        for r in range(width):
            i = j - edits + r                  # the new column's row i + 1 compares a[i]
            if i >= 0:
                eq |= (((fa[np.minimum(sa + i, fa.size - 1)] == ch) & (i < la)).astype(np.uint64)) << np.uint64(r)
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & band
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        at = at + 1 - ((d0 & top) != 0).astype(np.int64)     # along the diagonal
        x = d0 >> one
        vp = (hn | ~(x | hp)) & band      # already in line with the next column's rows
        vn = hp & x
        j += 1
        done = np.flatnonzero(lb == j)
        for r, d in upward(done) if done.size else ():
            here = la[done] == j - edits + r
            out[pair[done[here]]] = d[here] <= edits
        keep = lb > j
        if j % LOOK == 0:
            near = np.zeros(pair.size, bool)
            for _, d in upward(slice(None)):
                near |= d <= edits
            keep &= near
        if not keep.all():
            pair, la, lb, sa, sb, vp, vn, at = only(keep)
    return out


def _verify(edits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.loc[within(b["line_a"].tolist(), b["line_b"].tolist(), edits), ["a", "b"]]
    return run


def line_classes(lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(id, comp) for the lines (id long, line; distinct) that have a near copy."""
    pieces = lines.mapInPandas(_pieces(edits, min_chars), "key long, entry long, sig int")   # entry: 2 * id + is index
    # only keys where an index entry meets another entry; the window spills, it holds no group in memory
    own = Window.partitionBy("key")
    met = stored(pieces.withColumn("n", F.count("*").over(own)).filter("n > 1")
                 .withColumn("any", F.max(F.col("entry").bitwiseAND(F.lit(1))).over(own)).filter("any = 1")
                 .select("key", F.shiftright("entry", 1).alias("id"), "sig",
                         F.col("entry").bitwiseAND(F.lit(1)).cast("byte").alias("is_index")), "line-met")

    def possible(i, p):
        # bit_count widens an int with its sign: only the low 32 bits count
        differ = i("sig").bitwiseXOR(p("sig")).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
        return (i("id") != p("id")) & (F.bit_count(differ) <= 2 * edits)

    def verify(pairs: DataFrame) -> DataFrame:
        return settled(lines.sparkSession, lambda: compared(pairs), "line-links", rows=FEW_ROWS)

    def compared(pairs: DataFrame) -> DataFrame:
        pairs = stored(pairs, "line-pairs")
        ids = stored(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "id"), "line-ids")
        # few ids are broadcast, so that all other lines stay where they are
        few = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
        texts = stored(lines.join(few, "id"), "line-texts")
        return with_texts(pairs, texts, "line", spread=True).mapInPandas(_verify(edits), "a long, b long")

    # an index entry is also the probe of its own length at its own place
    return linked_components(met.filter("is_index = 1").select("key", "id", "sig"), met.select("key", "id", "sig"),
                             possible, verify)


def _places(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Every non-empty line with its place: (doc_id, text_key, line_no)."""
    # the key first, below the generator: once for each text and not for each line
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.md5(text).alias("text_key"), F.col(text).alias("text"))
    return keyed.select("doc_id", "text_key",
                       F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")).filter(F.length("line") > 0)


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """(doc_id, text_key, line_no, first_doc, first_line): each line that
    repeats an earlier line of its class, and where that one is.

    Lines are split at line feeds; empty ones (and null texts) take no part.
    The first of a class has the smallest (id, text key, number); null ids
    come first.  Rows that repeat an id and its text are one document.
    """
    places = _places(docs, id_col, text)
    lines = stored(places.groupBy("line").agg(F.count("*").alias("n"))
                   .withColumn("id", F.monotonically_increasing_id()), "line-distinct")
    comp = line_classes(lines.select("id", "line"), edits, min_chars)
    # lines that can repeat something: several times there, or in a class with others
    named = stored(lines.select("id", "n", F.md5("line").alias("line_key")).join(comp, "id", "left")
                   .filter((F.col("n") > 1) | F.col("comp").isNotNull())
                   .select("line_key", F.coalesce("comp", "id").alias("class")), "line-classes")
    where = stored(places.select("doc_id", "text_key", "line_no", F.md5("line").alias("line_key")).join(named, "line_key")
                   .select("class", F.struct("doc_id", "text_key", "line_no").alias("place")).distinct(), "line-places")
    first = where.groupBy("class").agg(F.min("place").alias("first"))
    return where.join(first, "class").filter("place <> first").select(
        "place.*", F.col("first.doc_id").alias("first_doc"), F.col("first.line_no").alias("first_line"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
                text: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of the text, ``n_lines`` (non-empty
    lines before) and ``removed`` (array of line_no, first_doc, first_line by
    number).  Null texts stay null; clashing columns are replaced."""
    docs = docs.drop("n_lines", "removed")
    gone = (repeated_lines(docs, edits, min_chars, id_col, text)
            .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("line_no", "first_doc", "first_line")))
                                               .alias("removed")))
    gone = stored(gone.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "removed"), "line-gone")
    n_docs, n_gone = gone.agg(F.count("*"), F.sum(F.size("removed"))).first()
    if 64 * n_docs + 40 * (n_gone or 0) <= BROADCAST_BYTES:      # else the texts are joined by a shuffle
        gone = F.broadcast(gone)
    out = docs.withColumn("_text_key", F.md5(text))
    out = out.join(gone, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_text_key") == F.col("_key")), "left").drop(
        "_id", "_key", "_text_key")
    parts = F.split(text, "\n", -1)
    numbers = F.transform("removed", lambda r: r["line_no"])
    kept = F.filter(parts, lambda x, i: ~F.array_contains(numbers, i))
    return (out.withColumn("n_lines", F.coalesce(F.size(F.filter(parts, lambda x: F.length(x) > 0)), F.lit(0)).cast("long"))
            .withColumn("n_lines", F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.col("n_lines")).cast("long"))
            .withColumn(text, F.when(F.col("removed").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))))
