"""Benchmark passages in training text, by an FM-index for each training shard.

A shard is a few megabytes of documents of one scan task.  Its words become
numbers; a word that no benchmark item has is a wall, because no test phrase
can cross it, and stretches between walls that are shorter than the shortest
phrase are left out.  Over what remains the shard gets an FM-index: suffix
order by prefix doubling, the Burrows-Wheeler transform in a wavelet matrix,
and every ``SAMPLE``-th suffix position.  All test phrases (windows of
``window`` words) are searched backwards together, occurrences are located by
stepping to a sampled position, and the hit words merge to removal spans.

Nothing is shuffled; the phrases are broadcast in blocks of at most
``BLOCK_WORDS`` benchmark words, one pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOW = 10
SHARD_BYTES = 6_000_000
SAMPLE = 8
BLOCK_WORDS = 500_000
HASH_WORDS = 1 << 16

# A-Z to a-z; words are 0-9, a-z and all bytes of non-ASCII characters
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_BASE = 0x9E3779B97F4A7C15
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(1 << 19, 1 << (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        made = []
        for x in (_BASE, pow(_BASE, -1, 2 ** 64)):
            f = np.full(size, x, np.uint64)
            f[0] = 1
            made.append(np.cumprod(f))
        _powers[size] = tuple(made)
    return _powers[size]


def word_bounds(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words of lower-cased bytes."""
    edge = np.diff(np.concatenate(([False], _IS_WORD[b], [False])).view(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word, from prefix sums of a polynomial over the bytes
    (taken up anew every ``HASH_WORDS`` words, which bounds the tables)."""
    out = np.empty(start.size, np.uint64)
    for at in range(0, start.size, HASH_WORDS):
        s, e = start[at:at + HASH_WORDS], end[at:at + HASH_WORDS]
        part = b[s[0]:e[-1]]
        s, e = s - s[0], e - s[0]
        up, down = _power(part.size + 1)
        total = np.empty(part.size + 1, np.uint64)
        total[0] = 0
        np.cumsum(part * up[:part.size], out=total[1:])
        h = (total[e] - total[s]) * down[s]
        h = (h ^ (h >> np.uint64(29)) ^ (e - s).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        out[at:at + HASH_WORDS] = h ^ (h >> np.uint64(32))
    return out


def _lowered(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)


class Phrases:
    """Test phrases as numbers: the vocabulary, distinct windows, and their items."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.items = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.items)}
        hashed = []
        for item, text in items:
            b = _lowered(text)
            hashed.append((number[item], word_hashes(b, *word_bounds(b))))
        self.vocabulary = np.unique(np.concatenate([h for _, h in hashed])) if hashed else np.empty(0, np.uint64)
        windows: dict[tuple, set[int]] = {}
        for item, h in hashed:
            ids = (np.searchsorted(self.vocabulary, h) + 1).tolist()
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                windows.setdefault(tuple(ids[k:k + window]), set()).add(item)
        keys = sorted(windows)
        self.size = np.array([len(w) for w in keys], np.int64)
        self.words = np.zeros((len(keys), window), np.int64)      # right-aligned: the search goes backwards
        for k, w in enumerate(keys):
            self.words[k, window - len(w):] = w
        self.item_of = np.array([i for w in keys for i in sorted(windows[w])], np.int64)
        self.item_at = np.concatenate(([0], np.cumsum([len(windows[w]) for w in keys]))).astype(np.int64)
        self.shortest = int(self.size.min()) if keys else 0
        self.seen = np.zeros(1 << 16, bool)      # quick check before the search in the vocabulary
        self.seen[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Word numbers from 1; 0 for words that no item has."""
        out = np.zeros(h.size, np.int64)
        maybe = np.flatnonzero(self.seen[(h & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, h[maybe])
        at[at == self.vocabulary.size] = 0
        found = self.vocabulary[at] == h[maybe]
        out[maybe[found]] = at[found] + 1
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of ``text``; zeros are walls, each smaller than the next
    one and than all words, so that comparisons end there.  The text ends with one."""
    n = text.size
    walls = np.flatnonzero(text == 0)
    order = np.empty(n, np.int64)
    order[:walls.size] = walls
    rank = np.empty(n, np.int64)
    rank[walls] = np.arange(walls.size)
    todo = np.flatnonzero(text)
    key, base, step = text[todo], np.full(todo.size, walls.size, np.int64), 0
    while todo.size:
        by = np.lexsort((key, base)) if step else np.argsort(key, kind="stable")
        todo, key, base = todo[by], key[by], base[by]
        place = np.arange(todo.size)
        fresh = np.ones(todo.size, bool)
        fresh[1:] = base[1:] != base[:-1]
        slot = base + place - np.maximum.accumulate(np.where(fresh, place, 0))
        fresh[1:] |= key[1:] != key[:-1]
        head = slot[np.maximum.accumulate(np.where(fresh, place, 0))]
        rank[todo] = head
        order[slot] = todo
        alone = fresh & np.concatenate((fresh[1:], [True]))
        todo, base = todo[~alone], head[~alone]
        step = max(1, 2 * step)
        key = rank[todo + step]
    return order


class WaveletMatrix:
    """Rank and access over a sequence of small numbers, one bit a level."""

    def __init__(self, s: np.ndarray, top: int):
        self.levels, self.n = [], s.size
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            one = (s >> bit) & 1 == 1
            ones = np.concatenate(([0], np.cumsum(one)))
            self.levels.append((bit, one, ones, self.n - int(ones[-1])))
            s = np.concatenate((s[~one], s[one]))

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``c`` stands before position ``at``."""
        lo = np.zeros(at.size, np.int64)
        for bit, _, ones, zeros in self.levels:
            is_one = (c >> bit) & 1 == 1
            a, b = ones[lo], ones[at]
            lo = np.where(is_one, zeros + a, lo - a)
            at = np.where(is_one, zeros + b, at - b)
        return at - lo

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number at each position, and how often it stands before."""
        c, lo = np.zeros(at.size, np.int64), np.zeros(at.size, np.int64)
        for bit, one, ones, zeros in self.levels:
            is_one = one[at]
            a, b = ones[lo], ones[at]
            c |= is_one.astype(np.int64) << bit
            lo = np.where(is_one, zeros + a, lo - a)
            at = np.where(is_one, zeros + b, at - b)
        return c, at - lo


class FMIndex:
    """Counts and places of phrases in a text of numbers with walls (0)."""

    def __init__(self, text: np.ndarray):
        order = suffix_order(text)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text))))   # suffixes that start with a smaller number
        self.bwt = WaveletMatrix(text[order - 1], int(text.max(initial=0)))
        # sampled: every so many positions, and all that follow a wall (no step can go back over one)
        marked = (order % SAMPLE == 0) | (text[order - 1] == 0)
        self.marked, self.marks_before = marked, np.concatenate(([0], np.cumsum(marked)))
        self.sampled = order[marked]
        self.top = self.before.size - 1

    def search(self, words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range of suffixes that start with each phrase (rows of ``words``, right-aligned)."""
        lo, hi = np.zeros(size.size, np.int64), np.zeros(size.size, np.int64)
        hi[:] = self.bwt.n
        live = np.arange(size.size)
        for k in range(words.shape[1]):
            live = live[(size[live] > k) & (hi[live] > lo[live])]
            if not live.size:
                break
            c = words[live, words.shape[1] - 1 - k]
            inside = c < self.top
            hi[live[~inside]] = lo[live[~inside]]
            now, c = live[inside], c[inside]
            lo[now], hi[now] = self.before[c] + self.bwt.rank(c, lo[now]), self.before[c] + self.bwt.rank(c, hi[now])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, by their place in the order."""
        at, steps = rows.copy(), np.zeros(rows.size, np.int64)
        todo = np.flatnonzero(~self.marked[at])
        while todo.size:
            c, r = self.bwt.access(at[todo])
            at[todo] = self.before[c] + r
            steps[todo] += 1
            todo = todo[~self.marked[at[todo]]]
        return self.sampled[self.marks_before[at]] + steps


def find_hits(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray], list]:
    """For the documents of a shard: word counts, hit word numbers, item
    numbers, and the byte bounds (start, end) of the hit words."""
    n = len(texts)
    b = np.frombuffer(b"\0".join(texts).translate(_LOWER), np.uint8)
    start, end = word_bounds(b)
    offset = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))[:n]
    first = np.searchsorted(start, offset)                        # first word of each document
    counts = np.diff(np.concatenate((first, [start.size])))
    nothing = np.empty(0, np.int64)
    hits, items, bounds = [nothing] * n, [nothing] * n, [(nothing, nothing)] * n
    if not phrases.size.size or not start.size:
        return counts, hits, items, bounds
    number = phrases.numbers(word_hashes(b, start, end))
    # stretches of known words within a document
    known = number > 0
    breaks = ~known
    newdoc = np.zeros(number.size, bool)
    newdoc[first[first < number.size]] = True
    stretch = np.cumsum(breaks | newdoc)
    long_enough = np.bincount(stretch[known], minlength=int(stretch[-1]) + 1) >= phrases.shortest
    word = np.flatnonzero(known & long_enough[stretch])
    if not word.size:
        return counts, hits, items, bounds
    cut = np.flatnonzero(stretch[word][1:] != stretch[word][:-1]) + 1
    text = np.concatenate((np.insert(number[word], cut, 0), [0]))
    origin = np.concatenate((np.insert(word, cut, -1), [-1]))     # word that stands at each position
    index = FMIndex(text)
    lo, hi = index.search(phrases.words, phrases.size)
    found = np.flatnonzero(hi > lo)
    if not found.size:
        return counts, hits, items, bounds
    many = hi[found] - lo[found]
    which = np.repeat(found, many)
    rows = np.arange(which.size) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo[found], many)
    at = origin[index.locate(rows)]
    mark = np.zeros(start.size + 1, np.int64)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + phrases.size[which], -1)
    hit = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    doc = np.searchsorted(first, at, side="right") - 1
    pair = np.unique(doc * np.int64(phrases.size.size) + which)   # (document, phrase)
    doc, which = pair // phrases.size.size, pair % phrases.size.size
    many = phrases.item_at[which + 1] - phrases.item_at[which]
    place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(phrases.item_at[which], many)
    pair = np.unique(np.repeat(doc, many) * np.int64(len(phrases.items)) + phrases.item_of[place])
    doc, item = pair // len(phrases.items), pair % len(phrases.items)
    for d in np.unique(doc):
        items[d] = item[doc == d]
        mine = hit[np.searchsorted(hit, first[d]):np.searchsorted(hit, first[d] + counts[d])]
        hits[d] = mine - first[d]
        bounds[d] = (start[mine] - offset[d], end[mine] - offset[d])
    return counts, hits, items, bounds


def removal_spans(text: bytes, words: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans of runs of adjacent hit words."""
    if not words.size:
        return []
    cut = np.flatnonzero(np.diff(words) > 1)
    lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    points = np.concatenate(([0], np.cumsum(lead)))
    return list(zip(points[start[np.concatenate(([0], cut + 1))]].tolist(),
                    points[end[np.concatenate((cut, [words.size - 1]))]].tolist()))


_RESULTS = {"n_words": T.LongType(), "hit_words": T.ArrayType(T.IntegerType()), "hit_items": T.ArrayType(T.StringType()),
            "removal_spans": T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()),
                                                       T.StructField("end", T.IntegerType())]))}


def _pass(phrases, text: str, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = phrases.value
        types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()),
                 pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
        for batch in batches:
            texts = [x.encode("utf-8", "surrogatepass") if x is not None else b"" for x in batch.column(text).to_pylist()]
            old = None if first else [batch.column(c).to_pylist() for c in ("hit_words", "hit_items", "removal_spans")]
            n_words, hit_words, hit_items, spans = [], [], [], []
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= SHARD_BYTES):
                    size += len(texts[to])
                    to += 1
                counts, hits, items, bounds = find_hits(texts[at:to], p)
                for k in range(to - at):
                    words, (s, e) = hits[k], bounds[k]
                    names = [p.items[i] for i in items[k]]
                    if old is not None and old[0][at + k]:        # of an earlier block of the benchmark
                        b = np.frombuffer(texts[at + k].translate(_LOWER), np.uint8)
                        words = np.union1d(words, np.array(old[0][at + k], np.int64))
                        s, e = (x[words] for x in word_bounds(b))
                        names = sorted({*names, *old[1][at + k]})
                    n_words.append(int(counts[k]))
                    hit_words.append(words.tolist())
                    hit_items.append(names)
                    spans.append([{"start": x, "end": y} for x, y in removal_spans(texts[at + k], words, s, e)])
                at = to
            new = [pa.array(x, t) for x, t in zip((n_words, hit_words, hit_items, spans), types)]
            if first:
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *_RESULTS])
            else:
                keep = [c for c in batch.schema.names if c not in _RESULTS]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *new], names=[*keep, *_RESULTS])
    return run


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
                       item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``hit_words`` (numbers of the words inside a
    benchmark window), ``hit_items`` (ids as sorted strings) and
    ``removal_spans`` (merged, code points, end exclusive).

    Null text has no words.  Items without id or words are left out; an empty
    benchmark hits nothing.  Repeated rows are each looked at; columns that
    clash with the results are replaced.
    """
    docs = docs.drop(*_RESULTS)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(k, t) for k, t in _RESULTS.items()]])
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("t")).filter(
        F.col("item").isNotNull() & F.col("t").isNotNull())
    words = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-words // (2 * BLOCK_WORDS)))     # a word and what follows it take 2 characters at least
    spark = docs.sparkSession
    out = docs
    for k in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()     # bounded by the block
        phrases = spark.sparkContext.broadcast(Phrases([(r["item"], r["t"]) for r in rows], window))
        out = out.mapInArrow(_pass(phrases, text, k == 0), schema)
    return out
