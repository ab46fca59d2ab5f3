"""Language by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of its
labelled text.  A text is parsed greedily into the longest phrases that occur
in the sample; with ``c`` phrases in ``n`` symbols and a sample of ``N``,
``c * log2(N) / n`` bits a symbol estimate the cross entropy (Ziv and
Merhav).  The language that needs the fewest wins.

The automata are small tables (sample size times alphabet) and broadcast.
Many texts are parsed in lock step with NumPy; a long text is cut into pieces
of ``PIECE`` symbols that are parsed side by side, which costs at most one
more phrase a piece, for every language alike.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = 512
BLOCK = 2_000_000          # symbols parsed at a time
OWN_SYMBOLS = 160          # most frequent letters with a symbol of their own
SHARED_SYMBOLS = 64        # symbols that the other letters share
SAMPLE_CHARS = 20_000      # bound of the training sample, for each language
SAMPLE_DOCS = 24           # documents drawn for it, for each language
MAX_LANGUAGES = 500        # beyond, the labels are not languages: an error
UNKNOWN = "und"
MARGIN = 16                # phrases beyond letters at random before a text counts as foreign


class Parser:
    """Suffix automata of a few languages over one alphabet."""

    def __init__(self, samples: dict[str, str], sample_chars: int = SAMPLE_CHARS):
        letters: dict[str, int] = {}
        samples = {k: v.lower() for k, v in sorted(samples.items())}
        for v in samples.values():
            for ch in v:
                if ch.isalpha():
                    letters[ch] = letters.get(ch, 0) + 1
        own = sorted(letters, key=lambda ch: (-letters[ch], ch))[:OWN_SYMBOLS]
        # symbol 0: any run of other characters
        is_letter = np.frombuffer(bytes(chr(i).isalpha() for i in range(0x110000)), np.uint8).astype(bool)
        lut = np.where(is_letter, OWN_SYMBOLS + 1 + np.arange(0x110000) % SHARED_SYMBOLS, 0).astype(np.uint8)
        for k, ch in enumerate(own):
            lut[ord(ch)] = k + 1
        used = np.unique(lut)     # close the gaps, so that the tables stay small
        dense = np.zeros(256, np.uint8)
        dense[used] = np.arange(used.size)
        self.lut, self.size = dense[lut], int(used.size)
        self.names, self.tables, self.log_n = [], [], []
        for name, v in samples.items():
            s = self.symbols(v)[:sample_chars]
            if s.size:
                self.names.append(name)
                self.tables.append(self._table(s))
                self.log_n.append(math.log2(s.size + 1))

    def symbols(self, text: str) -> np.ndarray:
        """Symbols of a lower-cased text, runs of non-letters as one."""
        s = self.lut[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = np.ones(s.size, bool)
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
        return s[keep]

    def _table(self, s: np.ndarray) -> np.ndarray:
        """Moves of the automaton: 4 * (next state * alphabet) + phrases ended by the step."""
        nxt, link, length, last = [{}], [-1], [0], 0
        for c in s.tolist():
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        a = self.size
        root = np.ones(a, np.int32)                       # a symbol the sample lacks is a phrase
        for c, q in nxt[0].items():
            root[c] = 4 * q * a
        table = np.empty((len(nxt), a), np.int32)
        table[:] = root + 1                               # the phrase ends before this symbol, which starts the next
        table[0] = root
        for state, moves in enumerate(nxt):
            if state:
                for c, q in moves.items():
                    table[state, c] = 4 * q * a
        return table.ravel()

    def parse(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bits a symbol for each text and language, number of letters, of symbols)."""
        sym = [self.symbols(t.lower()) for t in texts]
        sizes = np.array([s.size for s in sym])
        letters = np.array([int(np.count_nonzero(s)) for s in sym])
        flat = np.concatenate(sym).astype(np.int32) if sym else np.empty(0, np.int32)
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        pieces = -(-sizes // PIECE)
        owner = np.repeat(np.arange(len(sym)), pieces)
        nth = np.arange(owner.size) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = first[owner] + nth * PIECE
        size = np.minimum(sizes[owner] - nth * PIECE, PIECE)
        order = np.argsort(-size, kind="stable")
        owner, start, size = owner[order], start[order], size[order]
        active = np.searchsorted(-size, -np.arange(PIECE), side="left")   # pieces longer than t
        bits = np.empty((len(sym), len(self.tables)))
        for k, table in enumerate(self.tables):
            state = np.zeros(start.size, np.int32)
            phrases = np.zeros(start.size, np.int32)
            for t in range(PIECE):
                m = active[t]
                if not m:
                    break
                move = table[state[:m] + flat[start[:m] + t]]
                phrases[:m] += move & 3
                state[:m] = move >> 2
            phrases += state > 0
            total = np.bincount(owner, phrases, minlength=len(sym))
            bits[:, k] = total * self.log_n[k] / np.maximum(sizes, 1)
        return bits, letters, sizes

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None], list[bool]]:
        """Language, score and bits a symbol of each text, and whether it is
        foreign: the best language needs more bits for it than letters at
        random, by ``MARGIN`` phrases.  Short texts cannot reach the margin."""
        langs, scores, best_bits, foreign = [], [], [], []
        at = 0
        while at < len(texts):
            to, total = at, 0
            while to < len(texts) and (to == at or total + len(texts[to] or "") <= BLOCK):
                total += len(texts[to] or "")
                to += 1
            bits, letters, sizes = self.parse([t or "" for t in texts[at:to]])
            for row, n, size in zip(bits, letters, sizes):
                if n == 0 or row.size == 0:
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    best_bits.append(None)
                    foreign.append(False)
                    continue
                k = int(np.argmin(row))
                other = np.delete(row, k).min() if row.size > 1 else math.log2(max(2, self.size))
                langs.append(self.names[k])
                scores.append(float(min(1.0, max(0.0, 1.0 - row[k] / other))) if other > 0 else 0.0)
                best_bits.append(float(row[k]))
                foreign.append(bool((row[k] - self.letter_bits) * size > MARGIN * self.log_n[k]))
            at = to
        return langs, scores, best_bits, foreign

    @property
    def letter_bits(self) -> float:
        """Bits a symbol of a text whose every letter is a phrase of its own."""
        return math.log2(max(2, self.size))


def fit(labelled: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
        sample_chars: int = SAMPLE_CHARS, sample_docs: int = SAMPLE_DOCS) -> Parser:
    """Automata from a bounded sample: of each language the documents with
    the smallest hash in each of ``sample_docs`` hash slots, together at most
    ``sample_chars`` symbols.  Rows with null id, text or language are left out."""
    usable = labelled.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(
        F.col("id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    h = F.xxhash64(F.col("id").cast("string"))
    picked = (usable.groupBy("lang", F.pmod(h, F.lit(sample_docs)).alias("slot"))
              .agg(F.min_by("id", h).alias("id")).select("lang", "id"))
    if picked.select("lang").distinct().count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} language labels")
    # at most sample_docs * MAX_LANGUAGES ids
    rows = (usable.join(F.broadcast(picked), ["lang", "id"])
            .select("lang", "id", F.substring("text", 1, sample_chars).alias("text"))
            .groupBy("lang", "id").agg(F.min("text").alias("text")).collect())
    samples: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], str(r["id"]))):
        samples.setdefault(r["lang"], []).append(r["text"])
    return Parser({k: "\n".join(v) for k, v in samples.items()}, sample_chars)


def predict(docs: DataFrame, parser: Parser, text: str = "text", foreign: str | None = None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1: how far behind the
    second language is) and ``bits`` (a symbol, of the winner).

    Null text or text without a letter: ``und``, score 0, null bits; so is
    everything if there was nothing to learn from.  Columns that clash with
    the results are replaced, all others are passed on untouched.
    ``foreign`` names one more column: is the text long enough to tell that no
    language explains it (``Parser.predict``)?
    """
    docs = docs.drop("lang_pred", "score", "bits", *([foreign] if foreign else []))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType()),
                           *([T.StructField(foreign, T.BooleanType())] if foreign else [])])
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, bits, beyond = shared.value.predict(b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(bits, pa.float64()),
                 *([pa.array(beyond, pa.bool_())] if foreign else [])],
                names=[*b.schema.names, "lang_pred", "score", "bits", *([foreign] if foreign else [])])

    return docs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """The third of the ids that is never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
