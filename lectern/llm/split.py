"""Splitting oversized texts at natural boundaries (problem 1).

Method: agglomerative merging. A text starts as atomic segments (sentences and
list items; what is larger than a piece may be is cut at clause ends, words or
characters). Adjacent pairs wait in a heap by the strength of the boundary
between them (inside a sentence, sentence end, paragraph end, section start)
and their joint size; the weakest boundary is merged first, as long as the
joint size and the overlap stay within the limit. Every piece after the first
begins with the end of its predecessor, up to the overlap.

Size: if the characters of U+3040-30FF, U+4E00-9FFF and U+AC00-D7AF are more
than half of those that are not white space, their number and the number of
runs of A-Z and a-z; otherwise 1.3 times the words, rounded down. White space
is space, tab, CR, LF and form feed.

Defined results: null, empty and blank texts and texts within the limit give no
piece, unless one paragraph of theirs exceeds the limit by itself (mixed
scripts): then the text is one piece. A missing institution or hash leaves its
part of ``chunk_id`` empty. Every row is split, repeated ones as well.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 750, 60
LINE = re.compile(r"[^\n]*[^ \t\r\n\f][^\n]*(?:\n|$)")
SENTENCE = re.compile(r"[.!?][\"'”’»)\]]*(?=[ \t\r\n\f])|[。！？][」』”’）]*|\n(?=[ \t]*(?:[-*•–·›]|\d+[.)|]|\d+ \|)[ \t])")
CLAUSE = re.compile(r"[,;:](?=[ \t\r\n\f])|[，、；：]")
HEADING = re.compile(r"[ \t\f]*(?:#{1,6}[ \t]|\d+(?:\.\d+)*\.?[ \t])[^\n]{0,150}")
WORD, ATOM, PARAGRAPH, SECTION = 0, 1, 2, 3


class Sizes:
    """The size of any stretch of a text, from running counts."""

    def __init__(self, text: str):
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.solid = (c != 32) & ((c < 9) | (c > 13) | (c == 11))
        self.wide = ((c >= 0x3040) & (c <= 0x30FF)) | ((c >= 0x4E00) & (c <= 0x9FFF)) | ((c >= 0xAC00) & (c <= 0xD7AF))
        self.latin = ((c | 32) >= 97) & ((c | 32) <= 122)
        self.word = self.solid.copy()
        self.word[1:] &= ~self.solid[:-1]
        run = self.latin.copy()
        run[1:] &= ~self.latin[:-1]
        self.run = run
        total = lambda x: np.concatenate([np.zeros(1, np.int32), np.cumsum(x, dtype=np.int32)])
        self.words, self.wides, self.solids, self.runs = total(self.word), total(self.wide), total(self.solid), total(run)
        self.n = len(c)

    def of(self, a: int, b: int) -> int:
        if a >= b:
            return 0
        wide = int(self.wides[b] - self.wides[a])
        if 2 * wide > self.solids[b] - self.solids[a]:
            return wide + int(self.runs[b] - self.runs[a]) + int(self.latin[a] and not self.run[a])
        return (int(self.words[b] - self.words[a]) + int(self.solid[a] and not self.word[a])) * 13 // 10

    def back(self, a: int, b: int, most: int) -> int:
        """The first word or wide character from which on, up to b, no more than ``most`` lies; not before a."""
        starts = np.flatnonzero(self.word[a:b] | self.wide[a:b]) + a
        lo, hi = 0, len(starts)
        while lo < hi:
            mid = (lo + hi) // 2
            if self.of(int(starts[mid]), b) > most:
                lo = mid + 1
            else:
                hi = mid
        return int(starts[lo]) if lo < len(starts) else b


def paragraphs(text: str) -> list[tuple[int, int]]:
    """The stretches of the longest runs of lines that hold more than white space."""
    out: list[tuple[int, int]] = []
    last = -1
    for m in LINE.finditer(text):
        if m.start() == last:
            out[-1] = (out[-1][0], m.end())
        else:
            out.append(m.span())
        last = m.end()
    return out


def _atoms(text: str, sizes: Sizes, paras: list[tuple[int, int]], most: int) -> tuple[list[int], list[int]]:
    """Where atoms start, and the strength of the boundary before each."""
    starts, strengths = [], []
    for a, b in paras:
        cuts = [(a, SECTION if HEADING.match(text, a, b) else PARAGRAPH)]
        cuts += [(m.end(), ATOM) for m in SENTENCE.finditer(text, a, b) if a < m.end() < b]
        for (x, strength), y in zip(cuts, [*(c[0] for c in cuts[1:]), b]):
            starts.append(x)
            strengths.append(strength)
            if sizes.of(x, y) > most:
                at = x
                clauses = [m.end() for m in CLAUSE.finditer(text, x, y)]
                units = np.flatnonzero(sizes.word[x:y] | sizes.wide[x:y]) + x
                for p in sorted({*clauses, *units[24::24].tolist()}):
                    if at < p < y and (p in clauses or sizes.of(at, p) >= 24):
                        starts.append(p)
                        strengths.append(WORD)
                        at = p
                # a stretch without white space or wide characters has size 1, so none is left over
    if starts:
        starts[0] = 0
    return starts, strengths


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int, int]], list[tuple[int, int]]]:
    """The pieces as (start with overlap, start, end, size), and the paragraphs that are too large as (number, start)."""
    # a size is at most the number of characters
    if len(text) <= limit:
        return [], []
    sizes = Sizes(text)
    paras = paragraphs(text)
    large = [(k, a) for k, (a, b) in enumerate(paras) if b - a > limit and sizes.of(a, b) > limit]
    whole = sizes.of(0, sizes.n)
    if whole <= limit:
        return ([(0, 0, sizes.n, whole)] if large else []), large
    starts, strengths = _atoms(text, sizes, paras, limit - overlap)
    n = len(starts)
    ends = [*starts[1:], sizes.n]
    nxt, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(i: int, j: int) -> None:
        if i >= 0 and j < n and (joint := sizes.of(starts[i], ends[j])) + overlap <= limit:
            heap.append((strengths[j], joint, i, j)) if not ready else heapq.heappush(heap, (strengths[j], joint, i, j))

    ready = False
    for i in range(n - 1):
        offer(i, i + 1)
    heapq.heapify(heap)
    ready = True
    while heap:
        _, joint, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j]) or nxt[i] != j or sizes.of(starts[i], ends[j]) != joint:
            continue
        alive[j] = False
        ends[i], nxt[i] = ends[j], nxt[j]
        if nxt[i] < n:
            prev[nxt[i]] = i
        offer(prev[i], i)
        offer(i, nxt[i])
    out, i, before = [], 0, -1
    while i < n:
        a, b = starts[i], ends[i]
        at = a
        if before >= 0:
            at = sizes.back(starts[before], a, overlap)
            while at < a and sizes.of(at, b) > limit:
                at = sizes.back(at + 1, a, overlap)
        out.append((at, a, b, sizes.of(at, b)))
        before, i = i, nxt[i]
    return out, large


def split_documents(
    df: DataFrame, id_col: str = "policy_doc_id", text_col: str = "text", owner_col: str | None = "institution_id", hash_col: str | None = "sha256", limit: int = LIMIT, overlap: int = OVERLAP
) -> DataFrame:
    """A row a piece of every text above the limit.

    Columns: the id, ``chunk_id`` (owner, first 8 characters of the hash,
    running number), ``piece_no``, ``n_pieces``, ``start`` and ``end`` (code
    points, with the overlap), ``overlap_chars``, ``size``, ``text`` and
    ``large_paras``, the paragraphs above the limit that begin in the piece.
    """
    some = lambda c: F.coalesce(F.col(c), F.lit("")) if c else F.lit("")
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_"), F.concat_ws("_", some(owner_col), F.substring(some(hash_col), 1, 8)).alias("name_"))
    rows = rows.where(F.length("text_") > limit)
    names = ["id_", "chunk_id", "piece_no", "n_pieces", "start", "end", "overlap_chars", "size", "text", "large_paras"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.list_(pa.int32())
        for batch in batches:
            ids, texts, owners = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            row, cols = [], [[] for _ in names[1:]]
            for k, text in enumerate(texts):
                pieces, large = split_text(text, limit, overlap)
                for no, (at, a, b, size) in enumerate(pieces):
                    own = [p for p, start in large if a <= start < b]
                    row.append(k)
                    for col, x in zip(cols, (f"{owners[k]}_{no:03d}", no, len(pieces), at, b, a - at, size, text[at:b], own)):
                        col.append(x)
            i32 = lambda x: pa.array(x, pa.int32())
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(cols[0], pa.string()), *map(i32, cols[1:7]), pa.array(cols[7], pa.string()), pa.array(cols[8], types)], names=names)

    out = rows.mapInArrow(run, f"id_ {kind}, chunk_id string, piece_no int, n_pieces int, start int, end int, overlap_chars int, size int, text string, large_paras array<int>")
    return out.withColumnRenamed("id_", id_col)


def large_paragraphs(pieces: DataFrame, id_col: str = "policy_doc_id") -> DataFrame:
    """The paragraphs above the limit, from the pieces they begin in."""
    return pieces.select(id_col, F.explode("large_paras").alias("para_no"))
