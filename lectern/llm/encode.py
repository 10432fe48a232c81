"""Encoding a corpus with a public byte-level BPE vocabulary (problem 8).

Method: contiguous rank array. A short word is a list of part boundaries and a
parallel list of the ranks of adjacent parts; the minimum is found by scanning,
its boundary is deleted and the two neighbouring ranks are looked up again.
Words above ``LONG_WORD`` bytes use a heap over the same boundaries, so that no
text, however long, costs quadratic time.

Most work is saved before the merging: a text falls into chunks at white space,
and chunks recur, so their encoded bytes are remembered. Runs of letters
without spaces (Chinese, Japanese, Korean) are cut where no vocabulary entry
spans the border between two characters; no merge can cross such a border.

Defined results: null and empty texts have an empty list. Literal control
markers such as ``<|endoftext|>`` are ordinary text. A null id stays null, a
repeated row is encoded each time.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

VOCAB_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: Unicode White_Space, which the pattern's \s stands for.
SPACE = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
LONG_WORD = 192
REMEMBERED = 250_000
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
NONE = 1 << 30


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The vocabulary: base64 of the bytes and the rank, one a line."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


class _Chunks(dict):
    """Encoded bytes by chunk; what is missing is encoded on access."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(chunk) <= 32:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids


class Encoder:
    """Encodes texts into little-endian int32 ids of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex

        self.ranks = ranks
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\s+(?!\S)", f"[{SPACE}]+(?![^{SPACE}])").replace(r"\s+", f"[{SPACE}]+")).findall
        self.words: dict[str, bytes] = {}
        self.chunks = _Chunks(self._chunk)
        self.borders = self._spanned(ranks)
        self.free: dict[str, bool] = {}

    @staticmethod
    def _spanned(ranks: dict[bytes, int]) -> set[tuple[bytes, bytes]]:
        """For every border between characters inside an entry: what stands left and right of it."""
        out = set()
        for entry in ranks:
            for i in range(1, len(entry)):
                if entry[i] & 0xC0 != 0x80:  # a character starts here
                    left = i - 1
                    while left > 0 and entry[left] & 0xC0 == 0x80:
                        left -= 1
                    right = i + 1
                    while right < len(entry) and entry[right] & 0xC0 == 0x80:
                        right += 1
                    out.add((entry[left:i], entry[i:right]))
        return out

    def _is_free(self, pair: str) -> bool:
        """Whether no entry spans the border between these two characters."""
        a, b = pair[0].encode(), pair[1].encode()
        free = not any((a[i:], b[:j]) in self.borders for i in range(len(a)) for j in range(1, len(b) + 1))
        if len(self.free) < 4 * REMEMBERED:
            self.free[pair] = free
        return free

    def _pieces(self, word: str) -> Iterator[str]:
        free, start = self.free, 0
        for i in range(1, len(word)):
            pair = word[i - 1 : i + 1]
            known = free.get(pair)
            if self._is_free(pair) if known is None else known:
                yield word[start:i]
                start = i
        yield word[start:]

    def _chunk(self, chunk: str) -> bytes:
        out = []
        for word in self.split(chunk):
            parts = (word,) if word.isascii() else self._pieces(word)
            for part in parts:
                ids = self.words.get(part)
                if ids is None:
                    ids = np.array(self.merge(part.encode()), dtype="<i4").tobytes()
                    if len(part) <= 32:
                        if len(self.words) >= REMEMBERED:
                            self.words.clear()
                        self.words[part] = ids
                out.append(ids)
        return b"".join(out)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ranks = self.ranks
        whole = ranks.get(word)
        if whole is not None:
            return [whole]
        if len(word) > LONG_WORD:
            return self._merge_long(word)
        starts = list(range(len(word) + 1))
        near = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
        while near:
            least = min(near)
            if least == NONE:
                break
            i = near.index(least)
            del starts[i + 1], near[i]
            if i < len(near):
                near[i] = ranks.get(word[starts[i] : starts[i + 2]], NONE)
            if i:
                near[i - 1] = ranks.get(word[starts[i - 1] : starts[i + 1]], NONE)
        return [ranks[word[a:b]] for a, b in zip(starts, starts[1:])]

    def _merge_long(self, word: bytes) -> list[int]:
        ranks, n = self.ranks, len(word)
        after, before = list(range(1, n + 2)), list(range(-1, n))
        alive = [True] * n
        end = lambda i: after[i] if i < n else n
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if not alive[i] or after[i] != j or j >= n or not alive[j] or end(j) != k:
                continue
            alive[j] = False
            after[i] = k
            if k < n:
                before[k] = i
                if (r := ranks.get(word[i : end(k)])) is not None:
                    heapq.heappush(heap, (r, i, k, end(k)))
            h = before[i]
            if h >= 0 and (r := ranks.get(word[h:k])) is not None:
                heapq.heappush(heap, (r, h, i, k))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : after[i]]])
            i = after[i]
        return out

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as int32 bytes; none for null and empty text."""
        return b"".join(map(self.chunks.__getitem__, CHUNK.findall(text))) if text else b""


_encoders: dict[int, Encoder] = {}


def encoder_for(raw: bytes) -> Encoder:
    """The encoder of a vocabulary file, kept for the life of a Python worker."""
    key = hash(raw)
    if key not in _encoders:
        _encoders[key] = Encoder(read_ranks(raw))
    return _encoders[key]


def vocabulary(df: DataFrame, path: str):
    """The vocabulary file as a broadcast; its size is that of the public file, about a megabyte."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str = VOCAB_PATH) -> DataFrame:
    """One row a row of ``df``: the id and ``ids``, the token ids of the whole text.

    Null and empty texts have an empty list. Other columns are not read.
    """
    raw = vocabulary(df, vocab_path)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_for(raw.value).encode
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(texts), 512):
                parts = [encode(x) for x in texts[at : at + 512].to_pylist()]
                offsets = np.zeros(len(parts) + 1, dtype=np.int64)
                np.cumsum([len(x) // 4 for x in parts], out=offsets[1:])
                flat = np.frombuffer(b"".join(parts), dtype="<i4")
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))
                yield pa.RecordBatch.from_arrays([ids[at : at + 512], lists], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab_path: str = VOCAB_PATH) -> DataFrame:
    """The id, ``n_tokens``, 0 for null and empty texts, and ``row_``, which tells rows without an id apart (0 for all others)."""
    raw = vocabulary(df, vocab_path)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder_for(raw.value).encode, 0
        for batch in batches:
            n = [len(encode(x)) // 4 for x in batch.column(1).to_pylist()]
            null = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            row = np.where(null, np.arange(seen + 1, seen + 1 + len(n)), 0)
            seen += len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(row, pa.int64())], names=[id_col, "n_tokens", "row_"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens bigint, row_ bigint")
