"""Near copies of texts (problem 2).

Method: chosen-path set similarity join. Every text is a set of shingles,
embedded by ``WIDTH`` minwise hashes. A node of a tree holds the texts that
share its path; it branches on positions chosen by a hash of the path, about
1 / threshold of them, and a text follows those branches with its own minwise
token there. A node of at most ``NODE`` texts is compared exhaustively at
whatever level it stands, a larger one branches on. So many independent trees are joined that a pair at the
threshold is met with the probability ``RECALL`` at the depth reached (at least
``TREES``): texts of large nodes, which go deeper, get further trees. Pairs are
then checked exactly on the shingle sets.

Texts with the same shingle set are one class beforehand: its least id goes
through the trees, the others are its members. So a group of copies, however
large, is one leaf entry.

A node that still holds more than NODE texts at the last level is compared in
blocks by several tasks, none of which holds the node.

Defined results: null, empty and short texts (fewer than ``least`` shingles)
have no partner. Ids should be unique; rows with the same id count as one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, stage

THRESHOLD = 0.7
WORDS = 3
LEAST = 20
WIDTH = 64
#: Least number of trees, and the share of pairs at the threshold to be met, whatever the depth.
TREES = 10
RECALL = 0.99
NODE = 200
#: Levels of branching; a node that is large even then is compared in blocks.
DEPTH = 7
#: Agreement of minwise hashes below which a pair is not checked exactly: 3.5 standard errors below the threshold.
SKETCH_SLACK = 3.5
WIDE = "぀-ヿ一-鿿가-힯"
WORD = re.compile(rf"[{WIDE}]|[^\W_{WIDE}]+")
_PLAIN = re.compile(r"[a-z0-9]+")
M61 = (1 << 61) - 1
_rng = np.random.default_rng(20240607)
MUL = _rng.integers(1, 1 << 62, WIDTH, dtype=np.uint64) | np.uint64(1)
ADD = _rng.integers(0, 1 << 62, WIDTH, dtype=np.uint64)


class _Words(dict):
    """A stable 64-bit hash by word."""

    def __missing__(self, word: str) -> int:
        from hashlib import blake2b

        n = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        if len(self) > 400_000:
            self.clear()
        self[word] = n
        return n


_words = _Words()


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The distinct hashed sequences of ``words`` words, sorted."""
    text = text.lower()
    found = _PLAIN.findall(text) if text.isascii() else WORD.findall(text)
    n = len(found)
    if n < words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_words.__getitem__, found), dtype=np.uint64, count=n)
    out = h[: n - words + 1].copy()
    for k in range(1, words):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (out >> np.uint64(29))
        out += h[k : n - words + 1 + k]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def minwise(sets: np.ndarray) -> np.ndarray:
    """WIDTH minwise hashes of a set, 32 bits each; a large set in parts, so that memory stays small."""
    parts = [((sets[at : at + 8192, None] * MUL + ADD) >> np.uint64(32)).min(axis=0) for at in range(0, len(sets), 8192)]
    return (parts[0] if len(parts) == 1 else np.min(parts, axis=0)).astype(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def branches(path: np.ndarray, sketch: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The children of each (path, sketch): the row, and the path of the child.

    Which positions a path branches on is a hash of the path, the same for all
    texts that share it; a text's child is named by its minwise token there.
    """
    with np.errstate(over="ignore"):
        p = _mix(path[:, None] + np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        row, pos = np.nonzero(p < np.uint64(int((1 << 64) / (threshold * WIDTH)) & ((1 << 64) - 1)))
        return row, _mix(p[row, pos] ^ (sketch[row, pos].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


def recall_of(trees: int, depth: int, threshold: float, similarity: float) -> float:
    """The share of pairs of a similarity that share a node at ``depth`` in one of the trees: every level must hand on a common branch."""
    agree = np.arange(WIDTH + 1)
    weight = np.array([comb(WIDTH, a) for a in range(WIDTH + 1)], dtype=float) * similarity**agree * (1 - similarity) ** (WIDTH - agree)
    met = np.ones(WIDTH + 1)
    for _ in range(depth):
        met = 1 - (1 - met * min(1.0, 1 / (threshold * WIDTH))) ** agree
    return float((weight * (1 - (1 - met) ** trees)).sum())


def trees_for(depth: int, threshold: float, recall: float | None = None, least: int = TREES) -> int:
    """The number of trees, at least ``least``, that meet pairs at the threshold with the recall at a depth."""
    trees = least
    while recall_of(trees, depth, threshold, threshold) < (RECALL if recall is None else recall):
        trees += 1
    return trees


def sketches(df: DataFrame, id_col: str, text_col: str, words: int, least: int) -> DataFrame:
    """By row with enough shingles: ``id``, ``n`` shingles, ``same`` (a hash of the set), ``sketch``."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, n, same, sketch = [], [], [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                s = shingles(text, words)
                if len(s) >= least:
                    row.append(k)
                    n.append(len(s))
                    with np.errstate(over="ignore"):
                        same.append(int(_mix(s).sum(dtype=np.uint64) ^ np.uint64(len(s))) - (1 << 63))
                    sketch.append(minwise(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(n, pa.int32()), pa.array(same, pa.int64()), pa.array(sketch, pa.binary())], names=["id", "n", "same", "sketch"])

    return df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, text_col).mapInArrow(run, f"id {kind}, n int, same bigint, sketch binary")


def _unpack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, WIDTH)


def _nibbles(sketch: np.ndarray) -> np.ndarray:
    """The low 4 bits of each token, two a byte: what leaves compare."""
    low = (sketch & np.uint32(15)).astype(np.uint8)
    return low[:, ::2] << 4 | low[:, 1::2]


def _rows_at(path: np.ndarray, row: np.ndarray, part: pa.RecordBatch, sketch: np.ndarray) -> pa.RecordBatch:
    take = pa.array(row)
    small = np.ascontiguousarray(_nibbles(sketch))
    packed = pa.Array.from_buffers(pa.binary(WIDTH // 2), len(small), [None, pa.py_buffer(small)]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), part.column(0).take(take), part.column(1).take(take), packed.take(take)], names=["path", "id", "n", "small"])


AT_NODE = "path bigint, id {kind}, n int, small binary"


def _spread(reps: DataFrame, trees: range, threshold: float, levels: int, kind: str) -> DataFrame:
    """Every text at every node of the given level of the trees of these numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sketch = _unpack(part.column(2))
                row = np.tile(np.arange(part.num_rows), len(trees))
                path = np.repeat(_mix(np.arange(trees.start + 1, trees.stop + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)), part.num_rows)
                for _ in range(levels):
                    k, path = branches(path, sketch[row], threshold)
                    row = row[k]
                yield _rows_at(path, row, part, sketch)

    return reps.select("id", "n", "sketch").mapInArrow(run, AT_NODE.format(kind=kind))


def _deeper(rows: DataFrame, threshold: float, kind: str) -> DataFrame:
    """The rows (id, n, sketch, path) of large nodes at their children."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                sketch = _unpack(part.column(2))
                row, path = branches(part.column(3).to_numpy().view(np.uint64), sketch, threshold)
                yield _rows_at(path, row, part, sketch)

    return rows.select("id", "n", "sketch", "path").mapInArrow(run, AT_NODE.format(kind=kind))


def _compare(rows: DataFrame, threshold: float, kind: str) -> DataFrame:
    """The likely pairs of every node: ``a`` < ``b``. Rows of a node come one after the other; no node is larger than NODE."""
    # what agrees by chance on 4 bits comes on top
    expected = threshold + (1 - threshold) / 16
    enough = int(np.floor(WIDTH * expected - SKETCH_SLACK * np.sqrt(WIDTH * expected * (1 - expected))))

    def pairs(path, ids, n, small) -> tuple[pa.Array, pa.Array]:
        low = np.concatenate([small >> 4, small & 15], axis=1)
        left, right = [], []
        for shift in range(1, len(path)):
            k = np.flatnonzero(path[shift:] == path[:-shift])
            if not len(k):
                break
            x, y = n[k].astype(float), n[k + shift].astype(float)
            k = k[np.minimum(x, y) >= threshold * np.maximum(x, y)]
            if len(k):
                k = k[(low[k] == low[k + shift]).sum(axis=1) >= enough]
                left.append(k)
                right.append(k + shift)
        a, b = (pa.array(np.concatenate(x) if x else np.zeros(0, dtype=np.int64)) for x in (left, right))
        return ids.take(a), ids.take(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            block = pa.Table.from_batches([*([rest] if rest is not None else []), batch]).combine_chunks().to_batches()[0] if batch.num_rows else rest
            if block is None:
                continue
            path = block.column(0).to_numpy()
            # the last node may go on in the next batch
            cut = int(np.flatnonzero(path != path[-1])[-1]) + 1 if (path != path[-1]).any() else 0
            rest = block.slice(cut)
            if cut:
                yield _out(block.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield _out(rest)

    def _out(block: pa.RecordBatch) -> pa.RecordBatch:
        small = np.frombuffer(b"".join(block.column(3).to_pylist()), dtype=np.uint8).reshape(-1, WIDTH // 2)
        a, b = pairs(block.column(0).to_numpy(), block.column(1), block.column(2).to_numpy(), small)
        return pa.RecordBatch.from_arrays([a, b], names=["x", "y"])

    found = rows.repartition("path").sortWithinPartitions("path", "id").mapInArrow(run, f"x {kind}, y {kind}")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b")


def candidate_pairs(reps: DataFrame, threshold: float, kind: str, trees: int = TREES) -> DataFrame:
    """Pairs of representatives that some leaf holds and whose sketches agree, each once; ``trees`` is the least number of trees."""
    trees = trees_for(1, threshold, least=trees)
    level = _spread(reps, range(trees), threshold, 1, kind)
    found, at_level = None, None
    for depth in count(1):
        large = stage(level.groupBy("path").count().where(F.col("count") > NODE), "near-large")
        n_large = large.select(F.lit(1)).count()
        leaves = level.join(large.select("path"), "path", "left_anti") if n_large else level
        part = stage(_compare(leaves, threshold, kind).distinct(), "near-pairs")
        found = part if found is None else found.unionByName(part)
        if not n_large:
            break
        at = level.join(large, "path")
        if depth < DEPTH:
            level = _deeper(at.select("path", "id").join(reps, "id"), threshold, kind)
            # a branch lost at one more level is made up for by further trees, over the texts that go deeper
            more = trees_for(depth + 1, threshold, least=trees)
            if more > trees:
                level = level.unionByName(_spread(reps.join(at.select("id").distinct(), "id", "left_semi"), range(trees, more), threshold, depth + 1, kind))
                trees = more
            level, last = stage(level, "near-level"), at_level
            at_level = level
            release(large)
            if last is not None:
                release(last)
            continue
        # what no branching splits: in blocks, each pair of blocks a node of its own
        blocks = F.ceil(F.col("count") / (NODE / 2)).cast("int")
        at = at.withColumn("blocks", blocks).withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) as int)"))
        at = at.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        path = F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))
        found = found.unionByName(stage(_compare(at.select(path.alias("path"), "id", "n", "small"), threshold, kind).distinct(), "near-blocks"))
        break
    return found.distinct()


def _exact(pairs: DataFrame, df: DataFrame, id_col: str, text_col: str, words: int, threshold: float, kind: str) -> DataFrame:
    """The pairs whose shingle sets overlap enough, with ``similarity``."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                packed = [shingles(x, words).tobytes() for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], names=["id", "bag"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows)
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([u, v])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                out[k] = shared / (len(both) - shared)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "similarity"])

    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    bags = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text_")).join(ids, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(sets, f"id {kind}, bag binary")
    bags = stage(bags, "near-sets")
    both = pairs.join(bags.select(F.col("id").alias("a"), F.col("bag").alias("bag_a")), "a").join(bags.select(F.col("id").alias("b"), F.col("bag").alias("bag_b")), "b")
    return both.select("a", "b", "bag_a", "bag_b").mapInArrow(check, f"a {kind}, b {kind}, similarity double").where(F.col("similarity") >= threshold)


def near_copies(df: DataFrame, id_col: str = "policy_doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS, least: int = LEAST, trees: int = TREES) -> tuple[DataFrame, DataFrame]:
    """Pairs between representatives, and membership.

    The first result has ``a`` < ``b`` and ``similarity`` of representatives
    with different shingle sets; the second every row with enough shingles:
    ``id``, ``rep`` (the least id with the same set) and ``n_same``.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = stage(sketches(df, id_col, text_col, words, least), "near-sketches")
    classes = rows.groupBy("same").agg(F.min(F.struct("id", "n", "sketch")).alias("rep"), F.countDistinct("id").alias("n_same"))
    classes = stage(classes.select("same", "rep.*", "n_same"), "near-classes")
    members = rows.select("id", "same").distinct().join(classes.select("same", F.col("id").alias("rep"), "n_same"), "same").select("id", "rep", "n_same")
    pairs = stage(candidate_pairs(classes.select("id", "n", "sketch"), threshold, kind, trees), "near-candidates")
    return _exact(pairs, df, id_col, text_col, words, threshold, kind), members


#: Up to so many equal texts every pair of rows is given; larger groups of copies by pairs with their representative.
EXPAND = 64


def row_pairs(pairs: DataFrame, members: DataFrame, expand: int = EXPAND) -> DataFrame:
    """Pairs of rows, ``doc_a`` < ``doc_b``.

    Groups of equal texts of at most ``expand`` rows are expanded into all
    pairs. A larger group is given by the pairs of its rows with their
    representative, and by its representative in pairs with other texts.
    """
    small = members.where(F.col("n_same") <= expand).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    within = small.where(F.size("ids") > 1).select(F.posexplode("ids").alias("at", "doc_a"), "ids").select("doc_a", F.explode(F.expr("slice(ids, at + 2, size(ids))")).alias("doc_b"))
    star = members.where((F.col("n_same") > expand) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("doc_a"), F.col("id").alias("doc_b"))
    side = lambda end: small.select(F.col("rep").alias(end), F.col("ids").alias(f"{end}_ids"))
    both = pairs.select("a", "b").join(side("a"), "a", "left").join(side("b"), "b", "left")
    own = lambda end: F.coalesce(f"{end}_ids", F.array(end))
    across = both.select(F.explode(own("a")).alias("x"), own("b").alias("ys")).select("x", F.explode("ys").alias("y"))
    across = across.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))
    return within.unionByName(star).unionByName(across)


def groups(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """A row a member: ``id``, ``group_id`` (the least id of its group) and ``n_links`` of its text to other texts.

    Least labels spread along pairs until none changes. In every round what a
    text sees also lowers the text it has its label from (its root), and labels
    jump to the label of their label, so that rounds grow with the logarithm of
    the longest chain.
    """
    links = stage(pairs.select("a", "b").union(pairs.select("b", "a")), "near-links")
    nodes = members.select(F.col("rep").alias("v")).distinct().withColumn("label", F.col("v"))
    labels = stage(nodes, "near-labels")
    while True:
        near = links.join(labels.select(F.col("v").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("seen"))
        low = labels.join(near, labels.v == near.a, "left").select("v", "label", F.least("label", F.coalesce("seen", "label")).alias("low"))
        # what it sees lowers a text and its root
        hooked = stage(low.select("v", "low").union(low.where("low < label").select("label", "low")).groupBy("v").agg(F.min("low").alias("label")), "near-hooked")
        jump = hooked.select(F.col("v").alias("w"), F.col("label").alias("far"))
        new = stage(hooked.join(jump, hooked.label == jump.w).select("v", F.least("label", "far").alias("label")), "near-labels")
        changed = new.join(labels.select(F.col("v").alias("u"), F.col("label").alias("old")), F.col("v") == F.col("u")).where("label <> old").limit(1).count()
        release(labels)
        release(hooked)
        labels = new
        if not changed:
            break
    n_links = links.groupBy("a").agg(F.count(F.lit(1)).alias("n_links"))
    out = members.join(labels.select(F.col("v").alias("rep"), F.col("label").alias("group_id")), "rep")
    return out.join(n_links.withColumnRenamed("a", "rep"), "rep", "left").select("id", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
