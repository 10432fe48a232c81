"""Filling containers of fixed capacity with documents (problem 9).

Method: sum-of-squares online packing. ``level[h]`` counts the open containers
filled to ``h``; a document of size ``s`` goes into the level for which the sum
of the squared counts grows least, a new container being level 0. Documents
come in the order of a hash of their id.

The corpus falls into groups of about ``GROUP_ROWS`` rows by that hash; each is
packed by itself, so that no task holds more than a group. A group leaves a few
containers partly empty, against some ten thousand full ones.

Defined results: documents without tokens get no container. A document above
the capacity is cut into full pieces and a rest; no other is cut. Rows with a
null id are packed like others, and fall into groups by their place in the scan. Of rows with the same id each is packed.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import VOCAB_PATH, token_counts

CAPACITY = 2048
GROUP_ROWS = 40_000


def pack_sizes(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The container number of each size, 0 < size <= capacity, placed in the given order."""
    level = np.zeros(capacity + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, made = np.empty(len(sizes), dtype=np.int64), 0
    for k, s in enumerate(sizes.tolist()):
        room = capacity - s
        if not room:
            out[k], made = made, made + 1
            continue
        # growth of the sum of squares by level 0..room: leaving h, entering h + s (a full container counts no more)
        growth = 2 * level[s:] + 1
        growth[room] = 0
        growth -= 2 * level[: room + 1] - 1
        growth[0] = 2 * level[s] + 1
        growth[1:][level[1 : room + 1] == 0] = 1 << 60
        h = room - int(growth[::-1].argmin())
        if h:
            bin_ = open_at[h].pop()
            level[h] -= 1
        else:
            bin_, made = made, made + 1
        if h + s < capacity:
            level[h + s] += 1
            open_at[h + s].append(bin_)
        out[k] = bin_
    return out


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocab_path: str = VOCAB_PATH) -> DataFrame:
    """A row a piece: the id, ``piece_no``, ``start`` and ``n_tokens`` in tokens, and its ``container_id``."""
    kind = df.schema[id_col].dataType.simpleString()
    groups = max(1, -(-df.select(F.lit(1)).count() // GROUP_ROWS))
    sized = token_counts(df, id_col, text_col, vocab_path).where("n_tokens > 0")
    sized = sized.withColumn("order_", F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col("n_tokens"), F.col("row_"))).withColumn("group_", F.expr(f"cast(pmod(order_, {groups}) as int)"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order_", "n_tokens", id_col], kind="stable")
        n = rows.n_tokens.to_numpy()
        pieces = -(-n // capacity)
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(capacity, n[row] - piece * capacity)
        return pd.DataFrame({
            id_col: rows[id_col].to_numpy()[row], "piece_no": piece.astype("int32"), "start": piece * capacity, "n_tokens": size,
            "container_id": (np.int64(rows.group_.iloc[0]) << 32) + pack_sizes(size, capacity),
        })

    return sized.groupBy("group_").applyInPandas(run, f"`{id_col}` {kind}, piece_no int, start bigint, n_tokens bigint, container_id bigint")


def packing_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: documents' tokens, containers, and the share of space left empty (null without containers)."""
    return packed.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.countDistinct("container_id").alias("n_containers")).withColumn("unused_share", F.expr(f"1 - try_divide(n_tokens, n_containers * {capacity})"))


