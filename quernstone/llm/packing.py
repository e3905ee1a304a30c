"""Best-fit decreasing packing of token pieces into windows of a fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import longs, materialize, ship
from .tokens import token_pieces


class OpenWindows:
    """A segment tree over remaining capacities 0..size; a node counts the open windows below it."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def put(self, left: int, window: int) -> None:
        self.open[left].append(window)
        at = left + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (remaining, window) of the tightest window with room for ``need``."""
        count, at = self.count, need + self.leaves
        while not count[at]:  # climb to the first subtree on the right that holds a window
            while at & 1:
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        left = at - self.leaves
        while at:
            count[at] -= 1
            at >>= 1
        return left, self.open[left].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each piece; pieces are placed longest first, ties in the given order."""
    place, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    tree, used = OpenWindows(window), 0
    order = np.argsort(-lengths, kind="stable")
    for i, need in zip(order.tolist(), lengths[order].tolist(), strict=True):
        found = tree.take(need) if need < window else None
        if found is None:
            left, at = window, used
            used += 1
        else:
            left, at = found
        place[i], offset[i] = at, window - left
        if left > need:
            tree.put(left - need, at)
    return place, offset


def pack(docs: DataFrame, model: str, ranks: str, window: int = 1024, end_id: int = 0, group_pieces: int = 16_384, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pack every document into sequences of at most ``window`` tokens.

    Returns per piece: id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. Overlong documents are first cut into full windows; what remains is
    placed best-fit decreasing. Pieces are dealt by hash into groups of about
    ``group_pieces``, each packed on its own: more data means more groups of the
    same size, at a cost of a few open windows each. Sequence ids hold the group
    in their upper half. Null texts are one piece with the end id; rows with a
    null id or repeated rows are packed like others; an empty table gives none.
    Texts of any length are encoded whole.
    """
    spark = docs.sparkSession
    ship(spark)
    pieces = materialize(token_pieces(docs, model, ranks, window, end_id, id_column, text_column), "pieces")
    groups = -(-pieces.count() // group_pieces) or 1
    kind = pieces.schema[id_column].dataType.simpleString()
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).sort_by([("id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        place, offset = best_fit_decreasing(longs(table, "length"), window)
        table = table.append_column("sequence_id", pa.array((longs(table, "group") << 32) + place)).append_column("offset", pa.array(offset))
        yield from table.select(names).to_batches()

    dealt = pieces.withColumnRenamed(id_column, "id").withColumn("group", F.expr(f"pmod(xxhash64(id, start, ids_crc32), {groups}L)"))
    packed = dealt.groupBy("group").applyInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return packed.withColumnRenamed("id", id_column)
