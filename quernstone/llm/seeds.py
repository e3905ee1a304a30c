"""Winnowed anchors: what exact-substring operators seed their matches with.

Every window of ``span`` items has one anchor, the smallest of the hashed k-grams
inside it, leftmost on ties. Equal windows choose equal anchors at equal places,
so a repeated window shows in a repeated anchor, and all windows of one content
meet in the task of their anchor.

Rows of a table are known by ``row``, a hash of id and text: repeated ids and null
ids are rows like others, and results find their way back by row and id together.
Rows that are alike in both are one place.

What may match others travels by a ``route``. An anchor that is frequent within a
task is *hot*: its further places in the task are settled there and spread, so
that no route has more than LOCAL rows a task. Hot anchors are marked as such, for
operators that split them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, gather, longs, mix64, ranges

#: Items that a task holds before it combines and sends them on.
HELD = 4_000_000
#: An anchor is hot if a task has it more often than LOCAL, or all tasks together more often than HOT.
LOCAL, HOT = 64, 1 << 16


def sliding_min(key: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each ``w`` consecutive keys."""
    if len(key) < w:
        return key[:0]
    p = 1
    while 2 * p <= w:
        key = np.minimum(key[:-p], key[p:])
        p *= 2
    return np.minimum(key[: len(key) - (w - p)], key[w - p :]) if p < w else key


def anchors(grams: np.ndarray, firsts: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, first window, windows) for each anchor, all as item numbers.

    ``grams`` are k-gram hashes at each item of all rows together, ``firsts`` the
    first item of each row and the total. Windows never cross rows.
    """
    windows = np.maximum(np.diff(firsts) - span + 1, 0)
    starts = ranges(firsts[:-1], windows)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 4
    key = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(key, span - k + 1)[starts] & U(0xFFFFFFFF)).astype(np.int64)
    fresh = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    count = np.diff(np.append(fresh, len(at)))
    first = starts[fresh]
    return np.searchsorted(firsts, first, "right") - 1, at[fresh], first, count


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def sizes_of(starts: np.ndarray, total: int) -> np.ndarray:
    return np.diff(np.append(starts, total))


def place_route(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix64(doc.astype(np.uint64) * U(0x9E3779B97F4A7C15) + at.astype(np.uint64)).view(np.int64)


def runs(doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive starts of one document as (doc, start, n); input in any order, repeats allowed."""
    if not len(doc):
        return doc, start, start
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    keep = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])])
    doc, start = doc[keep], start[keep]
    fresh = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)]))
    return doc[fresh], start[fresh], sizes_of(fresh, len(doc))


#: Finds, in one slice of rows, (row, anchor hash, anchor's place within its row).
Finder = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def keyed(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(row, doc_id, text[, carried]): the rows dealt by ``row``; ``carry`` names columns that travel along as one."""
    carried = [F.struct(*(F.col(c) for c in carry)).alias("carried")] if carry else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *carried)
    return rows.select(F.xxhash64("doc_id", "text").alias("row"), *rows.columns).repartition("row")


def repeated_anchors(dealt: DataFrame, find: Finder, limit: int) -> DataFrame:
    """(row, places): the anchors of each row that occur more than once anywhere, as 2 * place, plus 1 if hot.

    ``dealt`` is from ``keyed``; ``limit`` is the slice size in bytes.
    """
    from .common import slices, text_bytes

    def emit(held: list) -> pa.RecordBatch:
        h, key, at = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(h)
        starts = group_starts(h[order])
        n = sizes_of(starts, len(h))
        crowd = np.repeat(n, n)
        few, hot = order[crowd <= LOCAL], order[crowd > LOCAL]
        mark = order[starts[n > LOCAL]]  # one row stands for all of the task's
        route = np.concatenate([h[few].view(np.int64), h[mark].view(np.int64), place_route(key[hot], at[hot])])
        rows = np.concatenate([few, mark, hot])
        many = np.concatenate([np.ones(len(few)), n[n > LOCAL], np.zeros(len(hot))]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(route), pa.array(key[rows]), pa.array(at[rows].astype(np.int32)), pa.array(many)], ["route", "row", "at", "many"])

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            keys = longs(batch, "row")
            data, offsets = text_bytes(batch.column(2))
            for a, b in slices(offsets, limit):
                row, h, at = find(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if len(row):
                    held.append((h, keys[a + row], at))
                    n += len(row)
                if n >= HELD:
                    yield emit(held)
                    held, n = [], 0
        if held:
            yield emit(held)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = gather(batches)
        if found is None:
            return
        key, at, many = (longs(found, c) for c in ("row", "at", "many"))
        known, open_ = np.flatnonzero(many == 0), np.flatnonzero(many > 0)
        route = longs(found, "route")[open_]
        order = np.argsort(route)
        starts = group_starts(route[order])
        n = sizes_of(starts, len(order))
        open_ = open_[order]
        total = np.add.reduceat(many[open_], starts) if len(open_) else n
        most = np.maximum.reduceat(many[open_], starts) if len(open_) else n
        hot = np.repeat((most > 1) | (total > HOT), n)
        keep = np.repeat(total > 1, n) & (many[open_] == 1)
        rows = np.concatenate([known, open_[keep]])
        place = 2 * at[rows] + np.concatenate([np.ones(len(known), np.int64), hot[keep].astype(np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(place)], ["row", "place"])

    sent = dealt.mapInArrow(seed, "route long, row long, at int, many int")
    return sent.repartition("route").mapInArrow(match, "row long, place long").groupBy("row").agg(F.collect_set("place").alias("places"))


def marked(places: np.ndarray, upto: np.ndarray, firsts: np.ndarray, a: int, b: int) -> np.ndarray:
    """1 at each repeated anchor of rows a..b-1, 2 at hot ones; ``places`` and ``upto`` as from ``list_column``."""
    seed = np.zeros(int(firsts[-1]) + 1, np.int8)
    own = places[upto[a] : upto[b]]
    seed[np.minimum((own >> 1) + np.repeat(firsts[:-1], np.diff(upto[a : b + 1])), len(seed) - 1)] = 1 + (own & 1)
    return seed


def nullable(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, null or not) of an integer column; a null's value is 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False), column.is_null().to_numpy(zero_copy_only=False)


def place_runs(key: np.ndarray, doc: np.ndarray, nul: np.ndarray, start: np.ndarray, rows: np.ndarray, starts: np.ndarray, lengths: np.ndarray | None = None):
    """Runs (row, doc_id, start, n) of the window starts ``starts`` (``lengths`` of them each) that items ``rows`` have."""
    if lengths is not None:
        rows, starts = np.repeat(rows, lengths), ranges(starts, lengths)
    order = np.lexsort((doc, nul, key))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (key[order][1:] != key[order][:-1]) | (doc[order][1:] != doc[order][:-1]) | (nul[order][1:] != nul[order][:-1])
    whose = np.zeros(len(order), np.int64)
    whose[order] = np.cumsum(fresh) - 1
    one = order[fresh]
    owner, first, n = runs(whose[rows], starts)
    owner = one[owner]
    return key[owner], pa.array(doc[owner], mask=nul[owner]), first, n


def list_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column of integers; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])


def gathered(gone: DataFrame) -> DataFrame:
    """(row, spans) of runs (row, doc_id, start, n)."""
    return gone.groupBy("row").agg(F.collect_set(F.struct("doc_id", "start", "n")).alias("spans")).hint("shuffle_hash")


def own_spans(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the batch, start, n) of the window runs listed for each row, those of other ids left out."""
    column = batch.column("spans")
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    if not len(flat):
        return (np.zeros(0, np.int64),) * 3
    row = np.repeat(np.arange(batch.num_rows), lengths)
    doc, nul = nullable(batch.column("doc_id"))
    told, none = nullable(flat.field("doc_id"))
    mine = (told == doc[row]) & (none == nul[row])
    start, n = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n"))
    order = np.flatnonzero(mine)
    order = order[np.lexsort((start[order], row[order]))]
    return row[order], start[order], n[order]


def covered(spans: tuple[np.ndarray, np.ndarray, np.ndarray], firsts: np.ndarray, width: int, a: int, b: int) -> np.ndarray:
    """Marks the items that rows a..b-1 lose; spans as from ``own_spans``, ``firsts`` as in ``anchors``. No span leaves its row."""
    row, start, n = spans
    lo, hi = np.searchsorted(row, [a, b])
    here, start, n = row[lo:hi] - a, start[lo:hi], n[lo:hi]
    mark = np.zeros(int(firsts[-1]) + 1, np.int64)
    end = firsts[here + 1]
    np.add.at(mark, np.minimum(start + firsts[here], end), 1)
    np.add.at(mark, np.minimum(start + n + width - 1 + firsts[here], end), -1)
    return np.cumsum(mark[:-1]) > 0


def span_column(spans: tuple[np.ndarray, np.ndarray, np.ndarray], a: int, b: int) -> pa.Array:
    """The spans of rows a..b-1 as lists of (start, n)."""
    row, start, n = spans
    cuts = np.searchsorted(row, np.arange(a, b + 1))
    body = pa.StructArray.from_arrays([pa.array(start[cuts[0] : cuts[-1]]), pa.array(n[cuts[0] : cuts[-1]])], ["start", "n"])
    return pa.ListArray.from_arrays(pa.array((cuts - cuts[0]).astype(np.int32)), body)
