"""What the operators of this subpackage share: worker imports, shared folders, byte-level hashing.

Arrays are numpy and cover one Arrow batch or one shuffle partition at a time,
so memory is bounded by ``spark.sql.execution.arrow.maxBytesPerBatch`` or by the
partition size, never by the table.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import shared_dir, ship  # noqa: F401

U = np.uint64
_rng = np.random.default_rng(20_240_117)
#: Random odd multipliers: by byte value and by position within a word.
BYTE_MIX = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
PLACE_MIX = _rng.integers(1, 2**63, 4096, dtype=np.uint64) * U(2) + U(1)
SHINGLE_MIX = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class _Open(threading.local):
    """Tables written in the blocks of ``tidy`` that are open in this thread."""

    def __init__(self):
        self.blocks: list[list[tuple[DataFrame, str]]] = []


_OPEN = _Open()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}.parquet"
    if _OPEN.blocks:
        _OPEN.blocks[-1].append((df, path))  # so that a write that fails is cleared, too
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._folder = path
    if _OPEN.blocks:
        _OPEN.blocks[-1][-1] = found, path
    return found


@contextmanager
def tidy() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose materialized tables are deleted at its end, but for those that the function it gives is called on."""
    kept: set[int] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(id(df))
        return df

    _OPEN.blocks.append([])
    try:
        yield keep
    finally:
        block = _OPEN.blocks.pop()
        for df, path in block:
            if id(df) not in kept:
                delete(df.sparkSession, path)
        if _OPEN.blocks:
            _OPEN.blocks[-1].extend(x for x in block if id(x[0]) in kept)


@contextmanager
def shuffles_cleared(spark: SparkSession) -> Iterator[None]:
    """A block in which a query's shuffle files go as soon as it has ended: its steps are written, and nothing is shuffled again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Delete the files of a frame from ``materialize`` that nothing reads any more."""
    delete(df.sparkSession, df._folder)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(buffers[1], kind, len(column) + 1, column.offset * np.dtype(kind).itemsize) if len(column) else np.zeros(1, kind)
    offsets = offsets.astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(buffers[2], np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return data, offsets - first


def slices(offsets: np.ndarray, limit: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, one row at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = b


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: (starts, ends, first word of each row and the total)."""
    solid = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    before[edge[:-1]] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[edge[1:]] = False
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``lower`` takes A-Z as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    table = BYTE_MIX[LOWER] if lower else BYTE_MIX.copy()
    table[IS_SPACE] = 0
    part = data[starts[0] :]
    begin = starts - starts[0]
    place = np.arange(len(part), dtype=np.int64) - np.repeat(begin, np.diff(np.append(begin, len(part))))
    block = place >> 12
    value = table[part] * PLACE_MIX[place & 4095]
    if block.any():
        value *= (block.astype(np.uint64) << U(1)) + U(1)
    return mix64(np.add.reduceat(value, begin) + (ends - starts).astype(np.uint64) * SHINGLE_MIX[63])


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive values of ``h``, by doubling; rows must be cut by the caller."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, have, power, span, step = None, 0, h, 1, 0
    while True:
        if k & span:
            if out is None:
                out, have = power, span
            else:
                n = len(power) - have
                out = mix64(out[: len(h) - have - span + 1] * SHINGLE_MIX[step] + power[have : have + len(h) - have - span + 1])
                have += span
        if have == k:
            return out[: len(h) - k + 1]
        power = mix64(power[: len(power) - span] * SHINGLE_MIX[32 + step] + power[span:])
        span, step = span * 2, step + 1


def row_of(firsts: np.ndarray) -> np.ndarray:
    """Row number of each item, from the first item of each row and the total."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges start .. start+length-1, one after another."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = lengths > 0
    starts, lengths = np.asarray(starts, np.int64)[keep], lengths[keep]
    step = np.ones(total, np.int64)
    at = np.cumsum(lengths)[:-1]
    step[0] = starts[0]
    step[at] = starts[1:] - starts[:-1] - lengths[:-1] + 1
    return np.cumsum(step)


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest reachable node) over the links a[i]-b[i]."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            next_ = new[new]
            if np.array_equal(next_, new):
                break
            new = next_
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def binary_column(values: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """A binary column: row i holds the raw little-endian items firsts[i]..firsts[i+1]-1."""
    raw = np.ascontiguousarray(values)
    offsets = (np.asarray(firsts, np.int64) * raw.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(firsts) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


def from_binary(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of ``binary_column``; null counts as no items."""
    data, offsets = text_bytes(column.fill_null(b"") if column.null_count else column)
    return np.frombuffer(data.tobytes(), kind), offsets // np.dtype(kind).itemsize


def gather(batches: Iterable[pa.RecordBatch]) -> pa.Table | None:
    """All batches of one shuffle partition, whose size the shuffle settings bound."""
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found).combine_chunks() if found else None


def longs(table: pa.Table | pa.RecordBatch, name: str) -> np.ndarray:
    """An integer column as int64."""
    column = table[name]
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
