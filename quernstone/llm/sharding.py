"""Stable placement of keys on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = 65_537) -> np.ndarray:
    """The shard number of each slot.

    Every shard has a permutation of the slots, offset + j * skip modulo the
    prime ``size``; shards take turns, each claiming the first free slot of its
    own list. Slots differ by one at most between shards, and when a shard
    leaves, few slots of the others change hands.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct, one at least")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table's size must be a prime of at least the number of shards")
    names = [hashlib.sha256(s.encode()).digest() for s in shards]
    offset = [int.from_bytes(d[:8], "big") % size for d in names]
    skip = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 for d in names]
    table, nxt, filled = np.full(size, -1, np.int64), [0] * len(shards), 0
    while filled < size:
        for k in range(len(shards)):
            slot = (offset[k] + nxt[k] * skip[k]) % size
            while table[slot] >= 0:
                nxt[k] += 1
                slot = (offset[k] + nxt[k] * skip[k]) % size
            table[slot] = k
            nxt[k] += 1
            filled += 1
            if filled == size:
                break
    return table


def place(df: DataFrame, key: str, shards: list[str], size: int = 65_537) -> DataFrame:
    """Add ``slot`` (hash of the key modulo the prime) and ``shard`` (its name).

    The table has ``size`` rows whatever the data, so it is broadcast, and no row
    moves. Equal keys land together; null keys share one slot, that of the hash
    seed. Columns named slot or shard are replaced. An empty table gives none.
    """
    spark = df.sparkSession
    table = lookup_table(shards, size)
    rows = spark.createDataFrame([(i, shards[k]) for i, k in enumerate(table.tolist())], "slot long, shard string")
    base = df.drop("slot", "shard").withColumn("slot", F.expr(f"pmod(xxhash64(`{key}`), {size}L)"))
    return base.join(F.broadcast(rows), "slot", "left").select(*base.columns, "shard")
