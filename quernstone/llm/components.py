"""Distributed connected components: alternating large-star and small-star rounds.

Links stay in tables. Each partition first shrinks its own links to stars, so
that a node with very many links has one of them a partition at most. Rounds
join links with the smallest neighbour of each node, which Spark sums before the
shuffle; the join itself sends a node's links to one partition, which adaptive
execution splits where it is skewed (spark.sql.adaptive.skewJoin).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, gather, local_components, longs, materialize, ship


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = gather(batches)
    if found is None:
        return
    nodes, low = local_components(longs(found, "u"), longs(found, "v"))
    far = nodes != low
    yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(low[far])], ["u", "v"])


def _small(links: DataFrame) -> DataFrame:
    """Link each lower neighbour of a node, and the node, to the lowest of them."""
    low = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return low.select("u", F.col("m").alias("v")).union(moved).distinct()


def _large(links: DataFrame) -> DataFrame:
    """Link each higher neighbour of a node to the lowest of the node and its neighbours."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``links`` (u, v); component is the smallest node reachable.

    Links may repeat, in either direction, and may be loops. Empty links give no
    rows. Rounds go on until no link changes: about log of the longest path.
    """
    ship(links.sparkSession)
    links = links.select("u", "v").where("u <> v")
    now = materialize(links.mapInArrow(_stars, "u long, v long").distinct(), "links")
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = digest(now)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        after = materialize(_small(_large(now)), "links")
        new = digest(after)
        discard(now)
        now = after
        if new == seen:
            break
        seen = new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
