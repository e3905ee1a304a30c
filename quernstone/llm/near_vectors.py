"""Embedding near-duplicates: sign hashing in several tables, exact cosine, distributed components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_MIX, U, gather, local_components, longs, materialize, mix64, ranges, ship, tidy
from .components import connected_components
from .seeds import group_starts, sizes_of

#: Vectors of a block when a bucket is compared.
BLOCK = 1024


def plan(n: int, cosine: float, miss: float) -> tuple[int, int]:
    """(bits, tables): buckets about as many as vectors, and tables so that a pair at ``cosine`` is missed with chance ``miss``."""
    bits = min(24, max(8, math.ceil(math.log2(max(n, 2)))))
    meet = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - meet)))


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row; those that may link with two hashes of the vector's bytes and the vector as little-endian doubles, others with nulls."""
    for batch in batches:
        lists = batch.column(2)
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        bad = flat.is_null().to_numpy(zero_copy_only=False)
        raw = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
        bad = bad | ~np.isfinite(raw)
        values = np.where(bad, 0.0, raw) + 0.0  # +0.0: one zero
        upto = np.concatenate([[0], np.cumsum(size)])
        wrong = np.concatenate([[0], np.cumsum(bad)])[upto]
        some = np.concatenate([[0], np.cumsum(values != 0)])[upto]
        ok = (np.diff(wrong) == 0) & (np.diff(some) > 0)
        ok &= ~(batch.column(0).is_null().to_numpy(zero_copy_only=False) | batch.column(1).is_null().to_numpy(zero_copy_only=False))
        place = ranges(np.zeros(len(size), np.int64), size).astype(np.uint64)
        one = mix64(values.view(np.uint64) + place * SHINGLE_MIX[3])
        other = mix64(one + SHINGLE_MIX[4])
        hashes = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])[upto] for x in (one, other)]
        offsets = np.concatenate([[0], np.cumsum(np.where(ok, size, 0))])
        keep = np.flatnonzero(ok)
        body = values[ranges(upto[keep], size[keep])]
        valid = pa.array(ok).buffers()[1]
        vec = pa.Array.from_buffers(pa.binary(), len(ok), [valid, pa.py_buffer((offsets * 8).astype(np.int32).tobytes()), pa.py_buffer(body.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, mask=~ok), *(pa.array(np.diff(h).view(np.int64), mask=~ok) for h in hashes), vec], ["id", "label", "dim", "h1", "h2", "vec"])


def near_vectors(vectors: DataFrame, cosine: float = 0.98, miss: float = 1e-5, seed: int = 11) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of (vec_id, embedding, label).

    Vectors of one label and dimension link at a cosine (in doubles) of
    ``cosine`` or more. Identical vectors of a label are compared as one and
    counted as many. Candidates share a bucket of a table of hyperplane signs;
    a pair exactly at the threshold is missed with a chance of at most ``miss``,
    closer pairs with less. Vectors that are null, zero or not finite, and rows
    with a null label or id, link with nothing; theirs is a component of one.
    Repeated rows of one id, label and vector count as one vector and come out
    alike; rows of one id and different vectors are different vectors, each
    with links of its own. An empty table gives no rows.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    with tidy() as keep:
        return _linked(rows, cosine, miss, seed, keep)


def _linked(rows: DataFrame, cosine: float, miss: float, seed: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    all_ = materialize(rows.mapInArrow(_usable, "id long, label string, dim long, h1 long, h2 long, vec binary"), "vectors")
    usable = all_.where("vec is not null")
    same = ["label", "dim", "h1", "h2"]
    # A class has a number of its own; its smallest id names it in the end.
    classes = usable.select("id", *same).distinct().groupBy(*same).agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-classes")
    bits, tables = plan(classes.count(), cosine, miss)

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = longs(batch, "dim")
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                if dim not in planes:
                    planes[dim] = np.random.default_rng([seed, dim]).normal(size=(dim, bits * tables))
                x = np.frombuffer(b"".join(part.column("vec").to_pylist()), np.float64).reshape(-1, dim)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                signs = (x @ planes[dim] > 0).reshape(len(x), tables, bits)
                code = (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int64)
                label = np.array([hash_label(v) for v in part.column("label").to_pylist()], np.uint64)
                key = mix64(label[:, None] + np.full(1, dim, np.uint64) * SHINGLE_MIX[5] + np.arange(tables, dtype=np.uint64) * SHINGLE_MIX[6] + code.astype(np.uint64) * SHINGLE_MIX[7]).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("rep"), pa.array(list(key), pa.list_(pa.int64()))], ["rep", "buckets"])

    reps = usable.join(classes.select("id", "rep", *same), ["id", *same]).dropDuplicates(["id", *same])
    coded = materialize(reps.mapInArrow(codes, "rep long, buckets array<long>"), "codes")
    flat = coded.select("rep", F.explode("buckets").alias("bucket"))
    shared = flat.groupBy("bucket").count().where("count > 1")
    blocks = F.ceil(F.col("count") / BLOCK).cast("long")
    met = flat.join(shared.select("bucket", blocks.alias("blocks")), "bucket")
    met = met.withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("bucket", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "mine", "rep")
    body = reps.select("rep", "vec").join(coded, "rep").join(classes.select("rep", "copies"), "rep")
    dealt = met.join(body, "rep").repartition("bucket", "x", "y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = gather(batches)
        if found is None:
            return
        bucket, x, y, mine, rep, copies = (longs(found, c) for c in ("bucket", "x", "y", "mine", "rep", "copies"))
        key = mix64(bucket.astype(np.uint64) + x.astype(np.uint64) * SHINGLE_MIX[1] + y.astype(np.uint64) * SHINGLE_MIX[2])
        order = np.argsort(key, kind="stable")
        starts = group_starts(key[order])
        vecs, all_codes = found["vec"].combine_chunks(), found["buckets"].combine_chunks()
        for s, m in zip(starts.tolist(), sizes_of(starts, len(order)).tolist(), strict=True):
            if m < 2:
                continue
            at = order[s : s + m]
            own = np.frombuffer(b"".join(vecs.take(pa.array(at)).to_pylist()), np.float64).reshape(m, -1)
            own = own / np.abs(own).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
            unit = own / np.linalg.norm(own, axis=1, keepdims=True)
            near = unit @ unit.T >= cosine
            lone = x[at[0]] != y[at[0]]
            if lone:  # two blocks: pairs within a block are compared by its own task
                near &= mine[at][:, None] != mine[at][None, :]
            i, j = np.nonzero(np.triu(near, 1))
            if not len(i):
                continue
            code = np.array(all_codes.take(pa.array(at)).to_pylist(), np.int64)
            table = int(np.flatnonzero(code[0] == bucket[at[0]])[0])
            first = np.ones(len(i), bool)  # a pair counts in the first table where it meets
            for t in range(table):
                first &= code[i, t] != code[j, t]
            i, j = i[first], j[first]
            if not len(i):
                continue
            links = np.bincount(i, copies[at[j]], m) + np.bincount(j, copies[at[i]], m)
            nodes, low = local_components(rep[at[i]], rep[at[j]])
            which = np.flatnonzero(links)
            root = dict(zip(nodes.tolist(), low.tolist(), strict=True))
            ids = rep[at[which]]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links[which].astype(np.int64)), pa.array([root[k] for k in ids.tolist()], pa.int64())], ["rep", "links", "root"])

    found = materialize(dealt.mapInArrow(compare, "rep long, links long, root long"), "vector-links")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    by_class = classes.join(counts, "rep", "left").join(joined, classes.rep == joined.node, "left")
    by_class = materialize(by_class.select("id", *same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")), "by-class")
    lowest = by_class.groupBy("component").agg(F.min("id").alias("component_id"))
    by_class = by_class.select(*same, "n_links", "component").join(lowest, "component")
    placed = keep(materialize(all_.select("id", *same).join(by_class, same, "left").select("id", "n_links", "component_id"), "placed"))
    component = F.coalesce("component_id", "id")
    return placed.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def hash_label(label: str) -> int:
    import hashlib

    return int.from_bytes(hashlib.blake2b(label.encode(), digest_size=8).digest(), "little")


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), low AS (
  SELECT x, min(y) AS y FROM reach GROUP BY x
), degree AS (
  SELECT x, count(*) AS n FROM links GROUP BY x
)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(low.y, e.vec_id))::BIGINT AS component_id,
       e.vec_id <= coalesce(low.y, e.vec_id) AS kept
FROM embeddings e LEFT JOIN low ON low.x = e.vec_id LEFT JOIN degree d ON d.x = e.vec_id
"""
