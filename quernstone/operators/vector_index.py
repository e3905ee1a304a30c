"""An inverted-file index of vectors: coarse cells, product codes of what is left, exact scores at the end.

Vectors are scaled to unit length and go to the cell of their nearest centroid; the
table of rows is partitioned by cell, so that a search reads the cells it probes
and no others. Beside each vector stands a code of its difference from the
centroid, a byte a part. A search compares codes first, then the vectors of the
best candidates. ``exact`` adds a second pass over just those cells that could
still hold something better; its hits are those of ``dense_search``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import ship
from .retrieve import top_k

#: Numbers that a block of vectors or codes may hold, and the most numbers that all centroids together may: both travel to tasks.
BLOCK, CENTROIDS = 1 << 19, 1 << 22
#: Bins that cells are dealt into, and the rows that a bin may hold at most; a query travels once to each bin that it probes, so their number does not grow with the table until bins are full.
BINS, ROWS = 64, 1 << 18
#: The cell of vectors of length zero, whose cosine is 0 with everything.
ZERO = -1


def unit_rows(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are whole vectors of ``dim`` numbers, those as unit vectors in doubles); zero vectors stay zero."""
    length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(length == dim)
    x = lists.take(pa.array(rows)).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    fine = np.isfinite(x).all(axis=1)
    x = x[fine]
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return rows[fine], x / np.where(norm == 0, 1, norm)


def lloyd(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, sphere: bool = False) -> np.ndarray:
    """``k`` centres of the rows of ``x``, or as many as there are different rows; on the unit sphere if asked for."""
    once = np.unique(x, axis=0)
    centre = once[rng.permutation(len(once))[:k]].copy()
    for _ in range(rounds if len(once) > k else 0):
        own = nearest(x, centre)
        order = np.argsort(own, kind="stable")
        starts = np.searchsorted(own[order], np.arange(len(centre)))
        n = np.diff(np.append(starts, len(x)))
        used = np.flatnonzero(n)
        mean = np.add.reduceat(x[order], starts[used], axis=0) / n[used, None]
        if sphere:
            norm = np.linalg.norm(mean, axis=1, keepdims=True)
            mean = np.where(norm > 0, mean / np.where(norm == 0, 1, norm), centre[used])
        centre[used] = mean
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Of each row the nearest centre, the first on ties."""
    out, square = np.zeros(len(x), np.int64), (centre * centre).sum(1)
    for i in range(0, len(x), 8192):
        out[i : i + 8192] = (square[None, :] - 2 * (x[i : i + 8192] @ centre.T)).argmin(1)
    return out


@dataclass(frozen=True)
class Quantizer:
    """centroids (cells, dim) and codebooks (parts, entries, dim / parts); probes and refine are what a search needs for the recall it was fitted for."""

    centroids: np.ndarray
    codebooks: np.ndarray
    probes: int = 1
    refine: int = 4

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code) of unit vectors."""
        cell = nearest(x, self.centroids)
        rest = (x - self.centroids[cell]).reshape(len(x), len(self.codebooks), -1)
        code = np.stack([nearest(rest[:, p], book) for p, book in enumerate(self.codebooks)], axis=1).astype(np.uint8)
        return np.where(x.any(1), cell, ZERO), code

    def decode(self, cell: int, code: np.ndarray) -> np.ndarray:
        """The vectors that codes of one cell stand for."""
        if cell == ZERO:
            return np.zeros((len(code), self.dim))
        return self.centroids[cell] + np.concatenate([book[code[:, p]] for p, book in enumerate(self.codebooks)], axis=1)


def calibrated(q: Quantizer, x: np.ndarray, recall: float, k: int = 10, most: int = 512) -> Quantizer:
    """``q`` with the probes and the refinement by which ``most`` sampled vectors find that share of their k nearest among the sample.

    Both may lose: cells that are not probed, and codes that rank a row too
    low. Each is given half of what may be missed. In a larger table neighbours are nearer, so it finds more.
    """
    asked, k = x[:: max(1, len(x) // most)], min(k, len(x))
    cell, code = q.encode(x)
    near = np.argsort(-(asked @ x.T), axis=1, kind="stable")[:, :k]
    order = np.argsort(-(asked @ q.centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    share = 1 - (1 - recall) / 2
    probes = 1 + int(np.quantile(np.take_along_axis(place, np.maximum(cell, 0)[near], axis=1), share, method="higher"))
    seen = np.concatenate([q.decode(c, code[cell == c]) for c in np.unique(cell)])
    back = np.argsort(np.concatenate([np.flatnonzero(cell == c) for c in np.unique(cell)]))
    about = asked @ seen[back].T
    behind = (about[:, None, :] > np.take_along_axis(about, near, axis=1)[:, :, None]).sum(2) if len(x) <= 4096 else np.stack([(row[None, :] > row[n][:, None]).sum(1) for row, n in zip(about, near, strict=True)])
    refine = max(1, math.ceil((1 + int(np.quantile(behind, share, method="higher"))) / k))
    return Quantizer(q.centroids, q.codebooks, min(probes, len(q.centroids)), refine)


def fit(vectors: DataFrame, cells: int | None = None, parts: int = 16, entries: int = 256, sample: int = 65_536, rounds: int = 8, seed: int = 3, recall: float = 0.95) -> Quantizer:
    """Centroids and codebooks of (id, embedding), from about ``sample`` rows chosen by a hash of their ids.

    The sample is the one bound here; every row is indexed. ``cells`` is the
    square root of the number of rows unless given. The length of vectors is that of most sampled rows.
    How many cells a search probes follows from the sample too, see
    ``calibrated``: few where vectors lie in clusters, most where they don't.
    """
    n = vectors.count()
    share = min(1.0, sample / max(n, 1))
    chosen = vectors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < math.ceil(share * (1 << 30))).select(F.col("embedding").cast("array<double>"))
    lists = chosen.limit(2 * sample).toArrow()["embedding"].combine_chunks()  # about ``sample`` rows, twice as many at most
    length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    length = length[length > 0]
    if not len(length):
        return Quantizer(np.zeros((1, 1)), np.zeros((1, 1, 1)))
    dim = int(np.bincount(length).argmax())
    x = unit_rows(lists, dim)[1]
    x = x[x.any(1)]
    if not len(x):
        return Quantizer(np.zeros((1, dim)), np.zeros((1, 1, dim)))
    parts = max(p for p in range(1, parts + 1) if dim % p == 0)
    cells = max(1, min(cells or round(math.sqrt(n)), CENTROIDS // dim))
    rng = np.random.default_rng(seed)
    centroids = lloyd(x, cells, rounds, rng, sphere=True)
    rest = (x - centroids[nearest(x, centroids)]).reshape(len(x), parts, -1)
    books = [lloyd(rest[:, p], min(entries, 256), rounds, rng) for p in range(parts)]
    width = max(map(len, books))
    return calibrated(Quantizer(centroids, np.stack([np.concatenate([b, np.repeat(b[:1], width - len(b), axis=0)]) for b in books])), x, recall)


@dataclass
class VectorIndex:
    """A saved index: ``path``/rows by cell (id, embedding, code), ``path``/cells (cell, n, least cosine to its centroid), ``path``/quantizer."""

    spark: SparkSession
    path: str
    quantizer: Quantizer
    low: np.ndarray
    schema: StructType
    sizes: np.ndarray  # rows of each cell, the zero vectors' last

    def __getstate__(self) -> dict:
        return self.__dict__ | {"spark": None}  # the session stays on the driver

    @staticmethod
    def build(vectors: DataFrame, path: str, quantizer: Quantizer | None = None, **options) -> VectorIndex:
        """Index every row of (id, embedding) and save it; ``options`` are those of ``fit``.

        Null vectors, those with null or non-finite numbers and those of another
        length than the quantizer's match nothing and are left out. Zero vectors
        have a cell of their own. Hot cells are split over files.
        """
        spark = vectors.sparkSession
        ship(spark)
        q = quantizer or fit(vectors, **options)
        told = spark.sparkContext.broadcast(q)  # CENTROIDS numbers at most, and 256 entries a part
        kind = vectors.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, x = unit_rows(batch.column(1), told.value.dim)
                cell, code = told.value.encode(x)
                cosine = np.where(cell == ZERO, 0.0, (x * told.value.centroids[np.maximum(cell, 0)]).sum(1))
                codes = pa.array([c.tobytes() for c in code], pa.binary())
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), codes, pa.array(cosine), pa.array(cell.astype(np.int32))], ["id", "embedding", "code", "cosine", "cell"])

        rows = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, f"id {kind}, embedding array<double>, code binary, cosine double, cell int")
        rows.limit(0).write.mode("overwrite").parquet(f"{path}/schema")  # of an index without rows, too
        rows.repartitionByRange("cell", F.xxhash64("id")).write.partitionBy("cell").mode("overwrite").parquet(f"{path}/rows")
        table = spark.read.schema(rows.schema).parquet(f"{path}/rows")
        table.groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("low")).write.mode("overwrite").parquet(f"{path}/cells")
        books = q.codebooks.reshape(len(q.codebooks), -1)
        saved = [("centroids", i, c.tolist()) for i, c in enumerate(q.centroids)] + [("codebooks", i, b.tolist()) for i, b in enumerate(books)] + [("plan", 0, [float(q.probes), float(q.refine)])]
        spark.createDataFrame(saved, "part string, at int, numbers array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/quantizer")
        return VectorIndex.load(spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        saved = spark.read.parquet(f"{path}/quantizer").orderBy("part", "at").collect()  # as large as the quantizer
        centroids = np.array([r["numbers"] for r in saved if r["part"] == "centroids"])
        books = np.array([r["numbers"] for r in saved if r["part"] == "codebooks"])
        width = centroids.shape[1] // len(books)
        low = np.full(len(centroids) + 1, np.inf)  # the last is the zero vectors'; a cell without rows needs no reading
        sizes = np.zeros(len(low), np.int64)
        for r in spark.read.parquet(f"{path}/cells").collect():  # one row a cell
            low[r["cell"]], sizes[r["cell"]] = r["low"], r["n"]
        probes, refine = next(r["numbers"] for r in saved if r["part"] == "plan")
        schema = spark.read.parquet(f"{path}/schema").schema
        return VectorIndex(spark, path, Quantizer(centroids, books.reshape(len(books), -1, width), int(probes), int(refine)), low, schema, sizes)

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The rows of some cells; no file of another cell is read."""
        table = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        return table if cells is None else table.where(F.col("cell").isin(cells))

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, refine: int | None = None, exact: bool = False) -> DataFrame:
        """The k best rows by cosine of each of (query_id, embedding): query_id, id, score, rank.

        Codes of the ``probes`` nearest cells give ``refine`` * k candidates,
        whose cosines are computed in doubles; both are the quantizer's unless given.
        With ``exact``, cells whose bound reaches the k-th cosine so far are
        compared in full as well, so that nothing is missed. Queries that are
        null, not finite or of another length find nothing.
        """
        q = self.quantizer
        ship(self.spark)
        probes, refine = probes or q.probes, refine or q.refine
        asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"), F.lit(-2.0).alias("least"))
        near = self._near(probes)

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, probed, _ in self._probed(batch, near):
                    found = np.flatnonzero(probed.any(0))
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(found == len(q.centroids), ZERO, found).astype(np.int32))], ["cell"])

        wanted = [r["cell"] for r in asked.mapInArrow(cells, "cell int").distinct().collect()]  # as many as there are cells at most
        found = self._best(asked, near, self.rows(wanted), k, k * refine)
        if not exact:
            return found
        least = found.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).otherwise(-2.0).alias("least"))
        open_ = asked.drop("least").join(least, "query_id", "left").select("query_id", "embedding", F.coalesce("least", F.lit(-2.0)).alias("least"))
        return self._best(open_, self._may, self.rows(), k)

    def _near(self, probes: int):
        """Of unit vectors, which cells are among the ``probes`` nearest that have rows; the zero vectors' is probed always."""
        centroids, low = self.quantizer.centroids, self.low

        def near(x: np.ndarray, least: np.ndarray) -> np.ndarray:
            some = np.flatnonzero(np.isfinite(low[:-1]))
            probed = np.zeros((len(x), len(low)), bool)
            np.put_along_axis(probed, some[np.argsort(-(x @ centroids[some].T), axis=1, kind="stable")[:, :probes]], True, axis=1)
            probed[:, -1] = np.isfinite(low[-1])
            return probed

        return near

    def _may(self, x: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Cells in which some vector may score ``least`` or more: by the angles of query and farthest row to the centroid."""
        low = self.low
        to = np.arccos(np.clip(x @ self.quantizer.centroids.T, -1, 1)) - np.arccos(np.clip(low[:-1], -1, 1))[None, :]
        bound = np.where(np.isfinite(low[:-1])[None, :], np.cos(np.maximum(to, 0)), -np.inf)
        bound = np.column_stack([bound, np.full(len(x), 0.0 if np.isfinite(low[-1]) else -np.inf)])
        bound[~x.any(1)] = np.where(np.isfinite(low), 0.0, -np.inf)  # a zero query scores 0 everywhere
        return bound >= least[:, None] - 1e-7

    def _probed(self, batch: pa.RecordBatch, which) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of (query_id, embedding, least), some at a time: row numbers, unit vectors, the cells each probes, and ``least``."""
        at, x = unit_rows(batch.column(1), self.quantizer.dim)
        least = batch.column(2).to_numpy(zero_copy_only=False)[at]
        step = max(1, min(BLOCK // self.quantizer.dim, 8 * BLOCK // len(self.low)))
        for i in range(0, len(at), step):
            yield at[i : i + step], x[i : i + step], which(x[i : i + step], least[i : i + step]), least[i : i + step]

    def _nearest_cells(self, probes: int):
        """(query_id, cell, unit): a row for each cell that a query probes."""
        near = self._near(probes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, x = unit_rows(batch.column(1), self.quantizer.dim)
                row, cell = np.nonzero(near(x, np.full(len(x), -2.0)))
                yield _probes(batch.column(0), at, x, row, np.where(cell == len(self.low) - 1, ZERO, cell))

        return run

    def _bins(self) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
        """(rows before each cell, number of bins, first and last bin of each cell): cells in order, cut where a bin has its share, so that a hot cell is split."""
        ends = np.cumsum(self.sizes)
        total = max(int(ends[-1]), 1)
        bins = max(min(BINS, -(-total // 1024)), -(-total // ROWS))
        return ends - self.sizes, bins, (ends - self.sizes) * bins // total, (ends - 1) * bins // total

    def _best(self, asked: DataFrame, which, rows: DataFrame, k: int, keep: int | None = None) -> DataFrame:
        """The k best rows of the cells that queries probe: by all vectors, or by those of the ``keep`` best codes of each bin.

        Rows lie in bins of neighbouring cells. A query goes once to each bin that
        it probes, with the cells it probes there. A task reads the rows of a bin
        and then its queries, block by block, and gives k rows a query.
        """
        q, total = self.quantizer, max(int(self.sizes.sum()), 1)
        start, bins, first, last = self._bins()
        kind, id_kind = asked.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()

        def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = batch.column(3).to_numpy(zero_copy_only=False)
                own = (start[cell] + batch.column(4).to_numpy(zero_copy_only=False) % np.maximum(self.sizes[cell], 1)) * bins // total
                for b in np.unique(own).tolist():
                    at = np.flatnonzero(own == b)
                    for part in np.array_split(at, -(-len(at) * q.dim // BLOCK)):
                        some = pa.array(part)
                        body = [cell[part].astype(np.int32).tobytes(), b"".join(batch.column(2).take(some).to_pylist()), unit_rows(batch.column(1).take(some), q.dim)[1].tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), _listed(batch.column(0).take(some)), *(pa.array([x], pa.binary()) for x in body)], ["bin", "ids", "cells", "codes", "body"])

        def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, x, probed, least in self._probed(batch, which):
                    for b in range(bins):
                        there = probed[:, (first <= b) & (b <= last) & (self.sizes > 0)]
                        own = np.flatnonzero(there.any(1))
                        if len(own):
                            body = [np.packbits(there[own], axis=1).tobytes(), least[own].tobytes(), x[own].tobytes()]
                            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), _listed(batch.column(0).take(pa.array(at[own]))), *(pa.array([x], pa.binary()) for x in body)], ["bin", "qids", "cells", "least", "body"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bin_, blocks, held = None, [], None
            for batch in batches:
                for i in range(batch.num_rows):
                    b, ids, qids, cells, codes, least, body = (batch.column(c)[i] for c in (0, 2, 3, 4, 5, 6, 7))
                    if b.as_py() != bin_:
                        bin_, blocks, held = b.as_py(), [], None
                    if ids.is_valid:
                        width = len(q.codebooks)
                        blocks.append((ids.values, *(np.frombuffer(x.as_buffer(), t).reshape(shape) for x, t, shape in ((cells, np.int32, -1), (codes, np.uint8, (-1, width)), (body, np.float64, (-1, q.dim))))))
                    elif blocks:
                        held = held or _Bin(q, np.flatnonzero((first <= bin_) & (bin_ <= last) & (self.sizes > 0)), blocks, keep)
                        n = len(qids.values)
                        probed = np.unpackbits(np.frombuffer(cells.as_buffer(), np.uint8).reshape(n, -1), axis=1)[:, : len(held.cells)].astype(bool)
                        one, row, score = held.best(np.frombuffer(body.as_buffer(), np.float64).reshape(n, q.dim), probed, k)
                        fine = score >= np.frombuffer(least.as_buffer(), np.float64)[one] - 1e-7
                        yield pa.RecordBatch.from_arrays([qids.values.take(pa.array(one[fine])), held.ids.take(pa.array(row[fine])), pa.array(score[fine])], ["query_id", "id", "score"])

        told = rows.select("id", "embedding", "code", "cell", F.xxhash64("id").alias("h")).mapInArrow(wide, f"bin int, ids array<{id_kind}>, cells binary, codes binary, body binary")
        met = told.unionByName(asked.mapInArrow(few, f"bin int, qids array<{kind}>, cells binary, least binary, body binary"), allowMissingColumns=True)
        met = met.select("bin", F.col("ids").isNull().alias("side"), "ids", "qids", "cells", "codes", "least", "body")
        met = met.repartition(2 * bins, "bin").sortWithinPartitions("bin", "side")
        return top_k(met.mapInArrow(run, f"query_id {kind}, id {id_kind}, score double"), k)


class _Bin:
    """The rows of a bin, by cell and id, beside what their codes stand for."""

    def __init__(self, q: Quantizer, cells: np.ndarray, blocks: list, keep: int | None):
        ids, cell, code, x = zip(*blocks, strict=True)
        ids, cell = pa.concat_arrays(ids), np.concatenate(cell)
        cell = np.where(cell == ZERO, len(q.centroids), cell)
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(pa.table({"id": ids}), sort_keys=[("id", "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(ids))
        order = np.lexsort((rank, cell))
        self.ids, self.rank, self.x, self.cells, self.keep = ids.take(pa.array(order)), rank[order], np.concatenate(x)[order], cells, keep
        ends = np.searchsorted(cell[order], cells, "right")
        self.spans = list(zip(np.searchsorted(cell[order], cells).tolist(), ends.tolist(), strict=True))
        if keep:
            code = np.concatenate(code)[order]
            self.about = np.concatenate([q.decode(ZERO if c == len(q.centroids) else c, code[i:j]) for c, (i, j) in zip(cells.tolist(), self.spans, strict=True)])

    def best(self, asked: np.ndarray, probed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of the k best rows of each query, ties to the smaller id."""
        out = []
        step = max(1, 4 * BLOCK // max(1, *(j - i for i, j in self.spans), (self.keep or k) * (asked.shape[1] if self.keep else 1)))
        for at in range(0, len(asked), step):
            some = asked[at : at + step]
            score, row = self._by(some, probed[at : at + step], self.about if self.keep else self.x, self.keep or k)
            if self.keep:
                score = np.where(row < 0, -np.inf, np.round(np.einsum("qrd,qd->qr", self.x[row], some), 9))
            place = np.where(row < 0, len(self.rank), self.rank[row])
            order = np.lexsort((place, -score), axis=1)[:, :k]
            score, row = np.take_along_axis(score, order, axis=1), np.take_along_axis(row, order, axis=1)
            one, other = np.nonzero(row >= 0)
            out.append((one + at, row[one, other], score[one, other]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _by(self, asked: np.ndarray, probed: np.ndarray, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and numbers (-1: none) of the n best rows of each query, a cell at a time."""
        score, row = np.full((len(asked), n), -np.inf), np.full((len(asked), n), -1)
        for c, (i, j) in enumerate(self.spans):
            own = np.flatnonzero(probed[:, c]) if j > i else []
            if not len(own):
                continue
            new = np.round(asked[own] @ x[i:j].T, 9)
            m = min(n, j - i)
            some = _first(new, m)
            new = np.column_stack([score[own], np.take_along_axis(new, some, axis=1)])
            which = np.column_stack([row[own], some + i])
            by_id = np.argsort(np.where(which < 0, len(self.rank), self.rank[which]), axis=1, kind="stable")
            new, which = np.take_along_axis(new, by_id, axis=1), np.take_along_axis(which, by_id, axis=1)
            some = _first(new, n)
            score[own], row[own] = np.take_along_axis(new, some, axis=1), np.take_along_axis(which, some, axis=1)
        return score, row


def _first(scores: np.ndarray, n: int) -> np.ndarray:
    """Columns of the n highest of each row, in order; of equal ones the first."""
    limit = -np.partition(-scores, n - 1, axis=1)[:, n - 1 : n]
    same = scores == limit
    fine = (scores > limit) | (same & (np.cumsum(same, axis=1) <= n - (scores > limit).sum(1)[:, None]))
    return np.nonzero(fine)[1].reshape(len(scores), n)


def _listed(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _probes(ids: pa.Array, at: np.ndarray, x: np.ndarray, row: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
    unit = pa.array([v.tobytes() for v in x], pa.binary())
    return pa.RecordBatch.from_arrays([ids.take(pa.array(at[row])), pa.array(cell.astype(np.int32)), unit.take(pa.array(row))], ["query_id", "cell", "unit"])
