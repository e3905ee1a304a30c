"""Product codes of vectors, trained by Yinyang Lloyd on integers.

Vectors become integers and are cut into equal parts; each part position has a
codebook of its own. A round assigns every part to its nearest entry and moves
entries to the (floored) mean of their parts. Yinyang saves most distances:
entries are clustered into groups once, each part keeps an upper bound of the
distance to its entry and one lower bound a group, bounds drift with the entries,
and only groups whose bound fails are scanned. Distances are compared as
integers, so ties are exact; bounds are floats that are rounded outwards.

A round is one job: it reads the table of integers, codes and bounds that the
last round wrote, writes the next one, and with it what each task adds to and
takes from the sums of the entries. Only those sums, whose size is that of the
codebooks, come to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import beside
from .common import discard, from_binary, materialize, ranges, ship, tidy

#: Rows whose distances are computed together.
ROWS = 4096
GROUP_SIZE = 4
UP, DOWN = np.float32(np.inf), np.float32(-np.inf)


@dataclass(frozen=True)
class Codebooks:
    """entries: (parts, entries, width) integers; group: (parts, entries) the Yinyang group of each entry."""

    entries: np.ndarray
    group: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def largest(width: int, parts: int) -> int:
    """Integers up to this size have errors that fit a long."""
    return math.isqrt((2**63 - 1) // (4 * width * parts))


def integers(lists: pa.Array, dim: int, parts: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are whole, their floor(scale * x) as rows of ``dim``): no null, no other length, nothing that is not finite or too large."""
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    bad = flat.is_null().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) * scale)
        bad = bad | ~(np.abs(values) <= largest(dim // parts, parts))
    upto = np.concatenate([[0], np.cumsum(size)])
    wrong = np.concatenate([[0], np.cumsum(bad)])[upto]
    keep = np.flatnonzero((np.diff(wrong) == 0) & (size == dim))
    return keep, values[ranges(upto[keep], size[keep])].astype(np.int64).reshape(-1, dim)


def pack(rows: np.ndarray) -> pa.Array:
    """Rows of integers as binary, in the narrowest of 16, 32 and 64 bits that holds all."""
    most = int(np.abs(rows).max(initial=0))
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    raw = np.ascontiguousarray(rows, kind)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * raw.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])


def unpack(column: pa.Array, dim: int) -> np.ndarray:
    """Inverse of ``pack``; batches may hold rows of several widths."""
    raw, upto = from_binary(column, np.uint8)
    width = np.diff(upto) // dim
    out = np.zeros((len(width), dim), np.int64)
    for kind in (np.int16, np.int32, np.int64):
        rows = np.flatnonzero(width == np.dtype(kind).itemsize)
        if len(rows):
            out[rows] = raw[ranges(upto[rows], np.diff(upto)[rows])].view(kind).reshape(-1, dim)
    return out


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances, as integers, of each row of ``x`` and each of ``c``."""
    most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * x.shape[1] * most**2 < 1 << 52:  # doubles hold all sums exactly
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)


def above(x: np.ndarray) -> np.ndarray:
    """A float32 no smaller than ``x``, with room for one rounding more."""
    return np.nextafter(np.nextafter(x.astype(np.float32), UP), UP)


def below(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.nextafter(x.astype(np.float32), DOWN), DOWN)


def groups_of(entries: np.ndarray) -> np.ndarray:
    """The Yinyang group of each entry of a codebook: a few plain Lloyd rounds from spread entries. Any grouping gives the same codes."""
    n = len(entries)
    t = max(1, -(-n // GROUP_SIZE))
    points = entries.astype(np.float64)
    centre = points[np.linspace(0, n - 1, t).astype(np.int64)]
    for _ in range(5):
        group = ((points[:, None] - centre[None]) ** 2).sum(2).argmin(1)
        centre = np.stack([points[group == g].mean(0) if (group == g).any() else centre[g] for g in range(t)])
    return group


def assign(x: np.ndarray, books: Codebooks, p: int, code: np.ndarray, ub: np.ndarray, lb: np.ndarray, drift: np.ndarray | None, exact: bool) -> np.ndarray | None:
    """Bring codes and bounds of part ``p`` of some rows up to date, in place.

    ``drift`` is how far each entry moved since the bounds were made; None means
    that there are none yet. With ``exact``, the squared distances to the
    assigned entries are returned.
    """
    c, group = books.entries[p], books.group[p]
    t = lb.shape[1]
    if drift is None:
        d = squared(x, c)
        code[:] = d.argmin(1)  # the first of the smallest
        best = d[np.arange(len(x)), code]
        ub[:] = above(np.sqrt(best))
        rest = d.astype(np.float64)
        rest[np.arange(len(x)), code] = np.inf
        for g in range(t):
            lb[:, g] = below(np.sqrt(rest[:, group == g].min(1))) if (group == g).any() else np.inf
        return best if exact else None
    ub += above(drift[code])
    ub[:] = np.nextafter(ub, UP)
    for g in range(t):
        own = drift[group == g]
        lb[:, g] = np.nextafter(lb[:, g] - above(own.max(keepdims=True)) if len(own) else lb[:, g], DOWN)
    to_own = np.zeros(len(x), np.int64)
    near = np.arange(len(x)) if exact else np.flatnonzero(lb.min(1) <= ub)
    to_own[near] = ((x[near] - c[code[near]]) ** 2).sum(1)
    ub[near] = above(np.sqrt(to_own[near]))
    near = near[lb[near].min(1) <= ub[near]]
    if len(near):
        was, old = code[near].copy(), to_own[near]
        best, now = old.copy(), was.copy()
        scan = lb[near] <= ub[near][:, None]
        seen: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for g in range(t):
            entries = np.flatnonzero(group == g)
            rows = np.flatnonzero(scan[:, g])
            if not len(rows) or not len(entries):
                continue
            d = squared(x[near[rows]], c[entries])
            seen.append((g, rows, entries, d))
            at = d.argmin(1)
            low, which = d[np.arange(len(rows)), at], entries[at]
            better = (low < best[rows]) | ((low == best[rows]) & (which < now[rows]))
            best[rows[better]], now[rows[better]] = low[better], which[better]
        for g, rows, entries, d in seen:  # what lies behind the entry that was chosen
            rest = np.where(entries[None, :] == now[rows][:, None], np.inf, d.astype(np.float64)).min(1)
            lb[near[rows], g] = below(np.sqrt(rest))
        moved = np.flatnonzero(now != was)
        left = group[was[moved]]
        lb[near[moved], left] = np.minimum(lb[near[moved], left], below(np.sqrt(old[moved])))
        code[near], to_own[near] = now, best
        ub[near] = above(np.sqrt(best))
    return to_own if exact else None


FORM = "vec_id long, label string, ints binary, code binary, upper binary, lower binary, error long, sums array<decimal(38,0)>"
NAMES = ["vec_id", "label", "ints", "code", "upper", "lower", "error", "sums"]


def _round(books: Codebooks, before: Codebooks | None, last: bool):
    """A pass over the table of a round: codes and bounds of every row, and one row a task of changes of the sums (count, then components, of each entry)."""
    parts, k, width = books.entries.shape
    t = int(books.group.max()) + 1
    drift = None if before is None else np.nextafter(np.sqrt(((books.entries - before.entries).astype(np.float64) ** 2).sum(2)), np.inf)

    def raw(x: np.ndarray) -> pa.Array:
        body = np.ascontiguousarray(x)
        offsets = np.arange(len(x) + 1, dtype=np.int32) * (body.nbytes // max(len(x), 1))
        return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(body.tobytes())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = np.zeros((parts, k, width + 1), np.int64)
        for whole in batches:
            for batch in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                n = batch.num_rows
                x = unpack(batch.column("ints"), parts * width).reshape(n, parts, width)
                if drift is None:
                    code, upper, lower = np.zeros((n, parts), np.int64), np.zeros((n, parts), np.float32), np.zeros((n, parts, t), np.float32)
                else:
                    code = from_binary(batch.column("code"), np.uint8)[0].reshape(n, parts).astype(np.int64)
                    upper, lower = from_binary(batch.column("upper"), np.float32)[0].reshape(n, parts).copy(), from_binary(batch.column("lower"), np.float32)[0].reshape(n, parts, t).copy()
                error = np.zeros(n, np.int64)
                for p in range(parts):
                    was = code[:, p].copy()
                    found = assign(x[:, p], books, p, code[:, p], upper[:, p], lower[:, p], None if drift is None else drift[p], last)
                    if last:
                        error += found
                        continue
                    rows = np.arange(n) if drift is None else np.flatnonzero(was != code[:, p])
                    both = np.column_stack([np.ones(len(rows), np.int64), x[rows, p]])
                    np.add.at(change[p], code[rows, p], both)
                    if drift is not None:
                        np.subtract.at(change[p], was[rows], both)
                none = pa.nulls(n, pa.binary())
                kept = [none] * 3 if last else [batch.column("ints"), raw(upper), raw(lower)]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), kept[0], raw(code.astype(np.uint8)), kept[1], kept[2], pa.array(error), pa.nulls(n, pa.list_(pa.decimal128(38, 0)))], NAMES)
        if not last and change.any():
            sums = pa.array([change.ravel().tolist()], pa.list_(pa.int64())).cast(pa.list_(pa.decimal128(38, 0)))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.string()), *(pa.nulls(1, pa.binary()) for _ in range(4)), pa.nulls(1, pa.int64()), sums], NAMES)

    return run


def moved(books: Codebooks, totals: np.ndarray) -> Codebooks:
    """Entries at the floored means of their parts; unused ones stay. ``totals`` holds Python integers: (parts, entries, 1 + width)."""
    out = books.entries.copy()
    for p, j in np.argwhere(totals[:, :, 0] > 0):
        out[p, j] = [s // totals[p, j, 0] for s in totals[p, j, 1:]]
    return Codebooks(out, books.group)


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, dim: int | None = None) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of the whole vectors of (vec_id, embedding, label).

    A vector is whole if it is not null, has ``dim`` components and each of them
    is a finite number; other rows are left out. Without ``dim``, the length of
    the first such vector by id that ``parts`` divides counts. Components
    become floor(scale * x); those beyond ``largest`` would make errors that no
    long holds, and count as not finite. Codebooks start as the parts of the
    ``entries`` (256 at most) first rows by id, null ids last and equal ids by vector; with fewer
    rows they are smaller. Ties go to the lower entry. label_error sums the error over equal
    labels, nulls together. Repeated rows are rows like others; tables without whole vectors give no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("codes have one byte a part")
    ship(vectors.sparkSession)
    with tidy() as keep:
        return _codes(vectors, parts, entries, rounds, scale, dim, keep)


def _codes(vectors, parts, entries, rounds, scale, dim, keep) -> DataFrame:
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if dim is None:
        finite = "embedding IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity'))"
        first = rows.where(f"{finite} AND size(embedding) % {parts} = 0").orderBy(F.asc_nulls_last("vec_id"), "embedding").select(F.size("embedding")).first()
        dim = first[0] if first else parts
    width = dim // parts

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ints = integers(batch.column(2), dim, parts, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pack(ints)], ["vec_id", "label", "ints"])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ints = integers(batch.column(1), dim, parts, scale)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(list(ints), pa.list_(pa.int64()))], ["vec_id", "ints"])

    lead = rows.select("vec_id", "embedding").mapInArrow(lists, "vec_id long, ints array<long>").orderBy(F.asc_nulls_last("vec_id"), "ints").limit(entries).collect()  # ``entries`` rows
    names = f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string"
    if not lead:
        return spark.createDataFrame([], names)
    start = np.array([r["ints"] for r in lead], np.int64).reshape(len(lead), parts, width).transpose(1, 0, 2)
    books, before = Codebooks(start, np.stack([groups_of(b) for b in start])), None
    totals = np.zeros((parts, len(lead), width + 1), object)
    now = rows.mapInArrow(whole, "vec_id long, label string, ints binary")
    for r in range(rounds):
        after = materialize(now.mapInArrow(_round(books, before, False), FORM), "codes")
        sums = after.where("sums IS NOT NULL").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
        change = np.zeros(totals.size, object)
        for row in sums.collect():  # as many rows as the codebooks have numbers
            change[row["at"]] = int(row["x"])
        totals = totals + change.reshape(totals.shape)
        before, books = books, moved(books, totals)
        if r:
            discard(now_table)
        now_table = after
        now = after.where("sums IS NULL")
    final = keep(materialize(now.mapInArrow(_round(books, before, True), FORM).select("vec_id", "label", "code", "error"), "final-codes"))
    by_label = materialize(final.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("label_error")), "label-errors")
    by_label = keep(by_label).withColumnRenamed("label", "of")
    joined = final.join(beside(by_label, by_label), F.col("label").eqNullSafe(F.col("of")))
    code = F.lower(F.hex("code"))
    return joined.select(F.col("vec_id").cast(kind).alias("vec_id"), code.alias("code"), "error", F.expr("try_cast(label_error AS bigint)").alias("label_error"), F.lit(books.sha256()).alias("codebooks_sha256"))


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The query in SQL, one pair of tables a round."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
, d{r} AS MATERIALIZED (
  SELECT p.vec_id, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x)) AS d FROM parts p JOIN b{r} b USING (part, pos) GROUP BY ALL
), a{r} AS MATERIALIZED (
  SELECT vec_id, part, arg_min(entry, d * 16384 + entry) AS entry, min(d) AS d FROM d{r} GROUP BY ALL
)""")
        if r < rounds:
            steps.append(f"""
, b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, b.pos, coalesce(m.x, b.x) AS x FROM b{r} b LEFT JOIN (
    SELECT part, entry, pos, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM a{r} JOIN parts USING (vec_id, part) GROUP BY ALL
  ) m USING (part, entry, pos)
)""")
    return f"""
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (len(v) // {parts}) AS part, (i - 1) % (len(v) // {parts}) AS pos, v[i] AS x FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM whole)
), b0 AS MATERIALIZED (
  SELECT part, entry, pos, x FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM whole ORDER BY vec_id LIMIT {entries}) USING (vec_id)
){''.join(steps)}
, coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id
)
SELECT c.vec_id, c.code, c.error, (sum(c.error) OVER (PARTITION BY w.label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
FROM coded c JOIN whole w USING (vec_id)
"""
