"""N-gram Jaccard join by grouped prefixes, and the components of its links.

Shingles are ordered rarest first, by a count sketch over all documents and then
by hash. Two sets that are similar enough share one of their first shingles, the
prefix. Documents with one set are a class; classes with one prefix and size are
a group. Groups meet in the lists of their prefix shingles, where size and
position rule out most pairs.

Not every pair of a list is written down. In a first round each group is
verified against the list's leader, and what links becomes a component. Lists
that still hold several components are compared in full, in blocks, by parity
bitmaps: where two bitmaps differ the sets do, so that pairs with too many
differences go before any set is moved. The few that remain are verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_MIX, U, binary_column, discard, from_binary, gather, longs, materialize, mix64, ranges, ship, slices, text_bytes, tidy, window_hashes, word_hashes, words
from .components import connected_components
from .seeds import group_starts, sizes_of

SLICE = 4 << 20
#: Counters of the sketch that orders shingles, and rows that it travels in: fixed, whatever the corpus.
SKETCH_BITS, SKETCH_ROWS = 20, 64
#: Members of a block when a list is compared in full.
BLOCK = 512


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each row, row offsets)."""
    starts, ends, firsts = words(data, offsets)
    h = word_hashes(data, starts, ends, lower=True)
    n = np.diff(firsts)
    size = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    upto = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(upto[-1]), np.uint64)
    full = n >= k
    out[ranges(upto[:-1][full], size[full])] = window_hashes(h, k)[ranges(firsts[:-1][full], size[full])]
    for m in range(1, k):  # fewer words than a shingle has: the whole sequence is one
        few = np.flatnonzero(n == m)
        if len(few):
            out[upto[few]] = mix64(window_hashes(h, m)[firsts[few]] + SHINGLE_MIX[60] * U(m))
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[upto[:-1][size > 0]] = True
    return out[fresh], np.concatenate([[0], np.cumsum(fresh)])[upto]


def _each(batches: Iterator[pa.RecordBatch], k: int):
    """(rows of the batch, hashes, offsets) of every slice."""
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for a, b in slices(offsets, SLICE):
            yield batch.slice(a, b - a), *shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], k)


def shingle_counts(docs: DataFrame, k: int) -> np.ndarray:
    """A count sketch of all shingles of all documents: 2^SKETCH_BITS counters."""
    width = (1 << SKETCH_BITS) // SKETCH_ROWS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for _, h, _ in _each(batches, k):
            total += np.bincount((h & U((1 << SKETCH_BITS) - 1)).view(np.int64), minlength=1 << SKETCH_BITS)
        rows = [total[i * width : (i + 1) * width].astype(np.uint32).tobytes() for i in range(SKETCH_ROWS)]
        salt = int(total.sum()) % 61  # which of several partial sums this task adds to
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SKETCH_ROWS)), pa.array([salt] * SKETCH_ROWS, pa.int64()), pa.array(rows, pa.binary())], ["part", "salt", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, salt, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = (part, salt)
                now = sums.setdefault(key, np.zeros(width, np.int64))
                now += np.frombuffer(raw, np.uint32)
        top = np.iinfo(np.uint32).max
        for (part, salt), now in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([salt]), pa.array([np.minimum(now, top).astype(np.uint32).tobytes()], pa.binary())], ["part", "salt", "counts"])

    form = "part long, salt long, counts binary"
    some = docs.mapInArrow(count, form).repartition("part", "salt").mapInArrow(add, form)
    rows = some.withColumn("salt", F.lit(0).cast("long")).repartition("part").mapInArrow(add, form).collect()  # SKETCH_ROWS rows
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in rows:
        out[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["counts"], np.uint32)
    return out


def keys_of(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shingles as numbers in their order: rarer first, then by hash."""
    level = (np.log2(counts[(h & U((1 << SKETCH_BITS) - 1)).view(np.int64)].astype(np.float64) + 1) * 32).astype(np.uint64)
    return (level << U(52)) | (mix64(h) >> U(12))


def prefix_size(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return np.where(n > 0, n - -(-num * n // den) + 1, 0)


def least_overlap(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    return -(-num * (n + m) // (num + den))


def overlaps(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Common items of the i-th sorted set of ``a`` and the i-th of ``b``, 2,048 sets at most, compared in full width."""
    row = np.concatenate([np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)]).astype(np.uint64)
    both = np.concatenate([a, b])
    key = row << U(53) | both >> U(11)
    order = np.argsort(key)
    key, both = key[order], both[order]
    alike = key[1:] == key[:-1]
    if (alike[1:] & alike[:-1]).any():  # three items that start alike: their order matters
        order = np.lexsort((np.concatenate([a, b]), row))
        key, both = row[order] << U(53), np.concatenate([a, b])[order]
        alike = key[1:] == key[:-1]
    twin = key[1:][alike & (both[1:] == both[:-1])]
    return np.bincount((twin >> U(53)).view(np.int64), minlength=len(na))


def bitmaps(h: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): a bitmap of one to two bits per item of each set, 256 at least; a bit is the parity of its items.

    Sizes are powers of two, and folding one in half gives the smaller bitmap.
    """
    n = np.diff(upto)
    size = np.maximum(256, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(size)])
    at = np.repeat(first[:-1], n) + (mix64(h ^ SHINGLE_MIX[62]) & np.repeat(size - 1, n).astype(np.uint64)).view(np.int64)
    return np.packbits(np.bincount(at, minlength=int(first[-1])).astype(np.uint8) & 1), first // 8


def fold(raw: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (rows of bytes) folded to ``size`` bytes."""
    while raw.shape[1] > size:
        half = raw.shape[1] // 2
        raw = raw[:, :half] ^ raw[:, half:]
    return raw


def at_most_apart(n: np.ndarray, m: np.ndarray, num: int, den: int) -> np.ndarray:
    """Items that only one of two linked sets may hold."""
    return n + m - 2 * least_overlap(n, m, num, den)


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    The threshold num / den must be over one half. Documents link when den * |common| >= num * |union| over their sets of
    distinct k-word shingles, A-Z lower-cased; fewer words make one shingle.
    component_id is the smallest doc_id that links reach. Links themselves, and
    their number, are not offered: pairs already in one component are not
    verified. Rows without words
    (or text) have no shingles and link with nothing, nor do rows with a null
    id. Each row is a document: rows of one id and different texts link by
    their own texts, repeated rows come out alike. Texts of any length are
    read whole. An empty table gives no rows.
    """
    if 2 * num <= den:
        raise ValueError("the threshold must be over one half")  # bitmaps of sets that may link differ by one size at most
    ship(docs.sparkSession)
    with tidy() as keep:
        return _components(docs, k, num, den, keep)


def _components(docs: DataFrame, k: int, num: int, den: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("row"))
    shared = spark.sparkContext.broadcast(shingle_counts(texts, k))  # 4 bytes a counter, whatever the corpus

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for part, h, upto in _each(batches, k):
            n = np.diff(upto)
            p = prefix_size(n, num, den)
            order, cuts = keys_of(h, counts), np.concatenate([[0], np.cumsum(p)])
            first = np.zeros(int(cuts[-1]), np.uint64)
            for a, b, c, q in zip(upto[:-1].tolist(), upto[1:].tolist(), cuts[:-1].tolist(), p.tolist(), strict=True):
                if q:
                    own = order[a:b]
                    first[c : c + q] = np.sort(np.partition(own, q - 1)[:q] if q < b - a else own)
            some = np.flatnonzero(n > 0)
            sums = [np.zeros(len(n), np.uint64) for _ in range(3)]
            if len(some):
                sums[0][some] = np.add.reduceat(mix64(h), upto[some])
                sums[1][some] = np.add.reduceat(mix64(h ^ SHINGLE_MIX[61]), upto[some])
                place = ranges(np.zeros(len(p), np.int64), p).astype(np.uint64)
                sums[2][some] = np.add.reduceat(mix64(first + place), cuts[some])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n), *(pa.array(x.view(np.int64)) for x in sums), binary_column(first, cuts), binary_column(*bitmaps(h, upto))], ["doc_id", "row", "n", "s1", "s2", "p", "prefix", "bits"])

    all_ = materialize(texts.mapInArrow(prefixes, "doc_id long, row long, n long, s1 long, s2 long, p long, prefix binary, bits binary"), "prefixes")
    real = all_.where("n > 0 and doc_id is not null")
    # A class has a number of its own; one of its rows, known by id and text, stands for it.
    classes = real.groupBy("n", "s1", "s2").agg(F.min(F.struct("doc_id", "row")).alias("one"), F.min("p").alias("p"))
    classes = materialize(classes.select("n", "s1", "s2", "p", "one.*", F.monotonically_increasing_id().alias("rep")), "classes")
    named = classes.select("doc_id", "row", "rep")
    groups = classes.groupBy("n", "p").agg(F.min("rep").alias("group"), F.count("*").alias("members"))
    first = groups.join(named.withColumnRenamed("rep", "group"), "group").select("doc_id", "row", "group", "n", "members")
    leads = real.select("doc_id", "row", "prefix").join(first, ["doc_id", "row"])
    members = materialize(classes.join(groups, ["n", "p"]).select("rep", "group", "n"), "members")
    lists = materialize(_lists(leads, num, den), "lists")

    bits = real.select("doc_id", "row", "bits").join(named, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"])
    bits = materialize(members.join(bits.select("rep", "bits"), "rep").select("rep", "group", "n", "bits"), "bits")

    heads = lists.where("leader <> group").select("leader", "group").distinct()
    ask = heads.join(members.select("group", "rep"), "group").select(F.col("leader").alias("a"), F.col("rep").alias("b"))
    ask = ask.union(members.where("rep <> group").select(F.col("group").alias("a"), F.col("rep").alias("b"))).distinct()
    linked = _verify(materialize(_close(ask, bits, num, den), "ask"), texts, named, k, num, den)
    known = connected_components(linked)

    more = _verify(materialize(_rest(lists, bits, known, num, den), "ask"), texts, named, k, num, den)
    found = connected_components(known.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more))
    by_class = classes.join(found, classes.rep == found.node, "left").select("n", "s1", "s2", "doc_id", F.coalesce("component", "rep").alias("component"))
    by_class = materialize(by_class, "by-class")
    lowest = by_class.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    placed = all_.select("doc_id", "n", "s1", "s2").join(by_class.drop("doc_id"), ["n", "s1", "s2"], "left")
    placed, lowest = keep(materialize(placed.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component")), "placed")), keep(materialize(lowest, "lowest"))
    return placed.join(lowest, "component", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _lists(leads: DataFrame, num: int, den: int) -> DataFrame:
    """Inverted lists (token, group, n, at, leader, list) of prefix shingles that two members or more share.

    leader: the group that stands first in its prefix order, if size and
    position allow a link with it. list: a digest of the list's groups; lists of
    the same groups need one comparison.
    """

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, upto = from_binary(batch.column(1), np.int64)
            size = np.diff(upto)
            row = np.repeat(np.arange(batch.num_rows), size)
            at = ranges(np.zeros(len(size), np.int64), size).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(token), *(batch.column(i).take(pa.array(row)) for i in (0, 2, 3)), pa.array(at)], ["token", "group", "n", "members", "at"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = gather(batches)
        if found is None:
            return
        token, group, n, at, many = (longs(found, c) for c in ("token", "group", "n", "at", "members"))
        order = np.argsort(token)
        starts = group_starts(token[order])
        total = np.add.reduceat(many[order], starts)
        keep = np.repeat(total > 1, sizes_of(starts, len(order)))
        order = order[keep]
        order = order[np.lexsort((group[order], n[order], token[order]))]
        order = order[np.concatenate([[True], (token[order][1:] != token[order][:-1]) | (group[order][1:] != group[order][:-1])])] if len(order) else order  # repeated rows
        token, group, n, at, many = token[order], group[order], n[order], at[order], many[order]
        near = (token[1:] == token[:-1]) & (den * n[:-1] >= num * n[1:])  # neighbours by size that may link
        keep = np.append(near, False) | np.concatenate([[False], near]) | (many > 1) if len(token) else np.zeros(0, bool)
        token, group, n, at = token[keep], group[keep], n[keep], at[keep]
        order = np.lexsort((group, at, token))
        token, group, n, at = token[order], group[order], n[order], at[order]
        starts = group_starts(token)
        if not len(starts):
            return
        size = sizes_of(starts, len(token))
        head = np.repeat(starts, size)
        need = least_overlap(n, n[head], num, den)
        fits = np.minimum(n - at, n[head] - at[head]) >= need
        digest = np.repeat(np.add.reduceat(mix64(group.astype(np.uint64)), starts) + size.astype(np.uint64), size)
        leader = pa.array(group[head], mask=~fits)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(group), pa.array(n), pa.array(at.astype(np.int32)), leader, pa.array(digest.view(np.int64))], ["token", "group", "n", "at", "leader", "list"])

    flat = leads.select("group", "prefix", "n", "members").mapInArrow(explode, "token long, group long, n long, members long, at int")
    return flat.repartition("token").mapInArrow(meet, "token long, group long, n long, at int, leader long, list long")


def _close(ask: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) whose bitmaps allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = longs(batch, "n"), longs(batch, "m")
            (x, xs), (y, ys) = from_binary(batch.column(4), np.uint8), from_binary(batch.column(5), np.uint8)
            keep = np.zeros(len(n), bool)
            wide = np.stack([np.diff(xs), np.diff(ys)], axis=1)
            for p, q in np.unique(wide, axis=0).tolist():
                rows = np.flatnonzero((wide == (p, q)).all(axis=1))
                one = x[ranges(xs[:-1][rows], np.full(len(rows), p))].reshape(-1, p)
                two = y[ranges(ys[:-1][rows], np.full(len(rows), q))].reshape(-1, q)
                apart = np.bitwise_count(fold(one, min(p, q)) ^ fold(two, min(p, q))).sum(axis=1, dtype=np.int64)
                keep[rows] = apart <= at_most_apart(n[rows], m[rows], num, den)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    one = ask.join(bits.select(F.col("rep").alias("b"), F.col("n").alias("m"), F.col("bits").alias("right")), "b")
    two = one.join(bits.select(F.col("rep").alias("a"), "n", F.col("bits").alias("left")), "a")
    sized = two.where(F.least("n", "m") * den >= F.greatest("n", "m") * num)
    return sized.select("a", "b", "n", "m", "left", "right").mapInArrow(run, "a long, b long")


def _verify(ask: DataFrame, texts: DataFrame, named: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(u, v): those of the asked pairs (a, b) that link, by their whole sets of shingles."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, h, upto in _each(batches, k):
            yield pa.RecordBatch.from_arrays([part.column(0), binary_column(h, upto)], ["id", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                a, na = from_binary(part.column(2), np.uint64)
                b, nb = from_binary(part.column(3), np.uint64)
                na, nb = np.diff(na), np.diff(nb)
                both = overlaps(a, na, b, nb)
                yield part.select(["u", "v"]).filter(pa.array(den * both >= num * (na + nb - both)))

    wanted = materialize(ask.select(F.explode(F.array("a", "b")).alias("rep")).distinct().join(named, "rep"), "wanted")
    sets = materialize(texts.join(wanted, ["doc_id", "row"]).select("rep", "text").mapInArrow(shingle, "id long, items binary").dropDuplicates(["id"]), "sets")
    one = ask.join(sets.select(F.col("id").alias("b"), F.col("items").alias("right")), "b")
    two = one.join(sets.select(F.col("id").alias("a"), F.col("items").alias("left")), "a")
    linked = materialize(two.select(F.col("b").alias("u"), F.col("a").alias("v"), "left", "right").mapInArrow(run, "u long, v long"), "linked")
    discard(sets)
    return linked


def _rest(lists: DataFrame, bits: DataFrame, known: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): pairs of one list in different components so far whose bitmaps allow a link."""
    whose = bits.join(known, bits.rep == known.node, "left").select("rep", "group", "n", "bits", F.coalesce("component", "rep").alias("component"))
    whose = materialize(whose, "whose")
    spread = whose.groupBy("group").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("members"))
    open_ = lists.join(spread, "group").groupBy("token", "list").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("members").alias("size")).where("low <> high")
    open_ = open_.groupBy("list").agg(F.min_by("token", "token").alias("token"), F.min_by("size", "token").alias("size"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("long")
    rows = lists.select("token", "group").join(open_.select("token", blocks.alias("blocks")), "token").join(whose, "group")
    mine = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("token", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"), "rep", "component", "n", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = gather(batches)
        if found is None:
            return
        token, x, y, rep, comp, n = (longs(found, c) for c in ("token", "x", "y", "rep", "component", "n"))
        raw, upto = from_binary(found["bits"].combine_chunks(), np.uint8)
        width = np.diff(upto)
        key = mix64(token.astype(np.uint64)) + x.astype(np.uint64) * SHINGLE_MIX[1] + y.astype(np.uint64) * SHINGLE_MIX[2]
        order = np.argsort(key, kind="stable")
        starts = group_starts(key[order])
        seen: set[tuple[int, int]] = set()
        for s, m in zip(starts.tolist(), sizes_of(starts, len(order)).tolist(), strict=True):
            own = order[s : s + m]
            if m < 2 or comp[own].min() == comp[own].max():
                continue
            for size in np.unique(width[own]).tolist():  # sets that may link differ by less than twice
                rows = own[(width[own] == size) | (width[own] == 2 * size)]
                if len(rows) < 2 or comp[rows].min() == comp[rows].max():
                    continue
                maps = np.concatenate([fold(raw[upto[r] : upto[r + 1]][None, :], size) for r in rows])
                signs = np.unpackbits(maps, axis=1).astype(np.float32) * 2 - 1
                apart = (8 * size - signs @ signs.T) / 2
                near = apart <= at_most_apart(n[rows][:, None], n[rows][None, :], num, den)
                near &= (comp[rows][:, None] != comp[rows][None, :]) & ((width[rows] == size)[:, None] | (width[rows] == size)[None, :])
                near &= den * np.minimum(n[rows][:, None], n[rows][None, :]) >= num * np.maximum(n[rows][:, None], n[rows][None, :])
                i, j = np.nonzero(np.triu(near, 1))
                seen.update(zip(np.minimum(rep[rows][i], rep[rows][j]).tolist(), np.maximum(rep[rows][i], rep[rows][j]).tolist(), strict=True))
        if seen:
            a, b = np.array(sorted(seen), np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.repartition("token", "x", "y").mapInArrow(run, "a long, b long").distinct()


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 3 THEN array_to_string(words, ' ') ELSE array_to_string(list_slice(words, i, i + 2), ' ') END AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach(x, y) AS (
  SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y
)
SELECT w.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce((SELECT min(y) FROM reach r WHERE r.x = w.doc_id), w.doc_id))::BIGINT AS component_id
FROM w LEFT JOIN sizes s USING (doc_id)
"""
