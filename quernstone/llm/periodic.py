"""Runs of repeated words: in-document repeated k-grams mask, Main-Lorentz on what is left.

A run of period q and at least ``least_length`` words equals itself shifted by q,
so each of its words lies in a stretch that occurs twice in its document. The
shortest such overlap any run can have gives k: words outside repeated k-grams
are in no run, and a run lies within one stretch of the words that remain. The
mask may keep too much (it compares hashes), never too little; runs themselves
are found on exact word numbers.

Main-Lorentz halves a stretch again and again; a run is found where it crosses a
middle, by how far words agree at a distance of q before and behind it. All
stretches of a batch are halved together, and agreement is looked up in the
ranks of the 2^j-grams.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHINGLE_MIX, mix64, ranges, row_of, ship, slices, text_bytes, window_hashes
from .seeds import nullable

#: Bytes of text whose words are numbered and masked together.
SLICE = 4 << 20
#: Words of the stretches that are halved together; a longer stretch is taken alone.
TOGETHER = 1 << 20


def least_length(period: np.ndarray, times: int, least: int) -> np.ndarray:
    return np.maximum(least, times * period)


def mask_size(times: int, least: int) -> int:
    """k: the smallest overlap of a run with itself, over all periods."""
    q = np.arange(1, least + 2)
    return int((least_length(q, times, least) - q).min())


def planted(items: list, doc_id: int | None) -> list:
    """``items`` with the periodic tail that every tenth crc32 of an id asks for; a null id asks for none."""
    n, h = len(items), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return items
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    tail = items[a : a + p]
    return items[:a] + (tail * (-(-(n - a) // p)))[: n - a]


def surviving(word: np.ndarray, firsts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches of words that lie in k-grams which occur more than once in their row."""
    n = np.diff(firsts)
    at = ranges(firsts[:-1], np.maximum(n - k + 1, 0))
    if not len(at):
        return at, at
    row = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0)).astype(np.uint64)
    key = mix64(window_hashes(mix64(word.astype(np.uint64) + SHINGLE_MIX[50]), k)[at] + row * SHINGLE_MIX[51])
    order = np.argsort(key)
    alike = key[order][1:] == key[order][:-1]
    often = np.zeros(len(at), bool)
    often[order[1:][alike]] = True
    often[order[:-1][alike]] = True
    mark = np.zeros(len(word) + 1, np.int32)
    np.add.at(mark, at[often], 1)
    np.add.at(mark, at[often] + k, -1)
    inside = np.cumsum(mark[:-1]) > 0
    inside_before = np.concatenate([[False], inside[:-1]])
    inside_before[firsts[:-1][n > 0]] = False  # a stretch ends with its row
    start = np.flatnonzero(inside & ~inside_before)
    ends = np.flatnonzero(inside & np.append(~inside[1:] | (row_of(firsts)[1:] != row_of(firsts)[:-1]), True)) + 1
    return start, ends


class Agreement:
    """How far a text agrees with itself: ranks of its 2^j-grams, for all stretches at once.

    ``text`` holds the stretches' word numbers, each stretch behind a number that
    occurs nowhere else, so that no agreement leaves its stretch.
    """

    def __init__(self, text: np.ndarray, longest: int):
        self.ranks = [np.unique(text, return_inverse=True)[1].astype(np.int32)]
        while 1 << len(self.ranks) <= longest:
            low, half = self.ranks[-1], 1 << (len(self.ranks) - 1)
            if len(low) <= half:
                break
            pair = low[:-half].astype(np.int64) << 32 | low[half:]
            self.ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))

    def forward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of equal words from a[i] and from b[i] on; b > a."""
        a, b = a.copy(), b.copy()
        far = np.zeros(len(a), np.int64)
        for j in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[j]
            same = b < len(rank)
            same[same] = rank[a[same]] == rank[b[same]]
            step = same.astype(np.int64) << j
            a += step
            b += step
            far += step
        return far

    def backward(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of equal words up to a[i] - 1 and up to b[i] - 1; b > a."""
        a, b = a.copy(), b.copy()
        far = np.zeros(len(a), np.int64)
        for j in range(len(self.ranks) - 1, -1, -1):
            rank = self.ranks[j]
            same = a >= 1 << j
            same[same] = rank[a[same] - (1 << j)] == rank[b[same] - (1 << j)]
            step = same.astype(np.int64) << j
            a -= step
            b -= step
            far += step
        return far


def main_lorentz(text: np.ndarray, start: np.ndarray, end: np.ndarray, times: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs within the stretches start..end-1 of ``text``, as ``Agreement`` has it; sorted."""
    agree = Agreement(text, int((end - start).max()))
    most = (end - start) // times  # the longest period of a stretch
    found = []
    lo, hi = start, end
    while len(lo):
        mid = (lo + hi) // 2
        for right in (True, False):
            count = np.minimum(np.minimum(hi - mid if right else mid - lo, (hi - lo) // times), most)
            q = ranges(np.ones(len(lo), np.int64), np.maximum(count, 0))
            m = np.repeat(mid, np.maximum(count, 0))
            a, b = (m, m + q) if right else (m - q, m)  # the run holds words a - 1 and a, and is q words further the same
            near = text[a - 1] == text[b - 1] if right else text[a] == text[b]
            a, b, q = a[near], b[near], q[near]
            back, ahead = agree.backward(a, b), agree.forward(a, b)
            length = back + ahead + q
            keep = length >= least_length(q, times, least)
            found.append(np.stack([(a - back)[keep], length[keep], q[keep]]))
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
        keep = hi - lo >= least
        lo, hi, most = lo[keep], hi[keep], np.concatenate([most, most])[keep]
    begin, length, q = np.concatenate(found, axis=1)
    order = np.lexsort((q, length, begin))
    begin, length, q = begin[order], length[order], q[order]
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (begin[1:] != begin[:-1]) | (length[1:] != length[:-1])  # of one stretch, its smallest period
    begin, length, q = begin[fresh], length[fresh], q[fresh]
    order = np.lexsort((q, begin))
    return begin[order], length[order], q[order]


def runs_of(word: np.ndarray, firsts: np.ndarray, times: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start within the row, length, period) of the runs of every row, by row, start and period."""
    lo, hi = surviving(word, firsts, mask_size(times, least))
    keep = hi - lo >= least
    lo, hi = lo[keep], hi[keep]
    found = [np.zeros((3, 0), np.int64)]
    a = 0
    while a < len(lo):
        b = max(a + 1, int(np.searchsorted(np.cumsum(hi[a:] - lo[a:]), TOGETHER, "right")) + a)
        n = hi[a:b] - lo[a:b]
        place = np.concatenate([[0], np.cumsum(n + 1)])
        text = np.full(int(place[-1]) + 1, -1, np.int64)
        text[place] = -1 - np.arange(len(place))
        text[ranges(place[:-1] + 1, n)] = word[ranges(lo[a:b], n)]
        begin, length, q = main_lorentz(text, place[:-1] + 1, place[1:], times, least)
        which = np.searchsorted(place, begin, "right") - 1
        found.append(np.stack([begin - place[which] - 1 + lo[a:b][which], length, q]))
        a = b
    begin, length, q = np.concatenate(found, axis=1)
    row = np.searchsorted(firsts, begin, "right") - 1
    return row, begin - firsts[row], length, q


def periodic_runs(docs: DataFrame, times: int = 4, least: int = 6, plant: bool = False, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, kept_text[, carried]) of every row: its runs of repeated words, and the text without the repeats.

    A run is a stretch of words whose smallest period is q, of at least
    ``times`` * q and ``least`` words, that no neighbour extends at that period.
    ``runs`` lists (start, length, period) by start, then period; words are
    ``[^\\x20\\x09-\\x0D]+`` and numbered from 0. kept_text joins by one space
    the words that no run holds after its first period; it is the empty text
    where there are none. ``plant`` first gives texts the periodic tails that
    their ids ask for (``planted``). Null and empty texts have no words and no
    runs. Rows with null or repeated ids are rows like others, and ``carry``
    names columns that travel along as one. Texts of any length are read whole; one is
    handled within a task. An empty table gives no rows.
    """
    if times < 2 or least < times:
        raise ValueError("a run has two periods or more, and as many words at least")
    ship(docs.sparkSession)
    carried = [F.struct(*(F.col(c) for c in carry)).alias("carried")] if carry else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids, none = nullable(batch.column(0))
            raw = data.tobytes()
            for a, b in slices(offsets, SLICE):
                numbers: dict[bytes, int] = {}
                rows = [raw[offsets[i] : offsets[i + 1]].split() for i in range(a, b)]  # bytes are split at just these six
                if plant:
                    rows = [planted(w, None if none[i] else int(ids[i])) for i, w in zip(range(a, b), rows, strict=True)]
                firsts = np.concatenate([[0], np.cumsum([len(w) for w in rows])])
                word = np.fromiter((numbers.setdefault(w, len(numbers)) for own in rows for w in own), np.int64, int(firsts[-1]))
                row, begin, length, q = runs_of(word, firsts, times, least)
                mark = np.zeros(len(word) + 1, np.int64)
                np.add.at(mark, firsts[row] + begin + q, 1)
                np.add.at(mark, firsts[row] + begin + length, -1)
                gone = np.cumsum(mark[:-1]) > 0
                texts = []
                for i, own in enumerate(rows):
                    drop = gone[firsts[i] : firsts[i + 1]]
                    texts.append(b" ".join([w for w, d in zip(own, drop.tolist(), strict=True) if not d] if drop.any() else own))
                cuts = np.searchsorted(row, np.arange(b - a + 1))
                body = pa.StructArray.from_arrays([pa.array(x) for x in (begin, length, q)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(firsts)), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), body), pa.array(texts, pa.binary()).cast(pa.string()), *(c.slice(a, b - a) for c in batch.columns[2:])],
                    ["doc_id", "n_words", "runs", "kept_text", *(["carried"] if carry else [])],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), *carried)
    more = f", carried {rows.schema['carried'].dataType.simpleString()}" if carry else ""
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept_text string" + more)


def digest(found: DataFrame) -> DataFrame:
    """What the query returns of ``periodic_runs``: counts, the longest run, and hashes."""
    order = "transform(runs, r -> struct(-r.length AS l, r.start AS start, r.period AS period))"
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    best = found.withColumn("best", F.expr(f"array_min({order})"))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.period").alias("period"),
        F.expr("(-best.l * 1000) div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept_text", 256).alias("collapsed_sha256"),
    )
