"""External induced suffix sorting, and byte-level deduplication on top of it.

A shard's suffixes are sorted as induced sorting does it. Suffixes that start a
rise (LMS) are named by the text up to the next of them; the string of names is
sorted by the same routine, level by level, until names are distinct or what is
left fits in memory; and the order of LMS suffixes induces that of all others.

Induction runs over priority queues of suffix tuples (position, prefix shared with
the tuple before). Their keys only ever grow (or fall), so a queue is a list of
ranges of symbols, each first in, first out. A range of one symbol streams through
memory in chunks; a range of several is sized to fit, and settled at once.

Nothing of a shard's size stays in memory: text, names, orders, marks and queues
are in files past a share of the budget. Sequences are read in chunks; single
positions of text and names are looked up through mapped pages, which are given
back after each chunk. The files have no names and go with the process.
"""

from __future__ import annotations

import itertools
import mmap
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_MIX, U, binary_column, longs, mix64, ranges, ship, slices, text_bytes
from .seeds import anchors, covered, gathered, group_starts, keyed, list_column, marked, nullable, own_spans, place_route, place_runs, repeated_anchors, sizes_of, span_column

SLICE = 1 << 20
#: Bytes of stretches that a task holds before it combines and sends them on.
HELD_BYTES = 16 << 20
#: The longest shared prefix that is told apart.
TOP = np.uint8(255)
#: Bytes of working memory for each name where names are sorted in memory.
NAME_BYTES = 64


class Scratch:
    """Space for one sort: arrays and logs of a sixteenth of the budget at most are in memory, larger ones in nameless files."""

    def __init__(self, budget: int):
        self.budget, self.share, self.maps = budget, budget >> 4, []

    @property
    def chunk(self) -> int:
        """Entries handled at a time: where files are mapped, each may touch a page of its own."""
        return max(256, min(1 << 20, self.budget >> 12)) if self.maps else 1 << 20

    def file(self):
        return tempfile.TemporaryFile(prefix="suffix-")

    def map(self, file, n: int, kind) -> np.ndarray:
        found = np.memmap(file, kind, "r+", shape=(n,))
        self.maps.append(found)
        return found.view(np.ndarray)

    def array(self, n: int, kind) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if size <= self.share:
            return np.zeros(n, kind)
        file = self.file()
        file.truncate(size)
        return self.map(file, n, kind)

    def relax(self) -> None:
        """Give back the pages of mapped files; what they hold stays in the files."""
        for m in self.maps:
            m._mmap.madvise(mmap.MADV_DONTNEED)

    def pieces(self, n: int) -> Iterator[tuple[int, int]]:
        a = 0
        while a < n:
            b = min(n, a + self.chunk)
            yield a, b
            self.relax()
            a = b


class Log:
    """Numbers that are added at the end, and read as an array when complete."""

    def __init__(self, scratch: Scratch, kind):
        self.scratch, self.kind, self.n, self.parts, self.file = scratch, np.dtype(kind), 0, [], None

    def add(self, values: np.ndarray) -> None:
        if not len(values):
            return
        values = np.ascontiguousarray(values, self.kind)
        self.n += len(values)
        self.parts.append(values)
        if self.file is None and self.n * self.kind.itemsize > self.scratch.share:
            self.file = self.scratch.file()
        if self.file is not None:
            for part in self.parts:
                self.file.write(memoryview(part).cast("B"))
            self.parts = []

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts) if self.parts else np.zeros(0, self.kind)
        self.file.flush()
        return self.scratch.map(self.file, self.n, self.kind)


class Queues:
    """Tuples (position, shared prefix) by range of symbols, first in, first out; past a share of the budget chunks go to a file."""

    def __init__(self, n: int, scratch: Scratch):
        self.scratch, self.limit, self.used, self.file, self.end = scratch, scratch.budget >> 3, 0, None, 0
        self.chunks: list[list] = [[] for _ in range(n)]

    def put(self, key: int, positions: np.ndarray, shared: np.ndarray) -> None:
        if not len(positions):
            return
        size = positions.nbytes + shared.nbytes
        if self.used + size > self.limit:
            self.file = self.file or self.scratch.file()
            self.file.seek(self.end)
            self.file.write(np.ascontiguousarray(positions).tobytes() + np.ascontiguousarray(shared).tobytes())
            self.chunks[key].append((self.end, len(positions)))
            self.end += size
        else:
            self.used += size
            self.chunks[key].append((positions, shared))

    def deal(self, keys: np.ndarray, positions: np.ndarray, shared: np.ndarray) -> None:
        """Put each tuple under its key, in order."""
        order = np.argsort(keys, kind="stable")
        starts = group_starts(keys[order])
        positions, shared = positions[order], shared[order]
        for s, m in zip(starts.tolist(), sizes_of(starts, len(order)).tolist(), strict=True):
            self.put(int(keys[order[s]]), positions[s : s + m], shared[s : s + m])

    def take(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Remove and yield what is queued now, small chunks joined; tuples that arrive meanwhile stay for the next call."""
        now, self.chunks[key] = self.chunks[key], []
        held, size = [], 0
        for first, second in now:
            if isinstance(first, int):
                self.file.seek(first)
                chunk = np.frombuffer(self.file.read(8 * second), np.int64), np.frombuffer(self.file.read(second), np.uint8)
            else:
                chunk = first, second
                self.used -= first.nbytes + second.nbytes
            held.append(chunk)
            size += len(chunk[0])
            if size >= self.scratch.chunk:
                yield self._join(held)
                held, size = [], 0
        if held:
            yield self._join(held)

    def take_all(self, key: int) -> np.ndarray:
        """The positions of one range, which fits in memory."""
        return np.concatenate([np.zeros(0, np.int64), *(p for p, _ in self.take(key))])

    @staticmethod
    def _join(held: list) -> tuple[np.ndarray, np.ndarray]:
        return held[0] if len(held) == 1 else (np.concatenate([p for p, _ in held]), np.concatenate([s for _, s in held]))

    def take_backwards(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Like ``take``, last tuple first."""
        parts: list[list] = [[]]
        size = 0
        for chunk in reversed(self.chunks[key]):
            parts[-1].append(chunk)
            size += chunk[1] if isinstance(chunk[0], int) else len(chunk[0])
            if size >= self.scratch.chunk:
                parts.append([])
                size = 0
        for part in parts:
            self.chunks[key] = part[::-1]
            for positions, own in reversed(list(self.take(key))):
                yield positions[::-1], own[::-1]


class BytePrefixes:
    """Lengths of common prefixes of suffixes of bytes, eight a step."""

    def __init__(self, padded: np.ndarray, n: int):
        self.n = n
        self.words = np.ndarray((n + 8,), ">u8", padded, strides=(1,))  # overlapping views: eight bytes from each place

    def shared(self, a: np.ndarray, b: np.ndarray, most: int | np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a[i] and b[i], at most ``most``."""
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        room = np.minimum(self.n - np.maximum(a, b), most)
        done = 0
        while len(live):
            x = (self.words[a[live] + done] ^ self.words[b[live] + done]).astype(np.uint64)
            same = x == 0
            stop = live[~same]
            out[stop] = np.minimum(done + _zero_bytes(x[~same]), room[stop])
            live, done = live[same], done + 8
            end = room[live] <= done
            out[live[end]] = room[live[end]]
            live = live[~end]
        return out


def _zero_bytes(x: np.ndarray) -> np.ndarray:
    """Zero bytes before the first other one of nonzero words."""
    n = np.zeros(len(x), np.int64)
    for shift in (32, 16, 8):
        zero = x >> U(64 - shift) == 0
        n += zero * (shift // 8)
        x = np.where(zero, x << U(shift), x)
    return n


class NamePrefixes:
    """The same for suffixes of names, one a step."""

    def __init__(self, text: np.ndarray, n: int):
        self.text, self.n = text, n

    def shared(self, a: np.ndarray, b: np.ndarray, most: int | np.ndarray) -> np.ndarray:
        room = np.minimum(self.n - np.maximum(a, b), most)
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(room > 0)
        while len(live):
            live = live[self.text[a[live] + out[live]] == self.text[b[live] + out[live]]]
            out[live] += 1
            live = live[out[live] < room[live]]
        return out


@dataclass
class Level:
    """A string of the recursion: symbols, and the ranges of symbols (first of each; whether it is alone) that queues go by."""

    text: np.ndarray
    n: int
    cuts: np.ndarray
    lone: np.ndarray
    prefixes: BytePrefixes | NamePrefixes
    scratch: Scratch
    bits: np.ndarray = field(default=None)
    before: np.ndarray = field(default=None)

    def range_of(self, symbols: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, symbols, "right") - 1 if self.text.dtype != np.uint8 else symbols.astype(np.int16)

    def mark_lms(self) -> np.ndarray:
        """Positions of LMS suffixes, in the order of the text; their marks and counts stay at hand for ``number``."""
        n, scratch = self.n, self.scratch
        self.bits = scratch.array(n // 64 + 2, np.uint64)
        self.before = scratch.array(n // 64 + 2, np.int64)
        raw = self.bits.view(np.uint8)
        block = -(-scratch.chunk // 64) * 64
        later = False  # whether the suffix after the block is smaller than the next one
        for a in range((n - 1) // block * block, -1, -block):
            b, lo = min(a + block, n), max(a - 1, 0)
            part = np.append(self.text[lo:b], self.text[b : b + 1] if b < n else self.text[b - 1 : b])
            differs = part[:-1] != part[1:]
            if b == n:
                differs[-1] = True  # the end counts as smaller than any symbol
            at = np.where(differs, np.arange(b - lo), b - lo)
            at = np.minimum.accumulate(at[::-1])[::-1]
            up = np.append(part[:-1] < part[1:], later)[at]
            later = bool(up[a - lo])
            mark = np.zeros(b - a, bool)
            mark[lo + 1 - a :] = up[1:] & ~up[:-1]
            packed = np.packbits(mark, bitorder="little")
            raw[a // 8 : a // 8 + len(packed)] = packed
            scratch.relax()
        found, total = Log(scratch, np.int64), 0
        for a in range(0, n, block):
            mine = slice(a // 64, min(a + block, n) // 64 + 1)
            upto = np.cumsum(np.bitwise_count(self.bits[mine]).astype(np.int64))
            self.before[mine] = total + np.append(0, upto[:-1])
            here = np.flatnonzero(np.unpackbits(raw[a // 8 : min(a + block, n) // 8 + 1], bitorder="little")[: min(block, n - a)])
            found.add(a + here)
            total += len(here)
            scratch.relax()
        return found.array()

    def is_lms(self, positions: np.ndarray) -> np.ndarray:
        return (self.bits[positions >> 6] >> (positions & 63).astype(np.uint64) & U(1)).astype(bool)

    def number(self, positions: np.ndarray) -> np.ndarray:
        """LMS positions before each of ``positions``."""
        below = (U(1) << (positions & 63).astype(np.uint64)) - U(1)
        return self.before[positions >> 6] + np.bitwise_count(self.bits[positions >> 6] & below)


def _preceding(level: Level, positions: np.ndarray) -> np.ndarray:
    """The symbol before each position; before position 0 is none, which callers rule out."""
    return level.text[np.maximum(positions - 1, 0)]


def _induced(level: Level, queues: Queues, seen: np.ndarray, shared: np.ndarray, positions: np.ndarray, symbol: np.ndarray, pending: np.ndarray, carry: bool, take: np.ndarray) -> None:
    """Queue the predecessors, which ``symbol`` starts, of those of a run of sorted suffixes that ``take`` selects.

    ``shared[i]`` is the prefix suffix i shares with the one scanned before it;
    ``pending[c]`` the least of these since the last predecessor that starts with c.
    """
    at = np.flatnonzero(take)
    key = level.range_of(symbol[at])
    order = np.argsort(key, kind="stable")  # a radix sort for bytes
    at, key = at[order], key[order]
    before = positions[at] - 1
    starts = group_starts(key)
    low = np.zeros(len(at), np.uint8)
    if carry:
        whole = shared.min() if len(shared) else TOP
        if len(at):
            fresh = np.zeros(len(at), bool)
            fresh[starts] = True
            later = np.flatnonzero(~fresh)
            if len(later):
                pairs = np.stack([at[later - 1] + 1, at[later] + 1], axis=1).ravel()
                low[later] = np.minimum.reduceat(np.append(shared, TOP), pairs)[::2]
            low[starts] = np.minimum(pending[key[starts]], np.minimum.accumulate(shared)[at[starts]])
        np.minimum(pending, whole, out=pending)
        if len(at):
            tails = np.append(starts[1:], len(at)) - 1
            after = np.append(np.minimum.accumulate(shared[::-1])[::-1], TOP)
            pending[key[tails]] = after[at[tails] + 1]
        low += low < TOP
    for s, m in zip(starts.tolist(), sizes_of(starts, len(at)).tolist(), strict=True):
        c = int(key[s])
        if not seen[c]:
            low[s] = 0  # the first of its range shares nothing with what stands before
            seen[c] = True
        queues.put(c, before[s : s + m], low[s : s + m])


def settled(level: Level, r: int, sign: int, own: np.ndarray, fixed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of one range of several symbols in scanning order, and which of them are of the induced type.

    ``own`` are those induced so far, in order of arrival; ``fixed`` those of the
    other type, in order. Within a symbol the former come first. Suffixes that
    the range induces within itself follow the order of the suffix behind them,
    which is found by pointer doubling along these links.
    """
    pos = [np.concatenate([own, fixed])]
    kind = [np.repeat([0, 2], [len(own), len(fixed)])]
    link = [np.arange(len(pos[0]))]
    front, mine, total = pos[0], kind[0] == 0, len(pos[0])
    base = 0
    while len(front):
        before = _preceding(level, front)
        here, next_ = sign * level.text[front], sign * before
        go = np.flatnonzero((front > 0) & ((next_ > here) | ((next_ == here) & mine)) & (level.range_of(before) == r))
        pos.append(front[go] - 1)
        kind.append(np.ones(len(go), np.int64))
        link.append(base + go)
        base, total = total, total + len(go)
        front, mine = pos[-1], np.ones(len(go), bool)
    pos, kind, link = map(np.concatenate, (pos, kind, link))
    place = np.where(kind == 1, 0, np.arange(total))
    order = np.lexsort((place, kind, sign * level.text[pos]))
    fresh = np.ones(total, np.int64)
    symbol = level.text[pos[order]]
    fresh[1:] = (symbol[1:] != symbol[:-1]) | (kind[order][1:] != 1) | (kind[order][:-1] != 1)
    rank = np.zeros(total, np.int64)
    rank[order] = np.cumsum(fresh) - 1
    link = np.where(kind == 1, link, np.arange(total))
    while total and rank.max() < total - 1:
        rank = np.unique(rank * total + rank[link], return_inverse=True)[1]
        link = link[link]
    order = np.argsort(rank)
    return pos[order], kind[order] < 2


def induce(level: Level, ups: Queues, carry: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sort all suffixes from LMS suffixes in order (and their shared prefixes), queued by range in ``ups``.

    Yields (positions, shared) in descending order; shared[i] belongs to position
    i and the one before it in the stream (the next larger). Without ``carry`` it is zero.
    """
    text, scratch, count = level.text, level.scratch, len(level.cuts)
    queues, done, rises = (Queues(count, scratch) for _ in range(3))

    def scan(out: Queues, positions: np.ndarray, own: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray]) -> None:
        symbol = _preceding(level, positions)
        _induced(level, out, seen, own, positions, symbol, pending, carry, (positions > 0) & wanted(symbol))
        scratch.relax()

    def spread(out: Queues, r: int, sign: int, positions: np.ndarray, mine: np.ndarray) -> None:
        symbol = _preceding(level, positions)
        here, next_ = sign * text[positions], sign * symbol
        go = np.flatnonzero((positions > 0) & ((next_ > here) | ((next_ == here) & mine)) & (level.range_of(symbol) != r))
        out.deal(level.range_of(symbol[go]), positions[go] - 1, np.zeros(len(go), np.uint8))
        scratch.relax()

    seen, pending = np.zeros(count, bool), np.full(count, TOP)
    last = int(level.range_of(text[level.n - 1 : level.n])[0])
    queues.put(last, np.array([level.n - 1]), np.zeros(1, np.uint8))
    seen[last] = True
    for r in range(count):
        if not level.lone[r]:
            positions, mine = settled(level, r, 1, queues.take_all(r), ups.take_all(r))
            done.put(r, positions[mine], np.zeros(int(mine.sum()), np.uint8))
            spread(queues, r, 1, positions, mine)
            continue
        c, tail = level.cuts[r], None
        while queues.chunks[r]:
            for positions, own in queues.take(r):
                done.put(r, positions, own)
                tail = positions[-1:]
                scan(queues, positions, own, lambda s: s >= c)  # noqa: B023
        first = True
        for positions, own in ups.take(r):
            if carry and first:
                own = own.copy()  # noqa: PLW2901
                own[0] = 0 if tail is None else level.prefixes.shared(tail, positions[:1], 255)[0]
            first = False
            scan(queues, positions, own, lambda s: s > c)  # noqa: B023
    seen, pending = np.zeros(count, bool), np.full(count, TOP)
    for r in range(count - 1, -1, -1):
        if not level.lone[r]:
            positions, mine = settled(level, r, -1, rises.take_all(r), done.take_all(r)[::-1])
            yield positions, np.zeros(len(positions), np.uint8)
            spread(rises, r, -1, positions, mine)
            continue
        c, tail = level.cuts[r], None
        while rises.chunks[r]:
            for positions, own in rises.take(r):
                tail = positions[-1:]
                yield positions, own
                scan(rises, positions, own, lambda s: s <= c)  # noqa: B023
        for positions, own in _falling(done, r, level, tail, carry):
            yield positions, own
            scan(rises, positions, own, lambda s: s < c)  # noqa: B023


def _falling(done: Queues, r: int, level: Level, tail: np.ndarray | None, carry: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A range's falling suffixes, largest first; shared prefixes move to the neighbour now met before."""
    link = None
    for positions, own in done.take_backwards(r):
        if link is None:
            link = int(level.prefixes.shared(tail, positions[:1], 255)[0]) if carry and tail is not None else 0
        moved = np.concatenate([[link], own[:-1]]).astype(np.uint8)
        link = int(own[-1])
        yield positions, moved


def _named(level: Level, lms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names of LMS substrings in the order of the text, how often each name occurs), by an induction of their own."""
    scratch, m = level.scratch, len(lms)
    ups = Queues(len(level.cuts), scratch)
    for a, b in scratch.pieces(m):
        ups.deal(level.range_of(level.text[lms[a:b]]), lms[a:b].copy(), np.zeros(b - a, np.uint8))
    names, sizes = scratch.array(m, np.int64), Log(scratch, np.int64)
    last, name, run = None, -1, 0
    for positions, _ in induce(level, ups, False):
        found = positions[level.is_lms(positions)]
        if not len(found):
            continue
        chain = found if last is None else np.concatenate([last, found])
        which = level.number(chain)
        length = np.where(which + 1 < m, lms[np.minimum(which + 1, m - 1)], level.n - 1) - chain + 1
        same = (length[1:] == length[:-1]) & (which[1:] < m - 1) & (which[:-1] < m - 1)  # the last one ends with the text and is alone
        close = np.flatnonzero(same)
        same[close] = level.prefixes.shared(chain[close], chain[close + 1], length[close]) >= length[close]
        fresh = np.concatenate([[True], ~same]) if last is None else ~same
        names[which[-len(found) :]] = name + np.cumsum(fresh)
        name += int(fresh.sum())
        at = np.flatnonzero(fresh)
        if len(at):
            ends = np.diff(np.append(at, len(found)))
            sizes.add(np.concatenate([np.array([] if last is None else [run + at[0]], np.int64), ends[:-1]]))
            run = int(ends[-1])
        else:
            run += len(found)
        last = found[-1:]
        scratch.relax()
    sizes.add(np.array([run]))
    for a, b in scratch.pieces(m):  # they were found from the largest down
        names[a:b] = name - names[a:b]
    return names, sizes.array()[::-1]


def _ranges(sizes: np.ndarray, limit: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """(first name of each range, whether it is the only one): as many names as ``limit`` occurrences allow, or one."""
    cuts, have = [0], 0
    for a, b in scratch.pieces(len(sizes)):
        upto, i = np.concatenate([[0], np.cumsum(sizes[a:b])]), 0
        while i < b - a:
            j = int(np.searchsorted(upto, upto[i] + limit - have, "right")) - 1  # names i to j - 1 still fit
            if j >= b - a:
                have += int(upto[-1] - upto[i])
                break
            j += j == i and not have
            cuts.append(a + j)
            i, have = j, 0
    cuts = np.unique([c for c in cuts if c < len(sizes)])
    return cuts, np.diff(np.append(cuts, len(sizes))) == 1


def sorted_lms(level: Level, most: int) -> np.ndarray:
    """LMS suffixes in order; in memory they are told apart by their first ``most`` bytes alone."""
    scratch = level.scratch
    lms = level.mark_lms()
    m = len(lms)
    if not m:
        return lms
    names, sizes = _named(level, lms)
    order = scratch.array(m, np.int64)
    if len(sizes) == m:
        for a, b in scratch.pieces(m):
            order[names[a:b]] = lms[a:b]
    elif m * NAME_BYTES <= scratch.budget:
        order[:] = lms[np.argsort(by_doubling(names, most), kind="stable")]
    else:
        cuts, lone = _ranges(sizes, max(16, scratch.budget >> 8), scratch)
        end = m
        for positions, _ in sorted_suffixes(Level(names, m, cuts, lone, NamePrefixes(names, m), scratch), most, False):
            for a in range(0, len(positions), scratch.chunk):
                part = positions[a : a + scratch.chunk]
                order[end - len(part) : end] = lms[part][::-1]
                end -= len(part)
                scratch.relax()
    return order


def by_doubling(rank: np.ndarray, most: int) -> np.ndarray:
    """Ranks of the suffixes of a string of names in memory, by 1, 2, 4, ... names until all differ or ``most`` bytes are compared.

    A rank is the number of smaller suffixes, so that a round only touches what
    is still tied. A name stands for two bytes at least.
    """
    span, n = 1, len(rank)
    crowd = np.bincount(rank)
    rank = (np.cumsum(crowd) - crowd)[rank]
    tied = np.flatnonzero(crowd[crowd > 0].repeat(crowd[crowd > 0])[rank] > 1)
    while len(tied) and 2 * span <= most + 2:
        after = tied + span
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[tied].astype(np.uint64) << U(32) | second.astype(np.uint64)
        order = np.argsort(key)
        key, tied = key[order], tied[order]
        group, new = group_starts(key >> U(32)), group_starts(key)
        size = sizes_of(new, len(key))
        offset = new - np.repeat(group, np.diff(np.append(np.searchsorted(new, group), len(new))))
        rank[tied] = rank[tied] + np.repeat(offset, size)
        tied = tied[np.repeat(size > 1, size)]
        span *= 2
    return rank


def sorted_suffixes(level: Level, most: int, carry: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of a level, as ``induce`` yields them."""
    order = sorted_lms(level, most)
    ups = Queues(len(level.cuts), level.scratch)
    last = order[:1]
    for a, b in level.scratch.pieces(len(order)):
        part = order[a:b].copy()
        shared = level.prefixes.shared(part, np.append(last, part[:-1]), most).astype(np.uint8) if carry else np.zeros(b - a, np.uint8)
        if not a:
            shared[:1] = 0
        ups.deal(level.range_of(level.text[part]), part, shared)
        last = part[-1:]
    yield from induce(level, ups, carry)


def byte_level(padded: np.ndarray, n: int, scratch: Scratch) -> Level:
    """The bytes of a shard, with 16 zeros behind them."""
    return Level(padded, n, np.arange(256), np.ones(256, bool), BytePrefixes(padded, n), scratch)


def suffixes(text: np.ndarray, most: int = 255, budget: int = 1 << 28) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes of ``text`` from the largest down, in chunks: (positions, prefix shared with the one before).

    Shared prefixes count to ``most`` (255 at the highest); suffixes alike for
    that long come in any order.
    """
    if most > 255:
        raise ValueError("shared prefixes are kept in a byte")
    if len(text):
        scratch = Scratch(budget)
        log = Log(scratch, np.uint8)
        log.add(text)
        log.add(np.zeros(16, np.uint8))
        yield from sorted_suffixes(byte_level(log.array(), len(text), scratch), most, True)


class Shard:
    """Stretches of bytes, and which windows of them occur twice; ``weight`` says how often a stretch stands."""

    def __init__(self, budget: int, span: int):
        self.scratch, self.span = Scratch(budget), span
        self.text, self.weight, self.n = Log(self.scratch, np.uint8), Log(self.scratch, np.uint8), 0

    def add(self, stretches: list[bytes], weight: np.ndarray) -> np.ndarray:
        """Where each stretch begins; equal ones of one call become one."""
        seen: dict[bytes, int] = {}
        code = np.fromiter((seen.setdefault(x, len(seen)) for x in stretches), np.int64, len(stretches))
        total = np.minimum(np.bincount(code, weight, len(seen)), 2).astype(np.uint8)
        size = np.fromiter(map(len, seen), np.int64, len(seen))
        first = self.n + np.concatenate([[0], np.cumsum(size)])
        self.text.add(np.frombuffer(b"".join(seen), np.uint8))
        place = ranges(np.zeros(len(size), np.int64), size)
        self.weight.add(np.where(place <= np.repeat(size, size) - self.span, np.repeat(total, size), 0))
        self.n = int(first[-1])
        return first[code]

    def repeated(self) -> np.ndarray:
        """Marks window starts whose bytes have a total weight of two or more."""
        scratch, n = self.scratch, self.n
        self.text.add(np.zeros(16, np.uint8))
        padded, weights = self.text.array(), self.weight.array()
        out = scratch.array(n, np.bool_)
        lone, total = np.zeros(0, np.int64), 0  # the run of equal windows that is still open: its weight, and its start while that is one
        for positions, own in sorted_suffixes(byte_level(padded, n, scratch), self.span, True) if n else ():
            weight = weights[positions].astype(np.int64)
            run = np.cumsum(own < self.span)  # 0: goes on with the open run
            use = np.flatnonzero(weight)
            last = int(run[-1])
            sums = np.bincount(run[use], weight[use], last + 1).astype(np.int64)
            sums[0] += total
            if sums[0] > 1:
                out[lone] = True
            elif last:
                lone = lone[:0]
            out[positions[use[sums[run[use]] > 1]]] = True
            open_ = positions[use[run[use] == last]]
            total = int(sums[last])
            lone = np.zeros(0, np.int64) if total > 1 else (open_ if last else np.concatenate([lone, open_]))
            scratch.relax()
        return out


_POWER: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BASE = U(0xD1342543DE82EF95)
BACK = U(pow(0xD1342543DE82EF95, -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i modulo 2^64."""
    size = 1 << max(n, 1).bit_length()
    if size not in _POWER:
        _POWER.clear()
        _POWER[size] = np.cumprod(np.full(size, BASE)), np.cumprod(np.full(size, BACK))
    return _POWER[size]


def rolling(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a polynomial hash, and the powers that move a difference to the origin."""
    forth, back = _powers(len(data))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_MIX[data] * forth[: len(data)])]), back


def remove_repeats(docs: DataFrame, span: int = 200, k: int = 32, budget: int = 1 << 28) -> DataFrame:
    """Remove every byte that a string of ``span`` bytes covers which also starts anywhere else.

    Returns doc_id, n_bytes, n_removed, n_spans, kept (binary) and spans (runs of
    repeated window starts: start, n). Texts count as UTF-8, null as empty;
    matches never cross documents; strings are judged on the input. Every row is
    a document: rows with a null id and rows of one id and different texts each
    have their own spans, and repeated rows are removed alike, since each repeats
    the other. An empty table gives none.

    Documents are cut into shards at winnowed anchors: equal strings have equal
    anchors and meet in one shard, and only stretches around anchors that occur
    twice are sent. Copies of a stretch within a task become one with a weight.
    All suffixes of a shard are sorted by induction within ``budget`` bytes of
    memory; suffixes that share ``span`` bytes are a repeat if their weights sum to two.
    An anchor's stretches arrive together: where all are alike none is sorted.
    """
    ship(docs.sparkSession)
    dealt = keyed(docs)

    def anchored(data: np.ndarray, offsets: np.ndarray):
        sums, back = rolling(data)
        n = max(0, len(data) - k + 1)
        grams = mix64((sums[k : k + n] - sums[:n]) * back[:n])
        return grams, anchors(grams, offsets, k, span)

    def find(data: np.ndarray, offsets: np.ndarray):
        grams, (row, at, _, _) = anchored(data, offsets)
        return row, grams[at], at - offsets[row]

    def emit(held: list) -> pa.RecordBatch:
        key, doc, nul, start, n, route = (np.concatenate([h[i] for h in held]) for i in range(6))
        seen: dict[bytes, int] = {}
        code = np.fromiter((seen.setdefault(x, len(seen)) for h in held for x in h[6]), np.int64, len(key))
        order = np.argsort(code, kind="stable")
        starts = group_starts(code[order])
        many = sizes_of(starts, len(order))
        one, weight = order[starts], np.minimum(many, 2)
        twins = order[np.repeat(many > 1, many)]
        gone_key, gone_doc, gone_start, gone_n = place_runs(key, doc, nul, start, twins, start[twins], n[twins])
        none = np.zeros(len(gone_key), np.int64)
        columns = [(route[one], place_route(gone_key, gone_start)), (key[one], gone_key), (start[one], gone_start), (n[one], gone_n), (weight, none)]
        route_, key_, start_, n_, weight_ = (pa.array(np.concatenate(c)) for c in columns)
        stretch = pa.concat_arrays([pa.array(list(seen), pa.binary()), pa.nulls(len(none), pa.binary())])
        return pa.RecordBatch.from_arrays([route_, key_, pa.concat_arrays([pa.array(doc[one], mask=nul[one]), gone_doc]), start_, n_, weight_, stretch], ["route", "row", "doc_id", "start", "n", "weight", "stretch"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys = longs(batch, "row")
            docs_, nulls = nullable(batch.column(1))
            data, offsets = text_bytes(batch.column(2))
            places, upto = list_column(batch.column("places"))
            for a, b in slices(offsets, SLICE):
                part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                if upto[a] == upto[b]:
                    continue
                grams, (row, at, first, count) = anchored(part, cuts)
                use = np.flatnonzero(marked(places, upto, cuts, a, b)[at]) if len(at) else at
                if not len(use):
                    continue
                first, count, whose = first[use], count[use], a + row[use]
                raw = part.tobytes()
                stretch = [raw[p:q] for p, q in zip(first.tolist(), (first + count + span - 1).tolist(), strict=True)]
                held.append((keys[whose], docs_[whose], nulls[whose], first - cuts[row[use]], count, grams[at[use]].view(np.int64), stretch))
                size += int(count.sum()) + len(use) * (span - 1)
                if size >= HELD_BYTES:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "start", "n"]
        shard, held, size = Shard(budget, span), [], 0
        kept: list[Log] = []  # a column each, for all stretches of the shard
        ends = [0]
        split: int | None = None  # an anchor whose stretches didn't fit into what is held at a time

        def settle(last: bool) -> tuple[list[pa.RecordBatch], pa.Table]:
            """Move what is held into the shard, but for its last anchor, which may go on: (what needs no sorting, what is left).

            Windows repeat each other within one anchor's stretches only. Where these
            are all alike, they are repeats or not by their number, and aren't sorted.
            """
            nonlocal split
            found = pa.Table.from_batches(held)
            real = longs(found, "weight") > 0
            out = found.filter(pa.array(~real)).select(names).combine_chunks().to_batches()
            found = found.filter(pa.array(real)).combine_chunks()
            route = longs(found, "route")
            left = found.slice(0, 0)
            if len(route) and not last:
                if route[0] == route[-1]:
                    split = int(route[-1])
                else:
                    whole = int(np.flatnonzero(route != route[-1])[-1]) + 1
                    found, left, route = found.slice(0, whole), found.slice(whole), route[:whole]
            if not len(route):
                return out, left
            code = pc.dictionary_encode(found["stretch"].combine_chunks()).indices.to_numpy()
            starts = group_starts(route)
            many = sizes_of(starts, len(route))
            alike = np.minimum.reduceat(code, starts) == np.maximum.reduceat(code, starts)
            if split is not None:
                alike &= route[starts] != split
            weight = np.add.reduceat(longs(found, "weight"), starts)
            twins = np.flatnonzero(np.repeat(alike & (weight > 1), many))
            if len(twins):
                doc, nul = nullable(found["doc_id"])
                gone = place_runs(longs(found, "row"), doc, nul, longs(found, "start"), twins, longs(found, "start")[twins], longs(found, "n")[twins])
                out.append(pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in gone], names))
            open_ = found.filter(pa.array(~np.repeat(alike, many))).combine_chunks()
            if open_.num_rows:
                first = shard.add(open_["stretch"].to_pylist(), longs(open_, "weight"))
                doc, nul = nullable(open_["doc_id"])
                columns = (longs(open_, "row"), doc, nul, longs(open_, "start"), longs(open_, "n"), first)
                if not kept:
                    kept.extend(Log(shard.scratch, values.dtype) for values in columns)
                for log, values in zip(kept, columns, strict=True):
                    log.add(values)
                ends.append(ends[-1] + open_.num_rows)
            return out, left

        def rest(a: int, b: int) -> pa.RecordBatch:
            key, doc, nul, start, n, first = (np.array(column[a:b]) for column in columns)
            rows = np.repeat(np.arange(len(key)), n)
            hit = np.flatnonzero(mark[ranges(first, n)])
            found = place_runs(key, doc, nul, start, rows[hit], ranges(start, n)[hit])
            shard.scratch.relax()
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in found], names)

        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= budget >> 3:
                out, left = settle(False)
                yield from out
                held, size = left.to_batches(), left.nbytes
        if held:
            yield from settle(True)[0]
        held = []
        mark = shard.repeated()
        columns = [log.array() for log in kept]
        for a, b in itertools.pairwise(ends):
            yield rest(a, b)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            spans = own_spans(batch)
            for a, b in slices(offsets, SLICE):
                part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                gone = covered(spans, cuts, span, a, b)
                lost = np.concatenate([[0], np.cumsum(gone)])[cuts]
                before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
                before[cuts[:-1][cuts[:-1] < len(gone)]] = False
                opens = np.concatenate([[0], np.cumsum(gone & ~before)])[cuts]
                kept = binary_column(part[~gone], cuts - lost)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), pa.array(np.diff(cuts)), pa.array(np.diff(lost)), pa.array(np.diff(opens)), kept, span_column(spans, a, b)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    places = repeated_anchors(dealt, find, SLICE).hint("shuffle_hash")
    form = "route long, row long, doc_id long, start long, n long, weight long, stretch binary"
    gone = dealt.join(places, "row", "left").mapInArrow(send, form).repartition("route").sortWithinPartitions("route").mapInArrow(sort, "row long, doc_id long, start long, n long")
    return dealt.join(gathered(gone), "row", "left").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,n:long>>")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS c FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS i FROM d)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY c) AS n FROM w) WHERE n > 1
), run AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS fresh FROM hit)
), gone AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM run GROUP BY doc_id, g
), cuts AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS s, a AS e FROM gone
  UNION ALL SELECT doc_id, max(b), (SELECT length(h) // 2 FROM d WHERE d.doc_id = gone.doc_id) FROM gone GROUP BY doc_id
), kept AS (
  SELECT c.doc_id, string_agg(substr(h, 2 * s + 1, 2 * (e - s)), '' ORDER BY s) AS h FROM cuts c JOIN d USING (doc_id) GROUP BY c.doc_id
), lost AS (
  SELECT doc_id, sum(b - a) AS n, count(*) AS spans FROM gone GROUP BY doc_id
)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(l.n, 0)::BIGINT AS n_removed, coalesce(l.spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN lost l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""
