"""The tokens of ``text.tokens`` for a whole batch of texts at once, as numpy arrays inside a task."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .text import NO_WORD

#: Code points of Chinese characters.
HAN = 0x3400, 0x9FFF
#: Bits of a code point; of a letter in a packed word.
POINT, ASCII, PACKED = 21, 7, 8


@cache
def letters(spark: SparkSession) -> bytes:
    """A bit for each code point: whether the JVM takes it for part of a word. Asked there, since Python knows another version of Unicode."""
    rows = spark.range(0x110000).where("id < 55296 or id > 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    known = np.zeros(0x110000, bool)
    known[[r.id for r in rows.where(~F.concat(F.lit("a"), "c").rlike(NO_WORD) & (F.length("c") == 1)).select("id").collect()]] = True  # as many rows as Unicode has letters
    return np.packbits(known).tobytes()


@cache
def _known(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)


def points(whole: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(all texts in one, its code points, where each text begins and the last one ends)."""
    joined = "".join(whole)
    size = np.fromiter(map(len, whole), np.int64, len(whole))
    return joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(size)])


@dataclass
class Tokens:
    """row (of the text), code (into the distinct tokens), and where each distinct token stands first: joined[start:end]."""

    row: np.ndarray
    code: np.ndarray
    joined: str
    start: np.ndarray
    end: np.ndarray

    def names(self) -> list[str]:
        return [self.joined[a:b] for a, b in zip(self.start.tolist(), self.end.tolist(), strict=True)]


def cut(joined: str, cp: np.ndarray, first: np.ndarray, bits: bytes) -> Tokens:
    """Tokens of lower-cased texts, which begin at ``first``, in no order within a text: words, pairs of Chinese characters, single ones."""
    word = _known(bits)[cp]
    han = word & (cp >= HAN[0]) & (cp <= HAN[1])
    other = word & ~han
    open_ = np.ones(len(cp) + 1, bool)  # whether what stands before a place belongs to the same text
    open_[first] = False
    joins = open_[1:-1]
    begins, goes_on = han.copy(), np.zeros(len(cp), bool)
    goes_on[:-1] = han[:-1] & han[1:] & joins
    begins[1:] &= ~goes_on[:-1]
    pair, single = np.flatnonzero(goes_on), np.flatnonzero(begins & ~goes_on)
    inner = other[:-1] & other[1:] & joins
    starts, ends = other.copy(), other.copy()
    starts[1:] &= ~inner
    ends[:-1] &= ~inner
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    wide = cp.astype(np.int64)
    key = np.zeros(len(starts), np.int64)
    plain = np.concatenate([[0], np.cumsum(cp > 127)])
    short = (ends - starts <= PACKED) & (plain[ends] == plain[starts])
    for j in range(PACKED):
        at = np.flatnonzero(short & (ends - starts > j))
        key[at] |= wide[starts[at] + j] << ASCII * j
    key |= 1 << 62
    seen: dict[str, int] = {}
    for i in np.flatnonzero(~short).tolist():
        key[i] = 1 << 61 | seen.setdefault(joined[starts[i] : ends[i]], len(seen))
    keys = np.concatenate([wide[pair] << POINT | wide[np.minimum(pair + 1, len(cp) - 1)], wide[single] << POINT, key])
    start = np.concatenate([pair, single, starts])
    code, found = pd.factorize(keys)
    place = np.zeros(len(found), np.int64)
    place[code[::-1]] = np.arange(len(code))[::-1]
    end = np.concatenate([pair + 2, single + 1, ends])
    return Tokens(np.searchsorted(first, start, "right") - 1, code, joined, start[place], end[place])


def neighbours(texts: list[str], bits: bytes) -> np.ndarray:
    """``text.jaccard`` of the tokens of each text and the next one."""
    found = cut(*points([x.lower() for x in texts]), bits)
    n = len(texts)
    each = np.sort(found.code * n + found.row)  # by token, then by text
    each = each[np.diff(each, prepend=-1) != 0]
    row = each % n if n else each
    size = np.bincount(row, minlength=n)
    next_ = (np.diff(each) == 1) & (row[1:] > 0)  # the same token in the text behind
    both = np.bincount(row[:-1][next_], minlength=n)[: max(0, n - 1)]
    return np.where((size[:-1] == 0) | (size[1:] == 0), 0.0, both / np.maximum(size[:-1] + size[1:] - both, 1))
