"""Text functions as Column builders: they stay inside the JVM and compose with any plan.

Java patterns carry (?U) where digits, spaces and word characters are Unicode ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from . import patterns as P

#: What ends a word.
NO_WORD = r"[^\p{L}\p{N}]+"
#: A run of Chinese characters.
CJK = "([㐀-鿿]+)"
#: A Chinese character that is a letter: not the signs among them, nor those that Java doesn't know.
_HAN = r"[\x{3400}-\x{4DB5}\x{4E00}-\x{9FEF}[\x{4DB6}-\x{4DBF}\x{9FF0}-\x{9FFF}&&\p{L}]]"
#: One of them with the next; the last of several, which was in a pair; or a single one.
CJK_PAIR = f"({_HAN})(?=({_HAN}))|(?<={_HAN}){_HAN}|([\\x{{3400}}-\\x{{9FFF}}])"
#: White space of any kind: what (?U)\s matches.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Turns a text into an array of tokens, with repeats, in order.
Tokenizer = Callable[[Column], Column]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.trim(x, F.lit(SPACES))


def plain_tokens(x: Column) -> Column:
    """Lower-cased runs of letters and digits; text without spaces comes as one token."""
    return F.array_remove(F.split(F.lower(x), NO_WORD), "")


def tokens(x: Column) -> Column:
    """Lower-cased runs of letters and digits; of each run of Chinese characters, its overlapping pairs (a single one stays)."""
    return plain_tokens(F.when(x.rlike(CJK), F.regexp_replace(x, CJK_PAIR, " $1$2$3 ")).otherwise(x))


def token_set(x: Column, stop: list[str] | None = None, tokenize: Tokenizer = tokens) -> Column:
    found = F.array_distinct(tokenize(x))
    return F.array_except(found, F.array(*map(F.lit, stop))) if stop else found


def numbers(x: Column, pattern: str = P.NUMBER_SIGNED) -> Column:
    return F.regexp_extract_all(x, F.lit("(?U)" + pattern), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if either is empty."""
    share = lambda s: let(F.size(F.array_intersect(s["a"], s["b"])), lambda n: n / (F.size(s["a"]) + F.size(s["b"]) - n))
    ratio = lambda s: F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), F.lit(0.0)).otherwise(share(s))
    return let(F.struct(a.alias("a"), b.alias("b")), ratio)


def normalize(x: Column) -> Column:
    """For scoring: lower case, ends stripped, punctuation removed; inner white space stays."""
    return F.translate(strip(F.lower(x)), P.PUNCTUATION, "")


def characters(x: Column) -> Column:
    return F.filter(F.split(x, ""), lambda c: c != "")


def prf(common: Column, pred: Column, gold: Column) -> Column:
    """struct(precision, recall, f1) of sizes; both empty: 1, one empty: 0."""

    def score(s: Column) -> Column:
        p, r = s["c"] / s["p"], s["c"] / s["g"]
        full = F.struct(p.alias("precision"), r.alias("recall"), F.when(s["c"] == 0, 0.0).otherwise(2 * p * r / (p + r)).alias("f1"))
        flat = lambda v: F.struct(*(F.lit(v).alias(n) for n in ("precision", "recall", "f1")))
        return F.when((s["p"] == 0) & (s["g"] == 0), flat(1.0)).when((s["p"] == 0) | (s["g"] == 0), flat(0.0)).otherwise(full)

    return let(F.struct(common.alias("c"), pred.alias("p"), gold.alias("g")), score)


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda xs, v: F.size(F.filter(xs, lambda x: x == v))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, v: n + F.least(count(a, v), count(b, v)))


def char_f1(pred: Column, gold: Column) -> Column:
    return _bag_f1(characters(pred), characters(gold))


def word_f1(pred: Column, gold: Column, tokenize: Tokenizer = tokens) -> Column:
    return _bag_f1(tokenize(pred), tokenize(gold))


def _bag_f1(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: prf(bag_overlap(s["a"], s["b"]), F.size(s["a"]), F.size(s["b"])))


def _lcs(x: str, y: str) -> int:
    """Bit-parallel longest common subsequence: one whole-number step per character of y."""
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    v = full
    for c in y:
        u = v & where.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(x) - v.bit_count()


@F.pandas_udf(LongType())
def lcs_length(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Length of the longest common subsequence of two strings, whole texts; null counts as empty."""
    for a, b in batches:
        yield pd.Series([_lcs(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="int64")


def rouge_l(pred: Column, gold: Column) -> Column:
    return prf(lcs_length(pred, gold), F.length(pred), F.length(gold))


def number_f1(pred: Column, gold: Column) -> Column:
    """Set F1 over numbers of the raw texts; both without numbers: 1."""
    pair = F.struct(F.array_distinct(numbers(pred)).alias("a"), F.array_distinct(numbers(gold)).alias("b"))
    return let(pair, lambda s: prf(F.size(F.array_intersect(s["a"], s["b"])), F.size(s["a"]), F.size(s["b"]))["f1"])


def cosine(a: Column, b: Column) -> Column:
    """Of two numeric arrays, in doubles; 0 where a norm is 0."""
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)
