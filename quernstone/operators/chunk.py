"""Chunking: pages with their tables, and semantic groups of sentences with overlap."""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from ..functions import patterns as P
from ..functions.batches import letters, neighbours
from ..functions.text import SPACES, Tokenizer, cosine, jaccard, let, strip, token_set, tokens
from ..plugins import Encoder
from ..session import ship

PAGE = ["filename", "page"]
#: Characters of a page whose sentences are not held all at once.
LONG_PAGE = 1 << 20


def _table_chunks(pages: DataFrame) -> DataFrame:
    rows = pages.select(*PAGE, F.posexplode("tables").alias("i", "content")).where(strip(F.col("content")) != "")
    return rows.select(F.concat_ws("", "filename", F.lit("_p"), "page", F.lit("_table"), "i").alias("chunk_id"), *PAGE, F.lit("table").alias("type"), strip(F.col("content")).alias("content"))


def page_chunks(pages: DataFrame) -> DataFrame:
    """(chunk_id, filename, page, type, content): a page's text without its tables, and each table.

    The text needs more than 10 characters. Tables are numbered with blank ones
    counted, and removed from the text wherever they occur, one after another.
    """
    bare = strip(F.aggregate("tables", F.col("text"), lambda t, x: F.when(x == "", t).otherwise(F.replace(t, x, F.lit("")))))
    text = pages.select(*PAGE, bare.alias("content")).where(F.length("content") > 10)
    text = text.select(F.concat_ws("", "filename", F.lit("_p"), "page", F.lit("_text")).alias("chunk_id"), *PAGE, F.lit("text").alias("type"), "content")
    return text.unionByName(_table_chunks(pages))


def sentences_of(text: Column) -> Column:
    """Sentences, cut after Chinese stops and at newlines, stripped, longer than two characters."""
    for stop in "。！？；":
        text = F.replace(text, F.lit(stop), F.lit(stop + "\n"))
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda s: F.length(s) > 2)


def sentences(pages: DataFrame) -> DataFrame:
    """(filename, page, idx, sentence)."""
    return pages.select(*PAGE, F.posexplode(sentences_of(F.col("text"))).alias("idx", "sentence")).withColumn("idx", F.col("idx").cast("long"))


def similarity(a: Column, b: Column, vector: bool = False, tokenize: Tokenizer = tokens) -> Column:
    """Of two sentences: overlap of their token sets, or cosine of their vectors."""
    return cosine(a, b) if vector else jaccard(token_set(a, None, tokenize), token_set(b, None, tokenize))


def _features(sents: DataFrame, encoder: Encoder | None, tokenize: Tokenizer) -> DataFrame:
    """``sents`` with what sentences are compared by, once a sentence: token sets, or vectors of an encoder."""
    if encoder is None:
        return sents.withColumn("feature", token_set(F.col("sentence"), None, tokenize))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(feature=list(encoder.encode(batch["sentence"].tolist())))

    return sents.mapInPandas(run, StructType([*sents.schema.fields, StructField("feature", ArrayType(DoubleType()))]))


def _compared(sents: DataFrame, encoder: Encoder | None, tokenize: Tokenizer) -> DataFrame:
    """``sents`` with the similarity of each sentence and the next one of its page; null for the last."""
    nxt = F.lead("feature").over(Window.partitionBy(*PAGE).orderBy("idx"))
    both = _features(sents, encoder, tokenize).withColumn("next", nxt)
    measure = cosine if encoder else jaccard
    return both.withColumn("similarity", F.when(F.col("next").isNotNull(), measure(F.col("feature"), F.col("next")))).drop("feature", "next")


def sentence_similarity(sents: DataFrame, encoder: Encoder | None = None, tokenize: Tokenizer = tokens) -> DataFrame:
    """(filename, page, idx, similarity) of each sentence and the next one of its page."""
    return _compared(sents, encoder, tokenize).where("similarity is not null").select(*PAGE, "idx", "similarity")


def breakpoints(sents: DataFrame, encoder: Encoder | None = None, tokenize: Tokenizer = tokens) -> DataFrame:
    """(filename, page, idx, sentence, similarity, is_break): where a group of sentences may end.

    A page's threshold is the mean less one population deviation of its
    similarities (a deviation of 0.1 for a single one), 0.15 at least. A dip
    after sentence i marks i + 1; a Markdown heading marks itself.
    """
    order = Window.partitionBy(*PAGE).orderBy("idx")
    page = Window.partitionBy(*PAGE)
    scored = _compared(sents, encoder, tokenize)
    spread = F.when(F.count("similarity").over(page) == 1, 0.1).otherwise(F.stddev_pop("similarity").over(page))
    limit = F.greatest(F.round(F.avg("similarity").over(page) - spread, 12), F.lit(0.15))
    scored = scored.withColumn("dip", F.round("similarity", 12) < limit)
    dip = F.coalesce(F.lag("dip").over(order), F.lit(False))
    return scored.select(*PAGE, "idx", "sentence", "similarity", (dip | F.col("sentence").rlike("(?U)" + P.MARKDOWN_HEAD)).alias("is_break"))


def group_sentences(marked: DataFrame, chunk_size: int = 500) -> DataFrame:
    """(filename, page, grp, text): sentences joined into groups, in one ordered fold per page.

    A group ends at a mark once it has 50 characters; past ``chunk_size`` at a
    similarity under 0.25 to the next sentence, and past 1.5 times that anyway.
    The length starts anew with each group, so no window sum expresses it.
    """
    item = F.struct("idx", "sentence", "similarity", "is_break")
    pages = marked.groupBy(*PAGE).agg(F.array_sort(F.collect_list(item)).alias("items"))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, s: Column) -> Column:
        text = F.concat(state["open"], s["sentence"])
        n = F.length(text)
        far = (n >= chunk_size) & (F.coalesce(s["similarity"] < 0.25, F.lit(False)) | (n >= chunk_size * 1.5))
        ends = (s["is_break"] & (n >= 50)) | far
        return F.struct(F.when(ends, F.concat(state["done"], F.array(text))).otherwise(state["done"]).alias("done"), F.when(ends, "").otherwise(text).alias("open"))

    groups = F.aggregate("items", zero, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))
    return pages.select(*PAGE, F.posexplode(groups).alias("grp", "text"))


def stream_groups(marked: DataFrame, chunk_size: int = 500) -> DataFrame:
    """The rows of ``group_sentences``, for pages of any length.

    A table function sees the sentences of a page one after another, as Spark has
    sorted them, and holds the open group alone; no row holds a page.
    """
    ship(marked.sparkSession)
    schema = marked.schema
    kinds = {c: schema[c].dataType.simpleString() for c in PAGE}

    class Fold:
        def __init__(self):
            self.page, self.parts, self.n, self.grp = None, [], 0, 0

        def _group(self):
            self.grp += 1
            return (*self.page, self.grp - 1, "".join(self.parts))

        def eval(self, row):
            self.page = tuple(row[c] for c in PAGE)
            self.parts.append(row["sentence"])
            self.n += len(row["sentence"])
            far = self.n >= chunk_size and (self.n >= chunk_size * 1.5 or (row["similarity"] is not None and row["similarity"] < 0.25))
            if far or (row["is_break"] and self.n >= 50):
                yield self._group()
                self.parts, self.n = [], 0

        def terminate(self):
            if self.n:
                yield self._group()

    fold = F.udtf(Fold, returnType=", ".join(f"{c} {kinds[c]}" for c in PAGE) + ", grp int, text string")
    return fold(marked.select(*PAGE, "idx", "sentence", "similarity", "is_break").asTable().partitionBy(*PAGE).orderBy("idx"))


def overlapped(groups: DataFrame, overlap: int = 100) -> DataFrame:
    """(filename, page, grp, content): each group behind the end of the one before, if that is longer than ``overlap``."""
    before = F.lag("text").over(Window.partitionBy(*PAGE).orderBy("grp"))
    tail = F.when(F.length(before) > overlap, F.substring(before, -overlap, overlap)).otherwise("")
    tail = F.coalesce(tail, F.lit(""))
    content = F.when(F.col("text").startswith(tail), F.col("text")).otherwise(F.concat(tail, F.col("text")))
    return groups.select(*PAGE, "grp", strip(content).alias("content")).where(F.length("content") > 10)


def _cuts(s: Column, chunk_size: int) -> Column:
    """Of a page's struct(sents, sims): after how many sentences each group of ``group_sentences`` ends, by the marks of ``breakpoints``."""
    known = F.filter(s["sims"], lambda x: x.isNotNull())
    n = F.nullif(F.size(known), F.lit(0))
    mean = F.aggregate(known, F.lit(0.0), lambda t, x: t + x) / n

    def limit(m: Column) -> Column:
        spread = F.when(n == 1, 0.1).otherwise(F.sqrt(F.aggregate(known, F.lit(0.0), lambda t, x: t + (x - m) * (x - m)) / n))
        return F.greatest(F.round(m - spread, 12), F.lit(0.15))

    def items(least: Column) -> Column:
        dip = lambda i: F.coalesce(F.round(F.get(s["sims"], i - 1), 12) < least, F.lit(False))
        return F.transform(s["sents"], lambda x, i: F.struct(i.alias("i"), F.length(x).alias("n"), F.get(s["sims"], i).alias("similarity"), (dip(i) | x.rlike("(?U)" + P.MARKDOWN_HEAD)).alias("is_break")))

    def step(state: Column, x: Column) -> Column:
        n = state["n"] + x["n"]
        far = (n >= chunk_size) & (F.coalesce(x["similarity"] < 0.25, F.lit(False)) | (n >= chunk_size * 1.5))
        ends = (x["is_break"] & (n >= 50)) | far
        return F.struct(F.when(ends, F.concat(state["cuts"], F.array(x["i"] + 1))).otherwise(state["cuts"]).alias("cuts"), F.when(ends, 0).otherwise(n).alias("n"))

    zero = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("n"))
    rest = lambda t: F.when(t["n"] == 0, t["cuts"]).otherwise(F.concat(t["cuts"], F.array(F.size(s["sents"]))))
    return F.aggregate(let(let(mean, limit), items), zero, step, rest)


def _page_groups(sents: Column, chunk_size: int, overlap: int, tokenize: Tokenizer) -> Column:
    """The contents of ``overlapped`` of a page's sentences, as one array."""
    sims = lambda f: F.zip_with(f, F.slice(f, 2, F.size(f)), lambda x, y: F.when(y.isNotNull(), jaccard(x, y)))
    joined = lambda s: F.transform(s["cuts"], lambda c, i: let(F.coalesce(F.get(s["cuts"], i - 1), F.lit(0)), lambda b: F.array_join(F.slice(s["sents"], b + 1, c - b), "")))
    tail = lambda t: F.when(F.length(t) > overlap, F.substring(t, -overlap, overlap)).otherwise("")
    behind = lambda t, x: strip(F.when(x.startswith(t), x).otherwise(F.concat(t, x)))
    told = lambda g: F.filter(F.transform(g, lambda x, i: let(tail(F.get(g, i - 1)), lambda t: behind(t, x))), lambda x: F.length(x) > 10)
    compared = lambda x: F.struct(x.alias("sents"), let(F.transform(x, lambda y: token_set(y, None, tokenize)), sims).alias("sims"))
    cut = lambda s: F.struct(s["sents"].alias("sents"), _cuts(s, chunk_size).alias("cuts"))
    return let(let(let(let(sents, compared), cut), joined), told)


#: A sentence up to its stop, before its ends are stripped; what marks a heading; bytes of pages that are compared at a time.
SENTENCE, HEADING, SLICE = re.compile("[^\n。！？；]+[。！？；]?"), re.compile(f"#{{1,4}}[{SPACES}]"), 1 << 20


def _folded(sents: Iterable[str], sims: Iterable[float], least: float, chunk_size: int) -> Iterator[str]:
    """The groups of ``group_sentences``; sims: of each sentence and the next, dips are those under ``least``."""
    parts, n, dip = [], 0, False
    for s, sim in itertools.zip_longest(sents, sims, fillvalue=1.0):
        parts.append(s)
        n += len(s)
        if (n >= 50 and (dip or HEADING.match(s))) or (n >= chunk_size and (sim < 0.25 or n >= chunk_size * 1.5)):
            yield "".join(parts)
            parts, n = [], 0
        dip = sim < least
    if parts:
        yield "".join(parts)


def _contents(groups: Iterable[str], overlap: int) -> Iterator[str]:
    """The contents of ``overlapped`` of a page's groups."""
    tail = ""
    for g in groups:
        content = (g if g.startswith(tail) else tail + g).strip(SPACES)
        tail = g[len(g) - overlap :] if len(g) > overlap else ""
        if len(content) > 10:
            yield content


def _sentences(texts: list[str]) -> Iterator[str]:
    """``sentences_of`` the rows of a page, one after another, those of several rows by number and content."""
    own = lambda text: (s for x in SENTENCE.finditer(text) if len(s := x[0].strip(SPACES)) > 2)
    return own(texts[0]) if len(texts) == 1 else (s for _, s in heapq.merge(*(enumerate(own(t)) for t in texts)))


def _limit(sims: np.ndarray, page: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of each page: under which similarity a sentence is followed by a break, as ``breakpoints`` says."""
    n = np.maximum(size - 1, 1)
    mean = np.bincount(page, sims, len(size)) / n
    spread = np.where(size == 2, 0.1, np.sqrt(np.bincount(page, (sims - mean[page]) ** 2, len(size)) / n))
    return np.maximum(_rounded(mean - spread), 0.15)


def _rounded(x: np.ndarray) -> np.ndarray:
    return np.floor(x * 1e12 + 0.5) / 1e12


def _long_page(texts: list[str], chunk_size: int, overlap: int, bits: bytes) -> Iterator[str]:
    """The contents of a page whose sentences are held a slice at a time: they are compared first, and folded from the text again."""
    sims, held, chars = [np.zeros(0)], [], 0
    for s in _sentences(texts):
        held.append(s)
        chars += len(s)
        if chars >= SLICE:
            sims.append(neighbours(held, bits))
            held, chars = held[-1:], 0
    sims = np.concatenate([*sims, neighbours(held, bits)])
    least = _limit(sims, np.zeros(len(sims), np.int64), np.array([len(sims) + 1]))[0]
    return _contents(_folded(_sentences(texts), map(float, _rounded(sims)), least, chunk_size), overlap)


def _short_pages(pages: list[list[str]], chunk_size: int, overlap: int, bits: bytes) -> Iterator[Iterator[str]]:
    """The contents of each page; the sentences of all are compared at once."""
    sents = [list(_sentences(texts)) if texts else [] for texts in pages]
    size = np.fromiter(map(len, sents), np.int64, len(sents))
    ends = np.cumsum(size)
    sims = neighbours([s for p in sents for s in p], bits)
    within = np.ones(len(sims), bool)  # not the last sentence of a page and the first of the next
    within[ends[(ends > 0) & (ends <= len(sims))] - 1] = False
    sims = sims[within]
    least, told, at = _limit(sims, np.repeat(np.arange(len(size)), np.maximum(size - 1, 0)), size).tolist(), _rounded(sims).tolist(), 0
    for p, own in enumerate(sents):
        until = at + max(len(own) - 1, 0)
        yield _contents(_folded(own, told[at:until], least[p], chunk_size), overlap)
        at = until


def _chunks_in_batches(pages: DataFrame, chunk_size: int, overlap: int) -> DataFrame:
    """``semantic_chunks`` of the usual tokens: pages move once, and the sentences of many are compared at once.

    Rows of a page come one after another, as Spark has sorted them. A task holds
    the text of about a MB of pages, or of a single page over LONG_PAGE, of which
    it holds the sentences of a MB.
    """
    ship(pages.sparkSession)
    bits = letters(pages.sparkSession)
    kept = [pages.schema[c] for c in PAGE]
    form = StructType([*kept, StructField("tail", StringType()), StructField("type", StringType()), StructField("content", StringType())])
    arrow = to_arrow_schema(form)

    def by_page(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
        rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in (*PAGE, "text", "tables")), strict=True))
        return ((key, [r[2:] for r in own]) for key, own in itertools.groupby(rows, lambda r: r[:2]))

    def told(key: tuple, parts: list[tuple], contents: Iterable[str]) -> Iterator[tuple]:
        yield from ((*key, f"_chunk{i}", "text", x) for i, x in enumerate(contents))
        for text, tables in parts:
            if tables and (len((text or "").strip(SPACES)) < 10 or next(_sentences([text]), None)):
                yield from ((*key, f"_table{i}", "table", t) for i, x in enumerate(tables) if x is not None and (t := x.strip(SPACES)))

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, chars = [], 0

        def settle() -> Iterator[tuple]:
            for (key, parts, _), contents in zip(held, _short_pages([texts for _, _, texts in held], chunk_size, overlap, bits), strict=True):
                yield from told(key, parts, contents)

        for key, parts in by_page(batches):
            texts = [text for text, _ in parts if len((text or "").strip(SPACES)) >= 10]
            n = sum(map(len, texts))
            if n > LONG_PAGE:
                yield from told(key, parts, _long_page(texts, chunk_size, overlap, bits))
                continue
            held.append((key, parts, texts))
            chars += n
            if chars >= SLICE or len(held) >= SLICE >> 6:
                yield from settle()
                held, chars = [], 0
        yield from settle()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in itertools.batched(chunks(batches), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    dealt = pages.select(*PAGE, "text", "tables").repartition(*PAGE).sortWithinPartitions(*PAGE)
    return dealt.mapInArrow(run, form).select(F.concat_ws("", "filename", F.lit("_p"), "page", "tail").alias("chunk_id"), *PAGE, "type", "content")


def _chunks_by_page(pages: DataFrame, chunk_size: int, overlap: int, tokenize: Tokenizer) -> DataFrame:
    """``semantic_chunks`` with all work on a page's sentences in its row: pages move once, and no sentence by itself."""
    long_ = lambda p: F.length(strip(F.coalesce(p["text"], F.lit("")))) >= 10
    numbered = lambda p: F.transform(sentences_of(p["text"]), lambda s, i: F.struct(i.alias("idx"), s.alias("sentence")))
    many = lambda ps: F.transform(F.array_sort(F.flatten(F.transform(ps, numbered))), lambda x: x["sentence"])
    sents = lambda ps: F.when(F.size(ps) == 1, sentences_of(F.get(ps, F.lit(0))["text"])).otherwise(many(ps))
    chunk = lambda tail, kind: lambda x, i: F.struct(F.concat(F.lit(tail), i.cast("string")).alias("tail"), F.lit(kind).alias("type"), x.alias("content"))
    shown = F.filter("parts", lambda p: (F.size(p["tables"]) > 0) & (~long_(p) | (F.size(sentences_of(p["text"])) > 0)))
    tables = F.flatten(F.transform(shown, lambda p: F.filter(F.transform(p["tables"], lambda t, i: chunk("_table", "table")(strip(t), i)), lambda t: t["content"] != "")))
    rows = pages.groupBy(*PAGE).agg(F.collect_list(F.struct("text", "tables")).alias("parts"))
    rows = rows.select(*PAGE, tables.alias("tables"), _page_groups(let(F.filter("parts", long_), sents), chunk_size, overlap, tokenize).alias("texts"))
    rows = rows.select(*PAGE, F.explode(F.concat(F.transform("texts", chunk("_chunk", "text")), "tables")).alias("c"))
    return rows.select(F.concat_ws("", "filename", F.lit("_p"), "page", "c.tail").alias("chunk_id"), *PAGE, "c.type", "c.content")


def semantic_chunks(pages: DataFrame, chunk_size: int = 500, overlap: int = 100, encoder: Encoder | None = None, tokenize: Tokenizer = tokens, streamed: bool = False) -> DataFrame:
    """(chunk_id, filename, page, type, content): groups of sentences, compared by tokens or by an encoder, and tables.

    Chunks count within their page. Pages under 10 characters give tables alone;
    longer pages without a sentence give nothing. Sentences of the usual tokens are
    folded from their page's text, those of a long one without holding them all.
    With another tokenizer ``streamed`` folds pages a sentence at a time, with the
    same chunks; they, and what is compared in Python, take a row a sentence.
    """
    if tokenize is tokens and not encoder:
        return _chunks_in_batches(pages, chunk_size, overlap)
    if not (encoder or streamed or hasattr(tokenize, "evalType")):
        return _chunks_by_page(pages, chunk_size, overlap, tokenize)
    return _chunks_by_sentence(pages, chunk_size, overlap, encoder, tokenize, streamed)


def _chunks_by_sentence(pages: DataFrame, chunk_size: int, overlap: int, encoder: Encoder | None, tokenize: Tokenizer, streamed: bool) -> DataFrame:
    """``semantic_chunks`` with a row a sentence."""
    long_ = F.length(strip(F.coalesce("text", F.lit("")))) >= 10
    fold = stream_groups if streamed else group_sentences
    groups = overlapped(fold(breakpoints(sentences(pages.where(long_)), encoder, tokenize), chunk_size), overlap)
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("grp")) - 1
    text = groups.withColumn("n", number).select(F.concat_ws("", "filename", F.lit("_p"), "page", F.lit("_chunk"), "n").alias("chunk_id"), *PAGE, F.lit("text").alias("type"), "content")
    told = pages.where(~long_ | (F.size(sentences_of(F.col("text"))) > 0))
    return text.unionByName(_table_chunks(told))
