"""Indexes as plain tables: postings, lengths, term and corpus statistics, TF-IDF weights, vectors."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.batches import cut, letters, points
from ..functions.text import Tokenizer, strip, tokens
from ..plugins import Encoder
from ..session import dealt, ship

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Bytes of text whose tokens are held at a time.
BLOCK_BYTES = 1 << 20


def by_term(postings: DataFrame) -> DataFrame:
    """``postings`` sorted by term, those of a frequent term over many partitions."""
    return postings.repartitionByRange("term", F.xxhash64("id")).sortWithinPartitions("term")


@dataclass
class LexicalIndex:
    """postings (term, id, tf, dl), terms (term, df, idf), corpus (n, avgdl: one row); the postings by text besides, where they are saved so, see ``by_text``."""

    postings: DataFrame
    terms: DataFrame
    corpus: DataFrame
    texts: DataFrame | None = None

    def save(self, path: str) -> None:
        by_term(self.postings).write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.corpus.write.mode("overwrite").parquet(f"{path}/corpus")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LexicalIndex:
        return LexicalIndex(*(spark.read.parquet(f"{path}/{part}") for part in ("postings", "terms", "corpus")))


def token_counts(texts: DataFrame, id_: str, text: str = "text", tokenize: Tokenizer = tokens) -> DataFrame:
    found = tokenize(F.col(text))
    return texts.select(id_, F.size(found).cast("long").alias("n_tokens"), F.size(F.array_distinct(found)).cast("long").alias("n_distinct"))


def _by_id(texts: DataFrame, id_: str) -> DataFrame:
    return dealt(texts.select(F.col(id_).alias("id"), *(c for c in texts.columns if c != id_)), "id")


def _cut(texts: DataFrame, id_: str, tokenized: Column) -> DataFrame:
    return _by_id(texts.select(id_, tokenized.alias("tokens")), id_)


def _number(texts: DataFrame, id_: str, text: str, counts: Column) -> DataFrame:
    """n: how many texts meet a condition, one row.

    They are counted behind the exchange of ``postings_of``, so that texts that
    are made are not made again; the length, which is never below 0, keeps the
    columns of that exchange.
    """
    return _by_id(texts.select(id_, text), id_).agg(F.count(F.when((F.coalesce(F.length(text), F.lit(0)) >= 0) & counts, 1)).alias("n"))


def in_python(tokenize: Tokenizer) -> bool:
    """Whether a tokenizer is a Python function, which rows leave the JVM for."""
    return hasattr(tokenize, "evalType")


def postings_of(texts: DataFrame, id_: str, tokenized: Column, python: bool = False) -> DataFrame:
    """(id, dl, term, tf).

    Texts are dealt by id before they are cut into words, so that words are
    counted where they are: the texts move once, and not a row a word. An outer
    explode, since for an inner one the optimizer would tokenize below that
    exchange too, to drop texts without words. There are as many partitions as
    the counts of one need to fit into memory. Spark no longer knows how rows are
    dealt once they were in Python, so a ``python`` tokenizer comes first: it cuts
    each text once, and its tokens are dealt.
    """
    cut = _cut(texts, id_, tokenized) if python else _by_id(texts, id_).select("id", tokenized.alias("tokens"))
    rows = cut.select("id", F.size("tokens").cast("long").alias("dl"), F.explode_outer("tokens").alias("term"))
    return rows.where("term is not null").groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))


def by_text(postings: DataFrame) -> DataFrame:
    """(id, dl, total, main, words: (term, tf, dl)): the postings of each text in one row, with its length, the sum of its tf and its most frequent term."""
    return postings.groupBy("id").agg(F.max("dl").alias("dl"), F.sum("tf").alias("total"), F.max_by("term", F.struct("tf", "term")).alias("main"), F.collect_list(F.struct("term", "tf", "dl")).alias("words"))


def lexical_index(texts: DataFrame, id_: str, text: str = "text", tokenize: Tokenizer = tokens, path: str | None = None) -> LexicalIndex:
    """BM25 statistics. Terms in over half of the texts get EPSILON times the mean of all raw weights.

    With a ``path``, each text is cut into words once: they are counted where the
    text is and written by text, and all else is read from there. Worth it where
    several jobs read the index.
    """
    postings = postings_of(texts.select(id_, text), id_, tokenize(F.col(text)), in_python(tokenize))
    if path:
        by_text(postings).write.mode("overwrite").parquet(f"{path}/texts")
        saved = texts.sparkSession.read.parquet(f"{path}/texts")
        postings = saved.select("id", F.explode("words").alias("w")).select("id", "w.dl", "w.term", "w.tf")
        n = texts.agg(F.count("*").alias("n"))  # texts without words, too
        corpus = n.crossJoin(F.broadcast(saved.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))))  # two rows of one number
        return LexicalIndex(postings, term_weights(postings.groupBy("term").agg(F.count("*").alias("df")), n), corpus.select("n", (F.col("total") / F.nullif(F.col("n"), F.lit(0))).alias("avgdl")), saved)
    # Asking for both numbers everywhere keeps the plans of all uses alike, so that one exchange serves them.
    df = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where("df > 0 and total > 0")
    # The number of tokens is the sum over terms, so that no text is cut again for the mean length.
    if in_python(tokenize):  # the same exchange; the size is -1 or more
        n = _cut(texts.select(id_, text), id_, tokenize(F.col(text))).agg(F.count(F.when(F.coalesce(F.size("tokens"), F.lit(0)) >= -1, 1)).alias("n"))
    else:
        n = _number(texts, id_, text, F.lit(True))
    corpus = n.crossJoin(F.broadcast(df.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))))  # two rows of one number
    corpus = corpus.select("n", (F.col("total") / F.nullif(F.col("n"), F.lit(0))).alias("avgdl"))
    return LexicalIndex(postings, term_weights(df, n), corpus)


def term_weights(df: DataFrame, n: DataFrame) -> DataFrame:
    """(term, df, idf) from (term, df) and the number of texts ``n``, one row. Weights below 0 are replaced by EPSILON times the mean of all."""
    raw = df.crossJoin(F.broadcast(n)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    idf = F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf"))


@dataclass
class TfidfIndex:
    """weights (id, term, weight) with unit length per id, terms (term, idf)."""

    weights: DataFrame
    terms: DataFrame

    def save(self, path: str) -> None:
        by_term(self.weights).write.mode("overwrite").parquet(f"{path}/weights")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TfidfIndex:
        return TfidfIndex(*(spark.read.parquet(f"{path}/{part}") for part in ("weights", "terms")))


def word_terms(text: Column, tokenize: Tokenizer = tokens) -> Column:
    """Lower-cased words of two characters or more."""
    return F.filter(tokenize(text), lambda t: F.length(t) >= 2)


def tfidf_index(texts: DataFrame, id_: str, text: str = "text", max_terms: int = 5000, tokenize: Tokenizer = tokens) -> TfidfIndex:
    """Raw counts times ln((1 + n) / (1 + df)) + 1, scaled to unit length; the ``max_terms`` most frequent terms (ties by term)."""
    # A text that is blank has no words; it only counts for n.
    postings = postings_of(texts.select(id_, text), id_, word_terms(F.col(text), tokenize), in_python(tokenize))
    n = _number(texts, id_, text, strip(F.col(text)) != "")
    terms = postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).orderBy(F.desc("total"), "term").limit(max_terms)
    idf = F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0
    terms = terms.crossJoin(F.broadcast(n)).select("term", idf.alias("idf"))
    raw = postings.join(F.broadcast(terms), "term").select("id", "term", (F.col("tf") * F.col("idf")).alias("w"))  # max_terms rows at most
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return TfidfIndex(raw.select("id", "term", (F.col("w") / length).alias("weight")), terms)


def dense_index(chunks: DataFrame, encoder: Encoder, id_: str = "chunk_id", text: str = "content") -> DataFrame:
    """(id, embedding): each text through the encoder, a batch at a time."""
    kind = chunks.schema[id_].dataType.simpleString()

    def run(batches):
        for batch in batches:
            batch["embedding"] = list(encoder.encode(batch[text].tolist()))
            yield batch[[id_, "embedding"]]

    return chunks.select(id_, text).mapInPandas(run, f"{id_} {kind}, embedding array<double>")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows of both, the latest by ``order`` for each key; on a tie the new table's."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    latest = Window.partitionBy(*key).orderBy(F.desc(order), F.desc("_new"))
    return both.withColumn("_rank", F.row_number().over(latest)).where("_rank = 1").drop("_rank", "_new")


#: Columns of a block of texts, see ``token_blocks``.
BLOCK = "terms array<string>, df array<long>, total array<long>, n long, ids array<{}>, dl array<long>, doc array<long>, term array<string>, tf array<long>"


def token_blocks(texts: DataFrame, id_: str, text: str, asked: list[str]) -> DataFrame:
    """Texts in blocks of about a MB: each distinct term of a block with its texts and its occurrences, and the postings of the terms in ``asked`` alone.

    Rows (terms, df, total, n, ids, dl, doc, term, tf): ``doc`` numbers the ids of
    its row. Rows of one id and one length are one text, as in ``postings_of``; they
    are in one partition, and in one block if any id repeats there.
    """
    ship(texts.sparkSession)
    bits, wanted = letters(texts.sparkSession), pa.array(asked, pa.string())
    kind = texts.schema[id_].dataType.simpleString()

    def block(ids: pa.Array, lowered: pa.Array) -> pa.RecordBatch:
        found = cut(*points(lowered.fill_null("").to_pylist()), bits)
        length = np.bincount(found.row, minlength=len(ids))
        doc = np.arange(len(ids))
        same = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
        if len(ids) and same.max() + 1 < len(ids):
            _, first, doc = np.unique(same * (length.max() + 1) + length, return_index=True, return_inverse=True)
            ids, length = ids.take(pa.array(first)), length[first]
        names = pa.array(found.names(), pa.string())
        each = np.sort(doc[found.row] * max(len(names), 1) + found.code)
        starts = np.flatnonzero(np.concatenate([np.ones(min(len(each), 1), bool), each[1:] != each[:-1]]))
        tf, each = np.diff(np.append(starts, len(each))), each[starts]
        at, code = each // max(len(names), 1), each % max(len(names), 1)
        mine = np.flatnonzero(pc.is_in(names, wanted).to_numpy(zero_copy_only=False)[code])
        columns = [names, np.bincount(code, minlength=len(names)), np.bincount(found.code, minlength=len(names)), len(lowered), ids, length, at[mine], names.take(pa.array(code[mine])), tf[mine]]
        return pa.RecordBatch.from_arrays([pa.array([x]) if isinstance(x, int) else listed(x) for x in columns], [c.split()[0] for c in BLOCK.split(", ")])

    def listed(values) -> pa.Array:
        values = values if isinstance(values, pa.Array) else pa.array(values, pa.int64())
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [b for b in batches if b.num_rows]  # a partition is of bounded size, see ``dealt``
        if not found:
            return
        table = pa.Table.from_batches(found).combine_chunks()
        ids, lowered = (c.chunk(0) for c in table.columns)
        if pc.count_distinct(ids, mode="all").as_py() < len(ids):
            yield block(ids, lowered)
            return
        ends = np.cumsum(pc.binary_length(lowered).fill_null(0).to_numpy())
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(ends // BLOCK_BYTES)) + 1, [len(ids)]]))
        for a, b in itertools.pairwise(cuts.tolist()):
            yield block(ids.slice(a, b - a), lowered.slice(a, b - a))

    rows = _by_id(texts.select(id_, text), id_).select("id", F.lower(text).alias("text"))
    return rows.mapInArrow(run, BLOCK.format(kind))


def block_terms(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``token_blocks``: the terms (term, df, idf), and the corpus (n, avgdl: one row)."""
    each = blocks.select(F.explode(F.arrays_zip("terms", "df", "total")).alias("t")).select(F.col("t.terms").alias("term"), "t.df", "t.total")
    df = each.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    n = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    total = blocks.select(F.aggregate("total", F.lit(0).cast("long"), lambda s, x: s + x).alias("total")).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("total"))
    corpus = n.crossJoin(F.broadcast(total))  # two rows of one number
    return term_weights(df.select("term", "df"), n), corpus.select("n", (F.col("total") / F.nullif(F.col("n"), F.lit(0))).alias("avgdl"))
