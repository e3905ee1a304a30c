"""Retrieval over whole batches of queries: channels of ranked hits, fused and turned into contexts.

Hits are rows (query_id, id, score, rank); ranks start at 1, ties go to the
smaller id. Queries are rows (query_id, question).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.text import Tokenizer, tokens
from ..session import beside, small
from .index import B, K1, LexicalIndex, TfidfIndex, block_terms, lexical_index, token_blocks, word_terms

#: Fixed order of channels in fused results.
CHANNELS = ["dense", "bm25", "title", "keyword", "summary"]
#: Numbers that a block of vectors may hold.
BLOCK = 1 << 19


def top_k(scored: DataFrame, k: int, places: int = 9) -> DataFrame:
    """The k best hits of each query; the window keeps k rows per task before the shuffle."""
    scored = scored.withColumn("score", F.round("score", places))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _wanted(postings: DataFrame, asked: DataFrame, weights: DataFrame, queries: DataFrame) -> DataFrame:
    """Postings (.., id, term) joined with the query terms (query_id, term, ..) and their weights.

    A semi-join first, which moves below the counting of words and drops most of
    them there. Query terms go to every task if the queries are few; postings
    then stay where their text is, and their scores add up before any shuffle.
    """
    found = postings.join(beside(asked.select("term").distinct(), queries), "term", "left_semi")
    return found.join(beside(asked.join(weights, "term"), queries), "term")


def bm25_search(index: LexicalIndex, queries: DataFrame, k: int = 10, tokenize: Tokenizer = tokens) -> DataFrame:
    """Sum of BM25 weights over the query's tokens, repeats included; the top k, then those above 0.

    Postings meet query terms by an equi-join on the term, so that only matching
    postings are scored.
    """
    asked = queries.select("query_id", F.explode(tokenize(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    matched = _wanted(index.postings, asked, index.terms.select("term", "idf"), queries).crossJoin(F.broadcast(index.corpus.select("avgdl")))  # corpus: one row
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / norm
    scores = matched.groupBy("query_id", "id").agg(F.sum(part).alias("score"))
    return top_k(scores, k).where("score > 0")


def bm25_once(texts: DataFrame, id_: str, queries: DataFrame, path: str, k: int = 10, text: str = "text") -> DataFrame:
    """The hits of ``bm25_search`` over ``texts``, for an index that is asked once by few queries.

    Each text is cut into words once, in blocks that are written to ``path`` with
    their counts of terms and the postings of the asked terms. A task scores its
    blocks and sends its k best of each query alone, where a common word would
    make a row for every text and query. Many queries go through ``lexical_index``.
    """
    if not small(queries, 2 << 20):
        return bm25_search(lexical_index(texts, id_, text), queries, k)
    asked = queries.select("query_id", F.explode(tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    wanted = asked.toPandas()  # the terms of few queries
    spark = texts.sparkSession
    token_blocks(texts, id_, text, sorted(set(wanted["term"]))).write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    terms, corpus = block_terms(blocks)
    mean = corpus.collect()[0]["avgdl"]
    idf = {r["term"]: r["idf"] for r in terms.join(F.broadcast(asked.select("term").distinct()), "term").select("term", "idf").collect()}
    places = {t: i for i, t in enumerate(sorted(idf))}
    names, by_query = pa.array(places, pa.string()), list(wanted[wanted["term"].isin(places)].groupby("query_id", sort=False))
    weights = np.zeros((len(by_query), len(places)))
    for i, (_, rows) in enumerate(by_query):
        weights[i, [places[t] for t in rows["term"]]] = [q * idf[t] for q, t in zip(rows["qtf"], rows["term"], strict=True)]
    qids, qkind = [q for q, _ in by_query], queries.schema["query_id"].dataType
    kind = blocks.schema["ids"].dataType.elementType
    form = StructType([StructField("query_id", qkind), StructField("id", kind), StructField("score", DoubleType())])
    arrow = to_arrow_schema(form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[pa.Table] = [arrow.empty_table()] * len(qids)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, dl, doc, term, tf = (batch.column(c)[row].values for c in range(5))
                coded = ids.dictionary_encode(null_encoding="encode")  # texts of one id and unlike lengths add up
                ids = coded.dictionary
                order = pc.sort_indices(ids, null_placement="at_start").to_numpy()  # ties go to the smaller id
                place = np.empty(len(order), np.int64)
                place[order] = np.arange(len(order))
                place = place[coded.indices.to_numpy()]
                dl, doc, tf = dl.to_numpy(), doc.to_numpy(), tf.to_numpy()
                code = pc.index_in(term, names).to_numpy(zero_copy_only=False)
                part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[doc] / mean))
                for i, mine in enumerate(weights):
                    use = np.flatnonzero(mine[code] != 0)
                    if not len(use):
                        continue
                    score = np.round(np.bincount(place[doc[use]], part[use] * mine[code[use]], len(order)), 9)
                    met = np.zeros(len(order), bool)
                    met[place[doc[use]]] = True
                    score[~met] = -np.inf
                    least = np.partition(score, -k)[-k] if k < len(score) else -np.inf
                    ahead = np.flatnonzero(met & (score > least))
                    level = np.flatnonzero(met & (score == least))[: max(0, k - len(ahead))] if np.isfinite(least) else np.flatnonzero(met)[:0]
                    top = np.concatenate([ahead, level])
                    found = pa.Table.from_arrays([pa.array([qids[i]] * len(top), arrow.field(0).type), ids.take(pa.array(order[top])).cast(arrow.field(1).type), pa.array(score[top])], schema=arrow)
                    both = pa.concat_tables([best[i], found]).combine_chunks()
                    best[i] = both.take(pc.sort_indices(both, [("score", "descending"), ("id", "ascending")], null_placement="at_start").slice(0, k))
        for found in best:
            yield from found.combine_chunks().to_batches()

    return top_k(blocks.select("ids", "dl", "doc", "term", "tf").mapInArrow(run, form), k).where("score > 0")


def scaled_search(index: LexicalIndex, queries: DataFrame, k: int = 5, tokenize: Tokenizer = tokens) -> DataFrame:
    """BM25 hits with scores divided by the query's best; titles and summaries are searched so."""
    return scaled(bm25_search(index, queries, k, tokenize))


def scaled(hits: DataFrame) -> DataFrame:
    """``hits`` with scores divided by the query's best."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return hits.withColumn("score", F.round(F.col("score") / best, 9))


def keyword_search(index: TfidfIndex, queries: DataFrame, k: int = 5, tokenize: Tokenizer = tokens) -> DataFrame:
    """TF-IDF cosine, as a join on terms of two unit-length sparse vectors."""
    raw = queries.select("query_id", F.explode(word_terms(F.col("question"), tokenize)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    raw = raw.join(index.terms, "term").select("query_id", "term", (F.col("tf") * F.col("idf")).alias("w"))
    asked = raw.withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query_id"))))
    scores = index.weights.join(beside(asked, queries), "term").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("w")).alias("score"))
    return top_k(scores, k).where("score > 0")


def _blocks(vectors: DataFrame, id_: str, ids: str, dim: str, unit: str) -> DataFrame:
    """Vectors of one length as blocks of at most BLOCK numbers: ids, length, unit vectors as doubles. Null vectors go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            length = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for n in np.unique(length[length > 0]).tolist():
                rows = np.flatnonzero(length == n)
                for part in np.array_split(rows, -(-len(rows) * n // BLOCK)):
                    x = lists.take(pa.array(part)).flatten().fill_null(float("nan")).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, n)
                    fine = np.isfinite(x).all(axis=1)
                    if fine.any():
                        named = batch.column(0).take(pa.array(part[fine]))
                        yield pa.RecordBatch.from_arrays([pa.array([named.to_pylist()], pa.list_(named.type)), pa.array([n]), pa.array([_unit(x[fine]).tobytes()], pa.binary())], [ids, dim, unit])

    kind = vectors.schema[id_].dataType.simpleString()
    return vectors.select(id_, F.col("embedding").cast("array<double>")).mapInArrow(run, f"{ids} array<{kind}>, {dim} long, {unit} binary")


def dense_search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Exact cosine of (id, embedding) rows with (query_id, embedding) rows of the same length.

    Both sides are packed into blocks of a fixed size. Blocks of queries meet
    blocks of vectors, a matrix product each, which keeps its own k best; only
    these are shuffled. Queries and vectors that are null or hold null or
    non-finite numbers match nothing; zero vectors match everything at 0.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    qkind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = batch.column(1)[i].as_py()
                if n != batch.column(4)[i].as_py():
                    continue
                x, q = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float64).reshape(-1, n) for c in (2, 5))
                scores = np.round(q @ x.T, 9)
                keep = min(k, scores.shape[1])
                limit = -np.partition(-scores, keep - 1, axis=1)[:, keep - 1 : keep]
                one, other = np.nonzero(scores >= limit)  # ties at the limit stay until the final ranking
                yield pa.RecordBatch.from_arrays([batch.column(3)[i].values.take(pa.array(one)), batch.column(0)[i].values.take(pa.array(other)), pa.array(scores[one, other])], ["query_id", "id", "score"])

    asked = _blocks(queries, "query_id", "qids", "qdim", "qunit")
    asked = F.broadcast(asked) if small(queries) else asked.hint("shuffle_replicate_nl")  # many queries: blocks are dealt out, none goes to all tasks
    blocks = _blocks(vectors, "id", "ids", "dim", "unit").crossJoin(asked)
    return top_k(blocks.mapInArrow(run, f"query_id {qkind}, id {kind}, score double"), k)


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm == 0, 1, norm)


def fuse(channels: dict[str, DataFrame], k: int = 60, payload: tuple[str, ...] = ("content", "filename", "page")) -> DataFrame:
    """Reciprocal rank fusion: (query_id, id, score, rank, sources, payload columns).

    Every occurrence adds 1 / (k + rank). The payload is that of the first
    occurrence in channel order; ties keep the order of first occurrence.
    """
    rows = None
    for i, name in enumerate(c for c in CHANNELS if c in channels):
        part = channels[name].select("query_id", "id", "rank", F.lit(i).alias("channel"), F.lit(name).alias("source"), *payload)
        rows = part if rows is None else rows.unionByName(part)
    first = F.struct("channel", "rank")
    fused = rows.groupBy("query_id", "id").agg(
        F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("score"), F.min(first).alias("first"),
        F.array_sort(F.collect_set(F.struct("channel", "source"))).alias("seen"), *(F.min_by(c, first).alias(c) for c in payload),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "id")
    ranked = fused.withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.select("query_id", "id", "score", "rank", F.transform("seen", lambda s: s["source"]).alias("sources"), *payload)


def contexts(hits: DataFrame, queries: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """One row per query: top_filename, top_page, context_text, image_path, n_hits; without hits: '', 0, '', null, 0."""
    block = F.concat(F.lit("[来源: "), "filename", F.lit(" 第"), F.col("page").cast("string"), F.lit("页]\n"), "content")
    if images is None:
        hits = hits.withColumn("image_path", F.lit(None).cast("string"))
    else:
        hits = hits.join(images.select("filename", "page", "image_path"), ["filename", "page"], "left")
    told = hits.groupBy("query_id").agg(
        F.min_by("filename", "rank").alias("top_filename"), F.min_by("page", "rank").alias("top_page"), F.min_by("image_path", "rank").alias("image_path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))), lambda x: x["block"]), "\n\n---\n\n").alias("context_text"), F.count("*").alias("n_hits"),
    )
    none = {"top_filename": F.lit(""), "top_page": F.lit(0), "context_text": F.lit(""), "n_hits": F.lit(0)}
    return queries.select("query_id").join(told, "query_id", "left").select("query_id", *(F.coalesce(c, v.cast(told.schema[c].dataType)).alias(c) for c, v in none.items()), "image_path")
