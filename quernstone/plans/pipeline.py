"""Whole plans: build all indexes, then answer a batch of questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions.text import Tokenizer, tokens
from ..operators import chunk, index, parse, rerank, retrieve
from ..operators.block_index import BlockIndex
from ..operators.generate import generate
from ..operators.vector_index import VectorIndex
from ..plugins import Encoder, HashedEncoder, LanguageModel, Scorer
from ..sources.readers import Settings
from ..sources.tables import exists


@dataclass
class Indexes:
    chunks: DataFrame
    bm25: index.LexicalIndex
    vectors: DataFrame
    titles: index.LexicalIndex
    summaries: index.LexicalIndex
    keywords: index.TfidfIndex
    extra: DataFrame  # payload of title, keyword and summary ids
    cells: VectorIndex | None = None  # of the vectors; searched instead of all of them
    blocks: BlockIndex | None = None  # of bm25; searched with the same hits

    def save(self, path: str, cells: bool = False, blocks: bool = False) -> None:
        """Each index as tables in a folder of its own; with the vectors in ``cells`` and the postings in ``blocks`` besides, if asked for."""
        if cells:
            VectorIndex.build(self.vectors, f"{path}/cells")
        if blocks:
            BlockIndex.build(self.bm25, f"{path}/blocks")
        for name in ("chunks", "vectors", "extra"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        for name in ("bm25", "titles", "summaries", "keywords"):
            getattr(self, name).save(f"{path}/{name}")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Indexes:
        plain = {name: spark.read.parquet(f"{path}/{name}") for name in ("chunks", "vectors", "extra")}
        lexical = {name: index.LexicalIndex.load(spark, f"{path}/{name}") for name in ("bm25", "titles", "summaries")}
        cells = VectorIndex.load(spark, f"{path}/cells") if exists(spark, f"{path}/cells") else None
        blocks = BlockIndex.load(spark, f"{path}/blocks") if exists(spark, f"{path}/blocks") else None
        return Indexes(**plain, **lexical, keywords=index.TfidfIndex.load(spark, f"{path}/keywords"), cells=cells, blocks=blocks)


def build_indexes(pages: DataFrame, encoder: Encoder | None = None, semantic: bool = False, settings: Settings = Settings(), tokenize: Tokenizer = tokens) -> Indexes:
    """All indexes over pages (filename, page, text, tables)."""
    chunks = chunk.semantic_chunks(pages, settings.chunk_size, settings.overlap, encoder, tokenize) if semantic else chunk.page_chunks(pages)
    vectors = index.dense_index(chunks, encoder or HashedEncoder()).withColumnRenamed("chunk_id", "id")
    named = lambda df, tail: df.withColumn("id", F.concat_ws("", "filename", F.lit("_p"), "page", F.lit(tail)))
    titles, sums, keys = named(parse.titles(pages), "_title"), named(parse.summaries(pages), "_summary"), named(pages, "_keyword")
    extra = titles.select("id", F.col("title").alias("content"), "filename", "page")
    extra = extra.unionByName(sums.join(pages.select("filename", "page", F.col("text").alias("content")), ["filename", "page"]).select("id", "content", "filename", "page"))
    extra = extra.unionByName(keys.select("id", F.col("text").alias("content"), "filename", "page"))
    lexical = lambda df, id_, text: index.lexical_index(df, id_, text, tokenize)
    return Indexes(chunks, lexical(chunks, "chunk_id", "content"), vectors, lexical(titles, "id", "title"), lexical(sums, "id", "summary"), index.tfidf_index(keys, "id", tokenize=tokenize), extra.dropDuplicates(["id"]))


def search(ix: Indexes, queries: DataFrame, encoder: Encoder | None = None, settings: Settings = Settings(), multi: bool = False, scorer: Scorer | None = None, staged: bool = False, tokenize: Tokenizer = tokens) -> DataFrame:
    """Fused and reranked hits of every query (query_id, question[, question_type])."""
    asked = index.dense_index(queries, encoder or HashedEncoder(), "query_id", "question")
    body = ix.chunks.select(F.col("chunk_id").alias("id"), "content", "filename", "page")
    k = settings.channel_top_k
    dense = ix.cells.search(asked, settings.dense_top_k) if ix.cells else retrieve.dense_search(ix.vectors, asked, settings.dense_top_k)
    lexical = ix.blocks.search(queries, settings.bm25_top_k, tokenize=tokenize) if ix.blocks else retrieve.bm25_search(ix.bm25, queries, settings.bm25_top_k, tokenize)
    channels = {"dense": dense.join(body, "id"), "bm25": lexical.join(body, "id")}
    if multi:
        found = {"title": retrieve.scaled_search(ix.titles, queries, k, tokenize), "keyword": retrieve.keyword_search(ix.keywords, queries, k, tokenize), "summary": retrieve.scaled_search(ix.summaries, queries, k, tokenize)}
        channels |= {name: hits.join(ix.extra, "id") for name, hits in found.items()}
    fused = retrieve.fuse(channels, settings.rrf_k).join(queries, "query_id").join(ix.chunks.select(F.col("chunk_id").alias("id"), "type"), "id", "left")
    if staged:
        typed = fused if "question_type" in fused.columns else fused.withColumn("question_type", A.classify(F.col("question")))
        return rerank.multi_stage(typed, settings.coarse_k, settings.fine_k, settings.final_top_k, settings.mmr_weight, scorer, tokenize)
    return rerank.head(rerank.rerank(fused, scorer) if scorer else fused, settings.final_top_k)


def answer(ix: Indexes, queries: DataFrame, model: LanguageModel, images: DataFrame | None = None, settings: Settings = Settings(), tokenize: Tokenizer = tokens, **options) -> DataFrame:
    """The submission: question, filename, page, answer, question_type, citations, has_citations, self_check, image_path.

    ``images`` (filename, page, image_path) gives the image of the first page found; the model reads text alone.
    """
    hits = search(ix, queries, settings=settings, tokenize=tokenize, **options)
    told = retrieve.contexts(hits, queries, images)
    rows = generate(queries.join(told, "query_id").withColumnRenamed("context_text", "context"), model, temperature=settings.temperature, max_tokens=settings.max_new_tokens)
    check = A.self_check(F.col("answer"), F.col("context"), tokenize)
    return rows.select("query_id", "question", F.col("top_filename").alias("filename"), F.col("top_page").alias("page"), "answer", "question_type", "citations", (F.size("citations") > 0).alias("has_citations"), check.alias("self_check"), "image_path")
