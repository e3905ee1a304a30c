"""BM25 top-k over postings in blocks, so that most blocks are never scored.

Texts are dealt into buckets of about ``BUCKET``: by length class and by their most
frequent term, which keeps languages and subjects apart, then by a hash of their ids. A block holds the postings of one term in one bucket, and the largest
score that any of them can give. For a query, the largest scores of its terms
bound what a text of a bucket can reach. The most promising buckets are scored
first; the k-th score there is a threshold, and only buckets whose bound
reaches it are scored after them. Hits are those of ``bm25_search``, ties included.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import Tokenizer, tokens
from ..session import beside, pieces, small
from .index import B, K1, LexicalIndex, by_text
from .retrieve import top_k

#: Texts of a bucket, length classes a doubling of the length, and kinds of texts by their most frequent term.
BUCKET, CLASSES, KINDS = 256, 2, 64
#: What rounding may hide: bounds within this of the threshold are scored.
SLACK = 1e-8


def length_class(dl) -> F.Column:
    return F.floor(CLASSES * F.log2(1.0 + dl)).cast("long")


@dataclass
class BlockIndex:
    """blocks (term, bucket, top, n, postings: (id, tf, dl)), terms (term, df, idf)."""

    blocks: DataFrame
    terms: DataFrame

    @staticmethod
    def build(index: LexicalIndex, path: str, bucket: int = BUCKET) -> BlockIndex:
        """Write the blocks of a lexical index, those of a bucket together, sorted by term.

        A text is in one bucket with all its terms, so texts move to their bucket
        whole, and blocks are made where they arrive. Texts without terms are in
        no bucket, which loses no hit. An index without postings has no blocks.
        """
        spark = index.postings.sparkSession
        texts = index.texts if index.texts is not None else by_text(index.postings)
        texts = texts.withColumn("kind", length_class(F.col("dl")) * KINDS + F.pmod(F.xxhash64("main"), F.lit(KINDS)))
        sizes = texts.groupBy("kind").agg(F.ceil(F.count("*") / bucket).alias("buckets"))  # KINDS times some dozen classes, whatever the corpus
        placed = texts.join(F.broadcast(sizes), "kind").select("id", "words", (F.col("kind") * F.lit(1 << 40) + F.pmod(F.xxhash64("id"), F.col("buckets"))).alias("bucket"))
        n = pieces(texts.select("id", "words"), 1 << 20)
        placed = placed.repartition("bucket") if n is None else placed.repartition(n, "bucket")
        rows = placed.select("bucket", "id", F.explode("words").alias("w")).crossJoin(F.broadcast(index.corpus.select("avgdl")))  # corpus: one row
        part = F.col("w.tf") * (K1 + 1) / (F.col("w.tf") + K1 * (1 - B + B * F.col("w.dl") / F.col("avgdl")))
        rows = rows.select(F.col("w.term").alias("term"), "bucket", "id", part.alias("part"))
        blocks = rows.groupBy("term", "bucket").agg(F.max("part").alias("top"), F.count("*").alias("n"), F.collect_list(F.struct("id", "part")).alias("postings"))
        blocks.sortWithinPartitions("term", "bucket").write.mode("overwrite").parquet(f"{path}/blocks")
        index.terms.write.mode("overwrite").parquet(f"{path}/terms")
        return BlockIndex.load(spark, path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> BlockIndex:
        return BlockIndex(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/terms"))

    def weighted(self, queries: DataFrame, tokenize: Tokenizer) -> DataFrame:
        """(query_id, term, w) of the queries' terms."""
        asked = queries.select("query_id", F.explode(tokenize(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        return asked.join(self.terms.select("term", "idf"), "term").select("query_id", "term", (F.col("qtf") * F.col("idf")).alias("w"))

    def search(self, queries: DataFrame, k: int = 10, first: int = 4, tokenize: Tokenizer = tokens) -> DataFrame:
        """(query_id, id, score, rank): the top k, then those above 0, from the ``first`` best buckets and from all that may hold more."""
        asked = self.weighted(queries, tokenize)
        early, bounds = self._plan(queries, asked, k, first)
        late = self._met(self._wanted(queries, asked, bounds.where("scored AND NOT ahead").select("query_id", "bucket")))
        return top_k(early.unionByName(late), k).where("score > 0")

    def report(self, queries: DataFrame, k: int = 10, first: int = 4, tokenize: Tokenizer = tokens) -> DataFrame:
        """(query_id, blocks, read): the blocks of each query's terms, and how many of them a search scores."""
        asked = self.weighted(queries, tokenize)
        bounds = self._plan(queries, asked, k, first)[1]
        return bounds.groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum(F.when(F.col("scored"), F.col("blocks")).otherwise(0)).alias("read"))

    def _bounds(self, queries: DataFrame, asked: DataFrame, first: int) -> DataFrame:
        """(query_id, bucket, bound, blocks, place): what a text of a bucket can reach, best first; place is exact up to ``first``."""
        heads = self.blocks.select("term", "bucket", "top").join(beside(asked, queries), "term")
        bounds = heads.groupBy("query_id", "bucket").agg(F.sum(F.greatest(F.col("w"), F.lit(0.0)) * F.col("top")).alias("bound"), F.count("*").alias("blocks"))
        best = Window.partitionBy("query_id").orderBy(F.desc("bound"), "bucket")
        ahead = bounds.withColumn("place", F.row_number().over(best)).where(F.col("place") <= first).select("query_id", "bucket", "place")
        placed = bounds.join(beside(ahead, queries), ["query_id", "bucket"], "left")  # so that no task gets all buckets of a query
        return placed.withColumn("place", F.coalesce("place", F.lit(first + 1)))

    def _plan(self, queries: DataFrame, asked: DataFrame, k: int, first: int) -> tuple[DataFrame, DataFrame]:
        """Scores of the first buckets, and all bounds with ``ahead``, whether a bucket is one of the first, and ``scored``, whether it is scored at all."""
        bounds = self._bounds(queries, asked, first)
        wanted = self._wanted(queries, asked, bounds.where(F.col("place") <= first).select("query_id", "bucket"))
        # ``first`` rows a term of a query: few beside the blocks, so that blocks stay where they are.
        early = self._met(F.broadcast(wanted) if small(queries, (2 << 20) // first) else wanted)
        least = top_k(early, k).groupBy("query_id").agg(F.when(F.count("*") == k, F.greatest(F.min("score"), F.lit(0.0))).otherwise(0.0).alias("least"))
        both = bounds.join(beside(least, queries), "query_id", "left").withColumn("ahead", F.col("place") <= first)
        late = (F.col("bound") > 0) & (F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK)
        return early, both.withColumn("scored", F.col("ahead") | late).drop("least")

    def _wanted(self, queries: DataFrame, asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """(query_id, bucket, term, w): the blocks of some buckets of queries."""
        return pairs.join(beside(asked, queries), "query_id").select("query_id", "bucket", "term", "w")

    def _met(self, wanted: DataFrame) -> DataFrame:
        """(query_id, id, score) of all texts of the wanted blocks."""
        met = self.blocks.select("term", "bucket", "postings").join(wanted, ["term", "bucket"]).select("query_id", "w", F.explode("postings").alias("p"))
        return met.groupBy("query_id", F.col("p.id").alias("id")).agg(F.sum(F.col("w") * F.col("p.part")).alias("score"))
