"""A cleaning pipeline over ``documents``; each stage is one of the training-data operators.

Stages take (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import langid, mixing, ngram_join, packing, substring, tokens
from quernstone.llm.common import discard, materialize, tidy
from quernstone.llm.queries import MODEL, RANKS, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the language model rejects: null texts, texts without a letter, and scores under the calibrated threshold.

    The threshold is what one right answer in a thousand falls below, so some
    documents go whose language was right. Rows with a null or repeated id are
    judged like others, repeated rows alike; rows without a label teach nothing. An
    empty table, or one without labels, gives no rows.
    """
    return langid.predict(docs, langid.fit(docs)).where(~F.col("rejected")).select(docs.columns)


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with a number for each distinct (doc_id, text) in the order of ids, as ``_row``, and whether an id repeats.

    Operators know rows by their id. Where ids repeat, numbers keep rows of one id
    and different texts apart; equal rows share theirs. A null id has none.
    """
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.withColumn("_row", F.col("doc_id").cast("long")), False
    marked = docs.withColumn("_text", F.coalesce(F.sha2("text", 256), F.lit("")))
    keys = marked.where("doc_id is not null").select("doc_id", "_text").distinct().orderBy("doc_id", "_text").withColumn("_row", F.monotonically_increasing_id())
    return materialize(marked.join(materialize(keys, "row-numbers"), ["doc_id", "_text"], "left").select(*docs.columns, "_row"), "numbered"), True


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of near-duplicates, of its smallest id: five-word shingles, Jaccard 0.8 or more.

    Of rows with one id and one text one stays, with words or without. Rows with a null id all stay.
    """
    rows, repeats = numbered(docs)
    found = ngram_join.jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text"), k=5, num=8, den=10)
    kept = rows.join(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_row")), "_row", "left_anti")
    if not repeats:
        return kept.select(docs.columns)
    once = kept.where("_row is not null").groupBy("_row").agg(F.min(F.struct(*docs.columns)).alias("one")).select("one.*")
    return once.unionByName(kept.where("_row is null").select(docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that stand in an earlier document; drop documents of which nothing is left.

    Rows of one id and one text are one place and come out alike; of rows of one
    id and different texts, each loses its own passages alone. Null ids count as
    the largest. Null and empty texts stay; an empty table gives none.
    """
    cut = F.col("n_removed") > 0
    found = substring.remove_repeats(docs, span=50, carry=docs.columns).where(~cut | (F.col("kept_text") != ""))
    n_chars = F.when(cut, F.length("kept_text").cast("long")).otherwise(F.col("carried.n_chars"))
    new = {"text": F.when(cut, F.col("kept_text")).otherwise(F.col("carried.text")), "n_chars": n_chars}
    return found.select(*(new.get(c, F.col("carried")[c]).alias(c) for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document as often as its source's target asks, or drop it.

    Rows with a null id are dealt like others, a null source is a source, rows of one id and one text are
    taken together, and null and empty texts have no words to take. An empty table gives no rows.
    """
    return mixing.repeated(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into training sequences, one row a piece.

    Null and empty texts are the end id alone; rows with null ids and repeated
    rows are packed like others; very long texts fill windows of their own. An empty table gives none.
    """
    return packing.pack(docs, tokens.public_path(MODEL), tokens.public_path(RANKS))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("substring dedup", repeated_passages), ("mixing", mixture), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        with tidy() as keep:
            docs = keep(materialize(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
