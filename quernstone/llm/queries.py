"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import hidden_markov, langid, media, mixing, near_vectors, ngram_join, packing, periodic, sharding, substring, suffix, tokens, vector_codes

MODEL, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir), k=3, num=90, den=100)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir), weights=(3, 1, 2), share=1.5, cap=2.0)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(table(spark, sf_dir).select("doc_id", "text"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.remove_repeats(table(spark, sf_dir), span=20))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir), tokens.public_path(MODEL), tokens.public_path(RANKS), window=1024, end_id=0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir), tokens.public_path(MODEL), tokens.public_path(RANKS), limit=1024)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digest(suffix.remove_repeats(table(spark, sf_dir), span=200))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir).select("doc_id"), "doc_id", SHARDS)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = "crc32(cast(cast(doc_id AS string) AS binary)) % 5"
    found = hidden_markov.score(table(spark, sf_dir).select("doc_id", "text"), learn=f"{part} <> 1")
    return found.select("doc_id", F.expr(f"coalesce({part} = 1, false)").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.periodic_runs(table(spark, sf_dir).select("doc_id", "text"), times=4, least=6, plant=True))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_join, op2_embedding_dedup, op3_mixing, op4_media, op5_substring_dedup, op6_packing, op7_token_counts, op8_language_id, op9_suffix_dedup, op10_sharding, op11_vector_codes, op12_lm_scores, op13_periodic_runs)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": ngram_join.ORACLE,
        "op2_embedding_dedup": near_vectors.ORACLE,
        "op3_mixing": mixing.ORACLE,
        "op5_substring_dedup": substring.ORACLE,
        "op9_suffix_dedup": suffix.ORACLE,
        "op11_vector_codes": vector_codes.oracle(),
    }
