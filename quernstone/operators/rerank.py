"""Reranking of hits (query_id, id, rank, content, ...): by a scorer, for diversity, by question type, in stages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions import patterns as P
from ..functions.text import Tokenizer, token_set, tokens
from ..plugins import Scorer
from ..session import ship


def head(hits: DataFrame, k: int) -> DataFrame:
    return hits.where(F.col("rank") <= k)


def _ranked(hits: DataFrame, *order) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(window).cast("long"))


def rerank(hits: DataFrame, scorer: Scorer | None = None, tokenize: Tokenizer = tokens, at_once: int = 32, profile: ResourceProfile | None = None) -> DataFrame:
    """New ranks by ``rerank_score`` of (question, content); the default is the share of the question's words found.

    ``hits`` has question and content. Ties keep their order. A scorer gets
    ``at_once`` pairs of about one length a call; with ``profile`` its stage asks for resources of its own, an
    accelerator say.
    """
    if scorer is None:
        asked = token_set(F.col("question"), None, tokenize)
        n = F.size(asked)
        found = F.col("_set") if "_set" in hits.columns else token_set(F.col("content"), None, tokenize)
        score = F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(asked, found)) / n)
        scored = hits.withColumn("rerank_score", F.round(score, 9))
    else:
        scored = _scored(hits, scorer, "question", "content", "rerank_score", at_once, profile).withColumn("rerank_score", F.round("rerank_score", 9))
    return _ranked(scored, F.desc("rerank_score"), "rank")


def mmr(hits: DataFrame, k: int = 5, weight: float = 0.7, relevance: str = "score", scorer: Scorer | None = None, tokenize: Tokenizer = tokens, most: int | None = None) -> DataFrame:
    """Greedy maximal marginal relevance: k rounds among the hits of each query.

    Each round takes the hit with the highest weight * relevance - (1 - weight) *
    largest similarity to those taken; earlier ranks win ties. Similarity is the
    overlap of token sets; with a scorer it is the score of the pair, the earlier
    hit first, and relevance the score of the question with the hit. Queries with
    k hits or fewer keep their order. A query's candidates are compared in one task: as many as a
    search was asked for, or the first ``most`` where a caller says so.
    """
    if scorer is not None:
        hits = _scored(hits, scorer, "question", "content", "_relevance")
        relevance = "_relevance"
    n = F.count("*").over(Window.partitionBy("query_id"))
    base = hits.withColumn("_n", n)
    few = base.where(F.col("_n") <= k).drop("_n", "_relevance", "_set")
    many = base.where(F.col("_n") > k) if most is None else base.where((F.col("_n") > k) & (F.col("rank") <= most))
    if scorer is None:
        found = F.col("_set") if "_set" in hits.columns else token_set(F.col("content"), None, tokenize)
        rows = many.select("query_id", "rank", F.col(relevance).cast("double").alias("rel"), found.alias("like"))
    else:
        rows = many.select("query_id", "rank", F.col(relevance).cast("double").alias("rel")).join(_pair_scores(many, scorer), ["query_id", "rank"])
    pick = _by_sets if scorer is None else _by_scores
    kind = hits.schema["query_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        taken = pick(table["rel"].to_pylist(), table["rank"].to_pylist(), table["like"].to_pylist(), k, weight)
        return pa.table({"query_id": table["query_id"].take(pa.array(taken)), "old": table["rank"].take(pa.array(taken)), "new": pa.array(range(1, len(taken) + 1), pa.int64())})

    taken = rows.groupBy("query_id").applyInArrow(run, f"query_id {kind}, old long, new long")
    moved = hits.join(taken, (hits.query_id == taken.query_id) & (hits["rank"] == taken.old)).drop(taken.query_id).withColumn("rank", F.col("new")).drop("new", "old", "_relevance", "_set")
    return few.unionByName(moved)


def _greedy(rel: list[float], k: int, weight: float, like: Callable[[int, int], float]) -> list[int]:
    """The hits taken, in order; ``worst`` keeps each hit's largest similarity so far, so a round compares with the last one taken alone."""
    left, taken, worst = list(range(len(rel))), [], [None] * len(rel)
    while left and len(taken) < k:
        value = lambda i: round(weight * rel[i] - (1 - weight) * (worst[i] or 0.0), 12)
        best = max(left, key=lambda i: (value(i), -i))
        left.remove(best)
        taken.append(best)
        for i in left:
            near = like(i, best)
            worst[i] = near if worst[i] is None else max(worst[i], near)
    return taken


def _by_sets(rel: list[float], ranks: list[int], sets: list[list[str] | None], k: int, weight: float) -> list[int]:
    own = [frozenset(x or ()) for x in sets]

    def overlap(i: int, j: int) -> float:
        common = len(own[i] & own[j])
        return common / (len(own[i]) + len(own[j]) - common) if common else 0.0

    return _greedy(rel, k, weight, overlap)


def _by_scores(rel: list[float], ranks: list[int], maps: list[list[tuple[int, float]]], k: int, weight: float) -> list[int]:
    own = [dict(x) for x in maps]
    return _greedy(rel, k, weight, lambda i, j: own[j][ranks[i]])


def _scored(rows: DataFrame, scorer: Scorer, one: str, other: str, name: str, at_once: int = 32, profile: ResourceProfile | None = None) -> DataFrame:
    """``rows`` with the score of two text columns."""

    ship(rows.sparkSession)
    fields = StructType([*(f for f in rows.schema.fields if f.name != name), StructField(name, DoubleType())])
    columns = fields.fieldNames()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pairs = list(zip(batch[one], batch[other], strict=True))
            yield batch.assign(**{name: in_length_order(scorer, pairs, at_once)})[columns]

    return rows.mapInPandas(run, fields, profile=profile)


def in_length_order(scorer: Scorer, pairs: list[tuple[str, str]], at_once: int) -> list[float]:
    """Scores in the order of ``pairs``; the scorer gets ``at_once`` pairs of about one length a call, longest first, so that little is padded."""
    order = sorted(range(len(pairs)), key=lambda i: -sum(len(x or "") for x in pairs[i]))
    out = [0.0] * len(pairs)
    for k in range(0, len(order), at_once):
        part = order[k : k + at_once]
        for i, score in zip(part, scorer.predict([pairs[i] for i in part]), strict=True):
            out[i] = float(score)
    return out


def _pair_scores(hits: DataFrame, scorer: Scorer) -> DataFrame:
    """(query_id, rank, like): each hit's score with the others of its query, by their rank; both ways alike."""
    one = hits.select("query_id", F.col("rank").alias("x"), F.col("content").alias("a"))
    other = hits.select("query_id", F.col("rank").alias("y"), F.col("content").alias("b"))
    pairs = _scored(one.join(other, "query_id").where("x < y"), scorer, "a", "b", "s").select("query_id", "x", "y", "s")
    both = pairs.union(pairs.select("query_id", F.col("y").alias("x"), F.col("x").alias("y"), "s"))
    return both.groupBy("query_id", F.col("x").alias("rank")).agg(F.map_from_entries(F.collect_list(F.struct("y", "s"))).alias("like"))


def by_question_type(hits: DataFrame) -> DataFrame:
    """Tables first for facts, passages that refer to figures first for charts; else unchanged. Nothing is dropped."""
    first = F.when(F.col("question_type") == "fact_extraction", F.col("type") == "table")
    first = first.when(F.col("question_type") == "chart_understanding", F.col("content").rlike("(?U)" + P.CHART_REFERENCE)).otherwise(False)
    return _ranked(hits.withColumn("_first", first), F.desc("_first"), "rank").drop("_first")


def multi_stage(hits: DataFrame, coarse: int = 50, fine: int = 20, final: int = 5, weight: float = 0.7, scorer: Scorer | None = None, tokenize: Tokenizer = tokens) -> DataFrame:
    """Coarse cut, scorer, fine cut, diversity, question type; types permute the final hits alone."""
    first = head(hits, coarse)
    if scorer is None:  # the scorer and the diversity compare the same sets
        first = first.withColumn("_set", token_set(F.col("content"), None, tokenize))
    scored = rerank(first, scorer, tokenize)
    diverse = mmr(head(scored, fine), final, weight, "rerank_score", scorer, tokenize)
    return head(by_question_type(diverse), final)
