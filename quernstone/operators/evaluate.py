"""Evaluation: answers against gold, retrieval ranks, errors by group, and votes among answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def _pairs(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions with the last gold answer (by ``ord``) of the same stripped question; blank gold questions don't count."""
    q = T.strip(F.col("question"))
    last = gold.withColumn("question", q).where("question <> ''").groupBy("question").agg(F.max_by("answer", "ord").alias("gold"))
    return pred.withColumn("question", q).withColumnRenamed("answer", "pred").join(last, "question")


def answer_scores(pred: DataFrame, gold: DataFrame, tokenize: T.Tokenizer = T.tokens) -> DataFrame:
    """Each matched prediction's exact_match, char_f1, word_f1, rouge_l and number_f1; numbers are read from raw texts."""
    pairs = _pairs(pred, gold).withColumn("p", T.normalize(F.col("pred"))).withColumn("g", T.normalize(F.col("gold")))
    p, g = F.col("p"), F.col("g")
    scored = pairs.withColumn("lcs", T.lcs_length(p, g))
    rouge = T.prf(F.col("lcs"), F.length(p), F.length(g))["f1"]
    return scored.select(
        *[c for c in pred.columns if c != "answer"], "pred", "gold", (p == g).cast("double").alias("exact_match"),
        T.char_f1(p, g)["f1"].alias("char_f1"), T.word_f1(p, g, tokenize)["f1"].alias("word_f1"), rouge.alias("rouge_l"), T.number_f1(F.col("pred"), F.col("gold")).alias("number_f1"),
    )


METRICS = ["exact_match", "char_f1", "word_f1", "rouge_l", "number_f1"]


def evaluate(scores: DataFrame) -> DataFrame:
    """One row: count and the mean of each metric, rounded to 6 places."""
    return scores.agg(F.count("*").alias("count"), *(F.round(F.avg(m), 6).alias(m) for m in METRICS))


def extremes(scores: DataFrame, key: str) -> DataFrame:
    """The best and the worst prediction by ROUGE-L; ties go to the smaller key."""
    best = F.struct(F.col("rouge_l"), -F.col(key))
    worst = F.struct(F.col("rouge_l"), F.col(key))
    return scores.agg(F.max_by(key, best).alias("best"), F.round(F.max("rouge_l"), 6).alias("best_rouge_l"), F.min_by(key, worst).alias("worst"), F.round(F.min("rouge_l"), 6).alias("worst_rouge_l"))


def containing(docs: DataFrame, postings: DataFrame, terms: DataFrame, passages: DataFrame, tokenize: T.Tokenizer = T.tokens) -> DataFrame:
    """(query_id, id): the documents (id, text) whose text holds the passage (query_id, question), out of all.

    A text that holds a passage has all its tokens but perhaps the first and the
    last, which may be parts of longer words there. So documents are looked up
    by the rarest token in between, and then compared. Passages without one are
    compared with every document.
    """
    known = T.let(tokenize(F.col("question")), lambda t: F.slice(t, 2, F.greatest(F.size(t) - 2, F.lit(0))))
    asked = passages.where(F.length("question") > 0).withColumn("inner", known)
    words = asked.select("query_id", F.explode(F.array_distinct("inner")).alias("term")).join(terms.select("term", "df"), "term", "left")
    rarest = words.groupBy("query_id").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("least")).select("query_id", "least.term")
    near = postings.join(rarest.select("term").distinct(), "term", "left_semi").join(rarest, "term").select("query_id", "id")
    found = near.join(asked.select("query_id", "question"), "query_id").join(docs.select("id", "text"), "id").where(F.col("text").contains(F.col("question")))
    short = asked.where(F.size("inner") == 0).select("query_id", "question")
    return found.select("query_id", "id").union(docs.join(short, F.col("text").contains(F.col("question"))).select("query_id", "id"))


def first_ranks(gold: DataFrame, hits: DataFrame, most: int) -> DataFrame:
    """(query_id, rank): the first rank with the gold file and page, 0 if it is not among the ``most`` first."""
    told = gold.where((T.strip(F.col("question")) != "") & (F.col("page") >= 0))
    near = hits.where(F.col("rank") <= most).select("query_id", "filename", "page", "rank")
    found = near.join(told.select("query_id", "filename", "page"), ["query_id", "filename", "page"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return told.select("query_id").distinct().join(found, "query_id", "left").select("query_id", F.coalesce("rank", F.lit(0)).cast("long").alias("rank"))


def retrieval_metrics(gold: DataFrame, hits: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """(k, count, recall, hit_rate, mrr): recall and hit rate count the same events and are equal."""
    ranks = first_ranks(gold, hits, max(ks))
    cuts = ranks.select("rank", F.explode(F.array(*(F.lit(k).cast("long") for k in ks))).alias("k"))
    hit = F.avg(((F.col("rank") > 0) & (F.col("rank") <= F.col("k"))).cast("double"))
    return cuts.groupBy("k").agg(F.count("*").alias("count"), F.round(hit, 9).alias("recall"), F.round(hit, 9).alias("hit_rate"), F.round(F.avg(F.when(F.col("rank") > 0, 1.0 / F.col("rank")).otherwise(0.0)), 9).alias("mrr"))


def judged(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Matched predictions with ``error``: the stripped answers differ."""
    return _pairs(pred, gold).withColumn("error", T.strip(F.col("pred")) != T.strip(F.col("gold")))


def error_rates(rows: DataFrame, by: str) -> DataFrame:
    """(group, total, errors, error_rate); a missing group is unknown."""
    errors = F.sum(F.col("error").cast("long"))
    return rows.groupBy(F.coalesce(F.col(by).cast("string"), F.lit("unknown")).alias("group")).agg(F.count("*").alias("total"), errors.alias("errors"), F.round(errors / F.count("*"), 9).alias("error_rate"))


def vote(answers: DataFrame, group: str, idx: str = "idx", answer: str = "answer", tokenize: T.Tokenizer = T.tokens) -> DataFrame:
    """(group, best_idx, votes): the answer most like its group's others, and how many are nearly as alike.

    Similarities are overlaps of token sets; the first of the best wins; votes
    are answers with at least 0.8 of the best sum, a lone answer has one.
    A group's answers meet in one row, as arrays of token sets, so that no pairs
    are written; groups are the few answers given to one question.
    """
    item = F.struct(F.col(idx).alias("idx"), T.token_set(F.col(answer), P.STOP_WORDS, tokenize).alias("set"))
    rows = answers.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    total = lambda x: F.aggregate("items", F.lit(0.0), lambda s, y: s + F.when(x["idx"] == y["idx"], 0.0).otherwise(T.jaccard(x["set"], y["set"])))
    scored = rows.select(group, F.transform("items", lambda x: F.struct((-F.round(total(x), 9)).alias("neg"), x["idx"].alias("idx"))).alias("scores"))
    best = F.array_min("scores")
    return scored.select(group, best["idx"].alias("best_idx"), F.size(F.filter("scores", lambda s: -s["neg"] >= F.round(-best["neg"] * 0.8, 9))).cast("long").alias("votes"))
