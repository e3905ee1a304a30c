"""Every query of the library by name, with its counterpart in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bases
from .functions import answers as A
from .functions import patterns as P
from .functions import text as T
from .operators import block_index, chunk, enrich, evaluate, generate, index, parse, rerank, retrieve, segments, vector_index, wordlist
from .oracles import SQL
from .plans import pipeline
from .plugins import EchoModel
from .session import shared_dir, ship, spread
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark, d):
    """Documents as they are read; indexes deal them by id themselves."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.col("source").alias("filename"), F.col("doc_id").alias("page"))


def documents(spark, d):
    return spread(corpus(spark, d))


def benchmark(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))


def answers(spark, d):
    return bases.spark_rows(spark, d, bases.ANSWERS)


def questions(spark, d):
    return bases.spark_rows(spark, d, bases.QUESTIONS)


def replies(spark, d):
    return bases.spark_rows(spark, d, bases.REPLIES)


def pages(spark, d):
    return parse.split_pages(bases.spark_rows(spark, d, bases.MARKDOWN))


def predictions(spark, d):
    return bases.spark_rows(spark, d, bases.PREDICTIONS)


def gold(spark, d):
    return bases.spark_rows(spark, d, bases.GOLD)


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def listed(x) -> F.Column:
    """An array of strings as one string, so that any engine compares it."""
    return F.array_join(x, "|")


# --- indexes and retrieval


@query
def token_counts(spark, d):
    return index.token_counts(table(spark, d, "documents"), "doc_id")


@query
def page_tokens(spark, d):
    """Words, digits and pairs of Chinese characters of Markdown pages."""
    return index.token_counts(pages(spark, d).select(F.concat_ws("_p", "filename", "page").alias("id"), "text"), "id")


@query
def page_topk(spark, d):
    """BM25 over Chinese pages with Chinese questions."""
    rows = pages(spark, d).select(F.concat_ws("_p", "filename", "page").alias("id"), "text")
    hits = retrieve.bm25_once(rows, "id", bases.spark_rows(spark, d, bases.TITLE_QUESTIONS), _folder(spark, "pages-asked"), 10)
    return rounded(hits.select("query_id", "rank", "id", "score"), "score")


def _bm25(spark, d, path=None):
    return index.lexical_index(corpus(spark, d), "id", path=path)


def _blocks(spark, d):
    path = _folder(spark, "block-index")
    return block_index.BlockIndex.build(_bm25(spark, d, path), path)


@query
def bm25_term_stats(spark, d):
    return rounded(_bm25(spark, d).terms, "idf")


@query
def bm25_topk(spark, d):
    hits = retrieve.bm25_search(_bm25(spark, d), benchmark(spark, d), 10)
    return rounded(hits.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score"), "score")


def _dense(spark, d, k=10):
    v = vectors(spark, d)
    items = benchmark(spark, d).select("query_id")
    asked = v.join(items, v.id == items.query_id).select("query_id", "embedding")
    return retrieve.dense_search(v, asked, k)


@query
def dense_topk(spark, d):
    return rounded(_dense(spark, d).select("query_id", "rank", F.col("id").alias("vec_id"), "score"), "score")


def _folder(spark, name):
    """A new folder among those that driver and executors share, for an index that the returned rows read."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _some_vectors(spark, d):
    """Every twentieth vector asks."""
    return vectors(spark, d).where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")


@query
def vector_index_topk(spark, d):
    """All vectors in cells; every twentieth asks, and the cells that may hold something better are read after the probed ones."""
    found = vector_index.VectorIndex.build(vectors(spark, d), _folder(spark, "vector-index"))
    return rounded(found.search(_some_vectors(spark, d), 10, exact=True).select("query_id", "rank", F.col("id").alias("vec_id"), "score"), "score")


@query
def vector_index_recall(spark, d):
    """Of the exact ten of every twentieth vector, how many the probed cells alone give."""
    asked = _some_vectors(spark, d)
    found = vector_index.VectorIndex.build(vectors(spark, d), _folder(spark, "vector-index")).search(asked, 10)
    exact = retrieve.dense_search(vectors(spark, d), asked, 10)
    both = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return both.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))


@query
def bm25_block_topk(spark, d):
    """BM25 over postings in blocks, most of which are passed over."""
    return rounded(_blocks(spark, d).search(benchmark(spark, d), 10).select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score"), "score")


@query
def bm25_block_report(spark, d):
    """The blocks of each question's terms, and how many of them a search scores."""
    return _blocks(spark, d).report(benchmark(spark, d), 10).withColumnRenamed("query_id", "item_id")


@query
def bm25_segments_topk(spark, d):
    """An index that grew: at first all documents, French ones by their source alone; then the texts of these; then toxic documents go."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang", "source")
    ix = segments.SegmentedIndex(spark, _folder(spark, "segments"))
    ix.add(docs.select("id", F.when(F.col("lang") == "fr", F.col("source")).otherwise(F.col("text")).alias("text")))
    ix.add(docs.where("lang = 'fr'").select("id", "text"))
    ix.delete(table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("id")))
    hits = retrieve.bm25_search(ix.index(), benchmark(spark, d), 10)
    return rounded(hits.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score"), "score")


@query
def word_candidates(spark, d):
    """Stretches of Chinese characters over all pages, with what decides whether they are words."""
    return rounded(wordlist.candidates(pages(spark, d)), "cohesion", "freedom")


@query
def segmented_tokens(spark, d):
    """Words of Chinese pages along the likeliest path, by the words of the same pages."""
    rows = pages(spark, d).select("filename", "page", "text")
    cut = wordlist.tokenizer(wordlist.words(wordlist.candidates(rows)))
    return rows.select("filename", "page", listed(cut(F.col("text"))).alias("tokens"))


@query
def segmented_topk(spark, d):
    """BM25 over Chinese pages, cut into learned words."""
    rows = pages(spark, d).select(F.concat_ws("_p", "filename", "page").alias("id"), "text")
    cut = wordlist.tokenizer(wordlist.words(wordlist.candidates(rows)))
    hits = retrieve.bm25_search(index.lexical_index(rows, "id", tokenize=cut), bases.spark_rows(spark, d, bases.TITLE_QUESTIONS), 10, cut)
    return rounded(hits.select("query_id", "rank", "id", "score"), "score")


@query
def tfidf_topk(spark, d):
    hits = retrieve.keyword_search(index.tfidf_index(corpus(spark, d), "id"), benchmark(spark, d), 5)
    return rounded(hits.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score"), "score")


@query
def title_rows(spark, d):
    return parse.titles(pages(spark, d))


@query
def title_topk(spark, d):
    rows = parse.titles(pages(spark, d)).select(F.concat_ws("", "filename", F.lit("_p"), "page", F.lit("_"), "line").alias("id"), "title")
    hits = retrieve.scaled(retrieve.bm25_once(rows, "id", bases.spark_rows(spark, d, bases.TITLE_QUESTIONS), _folder(spark, "titles-asked"), 5, "title"))
    return rounded(hits.select("query_id", "rank", "id", "score"), "score")


@query
def summary_rows(spark, d):
    return documents(spark, d).select(F.col("id").alias("doc_id"), parse.summary(F.col("text")).alias("summary"))


def _summaries(spark, d):
    return documents(spark, d).select("id", parse.summary(F.col("text")).alias("summary")).where("summary <> ''")


@query
def summary_topk(spark, d):
    hits = retrieve.scaled_search(index.lexical_index(_summaries(spark, d), "id", "summary"), benchmark(spark, d), 5)
    return rounded(hits.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score"), "score")


def _title_hits(spark, d, k=5):
    """Documents as pages: the headings of their texts, searched like titles; a document ranks by its best heading."""
    heads = parse.titles(documents(spark, d)).select(F.col("page").alias("doc"), F.concat_ws("_", "page", "line").alias("id"), "title")
    hits = retrieve.scaled_search(index.lexical_index(heads.select("id", "title"), "id", "title"), benchmark(spark, d), k)
    return hits.join(heads.select("id", "doc"), "id").select("query_id", F.col("doc").alias("id"), "score", "rank")


def _fused(spark, d):
    """Channels over documents; a vector with a document's id stands in for its embedding. Texts join the few that are shown."""
    docs, asked = corpus(spark, d), benchmark(spark, d)
    found = {
        "dense": _dense(spark, d), "bm25": retrieve.bm25_search(index.lexical_index(docs, "id"), asked, 10), "title": _title_hits(spark, d),
        "keyword": retrieve.keyword_search(index.tfidf_index(docs, "id"), asked, 5), "summary": retrieve.scaled_search(index.lexical_index(_summaries(spark, d), "id", "summary"), asked, 5),
    }
    tails = {"dense": "_text", "bm25": "_text", "title": "_title", "keyword": "_keyword", "summary": "_summary"}
    # Hits are fused by document and tail; names come from documents afterwards, for what was found alone.
    tailed = {n: hits.select("query_id", "rank", F.concat_ws("", F.col("id").cast("string"), F.lit(tails[n])).alias("id"), F.col("id").alias("doc"), F.lit(tails[n]).alias("tail")) for n, hits in found.items()}
    return retrieve.fuse(tailed, payload=("doc", "tail"))


@query
def rrf_fusion(spark, d):
    names = corpus(spark, d).select(F.col("id").alias("doc"), "filename", "page")
    fused = _fused(spark, d).join(names, "doc").withColumn("id", F.concat_ws("", "filename", F.lit("_p"), "page", "tail"))
    return rounded(fused.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("chunk_id"), "score", listed("sources").alias("sources")), "score", places=9)


@query
def context_text(spark, d):
    body = corpus(spark, d).select(F.col("id").alias("doc"), F.col("text").alias("content"), "filename", "page")
    told = retrieve.contexts(rerank.head(_fused(spark, d), 3).join(body, "doc"), benchmark(spark, d))
    return told.select(F.col("query_id").alias("item_id"), "top_filename", F.col("top_page").cast("long").alias("top_page"), F.md5("context_text").alias("context_md5"), F.length("context_text").cast("long").alias("context_len"), "n_hits")


def _hits(spark, d, k=10):
    """BM25 hits with content, for reranking; every other document counts as a table."""
    hits = retrieve.bm25_search(_bm25(spark, d), benchmark(spark, d), k)
    body = documents(spark, d).select("id", F.col("text").alias("content"), F.when(F.col("id") % 2 == 0, "table").otherwise("text").alias("type"))
    kinds = F.element_at(F.array(*map(F.lit, P.QUESTION_PATTERNS)), (F.col("query_id") % 4 + 1).cast("int"))
    return hits.join(body, "id").join(benchmark(spark, d), "query_id").withColumn("question_type", kinds)


def _ids(df):
    return df.select(F.col("query_id").alias("item_id"), "rank", F.col("id").alias("doc_id"))


@query
def rerank_lexical(spark, d):
    return _ids(rerank.rerank(_hits(spark, d)))


@query
def mmr_rerank(spark, d):
    scaled = _hits(spark, d).withColumn("score", F.round(F.col("score") / 100, 9))
    return _ids(rerank.mmr(scaled, 3))


@query
def type_filter(spark, d):
    return _ids(rerank.by_question_type(_hits(spark, d)))


@query
def multi_stage_rerank(spark, d):
    return _ids(rerank.multi_stage(_hits(spark, d, 60)))


# --- structure and chunks


@query
def page_split(spark, d):
    return pages(spark, d).select("filename", "page", F.md5("text").alias("text_md5"), F.size("tables").cast("long").alias("n_tables"))


@query
def extract_tables(spark, d):
    rows = bases.spark_rows(spark, d, bases.MARKDOWN).select("filename", F.posexplode(parse.extract_tables(F.col("text"))).alias("idx", "tbl"))
    return rows.withColumn("idx", F.col("idx").cast("long"))


@query
def page_chunks(spark, d):
    return chunk.page_chunks(pages(spark, d)).select("chunk_id", "type", F.length("content").cast("long").alias("length"), F.md5("content").alias("md5"))


@query
def sentences(spark, d):
    return chunk.sentences(pages(spark, d))


@query
def sentence_similarity(spark, d):
    return rounded(chunk.sentence_similarity(chunk.sentences(pages(spark, d))), "similarity")


@query
def breakpoints(spark, d):
    return chunk.breakpoints(chunk.sentences(pages(spark, d))).select("filename", "page", "idx", "is_break")


def _semantic(spark, d, *sizes):
    return chunk.semantic_chunks(pages(spark, d), *sizes).select("chunk_id", "type", F.length("content").cast("long").alias("length"), F.md5("content").alias("md5"))


@query
def semantic_chunks(spark, d):
    return _semantic(spark, d, 500, 100)


@query
def semantic_chunks_small(spark, d):
    return _semantic(spark, d, 120, 30)


# --- questions, prompts and answers


@query
def classify_question(spark, d):
    return questions(spark, d).select("qid", A.classify(F.col("question")).alias("question_type"))


@query
def classify_scores(spark, d):
    return questions(spark, d).select("qid", A.type_scores(F.col("question")).alias("s")).select("qid", "s.*")


@query
def rewrite_dedup(spark, d):
    return replies(spark, d).select("qid", listed(A.rewrites(F.col("question"), F.col("reply"))).alias("variants"))


@query
def decompose_lines(spark, d):
    return replies(spark, d).select("qid", listed(A.sub_questions(F.col("question"), F.col("reply"))).alias("parts"))


@query
def prompt_text(spark, d):
    rows = questions(spark, d).join(answers(spark, d), "qid")
    return rows.select("qid", F.md5(generate.prompt(F.col("question"), F.col("context"), A.classify(F.col("question")))).alias("prompt_md5"))


@query
def citations(spark, d):
    rows = answers(spark, d).select("qid", F.posexplode(A.citations(F.col("answer"))).alias("idx", "c"))
    return rows.select("qid", F.col("idx").cast("long").alias("idx"), "c.filename", "c.page")


@query
def has_citations(spark, d):
    return answers(spark, d).select("qid", A.has_citations(F.col("answer")).alias("has_citations"))


@query
def format_citation(spark, d):
    return questions(spark, d).select("qid", A.format_citation(F.lit("报告 A"), F.col("qid")).alias("citation"))


@query
def clean_answer(spark, d):
    return answers(spark, d).select("qid", A.without_citations(F.col("answer")).alias("answer"))


@query
def numbers_eval(spark, d):
    return answers(spark, d).select("qid", listed(T.numbers(F.col("answer"))).alias("numbers"))


@query
def numbers_selfcheck(spark, d):
    return answers(spark, d).select("qid", listed(T.numbers(F.col("answer"), P.NUMBER_PLAIN)).alias("numbers"))


@query
def unsupported_numbers(spark, d):
    return answers(spark, d).select("qid", listed(A.unsupported_numbers(F.col("answer"), F.col("context"))).alias("numbers"))


@query
def normalize_format(spark, d):
    return answers(spark, d).select("qid", A.normalize_format(F.col("answer")).alias("answer"))


@query
def handle_empty(spark, d):
    return answers(spark, d).select("qid", A.handle_empty(F.col("answer")).alias("answer"))


@query
def control_length(spark, d):
    return answers(spark, d).select("qid", A.control_length(F.col("answer")).alias("answer"))


@query
def postprocess(spark, d):
    rows = answers(spark, d).select("qid", A.postprocess(F.col("answer"), F.col("context")).alias("p"))
    return rows.select("qid", "p.answer", listed("p.unsupported_numbers").alias("unsupported_numbers"), "p.was_truncated", "p.was_empty")


@query
def check_support(spark, d):
    return answers(spark, d).select("qid", A.check_support(F.col("answer"), F.col("context")).alias("verdict"))


@query
def self_check(spark, d):
    rows = answers(spark, d).select("qid", A.self_check(F.col("answer"), F.col("context")).alias("s"))
    return rows.select("qid", "s.verdict", "s.num_support_ratio", "s.keyword_overlap_ratio", listed("s.answer_numbers").alias("answer_numbers"), listed("s.context_numbers").alias("context_numbers"))


@query
def feedback(spark, d):
    return answers(spark, d).select("qid", A.feedback(A.check_support(F.col("answer"), F.col("context"))).alias("f")).select("qid", "f.action", "f.reason", "f.suggestion")


@query
def consistency_vote(spark, d):
    said = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", F.col("turn").alias("idx"), "text")
    return evaluate.vote(said, "conv_id", answer="text")


# --- evaluation


@query
def normalize_text(spark, d):
    return predictions(spark, d).select("id", T.normalize(F.col("answer")).alias("answer"))


def _scores(spark, d):
    return evaluate.answer_scores(predictions(spark, d), gold(spark, d))


def _metric(spark, d, name):
    return rounded(_scores(spark, d).select("id", name), name)


@query
def char_f1(spark, d):
    return _metric(spark, d, "char_f1")


@query
def word_f1(spark, d):
    return _metric(spark, d, "word_f1")


@query
def rouge_l(spark, d):
    return _metric(spark, d, "rouge_l")


@query
def number_f1(spark, d):
    return _metric(spark, d, "number_f1")


@query
def evaluate_answers(spark, d):
    return evaluate.evaluate(_scores(spark, d))


@query
def report_extremes(spark, d):
    return evaluate.extremes(_scores(spark, d), "id")


def _retrieval(spark, d):
    """Gold: the first document, of all, that holds the benchmark passage; a document's file and page are its source and id."""
    asked, docs, ix = benchmark(spark, d), corpus(spark, d), _bm25(spark, d)
    hits = retrieve.bm25_search(ix, asked, 10).select("query_id", "id", "rank")
    told = evaluate.containing(docs, ix.postings, ix.terms, asked).groupBy("query_id").agg(F.min("id").alias("id"))
    names = docs.select("id", "filename", "page")
    blank = F.when(F.col("query_id") % 2 == 0, -1).otherwise(0).cast("long")
    gold_ = asked.join(told.join(names, "id"), "query_id", "left").select("query_id", "question", F.coalesce("filename", F.lit("")).alias("filename"), F.coalesce("page", blank).alias("page"))
    return gold_, hits.join(names, "id").select("query_id", "filename", "page", "rank")


@query
def retrieval_details(spark, d):
    return evaluate.first_ranks(*_retrieval(spark, d), 10).withColumnRenamed("query_id", "item_id")


@query
def retrieval_metrics(spark, d):
    return evaluate.retrieval_metrics(*_retrieval(spark, d))


@query
def errors_by_type(spark, d):
    return evaluate.error_rates(evaluate.judged(predictions(spark, d), gold(spark, d)), "question_type")


@query
def errors_by_document(spark, d):
    return evaluate.error_rates(evaluate.judged(predictions(spark, d), gold(spark, d)), "filename")


@query
def bad_cases(spark, d):
    return evaluate.judged(predictions(spark, d), gold(spark, d)).where("error").select("id", "question", "pred", "gold")


# --- enrichment


def _tasks(spark, d):
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("filename"), F.col("event_id").alias("page"), "event_type", "value")


def _done(spark, d):
    return _tasks(spark, d).where("event_type = 'purchase'")


@query
def enrich_pending(spark, d):
    return enrich.pending(_tasks(spark, d), _done(spark, d), 100).select("filename", "page")


@query
def enrich_cap(spark, d):
    return enrich.capped(_tasks(spark, d), 3).select("filename", "page")


@query
def enrich_progress(spark, d):
    return enrich.progress(_tasks(spark, d), _done(spark, d))


@query
def enrich_merge(spark, d):
    results = _tasks(spark, d).select("filename", (F.col("page") % 50).alias("page"), F.col("event_type").alias("description"), F.col("page").alias("ord"))
    return enrich.merge(_tasks(spark, d).select("filename", (F.col("page") % 97).alias("page")).distinct(), results, "ord")


@query
def enrich_merge_charts(spark, d):
    """Whole chart structs: the last result of a page, or empty values; absent keys too."""
    done = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("filename"), (F.col("event_id") % 50).alias("page"), F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("page_summary"), (F.col("event_id") % 2 == 0).alias("has_charts"),
        F.when(F.col("event_id") % 5 > 0, True).alias("has_tables"), F.when(F.col("event_id") % 4 > 0, F.array("event_type", F.lit("c"))).alias("charts"), F.array().cast("array<string>").alias("tables"), F.col("event_id").alias("ord"),
    )
    found = enrich.merge_charts(_tasks(spark, d).select("filename", (F.col("page") % 97).alias("page")).distinct(), done, "ord")
    return found.select("filename", "page", "chart_descriptions.*").withColumns({"charts": listed("charts"), "tables": listed("tables")})


@query
def chart_items(spark, d):
    """The charts of model replies, as objects: fenced, in running text, broken, and with fields that are absent or of another type."""
    title, props, n = F.concat(F.lit('"title": "'), "event_type", F.lit('"')), F.col("props"), F.col("event_id")
    chart = F.concat(F.lit("{"), title, F.lit(', "values": ['), n.cast("string"), F.lit(', "x"], "source": '), props, F.lit("}"))
    other = F.when(n % 3 == 0, F.lit('{"title": 7}')).when(n % 3 == 1, F.lit('{"values": [1.5]}')).otherwise(F.lit("null"))
    body = F.concat(F.lit('{"page_summary": "s", "charts": ['), chart, F.lit(", "), other, F.lit("]}"))
    reply = F.when(n % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n % 5 == 1, F.concat(F.lit("结果如下 "), body)).when(n % 5 == 2, F.concat(body, F.lit("}"))).when(n % 5 == 3, F.lit('{"charts": "none"}')).otherwise(body)
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("filename"), n.alias("page"), reply.alias("reply"))
    found = enrich.chart_items(rows, fields={"title": "string", "values[0]": "double", "source.k": "bigint"})
    return found.select("filename", "page", F.col("pos").cast("long").alias("pos"), "title", "values", F.coalesce("source_k", F.lit(-1)).cast("long").alias("source_k"))


@query
def enrich_merge_typed(spark, d):
    """The last reply of each page: its summary, how many charts it has, and their titles by path."""
    n = F.col("event_id")
    chart = lambda i: F.concat(F.lit('{"title": "'), "event_type", F.lit(f"{i}\", \"source\": "), "props", F.lit("}"))
    many = F.when(n % 3 == 0, F.concat(chart(0), F.lit(", "), chart(1))).when(n % 3 == 1, chart(0)).otherwise("")
    reply = F.when(n % 7 == 0, F.lit("no JSON")).otherwise(F.concat(F.lit('{"page_summary": "p'), n.cast("string"), F.lit('", "has_charts": '), (n % 3 < 2).cast("string"), F.lit(', "charts": ['), many, F.lit("]}")))
    replies = table(spark, d, "events").select(F.col("user_id").cast("string").alias("filename"), (n % 50).alias("page"), n.alias("ord"), reply.alias("reply"))
    found = enrich.merge_typed(_tasks(spark, d).select("filename", (F.col("page") % 97).alias("page")).distinct(), replies, "ord")
    title = F.transform("chart_descriptions.charts", lambda c: F.try_variant_get(c, "$.title", "string"))
    sources = F.transform("chart_descriptions.charts", lambda c: F.try_variant_get(c, "$.source.k", "bigint"))
    return found.select("filename", "page", "chart_descriptions.page_summary", "chart_descriptions.has_charts", listed(title).alias("titles"), F.coalesce(F.aggregate(sources, F.lit(0).cast("bigint"), lambda s, x: s + F.coalesce(x, F.lit(0))), F.lit(0)).alias("sources"))


@query
def semantic_chunks_streamed(spark, d):
    """The chunks of semantic_chunks, folded a sentence at a time."""
    return chunk.semantic_chunks(pages(spark, d), 500, 100, streamed=True).select("chunk_id", "type", F.length("content").cast("long").alias("length"), F.md5("content").alias("md5"))


@query
def enrich_max_pages(spark, d):
    """A job that may do 500 pages, with a stand-in model, over the results of an earlier one."""
    path = _folder(spark, "enriched")
    former = _done(spark, d).select(*enrich.KEY, F.lit("earlier").alias("page_summary"))
    empty = spark.createDataFrame([], enrich.RESULT + ", done_at timestamp")
    tables.added(empty.unionByName(former.withColumn("done_at", F.lit("2000-01-01").cast("timestamp")), allowMissingColumns=True), path)
    todo = _tasks(spark, d).withColumn("path", F.concat_ws("_page_", *enrich.KEY))
    done = enrich.run(todo, path, lambda image: '{"page_summary": "' + image + '"}', start_page=100, max_pages=500, wave=200)
    return done.where("page_summary <> 'earlier'").select(*enrich.KEY, "page_summary")


@query
def tasks_from_images(spark, d):
    name = F.concat(F.lit("/img/u_page_"), F.col("user_id").cast("string"), F.lit("_page_"), F.when(F.col("event_id") % 7 == 0, "x").otherwise(F.col("event_id").cast("string")), F.lit(".png"))
    return enrich.tasks_from_images(table(spark, d, "events").select(name.alias("path")))


@query
def parse_json_reply(spark, d):
    props = F.col("props")
    wrapped = F.when(F.col("event_id") % 4 == 0, props).when(F.col("event_id") % 4 == 1, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit("结果如下 "), props, F.lit(" 完"))).otherwise("no json")
    return table(spark, d, "events").select("event_id", F.coalesce(A.json_reply(wrapped, "k bigint")["k"], F.lit(-1)).cast("long").alias("k"))


@query
def upsert_latest(spark, d):
    events = table(spark, d, "events").select("user_id", "event_id", "event_type")
    found = index.upsert(events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1"), ["user_id"], "event_id")
    return found


@query
def pipeline_stub(spark, d):
    """The whole chain of answering with a stand-in model: classify, context, answer, check."""
    rows = questions(spark, d).join(answers(spark, d), "qid")
    checked = rows.select("qid", "question", "answer", A.classify(F.col("question")).alias("question_type"), A.citations(F.col("answer")).alias("c"), A.self_check(F.col("answer"), F.col("context")).alias("s"))
    return checked.select("qid", "question_type", (F.size("c") > 0).alias("has_citations"), F.size("c").cast("long").alias("n_citations"), "s.verdict", "s.feedback.action")


@query
def answer_chain(spark, d):
    """The whole chain over short Chinese pages with stand-in models: index, search in all channels, staged reranking, prompt, answer, citations, checks."""
    shown = gold(spark, d).select(F.concat(F.lit("客户"), F.col("ord").cast("string")).alias("filename"), F.lit(1).cast("long").alias("page"), F.col("answer").alias("text"), F.array().cast("array<string>").alias("tables"))
    path = _folder(spark, "answer-chain")
    pipeline.build_indexes(shown).save(path)
    rows = pipeline.answer(pipeline.Indexes.load(spark, path), bases.spark_rows(spark, d, bases.SEGMENT_QUESTIONS), EchoModel(), multi=True, staged=True)
    return rows.select("query_id", "filename", "page", "question_type", F.md5("answer").alias("answer_md5"), "has_citations", "self_check.verdict", "self_check.feedback.action")


ORACLES = {name: SQL[name] for name in QUERIES if name in SQL}
