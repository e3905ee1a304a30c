"""The library in SQL: functions over text, views of indexes, and table functions that search them.

``register(spark)`` adds the scalar functions; ``views(spark, name, index)`` makes
the tables of a lexical index known as ``name_postings``, ``name_terms`` and
``name_corpus``, with a table function ``name_search(question, k)``. All are SQL
themselves, so that the optimizer sees through them: no Python runs for a row.

    SELECT q.query_id, h.* FROM questions q, LATERAL docs_search(q.question, 10) h
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .functions import patterns as P
from .functions.text import CJK, NO_WORD
from .operators.index import B, K1, LexicalIndex


def text(x: str) -> str:
    """``x`` as a SQL string."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: name(parameters), type, body.
SCALARS = [
    ("qs_strip(x STRING)", "STRING", f"regexp_replace(x, {text(r'(?U)^\s+|\s+$')}, '')"),
    ("qs_plain_tokens(x STRING)", "ARRAY<STRING>", f"array_remove(split(lower(x), {text(NO_WORD)}), '')"),
    (
        "qs_tokens(x STRING)", "ARRAY<STRING>",
        f"""CASE WHEN x RLIKE {text(CJK)} THEN flatten(transform(array_remove(split(lower(regexp_replace(x, {text(CJK)}, ' $1 ')), {text(NO_WORD)}), ''),
          t -> CASE WHEN t RLIKE {text('^' + CJK)} AND length(t) > 1 THEN transform(sequence(1, length(t) - 1), i -> substring(t, i, 2)) ELSE array(t) END))
        ELSE array_remove(split(lower(x), {text(NO_WORD)}), '') END""",
    ),
    ("qs_numbers(x STRING)", "ARRAY<STRING>", f"regexp_extract_all(x, {text('(?U)' + P.NUMBER_SIGNED)}, 0)"),
    ("qs_jaccard(a ARRAY<STRING>, b ARRAY<STRING>)", "DOUBLE", "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END"),
    ("qs_normalize(x STRING)", "STRING", f"translate(regexp_replace(lower(x), {text(r'(?U)^\s+|\s+$')}, ''), {text(P.PUNCTUATION)}, '')"),
    ("qs_has_citations(x STRING)", "BOOLEAN", f"x RLIKE {text('(?U)' + P.CITATION)}"),
]


def register(spark: SparkSession) -> list[str]:
    """Make the scalar functions known to a session, as temporary ones; their names."""
    for head, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head, _, _ in SCALARS]


def views(spark: SparkSession, name: str, index: LexicalIndex) -> None:
    """Views of an index, and ``name_search(question, k)``: id, score, rank of the best texts, those above 0.

    Questions are cut by qs_tokens, so the index must be too (the default tokenizer). Hits are those of ``bm25_search``.
    """
    if not name.isidentifier():
        raise ValueError(f"{name!r} is no name")
    register(spark)
    for part in ("postings", "terms", "corpus"):
        getattr(index, part).createOrReplaceTempView(f"{name}_{part}")
    kind = index.postings.schema["id"].dataType.simpleString()
    spark.sql(f"""
      CREATE OR REPLACE TEMPORARY FUNCTION {name}_search(question STRING, k INT) RETURNS TABLE (id {kind}, score DOUBLE, rank BIGINT) RETURN
        WITH asked AS (SELECT term, count(*) AS qtf FROM (SELECT explode(t) AS term FROM (SELECT qs_tokens({name}_search.question) AS t)) GROUP BY term),
        scored AS (
          SELECT p.id, round(sum(a.qtf * t.idf * p.tf * {K1 + 1} / (p.tf + {K1} * (1 - {B} + {B} * p.dl / c.avgdl))), 9) AS score
          FROM {name}_postings p JOIN asked a ON a.term = p.term JOIN {name}_terms t ON t.term = p.term CROSS JOIN {name}_corpus c GROUP BY p.id),
        ranked AS (SELECT id, score, cast(row_number() OVER (ORDER BY score DESC, id) AS BIGINT) AS rank FROM scored)
        SELECT id, score, rank FROM ranked WHERE rank <= {name}_search.k AND score > 0""")
