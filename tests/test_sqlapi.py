"""SQL functions against the Column builders, and searches in SQL against searches by plan."""

import pytest
from pyspark.sql import functions as F

from quernstone import sqlapi
from quernstone.functions import answers as A
from quernstone.functions import text as T
from quernstone.operators import index, retrieve

TEXTS = ["", " 营收增长 12.5%，ABC's plan\n\t好 ", "plain words, 1,234 -5 and 2023", "据报告 [来源: a b 第7页] 。", "　全角空格　", "it's \\ 'quoted'", None]


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    sqlapi.register(spark)


def test_functions_are_the_column_builders(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "x string")
    pairs = {"qs_strip(x)": T.strip(F.col("x")), "qs_plain_tokens(x)": T.plain_tokens(F.col("x")), "qs_tokens(x)": T.tokens(F.col("x")), "qs_numbers(x)": T.numbers(F.col("x")), "qs_normalize(x)": T.normalize(F.col("x")), "qs_has_citations(x)": A.has_citations(F.col("x"))}
    for sql, column in pairs.items():
        rows = df.select(F.expr(sql).alias("a"), column.alias("b")).collect()
        assert [r["a"] for r in rows] == [r["b"] for r in rows], sql
    other = df.select(F.expr("qs_jaccard(qs_tokens(x), qs_tokens('营收 plain abc'))").alias("a"), T.jaccard(T.tokens(F.col("x")), T.tokens(F.lit("营收 plain abc"))).alias("b")).where("x IS NOT NULL").collect()
    assert [r["a"] for r in other] == [r["b"] for r in other]


def test_search_in_sql(spark):
    rows = [(i, t) for i, t in enumerate(["a b b c", "b", "c c c d 营收增长", "", "d d", "b"])]
    ix = index.lexical_index(spark.createDataFrame(rows, "id long, text string"), "id")
    sqlapi.views(spark, "docs", ix)
    asked = spark.createDataFrame([(1, "b b d"), (2, "营收"), (3, "unheard")], "query_id long, question string")
    want = sorted(tuple(r) for r in retrieve.bm25_search(ix, asked, 3).select("query_id", "id", "score", "rank").collect())
    found = []
    for q in asked.collect():
        found += [(q["query_id"], *r) for r in spark.sql("SELECT * FROM docs_search(:question, 3)", {"question": q["question"]}).collect()]
    assert sorted(found) == want
    assert spark.sql("SELECT count(*) FROM docs_terms").first()[0] == ix.terms.count()
    with pytest.raises(ValueError, match="no name"):
        sqlapi.views(spark, "x; y", ix)
