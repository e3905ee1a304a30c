"""Texts in batches: tokens as arrays, searches that cut each text once."""

import random

from pyspark.sql import functions as F

from quernstone.functions import batches
from quernstone.functions import text as T
from quernstone.operators import chunk, index, parse, retrieve

SIGNS = ["中", "文", "字", "䷀", "㐀", "鿿", "a", "B", "é", "İ", "ß", "Σ", "1", "٣", " ", "\n", "\t", "　", "\x85", "\x1c", "﻿", "。", "-", "|", "😀", "𠀀", "々", "averylongword"]


def odd(n: int) -> list[str | None]:
    rng = random.Random(7)
    return [None, "", *("".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 25))) for _ in range(n))]


def test_tokens_of_a_batch_are_those_of_the_column(spark):
    rows = spark.createDataFrame([(x,) for x in odd(2000)], "x string").select(F.lower("x").alias("x"), T.tokens(F.col("x")).alias("t")).collect()
    found = batches.cut(*batches.points([r.x or "" for r in rows]), batches.letters(spark))
    names, told = found.names(), [[] for _ in rows]
    for row, code in zip(found.row.tolist(), found.code.tolist(), strict=True):
        told[row].append(names[code])
    assert [sorted(t) for t in told] == [sorted(r.t or []) for r in rows]


def test_pairs_stand_in_order_and_stop_at_signs(spark):
    got = spark.createDataFrame([("甲乙丙x丁 ab䷀丙丁䷀戊",)], "x string").select(T.tokens(F.col("x"))).first()[0]
    assert got == ["甲乙", "乙丙", "x", "丁", "ab", "丙丁", "戊"]


def test_search_in_blocks_gives_the_hits_of_an_index(spark, tmp_path):
    """With many ties, repeated ids of one and of several texts, a null id, null texts, and words that nearly all texts have."""
    texts = [(f"d{i}", f"客户评级 {i % 5} 订单 {i} {'urgent ' * (i % 3)}") for i in range(300)] + [("d7", "客户 订单 7 7"), ("d8", "客户评级 3 订单 8 urgent urgent "), (None, "客户评级 1"), ("x", None), ("y", "")]
    docs = spark.createDataFrame(texts, "id string, text string")
    asked = spark.sql("SELECT * FROM VALUES (1, '客户评级 1 订单 7'), (2, 'urgent urgent 订单'), (3, 'nothing here'), (4, '') AS t(query_id, question)")
    want = sorted(map(tuple, retrieve.bm25_search(index.lexical_index(docs, "id"), asked, 10).select("query_id", "rank", "id", "score").collect()))
    for name, rows in (("repeated", docs), ("numbers", docs.select(F.xxhash64("id").alias("id"), "text"))):
        if name == "numbers":
            want = sorted(map(tuple, retrieve.bm25_search(index.lexical_index(rows, "id"), asked, 10).select("query_id", "rank", "id", "score").collect()))
        got = retrieve.bm25_once(rows, "id", asked, f"{tmp_path}/{name}", 10).select("query_id", "rank", "id", "score")
        assert sorted(map(tuple, got.collect())) == want and want
    blocks = spark.read.parquet(f"{tmp_path}/repeated/blocks")
    assert set(blocks.select(F.explode("term")).distinct().toPandas()["col"]) <= set("客户 户评 评级 1 7 订单 urgent".split())


def test_search_of_unlike_ids_in_blocks(spark, tmp_path):
    docs = spark.range(500).select("id", F.concat(F.lit("word "), F.col("id") % 7, F.lit(" "), F.repeat(F.lit("filler "), F.col("id").cast("int"))).alias("body"))
    asked = spark.sql("SELECT * FROM VALUES ('a', 'word 3'), ('b', '6 filler') AS t(query_id, question)")
    want = retrieve.bm25_search(index.lexical_index(docs, "id", "body"), asked, 5).select("query_id", "rank", "id", "score").collect()
    got = retrieve.bm25_once(docs, "id", asked, f"{tmp_path}/ids", 5, "body").select("query_id", "rank", "id", "score").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_pages_and_tables_of_odd_documents(spark):
    docs = spark.createDataFrame([("a", "x\n<!-- Page 3 -->\n| a |\n|---|\n| b |\nrest\n---\n<!--Page 4-->  "), ("b", " \n<!-- Page 2 --> "), ("c", None), ("d", "| t |\n"), ("e", "")], "filename string, text string")
    got = {(r.filename, r.page): (r.text, r.tables) for r in parse.split_pages(docs).collect()}
    assert got == {("a", 1): ("x", []), ("a", 3): ("| a |\n|---|\n| b |\nrest", ["| a |\n|---|\n| b |"]), ("b", 1): ("<!-- Page 2 -->", []), ("c", 1): (None, None), ("d", 1): ("| t |", ["| t |"]), ("e", 1): ("", [])}


def plain(x):
    """The usual tokens under another name, which go the way of other tokenizers: by columns."""
    return T.tokens(x)


def test_pages_in_batches_give_the_chunks_of_columns(spark, monkeypatch):
    """Long pages and short ones, pages of several rows, headings, odd white space, tables, null texts and null names."""
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(["营收增长", "alpha", "beta", "Gamma", "İx", "12", "成本。", "风险；", "\x1c"]) for _ in range(rng.randint(0, 14)))
    text = lambda: "\n".join(rng.choice(["", "# ", "##　", "  ", "#x "]) + line() for _ in range(rng.randint(0, 30)))
    rows = [(f"d{i % 40}" if i % 23 else None, i % 3, text(), [line(), " ", "| t |"][: i % 4]) for i in range(200)] + [("n", 1, None, ["t"]), ("s", 1, "。\n。\n。\n。\n。\n。", ["t"]), ("q", None, "short", ["t", None])]
    pages = spark.createDataFrame(rows, "filename string, page long, text string, tables array<string>")
    key = lambda df: sorted(map(repr, map(tuple, df.collect())))
    want = key(chunk.semantic_chunks(pages, 120, 20, tokenize=plain))
    assert key(chunk.semantic_chunks(pages, 120, 20)) == want == key(chunk.semantic_chunks(pages, 120, 20, streamed=True))
    bits, short = batches.letters(spark), [[r[2]] for r in rows if r[2]]
    monkeypatch.setattr(chunk, "SLICE", 40)  # a long page holds the sentences of a slice alone
    for texts, contents in zip(short, chunk._short_pages(short, 120, 20, bits), strict=True):
        assert list(chunk._long_page(texts, 120, 20, bits)) == list(contents)


def test_pages_go_to_tasks_once_and_by_no_sentence(spark):
    pages = spark.createDataFrame([("a", 1, "x y z。", ["t"])], "filename string, page int, text string, tables array<string>")
    plan = chunk.semantic_chunks(pages, streamed=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan and "Generate" not in plan
