"""Operators on small literal tables."""

import json

import pytest
from pyspark.sql import functions as F

from quernstone import plugins
from quernstone.operators import chunk, enrich, evaluate, generate, index, parse, rerank, retrieve
from quernstone.plans import pipeline
from quernstone.session import ship
from quernstone.sources import readers, writers


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_pages_and_tables(spark):
    md = "intro\f more\n<!-- Page 3 -->\n42\n<!--Page 4-->\n \n<!-- Page 5 -->x |a|b|\n|-|-|\n|1|2|\nend |z|\n|last|"
    df = spark.createDataFrame([("d", md), ("e", " "), ("f", "plain")], "filename string, text string")
    got = rows(parse.split_pages(df), "filename", "page")
    assert [(f, p) for f, p, *_ in got] == [("d", 1), ("d", 3), ("d", 5), ("e", 1), ("f", 1)]
    assert got[0][2] == "intro more" and got[1][2] == "42" and got[3][2] == ""
    assert got[2][3] == ["|a|b|\n|-|-|\n|1|2|", "|z|"]


def test_titles_and_summaries(spark):
    text = "# Head one\n免责声明：x\n行业展望与战略\n盈利预测..........\n因此我们维持\n第一，而后\n客户评级：一\n营收 12%\n短"
    df = spark.createDataFrame([("d", 1, text)], "filename string, page int, text string")
    assert [r[3] for r in rows(parse.titles(df), "line")] == ["Head one", "行业展望与战略", "盈利预测", "客户评级：一"]
    s = spark.createDataFrame([("## heading line here\n12 | 34 | 56 | 78\n短，then this line is skipped\nA long enough clause，and more",), ("x",)], "text string")
    assert [r[0] for r in s.select(parse.summary(F.col("text"))).collect()] == ["A long enough clause", ""]


def test_page_chunks(spark):
    df = spark.createDataFrame([("d", 1, "long enough text T1 and T1 again", ["T1", " ", "T2 "]), ("e", 1, "T1 short", ["T1"])], readers.PAGE)
    got = {r["chunk_id"]: r["content"] for r in chunk.page_chunks(df).collect()}
    assert got == {"d_p1_text": "longenoughtextandagain", "d_p1_table0": "T1", "d_p1_table2": "T2", "e_p1_table0": "T1"}


def test_semantic_chunks(spark):
    one, two = "alpha beta gamma delta。", "epsilon zeta eta theta。"
    df = spark.createDataFrame([("a", 1, one * 5 + two * 5, []), ("b", 1, "tiny", ["T"]), ("c", 1, "。\n。\n。\n。\n。\n。", ["T"])], readers.PAGE)
    got = {r["chunk_id"]: r["content"] for r in chunk.semantic_chunks(df, 100, 10).collect()}
    assert got["b_p1_table0"] == "T" and "c_p1_table0" not in got
    assert got["a_p1_chunk1"].startswith(got["a_p1_chunk0"][-10:])
    assert one in got["a_p1_chunk0"]


def lexicon(spark, texts):
    return index.lexical_index(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id")


def test_bm25(spark, tmp_path):
    ix = lexicon(spark, ["cat sat", "cat ran far away", "dog", "bird", "fish"])
    asked = spark.createDataFrame([(1, "cat"), (2, "unknown"), (3, "dog dog")], "query_id long, question string")
    hits = rows(retrieve.bm25_search(ix, asked).select("query_id", "rank", "id"), "query_id", "rank")
    assert hits == [(1, 1, 0), (1, 2, 1), (3, 1, 2)]
    ix.save(str(tmp_path / "ix"))
    again = index.LexicalIndex.load(spark, str(tmp_path / "ix"))
    assert rows(retrieve.bm25_search(again, asked).select("query_id", "rank", "id"), "query_id", "rank") == hits
    common = lexicon(spark, ["a b", "a c", "a d"])
    assert dict(common.terms.select("term", "idf").collect())["a"] == pytest.approx(0.25 * sum(dict(common.terms.select("term", F.expr("ln(3 - df + 0.5) - ln(df + 0.5)")).collect()).values()) / 4)


def test_dense_search_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "BLOCK", 4)
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, embedding array<double>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "query_id long, embedding array<double>")
    got = rows(retrieve.dense_search(v, asked, 2).select("query_id", "rank", "id"), "query_id", "rank")
    assert got == [(1, 1, 4), (1, 2, 3), (2, 1, 0), (2, 2, 1), (3, 1, 0), (3, 2, 1)]
    assert retrieve.dense_search(v, asked.where("false"), 2).count() == 0
    odd = spark.createDataFrame([(4, None), (5, [1.0]), (6, [None, 1.0]), (7, [float("nan"), 1.0]), (8, [])], "query_id long, embedding array<double>")
    assert retrieve.dense_search(v, odd, 2).count() == 0


def hits(spark, data, extra=""):
    return spark.createDataFrame(data, "query_id long, id string, rank long, content string, filename string, page int" + extra)


def test_fusion_and_context(spark):
    a = hits(spark, [(1, "x", 1, "cx", "f", 1), (1, "y", 2, "cy", "f", 2)])
    b = hits(spark, [(1, "y", 1, "other", "f", 2), (1, "z", 2, "cz", "g", 3), (1, "z", 3, "cz", "g", 3)])
    fused = retrieve.fuse({"bm25": b, "dense": a})
    got = [(r["id"], r["sources"], r["content"]) for r in fused.orderBy("rank").collect()]
    assert got == [("y", ["dense", "bm25"], "cy"), ("z", ["bm25"], "cz"), ("x", ["dense"], "cx")]
    asked = spark.createDataFrame([(1, "q"), (2, "r")], "query_id long, question string")
    told = {r["query_id"]: r for r in retrieve.contexts(fused, asked).collect()}
    assert told[1]["context_text"] == "[来源: f 第2页]\ncy\n\n---\n\n[来源: g 第3页]\ncz\n\n---\n\n[来源: f 第1页]\ncx"
    assert (told[2]["top_filename"], told[2]["top_page"], told[2]["context_text"], told[2]["n_hits"]) == ("", 0, "", 0)


def test_mmr_and_types(spark):
    data = [(1, "a", 1, "one two three", "f", 1, 0.9, "text"), (1, "b", 2, "one two three", "f", 1, 0.8, "table"), (1, "c", 3, "other words 图3", "f", 1, 0.7, "text"), (2, "d", 1, "x", "f", 1, 0.1, "text")]
    df = hits(spark, data, ", score double, type string")
    assert rows(rerank.mmr(df, 2, 0.5).select("query_id", "rank", "id"), "query_id", "rank") == [(1, 1, "a"), (1, 2, "c"), (2, 1, "d")]
    typed = lambda t: [r[1] for r in rows(rerank.by_question_type(df.withColumn("question_type", F.lit(t))).where("query_id = 1").select("rank", "id"), "rank")]
    assert (typed("fact_extraction"), typed("chart_understanding"), typed("comparison")) == (["b", "a", "c"], ["c", "a", "b"], ["a", "b", "c"])
    scored = rerank.rerank(df.withColumn("question", F.lit("other words")), plugins.LexicalScorer()).where("query_id = 1")
    assert scored.orderBy("rank").first()["id"] == "c"


def test_generation_and_rewriting(spark):
    class Fails:
        def complete(self, prompt, temperature, max_tokens):
            raise ValueError("no")

    class Lines:
        def complete(self, prompt, temperature, max_tokens):
            assert (temperature, max_tokens) == (0.3, 512)
            return " a \nb\na"

    df = spark.createDataFrame([("营收是多少", "ctx [x]")], "question string, context string")
    row = generate.generate(df, plugins.EchoModel()).first()
    assert row["question_type"] == "fact_extraction" and "ctx [x]" in row["prompt"] and row["answer"]
    with pytest.raises(Exception, match="unknown question type"):
        generate.generate(df.withColumn("question_type", F.lit("odd")), plugins.EchoModel()).collect()
    assert generate.generate(df, Fails(), errors="error").first()["error"] == "no"
    rewriter = generate.Rewriter(Lines())
    assert rewriter.rewrite(df).first()["variants"] == ["营收是多少", "a", "b"]
    assert rewriter.decompose(df).first()["parts"] == ["a", "b", "a"]
    assert generate.Rewriter().rewrite(df).first()["variants"] == ["营收是多少"]
    waits = []
    with pytest.raises(plugins.ModelError):
        plugins.with_retries(lambda: 1 / 0, 3, 2.0, waits.append)
    assert waits == [2.0, 4.0]


def test_evaluation(spark):
    gold = spark.createDataFrame([(1, "q", "old"), (2, " q ", "Same。"), (3, " ", "x")], "ord long, question string, answer string")
    pred = spark.createDataFrame([(1, "q", "same", "t", None), (2, "q", "else", None, "f"), (3, "none", "x", "t", "f")], "id long, question string, answer string, question_type string, filename string")
    scores = evaluate.answer_scores(pred, gold)
    assert rows(scores.select("id", "exact_match"), "id") == [(1, 1.0), (2, 0.0)]
    assert evaluate.evaluate(scores).first()["count"] == 2
    judged = evaluate.judged(pred, gold)
    assert rows(evaluate.error_rates(judged, "question_type"), "group") == [("t", 1, 1, 1.0), ("unknown", 1, 1, 1.0)]
    told = spark.createDataFrame([(1, "q", "f", 1), (2, "q", "f", 9), (3, "q", "f", -1), (4, " ", "f", 1)], "query_id long, question string, filename string, page int")
    found = spark.createDataFrame([(1, "f", 2, 1), (1, "f", 1, 2), (3, "f", 1, 1)], "query_id long, filename string, page int, rank long")
    got = {r["k"]: r for r in evaluate.retrieval_metrics(told, found).collect()}
    assert (got[1]["recall"], got[3]["recall"], got[3]["hit_rate"], got[1]["mrr"], got[1]["count"]) == (0.0, 0.5, 0.5, 0.25, 2)


def test_vote(spark):
    df = spark.createDataFrame([(1, 0, "a b"), (1, 1, "a b c"), (1, 2, "x"), (2, 0, "only"), (3, 0, "p"), (3, 1, "q")], "g long, idx long, answer string")
    assert rows(evaluate.vote(df, "g"), "g") == [(1, 0, 2), (2, 0, 1), (3, 0, 2)]


def test_enrichment(spark):
    tasks = spark.createDataFrame([("f", 1), ("f", 2), ("f", 3), ("g", 1)], "filename string, page long")
    done = spark.createDataFrame([("f", 1, "ok", 1), ("f", 1, "newer", 2), ("g", 1, None, 1)], "filename string, page long, description string, ord int")
    assert rows(enrich.pending(tasks, done), "page") == [("f", 2), ("f", 3)]
    assert rows(enrich.capped(tasks, 1), "filename") == [("f", 1), ("g", 1)]
    assert rows(enrich.progress(tasks, done.dropDuplicates(["filename", "page"])), "filename") == [("f", 3, 1, 2), ("g", 1, 1, 0)]
    assert rows(enrich.merge(tasks, done, "ord"), "filename", "page") == [("f", 1, "newer"), ("f", 2, ""), ("f", 3, ""), ("g", 1, "")]
    said = {"f1": '```json\n{"page_summary": "s", "has_charts": true, "charts": [{"a": 1}], "x": 0}\n```', "f3": "no json", "g1": ""}
    waits = []
    rows_ = tasks.withColumn("path", F.concat("filename", "page")).union(spark.createDataFrame([("h", 1, "none")], "filename string, page long, path string"))
    got = {r["filename"] + str(r["page"]): r for r in enrich.extract(rows_, lambda p: 1 / 0 if p == "f2" else said[p], 2, 0.0, waits.append, lambda p: p != "none").collect()}
    assert sorted(got) == ["f1", "f2", "f3", "g1"]
    assert (got["f1"]["page_summary"], got["f1"]["has_charts"], got["f1"]["has_tables"], got["f1"]["charts"], got["f1"]["tables"], got["f1"]["error"]) == ("s", True, False, ['{"a":1}'], [], None)
    assert (got["f2"]["page_summary"], got["f2"]["error"], got["f2"]["charts"]) == (enrich.FAILED + "division by zero", "division by zero", [])
    assert (got["f3"]["page_summary"], got["f3"]["raw_response"], got["f3"]["error"]) == (enrich.UNPARSED, "no json", None)
    assert got["g1"]["error"] == "empty reply"
    merged = {(r["filename"], r["page"]): r["chart_descriptions"] for r in enrich.merge_charts(tasks, spark.createDataFrame([("f", 1, "old", None, 1), ("f", 1, None, True, 2)], "filename string, page long, page_summary string, has_charts boolean, ord int").selectExpr("*", "false AS has_tables", "array('c') AS charts", "cast(null AS array<string>) AS tables"), "ord").collect()}
    assert tuple(merged["f", 1]) == ("", True, False, ["c"], []) and tuple(merged["g", 1]) == ("", False, False, [], [])


def test_enrichment_job(spark, tmp_path):
    path = str(tmp_path / "charts")
    tasks = spark.createDataFrame([(f, i, f"{f}{i}") for f in "fg" for i in range(1, 6)], "filename string, page long, path string")
    fails = lambda p: 1 / 0 if p in ("f2", "g1") else '{"page_summary": "ok"}'
    state = lambda df: [(r["filename"], r["page"], r["error"] is None) for r in df.orderBy("filename", "page").collect()]
    first = enrich.run(tasks, path, fails, max_pages=3, wave=2, attempts=1)
    assert state(first) == [("f", 1, True), ("f", 2, False), ("f", 3, True), ("f", 4, True)]
    images = tasks.where("path <> 'g4'")
    rest = enrich.run(tasks, path, fails, images, per_file=4, start_page=1, attempts=1)
    assert state(rest) == [("f", 1, True), ("f", 2, False), ("f", 3, True), ("f", 4, True), ("g", 1, False), ("g", 2, True), ("g", 3, True)]
    assert state(enrich.run(tasks, path, fails, images, per_file=4, attempts=1)) == state(rest)
    again = enrich.run(tasks, path, lambda p: '{"page_summary": "new"}', per_file=2, redo=True, wave=3)
    assert again.count() == rest.count() + 4
    last = enrich.merge_charts(tasks.select("filename", "page"), again, "done_at").where("filename = 'f' and page <= 3").orderBy("page").collect()
    assert [r["chart_descriptions"]["page_summary"] for r in last] == ["new", "new", "ok"]


def test_upsert(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k long, t long, v string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 1, "e")], "k long, t long, v string")
    assert rows(index.upsert(old, new, ["k"], "t"), "k") == [(1, 1, "c"), (2, 5, "b"), (3, 1, "e")]


def test_settings_and_models(spark):
    spark.conf.set("quernstone.rrf_k", "7")
    got = readers.Settings.load(spark, {"QUERNSTONE_RRF_K": "9", "QUERNSTONE_MMR_WEIGHT": "0.5"}, final_top_k=4)
    spark.conf.unset("quernstone.rrf_k")
    assert (got.rrf_k, got.mmr_weight, got.final_top_k, got.dense_top_k) == (7, 0.5, 4, 10)
    with pytest.raises(ValueError, match="key"):
        plugins.ChatModel("http://localhost:9", None, "m")
    with pytest.raises(plugins.ModelError, match="model call failed"):
        plugins.ChatModel("http://localhost:9", "k", "m").complete("x")
    assert plugins.words("营收增长 ABC 好") == ["营收", "收增", "增长", "abc", "好"]


def test_pdfs(spark, tmp_path):
    import zlib

    shown = zlib.compress(b"BT (Hello \\(x\\)) Tj 0 -14 Td <776f726c64> Tj ET")
    pdf = b"%%PDF-1.4\n1 0 obj <</Type /Pages /Kids [2 0 R]>> endobj\n2 0 obj <</Type /Page /Contents 3 0 R>> endobj\n3 0 obj <</Filter /FlateDecode /Length %d>> stream\n%s\nendstream endobj" % (len(shown), shown)
    (tmp_path / "pdfs").mkdir()
    (tmp_path / "pdfs" / "good.pdf").write_bytes(pdf)
    (tmp_path / "pdfs" / "bad.pdf").write_bytes(b"junk")
    parsed = readers.parsed_pdfs(spark, str(tmp_path / "pdfs"))
    assert rows(parsed, "filename") == [("bad", None, None, "not a PDF"), ("good", 1, "Hello (x)\nworld", None)]
    assert rows(readers.parse_index(parsed), "filename") == [("bad", 0, "not a PDF"), ("good", 1, None)]
    none = spark.createDataFrame([], "pdf string, path string, text string")
    assert rows(readers.page_index(none, parsed), "filename") == [("good", 1, "Hello (x)\nworld", [])]
    shots = readers.rendered_pdfs(spark, str(tmp_path / "pdfs"), lambda c: [c[:4], c[:2]] if c[:1] == b"%" else 1 / 0)
    assert rows(shots.select("filename", "page", "name", "error"), "filename", "page") == [("bad", None, None, "division by zero"), ("good", 1, "good_page_1.png", None), ("good", 2, "good_page_2.png", None)]
    assert shots.where("page = 1").select(parse.data_url(F.col("content"))).first()[0] == "data:image/png;base64,JVBERg=="
    assert not readers.parser_available("no-such-command") and not readers.parser_available("ls", ("no_such_module.x",)) and readers.parser_available("ls")
    mine = lambda c: ["p"]
    assert readers.choose_parser(mine, "no-such-command") is readers.plain_pages and readers.choose_parser(mine, "ls") is mine


def test_semantic_chunks_with_an_encoder(spark):
    class Letters:
        def encode(self, texts):
            return [[float(t.count(c)) for c in "abcdefgh"] for t in texts]

    pages = spark.createDataFrame([("a", 1, "abc abc。\nabd abd。\nhgf hgf。\nhhg hgf。", [])], readers.PAGE)
    got = [r["similarity"] for r in chunk.sentence_similarity(chunk.sentences(pages), Letters()).orderBy("idx").collect()]
    assert got == pytest.approx([2 / 3, 0.0, 10 / 3**0.5 / 36**0.5], abs=0.2) and got[1] == 0.0
    marks = [r["is_break"] for r in chunk.breakpoints(chunk.sentences(pages), Letters()).orderBy("idx").collect()]
    assert marks == [False, False, True, False]
    assert chunk.semantic_chunks(pages, encoder=Letters()).count() == 1


def test_mmr_with_a_scorer(spark):
    class Pairs:
        """Relevance by the passage's number; two passages of one letter are alike."""

        def predict(self, pairs):
            return [float(b[1:]) if a == "q" else float(a[0] == b[0]) for a, b in pairs]

    data = [(1, n, i + 1, n, "f", 1, "q") for i, n in enumerate(["a9", "a8", "b5", "c1"])]
    df = hits(spark, data, ", question string")
    assert [r["id"] for r in rerank.mmr(df, 3, 0.1, scorer=Pairs()).orderBy("rank").collect()] == ["a9", "b5", "c1"]
    assert [r["id"] for r in rerank.mmr(df, 3, 0.9, scorer=Pairs()).orderBy("rank").collect()] == ["a9", "a8", "b5"]


def test_documents_that_hold_a_passage(spark):
    docs = spark.createDataFrame([(1, "xcat sat on mats"), (2, "the cat sat on mat"), (3, "cat on sat"), (4, "营收增长十分快")], "id long, text string")
    ix = index.lexical_index(docs, "id")
    asked = spark.createDataFrame([(1, "cat sat on mat"), (2, "t"), (3, "no such words here"), (4, "收增长十分"), (5, ""), (6, None)], "query_id long, question string")
    assert rows(evaluate.containing(docs, ix.postings, ix.terms, asked), "query_id", "id") == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3), (4, 4)]


def test_command_line(spark, tmp_path, capsys):
    from quernstone import cli

    (tmp_path / "md" / "f").mkdir(parents=True)
    (tmp_path / "md" / "f" / "f.md").write_text("copper revenue grew to 12%\n<!-- Page 2 -->\nglass segment shrank a lot")
    (tmp_path / "q.json").write_text(json.dumps([{"question": "copper revenue"}, {"question": "glass segment"}]))
    at = lambda x: str(tmp_path / x)
    cli.main(["parse", "--markdown", at("md"), "--output", at("parsed")], spark)
    cli.main(["index", "--pages", at("parsed/pages"), "--index", at("ix")], spark)
    cli.main(["search", "--index", at("ix"), "--query", "glass", "--multi"], spark)
    assert "glass segment shrank" in capsys.readouterr().out
    cli.main(["generate", "--question", "营收是多少", "--context", "copper"], spark)
    assert "fact_extraction" in capsys.readouterr().out
    cli.main(["answer", "--questions", at("q.json"), "--index", at("ix"), "--output", at("sub")], spark)
    got = readers.answers(spark, at("sub")).orderBy("question").collect()
    assert [(r["question"], r["filename"], r["page"]) for r in got] == [("copper revenue", "f", 1), ("glass segment", "f", 2)]
    (tmp_path / "gold.json").write_text(json.dumps([{"question": r["question"], "answer": r["answer"]} for r in got]))
    cli.main(["evaluate", "--pred", at("sub"), "--gold", at("gold.json"), "--output", at("report")], spark)
    assert spark.read.json(at("report")).first()["exact_match"] == 1.0
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "f_page_1.png").write_bytes(b"x")
    cli.main(["enrich", "--images", at("img"), "--output", at("charts"), "--model", "os.path:basename", "--pages", at("parsed/pages"), "--merged", at("merged")], spark)
    assert spark.read.json(at("merged")).count() == 2


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "q.json").write_text(json.dumps({"questions": [{"question": "q", "page": 3}]}))
    assert tuple(readers.questions(spark, str(tmp_path / "q.json")).first()) == (None, 3, "q", None)
    (tmp_path / "p.json").write_text(json.dumps([{"filename": "f", "page": 1, "text": "t", "tables": []}]))
    assert readers.pages(spark, str(tmp_path / "p.json")).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.pages(spark, str(tmp_path / "none.json")).count()
    assert readers.earlier_results(spark, str(tmp_path / "none.json"), "filename string").count() == 0
    (tmp_path / "img").mkdir()
    for name in ("a_page_1.png", "a_page_b_page_12.png", "bad.png", "a_page_x.png"):
        (tmp_path / "img" / name).write_bytes(b"x")
    assert rows(readers.images(spark, str(tmp_path / "img")).select("filename", "page"), "page") == [("a", 1), ("a_page_b", 12)]
    for pdf, name, text in (("one", "one.md", "a\n<!-- Page 2 -->\nb"), ("two", "two_page_1.md", " x "), ("two", "two_page_10.md", "y")):
        (tmp_path / "md" / pdf).mkdir(parents=True, exist_ok=True)
        (tmp_path / "md" / pdf / name).write_text(text)
    got = rows(readers.page_index(readers.markdown_files(spark, str(tmp_path / "md"))).select("filename", "page", "text"), "filename", "page")
    assert got == [("one", 1, "a"), ("one", 2, "b"), ("two", 1, "x"), ("two", 10, "y")]
    out = spark.createDataFrame([("f", 1, "v")], "filename string, page long, v string")
    writers.results_by_file(out, str(tmp_path / "res"))
    writers.results_by_file(out.withColumn("filename", F.lit("g")), str(tmp_path / "res"))
    assert spark.read.parquet(str(tmp_path / "res")).count() == 2
    writers.submission(out, str(tmp_path / "sub"))
    assert spark.read.json(str(tmp_path / "sub")).count() == 1


def test_whole_pipeline(spark, tmp_path):
    pages = spark.createDataFrame([("f", i, f"page {i} revenue grew in segment {w}", [f"|t{i}|"]) for i, w in enumerate(["steel", "copper", "glass", "paper"])], readers.PAGE)
    asked = spark.createDataFrame([(1, "copper revenue"), (2, "glass segment")], "query_id long, question string")
    ix = pipeline.build_indexes(pages)
    images = spark.createDataFrame([("f", 1, "/img/f_page_1.png")], "filename string, page int, image_path string")
    got = {r["query_id"]: r for r in pipeline.answer(ix, asked, plugins.EchoModel(), images).collect()}
    assert (got[1]["page"], got[2]["page"]) == (1, 2) and (got[1]["image_path"], got[2]["image_path"]) == ("/img/f_page_1.png", None)
    ix.save(str(tmp_path / "ix"))
    ids = lambda i: rows(pipeline.search(i, asked, multi=True).select("query_id", "rank", "id"), "query_id", "rank")
    assert ids(pipeline.Indexes.load(spark, str(tmp_path / "ix"))) == ids(ix)
    assert pipeline.search(ix, asked, multi=True, staged=True).groupBy("query_id").count().count() == 2


def test_stream_of_pages(spark, tmp_path):
    from quernstone.streaming.ingest import chunk_stream, page_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"filename": "f", "page": 1, "text": "a text of some length", "tables": ["T"]}))
    chunk_stream(page_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_texts_are_dealt_by_their_size(spark, tmp_path):
    """The words of one task's texts are a bounded part of the table, whatever the number of cores."""
    path = str(tmp_path / "texts")
    spark.range(24000).selectExpr("id", "concat_ws(' ', sha2(cast(id AS string), 512), sha2(cast(id + 9 AS string), 512)) AS text").write.parquet(path)
    ix = index.lexical_index(spark.read.parquet(path), "id")
    found = ix.postings.groupBy(F.spark_partition_id().alias("part")).count().collect()
    assert len(found) > 2 * spark.sparkContext.defaultParallelism and max(r["count"] for r in found) < 48000 / 8
    assert tuple(ix.corpus.first()) == (24000, 2.0)
