"""Vector index, BM25 in blocks, segments and learned words: against the plain operators and brute force."""

import itertools
import math
import random
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quernstone.operators import block_index, enrich, index, rerank, retrieve, segments, vector_index, wordlist
from quernstone.session import ship

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def hits(df):
    return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 7)) for r in df.collect())


# --- vectors


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")


@pytest.fixture(scope="module")
def built(vectors, tmp_path_factory):
    return vector_index.VectorIndex.build(vectors, str(tmp_path_factory.mktemp("vectors") / "index"))


def test_vector_index_recall(spark, vectors, built):
    """Every row is indexed; probed cells alone give nine of ten, and the exact search all."""
    assert built.rows().count() == vectors.count()
    asked = vectors.where("id % 20 = 0").select(F.col("id").alias("query_id"), "embedding")
    want = hits(retrieve.dense_search(vectors, asked, 10))
    found = hits(built.search(asked, 10))
    top = lambda rows: {(q, i) for q, _, i, _ in rows}
    assert len(top(want) & top(found)) >= 0.9 * len(want)
    assert all(s <= dict(((q, r), t) for q, r, _, t in want)[q, r] + 1e-9 for q, r, _, s in found)
    assert hits(built.search(asked, 10, probes=1, exact=True)) == want


def test_fewer_probes_read_fewer_files(spark, vectors, built):
    asked = vectors.where("id = 40").select(F.col("id").alias("query_id"), "embedding").collect()
    asked = spark.createDataFrame(asked, vectors.select(F.col("id").alias("query_id"), "embedding").schema)
    probed = lambda n: [r["cell"] for r in asked.mapInArrow(built._nearest_cells(n), "query_id long, cell int, unit binary").select("cell").distinct().collect()]
    size = lambda df: sum(r["file_size"] for r in df.select("_metadata.file_path", "_metadata.file_size").distinct().collect())
    one, few, all_ = (size(built.rows(probed(n))) for n in (1, 8, 10_000))
    assert one < few < all_ == size(built.rows())
    plan = built.rows(probed(1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "cell" in plan.split("PartitionFilters")[1].split("]")[0]


def test_vector_index_saved_and_loaded(spark, vectors, built):
    again = vector_index.VectorIndex.load(spark, built.path)
    assert np.array_equal(again.quantizer.centroids, built.quantizer.centroids) and np.array_equal(again.quantizer.codebooks, built.quantizer.codebooks) and np.array_equal(again.low, built.low)
    asked = vectors.where("id < 5").select(F.col("id").alias("query_id"), "embedding")
    assert hits(again.search(asked, 3, probes=4)) == hits(built.search(asked, 3, probes=4))


def test_vector_index_cases(spark, tmp_path):
    """Nulls, zero vectors, other lengths, repeated rows and ties, and more copies than a search gives."""
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(400, None), (401, [0.0] * 6), (402, [1.0] * 5), (403, [float("nan")] * 6), (404, [0.0] * 6), (405, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(500 + i, rows[7][1]) for i in range(30)] + [(7, rows[7][1])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = spark.createDataFrame([(1, rows[7][1]), (2, [0.0] * 6), (3, None), (4, rows[9][1]), (5, [1.0] * 5), (None, rows[3][1]), (6, [-x for x in rows[7][1]])], "query_id long, embedding array<double>")
    ix = vector_index.VectorIndex.build(df, str(tmp_path / "ix"), cells=12, parts=3)
    assert ix.rows().count() == 300 + 2 + 31
    same = df.where("size(embedding) = 6")
    want = [x for x in hits(retrieve.dense_search(same, asked.where("query_id IS NOT NULL"), 8)) if x[0] != 5]
    assert [x for x in hits(ix.search(asked.where("query_id IS NOT NULL"), 8, probes=2, exact=True))] == want
    found = ix.search(asked.where("query_id = 1"), 8, probes=1).collect()
    assert [x["id"] for x in sorted(found, key=lambda x: x["rank"])][:2] == [7, 7] and all(x["score"] == 1.0 for x in found)
    none = vector_index.VectorIndex.build(df.limit(0), str(tmp_path / "none"))
    assert none.search(asked.where("query_id = 1"), 3).count() == 0 and none.search(asked.where("query_id = 1"), 3, exact=True).count() == 0


def test_queries_travel_once_to_a_bin(spark, tmp_path, monkeypatch):
    """A hot cell is split over bins, ties go to the smaller id across them, and nothing is joined row by row."""
    monkeypatch.setattr(vector_index, "ROWS", 60)
    r = random.Random(8)
    rows = [(f"v{i}", [r.gauss(0, 1) for _ in range(4)]) for i in range(200)]
    rows += [(f"c{i}", rows[5][1]) for i in range(300)] + [(None, rows[6][1]), ("zero", [0.0] * 4)]
    df = spark.createDataFrame(rows, "id string, embedding array<double>")
    asked = spark.createDataFrame([(1, rows[5][1]), (2, rows[6][1]), (3, [0.0] * 4), (4, [1.0, 2.0, -1.0, 0.5])], "query_id long, embedding array<double>")
    ix = vector_index.VectorIndex.build(df, str(tmp_path / "ix"), cells=6, parts=2)
    start, bins, first, last = ix._bins()
    assert bins == 9 and (last - first).max() >= 4 and sum(ix.sizes) == len(rows)
    found = ix.search(asked, 12, probes=1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    key = lambda hits: sorted((h["query_id"], h["rank"], h["id"] or "", round(h["score"], 7)) for h in hits.collect())
    assert key(ix.search(asked, 12, probes=1, exact=True)) == key(retrieve.dense_search(df, asked, 12))
    assert {h["id"] for h in found.where("query_id = 1").collect()} == set(sorted(["v5", *(f"c{i}" for i in range(300))])[:12])


# --- BM25 in blocks


def corpus(r, n, words=400, most=60):
    lexicon = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(r.choices(lexicon, weights, k=r.randrange(0, most)))) for i in range(n)]


@pytest.mark.parametrize(("n", "bucket", "first"), [(600, 8, 2), (40, 1, 1), (3, 256, 4)])
def test_blocks_give_the_same_hits(spark, tmp_path, n, bucket, first):
    r = random.Random(n)
    rows = corpus(r, n) + [(5000 + i, "w3 w9 w9 tie") for i in range(25)] + [(9000, None), (9001, "")]
    asked = spark.createDataFrame([(1, "w3 w3 w9"), (2, "tie"), (3, "unheard"), (4, ""), (5, None), (6, " ".join(f"w{i}" for i in range(0, 80, 7))), (7, "w0 w399")], "query_id long, question string")
    ix = index.lexical_index(spark.createDataFrame(rows, "id long, text string"), "id")
    blocks = block_index.BlockIndex.build(ix, str(tmp_path / "blocks"), bucket)
    for k in (3, 1000):
        assert hits(blocks.search(asked, k, first)) == hits(retrieve.bm25_search(ix, asked, k))


def test_blocks_are_passed_over(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    asked = spark.read.parquet(f"{DATA}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    ix = index.lexical_index(docs, "id")
    blocks = block_index.BlockIndex.build(ix, str(tmp_path / "blocks"))
    assert hits(blocks.search(asked, 10)) == hits(retrieve.bm25_search(ix, asked, 10))
    told = blocks.report(asked, 10).agg(F.sum("read"), F.sum("blocks")).first()
    assert 0 < told[0] < 0.8 * told[1]


def test_no_blocks(spark, tmp_path):
    asked = spark.createDataFrame([(1, "a")], "query_id long, question string")
    for i, rows in enumerate(([], [(1, "")])):
        ix = index.lexical_index(spark.createDataFrame(rows, "id long, text string"), "id")
        assert block_index.BlockIndex.build(ix, str(tmp_path / f"b{i}")).search(asked).count() == 0


def test_blocks_of_an_index_that_cuts_texts_once(spark, tmp_path):
    """Statistics, blocks and searches read the words that were written; rows without an id or without words count as before."""
    r = random.Random(4)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(text):
        seen.add(1)
        return (text or "").split()

    rows = corpus(r, 300) + [(None, "w3 w9 tie"), (9000, None), (9001, "")]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4)
    asked = spark.createDataFrame([(1, "w3 w3 w9"), (2, "tie"), (3, "unheard")], "query_id long, question string")
    ix = index.lexical_index(docs, "id", tokenize=cut, path=str(tmp_path / "ix"))
    blocks = block_index.BlockIndex.build(ix, str(tmp_path / "ix"), 8)
    blocks.report(asked).collect()
    assert seen.value == len(rows)
    plain = index.lexical_index(docs, "id")
    weights = lambda i: sorted((t["term"], t["df"], round(t["idf"], 9)) for t in i.terms.collect())
    assert weights(ix) == weights(plain) and ix.corpus.first() == plain.corpus.first()
    key = lambda df: sorted((h["query_id"], h["rank"], h["id"] or -1, round(h["score"], 7)) for h in df.collect())
    assert key(blocks.search(asked, 50)) == key(retrieve.bm25_search(plain, asked, 50))


# --- segments


def test_segments_are_a_fresh_index(spark, tmp_path):
    r = random.Random(9)
    asked = spark.createDataFrame([(1, "w3 w9 w9"), (2, "w0 w1 w50"), (3, "tie w7")], "query_id long, question string")
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string")
    ix = segments.SegmentedIndex(spark, str(tmp_path / "ix"))
    assert ix.index().postings.count() == 0 and retrieve.bm25_search(ix.index(), asked).count() == 0
    live = {}

    def same():
        now, fresh = ix.index(), index.lexical_index(frame(sorted(live.items())), "id")
        assert hits(retrieve.bm25_search(now, asked, 10)) == hits(retrieve.bm25_search(fresh, asked, 10))
        assert sorted((t["term"], t["df"], round(t["idf"], 9)) for t in now.terms.collect()) == sorted((t["term"], t["df"], round(t["idf"], 9)) for t in fresh.terms.collect())
        assert {x["id"] for x in ix.texts().collect()} == set(live)

    first = corpus(r, 120) + [(200, "tie"), (201, "tie"), (202, None), (203, "")]
    ix.add(frame([*first, (None, "no id w3")]))
    live |= dict(first)
    same()
    changed = [(i, t) for i, t in corpus(r, 60) if i % 3 == 0] + [(300, "w9 tie"), (200, "changed w3")]
    ix.add(frame(changed + changed[:5]))
    live |= dict(changed)
    same()
    ix.delete(spark.createDataFrame([(i,) for i in (0, 3, 201, 77, 99999, None)], "id long"))
    live = {i: t for i, t in live.items() if i not in (0, 3, 201, 77)}
    same()
    ix.add(frame([(0, "w9 again")]))  # what was deleted may come back
    live[0] = "w9 again"
    same()
    again = segments.SegmentedIndex(spark, ix.path)
    assert again.commits() == [1, 2, 3, 4]
    assert again.compact() == 5 and ix.commits() == [5]
    same()
    assert ix.vacuum() == [1, 2, 3, 4] and ix.vacuum() == []
    ix.delete(spark.createDataFrame([(i,) for i in live], "id long"))
    live = {}
    assert ix.index().terms.count() == 0 and ix.texts().count() == 0


def test_an_unfinished_commit_does_not_show(spark, tmp_path, monkeypatch):
    ix = segments.SegmentedIndex(spark, str(tmp_path / "ix"))
    ix.add(spark.createDataFrame([(1, "a b"), (2, "b")], "id long, text string"))
    monkeypatch.setattr(segments.SegmentedIndex, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        ix.add(spark.createDataFrame([(1, "c")], "id long, text string"))
    assert {t["term"]: t["df"] for t in ix.index().terms.collect()} == {"a": 1, "b": 2}
    monkeypatch.undo()
    ix.add(spark.createDataFrame([(1, "d")], "id long, text string"))
    assert {t["term"]: t["df"] for t in ix.index().terms.collect()} == {"d": 1, "b": 1}
    with pytest.raises(Exception, match="(?i)exist"):
        ix._publish([1], 2)  # of two writers of one version, the second fails


# --- learned words


def test_cut_takes_the_likeliest_path():
    r = random.Random(3)
    for _ in range(60):
        lattice = wordlist.Lattice(200)
        known = {"".join(r.choice("甲乙丙") for _ in range(r.randrange(1, 4))): r.randrange(1, 60) for _ in range(8)}
        for w, n in known.items():
            lattice.put(w, n)
        run = "".join(r.choice("甲乙丙丁") for _ in range(r.randrange(1, 9)))
        price = lambda w: math.log(200 / known[w]) if w in known else math.log(400) if len(w) == 1 else None  # noqa: B023, E731
        ways = []
        for cuts in itertools.product([0, 1], repeat=len(run) - 1):
            edges = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(run)]
            way = [run[a:b] for a, b in itertools.pairwise(edges)]
            if all(price(w) is not None for w in way):
                ways.append((sum(map(price, way)), way))
        got = lattice.cut(run)
        assert "".join(got) == run and sum(map(price, got)) == pytest.approx(min(ways)[0])


def test_recurring_runs_are_cut_once(monkeypatch):
    """Runs that recur are cut once, also after others pushed them out; long ones are not kept."""
    lattice = wordlist.Lattice(10)
    for w, n in (("甲", 3), ("乙", 3), ("甲乙", 2)):
        lattice.put(w, n)
    cuts, cut = [], wordlist.Lattice.cut
    monkeypatch.setattr(wordlist.Lattice, "cut", lambda self, run: cuts.append(run) or cut(self, run))
    assert [lattice.tokens("甲乙 A1 乙甲") for _ in range(50)] == [["甲乙", "a1", "乙", "甲"]] * 50 and cuts == ["甲乙", "乙甲"]
    monkeypatch.setattr(wordlist, "KEPT", 1)
    assert lattice.tokens("乙 甲乙") == ["乙", "甲乙"] and len(lattice.known) <= 2
    assert lattice.tokens("甲" * 65) == ["甲"] * 65 and "甲" * 65 not in lattice.known
    lattice.put("乙甲", 9)
    assert lattice.tokens("乙甲") == ["乙甲"]


def test_a_python_tokenizer_cuts_each_text_once(spark):
    """Postings, counts and the number of texts come from one exchange of tokens; nulls, empty and repeated texts count as with any tokenizer."""
    cut = wordlist.tokenizer(spark.createDataFrame([("甲", 3), ("乙", 3)], "word string, n long"))
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<string>")
    def counting(texts: pd.Series) -> pd.Series:
        calls.add(len(texts))
        return texts.map(lambda t: None if t is None else list(t.replace(" ", "")))

    rows = spark.createDataFrame([(1, "甲 乙"), (2, "甲"), (2, "甲"), (3, ""), (4, None), (5, "乙 乙 甲")], "id long, text string")
    asked = spark.createDataFrame([(1, "乙 甲")], "query_id long, question string")
    want = hits(retrieve.bm25_search(index.lexical_index(rows, "id"), asked))
    assert hits(retrieve.bm25_search(index.lexical_index(rows, "id", tokenize=cut), asked, 10, cut)) == want
    ix = index.lexical_index(rows, "id", tokenize=counting)
    assert hits(retrieve.bm25_search(ix, asked)) == want and tuple(ix.corpus.first())[0] == 6
    calls.value = 0
    assert hits(retrieve.bm25_search(ix, asked)) == want and calls.value == 6


def test_words_are_learned(spark):
    r = random.Random(5)
    lexicon = ["营收", "增长", "银行业", "利润", "净资产", "下降"]
    texts = [("，".join("".join(r.choice(lexicon) for _ in range(r.randrange(1, 7))) for _ in range(4)) + " Q3 Report",) for _ in range(300)]
    df = spark.createDataFrame([*texts, (None,), ("",)], "text string")
    found = wordlist.candidates(df)
    words = {x["word"] for x in wordlist.words(found).collect() if len(x["word"]) > 1}
    assert set(lexicon) <= words
    cut = wordlist.tokenizer(wordlist.words(found))
    got = spark.createDataFrame([("银行业净资产增长，ABC利润 12",), (None,), ("",), ("鑫",)], "text string").select(cut(F.col("text"))).collect()
    assert [x[0] for x in got] == [["银行业", "净资产", "增长", "abc", "利润", "12"], None, [], ["鑫"]]
    for row in df.where("text <> ''").select("text", cut(F.col("text")).alias("t")).limit(50).collect():
        assert "".join(row["t"]) == "".join(wordlist.PIECE.findall(row["text"].lower()))
    with pytest.raises(ValueError, match="more than 3 words"):
        wordlist.tokenizer(wordlist.words(found), most=3)
    assert wordlist.candidates(df.where("text = ''")).count() == 0
    ix = index.lexical_index(spark.createDataFrame([(1, "银行业利润下降"), (2, "营收增长"), (3, "净资产")], "id long, text string"), "id", tokenize=cut)
    hit = retrieve.bm25_search(ix, spark.createDataFrame([(1, "利润")], "query_id long, question string"), 5, cut).collect()
    assert [x["id"] for x in hit] == [1]


# --- reranking and enrichment


def test_mmr_takes_all_candidates(spark):
    rows = [(1, f"h{i:03d}", i, 1.0 if i < 150 else 9.0, f"t{i}") for i in range(1, 151)]
    df = spark.createDataFrame(rows, "query_id long, id string, rank long, score double, content string")
    assert rerank.mmr(df, 3).where("rank = 1").first()["id"] == "h150"
    assert rerank.mmr(df, 120).count() == 120 and rerank.mmr(df, 3, most=100).where("id = 'h150'").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_mmr_is_greedy(spark, seed):
    r = random.Random(seed)
    rows = [(q, f"h{i}", i, r.choice([0.1, 0.5, 0.9]), " ".join(r.choice("abcdefg") for _ in range(r.randrange(0, 6)))) for q in range(4) for i in range(1, r.choice([3, 12, 30]))]
    got = rerank.mmr(spark.createDataFrame(rows, "query_id long, id string, rank long, score double, content string"), 4, 0.6).collect()
    for q in range(4):
        own = sorted(x for x in rows if x[0] == q)
        own.sort(key=lambda x: x[2])
        sets = {x[2]: set(x[4].split()) for x in own}
        like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] and sets[b] else 0.0  # noqa: B023, E731
        taken = []
        while len(taken) < min(4, len(own)) and len(own) > 4:
            taken.append(max((x for x in own if x[2] not in taken), key=lambda x: (round(0.6 * x[3] - 0.4 * max((like(x[2], t) for t in taken), default=0.0), 12), -x[2]))[2])
        want = [f"h{t}" for t in taken] or [x[1] for x in own]
        assert [x["id"] for x in sorted((x for x in got if x["query_id"] == q), key=lambda x: x["rank"])] == want


def test_waves_are_spread_and_not_sorted_again(spark, tmp_path):
    todo = spark.range(2000).select(F.concat(F.lit("f"), F.col("id") % 7).alias("filename"), F.col("id").alias("page"), F.col("id").cast("string").alias("path"))
    seen = tmp_path / "seen"
    seen.mkdir()

    def call(image):
        import os

        from pyspark import TaskContext

        (seen / f"{TaskContext.get().partitionId()}-{os.getpid()}-{threading.get_ident()}").touch()
        return '{"page_summary": "' + image + '"}'

    done = enrich.run(todo, str(tmp_path / "out"), call, wave=900)
    assert sorted(int(x["page_summary"]) for x in done.collect()) == list(range(2000))
    assert len({p.name.split("-")[0] for p in seen.iterdir()}) == 4  # all cores
    order = done.groupBy("done_at").agg(F.count("*").alias("n"), F.min(F.struct("filename", "page")).alias("low"), F.max(F.struct("filename", "page")).alias("high")).orderBy("done_at").collect()
    assert [x["n"] for x in order] == [900, 900, 200] and all(tuple(a["high"]) < tuple(b["low"]) for a, b in itertools.pairwise(order))
    part, total = enrich.numbered(todo, str(tmp_path / "numbered"))
    assert total == 2000 and sorted(tuple(x) for x in part(700, 5).select("filename", "page").collect()) == sorted(tuple(x) for x in todo.orderBy("filename", "page").select("filename", "page").collect())[700:705]
    assert enrich.numbered(todo.limit(0), str(tmp_path / "nothing"))[1] == 0


def test_pauses_between_calls(spark, tmp_path):
    waits = tmp_path / "waits"
    todo = spark.range(6).select(F.lit("f").alias("filename"), F.col("id").alias("page"), F.lit("x").alias("path"))

    def sleep(seconds):
        with waits.open("a") as f:
            f.write(f"{seconds}\n")

    enrich.run(todo, str(tmp_path / "out"), lambda image: "{}", tasks_at_once=1, delay=0.25, sleep=sleep)
    assert waits.read_text().split() == ["0.25"] * 5


# --- replies as variants, folds of long pages, scorers, streams


def test_chart_items(spark):
    reply = '```json\n{"page_summary": "s", "charts": [{"title": "a", "axis": {"x": "year"}, "values": [1, 2.5]}, {"title": null}, 7]}\n```'
    rows = [("f", 1, reply), ("f", 2, "no JSON"), ("f", 3, '{"charts": {}}'), ("f", 4, None), ("f", 5, 'said: {"charts": [], "tables": [{"rows": [[1, 2]]}]} so')]
    df = spark.createDataFrame(rows, "filename string, page long, reply string")
    got = enrich.chart_items(df, fields={"title": "string", "axis.x": "string", "values[1]": "double"})
    assert sorted(tuple(x) for x in got.drop("item").collect()) == [("f", 1, 0, "a", "year", 2.5), ("f", 1, 1, None, None, None), ("f", 1, 2, None, None, None)]
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    tables = enrich.chart_items(df, "tables", fields={"rows[0][1]": "bigint"})
    assert [tuple(x) for x in tables.select("page", "rows").collect()] == [(5, 2)]


def test_streamed_groups(spark):
    from quernstone.operators import chunk

    r = random.Random(1)
    stops = ["第一节概况。", "营收增长很快！", "# 标题行很长", "Costs fell again this year；", "管理层认为需求将在下半年回升，订单继续增长。"]
    pages = spark.createDataFrame([(f"f{i % 3}", i, "".join(r.choice(stops) for _ in range(r.randrange(0, 60))), ["|a|"]) for i in range(12)], "filename string, page int, text string, tables array<string>")
    marked = chunk.breakpoints(chunk.sentences(pages))
    rows = lambda df: sorted(tuple(x) for x in df.collect())
    for size in (60, 500):
        assert rows(chunk.stream_groups(marked, size)) == rows(chunk.group_sentences(marked, size))
    assert rows(chunk.semantic_chunks(pages, 120, 20, streamed=True)) == rows(chunk.semantic_chunks(pages, 120, 20))
    assert chunk.stream_groups(marked.limit(0)).count() == 0


def test_a_page_of_very_many_sentences(spark):
    from quernstone.operators import chunk

    n = 300_000
    one = spark.range(n).select(F.lit("f").alias("filename"), F.lit(1).cast("long").alias("page"), F.col("id").alias("idx"), F.lit("x" * 30).alias("sentence"), F.lit(0.9).alias("similarity"), F.lit(False).alias("is_break"))
    got = chunk.stream_groups(one.repartition(8, "idx"), 500)
    assert got.agg(F.count("*"), F.sum(F.length("text")), F.max(F.length("text"))).first()[:] == (n // 25, 30 * n, 750)


def test_probes_follow_from_the_vectors():
    """Clusters need few cells, noise needs most of them."""
    rng = np.random.default_rng(1)
    clusters = (rng.normal(size=(40, 16))[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 16)) * 0.1).astype(float)
    noise = rng.normal(size=(3000, 16))
    probes = []
    for x in (clusters, noise):
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        q = vector_index.Quantizer(vector_index.lloyd(x, 40, 8, rng, sphere=True), np.zeros((1, 1, 16)))
        probes.append(vector_index.calibrated(q, x, 0.95).probes)
    assert probes[0] <= 4 and probes[1] > 2 * probes[0]


class Padded:
    """Counts what a scorer that pads its pairs to one length would work on."""

    def __init__(self):
        self.work = 0

    def predict(self, pairs):
        self.work += len(pairs) * max(len(a) + len(b) for a, b in pairs)
        return [len(b) + 0.5 for _, b in pairs]


def test_scorers_get_pairs_of_one_length():
    r = random.Random(3)
    pairs = [("q", "x" * r.choice([1, 5, 500])) for _ in range(400)]
    plain, sorted_ = Padded(), Padded()
    want = [s for k in range(0, len(pairs), 16) for s in plain.predict(pairs[k : k + 16])]
    assert rerank.in_length_order(sorted_, pairs, 16) == want and sorted_.work < 0.5 * plain.work
    assert rerank.in_length_order(Padded(), [], 16) == []


def test_a_stage_may_ask_for_resources(spark):
    from pyspark.resource import ResourceProfileBuilder, TaskResourceRequests

    df = spark.createDataFrame([(1, "a", 1, "q", "xyz"), (1, "b", 2, "q", "x")], "query_id long, id string, rank long, question string, content string")
    profile = ResourceProfileBuilder().require(TaskResourceRequests().cpus(1)).build

    def scorer():
        class Lengths:
            def predict(self, pairs):
                return [len(b) + 0.5 for _, b in pairs]

        return Lengths()

    try:
        got = rerank.rerank(df, scorer(), profile=profile).collect()
    except Exception as e:  # a local session has no stage-level scheduling
        assert "ResourceProfiles are only supported" in str(e) or "TaskResourceProfiles" in str(e)
        got = rerank.rerank(df, scorer()).collect()
    assert [(r["rank"], r["id"], r["rerank_score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, "a", 3.5), (2, "b", 1.5)]


def test_enrichment_stream_survives_a_lost_wave(spark, tmp_path):
    """The second wave is killed in a task; a restart does it again, no page twice and none lost."""
    from quernstone.streaming import enrichment

    folder, out, mark = tmp_path / "img", str(tmp_path / "out"), str(tmp_path / "died")
    folder.mkdir()
    touch = lambda names: [(folder / f"doc_page_{i}.png").write_bytes(b"x") for i in names]

    def call(image):
        import os

        if "_page_17." in image and not os.path.exists(mark):
            open(mark, "w").close()
            os._exit(1)
        return '{"page_summary": "' + image.rsplit("/", 1)[-1] + '"}'

    touch(range(30))
    (folder / "cover.png").write_bytes(b"x")
    start = lambda: enrichment.enrich_stream(enrichment.image_stream(spark, str(folder), wave=8), out, str(tmp_path / "checkpoint"), call, attempts=1)
    with pytest.raises(Exception, match="(?i)exit|crash|EOF|exception"):
        start().awaitTermination()
    first = enrichment.results(spark, out)
    assert first.count() < 30
    start().awaitTermination()
    pages = lambda: sorted(r["page"] for r in enrichment.results(spark, out).collect())
    assert pages() == list(range(30))
    touch(range(25, 40))  # new pages, and old ones as other files
    (folder / "again").mkdir()
    (folder / "again" / "doc_page_3.png").write_bytes(b"x")
    start().awaitTermination()
    assert pages() == list(range(40))
    rows = enrichment.results(spark, out).collect()
    assert all(r["page_summary"] == f"doc_page_{r['page']}.png" and r["error"] is None for r in rows) and len({r["wave"] for r in rows}) >= 5


def test_the_whole_chain_over_saved_cells_and_blocks(spark, tmp_path):
    from quernstone import plugins
    from quernstone.plans import pipeline

    r = random.Random(6)
    topics = ["营收增长很快，利润上升", "银行业净资产下降", "管理层看好海外市场", "研发投入继续增加"]
    pages = spark.createDataFrame([(f"f{i % 4}", i, f"{r.choice(topics)}，第{i}页的说明文字。", []) for i in range(60)], "filename string, page long, text string, tables array<string>")
    asked = spark.createDataFrame([(1, "营收增长"), (2, "净资产"), (3, "海外市场研发")], "query_id long, question string")
    ix = pipeline.build_indexes(pages)
    ix.save(str(tmp_path / "plain"))
    ix.save(str(tmp_path / "fast"), cells=True, blocks=True)
    plain, fast = (pipeline.Indexes.load(spark, str(tmp_path / x)) for x in ("plain", "fast"))
    assert plain.cells is None and plain.blocks is None and fast.cells and fast.blocks
    fast.cells.quantizer = vector_index.Quantizer(fast.cells.quantizer.centroids, fast.cells.quantizer.codebooks, len(fast.cells.quantizer.centroids), 100)  # every cell
    rows = lambda ix: sorted(tuple(x) for x in pipeline.search(ix, asked, multi=True).select("query_id", "rank", "id", "score").collect())
    assert rows(fast) == rows(plain)
    assert pipeline.answer(fast, asked, plugins.EchoModel(), staged=True).count() == 3


def test_merge_typed(spark):
    pages = spark.createDataFrame([("f", 1), ("f", 2), ("f", 3), ("g", 1)], "filename string, page long")
    replies = [("f", 1, 1, '{"page_summary": "old"}'), ("f", 1, 2, '```json\n{"page_summary": "new", "has_charts": true, "charts": [{"title": "t", "rows": [[1, 2], [3, 4]]}, 5], "tables": "none"}\n```'), ("f", 2, 1, "no JSON"), ("f", 3, 1, None)]
    got = {(r["filename"], r["page"]): r for r in enrich.merge_typed(pages, spark.createDataFrame(replies, "filename string, page long, ord long, reply string"), "ord").select(
        "filename", "page", "chart_descriptions.page_summary", "chart_descriptions.has_charts", F.size("chart_descriptions.charts").alias("n"), F.size("chart_descriptions.tables").alias("m"),
        F.expr("try_variant_get(get(chart_descriptions.charts, 0), '$.rows[1][0]', 'int')").alias("x"),
    ).collect()}
    assert tuple(got["f", 1])[2:] == ("new", True, 2, 0, 3)
    assert all(tuple(got[k])[2:] == ("", False, 0, 0, None) for k in (("f", 2), ("f", 3), ("g", 1)))


def test_chunks_by_page_are_those_by_sentence(spark):
    """No sentence is a row of its own, whatever a page holds; rows of one page are one page."""
    from quernstone.operators import chunk

    r = random.Random(6)
    said = ["# 标题 一", "营收增长。", "成本下降！利润上升；", "The margin held up well", "margin held up again。", "x", "", "长" * 130, "## 标题 二"]
    rows = [("d", i, "\n".join(r.choices(said, k=r.randrange(0, 30))), r.choice([[], ["| a |", " "], ["", "| b |"]])) for i in range(80)]
    rows += [("n", 1, None, ["| t |"]), (None, 2, "没有文件名的一页。还有一句话在这里", []), ("n", 3, "short", ["| u |"]), ("n", 4, "..\n..\n..\n..\n..", ["| v |"])]
    rows += [("two", 1, "第一部分的句子。\n" * 9, ["| w |"]), ("two", 1, "x", ["| y |"])]
    pages = spark.createDataFrame(rows, "filename string, page long, text string, tables array<string>")
    found = chunk.semantic_chunks(pages, 120, 20)
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    key = lambda df: sorted(tuple(map(str, c)) for c in df.collect())
    assert key(found) == key(chunk.semantic_chunks(pages, 120, 20, streamed=True))


def test_a_frequent_term_is_saved_over_many_partitions(spark):
    """A term that all texts share does not go to one task."""
    postings = spark.range(0, 20_000, 1, 4).select("id", F.lit("all").alias("term"), F.lit(1).alias("tf"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sizes = [r["count"] for r in index.by_term(postings).groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 20_000 and max(sizes) < 20_000
