"""Tokens, packing, mixing, language ID, media, sharding and the pipeline, against brute force or by round trips."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quernstone.llm import langid, media, mixing, packing, queries, sharding, tokens

MODEL, RANKS = tokens.public_path("byte_bpe_50k.json"), tokens.public_path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "Hello world", "it's 12 o'clock\n\n  <|endoftext|> x<|endoftext|>", "naïve café 日本語 ​퟿ 🙂", "a" * 3000, "word " * 3000, "\t\x1c\x85 　x", "<|endoftext|", "Hello world"]


def frame(spark, texts, extra="start long, id string"):
    return spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], f"doc_id long, text string, {extra}")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts(spark, library):
    got = {r["doc_id"]: r for r in tokens.count_tokens(frame(spark, TEXTS, "n_tokens long, id string"), MODEL, RANKS, room=3).collect()}
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 1024)
    assert tokens.count_tokens(frame(spark, []), MODEL, RANKS).count() == 0


BLANKS = ["word" + " " * 2_000_000 + "end", "\n" * 2_000_000, "x" + " \t" * 600_000 + "<|endoftext|>" + "\n \n" * 500_000 + " y", " " * 4096 + "<|endoftext|>", "a " * 3000 + " " * 5000]


def test_very_long_white_space(spark, library):
    docs = frame(spark, BLANKS)
    want = [library.encode(t, add_special_tokens=False).ids for t in BLANKS]
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(docs, MODEL, RANKS).collect()} == {i: len(x) for i, x in enumerate(want)}
    pieces = {(p["doc_id"], p["start"]): p for p in packing.pack(docs, MODEL, RANKS).collect()}
    for i, ids in enumerate(want):
        ids = np.array([*ids, 0], "<u4")
        for at in range(0, len(ids), 1024):
            assert pieces[i, at]["ids_crc32"] == zlib.crc32(ids[at : at + 1024].tobytes()) and pieces[i, at]["doc_tokens"] == len(ids)


def test_special_strings_of_any_form(spark, tmp_path, library):
    import json

    told = json.loads(open(MODEL, encoding="utf-8").read())
    told["added_tokens"][0]["content"] = "[PAD]"
    told["model"]["vocab"] = {("[PAD]" if k == "<|endoftext|>" else k): v for k, v in told["model"]["vocab"].items()}
    (tmp_path / "other.json").write_text(json.dumps(told))
    texts = ["a [PAD] b[PAD]", "[PAD", "<|endoftext|>"]
    other = Tokenizer.from_file(str(tmp_path / "other.json"))
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(frame(spark, texts), str(tmp_path / "other.json"), RANKS).collect()}
    assert got == {i: len(other.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_whole_tokens_are_single(library):
    proven = tokens.whole_tokens(MODEL)
    assert len(proven) > 45_000
    assert all(len(library.encode(s, add_special_tokens=False).ids) == 1 for s in sorted(proven)[::500])


def test_packing(spark, library):
    r = random.Random(1)
    texts = TEXTS + [" ".join("abc"[r.randrange(3)] * r.randrange(1, 5) for _ in range(r.randrange(1, 900))) for _ in range(150)]
    pieces = packing.pack(frame(spark, texts), MODEL, RANKS, group_pieces=60).collect()
    by_doc, by_seq = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_seq.setdefault(p["sequence_id"], []).append(p)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert (p["start"], p["doc_tokens"]) == (at, len(ids))
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    for group in by_seq.values():
        at = 0
        for p in sorted(group, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    assert sum(p["length"] for p in pieces) / len(by_seq) > 0.9 * 1024
    assert packing.pack(frame(spark, []), MODEL, RANKS).count() == 0


def test_best_fit_takes_the_tightest_window():
    place, offset = packing.best_fit_decreasing(np.array([6, 7, 3, 4, 10, 1]), 10)
    assert place.tolist() == [2, 1, 1, 2, 0, 3] and offset.tolist() == [0, 0, 7, 6, 0, 0]
    r = np.random.default_rng(2)
    sizes = r.integers(1, 40, 300)
    place, _ = packing.best_fit_decreasing(sizes, 40)
    left: list[int] = []
    for i in np.argsort(-sizes, kind="stable"):
        fits = [x for x in left if x >= sizes[i]]
        if fits and sizes[i] < 40:
            left[left.index(min(fits))] -= sizes[i]
        else:
            left.append(40 - sizes[i])
    assert sorted(40 - np.bincount(place, sizes).astype(int)) == sorted(left)


def brute_mix(rows, weights=(3, 1, 2), share=1.5, cap=2.0):
    size = {k: len(re.findall(r"[^ \t-\r]+", t or "")) for k, (_, t, _) in enumerate(rows)}
    total = {}
    for k, (_, _, s) in enumerate(rows):
        total[s] = total.get(s, 0) + size[k]
    names = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(total.values())
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > cap * total[s]}
        if not full:
            target |= {s: level * w[s] for s in open_}
            break
        for s in full:
            target[s] = cap * total[s]
            left -= target[s]
        open_ -= full
    return size, total, target


def test_mixing(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(r.randrange(0, 200))), r.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    rows += [(1000, None, "d"), (1001, "", "d"), (1002, "x", "e"), (7, "same id", "a"), (None, "no id", "b"), (None, "no id", "b")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    size, total, target = brute_mix(rows)
    assert len(got) == len(rows) and sorted(x["size"] for x in got) == sorted(size.values())
    taken = {}
    for x in got:
        assert x["source_size"] == total[x["source"]] and x["target"] == pytest.approx(target[x["source"]])
        assert x["taken"] == x["size"] * x["copies"] and 0 <= x["copies"] <= 2
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
    assert all(abs(taken[s] - target[s]) <= 200 for s in taken)
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


@pytest.mark.parametrize("kind", ["noise", "flat", "wave", "text", "spiky"])
def test_flac_round_trip(kind):
    rng = np.random.default_rng(5)
    make = {"noise": lambda n: rng.integers(0, 256, n), "flat": lambda n: np.full(n, 9), "wave": lambda n: 128 + 50 * np.sin(np.arange(n) / 9), "text": lambda n: rng.integers(97, 123, n), "spiky": lambda n: np.where(rng.random(n) < 0.01, rng.integers(0, 256, n), 32)}
    rows = [make[kind](n).astype(np.uint8) for n in (1, 2, 3, 64, 4096, 4097, 20_000)]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    streams = media.encode(np.concatenate(rows), offsets)
    cuts = np.concatenate([[0], np.cumsum([len(x) for x in streams])])
    data = np.frombuffer(b"".join(streams), np.uint8)
    pcm, at, seek, frames = media.decode(data, cuts)
    assert (pcm == np.concatenate(rows)).all() and (at == offsets).all()
    assert frames.tolist() == [1, 1, 1, 1, 1, 2, 5] and seek[-5:].tolist() == [0, 4096, 8192, 12288, 16384]
    if kind == "wave":
        assert len(streams[-1]) < 0.6 * 20_000
    for place in (cuts[-2] + 200, cuts[-1] - 1, cuts[-2] + 60):
        bad = data.copy()
        bad[place] ^= 4
        with pytest.raises(ValueError):
            media.decode(bad, cuts)


def bits(values):
    text = "".join(values)
    return bytes(int((text + "0" * (-len(text) % 8))[i : i + 8], 2) for i in range(0, len(text) + -len(text) % 8, 8))


def test_flac_linear_predictor_partitions_and_escapes():
    """A stream by hand: order 2, coefficients 3 and -2 over 2, two partitions, the second with plain 5-bit residuals."""
    n, shift, weights = 16, 1, (3, -2)
    residual = [0, 0, 1, -1, 0, 2, -3, 0] + [4, -5, 0, 15, -16, 1, 2, 3]
    x = [10, 12]
    for i in range(2, n):
        x.append(((weights[0] * x[-1] + weights[1] * x[-2]) >> shift) + residual[i])
    b = lambda v, k: format(v & (1 << k) - 1, f"0{k}b")
    zig = lambda v: 2 * v if v >= 0 else -2 * v - 1
    rice = lambda v, k: "0" * (zig(v) >> k) + "1" + (b(zig(v), k) if k else "")
    body = ["0", b(32 + 1, 6), "0", b(10, 8), b(12, 8), b(3, 4), b(shift, 5), b(3, 4), b(-2, 4), "00", b(1, 4), b(1, 4)]
    body += [rice(v, 1) for v in residual[2:8]] + [b(15, 4), b(5, 5)] + [b(v, 5) for v in residual[8:]]
    head = bytes([0xFF, 0xF8, 0x64, 0x02, 0, n - 1])
    one = lambda raw, w: int(media.crc_many(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), w)[0])
    frame_ = head + bytes([one(head, 8)]) + bits(body)
    frame_ += one(frame_, 16).to_bytes(2, "big")
    stream = media.stream_info(n, n, len(frame_), len(frame_), hashlib.md5(np.array(x, np.int8).tobytes()).digest(), True) + frame_
    pcm, *_ = media.decode(np.frombuffer(stream, np.uint8), np.array([0, len(stream)]))
    assert (pcm.astype(int) - 128).tolist() == x


def test_flac_in_runs_of_frames(monkeypatch):
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, 256, n).astype(np.uint8) for n in (64, 4096, 30_000, 4097, 128)]
    data, offsets = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
    whole = media.encode(data, offsets)
    monkeypatch.setattr(media, "RUN", 5000)
    assert media.encode(data, offsets) == whole


def test_null_ids_and_repeated_rows(spark, library):
    """Media, tokens and packing treat them as rows like others."""
    df = spark.createDataFrame([(None, "a b"), (None, None), (5, "a b"), (5, "a b")], "doc_id long, text string")
    assert sorted((x["doc_id"] or 0, x["n_bytes"]) for x in media.round_trip(df).collect()) == [(0, 0), (0, 3), (5, 3), (5, 3)]
    assert sorted((x["doc_id"] or 0, x["n_tokens"]) for x in tokens.count_tokens(df, MODEL, RANKS).collect()) == [(0, 0), (0, 2), (5, 2), (5, 2)]
    got = packing.pack(df, MODEL, RANKS).collect()
    assert sorted((x["doc_id"] or 0, x["length"]) for x in got) == [(0, 1), (0, 3), (5, 3), (5, 3)]
    assert sorted((x["offset"], x["length"]) for x in got) == [(0, 3), (3, 3), (6, 3), (9, 1)]


def test_models_with_other_settings_are_refused(tmp_path):
    import json

    told = json.load(open(MODEL, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [told["added_tokens"][0] | {"lstrip": True}]}):
        (tmp_path / "m.json").write_text(json.dumps(told | change))
        with pytest.raises(ValueError, match="unsupported"):
            tokens.special_tokens(str(tmp_path / "m.json"))


def test_mixing_without_ids(spark):
    """A source whose ids are all null or equal is met as closely as any other; clashing columns do no harm."""
    rows = [(None, f"w {i} " * 5, "a", 1, "x") for i in range(300)] + [(7, f"v {i} " * 5, "b", 1, "x") for i in range(300)] + [(i, "u " * 10, "c", 1, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, hash long, target string")
    got = mixing.mix(df).collect()
    for s in "abc":
        assert abs(sum(x["taken"] for x in got if x["source"] == s) - next(x["target"] for x in got if x["source"] == s)) <= 10
    assert sum(len(x["text"].split()) for x in mixing.repeated(df).collect()) == sum(x["taken"] for x in got)


def test_media_table(spark):
    df = frame(spark, TEXTS, "media long, id string")
    got = {r["doc_id"]: r for r in media.round_trip(df).collect()}
    slow = {r["doc_id"]: r for r in media.digests(media.load(media.store(df))).collect()}
    assert got == slow
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        full = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert got[3].asDict() | {"doc_id": 0} == got[10].asDict() | {"doc_id": 0}
    streams = {r["doc_id"]: bytes(r["media"]) for r in media.store(df).collect()}
    assert all(hashlib.sha256(s).hexdigest() == got[i]["media_sha256"] for i, s in streams.items())
    assert media.round_trip(frame(spark, [])).count() == 0


def test_language_id(spark):
    r = random.Random(6)
    syllables = {"xx": ["ba", "du", "gor", "th"], "yy": ["çi", "lé", "oux", "que"], "zz": ["sch", "ung", "keit", "zu"]}
    rows = []
    for i in range(600):
        lang = r.choice(sorted(syllables))
        text = " ".join("".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(3, 60)))
        rows.append((i, text, lang if r.random() < 0.9 else None, lang))
    rows += [(9000, None, "xx", "und"), (9001, "", None, "und"), (9002, "12 !?", None, "und"), (None, "schkeitung zu", "zz", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string").withColumn("score", F.lit("clash"))
    model = langid.fit(df, per_label=100)
    got = langid.predict(df, model).withColumn("held", langid.held_out()).collect()
    assert len(got) == len(rows) and model.labels == ["xx", "yy", "zz"]
    held = [x for x in got if x["held"]]
    assert len(held) > 100 and sum(x["lang_pred"] == x["truth"] for x in held) >= 0.98 * len(held)
    assert all(x["lang_pred"] == "und" and x["rejected"] for x in got if x["truth"] == "und")
    assert sum(x["rejected"] for x in got if x["truth"] != "und") <= 3
    assert all(0 <= x["score"] <= 1 for x in got)
    alone = langid.predict(df.where("doc_id = 5"), model).first()
    assert alone["score"] == pytest.approx(next(x["score"] for x in got if x["doc_id"] == 5))
    none = langid.fit(df.where("false"))
    assert {x["lang_pred"] for x in langid.predict(df, none).collect()} == {"und"}


def test_sharding(spark):
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 65_537)
    counts = np.bincount(table)
    assert len(table) == 65_537 and counts.max() - counts.min() <= 1
    fewer = sharding.lookup_table(shards[:-1], 65_537)
    stay = table != 6
    assert (table[stay] == fewer[stay]).mean() > 0.75
    df = spark.createDataFrame([(i % 50, "old") for i in range(100)] + [(None, "old")], "k long, shard string")
    got = sharding.place(df, "k", shards).collect()
    assert len(got) == 101 and len({(x["k"], x["shard"]) for x in got}) == 51
    assert all(x["shard"] == shards[table[x["slot"]]] for x in got)
    for bad in ((["a", "a"], 7), ([], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.lookup_table(*bad)


def test_sharding_table_is_a_plain_refill():
    """The table against a direct one: lists of preferences in full, and shards that take turns."""
    shards, size = [f"s{i}" for i in range(5)], 101
    wish = []
    for s in shards:
        d = hashlib.sha256(s.encode()).digest()
        offset, skip = int.from_bytes(d[:8], "big") % size, int.from_bytes(d[8:16], "big") % (size - 1) + 1
        wish.append([(offset + j * skip) % size for j in range(size)])
        assert sorted(wish[-1]) == list(range(size))
    table = {}
    while len(table) < size:
        for k in range(len(shards)):
            if len(table) < size:
                table[next(x for x in wish[k] if x not in table)] = k
    assert sharding.lookup_table(shards, size).tolist() == [table[i] for i in range(size)]


def test_sharding_of_nothing(spark):
    assert sharding.place(spark.createDataFrame([], "k long, slot string"), "k", ["a", "b"]).count() == 0


def test_language_id_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    held = langid.predict(docs, model).where(langid.held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).collect()
    assert len(held) > 150
    assert sum(x["lang_pred"] == x["lang"] for x in held) >= 0.98 * len(held)
    assert sum(x["rejected"] for x in held) <= 0.02 * len(held)


def test_queries_match_their_names():
    names = list(queries.queries())
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in names] == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    words = {"xx": ["bado", "gorth", "dugo", "thba"], "yy": ["çilé", "ouxque", "léoux", "queçi"]}
    prose = lambda lang, n: " ".join(r.choice(words[lang]) + str(r.randrange(10**6)) for _ in range(n))
    passage = prose("xx", 70)
    rows = [(i, prose(lang, 120), lang, f"s{i % 3}", 1) for i, lang in enumerate(["xx", "yy"] * 40)]
    rows += [(100, rows[0][1], "xx", "s0", 1), (101, rows[2][1] + " one", "xx", "s1", 1), (102, prose("xx", 90) + " " + passage, "xx", "s2", 1), (103, passage + "\n" + prose("xx", 90), "xx", "s0", 1), (104, "123 456", None, "s1", 1), (105, None, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    after = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, after, str(tmp_path)).cache()
        assert after.columns == docs.columns
        seen[name] = {x["doc_id"]: x["text"] for x in after.collect()}
    every = {x[0] for x in rows}
    assert set(seen["language ID"]) == every - {104, 105}
    assert set(seen["n-gram Jaccard join"]) == every - {100, 101, 104, 105}
    texts = dict((x[0], x[1]) for x in rows)
    cut = seen["substring dedup"]
    assert set(cut) == set(seen["n-gram Jaccard join"])
    assert cut[103] == " ".join(texts[103].split()[70:]) and all(cut[d] == texts[d] for d in cut if d != 103)
    assert set(seen["mixing"]) <= set(cut)
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(final.columns) and final.count() > 0


def pipeline_rows(seed):
    r = random.Random(seed)
    words = ["bado", "gorth", "dugo", "thba"]
    prose = lambda n: " ".join(r.choice(words) + str(r.randrange(10**6)) for _ in range(n))
    return prose, [(i, prose(100), "xx", f"s{i % 3}", 1) for i in range(60)]


def test_pipeline_keeps_null_ids(spark, tmp_path):
    import corpus_pipeline

    prose, rows = pipeline_rows(9)
    rows += [(None, prose(100), "xx", "s1", 1), (None, prose(100), "xx", "null ids", 1), (None, prose(100), "xx", None, 1)]
    after = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-2]:
        after = stage(spark, after, str(tmp_path)).cache()
        assert sorted(x["text"] for x in after.collect()) == sorted(x[1] for x in rows), name
    want = {}
    for x in mixing.mix(after).collect():
        key = (x["doc_id"], x["source"])
        want[key] = want.get(key, 0) + x["copies"]
    mixed = corpus_pipeline.STAGES[3][1](spark, after, str(tmp_path)).cache()
    got = {}
    for x in mixed.collect():
        key = (x["doc_id"], x["source"])
        got[key] = got.get(key, 0) + 1
    assert got == {k: n for k, n in want.items() if n} and got[None, "null ids"] == 2 and mixed.columns == after.columns
    pieces = corpus_pipeline.STAGES[4][1](spark, mixed, str(tmp_path))
    assert pieces.where("doc_id is null and start = 0").count() == sum(n for (d, _), n in want.items() if d is None)


def test_pipeline_repeated_ids(spark, tmp_path):
    import corpus_pipeline

    prose, rows = pipeline_rows(10)
    passage, long_passage, own, twin = prose(70), prose(200), prose(150), prose(100)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    put = lambda d, t: (d, t, "xx", "s1", 1)
    rows += [put(-1, passage + " " + own)]
    rows += [put(100, prose(90) + "\n" + passage)] * 3  # one row, repeated, that loses words
    rows += [put(200, long_passage + " " + prose(5)), put(200, "short words only"), put(200, prose(60) + " " + passage)]  # one id, three texts
    rows += [put(300, twin), put(300, twin + " more"), put(301, twin), put(302, None), put(302, None)]
    deduped = corpus_pipeline.STAGES[1][1](spark, spark.createDataFrame(rows, schema), str(tmp_path)).cache()
    got = sorted((x["doc_id"], x["text"] or "") for x in deduped.collect())
    left = set(rows) - {put(300, twin), put(300, twin + " more"), put(301, twin)}
    first = [x for x in got if x[0] >= 300 and x[1]]
    assert len(first) == 1 and first[0] in {(300, twin), (300, twin + " more")}
    assert [x for x in got if x not in first] == sorted((d, t or "") for d, t, *_ in left)

    for again in (1, 3):  # also where the stage itself is given repeated rows
        given = spark.createDataFrame([x for x in sorted(left, key=str) for _ in range(again)], schema)
        cut = sorted((x["doc_id"], x["text"] or "", x["n_chars"]) for x in corpus_pipeline.STAGES[2][1](spark, given, str(tmp_path)).collect())
        want = []
        for d, t, _, _, n in left:
            kept = " ".join(t.replace(passage, "").split()) if d in (100, 200) and passage in t else t or ""
            want += [(d, kept, n if kept == (t or "") else len(kept))] * again
        assert cut == sorted(want)


@pytest.mark.parametrize("labels", [2, 4])
def test_language_id_rejects_unlearned_languages(spark, labels):
    r = random.Random(12)
    syllables = {"ww": ["pri", "no", "ska", "vel"], "xx": ["ba", "du", "gor", "th"], "yy": ["çi", "lé", "oux", "que"], "zz": ["sch", "ung", "keit", "zu"]}
    learned = sorted(syllables)[:labels]
    write = lambda parts: " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(30))
    rows = [(i, write(syllables[lang]), lang) for i, lang in enumerate(learned * (800 // labels))]
    other = [(10_000 + i, write(parts), None) for i, parts in enumerate([["при", "вет", "мир", "ска"], ["日", "本", "語", "文"], ["jjq", "wkx", "ymf", "xwj"]] * 20)]
    df = spark.createDataFrame(rows + other, "doc_id long, text string, lang string")
    got = langid.predict(df, langid.fit(df)).withColumn("held", langid.held_out()).collect()
    held = [x["rejected"] for x in got if x["held"] and x["lang"]]
    assert len(held) > 150 and sum(held) <= 0.02 * len(held)
    assert all(x["rejected"] for x in got if x["lang"] is None)


def test_language_id_learns_from_whole_texts(spark):
    long_ = "header " * 1000 + "".join(f"<{k}>" for k in range(50_000))
    rows = [(0, long_, "xx"), (1, "short text", "xx"), (2, "é" * 90_000, "xx"), (3, "plain words " * 200_000, "yy"), (4, "", "yy")]
    found, langs = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 1000, 7)
    assert langs == ["xx", "xx", "xx", "yy", "yy"]
    assert [x.text for x in found] == [None, b"short text", ("é" * 90_000).encode(), None, b""]
    for i in (0, 3):
        at, n = np.unique(langid.features(rows[i][1].encode(), langid.BUCKETS), return_counts=True)
        assert np.array_equal(found[i].counts[0], at) and np.array_equal(found[i].counts[1], n)
        assert len(found[i].pieces) == langid.PIECES and all(len(x) == langid.SHORT and x in rows[i][1].encode() for x in found[i].pieces)
    assert max(long_.encode().index(x) for x in found[0].pieces) > len(long_) // 2
    assert 20 <= len(found[0].stretch(np.random.default_rng(1))) < langid.SHORT
    model = langid.train(found * 20, langs * 20)
    assert model.labels == ["xx", "yy"]


def test_language_scores_are_plain_sums(spark):
    """Each text's score against the sum over its own subwords, texts at the edges of batches and slices included."""
    rng = np.random.default_rng(3)
    model = langid.Model(["a", "b", "c"], rng.normal(0, 1, (langid.BUCKETS, 3)).astype(np.float32), rng.normal(size=3), 1.3, 0.5, 0.6)
    r = random.Random(2)
    texts = ["x", "é", "Ab", "ab cd", " lead", "trail ", "日本語", "1 a 2"] + ["".join(r.choice("abcdé 1.") for _ in range(r.randrange(1, 700))) + "z" for _ in range(200)] + ["z" * 3_000_000, "last"]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {x["doc_id"]: x for x in langid.predict(frame(spark, texts), model).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for i, t in enumerate(texts):
        at = langid.features(t.encode(), langid.BUCKETS)
        p = langid.softmax((model.table[at].sum(axis=0, dtype=np.float64) / len(at) + model.bias) / model.temperature)
        assert got[i]["lang_pred"] == model.labels[int(p.argmax())] and got[i]["score"] == pytest.approx(p.max(), rel=1e-5)
        assert got[i]["rejected"] == (got[i]["score"] < (model.short_threshold if len(t.encode()) < langid.SHORT else model.threshold))
