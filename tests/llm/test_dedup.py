"""Deduplication operators against brute force, with nulls, empties, ties, repeats and long texts."""

import hashlib
import random
from collections import Counter
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import near_vectors, ngram_join, seeds, substring, suffix
from quernstone.llm.components import connected_components

WORD = re.compile(r"[^ \t-\r]+")


def texts(seed: int, n: int = 60, vocabulary: int = 400) -> list[str | None]:
    r = random.Random(seed)
    names = ["".join(r.choice("abcdeé") for _ in range(r.randrange(1, 7))) for _ in range(vocabulary)]
    passages = [" ".join(r.choice(names) for _ in range(r.randrange(15, 60))) for _ in range(5)]
    out: list[str | None] = [None, "", " \n\t", "one", "ONE", "two words", "x " * 700, "lorem " + "z" * 5000]
    base = None
    while len(out) < n:
        kind = r.randrange(6)
        if kind == 0 and base:
            out.append(base)
        elif kind == 1 and base:
            w = base.split()
            for _ in range(r.randrange(1, 4)):
                w[r.randrange(len(w))] = r.choice(names)
            out.append(" ".join(w))
        elif kind == 2:
            out.append(" ".join([r.choice(names), r.choice(passages), r.choice(names), r.choice(passages)]) + "\n")
        else:
            base = " ".join(r.choice(names) for _ in range(r.randrange(1, 300)))
            out.append(base)
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, route long, known boolean")


def rows_of(all_texts):
    order = list(range(len(all_texts)))
    random.Random(5).shuffle(order)
    return [(3 * i + 1, all_texts[i], 7, None) for i in order]


def components(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components_chain_star_and_loop(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(300, 300), (400, 401), (401, 400)]
    got = dict(connected_components(spark.createDataFrame(links, "u long, v long")).collect())
    want = components({x for p in links for x in p} - {300}, [p for p in links if p[0] != p[1]])
    assert got == want
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_jaccard(rows, k, num, den):
    sets = {}
    for d, t, *_ in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(t or "")]
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    ids = sorted(x for x in sets if x is not None)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    comp = components(ids, links)
    return {(d, len(sets[d]), comp[d]) for d in ids}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_ngram_join(spark, k, num, den):
    rows = rows_of(texts(1, 90))
    got = ngram_join.jaccard_components(frame(spark, rows), k, num, den).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == brute_jaccard(rows, k, num, den)


def test_ngram_join_family_of_near_copies(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randrange(0, 6)):
            w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
        rows.append((i, " ".join(w), 0, True))
    got = {tuple(x) for x in ngram_join.jaccard_components(frame(spark, rows), 3, 90, 100).collect()}
    assert got == brute_jaccard(rows, 3, 90, 100)


def test_ngram_join_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    test_ngram_join_family_of_near_copies(spark)


def brute_rows(rows, k, num, den):
    """As brute_jaccard, with each row a document of its own."""
    by_row = {d: (n, c) for d, n, c in brute_jaccard([(i, t) for i, (_, t, *_) in enumerate(rows)], k, num, den)}
    low = {}
    for i, (d, *_) in enumerate(rows):
        low[by_row[i][1]] = min(d, low.get(by_row[i][1], d))
    return sorted((d, by_row[i][0], low[by_row[i][1]]) for i, (d, *_) in enumerate(rows))


@pytest.mark.parametrize("seed", range(4))
def test_ngram_join_texts_that_share_an_id(spark, seed):
    """Each text keeps its own links, whichever texts its id has besides."""
    r = random.Random(seed)
    names = [f"w{i}" for i in range(5000)]
    bases = [[r.choice(names) for _ in range(90)] for _ in range(12)]
    rows = []
    for i, base in enumerate(bases):
        rows.append((r.randrange(6), " ".join(base), 0, True))  # ids 0 to 5 have several texts
        rows += [(100 + 3 * i + j, " ".join(base[:60] + [f"e{i}"] * (j > 0) + base[60:]), 0, True) for j in range(3)]
        rows.append((r.randrange(6), " ".join([*base, f"t{i}"]), 0, True))
    rows += rows[:7]
    r.shuffle(rows)
    got = ngram_join.jaccard_components(frame(spark, rows), 3, 90, 100).collect()
    assert sorted(tuple(x) for x in got) == brute_rows(rows, 3, 90, 100)


def test_ngram_join_links_of_one_id(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(50))
    got = ngram_join.jaccard_components(frame(spark, [(1, a, 0, True), (1, b, 0, True), (2, a + " x", 0, True), (3, b + " x", 0, True)]), 3, 90, 100).collect()
    assert sorted(tuple(x) for x in got) == [(1, 48, 1), (1, 48, 1), (2, 49, 1), (3, 49, 1)]


def test_ngram_join_null_ids_repeats_and_nothing(spark):
    got = ngram_join.jaccard_components(frame(spark, [(None, "a b c d", 1, True), (2, "a b c d", 1, True), (2, "a b c d", 1, True), (None, None, 1, True)]), 3, 90, 100).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 2, None), (2, 2, 2), (2, 2, 2), (None, 0, None)], key=str)
    assert ngram_join.jaccard_components(frame(spark, []), 3, 90, 100).count() == 0


def brute_words(rows, span):
    seen, out = set(), {}
    for d, t, *_ in sorted(rows):
        w = WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - span + 1):
            key = tuple(w[i : i + span])
            if key in seen:
                gone.update(range(i, i + span))
            seen.add(key)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows = rows_of(texts(seed, 80))
    got = substring.digest(substring.remove_repeats(frame(spark, rows), span=20)).collect()
    assert len(got) == len(rows)
    assert {r[0]: tuple(r)[1:] for r in got} == brute_words(rows, 20)
    assert sum(r["n_removed"] for r in got) > 1000


def test_substring_dedup_null_ids_and_repeated_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    got = substring.remove_repeats(frame(spark, [(None, t, 1, True), (4, t, 1, True), (4, t, 1, True), (9, t, 1, True)])).select("doc_id", "n_removed").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 30), (4, 0), (4, 0), (9, 30)], key=str)
    assert substring.remove_repeats(frame(spark, [])).count() == 0


def test_substring_dedup_texts_that_share_an_id(spark):
    a, own = " ".join(f"a{i}" for i in range(120)), " ".join(f"u{i}" for i in range(10))
    rows = [(2, a, 1, True), (2, own, 1, True), (1, a, 1, True), (3, "z", 1, True), (None, a + " end", 1, True), (None, own, 1, True)]
    got = substring.remove_repeats(frame(spark, rows)).select("doc_id", "text", "n_removed").collect()
    want = {(2, a): 120, (2, own): 0, (1, a): 0, (3, "z"): 0, (None, a + " end"): 120, (None, own): 0}
    assert {(r[0], r[1]): r[2] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("local", [1, 4])
def test_substring_dedup_hot_anchors(spark, monkeypatch, local):
    monkeypatch.setattr(seeds, "LOCAL", local)
    rows = rows_of(texts(3, 120, 60))
    got = substring.digest(substring.remove_repeats(frame(spark, rows), span=20)).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_words(rows, 20)


def test_substring_dedup_carries_columns(spark):
    rows = [(1, "x " * 30, 5, None), (1, "y", 6, True), (None, None, 7, False)]
    got = substring.remove_repeats(frame(spark, rows), carry=["doc_id", "text", "route", "known"]).select("kept_text", "carried.*").collect()
    assert sorted((r["route"], r["known"], r["text"]) for r in got) == [(5, None, "x " * 30), (6, True, "y"), (7, False, None)]
    assert [r["kept_text"] for r in sorted(got, key=lambda r: r["route"])] == ["x", "y", ""]


def brute_bytes(rows, span):
    count = {}
    for _, t, *_ in rows:
        b = (t or "").encode()
        for i in range(len(b) - span + 1):
            count[b[i : i + span]] = count.get(b[i : i + span], 0) + 1
    out = {}
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - span + 1):
            if count[b[i : i + span]] > 1:
                gone[i : i + span] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out[d] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize(("seed", "budget"), [(1, 1 << 28), (2, 2000)])
def test_suffix_dedup(spark, seed, budget):
    rows = rows_of(texts(seed, 60))
    got = suffix.digest(suffix.remove_repeats(frame(spark, rows), span=200, budget=budget)).collect()
    assert len(got) == len(rows)
    assert {r[0]: tuple(r)[1:] for r in got} == brute_bytes(rows, 200)
    assert sum(r["n_spans"] for r in got) > 10
    assert suffix.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("budget", [1 << 28, 1 << 13])
def test_suffix_dedup_sorts_no_stretches_that_are_all_alike(spark, budget):
    """Many exact copies beside copies with another end, where an anchor's stretches don't fit into what a task holds at a time."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(900)) for _ in range(3)]
    rows = [(i, base[i % 3] if i % 5 else base[i % 3][:450] + str(i) * 200) for i in range(120)] + [(200, "alone " + "".join(rng.choice("xyz") for _ in range(600)))]
    found = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), span=200, budget=budget)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Sort [route" in plan  # so that an anchor's stretches come one after another
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in found.collect()}
    seen = Counter(t[a : a + 200] for _, t in rows for a in range(len(t) - 199))
    for i, t in rows:
        gone = set()
        for a in range(len(t) - 199):
            if seen[t[a : a + 200]] > 1:
                gone.update(range(a, a + 200))
        assert got[i] == (len(t), len(gone))


def test_suffix_dedup_texts_that_share_an_id(spark):
    r = random.Random(8)
    write = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    a, own, other = write(500), write(78), write(300)
    rows = [(1, a), (1, own), (2, a), (3, "z"), (None, other), (None, own + "x"), (7, other + "y"), (8, own), (9, write(400)), (9, None)]
    twice = write(250)
    rows += [(20, twice), (20, twice)]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed").collect()
    want = sorted((d or -1, len(t or ""), {a: 500, other: 300, other + "y": 300, twice: 250}.get(t, 0)) for d, t in rows)
    assert sorted((x[0] or -1, x[1], x[2]) for x in got) == want


def in_order(text: bytes, budget: int):
    positions, shared = (np.concatenate(x) for x in zip(*suffix.suffixes(np.frombuffer(text, np.uint8), 255, budget), strict=True))
    assert sorted(positions.tolist()) == list(range(len(text)))
    for a, b, s in zip(positions[:-1].tolist(), positions[1:].tolist(), shared[1:].tolist(), strict=True):
        n = 0
        while n < 255 and a + n < len(text) and b + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        assert s == n, (a, b, s, n)
        assert text[b : b + 300] < text[a : a + 300] or n >= 255


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("budget", [1 << 28, 64, 4096])
def test_suffixes_are_in_order_with_their_shared_prefixes(seed, budget):
    r = random.Random(seed)
    alphabet = ["ab", "abcdefgh", "a", "xyzzy "][seed % 4]
    piece = "".join(r.choice(alphabet) for _ in range(40))
    in_order("".join(r.choice([piece, piece[:13], r.choice(alphabet)]) for _ in range(30)).encode(), budget)


@pytest.mark.parametrize("seed", range(4))
def test_names_are_sorted_by_recursive_induction(seed, monkeypatch):
    """A budget far below the text: every level is induced from files, and none is sorted in memory."""
    depth, inner = [], suffix.sorted_lms

    def counted(level, most):
        depth.append((level.n, int(level.lone.sum()), len(level.lone)))
        return inner(level, most)

    monkeypatch.setattr(suffix, "sorted_lms", counted)
    monkeypatch.setattr(suffix, "by_doubling", None)
    monkeypatch.setattr(suffix, "NAME_BYTES", 1 << 40)
    r = random.Random(seed)
    words_ = ["".join(r.choice("abcd") for _ in range(r.randrange(1, 6))) for _ in range(60)]
    passage = " ".join(r.choice(words_) for _ in range(60))
    in_order(" ".join(r.choice([passage, *words_]) for _ in range(400)).encode(), 1 << (10 + 2 * seed))
    assert len(depth) >= 4 and all(a[0] > 2 * b[0] for a, b in zip(depth, depth[1:], strict=False))
    assert any(0 < lone < n for _, lone, n in depth[1:]) or seed


def brute_vectors(rows, cosine):
    real = {d: (lab, np.array(v, float)) for d, v, lab in rows if d is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(real)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if real[a][0] == real[b][0] and len(real[a][1]) == len(real[b][1]) and real[a][1] @ real[b][1] / np.linalg.norm(real[a][1]) / np.linalg.norm(real[b][1]) >= cosine]
    comp = components(sorted({d for d, *_ in rows if d is not None}), links)
    degree = {}
    for p in links:
        for x in p:
            degree[x] = degree.get(x, 0) + 1
    return {(d, degree.get(d, 0), comp[d], comp[d] == d) for d in comp}


@pytest.mark.parametrize("block", [1024, 8])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows, centre = [], rng.normal(size=16)
    for i in range(160):
        v = centre + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12, 2.0])
        rows.append((i, [float(x) for x in v], int(rng.integers(0, 2))))
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] + [1.0] * 15, 1), (203, [None] + [1.0] * 15, 1), (204, rows[0][1], None), (205, [], 1), (206, [1.0, 2.0], 1), (207, [1.0, 2.0], 1), (208, [2 * x for x in rows[3][1]], rows[3][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = near_vectors.near_vectors(df, 0.98).collect()
    assert len(got) == len(rows)
    assert {tuple(r) for r in got} == brute_vectors(rows, 0.98)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert near_vectors.near_vectors(empty).count() == 0


def test_near_vectors_null_ids_repeats_extremes_and_other_columns(spark):
    rows = [(None, [1.0, 2.0], 1, "x"), (1, [1.0, 2.0], 1, "x"), (1, [1.0, 2.0], 1, "x"), (2, [1e200, 2e200], 1, "x"), (3, [1e-200, 2e-200], 1, "x"), (4, [1.0, 2.0], None, "x"), (5, [1.0, 2.0], 2, "x"), (6, [2.0, 4.0], 2, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep string").withColumn("links", F.lit("clash"))
    got = near_vectors.near_vectors(df, 0.98).collect()
    want = [(None, 0, None, None), (1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_near_vectors_that_share_an_id(spark, seed):
    """Rows of one id and different vectors are different vectors; repeated rows are one."""
    r = np.random.default_rng(seed)
    bases = r.normal(size=(10, 16))
    rows = []
    for i, base in enumerate(bases):
        near = lambda: (base + r.normal(size=16) * 0.01).tolist()  # noqa: B023, E731
        rows += [(int(r.integers(0, 4)), near(), "x"), (100 + i, near(), "x"), (200 + i, base.tolist(), "x"), (int(r.integers(0, 4)), base.tolist(), "x"), (300 + i, near(), "y")]
    rows += rows[:6]
    once = sorted({(i, label, tuple(v)) for i, v, label in rows})
    unit = np.array([np.array(v) / np.linalg.norm(v) for _, _, v in once])
    alike = (unit @ unit.T >= 0.98) & (np.array([x[1] for x in once])[:, None] == np.array([x[1] for x in once])[None, :])
    comp = components(range(len(once)), list(zip(*np.nonzero(np.triu(alike, 1)), strict=True)))
    low = {}
    for k, (i, _, _) in enumerate(once):
        low[comp[k]] = min(i, low.get(comp[k], i))
    want = {x: (int(alike[k].sum()) - 1, low[comp[k]]) for k, x in enumerate(once)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted(tuple(x) for x in near_vectors.near_vectors(df, cosine=0.98).collect())
    assert got == sorted((i, *want[i, label, tuple(v)], i == want[i, label, tuple(v)][1]) for i, v, label in rows)


def test_near_vectors_links_of_one_id(spark):
    v, w = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.2, 0.0]
    df = spark.createDataFrame([(1, v, "a"), (1, w, "a"), (2, [1.0, 0.01, 0.0, 0.1], "a"), (3, [0.0, 1.0, 0.21, 0.0], "a")], "vec_id long, embedding array<double>, label string")
    assert sorted(tuple(x) for x in near_vectors.near_vectors(df).collect()) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_overlaps_are_counted_in_full_width():
    a = np.array([1 << 11, (1 << 11) + 1, 5 << 20], np.uint64)
    b = np.array([(1 << 11) + 1, (1 << 11) + 2, 5 << 20], np.uint64)
    n = np.array([3])
    assert ngram_join.overlaps(a, n, b, n).tolist() == [2]
    assert ngram_join.overlaps(np.concatenate([a, a]), np.array([3, 3]), np.concatenate([b, a]), np.array([3, 3])).tolist() == [2, 3]


def test_ngram_join_refuses_low_thresholds(spark):
    with pytest.raises(ValueError, match="one half"):
        ngram_join.jaccard_components(frame(spark, []), 3, 1, 2)


def test_near_vectors_not_finite(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(i, [x] + [1.0] * 3, 1) for i, x in enumerate([inf, inf, -inf, -inf, nan, nan, 1.0, 1.0])]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), 0.98).collect()
    assert sorted(map(tuple, got)) == [(i, 0, i, True) for i in range(6)] + [(6, 1, 6, True), (7, 1, 6, False)]
