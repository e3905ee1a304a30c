"""Product codes, hidden Markov scores and periodic runs, against brute force."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest

from quernstone.llm import hidden_markov, langid, periodic, queries, vector_codes

TABLE = "doc_id long, text string, start long, runs string"


# --- op13


def brute_runs(items, times=4, least=6):
    """Every period at every place."""
    n, found = len(items), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if items[i] != items[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and items[j] == items[j + q]:
                j += 1
            if j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, m, q) for (s, m), q in found.items())


def brute_planted(words, doc_id):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def brute_digest(doc_id, text):
    own = brute_planted((text or "").encode().split(), doc_id)
    runs = brute_runs(own)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = b" ".join(w for i, w in enumerate(own) if i not in gone)
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def repetitive(r, parts, letters=3):
    out = []
    for _ in range(parts):
        p = [r.choice("abcdefgh"[:letters]) for _ in range(r.randrange(1, 7))]
        out += (p * r.randrange(1, 9))[: r.randrange(1, 40)]
    return out


@pytest.mark.parametrize(("times", "least"), [(4, 6), (2, 2), (2, 9), (3, 7)])
def test_runs_of_many_rows(times, least):
    r = random.Random(times * 100 + least)
    for _ in range(150):
        rows = [repetitive(r, r.randrange(0, 6), r.choice([2, 3, 8])) for _ in range(r.randrange(1, 6))]
        firsts = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        word = np.array([ord(c) for x in rows for c in x], np.int64)
        row, start, length, q = periodic.runs_of(word, firsts, times, least)
        got = [[(int(a), int(b), int(c)) for i, a, b, c in zip(row, start, length, q, strict=True) if i == k] for k in range(len(rows))]
        assert got == [brute_runs(x, times, least) for x in rows]


def test_runs_do_not_leave_their_row_or_stretch():
    word = np.array([1] * 5 + [1] * 5 + [1] * 6)
    row, start, length, q = periodic.runs_of(word, np.array([0, 5, 10, 16]))
    assert (row.tolist(), start.tolist(), length.tolist(), q.tolist()) == ([2], [0], [6], [1])
    assert periodic.mask_size(4, 6) == 5


def test_periodic_runs(spark):
    r = random.Random(4)
    rows = [(i, " ".join(repetitive(r, r.randrange(0, 9), 5)), 1, "x") for i in range(160)]
    rows += [(200, None, 1, "x"), (201, "", 1, "x"), (202, " \t\n", 1, "x"), (203, "w " * 40_000, 1, "x"), (204, " ".join(map(str, range(300))) + " " + " ".join(map(str, range(300))), 1, "x"), (None, "a b " * 9, 1, "x"), (None, "a b " * 9, 1, "x"), (7, "é é é é é é é", 1, "x"), (7, "é é é é é é é", 1, "x")]
    got = periodic.digest(periodic.periodic_runs(spark.createDataFrame(rows, TABLE), plant=True)).collect()
    small = [x for x in rows if x[0] != 203]
    key = lambda x: (x[0] is None, x[0] or 0, x)
    assert sorted((tuple(x) for x in got if x["doc_id"] != 203), key=lambda x: repr(x)) == sorted((brute_digest(x[0], x[1]) for x in small), key=lambda x: repr(x))
    assert key is not None and any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(160))
    one = next(x for x in got if x["doc_id"] == 203)
    assert (one["n_runs"], one["start"], one["length"], one["period"], one["exponent_milli"]) == (1, 0, 40_000, 1, 40_000_000)
    empty = periodic.digest(periodic.periodic_runs(spark.createDataFrame([], TABLE)))
    assert empty.count() == 0 and empty.columns[:2] == ["doc_id", "n_runs"]


def test_kept_text_and_carried_columns(spark):
    docs = spark.createDataFrame([(1, "x go go go go go go y", 3, "r"), (2, "a b", None, None)], TABLE)
    got = {x["doc_id"]: x for x in periodic.periodic_runs(docs, carry=docs.columns).collect()}
    assert got[1]["kept_text"] == "x go y" and got[1]["carried"]["runs"] == "r" and [tuple(x) for x in got[1]["runs"]] == [(1, 6, 1)]
    assert got[2]["kept_text"] == "a b" and got[2]["runs"] == [] and got[2]["carried"]["text"] == "a b"


# --- op11


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096, dim=None):
    """Plain Lloyd on Python integers; rows are (vec_id, vector, label)."""
    whole = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    whole.sort(key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    w = dim // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for _, v, _ in whole]
    books = [[own[p] for own in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, p: min(range(len(books[p])), key=lambda j: (far(x, books[p][j]), j))
    for _ in range(rounds):
        code = [[near(own[p], p) for p in range(parts)] for own in cut]
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [own[p] for own, c in zip(cut, code, strict=True) if c[p] == j]
                if mine:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    code = [[near(own[p], p) for p in range(parts)] for own in cut]
    error = [sum(far(own[p], books[p][c[p]]) for p in range(parts)) for own, c in zip(cut, code, strict=True)]
    by_label = {}
    for (_, _, label), e in zip(whole, error, strict=True):
        by_label[label] = by_label.get(label, 0) + e
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, "".join(f"{j:02x}" for j in c), e, by_label[label], sha) for (i, _, label), c, e in zip(whole, code, error, strict=True)]


VECTORS = "vec_id long, embedding array<float>, label int, code string"


@pytest.mark.parametrize("kind", ["plain", "ties", "few", "wide"])
def test_vector_codes(spark, kind):
    r = random.Random(len(kind))
    f32 = lambda x: float(np.float32(x))
    make = {"plain": lambda: f32(r.gauss(0, 0.3)), "ties": lambda: r.randrange(-1, 2) / 4096, "few": lambda: f32(r.gauss(0, 1)), "wide": lambda: f32(r.gauss(0, 1) * 10 ** r.randrange(0, 5))}[kind]
    n = 9 if kind == "few" else 260
    rows = [(i, [make() for _ in range(16)], r.choice([1, 1, 1, 2, None])) for i in range(n)]
    rows += [(3, rows[0][1], 2), (3, rows[0][1], 2), (None, rows[1][1], None), (-5, None, 1), (-4, [0.0] * 15 + [None], 1), (-3, [0.0] * 15 + [float("nan")], 1), (-2, [0.0] * 15 + [float("inf")], None), (-1, [], 1), (n, [1.0] * 24, 1)]
    got = vector_codes.vector_codes(spark.createDataFrame([(*x, "c") for x in rows], VECTORS))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute_codes(rows, dim=16), key=repr)


def test_vector_codes_without_whole_vectors(spark):
    assert vector_codes.vector_codes(spark.createDataFrame([], VECTORS)).count() == 0
    assert vector_codes.vector_codes(spark.createDataFrame([(1, None, 1, "c"), (2, [1.0] * 7, 1, "c"), (3, [float("nan")] * 8, 1, "c")], VECTORS)).count() == 0
    huge = vector_codes.vector_codes(spark.createDataFrame([(1, [3.0e38] * 8, 1, "c"), (2, [0.5] * 8, 1, "c")], VECTORS)).collect()
    assert [(x["vec_id"], x["error"]) for x in huge] == [(2, 0)]


def test_bounds_save_distances(monkeypatch):
    """Once entries settle, most rows are not scanned at all; the codes stay those of a full scan."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(16, 8)) * 3000
    x = (centre[rng.integers(0, 16, 4000)] + rng.normal(size=(4000, 8)) * 90).astype(np.int64)
    books = vector_codes.Codebooks(x[:16][None].copy(), vector_codes.groups_of(x[:16])[None])
    t = int(books.group.max()) + 1
    code, ub, lb, before = np.zeros(len(x), np.int64), np.zeros(len(x), np.float32), np.zeros((len(x), t), np.float32), None
    scanned, whole = [], vector_codes.squared
    for _ in range(12):
        scanned.append(0)

        def counted(a, b):
            scanned[-1] += len(a) * len(b)
            return whole(a, b)

        monkeypatch.setattr(vector_codes, "squared", counted)
        drift = None if before is None else np.nextafter(np.sqrt(((books.entries - before.entries).astype(float) ** 2).sum(2)), np.inf)[0]
        vector_codes.assign(x, books, 0, code, ub, lb, drift, False)
        assert (code == ((x[:, None] - books.entries[0][None]) ** 2).sum(2).argmin(1)).all()
        totals = np.zeros((1, 16, 9), object)
        for j in range(16):
            totals[0, j] = [int((code == j).sum()), *(int(v) for v in x[code == j].sum(0))]
        before, books = books, vector_codes.moved(books, totals)
    assert scanned[0] == 16 * len(x) and min(scanned[1:]) < 0.2 * scanned[0]


# --- op12


def tiny_model(states, classes, seed):
    rng = np.random.default_rng(seed)
    one = lambda *size: (lambda x: x / x.sum(-1, keepdims=True))(rng.random(size) + 0.05)
    return hidden_markov.Model(one(states), one(states, states), one(states, classes).T.copy())


def test_likelihoods_and_expected_counts(monkeypatch):
    """Against sums over all paths of states; chunks of three, so that texts are put together from many."""
    monkeypatch.setattr(hidden_markov, "CLASSES", 5)
    r = random.Random(8)
    texts = [[r.randrange(5) for _ in range(n)] for n in (1, 2, 3, 4, 6, 7, 8, 3, 1)]
    m = tiny_model(3, 5, 2)
    starts, moves, emits, logs = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3)), []
    for text in texts:
        ways = []
        for path in itertools.product(range(3), repeat=len(text)):
            p = m.start[path[0]] * m.emit[text[0], path[0]]
            for t in range(1, len(text)):
                p *= m.move[path[t - 1], path[t]] * m.emit[text[t], path[t]]
            ways.append((path, p))
        total = sum(p for _, p in ways)
        logs.append(math.log(total))
        for path, p in ways:
            starts[path[0]] += p / total
            for t, s in enumerate(path):
                emits[text[t], s] += p / total
                if t:
                    moves[path[t - 1], s] += p / total
    for chunk in (1, 3, 100):
        monkeypatch.setattr(hidden_markov, "CHUNK", chunk)
        cut = hidden_markov.Chunks(np.array([c for t in texts for c in t]), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        assert np.allclose(cut.likelihoods(m), logs)
        got = cut.expected(m)
        assert np.allclose(got[0], starts) and np.allclose(got[1], moves) and np.allclose(got[2], emits) and got[3] == pytest.approx(sum(logs))


def test_texts_of_one_chunk_and_of_many_agree(monkeypatch):
    rng = np.random.default_rng(1)
    m, size = tiny_model(4, 50, 3), [5000, 1, 700, 2048, 1024, 1025]
    classes, firsts = rng.integers(0, 50, sum(size)), np.concatenate([[0], np.cumsum(size)])
    monkeypatch.setattr(hidden_markov, "CLASSES", 50)
    cut, a = hidden_markov.Chunks(classes, firsts).likelihoods(m), hidden_markov.Chunks(classes, firsts).expected(m)
    monkeypatch.setattr(hidden_markov, "CHUNK", 10_000)
    b = hidden_markov.Chunks(classes, firsts).expected(m)
    assert np.allclose(cut, hidden_markov.Chunks(classes, firsts).likelihoods(m), rtol=1e-10) and np.isfinite(cut).all()
    assert all(np.allclose(x, y) for x, y in zip(a, b, strict=True))


def brute_base(rows, learns):
    texts = [(t or "").encode().lower().split() + [b""] for _, t in rows]
    count = {}
    for (i, _), words in zip(rows, texts, strict=True):
        for w in words if learns(i) else ():
            count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    base = [sum(math.log10((count.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))) for w in words) for words in texts]
    return n, [(len(w), sum(x in count for x in w), b) for w, b in zip(texts, base, strict=True)]


def test_lm_scores(spark):
    r = random.Random(6)
    lexicon = {k: [f"{k}{i}" for i in range(60)] for k in ("la", "mo", "zu")}
    own = lambda n: (lambda words: " ".join(r.choice(words) for _ in range(n)))(lexicon[r.choice(list(lexicon))])
    rows = [(i, own(r.randrange(1, 120))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "La1 LA1 É é unheard"), (1004, own(5000)), (7, own(9)), (None, "la1 la2"), (None, "la1 la2")]
    docs = spark.createDataFrame([(*x, 5.0, "s") for x in rows], "doc_id long, text string, score double, n_tokens string")
    learns = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    n, want = brute_base(rows, learns)
    got = hidden_markov.score(docs, "crc32(cast(cast(doc_id AS string) AS binary)) % 5 <> 1").collect()
    assert len(got) == len(rows) and {x["train_tokens"] for x in got} == {n}
    brute = sorted(((i is None, i or 0, bool(learns(i)), k, m, round(b, 6)) for (i, _), (k, m, b) in zip(rows, want, strict=True)))
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0, x["learns"], x["n_tokens"], x["n_known"], round(x["base_score"], 6)) for x in got) == brute
    assert all(math.isfinite(x["score"]) and x["score"] < 0 for x in got)
    held = [x for x in got if not x["learns"]]
    assert sum(x["score"] for x in held) > sum(x["base_score"] for x in held) + 0.2 * sum(x["n_tokens"] for x in held)  # three lexica: half a digit at most
    assert hidden_markov.score(docs.limit(0), "true").count() == 0
    nothing = hidden_markov.score(docs.where("doc_id < 3"), "false").collect()
    assert all(x["n_known"] == 0 and x["train_tokens"] == 0 and math.isfinite(x["score"]) for x in nothing)


def test_probabilities_of_words_sum_to_one():
    """Of every state: over known words and one unknown word a class."""
    rng = np.random.default_rng(5)
    base = rng.random(hidden_markov.CLASSES)
    base /= base.sum()
    counts = rng.random(3) * 9, rng.random((3, 3)) * 99, np.where(rng.random((hidden_markov.CLASSES, 3)) < 0.1, rng.random((hidden_markov.CLASSES, 3)) * 9, 0)
    for m in (hidden_markov.initial(base, 3, 1), hidden_markov.learned(counts, base, 0.75)):
        assert np.allclose(m.emit.sum(0), 1) and np.allclose(m.move.sum(1), 1) and np.isclose(m.start.sum(), 1) and (m.emit > 0).all()


def test_rounds_gain_likelihood():
    rng = np.random.default_rng(7)
    classes = np.concatenate([rng.integers(1, 40, 60) + 40 * (i % 3) for i in range(90)])
    texts = hidden_markov.Chunks(classes, np.arange(0, len(classes) + 1, 60))
    base = np.bincount(classes, minlength=hidden_markov.CLASSES) + 0.5
    model, seen = hidden_markov.initial(base / base.sum(), 4, 2), []
    for _ in range(6):
        *counts, log = texts.expected(model)
        seen.append(log)
        model = hidden_markov.learned(tuple(counts), base / base.sum(), 0.0)
    assert seen[-1] > seen[0] and seen == sorted(seen)


def test_new_queries_over_whole_tables(spark):
    d = "/root/testdata/sf0.001"
    n, vectors = spark.read.parquet(f"{d}/documents.parquet").count(), spark.read.parquet(f"{d}/embeddings.parquet").count()
    found = queries.queries()
    assert found["op11_vector_codes"](spark, d).count() == vectors
    scored = found["op12_lm_scores"](spark, d)
    assert scored.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and scored.count() == n
    assert found["op13_periodic_runs"](spark, d).count() == n


def test_prediction_takes_little_memory(spark, monkeypatch):
    """A batch of 8 MB of texts is predicted slice by slice, alike whatever the slice."""
    import tracemalloc

    import pyarrow as pa

    examples = [langid.Example(x) for x in (b"der hund und die katze ", b"the dog and the cat ") for _ in range(10)]
    model = langid.train(examples, ["de"] * 10 + ["en"] * 10)
    found, empty = [], spark.createDataFrame([], "doc_id long, text string")
    monkeypatch.setattr(type(empty), "mapInArrow", lambda self, f, schema: found.append(f) or self)
    langid.predict(empty, model)
    texts = [("the dog and the cat " if i % 2 else "der hund und die katze ") * (1 + i % 200) for i in range(4000)] + ["", "7", None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    tracemalloc.start()
    out = next(found[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    monkeypatch.setattr(langid, "SLICE", 1 << 30)
    assert next(found[0](iter([batch]))).equals(out)
