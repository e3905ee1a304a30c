"""A hidden Markov language model: Baum-Welch over the partitions, exact likelihoods by the scaled forward recursion.

Words are emitted in two steps, so that what states learn has a fixed size
however large the vocabulary grows: a state emits a word class (a hash of the
word, and one class for the end of a text), the class emits the word by its
corpus count. Word counts are exact, over all training texts; they are joined
once. Rounds of Baum-Welch only need the classes: each is one pass that sums
expected counts of a task before Spark sums them over tasks.

    p(word | state) = E[state, class(word)] * (c + 0.5) / (N_class + 0.5 * V_class + 0.5)

c: the word's count, N_class and V_class: tokens and distinct words of the class.
Each class keeps room for one unknown word, so probabilities of a class sum to 1.

Recursions run over many texts at once, a word a step. Texts longer than CHUNK
are cut; each chunk first yields its matrix from states to states, by which the
chunks of a text are put together. So likelihoods are those of whole texts, and
no text, however long, holds up the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, from_binary, discard, materialize, ranges, ship, shuffles_cleared, text_bytes, tidy

#: Word classes, class 0 being the end of a text. A fixed size: states times CLASSES numbers are sent to tasks and gathered each round.
CLASSES = 1 << 16
#: Steps of a chunk, tokens that are worked on together, bytes of text of a block.
CHUNK, TOKENS, BLOCK = 1024, 1 << 20, 6 << 20
#: Slices of the training texts; each of the first rounds learns from one.
SLICES = 8
#: Tokens of a task of a round at least, where there are that many: a task returns numbers for all classes.
ROUND = 1 << 25


def class_of(word: bytes) -> int:
    return 1 + zlib.crc32(word) % (CLASSES - 1)


@dataclass(frozen=True)
class Model:
    """start: (states), move: (states, states), emit: (classes, states); all rows and columns of one state sum to 1."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def single(self) -> Model:
        """In single precision, which training does with."""
        return Model(*(np.ascontiguousarray(x, np.float32) for x in (self.start, self.move, self.emit)))


def initial(base: np.ndarray, states: int, seed: int, stay: float = 0.9, noise: float = 0.5) -> Model:
    """States that hardly change within a text, and emit classes by their frequency with some noise of their own."""
    rng = np.random.default_rng(seed)
    emit = base[:, None] * np.exp(noise * rng.normal(size=(len(base), states)))
    move = np.full((states, states), (1 - stay) / max(states - 1, 1))
    np.fill_diagonal(move, stay if states > 1 else 1.0)
    return Model(np.full(states, 1 / states), move, emit / emit.sum(0))


def learned(counts: tuple[np.ndarray, np.ndarray, np.ndarray], base: np.ndarray, discount: float) -> Model:
    """The model of expected counts (starts, moves, emissions).

    Emissions are smoothed by absolute discounting: up to ``discount`` of each
    count, and one token, are dealt out by the base frequencies.
    """
    starts, moves, emits = counts
    n = len(starts)
    move = moves + np.eye(n) + 1 / n
    off = np.minimum(emits, discount)
    emit = emits - off + (off.sum(0) + 1) * base[:, None]
    return Model((starts + 1) / (starts + 1).sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


class Chunks:
    """Texts (class numbers, the offset of each) cut into chunks, longest chunk first; a step works on the chunks that are not over."""

    def __init__(self, classes: np.ndarray, firsts: np.ndarray):
        n = np.diff(firsts)
        pieces = np.maximum(-(-n // CHUNK), 1)
        text = np.repeat(np.arange(len(n)), pieces)
        nth = ranges(np.zeros(len(n), np.int64), pieces)
        begin = firsts[:-1][text] + nth * CHUNK
        size = np.minimum(firsts[1:][text] - begin, CHUNK)
        self.order = np.argsort(-size, kind="stable")
        self.place = np.argsort(self.order)  # of a chunk, in the order of texts, its row
        self.begin, self.size, self.text = begin[self.order], size[self.order], text[self.order]
        self.classes, self.pieces = classes, pieces
        self.upto = np.concatenate([[0], np.cumsum(pieces)])
        self.active = [int(np.searchsorted(-self.size, -t, "left")) for t in range(int(size.max(initial=0)))]  # chunks longer than t

    def forward(self, m: Model, p: np.ndarray, rows: np.ndarray | None = None, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(state probabilities behind each chunk, log likelihood of each chunk) from those before it.

        ``p`` may have more axes between chunks and states. ``keep`` gets the
        probabilities before each token.
        """
        begin, size = (self.begin, self.size) if rows is None else (self.begin[rows], self.size[rows])
        p, total = p.copy(), np.zeros(p.shape[:-1])
        for t in range(int(size.max(initial=0))):
            k = int(np.searchsorted(-size, -t, "left"))
            at = begin[:k] + t
            if keep is not None:
                keep[at] = p[:k]
            e = m.emit[self.classes[at]]
            f = p[:k] * (e if p.ndim == 2 else e[:, None, :])
            z = f.sum(-1)
            total[:k] += np.log(z)
            p[:k] = (f / z[..., None]) @ m.move
        return p, total

    def entries(self, m: Model) -> tuple[np.ndarray, np.ndarray, list]:
        """(state probabilities before each chunk, log likelihood of each text so far, matrices of the chunks of long texts)."""
        s = len(m.start)
        p = np.tile(m.start, (len(self.begin), 1))
        logs = np.zeros(len(self.pieces))
        long = np.flatnonzero(self.pieces > 1)
        matrices = []
        if len(long):
            rows = np.sort(self.place[ranges(self.upto[long], self.pieces[long])])  # in order of size still
            unit = np.broadcast_to(np.eye(s, dtype=p.dtype), (len(rows), s, s))
            ends, scale = self.forward(m, unit, rows)
            where = np.full(len(self.begin), -1)
            where[rows] = np.arange(len(rows))
            for text in long.tolist():
                own = self.place[self.upto[text] : self.upto[text + 1]]
                now = m.start
                for r in own:
                    p[r] = now
                    w = where[r]
                    lift = scale[w].max()
                    matrix = np.exp(scale[w] - lift)[:, None] * ends[w]
                    now = now @ matrix
                    z = now.sum()
                    logs[text] += np.log(z) + lift
                    now = now / z
                    matrices.append((text, r, matrix))
        return p, logs, matrices

    def likelihoods(self, m: Model) -> np.ndarray:
        """Natural log likelihood of each text."""
        p, logs, _ = self.entries(m)
        short = np.flatnonzero(self.pieces[self.text] == 1)
        _, total = self.forward(m, p[short], short)
        logs[self.text[short]] = total
        return logs

    def expected(self, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions of all texts, and their log likelihood."""
        s, n = len(m.start), len(self.classes)
        p, logs, matrices = self.entries(m)
        before = np.zeros((n, s), p.dtype)
        _, total = self.forward(m, p, keep=before)
        ends = np.zeros(len(self.begin), bool)
        ends[self.place[self.upto[1:] - 1]] = True
        g = np.ones((len(self.begin), s), p.dtype)  # how well each state before the next token explains what follows
        for _, r, matrix in reversed(matrices):
            if not ends[r]:
                g[r] = ahead
            ahead = matrix @ g[r]
            ahead = ahead / ahead.max()
        moves, after = np.zeros((s, s)), np.zeros((n, s), p.dtype)
        for t in range(int(self.size.max(initial=0)) - 1, -1, -1):
            k = self.active[t]
            at = self.begin[:k] + t
            e = m.emit[self.classes[at]]
            own = e * (g[:k] @ m.move.T)
            d = (before[at] * own).sum(1)
            follows = ~(ends[:k] & (self.size[:k] == t + 1))
            f = before[at] * e / d[:, None]
            moves += f[follows].T @ g[:k][follows]
            after[at] = own * before[at] / d[:, None]
            g[:k] = own / own.max(1, keepdims=True)
        moves *= m.move
        firsts = self.begin[self.place[self.upto[:-1]]]
        starts = after[firsts].sum(0)
        emits = np.stack([np.bincount(self.classes, after[:, i], CLASSES) for i in range(s)], axis=1)
        return starts, moves, emits, float(total.sum())


def _blocks(docs: DataFrame, learn: str) -> DataFrame:
    """Texts in blocks of about BLOCK bytes: (block, ids, learns, slice, firsts, classes, local, words, kinds, counts).

    firsts: the first token of each text and the total; classes, local: of each
    token its class and its place among the block's words; words, kinds, counts:
    of each word of the block itself, its class and its tokens in training texts.
    The end of a text is the empty word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_blocks = 0
        ids, learns, slices, sizes, local, held = [], [], [], [], [], 0
        numbers: dict[bytes, int] = {b"": 0}

        def flush() -> pa.RecordBatch:
            nonlocal n_blocks, ids, learns, slices, sizes, local, held, numbers
            firsts = np.concatenate([[0], np.cumsum(sizes)])
            token = np.concatenate(local)
            kinds = np.fromiter((class_of(w) if w else 0 for w in numbers), np.uint16, len(numbers))
            counts = np.bincount(token, np.repeat(np.array(learns, float), sizes), len(numbers)).astype(np.int64)
            whole, narrow = np.array([0, len(token)]), token
            if len(numbers) < 1 << 24:  # three bytes a token, where they do
                narrow = token.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].ravel()
            lists = [pa.array([x], pa.list_(kind)) for x, kind in ((ids, pa.int64()), (learns, pa.bool_()), (slices, pa.int32()))]
            words = pa.array([list(numbers)], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
            block = (TaskContext.get().partitionId() << 32) + n_blocks
            out = pa.RecordBatch.from_arrays(
                [pa.array([block]), *lists, binary_column(firsts, np.array([0, len(firsts)])), binary_column(kinds[token], whole), binary_column(narrow, np.array([0, len(narrow)])), words, pa.array([kinds.astype(np.int32).tolist()], pa.list_(pa.int32())), pa.array([counts.tolist()], pa.list_(pa.int64()))],
                ["block", "ids", "learns", "slices", "firsts", "classes", "local", "words", "kinds", "counts"],
            )
            n_blocks += 1
            ids, learns, slices, sizes, local, held, numbers = [], [], [], [], [], 0, {b"": 0}
            return out

        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            raw = data.tobytes()
            for i, (key, does, part) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own = raw[offsets[i] : offsets[i + 1]].lower().split()  # bytes: A-Z alone are lowered, and six kinds of space part words
                own.append(b"")
                local.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in own), np.int32, len(own)))
                ids.append(key)
                learns.append(bool(does))
                slices.append(part)
                sizes.append(len(own))
                held += int(offsets[i + 1] - offsets[i]) + 16
                if held >= BLOCK:
                    yield flush()
        if ids:
            yield flush()

    part = F.pmod(F.xxhash64("text"), F.lit(SLICES)).cast("int")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.coalesce(F.expr(learn), F.lit(False)).alias("learn"), part.alias("slice"))
    form = "block long, ids array<long>, learns array<boolean>, slices array<int>, firsts binary, classes binary, local binary, words array<string>, kinds array<int>, counts array<long>"
    return rows.mapInArrow(run, form)


def _numbers(raw: pa.Buffer, n: int) -> np.ndarray:
    """``n`` numbers of three or four bytes each."""
    data = np.frombuffer(raw, np.uint8).reshape(n, -1)
    wide = np.zeros((n, 4), np.uint8)
    wide[:, : data.shape[1]] = data
    return wide.view("<i4").ravel()


def _texts(batch: pa.RecordBatch, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(firsts, classes, learns, slices) of a block."""
    firsts = np.frombuffer(batch.column("firsts")[row].as_buffer(), np.int64)
    classes = np.frombuffer(batch.column("classes")[row].as_buffer(), np.uint16)
    return firsts, classes, np.array(batch.column("learns")[row].as_py(), bool), np.array(batch.column("slices")[row].as_py())


def _grouped(texts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[Chunks]:
    """Chunks of about TOKENS tokens from (classes, sizes) of some texts at a time."""
    held, n = [], 0
    for classes, sizes in texts:
        held.append((classes, sizes))
        n += len(classes)
        if n >= TOKENS:
            yield Chunks(np.concatenate([x[0] for x in held]), np.concatenate([[0], np.cumsum(np.concatenate([x[1] for x in held]))]))
            held, n = [], 0
    if n:
        yield Chunks(np.concatenate([x[0] for x in held]), np.concatenate([[0], np.cumsum(np.concatenate([x[1] for x in held]))]))


def expected_counts(blocks: DataFrame, model: Model, part: int | None, tasks: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], float]:
    """Baum-Welch counts of the training texts, of one slice or of all, and their log likelihood."""
    s = len(model.start)
    told = blocks.sparkSession.sparkContext.broadcast(model)  # CLASSES * states doubles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chosen() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in batches:
                for row in range(batch.num_rows):
                    firsts, classes, learns, slices = _texts(batch, row)
                    use = np.flatnonzero(learns & (slices == part) if part is not None else learns)
                    sizes = np.diff(firsts)[use]
                    if len(use):
                        yield classes[ranges(firsts[use], sizes)], sizes

        now, sums = told.value.single(), [np.zeros(s), np.zeros((s, s)), np.zeros((CLASSES, s)), 0.0]
        for chunks in _grouped(chosen()):
            for i, x in enumerate(chunks.expected(now)):
                sums[i] = sums[i] + x
        some = np.flatnonzero(sums[2].any(1))
        if len(some):  # emissions by class, then starts, moves and the likelihood under numbers of their own
            extra = np.concatenate([sums[0][None], sums[1], np.full((1, s), sums[3] / s)])
            values = np.concatenate([sums[2][some], extra])
            keys = np.concatenate([some, CLASSES + np.arange(len(extra))])
            yield pa.RecordBatch.from_arrays([pa.array(keys), *(pa.array(values[:, i]) for i in range(s))], ["at", *(f"s{i}" for i in range(s))])

    form = "at long, " + ", ".join(f"s{i} double" for i in range(s))
    rows = blocks.select("firsts", "classes", "learns", "slices").coalesce(tasks).mapInArrow(run, form).groupBy("at").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(s))).toArrow()
    out = np.zeros((CLASSES + s + 2, s))
    if rows.num_rows:
        out[rows["at"].to_numpy()] = np.stack([rows[f"s{i}"].to_numpy() for i in range(s)], axis=1)
    told.destroy()
    return (out[CLASSES], out[CLASSES + 1 : CLASSES + 1 + s], out[:CLASSES]), float(out[-1].sum())


def train(blocks: DataFrame, tokens: int, base: np.ndarray, states: int, warm: int, rounds: int, discount: float, seed: int, tell: Callable[[float], None] | None = None) -> Model:
    """Baum-Welch: ``warm`` rounds of a slice of the training texts each, in turn, then ``rounds`` of all of them."""
    model, cores = initial(base, states, seed), blocks.sparkSession.sparkContext.defaultParallelism
    for r in range(warm + rounds):
        counts, log = expected_counts(blocks, model, r % SLICES if r < warm else None, max(cores, tokens // ROUND))
        model = learned(counts, base, discount)
        if tell:
            tell(log)
    return model


def score(docs: DataFrame, learn: str, states: int = 8, warm: int = 8, rounds: int = 1, discount: float = 0.75, seed: int = 5) -> DataFrame:
    """(doc_id, learns, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Texts for which the SQL condition ``learn`` (of doc_id) holds train the model. Tokens
    are words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, then one end a text.
    base_score: the sum of log10((c + 0.5) / (N + 0.5 * (V + 1))); score: log10 of
    the text's likelihood under the hidden Markov model. A null text is empty: the end
    alone. Rows with null or repeated ids are rows like others, and a null condition does not
    learn. Texts of any length are read and scored whole. Without training texts nothing is
    known and all states emit the same; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    with tidy() as keep, shuffles_cleared(docs.sparkSession):
        return _score(docs, learn, states, warm, rounds, discount, seed, keep)


def _score(docs, learn, states, warm, rounds, discount, seed, keep) -> DataFrame:
    spark = docs.sparkSession
    blocks = materialize(_blocks(docs, learn), "lm-blocks")
    listed = blocks.select("block", F.posexplode(F.arrays_zip("words", "kinds", "counts")).alias("j", "w")).select("block", "j", "w.words", "w.kinds", "w.counts")
    known = materialize(listed.where("counts > 0").groupBy("words").agg(F.sum("counts").alias("c"), F.min("kinds").alias("kinds")), "lm-words")
    by_class = known.groupBy("kinds").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toArrow()  # CLASSES rows at most
    tokens, distinct = np.zeros(CLASSES), np.zeros(CLASSES)
    at = by_class["kinds"].to_numpy()
    tokens[at], distinct[at] = by_class["c"].to_numpy(), by_class["v"].to_numpy()
    room = tokens + 0.5 * distinct + 0.5
    n, v = int(tokens.sum()), int(distinct.sum())
    model = train(blocks, n, room / room.sum(), states, warm, rounds, discount, seed)
    told = spark.sparkContext.broadcast((model, room))

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        """Base scores of a block's texts from its words' counts, and likelihoods."""
        model, room = told.value
        counts = np.zeros(0, np.int64)
        if right.num_rows:
            counts = np.zeros(int(right["j"].to_numpy().max()) + 1, np.int64)
            counts[right["j"].to_numpy()] = right["c"].to_numpy()
        out = []
        for batch in left.to_batches():
            for row in range(batch.num_rows):
                firsts = np.frombuffer(batch.column("firsts")[row].as_buffer(), np.int64)
                learns = np.array(batch.column("learns")[row].as_py(), bool)
                token = _numbers(batch.column("local")[row].as_buffer(), int(firsts[-1]))
                kinds = batch.column("kinds")[row].values.to_numpy(zero_copy_only=False)
                classes, c = kinds[token].astype(np.uint16), np.zeros(len(kinds), np.int64)
                c[: len(counts)] = counts
                c = c[token]
                base = np.add.reduceat(np.log10((c + 0.5) / (n + 0.5 * (v + 1))), firsts[:-1])
                within = np.add.reduceat(np.log10((c + 0.5) / room[classes]), firsts[:-1])
                logs = np.zeros(len(firsts) - 1)
                a = 0
                while a < len(logs):
                    b = max(a + 1, int(np.searchsorted(firsts, firsts[a] + TOKENS, "right")) - 1)
                    logs[a:b] = Chunks(classes[firsts[a] : firsts[b]], firsts[a : b + 1] - firsts[a]).likelihoods(model)
                    a = b
                some = np.add.reduceat((c > 0).astype(np.int64), firsts[:-1])
                out.append(pa.table({"doc_id": batch.column("ids")[row].values, "learns": pa.array(learns), "n_tokens": np.diff(firsts), "n_known": some, "base_score": base, "score": logs / np.log(10) + within}))
        return pa.concat_tables(out) if out else pa.table({k: [] for k in ("doc_id", "learns", "n_tokens", "n_known", "base_score", "score")})

    counted = materialize(listed.select("block", "j", "words").join(known.select("words", "c"), "words").select(F.col("block").alias("of"), "j", "c"), "lm-counted")
    discard(known)
    form = "doc_id long, learns boolean, n_tokens long, n_known long, base_score double, score double"
    pairs = blocks.select("block", "ids", "learns", "firsts", "kinds", "local").groupBy("block").cogroup(counted.groupBy("of"))
    scored = keep(materialize(pairs.applyInArrow(finish, form), "lm-scores"))
    return scored.select("doc_id", "learns", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
