"""Language identification: averaged hashed subword embeddings under a linear softmax.

Trained by stochastic gradient descent in numpy on a bounded sample of labelled
rows, whole texts each; scores are calibrated by a temperature on a part of that
sample which the training does not see, and the same part sets the scores under
which short texts and others are rejected.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BYTE_MIX, LOWER, SHINGLE_MIX, mix64, ship, slices, text_bytes

U = np.uint64
ORDERS = (2, 3, 4)
LETTER = regex.compile(r"\p{L}")
#: Bytes as subwords see them: lower case, and whatever is no letter is a word end.
PLAIN = LOWER.copy()
PLAIN[:65] = 32
PLAIN[91:97] = 32
PLAIN[123:128] = 32


BUCKETS = 1 << 15
#: Bytes under which a text is short, and counts as a stretch does.
SHORT = 400
#: Places in a text, by a hash of it, from which short stretches for training are taken.
PIECES = 8
BLOCK = 1 << 20
#: Bytes of texts that are predicted at once: their subwords take about a hundred bytes each.
SLICE = 1 << 18


@dataclass
class Model:
    labels: list[str]
    table: np.ndarray  # bucket -> a logit per label: the embedding times the softmax weights
    bias: np.ndarray
    temperature: float
    threshold: float  # for texts of SHORT bytes or more
    short_threshold: float


def subwords(data: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """The bucket of the ``order`` bytes that start at each byte of ``data``."""
    plain = PLAIN[data]
    h = np.zeros(max(0, len(data) - order + 1), np.uint64)
    for k in range(order):
        h += BYTE_MIX[plain[k : k + len(h)]] * SHINGLE_MIX[8 * order + k]
    return (mix64(h) >> U(40)).astype(np.int64) % buckets


def features(text: bytes, buckets: int) -> np.ndarray:
    data = np.frombuffer(b" " + text + b" ", np.uint8)
    return np.concatenate([subwords(data, n, buckets) for n in ORDERS])


def counted(text: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of a text's subwords, how often each occurs)."""
    if len(text) < BLOCK:
        return np.unique(features(text, buckets), return_counts=True)
    data, total = np.frombuffer(b" " + text + b" ", np.uint8), np.zeros(buckets, np.int64)
    for order in ORDERS:
        for a in range(0, len(data), BLOCK):
            total += np.bincount(subwords(data[a : a + BLOCK + order - 1], order, buckets), minlength=buckets)
    at = np.flatnonzero(total)
    return at, total[at]


def pieces_of(text: bytes) -> list[bytes]:
    """PIECES stretches of SHORT bytes from hashed places of a text of any length; all of it if it is no longer."""
    if len(text) <= SHORT:
        return [text]
    places = np.random.default_rng(zlib.crc32(text)).integers(0, len(text) - SHORT + 1, PIECES)
    return [text[p : p + SHORT] for p in places.tolist()]


@dataclass
class Example:
    """A whole text to learn from, as itself or, where that is smaller, as its counted subwords; and its pieces. Either way it teaches the same."""

    text: bytes | None
    counts: tuple[np.ndarray, np.ndarray] | None = None
    pieces: list[bytes] = field(default_factory=list)

    def __post_init__(self):
        if not self.pieces:
            self.pieces = pieces_of(self.text)

    def whole(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        return counted(self.text, buckets) if self.counts is None else self.counts

    def is_short(self) -> bool:
        return self.counts is None and len(self.text) < SHORT

    def stretch(self, rng: np.random.Generator) -> bytes:
        text = self.pieces[int(rng.integers(len(self.pieces)))]
        if len(text) <= 40:
            return text
        size = int(rng.integers(20, min(len(text), SHORT)))
        at = int(rng.integers(0, len(text) - size + 1))
        return text[at : at + size]


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def low_score(scores: np.ndarray, quantile: float) -> float:
    """The score that right answers fall below with chance ``quantile``, from their ``scores`` alone.

    That is their own quantile; but a rare one lies under the least of few
    scores. So the lowest tenth (ten at least) sets the scale of an exponential
    tail of the log odds, with one more unit, the tail of a logistic, where there
    are few. The lower of the two counts.
    """
    p = np.clip(np.asarray(scores, np.float64), 1e-9, 1 - 1e-9)
    odds = np.sort(np.log(p / (1 - p)))
    k = min(len(odds), max(10, -(-len(odds) // 10)))
    scale = (1 + (odds[k - 1] - odds[:k]).sum()) / (k + 1)
    tail = odds[k - 1] - scale * np.log(k / (len(odds) * quantile))
    return float(1 / (1 + np.exp(-min(tail, np.quantile(odds, quantile)))))


def train(examples: list[Example], langs: list[str], dim: int = 16, buckets: int = BUCKETS, epochs: int = 4, rate: float = 0.4, quantile: float = 0.001, seed: int = 7) -> Model:
    """Fit on four fifths of the sample, calibrate on the rest.

    Each step takes one document, or as often a short stretch of it, so that
    short texts are scored as soberly as long ones; calibration takes both of
    each. A text is rejected if its score is under the ``quantile`` of right
    calibration answers, see ``low_score``; short texts have a score of their
    own, from stretches and short documents.
    """
    labels = sorted(set(langs))
    if not labels:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0), 1.0, 0.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.searchsorted(labels, langs)
    emb = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    out, bias = np.zeros((dim, len(labels)), np.float32), np.zeros(len(labels), np.float32)
    order = rng.permutation(len(examples))
    held, used = order[: len(order) // 5], order[len(order) // 5 :]
    steps, done = max(1, epochs * len(used)), 0
    for _ in range(epochs):
        for i in rng.permutation(used):
            at, n = counted(examples[i].stretch(rng), buckets) if rng.random() < 0.5 else examples[i].whole(buckets)
            share = (n / n.sum()).astype(np.float32)
            v = share @ emb[at]
            p = softmax(v @ out + bias)
            p[y[i]] -= 1
            step = rate * (1 - done / steps)
            back = out @ p
            out -= step * np.outer(v, p)
            bias -= step * p
            emb[at] -= (step * len(at) ** 0.5) * np.outer(share, back)
            done += 1
    table = (emb @ out).astype(np.float32)
    parts = [examples[i].whole(buckets) for i in held] + [counted(examples[i].stretch(rng), buckets) for i in held]
    logits = np.array([n @ table[at] / n.sum() + bias for at, n in parts]).reshape(-1, len(labels))
    right = np.tile(y[held], 2)
    brief = np.array([examples[i].is_short() for i in held] + [True] * len(held), bool)
    temperature, thresholds = 1.0, [0.0, 0.0]
    if len(held):
        grid = np.geomspace(1, 10, 21)  # scores may be softened, never sharpened
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(right)), right], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
        p = softmax(logits / temperature)
        good = p.argmax(axis=1) == right
        for i, of in enumerate((good & ~brief, good & brief)):
            mine = p.max(axis=1)[of if of.any() else good]
            thresholds[i] = low_score(mine, quantile) if len(mine) else 0.0
    return Model(labels, table, bias, temperature, *thresholds)


def condensed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole texts as ``Example`` holds them: a text that is larger than its counts can be sends these instead."""
    for batch in batches:
        for i in range(batch.num_rows):
            text, at, n, pieces = batch.column(2)[i].as_py().encode(), None, None, None
            if len(text) > 6 * BUCKETS:
                at, n = counted(text, BUCKETS)
                at, n = at.astype("<u2").tobytes(), n.astype("<u4").tobytes()
                text, pieces = None, pieces_of(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([text], pa.binary()), pa.array([at], pa.binary()), pa.array([n], pa.binary()), pa.array([pieces], pa.list_(pa.binary()))],
                ["doc_id", "lang", "text", "at", "n", "pieces"],
            )


def sample(labelled: DataFrame, per_label: int, seed: int) -> tuple[list[Example], list[str]]:
    """About ``per_label`` rows of each label, by a hash of the id; whole texts, of 200 kB a row at most, see ``condensed``."""
    ship(labelled.sparkSession)
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, per_label / n)))])
    draw = F.expr(f"pmod(xxhash64(doc_id, {seed}), 1000003) / 1000003.0D")
    drawn = labelled.where(draw < F.element_at(share, F.col("lang"))).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    rows = drawn.mapInArrow(condensed, "doc_id long, lang string, text binary, at binary, n binary, pieces array<binary>").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["at"] or b"") if r["text"] is None else bytes(r["text"]), r["lang"]))
    found = [
        Example(bytes(r["text"])) if r["text"] is not None else Example(None, (np.frombuffer(r["at"], "<u2").astype(np.int64), np.frombuffer(r["n"], "<u4").astype(np.int64)), list(map(bytes, r["pieces"])))
        for r in rows
    ]
    return found, [r["lang"] for r in rows]


def fit(docs: DataFrame, per_label: int = 1500, seed: int = 7) -> Model:
    """Learn from rows with text, lang and an id whose crc32 modulo 4 is not 2 (others are held out).

    About ``per_label`` documents of each label come to the driver, by a hash of
    the id; repeated rows are drawn together. Each is learned from whole: a text
    comes itself, or as the counts of its subwords if these are smaller. Without
    a labelled row nothing is learned.
    """
    labelled = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & ~held_out())
    return train(*sample(labelled, per_label, seed), seed=seed)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of ``docs`` with lang_pred, score and rejected instead of columns of these names.

    Reads the text alone, whole. Null texts, texts without a letter, and all
    texts if nothing could be learned get ``und``, score 0, and are rejected.
    Rows with a null id and repeated rows are predicted like others; an empty table gives none.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # buckets x labels numbers, whatever the corpus
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            column = batch.column(at)
            data, offsets = text_bytes(column)
            found, score = np.full(len(column), -1), np.zeros(len(column))
            ascii_letter = (PLAIN != 32) & (np.arange(256) < 128)
            for a, b in slices(offsets, SLICE):
                part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                letters = np.diff(np.concatenate([[0], np.cumsum(ascii_letter[part])])[cuts]) > 0
                for i in np.flatnonzero(~letters):
                    letters[i] = bool(LETTER.search(column[int(a + i)].as_py() or ""))
                if not m.labels:
                    continue
                framed = np.full(len(part) + 2 * (b - a), 32, np.uint8)  # a word end before and after each text
                begin = cuts[:-1] + 2 * np.arange(b - a)
                inner = np.ones(len(framed), bool)
                inner[begin] = False
                inner[cuts[1:] + 2 * np.arange(b - a) + 1] = False
                framed[inner] = part
                size = np.diff(cuts) + 2
                logits, n = np.zeros((b - a, len(m.labels))), np.zeros(b - a)
                for order in ORDERS:
                    each = np.zeros((len(framed), len(m.labels)), np.float32)
                    at_ = subwords(framed, order, len(m.table))
                    each[: len(at_)] = m.table[at_]
                    for k in range(1, order):  # subwords that would run on into the next text
                        last = begin + size - k
                        each[last[last >= 0]] = 0
                    logits += np.add.reduceat(each, begin, axis=0, dtype=np.float64)
                    n += np.maximum(size - order + 1, 0)
                p = softmax((logits / np.maximum(n, 1)[:, None] + m.bias) / m.temperature)
                found[a:b] = np.where(letters, p.argmax(axis=1), -1)
                score[a:b] = np.where(letters, p.max(axis=1), 0.0)
            least = np.where(np.diff(offsets) < SHORT, m.short_threshold, m.threshold)
            names = pa.array([*m.labels, "und"], pa.string()).take(pa.array(np.where(found < 0, len(m.labels), found)))
            yield pa.RecordBatch.from_arrays([*batch.columns, names, pa.array(score), pa.array((found < 0) | (score < least))], [*kept, "lang_pred", "score", "rejected"])

    fields = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.select(*kept).mapInArrow(run, fields)
