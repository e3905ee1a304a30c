"""Token ids and token counts of whole texts with a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import ship, slices, text_bytes

#: The pre-token pattern of byte-level BPE vocabularies of this family (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def special_tokens(model: str) -> dict[str, int]:
    """The special strings that the library finds inside texts by default, and their ids.

    Only models that cut text by PATTERN, as it is, and find special strings
    literally can be counted here; others are an error.
    """
    with open(model, encoding="utf-8") as f:
        told = json.load(f)
    cut = told.get("pre_tokenizer") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and told.get("normalizer") is None
    odd = [t["content"] for t in told["added_tokens"] if any(t.get(k) for k in ("single_word", "lstrip", "rstrip", "normalized"))]
    if not plain or odd:
        raise ValueError(f"unsupported settings in {model}: {odd or [cut, told.get('normalizer')]}")
    return {t["content"]: t["id"] for t in told["added_tokens"]}


@functools.lru_cache(maxsize=4)
def encoder(ranks: str, model: str) -> tiktoken.Encoding:
    """The vocabulary as ranks, with the special strings of the .json model; ids are the .json model's."""
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens=special_tokens(model))


def whole_tokens(model: str) -> frozenset[str]:
    """The vocabulary strings proven to encode, alone, as exactly their own token.

    The proof is one run of the library over its own vocabulary, on the driver,
    once per call of the operator; only strings that pass may take the shortcut.
    """
    tokenizer = Tokenizer.from_file(model)
    special = special_tokens(model)
    size = tokenizer.get_vocab_size()
    strings = [(tokenizer.decode([i], skip_special_tokens=False), i) for i in range(size)]
    strings = [(s, i) for s, i in strings if s and s not in special and "�" not in s]
    found = tokenizer.encode_batch([s for s, _ in strings], add_special_tokens=False)
    return frozenset(s for (s, i), e in zip(strings, found, strict=True) if e.ids == [i])


class PieceCounts(dict):
    """Tokens of a pre-token: 1 at once for proven whole tokens, merged and kept for the rest."""

    def __init__(self, proven: frozenset[str], bpe: tiktoken.Encoding, room: int):
        super().__init__(dict.fromkeys(proven, 1))
        self.proven, self.bpe, self.room = proven, bpe, room + len(proven)

    def __missing__(self, piece: str) -> int:
        if len(self) >= self.room:
            self.clear()
            self.update(dict.fromkeys(self.proven, 1))
        n = len(self.bpe._encode_single_piece(piece))  # merges alone: the library's own pattern overflows on very long white space
        if len(piece) <= 64:
            self[piece] = n
        return n


#: White space so long that the library's pattern, which steps back through it, may overflow.
LONG_BLANK = regex.compile(r"\s{4096}")


def token_ids(text: str, bpe: tiktoken.Encoding, split: regex.Pattern, special: regex.Pattern | None) -> np.ndarray:
    """The ids of a text, special strings as their own; texts with very long white space are cut here and merged piece by piece."""
    if len(text) < 4096 or not LONG_BLANK.search(text):
        return bpe.encode_to_numpy(text, allowed_special="all")
    ids: list[int] = []
    for i, part in enumerate(special.split(text) if special else [text]):
        if i % 2:
            ids.append(bpe.encode_single_token(part))
        else:
            for piece in split.findall(part):
                ids += bpe._encode_single_piece(piece)
    return np.array(ids, np.uint32)


def special_pattern(special: dict[str, int]) -> regex.Pattern | None:
    """Finds the special strings, longer ones first, as a group."""
    return regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None


_KEPT: dict = {}


def count_tokens(docs: DataFrame, model: str, ranks: str, limit: int = 1024, room: int = 200_000, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Whole-token shortcut: pre-tokens proven to be one token are counted by a
    lookup; only others are merged, and the counts of ``room`` recent ones are
    kept per worker. A null text counts as empty (0 bytes, 0 tokens). Null ids,
    repeated rows and extra columns are harmless: one row out for each row in,
    and none for an empty table. Very long texts are counted whole, long runs of
    white space among them.
    """
    spark = docs.sparkSession
    ship(spark)
    proven = spark.sparkContext.broadcast(whole_tokens(model))  # as large as the vocabulary
    special = special_tokens(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (model, ranks, room)
        if key not in _KEPT:
            _KEPT.clear()
            _KEPT[key] = PieceCounts(proven.value, encoder(ranks, model), room)
        counts, split = _KEPT[key], regex.compile(PATTERN).findall
        cut, of = special_pattern(special), counts.__getitem__
        for batch in batches:
            texts = batch.column(1)
            _, offsets = text_bytes(texts)
            n = np.zeros(len(texts), np.int64)
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                if any(x in text for x in special):
                    parts = cut.split(text)  # every other one is a special string
                    n[i] = sum(sum(map(of, split(p))) for p in parts[::2]) + len(parts) // 2
                else:
                    n[i] = sum(map(of, split(text)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_column].dataType.simpleString()
    found = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return found.withColumnRenamed("id", id_column)


def token_pieces(docs: DataFrame, model: str, ranks: str, window: int = 1024, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's ids and ``end_id``, cut into full windows and a rest.

    Rows: id, start, length, ids_crc32 (of little-endian unsigned 32-bit ids),
    doc_tokens. A null text is empty: one piece with the end id alone. Null ids
    and repeated rows are cut like others; an empty table gives none. Very long
    texts are encoded whole, long runs of white space among them.
    """
    import zlib

    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, split, special = encoder(ranks, model), regex.compile(PATTERN), special_pattern(special_tokens(model))
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets):
                rows, start, length, crc, total = [], [], [], [], []
                for i in range(a, b):
                    ids = np.append(token_ids(batch.column(1)[i].as_py() or "", bpe, split, special), end_id).astype("<u4")
                    for at in range(0, len(ids), window):
                        piece = ids[at : at + window]
                        rows.append(i)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                        total.append(len(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(x, pa.int64()) for x in (start, length, crc, total)], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_column].dataType.simpleString()
    found = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    return found.withColumnRenamed("id", id_column)
