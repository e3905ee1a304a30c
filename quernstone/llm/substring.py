"""Substring deduplication on words by seed and extend: joined on winnowed anchors, extended both ways word by word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SHINGLE_MIX, binary_column, gather, longs, mix64, ranges, ship, slices, text_bytes, window_hashes, word_hashes, words
from .seeds import anchors, covered, gathered, group_starts, keyed, list_column, marked, nullable, own_spans, place_route, place_runs, repeated_anchors, sizes_of, span_column

SLICE = 2 << 20
#: Bytes of stretches that a task holds before it combines and sends them on.
HELD_BYTES = 16 << 20
SPANS = T.ArrayType(T.StructType().add("start", "long").add("n", "long"))
FORM = "route long, row long, doc_id long, start long, before int, n int, stretch binary"


def _sequences(data: np.ndarray, offsets: np.ndarray, k: int, span: int):
    """Words of a slice, their hashes and its anchors."""
    starts, ends, firsts = words(data, offsets)
    h = word_hashes(data, starts, ends)
    grams = window_hashes(h, k)
    return (starts, ends, firsts), h, grams, anchors(grams, firsts, k, span)


def plain_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """All words, each with one space behind it, and where each begins (and the end)."""
    size = ends - starts
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(int(begin[-1]), 32, np.uint8)
    out[ranges(begin[:-1], size)] = data[ranges(starts, size)]
    return out.tobytes(), begin


def _refined(classes: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Numbers of the distinct pairs (classes[i], by[i])."""
    return np.unique(classes * (int(by.max(initial=0)) + 1) + by, return_inverse=True)[1]


def extended(stretches: pa.Array, route: np.ndarray, before: np.ndarray, place: np.ndarray, k: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(item, words before its anchor) of every window of ``span`` words that an item with a smaller place has too.

    Items are stretches of words that hold one anchor each, ``before`` words
    from their start; those of one route may match. All are extended together:
    one more word to the right, or to the left, parts the items whose words
    differ. A window is a match if its words left of the anchor and from the
    anchor on are. So a frequent anchor costs its items times the span, and no
    pairs are formed. Items come in the order of their places.
    """
    data, offsets = text_bytes(stretches)
    ends = np.flatnonzero(data == 32) + 1
    upto = np.concatenate([[0], ends])
    first = np.searchsorted(ends, offsets, "right")  # each item's first word, and the total
    spelled = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(upto.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
    word = spelled.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    anchor = first[:-1] + before
    right = first[1:] - anchor  # words from the anchor on

    def widen(classes: np.ndarray, live: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.full(len(classes), -1)
        out[live] = _refined(classes[live], word[at[live]])
        return out

    ahead = {0: np.unique(route, return_inverse=True)[1]}
    for m in range(1, span + 1):
        ahead[m] = widen(ahead[m - 1], np.flatnonzero(right >= m), anchor + m - 1)
        if m - 1 < k:
            del ahead[m - 1]
    behind = np.zeros(len(route), np.int64)
    items, offs = [], []
    for j in range(span - k + 1):
        if j:
            behind = widen(behind, np.flatnonzero(before >= j), anchor - j)
        live = np.flatnonzero((before >= j) & (right >= span - j))
        if len(live) < 2:
            continue
        both = behind[live] * len(route) + ahead[span - j][live]
        order = np.argsort(both, kind="stable")
        starts = group_starts(both[order])
        order = live[order]
        head = np.repeat(order[starts], sizes_of(starts, len(order)))
        late = order[place[order] != place[head]]
        items.append(late)
        offs.append(np.full(len(late), j))
    return (np.concatenate(items), np.concatenate(offs)) if items else (np.zeros(0, np.int64),) * 2


def _places(key: np.ndarray, doc: np.ndarray, nul: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, number): items by (id, nulls last, row, start), and a number for each distinct place, in that order."""
    order = np.lexsort((start, key, doc, nul))
    fresh = np.ones(len(order), bool)
    for x in (key, doc, nul, start):
        fresh[1:] &= x[order][1:] == x[order][:-1]
    fresh[1:] = ~fresh[1:]
    number = np.zeros(len(order), np.int64)
    number[order] = np.cumsum(fresh)
    return order, number


def remove_repeats(docs: DataFrame, span: int = 20, k: int = 5, carry: list[str] | None = None) -> DataFrame:
    """Remove repeated passages of ``span`` words or more, all but where they stand first.

    Returns doc_id, text, n_words, n_removed, kept_text (the kept words joined
    by one space), spans (removed runs of words: start, n, width in windows) and
    carried (the columns that ``carry`` names). A word goes if a window of
    ``span`` words covers it that also starts earlier: in a smaller doc_id, or in
    the same row further left. Windows are judged on the input.

    Rows are joined on winnowed anchors that occur more than once. Each brings
    the stretch of words whose windows the anchor stands for; matches are
    extended from the anchor both ways, comparing words, and the runs of
    neighbouring anchors join into maximal repeats. Copies of one stretch within a
    task are settled there. A hot anchor (see seeds) is split: each of its
    windows goes by its own content, so that the edges of a passage which stands
    in very many texts, each time between other words, are spread.

    Null texts have no words. Null ids count as the largest; rows of one id and
    different texts stand in the order of a hash of their texts. Rows of one id
    and one text count as the same place, so they don't remove each other. An
    empty table gives none.
    """
    ship(docs.sparkSession)
    dealt = keyed(docs, carry)

    def find(data: np.ndarray, offsets: np.ndarray):
        (_, _, firsts), _, grams, (row, at, _, _) = _sequences(data, offsets, k, span)
        return row, grams[at], at - firsts[row]

    def batch_of(open_: tuple, gone: tuple) -> pa.RecordBatch:
        route, key, doc, start, before, stretch = open_
        gone_key, gone_doc, gone_start, gone_n = gone
        m, n = len(route), len(gone_key)
        columns = [
            pa.array(np.concatenate([route, place_route(gone_key, gone_start)])), pa.array(np.concatenate([key, gone_key])), pa.concat_arrays([doc, gone_doc]), pa.array(np.concatenate([start, gone_start])),
            pa.array(np.concatenate([before, np.full(n, -1)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(m, np.int64), gone_n]).astype(np.int32)), pa.concat_arrays([stretch, pa.nulls(n, pa.binary())]),
        ]
        return pa.RecordBatch.from_arrays(columns, ["route", "row", "doc_id", "start", "before", "n", "stretch"])

    def emit(held: list) -> pa.RecordBatch:
        route, key, doc, nul, start, before, n = (np.concatenate([h[i] for h in held]) for i in range(7))
        stretch = [x for h in held for x in h[7]]
        seen: dict[tuple, int] = {}
        code = np.fromiter((seen.setdefault(x, len(seen)) for x in zip(route.tolist(), before.tolist(), stretch, strict=True)), np.int64, len(stretch))
        order, place = _places(key, doc, nul, start)
        order = order[np.argsort(code[order], kind="stable")]
        starts = group_starts(code[order])
        one = order[starts]
        head = np.repeat(one, sizes_of(starts, len(order)))
        late = order[place[order] != place[head]]
        gone = place_runs(key, doc, nul, start, late, start[late], n[late])
        return batch_of((route[one], key[one], pa.array(doc[one], mask=nul[one]), start[one], before[one], pa.array([stretch[i] for i in one.tolist()], pa.binary())), gone)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys = longs(batch, "row")
            docs_, nulls = nullable(batch.column(1))
            data, offsets = text_bytes(batch.column(2))
            places, upto = list_column(batch.column("places"))
            for a, b in slices(offsets, SLICE):
                part = data[offsets[a] : offsets[b]]
                (starts, ends, firsts), h, grams, (row, at, first, count) = _sequences(part, offsets[a : b + 1] - offsets[a], k, span)
                seed = marked(places, upto, firsts, a, b)[at] if len(at) else np.zeros(0, np.int8)
                if not seed.any():
                    continue
                plain, begin = plain_words(part, starts, ends)
                cold, hot = np.flatnonzero(seed == 1), np.flatnonzero(seed == 2)
                of = np.concatenate([cold, np.repeat(hot, count[hot])])
                begins = np.concatenate([first[cold], ranges(first[hot], count[hot])])
                n = np.concatenate([count[cold], np.ones(len(of) - len(cold), np.int64)])
                own = mix64(window_hashes(h, span)[begins[len(cold) :]] ^ SHINGLE_MIX[59])
                stretch = [plain[p:q] for p, q in zip(begin[begins].tolist(), begin[begins + n + span - 1].tolist(), strict=True)]
                whose = a + row[of]
                held.append((np.concatenate([grams[at[cold]], own]).view(np.int64), keys[whose], docs_[whose], nulls[whose], begins - firsts[row[of]], at[of] - begins, n, stretch))
                size += sum(map(len, stretch))
                if size >= HELD_BYTES:
                    yield emit(held)
                    held, size = [], 0
        if held:
            yield emit(held)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = gather(batches)
        if found is None:
            return
        key, start, before, n = (longs(found, c) for c in ("row", "start", "before", "n"))
        doc, nul = nullable(found["doc_id"])
        known, open_ = np.flatnonzero(before < 0), np.flatnonzero(before >= 0)
        route = longs(found, "route")
        by = np.argsort(route[open_])
        sizes = sizes_of(group_starts(route[open_][by]), len(by))
        open_ = open_[by[np.repeat(sizes > 1, sizes)]]
        late, left = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(open_):
            order, place = _places(key[open_], doc[open_], nul[open_], start[open_] + before[open_])
            open_ = open_[order]
            late, left = extended(found["stretch"].take(pa.array(open_)).combine_chunks(), route[open_], before[open_], place[order], k, span)
            late = open_[late]
        gone = place_runs(key, doc, nul, start, late, start[late] + before[late] - left)
        rest = key[known], pa.array(doc[known], mask=nul[known]), start[known], n[known]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([gone[0], rest[0]])), pa.concat_arrays([gone[1], rest[1]]), *(pa.array(np.concatenate([gone[i], rest[i]])) for i in (2, 3))], ["row", "doc_id", "start", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            spans = own_spans(batch)
            for a, b in slices(offsets, SLICE):
                part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                starts, ends, firsts = words(part, cuts)
                gone = covered(spans, firsts, span, a, b)
                kept = np.flatnonzero(~gone)
                row = np.searchsorted(firsts, kept, "right") - 1
                mark = np.zeros(len(part) + 1, np.int8)
                mark[starts[kept]] += 1
                mark[ends[kept]] -= 1
                keep = np.cumsum(mark[:-1], dtype=np.int8) > 0
                out = part.copy()
                if len(kept):
                    gaps = ends[kept[:-1][row[1:] == row[:-1]]]
                    keep[gaps], out[gaps] = True, 32
                upto = np.concatenate([[0], np.cumsum(keep)])[cuts]
                text = binary_column(out[keep], upto).cast(pa.string())
                lost = np.concatenate([[0], np.cumsum(gone)])[firsts]
                same = [batch.column(c).slice(a, b - a) for c in ("doc_id", "text", *(["carried"] if carry else []))]
                yield pa.RecordBatch.from_arrays([*same[:2], pa.array(np.diff(firsts)), pa.array(np.diff(lost)), text, span_column(spans, a, b), *same[2:]], form.names)

    places = repeated_anchors(dealt, find, SLICE).hint("shuffle_hash")
    stretches = dealt.join(places, "row", "left").mapInArrow(extend, FORM)
    gone = stretches.repartition("route").mapInArrow(decide, "row long, doc_id long, start long, n long")
    form = dealt.select("doc_id", "text").schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string").add("spans", SPANS)
    if carry:
        form = form.add(dealt.schema["carried"])
    return dealt.join(gathered(gone), "row", "left").mapInArrow(cut, form)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = """
WITH w AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS words FROM documents
), windows AS (
  SELECT doc_id, i AS start, array_to_string(list_slice(words, i, i + 19), ' ') AS content
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 18, 1))) AS i FROM w)
), late AS (
  SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY content ORDER BY doc_id, start) AS nth FROM windows) WHERE nth > 1
), gone AS (
  SELECT DISTINCT doc_id, start + o AS pos FROM late, (SELECT unnest(range(0, 20)) AS o)
), lost AS (
  SELECT doc_id, list(pos) AS places, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(l.n, 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN l.n IS NULL THEN w.words ELSE list_transform(list_filter(list_zip(w.words, range(1, len(w.words) + 1)), lambda x: NOT list_contains(l.places, x[2])), lambda x: x[1]) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN lost l USING (doc_id)
"""
