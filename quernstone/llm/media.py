"""Texts as lossless audio: a FLAC encoder and decoder in numpy that work on many streams at once.

Streams are mono, 8 bits a sample, in blocks of up to 4096 samples. The decoder
reads Rice residuals of all frames of a batch in step, one sample of each frame
per step, runs the linear predictors, and checks the CRC-8 of every frame
header, the CRC-16 of every frame and the MD5 of every stream.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, ranges, ship, slices, text_bytes

BLOCK, RATE, BITS, UNIT = 4096, 8000, 8, 64
#: Samples that are encoded at a time.
RUN = 1 << 21
#: The encoder tries fixed predictors of orders 0 to TRIED - 1; the decoder knows all.
TRIED = 3
#: Fixed values of the format: weights of the fixed predictors of orders 0 to 4.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(width: int, poly: int) -> np.ndarray:
    """One byte's step of a CRC, most significant bit first."""
    c = np.arange(256, dtype=np.int64) << (width - 8)
    for _ in range(8):
        c = np.where(c >> (width - 1) & 1, (c << 1) ^ poly, c << 1) & ((1 << width) - 1)
    return c


CRC8, CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def crc_many(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """The CRC of each stretch of ``data``; all stretches advance together."""
    table, out = (CRC8, 8) if width == 8 else (CRC16, 16), np.zeros(len(starts), np.int64)
    table = table[0]
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    state = np.zeros(len(starts), np.int64)
    live = np.searchsorted(-left, -np.arange(1, (int(left[0]) if len(left) else 0) + 1), "right")
    for step, n in enumerate(live.tolist()):
        byte = data[at[:n] + step]
        if width == 8:
            state[:n] = table[state[:n] ^ byte]
        else:
            state[:n] = ((state[:n] << 8) & 0xFFFF) ^ table[(state[:n] >> 8) ^ byte]
    out[order] = state
    return out


def _utf8_number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1 if k < 7 else 36))
    tail = [0x80 | (n >> 6 * i) & 0x3F for i in range(size - 1)][::-1]
    return bytes([(0xFF << (8 - size) & 0xFF) | n >> 6 * (size - 1), *tail])


def _read_utf8_number(data: np.ndarray, at: int) -> tuple[int, int]:
    first = int(data[at])
    size = 1 if first < 0x80 else 8 - (first ^ 0xFF).bit_length()
    n = first if size == 1 else first & ((1 << (7 - size)) - 1)
    for k in range(1, size):
        n = n << 6 | int(data[at + k]) & 0x3F
    return n, size


def stream_info(samples: int, block_low: int, frame_low: int, frame_high: int, md5: bytes, last: bool) -> bytes:
    head = BLOCK.to_bytes(2, "big") if samples > BLOCK else max(16, block_low).to_bytes(2, "big")
    packed = RATE << 44 | 0 << 41 | (BITS - 1) << 36 | samples
    body = head + head + frame_low.to_bytes(3, "big") + frame_high.to_bytes(3, "big") + packed.to_bytes(8, "big") + md5
    return b"fLaC" + bytes([0x80 if last else 0, 0, 0, 34]) + body


def seek_points(sizes: np.ndarray, samples: np.ndarray) -> bytes:
    """A seek table with a point for every frame: its first sample, byte offset and number of samples."""
    points = np.zeros(len(sizes), [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    points["sample"], points["offset"], points["n"] = np.cumsum(samples) - samples, np.cumsum(sizes) - sizes, samples
    raw = points.tobytes()
    return bytes([0x80 | 3]) + len(raw).to_bytes(3, "big") + raw


def encode(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """One FLAC stream per row of bytes; rows must not be empty. A byte is an unsigned 8-bit sample.

    Frames do not depend on each other, so they are made RUN bytes at a time:
    a very long row needs little more than its own bytes and its stream.
    """
    lengths = np.diff(offsets)
    frames = -(-lengths // BLOCK)
    owner = np.repeat(np.arange(len(lengths)), frames)
    number = ranges(np.zeros(len(frames), np.int64), frames)
    start = offsets[:-1][owner] + number * BLOCK
    size = np.minimum(BLOCK, offsets[1:][owner] - start)
    parts, sizes, a = [], [np.zeros(0, np.int64)], 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(start, start[a] + RUN, "left")))
        out, frame_size = _frames(data[start[a] : start[b - 1] + size[b - 1]], start[a:b] - start[a], size[a:b], number[a:b])
        parts.append(out.tobytes())
        sizes.append(frame_size)
        a = b
    body, frame_size = b"".join(parts), np.concatenate(sizes)
    first = np.concatenate([[0], np.cumsum(frame_size)])
    streams, upto = [], np.concatenate([[0], np.cumsum(frames)])
    for i in range(len(lengths)):
        a, b = upto[i], upto[i + 1]
        own = frame_size[a:b]
        md5 = hashlib.md5((data[offsets[i] : offsets[i + 1]] ^ 0x80).tobytes()).digest()
        info = stream_info(int(lengths[i]), int(size[a]), int(own.min()), int(own.max()), md5, b - a == 1)
        table = seek_points(own, size[a:b]) if b - a > 1 else b""
        streams.append(info + table + body[first[a] : first[b]])
    return streams


def _frames(data: np.ndarray, start: np.ndarray, size: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frames of consecutive blocks of samples, and how long each is."""
    samples = data.astype(np.int32) - 128
    place = ranges(np.zeros(len(size), np.int64), size)
    residuals, cost, params = [], [], []
    now = samples
    for order in range(TRIED):
        if order:
            now = now - np.concatenate([[0], now[:-1]])
        zig = (now << 1) ^ (now >> 31)
        zig[place < order] = 0
        residuals.append(zig)
        n = np.maximum(size - order, 1)
        sums = np.add.reduceat(zig, start, dtype=np.int64)
        k = np.clip(np.round(np.log2(np.maximum(sums / n, 1) * 0.7)), 0, 14).astype(np.int64)
        params.append(k)
        cost.append(np.where(size > order, (sums >> k) + n * (k + 1) + 8 * order, 1 << 40))
    cost, params, residuals = np.array(cost), np.array(params), np.array(residuals)
    best = cost.argmin(axis=0)
    each = np.arange(len(start))
    k = params[best, each]
    zig = residuals[np.repeat(best, size), np.arange(len(samples))]
    verbatim = cost[best, each] + 10 >= size * BITS

    # Bits of each subframe after its header byte: warm-up samples, residual header, then the codes.
    warm = np.where(verbatim, size, best)
    coded = np.where(verbatim, 0, size - best)
    raw = place < np.repeat(warm, size)
    spread = np.repeat(k, size)
    width = np.where(raw, BITS, spread + 1 + (zig >> spread))
    opens = (start + warm)[~verbatim]
    width[opens] += 10  # coding method 0, one partition, its 4-bit parameter
    body_bits = np.add.reduceat(width, start)
    heads = []
    for i in range(len(start)):
        n, full = int(size[i]), int(size[i]) == BLOCK
        head = bytes([0xFF, 0xF8, (0xC0 if full else 0x70) | 0x04, 0x02]) + _utf8_number(int(number[i])) + (b"" if full else (n - 1).to_bytes(2, "big"))
        heads.append(head)
    head_size = np.array([len(h) for h in heads], np.int64) + 1
    frame_size = head_size + 1 + -(-body_bits // 8) + 2
    first = np.concatenate([[0], np.cumsum(frame_size)])
    out = np.zeros(int(first[-1]), np.uint8)
    flat = np.frombuffer(b"".join(heads), np.uint8)
    out[ranges(first[:-1], head_size - 1)] = flat
    out[first[:-1] + head_size - 1] = crc_many(out, first[:-1], head_size - 1, 8)
    out[first[:-1] + head_size] = np.where(verbatim, 2, (8 + best) << 1)

    ends = np.cumsum(width)
    base = (first[:-1] + head_size + 1) * 8 - np.concatenate([[0], ends])[:-1][start]
    code_end = ends + np.repeat(base, size)  # bit position after each code
    bits = np.zeros(len(out) * 8, np.uint8)

    def put(at: np.ndarray, value: np.ndarray, n: np.ndarray) -> None:
        for bit in range(int(n.max()) if len(n) else 0):
            on = (n > bit) & ((value >> bit) & 1 == 1)
            bits[at[on] - 1 - bit] = 1

    put(code_end[raw], (samples & 0xFF)[raw], np.full(int(raw.sum()), BITS))
    rest = ~raw
    kk = spread[rest]
    put(code_end[rest], zig[rest] & ((1 << kk) - 1), kk)
    bits[code_end[rest] - kk - 1] = 1
    put(code_end[opens] - width[opens] + 10, spread[opens], np.full(len(opens), 4))
    packed = np.packbits(bits)
    out |= packed
    out[first[1:] - 2], out[first[1:] - 1] = (c := crc_many(out, first[:-1], frame_size - 2, 16)) >> 8, c & 0xFF

    return out, frame_size


def _bits(words: np.ndarray, at: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """Up to 32 bits from bit position ``at``; words[i] holds the 8 bytes from byte i, as a big-endian number."""
    return ((words[at >> 3] << (at & 7).astype(np.uint64)) >> (np.uint64(64) - np.asarray(n, np.uint64)) if np.ndim(n) or n else np.zeros(len(at), np.uint64)).astype(np.int64)


def _layout(data: np.ndarray, at: int, end: int) -> tuple[int, int, bytes, np.ndarray]:
    """(first frame's byte, samples, MD5, frame offsets of the seek table if it has every frame)."""
    if data[at : at + 4].tobytes() != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, total, md5, points = at + 4, 0, b"", np.zeros(0, np.int64)
    while True:
        kind, length = int(data[at]), int.from_bytes(data[at + 1 : at + 4].tobytes(), "big")
        body = data[at + 4 : at + 4 + length].tobytes()
        if kind & 0x7F == 0:
            packed = int.from_bytes(body[10:18], "big")
            if packed >> 36 & 0x1F != BITS - 1 or packed >> 41 & 7:
                raise ValueError("only mono streams of 8 bits a sample")
            total, md5 = packed & (1 << 36) - 1, body[18:34]
        elif kind & 0x7F == 3:
            table = np.frombuffer(body, [("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
            samples, n = table["sample"].astype(np.int64), table["n"].astype(np.int64)
            if len(table) and (np.cumsum(n) - n == samples).all() and n.sum() == total:
                points = table["offset"].astype(np.int64)
        at += 4 + length
        if at > end:
            raise ValueError("a stream ends in its metadata")
        if kind & 0x80:
            return at, total, md5, points


def decode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(samples as unsigned bytes, offsets by stream, first sample of each frame, frames by stream).

    Raises ValueError where a marker, a checksum, a count or an MD5 is wrong.
    Handles mono 8-bit streams with constant, verbatim, fixed and linear
    predictor subframes and Rice partitions of either parameter size. Frames that
    a seek table lists are decoded side by side; other streams frame by frame.
    """
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.zeros(len(data) + 8, np.uint64)
    for i in range(8):
        words |= padded[i : i + len(words)].astype(np.uint64) << np.uint64(56 - 8 * i)
    found = [_layout(data, int(a), int(b)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    left = np.array([f[1] for f in found], np.int64)
    first = np.concatenate([[0], np.cumsum(left)])
    pcm = np.zeros(int(first[-1]), np.int32)
    points = [f[3] if len(f[3]) else np.zeros(1, np.int64) for f in found]
    owner = np.repeat(np.arange(len(found)), [len(p) for p in points])
    number = np.concatenate([np.arange(len(p)) for p in points]) if points else np.zeros(0, np.int64)
    at = np.array([f[0] for f in found], np.int64)[owner] + (np.concatenate(points) if points else 0)
    sample = number * 0
    owners, seeks = [], []
    done = np.zeros(len(found), np.int64)
    while len(at):
        if (at + 6 > offsets[1:][owner]).any():
            raise ValueError("a stream is too short")
        head, n = _headers(data, at, number)
        if (crc_many(data, at, head, 8) != data[at + head]).any():
            raise ValueError("a frame header's checksum is wrong")
        fresh = np.concatenate([[True], owner[1:] != owner[:-1]])
        run = np.cumsum(n) - n
        sample = done[owner] + run - np.repeat(run[fresh], np.diff(np.append(np.flatnonzero(fresh), len(run))))
        if (sample + n > left[owner]).any():
            raise ValueError("a stream has too many samples")
        end = _subframes(words, at + head + 1, n, pcm, first[owner] + sample)
        if (end + 2 > offsets[1:][owner]).any() or (crc_many(data, at, end - at, 16) != (data[end].astype(np.int64) << 8 | data[end + 1])).any():
            raise ValueError("a frame's checksum is wrong")
        end = end + 2
        if (end[:-1] != at[1:])[~fresh[1:]].any():
            raise ValueError("frames don't follow one another")
        owners.append(owner)
        seeks.append(sample)
        done += np.bincount(owner, n, len(found)).astype(np.int64)
        last = np.append(fresh[1:], True)
        more = last & (done[owner] < left[owner])
        if (end[last & ~more] != offsets[1:][owner][last & ~more]).any():
            raise ValueError("a stream's length is wrong")
        at, owner, number = end[more], owner[more], number[more] + 1
    if (done != left).any():
        raise ValueError("a stream has too few samples")
    for i, f in enumerate(found):
        if hashlib.md5(pcm[first[i] : first[i + 1]].astype(np.int8).tobytes()).digest() != f[2]:
            raise ValueError("a stream's MD5 is wrong")
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    seek = np.concatenate(seeks) if seeks else np.zeros(0, np.int64)
    order = np.lexsort((seek, owner))
    return (pcm + 128).astype(np.uint8), first, seek[order], np.bincount(owner, minlength=len(found))


def _headers(data: np.ndarray, at: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes before the header's checksum, samples) of the frame at each position."""
    if (data[at] != 0xFF).any() or ((data[at + 1] & 0xFE) != 0xF8).any():
        raise ValueError("no frame where one must start")
    lead = data[at + 4]
    code = (data[at + 2] >> 4).astype(np.int64)
    extra = np.where(code == 6, 1, np.where(code == 7, 2, 0))
    used = np.where(lead < 0x80, 1, 2)
    number = lead.astype(np.int64)
    for j in np.flatnonzero(lead >= 0x80):
        number[j], used[j] = _read_utf8_number(data, int(at[j]) + 4)
    if (number != wanted).any():
        raise ValueError("frames out of order")
    head = 4 + used + extra
    near = at + head
    stated = np.where(extra == 1, data[near - 1], data[near - 2].astype(np.int64) << 8 | data[near - 1]) + 1
    n = np.where(extra > 0, stated, np.where(code == 1, 192, np.where(code < 6, 576 << np.maximum(code - 2, 0), 256 << np.maximum(code - 8, 0))))
    if (code == 0).any():
        raise ValueError("a reserved block size")
    return head, n


def _subframes(words: np.ndarray, at: np.ndarray, size: np.ndarray, pcm: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Decode one mono subframe per row into ``pcm``; returns the byte after each."""
    head = _bits(words, at * 8, 8)
    kind = head >> 1
    if (head & 0x81).any():
        raise ValueError("a subframe header is wrong, or bits are wasted")
    order = np.where((kind >= 8) & (kind <= 12), kind - 8, np.where(kind >= 32, kind - 31, 0))
    if ((kind > 12) & (kind < 32) | (kind > 1) & (kind < 8)).any() or (order > size).any():
        raise ValueError("a reserved subframe type")
    bit = at * 8 + 8
    raw = np.where(kind == 1, size, np.where(kind == 0, 1, order))
    inside = ranges(raw * 0, raw)
    values = _bits(words, np.repeat(bit, raw) + inside * BITS, BITS)
    pcm[np.repeat(out, raw) + inside] = (values ^ 0x80) - 0x80
    bit = bit + raw * BITS
    for i in np.flatnonzero(kind == 0):
        pcm[out[i] : out[i] + size[i]] = pcm[out[i]]
    linear = np.flatnonzero(kind >= 32)
    weights, shift = np.zeros((len(at), 32), np.int64), np.zeros(len(at), np.int64)
    if linear.size:
        precision = _bits(words, bit[linear], 4) + 1
        shift[linear] = (_bits(words, bit[linear] + 4, 5) ^ 16) - 16
        bit[linear] += 9
        for j in range(int(order[linear].max())):
            has = linear[order[linear] > j]
            p = precision[np.searchsorted(linear, has)]
            v = _bits(words, bit[has], p)
            weights[has, j] = v - ((v >> (p - 1)) << p)
            bit[has] += p
    coded = np.flatnonzero(kind >= 8)
    if coded.size:
        _residuals(words, bit, coded, order, size, pcm, out)
    for o in range(1, len(FIXED)):
        _integrate(pcm, out[kind == 8 + o], size[kind == 8 + o], o)
    _predict(pcm, out[linear], size[linear], order[linear], weights[linear], shift[linear])
    return (bit + 7) >> 3


def _integrate(pcm: np.ndarray, out: np.ndarray, size: np.ndarray, order: int) -> None:
    """Undo a fixed predictor: sum ``order`` times, each time from one sample earlier."""
    if not len(out):
        return
    for depth in range(1, order):  # warm-up samples become differences of rising order
        for j in range(order - 1, depth - 1, -1):
            pcm[out + j] -= pcm[out + j - 1]
    for start in range(order - 1, -1, -1):
        n = size - start
        at = ranges(out + start, n)
        sums = np.cumsum(pcm[at], dtype=np.int64)
        before = np.concatenate([[0], sums])[np.cumsum(n) - n]
        pcm[at] = sums - np.repeat(before, n)


def _predict(pcm: np.ndarray, out: np.ndarray, size: np.ndarray, order: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> None:
    """Add the linear predictor to residuals, one sample of every row at a time."""
    rows = np.argsort(-size, kind="stable")
    out, size, order, weights, shift = out[rows], size[rows], order[rows], weights[rows], shift[rows]
    for step in range(1, int(size[0]) if len(size) else 0):
        live = np.flatnonzero((size > step) & (order <= step))
        guess = np.zeros(len(live), np.int64)
        for j in range(min(step, int(order.max()))):
            guess += weights[live, j] * pcm[out[live] + step - 1 - j]
        pcm[out[live] + step] += (guess >> shift[live]).astype(np.int32)


def _lead(n: int = 16) -> np.ndarray:
    """Zero bits before the first one among the upper ``n`` bits; ``n`` where there is none."""
    x = np.arange(1 << n)
    return (n - np.ceil(np.log2(x + 1)).astype(np.int64)).astype(np.uint64)


LEAD = _lead()


def _residuals(words: np.ndarray, bit: np.ndarray, coded: np.ndarray, order: np.ndarray, size: np.ndarray, pcm: np.ndarray, out: np.ndarray) -> None:
    """Read the Rice codes of all ``coded`` rows, one code of each row at a time; moves ``bit`` past them."""
    coded = coded[np.argsort(-size[coded], kind="stable")]
    method = _bits(words, bit[coded], 2)
    if (method > 1).any():
        raise ValueError("a reserved residual coding")
    part = size[coded] >> _bits(words, bit[coded] + 2, 4)
    wide = np.where(method == 0, 4, 5)
    pos, n, base = (bit[coded] + 6).astype(np.uint64), size[coded], out[coded]
    k, plain, opens = np.zeros(len(coded), np.uint64), np.zeros(len(coded), bool), order[coded].copy()
    start, begun = opens.copy(), int(opens.max())
    live_at = np.searchsorted(-n, -np.arange(int(n[0])), "left").tolist()
    one, seven, three, top = U(1), U(7), U(3), U(63)
    for step in range(int(opens.min()), int(n[0])):
        live = live_at[step]
        if step == next_open if step > int(start.min()) else True:
            fresh = np.flatnonzero(opens[:live] == step)
            at = pos[fresh].astype(np.int64)
            width = wide[fresh]
            got = _bits(words, at, width)
            escape = got == (1 << width) - 1
            plain[fresh] = escape
            k[fresh] = np.where(escape, _bits(words, at + width, 5), got)
            pos[fresh] += (width + 5 * escape).astype(np.uint64)
            opens[fresh] = np.maximum(part[fresh], 1) * (step // np.maximum(part[fresh], 1) + 1)
            next_open = int(opens[:live].min())
        p, kk = pos[:live], k[:live]
        window = words[(p >> three).view(np.int64)] << (p & seven)
        quotient = LEAD[(window >> U(48)).view(np.int64)]
        used = quotient + one
        zig = (quotient << kk) | (((window << used) >> one) >> (top - kk))
        if int(quotient.max()) == 16:
            _long_codes(words, p, quotient, kk, used, zig)
        value = (zig >> one).view(np.int64) ^ -((zig & one).view(np.int64))
        moved = p + used + kk
        if plain[:live].any():
            rows = np.flatnonzero(plain[:live])
            bits = kk[rows].astype(np.int64)
            v = np.where(bits > 0, _bits(words, p[rows].astype(np.int64), np.maximum(bits, 1)), 0)
            value[rows] = np.where(bits > 0, v - ((v >> np.maximum(bits - 1, 0)) << bits), 0)
            moved[rows] = p[rows] + kk[rows]
        if step >= begun:
            pcm[base[:live] + step] = value
            pos[:live] = moved
        else:
            ready = np.flatnonzero(start[:live] <= step)
            pcm[base[ready] + step] = value[ready]
            pos[ready] = moved[ready]
    bit[coded] = pos.astype(np.int64)


def _long_codes(words: np.ndarray, p: np.ndarray, quotient: np.ndarray, k: np.ndarray, used: np.ndarray, zig: np.ndarray) -> None:
    """Codes with 16 zeros or more, one by one: sets how long their unary part is and what they stand for."""
    end = 8 * (len(words) - 8)
    for i in np.flatnonzero(quotient == 16).tolist():
        at = int(p[i])
        while at < end and not (word := int(words[at >> 3]) << (at & 7) & (1 << 64) - 1) >> 8:
            at += 56
        at = min(at + 64 - word.bit_length(), end) if at < end else end
        zeros, shift = at - int(p[i]), int(k[i])
        if zeros << shift >= 1 << 16:
            zeros = 0  # damaged data, or a row that isn't at its first code yet
        used[i] = zeros + 1
        zig[i] = zeros << shift | (int(_bits(words, np.array([min(at + 1, end)]), shift)[0]) if shift else 0)


def payload(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bytes, then bytes 0 up to a positive multiple of UNIT."""
    size = np.diff(offsets)
    full = np.maximum(UNIT, -(-size // UNIT) * UNIT)
    at = np.concatenate([[0], np.cumsum(full)])
    out = np.zeros(int(at[-1]), np.uint8)
    out[ranges(at[:-1], size)] = data
    return out, at


STORED = {"n_bytes": "long", "media": "binary"}
LOADED = STORED | {"pcm": "binary", "seek": "array<long>"}
DIGESTS = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
Batches = Iterator[pa.RecordBatch]


def _store(batches: Batches) -> Batches:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for a, b in slices(offsets, 8 << 20):
            streams = []
            for c, d in slices(offsets[a : b + 1], 1 << 20):
                c, d = a + c, a + d
                streams += encode(*payload(data[offsets[c] : offsets[d]], offsets[c : d + 1] - offsets[c]))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(offsets[a : b + 1])), pa.array(streams, pa.binary())], ["id", *STORED])


def _load(batches: Batches) -> Batches:
    for batch in batches:
        column = batch.column(2)
        data, offsets = text_bytes(column.fill_null(b"") if column.null_count else column)
        for a, b in slices(offsets, 8 << 20):
            part = batch.slice(a, b - a)
            real = np.flatnonzero(np.diff(offsets[a : b + 1]) > 0)
            cuts = np.concatenate([offsets[a + real], [offsets[b]]]) - offsets[a]
            pcm, at, seek, frames = decode(data[offsets[a] : offsets[b]], cuts)
            upto = np.concatenate([[0], np.cumsum(frames)])
            blocks, tables = [None] * (b - a), [None] * (b - a)
            for j, i in enumerate(real.tolist()):
                blocks[i], tables[i] = pcm[at[j] : at[j + 1]].tobytes(), seek[upto[j] : upto[j + 1]].tolist()
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(blocks, pa.binary()), pa.array(tables, pa.list_(pa.int64()))], ["id", *LOADED])


def _digest(batches: Batches) -> Batches:
    for batch in batches:
        rows: list[list] = [[] for _ in range(6)]
        for media, pcm, seek in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
            media, pcm, last = media.as_buffer(), pcm.as_buffer(), seek.values[-1].as_py()
            x = np.frombuffer(pcm, np.uint8).astype(np.int16) - 128
            turns = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
            feature = f"blocks={len(seek)};last={last};mean={int(x.sum(dtype=np.int64)) / len(x):.6f};power={int((x * x).sum(dtype=np.int64)) / len(x):.6f};turns={turns}"
            found = (len(x), hashlib.sha256(pcm).hexdigest(), zlib.crc32(memoryview(pcm)[-UNIT:]), media.size, hashlib.sha256(media).hexdigest(), feature)
            for column, value in zip(rows, found, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))], ["id", *DIGESTS])


def _map(df: DataFrame, run, id_column: str, columns: list[str], out: dict[str, str]) -> DataFrame:
    ship(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()
    fields = ", ".join([f"id {kind}", *(f"{k} {v}" for k, v in out.items())])
    return df.select(F.col(id_column).alias("id"), *columns).mapInArrow(run, fields).withColumnRenamed("id", id_column)


def store(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The stored form: id, n_bytes (of the text), media (a FLAC stream as binary).

    The samples are the text's UTF-8, then bytes 0 up to a positive multiple of
    UNIT; a null text counts as empty. One row for each row; ids are not read.
    """
    return _map(docs, _store, id_column, [text_column], STORED)


def load(media: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Decode a stored table: its columns, pcm (binary) and seek (first sample of each block).

    A damaged stream raises ValueError; a null stream gives a null pcm.
    """
    return _map(media, _load, id_column, [*STORED], LOADED)


def digests(loaded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Checksums and a feature of the decoded samples.

    feature: blocks, first sample of the last block, mean and mean square of the
    signed samples, and sign changes.
    """
    return _map(loaded, _digest, id_column, [*LOADED], DIGESTS)


def round_trip(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``digests(load(store(docs)))`` in one pass: streams go from encoder to decoder within a task.

    Null texts are empty and padded like others; null ids and repeated rows are rows like others; an empty table gives none.
    """
    return _map(docs, lambda batches: _digest(_load(_store(batches))), id_column, [text_column], DIGESTS)
