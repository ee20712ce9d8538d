"""FLAC as a media column: 8-bit mono streams, encoded and decoded for many frames at a time.

A text's bytes are stored as samples (byte - 128) in frames of ``FRAME`` samples. Encoding
picks for each frame the best of the fixed predictors and a quantised linear predictor of
order ``ORDER``, and a Rice parameter for each 64 to 128 residuals. Decoding walks all frames
of a slab in step: the n-th sample of each frame at once, reading Rice residuals off an index
of the next set bit and adding the predictor's value. The seek table has a point for every
frame, so frames decode apart from each other; header CRC-8 and frame CRC-16 are verified.

Defined results: null and empty texts are 64 zero bytes; a frame whose checksums fail gives
a block with ``ok`` false and no PCM, other frames are not affected; a null stream has no
blocks; streams that aren't 8-bit mono or lack a seek table raise ValueError; an empty table
gives an empty result; only the named columns are read, so others can't clash.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slabs, text_of

#: Samples of a frame; order, bits and shift of the linear predictor; the unit that payloads are filled up to.
FRAME, ORDER, PRECISION, SHIFT, UNIT = 1024, 4, 12, 10, 64
RATE = 8000
#: Samples encoded or decoded at a time.
SLAB = 1 << 20
# Fixed values of the format: coefficients of the fixed predictors, block sizes by code.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
BLOCK_SIZES = (0, 192, 576, 1152, 2304, 4608, 0, 0, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768)


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint32)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The checksum of each stretch, all stretches byte by byte in step."""
    crc = np.zeros(len(starts), np.uint32)
    order = np.argsort(-lengths, kind="stable")
    starts, counts = starts[order], lengths[order]
    out = np.zeros(len(starts), np.uint32)
    mask, shift = np.uint32((1 << bits) - 1), np.uint32(bits - 8)
    live = len(starts)
    for i in range(int(counts[0]) if live else 0):
        while counts[live - 1] <= i:
            live -= 1
        c = crc[:live]
        crc[:live] = ((c << np.uint32(8)) & mask) ^ table[(c >> shift) ^ data[starts[:live] + i]]
    out[order] = crc
    return out


def payload(text: str | None) -> bytes:
    """The text's bytes and zero bytes up to a positive multiple of ``UNIT``."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


# -- encoding ---------------------------------------------------------------------------


def _utf8_number(n: int) -> bytes:
    """A frame number in the format's extended UTF-8."""
    if n < 0x80:
        return bytes([n])
    for size, first in ((2, 0xC0), (3, 0xE0), (4, 0xF0), (5, 0xF8), (6, 0xFC), (7, 0xFE)):
        if n < 1 << (5 * size + 1):
            tail = [0x80 | n >> 6 * i & 0x3F for i in range(size - 2, -1, -1)]
            return bytes([first | n >> 6 * (size - 1), *tail])
    raise ValueError(n)


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for i in range(width):
        bits[at + i] = value >> (width - 1 - i) & 1


def _linear(x: np.ndarray) -> np.ndarray:
    """Quantised predictor coefficients of each row, from its autocorrelation (Levinson-Durbin)."""
    y = x.astype(np.float64)
    n = x.shape[1]
    r = np.stack([np.einsum("ij,ij->i", y[:, k:], y[:, : n - k]) for k in range(ORDER + 1)], 1)
    r[:, 0] += 1e-9 + r[:, 0] * 1e-9
    a, err = np.zeros((len(x), ORDER)), r[:, 0].copy()
    for i in range(ORDER):
        k = (r[:, i + 1] - np.einsum("ij,ij->i", a[:, :i], r[:, i:0:-1])) / err
        grown = a.copy()
        grown[:, i] = k
        grown[:, :i] -= k[:, None] * a[:, :i][:, ::-1]
        a, err = grown, np.maximum(err * (1 - k * k), 1e-9)
    top = 1 << (PRECISION - 1)
    return np.clip(np.rint(a * (1 << SHIFT)), -top, top - 1).astype(np.int32)


def _residual(x: np.ndarray, coefs: np.ndarray, shift: int) -> np.ndarray:
    """x less its prediction; the first samples, which have no prediction, are left 0."""
    order, r = coefs.shape[1], np.zeros_like(x)
    guess = np.zeros_like(x[:, order:])
    for j in range(order):
        guess += coefs[:, j : j + 1] * x[:, order - 1 - j : x.shape[1] - 1 - j]
    r[:, order:] = x[:, order:] - (guess >> shift)
    return r


def _frames(x: np.ndarray, numbers: list[int]) -> list[bytes]:
    """One frame for each row of samples; all rows are equally long."""
    n_rows, n = x.shape
    x = x.astype(np.int32)
    lpc = _linear(x)
    options = [x, x.copy(), x.copy(), _residual(x, lpc, SHIFT)]
    for o in (1, 2):
        options[o][:, o:] = np.diff(x, n=o)
        options[o][:, :o] = 0
    orders = np.array([0, 1, 2, ORDER])
    pick = np.stack([np.abs(r).sum(1) for r in options], 1).argmin(1)
    order = orders[pick]
    res = np.choose(pick[:, None], options)
    flat = (x == x[:, :1]).all(1)
    u = np.where(res >= 0, res << 1, (-res << 1) - 1)

    parts = 1
    while parts < 16 and n // parts % 2 == 0 and n // parts > 64:
        parts *= 2
    size = n // parts
    warm = np.arange(n) < order[:, None]
    mean = u.reshape(n_rows, parts, size).mean(2)
    k = np.clip(np.log2(np.maximum(mean * 0.7, 1)), 0, 14).astype(np.int32)  # near the best for geometric residuals
    kk = np.repeat(k, size, axis=1)
    q = u >> kk
    length = np.where(warm, 0, q + 1 + kk)
    length[:, ::size] += 4

    head = [b"\xff\xf8\x70\x02" + _utf8_number(i) + struct.pack(">H", n - 1) for i in numbers]
    head_bits = np.array([len(h) * 8 for h in head]) + 8
    extra = np.where(pick == 3, 9 + ORDER * PRECISION, 0)
    body = np.where(flat, 16, 8 + order * 8 + extra + 6 + length.sum(1))
    total = head_bits + body
    total += -total % 8 + 16
    base = np.cumsum(total) - total
    bits = np.zeros(int(total.sum()), np.uint8)

    sub = base + head_bits
    _put(bits, sub, np.where(flat, 0, np.where(pick == 3, 32 + ORDER - 1, 8 + order)) << 1, 8)
    _put(bits, sub[flat] + 8, x[flat, 0] & 255, 8)
    rich = np.flatnonzero(~flat)
    for j in range(ORDER):
        has = rich[order[rich] > j]
        _put(bits, sub[has] + 8 + 8 * j, x[has, j] & 255, 8)
    at = sub + 8 + order * 8
    by_lpc = rich[pick[rich] == 3]
    _put(bits, at[by_lpc], np.full(len(by_lpc), PRECISION - 1), 4)
    _put(bits, at[by_lpc] + 4, np.full(len(by_lpc), SHIFT), 5)
    for j in range(ORDER):
        _put(bits, at[by_lpc] + 9 + j * PRECISION, lpc[by_lpc, j] & ((1 << PRECISION) - 1), PRECISION)
    at = at + extra
    _put(bits, at[rich] + 2, np.full(len(rich), parts.bit_length() - 1), 4)
    start = (at + 6)[:, None] + np.cumsum(length, 1) - length
    _put(bits, start[rich][:, ::size].ravel(), k[rich].ravel(), 4)
    start[:, ::size] += 4
    coded = ~warm & ~flat[:, None]
    stop, kv, uv = (start + q)[coded], kk[coded], u[coded]
    bits[stop] = 1
    for width in np.unique(kv):
        has = np.flatnonzero(kv == width)
        _put(bits, stop[has] + 1, uv[has], int(width))
    data = np.packbits(bits)
    starts, sizes = base // 8, total // 8
    for i, h in zip(starts, head):
        data[i : i + len(h)] = np.frombuffer(h, np.uint8)
    n_head = head_bits // 8 - 1
    data[starts + n_head] = _crc(data, starts, n_head, _CRC8, 8)
    crc = _crc(data, starts, sizes - 2, _CRC16, 16)
    data[starts + sizes - 2], data[starts + sizes - 1] = crc >> 8, crc & 255
    return [data[i : i + s].tobytes() for i, s in zip(starts, sizes)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload."""
    jobs: dict[int, list[tuple[int, int]]] = {}
    frames: list[list[bytes]] = [[b""] * -(-len(p) // FRAME) for p in payloads]
    for i, p in enumerate(payloads):
        for f in range(len(frames[i])):
            jobs.setdefault(min(FRAME, len(p) - f * FRAME), []).append((i, f))
    for n, where in jobs.items():
        step = max(1, SLAB // n)
        for lo in range(0, len(where), step):
            part = where[lo : lo + step]
            raw = b"".join(payloads[i][f * FRAME : f * FRAME + n] for i, f in part)
            x = np.frombuffer(raw, np.uint8).reshape(len(part), n).astype(np.int16) - 128
            for (i, f), frame in zip(part, _frames(x, [f for _, f in part])):
                frames[i][f] = frame
    return [_stream(p, f) for p, f in zip(payloads, frames)]


def _stream(raw: bytes, frames: list[bytes]) -> bytes:
    sizes = [len(f) for f in frames]
    signed = (np.frombuffer(raw, np.uint8) ^ 0x80).tobytes()
    block = min(FRAME, len(raw)) if len(frames) == 1 else FRAME
    packed = RATE << 44 | 7 << 36 | len(raw)
    info = struct.pack(">HH", max(16, block), max(16, block)) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(signed).digest()
    points, at = [], 0
    for i, s in enumerate(sizes):
        points.append(struct.pack(">QQH", i * FRAME, at, min(FRAME, len(raw) - i * FRAME)))
        at += s
    # A metadata block's length has 24 bits: a longer table goes on in further blocks.
    most = (1 << 24) // 18 - 1
    tables = [b"".join(points[i : i + most]) for i in range(0, len(points), most)]
    out = [b"fLaC\0", len(info).to_bytes(3, "big"), info]
    for i, t in enumerate(tables):
        out += [bytes([3 | (0x80 if i == len(tables) - 1 else 0)]), len(t).to_bytes(3, "big"), t]
    return b"".join([*out, *frames])


# -- decoding ---------------------------------------------------------------------------


def seek_points(stream: bytes) -> tuple[int, list[tuple[int, int, int]]]:
    """(samples in all, [(sample offset, byte offset in the stream, samples)] of all frames)."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last, samples, points = 4, False, 0, []
    while not last:
        kind, n = stream[at], int.from_bytes(stream[at + 1 : at + 4], "big")
        last, kind, body = bool(kind & 0x80), kind & 0x7F, stream[at + 4 : at + 4 + n]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            samples = packed & ((1 << 36) - 1)
            if packed >> 41 & 7 or (packed >> 36 & 31) != 7:
                raise ValueError("only 8-bit mono is read")
        elif kind == 3:
            points += [p for p in struct.iter_unpack(">QQH", body) if p[0] < 1 << 63]
        at += 4 + n
    if sum(p[2] for p in points) != samples:
        raise ValueError("the seek table doesn't cover the stream")
    return samples, [(s, at + o, n) for s, o, n in points]


def _decode_frames(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x samples, whether each frame is sound) for frames of at most ``wanted`` samples each."""
    size = len(data)
    data = np.concatenate([data, np.zeros(16, np.uint8)])
    window = np.zeros(size + 8, np.int64)  # 40 bits from each byte on
    for i in range(5):
        window |= data[i : size + 8 + i].astype(np.int64) << (32 - 8 * i)
    bit = np.unpackbits(data)
    following = np.where(bit, np.arange(len(bit), dtype=np.int32), np.int32(len(bit) - 1))
    following = np.minimum.accumulate(following[::-1])[::-1]

    def take(at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Up to 32 bits at each bit position."""
        at = np.minimum(at, size * 8)
        return window[at >> 3] >> (40 - (at & 7) - width) & ((1 << np.asarray(width, np.int64)) - 1)

    def signed(v: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        half = np.left_shift(1, np.maximum(np.asarray(width, np.int64) - 1, 0))
        return np.where(np.asarray(width) > 0, (v ^ half) - half, 0)

    ok = (sizes > 8) & (take(starts * 8, 16) == 0xFFF8)
    lead = data[starts + 4].astype(np.int64)
    number = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    code = data[starts + 2].astype(np.int64) >> 4
    after = starts + 4 + number
    n = np.select([code == 6, code == 7], [data[after].astype(np.int64) + 1, take(after * 8, 16) + 1], np.array(BLOCK_SIZES)[code])
    head = 4 + number + np.select([code == 6, code == 7], [1, 2], 0)
    ok &= (head < sizes) & (n == wanted) & (data[starts + 3] >> 1 == 1)
    head = np.where(ok, head, 0)
    ok &= _crc(data, starts, head, _CRC8, 8) == data[starts + head]
    crc = _crc(data, starts, np.where(ok, sizes - 2, 0), _CRC16, 16)
    ok &= crc == take((starts + sizes - 2) * 8, 16)

    n = np.where(ok, wanted, 0)
    most = int(n.max(initial=0))
    out = np.zeros((len(starts), most), np.int64)
    at = (starts + head + 1) * 8
    kind = take(at, 8) >> 1
    at = at + 8
    constant, verbatim = kind == 0, kind == 1
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    ok &= (constant | verbatim | fixed | linear) & (take(at - 1, 1) == 0)
    out[ok & constant] = signed(take(at, 8), 8)[ok & constant, None]
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    coded = ok & (fixed | linear)
    raw = np.where(ok & verbatim, n, np.where(coded, order, 0))  # samples that stand as they are
    for j in range(int(raw.max(initial=0))):
        has = np.flatnonzero(raw > j)
        out[has, j] = signed(take(at[has] + 8 * j, 8), 8)
    f = np.flatnonzero(coded)
    if not len(f):
        return out, ok
    at, order, linear, n = (at + 8 * order)[f], order[f], linear[f], n[f]
    depth = max(1, int(order.max(initial=0)))
    coefs, shift = np.zeros((len(f), depth), np.int64), np.zeros(len(f), np.int64)
    for o in range(1, min(4, depth) + 1):
        coefs[(order == o) & ~linear, :o] = FIXED[o]
    precision = np.where(linear, take(at, 4) + 1, 0)
    shift = np.where(linear, take(at + 4, 5), 0)
    at = at + np.where(linear, 9, 0)
    for j in range(depth):
        has = linear & (order > j)
        coefs[has, j] = signed(take(at[has], precision[has]), precision[has])
        at = at + np.where(has, precision, 0)
    width = 4 + take(at, 2)
    part = n >> take(at + 2, 4)
    at = at + 6
    escape = (1 << width) - 1

    # By length, so that the frames that still go on come first.
    rank = np.argsort(-n, kind="stable")
    f, at, order, coefs, shift, width, part, escape, n = (v[rank] for v in (f, at, order, coefs, shift, width, part, escape, n))
    k, plain, any_plain = np.zeros(len(f), np.int64), np.zeros(len(f), bool), False
    x = np.zeros((most + depth, len(f)), np.int64)  # sample j at row j + depth
    for j in range(int(order.max(initial=0))):
        x[j + depth] = np.where(order > j, out[f, j], 0)
    coefs = np.ascontiguousarray(coefs.T[::-1])
    edges = {*range(depth + 1), *(j for size in np.unique(part) for j in range(0, most, int(size)))}
    live = len(f)
    for j in range(most):
        while live and n[live - 1] <= j:
            live -= 1
        s = slice(0, live)
        if j in edges:
            begins = np.flatnonzero((j == order[s]) | ((j % part[s] == 0) & (j > order[s])))
            k[begins] = take(at[begins], width[begins])
            at[begins] += width[begins]
            plain[begins] = k[begins] == escape[begins]
            bare = begins[plain[begins]]
            k[bare] = take(at[bare], 5)
            at[bare] += 5
            any_plain = bool(plain.any())
        p, kk = at[s], k[s]
        stop = following[p]
        if any_plain:
            stop = np.where(plain[s], p - 1, stop)
        low_at = stop + 1
        low = window[low_at >> 3] >> (40 - (low_at & 7) - kk) & ((1 << kk) - 1)
        u = (stop - p) << kk | low
        r = (u >> 1) ^ -(u & 1)
        if any_plain:
            r = np.where(plain[s], signed(low, kk), r)
        value = r + ((coefs[:, s] * x[j : j + depth, s]).sum(0) >> shift[s])
        ends = low_at + kk
        if j < depth:
            early = j < order[s]
            value, ends = np.where(early, x[j + depth, s], value), np.where(early, p, ends)
        x[j + depth, s] = value
        at[s] = ends
    out[f] = x[depth:].T
    return out, ok


def decode(streams: list[bytes | None]) -> list[list[tuple[int, int, bytes | None, bool]]]:
    """For each stream its PCM blocks: (sample offset, samples, unsigned 8-bit PCM, whether sound)."""
    blocks: list[list] = [[] for _ in streams]
    jobs = []
    for i, stream in enumerate(streams):
        if stream is not None:
            points = seek_points(stream)[1]
            ends = [p[1] for p in points[1:]] + [len(stream)]
            jobs += [(i, s, at, end - at, n) for (s, at, n), end in zip(points, ends)]
            blocks[i] = [None] * len(points)
    where = [0] * len(streams)
    lo = 0
    while lo < len(jobs):
        hi, total = lo, 0
        while hi < len(jobs) and (hi == lo or total + jobs[hi][4] <= SLAB):
            total += jobs[hi][4]
            hi += 1
        part = jobs[lo:hi]
        data = np.frombuffer(b"".join(streams[i][at : at + size] for i, _, at, size, _ in part), np.uint8)
        sizes = np.array([j[3] for j in part], np.int64)
        wanted = np.array([j[4] for j in part], np.int64)
        x, ok = _decode_frames(data, np.cumsum(sizes) - sizes, sizes, wanted)
        pcm = (x + 128).astype(np.uint8)
        for row, (i, s, _, _, n) in enumerate(part):
            blocks[i][where[i]] = (s, n, pcm[row, :n].tobytes() if ok[row] else None, bool(ok[row]))
            where[i] += 1
        lo = hi
    return blocks


# -- on Spark ---------------------------------------------------------------------------


def with_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's bytes as a FLAC stream."""
    kind = docs.schema[id_col].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "_text", 4 << 20):
            texts = batch.column("_text").to_pylist()
            n = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            media = encode([payload(t) for t in texts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(encoded, f"`{id_col}` {kind}, n_bytes long, media binary")


BLOCKS = T.ArrayType(T.StructType([
    T.StructField("sample_offset", T.LongType()), T.StructField("n_samples", T.IntegerType()),
    T.StructField("pcm", T.BinaryType()), T.StructField("ok", T.BooleanType()),
]))


def with_pcm(media: DataFrame, media_col: str = "media") -> DataFrame:
    """``media`` and its PCM blocks, in order, in a column ``blocks`` (which an explode() makes rows)."""
    rest = [c for c in media.columns if c != "blocks"]
    schema = media.select(rest).schema.add("blocks", BLOCKS)
    kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary()), ("ok", pa.bool_())]))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, media_col, 4 << 20):
            found = [[dict(zip(("sample_offset", "n_samples", "pcm", "ok"), b)) for b in x] for x in decode(batch.column(media_col).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*rest, "blocks"])

    return media.select(rest).mapInArrow(decoded, schema)


def at_sample(media: DataFrame, sample: int, media_col: str = "media") -> DataFrame:
    """``media`` (without a column ``block``) and the block that has the sample number ``sample``, decoded alone, in a column ``block``; null if there is none."""

    def sought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stream in batch.column(media_col).to_pylist():
                points = seek_points(stream)[1] if stream is not None else []
                i = next((i for i, (s, _, n) in enumerate(points) if s <= sample < s + n), None)
                if i is None:
                    out.append(None)
                    continue
                s, at, n = points[i]
                end = points[i + 1][1] if i + 1 < len(points) else len(stream)
                x, ok = _decode_frames(np.frombuffer(stream[at:end], np.uint8), np.zeros(1, np.int64), np.array([end - at]), np.array([n]))
                out.append((x[0, :n] + 128).astype(np.uint8).tobytes() if ok[0] else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "block"])

    return media.mapInArrow(sought, T.StructType([*media.schema.fields, T.StructField("block", T.BinaryType())]))
