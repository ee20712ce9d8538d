"""Byte-level BPE encoding by overlapping chunks, and decoding.

Texts of at most ``chunk`` code points are pre-tokenised and encoded where they are read.
Longer ones are cut into overlapping chunks, which Spark deals out. Each chunk is
pre-tokenised from its own (arbitrary) start. The pattern never looks back, so from a
boundary that two neighbours share both go on alike: that shared boundary in their overlap
is where they are stitched, and each chunk then encodes its pieces between its two stitches.
Neighbours without a shared boundary (a piece longer than the overlap lies across their edge)
are joined into one span, and stitching goes on behind them. A joined span is pre-tokenised
again as a whole; if the stitch at its end turns out to be no boundary of it, that one text
is encoded as a whole, so the result is that of the whole text in every case.

A task encodes a slab of texts at a time: the slab's distinct pieces are merged in lock step,
those of equal length as one matrix, and each text's ids are gathered from theirs. Nothing is
remembered from slab to slab, so a task's memory is that of a slab. Decoding concatenates the
ids' raw bytes.

Defined results: a null text counts as empty and has no ids; rows with the same id are
encoded one by one; an empty table gives an empty result; only the id and text columns are
read, so other columns can't clash.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import cut, is_long
from .common import slabs, stored, text_of

#: Code points of a chunk and of the overlap on either side.
CHUNK, OVERLAP = 32768, 512
#: Code points past a piece that the pattern may look at, at most.
MARGIN = 8
#: Bytes of text that are encoded together; pieces merged in one matrix, and bytes of a piece in one.
SLAB, ROWS, WIDTH = 4 << 20, 4096, 64
_NONE = np.iinfo(np.int32).max


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: join the adjacent pair of lowest rank, leftmost first, until none has a rank.

    A heap over a linked list: n log n.
    """
    if piece in ranks:
        return [ranks[piece]]
    parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(ranks[piece[i : i + 2]], i, 2) for i in range(len(parts) - 1) if piece[i : i + 2] in ranks]
    heapq.heapify(heap)

    def offer(i: int) -> None:
        if i >= 0 and (j := after[i]) < len(parts) and (joined := parts[i] + parts[j]) in ranks:
            heapq.heappush(heap, (ranks[joined], i, len(joined)))

    while heap:
        _, i, n = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= len(parts) or len(parts[i]) + len(parts[j]) != n:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        after[i] = after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [ranks[p] for p in parts if p is not None]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one range after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Codec:
    """Ranks and a pre-token pattern, as a worker holds them. An id is the rank of its bytes."""

    _held: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str):
        self.ranks = load_ranks(path)
        self.pattern = regex.compile(pattern)
        vocab: list[bytes] = [b""] * (1 + max(self.ranks.values()))
        for piece, i in self.ranks.items():
            vocab[i] = piece
        self.vocab = pa.array(vocab, pa.binary())
        self.byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        # All pairs of ids that join to an id, in order: left id, then right id.
        joins = [(self.ranks[p[:k]] << 32 | self.ranks[p[k:]], i) for p, i in self.ranks.items() for k in range(1, len(p)) if p[:k] in self.ranks and p[k:] in self.ranks]
        self.pair, self.joined = (x[np.argsort([j[0] for j in joins])] for x in (np.array([j[0] for j in joins], np.int64), np.array([j[1] for j in joins], np.int32)))
        self.first = self.join(np.repeat(self.byte, 256), np.tile(self.byte, 256)).reshape(256, 256)

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._held:
            cls._held[path, pattern] = cls(path, pattern)
        return cls._held[path, pattern]

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids that pairs of ids join to, _NONE where there is none."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.joined[at], _NONE)

    def _merged(self, pieces: np.ndarray, rows: np.ndarray, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> None:
        """Merge pieces of equal length, one in each row of bytes, each by its lowest pair at a time."""
        own, low = self.byte[pieces], self.first[pieces[:, :-1], pieces[:, 1:]]
        while len(rows):
            width = own.shape[1]
            at = low.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
            best = low[np.arange(len(rows)), at] if width > 1 else np.full(len(rows), _NONE)
            done = best == _NONE
            if done.any():
                ids[starts[rows[done], None] + np.arange(width)] = own[done]
                counts[rows[done]] = width
                rows, own, low, at, best = (x[~done] for x in (rows, own, low, at, best))
            if not len(rows):
                return
            n, places = np.arange(len(rows)), np.arange(width)
            own[n, at] = best
            own = own[places != at[:, None] + 1].reshape(len(rows), width - 1)
            low = low[places[:-1] != at[:, None]].reshape(len(rows), width - 2)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            low[left, at[left] - 1] = self.join(own[left, at[left] - 1], own[left, at[left]])
            low[right, at[right]] = self.join(own[right, at[right]], own[right, at[right] + 1])

    def merged(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start, count) of each of the distinct ``pieces``."""
        pieces = pieces.cast(pa.binary())
        ends = np.frombuffer(pieces.buffers()[1], np.int32)[pieces.offset : pieces.offset + len(pieces) + 1].astype(np.int64)
        raw = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)
        starts, sizes = ends[:-1], np.diff(ends)
        ids, counts = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32), np.ones(len(pieces), np.int64)
        whole = pc.index_in(pieces, self.vocab)
        known = whole.is_valid().to_numpy(zero_copy_only=False)
        ids[starts[known]] = whole.drop_null().to_numpy()
        order = np.flatnonzero(~known & (sizes <= WIDTH))
        order = order[np.argsort(sizes[order], kind="stable")]
        for group in np.split(order, 1 + np.flatnonzero(np.diff(sizes[order]))):
            for i in range(0, len(group), ROWS):
                rows = group[i : i + ROWS]
                self._merged(raw[starts[rows, None] + np.arange(sizes[rows[0]])], rows, ids, starts, counts)
        for row in np.flatnonzero(~known & (sizes > WIDTH)):
            found = merge(raw[starts[row] : ends[row + 1]].tobytes(), self.ranks)
            counts[row] = len(found)
            ids[starts[row] : starts[row] + len(found)] = found
        return ids, starts, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, where each text's begin and the last one's end)."""
        pieces = [pa.array(self.pattern.findall(t), pa.string()) for t in texts]
        places = pa.chunked_array(pieces, pa.string()).combine_chunks().dictionary_encode()
        at = places.indices.to_numpy()
        ids, starts, counts = self.merged(places.dictionary)
        sizes = counts[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, pieces)])]
        return ids[ranges(starts[at], sizes)], ends

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.BinaryArray:
        """The bytes of each text's ids, which are joined as they are even where they cut a character."""
        return joined(self.vocab.take(pa.array(ids)), ends)

    def ends(self, text: str, start: int = 0) -> list[int]:
        """Where the pieces of ``text`` from ``start`` on end."""
        return [m.end() for m in self.pattern.finditer(text, start)]


def joined(parts: pa.BinaryArray, ends: np.ndarray) -> pa.BinaryArray:
    """The bytes of each run of parts; taken parts lie one after another, so their buffer stays as it is."""
    at = np.frombuffer(parts.buffers()[1], np.int32)[: len(parts) + 1] if len(parts) else np.zeros(1, np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(np.ascontiguousarray(at[ends])), parts.buffers()[2] if len(parts) else pa.py_buffer(b"")])


def shared_boundary(left: set[int], right: set[int]) -> int | None:
    """The first boundary that two neighbours share in their overlap."""
    return min(left & right, default=None)


def _boundaries(batches: Iterator[pa.RecordBatch], path: str, pattern: str, size: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """Pre-tokenise each chunk; keep the boundaries (in the whole text) within its two overlaps.

    A piece within MARGIN of the chunk's end might be another one with more text to see, so it
    bounds nothing, but for the last chunk.
    """
    codec = Codec.of(path, pattern)
    for batch in slabs(batches, "_text", SLAB):
        left, right = [], []
        for text, chunk, chunks, start in zip(*(batch.column(c).to_pylist() for c in ("_text", "_chunk", "_chunks", "_start"))):
            own = chunk * size
            ends = [start + e for e in codec.ends(text) if e <= len(text) - MARGIN or chunk == chunks - 1]
            left.append([e for e in ends if own - overlap <= e <= own + overlap] if chunk else [])
            right.append([e for e in ends if abs(e - own - size) <= overlap] if chunk < chunks - 1 else [])
        keys = [batch.column(c) for c in ("_key", "_chunk", "_chunks")]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(left, pa.list_(pa.int32())), pa.array(right, pa.list_(pa.int32()))], names=["_key", "_chunk", "_chunks", "_left", "_right"])


def _stitches(pdf, size: int):
    """For one text: the span that each chunk belongs to (by its first chunk), and what it has of it.

    A chunk that shares no boundary with its neighbour goes on with the neighbour's span, which
    ends at the next boundary shared by two chunks.
    """
    import pandas as pd

    pdf = pdf.sort_values("_chunk")
    left, right, n = list(pdf["_left"]), list(pdf["_right"]), len(pdf)
    first, begins = [0] * n, [0] * n
    for i in range(1, n):
        found = shared_boundary({*right[i - 1]}, {*left[i]})
        first[i], begins[i] = (first[i - 1], i * size) if found is None else (i, found)
    times = pd.Series(first).map(pd.Series(first).value_counts()).to_list()
    return pd.DataFrame({"_key": pdf["_key"].to_list(), "_chunk": pdf["_chunk"].to_list(), "_first": first, "_from": begins, "_to": [*begins[1:], -1], "_alone": [t == 1 for t in times]})


#: Makes further columns of a slab's ids: (codec, ids, where each text's begin and end).
Finish = Callable[[Codec, np.ndarray, np.ndarray], list[pa.Array]]


def id_lists(codec: Codec, ids: np.ndarray, ends: np.ndarray) -> list[pa.Array]:
    return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))]


def _encoded(path: str, pattern: str, names: list[str], finish: Finish) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in slabs(batches, "_text", SLAB):
            keys = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keys), *finish(codec, *codec.encode(batch.column("_text").to_pylist()))], names=[*keys, *names])

    return encoded


def _long_ids(texts: DataFrame, path: str, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(_id, _ids) for each of the long ``texts``; only their chunks and the parts' ids are shuffled."""
    kind = texts.schema["_id"].dataType.simpleString()
    keyed = texts.withColumn("_key", F.monotonically_increasing_id())
    chunks = stored(cut(keyed, "_text", chunk, overlap).repartition("_key", "_chunk"), "bpe-chunks")
    ends = chunks.select("_key", "_chunk", "_chunks", "_start", "_text").mapInArrow(
        lambda b: _boundaries(b, path, pattern, chunk, overlap), "_key long, _chunk int, _chunks int, _left array<int>, _right array<int>"
    )
    spans = ends.groupBy("_key").applyInPandas(lambda pdf: _stitches(pdf, chunk), "_key long, _chunk int, _first int, _from int, _to int, _alone boolean")
    pieces = stored(chunks.join(spans, ["_key", "_chunk"]), "bpe-spans")
    begin = F.col("_from") - F.col("_start")
    length = F.when(F.col("_to") < 0, F.char_length("_text")).otherwise(F.col("_to") - F.col("_from"))
    alone = pieces.where("_alone").select("_id", "_key", F.col("_first").alias("_part"), F.substring("_text", begin + 1, length).alias("_text"))

    # Joined spans come with what follows them, to see that they do end where the next span begins.
    tail = F.when(F.col("_to") >= 0, F.substring(F.col("_text"), F.col("_to") - F.col("_start") + 1, F.char_length("_text"))).otherwise("")
    own = F.struct("_chunk", F.substring("_text", begin + 1, length).alias("t"), tail.alias("tail"))
    parts = pieces.where(~F.col("_alone")).groupBy("_key", "_first").agg(F.first("_id").alias("_id"), F.sort_array(F.collect_list(own)).alias("_own"))
    span = F.array_join(F.transform("_own", lambda x: x["t"]), "")
    parts = parts.select("_id", "_key", F.col("_first").alias("_part"), span.alias("_text"), F.element_at("_own", -1)["tail"].alias("_tail"))

    def ends_well(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            good = [not tail or len(text) in codec.ends(text + tail) for text, tail in zip(batch.column("_text").to_pylist(), batch.column("_tail").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(good, pa.bool_())], names=[*batch.schema.names, "_good"])

    spanned = stored(parts.mapInArrow(ends_well, f"_id {kind}, _key long, _part int, _text string, _tail string, _good boolean"), "bpe-joined")
    bad = spanned.where("not _good").select("_key").distinct()
    stitched = alone.unionByName(spanned.drop("_tail", "_good")).join(bad, "_key", "left_anti")
    core = F.substring("_text", F.col("_chunk") * chunk - F.col("_start") + 1, F.lit(chunk))
    again = pieces.join(bad, "_key", "left_semi").groupBy("_key").agg(F.first("_id").alias("_id"), F.sort_array(F.collect_list(F.struct("_chunk", core.alias("t")))).alias("_own"))
    again = again.select("_id", "_key", F.lit(0).alias("_part"), F.array_join(F.transform("_own", lambda x: x["t"]), "").alias("_text"))
    coded = stitched.select("_id", "_key", "_part", "_text").unionByName(again).mapInArrow(_encoded(path, pattern, ["_ids"], id_lists), f"_id {kind}, _key long, _part int, _ids array<int>")
    found = coded.groupBy("_key").agg(F.first("_id").alias("_id"), F.sort_array(F.collect_list(F.struct("_part", "_ids"))).alias("_parts"))
    return found.select("_id", F.flatten(F.col("_parts._ids")).alias("_ids"))


def encode_to(docs: DataFrame, path: str, pattern: str, finish: Finish, columns: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(_id, *columns): what ``finish`` makes of each text's ids, in the task that has them."""
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    schema, names = f"_id {kind}, {columns}", [c.split()[0] for c in columns.split(", ")]
    short = texts.where(~is_long(F.col("_text"), chunk)).mapInArrow(_encoded(path, pattern, names, finish), schema)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            lists = batch.column("_ids")
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *finish(codec, lists.flatten().to_numpy(), ends)], names=["_id", *names])

    long = _long_ids(texts.where(is_long(F.col("_text"), chunk)), path, pattern, chunk, overlap)
    return short.unionByName(long.mapInArrow(finished, schema))


def whole_ids(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(_id, _ids): each text's ids."""
    return encode_to(docs, path, pattern, id_lists, "_ids array<int>", id_col, text_col, chunk, overlap)


def decode(ids: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, raw): the bytes of each row of :func:`whole_ids`."""
    kind = ids.schema["_id"].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            lists = batch.column("_ids")
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), lists, codec.decode(lists.flatten().to_numpy(), ends)], names=[id_col, "ids", "raw"])

    return ids.mapInArrow(decoded, f"{id_col} {kind}, ids array<int>, raw binary")
