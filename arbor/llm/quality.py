"""Quality classifier: logistic regression over hashed word n-grams, learned by FTRL-proximal.

A text's features are its single words and adjacent pairs, twice: as the words themselves
(A-Z lowered) and as their shapes (runs of capitals, small letters, digits and each sign;
a word equal to the one before has a shape of its own). Each is hashed into ``2**BITS``
buckets; a bucket's value is its share of the text's n-grams times ``SCALE``. One task learns
from a bounded sample of labelled rows (``SAMPLE``: the labelled ids of smallest hash, as far
as they have at most ``MOST`` distinct n-grams), one row after another; scores are sparse dot products, a whole batch of texts at a time.

Defined results: null and empty texts have no n-grams and get the bias's score; a document
without text can still be labelled; a label counts once for each id, the smallest one if they
differ, and null labels or ids are left out; without any labelled row every score is 0.5; rows
with the same id are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import slabs, text_of, unused

BITS = 18
SCALE = 16.0
#: Labelled rows to learn from, at most, and passes over them.
SAMPLE, EPOCHS = 16384, 3
#: Their texts' distinct n-grams, at most: eight bytes each in the one task that learns.
MOST = 50_000_000
#: Bytes of text whose n-grams are made together.
SLAB = 2 << 20
#: FTRL-proximal: step size, its offset, and the weights of the absolute and squared penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
#: A text is predicted good at this score.
THRESHOLD = 0.3
#: Distinct words whose hashes a task remembers; then it forgets them all.
REMEMBERED = 150_000
_SHAPES = bytes.maketrans(bytes(range(256)), bytes(
    0x41 if 0x41 <= b <= 0x5A else 0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256)
))


_RUN = re.compile(rb"(.)\1+", re.DOTALL)


class _Hashes(dict):
    """For each word the place of its (word hash, shape hash) in ``rows``.

    A shape has one byte for each run of capitals, small letters (or bytes of non-ASCII
    characters), digits or one sign.
    """

    def __init__(self) -> None:
        self.rows: list[tuple[int, int]] = []  # since the table was last made
        self.done = np.zeros((0, 2), np.uint64)
        self.shapes: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        kinds = word.translate(_SHAPES)
        look = self.shapes.get(kinds)
        if look is None:
            look = self.shapes[kinds] = xxhash.xxh64_intdigest(_RUN.sub(rb"\1", kinds), 1)
        self.rows.append((xxhash.xxh64_intdigest(word.lower()), look))
        return i

    def table(self) -> np.ndarray:
        if self.rows:
            self.done = np.concatenate([self.done, np.array(self.rows, np.uint64)])
            self.rows.clear()
        return self.done


_SAME = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xC2B2AE3D27D4EB4F)
_SHAPE_PAIR, _WORD_PAIR = np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5)


class Features:
    """Hashed n-grams of texts, as a worker makes them."""

    def __init__(self, bits: int = BITS):
        self.bits, self.hashes = bits, _Hashes()

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets of all texts' n-grams one after another, number of n-grams of each text)."""
        if len(self.hashes) > REMEMBERED:
            self.hashes = _Hashes()
        split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        n = np.array([len(w) for w in split], np.int64)
        total = int(n.sum())
        at = np.fromiter((i for w in split for i in map(self.hashes.__getitem__, w)), np.int64, total)
        table = self.hashes.table()
        word, look = table[at, 0], table[at, 1].copy()
        first = np.zeros(total, bool)
        first[(np.cumsum(n) - n)[n > 0]] = True
        same = np.zeros(total, bool)
        same[1:] = (word[1:] == word[:-1]) & ~first[1:]
        look[same] = _SAME
        pairs = ~first  # a pair ends at every word but a text's first
        before = np.flatnonzero(pairs) - 1
        shift = np.uint64(64 - self.bits)
        with np.errstate(over="ignore"):
            hashed = [word, look, (word[before] * _MIX + word[pairs]) * _WORD_PAIR, (look[before] * _MIX + look[pairs]) * _SHAPE_PAIR]
            buckets = [((h * _SAME) >> shift).astype(np.int64) for h in hashed]
        text = np.repeat(np.arange(len(n)), n)
        owner = np.concatenate([text, text, text[pairs], text[pairs]])
        order = np.argsort(owner, kind="stable")
        return np.concatenate(buckets)[order], 2 * n + 2 * np.maximum(n - 1, 0)


def dots(weights: np.ndarray, buckets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sparse dot product of each text's values with the weights, without the bias."""
    sums = np.concatenate([[0.0], np.cumsum(weights[buckets], dtype=np.float64)])
    ends = np.cumsum(sizes)
    return SCALE * (sums[ends] - sums[ends - sizes]) / np.maximum(sizes, 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


class Ftrl:
    """FTRL-proximal over hashed buckets; the last weight is the bias."""

    def __init__(self, bits: int = BITS):
        self.z, self.n = np.zeros(2**bits + 1), np.zeros(2**bits + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return -np.sign(z) * np.maximum(np.abs(z) - L1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def update(self, buckets: np.ndarray, times: np.ndarray, label: int) -> None:
        """Learn from a text's distinct buckets, with how often it has each."""
        at = np.append(buckets, len(self.z) - 1)
        x = np.append(SCALE * times / max(1, times.sum()), 1.0)
        w = self.weights(at)
        g = (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x))))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def fold(id_col: str, folds: int) -> Column:
    """The fold of a document by its id; -1 for a null id, which so is in none of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(-1).cast("long"))


def _learned(batches: Iterator[pa.RecordBatch], bits: int, epochs: int, most: int) -> Iterator[pa.RecordBatch]:
    features, rows, total = Features(bits), [], 0
    for batch in slabs(batches, "_text", SLAB):
        buckets, sizes = features.batch(batch.column("_text").to_pylist())
        keys = zip(batch.column("_order").to_pylist(), batch.column("_id").to_pylist(), batch.column("_label").to_pylist())
        for (order, doc, label), own in zip(keys, np.split(buckets, np.cumsum(sizes)[:-1])):
            at, times = np.unique(own, return_counts=True)
            # The largest order is on top, to go when there is too much.
            heapq.heappush(rows, (-order, len(own), str(doc), label, at.astype(np.int32).tobytes(), times.astype(np.int32).tobytes()))
            total += len(at)
            while total > most and len(rows) > 1:
                total -= len(heapq.heappop(rows)[4]) // 4
    rows.sort(key=lambda r: (-r[0], r[2], r[1]))
    model = Ftrl(bits)
    for _ in range(epochs if rows else 0):
        for *_, label, at, times in rows:
            model.update(np.frombuffer(at, np.int32), np.frombuffer(times, np.int32), label)
    yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype(np.float32).tobytes()])], names=["weights"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, most: int = MOST, bits: int = BITS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights from at most ``sample`` of the ``labels`` (which the caller has restricted to those to learn from).

    Of these, as many in order of hash as together have at most ``most`` distinct n-grams are learned from.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(label_col).cast("int")).alias("_label"))
    taken = known.withColumn("_order", F.xxhash64("_id")).orderBy("_order", "_id").limit(sample)
    # At most ``sample`` rows of three numbers: small enough to broadcast at any input size.
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(taken), "_id")
    one = texts.groupBy("_id").agg(F.min(F.struct("_order", "_label", "_text")).alias("_x")).select("_id", "_x.*")
    learned = one.coalesce(1).mapInArrow(lambda b: _learned(b, bits, epochs, most), "weights binary")
    found = learned.collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros(2**bits + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """The columns ``keep`` (the id if None) and ``score_col``, 0 to 1, for each row. A text that is kept too is sent once."""
    held = docs.sparkSession.sparkContext.broadcast(weights)  # 1 MB at 18 bits
    names = [id_col] if keep is None else keep
    schema = docs.select([f"`{c}`" for c in names]).schema.add(score_col, "double")
    bits = int(math.log2(len(weights) - 1))
    own = names.index(text_col) if text_col in names and isinstance(docs.schema[text_col].dataType, StringType) else len(names)
    sent = [F.col(f"`{c}`") for c in names] + ([] if own < len(names) else [text_of(text_col).alias(unused("text", names))])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, w = Features(bits), held.value.astype(np.float64)
        for batch in slabs(batches, own, SLAB):
            x = dots(w, *features.batch(batch.column(own).to_pylist())) + w[-1]
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sigmoid(x))], names=[*names, score_col])

    return docs.select(*sent).mapInArrow(scored, schema)


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns."""
    weights = learn(docs, labels, id_col, text_col, **how)
    name = unused("score", docs.columns)
    out = score(docs, weights, id_col, text_col, keep=docs.columns, score_col=name)
    return out.where(F.col(name) >= threshold).drop(name)
