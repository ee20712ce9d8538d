"""LM scoring with a log-bilinear model, trained in numpy by noise-contrastive estimation.

Tokens are words between ASCII white space (A-Z lowered) and one end for each text. The model
works on ``CLASSES`` classes: the end, the most frequent training words one by one, and the
other words in ``RARE`` classes by their last two bytes. The two preceding classes predict the
next: the prediction is the sum of their vectors, each scaled by a vector for its place, and
a class's score is its product with the class's own vector plus a bias. Within a class of
rare words a word has probability (c+1) / (tokens + words + 1) of its class, where the one
extra slot is that of words never seen, so the model is normalised over all texts.

On Spark: words are counted over all training texts; each task trains on all of its training
texts from the same start and the parameters are averaged, weighted by tokens; the scores'
normalisers for all pairs of classes are batched matrix products, dealt out by first class.
Counts of frequent words (at most ``HEAD``, of at most ``WORD_BYTES`` bytes each) are broadcast;
the rest of a text's words meet their counts in a join by word.

Defined results: null and empty texts are one end token; without training texts N is 0 and
every score is that of equal counts; rows with the same id are scored one by one; a null id
is never held out; an empty table gives an empty result; only the id and text are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slabs, stored, text_of, words

CLASSES, RARE, DIM = 1024, 64, 24
END = 0
#: Words whose counts are broadcast, at most, and the length of each.
HEAD, WORD_BYTES = 1 << 19, 64
#: Trigrams of a training step, noise samples shared by a step, step size, passes over a task's texts.
BATCH, NOISE, RATE, PASSES = 4096, 64, 0.2, 1


def rare_class(word: bytes) -> int:
    return CLASSES - RARE + zlib.crc32(word[-2:]) % RARE


class _Classes(dict):
    """The class of each word: words that aren't known one by one go by their last two bytes."""

    def __missing__(self, word: bytes) -> int:
        found = rare_class(word)
        if len(self) < 500_000:
            self[word] = found
        return found


class Model(NamedTuple):
    """Vectors of classes as context (scaled by place) and as target, and biases."""

    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    place: np.ndarray

    @classmethod
    def start(cls, unigram: np.ndarray) -> Model:
        rng = np.random.default_rng(5)
        small = lambda: rng.normal(0, 0.1, (len(unigram), DIM)).astype(np.float32)
        return cls(small(), small(), np.log(unigram).astype(np.float32), np.array([[1.0], [0.5]], np.float32) * np.ones((2, DIM), np.float32))

    def predicted(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The prediction after classes ``second``, ``first`` (the nearer one)."""
        return self.context[first] * self.place[0] + self.context[second] * self.place[1]

    def normalisers(self, first: int) -> np.ndarray:
        """log of the summed exponentials of all classes' scores after (each class, ``first``)."""
        every = np.arange(len(self.bias))
        scores = self.predicted(np.full(len(every), first), every) @ self.target.T + self.bias
        top = scores.max(1)
        return top + np.log(np.exp(scores - top[:, None]).sum(1))

    def flat(self) -> np.ndarray:
        """One row for each class, and one for the places."""
        rows = np.concatenate([self.context, self.target, self.bias[:, None]], 1)
        return np.concatenate([rows, np.concatenate([self.place.ravel(), [0.0]])[None]])

    @classmethod
    def unflat(cls, rows: np.ndarray) -> Model:
        rows = rows.astype(np.float32)
        return cls(rows[:-1, :DIM].copy(), rows[:-1, DIM : 2 * DIM].copy(), rows[:-1, -1].copy(), rows[-1, :-1].reshape(2, DIM).copy())


def _add(sums: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add each row to the one of ``sums`` that ``at`` names."""
    order = np.argsort(at, kind="stable")
    at = at[order]
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    sums[at[starts]] += np.add.reduceat(rows[order], starts, axis=0)


class Trainer:
    """Noise-contrastive estimation with Adagrad steps; the model's normaliser is taken as 1, which it learns."""

    def __init__(self, model: Model, unigram: np.ndarray):
        self.model = Model(*(p.copy() for p in model))
        self.squares = [np.full_like(p, 0.1) for p in self.model]
        self.cumulative = np.cumsum(unigram)
        self.log_noise = np.log(NOISE * unigram).astype(np.float32)
        self.rng, self.tokens = np.random.default_rng(11), 0

    def texts(self, classes: list[np.ndarray]) -> None:
        """Learn from texts given as classes with their ends: equal trigrams count together."""
        after = np.concatenate(classes).astype(np.int64)
        starts = np.cumsum([0, *map(len, classes[:-1])])
        one, two = np.roll(after, 1), np.roll(after, 2)
        one[starts] = two[starts] = END
        two[(starts + 1)[np.array([len(c) for c in classes]) > 1]] = END
        keys, times = np.unique((two << 40) | (one << 20) | after, return_counts=True)
        order = self.rng.permutation(len(keys))
        keys, times = keys[order], times[order].astype(np.float32)
        mask = (1 << 20) - 1
        for _ in range(PASSES):
            for lo in range(0, len(keys), BATCH):
                k = keys[lo : lo + BATCH]
                self.step(k >> 20 & mask, k >> 40, k & mask, times[lo : lo + BATCH])
        self.tokens += len(after)

    def step(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, times: np.ndarray) -> None:
        m = self.model
        noise = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), len(self.cumulative) - 1)
        q = m.predicted(one, two)
        weight = times / times.sum()
        real = np.einsum("ij,ij->i", q, m.target[word]) + m.bias[word] - self.log_noise[word]
        fake = q @ m.target[noise].T + (m.bias[noise] - self.log_noise[noise])
        up = weight / (1 + np.exp(np.clip(real, -30, 30)))
        down = weight[:, None] / (1 + np.exp(-np.clip(fake, -30, 30)))
        dq = up[:, None] * m.target[word] - down @ m.target[noise]
        grads = [np.zeros_like(p) for p in m]
        _add(grads[1], word, up[:, None] * q)
        np.add.at(grads[1], noise, -(down.T @ q))
        _add(grads[2], word, up)
        np.add.at(grads[2], noise, -down.sum(0))
        _add(grads[0], one, dq * m.place[0])
        _add(grads[0], two, dq * m.place[1])
        grads[3][0] = (dq * m.context[one]).sum(0)
        grads[3][1] = (dq * m.context[two]).sum(0)
        for p, g, s in zip(m, grads, self.squares):
            g *= np.float32(len(word) / 64)  # a step's mean is over many rows: scaled to the start of the squares
            s += g * g
            p += np.float32(RATE) * g / np.sqrt(s)


# -- on Spark ---------------------------------------------------------------------------


class Corpus(NamedTuple):
    """What the training texts are counted into. ``counts`` has all words; the rest is bounded."""

    counts: DataFrame
    tokens: int
    types: int
    ends: int
    least: int
    head: dict[bytes, int]
    rare: dict[int, tuple[int, int]]


def _word_counts(texts: DataFrame) -> DataFrame:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches, "_text"):
            found = Counter(chain.from_iterable(map(words, batch.column("_text").to_pylist())))
            for lo in range(0, len(found), 50_000):
                part = slice(lo, lo + 50_000)
                yield pa.RecordBatch.from_arrays([pa.array([*found][part], pa.binary()), pa.array([*found.values()][part], pa.int64())], names=["_word", "_n"])

    return texts.select("_text").mapInArrow(counted, "_word binary, _n long").groupBy("_word").agg(F.sum("_n").alias("_n"))


def count_corpus(texts: DataFrame, head: int = HEAD) -> Corpus:
    """Count the words of ``texts`` (_text)."""
    counts = stored(_word_counts(texts), "lm-counts")
    ends = texts.count()
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    # The least count of a word in the head: from how many words have each count, most first.
    short = F.octet_length("_word") <= WORD_BYTES
    least, room = 1, head
    by_count = counts.where(short).groupBy(F.least(F.col("_n"), F.lit(1 << 16)).alias("n")).agg(F.count(F.lit(1)).alias("k"))
    for n, k in by_count.orderBy(F.desc("n")).collect():  # 65,536 rows at most
        if k > room:
            least = n + 1
            break
        room -= k
    rows = counts.where(short & (F.col("_n") >= least)).toArrow()  # head rows at most
    ordered = sorted(zip(rows.column("_n").to_pylist(), rows.column("_word").to_pylist()), key=lambda x: (-x[0], x[1]))
    known = {w: n for n, w in ordered}
    del rows, ordered
    own = list(islice(known, CLASSES - RARE - 1))
    suffix = F.crc32(F.substring("_word", -2, 2)) % RARE + (CLASSES - RARE)
    sums = counts.where(~(short & (F.col("_n") >= least))).groupBy(suffix.alias("g")).agg(F.sum("_n"), F.count(F.lit(1))).collect()  # RARE rows
    rare = {g: [0, 0] for g in range(CLASSES - RARE, CLASSES)}
    for g, n, k in sums:
        rare[g][0] += n
        rare[g][1] += k
    for w in islice(known, len(own), None):
        g = rare_class(w)
        rare[g][0] += known[w]
        rare[g][1] += 1
    return Corpus(counts, total[0] + ends, total[1] + (ends > 0), ends, least, known, {g: tuple(v) for g, v in rare.items()})


def own_classes(corpus: Corpus) -> _Classes:
    out = _Classes()
    for i, w in enumerate(corpus.head):
        if i == CLASSES - RARE - 1:
            break
        out[w] = i + 1
    return out


def unigram(corpus: Corpus) -> np.ndarray:
    """Smoothed class probabilities: the start of training, and its noise."""
    n = np.ones(CLASSES)
    n[END] += corpus.ends
    for i, c in enumerate(list(corpus.head.values())[: CLASSES - RARE - 1]):
        n[i + 1] += c
    for g, (c, _) in corpus.rare.items():
        n[g] += c
    return n / n.sum()


def train(texts: DataFrame, corpus: Corpus) -> Model:
    """Train on each task's share of ``texts`` (_text) and average, weighted by tokens."""
    spark = texts.sparkSession
    noise = unigram(corpus)
    start = Model.start(noise)
    held = spark.sparkContext.broadcast((dict(own_classes(corpus)), noise, start))
    width = 2 * DIM + 1

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, noise, start = held.value
        classes, trainer = _Classes(known), Trainer(start, noise)
        for batch in slabs(batches, "_text"):
            found = []
            for text in batch.column("_text").to_pylist():
                w = words(text)
                found.append(np.append(np.fromiter(map(classes.__getitem__, w), np.int32, len(w)), END))
            if found:
                trainer.texts(found)
        if trainer.tokens:
            rows = trainer.model.flat().astype(np.float64)
            n = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n), pa.int32()), pa.array([float(trainer.tokens)] * n), pa.array(list(rows), pa.list_(pa.float64()))], names=["_row", "_weight", "_values"]
            )

    parts = texts.select("_text").mapInArrow(trained, "_row int, _weight double, _values array<double>")
    sums = [F.sum(F.col("_weight") * F.col("_values")[i]).alias(f"v{i}") for i in range(width)]
    rows = parts.groupBy("_row").agg(F.sum("_weight").alias("_weight"), *sums).collect()  # one for each class
    if not rows:
        return start
    out = start.flat().astype(np.float64)
    for row in rows:
        out[row[0]] = np.array(row[2:]) / row[1]
    return Model.unflat(out)


def normalisers(model: Model, spark) -> np.ndarray:
    """log Z after each pair (nearer class, class before it)."""
    held = spark.sparkContext.broadcast(model)

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(0).to_pylist()
            z = [held.value.normalisers(i).astype(np.float32).tobytes() for i in first]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], names=["_first", "_z"])

    rows = spark.range(len(model.bias), numPartitions=16).mapInArrow(solved, "_first long, _z binary").collect()  # CLASSES squared floats
    return np.stack([np.frombuffer(z, np.float32) for _, z in sorted((r[0], bytes(r[1])) for r in rows)])


def _scored(docs: DataFrame, corpus: Corpus, model: Model) -> DataFrame:
    """For each row what the head and the model give, and the words whose counts are still to be joined."""
    spark = docs.sparkSession
    words_in_head = list(corpus.head)
    logs = np.log10(np.array([*corpus.head.values(), 0], np.float64) + 1)
    slots = {g: np.log10(n + k + 1) for g, (n, k) in corpus.rare.items()}
    held = spark.sparkContext.broadcast((words_in_head, logs, slots, model, normalisers(model, spark), corpus.ends))
    kind = docs.schema["_id"].dataType.simpleString()
    own = CLASSES - RARE - 1

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, logs, slots, model, z, ends = held.value
        at_word = dict(zip(head, range(len(head))))
        suffixes = _Classes()
        class_of = np.array([i + 1 if i < own else rare_class(w) for i, w in enumerate(head)] + [0], np.int64)
        slot = np.zeros(CLASSES)
        for g, v in slots.items():
            slot[g] = v
        for batch in slabs(batches, "_text", 4 << 20):
            split = [words(t) for t in batch.column("_text").to_pylist()]
            n = np.array([len(w) + 1 for w in split], np.int64)
            at = np.fromiter(chain.from_iterable(chain(map(at_word.get, w, repeat(-1)), (-2,)) for w in split), np.int64, int(n.sum()))
            last = np.cumsum(n)
            tails, cls = [], class_of[at]
            is_end, unknown = at == -2, at == -1
            cls[is_end] = END
            missing = np.flatnonzero(unknown)
            if len(missing):
                text = np.searchsorted(last, missing, side="right")
                place = missing - (last - n)[text]
                tail = [split[t][p] for t, p in zip(text.tolist(), place.tolist())]
                cls[missing] = [suffixes[w[-2:]] for w in tail]
                tails = np.split(np.array(tail, object), np.searchsorted(text, np.arange(1, len(split))))
            one, two = np.roll(cls, 1), np.roll(cls, 2)
            starts = last - n
            one[starts] = two[starts] = END
            two[(starts + 1)[n > 1]] = END
            value = np.zeros(len(cls))
            for lo in range(0, len(cls), 1 << 18):
                s = slice(lo, lo + (1 << 18))
                value[s] = np.einsum("ij,ij->i", model.predicted(one[s], two[s]), model.target[cls[s]]) + model.bias[cls[s]]
            value = (value - z[one, two]) / np.log(10) - slot[cls]
            base = np.where(is_end, np.log10(ends + 1), np.where(unknown, 0.0, logs[at]))
            rare = np.where(cls >= CLASSES - RARE, np.where(unknown, 0.0, logs[at]), 0.0)
            sums = [np.add.reduceat(v, starts) if len(starts) else v[:0] for v in (base, value + rare, (~unknown & (~is_end | (ends > 0))).astype(np.int64))]
            folded = [Counter(t.tolist()) for t in tails] if len(missing) else [{}] * len(split)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("_id", "_key")), pa.array(n), *map(pa.array, sums),
                 pa.array([list(c) for c in folded], pa.list_(pa.binary())), pa.array([list(c.values()) for c in folded], pa.list_(pa.int32()))],
                names=["_id", "_key", "n_tokens", "_base", "_score", "_known", "_words", "_times"],
            )

    return docs.select("_id", "_key", "_text").mapInArrow(scored, f"_id {kind}, _key long, n_tokens long, _base double, _score double, _known long, _words array<binary>, _times array<int>")


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """Train on the rows that aren't ``held_out``; one row for each row of ``docs``."""
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), F.coalesce(held_out, F.lit(False)).alias("_held"))
    training = texts.where(~F.col("_held"))
    corpus = count_corpus(training, head)
    model = train(training, corpus)
    kept = texts.withColumn("_key", F.monotonically_increasing_id())
    scored = stored(_scored(kept, corpus, model), "lm-scored")
    tail = scored.where(F.size("_words") > 0).select("_key", F.explode(F.arrays_zip("_words", "_times")).alias("x"))
    tail = tail.select("_key", F.col("x._words").alias("_word"), F.col("x._times").alias("_times"))
    log = F.log10(F.coalesce(F.col("_n"), F.lit(0)) + 1)
    joined = tail.join(corpus.counts.where((F.col("_n") < corpus.least) | (F.octet_length("_word") > WORD_BYTES)), "_word", "left")
    rest = joined.groupBy("_key").agg(
        F.sum(F.col("_times") * log).alias("_log"), F.sum(F.when(F.col("_n") > 0, F.col("_times")).otherwise(0)).alias("_seen")
    )
    out = scored.drop("_words", "_times").join(rest, "_key", "left")
    log, seen = F.coalesce("_log", F.lit(0.0)), F.coalesce("_seen", F.lit(0))
    floor = float(np.log10(corpus.tokens + corpus.types + 1))
    return out.select(
        F.col("_id").alias(id_col), "n_tokens", (F.col("_known") + seen).alias("n_known"), F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + log - F.col("n_tokens") * floor).alias("base_score"), (F.col("_score") + log).alias("score"),
    )
