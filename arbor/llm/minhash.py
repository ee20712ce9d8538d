"""MinHash near-dedup by a signature-coordinate inverted join.

Equal shingle sets are folded into one class first, so copies are never paired. Each class
posts itself under (coordinate, value) for the first ``POSTED`` coordinates of its signature.
Two classes that agree in at least ``least`` of them share one of the
``POSTED - least + 1`` rarest of either (prefix merging), so only those are posted, and
of those only the ones that another class has too; the remaining coordinates aren't merged
but looked up (skip merging): a pair's collisions over all ``COORDINATES`` are counted, and
pairs above a match threshold are confirmed on the full sets.

Long lists aren't paired out. First each class meets one hub of each of its lists, and its
best match is confirmed: linear in the list. Where all of a list then is one component, the
list is done. In others, only the classes outside its main component meet its other members,
in blocks of ``BLOCK``, so that no task holds a whole list: first for their best match in the
main component, then, those that are still outside, for all others.

The thresholds (:func:`least_matches`) leave a link at exactly the wanted similarity 4.7
standard deviations of margin in the posted coordinates and 3.6 in all, so about 2.2 in 10,000 such single links (far
fewer above it) are lost; no cap is set on lists, candidates or rounds.

Defined results: null and empty texts have no shingles and are alone; texts of fewer words
than a shingle have one, all their words; rows that share an id are versions of one document,
which is linked if any version is, and they stay or go together; rows whose id is null are
never linked and stay, unless a row with an id has the same set, which then is their
component; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import slabs, stored, text_of, unused, words
from .components import components

COORDINATES, POSTED = 384, 96
SHINGLE, PERCENT = 3, 85
BLOCK = 1024
#: Distinct words whose hashes a worker remembers; then it forgets them all.
REMEMBERED = 400_000


def least_matches(coordinates: int, percent: int, deviations: float) -> int:
    """Collisions that pairs of the similarity ``percent`` have, but for the chance of so many standard deviations."""
    j = percent / 100
    return math.floor(coordinates * j - deviations * math.sqrt(coordinates * j * (1 - j)))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MULTIPLY[1]
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sets of shingle hashes, as a worker makes them."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.hashes = size, _Hashes()

    def sets(self, text: str | None) -> np.ndarray:
        """The sorted hashes of the distinct shingles."""
        if len(self.hashes) > REMEMBERED:
            self.hashes.clear()
        w = words(text)
        h = np.fromiter(map(self.hashes.__getitem__, w), np.uint64, len(w))
        n = min(self.size, len(h))
        if not n:
            return h
        with np.errstate(over="ignore"):
            out = np.zeros(len(h) - n + 1, np.uint64)
            for i in range(n):
                out = _mixed(out + h[i : len(h) - n + 1 + i] * _MULTIPLY[i % 5] + np.uint64(n))
        return np.unique(out)


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(29)
    return rng.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, count, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The minimum of each of COORDINATES hash functions (upper 32 bits)."""
    a, b = _factors(COORDINATES)
    low = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for lo in range(0, len(shingles), 128):
            np.minimum(low, (shingles[lo : lo + 128, None] * a + b).min(0), out=low)
    return (low >> np.uint64(32)).astype(np.uint32)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """(_id, _n, _set, _posts, _sig): set size, hash of the set, posted values, all values in 16 bits each."""
    kind = docs.schema["_id"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in slabs(batches, "_text"):
            n, sets, posts, sigs = [], [], [], []
            for text in batch.column("_text").to_pylist():
                s = shingler.sets(text)
                n.append(len(s))
                sets.append(xxhash.xxh128_digest(s.tobytes()) if len(s) else None)
                sig = signature(s) if len(s) else np.zeros(COORDINATES, np.uint32)
                posts.append(sig[:POSTED].astype("<u4").tobytes())
                sigs.append(sig.astype("<u2").tobytes())
            arrays = [pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(posts, pa.binary()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), *arrays], names=["_id", "_n", "_set", "_posts", "_sig"])

    return docs.select("_id", "_text").mapInArrow(made, f"_id {kind}, _n long, _set binary, _posts binary, _sig binary")


def _postings(classes: DataFrame, least: int) -> DataFrame:
    """(_token, _coord, _c, _n, _sig, _mask): each class under its rarest shared posted coordinates."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coords = np.arange(POSTED, dtype=np.int64) << 32
        for batch in batches:
            posts = [np.frombuffer(x, "<u4").astype(np.int64) | coords for x in batch.column("_posts").to_pylist()]
            flat = np.concatenate(posts) if posts else np.zeros(0, np.int64)
            owner = np.repeat(batch.column("_c").to_numpy(zero_copy_only=False), POSTED)
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(flat)], names=["_c", "_token"])

    posted = classes.select("_c", "_posts").mapInArrow(tokens, "_c long, _token long")
    shared = stored(posted.groupBy("_token").agg(F.count(F.lit(1)).alias("_times")).where("_times > 1"), "minhash-shared")
    own = Window.partitionBy("_c")
    found = posted.join(shared, "_token")
    # What only one class has comes first in the order of rarity and takes up places of the prefix.
    found = found.withColumn("_place", F.row_number().over(own.orderBy("_times", "_token")) + POSTED - F.count(F.lit(1)).over(own))
    prefix = found.where(F.col("_place") <= POSTED - least + 1).select("_c", "_token", "_times")
    return stored(prefix, "minhash-postings")


def _with_signatures(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """(_c, _m0, _m48, _n, _sig, _posts): each posted class with a bit mask of its prefix's coordinates."""
    bit = "if({lo} <= (_token >> 32) and (_token >> 32) < {lo} + 48, 1L << cast((_token >> 32) - {lo} as int), 0L)"
    masks = postings.groupBy("_c").agg(*[F.bit_or(F.expr(bit.format(lo=lo))).alias(f"_m{lo}") for lo in (0, 48)])
    return masks.join(classes.select("_c", "_n", "_sig", "_posts"), "_c")


def _matches(sig: np.ndarray, others: np.ndarray) -> np.ndarray:
    return (sig[None] == others).sum(1)


def _rows(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys, across batches."""
    every = (row for batch in batches for row in batch.to_pylist())
    for _, run in groupby(every, key=lambda r: tuple(r[k] for k in keys)):
        yield list(run)


def _sized(n: int, others: np.ndarray, percent: int) -> np.ndarray:
    """Whether set sizes allow the similarity."""
    return np.minimum(n, others) * 100 >= np.maximum(n, others) * percent


def _hub_pairs(lists: DataFrame, percent: int, least: int) -> DataFrame:
    """(a, b, m): in each block of a list, the members that match its hub (which differs from list to list)."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for run in _rows(batches, ["_token", "_block"]):
            if len(run) > 1:
                sig = np.frombuffer(b"".join(r["_sig"] for r in run), "<u2").reshape(len(run), -1)
                n = np.array([r["_n"] for r in run])
                m = _matches(sig[0], sig)
                good = np.flatnonzero((m >= least) & _sized(n[0], n, percent))
                out += [(run[i]["_c"], run[0]["_c"], int(m[i])) for i in good if i]
            if len(out) > 10_000:
                yield _pairs(out)
                out = []
        yield _pairs(out)

    dealt = lists.repartition("_token", "_block").sortWithinPartitions("_token", "_block", F.xxhash64("_c", "_token"))
    return dealt.select("_token", "_block", "_c", "_n", "_sig").mapInArrow(paired, "a long, b long, m int")


def _pairs(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
    a, b, m = zip(*out) if out else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m, pa.int32())], names=["a", "b", "m"])


def _cross_pairs(lists: DataFrame, percent: int, least: int, best: bool) -> DataFrame:
    """(a, b, m): in each block of a list, what its outsiders (probes) match in other components.

    With ``best``, only each outsider's best match in the main component. A pair that shares several lists is compared in the one of the first coordinate that both
    have in their prefixes, by the posted values of 32 bits, as lists are.
    """

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        bits = np.arange(48)
        for run in _rows(batches, ["_token", "_block"]):
            members = [r for r in run if not r["_probe"]]
            if not members:
                continue
            coord = run[0]["_token"] >> 32
            sig = np.frombuffer(b"".join(r["_sig"] for r in members), "<u2").reshape(len(members), -1)
            posts = np.frombuffer(b"".join(r["_posts"] for r in members), "<u4").reshape(len(members), -1)
            mask = np.concatenate([(np.array([r[k] for r in members])[:, None] >> bits & 1).astype(bool) for k in ("_m0", "_m48")], 1)
            n, comp, own = (np.array([r[k] for r in members]) for k in ("_n", "_comp", "_c"))
            outside = np.array([r["_outside"] for r in members])
            for p in (r for r in run if r["_probe"]):
                others = ~outside if best else (comp != p["_comp"]) & (~outside | (own > p["_c"]))
                able = np.flatnonzero(others & _sized(p["_n"], n, percent))
                if not len(able):
                    continue
                m = _matches(np.frombuffer(p["_sig"], "<u2"), sig[able])
                same = posts[able] == np.frombuffer(p["_posts"], "<u4")
                mine_mask = np.concatenate([p[k] >> bits & 1 for k in ("_m0", "_m48")]).astype(bool)
                first = (same & mask[able] & mine_mask).argmax(1) == coord
                good = np.flatnonzero((m >= least) & first)
                if best and len(good):
                    good = good[m[good].argmax()][None]
                out += [(p["_c"], int(own[able[i]]), int(m[i])) for i in good]
                if len(out) > 10_000:
                    yield _pairs(out)
                    out = []
        yield _pairs(out)

    dealt = lists.repartition("_token", "_block").sortWithinPartitions("_token", "_block")
    return dealt.mapInArrow(paired, "a long, b long, m int")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough; ``texts`` has (_c, _text)."""
    pairs = stored(pairs.select("a", "b"), "minhash-pairs")
    ends = stored(pairs.select(F.col("a").alias("_c")).distinct().union(pairs.select("b").distinct()).distinct(), "minhash-ends")

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in slabs(batches, "_text"):
            sets = [shingler.sets(t).tobytes() for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_c"), pa.array(sets, pa.binary())], names=["_c", "_members"])

    sets = stored(texts.join(ends, "_c", "left_semi").select("_c", "_text").mapInArrow(made, "_c long, _members binary"), "minhash-sets")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("_x"), batch.column("_y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                both = int((x[np.minimum(at, len(x) - 1)] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c, name: sets.select(F.col("_c").alias(c), F.col("_members").alias(name))
    joined = pairs.join(side("a", "_x"), "a").join(side("b", "_y"), "b")
    return joined.select("a", "b", "_x", "_y").mapInArrow(compared, "a long, b long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, links): (_id, _n, _c) for each document with its class (null without shingles), and (a, b) links between classes.

    Classes are numbered by the smallest id of their documents where ids are integers.
    """
    least = least_matches(COORDINATES, percent, 3.6)
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    signed = stored(_signed(texts, size), "minhash-signed")
    folded = signed.where("_n > 0").groupBy("_set").agg(F.min("_id").alias("_c"), F.first("_n").alias("_n"), F.first("_posts").alias("_posts"), F.first("_sig").alias("_sig"))
    classes = stored(folded.where("_c is not null"), "minhash-classes")
    members = signed.select("_id", "_n", "_set").join(classes.select("_set", "_c"), "_set", "left").select("_id", "_n", "_c")
    postings = _postings(classes, least_matches(POSTED, percent, 4.7))
    signatures = stored(_with_signatures(postings, classes), "minhash-prefixed")
    lists = postings.withColumn("_blocks", F.ceil(F.col("_times") / block))
    lists = lists.withColumn("_block", F.pmod(F.xxhash64("_c"), F.col("_blocks")))
    by_hub = _hub_pairs(lists.join(signatures, "_c"), percent, least)
    best = by_hub.groupBy("a").agg(F.max(F.struct("m", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    by_class = texts.select(F.col("_id").alias("_c"), "_text")
    links = stored(_confirmed(best, by_class, size, percent), "minhash-links")
    for best in (True, False):
        cross = _cross_pairs(_unsettled(postings, components(links), signatures, block), percent, least, best)
        if best:
            cross = cross.groupBy("a").agg(F.max(F.struct("m", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
        links = links.unionByName(stored(_confirmed(cross, by_class, size, percent), "minhash-links"))
    return members, links


def _unsettled(postings: DataFrame, comps: DataFrame, signatures: DataFrame, block: int) -> DataFrame:
    """The lists with more than one component, in blocks: their members, and as probes those outside the main component."""
    labelled = postings.join(comps, postings["_c"] == comps["v"], "left").select("_c", "_token", "_times", F.coalesce("comp", "_c").alias("_comp"))
    labelled = stored(labelled, "minhash-lists")
    sizes = labelled.groupBy("_token", "_comp").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("_token").agg(F.max(F.struct("k", "_comp"))["_comp"].alias("_main"), F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
    main = stored(main.select("_token", "_main"), "minhash-main")
    rest = labelled.join(main, "_token").withColumn("_outside", F.col("_comp") != F.col("_main"))
    rest = rest.withColumn("_blocks", F.ceil(F.col("_times") / block)).join(signatures, "_c")
    columns = ["_token", "_block", "_probe", "_outside", "_c", "_comp", "_n", "_sig", "_posts", "_m0", "_m48"]
    placed = rest.withColumn("_block", F.pmod(F.xxhash64("_c"), F.col("_blocks"))).withColumn("_probe", F.lit(False))
    probes = rest.where("_outside").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).withColumn("_probe", F.lit(True))
    return placed.select(columns).unionByName(probes.select(columns))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, component_id, kept."""
    members, links = near_classes(docs, id_col, text_col, **how)
    comps = components(stored(links, "minhash-all-links"))
    out = members.join(comps, members["_c"] == comps["v"], "left")
    comp = F.coalesce("comp", "_c", "_id")
    return out.select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), comp.alias("component_id"), F.col("_id").eqNullSafe(comp).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns."""
    name = unused("gone", docs.columns)
    gone = near_groups(docs, id_col, text_col, **how).where("not kept").select(F.col(id_col).alias(name)).distinct()
    return docs.join(gone, docs[id_col] == gone[name], "left_anti")
