"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its distinct lower-cased words. A line is removed if an earlier one (by
document id, then line number) has a Jaccard similarity of at least ``PERCENT`` to it.

Texts are split once; the lines' sets are stored. Equal sets are folded into a class, with its
earliest line. Words are ordered by rarity: by how many lines have a word of their hash bucket,
then by hash, which is one total order for all lines. Of two similar sets, a prefix of the
longer one (as long as the threshold allows) and a shorter prefix of the other share a word in
that order, so classes are posted under their prefixes' words and joined on them, under
conditions that the pair's first common word always meets: the length filter, the positional
filter (what can still be shared from that word on) and a bound from the differing bits of
parity sketches, finer ones for long lines, whose words would fill a sketch of 64 bits.
Candidates are verified on the full sets.

Long lists (found by counting those of every ``SAMPLED``-th class, which decides only how the
work is done) are different: there each class first meets only the earliest class of its lists
(linear in a list's length), and what is settled by that doesn't look for an earlier line in
them again, so most near copies are never paired with each other.

Defined results: null and empty texts have one line without words; lines without words always
stay; lines too short for another set to be similar enough (up to three words at 80 %) only
match equal sets; rows that share an id are read as one document, of which equal line numbers
stay or go together; a null id sorts first; an empty table gives an empty result; only the id
and text columns are read. Words are told apart by 56 bits of their hash; lists go by 31 of
them, so two words may share a list, which only adds candidates.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import filters
from .common import SPACE, stored, text_of

PERCENT = 80
#: Hash buckets in which words are counted; a number for each is all that tasks get of the counts.
BUCKETS, BLOCK = 1 << 18, 1 << 10
#: Classes of a long list, about, and the share of classes by which long lists are found.
LONG, SAMPLED = 512, 16
#: Sets of more words have a second sketch that splits cells of the first, of so many bits at most.
FINE, SPLIT = 72, 32


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_doc, _line, _set) for each line with words: hashes of its distinct words."""
    text = F.lower(text_of(text_col))
    for space in "\t\x0b\x0c\r":  # one character to split at takes no regular expression
        text = F.replace(text, F.lit(space), F.lit(" "))
    out = docs.select(F.col(id_col).alias("_doc"), F.posexplode(F.split(text, "\n")).alias("_line", "_text")).where(F.trim("_text") != "")
    words = F.transform(F.split("_text", " "), lambda w: F.xxhash64(w))
    return out.select("_doc", "_line", F.array_remove(F.array_distinct(words), F.xxhash64(F.lit(""))).alias("_set"))


def _bucket(word: Column) -> Column:
    return word.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def rarity(lines: DataFrame) -> list[int]:
    """For each bucket a level that grows with the logarithm of how many lines have a word of it.

    BUCKETS letters reach the driver and BUCKETS numbers go back, whatever the input's size.
    """
    found = lines.select(F.explode("_set").alias("w")).select(_bucket(F.col("w")).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    every = lines.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("b"), F.lit(0).cast("long").alias("n"))
    level = F.when(F.col("n") > 0, F.floor(2 * F.log2("n")).cast("int") + 1).otherwise(0)
    each = found.unionByName(every).groupBy("b").agg(F.max("n").alias("n")).select("b", level.alias("level"))
    blocks = each.groupBy(F.floor(F.col("b") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("b", "level"))).alias("x"))
    rows = blocks.select("block", F.array_join(F.transform("x", lambda x: F.char(x["level"] + 33)), "").alias("levels")).collect()
    return [ord(c) - 33 for r in sorted(rows, key=lambda r: r.block) for c in r.levels]


def _classes(lines: DataFrame, levels: list[int], percent: int) -> DataFrame:
    """(_doc, _line, _n, _sketch, _fine, _prefix) for each set of words: its earliest line, size, sketches and rarest words.

    A word is its bucket's level and 56 bits of its hash in one number, so that numbers sort by rarity.
    """
    table = F.split(F.lit(",".join(map(str, levels))), ",").cast("array<bigint>")  # folded to a constant when the query is planned
    ranked = lambda w: F.coalesce(F.shiftleft(F.get(table, _bucket(w)), 56).bitwiseOR(w.bitwiseAND(F.lit((1 << 56) - 1))), F.lit(0).cast("long"))
    rows = lines.select(F.struct("_doc", "_line").alias("_at"), F.sort_array(F.transform("_set", ranked)).alias("_set"))
    size = F.size("_set")
    key = F.struct(F.xxhash64("_set").alias("a"), F.xxhash64(F.lit(1), "_set").alias("b"), size.alias("n"))
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(w, 24).bitwiseAND(F.lit(63)).cast("int"))
    parity = F.aggregate("_set", F.lit(0).cast("long"), lambda x, w: x.bitwiseXOR(bit(w)))
    # Of the words of a cell those of one half, by another bit: with them a cell of the first sketch is two.
    half = lambda w: F.call_function("shiftleft", F.shiftrightunsigned(w, 30).bitwiseAND(F.lit(1)), F.shiftrightunsigned(w, 24).bitwiseAND(F.lit(63)).cast("int"))
    fine = F.when(size > FINE, F.aggregate("_set", F.lit(0).cast("long"), lambda x, w: x.bitwiseXOR(half(w)))).otherwise(0)
    prefix = F.slice("_set", 1, size - F.ceil(size * percent / 100).cast("int") + 1)
    prefix = F.transform(prefix, lambda w: w.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))
    rows = rows.select("_at", key.alias("_key"), parity.alias("_sketch"), fine.bitwiseAND(F.lit((1 << SPLIT) - 1)).alias("_fine"), prefix.alias("_prefix"))
    out = rows.groupBy("_key").agg(F.min("_at").alias("_at"), F.first("_sketch").alias("_sketch"), F.first("_fine").alias("_fine"), F.first("_prefix").alias("_prefix"))
    return out.select("_at._doc", "_at._line", F.col("_key.n").alias("_n"), "_sketch", "_fine", "_prefix")


class Layout(NamedTuple):
    """How a posting's _place holds in one number: size, place in the set, line (if ``line`` bits are left), and whether it doesn't look; above, ``fine`` bits of the second sketch."""

    place: int
    line: int
    fine: int

    @classmethod
    def of(cls, classes: DataFrame) -> Layout:
        most = classes.agg(F.max("_n"), F.max("_line")).first()
        size, line = ((x or 0).bit_length() for x in most)
        line = line if 2 * size + line < 62 else 0
        return cls(size, line, max(0, min(SPLIT, 62 - 2 * size - line)))

    @property
    def columns(self) -> list[str]:
        """Besides _word and _doc."""
        return ["_place", "_sketch"] + ([] if self.line else ["_line"])

    def pack(self, n: Column, pos: Column, line: Column, fine: Column) -> Column:
        fine = F.shiftleft(fine.bitwiseAND(F.lit((1 << self.fine) - 1)), 2 * self.place + self.line + 1)
        out = F.shiftleft(n.cast("long"), self.place).bitwiseOR(pos.cast("long"))
        return F.shiftleft(F.shiftleft(out, self.line).bitwiseOR(line.cast("long")) if self.line else out, 1).bitwiseOR(fine)

    def size_and_place(self, side: str) -> tuple[Column, Column]:
        at = F.shiftright(F.col(f"{side}._place"), self.line + 1)
        return F.shiftright(at, self.place).bitwiseAND(F.lit((1 << self.place) - 1)), at.bitwiseAND(F.lit((1 << self.place) - 1))

    def first(self, side: str) -> Column:
        """The line of a side, in order of lines."""
        packed = F.shiftright(F.col(f"{side}._place"), 1).bitwiseAND(F.lit((1 << self.line) - 1)).cast("int")
        return F.struct(F.col(f"{side}._doc").alias("_doc"), (packed if self.line else F.col(f"{side}._line")).alias("_line"))

    def differing(self) -> Column:
        """In how many cells of their sketches two sets a and b differ, which is in no more than they differ in words."""
        bits = F.col("a._sketch").bitwiseXOR(F.col("b._sketch"))
        fine = F.shiftright(F.col("a._place").bitwiseXOR(F.col("b._place")), 2 * self.place + self.line + 1)
        both = F.least(self.size_and_place("a")[0], self.size_and_place("b")[0]) > FINE
        return F.when(both, F.bit_count(fine) + F.bit_count(bits.bitwiseXOR(fine))).otherwise(F.bit_count(bits)) if self.fine else F.bit_count(bits)

    def looks(self, side: str) -> Column:
        """Whether the class of a side looks for an earlier line."""
        return F.col(f"{side}._place").bitwiseAND(F.lit(1)) == 0


def _postings(classes: DataFrame, layout: Layout, percent: int, *more: str) -> DataFrame:
    """Each class under the words of its prefix, but for sets so small that no other set can be similar enough."""
    able = classes.where(F.col("_n") * 100 >= (F.col("_n") + 1) * percent)
    posted = able.select("_doc", "_line", "_n", "_sketch", "_fine", *more, F.posexplode("_prefix").alias("_pos", "_word"))
    return posted.withColumn("_place", layout.pack(F.col("_n"), F.col("_pos"), F.col("_line"), F.col("_fine"))).select("_word", "_doc", *layout.columns, *more)


def _able(layout: Layout, percent: int) -> Column:
    """What holds for two sets a and b that reach the threshold at the first word that they share.

    They have to share ``(an + bn) * percent / (100 + percent)`` words; all is in whole numbers, as it is asked of every pair that meets.
    """
    (an, ap), (bn, bp) = layout.size_and_place("a"), layout.size_and_place("b")
    need, whole = (an + bn) * percent, 100 + percent
    left = ((an - ap) * whole >= need) & ((bn - bp) * whole >= need)
    return (an * 100 >= bn * percent) & (bn * 100 >= an * percent) & left & (F.shiftright(an + bn - layout.differing(), 1) * whole >= need)


def _parities() -> list[Column]:
    """Four sketches of a set, of the words that fall to each: the bits in which two sets differ show as many other words."""
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(w, 40).bitwiseAND(F.lit(63)).cast("int"))
    part = lambda i: lambda x, w: F.when(F.shiftrightunsigned(w, 46).bitwiseAND(F.lit(3)) == i, x.bitwiseXOR(bit(w))).otherwise(x)
    return [F.aggregate("_set", F.lit(0).cast("long"), part(i)) for i in range(4)]


def _near(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(_at, _set, _n, _s0 ... _s3) of the lines of ``pairs`` (a, b), a stored table, and of few others."""
    sets = lines.select(F.struct("_doc", "_line").alias("_at"), "_set", F.xxhash64("_doc", "_line").alias("_h"))
    ends = pairs.select(F.xxhash64("a._doc", "a._line").alias("_h")).union(pairs.select(F.xxhash64("b._doc", "b._line")))
    ends = stored(ends.distinct(), "lines-ends")
    blocks = filters.blocks_for(ends.count())
    if filters.broadcastable(blocks):  # else all sets meet the pairs
        sets = filters.passing(sets, stored(filters.cells_hit(ends, blocks), "lines-cells"), blocks)
    return stored(sets.select("_at", "_set", F.size("_set").alias("_n"), *[x.alias(f"_s{i}") for i, x in enumerate(_parities())]), "lines-near")


def _met(pairs: DataFrame, near: DataFrame, *columns: str) -> DataFrame:
    """The pairs with these columns of either end, as _a and _b."""
    side = lambda end: near.select(F.col("_at").alias(end), F.struct(*columns).alias(f"_{end}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")


def _least(percent: int) -> Column:
    """How many words the two sets of a pair have to share."""
    return F.ceil((F.col("_a._n") + F.col("_b._n")) * percent / (100 + percent))


def _similar(pairs: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """(a) of the pairs whose full sets are similar enough."""
    both = F.size(F.array_intersect("_a._set", "_b._set"))
    return stored(_met(pairs, near, "_n", "_set").where(both >= _least(percent)).select("a").distinct(), "lines-similar")


def _sifted(pairs: DataFrame, near: DataFrame, percent: int) -> DataFrame:
    """The pairs that can be similar enough by sketches of 256 bits, so that sets are sent for few others."""
    names = [f"_s{i}" for i in range(4)]
    differing = sum((F.bit_count(F.col(f"_a.{s}").bitwiseXOR(F.col(f"_b.{s}"))) for s in names), F.lit(0))
    able = F.col("_a._n") + F.col("_b._n") - differing >= 2 * _least(percent)
    return stored(_met(pairs, near, "_n", *names).where(able).select("a", "b").distinct(), "lines-sifted")


def _verified(pairs: DataFrame, lines: DataFrame, percent: int) -> DataFrame:
    """(a) of the pairs (a, b, d) of lines whose full sets are similar enough.

    A line is asked about once: first each one's likeliest partner is compared (of least d), then
    all others of those lines that this doesn't settle; so of a group of near copies one pair
    of each is compared.
    """
    pairs = stored(pairs.groupBy("a", "b").agg(F.min("d").alias("d")), "lines-pairs")
    near = _near(pairs, lines)
    best = pairs.groupBy("a").agg(F.min(F.struct("d", "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    found = _similar(best, near, percent)
    rest = stored(pairs.select("a", "b").join(found, "a", "left_anti"), "lines-rest")
    return found if rest.isEmpty() else found.unionByName(_similar(_sifted(rest, near, percent), near, percent))


def _long_lists(classes: DataFrame, layout: Layout, percent: int) -> DataFrame:
    """(_word) of the long lists."""
    some = classes.where(F.pmod(F.xxhash64("_doc", "_line"), F.lit(SAMPLED)) == 0)
    return _postings(some, layout, percent).groupBy("_word").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") * SAMPLED >= LONG).select("_word")


def _settled(hot: DataFrame, lines: DataFrame, layout: Layout, percent: int) -> DataFrame:
    """(a): classes in long lists that are similar to the earliest one of one of them."""
    earliest = F.min(F.struct(layout.first("p").alias("_first"), *[F.col(f"p.{c}") for c in ("_doc", *layout.columns)])).alias("h")
    hubs = hot.alias("p").groupBy("_word").agg(earliest).select("_word", "h.*").drop("_first")
    near = hot.alias("a").join(hubs.alias("b"), (F.col("a._word") == F.col("b._word")) & _able(layout, percent) & (layout.first("b") < layout.first("a")))
    closest = near.groupBy(layout.first("a").alias("a")).agg(F.min(F.struct(layout.differing().alias("d"), layout.first("b").alias("b"))).alias("x"))
    closest = stored(closest.select("a", F.col("x.b").alias("b")), "lines-closest")
    return _similar(closest, _near(closest, lines), percent)


def _marked(classes: DataFrame, words: DataFrame, hot: DataFrame, settled: DataFrame, layout: Layout, percent: int) -> DataFrame:
    """The postings, of which those of settled classes (nearly all of them) in long lists are marked in _place."""
    open_ = hot.alias("p").select(layout.first("p").alias("_at")).distinct().join(settled, F.col("_at") == F.col("a"), "left_anti")
    open_ = stored(open_.select(F.xxhash64("_at._doc", "_at._line").alias("_h")), "lines-open")
    blocks = filters.blocks_for(open_.count())
    classes = classes.withColumn("_h", F.xxhash64("_doc", "_line"))
    if filters.broadcastable(blocks):  # a settled class taken for an open one does some work in vain
        classes = filters.probe(classes, stored(filters.cells_hit(open_, blocks), "lines-open-cells"), blocks)
    else:
        classes = classes.join(open_.distinct().withColumn("_hit", F.lit(True)), "_h", "left").withColumn("_maybe", F.col("_hit").isNotNull())
    posted = _postings(classes, layout, percent, "_maybe").join(words.withColumn("_long", F.lit(True)), "_word", "left")
    marked = F.when(F.col("_maybe") | F.col("_long").isNull(), F.col("_place")).otherwise(F.col("_place").bitwiseOR(F.lit(1)))
    return posted.withColumn("_place", marked).select("_word", "_doc", *layout.columns)


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(_doc, _line): the lines with words that stay."""
    lines = stored(lines_of(docs, id_col, text_col), "lines-sets", **{"parquet.dictionary.page.size": 8 << 20})
    classes = stored(_classes(lines, rarity(lines), percent), "lines-classes")
    layout = Layout.of(classes)
    words = stored(_long_lists(classes, layout, percent), "lines-long")
    posted, gone, later_looks = _postings(classes, layout, percent), None, F.lit(True)
    first, second = layout.first("a"), layout.first("b")
    a_later = first > second
    if not words.isEmpty():
        hot = stored(posted.join(words, "_word", "left_semi"), "lines-hot")
        gone = _settled(hot, lines, layout, percent)
        posted = _marked(classes, words, hot, gone, layout, percent)
        later_looks = F.when(a_later, layout.looks("a")).otherwise(layout.looks("b"))
    # a is the shorter set, which meets others by fewer words. Its postings under these and the rest are shuffled once each.
    (an, ap), (bn, _) = layout.size_and_place("a"), layout.size_and_place("b")
    indexed = (an - ap) * (100 + percent) >= an * 2 * percent
    fewer, rest = posted.alias("a").where(indexed).select("a.*"), posted.alias("a").where(~indexed).select("a.*")
    shorter = (an < bn) | ((an == bn) & (first < second))
    on = (F.col("a._word") == F.col("b._word")) & (an <= bn) & _able(layout, percent) & shorter & (first != second) & later_looks
    later, earlier = F.when(a_later, first).otherwise(second), F.when(a_later, second).otherwise(first)
    met = lambda others: fewer.alias("a").join(others.alias("b"), on).select(later.alias("a"), earlier.alias("b"), layout.differing().alias("d"))
    pairs = met(fewer).unionByName(met(rest))
    found = _verified(pairs, lines, percent)
    gone = found if gone is None else gone.unionByName(found)
    return classes.select(F.struct("_doc", "_line").alias("_at")).join(gone, F.col("_at") == F.col("a"), "left_anti").select("_at._doc", "_at._line")


def line_summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """For each row of ``docs``: id, n_lines, n_blank, and the numbers of the lines with words that stay."""
    kept = kept_lines(docs, id_col, text_col, percent).groupBy("_doc").agg(F.array_sort(F.collect_list("_line")).alias("_kept"))
    lines = F.split(text_of(text_col), "\n")
    blank = F.size(F.filter(lines, lambda x: ~x.rlike(f"[^{SPACE}]")))
    rows = docs.select(F.col(id_col).alias("_id"), F.size(lines).alias("n_lines"), blank.alias("n_blank"))
    out = rows.join(kept, F.col("_id").eqNullSafe(F.col("_doc")), "left")
    return out.select(F.col("_id").alias(id_col), "n_lines", "n_blank", F.coalesce("_kept", F.array().cast("array<int>")).alias("kept_lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with the removed lines gone from the text."""
    kept = kept_lines(docs, id_col, text_col, percent).groupBy("_doc").agg(F.collect_set("_line").alias("_kept"))
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    joined = rows.join(kept, F.col("_id").eqNullSafe(F.col("_doc")), "left")
    stays = F.filter(
        F.transform(F.split("_text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
        lambda x: ~x["x"].rlike(f"[^{SPACE}]") | F.array_contains(F.coalesce("_kept", F.array().cast("array<int>")), x["i"]),
    )
    text = F.when(F.col("_row")[text_col].isNotNull(), F.array_join(F.transform(stays, lambda x: x["x"]), "\n"))
    return joined.select(*[text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns])
