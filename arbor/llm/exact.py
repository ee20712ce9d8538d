"""Exact dedup by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 maps each normalised text's hash to a few cells of a blocked Bloom filter and counts
the rows on each cell (partial sums first, so a text with a third of all rows sends one row
per task); cells that two or more rows hit become a bitmap of 4 KiB blocks. Pass 2 probes
that bitmap: a row with a cell that nobody else hit is alone and passes straight through;
only the possibly repeated rows are shuffled, by the full SHA-256, which decides exactly.

Defined results: a null text counts as empty; empty texts are equal to each other and to
texts of white space; ties go to the longer original text, then the smaller id (null ids
last), then any one of fully repeated rows; an empty table gives an empty result; extra
columns, whatever their names, neither matter nor clash (:func:`exact_dedup` returns them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_of
from .filters import blocks_for, cells_hit, probe


def normalised(text: Column) -> Column:
    """The text without the characters 0x20 and 0x09 to 0x0D."""
    for c in " \t\n\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _digest(docs: DataFrame, id_col: str, text_col: str, row: Column | None = None) -> DataFrame:
    text = text_of(text_col)
    out = docs.select(
        F.col(id_col).alias("_id"),
        F.char_length(text).alias("_n"),
        F.unhex(F.sha2(normalised(text), 256)).alias("_sha"),
        *([row.alias("_row")] if row is not None else []),
    )
    return out.withColumn("_h", F.xxhash64("_sha"))


def _winners(maybe: DataFrame, *tie: str) -> DataFrame:
    """For each text among possibly repeated rows: its group's size and the row that stays."""
    best = F.min(F.struct((-F.col("_n")).alias("n"), F.col("_id").isNull().alias("null"), F.col("_id").alias("id"), *tie)).alias("_best")
    groups = maybe.groupBy("_sha").agg(F.count(F.lit(1)).alias("_size"), best)
    # Written, so that the join below deals both sides anew and a hot text's rows can be split.
    return stored(groups.select("_sha", "_size", F.col("_best.id").alias("_keep"), (-F.col("_best.n")).alias("_keep_n"), *[F.col(f"_best.{c}").alias(f"_keep{c}") for c in tie]), "exact-winners")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    digests = stored(_digest(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "exact-digests")
    blocks = blocks_for(digests.count())
    probed = probe(digests, cells_hit(digests, blocks, 2), blocks)
    alone = probed.where(~F.col("_maybe")).select("_sha", "_id", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("_size"), F.lit(True).alias("_kept"))
    maybe = probed.where("_maybe")
    found = maybe.join(_winners(maybe, "_row"), "_sha").select("_sha", "_id", "_keep", "_size", (F.col("_row") == F.col("_keep_row")).alias("_kept"))
    return alone.unionByName(found).select(
        F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"), F.col("_size").alias("group_size"),
        F.col("_kept").alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rows that are surely alone aren't shuffled."""
    digests = _digest(docs, id_col, text_col)
    blocks = blocks_for(docs.count())
    repeats = stored(cells_hit(digests, blocks, 2), "exact-filter")
    winners = _winners(probe(digests, repeats, blocks).where("_maybe"))
    rows = probe(_digest(docs, id_col, text_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns])), repeats, blocks)
    best = rows.where("_maybe").join(winners, "_sha").where(F.col("_id").eqNullSafe(F.col("_keep")) & (F.col("_n") == F.col("_keep_n")))
    # Rows of equal text, length and id are left: one of each stays, picked in each task before they are shuffled.
    return rows.where(~F.col("_maybe")).select("_row").unionByName(best.dropDuplicates(["_sha"]).select("_row")).select("_row.*")
