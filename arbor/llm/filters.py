"""Blocked Bloom filters as rows of bitmaps, in DataFrame functions only.

A hash picks a block of 4 KiB and a few cells in it. A filter says which cells were hit, or hit
twice; it is broadcast while its size, known beforehand from the number of hashes, is bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter block: 512 numbers of 64 bits.
BLOCK_BITS = 32768
#: Filter bits for each row, and cells that a row hits.
BITS_PER_ROW, CELLS = 16, 3
#: A filter is broadcast up to this size; beyond it, hashes meet it by a shuffled join.
MAX_BROADCAST_BYTES = 64 << 20


def blocks_for(rows: int) -> int:
    return max(1, -(-rows * BITS_PER_ROW // BLOCK_BITS))


def broadcastable(blocks: int) -> bool:
    return blocks * BLOCK_BITS // 8 <= MAX_BROADCAST_BYTES


def _cells() -> list[Column]:
    bits = F.xxhash64(F.col("_h"), F.lit(7))
    return [F.shiftrightunsigned(bits, 15 * i).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for i in range(CELLS)]


def _block(blocks: int) -> Column:
    return F.pmod(F.col("_h"), F.lit(blocks))


def cells_hit(hashes: DataFrame, blocks: int, times: int = 1) -> DataFrame:
    """(_block, _bits): the cells that at least so many rows of ``hashes`` (_h) hit, as 512 numbers.

    Hits are counted before they are shuffled: a hash that a third of all rows have is one row of a task.
    """
    hits = hashes.select(_block(blocks).alias("_block"), F.explode(F.array_distinct(F.array(*_cells()))).alias("_cell"))
    if times > 1:
        hits = hits.groupBy("_block", "_cell").agg(F.count(F.lit(1)).alias("_hits")).where(F.col("_hits") >= times)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_cell").bitwiseAND(F.lit(63)))
    words = hits.select("_block", F.shiftright("_cell", 6).alias("_word"), one.alias("_bit"))
    per = BLOCK_BITS // 64
    every = hashes.sparkSession.range(blocks * per).select(F.floor(F.col("id") / per).alias("_block"), (F.col("id") % per).cast("int").alias("_word"), F.lit(0).cast("long").alias("_bit"))
    whole = words.unionByName(every).groupBy("_block", "_word").agg(F.bit_or("_bit").alias("_bit"))
    packed = F.sort_array(F.collect_list(F.struct("_word", "_bit")))
    return whole.groupBy("_block").agg(F.transform(packed, lambda x: x["_bit"]).alias("_bits"))


def _all_hit() -> Column:
    """Whether all cells of a row (_h) are hit in _bits."""
    maybe = F.lit(True)
    for cell in _cells():
        word = F.get("_bits", F.shiftright(cell, 6))
        maybe = maybe & (F.call_function("shiftrightunsigned", word, cell.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1)) == 1)
    return maybe


def probe(hashes: DataFrame, hit: DataFrame, blocks: int) -> DataFrame:
    """``hashes`` (_h and any columns) with _maybe: whether all cells of the row are hit."""
    if broadcastable(blocks):
        hit = F.broadcast(hit)
    joined = hashes.withColumn("_block", _block(blocks)).join(hit, "_block", "left")
    return joined.withColumn("_maybe", F.coalesce(_all_hit(), F.lit(False))).drop("_block", "_bits")


def passing(hashes: DataFrame, hit: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``hashes`` (_h and any columns) whose cells are all hit; the join makes no others."""
    if broadcastable(blocks):
        hit = F.broadcast(hit)
    hit = hit.withColumnRenamed("_block", "_of")
    return hashes.withColumn("_block", _block(blocks)).join(hit, (F.col("_block") == F.col("_of")) & _all_hit(), "left_semi").drop("_block")
