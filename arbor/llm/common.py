"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_dir, stored

__all__ = ["SPACE", "load", "shared_dir", "slabs", "stored", "text_of", "unused", "words"]

#: ASCII white space as a regular-expression class body; words are runs of anything else.
SPACE = r"\x20\x09-\x0D"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """``name``, or with as many underscores before it as no column has."""
    while name.lower() in {c.lower() for c in columns}:
        name = "_" + name
    return name


def text_of(text_col: str) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lowered."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def slabs(batches: Iterable[pa.RecordBatch], text_col: str | int, max_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches where their texts pass ``max_bytes``, so that a batch of long texts stays small."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < len(sizes):
            yield batch.slice(start)
    pa.default_memory_pool().release_unused()  # a reused worker waits without what this task needed
