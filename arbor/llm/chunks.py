"""Long texts as overlapping chunks, so that one text isn't one task's work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_long(text: Column, size: int) -> Column:
    return F.char_length(text) > size


def cut(df: DataFrame, text_col: str, size: int, overlap: int = 0) -> DataFrame:
    """Each row once for each ``size`` code points of its text: _chunk (from 0), _chunks, _start, _text.

    _text has ``overlap`` (at most ``size``) more code points on either side, as far as there
    are any, and begins at code point _start. One pass over the text, whatever its length.
    """
    parts = df.withColumn("_all", F.regexp_extract_all(F.col(text_col), F.lit(f"(?s).{{1,{size}}}"), F.lit(0)))
    parts = parts.withColumn("_chunks", F.size("_all"))
    whole = F.transform(
        "_all",
        lambda c, i: F.concat(
            F.coalesce(F.right(F.get("_all", i - 1), F.lit(overlap)), F.lit("")), c,
            F.coalesce(F.left(F.get("_all", i + 1), F.lit(overlap)), F.lit("")),
        ),
    )
    keep = [c for c in df.columns if c != text_col]
    out = parts.select(*keep, "_chunks", F.posexplode(whole).alias("_chunk", "_text"))
    return out.withColumn("_start", F.greatest(F.lit(0), F.col("_chunk") * size - overlap))
