"""Joins that keys, lookups in other documents, containment and nearest-before steps come to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def by_key(df: DataFrame, key: Column | str, nodes: DataFrame, use: Column | str, how: str = "inner") -> DataFrame:
    """Rows with the nodes that a key finds for their value. Spark picks a broadcast by measured size."""
    left = df.withColumn("_key", key if isinstance(key, Column) else F.col(key))
    right = nodes.withColumn("_use", use if isinstance(use, Column) else F.col(use))
    return left.join(right, F.col("_key") == F.col("_use"), how).drop("_key", "_use")


def or_empty(df: DataFrame, *columns: str) -> DataFrame:
    """What an outer join left missing, as empty text."""
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, right_time: str, values: list[str]) -> DataFrame:
    """Each left row with the values of the last right row at or before its time, of equal ``by``.

    Both sides are one stream in order of time and each value is carried on: one shuffle, no
    pairs. At equal times right rows come first; among those the largest values.
    """
    lefts = left.select(*by, F.col(time).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"))
    rights = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"), F.struct(*values).alias("_v"))
    w = Window.partitionBy(*by).orderBy("_t", "_side", "_v").rowsBetween(Window.unboundedPreceding, 0)
    both = lefts.unionByName(rights).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return both.select("_row.*", "_v.*")


def within(points: DataFrame, spans: DataFrame, by: list[str], at: str, low: str, high: str, bucket: int) -> DataFrame:
    """Points with the spans that hold them (low <= at <= high): an equi-join on buckets of width ``bucket``.

    A span is posted in each bucket that it touches, so a point meets only spans near it.
    """
    posted = spans.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(low) / bucket), F.floor(F.col(high) / bucket))))
    placed = points.withColumn("_bucket", F.floor(F.col(at) / bucket))
    return placed.join(posted, [*by, "_bucket"]).where(F.col(at).between(F.col(low), F.col(high))).drop("_bucket")
