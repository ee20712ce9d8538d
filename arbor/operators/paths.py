"""Steps and predicates over tables, each row being a node: filters, positions, existence, and sets of nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import truth


def where(df: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which all conditions hold; a missing condition doesn't."""
    for c in conditions:
        df = df.where(truth(c))
    return df


def _window(parent: list[str], order: list[Column | str]) -> Window:
    return Window.partitionBy(*parent).orderBy(*order)


def at_position(df: DataFrame, n: int, parent: list[str], order: list[Column | str]) -> DataFrame:
    """The n-th row of each parent, in document order; -1 is the last."""
    if n < 0:
        backwards = [o.desc() if isinstance(o, Column) else F.desc(o) for o in order]
        return at_position(df, -n, parent, backwards)
    return df.withColumn("_at", F.row_number().over(_window(parent, order))).where(F.col("_at") == n).drop("_at")


def first_positions(df: DataFrame, n: int, parent: list[str], order: list[Column | str]) -> DataFrame:
    """The first n rows of each parent."""
    return df.withColumn("_at", F.row_number().over(_window(parent, order))).where(F.col("_at") <= n).drop("_at")


def with_position(df: DataFrame, parent: list[str], order: list[Column | str], position: str = "position", last: str | None = None) -> DataFrame:
    """Adds each row's place among its parent's rows, and how many there are."""
    out = df.withColumn(position, F.row_number().over(_window(parent, order)))
    return out if last is None else out.withColumn(last, F.count(F.lit(1)).over(Window.partitionBy(*parent)))


def having(df: DataFrame, child: DataFrame, on: Column) -> DataFrame:
    """Rows with some child: a semi join."""
    return df.join(child, on, "left_semi")


def having_none(df: DataFrame, child: DataFrame, on: Column) -> DataFrame:
    return df.join(child, on, "left_anti")


def having_value(df: DataFrame, key: str, values: DataFrame, value: str) -> DataFrame:
    """Rows of which ``key`` equals some value of the other table."""
    return df.join(values.select(F.col(value).alias("_value")).distinct(), F.col(key) == F.col("_value"), "left_semi")


def union(key: list[str], *parts: DataFrame) -> DataFrame:
    """Rows of all parts, each identity once."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(key)


def intersection(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_semi")


def difference(df: DataFrame, other: DataFrame, key: list[str]) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_anti")


def leading(df: DataFrame, marks: DataFrame, parent: list[str], order: str) -> DataFrame:
    """Each parent's rows before its first mark; all of them if it has none."""
    first = marks.groupBy(*parent).agg(F.min(order).alias("_mark"))
    return df.join(first, parent, "left").where(F.col("_mark").isNull() | (F.col(order) < F.col("_mark"))).drop("_mark")


def trailing(df: DataFrame, marks: DataFrame, parent: list[str], order: str) -> DataFrame:
    """Each parent's rows after its first mark."""
    first = marks.groupBy(*parent).agg(F.min(order).alias("_mark"))
    return df.join(first, parent).where(F.col(order) > F.col("_mark")).drop("_mark")


def content_key(columns: list[str]) -> Column:
    """A hash by which rows of equal content meet: missing and empty text are the same, outer space doesn't count."""
    return F.sha2(F.to_json(F.array(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns])), 256)


def common(base: DataFrame, columns: list[str], *others: DataFrame) -> DataFrame:
    """Rows of ``base`` whose content is that of a row of any other table."""
    keys = union(["_key"], *[o.select(content_key(columns).alias("_key")) for o in others])
    return base.withColumn("_key", content_key(columns)).join(keys, "_key", "left_semi").drop("_key")


def distinct_from(base: DataFrame, columns: list[str], *others: DataFrame) -> DataFrame:
    """Rows of ``base`` whose content is in no other table."""
    keys = union(["_key"], *[o.select(content_key(columns).alias("_key")) for o in others])
    return base.withColumn("_key", content_key(columns)).join(keys, "_key", "left_anti").drop("_key")


def ordered(df: DataFrame, *keys: tuple[str | Column, str, str], tie: list[str]) -> DataFrame:
    """Sorted by keys (value, "text" or "number", "ascending" or "descending"), stable by ``tie``."""
    by = []
    for value, kind, direction in keys:
        c = F.col(value) if isinstance(value, str) else value
        c = F.coalesce(c.cast("string"), F.lit("")) if kind == "text" else F.coalesce(c.try_cast("double"), F.lit(float("nan")))
        by.append(c.desc() if direction == "descending" else c.asc())
    return df.orderBy(*by, *tie)


def top(df: DataFrame, n: int, *keys, tie: list[str], skip: int = 0) -> DataFrame:
    """The first n rows of that order after ``skip``, with their place."""
    out = ordered(df, *keys, tie=tie)
    return (out.offset(skip) if skip else out).limit(n)


def sequence(spark, first: int, last: int, name: str = "n") -> DataFrame:
    """The whole numbers from ``first`` to ``last``, which may be the smaller one."""
    step = 1 if first <= last else -1
    return spark.range(first, last + step, step).toDF(name)


def each_sequence(df: DataFrame, first: str, last: str, name: str = "n") -> DataFrame:
    """Each row once for every whole number from one column to another, up or down."""
    step = F.when(F.col(first) <= F.col(last), 1).otherwise(-1)
    return df.withColumn(name, F.explode(F.sequence(F.col(first), F.col(last), step)))
