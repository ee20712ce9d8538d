"""What sibling steps, running sums and counts of larger siblings say, as windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.core import col, text


def _by(parent: list[str], order: list[Column | str]):
    return Window.partitionBy(*parent).orderBy(*order)


def sibling(value: str | Column, k: int, parent: list[str], order: list[Column | str]) -> Column:
    """The value of the k-th following sibling (preceding if negative); null if there is none."""
    return (F.lead(value, k) if k > 0 else F.lag(value, -k)).over(_by(parent, order))


def running_before(value: str, parent: list[str], order: list[Column | str]) -> Column:
    """The sum over all preceding siblings, 0 for the first."""
    w = _by(parent, order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0.0))


def around_mean(value: str, k: int, parent: list[str], order: list[Column | str]) -> Column:
    """The mean of up to k siblings before and k after, without the row itself; NaN if it is alone."""
    w = _by(parent, order).rowsBetween(-k, k)
    n = F.count(value).over(w) - 1
    return F.when(n > 0, (F.sum(value).over(w) - F.col(value)) / n).otherwise(float("nan"))


def larger_siblings(value: str, parent: list[str]) -> Column:
    """How many siblings have a larger value: the rank less one, not a join of a table with itself."""
    return F.rank().over(Window.partitionBy(*parent).orderBy(F.desc(value))) - 1


def nearest_before(value: Column, parent: list[str], order: list[Column | str]) -> Column:
    """The last value that isn't null among preceding siblings and the row itself."""
    return F.last(value, ignorenulls=True).over(_by(parent, order).rowsBetween(Window.unboundedPreceding, 0))


def once(value: str | Column, parent: list[str], order: list[Column | str]) -> Column:
    """The value, or nothing where the sibling before has the same."""
    same = F.lag(value).over(_by(parent, order)).eqNullSafe(col(value))
    return F.when(same & (F.row_number().over(_by(parent, order)) > 1), "").otherwise(text(value))


def numbered(*levels: tuple[list[str], list[Column | str]]) -> Column:
    """A number of several levels: at each level the dense place among its parent's keys, joined by points."""
    return F.concat_ws(".", *[F.dense_rank().over(_by(parent, order)).cast("string") for parent, order in levels])
