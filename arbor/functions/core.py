"""Values as path expressions see them: no nulls in text or truth, numbers as doubles with NaN."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INFINITY = float("inf")


def col(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def text(x: Column | str) -> Column:
    """A string; a missing value is the empty string."""
    return F.coalesce(col(x).cast("string"), F.lit(""))


def number(x: Column | str) -> Column:
    """A double; what isn't a number, and what is missing, is NaN."""
    return F.coalesce(col(x).try_cast("double"), F.lit(float("nan")))


def truth(x: Column | str) -> Column:
    """A condition with missing as false."""
    return F.coalesce(col(x).cast("boolean"), F.lit(False))


def truth_of_text(x: Column | str) -> Column:
    """Whether a string is not empty."""
    return text(x) != ""


def truth_of_number(x: Column | str) -> Column:
    """Whether a number is neither zero nor NaN."""
    n = number(x)
    return (n != 0) & ~F.isnan(n)


def number_text(x: Column | str) -> Column:
    """A number as text: whole ones without a point, NaN and Infinity by name, no exponent."""
    n = number(x)
    whole = (n == F.floor(n)) & (F.abs(n) < 1e15)
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", n), "0+$", ""), r"\.$", "")
    return (
        F.when(F.isnan(n), "NaN").when(n == INFINITY, "Infinity").when(n == -INFINITY, "-Infinity")
        .when(whole, n.cast("decimal(20,0)").cast("string")).otherwise(plain)
    )


def equal(a: Column | str, b: Column | str) -> Column:
    """Numeric equality: NaN equals nothing."""
    x, y = number(a), number(b)
    return (x == y) & ~F.isnan(x) & ~F.isnan(y)


def less(a: Column | str, b: Column | str) -> Column:
    x, y = number(a), number(b)
    return (x < y) & ~F.isnan(x) & ~F.isnan(y)


def divide(a: Column | str, b: Column | str) -> Column:
    """IEEE division: by zero it gives an infinity or NaN."""
    x, y = number(a), number(b)
    signed = F.when((x == 0) | F.isnan(x), float("nan")).when(x > 0, INFINITY).otherwise(-INFINITY)
    return F.when(y == 0, signed).otherwise(F.try_divide(x, y))


def modulo(a: Column | str, b: Column | str) -> Column:
    """The remainder with the dividend's sign; by zero it is NaN."""
    x, y = number(a), number(b)
    return F.when(y == 0, float("nan")).otherwise(F.try_mod(x, y))


def half_up(x: Column | str) -> Column:
    """The nearest whole number; halves go up, also below zero."""
    n = number(x)
    return F.when(F.isnan(n) | (F.abs(n) == INFINITY), n).otherwise(F.floor(n + 0.5).cast("double"))


def choose(condition: Column, yes: Column, no: Column) -> Column:
    return F.when(truth(condition), yes).otherwise(no)


def or_else(a: Column | str, b: Column | str) -> Column:
    """``a`` if it is a text that isn't empty, else ``b``."""
    return F.when(text(a) != "", text(a)).otherwise(text(b))


def any_equal(values: Column | str, others: Column | str) -> Column:
    """Whether some item of one array equals some item of the other."""
    return F.coalesce(F.arrays_overlap(col(values), col(others)), F.lit(False))


def any_differs(values: Column | str, others: Column | str) -> Column:
    """Whether some item of one array differs from some item of the other: not the negation of equality."""
    v, o = F.array_compact(F.coalesce(col(values), F.array())), F.array_compact(F.coalesce(col(others), F.array()))
    distinct = F.array_distinct(F.concat(v, o))
    return (F.size(v) > 0) & (F.size(o) > 0) & (F.size(distinct) > 1)


def total(x: Column | str) -> Column:
    """Aggregate: the sum of numbers, NaN if one isn't a number, 0 of nothing."""
    return F.coalesce(F.sum(number(x)), F.lit(0.0))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, map(truth, conditions))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, map(truth, conditions))
