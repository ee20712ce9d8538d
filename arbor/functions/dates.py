"""Date functions over timestamps and ISO texts. Missing or malformed dates are null, as in Spark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import col


def moment(x: Column | str) -> Column:
    return col(x).try_cast("timestamp_ntz")


def year(x): return F.year(moment(x))  # noqa: E704
def month_in_year(x): return F.month(moment(x))  # noqa: E704
def day_in_month(x): return F.dayofmonth(moment(x))  # noqa: E704
def day_in_year(x): return F.dayofyear(moment(x))  # noqa: E704
def week_in_year(x): return F.weekofyear(moment(x))  # noqa: E704
def hour_in_day(x): return F.hour(moment(x))  # noqa: E704
def minute_in_hour(x): return F.minute(moment(x))  # noqa: E704
def second_in_minute(x): return F.second(moment(x))  # noqa: E704


def day_in_week(x: Column | str) -> Column:
    """Sunday is 1."""
    return F.dayofweek(moment(x))


def day_of_week_in_month(x: Column | str) -> Column:
    """Which of its weekdays in the month a date is: 3 for a third Monday."""
    return F.floor((F.dayofmonth(moment(x)) - 1) / 7).cast("int") + 1


def week_in_month(x: Column | str) -> Column:
    """Weeks begin on Sunday; the month's first days are in week 1."""
    first = F.date_trunc("month", moment(x))
    return F.floor((F.dayofmonth(moment(x)) + F.dayofweek(first) - 2) / 7).cast("int") + 1


def month_name(x: Column | str) -> Column:
    return F.date_format(moment(x), "MMMM")


def month_abbreviation(x: Column | str) -> Column:
    return F.date_format(moment(x), "MMM")


def day_name(x: Column | str) -> Column:
    return F.date_format(moment(x), "EEEE")


def leap_year(x: Column | str) -> Column:
    y = F.year(moment(x))
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def seconds(x: Column | str) -> Column:
    """Seconds since 1970 began."""
    return F.unix_timestamp(moment(x).cast("timestamp"))


def add(x: Column | str, months: int = 0, days: int = 0, secs: int = 0) -> Column:
    return moment(x) + F.make_interval(months=F.lit(months), days=F.lit(days), secs=F.lit(secs))


def difference(a: Column | str, b: Column | str) -> Column:
    """Seconds from ``a`` to ``b``."""
    return seconds(b) - seconds(a)


def duration(secs: Column | str) -> Column:
    """Seconds as an ISO duration of days and time: P1DT2H3M4S."""
    s = F.abs(col(secs).cast("long"))
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit))).otherwise("")
    clock = (part(F.floor(s % 86400 / 3600), "H"), part(F.floor(s % 3600 / 60), "M"), part(s % 60, "S"))
    sign, mark = F.when(col(secs) < 0, "-").otherwise(""), F.when(s % 86400 > 0, "T").otherwise("")
    return F.when(s > 0, F.concat(sign, F.lit("P"), part(F.floor(s / 86400), "D"), mark, *clock)).otherwise("PT0S")


def _once(x: Column, make) -> Column:
    """``make`` of a value that is computed once, however often it is used in there."""
    return F.get(F.transform(F.array(x), make), 0)


def duration_seconds(x: Column | str) -> Column:
    """Seconds of an ISO duration of days and time; null if it isn't one."""
    form = r"^(-?)P(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"

    def added(parts: Column) -> Column:
        part = lambda i: F.coalesce(F.when(F.get(parts, i) != "", F.get(parts, i)).try_cast("long"), F.lit(0))  # noqa: E731; a cast that fails costs an exception
        n = part(1) * 86400 + part(2) * 3600 + part(3) * 60 + part(4)
        return F.when(F.get(parts, 0) == "-", -n).otherwise(n)

    return _once(col(x), lambda t: F.when(t.rlike(form), _once(F.split(F.regexp_replace(t, form, "$1,$2,$3,$4,$5"), ","), added)))


def formatted(x: Column | str, form: str) -> Column:
    return F.date_format(moment(x), form)


def parsed(x: Column | str, form: str) -> Column:
    return F.try_to_timestamp(col(x), F.lit(form)).cast("timestamp_ntz")
