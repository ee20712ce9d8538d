"""String functions of path expressions and of their usual extensions, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import half_up, number, text

SPACE = r"[ \t\r\n]+"
#: POSIX bracket classes and what they are in Java patterns.
POSIX = {
    "[:alpha:]": r"\p{Alpha}", "[:digit:]": r"\p{Digit}", "[:alnum:]": r"\p{Alnum}", "[:upper:]": r"\p{Upper}",
    "[:lower:]": r"\p{Lower}", "[:space:]": r"\s", "[:punct:]": r"\p{Punct}", "[:xdigit:]": r"\p{XDigit}",
}


def pattern(posix: str, ignore_case: bool = False) -> str:
    """An extended POSIX pattern for Java; alternatives are tried in order, not longest first."""
    for k, v in POSIX.items():
        posix = posix.replace(k, v)
    return "(?i)" + posix if ignore_case else posix


def concat(*parts: Column | str) -> Column:
    return F.concat(*map(text, parts))


def before(x: Column | str, mark: str) -> Column:
    """What stands before the first ``mark``; empty if there is none."""
    t = text(x)
    return F.when(F.contains(t, F.lit(mark)), F.substring_index(t, mark, 1)).otherwise("")


def after(x: Column | str, mark: str) -> Column:
    """What stands after the first ``mark``; empty if there is none."""
    t = text(x)
    at = F.instr(t, mark)
    return F.when(at > 0, F.substring(t, at + len(mark), F.char_length(t))).otherwise("")


def substring(x: Column | str, start: Column | float, length: Column | float | None = None) -> Column:
    """The characters at places p with round(start) <= p < round(start) + round(length); places count from 1."""
    t = text(x)
    lo = half_up(start if isinstance(start, Column) else F.lit(float(start)))
    n = F.char_length(t).cast("double")
    hi = n + 1 if length is None else lo + half_up(length if isinstance(length, Column) else F.lit(float(length)))
    first, last = F.greatest(lo, F.lit(1.0)), F.least(hi, n + 1)
    empty = F.isnan(lo) | F.isnan(hi) | (last <= first)
    return F.when(empty, "").otherwise(F.substring(t, first.cast("int"), (last - first).cast("int")))


def normal_space(x: Column | str) -> Column:
    return F.trim(F.regexp_replace(text(x), SPACE, " "))


def translate(x: Column | str, what: str, to: str) -> Column:
    """Each character of ``what`` becomes the one at its place in ``to``, or nothing if there is none."""
    return F.translate(text(x), what, to)


def ends_with(x: Column | str, end: str) -> Column:
    return F.endswith(text(x), F.lit(end))


def first_of(*values: Column | str) -> Column:
    """The first value that isn't empty, else an empty string."""
    return F.coalesce(*[F.nullif(text(v), F.lit("")) for v in values], F.lit(""))


def is_empty(*values: Column | str) -> Column:
    """Whether all values are empty."""
    out = F.lit(True)
    for v in values:
        out = out & (text(v) == "")
    return out


def match(x: Column | str, posix: str, ignore_case: bool = False) -> Column:
    """The first match and its groups as an array; empty groups at the end are cut off; an empty array if nothing matches."""
    p = pattern(posix, ignore_case)
    groups = F.array(*[F.coalesce(F.regexp_extract(text(x), p, i), F.lit("")) for i in range(re.compile(re.sub(r"\\p\{\w+\}", "x", p)).groups + 1)])
    used = F.aggregate(F.transform(groups, lambda g, i: F.when(g != "", i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    return F.when(text(x).rlike(p), F.slice(groups, 1, used)).otherwise(F.array().cast("array<string>"))


def matches(x: Column | str, posix: str, ignore_case: bool = False) -> Column:
    return text(x).rlike(pattern(posix, ignore_case))


def split(x: Column | str, posix: str, limit: int = -1) -> Column:
    """Pieces between matches; at most ``limit`` if that is positive. An empty string has no pieces."""
    return F.when(text(x) == "", F.array().cast("array<string>")).otherwise(F.split(text(x), pattern(posix), limit))


def lines(x: Column | str) -> Column:
    """Lines, whether they end in LF or CR LF; no empty one after the last end."""
    return split(F.regexp_replace(text(x), "\r?\n$", ""), "\r?\n")


def join(mark: str, *values: Column | str) -> Column:
    """Values that aren't empty, with ``mark`` between."""
    return F.concat_ws(mark, *[F.nullif(text(v), F.lit("")) for v in values])


def tokens(x: Column | str, marks: str = " \t\r\n") -> Column:
    """Pieces between any of the characters ``marks``, without empty ones; single characters if ``marks`` is empty."""
    cut = F.split(text(x), "" if not marks else "[" + re.escape(marks) + "]")
    return F.filter(cut, lambda p: p != "")


def replace(x: Column | str, pairs: dict[str, str]) -> Column:
    """Each key is replaced by its value, longest keys first."""
    out = text(x)
    for k in sorted(pairs, key=len, reverse=True):
        out = F.replace(out, F.lit(k), F.lit(pairs[k]))
    return out


def padding(length: int, fill: str = " ") -> Column:
    return F.rpad(F.lit(""), length, fill)


def align(x: Column | str, width: int, side: str = "left") -> Column:
    """The text in a field of ``width``: cut off if longer, at the left, right or center if shorter."""
    t = F.substring(text(x), 1, width)
    if side == "right":
        return F.lpad(t, width, " ")
    if side == "center":
        return F.rpad(F.lpad(t, (F.char_length(t) + F.floor((width - F.char_length(t)) / 2)).cast("int"), F.lit(" ")), width, " ")
    return F.rpad(t, width, " ")


def encode_uri(x: Column | str) -> Column:
    """Percent-encoded, spaces as %20."""
    return F.replace(F.url_encode(text(x)), F.lit("+"), F.lit("%20"))


def decode_uri(x: Column | str) -> Column:
    """Without percent-encoding; a text with escapes that are none stays as it is."""
    return F.coalesce(F.try_url_decode(F.replace(text(x), F.lit("+"), F.lit("%2B"))), text(x))


def base64_encode(x: Column | str) -> Column:
    """Base64 in one line, however long; Spark's has a line end after every 76 signs."""
    return F.replace(F.base64(text(x).cast("binary")), F.lit("\r\n"), F.lit(""))


def base64_decode(x: Column | str, instead: str = "") -> Column:
    """Decoded text; control characters that documents can't hold become ``instead``."""
    return F.regexp_replace(F.unbase64(text(x)).cast("string"), r"[\x00-\x08\x0b\x0c\x0e-\x1f]", instead)


def capital(x: Column | str) -> Column:
    """The first character as a capital."""
    t = text(x)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, F.char_length(t)))


def tagged(tag: str, x: Column | str) -> Column:
    """The text after a tag, or nothing if it is empty."""
    return F.when(text(x) != "", F.concat(F.lit(tag), text(x))).otherwise("")


def printed(form: str, *values: Column | str) -> Column:
    """A printf form in which every conversion prints text (%5s, %-5s, %.3s, %%)."""
    return F.format_string(re.sub(r"%(-?\d*(?:\.\d+)?)[a-zA-Z]", r"%\1s", form), *map(text, values))


def human_size(x: Column | str, base: int = 1024, whole: bool = False, unit: str = "", largest: str = "E") -> Column:
    """A number with a suffix of its magnitude, ``largest`` at most: 1536 is 1.5K."""
    n = number(x)
    out = F.when(F.abs(n) < base, F.concat(F.format_string("%.0f", n), F.lit(unit)))
    marks = "KMGTPE"
    marks = marks[: marks.index(largest) + 1]
    for i, mark in enumerate(marks, 1):
        scaled = n / float(base**i)
        shown = F.format_string("%.0f" if whole else "%.1f", scaled)
        branch = F.concat(shown, F.lit(mark + unit))
        out = out.otherwise(branch) if i == len(marks) else out.when(F.abs(n) < float(base ** (i + 1)), branch)
    return out


def format_number(x: Column | str, decimals: int = 0, grouping: str = ",", point: str = ".", minus: str = "-") -> Column:
    """A number with grouped digits and the symbols of a decimal format; NaN by name."""
    n = number(x)
    plain = F.format_number(F.abs(n), decimals)
    shown = F.translate(plain, ",.", grouping + point)
    return F.when(F.isnan(n), "NaN").when(n < 0, F.concat(F.lit(minus), shown)).otherwise(shown)


def string_length(x: Column | str) -> Column:
    return F.char_length(text(x))


