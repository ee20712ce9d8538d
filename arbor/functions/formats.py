"""Numbers and texts in the forms that patterns ask for."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import windows
from .core import number, text
from .strings import capital, human_size, tagged


@dataclass(frozen=True)
class DecimalFormat:
    """The signs that a pattern and its results are written with."""

    point: str = "."
    grouping: str = ","
    minus: str = "-"
    percent: str = "%"
    per_mille: str = "‰"
    zero: str = "0"
    digit: str = "#"
    separator: str = ";"
    nan: str = "NaN"
    infinity: str = "Infinity"


def _part(pattern: str, d: DecimalFormat) -> tuple[str, str, str]:
    """What stands before the digits, the digits, and what stands behind them."""
    signs = re.escape(d.digit + d.zero + d.grouping + d.point)
    found = re.match(rf"(?s)([^{signs}]*)([{signs}]*)(.*)", pattern)
    return found[1], found[2], found[3]


def format_number(x: Column | str, pattern: str, form: DecimalFormat = DecimalFormat()) -> Column:
    """A number by a pattern such as ``#,##0.00;(#)``: digits that are shown only if needed or always, groups, percent.

    The part behind the separator holds for negative numbers and lends them what stands around
    their digits; without it they have a minus sign in front.
    """
    n, d = number(x), form
    halves = pattern.split(d.separator)
    before, digits, behind = _part(halves[0], d)
    whole, _, fraction = digits.partition(d.point)
    least, most = fraction.count(d.zero), len(fraction)
    group = len(whole) - whole.rindex(d.grouping) - 1 if d.grouping in whole else 0
    least_whole = whole.count(d.zero)
    scale = 100.0 if d.percent in before + behind else 1000.0 if d.per_mille in before + behind else 1.0
    shown = F.format_string(f"%.{most}f", F.abs(n) * scale)
    left, right = F.split_part(shown, F.lit("."), F.lit(1)), F.split_part(shown, F.lit("."), F.lit(2))
    right = F.concat(F.substring(right, 1, least), F.regexp_replace(F.substring(right, least + 1, most), "0+$", ""))
    left = F.when(F.char_length(left) < least_whole, F.lpad(left, least_whole, "0")).otherwise(left)
    if not least_whole:
        left = F.when((left == "0") & (right != ""), "").otherwise(left)
    if group:
        left = F.regexp_replace(left, rf"(\d)(?=(\d{{{group}}})+$)", "$1,")
    body = F.concat(left, F.when(right != "", F.concat(F.lit("."), right)).otherwise(""))
    body = F.translate(body, "0123456789,.", "".join(chr(ord(d.zero) + i) for i in range(10)) + d.grouping + d.point)
    low_before, low_behind = _part(halves[1], d)[::2] if len(halves) > 1 else (d.minus + before, behind)
    around = lambda a, b: F.concat(F.lit(a), F.when(F.abs(n) == float("inf"), d.infinity).otherwise(body), F.lit(b))
    return F.when(F.isnan(n), d.nan).when(n < 0, around(low_before, low_behind)).otherwise(around(before, behind))


# The signs of Roman numbers for ones, tens, hundreds and thousands.
ROMAN = (
    ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"),
    ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"),
    ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"),
    ("", "m", "mm", "mmm"),
)


def roman(n: Column) -> Column:
    """A number from 1 to 3999 in Roman signs, others in digits."""
    places = [F.get(F.array(*map(F.lit, signs)), (F.floor(n / 10**i) % 10).cast("int")) for i, signs in enumerate(ROMAN)]
    return F.when((n > 0) & (n < 4000), F.concat(*reversed(places))).otherwise(n.cast("string"))


def letters(n: Column, places: int = 6) -> Column:
    """1 is a, 26 is z, 27 is aa; numbers below 1 (or of too many places) in digits."""
    out, first = n.cast("string"), 1
    for width in range(1, places + 1):
        rest = n - first
        made = F.concat(*[F.char((F.floor(rest / 26**i) % 26 + 97).cast("int")) for i in reversed(range(width))])
        out = F.when((n >= first) & (n < first + 26**width), made).otherwise(out)
        first += 26**width
    return out


def number_as(n: Column | str, form: str = "1") -> Column:
    """A whole number as ``1``, ``01`` (at least so many digits), ``a``, ``A``, ``i`` or ``I``."""
    c = (F.col(n) if isinstance(n, str) else n).cast("long")
    made = {"a": letters, "A": lambda x: F.upper(letters(x)), "i": roman, "I": lambda x: F.upper(roman(x))}
    if form in made:
        return made[form](c)
    digits = c.cast("string")
    return F.when(F.char_length(digits) < len(form), F.lpad(digits, len(form), "0")).otherwise(digits)


def numbers_as(numbers: Column | str, form: str = "1") -> Column:
    """An array of numbers by a form such as ``(1.a)``: a token for each number, the last one for those that are left."""
    c = F.col(numbers) if isinstance(numbers, str) else numbers
    tokens = re.findall(r"[0-9A-Za-z]+", form) or ["1"]
    marks = re.split(r"[0-9A-Za-z]+", form) if re.search(r"[0-9A-Za-z]", form) else ["", ""]
    between = marks[1:-1] or ["."]

    def one(n: Column, i: Column) -> Column:
        made, mark = number_as(n, tokens[-1]), F.lit(between[-1])
        for k, token in enumerate(tokens[:-1]):
            made = F.when(i == k, number_as(n, token)).otherwise(made)
        for k, m in enumerate(between[:-1], 1):
            mark = F.when(i == k, m).otherwise(mark)
        return F.concat(F.when(i == 0, "").otherwise(mark), made)

    return F.concat(F.lit(marks[0]), F.array_join(F.transform(c, one), ""), F.lit(marks[-1]))


_CONVERSION = re.compile(r"%(?:(%)|(-?)(\d+|\*)?(?:\.(\d+|\*))?(j(?:c|1|t\{[^}]*\}|h\{[^}]*\})*)?[a-zA-Z])")


def printed(form: str, *values: Column | str, within: tuple[list[str], list[str]] | None = None) -> Column:
    """A printf form in which every conversion prints text.

    Widths and precisions are digits or ``*`` (the next value); a ``j`` brings more: ``c`` makes
    the first character a capital, ``t{tag}`` puts a tag before what isn't empty, ``h{...}``
    shows a number with its magnitude (of ``1000`` with that word in braces; ``whole``), and
    ``1`` prints what differs from the row before, in the groups and order of ``within``.
    """
    left, parts, at = [text(v) for v in values], [], 0
    raw = list(values)

    def take() -> tuple[Column, Column | str]:
        return left.pop(0), raw.pop(0)

    for m in _CONVERSION.finditer(form):
        parts.append(F.lit(form[at : m.start()]))
        at = m.end()
        if m[1]:
            parts.append(F.lit("%"))
            continue
        width = F.lit(int(m[3])) if m[3] and m[3] != "*" else take()[0].cast("int") if m[3] else None
        most = F.lit(int(m[4])) if m[4] and m[4] != "*" else take()[0].cast("int") if m[4] else None
        shown, value = take()
        for flag in re.findall(r"c|1|t\{[^}]*\}|h\{[^}]*\}", (m[5] or "")[1:]):
            if flag == "c":
                shown = capital(shown)
            elif flag == "1":
                parent, order = within or ([], [])
                shown = windows.once(value, parent, order)
            elif flag[0] == "t":
                shown = tagged(flag[2:-1], shown)
            else:
                shown = human_size(value, 1000 if "1000" in flag else 1024, "whole" in flag)
        if most is not None:
            shown = F.substring(shown, F.lit(1), most)
        if width is not None:
            fill = F.repeat(F.lit(" "), F.greatest(F.lit(0), width - F.char_length(shown)))
            shown = F.concat(shown, fill) if m[2] else F.concat(fill, shown)
        parts.append(shown)
    return F.concat(*parts, F.lit(form[at:]))
