"""Bit strings: text of 0 and 1 of any length. Operands are filled up on the left to equal width."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import text


def _wide(a: Column | str, b: Column | str) -> tuple[Column, Column]:
    width = F.greatest(F.char_length(text(a)), F.char_length(text(b)))
    return F.lpad(text(a), width, F.lit("0")), F.lpad(text(b), width, F.lit("0"))


def _each(a: Column | str, b: Column | str, ones: tuple[str, ...]) -> Column:
    """Bit by bit: 1 where the pair of bits is one of ``ones``."""
    x, y = _wide(a, b)
    pairs = F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: F.when(F.concat(p, q).isin(*ones), "1").otherwise("0"))
    return F.when(F.char_length(x) == 0, "").otherwise(F.array_join(pairs, ""))


def and_(a: Column | str, b: Column | str) -> Column:
    return _each(a, b, ("11",))


def or_(a: Column | str, b: Column | str) -> Column:
    return _each(a, b, ("01", "10", "11"))


def xor(a: Column | str, b: Column | str) -> Column:
    return _each(a, b, ("01", "10"))


def nand(a: Column | str, b: Column | str) -> Column:
    return _each(a, b, ("00", "01", "10"))


def nor(a: Column | str, b: Column | str) -> Column:
    return _each(a, b, ("00",))


def xnor(a: Column | str, b: Column | str) -> Column:
    return _each(a, b, ("00", "11"))


def not_(a: Column | str) -> Column:
    return F.translate(text(a), "01", "10")


def mask(ones: int, width: int = 0) -> Column:
    """``ones`` bits set at the right of at least ``width``."""
    return F.lit(("1" * ones).rjust(max(width, ones, 1), "0"))


def to_int(a: Column | str) -> Column:
    """The number; -1 if it takes more than 63 bits."""
    short = F.ltrim(text(a), F.lit("0"))
    return F.when(F.char_length(short) > 63, F.lit(-1).cast("long")).otherwise(F.coalesce(F.conv(F.concat(F.lit("0"), short), 2, 10).cast("long"), F.lit(0)))


def from_int(n: Column | str, width: int = 0) -> Column:
    made = F.bin(n)
    return F.lpad(made, F.greatest(F.char_length(made), F.lit(width)), F.lit("0"))


def to_hex(a: Column | str) -> Column:
    """0x and small hex digits."""
    return F.concat(F.lit("0x"), F.lower(F.conv(F.concat(F.lit("0"), text(a)), 2, 16)))


def from_hex(h: Column | str, width: int = 0) -> Column:
    digits = F.regexp_replace(text(h), "^0[xX]", "")
    made = F.conv(digits, 16, 2)
    return F.lpad(made, F.greatest(F.char_length(made), F.lit(width)), F.lit("0"))


def _with_bit(a: Column | str, place: int, bit: str) -> Column:
    wide = F.lpad(text(a), F.greatest(F.char_length(text(a)), F.lit(place + 1)), F.lit("0"))
    return F.overlay(wide, F.lit(bit), F.char_length(wide) - place, F.lit(1))


def set_bit(a: Column | str, place: int = 0) -> Column:
    """Bit 0 is the rightmost; the string grows if it is too short."""
    return _with_bit(a, place, "1")


def clear_bit(a: Column | str, place: int = 0) -> Column:
    return _with_bit(a, place, "0")


def compare(a: Column | str, b: Column | str) -> Column:
    """1, 0 or -1, whatever the widths."""
    x, y = _wide(a, b)
    return F.when(x > y, 1).when(x < y, -1).otherwise(0)


def shift_left(a: Column | str, by: int) -> Column:
    """The width stays."""
    t = text(a)
    return F.rpad(F.substring(t, by + 1, F.char_length(t)), F.char_length(t), F.lit("0"))


def shift_right(a: Column | str, by: int, fill: Column | str = "0") -> Column:
    t = text(a)
    filler = F.lit(fill) if isinstance(fill, str) else fill
    return F.lpad(F.substring(t, F.lit(1), F.greatest(F.char_length(t) - by, F.lit(0))), F.char_length(t), filler)


def arithmetic_shift_right(a: Column | str, by: int) -> Column:
    """Fills with the leftmost bit."""
    return shift_right(a, by, F.substring(text(a), 1, 1))
