import math

import pytest
from pyspark.sql import functions as F

from arbor.functions import bits, core, dates, strings


@pytest.fixture(scope="module")
def value(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("start, length, want", [(0, 3, "12"), (1.5, 2.6, "234"), (2, None, "2345"), (-42, 1e6, "12345"), (6, 1, ""), (float("nan"), 3, ""), (1, float("nan"), "")])
def test_substring(value, start, length, want):
    assert value(strings.substring(F.lit("12345"), start, length)) == want


@pytest.mark.parametrize("x, want", [("5", 5.0), ("  5 ", 5.0), ("x", None), (None, None)])
def test_number(value, x, want):
    got = value(core.number(F.lit(x)))
    assert math.isnan(got) if want is None else got == want


@pytest.mark.parametrize("x, want", [(2.5, 3.0), (-2.5, -2.0), (0.4, 0.0)])
def test_half_up(value, x, want):
    assert value(core.half_up(F.lit(x))) == want


@pytest.mark.parametrize("a, b, want", [(1, 0, math.inf), (-1, 0, -math.inf), (6, 4, 1.5)])
def test_divide(value, a, b, want):
    assert value(core.divide(F.lit(a), F.lit(b))) == want


def test_nan_equals_nothing(value):
    assert value(core.equal(F.lit("x"), F.lit("x"))) is False
    assert value(core.less(F.lit(1), F.lit("x"))) is False


@pytest.mark.parametrize("x, want", [(3.0, "3"), (3.25, "3.25"), (-0.5, "-0.5"), (math.nan, "NaN"), (math.inf, "Infinity"), (1e14, "100000000000000")])
def test_number_text(value, x, want):
    assert value(core.number_text(F.lit(x))) == want


def test_sets_compare_by_some_member(value):
    a, b = F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))
    assert value(core.any_equal(a, b)) and value(core.any_differs(a, b))
    assert not value(core.any_differs(b, b)) and not value(core.any_equal(F.lit(None).cast("array<int>"), b))


def test_text(value):
    assert value(strings.before(F.lit("a=b=c"), "=")) == "a" and value(strings.after(F.lit("a=b=c"), "=")) == "b=c"
    assert value(strings.before(F.lit("abc"), "=")) == "" and value(strings.after(F.lit(None), "=")) == ""
    assert value(strings.normal_space(F.lit(" a \n b "))) == "a b"
    assert value(strings.match(F.lit("ab12"), "([[:alpha:]]+)([[:digit:]]+)(x)?")) == ["ab12", "ab", "12"]
    assert value(strings.match(F.lit("zz"), "([0-9])")) == []
    assert value(strings.lines(F.lit("a\r\nb\n"))) == ["a", "b"]
    assert value(strings.split(F.lit(",a,b"), ",", 2)) == ["", "a,b"]
    assert value(strings.human_size(F.lit(1536))) == "1.5K" and value(strings.human_size(F.lit(12))) == "12"
    assert value(strings.align(F.lit("ab"), 5, "center")) == " ab  "
    assert value(strings.base64_decode(F.lit("AGE="))) == "a"
    assert value(strings.is_empty(F.lit(None), F.lit(""))) and not value(strings.is_empty(F.lit(""), F.lit("x")))
    assert value(strings.tagged("t:", F.lit(""))) == "" and value(strings.tagged("t:", F.lit("x"))) == "t:x"


def test_bits(value):
    assert value(bits.and_(F.lit("1100"), F.lit("101"))) == "0100"
    assert value(bits.nor(F.lit("10"), F.lit("00"))) == "01" and value(bits.nand(F.lit("11"), F.lit("10"))) == "01" and value(bits.xnor(F.lit("11"), F.lit("10"))) == "10"
    assert value(bits.clear_bit(F.lit("111"), 1)) == "101" and value(bits.set_bit(F.lit("1"), 3)) == "1001"
    assert value(bits.shift_left(F.lit("0110"), 1)) == "1100" and value(bits.shift_right(F.lit("0110"), 9)) == "0000" and value(bits.arithmetic_shift_right(F.lit("1010"), 2)) == "1110"
    assert value(bits.compare(F.lit("0010"), F.lit("10"))) == 0 and value(bits.to_int(F.lit("1" * 70))) == -1
    assert value(bits.mask(2, 4)) == "0011" and value(bits.from_hex(F.lit("0x1F"), 8)) == "00011111" and value(bits.to_hex(F.lit("11111"))) == "0x1f"


def test_dates(value):
    assert value(dates.duration(F.lit(93784))) == "P1DT2H3M4S" and value(dates.duration(F.lit(0))) == "PT0S"
    assert value(dates.duration_seconds(F.lit("-PT1M"))) == -60 and value(dates.duration_seconds(F.lit("P1Y"))) is None
    assert value(dates.day_in_week(F.lit("2024-03-03"))) == 1 and value(dates.week_in_month(F.lit("2024-03-03"))) == 2
    assert value(dates.year(F.lit("no date"))) is None


def test_bad_escapes_and_repeated_names(spark):
    from arbor.sources import readers

    df = spark.createDataFrame([("a=1&a=2&b=%zz&c&=x",), (None,)], "q string")
    found = df.select(readers.form_fields("q").alias("f")).collect()
    assert found[0].f == {"a": "2", "b": None, "c": "", "": "x"} and found[1].f == {}
    assert [r[0] for r in spark.createDataFrame([("%zz",), ("a%20b+",)], "q string").select(strings.decode_uri("q")).collect()] == ["%zz", "a b+"]
