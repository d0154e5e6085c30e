import pytest
from pyspark.sql import functions as F

from sheaf.functions import coerce, fields, mathx, text


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("s", "number", "whole"),
    [("3.5abc", 3.5, 3), ("-7", -7.0, -7), ("", 0.0, 0), ("x1", 0.0, 0), (".5", 0.5, 0), ("1e3", 1000.0, 1), ("12.", 12.0, 12), (" 4", 0.0, 0), ("99999999999999999999", 1e20, 0), ("+8", 8.0, 8), ("5e", 5.0, 5)],
)
def test_text_to_numbers(spark, s, number, whole):
    assert one(spark, coerce.to_num(F.lit(s))) == number
    assert one(spark, coerce.to_int(F.lit(s))) == whole


@pytest.mark.parametrize(
    ("x", "s"),
    [(2.0, "2"), (3.5, "3.5"), (2.718281828459045, "2.718281828459045"), (12345678.5, "12345678.5"), (0.0001, "0.0001"), (0.00012, "0.00012"), (1e15, "1000000000000000"), (1.5e20, "1.5e20"), (1e-7, "1e-7"), (-0.001, "-0.001"), (float("nan"), "NaN"), (float("inf"), "inf"), (-12345678.25, "-12345678.25")],
)
def test_numbers_to_text(spark, x, s):
    assert one(spark, coerce.num_to_text(F.lit(x))) == s


def test_truncation_saturates(spark):
    for x, n in ((1e300, 2**63 - 1), (-1e300, -(2**63)), (-1.9, -1), (float("nan"), 0), (0.25, 0)):
        assert one(spark, coerce.float_to_int(F.lit(x))) == n


def test_truth(spark):
    for x, kind, want in ((0.25, "float", False), ("0", "str", True), ("", "str", False), (3, "int", True)):
        assert one(spark, coerce.truthy(F.lit(x), kind)) is want


def test_substr_clamps(spark):
    s = F.lit("hello")
    assert one(spark, text.substr(s, -20, 4)) == "hell"
    assert one(spark, text.substr(s, 4)) == "lo"
    assert one(spark, text.substr(s, 9)) == ""
    assert one(spark, text.substr(s, 2, -3)) == ""
    assert one(spark, text.length(F.lit("é"))) == 2
    assert one(spark, text.index(F.lit("éa"), F.lit("a"))) == 3


def test_substitutions(spark):
    s = F.lit("a1b22c333")
    assert one(spark, text.sub(s, "[0-9]+", r"<&\&$>")) == "a<1&$>b22c333"
    assert one(spark, text.gsub(s, "[0-9]+", "#")) == "a#b#c#"
    assert one(spark, text.gensub(s, "([0-9])[0-9]*", r"[\1]", 2)) == "a1b[2]c333"
    assert one(spark, text.gensub(s, "[0-9]+", "x", 9)) == "a1b22c333"


@pytest.mark.parametrize(
    ("fmt", "args", "want"),
    [("%5d|%-4s|%03d", [(7, "int"), ("ab", "str"), (-5, "int")], "    7|ab  |-05"), ("%.2f %s", [(3.14159, "float"), (2.0, "float")], "3.14 2"), ("%c%c", [(65, "int"), ("xyz", "str")], "Ax"), ("%x %o", [(255, "int"), (8, "int")], "ff 10"), ("100%% %d", [], "100% 0"), ("%z", [], "%z"), ("%e", [(12535.0, "float")], "1.2535e4"), ("%.1e", [(12535.0, "float")], "1.3e4")],
)
def test_sprintf(spark, fmt, args, want):
    assert one(spark, text.sprintf(fmt, *[(F.lit(v), k) for v, k in args])) == want


def test_hex_and_escapes(spark):
    for s, n in (("0xff", 255), ("-0x10", -16), ("zz", 0), ("7", 7), ("0xfffffffffffffffff", 0)):
        assert one(spark, text.hex_to_int(F.lit(s))) == n
    assert one(spark, text.escape_csv(F.lit('a"b,c\t'))) == '"a""b,c\\t"'
    assert one(spark, text.unescape(F.lit("a\\tb\\\\n"))) == "a\tb\\n"


def test_fields(spark):
    f = F.array(F.lit("a"), F.lit("b"))
    assert one(spark, fields.nth(f, 3)) == ""
    assert one(spark, fields.rebuild(fields.assign(f, 4, F.lit("z")), ",")) == "a,b,,z"
    with pytest.raises(Exception, match="positive"):
        one(spark, fields.nth(f, 0))


def test_division_edges(spark):
    assert one(spark, mathx.divide(F.lit(-1.0), F.lit(0.0))) == float("-inf")
    assert str(one(spark, mathx.divide(F.lit(0.0), F.lit(0.0)))) == "nan"
    assert one(spark, mathx.modulo_int(F.lit(7), F.lit(0))) == 0
