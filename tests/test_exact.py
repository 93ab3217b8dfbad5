"""Integer columns against Python integers."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import exact, text

U128 = 2**128 - 1


def frame(spark, rows):
    data = [tuple(Decimal(x) for x in r) for r in rows]
    return spark.createDataFrame(data, "a decimal(38,0), b decimal(38,0), c decimal(38,0)")


def test_mul_div_matches_saturating_integers(spark):
    r = random.Random(7)
    rows = [(r.randrange(10**r.randrange(1, 24)), r.randrange(10**r.randrange(1, 22)), r.randrange(10**r.randrange(1, 20))) for _ in range(400)]
    rows += [(10**22, 10**16, 1), (10**25, 10**16, 10**9), (0, 5, 7), (5, 7, 0), (10**37, 9, 10)]
    df = frame(spark, rows).select("a", "b", "c", exact.mul_div_floor(F.col("a"), F.col("b"), F.col("c")).alias("x"),
                                   exact.mul_div_floor(F.col("a"), F.col("b"), 10**16).alias("y"),
                                   exact.div_floor(F.col("a"), F.col("c")).alias("z"))
    for g in df.collect():
        a, b, c = int(g.a), int(g.b), int(g.c)
        product = min(a * b, U128)
        if product == 0 or c == 0 or product // c < 10**38:
            assert int(g.x) == (product // c if c else 0)
        assert int(g.y) == product // 10**16
        assert int(g.z) == (a // c if c else 0)


def test_wide_products_are_exact(spark):
    """Products of 37 to 50 digits, divided by anything from 1 to 37 digits, down and up."""
    r = random.Random(13)
    rows = [(r.randrange(10**18, 10**r.randrange(19, 26)), r.randrange(10**17, 10**r.randrange(18, 23)), r.randrange(1, 10**r.randrange(1, 38))) for _ in range(400)]
    rows += [(2 * 10**22, 10**16, 10**12), (5 * 10**22, 10**16, 10**12), (3 * 10**16, 5 * 10**21, 5 * 10**22), (10**19, 10**19, 10**28), (10**19 - 1, 10**19 + 1, 10**37), (18446744073709551616, 18446744073709551616, 7)]
    df = frame(spark, rows).select("a", "b", "c", exact.mul_div_floor(F.col("a"), F.col("b"), F.col("c")).alias("x"), exact.mul_div_ceil(F.col("a"), F.col("b"), F.col("c")).alias("y"))
    for g in df.collect():
        a, b, c = int(g.a), int(g.b), int(g.c)
        product, cap = min(a * b, U128), 10**38 - 1
        assert (int(g.x), int(g.y)) == (min(product // c, cap), min(-(-product // c), cap)), (a, b, c)


def test_percent_change_truncates_toward_zero(spark):
    rows = [(110, 100, 0), (90, 100, 0), (1, 3, 0), (2, 3, 0), (5, 0, 0), (10**30, 1, 0)]
    got = [r.p for r in frame(spark, rows).select(exact.percent_change_bp(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got == [100000, -100000, -666666, -333333, 0, 2**63 - 1]


def test_number_text(spark):
    df = spark.createDataFrame([("0x4d", "77", "ff"), ("0x" + "f" * 31, "12x", "zz"), ("0x", "", "1")], "a string, b string, c string")
    rows = df.select(text.parse_num(F.col("a")).alias("a"), text.parse_num(F.col("b")).alias("b"), text.parse_num(F.col("c"), True).alias("c")).collect()
    assert [r.a and int(r.a) for r in rows] == [77, 16**31 - 1, None]
    assert [r.b and int(r.b) for r in rows] == [77, None, None]
    assert [r.c and int(r.c) for r in rows] == [255, None, 1]
    bp = spark.range(1).select(text.format_bp(F.lit(-5)).alias("a"), text.format_bp(F.lit(1234567)).alias("b"),
                               text.parse_bp(F.lit("-1.23455")).alias("c"), text.strip_lp_suffix(F.lit("a / b LP ")).alias("d")).first()
    assert (bp.a, bp.b, bp.c, bp.d) == ("-0.0005", "123.4567", -12346, "a / b")


def test_percent_text_saturates(spark):
    cases = {"1.00005": 10001, "1.000049": 10000, "-1.23455": -12346, " +2 ": 20000, "": 0, "-": 0, "x": 0, "1.2.3": 0, ".5": 5000, "9" * 40: 2**63 - 1, "-" + "9" * 40: -2**63, "-922337203685477.5808": -2**63}
    got = {r.t: r.v for r in spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.parse_bp(F.col("t")).alias("v")).collect()}
    assert got == cases


def test_amount_text_and_json_series(spark):
    df = frame(spark, [(123456700000000, 0, 1), (100000000, 0, 1), (5, 0, 2), (2**53, 0, 2)])
    assert [r.v for r in df.select(text.short_amount(F.col("a")).alias("v")).collect()] == ["1,234,567", "1", "0.00000005", "90,071,992.54740992"]
    got = {int(r.a): r.j for r in text.json_series(df, ["c"], "a", "j").collect()}
    assert got == {123456700000000: "123456700000000", 100000000: "100000000", 5: '"5"', 2**53: '"9007199254740992"'}


def test_little_endian_numbers(spark):
    df = spark.createDataFrame([(bytearray(b"\x01\x02"),), (bytearray(),), (bytearray(b"\x00" * 15 + b"\x10"),)], "b binary")
    assert [r.v and int(r.v) for r in df.select(text.u128_le(F.col("b")).alias("v")).collect()] == [513, None, 16 * 256**15]
