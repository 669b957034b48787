"""Scalar functions on goldens and odd input."""

from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticklake.functions import scalars as X


def run(spark, values, kind, expr):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}").select("i", expr(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_parse_fixed(spark):
    cases = {"1": 10**8, "-0.5": -(5 * 10**7), ".25": 25 * 10**6, "5.": 5 * 10**8, "1e-8": 1, "1e-9": None, "0.000000010": 1, "0.000000001": None, "": None, ".": None, " 1": None, "1 ": None, "1e": None, "+2E2": 2 * 10**10, "92233720368.54775807": 2**63 - 1, "92233720368.54775808": None, "1e30": None, "0e99": 0, "-0": 0, "1.2.3": None, "0x1": None}
    assert run(spark, list(cases), "string", X.parse_fixed) == list(cases.values())


def test_round_trip(spark):
    values = [0, 1, -1, 10**8, -(10**8), 123456789, 2**63 - 1, -(2**63) + 1, 10, 100000000000]
    texts = run(spark, values, "bigint", X.format_fixed)
    assert [int(Decimal(t) * 10**8) for t in texts] == values
    assert texts[:4] == ["0", "0.00000001", "-0.00000001", "1"]
    assert run(spark, texts, "string", X.parse_fixed) == values


def test_parse_fixed_matches_decimal(spark):
    @settings(max_examples=5, deadline=None, database=None)
    @given(st.lists(st.decimals(min_value=-(10**10), max_value=10**10, places=8), min_size=1, max_size=40))
    def check(values):
        assert run(spark, [f"{v:f}" for v in values], "string", X.parse_fixed) == [int(v * 10**8) for v in values]

    check()


def test_rfc3339(spark):
    cases = {"1970-01-01T00:00:00Z": 0, "2024-02-29T12:00:00.5Z": 1709208000500000000, "2023-02-29T00:00:00Z": None, "2024-01-01t00:00:00.123456789z": 1704067200123456789, "2024-01-01T00:00:00.1234567890Z": None, "2024-01-01T00:00:00+00:00": None, "1969-12-31T23:59:59Z": None, "2024-01-01T24:00:00Z": None, "2024-01-01T00:00:00Zx": None, "2024-13-01T00:00:00Z": None, "2024-01-01 00:00:00Z": None}
    assert run(spark, list(cases), "string", X.rfc3339_ns) == list(cases.values())


def test_book_checksum_golden(spark):
    # fixed values: one level a side at (7, 8) and (5, 8) decimals
    for asks, bids, decimals, crc in [((12345670, 250000000), (12345600, 100), (7, 8), 1347474524), ((52345000, 100000000000), (52344000, 1), (5, 8), 984447197)]:
        from ticklake.plans.books import book_crc

        rows = spark.createDataFrame([(1, "A", *asks, 1, *decimals), (1, "B", *bids, 1, *decimals)], "qid int, side string, price bigint, qty bigint, rank int, price_decimals int, qty_decimals int")
        assert book_crc(rows).first().crc == crc


def test_zigzag_and_varint(spark):
    assert run(spark, [0, -1, 1, -2, 2**40], "bigint", X.zigzag) == [0, 1, 2, 3, 2**41]
    assert run(spark, [0, 127, 128, 16383, 16384, 2**62], "bigint", X.varint_len) == [1, 1, 2, 2, 3, 9]
