"""The scalar functions as SQL functions of a session, by their rules in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name: (parameters, result, rule)
FUNCTIONS = {
    "fixed_to_double": ("m BIGINT", "DOUBLE", "m / 100000000D"),
    "tick_side": ("kind INT", "STRING", "CASE WHEN kind IN (1, 5) THEN 'B' WHEN kind IN (2, 6) THEN 'A' END"),
    "is_book": ("kind INT", "BOOLEAN", "kind IN (1, 2, 4, 5, 6, 7, 11)"),
    "zigzag": ("v BIGINT", "BIGINT", "shiftleft(v, 1) ^ shiftright(v, 63)"),
    "unzigzag": ("v BIGINT", "BIGINT", "shiftrightunsigned(v, 1) ^ -(v & 1)"),
    "old_wsname": ("name STRING", "STRING", "array_join(transform(split(name, '/'), p -> CASE p WHEN 'BTC' THEN 'XBT' WHEN 'DOGE' THEN 'XDG' ELSE p END), '/')"),
    "to_unix_sec": ("n DOUBLE", "DOUBLE", "CASE WHEN n <= 0 THEN 0D WHEN n >= 1e17 THEN n / 1e9 WHEN n >= 1e14 THEN n / 1e6 WHEN n >= 1e11 THEN n / 1e3 ELSE n END"),
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; their names."""
    for name, (parameters, result, rule) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {rule}")
    return list(FUNCTIONS)
