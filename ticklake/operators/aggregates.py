"""Aggregations over ticks: exact sums, nearest-rank and floor-index percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklake import schema as S
from ticklake.operators import cells

WIDE = "decimal(38,0)"


def wide_sum(column: str | Column) -> Column:
    """A sum of 64-bit integers that cannot overflow."""
    return F.sum((F.col(column) if isinstance(column, str) else column).cast(WIDE)).cast(WIDE)


def floor_percentiles(rows: DataFrame, by: list[str], column: str, percents: list[int], width: int = 1_000_000) -> DataFrame:
    """sorted[(n - 1) * p div 100] of each group, by ranks inside cells of values; no group
    is collected or sorted in one task."""
    ranked = cells.numbered(rows.select(*by, column), by, [column], cells.cell(column, width), "_i")
    sizes = rows.groupBy(*by).agg(F.count(column).alias("_n"))
    ranked = ranked.join(sizes, by)
    return ranked.groupBy(*by).agg(*[F.max(F.when(F.col("_i") - 1 == F.call_function("div", (F.col("_n") - 1) * p, F.lit(100)), F.col(column))).alias(f"p{p}") for p in percents])


def instrument_scan(ticks: DataFrame) -> DataFrame:
    """Count, exact quantity sum, price range and last time of each instrument."""
    return ticks.groupBy("instrument").agg(
        F.count("*").alias("n"), wide_sum("qty").alias("sum_qty"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.max("recv_mono").alias("last_mono")
    )


def zone_map(ticks: DataFrame, size: int) -> DataFrame:
    """Count and ranges of each block of ``size`` ticks of an instrument, in order."""
    placed = cells.numbered(ticks, "instrument", list(S.ORDER), cells.cell("recv_mono"))
    return placed.withColumn("block", F.call_function("div", F.col("place") - 1, F.lit(size))).groupBy("instrument", "block").agg(
        F.count("*").alias("n"), F.min("recv_mono").alias("min_mono"), F.max("recv_mono").alias("max_mono"), F.min("recv_wall").alias("min_wall"), F.max("recv_wall").alias("max_wall")
    )


def last_row(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The row of each group with the largest ``order``, by one aggregation."""
    return rows.groupBy(*by).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in by]), order).alias("_r")).select(*by, "_r.*")
