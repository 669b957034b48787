"""Running values over keys of any length.

A window over a whole key sorts all its rows in one task.  Here a key is cut into cells of
its order: windows run inside (key, cell), a small table carries what earlier cells hold,
and both meet by an equi-join.  A hot key becomes as many tasks as it has cells.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nanoseconds of a cell of time.
HOURS_6 = 21_600_000_000_000


def cell(column: str | Column, width: int = HOURS_6) -> Column:
    """Cell of an ordering number, as the floor of its quotient."""
    value = F.col(column) if isinstance(column, str) else column
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


@dataclass(frozen=True)
class Running:
    """``kind`` (last, sum or max) of ``value`` over the rows before a row, or with ``upto``
    over these and the row; nulls do not count."""

    kind: str
    value: Column
    upto: bool = False


def last(value: Column, upto: bool = False) -> Running:
    return Running("last", value, upto)


def total(value: Column, upto: bool = False) -> Running:
    return Running("sum", value, upto)


def most(value: Column, upto: bool = False) -> Running:
    return Running("max", value, upto)


def running(rows: DataFrame, key: str | list[str], order: list[str], at: Column, **values: Running) -> DataFrame:
    """Adds the running values to ``rows``.  ``at``: a row's cell, which must never fall along
    ``order``; rows that tie in ``order`` come in any order."""
    keys = [key] if isinstance(key, str) else list(key)
    names = rows.columns
    rows = rows.withColumn("_cell", at)
    own = Window.partitionBy(*keys, "_cell").orderBy(*order)
    frames = {False: own.rowsBetween(Window.unboundedPreceding, -1), True: own.rowsBetween(Window.unboundedPreceding, 0)}
    inside = {"last": lambda v: F.last(v, ignorenulls=True), "sum": F.sum, "max": F.max}
    place = [F.col(c).alias(f"o{i}") for i, c in enumerate(order)]
    whole = {"last": lambda v: F.max(F.when(v.isNotNull(), F.struct(*place, v.alias("v"))))["v"], "sum": F.sum, "max": F.max}
    across = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_cell").agg(*[whole[r.kind](r.value).alias(f"_t_{n}") for n, r in values.items()])
    carried = totals.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_cell").alias("_c"), *[inside[r.kind](F.col(f"_t_{n}")).over(across).alias(f"_c_{n}") for n, r in values.items()])
    here = rows.withColumns({f"_l_{n}": inside[r.kind](r.value).over(frames[r.upto]) for n, r in values.items()})
    on = (F.col("_cell") == F.col("_c")) if not keys else None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"_k{i}"))
        on = same if on is None else on & same
    joined = here.join(carried, on & F.col("_cell").eqNullSafe(F.col("_c")))

    def met(name: str, r: Running) -> Column:
        now, before = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if r.kind == "last":
            return F.coalesce(now, before)
        if r.kind == "max":
            return F.greatest(now, before)
        return F.coalesce(now + before, now, before)

    return joined.select(*names, *[met(n, r).alias(n) for n, r in values.items()])


def numbered(rows: DataFrame, key: str | list[str], order: list[str], at: Column, name: str = "place") -> DataFrame:
    """Adds each row's number, from 1, in its key's order."""
    got = running(rows, key, order, at, **{name: total(F.lit(1).cast("bigint"), True)})
    return got


def nearest_ranks(rows: DataFrame, by: str, column: str, millis: dict[str, int], width: float) -> DataFrame:
    """sorted[ceil(n * m / 1000) - 1] of each group for each named m.  Values are counted
    first, and their counts summed up by cells of ``width``; no group meets in one task."""
    counted = rows.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count("*").alias("_n"))
    size = counted.groupBy(F.col(by).alias("_by")).agg(F.sum("_n").alias("_all"))
    ranked = running(counted, by, [column], F.floor(F.col(column) / F.lit(width)).cast("bigint"), _upto=total(F.col("_n"), True))
    placed = ranked.join(size, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    target = lambda m: F.call_function("div", F.col("_all") * m + 999, F.lit(1000))
    return placed.groupBy(by).agg(*[F.min(F.when(F.col("_upto") >= target(m), F.col(column))).alias(name) for name, m in millis.items()])
