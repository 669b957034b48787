"""Time-series operators: counters, gaps, sessions, islands, delta columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklake import schema as S
from ticklake.operators import cells


def counter_delta(column: str, by: Window) -> Column:
    """Growth of a cumulative counter; after a reset the counter itself; null at the start."""
    before = F.lag(column).over(by)
    return F.when(F.col(column) >= before, F.col(column) - before).when(before.isNotNull(), F.col(column))


def sessions(column: str, by: Window) -> Column:
    """Sessions so far: a new one starts where a counter falls."""
    fell = F.col(column) < F.lag(column).over(by)
    return fell


def telemetry(ticks: DataFrame) -> DataFrame:
    """Cumulative counters of each venue and hour, which restart every seventh day.

    Columns: venue, hour, msgs, events, gaps, uptime_s."""
    hour = F.call_function("div", F.col("recv_mono"), F.lit(3_600_000_000_000))
    hourly = ticks.groupBy("venue", hour.alias("hour")).agg(F.count("*").alias("msgs"), F.count_if(F.col("kind") < 8).alias("events"), F.count_if(F.col("kind") == 10).alias("gaps"))
    week = F.call_function("div", F.col("hour"), F.lit(168))
    run = Window.partitionBy("venue", week).orderBy("hour").rowsBetween(Window.unboundedPreceding, 0)
    return hourly.select("venue", "hour", *[F.sum(c).over(run).alias(c) for c in ("msgs", "events", "gaps")], (F.pmod("hour", F.lit(168)) * 3600).alias("uptime_s"))


def islands(rows: DataFrame, key: str, time: str, hole: int) -> DataFrame:
    """Stretches without a pause over ``hole``: key, island, start, end, n."""
    paused = cells.running(rows.select(key, time), key, [time], cells.cell(time), _before=cells.last(F.col(time)))
    new = (F.col(time) - F.col("_before") > hole).cast("bigint")
    found = cells.running(paused.withColumn("_new", F.coalesce(new, F.lit(0).cast("bigint"))), key, [time], cells.cell(time), island=cells.total(F.col("_new"), True))
    return found.groupBy(key, "island").agg(F.min(time).alias("start"), F.max(time).alias("end"), F.count("*").alias("n"))


#: Places of a stream in one cell.
_SPOTS = 100_000


def trade_ids(ticks: DataFrame) -> DataFrame:
    """Trades of each instrument, numbered in order: instrument, recv_mono, event_id, id."""
    trades = ticks.where("kind = 3").select("instrument", *S.ORDER)
    return cells.numbered(trades, "instrument", list(S.ORDER), cells.cell("recv_mono"), "id").drop("sub")


def trades_with_holes(ticks: DataFrame) -> DataFrame:
    """Trade ids of each instrument: its trades numbered in order, some ids dropped and
    some pairs swapped, so that gap detection has something to find.

    Columns: instrument, recv_mono, event_id, id (place in the stream is ``spot``)."""
    kept = trade_ids(ticks).where("id % 11 <> 0")
    return kept.withColumn("spot", F.when(F.col("id") % 13 == 0, F.col("id") + 2).otherwise(F.col("id")) * 2 + (F.col("id") % 13 == 0).cast("int"))


def trade_gaps(trades: DataFrame) -> DataFrame:
    """Ids missed before each trade: it jumps past all that came before (the baseline only
    advances); the first never gaps."""
    seen = cells.running(trades, "instrument", ["spot"], cells.cell("spot", _SPOTS), seen=cells.most(F.col("id")))
    return seen.withColumn("missed", F.when(F.col("id") > F.col("seen") + 1, F.col("id") - F.col("seen") - 1)).where("missed is not null").select("instrument", "id", "missed")


def trade_gaps_by_last(trades: DataFrame) -> DataFrame:
    """Ids missed since the trade just before, whatever its id."""
    told = cells.running(trades, "instrument", ["spot"], cells.cell("spot", _SPOTS), last_id=cells.last(F.col("id")))
    return told.withColumn("missed", F.when(F.col("id") > F.col("last_id") + 1, F.col("id") - F.col("last_id") - 1)).where("missed is not null").select("instrument", "id", "missed")


def heartbeat_gaps(trades: DataFrame, beats: DataFrame) -> DataFrame:
    """Trades that a heartbeat's last id says were missed.  ``beats``: instrument, spot, id.
    A beat before the first trade says nothing; each advances the baseline."""
    both = trades.select("instrument", "spot", "id", F.lit(0).alias("beat")).unionByName(beats.select("instrument", "spot", "id", F.lit(1).alias("beat")))
    first = trades.groupBy("instrument").agg(F.min("spot").alias("first_at"))
    started = both.join(first, "instrument").where("spot >= first_at").drop("first_at")
    seen = cells.running(started, "instrument", ["spot", "beat", "id"], cells.cell("spot", _SPOTS), seen=cells.most(F.col("id")))
    return seen.where("beat = 1 and id > seen").select("instrument", "spot", F.col("id").alias("last_trade_id"), (F.col("id") - F.col("seen")).alias("missed"))


def delta_columns(ticks: DataFrame) -> DataFrame:
    """Deltas and deltas of deltas of each instrument's times and prices, zigzagged."""
    from ticklake.functions.scalars import zigzag

    zero = F.lit(0).cast("bigint")
    order, at = list(S.ORDER), cells.cell("recv_mono")
    rows = ticks.select("instrument", *S.ORDER, "price")
    first = cells.running(rows, "instrument", order, at, p_mono=cells.last(F.col("recv_mono")), p_price=cells.last(F.col("price")))
    first = first.withColumns({"d_mono": F.col("recv_mono") - F.coalesce("p_mono", zero), "d_price": F.col("price") - F.coalesce("p_price", zero)})
    second = cells.running(first, "instrument", order, at, p_delta=cells.last(F.col("d_mono"))).withColumn("dd_mono", F.col("d_mono") - F.coalesce("p_delta", zero))
    return second.select("instrument", "event_id", "sub", "recv_mono", "d_mono", "dd_mono", "d_price", zigzag(F.col("d_price")).alias("zz_price"))


def delta_decoded(deltas: DataFrame) -> DataFrame:
    """The inverse: running sums in order of the stored place."""
    price = F.shiftright("zz_price", 1).bitwiseXOR(-F.col("zz_price").bitwiseAND(1))
    order, at = list(S.ORDER), cells.cell("recv_mono")
    once = cells.running(deltas.withColumn("_p", price), "instrument", order, at, d_again=cells.total(F.col("dd_mono"), True), price=cells.total(F.col("_p"), True))
    twice = cells.running(once, "instrument", order, at, mono_again=cells.total(F.col("d_again"), True))
    return twice.select("instrument", "event_id", "sub", F.col("mono_again").alias("recv_mono"), "price")
