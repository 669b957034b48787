"""Order books in closed form, and as an ordered fold where a depth cap forbids that.

Running values over (instrument, order), cut into cells, give the sync state before each
tick: the last begin, gap or clear decides, and a snapshot end since a begin completes it.  Levels live
from the last begin or clear (the level epoch).  A book at t is, for each side and price,
the last effective tick of the epoch that t falls in, unless it removed the level.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklake import schema as S
from ticklake.operators import cells



_TIME = "recv_mono"


def with_state(ticks: DataFrame) -> DataFrame:
    """Adds sync_state before the tick, whether it takes effect, and its level epoch."""
    kind, place = F.col("kind"), F.struct(*S.ORDER)
    reset = kind.isin(S.SNAP_BEGIN, S.GAP, S.CLEAR)
    rows = cells.running(
        ticks, "instrument", list(S.ORDER), cells.cell(_TIME),
        _reset=cells.last(F.when(reset, F.struct(place.alias("at"), kind.alias("kind")))),
        _end=cells.last(F.when(kind == S.SNAP_END, place)),
        epoch=cells.total(kind.isin(S.SNAP_BEGIN, S.CLEAR).cast("bigint"), True),
    )
    state = F.when(F.coalesce(F.col("_reset.kind") != S.SNAP_BEGIN, F.lit(True)), "Unsynced").when(F.col("_end") > F.col("_reset.at"), "Synced").otherwise("Filling")
    rows = rows.withColumn("sync_state", state)
    effective = (kind.isin(S.BID_SET, S.ASK_SET) & (F.col("sync_state") == "Synced")) | (kind.isin(S.SNAP_BID, S.SNAP_ASK) & (F.col("sync_state") == "Filling"))
    return rows.withColumn("effective", effective).drop("_reset", "_end")


def side() -> Column:
    return F.when(F.col("kind").isin(S.BID_SET, S.SNAP_BID), "B").when(F.col("kind").isin(S.ASK_SET, S.SNAP_ASK), "A")


def outcome() -> Column:
    """What applying a tick to its book does, from its kind and the state before it."""
    kind, state = F.col("kind"), F.col("sync_state")
    return (
        F.when(kind.isin(S.BID_SET, S.ASK_SET), F.when(state == "Synced", "Mutated").otherwise("Dropped"))
        .when(kind.isin(S.SNAP_BID, S.SNAP_ASK), F.when(state == "Filling", "Mutated").otherwise("Dropped"))
        .when(kind == S.SNAP_BEGIN, "SnapshotStarted")
        .when(kind == S.SNAP_END, F.when(state == "Filling", "SnapshotComplete").otherwise("Dropped"))
        .when(kind == S.CHECKSUM, "ChecksumToVerify")
        .when(kind == S.CLEAR, "Cleared")
        .when(kind == S.GAP, "GapMarked")
        .otherwise("NotBook")
    )


def snapshot_index(ticks: DataFrame) -> DataFrame:
    """Complete snapshots: (instrument, mono, event_id, sub) of begins that an end closes."""
    control = ticks.where(F.col("kind").isin(S.SNAP_BEGIN, S.SNAP_END, S.CLEAR))
    control = cells.running(control, "instrument", list(S.ORDER), cells.cell(_TIME), before=cells.last(F.struct("kind", "recv_mono", "event_id", "sub")))
    ends = control.where((F.col("kind") == S.SNAP_END) & (F.col("before.kind") == S.SNAP_BEGIN))
    return ends.select("instrument", F.col("before.recv_mono").alias("mono"), F.col("before.event_id").alias("event_id"), F.col("before.sub").alias("sub"))


def asof(queries: DataFrame, facts: DataFrame, time: str, order: list[str], value: Column) -> DataFrame:
    """Adds ``value`` of the last fact of the query's instrument at or before its ``t``
    (null if none): both sides in one sort of each cell of time, no pair is ever made."""
    names = queries.columns
    left = queries.withColumns({"_t": F.col("t"), "_o": F.lit(None).cast("struct<a:bigint,b:int>"), "_v": F.lit(None).cast(facts.select(value.alias("v")).schema[0].dataType), "_q": F.lit(1)})
    right = facts.select("instrument", F.col(time).alias("_t"), F.struct(F.col(order[0]).cast("bigint").alias("a"), F.col(order[1]).cast("int").alias("b")).alias("_o"), value.alias("_v"), F.lit(0).alias("_q"))
    both = left.unionByName(right, allowMissingColumns=True)
    return cells.running(both, "instrument", ["_t", "_q", "_o"], cells.cell("_t"), found=cells.last(F.col("_v"), True)).where("_q = 1").select(*names, "found")


def levels_at(queries: DataFrame, ticks: DataFrame, width: int = 3_600_000_000_000) -> DataFrame:
    """Book levels (qid, instrument, t, side, price, qty) at each query's time.

    A query finds its epoch.  Of the epoch's effective ticks it meets those of its own cell
    of time, up to its time; what earlier cells left is one quantity for each price and cell,
    folded once for each cell that is asked about, however many queries fall into it."""
    rows = with_state(ticks)
    opened = rows.where(F.col("kind").isin(S.SNAP_BEGIN, S.CLEAR)).select("instrument", "recv_mono", "event_id", "sub", "epoch")
    placed = asof(queries, opened, "recv_mono", ["event_id", "sub"], F.col("epoch")).withColumnRenamed("found", "epoch")
    asked = placed.where("epoch is not null").withColumn("cell", cells.cell("t", width))
    place = F.struct(*S.ORDER)
    moves = rows.where("effective").select("instrument", "epoch", side().alias("side"), "price", "qty", place.alias("at"), cells.cell(_TIME, width).alias("cell"))
    own = ["instrument", "epoch", "side", "price"]
    near = asked.join(moves, ["instrument", "epoch", "cell"]).where(F.col("at.recv_mono") <= F.col("t")).select("qid", "t", *own, "at", "qty")
    left = moves.groupBy(*own, "cell").agg(F.max(F.struct("at", "qty")).alias("x"))
    wanted = asked.select("instrument", "epoch", F.col("cell").alias("asked_cell")).distinct()
    earlier = left.join(wanted, ["instrument", "epoch"]).where(F.col("cell") < F.col("asked_cell")).groupBy(*own, F.col("asked_cell").alias("cell")).agg(F.max("x").alias("x"))
    far = asked.join(earlier, ["instrument", "epoch", "cell"]).select("qid", "t", *own, F.col("x.at").alias("at"), F.col("x.qty").alias("qty"))
    last = near.unionByName(far).groupBy("qid", "instrument", "t", "side", "price").agg(F.max(F.struct("at", "qty"))["qty"].alias("qty"))
    return last.where("qty <> 0")


def tops(levels: DataFrame) -> DataFrame:
    """Best price and quantity of each side, for each query with a level."""
    bid, ask = F.col("side") == "B", F.col("side") == "A"
    return levels.groupBy("qid", "instrument", "t").agg(
        F.max(F.when(bid, F.struct("price", "qty"))).alias("b"), F.min(F.when(ask, F.struct("price", "qty"))).alias("a"),
        F.count_if(bid).alias("bid_depth"), F.count_if(ask).alias("ask_depth"),
    ).select("qid", "instrument", "t", F.col("b.price").alias("bid"), F.col("b.qty").alias("bid_qty"), F.col("a.price").alias("ask"), F.col("a.qty").alias("ask_qty"), "bid_depth", "ask_depth")


def top_n(levels: DataFrame, n: int = 10) -> DataFrame:
    by = Window.partitionBy("qid", "side").orderBy(F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price")))
    return levels.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= n)


_FOLD = "instrument int, epoch bigint, recv_mono bigint, event_id bigint, sub int, bid bigint, bid_qty bigint, ask bigint, ask_qty bigint, bid_depth int, ask_depth int, top_changed boolean"


def fold(ticks: DataFrame, cap: int | dict[int, int] | None = None) -> DataFrame:
    """The book after every effective tick, by an ordered fold of each level epoch.  ``cap``:
    levels a side holds at most, for all or by venue; beyond it the worst goes.

    Epochs begin with an empty book, so they are independent, with a depth cap too: the
    rows are dealt by (instrument, epoch) and no instrument is one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by epoch and order; one book is held at a time."""
        names, kinds = [p.split()[0] for p in _FOLD.split(", ")], {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
        types = [kinds[p.split()[1]] for p in _FOLD.split(", ")]
        key, books, best = None, {}, {}
        for batch in batches:
            out = []
            for instrument, epoch, kind, s, price, qty, mono, event, sub, venue in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (instrument, epoch) != key:
                    key, books, best = (instrument, epoch), {"B": {}, "A": {}}, {"B": None, "A": None}
                levels, pick = books[s], max if s == "B" else min
                if qty == 0:
                    levels.pop(price, None)
                else:
                    levels[price] = qty
                    most = cap.get(venue) if isinstance(cap, dict) else cap
                    if most is not None and len(levels) > most:
                        del levels[min(levels) if s == "B" else max(levels)]
                top = pick(levels) if levels else None
                now = None if top is None else (top, levels[top])
                changed = now != best[s] or kind in (S.SNAP_BID, S.SNAP_ASK)
                best[s] = now
                out.append((instrument, epoch, mono, event, sub, *(best["B"] or (None, None)), *(best["A"] or (None, None)), len(books["B"]), len(books["A"]), changed))
            columns = list(zip(*out, strict=True)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    moves = with_state(ticks).where("effective").select("instrument", "epoch", "kind", side().alias("side"), "price", "qty", *S.ORDER, "venue")
    return moves.repartition("instrument", "epoch").sortWithinPartitions("instrument", "epoch", *S.ORDER).mapInArrow(run, _FOLD)


def folded_at(ticks: DataFrame, asked: str) -> DataFrame:
    """Levels (qid, instrument, t, side, price, qty) of the book at each tick that meets the
    condition ``asked`` on its state (qid: its event), by the ordered fold."""
    rows = with_state(ticks).withColumn("asks", F.expr(asked))
    moves = rows.where("effective or asks").select("instrument", "epoch", side().alias("side"), "price", "qty", *S.ORDER, "asks")
    moves = moves.repartition("instrument", "epoch").sortWithinPartitions("instrument", "epoch", *S.ORDER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, books = None, {}
        names, kinds = ["qid", "instrument", "t", "side", "price", "qty"], [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            out = []
            for instrument, epoch, s, price, qty, mono, event, _, asks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (instrument, epoch) != key:
                    key, books = (instrument, epoch), {}
                if asks:
                    out += [(event, instrument, mono, *level, n) for level, n in books.items()]
                elif qty == 0:
                    books.pop((s, price), None)
                else:
                    books[s, price] = qty
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return moves.mapInArrow(run, "qid bigint, instrument int, t bigint, side string, price bigint, qty bigint")


def _fnv(data: bytes, state: int = 0xCBF29CE484222325) -> int:
    # fixed values: offset and prime of FNV-1a with 64 bits
    for b in data:
        state = (state ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return state


def book_digests(ticks: DataFrame) -> DataFrame:
    """FNV-1a digest of each instrument's final book: asks ascending, bids descending, sync flag."""
    rows = with_state(ticks)
    final = rows.groupBy("instrument").agg(F.max("epoch").alias("epoch"), F.max_by(F.struct("sync_state", "kind"), F.struct(*S.ORDER)).alias("last"))
    state, kind = F.col("last.sync_state"), F.col("last.kind")
    synced = F.when(kind.isin(S.SNAP_BEGIN, S.GAP, S.CLEAR), False).when((kind == S.SNAP_END) & (state == "Filling"), True).otherwise(state == "Synced")
    moves = rows.where("effective").select("instrument", "epoch", side().alias("side"), "price", "qty", *S.ORDER).join(final, ["instrument", "epoch"])
    level = moves.groupBy("instrument", "side", "price").agg(F.max_by("qty", F.struct(*S.ORDER)).alias("qty")).where("qty <> 0")
    sides = level.groupBy("instrument").agg(*[F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("price", "qty")))).alias(s) for s in "AB"])
    books = final.select("instrument", synced.alias("synced")).join(sides, "instrument", "left")

    @F.pandas_udf("string")
    def digest(asks: pd.Series, bids: pd.Series, flag: pd.Series) -> pd.Series:
        def pack(side: list) -> bytes:
            return b"".join(int(x).to_bytes(8, "little", signed=True) for level in side for x in (level["price"], level["qty"]))

        def one(a: list | None, b: list | None, s: bool) -> str:
            a, b = list(a) if a is not None else [], list(b)[::-1] if b is not None else []
            return f"{_fnv(b'A' + pack(a) + b'B' + pack(b) + bytes([s])):016x}"

        return pd.Series([one(*x) for x in zip(asks, bids, flag, strict=True)])

    return books.select("instrument", "synced", digest("A", "B", "synced").alias("digest"))


def stream_digest(ticks: DataFrame) -> DataFrame:
    """Order-sensitive FNV-1a digest of the ticks of each instrument."""
    fields = ["recv_mono", "price", "qty", "aux", "kind"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state, n = None, 0, 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                if r.instrument != at:
                    if at is not None:
                        yield pd.DataFrame([(at, n, f"{state:016x}")], columns=["instrument", "n", "digest"])
                    at, state, n = r.instrument, 0xCBF29CE484222325, 0
                state, n = _fnv(b"".join(int(getattr(r, f)).to_bytes(8, "little", signed=True) for f in fields), state), n + 1
        if at is not None:
            yield pd.DataFrame([(at, n, f"{state:016x}")], columns=["instrument", "n", "digest"])

    ordered = ticks.repartition("instrument").sortWithinPartitions("instrument", *S.ORDER).select("instrument", *fields)
    return ordered.mapInPandas(run, "instrument int, n bigint, digest string")
