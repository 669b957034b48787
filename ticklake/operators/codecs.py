"""Venue messages to ticks: declarative JSON with explicit schemas, one row a level.

``decode_*`` read frames (frame_id, payload) to one row a frame: its signal (data, control,
reconnect or ignored), the cause of its rejection, if any, and its ticks.  A frame is good
or bad as a whole: one bad level, side, symbol or time rejects it.  ``ticks`` gives the
ticks of good frames, ``rejects`` the bad frames with their causes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklake import schema as S
from ticklake.functions import scalars as X

_COINBASE = "type string, product_id string, trade_id bigint, last_trade_id bigint, side string, size string, price string, sequence bigint, time string, changes array<array<string>>, bids array<array<string>>, asks array<array<string>>"
_BINANCE = "stream string, result string, id bigint, data struct<e:string,event_ms:bigint,s:string,first_u:bigint,u:bigint,t:bigint,p:string,q:string,trade_ms:bigint,m:string,b:array<array<string>>,a:array<array<string>>>"
_KRAKEN = "channel string, type string, method string, data array<struct<symbol:string,bids:array<struct<price:string,qty:string>>,asks:array<struct<price:string,qty:string>>,checksum:bigint,timestamp:string,side:string,price:string,qty:string,trade_id:bigint>>"
_REST = "sequence bigint, lastUpdateId bigint, bids array<array<string>>, asks array<array<string>>"
_TICK = "array<struct<instrument:int,kind:int,price:bigint,qty:bigint,aux:bigint,flags:int,venue_ts:bigint,venue_seq:bigint>>"


def _zero() -> Column:
    return F.lit(0).cast("bigint")


#: Registered symbols of a venue at most; beyond that the registry is no dimension any more.
MOST_SYMBOLS = 100_000


def _with_symbols(frames: DataFrame, dim: DataFrame, venue: int) -> DataFrame:
    """Frames with the venue's symbols and instruments in one map: one row, whose size is checked."""
    own = dim.where(F.col("venue") == venue).groupBy().agg(F.map_from_entries(F.collect_list(F.struct("venue_symbol", "instrument"))).alias("symbols"))
    few = F.assert_true(F.size("symbols") <= MOST_SYMBOLS, "too many symbols")
    return frames.crossJoin(F.broadcast(own.where(few.isNull())))


def _tick(instrument: Column, kind: Column | int, ts: Column, seq: Column, price: Column | None = None, qty: Column | None = None, aux: Column | None = None, flags: Column | int = 0) -> Column:
    number = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("int")
    return F.struct(
        instrument.cast("int").alias("instrument"), number(kind).alias("kind"), (_zero() if price is None else price).alias("price"), (_zero() if qty is None else qty).alias("qty"), (_zero() if aux is None else aux).cast("bigint").alias("aux"),
        number(flags).alias("flags"), ts.cast("bigint").alias("venue_ts"), seq.cast("bigint").alias("venue_seq"),
    )


def _levels(levels: Column, kind: int, instrument: Column, ts: Column, seq: Column, flags: int = 0, named: bool = False) -> Column:
    """Ticks of an array of [price, quantity, ...] or of {price, qty}."""
    part = (lambda v, i: v["price" if i == 1 else "qty"]) if named else (lambda v, i: F.try_element_at(v, F.lit(i)))
    return F.transform(levels, lambda v: _tick(instrument, kind, ts, seq, X.parse_fixed(part(v, 1)), X.parse_fixed(part(v, 2)), flags=flags))


def _bracket(bids: Column, asks: Column, instrument: Column, ts: Column, seq: Column, flags: int, named: bool = False, end_aux: Column | None = None) -> Column:
    """A snapshot: clear, begin (aux: number of levels), bids, asks, end.  Null without both sides."""
    mark = lambda kind, aux=None: F.array(_tick(instrument, kind, ts, seq, aux=aux, flags=flags))
    sides = [_levels(x, kind, instrument, ts, seq, flags, named) for x, kind in ((bids, S.SNAP_BID), (asks, S.SNAP_ASK))]
    return F.concat(mark(S.CLEAR), mark(S.SNAP_BEGIN, F.size(bids) + F.size(asks)), *sides, mark(S.SNAP_END, end_aux))


def _judged(frames: DataFrame, signal: Column, ticks: Column) -> DataFrame:
    """frame_id, signal, cause and ticks; frames that are no data have no ticks and no cause.
    The ticks come out of a generator, so that what is asked of them later is not pushed
    below them, where it would repeat all their expressions."""
    made = F.struct(signal.alias("signal"), F.when(signal == "data", ticks).cast(_TICK).alias("ticks"))
    got = frames.select("frame_id", F.explode(F.array(made)).alias("d")).select("frame_id", "d.signal", "d.ticks")
    bad = lambda test: F.exists("ticks", test)
    cause = (
        F.when(F.col("signal") == "malformed", "structure")
        .when(F.col("signal") != "data", F.lit(None))
        .when(F.col("ticks").isNull(), "structure")
        .when(bad(lambda t: t["instrument"].isNull()), "unknown_symbol")
        .when(bad(lambda t: t["kind"].isNull() | t["flags"].isNull()), "side")
        .when(bad(lambda t: t["price"].isNull() | t["qty"].isNull()), "level")
        .when(bad(lambda t: t["venue_ts"].isNull()), "time")
        .when(bad(lambda t: t["venue_seq"].isNull() | t["aux"].isNull()), "structure")
    )
    return got.select("frame_id", "signal", cause.alias("cause"), "ticks")


def ticks(decoded: DataFrame) -> DataFrame:
    """One row a tick of good frames, numbered by ``sub`` in the frame's order."""
    return decoded.where("cause is null").select("frame_id", F.posexplode("ticks").alias("sub", "x")).select("frame_id", "sub", "x.*")


def rejects(decoded: DataFrame) -> DataFrame:
    return decoded.where("cause is not null").select("frame_id", "cause")


def _time(text: Column) -> Column:
    """Nanoseconds of a time that may be absent (0); null if it is there and no time."""
    return F.when(text.isNull(), _zero()).otherwise(X.rfc3339_ns(text))


def decode_coinbase(frames: DataFrame, dim: DataFrame) -> DataFrame:
    """``snapshot`` brackets, ``l2update`` sets in payload order, trades of ``match`` (the
    named side is the maker's) and ``heartbeat`` (aux: last trade id)."""
    m = _with_symbols(frames.select("frame_id", F.from_json("payload", _COINBASE).alias("m")), dim, 1).select("frame_id", "m.*", "symbols")
    m = m.withColumns({"instrument": F.try_element_at("symbols", F.col("product_id")), "ts": _time(F.col("time"))}).drop("symbols")
    one, ts, seq, kind = F.col("instrument"), F.col("ts"), F.col("sequence"), F.col("type")
    side = lambda c: F.when(F.try_element_at(c, F.lit(1)) == "buy", S.BID_SET).when(F.try_element_at(c, F.lit(1)) == "sell", S.ASK_SET)
    sets = F.transform("changes", lambda c: _tick(one, side(c), ts, _zero(), X.parse_fixed(F.try_element_at(c, F.lit(2))), X.parse_fixed(F.try_element_at(c, F.lit(3)))))
    trade = F.array(_tick(one, S.TRADE, ts, seq, X.parse_fixed(F.col("price")), X.parse_fixed(F.col("size")), F.col("trade_id"), X.taker_side(F.lit(1), F.col("side"))))
    beat = F.array(_tick(one, S.HEARTBEAT, ts, seq, aux=F.col("last_trade_id")))
    found = F.when(kind == "l2update", sets).when(kind == "snapshot", _bracket(F.col("bids"), F.col("asks"), one, ts, _zero(), S.FROM_SNAPSHOT)).when(kind == "heartbeat", beat).otherwise(trade)
    signal = F.when(kind.isNull(), "malformed").when(kind.isin("snapshot", "l2update", "match", "last_match", "heartbeat"), "data").when(kind.isin("subscriptions", "error"), "control").otherwise("ignored")
    return _judged(m, signal, found)


def _capitals(payload: Column) -> Column:
    """Names for the keys that differ from others by case alone, which columns may not."""
    for key, name in (("E", "event_ms"), ("U", "first_u"), ("T", "trade_ms")):
        payload = F.replace(payload, F.lit(f'"{key}":'), F.lit(f'"{name}":'))
    return payload


def decode_binance(frames: DataFrame, dim: DataFrame) -> DataFrame:
    """``depthUpdate``: bids then asks, before the chain of update ids is applied; ``trade``
    (seq and aux: trade id); ``serverShutdown`` asks to reconnect; answers are control."""
    m = frames.select("frame_id", F.from_json(_capitals(F.col("payload")), _BINANCE).alias("m"), F.col("payload").rlike(r'^\s*\{\s*"(result|id|error)"\s*:').alias("answer"))
    m = _with_symbols(m, dim, 2).select("frame_id", "answer", "m.stream", "m.data.*", "symbols")
    m = m.withColumn("instrument", F.try_element_at("symbols", F.col("s"))).drop("symbols")
    one, kind, u = F.col("instrument"), F.col("e"), F.col("u")
    at = lambda ms: F.try_multiply(F.col(ms), F.lit(1_000_000))
    depth = F.when(F.col("first_u").isNotNull(), F.concat(_levels(F.col("b"), S.BID_SET, one, at("event_ms"), u), _levels(F.col("a"), S.ASK_SET, one, at("event_ms"), u)))
    trade = F.array(_tick(one, S.TRADE, at("trade_ms"), F.col("t"), X.parse_fixed(F.col("p")), X.parse_fixed(F.col("q")), F.col("t"), X.taker_side(F.lit(2), F.col("m"))))
    signal = F.when(F.col("answer"), "control").when(F.col("stream").isNull() | kind.isNull(), "malformed").when(kind.isin("depthUpdate", "trade"), "data").when(kind == "serverShutdown", "reconnect").otherwise("ignored")
    return _judged(m, signal, F.when(kind == "depthUpdate", depth).otherwise(trade))


def decode_kraken(frames: DataFrame, dim: DataFrame) -> DataFrame:
    """``book`` snapshots as brackets (end aux: checksum, no time) and updates as sets and a
    checksum tick, ``trade`` as trades, entry after entry; ``heartbeat`` without instrument.
    Number tokens are kept as text, so no digit is lost."""
    m = _with_symbols(frames.select("frame_id", F.from_json(X.quote_numbers(F.col("payload")), _KRAKEN).alias("m")), dim, 3).select("frame_id", "m.*", "symbols")
    snap = F.col("type") == "snapshot"

    def book(e: Column) -> Column:
        one, ts = F.try_element_at("symbols", e["symbol"]), X.rfc3339_ns(e["timestamp"])
        sets = [_levels(F.coalesce(e[side], F.array().cast("array<struct<price:string,qty:string>>")), kind, one, ts, _zero(), named=True) for side, kind in (("bids", S.BID_SET), ("asks", S.ASK_SET))]
        update = F.concat(*sets, F.array(_tick(one, S.CHECKSUM, ts, _zero(), aux=e["checksum"])))
        return F.when(snap, _bracket(e["bids"], e["asks"], one, _zero(), _zero(), S.FROM_SNAPSHOT, True, e["checksum"])).otherwise(update)

    def trade(e: Column) -> Column:
        sold = X.taker_side(F.lit(3), e["side"])
        flags = sold + F.when(snap, S.FROM_SNAPSHOT).otherwise(0)
        return F.array(_tick(F.try_element_at("symbols", e["symbol"]), S.TRADE, X.rfc3339_ns(e["timestamp"]), e["trade_id"], X.parse_fixed(e["price"]), X.parse_fixed(e["qty"]), e["trade_id"], flags))

    channel = F.col("channel")
    beat = F.array(_tick(F.lit(0), S.HEARTBEAT, _zero(), _zero()))
    # flatten is null if an entry is, so a bad entry rejects the frame
    found = F.when(channel == "book", F.flatten(F.transform("data", book))).when(channel == "trade", F.flatten(F.transform("data", trade))).otherwise(beat)
    signal = F.when(channel.isin("book", "trade"), F.when(F.col("type").isin("snapshot", "update"), "data").otherwise("malformed")).when(channel == "heartbeat", "data")
    signal = signal.when((channel == "status") | F.col("method").isNotNull(), "control").when(channel.isNull(), "malformed").otherwise("ignored")
    return _judged(m, signal, found)


def decode_rest(bodies: DataFrame) -> DataFrame:
    """REST books (frame_id, venue, instrument, payload) as synthetic brackets: the first
    venue's levels are triples, its time is the last in the body and its seq the sequence;
    the second's seq is the last update id, and it has no time."""
    m = bodies.select("frame_id", "venue", "instrument", "payload", F.from_json("payload", _REST).alias("m")).select("*", "m.*")
    flags = S.FROM_SNAPSHOT | S.SYNTHETIC
    last = F.element_at(F.split("payload", '"time"\\s*:'), -1)
    time = F.when(F.col("payload").rlike('"time"\\s*:'), X.rfc3339_ns(F.regexp_extract(last, r'^\s*"([^"]*)"', 1))).otherwise(_zero())
    first = F.col("venue") == 1
    m = m.withColumns({"ts": F.when(first, time).otherwise(_zero()), "seq": F.when(first, F.col("sequence")).otherwise(F.col("lastUpdateId"))})
    whole = ~first | F.forall(F.concat("bids", "asks"), lambda v: F.size(v) == 3)
    signal = F.when(F.col("seq").isNull() | ~F.coalesce(whole, F.lit(False)), "malformed").otherwise("data")
    return _judged(m, signal, _bracket(F.col("bids"), F.col("asks"), F.col("instrument"), F.col("ts"), F.col("seq"), flags))


_PLAIN = ("frame_id", "sub", "instrument", "kind", "price", "qty", "venue_ts", "venue_seq")


def coinbase_l2(frames: DataFrame, dim: DataFrame) -> DataFrame:
    return ticks(decode_coinbase(frames, dim)).where(F.col("kind").isin(S.BID_SET, S.ASK_SET)).select(*_PLAIN)


def coinbase_match(frames: DataFrame, dim: DataFrame) -> DataFrame:
    return ticks(decode_coinbase(frames, dim)).where(F.col("kind") == S.TRADE).select(*_PLAIN, "flags", "aux")


def binance_depth(frames: DataFrame, dim: DataFrame) -> DataFrame:
    return ticks(decode_binance(frames, dim)).where(F.col("kind").isin(S.BID_SET, S.ASK_SET)).select(*_PLAIN)


def kraken_book(frames: DataFrame, dim: DataFrame) -> DataFrame:
    return ticks(decode_kraken(frames, dim)).where(~F.col("kind").isin(S.TRADE, S.HEARTBEAT)).select(*_PLAIN, "aux")


def kraken_trade(frames: DataFrame, dim: DataFrame) -> DataFrame:
    return ticks(decode_kraken(frames, dim)).where(F.col("kind") == S.TRADE).select(*_PLAIN, "flags", "aux")


_CHAIN = "instrument int, frame_id bigint, verdict string, missed bigint"


def depth_chain(diffs: DataFrame) -> DataFrame:
    """The chain of update ids of each instrument: diffs (first_u, final_u) and snapshots
    (``snapshot`` true, final_u its id), in frame order.

    Verdicts: early (no snapshot yet), stale, applied, gap (with what was missed), and for
    snapshots synced or too_old (behind what the stream has shown).  A snapshot that comes
    while the chain holds always restarts it, so frames are cut into sessions there as far
    as that can be told from the frames alone; a session's rows go by in order through
    sorted partitions, and only the chain's state is held."""
    parts = int(diffs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = diffs.select("instrument", "frame_id", "snapshot", "first_u", "final_u").repartition(parts, "instrument").sortWithinPartitions("instrument", "frame_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = last = high = None
        for batch in batches:
            verdicts, missing = [], np.zeros(batch.num_rows, np.int64)
            for i, (instrument, snapshot, first_u, final_u) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 2, 3, 4)), strict=True)):
                if instrument != at:
                    at, last, high = instrument, None, None
                if snapshot:
                    verdict = "too_old" if high is not None and last is None and final_u < high else "synced"
                    last = final_u if verdict == "synced" else last
                elif last is None:
                    verdict, high = "early", final_u if high is None else max(high, final_u)
                elif final_u <= last:
                    verdict = "stale"
                elif first_u > last + 1:
                    verdict, missing[i], high, last = "gap", first_u - last - 1, final_u, None
                else:
                    verdict, last = "applied", final_u
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(verdicts, pa.string()), pa.array(missing)], names=["instrument", "frame_id", "verdict", "missed"])

    return ranged.mapInArrow(run, _CHAIN)


def chain_ticks(depth: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Depth ticks (frame_id, sub, instrument, ...) after the chain: those of applied frames,
    and for each gap one tick (aux: updates missed) that asks for a new snapshot."""
    told = depth.join(verdicts.select("instrument", "frame_id", "verdict", "missed"), ["instrument", "frame_id"])
    gap = told.where("verdict = 'gap'").withColumn("n", F.row_number().over(Window.partitionBy("instrument", "frame_id").orderBy("sub"))).where("n = 1").drop("n")
    gap = gap.withColumns({"sub": F.lit(0), "kind": F.lit(S.GAP), "price": _zero(), "qty": _zero(), "aux": F.col("missed")})
    kept = told.where("verdict = 'applied'").withColumn("aux", _zero())
    return kept.unionByName(gap).drop("verdict", "missed")


#: Messages and addresses that ask the venues for books and trades.
_SUBSCRIBE = {
    1: ['{"type":"subscribe","product_ids":[<ids>],"channels":["level2_batch","matches","heartbeat"]}'],
    2: ["wss://stream.binance.com:9443/stream?streams=<streams>"],
    3: ['{"method":"subscribe","params":{"channel":"book","symbol":[<ids>],"depth":100}}', '{"method":"subscribe","params":{"channel":"trade","symbol":[<ids>],"snapshot":false}}'],
}


def subscriptions(dim: DataFrame) -> DataFrame:
    """(venue, place, message) for the symbols of each venue, in the registry's order."""
    symbols = dim.groupBy("venue").agg(F.transform(F.sort_array(F.collect_list(F.struct("instrument", "venue_symbol"))), lambda x: x["venue_symbol"]).alias("symbols"))
    ids = F.array_join(F.transform("symbols", lambda s: F.concat(F.lit('"'), s, F.lit('"'))), ",")
    streams = F.array_join(F.transform("symbols", lambda s: F.concat(F.lower(s), F.lit("@depth@100ms/"), F.lower(s), F.lit("@trade"))), "/")
    forms = F.create_map(*[x for venue, texts in _SUBSCRIBE.items() for x in (F.lit(venue), F.array(*map(F.lit, texts)))])
    each = symbols.select("venue", "symbols", F.posexplode(forms[F.col("venue")]).alias("place", "form"))
    message = F.replace(F.replace(F.col("form"), F.lit("<ids>"), ids), F.lit("<streams>"), streams)
    return each.select("venue", (F.col("place") + 1).alias("place"), message.alias("message"))
