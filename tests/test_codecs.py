"""Venue frames by hand: several entries, bad ones, brackets, control messages; streams."""

import pytest
from pyspark.sql import functions as F

from ticklake.operators import codecs
from ticklake.sources.ticks import instruments

T = "2024-01-01T00:00:01Z"
NS = 1_704_067_201_000_000_000


def decode(spark, venue, *payloads):
    frames = spark.createDataFrame(list(enumerate(payloads)), "frame_id bigint, payload string")
    return {1: codecs.decode_coinbase, 2: codecs.decode_binance, 3: codecs.decode_kraken}[venue](frames, instruments(spark))


def causes(got):
    return [(r.signal, r.cause, None if r.ticks is None else len(r.ticks)) for r in got.orderBy("frame_id").collect()]


def test_coinbase(spark):
    got = decode(
        spark, 1,
        '{"type":"l2update","product_id":"BTC-USD","changes":[["buy","1.5","2"],["sell","3","0"]],"time":"%s"}' % T,
        '{"type":"l2update","product_id":"BTC-USD","changes":[["hold","1.5","2"]],"time":"%s"}' % T,
        '{"type":"l2update","product_id":"BTC-USD","changes":[["buy","1.5","2"]]}',
        '{"type":"l2update","product_id":"BTC-USD","changes":[["buy","1.5","2"]],"time":"noon"}',
        '{"type":"l2update","product_id":"XXX-USD","changes":[["buy","1.5","2"]],"time":"%s"}' % T,
        '{"type":"l2update","product_id":"BTC-USD","changes":[["buy","1.123456789","2"]],"time":"%s"}' % T,
        '{"type":"match","trade_id":7,"side":"buy","size":"1","price":"2","product_id":"ETH-USD","sequence":9,"time":"%s"}' % T,
        '{"type":"subscriptions"}', '{"type":"ticker"}', "not json", '{"type":"snapshot","product_id":"BTC-USD","bids":[["1","1"]]}',
    ).cache()
    assert causes(got) == [("data", None, 2), ("data", "side", 1), ("data", None, 1), ("data", "time", 1), ("data", "unknown_symbol", 1), ("data", "level", 1), ("data", None, 1), ("control", None, None), ("ignored", None, None), ("malformed", "structure", None), ("data", "structure", None)]
    rows = [tuple(r) for r in codecs.ticks(got).orderBy("frame_id", "sub").select("frame_id", "sub", "instrument", "kind", "price", "qty", "aux", "flags", "venue_ts", "venue_seq").collect()]
    assert rows == [(0, 0, 1, 1, 150_000_000, 200_000_000, 0, 0, NS, 0), (0, 1, 1, 2, 300_000_000, 0, 0, 0, NS, 0), (2, 0, 1, 1, 150_000_000, 200_000_000, 0, 0, 0, 0), (6, 0, 2, 3, 200_000_000, 100_000_000, 7, 1, NS, 9)]
    assert codecs.rejects(got).count() == 6


def test_binance(spark):
    got = decode(
        spark, 2,
        '{"stream":"x","data":{"e":"depthUpdate","E":5,"s":"BTCUSDT","U":1,"u":2,"b":[["1","2"],["1","0"]],"a":[]}}',
        '{"stream":"x","data":{"e":"trade","E":5,"s":"BTCUSDT","t":3,"p":"1","q":"2","T":6,"m":maybe}}',
        '{"stream":"x","data":{"e":"trade","E":5,"s":"BTCUSDT","t":3,"p":"1","q":"2","T":6,"m":false,"M":true}}',
        '{"result":null,"id":1}', '{"stream":"!serverShutdown","data":{"e":"serverShutdown","E":1}}', '{"stream":"x","data":{"e":"kline"}}', '{"stream":"x","data":{"e":"depthUpdate","E":5,"s":"BTCUSDT","u":2,"b":[],"a":[]}}',
    ).cache()
    told = causes(got)
    assert [told[i] for i in (0, 2, 3, 4, 5, 6)] == [("data", None, 2), ("data", None, 1), ("control", None, None), ("reconnect", None, None), ("ignored", None, None), ("data", "structure", None)]
    assert told[1][1] is not None
    trade = codecs.ticks(got).where("kind = 3").first()
    assert (trade.aux, trade.venue_seq, trade.flags, trade.venue_ts) == (3, 3, 0, 6_000_000)


@pytest.mark.parametrize("entries", [0, 1, 2, 3])
def test_kraken_frames_of_several_entries(spark, entries):
    entry = '{"symbol":"BTC/USD","side":"%s","price":%d.5,"qty":2,"ord_type":"limit","trade_id":%d,"timestamp":"' + T + '"}'
    trades = ",".join(entry % ("sell" if i % 2 else "buy", i, i) for i in range(entries))
    got = codecs.ticks(decode(spark, 3, '{"channel":"trade","type":"update","data":[%s]}' % trades)).orderBy("sub").collect()
    assert [(r.sub, r.price, r.aux, r.flags) for r in got] == [(i, i * 100_000_000 + 50_000_000, i, i % 2) for i in range(entries)]
    bad = decode(spark, 3, '{"channel":"trade","type":"update","data":[%s]}' % ",".join([trades] * (entries > 0) + [entry % ("hold", 1, 1)]))
    assert causes(bad) == [("data", "side", entries + 1)]
    book = '{"symbol":"BTC/USD","bids":[{"price":1.0,"qty":2}],"asks":[],"checksum":%d,"timestamp":"' + T + '"}'
    got = codecs.ticks(decode(spark, 3, '{"channel":"book","type":"update","data":[%s]}' % ",".join(book % i for i in range(entries)))).orderBy("sub").collect()
    assert [(r.kind, r.aux) for r in got] == [x for i in range(entries) for x in ((1, 0), (8, i))]


def test_kraken_control(spark):
    got = decode(spark, 3, '{"channel":"heartbeat"}', '{"channel":"status","type":"update","data":[]}', '{"method":"subscribe","success":true}', '{"channel":"book","type":"odd","data":[]}')
    assert [x[:2] for x in causes(got)] == [("data", None), ("control", None), ("control", None), ("malformed", "structure")]
    assert [(r.kind, r.instrument) for r in codecs.ticks(got).collect()] == [(9, 0)]


def test_stream_chain_equals_batch(spark):
    from ticklake.plans.registry import load

    queries = load()
    d = "/root/testdata/sf0.001"
    key = ["instrument", "frame_id", "verdict", "missed"]
    batch = sorted(tuple(r) for r in queries["depth_chain"].run(spark, d).select(*key).collect())
    streamed = sorted(tuple(r) for r in queries["stream_depth_chain"].run(spark, d).select(*key).collect())
    assert batch == streamed and {x[2] for x in batch} >= {"applied"}


def test_chain_ticks(spark):
    depth = spark.createDataFrame([(1, i, s, 1, 100, 5, 0, i) for i in range(5) for s in range(2)], "instrument int, frame_id bigint, sub int, kind int, price bigint, qty bigint, venue_ts bigint, venue_seq bigint")
    diffs = spark.createDataFrame([(1, 0, True, None, 10), (1, 1, False, 11, 12), (1, 2, False, 12, 12), (1, 3, False, 20, 21), (1, 4, False, 22, 22)], "instrument int, frame_id bigint, snapshot boolean, first_u bigint, final_u bigint")
    verdicts = codecs.depth_chain(diffs)
    assert [(r.verdict, r.missed) for r in verdicts.orderBy("frame_id").collect()] == [("synced", 0), ("applied", 0), ("stale", 0), ("gap", 7), ("early", 0)]
    got = codecs.chain_ticks(depth, verdicts).orderBy("frame_id", "sub").collect()
    assert [(r.frame_id, r.kind, r.aux) for r in got] == [(1, 1, 0), (1, 1, 0), (3, 10, 7)]


def test_stream_resumes(spark, tmp_path):
    """The state goes on from where the stream stopped; rows are added, none repeated."""
    from ticklake.streaming import stateful

    schema = "instrument int, spot bigint, id bigint"
    first = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], schema)
    first.write.parquet(f"{tmp_path}/in/a")
    progress = f"{tmp_path}/progress"
    assert stateful.drain(spark, f"{tmp_path}/in", schema, stateful.trade_gaps, progress).count() == 0
    spark.createDataFrame([(1, 3, 6)], schema).write.parquet(f"{tmp_path}/in/b")
    got = stateful.drain(spark, f"{tmp_path}/in", schema, stateful.trade_gaps, progress)
    assert [tuple(r) for r in got.collect()] == [(1, 6, 3)]
    assert stateful.drain(spark, f"{tmp_path}/in", schema, stateful.trade_gaps, progress).count() == 1


def test_segments_on_disk(spark, tmp_path):
    from ticklake.sources import segments

    frames = spark.range(500).select((F.col("id") % 2 + 1).cast("int").alias("venue"), F.col("id").alias("event_id"), F.lit(0).alias("sub"), F.col("id").alias("recv_mono"), (F.col("id") + 7).alias("recv_wall"), F.concat(F.lit("x"), F.col("id")).alias("payload"))
    root = f"{tmp_path}/raw"
    segments.write(frames, root, 1000)
    # what a lost task leaves behind is not read
    (tmp_path / "raw" / "1" / "1-0-0-left.fbraw").write_bytes(segments.encode(1, [(1, 0, 0, b"left")]))
    files = segments.read(spark, root)
    assert files.count() > 10 and files.agg(F.max(F.length("content"))).first()[0] <= 1034
    got = segments.records(files).select("venue", "recv_mono", F.col("payload").cast("string")).collect()
    assert sorted(tuple(r) for r in got) == sorted((i % 2 + 1, i, f"x{i}") for i in range(500))


def test_store_pushes_time_bounds(spark):
    from ticklake.plans.registry import load

    plan = load()["range_scan"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(recv_mono,500000000000000)" in plan
