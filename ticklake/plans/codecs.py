"""Venue messages, symbol joins and the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake import schema as S
from ticklake.functions import scalars as X
from ticklake.operators import codecs
from ticklake.plans.registry import query
from ticklake.plans.sql import TICKS
from ticklake.sources.ticks import instruments, pair_decimals, read_ticks

_FIX = "price // 100000000 || '.' || lpad(CAST(price % 100000000 AS VARCHAR), 8, '0')"
_QFIX = "qty // 100000000 || '.' || lpad(CAST(qty % 100000000 AS VARCHAR), 8, '0')"
_TIME = "'2024-01-01T00:00:' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || 'Z'"
_TIME_NS = "1704067200000000000 + event_id % 60 * 1000000000 + event_id % 1000 * 1000000"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Ticks with their numbers as decimal text and a time text."""
    def text(c: str):  # noqa: E306
        return F.concat(F.call_function("div", F.col(c), F.lit(S.SCALE)).cast("string"), F.lit("."), F.lpad((F.col(c) % S.SCALE).cast("string"), 8, "0"))

    time = F.concat(F.lit("2024-01-01T00:00:"), F.lpad((F.col("event_id") % 60).cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"), F.lit("Z"))
    return read_ticks(spark, d).join(F.broadcast(instruments(spark).drop("venue")), "instrument").withColumns({"p": text("price"), "q": text("qty"), "time": time, "frame_id": F.col("event_id")})


def _format(template: str, **values: object):
    """Text with {names} replaced by columns."""
    parts, rest = [], template
    while rest:
        head, mark, tail = rest.partition("<")
        parts.append(F.lit(head))
        if not mark:
            break
        name, _, rest = tail.partition(">")
        parts.append(F.coalesce(F.col(name).cast("string"), F.lit("")))
    return F.concat(*parts)


_NEAR = "event_id, instrument, kind, price, qty"


@query("coinbase_l2update", TICKS + f"SELECT event_id AS frame_id, 0 AS sub, instrument, kind, price, qty, {_TIME_NS} AS venue_ts, 0::BIGINT AS venue_seq FROM tick WHERE venue = 1 AND kind IN (1, 2)")
def coinbase_l2update(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).where("venue = 1 and kind in (1, 2)").withColumn("side", F.when(F.col("kind") == 1, "buy").otherwise("sell"))
    frames = rows.select("frame_id", _format('{"type":"l2update","product_id":"<venue_symbol>","changes":[["<side>","<p>","<q>"]],"time":"<time>"}').alias("payload"))
    return codecs.coinbase_l2(frames, instruments(spark))


@query("coinbase_match", TICKS + f"SELECT event_id AS frame_id, 0 AS sub, instrument, kind, price, qty, {_TIME_NS} AS venue_ts, venue_seq, flags, event_id AS aux FROM tick WHERE venue = 1 AND kind = 3")
def coinbase_match(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).where("venue = 1 and kind = 3").withColumn("side", F.when(F.col("flags") == 1, "buy").otherwise("sell"))
    frames = rows.select("frame_id", _format('{"type":"match","trade_id":<event_id>,"side":"<side>","size":"<q>","price":"<p>","product_id":"<venue_symbol>","sequence":<venue_seq>,"time":"<time>"}').alias("payload"))
    return codecs.coinbase_match(frames, instruments(spark))


@query("binance_depth", TICKS + "SELECT event_id AS frame_id, 0 AS sub, instrument, kind, price, qty, event_id * 1000000 AS venue_ts, event_id AS venue_seq FROM tick WHERE venue = 2 AND kind IN (1, 2)")
def binance_depth(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).where("venue = 2 and kind in (1, 2)")
    level = _format('["<p>","<q>"]')
    rows = rows.withColumns({"b": F.when(F.col("kind") == 1, level), "a": F.when(F.col("kind") == 2, level)})
    frames = rows.select("frame_id", _format('{"stream":"x@depth","data":{"e":"depthUpdate","E":<event_id>,"s":"<venue_symbol>","U":<event_id>,"u":<event_id>,"b":[<b>],"a":[<a>]}}').alias("payload"))
    return codecs.binance_depth(frames, instruments(spark))


@query("kraken_book", TICKS + f""", u AS (SELECT * FROM tick WHERE venue = 3 AND kind IN (1, 2) AND price > 0),
 r AS (SELECT event_id AS frame_id, 0 AS sub, instrument, kind, price, qty, {_TIME_NS} AS venue_ts, 0::BIGINT AS aux FROM u UNION ALL SELECT event_id, 1, instrument, 8, 0, 0, {_TIME_NS}, event_id FROM u)
 SELECT frame_id, sub, instrument, kind, price, qty, venue_ts, 0::BIGINT AS venue_seq, aux FROM r""")
def kraken_book(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).where("venue = 3 and kind in (1, 2) and price > 0")
    level = _format('{"price":<p>,"qty":<q>}')
    rows = rows.withColumns({"b": F.when(F.col("kind") == 1, level), "a": F.when(F.col("kind") == 2, level)})
    frames = rows.select("frame_id", _format('{"channel":"book","type":"update","data":[{"symbol":"<venue_symbol>","bids":[<b>],"asks":[<a>],"checksum":<event_id>,"timestamp":"<time>"}]}').alias("payload"))
    return codecs.kraken_book(frames, instruments(spark))


@query("kraken_trade", TICKS + f"SELECT event_id AS frame_id, 0 AS sub, instrument, kind, price, qty, {_TIME_NS} AS venue_ts, event_id AS venue_seq, flags, event_id AS aux FROM tick WHERE venue = 3 AND kind = 3")
def kraken_trade(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).where("venue = 3 and kind = 3").withColumn("side", F.when(F.col("flags") == 1, "sell").otherwise("buy"))
    frames = rows.select("frame_id", _format('{"channel":"trade","type":"update","data":[{"symbol":"<venue_symbol>","side":"<side>","price":<p>,"qty":<q>,"ord_type":"limit","trade_id":<event_id>,"timestamp":"<time>"}]}').alias("payload"))
    return codecs.kraken_trade(frames, instruments(spark))


_COLUMNS = "frame_id, sub, instrument, kind, price, qty, aux, flags, venue_ts, venue_seq"


@query("kraken_multi", TICKS + f"""
, f AS (SELECT *, event_id % 4 AS entries, CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END AS bad FROM tick WHERE venue = 3 AND kind = 3),
 e AS (SELECT *, CAST(unnest(range(0, entries)) AS INTEGER) AS n FROM f)
 SELECT event_id AS frame_id, n AS sub, instrument, 3 AS kind, price + n * 100000000 AS price, qty, event_id * 10 + n AS aux, CAST((flags + n) % 2 AS INTEGER) AS flags, {_TIME_NS} AS venue_ts, event_id * 10 + n AS venue_seq
 FROM e WHERE bad = 0""")
def kraken_multi(spark: SparkSession, d: str) -> DataFrame:
    """Trade frames of none to three entries; a frame whose last entry names no side goes whole."""
    rows = _texts(spark, d).where("venue = 3 and kind = 3").withColumn("entries", (F.col("event_id") % 4).cast("int"))

    def entry(n):
        sold = (F.col("flags") + n) % 2 == 1
        last = (F.col("event_id") % 11 == 0) & (n == F.col("entries") - 1)
        side = F.when(last, "hold").when(sold, "sell").otherwise("buy")
        price = F.concat((F.call_function("div", F.col("price"), F.lit(S.SCALE)) + n).cast("string"), F.lit("."), F.lpad((F.col("price") % S.SCALE).cast("string"), 8, "0"))
        return F.concat(F.lit('{"symbol":"'), F.col("venue_symbol"), F.lit('","side":"'), side, F.lit('","price":'), price, F.lit(',"qty":'), F.col("q"), F.lit(',"ord_type":"limit","trade_id":'), F.col("event_id") * 10 + n, F.lit(',"timestamp":"'), F.col("time"), F.lit('"}'))

    each = F.when(F.col("entries") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("entries") - 1, F.lit(0))), entry)).otherwise(F.array().cast("array<string>"))
    payload = F.concat(F.lit('{"channel":"trade","type":"update","data":['), F.array_join(each, ","), F.lit("]}"))
    return codecs.ticks(codecs.decode_kraken(rows.select("frame_id", payload.alias("payload")), instruments(spark)))


@query("kraken_snapshot", TICKS + """
, f AS (SELECT *, event_id % 3 AS levels FROM tick WHERE venue = 3 AND kind = 1 AND price > 0),
 parts AS (SELECT *, 0 AS entry FROM f UNION ALL SELECT *, 1 AS entry FROM f),
 z AS (SELECT *, unnest([0, 1] || range(100, 100 + levels) || [200, 300]) AS step FROM parts)
 SELECT event_id AS frame_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY entry, step) - 1 AS INTEGER) AS sub, instrument,
  CASE WHEN step = 0 THEN 11 WHEN step = 1 THEN 4 WHEN step < 200 THEN 5 WHEN step = 200 THEN 6 ELSE 7 END AS kind,
  CASE WHEN step BETWEEN 100 AND 199 THEN price - (step - 100) * 100000000 WHEN step = 200 THEN price + 500000000 ELSE 0 END AS price,
  CASE WHEN step BETWEEN 100 AND 200 THEN qty ELSE 0 END AS qty, CASE WHEN step = 1 THEN levels + 1 WHEN step = 300 THEN event_id + entry ELSE 0 END AS aux,
  2 AS flags, 0::BIGINT AS venue_ts, 0::BIGINT AS venue_seq FROM z""")
def kraken_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Book snapshots of two entries, each of up to two bids and an ask, as brackets."""
    rows = _texts(spark, d).where("venue = 3 and kind = 1 and price > 0").withColumn("levels", (F.col("event_id") % 3).cast("int"))

    def level(shift):
        price = F.concat((F.call_function("div", F.col("price"), F.lit(S.SCALE)) + shift).cast("string"), F.lit("."), F.lpad((F.col("price") % S.SCALE).cast("string"), 8, "0"))
        return F.concat(F.lit('{"price":'), price, F.lit(',"qty":'), F.col("q"), F.lit("}"))

    bids = F.when(F.col("levels") > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col("levels") - 1, F.lit(0))), lambda i: level(-i))).otherwise(F.array().cast("array<string>"))
    entry = lambda n: F.concat(F.lit('{"symbol":"'), F.col("venue_symbol"), F.lit('","bids":['), F.array_join(bids, ","), F.lit('],"asks":['), level(F.lit(5)), F.lit('],"checksum":'), F.col("event_id") + n, F.lit("}"))
    payload = F.concat(F.lit('{"channel":"book","type":"snapshot","data":['), entry(0), F.lit(","), entry(1), F.lit("]}"))
    return codecs.ticks(codecs.decode_kraken(rows.select("frame_id", payload.alias("payload")), instruments(spark)))


@query("coinbase_snapshot", TICKS + f"""
, f AS (SELECT * FROM tick WHERE venue = 1 AND kind IN (1, 2)),
 z AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS step FROM f)
 SELECT event_id AS frame_id, CAST(step AS INTEGER) AS sub, instrument, [11, 4, 5, 6, 7][step + 1] AS kind,
  CASE step WHEN 2 THEN price WHEN 3 THEN price + 100000000 ELSE 0 END AS price, CASE WHEN step IN (2, 3) THEN qty ELSE 0 END AS qty, CASE step WHEN 1 THEN 2 ELSE 0 END::BIGINT AS aux,
  2 AS flags, CASE WHEN event_id % 2 = 0 THEN {_TIME_NS} ELSE 0 END AS venue_ts, 0::BIGINT AS venue_seq FROM z""")
def coinbase_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots with and without a time; the asks stand first in the text, the bids in the ticks."""
    rows = _texts(spark, d).where("venue = 1 and kind in (1, 2)")
    up = F.concat((F.call_function("div", F.col("price"), F.lit(S.SCALE)) + 1).cast("string"), F.lit("."), F.lpad((F.col("price") % S.SCALE).cast("string"), 8, "0"))
    rows = rows.withColumns({"up": up, "stamp": F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(',"time":"'), "time", F.lit('"')))})
    frames = rows.select("frame_id", _format('{"type":"snapshot","product_id":"<venue_symbol>","asks":[["<up>","<q>"]],"bids":[["<p>","<q>"]]<stamp>}').alias("payload"))
    return codecs.ticks(codecs.decode_coinbase(frames, instruments(spark)))


@query("coinbase_heartbeat", TICKS + f"SELECT event_id AS frame_id, 0 AS sub, instrument, 9 AS kind, 0::BIGINT AS price, 0::BIGINT AS qty, event_id * 3 AS aux, 0 AS flags, {_TIME_NS} AS venue_ts, venue_seq FROM tick WHERE venue = 1 AND sub = 0")
def coinbase_heartbeat(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).where("venue = 1 and sub = 0").withColumn("last", F.col("event_id") * 3)
    frames = rows.select("frame_id", _format('{"type":"heartbeat","last_trade_id":<last>,"product_id":"<venue_symbol>","sequence":<venue_seq>,"time":"<time>"}').alias("payload"))
    return codecs.ticks(codecs.decode_coinbase(frames, instruments(spark)))


@query("binance_trade", TICKS + "SELECT event_id AS frame_id, 0 AS sub, instrument, 3 AS kind, price, qty, event_id AS aux, flags, (event_id + 7) * 1000000 AS venue_ts, event_id AS venue_seq FROM tick WHERE venue = 2 AND kind = 3")
def binance_trade(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).where("venue = 2 and kind = 3").withColumns({"ms": F.col("event_id") + 7, "maker": F.when(F.col("flags") == 1, "true").otherwise("false")})
    frames = rows.select("frame_id", _format('{"stream":"x@trade","data":{"e":"trade","E":<event_id>,"s":"<venue_symbol>","t":<event_id>,"p":"<p>","q":"<q>","T":<ms>,"m":<maker>,"M":true}}').alias("payload"))
    return codecs.ticks(codecs.decode_binance(frames, instruments(spark)))


@query("rest_books", TICKS + f"""
, f AS (SELECT * FROM tick WHERE venue IN (1, 2) AND kind IN (1, 2)), z AS (SELECT *, unnest([0, 1, 2, 3, 4]) AS step FROM f)
 SELECT event_id AS frame_id, CAST(step AS INTEGER) AS sub, instrument, [11, 4, 5, 6, 7][step + 1] AS kind,
  CASE step WHEN 2 THEN price WHEN 3 THEN price + 100000000 ELSE 0 END AS price, CASE WHEN step IN (2, 3) THEN qty ELSE 0 END AS qty, CASE step WHEN 1 THEN 2 ELSE 0 END::BIGINT AS aux,
  6 AS flags, CASE WHEN venue = 1 THEN {_TIME_NS} ELSE 0 END AS venue_ts, event_id AS venue_seq FROM z""")
def rest_books(spark: SparkSession, d: str) -> DataFrame:
    """REST books of two venues; the first's body holds an earlier time that does not count."""
    rows = _texts(spark, d).where("venue in (1, 2) and kind in (1, 2)")
    up = F.concat((F.call_function("div", F.col("price"), F.lit(S.SCALE)) + 1).cast("string"), F.lit("."), F.lpad((F.col("price") % S.SCALE).cast("string"), 8, "0"))
    rows = rows.withColumn("up", up)
    first = _format('{"bids":[["<p>","<q>",3]],"asks":[["<up>","<q>",1]],"sequence":<event_id>,"auction":{"time":"2020-01-01T00:00:00Z"},"time":"<time>"}')
    second = _format('{"lastUpdateId":<event_id>,"bids":[["<p>","<q>"]],"asks":[["<up>","<q>"]]}')
    return codecs.ticks(codecs.decode_rest(rows.select("frame_id", "venue", "instrument", F.when(F.col("venue") == 1, first).otherwise(second).alias("payload"))))


_CAUSE = "CASE event_id % 7 WHEN 0 THEN 'level' WHEN 1 THEN 'side' WHEN 2 THEN 'unknown_symbol' WHEN 3 THEN 'time' WHEN 4 THEN 'structure' END"


@query("codec_reject_causes", TICKS + f", f AS (SELECT event_id, {_CAUSE} AS cause FROM tick WHERE venue = 1 AND kind IN (1, 2)) SELECT coalesce(cause, 'none') AS cause, count(*) AS frames, CAST(sum(CASE WHEN cause IS NULL THEN 2 ELSE 0 END) AS BIGINT) AS ticks FROM f GROUP BY ALL")
def codec_reject_causes(spark: SparkSession, d: str) -> DataFrame:
    """Frames of a good level and one that is bad in one of four ways, or cut short; a bad
    frame gives no tick."""
    rows = _texts(spark, d).where("venue = 1 and kind in (1, 2)")
    way = F.col("event_id") % 7
    rows = rows.withColumns({
        "second": F.when(way == 0, '["sell","1x","2"]').when(way == 1, '["hold","1","2"]').otherwise('["sell","1","2"]'),
        "symbol": F.when(way == 2, "NEW-COIN").otherwise(F.col("venue_symbol")), "stamp": F.when(way == 3, "yesterday").otherwise(F.col("time")), "close": F.when(way == 4, '"').otherwise('"}'),
    })
    frames = rows.select("frame_id", _format('{"type":"l2update","product_id":"<symbol>","changes":[["buy","<p>","<q>"],<second>],"time":"<stamp><close>').alias("payload"))
    decoded = codecs.decode_coinbase(frames, instruments(spark))
    return decoded.groupBy(F.coalesce("cause", F.lit("none")).alias("cause")).agg(F.count("*").alias("frames"), F.sum(F.when(F.col("cause").isNull(), F.size("ticks")).otherwise(0)).cast("bigint").alias("ticks"))


@query("codec_errors", TICKS + "SELECT instrument, count(*) AS frames, count(CASE WHEN event_id % 5 = 0 THEN 1 END) AS errors FROM tick WHERE venue = 1 AND kind IN (1, 2) GROUP BY instrument")
def codec_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth frame has a bad second level, so its good first level goes too."""
    rows = _texts(spark, d).where("venue = 1 and kind in (1, 2)").withColumn("bad", F.when(F.col("event_id") % 5 == 0, F.lit(',["buy","1x","2"]')))
    frames = rows.select("frame_id", "instrument", _format('{"type":"l2update","product_id":"<venue_symbol>","changes":[["buy","<p>","<q>"]<bad>],"time":"<time>"}').alias("payload"))
    parsed = codecs.coinbase_l2(frames.drop("instrument"), instruments(spark)).select("frame_id").distinct().withColumn("fine", F.lit(1))
    return frames.join(parsed, "frame_id", "left").groupBy("instrument").agg(F.count("*").alias("frames"), F.count_if(F.col("fine").isNull()).alias("errors"))


def chain_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Update frames of the second venue: ids that overlap, and snapshots at times."""
    rows = read_ticks(spark, d).where("venue = 2 and sub = 0 and kind in (1, 2, 4)")
    diffs = rows.select("instrument", F.col("event_id").alias("frame_id"), (F.col("kind") == 4).alias("snapshot"), (F.col("event_id") - F.col("event_id") % 40).alias("first_u"), F.col("event_id").alias("final_u"))
    return diffs


@query("depth_chain")
def depth_chain(spark: SparkSession, d: str) -> DataFrame:
    return codecs.depth_chain(chain_diffs(spark, d))


_IDS = "string_agg('\"' || venue_symbol || '\"', ',' ORDER BY instrument)"


@query("subscriptions", TICKS + f"""SELECT 1 AS venue, 1 AS place, '{{"type":"subscribe","product_ids":[' || {_IDS} || '],"channels":["level2_batch","matches","heartbeat"]}}' AS message FROM inst WHERE venue = 1
 UNION ALL SELECT 2, 1, 'wss://stream.binance.com:9443/stream?streams=' || string_agg(lower(venue_symbol) || '@depth@100ms/' || lower(venue_symbol) || '@trade', '/' ORDER BY instrument) FROM inst WHERE venue = 2
 UNION ALL SELECT 3, 1, '{{"method":"subscribe","params":{{"channel":"book","symbol":[' || {_IDS} || '],"depth":100}}}}' FROM inst WHERE venue = 3
 UNION ALL SELECT 3, 2, '{{"method":"subscribe","params":{{"channel":"trade","symbol":[' || {_IDS} || '],"snapshot":false}}}}' FROM inst WHERE venue = 3""")
def subscriptions(spark: SparkSession, d: str) -> DataFrame:
    """What each venue is asked for: messages, and for the second venue the address itself."""
    return codecs.subscriptions(instruments(spark))


_SYMBOLS = TICKS + ", named AS (SELECT t.event_id, t.sub, t.venue, CASE WHEN t.event_id % 19 = 0 THEN 'NEW-COIN' ELSE i.venue_symbol END AS venue_symbol FROM tick t JOIN inst i USING (instrument)) "


def _named(spark: SparkSession, d: str) -> DataFrame:
    rows = read_ticks(spark, d).join(F.broadcast(instruments(spark).drop("venue")), "instrument")
    return rows.select("event_id", "sub", "venue", F.when(F.col("event_id") % 19 == 0, "NEW-COIN").otherwise(F.col("venue_symbol")).alias("venue_symbol"))


@query("symbol_join", _SYMBOLS + "SELECT n.event_id, n.sub, i.instrument FROM named n JOIN inst i ON i.venue = n.venue AND i.venue_symbol = n.venue_symbol")
def symbol_join(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).join(F.broadcast(instruments(spark)), ["venue", "venue_symbol"]).select("event_id", "sub", "instrument")


@query("unknown_symbols", _SYMBOLS + "SELECT venue, venue_symbol, count(*) AS n FROM named n WHERE NOT EXISTS (SELECT 1 FROM inst i WHERE i.venue = n.venue AND i.venue_symbol = n.venue_symbol) GROUP BY ALL")
def unknown_symbols(spark: SparkSession, d: str) -> DataFrame:
    return _named(spark, d).join(F.broadcast(instruments(spark)), ["venue", "venue_symbol"], "left_anti").groupBy("venue", "venue_symbol").agg(F.count("*").alias("n"))


@query("registry_join", TICKS + "SELECT i.canonical, i.venue, count(*) AS n FROM tick t JOIN inst i USING (instrument) GROUP BY ALL")
def registry_join(spark: SparkSession, d: str) -> DataFrame:
    counted = read_ticks(spark, d).groupBy("instrument").agg(F.count("*").alias("n"))
    return counted.join(F.broadcast(instruments(spark)), "instrument").groupBy("canonical", "venue").agg(F.sum("n").alias("n"))


@query("registry_violations", TICKS + ", r AS (SELECT instrument, venue, venue_symbol FROM inst UNION ALL VALUES (3, 1, 'X-USD'), (0, 2, 'ZERO'), (20, 3, 'BTC/USD')) SELECT 'id' AS rule, CAST(instrument AS VARCHAR) AS key FROM r GROUP BY instrument HAVING count(*) > 1 OR instrument = 0 UNION ALL SELECT 'symbol', venue || ':' || venue_symbol FROM r GROUP BY venue, venue_symbol HAVING count(*) > 1")
def registry_violations(spark: SparkSession, d: str) -> DataFrame:
    extra = spark.createDataFrame([(3, 1, "X-USD"), (0, 2, "ZERO"), (20, 3, "BTC/USD")], "instrument int, venue int, venue_symbol string")
    rows = instruments(spark).drop("canonical").unionByName(extra)
    ids = rows.groupBy("instrument").agg(F.count("*").alias("n")).where("n > 1 or instrument = 0").select(F.lit("id").alias("rule"), F.col("instrument").cast("string").alias("key"))
    symbols = rows.groupBy("venue", "venue_symbol").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("symbol").alias("rule"), F.concat_ws(":", "venue", "venue_symbol").alias("key"))
    return ids.unionByName(symbols)


@query("precision_drift", TICKS + ", v AS (SELECT instrument, CASE WHEN instrument = 12 THEN 3 ELSE price_decimals END AS price_decimals, qty_decimals FROM decimals WHERE instrument <> 14) SELECT p.instrument, p.price_decimals, v.price_decimals AS venue_price_decimals FROM decimals p LEFT JOIN v USING (instrument) WHERE v.instrument IS NULL OR v.price_decimals <> p.price_decimals OR v.qty_decimals <> p.qty_decimals")
def precision_drift(spark: SparkSession, d: str) -> DataFrame:
    pinned = pair_decimals(spark)
    venue = pinned.where("instrument <> 14").select("instrument", F.when(F.col("instrument") == 12, 3).otherwise(F.col("price_decimals")).alias("venue_price_decimals"), F.col("qty_decimals").alias("venue_qty_decimals"))
    both = pinned.join(F.broadcast(venue), "instrument", "left")
    changed = F.col("venue_price_decimals").isNull() | (F.col("venue_price_decimals") != F.col("price_decimals")) | (F.col("venue_qty_decimals") != F.col("qty_decimals"))
    return both.where(changed).select("instrument", "price_decimals", "venue_price_decimals")


@query("quote_tokens", TICKS + f"SELECT event_id, sub, '{{\"price\":\"' || {_FIX} || '\",\"qty\": \"' || {_QFIX} || '\"}}' AS payload FROM tick WHERE kind = 3")
def quote_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).where("kind = 3")
    return rows.select("event_id", "sub", X.quote_numbers(_format('{"price":<p>,"qty": <q>}')).alias("payload"))
