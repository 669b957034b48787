"""Gaps, counters, sessions, delta columns, windows and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticklake import schema as S
from ticklake.operators import aggregates as A
from ticklake.operators import cells, series
from ticklake.plans.registry import query
from ticklake.plans.sql import STATE, TICKS
from ticklake.sources.ticks import read_events, read_ticks

_TRADES = TICKS + """, ids AS (SELECT instrument, recv_mono, event_id, row_number() OVER (PARTITION BY instrument ORDER BY recv_mono, event_id, sub) AS id FROM tick WHERE kind = 3),
 trade AS (SELECT *, CASE WHEN id % 13 = 0 THEN (id + 2) * 2 + 1 ELSE id * 2 END AS spot FROM ids WHERE id % 11 <> 0) """


def _trades(spark: SparkSession, d: str) -> DataFrame:
    return series.trades_with_holes(read_ticks(spark, d))


@query("trade_gaps", _TRADES + ", s AS (SELECT *, max(id) OVER (PARTITION BY instrument ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM trade) SELECT instrument, id, id - seen - 1 AS missed FROM s WHERE id > seen + 1")
def trade_gaps(spark: SparkSession, d: str) -> DataFrame:
    return series.trade_gaps(_trades(spark, d))


@query("trade_gaps_lag", _TRADES + ", s AS (SELECT *, lag(id) OVER (PARTITION BY instrument ORDER BY spot) AS last FROM trade) SELECT instrument, id, id - last - 1 AS missed FROM s WHERE id > last + 1")
def trade_gaps_lag(spark: SparkSession, d: str) -> DataFrame:
    return series.trade_gaps_by_last(_trades(spark, d))


@query("heartbeat_gaps", _TRADES + """, beat AS (SELECT instrument, id * 2 + 1 AS spot, id + id % 3 AS id FROM ids WHERE id % 17 = 0),
 both_ AS (SELECT instrument, spot, id, 0 AS beat FROM trade UNION ALL SELECT instrument, spot, id, 1 FROM beat),
 f AS (SELECT instrument, min(spot) AS first_at FROM trade GROUP BY 1),
 s AS (SELECT b.*, max(id) OVER (PARTITION BY instrument ORDER BY spot, beat, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM both_ b JOIN f USING (instrument) WHERE b.spot >= f.first_at)
 SELECT instrument, spot, id AS last_trade_id, id - seen AS missed FROM s WHERE beat = 1 AND id > seen""")
def heartbeat_gaps(spark: SparkSession, d: str) -> DataFrame:
    ids = series.trade_ids(read_ticks(spark, d)).select("instrument", "id")
    beats = ids.where("id % 17 = 0").select("instrument", (F.col("id") * 2 + 1).alias("spot"), (F.col("id") + F.col("id") % 3).alias("id"))
    return series.heartbeat_gaps(_trades(spark, d), beats)


_LINES = TICKS + """, h AS (SELECT venue, recv_mono // 3600000000000 AS hour, count(*) AS msgs, count(CASE WHEN kind < 8 THEN 1 END) AS events, count(CASE WHEN kind = 10 THEN 1 END) AS gaps FROM tick GROUP BY ALL),
 line AS (SELECT venue, hour, CAST(sum(msgs) OVER w AS BIGINT) AS msgs, CAST(sum(events) OVER w AS BIGINT) AS events, CAST(sum(gaps) OVER w AS BIGINT) AS gaps, hour % 168 * 3600 AS uptime_s FROM h WINDOW w AS (PARTITION BY venue, hour // 168 ORDER BY hour)) """


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return series.telemetry(read_ticks(spark, d))


@query("stats_lines", _LINES + "SELECT CAST(venue AS VARCHAR) AS venue, hour, msgs, gaps FROM line UNION ALL SELECT 'total', hour, CAST(sum(msgs) AS BIGINT), CAST(sum(gaps) AS BIGINT) FROM line GROUP BY hour")
def stats_lines(spark: SparkSession, d: str) -> DataFrame:
    # each line once for its venue and once for the total
    twice = _lines(spark, d).withColumn("name", F.explode(F.array(F.col("venue").cast("string"), F.lit("total"))))
    return twice.groupBy(F.col("name").alias("venue"), "hour").agg(F.sum("msgs").alias("msgs"), F.sum("gaps").alias("gaps"))


@query("counter_deltas", _LINES + ", d AS (SELECT venue, hour, CASE WHEN msgs >= lag(msgs) OVER w THEN msgs - lag(msgs) OVER w ELSE msgs END AS d_msgs, lag(msgs) OVER w AS p, row_number() OVER (PARTITION BY venue ORDER BY hour DESC) AS back FROM line WINDOW w AS (PARTITION BY venue ORDER BY hour)) SELECT venue, hour, d_msgs FROM d WHERE p IS NOT NULL AND back <= 480")
def counter_deltas(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("venue").orderBy("hour")
    got = _lines(spark, d).select("venue", "hour", series.counter_delta("msgs", by).alias("d_msgs"), F.row_number().over(Window.partitionBy("venue").orderBy(F.desc("hour"))).alias("back"))
    return got.where("d_msgs is not null and back <= 480").drop("back")


@query("last_per_venue", _LINES + "SELECT venue, max(hour) AS hour, arg_max(msgs, hour) AS msgs, arg_max(gaps, hour) AS gaps FROM line GROUP BY venue")
def last_per_venue(spark: SparkSession, d: str) -> DataFrame:
    return A.last_row(_lines(spark, d).withColumn("at", F.col("hour")), ["venue"], "at").select("venue", "hour", "msgs", "gaps")


@query("uptime_sessions", _LINES + ", s AS (SELECT *, CASE WHEN uptime_s < lag(uptime_s) OVER (PARTITION BY venue ORDER BY hour) THEN 1 ELSE 0 END AS fell FROM line) SELECT venue, CAST(1 + sum(fell) AS BIGINT) AS sessions, max(uptime_s) AS longest_s FROM s GROUP BY venue")
def uptime_sessions(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("venue").orderBy("hour")
    marked = _lines(spark, d).withColumn("fell", series.sessions("uptime_s", by))
    return marked.groupBy("venue").agg((F.count_if("fell") + 1).alias("sessions"), F.max("uptime_s").alias("longest_s"))


_HOLE = 7_200_000_000_000
_ISLES = TICKS + f""", n AS (SELECT venue, recv_mono, CASE WHEN recv_mono - lag(recv_mono) OVER w > {_HOLE} THEN 1 ELSE 0 END AS new FROM tick WINDOW w AS (PARTITION BY venue ORDER BY recv_mono)),
 i AS (SELECT *, sum(new) OVER (PARTITION BY venue ORDER BY recv_mono ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM n),
 isle AS (SELECT venue, CAST(island AS BIGINT) AS island, min(recv_mono) AS "start", max(recv_mono) AS "end", count(*) AS n FROM i GROUP BY ALL) """


def _isles(spark: SparkSession, d: str) -> DataFrame:
    return series.islands(read_ticks(spark, d), "venue", "recv_mono", _HOLE)


@query("hole_free_windows", _ISLES + 'SELECT venue, "start", "end", n FROM isle')
def hole_free_windows(spark: SparkSession, d: str) -> DataFrame:
    return _isles(spark, d).drop("island")


@query("soak_continuity", _ISLES + 'SELECT venue, count(*) - 1 AS holes, max("end" - "start") AS longest, max("end") - min("start") AS span, CAST(sum(n) AS BIGINT) AS n FROM isle GROUP BY venue')
def soak_continuity(spark: SparkSession, d: str) -> DataFrame:
    return _isles(spark, d).groupBy("venue").agg((F.count("*") - 1).alias("holes"), F.max(F.col("end") - F.col("start")).alias("longest"), (F.max("end") - F.min("start")).alias("span"), F.sum("n").alias("n"))


@query("connect_sessions", TICKS + ", s AS (SELECT *, count(CASE WHEN kind = 11 THEN 1 END) OVER (PARTITION BY venue ORDER BY recv_mono, event_id, sub ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM tick) SELECT venue, session, count(*) AS n, min(recv_mono) AS first FROM s GROUP BY ALL")
def connect_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Connection epochs: a clear stands for the note that a venue connects."""
    cleared = cells.total((F.col("kind") == S.CLEAR).cast("bigint"), True)
    return cells.running(read_ticks(spark, d), "venue", list(S.ORDER), cells.cell("recv_mono"), session=cleared).groupBy("venue", "session").agg(F.count("*").alias("n"), F.min("recv_mono").alias("first"))


_DELTA = TICKS + """, a AS (SELECT *, recv_mono - lag(recv_mono, 1, 0) OVER w AS d_mono, price - lag(price, 1, 0) OVER w AS d_price FROM tick WINDOW w AS (PARTITION BY instrument ORDER BY recv_mono, event_id, sub)),
 b AS (SELECT *, d_mono - lag(d_mono, 1, 0) OVER (PARTITION BY instrument ORDER BY recv_mono, event_id, sub) AS dd_mono FROM a) """


@query("delta_encode", _DELTA + "SELECT instrument, event_id, sub, recv_mono, d_mono, dd_mono, d_price, CASE WHEN d_price >= 0 THEN d_price * 2 ELSE -d_price * 2 - 1 END AS zz_price FROM b")
def delta_encode(spark: SparkSession, d: str) -> DataFrame:
    return series.delta_columns(read_ticks(spark, d))


@query("encode_delta_cols", _DELTA + "SELECT instrument, count(*) AS n, CAST(sum(abs(d_mono)) AS DECIMAL(38,0)) AS abs_d, CAST(sum(abs(dd_mono)) AS DECIMAL(38,0)) AS abs_dd, count(CASE WHEN d_price = 0 THEN 1 END) AS same_price FROM b GROUP BY instrument")
def encode_delta_cols(spark: SparkSession, d: str) -> DataFrame:
    return series.delta_columns(read_ticks(spark, d)).groupBy("instrument").agg(F.count("*").alias("n"), A.wide_sum(F.abs("d_mono")).alias("abs_d"), A.wide_sum(F.abs("dd_mono")).alias("abs_dd"), F.count_if(F.col("d_price") == 0).alias("same_price"))


@query("delta_decode", TICKS + "SELECT instrument, event_id, sub, recv_mono, price FROM tick")
def delta_decode(spark: SparkSession, d: str) -> DataFrame:
    return series.delta_decoded(series.delta_columns(read_ticks(spark, d)))


@query("venue_series", _LINES + ", p AS (SELECT venue, hour // 24 AS day, max(msgs) AS msgs FROM line GROUP BY ALL) SELECT venue, string_agg(day || ':' || msgs, ',' ORDER BY day) AS points FROM p GROUP BY venue")
def venue_series(spark: SparkSession, d: str) -> DataFrame:
    daily = _lines(spark, d).groupBy("venue", F.expr("hour div 24").alias("day")).agg(F.max("msgs").alias("msgs"))
    points = F.transform(F.sort_array(F.collect_list(F.struct("day", "msgs"))), lambda p: F.concat_ws(":", p["day"], p["msgs"]))
    return daily.groupBy("venue").agg(F.array_join(points, ",").alias("points"))


@query("lag_totals", _LINES + ", d AS (SELECT *, CASE WHEN gaps >= lag(gaps) OVER w THEN gaps - lag(gaps) OVER w ELSE gaps END AS dg FROM line WINDOW w AS (PARTITION BY venue ORDER BY hour)) SELECT venue, CAST(sum(dg) AS BIGINT) AS gaps, arg_max(uptime_s, hour) AS uptime_s FROM d GROUP BY venue")
def lag_totals(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("venue").orderBy("hour")
    grown = _lines(spark, d).withColumn("dg", F.coalesce(series.counter_delta("gaps", by), "gaps"))
    return grown.groupBy("venue").agg(F.sum("dg").alias("gaps"), F.max_by("uptime_s", "hour").alias("uptime_s"))


@query("window_bounds", TICKS + ", b AS (SELECT min(recv_wall) AS first, max(recv_wall) AS last, max(recv_wall) - max(recv_mono) AS off FROM tick), s AS (SELECT *, greatest(first, last - 86400000000000) AS start_wall FROM b) SELECT start_wall, last AS end_wall, start_wall - off AS start_mono, greatest(10, ((last - start_wall + 999999999) // 1000000000 + 1999) // 2000) AS step_s FROM s")
def window_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The last day of the store, and a step that gives at most 2000 points."""
    got = read_ticks(spark, d).agg(F.min("recv_wall").alias("first"), F.max("recv_wall").alias("last"), (F.max("recv_wall") - F.max("recv_mono")).alias("off"))
    got = got.withColumn("start_wall", F.greatest("first", F.col("last") - 86_400_000_000_000))
    seconds = F.call_function("div", F.col("last") - F.col("start_wall") + 999_999_999, F.lit(1_000_000_000))
    return got.select("start_wall", F.col("last").alias("end_wall"), (F.col("start_wall") - F.col("off")).alias("start_mono"), F.greatest(F.lit(10).cast("bigint"), F.call_function("div", seconds + 1999, F.lit(2000))).alias("step_s"))


@query("minute_windows", "SELECT epoch_us(time_bucket(INTERVAL 10 MINUTE, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def minute_windows(spark: SparkSession, d: str) -> DataFrame:
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', w.start)")
    return read_events(spark, d).groupBy(F.window("ts", "10 minutes").alias("w"), "event_type").agg(F.count("*").alias("n")).select(start.alias("start_us"), "event_type", "n")


@query("session_windows", """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM o) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark: SparkSession, d: str) -> DataFrame:
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', w.start)")
    return read_events(spark, d).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n")).select("user_id", start.alias("start_us"), "n")


@query("stream_minute_counts", "SELECT event_type, epoch_us(date_trunc('hour', ts)) AS start_us, count(*) AS n FROM events GROUP BY ALL")
def stream_minute_counts(spark: SparkSession, d: str) -> DataFrame:
    from ticklake.streaming.counts import hourly_counts

    return hourly_counts(spark, f"{d}/events.parquet")


@query("stream_trade_gaps", _TRADES + ", s AS (SELECT *, max(id) OVER (PARTITION BY instrument ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM trade) SELECT instrument, id, id - seen - 1 AS missed FROM s WHERE id > seen + 1")
def stream_trade_gaps(spark: SparkSession, d: str) -> DataFrame:
    from ticklake.sources.store import scratch
    from ticklake.streaming import stateful

    path = scratch(spark, "trades")
    stateful.drops(_trades(spark, d).select("instrument", "spot", "id"), path, "spot")
    return stateful.drain(spark, path, "instrument int, spot bigint, id bigint", stateful.trade_gaps)


@query("stream_book_tops", STATE + """, f AS (SELECT instrument, max(epoch) AS epoch FROM state GROUP BY 1),
 l AS (SELECT s.instrument, s.side, s.price, arg_max(s.qty, s.place) AS qty FROM state s JOIN f USING (instrument, epoch) WHERE s.effective GROUP BY ALL)
 SELECT t.instrument, max(t.recv_mono) AS recv_mono, any_value(b.bid) AS bid, any_value(b.ask) AS ask FROM tick t LEFT JOIN (SELECT instrument, max(CASE WHEN side = 'B' THEN price END) AS bid, min(CASE WHEN side = 'A' THEN price END) AS ask FROM l WHERE qty <> 0 GROUP BY 1) b USING (instrument) GROUP BY 1""")
def stream_book_tops(spark: SparkSession, d: str) -> DataFrame:
    from ticklake.sources.store import scratch
    from ticklake.streaming import stateful

    path = scratch(spark, "ticks")
    stateful.drops(read_ticks(spark, d), path, "recv_mono")
    # each batch tells an instrument's best prices; the last word counts
    told = stateful.drain(spark, path, S.TICK, stateful.book_tops)
    return A.last_row(told.withColumn("at", F.col("recv_mono")), ["instrument"], "at").select("instrument", "recv_mono", "bid", "ask")


@query("stream_depth_chain")
def stream_depth_chain(spark: SparkSession, d: str) -> DataFrame:
    """The update chain over a stream, with the gaps that ask for a new snapshot."""
    from ticklake.plans.codecs import chain_diffs
    from ticklake.sources.store import scratch
    from ticklake.streaming import stateful

    path = scratch(spark, "diffs")
    stateful.drops(chain_diffs(spark, d), path, "frame_id")
    return stateful.drain(spark, path, "instrument int, frame_id bigint, snapshot boolean, first_u bigint, final_u bigint", stateful.depth_chain)


_PAIRS = "SELECT a.event_id AS id_a, b.event_id AS id_b FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR"


@query("stream_pairs", _PAIRS)
def stream_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Views and the purchases of the same user in the hour after, by a stream-stream join."""
    from ticklake.sources.store import scratch
    from ticklake.streaming import counts, stateful

    path = scratch(spark, "pairs")
    rows = read_events(spark, d).where("event_type in ('view', 'purchase')").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "view").alias("first"))
    rows.repartitionByRange("at").write.parquet(path)

    def pairs(stream: DataFrame) -> DataFrame:
        return counts.matched(stream.where("first"), stream.where("not first"), "1 hour").select("id_a", "id_b")

    return stateful.drain(spark, path, "key bigint, id bigint, at timestamp, first boolean", pairs)


@query("sliding_counts", "SELECT epoch_us(s) AS start_us, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts)]) AS s FROM events) GROUP BY ALL")
def sliding_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events of every hour that begins at a quarter."""
    start = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', w.start)")
    return read_events(spark, d).groupBy(F.window("ts", "1 hour", "15 minutes").alias("w")).agg(F.count("*").alias("n")).select(start.alias("start_us"), "n")


@query("stats_jsonl", _LINES + "SELECT CAST(venue AS VARCHAR) AS venue, hour, msgs, gaps FROM line UNION ALL SELECT 'total', hour, CAST(sum(msgs) AS BIGINT), CAST(sum(gaps) AS BIGINT) FROM line GROUP BY hour")
def stats_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """The stats lines written as JSON lines and read back."""
    from ticklake.sources.store import scratch

    path = scratch(spark, "stats")
    stats_lines(spark, d).write.mode("errorifexists").json(path)
    return spark.read.schema("venue string, hour bigint, msgs bigint, gaps bigint").json(path)


@query("ring_lag_model", TICKS + ", h AS (SELECT instrument, count(*) AS head FROM tick GROUP BY instrument) SELECT instrument, head, CASE WHEN head > 64 THEN greatest(1, head - 64 - 10) ELSE 0 END AS lost, head - 10 AS lag FROM h")
def ring_lag_model(spark: SparkSession, d: str) -> DataFrame:
    """A reader that stopped after ten messages of a ring of 64: what it lost, and its lag."""
    head = read_ticks(spark, d).groupBy("instrument").agg(F.count("*").alias("head"))
    lost = F.when(F.col("head") > 64, F.greatest(F.lit(1).cast("bigint"), F.greatest(F.col("head") - 64, F.lit(0)) - 10)).otherwise(0)
    return head.select("instrument", "head", lost.alias("lost"), (F.col("head") - 10).alias("lag"))


@query("stamp_interval_join", TICKS + ", a AS (SELECT instrument, event_id, recv_mono FROM tick WHERE kind = 1), b AS (SELECT instrument, event_id AS other, recv_mono AS mono2 FROM tick WHERE kind = 2) SELECT a.instrument, a.event_id, count(b.other) AS matched FROM a LEFT JOIN b ON a.instrument = b.instrument AND b.mono2 BETWEEN a.recv_mono AND a.recv_mono + 600000000000 GROUP BY ALL")
def stamp_interval_join(spark: SparkSession, d: str) -> DataFrame:
    """Bids and the asks of the ten minutes after them, by cells of ten minutes."""
    cell = 600_000_000_000
    rows = read_ticks(spark, d)
    place = F.call_function("div", F.col("recv_mono"), F.lit(cell))
    left = rows.where("kind = 1").select("instrument", "event_id", "recv_mono", F.explode(F.array(place, place + 1)).alias("cell"))
    right = rows.where("kind = 2").select("instrument", F.col("recv_mono").alias("mono2"), place.alias("cell"))
    met = left.join(right, ["instrument", "cell"], "left").withColumn("hit", F.coalesce(F.col("mono2").between(F.col("recv_mono"), F.col("recv_mono") + cell), F.lit(False)))
    return met.groupBy("instrument", "event_id").agg(F.count_if("hit").alias("matched"))


_STAMPS = ", d AS (SELECT instrument, event_id, sub, recv_mono AS t0, recv_mono + 1000000 AS t3, recv_mono + (recv_wall - venue_ts) // 1000000 * 30000 AS t2, event_id % 9 = 0 AS lost FROM tick)"


@query("stamp_match", TICKS + _STAMPS + ", m AS (SELECT instrument, CASE WHEN NOT lost AND t2 <= t3 + 1000000 THEN greatest(t3 - t2, 0) END AS deliver FROM d) SELECT instrument, count(deliver) AS matched, count(*) - count(deliver) AS unmatched, CAST(sum(deliver) AS BIGINT) AS deliver_ns FROM m GROUP BY instrument")
def stamp_match(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries and the stamps of their publication, some of which never come: a stamp
    counts if it comes at most a millisecond after the delivery."""
    rows = read_ticks(spark, d)
    key = ["instrument", "event_id", "sub"]
    delivered = rows.select(*key, (F.col("recv_mono") + 1_000_000).alias("t3"))
    k = F.call_function("div", F.col("recv_wall") - F.col("venue_ts"), F.lit(1_000_000))
    stamps = rows.where("event_id % 9 <> 0").select(*key, (F.col("recv_mono") + k * 30_000).alias("t2"))
    met = delivered.join(stamps, key, "left")
    deliver = F.when(F.col("t2") <= F.col("t3") + 1_000_000, F.greatest(F.col("t3") - F.col("t2"), F.lit(0)))
    return met.groupBy("instrument").agg(F.count(deliver).alias("matched"), (F.count("*") - F.count(deliver)).alias("unmatched"), F.sum(deliver).alias("deliver_ns"))
