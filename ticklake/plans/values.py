"""Scalar functions over values derived from ticks, and small JSON contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticklake.functions import scalars as X
from ticklake.plans.registry import query
from ticklake.plans.sql import TICKS
from ticklake.sources.ticks import instruments, read_ticks

#: Token shapes by place: plain, signed, exponents up and down, bare dots, and malformed ones.
_SHAPES = ["{q}", "-{q}", "{q}.50", "{q}e2", "{q}e-3", ".{q}", "{q}.", "1x{q}", " {q}", "{q}e20", "0.000000001{q}", "+{q}.000", "", "1e", "{q}E+1"]


@query("parse_fixed", TICKS + """, s AS (SELECT event_id, event_id % 1000 AS q, event_id % 15 AS k FROM tick WHERE sub = 0),
 v AS (SELECT event_id, k, q, CASE k WHEN 0 THEN q * 100000000 WHEN 1 THEN -q * 100000000 WHEN 2 THEN q * 100000000 + 50000000 WHEN 3 THEN q * 10000000000 WHEN 4 THEN q * 100000
  WHEN 5 THEN CASE WHEN q = 0 THEN 0 ELSE CAST(round(CAST('0.' || q AS DOUBLE) * 1e8) AS BIGINT) END WHEN 6 THEN q * 100000000 WHEN 9 THEN CASE WHEN q = 0 THEN 0 END WHEN 10 THEN NULL WHEN 11 THEN q * 100000000 WHEN 14 THEN q * 1000000000 END AS mantissa FROM s)
 SELECT event_id, CAST(mantissa AS BIGINT) AS mantissa FROM v""")
def parse_fixed(spark: SparkSession, d: str) -> DataFrame:
    q = (F.col("event_id") % 1000).cast("string")
    shapes = F.array(*[F.concat(F.lit(a), q if mark else F.lit(""), F.lit(b)) for a, mark, b in (s.partition("{q}") for s in _SHAPES)])
    rows = read_ticks(spark, d).where("sub = 0").select("event_id", F.element_at(shapes, (F.col("event_id") % 15 + 1).cast("int")).alias("token"))
    return rows.select("event_id", X.parse_fixed(F.col("token")).alias("mantissa"))


@query("format_fixed", TICKS + ", s AS (SELECT event_id, sub, qty - 300000000000 AS m FROM tick) SELECT event_id, sub, CASE WHEN m < 0 THEN '-' ELSE '' END || abs(m) // 100000000 || CASE WHEN abs(m) % 100000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(abs(m) % 100000000 AS VARCHAR), 8, '0'), '0') END AS text FROM s")
def format_fixed(spark: SparkSession, d: str) -> DataFrame:
    return read_ticks(spark, d).select("event_id", "sub", X.format_fixed(F.col("qty") - 300_000_000_000).alias("text"))


@query("rfc3339_ns", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE epoch_us(ts) * 1000 END AS ns FROM events")
def rfc3339_ns(spark: SparkSession, d: str) -> DataFrame:
    from ticklake.sources.ticks import read_events

    plain = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    # the right ending, lower case, trailing zeros, and an offset that is refused
    ends = F.element_at(F.array(F.concat(plain, F.lit("Z")), F.concat(F.lower(plain), F.lit("z")), F.concat(plain, F.lit("000Z")), F.concat(plain, F.lit("+00:00"))), (F.col("event_id") % 4 + 1).cast("int"))
    return read_events(spark, d).select("event_id", X.rfc3339_ns(ends).alias("ns"))


@query("varint_len", TICKS + "SELECT event_id, sub, CAST(CASE WHEN qty = 0 THEN 1 ELSE (CAST(floor(log2(qty)) AS INTEGER) + 7) // 7 END AS INTEGER) AS bytes FROM tick")
def varint_len(spark: SparkSession, d: str) -> DataFrame:
    return read_ticks(spark, d).select("event_id", "sub", X.varint_len(F.col("qty")).alias("bytes"))


@query("wsname_map", TICKS + "SELECT instrument, replace(replace(venue_symbol, 'BTC', 'XBT'), 'DOGE', 'XDG') AS wsname FROM inst WHERE venue = 3")
def wsname_map(spark: SparkSession, d: str) -> DataFrame:
    return instruments(spark).where("venue = 3").select("instrument", X.wsname(F.col("venue_symbol")).alias("wsname"))


@query("taker_side", TICKS + "SELECT event_id, flags AS taker_sell FROM tick WHERE kind = 3")
def taker_side(spark: SparkSession, d: str) -> DataFrame:
    sold = F.col("flags") == 1
    side = F.when(F.col("venue") == 1, F.when(sold, "buy").otherwise("sell")).when(F.col("venue") == 2, F.when(sold, "true").otherwise("false")).otherwise(F.when(sold, "sell").otherwise("buy"))
    return read_ticks(spark, d).where("kind = 3").withColumn("side", side).select("event_id", X.taker_side(F.col("venue"), F.col("side")).alias("taker_sell"))


@query("to_unix_sec", TICKS + ", u AS (SELECT event_id, CAST(recv_wall // CAST(pow(10, event_id % 4 * 3) AS BIGINT) AS DOUBLE) AS n FROM tick WHERE sub = 0) SELECT event_id, CASE WHEN n >= 1e17 THEN n / 1e9 WHEN n >= 1e14 THEN n / 1e6 WHEN n >= 1e11 THEN n / 1e3 ELSE n END AS seconds FROM u")
def to_unix_sec(spark: SparkSession, d: str) -> DataFrame:
    unit = F.pow(F.lit(10.0), (F.col("event_id") % 4) * 3).cast("bigint")
    return read_ticks(spark, d).where("sub = 0").select("event_id", X.to_unix_sec(F.call_function("div", F.col("recv_wall"), unit)).alias("seconds"))


_KEYS = ["scan.native.events_per_s", "latency_p99_ns", "a.p50", "size_bytes", "x.bytes_per_event", "loss_pct", "plain", "run_ms.total", "multiplier", "p500", "total_added_us", "fast.msgs_per_s", "mem_mb", "s"]
_KEY_SQL = "SELECT key FROM (VALUES " + ", ".join(f"('{k}')" for k in _KEYS) + ") v(key)"


@query("headline_metrics", f"SELECT key FROM ({_KEY_SQL}) WHERE key LIKE '%msgs_per_s%' OR key LIKE '%events_per_s%' OR key LIKE '%multiplier%' OR key LIKE '%bytes_per_event%' OR key LIKE '%gb_per_s%' OR key LIKE '%total_added%' OR len(list_intersect(string_split(replace(key, '.', '_'), '_'), ['p50', 'p90', 'p99', 'p999'])) > 0")
def headline_metrics(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in _KEYS], "key string").where(X.is_headline(F.col("key")))


_UNITS = {"scan.native.events_per_s": "events/s", "latency_p99_ns": "ns", "a.p50": "", "size_bytes": "bytes", "x.bytes_per_event": "B/event", "loss_pct": "%", "plain": "", "run_ms.total": "ms", "multiplier": "x", "p500": "", "total_added_us": "us", "fast.msgs_per_s": "msgs/s", "mem_mb": "MB", "s": "s"}


@query("unit_for", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{u}')" for k, u in _UNITS.items()) + ") v(key, unit)")
def unit_for(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k,) for k in _KEYS], "key string").select("key", X.unit_for(F.col("key")).alias("unit"))


@query("backoff_table", "SELECT n AS attempt, least(30000, 500 * CAST(pow(2, least(n, 31)) AS BIGINT)) AS ceiling_ms, CAST(greatest(1, least(3600, n * 300)) AS BIGINT) AS retry_s, (n + 1) * 1000 AS stagger_ms, n <= 5 OR n % 1000 = 0 AS logged FROM range(0, 40) t(n)")
def backoff_table(spark: SparkSession, d: str) -> DataFrame:
    """Reconnect arithmetic by attempt: ceiling, clamped pause, staggered start, log rule."""
    n = F.col("id")
    ceiling = F.least(F.lit(30_000).cast("bigint"), F.lit(500) * F.pow(F.lit(2.0), F.least(n, F.lit(31))).cast("bigint"))
    return spark.range(40).select(n.alias("attempt"), ceiling.alias("ceiling_ms"), F.greatest(F.lit(1).cast("bigint"), F.least(F.lit(3600).cast("bigint"), n * 300)).alias("retry_s"), ((n + 1) * 1000).alias("stagger_ms"), ((n <= 5) | (n % 1000 == 0)).alias("logged"))


@query("rotate_pred", TICKS + "SELECT event_id, qty >= 1000000000000 OR recv_mono >= 864000000000000 AS rotates FROM tick WHERE sub = 0")
def rotate_pred(spark: SparkSession, d: str) -> DataFrame:
    return read_ticks(spark, d).where("sub = 0").select("event_id", ((F.col("qty") >= 1_000_000_000_000) | (F.col("recv_mono") >= 864_000_000_000_000)).alias("rotates"))


@query("pace_schedule", TICKS + "SELECT event_id, CAST(CAST(recv_mono AS HUGEINT) * 1000000000 // 300000 AS DECIMAL(38,0)) AS deadline_ns FROM tick WHERE sub = 0")
def pace_schedule(spark: SparkSession, d: str) -> DataFrame:
    wide = F.col("recv_mono").cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return read_ticks(spark, d).where("sub = 0").select("event_id", ((wide - wide % F.lit(300_000).cast("decimal(6,0)")) / F.lit(300_000).cast("decimal(6,0)")).cast("decimal(38,0)").alias("deadline_ns"))


@query("fmt_bytes", TICKS + "SELECT event_id, CASE WHEN qty >= 1000000000 THEN qty // 1000000000 || ' GB' WHEN qty >= 1000000 THEN qty // 1000000 || ' MB' ELSE qty || ' B' END AS text FROM tick WHERE sub = 0")
def fmt_bytes(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("qty")
    def part(n: int, unit: str):  # noqa: E306
        return F.concat(F.call_function("div", q, F.lit(n)).cast("string"), F.lit(unit))

    return read_ticks(spark, d).where("sub = 0").select("event_id", F.when(q >= 10**9, part(10**9, " GB")).when(q >= 10**6, part(10**6, " MB")).otherwise(part(1, " B")).alias("text"))


@query("fmt_duration", TICKS + "SELECT event_id, recv_mono // 3600000000000 || 'h ' || recv_mono // 60000000000 % 60 || 'm' AS text FROM tick WHERE sub = 0")
def fmt_duration(spark: SparkSession, d: str) -> DataFrame:
    hours, minutes = F.call_function("div", F.col("recv_mono"), F.lit(3_600_000_000_000)), F.call_function("div", F.col("recv_mono"), F.lit(60_000_000_000)) % 60
    return read_ticks(spark, d).where("sub = 0").select("event_id", F.concat(hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m")).alias("text"))


@query("stats_parse", TICKS + "SELECT event_id, CASE venue WHEN 1 THEN 'coinbase' WHEN 2 THEN 'binance' ELSE 'kraken' END AS venue, recv_mono AS msgs FROM tick WHERE sub = 0 AND event_id % 7 NOT IN (0, 1)")
def stats_parse(spark: SparkSession, d: str) -> DataFrame:
    """Telemetry lines; lines that are no JSON and lines without a venue are left out."""
    name = F.element_at(F.array(F.lit("coinbase"), F.lit("binance"), F.lit("kraken")), F.col("venue"))
    line = F.when(F.col("event_id") % 7 == 0, F.lit('{"venue": "cut')).when(F.col("event_id") % 7 == 1, F.concat(F.lit('{"msgs":'), F.col("recv_mono"), F.lit("}"))).otherwise(F.concat(F.lit('{"venue":"'), name, F.lit('","msgs":'), F.col("recv_mono"), F.lit("}")))
    lines = read_ticks(spark, d).where("sub = 0").select("event_id", F.from_json(line, "venue string, msgs bigint", {"mode": "PERMISSIVE"}).alias("x"))
    return lines.where("x.venue is not null and x.msgs is not null").select("event_id", "x.venue", "x.msgs")


@query("contract_parse", TICKS + "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 0.0 ELSE CAST(instrument AS DOUBLE) END AS n, CASE WHEN event_id % 4 = 0 THEN 1 ELSE 2 END AS levels FROM tick WHERE sub = 0")
def contract_parse(spark: SparkSession, d: str) -> DataFrame:
    """Tolerant reading: numbers may be text, bad numbers become 0, bad levels go."""
    n = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('"'), F.col("instrument"), F.lit('"'))).when(F.col("event_id") % 3 == 1, F.lit('"none"')).otherwise(F.col("instrument").cast("string"))
    bad = F.when(F.col("event_id") % 4 == 0, F.lit('["x","1"]')).otherwise(F.lit('["3","4"]'))
    line = F.concat(F.lit('{"n":'), n, F.lit(',"bids":[["1","2"],'), bad, F.lit("]}"))
    read = read_ticks(spark, d).where("sub = 0").select("event_id", F.from_json(line, "n string, bids array<array<string>>").alias("x"))
    levels = F.filter("x.bids", lambda v: v[0].try_cast("double").isNotNull() & v[1].try_cast("double").isNotNull())
    return read.select("event_id", F.coalesce(F.col("x.n").try_cast("double"), F.lit(0.0)).alias("n"), F.size(levels).alias("levels"))


@query("flatten_numbers")
def flatten_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numeric leaves of result files under dotted keys."""
    from ticklake.functions.udtf import flatten_numbers as flatten

    rows = read_ticks(spark, d).where("sub = 0").select("event_id", F.concat(F.lit('{"a":{"b":'), F.col("price"), F.lit('},"c":['), F.col("qty"), F.lit(',"x",{"d":1.5}]}')).alias("doc"))
    return rows.lateralJoin(flatten(F.col("doc").outer()))


_ROWS = TICKS + ", r AS (SELECT 'v' || venue AS section, event_id, row_number() OVER (PARTITION BY venue ORDER BY event_id) AS n FROM tick WHERE sub = 0) "


@query("bench_rows", _ROWS + "SELECT section, event_id FROM r WHERE n <= 32")
def bench_rows(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("venue").orderBy("event_id")
    return read_ticks(spark, d).where("sub = 0").withColumn("n", F.row_number().over(by)).where("n <= 32").select(F.concat(F.lit("v"), F.col("venue")).alias("section"), "event_id")


@query("bench_sections", _ROWS + "SELECT section, min(event_id) AS first, count(*) AS n, string_agg(event_id, ',' ORDER BY event_id) AS ids FROM r WHERE n <= 32 GROUP BY section")
def bench_sections(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array_join(F.sort_array(F.collect_list("event_id")), ",")
    return bench_rows(spark, d).groupBy("section").agg(F.min("event_id").alias("first"), F.count("*").alias("n"), ids.alias("ids"))


@query("sql_functions", TICKS + "SELECT event_id, sub, price / 1e8 AS price, CASE WHEN kind IN (1, 5) THEN 'B' WHEN kind IN (2, 6) THEN 'A' END AS side, kind IN (1, 2, 4, 5, 6, 7, 11) AS book, CASE WHEN price - 100100000000 >= 0 THEN (price - 100100000000) * 2 ELSE -(price - 100100000000) * 2 - 1 END AS z, price - 100100000000 AS again FROM tick")
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The scalar functions as the session's SQL knows them."""
    from ticklake.functions.register import register

    register(spark)
    rows = read_ticks(spark, d)
    return spark.sql("SELECT event_id, sub, fixed_to_double(price) AS price, tick_side(kind) AS side, is_book(kind) AS book, zigzag(price - 100100000000) AS z, unzigzag(zigzag(price - 100100000000)) AS again FROM {rows}", rows=rows)
