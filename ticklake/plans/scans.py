"""Scans, projections, filters and plain aggregations over ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticklake import schema as S
from ticklake.functions import scalars as X
from ticklake.operators import aggregates as A
from ticklake.operators import cells, series
from ticklake.plans.registry import query
from ticklake.plans.sql import CRC, INDEX, TICKS, crc_steps
from ticklake.sources import store
from ticklake.sources.ticks import instruments, read_events, read_ticks

_DEC = "CAST({} AS DECIMAL(38,0))"
_ALL = ", ".join(S.TICK_COLUMNS)


@query("full_scan_agg", TICKS + "SELECT instrument, count(*) AS n, CAST(sum(qty) AS DECIMAL(38,0)) AS sum_qty, min(price) AS min_price, max(price) AS max_price, max(recv_mono) AS last_mono FROM tick GROUP BY instrument")
def full_scan_agg(spark: SparkSession, d: str) -> DataFrame:
    return A.instrument_scan(read_ticks(spark, d)).orderBy("instrument")


@query("split_sum", TICKS + "SELECT instrument, CAST(sum(qty >> 31) AS BIGINT) AS hi, CAST(sum(qty & 2147483647) AS BIGINT) AS lo, CAST(sum(qty) AS DECIMAL(38,0)) AS total FROM tick GROUP BY instrument")
def split_sum(spark: SparkSession, d: str) -> DataFrame:
    hi, lo = F.sum(F.shiftright("qty", 31)), F.sum(F.col("qty").bitwiseAND(2147483647))
    got = read_ticks(spark, d).groupBy("instrument").agg(hi.alias("hi"), lo.alias("lo"))
    return got.withColumn("total", (F.col("hi").cast("decimal(19,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("lo").cast("decimal(19,0)")).cast(A.WIDE))


@query("pruned_scan", TICKS + "SELECT instrument, kind, price FROM tick WHERE kind = 3")
def pruned_scan(spark: SparkSession, d: str) -> DataFrame:
    return read_ticks(spark, d).where("kind = 3").select("instrument", "kind", "price")


@query("range_scan", TICKS + f"SELECT {_ALL} FROM tick WHERE recv_mono BETWEEN 500000000000000 AND 900000000000000")
def range_scan(spark: SparkSession, d: str) -> DataFrame:
    """A time range of the store, whose row groups are sorted by time: the bounds are pushed to its scan."""
    return store.stored(read_ticks(spark, d), d).where("recv_mono between 500000000000000 and 900000000000000")


_SUMS = ["recv_mono", "recv_wall", "venue_ts", "price", "qty", "aux"]
_CHECK = "SELECT count(*) AS n, " + ", ".join(f"CAST(sum({c}) AS DECIMAL(38,0)) AS {c}" for c in _SUMS) + ", CAST(sum(instrument * 1000 + kind * 10 + venue) AS BIGINT) AS codes FROM tick"


def _check(ticks: DataFrame) -> DataFrame:
    codes = F.sum((F.col("instrument") * 1000 + F.col("kind") * 10 + F.col("venue")).cast("bigint"))
    return ticks.agg(F.count("*").alias("n"), *[A.wide_sum(c).alias(c) for c in _SUMS], codes.alias("codes"))


@query("full_scan_checksum", TICKS + _CHECK)
def full_scan_checksum(spark: SparkSession, d: str) -> DataFrame:
    return _check(read_ticks(spark, d))


@query("store_roundtrip", TICKS + f"SELECT {_ALL} FROM tick")
def store_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = store.scratch(spark, "ticks")
    store.write_store(read_ticks(spark, d), path)
    return store.read_store(spark, path)


@query("parquet_export_roundtrip", TICKS + _CHECK)
def parquet_export_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = store.scratch(spark, "export")
    read_ticks(spark, d).write.option("compression", "zstd").mode("errorifexists").parquet(path)
    return _check(spark.read.schema(S.TICK).parquet(path))


@query("store_verify", TICKS + "SELECT count(*) AS n, CAST(0 AS BIGINT) AS out_of_order, CAST(0 AS BIGINT) AS bad_kind, CAST(0 AS BIGINT) AS bad_venue FROM tick")
def store_verify(spark: SparkSession, d: str) -> DataFrame:
    path = store.scratch(spark, "verify")
    store.write_store(read_ticks(spark, d), path)
    return store.verify(store.read_store(spark, path))


@query("merged_stream", TICKS + "SELECT recv_mono, venue, event_id, sub, kind FROM tick")
def merged_stream(spark: SparkSession, d: str) -> DataFrame:
    ticks = read_ticks(spark, d).select("recv_mono", "venue", "event_id", "sub", "kind")
    return store.merge([ticks.where(F.col("venue") == v) for v in S.VENUES])


@query("snapshot_index", TICKS + INDEX + "SELECT * FROM idx")
def snapshot_index(spark: SparkSession, d: str) -> DataFrame:
    from ticklake.operators import book

    return book.snapshot_index(read_ticks(spark, d))


_FILES = """
WITH f AS (SELECT ['coinbase', 'binance', 'kraken', 'other'][CAST(event_id % 4 + 1 AS INTEGER)] AS dir, event_id // 3 AS wall, event_id % 3 AS form FROM events),
p AS (SELECT dir || '/' || dir || '-' || wall || CASE form WHEN 0 THEN '.fbraw' WHEN 1 THEN '.fbraw.zst' ELSE '.tmp' END AS path FROM f),
g AS (SELECT regexp_extract(path, '^([a-z]+)/', 1) AS venue, CAST(regexp_extract(path, '-([0-9]+)\\.fbraw(\\.zst)?$', 1) AS BIGINT) AS start_wall, ends_with(path, '.zst') AS compressed, path FROM p
  WHERE regexp_matches(path, '^(coinbase|binance|kraken)/.*-[0-9]+\\.fbraw(\\.zst)?$'))
SELECT venue, start_wall, arg_max(path, compressed) AS path, max(compressed) AS compressed FROM g GROUP BY venue, start_wall
"""


@query("discover_dedupe", _FILES)
def discover_dedupe(spark: SparkSession, d: str) -> DataFrame:
    part = F.element_at(F.array(*map(F.lit, ["coinbase", "binance", "kraken", "other"])), (F.col("event_id") % 4 + 1).cast("int"))
    form = F.element_at(F.array(*map(F.lit, [".fbraw", ".fbraw.zst", ".tmp"])), (F.col("event_id") % 3 + 1).cast("int"))
    listing = read_events(spark, d).select(F.concat(part, F.lit("/"), part, F.lit("-"), F.expr("event_id div 3").cast("string"), form).alias("path"))
    return store.discover(listing)


_FRAMES = TICKS + """, frame AS (SELECT venue, event_id, sub, recv_mono, '{"e":' || event_id || ',"p":' || price || ',"q":' || qty || '}' AS payload FROM tick)"""


def frames(ticks: DataFrame) -> DataFrame:
    """Raw frames: the ticks as JSON payloads."""
    payload = F.concat(F.lit('{"e":'), F.col("event_id"), F.lit(',"p":'), F.col("price"), F.lit(',"q":'), F.col("qty"), F.lit("}"))
    return ticks.select("venue", "event_id", "sub", "recv_mono", "recv_wall", payload.alias("payload"))


def _segments(spark: SparkSession, d: str) -> str:
    """The frames written as rotated segment files, once for a session and input."""
    from ticklake.sources import segments

    def write(path: str) -> None:
        segments.write(frames(read_ticks(spark, d)), path, 1 << 18)

    return store.once(spark, f"segments {d}", "segments", write)


@query("raw_scan_report", _FRAMES + "SELECT venue, count(*) AS records, CAST(sum(length(payload)) AS BIGINT) AS payload_bytes, CAST(sum(25 + length(payload)) AS BIGINT) AS record_bytes, 0::BIGINT AS torn FROM frame GROUP BY venue")
def raw_scan_report(spark: SparkSession, d: str) -> DataFrame:
    """Segment files scanned record by record: a record is a length, a kind, two clocks, the
    payload and a checksum."""
    from ticklake.sources import segments

    got = segments.report(segments.read(spark, _segments(spark, d)))
    return got.groupBy("venue").agg(F.sum("records").alias("records"), F.sum("payload_bytes").alias("payload_bytes"), F.sum(F.col("valid_bytes") - F.col("header_bytes")).alias("record_bytes"), F.count("torn").alias("torn"))


@query("raw_scan", _FRAMES + "SELECT venue, recv_mono, payload FROM frame")
def raw_scan(spark: SparkSession, d: str) -> DataFrame:
    """Frames written as segment files and read back record by record."""
    from ticklake.sources import segments

    got = segments.records(segments.read(spark, _segments(spark, d)))
    return got.select("venue", "recv_mono", F.col("payload").cast("string").alias("payload"))


@query("torn_tails", _FRAMES + ", f AS (SELECT venue, recv_mono // 86400000000000 AS day, event_id, sub, recv_mono, 25 + length(payload) AS size FROM frame), g AS (SELECT venue, day, count(*) AS n, sum(size) AS bytes, arg_max(size, (recv_mono, event_id, sub)) AS tail FROM f GROUP BY ALL) SELECT venue, day, CAST(n - CASE WHEN day % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS records, CAST(34 + bytes - CASE WHEN day % 3 = 0 THEN 0 ELSE tail END AS BIGINT) AS valid_bytes, CASE day % 3 WHEN 1 THEN 'short record' WHEN 2 THEN 'bad checksum' END AS torn FROM g")
def torn_tails(spark: SparkSession, d: str) -> DataFrame:
    """A segment for each venue and day, every third whole, the others cut short or with a
    flipped last byte: what is left after recovery."""
    from ticklake.sources import segments

    day = F.call_function("div", F.col("recv_mono"), F.lit(86_400_000_000_000))
    files = segments.images(frames(read_ticks(spark, d)).withColumn("day", day), "day")
    size = F.length("content")
    cut = F.expr("substring(content, 1, length(content) - 1)")
    flipped = F.concat(cut, F.unhex(F.lpad(F.hex(F.pmod(F.conv(F.hex(F.expr("substring(content, length(content), 1)")), 16, 10).cast("int") + 1, F.lit(256))), 2, "0")))
    torn = files.withColumn("content", F.when((F.col("day") % 3 == 0) | (size == 0), F.col("content")).when(F.col("day") % 3 == 1, F.expr("substring(content, 1, length(content) - 3)")).otherwise(flipped))
    whole = segments.report(segments.recover(torn.select("path", "content")))
    told = segments.report(torn.select("path", "content")).select("path", "torn")
    got = whole.select("path", "venue", "records", "valid_bytes").join(told, "path").join(files.select("path", "day"), "path")
    return got.select("venue", "day", "records", "valid_bytes", "torn")


@query("per_venue_cap", _FRAMES + "SELECT venue, event_id, sub FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY recv_mono, event_id, sub) AS n FROM frame) WHERE n <= 100")
def per_venue_cap(spark: SparkSession, d: str) -> DataFrame:
    by = Window.partitionBy("venue").orderBy(*S.ORDER)
    return frames(read_ticks(spark, d)).withColumn("n", F.row_number().over(by)).where("n <= 100").select("venue", "event_id", "sub")


@query("rest_envelope_roundtrip", TICKS + "SELECT event_id, instrument, '{\"bids\":[[\"' || price || '\",\"1\"]]}' AS body FROM tick WHERE sub = 0")
def rest_envelope_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    body = F.concat(F.lit('{"bids":[["'), F.col("price"), F.lit('","1"]]}'))
    packed = read_ticks(spark, d).where("sub = 0").join(F.broadcast(instruments(spark).drop("venue", "canonical")), "instrument").withColumn("body", body)
    packed = packed.select("event_id", store.rest_envelope(F.col("instrument"), F.col("venue_symbol"), F.lit("https://x/book"), F.col("body")).alias("envelope"))
    got = store.parse_rest_envelope(F.col("envelope"))
    return packed.select("event_id", got["instrument"].alias("instrument"), got["body"].alias("body"))


_MIX = "CAST((CAST(xor({v}, {v} >> {n}) AS UHUGEINT) * {m}) % 18446744073709551616 AS UBIGINT)"


@query("event_gen", f"""WITH i AS (SELECT CAST(unnest(range(1, (SELECT count(*) FROM events) + 1)) AS BIGINT) AS i),
 a AS (SELECT i, CAST((42 + CAST(i AS UHUGEINT) * 11400714819323198485) % 18446744073709551616 AS UBIGINT) AS z FROM i),
 b AS (SELECT i, {_MIX.format(v='z', n=30, m='13787848793156543929')} AS z FROM a), c AS (SELECT i, {_MIX.format(v='z', n=27, m='10723151780598845931')} AS z FROM b),
 x AS (SELECT i, xor(z, z >> 31) AS x FROM c),
 d AS (SELECT i, 50000 + CAST(x % 400000 AS BIGINT) AS dt, CAST((x >> 8) % 2001 AS BIGINT) - 1000 AS dp, CAST(x % 10 AS INTEGER) AS pick, CAST((x >> 16) % 500000000 AS BIGINT) AS qty, CAST(x % 15 AS INTEGER) + 1 AS instrument, CAST(x % 3 AS INTEGER) + 1 AS venue FROM x),
 w AS (SELECT *, CAST(sum(dt) OVER (ORDER BY i) AS BIGINT) + 1000000000 AS t, CAST(sum(dp) OVER (ORDER BY i) AS BIGINT) + 6358964000000 AS price FROM d)
 SELECT t AS recv_mono, t + 1700000000000000000 AS recv_wall, t + 1699999999997000000 AS venue_ts, i + 1 AS venue_seq, price, qty, i + 1 AS aux, instrument, CASE WHEN pick = 0 THEN 3 WHEN pick <= 5 THEN 1 ELSE 2 END AS kind, venue, 0 AS flags, i AS event_id, 0 AS sub FROM w""")
def event_gen(spark: SparkSession, d: str) -> DataFrame:
    """As many generated events as the table has."""
    return store.generate_events(spark, read_events(spark, d).count(), 42)


@query("kind_decode", TICKS + "SELECT CASE kind " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in S.KIND_NAMES.items()) + " END AS kind_name, venue, count(*) AS n FROM tick GROUP BY ALL")
def kind_decode(spark: SparkSession, d: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in S.KIND_NAMES.items() for x in pair])
    return read_ticks(spark, d).groupBy(F.try_element_at(names, F.col("kind")).alias("kind_name"), "venue").agg(F.count("*").alias("n"))


@query("side_of", TICKS + "SELECT CASE WHEN kind IN (1, 5) THEN 'B' WHEN kind IN (2, 6) THEN 'A' END AS side, count(*) AS n, CAST(sum(qty) AS DECIMAL(38,0)) AS qty FROM tick GROUP BY ALL")
def side_of(spark: SparkSession, d: str) -> DataFrame:
    from ticklake.operators.book import side

    return read_ticks(spark, d).groupBy(side().alias("side")).agg(F.count("*").alias("n"), A.wide_sum("qty").alias("qty"))


@query("book_events", TICKS + "SELECT event_id, sub, kind FROM tick WHERE kind IN (1, 2, 4, 5, 6, 7, 11)")
def book_events(spark: SparkSession, d: str) -> DataFrame:
    return read_ticks(spark, d).where(F.col("kind").isin(1, 2, 4, 5, 6, 7, 11)).select("event_id", "sub", "kind")


@query("steady_filter", TICKS + "SELECT instrument, count(*) AS n, CAST(sum(flags & 1) AS BIGINT) AS taker_sells FROM tick WHERE flags & 2 = 0 GROUP BY instrument")
def steady_filter(spark: SparkSession, d: str) -> DataFrame:
    steady = read_ticks(spark, d).where(F.col("flags").bitwiseAND(S.FROM_SNAPSHOT) == 0)
    return steady.groupBy("instrument").agg(F.count("*").alias("n"), F.sum(F.col("flags").bitwiseAND(S.TAKER_SELL)).alias("taker_sells"))


@query("checked_cast", TICKS + "SELECT event_id, sub, TRY_CAST(price // 1000000 AS INTEGER) AS narrow, price // 1000000 > 2147483647 OR qty // 100 > 2147483647 AS overflows, TRY_CAST(qty // 100 AS INTEGER) AS narrow_qty FROM tick")
def checked_cast(spark: SparkSession, d: str) -> DataFrame:
    price, qty = F.expr("price div 1000000"), F.expr("qty div 100")
    return read_ticks(spark, d).select("event_id", "sub", price.try_cast("int").alias("narrow"), ((price > 2147483647) | (qty > 2147483647)).alias("overflows"), qty.try_cast("int").alias("narrow_qty"))


@query("symbol_subset", TICKS + "SELECT t.instrument, i.venue_symbol, count(*) AS n FROM tick t JOIN inst i USING (instrument) WHERE split_part(i.canonical, '-', 1) IN ('BTC', 'SOL') AND t.venue IN (1, 3) GROUP BY ALL")
def symbol_subset(spark: SparkSession, d: str) -> DataFrame:
    wanted = instruments(spark).where(F.split("canonical", "-")[0].isin("BTC", "SOL") & F.col("venue").isin(1, 3)).select("instrument", "venue_symbol")
    return read_ticks(spark, d).join(F.broadcast(wanted), "instrument").groupBy("instrument", "venue_symbol").agg(F.count("*").alias("n"))


@query("instruments_seen", TICKS + "SELECT DISTINCT instrument FROM tick")
def instruments_seen(spark: SparkSession, d: str) -> DataFrame:
    return read_ticks(spark, d).select("instrument").distinct()


_COUNT = ", ".join(f"CAST(count(CASE WHEN kind IN ({k}) THEN 1 END) AS BIGINT) AS {n}" for n, k in (("sets", "1, 2"), ("trades", "3"), ("begins", "4"), ("ends", "7"), ("checksums", "8"), ("beats", "9"), ("gaps", "10"), ("clears", "11")))


@query("replay_counters", TICKS + f"SELECT count(*) AS events, {_COUNT}, count(CASE WHEN flags & 1 = 1 THEN 1 END) AS taker_sells FROM tick")
def replay_counters(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("kind")
    named = {"sets": (1, 2), "trades": (3,), "begins": (4,), "ends": (7,), "checksums": (8,), "beats": (9,), "gaps": (10,), "clears": (11,)}
    return read_ticks(spark, d).agg(F.count("*").alias("events"), *[F.count_if(kind.isin(*k)).alias(n) for n, k in named.items()], F.count_if(F.col("flags").bitwiseAND(1) == 1).alias("taker_sells"))


@query("venue_rollup", TICKS + "SELECT coalesce(CASE venue WHEN 1 THEN 'coinbase' WHEN 2 THEN 'binance' WHEN 3 THEN 'kraken' END, 'total') AS venue, count(*) AS events, count(CASE WHEN kind = 10 THEN 1 END) AS gaps FROM tick GROUP BY ROLLUP (venue)")
def venue_rollup(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, S.VENUES.values())), F.col("venue"))
    got = read_ticks(spark, d).withColumn("name", name).rollup("name").agg(F.count("*").alias("events"), F.count_if(F.col("kind") == 10).alias("gaps"))
    return got.select(F.coalesce("name", F.lit("total")).alias("venue"), "events", "gaps")


_LAT = TICKS + ", lat AS (SELECT *, recv_wall - venue_ts AS ns FROM tick WHERE venue_ts <> 0)"
_DISC = "CAST(quantile_disc(ns, {}) AS BIGINT) AS p{}"
_MS = 1_000_000
_PS = [(0.5, "50"), (0.9, "90"), (0.99, "99"), (0.999, "999")]


def _latency(spark: SparkSession, d: str) -> DataFrame:
    return read_ticks(spark, d).where("venue_ts <> 0").withColumn("ns", F.col("recv_wall") - F.col("venue_ts"))


@query("latency_percentiles", _LAT + "SELECT instrument, count(*) AS n, min(ns) AS least, max(ns) AS most, " + ", ".join(_DISC.format(q, n) for q, n in _PS) + ", round(avg(ns), 3) AS mean, round(coalesce(stddev_samp(ns), 0), 2) AS stdev FROM lat GROUP BY instrument")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = _latency(spark, d)
    ranks = cells.nearest_ranks(rows, "instrument", "ns", {f"p{n}": int(q * 1000) for q, n in _PS}, _MS)
    return rows.groupBy("instrument").agg(F.count("*").alias("n"), F.min("ns").alias("least"), F.max("ns").alias("most"), F.round(F.avg("ns"), 3).alias("mean"), F.round(F.coalesce(F.stddev_samp("ns"), F.lit(0.0)), 2).alias("stdev")).join(ranks, "instrument")


@query("floor_percentile", _LAT + ", r AS (SELECT venue, ns, row_number() OVER (PARTITION BY venue ORDER BY ns) - 1 AS i, count(*) OVER (PARTITION BY venue) AS n FROM lat) SELECT venue, max(CASE WHEN i = (n - 1) * 50 // 100 THEN ns END) AS p50, max(CASE WHEN i = (n - 1) * 90 // 100 THEN ns END) AS p90 FROM r GROUP BY venue")
def floor_percentile(spark: SparkSession, d: str) -> DataFrame:
    return A.floor_percentiles(_latency(spark, d), ["venue"], "ns", [50, 90])


@query("median_disc", _LAT + "SELECT instrument, CAST(quantile_disc(ns, 0.5) AS BIGINT) AS median FROM lat GROUP BY instrument")
def median_disc(spark: SparkSession, d: str) -> DataFrame:
    return cells.nearest_ranks(_latency(spark, d), "instrument", "ns", {"median": 500}, _MS)


@query("venue_latency", _LAT + "SELECT venue, " + ", ".join(f"quantile_disc(ns / 1e6, {q}) AS p{n}" for q, n in _PS[:3]) + ", count(*) AS n FROM lat GROUP BY venue")
def venue_latency(spark: SparkSession, d: str) -> DataFrame:
    ms = _latency(spark, d).withColumn("ms", F.col("ns") / F.lit(1e6))
    ranks = cells.nearest_ranks(ms, "venue", "ms", {f"p{n}": int(q * 1000) for q, n in _PS[:3]}, 1.0)
    return ms.groupBy("venue").agg(F.count("*").alias("n")).join(ranks, "venue")


@query("venue_latency_clamped", _LAT + ", c AS (SELECT venue, ns - 20000000 AS ns FROM lat) SELECT venue, CAST(quantile_disc(greatest(ns, 0), 0.5) AS BIGINT) AS p50, count(CASE WHEN ns < 0 THEN 1 END) AS clamped, count(*) AS n FROM c GROUP BY venue")
def venue_latency_clamped(spark: SparkSession, d: str) -> DataFrame:
    shifted = _latency(spark, d).withColumn("ns", F.col("ns") - 20_000_000).withColumn("held", F.greatest("ns", F.lit(0)))
    ranks = cells.nearest_ranks(shifted, "venue", "held", {"p50": 500}, _MS)
    return shifted.groupBy("venue").agg(F.count_if(F.col("ns") < 0).alias("clamped"), F.count("*").alias("n")).join(ranks, "venue")


@query("block_zone_map", TICKS + ", b AS (SELECT *, (row_number() OVER (PARTITION BY instrument ORDER BY recv_mono, event_id, sub) - 1) // 256 AS block FROM tick) SELECT instrument, block, count(*) AS n, min(recv_mono) AS min_mono, max(recv_mono) AS max_mono, min(recv_wall) AS min_wall, max(recv_wall) AS max_wall FROM b GROUP BY ALL")
def block_zone_map(spark: SparkSession, d: str) -> DataFrame:
    return A.zone_map(read_ticks(spark, d), 256)


_ZZ = "CASE WHEN {v} >= 0 THEN {v} * 2 ELSE -{v} * 2 - 1 END"
_BYTES = "greatest(1, (length(ltrim(bin({v}), '0')) + 6) // 7)"


@query("size_report", TICKS + f""", a AS (SELECT *, recv_mono - lag(recv_mono, 1, 0) OVER w AS d_mono, price - lag(price, 1, 0) OVER w AS d_price FROM tick WINDOW w AS (PARTITION BY instrument ORDER BY recv_mono, event_id, sub)),
 b AS (SELECT *, d_mono - lag(d_mono, 1, 0) OVER (PARTITION BY instrument ORDER BY recv_mono, event_id, sub) AS dd FROM a),
 z AS (SELECT instrument, 25 + length('{{"e":' || event_id || ',"p":' || price || ',"q":' || qty || '}}') AS raw, {_ZZ.format(v='dd')} AS zt, {_ZZ.format(v='d_price')} AS zp, qty FROM b)
 SELECT instrument, CAST(sum(raw) AS BIGINT) AS raw_bytes, CAST(sum({_BYTES.format(v='zt')} + {_BYTES.format(v='zp')} + {_BYTES.format(v='qty')}) AS BIGINT) AS stored_bytes,
 round(sum(raw) / sum({_BYTES.format(v='zt')} + {_BYTES.format(v='zp')} + {_BYTES.format(v='qty')}), 6) AS ratio FROM z GROUP BY instrument""")
def size_report(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of an instrument's raw records against those of its time, price and quantity
    columns as variable-length deltas."""
    rows = read_ticks(spark, d)
    raw = frames(rows.withColumn("venue", F.col("instrument"))).groupBy(F.col("venue").alias("instrument")).agg(F.sum(F.length("payload") + 25).cast("bigint").alias("raw_bytes"))
    deltas = series.delta_columns(rows).join(rows.select("event_id", "sub", "qty"), ["event_id", "sub"])
    size = X.varint_len(X.zigzag(F.col("dd_mono"))) + X.varint_len(F.col("zz_price")) + X.varint_len(F.col("qty"))
    got = raw.join(deltas.groupBy("instrument").agg(F.sum(size).alias("stored_bytes")), "instrument")
    return got.withColumn("ratio", F.round(F.coalesce(F.try_divide(F.col("raw_bytes").cast("double"), F.col("stored_bytes").cast("double")), F.lit(0.0)), 6))


@query("rate_agg", TICKS + ", s AS (SELECT venue, count(*) AS n, max(recv_mono) - min(recv_mono) AS ns FROM tick GROUP BY venue) SELECT venue, n, CASE WHEN ns = 0 THEN 0 ELSE round(n * 1e9 / ns, 9) END AS rate FROM s")
def rate_agg(spark: SparkSession, d: str) -> DataFrame:
    got = read_ticks(spark, d).groupBy("venue").agg(F.count("*").alias("n"), (F.max("recv_mono") - F.min("recv_mono")).alias("ns"))
    return got.select("venue", "n", F.round(F.coalesce(F.try_divide(F.col("n") * F.lit(1e9), F.col("ns").cast("double")), F.lit(0.0)), 9).alias("rate"))


@query("registry_build", TICKS + "SELECT * FROM inst")
def registry_build(spark: SparkSession, d: str) -> DataFrame:
    return instruments(spark)


@query("stride_sample", TICKS + ", n AS (SELECT instrument, event_id, sub, row_number() OVER (PARTITION BY instrument ORDER BY recv_mono, event_id, sub) - 1 AS i, count(*) OVER (PARTITION BY instrument) AS total FROM tick) SELECT instrument, event_id, sub FROM n WHERE i % greatest(1, (total + 99) // 100) = 0")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    """Every k-th tick of an instrument, k the least that keeps it to about a hundred."""
    rows = read_ticks(spark, d).select("instrument", *S.ORDER)
    placed = cells.numbered(rows, "instrument", list(S.ORDER), cells.cell("recv_mono")).join(rows.groupBy("instrument").agg(F.count("*").alias("total")), "instrument")
    return placed.where((F.col("place") - 1) % F.greatest(F.lit(1), F.call_function("div", F.col("total") + 99, F.lit(100))) == 0).select("instrument", "event_id", "sub")


_HALVED = "CASE WHEN (total + 98) // 99 <= 1 THEN 1 ELSE 1 << length(ltrim(bin((total + 98) // 99 - 1), '0')) END"


@query("halving_sample", TICKS + f", n AS (SELECT instrument, event_id, sub, row_number() OVER (PARTITION BY instrument ORDER BY recv_mono, event_id, sub) - 1 AS i, count(*) OVER (PARTITION BY instrument) AS total FROM tick) SELECT instrument, event_id, sub FROM n WHERE i % ({_HALVED}) = 0")
def halving_sample(spark: SparkSession, d: str) -> DataFrame:
    """What a sampler keeps of each instrument that drops every second sample and doubles its
    stride whenever it holds a hundred: the stride is a function of the count."""
    rows = read_ticks(spark, d).select("instrument", *S.ORDER)
    placed = cells.numbered(rows, "instrument", list(S.ORDER), cells.cell("recv_mono")).join(rows.groupBy("instrument").agg(F.count("*").alias("total")), "instrument")
    full = F.call_function("div", F.col("total") + 98, F.lit(99))
    stride = F.when(full <= 1, F.lit(1).cast("bigint")).otherwise(F.expr("shiftleft(1L, length(bin(((total + 98) div 99) - 1)))"))
    return placed.where((F.col("place") - 1) % stride == 0).select("instrument", "event_id", "sub")


@query("crc32", CRC + ", s AS (SELECT event_id AS id, 't' || event_id || props AS x FROM events), " + crc_steps("s") + " SELECT id AS event_id, crc FROM done")
def crc32(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("t"), F.col("event_id"), F.col("props"))
    return read_events(spark, d).select("event_id", F.crc32(text.cast("binary")).alias("crc"))


@query("leb128", TICKS + ", v AS (SELECT event_id, sub, qty, greatest(1, (length(ltrim(bin(qty), '0')) + 6) // 7) AS n FROM tick) SELECT event_id, sub, array_to_string(list_transform(range(0, n), lambda g: printf('%02X', ((qty >> CAST(7 * g AS INTEGER)) & 127) + CASE WHEN g < n - 1 THEN 128 ELSE 0 END)), '') AS bytes, qty AS again FROM v")
def leb128(spark: SparkSession, d: str) -> DataFrame:
    """Quantities as variable-length bytes, in hex, and read back."""
    put = read_ticks(spark, d).select("event_id", "sub", X.put_uvarint(F.col("qty")).alias("raw"))
    return put.select("event_id", "sub", F.hex("raw").alias("bytes"), X.take_uvarint(F.col("raw")).alias("again"))


@query("sql_quote", "SELECT event_id, '''' || replace(event_type || '''s ' || props, '''', '''''') || '''' AS literal FROM events")
def sql_quote(spark: SparkSession, d: str) -> DataFrame:
    return read_events(spark, d).select("event_id", X.sql_quote(F.concat("event_type", F.lit("'s "), "props")).alias("literal"))


@query("snapshot_index_stored", TICKS + INDEX + "SELECT instrument, mono, event_id, sub FROM idx")
def snapshot_index_stored(spark: SparkSession, d: str) -> DataFrame:
    """The snapshot index written beside the store and loaded again."""
    from ticklake.operators import book

    path = store.scratch(spark, "index")
    store.write_index(book.snapshot_index(read_ticks(spark, d)), path)
    return store.read_index(spark, path)
