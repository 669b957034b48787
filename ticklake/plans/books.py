"""Book state, point-in-time questions, checksums and cross-validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticklake import schema as S
from ticklake.functions import scalars as X
from ticklake.operators import aggregates as A
from ticklake.operators import book
from ticklake.plans.registry import query
from ticklake.plans.sql import CRC, INDEX, LEVELS, STATE, TICKS, crc_steps
from ticklake.sources.ticks import instruments, pair_decimals, pit_queries, read_events, read_ticks, ticks


def _ask(spark: SparkSession, d: str) -> DataFrame:
    return pit_queries(read_events(spark, d))


@query("sync_state", STATE + "SELECT event_id, sub, sync_state FROM state")
def sync_state(spark: SparkSession, d: str) -> DataFrame:
    return book.with_state(read_ticks(spark, d)).select("event_id", "sub", "sync_state")


_OUTCOME = """CASE WHEN kind IN (1, 2) THEN CASE WHEN sync_state = 'Synced' THEN 'Mutated' ELSE 'Dropped' END
 WHEN kind IN (5, 6) THEN CASE WHEN sync_state = 'Filling' THEN 'Mutated' ELSE 'Dropped' END WHEN kind = 4 THEN 'SnapshotStarted'
 WHEN kind = 7 THEN CASE WHEN sync_state = 'Filling' THEN 'SnapshotComplete' ELSE 'Dropped' END WHEN kind = 8 THEN 'ChecksumToVerify'
 WHEN kind = 11 THEN 'Cleared' WHEN kind = 10 THEN 'GapMarked' ELSE 'NotBook' END"""


@query("apply_outcome", STATE + f"SELECT event_id, sub, {_OUTCOME} AS outcome FROM state")
def apply_outcome(spark: SparkSession, d: str) -> DataFrame:
    return book.with_state(read_ticks(spark, d)).select("event_id", "sub", book.outcome().alias("outcome"))


@query("dropped_unsynced", STATE + f"SELECT instrument, count(CASE WHEN ({_OUTCOME}) = 'Dropped' THEN 1 END) AS dropped FROM state GROUP BY instrument")
def dropped_unsynced(spark: SparkSession, d: str) -> DataFrame:
    return book.with_state(read_ticks(spark, d)).groupBy("instrument").agg(F.count_if(book.outcome() == "Dropped").alias("dropped"))


@query("snapshot_level_counts", TICKS + ", b AS (SELECT event_id, instrument, count(CASE WHEN kind IN (5, 6) THEN 1 END) AS levels, count(*) AS n FROM tick WHERE flags & 2 = 2 GROUP BY ALL) SELECT instrument, event_id, levels, levels = 6 AS complete FROM b")
def snapshot_level_counts(spark: SparkSession, d: str) -> DataFrame:
    bracket = read_ticks(spark, d).where(F.col("flags").bitwiseAND(S.FROM_SNAPSHOT) == 2)
    got = bracket.groupBy("instrument", "event_id").agg(F.count_if(F.col("kind").isin(5, 6)).alias("levels"))
    return got.withColumn("complete", F.col("levels") == 6)


_ASOF = INDEX + ", found AS (SELECT q.qid, q.instrument, q.t, arg_max(i.mono, (i.mono, i.event_id)) AS anchor FROM ask q LEFT JOIN idx i ON i.instrument = q.instrument AND i.mono <= q.t GROUP BY ALL)"


@query("asof_snapshot", TICKS + _ASOF + "SELECT qid, instrument, t, anchor FROM found")
def asof_snapshot(spark: SparkSession, d: str) -> DataFrame:
    return _anchored(spark, d)


def _anchored(spark: SparkSession, d: str) -> DataFrame:
    return book.asof(_ask(spark, d), book.snapshot_index(read_ticks(spark, d)), "mono", ["event_id", "sub"], F.col("mono")).withColumnRenamed("found", "anchor")


_NAIVE = ", naive AS (SELECT q.qid, q.instrument, q.t, max(x.recv_mono) AS anchor FROM ask q LEFT JOIN tick x ON x.instrument = q.instrument AND x.kind = 4 AND x.recv_mono <= q.t GROUP BY ALL)"


def _naive(spark: SparkSession, d: str) -> DataFrame:
    begins = read_ticks(spark, d).where(F.col("kind") == S.SNAP_BEGIN)
    return book.asof(_ask(spark, d), begins, "recv_mono", ["event_id", "sub"], F.col("recv_mono")).withColumnRenamed("found", "anchor")


@query("naive_anchor", TICKS + _NAIVE + "SELECT * FROM naive")
def naive_anchor(spark: SparkSession, d: str) -> DataFrame:
    return _naive(spark, d)


@query("anchor_divergence", TICKS + _ASOF + _NAIVE + "SELECT f.qid, f.anchor, n.anchor AS naive, f.anchor IS DISTINCT FROM n.anchor AS diverged FROM found f JOIN naive n USING (qid)")
def anchor_divergence(spark: SparkSession, d: str) -> DataFrame:
    right = _naive(spark, d).select("qid", F.col("anchor").alias("naive"))
    return _anchored(spark, d).join(right, "qid").select("qid", "anchor", "naive", (~F.col("anchor").eqNullSafe(F.col("naive"))).alias("diverged"))


@query("anchor_or_first", TICKS + _ASOF + ", f AS (SELECT instrument, min(mono) AS first FROM idx GROUP BY 1) SELECT q.qid, coalesce(q.anchor, f.first) AS anchor FROM found q LEFT JOIN f USING (instrument)")
def anchor_or_first(spark: SparkSession, d: str) -> DataFrame:
    first = book.snapshot_index(read_ticks(spark, d)).groupBy("instrument").agg(F.min("mono").alias("first"))
    return _anchored(spark, d).join(F.broadcast(first), "instrument", "left").select("qid", F.coalesce("anchor", "first").alias("anchor"))


@query("pit_window", TICKS + _ASOF + "SELECT f.qid, count(*) AS n, CAST(sum(x.qty) AS DECIMAL(38,0)) AS qty FROM found f JOIN tick x ON x.instrument = f.instrument AND x.recv_mono BETWEEN f.anchor AND f.t GROUP BY 1")
def pit_window(spark: SparkSession, d: str) -> DataFrame:
    """Ticks between a question's anchor and its time.  Ranges over hourly cells meet by
    an equi-join, so a tick never meets a question of another hour."""
    cell = 3_600_000_000_000
    asked = _anchored(spark, d).where("anchor is not null")
    asked = asked.withColumn("cell", F.explode(F.sequence(F.call_function("div", F.col("anchor"), F.lit(cell)), F.call_function("div", F.col("t"), F.lit(cell)))))
    rows = read_ticks(spark, d).select("instrument", "recv_mono", "qty", F.call_function("div", F.col("recv_mono"), F.lit(cell)).alias("cell"))
    met = asked.join(rows, ["instrument", "cell"]).where("recv_mono between anchor and t")
    return met.groupBy("qid").agg(F.count("*").alias("n"), A.wide_sum("qty").alias("qty"))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    events = read_events(spark, d)
    return book.levels_at(pit_queries(events), ticks(events))


_TOPS = LEVELS + """, tops AS (SELECT qid, instrument, t, max(CASE WHEN side = 'B' THEN price END) AS bid, arg_max(CASE WHEN side = 'B' THEN qty END, CASE WHEN side = 'B' THEN price END) AS bid_qty,
 min(CASE WHEN side = 'A' THEN price END) AS ask, arg_min(CASE WHEN side = 'A' THEN qty END, CASE WHEN side = 'A' THEN price END) AS ask_qty,
 count(CASE WHEN side = 'B' THEN 1 END) AS bid_depth, count(CASE WHEN side = 'A' THEN 1 END) AS ask_depth FROM book GROUP BY ALL) """


@query("pit_bbo", _TOPS + "SELECT qid, bid, bid_qty, ask, ask_qty FROM tops")
def pit_bbo(spark: SparkSession, d: str) -> DataFrame:
    return book.tops(_levels(spark, d)).select("qid", "bid", "bid_qty", "ask", "ask_qty")


@query("pit_depth", _TOPS + "SELECT qid, bid_depth, ask_depth FROM tops")
def pit_depth(spark: SparkSession, d: str) -> DataFrame:
    return book.tops(_levels(spark, d)).select("qid", "bid_depth", "ask_depth")


_RANKED = LEVELS + ", ranked AS (SELECT *, row_number() OVER (PARTITION BY qid, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS rank FROM book) "


@query("pit_top10", _RANKED + "SELECT qid, side, rank, price, qty FROM ranked WHERE rank <= 10")
def pit_top10(spark: SparkSession, d: str) -> DataFrame:
    return book.top_n(_levels(spark, d)).select("qid", "side", "rank", "price", "qty")


_ANSWER = _TOPS + INDEX.replace(", control", ", control", 1) + _ASOF.removeprefix(INDEX)


@query("pit_query", _ANSWER + "SELECT f.qid, f.instrument, f.anchor, p.bid, p.bid_qty, p.ask, p.ask_qty FROM found f JOIN tops p USING (qid) WHERE f.anchor IS NOT NULL")
def pit_query(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).where("anchor is not null").drop("t")


def _answers(spark: SparkSession, d: str) -> DataFrame:
    return _anchored(spark, d).join(book.tops(_levels(spark, d)).drop("instrument", "t", "bid_depth", "ask_depth"), "qid")


@query("pit_batch", _ANSWER + "SELECT f.qid, f.instrument, f.t, f.anchor, p.bid, p.bid_qty, p.ask, p.ask_qty FROM found f LEFT JOIN tops p USING (qid)")
def pit_batch(spark: SparkSession, d: str) -> DataFrame:
    return _anchored(spark, d).join(book.tops(_levels(spark, d)).drop("instrument", "t", "bid_depth", "ask_depth"), "qid", "left")


@query("pit_hit_rate", TICKS + _ASOF + "SELECT instrument, count(*) AS n, round(avg(CASE WHEN anchor IS NULL THEN 0 ELSE 1 END), 9) AS hit_rate, min(t) AS first_t FROM found GROUP BY instrument")
def pit_hit_rate(spark: SparkSession, d: str) -> DataFrame:
    return _anchored(spark, d).groupBy("instrument").agg(F.count("*").alias("n"), F.round(F.avg(F.col("anchor").isNotNull().cast("int")), 9).alias("hit_rate"), F.min("t").alias("first_t"))


@query("mid_price", _TOPS + "SELECT qid, (CAST(bid AS DOUBLE) / 100000000 + CAST(ask AS DOUBLE) / 100000000) / 2 AS mid FROM tops WHERE bid IS NOT NULL AND ask IS NOT NULL")
def mid_price(spark: SparkSession, d: str) -> DataFrame:
    top = book.tops(_levels(spark, d)).where("bid is not null and ask is not null")
    return top.select("qid", ((X.fixed_to_double(F.col("bid")) + X.fixed_to_double(F.col("ask"))) / 2).alias("mid"))


@query("book_series", _TOPS.replace("ask AS (SELECT event_id", "ask_unused AS (SELECT event_id") .replace("WITH base", "WITH ask AS (SELECT g * 15 + i AS qid, CAST(i AS INTEGER) AS instrument, g * 21600000000000 AS t FROM (SELECT unnest(range((SELECT min(epoch_us(ts)) * 1000 - 1704067200000000000 FROM events) // 21600000000000, (SELECT max(epoch_us(ts)) * 1000 - 1704067200000000000 FROM events) // 21600000000000 + 1)) AS g) a, range(1, 16) b(i)), base") + """, last AS (SELECT q.qid, arg_max(s.kind, s.place) AS kind, arg_max(s.sync_state, s.place) AS st FROM ask q JOIN state s ON s.instrument = q.instrument AND s.recv_mono <= q.t GROUP BY 1)
 SELECT instrument, t, bid, ask, (CAST(bid AS DOUBLE) / 100000000 + CAST(ask AS DOUBLE) / 100000000) / 2 AS mid FROM tops JOIN last USING (qid)
 WHERE bid IS NOT NULL AND ask IS NOT NULL AND CASE WHEN kind IN (4, 10, 11) THEN FALSE WHEN kind = 7 AND st = 'Filling' THEN TRUE ELSE st = 'Synced' END""")
def book_series(spark: SparkSession, d: str) -> DataFrame:
    """Synced, two-sided books on a grid of six hours over the time that the ticks span."""
    step = F.lit(21_600_000_000_000)
    span = read_ticks(spark, d).agg(F.min("recv_mono").alias("a"), F.max("recv_mono").alias("b"))
    steps = span.select(F.explode(F.sequence(F.call_function("div", F.col("a"), step), F.call_function("div", F.col("b"), step))).alias("g"))
    grid = steps.crossJoin(F.broadcast(instruments(spark).select("instrument")))
    asked = grid.select((F.col("g") * 15 + F.col("instrument")).alias("qid"), "instrument", (F.col("g") * 21_600_000_000_000).alias("t"))
    return _series(read_ticks(spark, d), asked)


def _series(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """Best prices and mid of books that are synced and two-sided when they are asked for."""
    kind, state = F.col("kind"), F.col("sync_state")
    after = F.when(kind.isin(S.SNAP_BEGIN, S.GAP, S.CLEAR), False).when((kind == S.SNAP_END) & (state == "Filling"), True).otherwise(state == "Synced")
    synced = book.asof(asked, book.with_state(rows).withColumn("after", after), "recv_mono", ["event_id", "sub"], F.col("after")).where("found").select("qid")
    top = book.tops(book.levels_at(asked, rows)).where("bid is not null and ask is not null").join(synced, "qid")
    return top.select("instrument", "t", "bid", "ask", ((X.fixed_to_double(F.col("bid")) + X.fixed_to_double(F.col("ask"))) / 2).alias("mid"))


_BOUNDS = "SELECT max(w) - 1704067200000000000 AS last, greatest(min(w), max(w) - 86400000000000) - 1704067200000000000 AS first FROM (SELECT epoch_us(ts) * 1000 AS w FROM events)"
_GRID = f"WITH span AS ({_BOUNDS}), stepped AS (SELECT first, last, greatest(10, ((last - first + 999999999) // 1000000000 + 1999) // 2000) * 1000000000 AS step FROM span), ask AS (SELECT k * 15 + i AS qid, CAST(i AS INTEGER) AS instrument, first + k * step AS t FROM (SELECT *, unnest(range(0, (last - first) // step + 1)) AS k FROM stepped) a, range(1, 16) b(i)), base"
_SERIES_END = """, last AS (SELECT q.qid, arg_max(s.kind, s.place) AS kind, arg_max(s.sync_state, s.place) AS st FROM ask q JOIN state s ON s.instrument = q.instrument AND s.recv_mono <= q.t GROUP BY 1)
 SELECT instrument, t, bid, ask, (CAST(bid AS DOUBLE) / 100000000 + CAST(ask AS DOUBLE) / 100000000) / 2 AS mid FROM tops JOIN last USING (qid)
 WHERE bid IS NOT NULL AND ask IS NOT NULL AND CASE WHEN kind IN (4, 10, 11) THEN FALSE WHEN kind = 7 AND st = 'Filling' THEN TRUE ELSE st = 'Synced' END"""


@query("book_window", _TOPS.replace("ask AS (SELECT event_id", "ask_unused AS (SELECT event_id").replace("WITH base", _GRID) + _SERIES_END)
def book_window(spark: SparkSession, d: str) -> DataFrame:
    """Synced, two-sided books over the last day, by a step that gives at most 2000 points."""
    rows = read_ticks(spark, d)
    span = rows.agg(F.max("recv_mono").alias("b"), F.greatest(F.min("recv_mono"), F.max("recv_mono") - 86_400_000_000_000).alias("a"))
    seconds = F.call_function("div", F.col("b") - F.col("a") + 999_999_999, F.lit(1_000_000_000))
    step = F.greatest(F.lit(10).cast("bigint"), F.call_function("div", seconds + 1999, F.lit(2000))) * 1_000_000_000
    points = span.select(F.posexplode(F.sequence("a", "b", step)).alias("k", "t"))
    asked = points.crossJoin(F.broadcast(instruments(spark).select("instrument"))).select((F.col("k") * 15 + F.col("instrument")).cast("bigint").alias("qid"), "instrument", "t")
    return _series(rows, asked)


_FINAL = STATE + """, last AS (SELECT instrument, max(epoch) AS epoch FROM state GROUP BY 1), final AS (SELECT s.instrument, s.side, s.price, arg_max(s.qty, s.place) AS qty FROM state s JOIN last l USING (instrument, epoch) WHERE s.effective GROUP BY ALL HAVING arg_max(s.qty, s.place) <> 0) """


@query("backend_parity", STATE + "SELECT 0::BIGINT AS only_closed, 0::BIGINT AS only_folded")
def backend_parity(spark: SparkSession, d: str) -> DataFrame:
    """The closed form and the fold give the same best prices after each instrument's last
    effective tick: rows that only one of them has."""
    rows = read_ticks(spark, d)
    folded = A.last_row(book.fold(rows).withColumn("at", F.struct(*S.ORDER)), ["instrument"], "at").select("instrument", "epoch", "recv_mono", "bid", "bid_qty", "ask", "ask_qty")
    ends = book.with_state(rows).where("effective").groupBy("instrument").agg(F.max("recv_mono").alias("t"))
    asked = ends.select(F.col("instrument").cast("bigint").alias("qid"), "instrument", "t")
    closed = book.tops(book.levels_at(asked, rows)).select("instrument", "bid", "bid_qty", "ask", "ask_qty")
    folded = folded.select("instrument", "bid", "bid_qty", "ask", "ask_qty").where("bid is not null or ask is not null")
    return closed.exceptAll(folded).agg(F.count("*").alias("only_closed")).crossJoin(folded.exceptAll(closed).agg(F.count("*").alias("only_folded")))


@query("bbo_changes")
def bbo_changes(spark: SparkSession, d: str) -> DataFrame:
    return book.fold(read_ticks(spark, d)).where("top_changed")


@query("capped_book")
def capped_book(spark: SparkSession, d: str) -> DataFrame:
    return book.fold(read_ticks(spark, d), cap=3)


@query("venue_capped_book")
def venue_capped_book(spark: SparkSession, d: str) -> DataFrame:
    """Books of which the second venue's hold two levels a side and the third's four."""
    return book.fold(read_ticks(spark, d), cap={2: 2, 3: 4})


@query("event_digest")
def event_digest(spark: SparkSession, d: str) -> DataFrame:
    return book.stream_digest(read_ticks(spark, d))


@query("book_digest")
def book_digest(spark: SparkSession, d: str) -> DataFrame:
    return book.book_digests(read_ticks(spark, d))


def book_crc(levels: DataFrame) -> DataFrame:
    """CRC32 of the digits of the ten best levels of each side, asks first; levels carry
    qid, side, price, qty, rank and the pair's decimals."""
    digits = F.concat(X.crc_digits(F.col("price"), F.col("price_decimals")), X.crc_digits(F.col("qty"), F.col("qty_decimals")))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("side", "rank", digits.alias("x")))), lambda v: v["x"]), "")
    return levels.groupBy("qid").agg(text.alias("digits")).withColumn("crc", F.crc32(F.col("digits").cast("binary")))


@query("crc_digits", _RANKED + ", w AS (SELECT r.qid, r.side, r.rank, CASE WHEN r.price // CAST(pow(10, 8 - c.price_decimals) AS BIGINT) = 0 THEN '' ELSE CAST(r.price // CAST(pow(10, 8 - c.price_decimals) AS BIGINT) AS VARCHAR) END || CASE WHEN r.qty = 0 THEN '' ELSE CAST(r.qty AS VARCHAR) END AS x FROM ranked r JOIN decimals c USING (instrument) WHERE rank <= 10) SELECT qid, string_agg(x, '' ORDER BY side, rank) AS digits FROM w GROUP BY qid")
def crc_digits(spark: SparkSession, d: str) -> DataFrame:
    levels = book.top_n(_levels(spark, d)).join(F.broadcast(pair_decimals(spark)), "instrument")
    return book_crc(levels).select("qid", "digits")


_DIGITS = ", w AS (SELECT r.qid, r.side, r.rank, CASE WHEN r.price // CAST(pow(10, 8 - c.price_decimals) AS BIGINT) = 0 THEN '' ELSE CAST(r.price // CAST(pow(10, 8 - c.price_decimals) AS BIGINT) AS VARCHAR) END || CASE WHEN r.qty = 0 THEN '' ELSE CAST(r.qty AS VARCHAR) END AS x FROM ranked r JOIN decimals c USING (instrument) WHERE rank <= 10), texts AS (SELECT qid AS id, string_agg(x, '' ORDER BY side, rank) AS x FROM w GROUP BY qid), "


def _with_crc(statement: str) -> str:
    return CRC + ", " + statement.strip().removeprefix("WITH ")


@query("book_crc32", _with_crc(_RANKED) + _DIGITS + crc_steps("texts") + " SELECT id AS qid, texts.x AS digits, crc FROM done JOIN texts USING (id)")
def book_crc32(spark: SparkSession, d: str) -> DataFrame:
    return book_crc(book.top_n(_levels(spark, d)).join(F.broadcast(pair_decimals(spark)), "instrument"))


_STATED = "stated_row AS (SELECT event_id AS qid, instrument, recv_mono AS t FROM state WHERE kind = 8 AND venue = 3 AND sync_state = 'Synced')"
_CHECKED = _with_crc(_RANKED.replace("FROM ask q)", "FROM stated_row q)").replace(", question AS", ", " + _STATED + ", question AS"))


@query("crc_verify", _CHECKED + _DIGITS + crc_steps("texts") + " SELECT q.qid, q.instrument, coalesce(crc, 0) + CASE WHEN q.qid % 3 = 0 THEN 1 ELSE 0 END AS stated, coalesce(crc, 0) AS crc, q.qid % 3 <> 0 AS matches FROM stated_row q LEFT JOIN done ON done.id = q.qid")
def crc_verify(spark: SparkSession, d: str) -> DataFrame:
    """Checksum ticks of synced third-venue books: the stated sum against the book's.  The
    stated sums are those of books folded tick by tick, every third off by one."""
    rows = read_ticks(spark, d)
    marks = book.with_state(rows).where("kind = 8 and venue = 3 and sync_state = 'Synced'").select(F.col("event_id").alias("qid"), "instrument", F.col("recv_mono").alias("t"))
    levels = book.top_n(book.levels_at(marks, rows)).join(F.broadcast(pair_decimals(spark)), "instrument")
    folded = book_crc(book.top_n(book.folded_at(rows, "kind = 8 and venue = 3 and sync_state = 'Synced'")).join(F.broadcast(pair_decimals(spark)), "instrument")).select("qid", F.col("crc").alias("folded"))
    stated = marks.join(folded, "qid", "left").withColumn("stated", F.coalesce("folded", F.lit(0)) + F.when(F.col("qid") % 3 == 0, 1).otherwise(0))
    crc = F.coalesce("crc", F.lit(0))
    return stated.join(book_crc(levels), "qid", "left").select("qid", "instrument", "stated", crc.alias("crc"), (F.col("stated") == crc).alias("matches"))


_OVERLAP = _RANKED + """, live AS (SELECT * FROM ranked WHERE rank <= 10), rest AS (SELECT qid, side, price, qty + CASE WHEN rank % 2 = 0 THEN 1 ELSE 0 END AS qty FROM live),
 s AS (SELECT l.qid, count(CASE WHEN l.price = r.price AND l.qty = r.qty THEN 1 END) * 5 AS exact_pct, count(CASE WHEN l.price = r.price THEN 1 END) * 5 AS price_pct FROM live l JOIN rest r ON l.qid = r.qid AND l.side = r.side AND l.price = r.price GROUP BY 1) """


def _overlap(spark: SparkSession, d: str) -> DataFrame:
    """Shares of the twenty best levels that a snapshot confirms: price and quantity, price
    alone.  The snapshot is the book with every second quantity one more."""
    live = book.top_n(_levels(spark, d))
    rest = live.withColumn("qty", F.col("qty") + (F.col("rank") % 2 == 0).cast("int"))
    def sides(rows: DataFrame, name: str) -> DataFrame:  # noqa: E306
        return rows.groupBy("qid").agg(F.collect_set(F.struct("side", "price", "qty")).alias(name))

    both = sides(live, "live").join(sides(rest, "rest"), "qid")
    exact = F.size(F.array_intersect("live", "rest"))
    price = F.size(F.array_intersect(F.transform("live", lambda v: F.struct(v["side"], v["price"])), F.transform("rest", lambda v: F.struct(v["side"], v["price"]))))
    return both.select("qid", (exact * 5).cast("bigint").alias("exact_pct"), (price * 5).cast("bigint").alias("price_pct"))


@query("crossval_overlap", _OVERLAP + "SELECT * FROM s")
def crossval_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d)


@query("crossval_summary", _OVERLAP + ", r AS (SELECT exact_pct, row_number() OVER (ORDER BY exact_pct) - 1 AS i, count(*) OVER () AS n FROM s) SELECT max(CASE WHEN i = (n - 1) * 50 // 100 THEN exact_pct END) AS p50, max(CASE WHEN i = (n - 1) * 90 // 100 THEN exact_pct END) AS p90, min(exact_pct) AS worst, max(n) AS scored FROM r")
def crossval_summary(spark: SparkSession, d: str) -> DataFrame:
    # the percentages are multiples of five, so ranks come from 21 counts
    counts = _overlap(spark, d).groupBy("exact_pct").agg(F.count("*").alias("c"))
    upto = Window.orderBy("exact_pct").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"upto": F.sum("c").over(upto), "n": F.sum("c").over(Window.partitionBy())})
    def at(p: int):  # noqa: E306
        return F.min(F.when(F.col("upto") > F.call_function("div", (F.col("n") - 1) * p, F.lit(100)), F.col("exact_pct")))

    return ranked.agg(at(50).alias("p50"), at(90).alias("p90"), F.min("exact_pct").alias("worst"), F.max("n").alias("scored"))


@query("dataset_export", TICKS + """SELECT 'ticks' AS name, count(*) AS rows FROM tick UNION ALL SELECT 'instruments', count(*) FROM inst UNION ALL SELECT 'decimals', count(*) FROM decimals
 UNION ALL SELECT 'venues', count(DISTINCT venue) FROM tick UNION ALL SELECT 'days', count(*) FROM (SELECT DISTINCT instrument, recv_mono // 86400000000000 FROM tick)""")
def dataset_export(spark: SparkSession, d: str) -> DataFrame:
    """Tables for a reader outside, each a folder of JSON lines, and the rows read back from
    them: ticks, the registry, decimals, venue totals and daily sums."""
    from ticklake.sources.store import export, scratch

    rows = read_ticks(spark, d)
    day = F.call_function("div", F.col("recv_mono"), F.lit(86_400_000_000_000))
    tables = {
        "ticks": rows, "instruments": instruments(spark), "decimals": pair_decimals(spark), "venues": rows.groupBy("venue").agg(F.count("*").alias("n")),
        "days": rows.groupBy("instrument", day.alias("day")).agg(F.count("*").alias("n"), A.wide_sum("qty").alias("qty")),
    }
    return export(tables, scratch(spark, "export"))
