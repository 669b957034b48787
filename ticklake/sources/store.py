"""The tick store (range-sorted compressed Parquet), stream merging, raw listings and envelopes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticklake import schema as S


_ONCE: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared folder that the cluster names in
    spark.checkpoint.dir; a local one only where all executors run in this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="ticklake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def once(spark: SparkSession, key: str, label: str, write: Callable[[str], None]) -> str:
    """A scratch folder that ``write`` fills the first time an application asks for ``key``."""
    key = f"{spark.sparkContext.applicationId} {key}"
    if key not in _ONCE:
        path = scratch(spark, label)
        write(path)
        _ONCE[key] = path
    return _ONCE[key]


def stored(ticks: DataFrame, key: str) -> DataFrame:
    """The ticks' store, written the first time it is asked for under ``key``."""
    spark = ticks.sparkSession
    return read_store(spark, once(spark, f"store {key}", "store", lambda path: write_store(ticks, path)))


def write_index(index: DataFrame, path: str) -> None:
    """The snapshot index (instrument, mono, event_id, sub), sorted for look-ups by time."""
    index.select("instrument", "mono", "event_id", "sub").repartitionByRange("instrument", "mono").sortWithinPartitions("instrument", "mono", "event_id", "sub").write.mode("errorifexists").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("instrument int, mono bigint, event_id bigint, sub int").parquet(path)


def write_store(ticks: DataFrame, path: str, mode: str = "errorifexists", block: int = 1 << 20) -> None:
    """Write ticks once, range-partitioned and sorted by time, so that time filters skip
    row groups; refuses to replace a store.  Negative codes are refused by assertion."""
    fine = F.assert_true((F.col("kind") >= 0) & (F.col("instrument") >= 0), "negative code")
    checked = ticks.select(*S.TICK_COLUMNS).where(fine.isNull())
    checked.repartitionByRange(*S.ORDER).sortWithinPartitions(*S.ORDER).write.option("compression", "zstd").option("parquet.block.size", block).mode(mode).parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.TICK).parquet(path)


def export(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Write each table as JSON lines to its folder of ``path``, which must be new; the name
    and the number of rows of each, read back."""
    found = []
    for name, table in tables.items():
        table.write.mode("errorifexists").json(f"{path}/{name}")
        found.append(table.sparkSession.read.schema(table.schema).json(f"{path}/{name}").groupBy().agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows"))
    return reduce(DataFrame.unionByName, found)


def verify(ticks: DataFrame) -> DataFrame:
    """One row: ticks, steps back in time within an instrument, unknown kinds and venues."""
    from ticklake.operators import cells

    # events are numbered in time order of their source, so a step back is a fault
    rows = cells.running(ticks, "instrument", ["event_id", "sub"], cells.cell("event_id", 100_000), before=cells.last(F.col("recv_mono")))
    back = F.count_if(F.col("before") > F.col("recv_mono"))
    return rows.agg(
        F.count("*").alias("n"), back.alias("out_of_order"), F.count_if(~F.col("kind").between(1, 11)).alias("bad_kind"), F.count_if(~F.col("venue").between(1, 3)).alias("bad_venue")
    )


def merge(streams: list[DataFrame]) -> DataFrame:
    """One total order over all streams: time, venue, place in the stream."""
    return reduce(DataFrame.unionByName, streams).orderBy("recv_mono", "venue", "event_id", "sub")


def discover(listing: DataFrame) -> DataFrame:
    """Segments of a file listing (``path``): venue, start_wall, path, compressed; of a
    plain file and its compressed twin the compressed one."""
    # fixed values: venue folders and the endings of plain and compressed segments
    name = r"^(coinbase|binance|kraken)/.*-([0-9]+)\.fbraw(\.zst)?$"
    found = listing.where(F.col("path").rlike(name)).select(
        F.regexp_extract("path", name, 1).alias("venue"), F.regexp_extract("path", name, 2).cast("bigint").alias("start_wall"), (F.regexp_extract("path", name, 3) != "").alias("compressed"), "path"
    )
    return found.groupBy("venue", "start_wall").agg(F.max_by("path", "compressed").alias("path"), F.max("compressed").alias("compressed"))


def rest_envelope(instrument: Column, symbol: Column, url: Column, body: Column) -> Column:
    def quoted(text: Column) -> Column:
        return F.concat(F.lit('"'), F.regexp_replace(text, r'(["\\])', r"\\$1"), F.lit('"'))

    return F.concat(F.lit('{"instrument":'), instrument.cast("string"), F.lit(',"venue_symbol":'), quoted(symbol), F.lit(',"url":'), quoted(url), F.lit(',"body":'), body, F.lit("}"))


def parse_rest_envelope(envelope: Column) -> Column:
    """struct(instrument, body) of an envelope, the body verbatim; null if it is malformed."""
    mark = ',"body":'
    at = F.instr(envelope, F.lit(mark))
    number = F.regexp_extract(envelope, r'^\{"instrument":([0-9]+)', 1).try_cast("int")
    body = F.substring(envelope, at + len(mark), F.length(envelope) - at - len(mark))
    return F.when(number.isNotNull() & (at > 0) & envelope.endswith("}"), F.struct(number.alias("instrument"), body.alias("body")))


def generate_events(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """A seeded random walk of book-shaped events.  The generator's state after i steps is
    a product, so every partition starts where it must; only the walk's sums need order."""
    step = 0x9E3779B97F4A7C15  # fixed values: the constants of the SplitMix64 generator
    first, second = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            i = batch["id"].to_numpy().astype(np.uint64) + np.uint64(1)
            z = np.uint64(seed) + i * np.uint64(step)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(first)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(second)
            x = z ^ (z >> np.uint64(31))
            part = lambda shift, size: ((x >> np.uint64(shift)) % np.uint64(size)).astype(np.int64)
            yield pd.DataFrame({"i": i.astype(np.int64), "dt": 50_000 + part(0, 400_000), "dp": part(8, 2001) - 1000, "pick": part(0, 10), "qty": part(16, 500_000_000), "instrument": part(0, 15).astype(np.int32) + 1, "venue": part(0, 3).astype(np.int32) + 1})

    drawn = spark.range(n).mapInPandas(draw, "i bigint, dt bigint, dp bigint, pick bigint, qty bigint, instrument int, venue int")
    size = 1000
    block = drawn.withColumn("block", F.call_function("div", F.col("i") - 1, F.lit(size)))
    totals = block.groupBy("block").agg(F.sum("dt").alias("t"), F.sum("dp").alias("p"))
    starts = totals.selectExpr("block", "coalesce(sum(t) over (order by block rows between unbounded preceding and 1 preceding), 0) as t0", "coalesce(sum(p) over (order by block rows between unbounded preceding and 1 preceding), 0) as p0")
    by = Window.partitionBy("block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    walk = block.join(starts, "block").withColumns({"t": F.col("t0") + F.sum("dt").over(by) + 1_000_000_000, "price": F.col("p0") + F.sum("dp").over(by) + 6_358_964_000_000})
    kind = F.when(F.col("pick") == 0, S.TRADE).when(F.col("pick") <= 5, S.BID_SET).otherwise(S.ASK_SET)
    wall = F.col("t") + 1_700_000_000_000_000_000
    return walk.select(
        F.col("t").alias("recv_mono"), wall.alias("recv_wall"), (wall - 3_000_000).alias("venue_ts"), (F.col("i") + 1).alias("venue_seq"), "price", "qty", (F.col("i") + 1).alias("aux"),
        "instrument", kind.cast("int").alias("kind"), "venue", F.lit(0).alias("flags"), F.col("i").alias("event_id"), F.lit(0).alias("sub"),
    )
