"""Tick projection of the ``events`` table, and the small dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake import schema as S


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def ticks(events: DataFrame) -> DataFrame:
    """One tick for each event, eight for a snapshot bracket; exact integers throughout.

    Views set bids, clicks set asks, purchases trade; sign-ups are brackets, dangling
    begins or checksums by ``k`` of their properties, errors clear, mark gaps or beat."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    wall = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) * 1000L")
    base = events.select(
        "event_id", wall.alias("wall"), (F.col("user_id") % 15 + 1).cast("int").alias("instrument"), "event_type",
        (F.round(F.col("value") * 100).cast("bigint") * 1_000_000).alias("q"), k.alias("k"),
    )
    kk = F.expr(
        "CASE WHEN event_type = 'view' THEN 1 WHEN event_type = 'click' THEN 2 WHEN event_type = 'purchase' THEN 3 "
        "WHEN event_type = 'signup' AND k < 30 THEN 100 WHEN event_type = 'signup' AND k < 40 THEN 4 WHEN event_type = 'signup' THEN 8 "
        "WHEN k < 10 THEN 11 WHEN k < 20 THEN 10 ELSE 9 END"
    )
    bracket = F.col("kk") == 100
    rows = base.withColumn("kk", kk).withColumn("sub", F.explode(F.when(bracket, F.sequence(F.lit(0), F.lit(7))).otherwise(F.array(F.lit(0)))))
    side = F.when(F.col("sub") == 0, 4).when(F.col("sub") <= 3, 5).when(F.col("sub") <= 6, 6).otherwise(7)
    price = F.expr(
        "CASE WHEN kk = 1 THEN 1000 - k % 10 WHEN kk = 2 THEN 1001 + k % 10 WHEN kk = 3 THEN 1000 "
        "WHEN kk = 100 AND sub BETWEEN 1 AND 3 THEN 1000 - (k + sub) % 10 WHEN kk = 100 AND sub BETWEEN 4 AND 6 THEN 1001 + (k + sub) % 10 ELSE 0 END"
    )
    qty = F.expr("CASE WHEN kk IN (1, 2) AND k % 7 = 0 THEN 0L WHEN kk IN (1, 2, 3) THEN q WHEN kk = 100 AND sub BETWEEN 1 AND 6 THEN q + sub * 100000000L ELSE 0L END")
    return rows.select(
        (F.col("wall") - F.lit(1_704_067_200_000_000_000)).alias("recv_mono"), F.col("wall").alias("recv_wall"), (F.col("wall") - F.col("k") * 1_000_000).alias("venue_ts"),
        F.col("event_id").alias("venue_seq"), (price.cast("bigint") * S.SCALE).alias("price"), qty.alias("qty"), F.col("event_id").alias("aux"), "instrument",
        F.when(bracket, side).otherwise(F.col("kk")).cast("int").alias("kind"), F.expr("CAST((instrument - 1) DIV 5 + 1 AS INT)").alias("venue"),
        F.when((F.col("kk") == 3) & (F.col("k") % 2 == 1), 1).when(bracket, 2).otherwise(0).cast("int").alias("flags"), "event_id", F.col("sub").cast("int").alias("sub"),
    )


def read_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(read_events(spark, sf_dir))


def instruments(spark: SparkSession) -> DataFrame:
    """The 15 registered instruments: id, venue, venue_symbol, canonical."""
    i = F.col("id") - 1
    base = F.element_at(F.array(*map(F.lit, S.BASES)), (i % 5 + 1).cast("int"))
    venue = F.floor(i / 5) + 1
    symbol = F.when(venue == 1, F.concat(base, F.lit("-USD"))).when(venue == 2, F.concat(base, F.lit("USDT"))).otherwise(F.concat(base, F.lit("/USD")))
    return spark.range(1, 16).select(F.col("id").cast("int").alias("instrument"), venue.cast("int").alias("venue"), symbol.alias("venue_symbol"), F.concat(base, F.lit("-USD")).alias("canonical"))


def pair_decimals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, p, q) for i, (p, q) in S.PAIR_DECIMALS.items()], "instrument int, price_decimals int, qty_decimals int")


def pit_queries(events: DataFrame) -> DataFrame:
    """The point-in-time questions: every fiftieth event asks about one instrument."""
    t = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ)) * 1000L")
    return events.where("event_id % 50 = 0").select(F.col("event_id").alias("qid"), F.expr("CAST((event_id DIV 50) % 15 + 1 AS INT)").alias("instrument"), t.alias("t"))
