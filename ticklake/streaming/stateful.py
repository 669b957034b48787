"""Keyed streaming state: trade-id gaps, update chains and books that live across batches."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ticklake.sources.store import scratch


def trade_gaps(trades: DataFrame) -> DataFrame:
    """Gaps of a stream of trades (instrument, spot, id): the state of an instrument is the
    largest id seen; ids that come late are no gap and never lower it."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("spot")
        top = rows["id"].cummax()
        seen = top.shift(1)
        if state.exists:
            held = state.get[0]
            seen = seen.fillna(held).clip(lower=held)
            top = top.clip(lower=held)
        state.update((int(top.iloc[-1]),))
        missed = rows["id"] - seen - 1
        gap = missed > 0
        yield pd.DataFrame({"instrument": key[0], "id": rows["id"][gap], "missed": missed[gap].astype("int64")})

    return trades.groupBy("instrument").applyInPandasWithState(run, "instrument int, id bigint, missed bigint", "seen bigint", "append", GroupStateTimeout.NoTimeout)


def depth_chain(diffs: DataFrame) -> DataFrame:
    """The chain of update ids over a stream of diffs and snapshots (instrument, frame_id,
    snapshot, first_u, final_u): stale frames are dropped, a gap says how many updates were
    missed and asks for a new snapshot, and a snapshot older than what the stream has shown is
    refused.  The state is the last applied id and the highest id shown since it was lost."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, high = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("frame_id")
        verdicts, missed = [], []
        for snapshot, first_u, final_u in zip(rows["snapshot"].tolist(), rows["first_u"].tolist(), rows["final_u"].tolist(), strict=True):
            lost = 0
            if snapshot:
                verdict = "too_old" if last is None and high is not None and final_u < high else "synced"
                last = final_u if verdict == "synced" else last
            elif last is None:
                verdict, high = "early", final_u if high is None else max(high, final_u)
            elif final_u <= last:
                verdict = "stale"
            elif first_u > last + 1:
                verdict, lost, high, last = "gap", first_u - last - 1, final_u, None
            else:
                verdict, last = "applied", final_u
            verdicts.append(verdict)
            missed.append(lost)
        state.update((last, high))
        yield pd.DataFrame({"instrument": key[0], "frame_id": rows["frame_id"], "verdict": verdicts, "missed": missed, "need_resync": [v == "gap" for v in verdicts]})

    return diffs.groupBy("instrument").applyInPandasWithState(run, "instrument int, frame_id bigint, verdict string, missed bigint, need_resync boolean", "last bigint, high bigint", "append", GroupStateTimeout.NoTimeout)


def book_tops(ticks: DataFrame) -> DataFrame:
    """Best prices of each instrument after each batch of a stream of ticks; the state is
    the book (its levels and whether it is synced)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mode, sides = json.loads(state.get[0]) if state.exists else ["Unsynced", {"B": {}, "A": {}}]
        sides = {s: {int(p): q for p, q in levels.items()} for s, levels in sides.items()}
        rows = pd.concat(list(batches)).sort_values(["recv_mono", "event_id", "sub"])
        for kind, price, qty in zip(rows["kind"].tolist(), rows["price"].tolist(), rows["qty"].tolist(), strict=True):
            if kind in (1, 2, 5, 6):
                if mode == ("Synced" if kind < 3 else "Filling"):
                    side = sides["B" if kind in (1, 5) else "A"]
                    if qty == 0:
                        side.pop(price, None)
                    else:
                        side[price] = qty
            elif kind in (4, 11):
                sides, mode = {"B": {}, "A": {}}, "Filling" if kind == 4 else "Unsynced"
            elif kind == 7:
                mode = "Synced" if mode == "Filling" else mode
            elif kind == 10:
                mode = "Unsynced"
        state.update((json.dumps([mode, sides]),))
        bid, ask = max(sides["B"], default=None), min(sides["A"], default=None)
        yield pd.DataFrame([(key[0], int(rows["recv_mono"].iloc[-1]), bid, ask)], columns=["instrument", "recv_mono", "bid", "ask"]).astype({"bid": "Int64", "ask": "Int64"})

    return ticks.groupBy("instrument").applyInPandasWithState(run, "instrument int, recv_mono bigint, bid bigint, ask bigint", "book string", "append", GroupStateTimeout.NoTimeout)


def drops(rows: DataFrame, path: str, order: str, count: int = 4) -> None:
    """Write rows as ``count`` drops of files, one after another by ``order``.  Within a drop
    all of an instrument's rows are in one file, so a file stream meets them in order however
    its batches are cut; instruments are spread over files."""
    cuts = rows.approxQuantile(order, [i / count for i in range(1, count)], 0.01)
    edges = [None, *sorted(set(cuts)), None]
    for i, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        part = rows
        if low is not None:
            part = part.where(F.col(order) >= F.lit(int(low)))
        if high is not None:
            part = part.where(F.col(order) < F.lit(int(high)))
        part.repartition("instrument").write.parquet(f"{path}/drop-{i:04d}")


def drain(spark: SparkSession, path: str, schema: str, operator: Callable[[DataFrame], DataFrame], progress: str | None = None, timeout_s: int = 600) -> DataFrame:
    """Run a stateful operator over the files below ``path`` to their end; its rows.

    Results and the stream's progress lie in the folder ``progress`` (a fresh one if none is
    given): given again, the stream goes on where it stopped, and its rows are added."""
    progress = progress or scratch(spark, "stream")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).option("recursiveFileLookup", "true").parquet(path)
    query = operator(stream).writeStream.outputMode("append").format("parquet").option("path", f"{progress}/rows").option("checkpointLocation", f"{progress}/checkpoint").trigger(availableNow=True).start()
    if not query.awaitTermination(timeout_s):
        query.stop()
        raise TimeoutError("the stream did not end")
    return spark.read.schema(query_schema(spark, schema, operator)).parquet(f"{progress}/rows")


def query_schema(spark: SparkSession, schema: str, operator: Callable[[DataFrame], DataFrame]):
    """Columns of an operator's rows, from an empty stream."""
    empty = spark.readStream.format("rate").load().where("false")
    return operator(empty.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(schema)])).schema
