"""Token-id output: a directory of patched frame-of-reference chunks in document order.

Layout (Parquet files, written by Spark's commit protocol on any file system):
one row for each chunk with ``part, chunk, first_id`` (ids before it in its part),
``n_ids``, ``doc_ids``, ``doc_lengths`` and ``blob`` (see ``pfor``).  Parts follow
each other in document order, chunks within a part likewise; a chunk holds whole
documents, at least ``CHUNK_IDS`` ids unless it is the last of its part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.llm import pfor
from ticklake.llm.common import documents, fresh, rows
from ticklake.llm.tokens import default_path, encoder

CHUNK_IDS = 1 << 19
_CHUNKS = "part int, chunk int, first_id long, n_ids long, doc_ids array<long>, doc_lengths array<long>, blob binary"
_ARROW = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64())), ("blob", pa.binary())])


#: Bytes of input that a range partition should hold at most.
PART_BYTES = 64 << 20


def parts_for(df: DataFrame, least: int = 2) -> int:
    """Range partitions: as many as the session shuffles to, or more where the input's size,
    as the files state it, asks for more."""
    n = max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stated = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # a plan that states no size gives a huge number
    return max(n, -(-stated // PART_BYTES)) if stated < 1 << 60 else n


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, chunk_ids: int = CHUNK_IDS) -> None:
    """Encode every whole text (null: empty), append ``end_id`` and write the ids in
    ascending doc_id order to ``path``.  Rows that repeat a doc_id are separate
    documents, ordered by a hash of their text and then the text; a null doc_id comes first.
    Very long texts are encoded by slices; other columns are not read; an empty table gives
    a store without chunks."""
    tokenizer = tokenizer or default_path()
    ranged = documents(docs).withColumn("tie", F.xxhash64("text")).repartitionByRange(parts_for(docs), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode_texts = TaskContext.get().partitionId(), encoder(tokenizer).encode
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = written = chunk = 0

        def cut() -> pa.RecordBatch:
            nonlocal held, size, written, chunk
            docs, lengths, ids = [d for x in held for d in x[0]], np.concatenate([x[1] for x in held]), np.concatenate([x[2] for x in held])
            out = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([part, chunk, written, len(ids), docs, lengths, pfor.pack(ids)], _ARROW.types, strict=True)], schema=_ARROW)
            written, chunk, held, size = written + len(ids), chunk + 1, [], 0
            return out

        for batch in batches:
            docs, (ids, edges) = batch.column(0).to_pylist(), encode_texts(batch.column(1).to_pylist())
            ids = np.insert(ids, edges[1:], np.uint32(end_id))
            lengths = np.diff(edges) + 1
            ends = np.cumsum(lengths)
            at = used = 0
            while at < len(docs):
                # up to the document that fills the chunk
                stop = min(len(docs), int(np.searchsorted(ends, used + chunk_ids - size)) + 1)
                held.append((docs[at:stop], lengths[at:stop], ids[used : ends[stop - 1]]))
                size += int(ends[stop - 1]) - used
                at, used = stop, int(ends[stop - 1])
                if size >= chunk_ids:
                    yield cut()
        if held:
            yield cut()

    ranged.select("doc_id", "text").mapInArrow(encode, _CHUNKS).write.option("compression", "none").mode("errorifexists").parquet(path)


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Rows doc_id, start (ids of all documents before it), n_tokens and ``ids``
    (array of long), or with ``digest`` the ids' unsigned crc32 as ``ids_crc32``; no rows
    from a store without chunks."""
    chunks = spark.read.schema(_CHUNKS).parquet(path)
    # one row for each part, so the running sum is over a table as small as the number of parts
    totals = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = totals.selectExpr("part", "coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0) as part_start")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, docs, lengths, blob in rows(batch, "first", "doc_ids", "doc_lengths", "blob"):
                ids = pfor.unpack(blob)
                edges = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                parts = [ids[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                last = pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in parts], pa.int64()) if digest else pa.array([x.astype(np.int64) for x in parts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(edges[:-1] + start), pa.array(lengths, pa.int64()), last], names=["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    placed = chunks.join(F.broadcast(before), "part").select((F.col("first_id") + F.col("part_start")).alias("first"), "doc_ids", "doc_lengths", "blob")
    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<long>"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` written as chunks and read back, as digests."""
    path = fresh(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path, digest=True)
