"""Packing along a space-filling curve.

Each document's hashed token counts are projected to three dimensions; documents are
range-sorted by the Hilbert key of that point, and the token stream along the curve is
cut into sequences, so that neighbours in meaning share sequences and only the last
sequence of a range partition can be short.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.llm.common import documents, mix, rows, table
from ticklake.llm.token_store import parts_for
from ticklake.llm.tokens import default_path, encoder

BINS, DIMS, BITS = 256, 3, 10


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions of integer points (n, dims; each below 2**bits) along the Hilbert curve.

    From the coarsest bit down, each axis whose bit is set inverts the lower bits of the
    first axis and each other axis trades them with the first; the Gray code of the
    result, its bits interleaved, is the position."""
    x = points.T.astype(np.int64).copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for d in range(dims):
            on = (x[d] >> level & 1).astype(bool)
            trade = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, trade)
            x[d] ^= trade
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = key << 1 | x[d] >> level & 1
    return key


def _directions(seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((BINS, DIMS)) / np.sqrt(BINS)


def _place(ids: np.ndarray, edges: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Hilbert keys of documents whose ids lie between the edges."""
    n = len(edges) - 1
    row = np.repeat(np.arange(n), np.diff(edges))
    counts = np.bincount(row * BINS + ids % BINS, minlength=n * BINS).reshape(n, BINS)
    seen = np.sqrt(counts)
    seen /= np.maximum(np.linalg.norm(seen, axis=1, keepdims=True), 1e-12)
    # a unit vector's projection has a deviation near 1/16; +-0.5 spans what occurs, the rest goes to the rim
    grid = np.clip((seen @ directions + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_key(grid)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, length: int = 1024, end_id: int = 0) -> DataFrame:
    """Rows for each piece of a document: doc_id, start (its document's ids before
    it), length, ids (uint32 little-endian bytes), doc_tokens, sequence_id and offset.

    Every id lies in one piece; sequences are full but for the last of each range
    partition, which is padded to the next power of two.  Null text counts as empty
    and gives the end id alone; rows that repeat a doc_id are separate documents; documents
    of one place on the curve come in the order of a hash of their ids and then their doc_id;
    very long texts are encoded by slices; other columns are not read; an empty table gives
    no rows."""
    tokenizer = tokenizer or default_path()
    parts = parts_for(docs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts, directions = encoder(tokenizer).encode, _directions()
        for batch in batches:
            ids, edges = encode_texts(batch.column(1).to_pylist())
            ids = np.insert(ids, edges[1:], np.uint32(end_id)).astype("<u4", copy=False)
            edges = edges + np.arange(len(edges))
            keys = _place(ids, edges, directions)
            tie = mix(np.array([zlib.crc32(ids[a:b]) for a, b in zip(edges, edges[1:], strict=False)], np.uint64)).astype(np.int64)
            # ids below 2**16 are stored in two bytes, others in four after one that makes the length odd
            if not len(ids) or ids.max() < 65536:
                small = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(2 * edges), pa.py_buffer(ids.astype("<u2"))]).cast(pa.binary())
            else:
                small = pa.array([b"\xff" + ids[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(tie, pa.int64()), small], names=["doc_id", "key", "tie", "ids"])

    placed = table(documents(docs).mapInArrow(encode, "doc_id long, key long, tie long, ids binary"), "placed")
    ranged = placed.repartitionByRange(parts, "key", "tie", "doc_id").sortWithinPartitions("key", "tie", "doc_id")
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "seq", "offset", "part"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, offset = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            out: list[tuple] = []
            for doc, raw in rows(batch, "doc_id", "ids"):
                ids = raw[1:] if len(raw) % 2 else np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                total, at = len(ids) // 4, 0
                while at < total:
                    n = min(total - at, length - offset)
                    out.append((doc, at, n, ids[4 * at : 4 * (at + n)], total, seq, offset, part))
                    at, offset = at + n, offset + n
                    if offset == length:
                        seq, offset = seq + 1, 0
            columns = list(zip(*out, strict=True)) if out else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    pieces = table(ranged.select("doc_id", "ids").mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, seq long, offset long, part int"), "pieces")
    # a row for each range partition: the running sum is over a table as small as their number
    totals = pieces.groupBy("part").agg(F.max("seq").alias("last"))
    before = totals.selectExpr("part", "coalesce(sum(last + 1) over (order by part rows between unbounded preceding and 1 preceding), 0) as first")
    return pieces.join(F.broadcast(before), "part").select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("seq") + F.col("first")).alias("sequence_id"), "offset")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all ``documents`` in sequences of at most 1024 tokens."""
    return digest(pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def digest(pieces: DataFrame) -> DataFrame:
    """Pieces with the unsigned crc32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
