"""Plumbing shared by the training-data operators.

Intermediate tables go to the folder that the cluster names in
``spark.checkpoint.dir``; a local folder is made only where that is unset (tests).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one that the cluster names, or a local
    one where all executors run in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="ticklake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that ``cleanup`` deletes."""
    path = f"{shared_dir(spark)}/ticklake-{label}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def table(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here,
    and a lost executor costs a re-read, not a recomputation."""
    spark = df.sparkSession
    path = fresh(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[str]:
    """Paths of the intermediate tables that this driver wrote and has not deleted."""
    return list(_WRITTEN)


def drop(spark: SparkSession, paths: list[str]) -> int:
    """Delete intermediate tables that nothing reads any more; how many there were."""
    gone = [p for p in paths if p in _WRITTEN]
    for p in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _WRITTEN.remove(p)
    return len(gone)


def cleanup(spark: SparkSession) -> int:
    """Delete the intermediate tables written by this driver so far; call it when
    the results that read them have been stored."""
    return drop(spark, written())


def prepare(spark: SparkSession) -> None:
    """Arrow batches bounded in rows and bytes, so that long texts cannot fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def documents(df: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (and ``more``) alone, so that other columns cannot clash."""
    prepare(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def held_out():
    """True for rows whose crc32(doc_id as text) mod 5 is 0; they are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _POWERS[base] = have
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 22) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]] (bytes; starts ascending), by prefix
    sums of a polynomial; done piecewise so that memory stays bounded."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, lo + step)))
        hi = int(ends[i:j].max())
        part = data[lo:hi].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * _powers(_BASE, len(part)), out=sums[1:])
        a, b = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[b] - sums[a]) * _powers(_INVERSE, len(part) + 1)[a] + (b - a).astype(np.uint64)
        i = j
    return mix(out)
