"""Removal of long repeated byte strings with a run-length compressed index.

Every window of ``length`` bytes belongs to the least of its k-gram hashes (its anchor),
so equal windows share an anchor hash.  Windows of anchors that occur twice are cut out as
contexts; equal contexts are one row with a count; the contexts of an anchor meet in one
shard.  A shard's run-length Burrows-Wheeler index keeps, at both ends of each run, the
text position and its longest match with the suffix beside it; between such samples the
longest match shrinks by one each byte, so one pass over the text streams the matching
statistics of every position against all others.  Windows with a statistic of ``length``
or more, and all windows of contexts that occur twice, are repeats.

Anchors with very many distinct contexts are cut again by the bytes common to a range of
window offsets, down to single windows, so that no shard grows with the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklake.llm.common import documents, mix, prepare, rows, table

LENGTH, GRAM = 400, 100
#: Distinct contexts of a key above which it is cut finer, and the widths of the cuts.
HOT, WIDTHS = 200, (24, 1)
_STEP = 1 << 22
_SEPARATOR = b"\xff"  # never a byte of UTF-8


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    from ticklake.llm.common import _BASE, _INVERSE, _powers

    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _powers(_INVERSE, len(data) + 1)[: len(data) - k + 1])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first window, last window): each window's anchor is the leftmost
    least gram hash in it; neighbouring windows with one anchor are one row."""
    found = []
    for base in range(0, max(1, len(data) - length + 1), _STEP):
        part = data[base : base + _STEP + length - 1]
        if len(part) < length:
            break
        h = _gram_hashes(part, gram)
        # 38 bits of hash above 26 of position: the least is the leftmost of the smallest
        key = (h >> np.uint64(26) << np.uint64(26)) | np.arange(len(h), dtype=np.uint64)
        span = length - gram + 1
        n = len(part) - length + 1
        blocks = -(-len(key) // span)
        padded = np.full(blocks * span, np.iinfo(np.uint64).max, np.uint64)
        padded[: len(key)] = key
        grid = padded.reshape(blocks, span)
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        before = np.minimum.accumulate(grid, axis=1).ravel()
        at = (np.minimum(after[:n], before[span - 1 : span - 1 + n]) & np.uint64((1 << 26) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1])
        last = np.concatenate([first[1:] - 1, [n - 1]])
        found.append((h[at[first]], at[first] + base, first + base, last + base))
    if not found:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array, by doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n]
    order = np.argsort(key)
    slots, keys, rank, done = np.arange(n), key[order], np.empty(n, np.int64), 8
    subset = order
    while True:
        head = np.concatenate([[True], keys[1:] != keys[:-1]])
        first = np.maximum.accumulate(np.where(head, slots, 0))
        rank[subset] = first
        tied = ~(head & np.concatenate([head[1:], [True]]))
        if not tied.any():
            return order
        slots, subset = slots[tied], subset[tied]
        ahead = subset + done
        later = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        keys = rank[subset] * (n + 2) + later
        by = np.argsort(keys)
        keys, subset = keys[by], subset[by]
        order[slots] = subset
        done *= 2


def _match(text: np.ndarray, a: np.ndarray, b: np.ndarray, least: int, rows_at_once: int = 8192) -> np.ndarray:
    """Bytes that the suffixes at a and b share; 0 where they are fewer than ``least``."""
    n, out = len(text), np.zeros(len(a), np.int64)
    fits = np.maximum(a, b) + least <= n
    for at in range(0, least, 37):  # most pairs differ at one of a few bytes
        fits[fits] = text[a[fits] + at] == text[b[fits] + at]
    kept = np.flatnonzero(fits)
    for lo in range(0, len(kept), rows_at_once):
        live = kept[lo : lo + rows_at_once]
        while len(live):
            look = np.arange(64)
            i, j = (a[live] + out[live])[:, None] + look, (b[live] + out[live])[:, None] + look
            differ = text[np.minimum(i, n - 1)] != text[np.minimum(j, n - 1)]
            differ |= np.maximum(i, j) >= n
            stop = differ.any(axis=1)
            out[live] += np.where(stop, differ.argmax(axis=1), 64)
            live = live[~stop]
    out[out < least] = 0
    return out


class RunIndex:
    """The run-length Burrows-Wheeler index of a text with sampled run ends."""

    def __init__(self, text: np.ndarray, least: int = LENGTH):
        self.n = len(text)
        order = suffix_order(text)
        bwt = np.where(order == 0, -1, text[order - 1].astype(np.int16))  # nothing stands before the text
        heads = np.concatenate([[0], np.flatnonzero(bwt[1:] != bwt[:-1]) + 1])
        self.run_bytes, self.run_lengths = bwt[heads], np.diff(np.concatenate([heads, [self.n]]))
        inner = heads[1:]
        # the suffix at a run's start against the one above it, and at a run's end against the one below
        common = _match(text, order[inner], order[inner - 1], least)
        self.up_at, self.up = np.concatenate([[order[0]], order[inner]]), np.concatenate([[0], common])
        self.down_at, self.down = np.concatenate([order[inner - 1], [order[-1]]]), np.concatenate([common, [0]])

    def _stream(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        order = np.argsort(at, kind="stable")
        at, value = at[order], value[order]
        last = np.searchsorted(at, np.arange(self.n), side="right") - 1
        return value[last] - (np.arange(self.n) - at[last])

    def matching_statistics(self) -> np.ndarray:
        """For each position the longest match with the suffix of another position;
        where that is shorter than ``least``, any number below it."""
        return np.maximum(self._stream(self.up_at, self.up), self._stream(self.down_at, self.down))


def repeated_windows(contexts: list[bytes], counts: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each distinct context, whether each of its windows occurs elsewhere."""
    edges = np.concatenate([[0], np.cumsum([len(c) + 1 for c in contexts])])
    text = np.frombuffer(b"".join(c + _SEPARATOR for c in contexts), np.uint8)
    single = [i for i, n in enumerate(counts) if n < 2]
    stats = RunIndex(text, length).matching_statistics() if single else np.zeros(len(text), np.int64)
    out = []
    for i, c in enumerate(contexts):
        n = len(c) - length + 1
        out.append(np.ones(n, bool) if counts[i] > 1 else stats[edges[i] : edges[i] + n] >= length)
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edge[::2], edge[1::2] - 1


_MARKS = "key binary, ck binary, first array<int>, last array<int>"


def _mark(contexts: DataFrame, widths: tuple[int, ...], length: int, hot: int) -> DataFrame:
    """Contexts (owner, at, key, ctx, off, n): window w of ``ctx`` is window at + w of
    ``owner``, at offset off - w before its anchor, and stands for n occurrences.
    Gives (owner, runs): runs (first, last) of repeated windows of the owner, a row for
    each context that has any."""
    spark = contexts.sparkSession
    contexts = table(contexts.withColumn("ck", F.unhex(F.md5("ctx"))), "contexts")
    distinct = table(contexts.groupBy("key", "ck").agg(F.sum("n").alias("n"), F.first("ctx").alias("ctx"), F.first("off").alias("off")), "distinct")
    sizes = table(distinct.groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("seen")), "sizes")
    cold = distinct.join(sizes.where((F.col("m") <= hot) & (F.col("seen") > 1)).select("key"), "key")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; shards are cut between keys."""
        held: list[tuple] = []
        size = 0

        def shard() -> pa.RecordBatch:
            nonlocal held, size
            marks = repeated_windows([x[3] for x in held], [x[2] for x in held], length)
            spans = [_runs(m) for m in marks]
            keep = [i for i, (a, _) in enumerate(spans) if len(a)]
            out = pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in keep], pa.binary()), pa.array([held[i][1] for i in keep], pa.binary()), pa.array([spans[i][0] for i in keep], pa.list_(pa.int32())), pa.array([spans[i][1] for i in keep], pa.list_(pa.int32()))], names=["key", "ck", "first", "last"])
            held, size = [], 0
            return out

        for batch in batches:
            for row in rows(batch, "key", "ck", "n", "ctx"):
                if size > 400_000 and row[0] != held[-1][0]:
                    yield shard()
                held.append(row)
                size += len(row[3])
        if held:
            yield shard()

    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    marked = cold.select("key", "ck", "n", "ctx").repartition(parts, "key").sortWithinPartitions("key", "ck").mapInArrow(index, _MARKS)
    if widths:
        heavy = table(distinct.join(sizes.where(F.col("m") > hot).select("key"), "key"), "heavy")
        if not heavy.isEmpty():
            width = widths[0]

            def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    out = []
                    for key, ck, n, ctx, off in rows(batch, "key", "ck", "n", "ctx", "off"):
                        windows, at = len(ctx) - length + 1, 0
                        while at < windows:
                            # windows at one range of offsets before the anchor share these bytes
                            cell = (off - at) // width
                            end = min(windows, off - cell * width + 1)
                            low, high = off - cell * width - width + 1, off - cell * width
                            out.append((key + ck, at, hashlib.md5(key + cell.to_bytes(4, "little") + ctx[high : low + length]).digest(), ctx[at : end + length - 1], off - at, n))
                            at = end
                    columns = list(zip(*out, strict=True)) if out else [()] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int64()], strict=True)], names=["owner", "at", "key", "ctx", "off", "n"])

            finer = _mark(heavy.mapInArrow(split, "owner binary, at int, key binary, ctx binary, off int, n long"), widths[1:], length, hot if widths[1:] else 1 << 30)
            whole = _by_owner(finer).withColumn("x", _merged(F.col("runs")))
            again = whole.select(F.expr("substring(owner, 1, length(owner) - 16)").alias("key"), F.expr("substring(owner, length(owner) - 15, 16)").alias("ck"), F.col("x.first").alias("first"), F.col("x.last").alias("last"))
            marked = marked.unionByName(again)
    marked = table(marked, "marked")
    back = contexts.select("owner", "at", "key", "ck").join(marked, ["key", "ck"])
    shifted = F.transform(F.arrays_zip("first", "last"), lambda x: F.struct((F.col("at") + x["first"]).alias("first"), (F.col("at") + x["last"]).alias("last")))
    return back.select("owner", shifted.alias("runs"))


def _by_owner(marks: DataFrame) -> DataFrame:
    """All runs of an owner in one sorted array; an owner is one context or one document."""
    return marks.groupBy("owner").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"))


def _merged(runs: Column) -> Column:
    """Sorted runs with those that touch joined."""

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"))
        joined = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))
        return F.when(F.coalesce(last["last"] + 1 >= x["first"], F.lit(False)), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(runs, F.array().cast("array<struct<first:int,last:int>>"), add)


def _fields(text: str) -> list[T.StructField]:
    return T.StructType.fromDDL(text).fields


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, more: tuple[str, ...] = ()) -> DataFrame:
    """One row for each document: doc_id, n_bytes, spans (array of struct(start, end):
    maximal removed runs of bytes), kept (remaining bytes, binary), kept_text (the same
    without characters that a cut splits; null for a null text), row_id and ``rest`` (the
    document's columns ``more`` as they are).

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else,
    in this or another document, judged on the input.  Null and empty texts have no
    bytes; rows that repeat a doc_id are separate documents (so exact copies of
    ``length`` bytes or more go whole); very long texts are read in pieces of 4 MB by the
    anchors and whole otherwise; no result depends on the order of rows or on ties; other
    columns of ``docs``, whatever their names, are not read; an empty table gives no rows."""
    rest = F.struct(*more) if more else F.lit(None).cast("boolean")
    source = documents(docs, rest.alias("rest")).withColumns({"row_id": F.monotonically_increasing_id(), "tkey": F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(np.frombuffer((text or "").encode(), np.uint8), length, gram) for (text,) in rows(batch, "text")]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
            columns = [pa.array([x[i].astype(np.int64) for x in found], pa.list_(pa.int64())).cast(pa.list_(k)) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "hash", "pos", "first", "last"])

    schema = T.StructType([*source.schema.fields, *_fields("hash array<long>, pos array<int>, first array<int>, last array<int>")])
    scanned = table(source.mapInArrow(scan, schema), "scanned")
    # equal texts are looked at once: one row of them stands for all
    classes = table(scanned.groupBy("tkey").agg(F.min("row_id").alias("row_id"), F.count("*").alias("copies"), F.first("hash").alias("hash")), "classes")
    each = classes.select("row_id", "copies", F.posexplode("hash").alias("i", "hash"))
    twice = table(each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash"), "twice")
    hits = each.join(twice, "hash").groupBy("row_id").agg(F.first("copies").alias("copies"), F.collect_list("i").alias("hits"))
    held = scanned.select("row_id", "text", "hash", "pos", "first", "last").join(hits, "row_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for row_id, text, hashes, pos, first, last, copies, hit in rows(batch, "row_id", "text", "hash", "pos", "first", "last", "copies", "hits"):
                data = text.encode()
                for i in hit:
                    out.append((row_id, first[i], hashes[i].to_bytes(8, "little", signed=True), data[first[i] : last[i] + length], pos[i] - first[i], copies))
                    size += last[i] + length - first[i]
                    if size > 8 << 20:
                        yield _batch(out, kinds)
                        out, size = [], 0
            yield _batch(out, kinds)

    contexts = held.mapInArrow(cut, "owner long, at int, key binary, ctx binary, off int, n long")
    spans = _by_owner(_mark(contexts, WIDTHS, length, hot)).withColumnRenamed("owner", "row_id")
    changes = table(classes.select("row_id", "tkey", "copies").join(spans, "row_id", "left").where("copies > 1 or runs is not null").drop("row_id"), "spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, copies, runs in rows(batch, "text", "copies", "runs"):
                raw = (text or "").encode()
                if not runs and not (copies and copies > 1 and len(raw) >= length):
                    out.append((len(raw), [], raw, text))
                    continue
                data = np.frombuffer(raw, np.uint8)
                gone = np.zeros(len(data) + 1, np.int32)
                for run in runs or ():
                    gone[run["first"]] += 1
                    gone[run["last"] + length] -= 1
                mask = np.cumsum(gone[:-1]) > 0
                if copies > 1:
                    mask[:] = True
                a, b = _runs(mask)
                kept = data[~mask].tobytes()
                out.append((len(data), [{"start": x, "end": y + 1} for x, y in zip(a.tolist(), b.tolist(), strict=True)], kept, kept.decode("utf-8", "ignore")))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            kinds = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary(), pa.string()]
            given = {n: batch.column(batch.schema.get_field_index(n)) for n in ("row_id", "doc_id", "rest")}
            yield pa.RecordBatch.from_arrays([*given.values(), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*given, "n_bytes", "spans", "kept", "kept_text"])

    whole = scanned.select("row_id", "doc_id", "rest", "text", "tkey").join(changes, "tkey", "left").drop("tkey")
    result = T.StructType([whole.schema[n] for n in ("row_id", "doc_id", "rest")] + _fields("n_bytes long, spans array<struct<start:long,end:long>>, kept binary, kept_text string"))
    return whole.mapInArrow(strip, result)


def _batch(out: list[tuple], kinds: list) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) if out else [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["owner", "at", "key", "ctx", "off", "n"])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the remaining text."""
    got = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = (F.col("n_bytes") - F.length("kept")).cast("long")
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.coalesce("kept_text", F.lit("")).alias("text"))
