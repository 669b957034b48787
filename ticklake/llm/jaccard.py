"""N-gram Jaccard join: MinHash banding, then exact verification on full n-gram sets.

Texts are folded to lower-case words; equal word sequences are one class.  Classes that
share a band hash become candidates, candidates are gathered into candidate components,
and each component is verified in square tiles of bounded size by one matrix product of
n-gram indicators.  No pair is ever a row: a tile gives link counts, and a star for each group in it.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.llm.common import documents, mix, prepare, rows, span_hashes, table
from ticklake.llm.graph import connected_components

#: Members on each side of a verification tile.
TILE = 128
#: Rows that a verification group holds on average.
GROUP_ROWS = 1500


def bands_for(threshold: float, recall: float, max_hashes: int = 192) -> tuple[int, int]:
    """(bands, rows): the sharpest banding within ``max_hashes`` that a pair at the
    threshold passes with probability ``recall`` or more."""
    for r in range(16, 0, -1):
        b = int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**r))))
        if b * r <= max_hashes:
            return b, r
    raise ValueError("no banding reaches this recall")


_BLANK = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))
_KEPT: list[np.ndarray] = []


def _word_characters() -> np.ndarray:
    """Whether each code point is a letter, mark or number."""
    if not _KEPT:
        _KEPT.append(np.array([unicodedata.category(chr(i))[0] in "LMN" for i in range(0x110000)]))
    return _KEPT[0]


def folded(text: str | None) -> str:
    """Lower-case words (letters, marks, numbers) joined by one space; null gives ''."""
    low = (text or "").lower()
    if low.isascii():
        return b" ".join(low.encode().translate(_BLANK).split()).decode()
    codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
    plain = np.where(_word_characters()[codes], codes, 32).astype("<u4")
    return " ".join(plain.tobytes().decode("utf-32-le", "surrogatepass").split())


def _edges(norm: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, and start and end of each n-gram of words (all words if fewer)."""
    data = np.frombuffer(norm, np.uint8)
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])
    n = min(n, len(starts))
    return data, starts[: len(starts) - n + 1], ends[n - 1 :]


def signature(norm: str, n: int, bands: int, r: int, a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Band hashes of a folded text's n-gram set."""
    grams = np.unique(span_hashes(*_edges(norm.encode(), n)))
    least = np.full(bands * r, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(grams), 2048):
        np.minimum(least, (grams[i : i + 2048] * a[:, None] + c[:, None]).min(axis=1), out=least)
    out = np.zeros(bands, np.uint64)
    for row in least.reshape(bands, r).T:
        out = mix(out * np.uint64(31) + row)
    return out.astype(np.int64)


def _grams(norm: str, n: int) -> set[str]:
    raw = norm.encode()
    _, starts, ends = _edges(raw, n)
    return {raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)}


def _indicators(texts: list[str], n: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Sizes of the n-gram sets, and (row, column) of those that more than one text has."""
    index: dict[bytes, int] = {}
    row, col, sizes = [], [], np.zeros(len(texts))
    for i, text in enumerate(texts):
        ids = np.array([index.setdefault(g, len(index)) for g in _grams(text, n)], np.int64)
        sizes[i] = len(ids)
        row.append(np.full(len(ids), i))
        col.append(ids)
    rows_, cols = np.concatenate(row), np.concatenate(col)
    seen = np.bincount(cols, minlength=len(index))
    place = np.cumsum(seen > 1) - 1
    keep = seen[cols] > 1
    return sizes, (rows_[keep], place[cols[keep]], int((seen > 1).sum()))


def _overlaps(count: int, row: np.ndarray, col: np.ndarray, width: int, step: int = 8192) -> np.ndarray:
    """Sizes of all pairwise intersections, by blocks of columns."""
    out = np.zeros((count, count), np.float32)
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    for lo in range(0, width, step):
        a, b = np.searchsorted(col, [lo, lo + step])
        part = np.zeros((count, min(step, width - lo)), np.float32)
        part[row[a:b], col[a:b] - lo] = 1
        out += part @ part.T
    return out


def tile_links(linked: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, weights: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Weighted link counts and the connected groups of one tile.  ``linked``: symmetric
    boolean matrix over the tile's members; in a tile of two blocks only pairs across count."""
    linked = linked.copy()
    np.fill_diagonal(linked, False)
    if not same:
        linked[np.ix_(left, left)] = False
        linked[np.ix_(right, right)] = False
    counts = linked @ weights
    groups: list[list[int]] = []
    new = linked.any(axis=1)
    while new.any():
        front = [int(np.flatnonzero(new)[0])]
        new[front[0]] = False
        group = list(front)
        while front:
            reach = np.flatnonzero(linked[front.pop()] & new).tolist()
            new[reach] = False
            group += reach
            front += reach
        groups.append(group)
    return counts, groups


def tiles(members: DataFrame, sizes: DataFrame, key: str, tile: int = TILE) -> DataFrame:
    """Members (``component``, ``key``, ...) dealt to square tiles: columns ti, tj (ti <= tj)
    and ``block``.  A member of a component of m meets all others in m / tile tiles."""
    dealt = members.join(sizes, "component").withColumn("blocks", F.ceil(F.col("m") / tile).cast("int"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64(key, F.lit(11)), F.col("blocks")).cast("int"))
    return dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"ti": F.least("block", "other"), "tj": F.greatest("block", "other")}).drop("other", "blocks", "m")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999) -> DataFrame:
    """One row for each document: doc_id, class_id (smallest doc_id reachable by links),
    n_links (other documents linked directly).

    Two documents link if their word n-gram sets (``n`` words; shorter texts: one gram of
    all words) have a Jaccard similarity of ``threshold`` or more.  Null texts and texts
    without a word link with nothing and are their own class.  Rows that repeat a doc_id
    are separate documents; a null doc_id is never the smallest where another is there; a
    similarity that equals the threshold links; very long texts are signed and verified
    whole; other columns are not read; an empty table gives no rows."""
    signed, members = _members(docs, threshold, n, recall)
    heads = table(members.groupBy("component").agg(F.min("least").alias("class_id")), "heads")
    labels = table(members.join(heads, "component").select("key", "class_id", (F.coalesce("w", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "labels")
    return signed.select("doc_id", "key").join(labels, "key", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def firsts(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999) -> DataFrame:
    """(first_id, first_hash): of each group of near-duplicates the row with the smallest
    doc_id (null last) and then sha-256 of its text; documents without a word are in no group."""
    signed, members = _members(docs, threshold, n, recall)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    least = signed.where("key is not null").groupBy("key").agg(F.min(place).alias("first"))
    first = least.join(members.select("key", "component"), "key").groupBy("component").agg(F.min("first").alias("first"))
    return first.select(F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"))


def _members(docs: DataFrame, threshold: float, n: int, recall: float) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, bands, text_hash, norm), and classes (key, least, copies, component,
    w).  The key of a class is a hash of its folded text, null without a word."""
    spark = docs.sparkSession
    bands, r = bands_for(threshold, recall)
    seeds = np.random.default_rng(3).integers(1, 1 << 63, (2, bands * r), dtype=np.uint64)
    a, c = seeds[0] | np.uint64(1), seeds[1]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done: dict[bytes, np.ndarray] = {}
            keys, out, hashes, norms = [], [], [], []
            for text in batch.column(1).to_pylist():
                norm = folded(text)
                key = hashlib.md5(norm.encode("utf-8", "surrogatepass")).digest() if norm else None
                if norm and key not in done:
                    done[key] = signature(norm, n, bands, r, a, c)
                keys.append(key)
                out.append(done[key] if norm else None)
                hashes.append(None if text is None else hashlib.sha256(text.encode()).digest())
                norms.append(norm)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(out, pa.list_(pa.int64())), pa.array(hashes, pa.binary()), pa.array(norms, pa.string())], names=["doc_id", "key", "bands", "text_hash", "norm"])

    signed = table(documents(docs).mapInArrow(sign, "doc_id long, key binary, bands array<long>, text_hash binary, norm string"), "signed")
    classes = table(signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "classes")

    # candidates: every class of a band bucket with the smallest one there
    banded = classes.select("key", F.posexplode("bands").alias("band", "hash"))
    shared = table(banded.groupBy("band", "hash").agg(F.min("key").alias("head"), F.count("*").alias("m")).where("m > 1").drop("m"), "shared")
    stars = banded.join(shared, ["band", "hash"]).where("key <> head").select(F.col("key").alias("a"), F.col("head").alias("b")).distinct()
    candidates = connected_components(stars).withColumnRenamed("node", "key")
    sizes = table(candidates.groupBy("component").agg(F.count("*").alias("m")), "sizes")

    # the texts of candidate classes, one row for each class
    wanted = candidates.join(classes.select("key", "least", "copies"), "key")
    texts = signed.select("doc_id", "key", "norm").join(wanted, "key").where("doc_id <=> least").dropDuplicates(["key"])
    dealt = table(tiles(texts.select("key", "component", "copies", "norm"), sizes, "key"), "tiles")
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), dealt.count() // GROUP_ROWS + 1)
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("component", "ti", "tj"), F.lit(groups)))

    def verify(group: pa.Table) -> pa.Table:
        out_a, out_b, out_w = [], [], []
        frame = group.select(["component", "ti", "tj", "block", "key", "copies", "norm"]).to_pylist()
        by: dict[tuple, list[dict]] = {}
        for x in frame:
            by.setdefault((x["component"], x["ti"], x["tj"]), []).append(x)
        for (_, i, j), own in by.items():
            size, (row, col, width) = _indicators([x["norm"] for x in own], n)
            inter = _overlaps(len(own), row, col, width)
            linked = inter / (size[:, None] + size[None, :] - inter) >= threshold
            block = np.array([x["block"] for x in own])
            counts, groups = tile_links(linked, np.flatnonzero(block == i), np.flatnonzero(block == j), i == j, np.array([x["copies"] for x in own], np.int64))
            for x, w in zip(own, counts.tolist(), strict=True):
                if w:
                    out_a.append(x["key"])
                    out_b.append(None)
                    out_w.append(w)
            for members in groups:
                head, *rest = sorted(own[u]["key"] for u in members)
                out_a += rest
                out_b += [head] * len(rest)
                out_w += [0] * len(rest)
        return pa.table({"a": pa.array(out_a, pa.binary()), "b": pa.array(out_b, pa.binary()), "w": pa.array(out_w, pa.int64())})

    prepare(spark)
    found = table(dealt.groupBy("group").applyInArrow(verify, "a binary, b binary, w long"), "links")
    linked = connected_components(found.where("b is not null")).withColumnRenamed("node", "key")
    counts = found.where("b is null").groupBy(F.col("a").alias("key")).agg(F.sum("w").alias("w"))
    members = classes.select("key", "least", "copies").join(linked, "key", "left").join(counts, "key", "left").withColumn("component", F.coalesce("component", "key"))
    return signed, table(members, "members")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its class and its number of links."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
