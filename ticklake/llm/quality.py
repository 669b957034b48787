"""Quality classifier: random Fourier features of document statistics, ridge scores from
partition-summed normal equations, isotonic calibration.

Statistics of whole texts are computed once and stored; fitting and scoring read those
few numbers a document.  What reaches the driver is sums whose size depends on the number
of features only.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.llm.common import documents, held_out, table

STATISTICS = 24
#: Random features, ridge weight, and most partial sums that reach the driver.
FEATURES, RIDGE, SUMS = 256, 1e-3, 32
_SCORED = "doc_id long, held_out boolean, score double, predicted int"
_SYMBOLS = b"#*$%&|<>"
_CLASS = np.zeros(256, np.uint8)  # of a byte: 1 letter, 2 capital, 3 digit, 4 white space, 5 symbol, 6 ! or ?, 7 other mark
_CLASS[[*range(97, 123), *range(128, 256)]] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[list(_SYMBOLS)] = 5
_CLASS[[33, 63]] = 6
_CLASS[[b for b in range(33, 127) if _CLASS[b] == 0]] = 7


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text; all zero for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * STATISTICS
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    n, m = len(data), len(words)
    share = np.bincount(_CLASS[data], minlength=8) / n
    upper = sum(text.count(c) for c in "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ")
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    often = np.bincount(ids)
    lengths = np.array(list(map(len, words)), np.float64)
    pairs = len(np.unique(ids[:-1] * len(index) + ids[1:])) / max(1, m - 1)
    lines = [x for x in text.split("\n") if x.strip()]
    seen = np.bincount(data, minlength=256)
    seen = seen[seen > 0] / n
    letters = max(share[1] + share[2], 1e-9)
    return [
        np.log1p(n), np.log1p(m), lengths.mean(), lengths.std(), (share[2] + upper / n) / letters, share[3], share[4], share[5] * 10, share[6] * 10, share[7] * 10,
        len(index) / m, often.max() / m, pairs, float((ids[1:] == ids[:-1]).mean()) if m > 1 else 0.0, np.log1p(len(lines)), np.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)), sum(x.rstrip()[-1] in ".!?…" for x in lines) / max(1, len(lines)), float((lengths <= 2).mean()), float((lengths >= 12).mean()),
        float(-(seen * np.log2(seen)).sum()), len(zlib.compress(raw, 1)) / (n + 20), text.count("||") / m, sum(w.isupper() for w in words) / m,
    ]


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, held_out and the statistics ``x`` of every whole text (null: empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "held_out", "x"])

    return table(documents(docs).select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, x array<double>"), "statistics")


class Model:
    """Random features of standardised statistics, ridge weights and a calibration curve."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.spread = rng.standard_normal((STATISTICS, FEATURES)) / np.sqrt(STATISTICS) * 0.7
        self.phase = rng.uniform(0, 2 * np.pi, FEATURES)
        self.weights: np.ndarray | None = None
        self.curve = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ self.spread + self.phase), z / 10, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; a thousandth of the raw score orders what calibration ties."""
        raw = self.raw(x)
        return 0.999 * np.interp(raw, *self.curve) + 0.001 / (1 + np.exp(-4 * np.clip(raw - 0.5, -5, 5)))


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over points sorted by x: centres and means of the pools."""
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x, y, w, strict=True):
        pools.append([wi * xi, wi * yi, wi])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def fit(described: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on the labelled rows that are not held out: a quarter of them calibrates.
    A document with several labels counts with their mean; None without labels."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).where("y is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("y").alias("y"))
    joined = described.where("not held_out").join(y, "doc_id").select("x", "y", (F.crc32(F.col("doc_id").cast("string")) % 5 == 1).alias("calibrates"))
    train = table(joined, "labelled")
    total = train.select("y", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    if not total:
        return None
    model = Model(np.array([r.m for r in total]), np.array([max(r.s, 1e-6) for r in total]))
    rest = F.lit(True) if total[0].n < 20 else ~F.col("calibrates")  # a handful of labels serves for both
    held = F.lit(True) if total[0].n < 20 else F.col("calibrates")

    size = FEATURES + STATISTICS + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                z = model.features(np.array(batch.column(0).to_pylist(), np.float64))
                gram += z.T @ z
                right += z.T @ np.array(batch.column(1).to_pylist(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["gram", "right"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros(size * size), np.zeros(size)
        for batch in batches:
            for g, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                gram += np.frombuffer(g)
                right += np.frombuffer(r)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([right.tobytes()], pa.binary())], names=["gram", "right"])

    # each partition gives one sum; these are summed again, so that few reach the driver
    got = train.where(rest).select("x", "y").mapInArrow(sums, "gram binary, right binary").repartition(SUMS).mapInArrow(together, "gram binary, right binary").toLocalIterator()
    gram, right = np.zeros((FEATURES + STATISTICS + 1,) * 2), np.zeros(FEATURES + STATISTICS + 1)
    for r in got:
        gram += np.frombuffer(r.gram).reshape(gram.shape)
        right += np.frombuffer(r.right)
    model.weights = np.linalg.solve(gram + RIDGE * max(1.0, gram[-1, -1]) / FEATURES * np.eye(len(gram)), right)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                raw = np.clip(model.raw(np.array(batch.column(0).to_pylist(), np.float64)), -1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.round(raw * 500).astype(np.int32)), batch.column(1)], names=["bin", "y"])

    # at most 1501 bins, whatever the number of rows
    points = train.where(held).select("x", "y").mapInArrow(bins, "bin int, y double").groupBy("bin").agg(F.avg("y").alias("y"), F.count("*").alias("w")).orderBy("bin").collect()
    if points:
        model.curve = isotonic(np.array([p.bin / 500 for p in points]), np.array([p.y for p in points]), np.array([p.w for p in points], float))
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row for each document: doc_id, held_out, score (0 to 1), predicted (1 if score
    >= ``threshold``).  Null texts are scored as empty ones; without any label every score
    is 0.5; a document of several labels counts with their mean; equal texts score alike;
    rows that repeat a doc_id are scored each; very long texts are read whole, one at a time;
    other columns are not read; an empty table gives no rows."""
    described = describe(docs)
    model = fit(described, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(2).to_pylist(), np.float64).reshape(batch.num_rows, STATISTICS)
            score = np.clip(model.score(x), 0, 1) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return described.mapInArrow(run, _SCORED)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, scored by a model of its labelled rows."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
