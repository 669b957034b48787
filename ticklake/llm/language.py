"""Language identification by nearest centroid.

A text is a normalised TF-IDF vector of hashed byte pairs and triples of its lower-case
letters; a language is a few clustered centroids; the nearest by cosine wins, and a text
further from it than the language's own texts are is marked rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.llm.common import documents, held_out

BINS = 2048
#: Documents of all languages that the centroids are fitted on, about; centroids a language.
SAMPLE, CENTROIDS = 6000, 4
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(b if b >= 128 or 97 <= b < 123 else 32 for b in range(256))


def term_counts(text: str, step: int = 1 << 20) -> np.ndarray:
    """Counts of hashed byte pairs and triples of a whole text, by pieces."""
    data = np.frombuffer(b" " + text.lower().encode().translate(_FOLD) + b" ", np.uint8)
    out = np.zeros(BINS)
    for lo in range(0, len(data), step):
        x = data[lo : lo + step + 2].astype(np.uint32)
        two = x[:-1] << 8 | x[1:]
        three = two[:-1] << 8 | x[2:]
        for codes in (two[:step], three[:step]):
            codes = codes[(codes & 0xFFFF) != 0x2020]
            out += np.bincount((codes * np.uint32(2654435761)) >> np.uint32(21), minlength=BINS)
    return out


class Model:
    def __init__(self, idf: np.ndarray):
        self.idf = idf
        self.langs: list[str] = []
        self.centroids = np.zeros((0, BINS))
        self.owner = np.zeros(0, int)
        self.floor = np.zeros(0)

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)

    def learn(self, lang: str, x: np.ndarray, rounds: int = 8) -> None:
        """Spherical k-means of one language's vectors, started from spread rows."""
        at = np.linspace(0, len(x) - 1, min(CENTROIDS, len(x))).astype(int)
        c = x[at]
        for _ in range(rounds):
            near = (x @ c.T).argmax(axis=1)
            c = np.array([x[near == k].sum(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        self.owner = np.concatenate([self.owner, np.full(len(c), len(self.langs))])
        self.centroids = np.vstack([self.centroids, c])
        self.langs.append(lang)
        self.floor = np.append(self.floor, np.quantile((x @ c.T).max(axis=1), 0.01) - 0.05)

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sims = self.vectors(counts) @ self.centroids.T
        best = np.stack([sims[:, self.owner == k].max(axis=1) for k in range(len(self.langs))], axis=1)
        e = np.exp(30 * (best - best.max(axis=1, keepdims=True)))
        top = best.argmax(axis=1)
        return top, (e / e.sum(axis=1, keepdims=True))[np.arange(len(top)), top], best[np.arange(len(top)), top] < self.floor[top]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Document frequencies over all documents with a language that are not held out;
    centroids on about ``sample`` of them, an even share for each language, drawn by a
    hash of doc_id and text.  None where there is nothing to learn from."""
    known = documents(docs, F.col("lang").cast("string").alias("lang")).where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(BINS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen += term_counts(text) > 0
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS + 1, dtype=np.int32)), pa.array(np.append(seen, n))], names=["bin", "n"])

    got = known.select("text").mapInArrow(frequencies, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()
    df, n = np.array([r.n for r in got[:BINS]]), got[BINS].n
    model = Model(np.log((1 + n) / (1 + df)) + 0.1)

    share = max(20, sample // len(sizes))
    # 62 bits of a hash, so that the share is right for any number of documents
    limit = F.create_map(*[x for lang, m in sizes.items() for x in (F.lit(lang), F.lit((min(share, m) << 62) // m))])
    drawn = known.where(F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 2) < limit[F.col("lang")])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = model.vectors(np.array([term_counts(t) for t in batch.column(1).to_pylist()])).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["lang", "x"])

    by: dict[str, list[bytes]] = {}
    for r in drawn.select("lang", "text").mapInArrow(vectors, "lang string, x binary").collect():
        by.setdefault(r.lang, []).append(bytes(r.x))
    for lang in sorted(by):
        model.learn(lang, np.array([np.frombuffer(x, np.float16) for x in sorted(by[lang])]).astype(np.float64))
    return model if by else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score (0 to 1), rejected.
    ``und`` with score 0 if the text is null or has no letter, or nothing was learned; of
    languages that are equally near the first by name wins; rows that repeat a doc_id are
    judged each; very long texts are counted by pieces; other columns are not read; an empty
    table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            lang, score, rejected = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            at = [i for i, t in enumerate(texts) if model and t and _LETTER.search(t)]
            for lo in range(0, len(at), 500):
                part = at[lo : lo + 500]
                top, s, r = model.predict(np.array([term_counts(texts[i]) for i in part]))
                score[part], rejected[part] = s, r
                for i, k in zip(part, top, strict=True):
                    lang[i] = model.langs[k]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lang), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return documents(docs).select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, learned from its other rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
