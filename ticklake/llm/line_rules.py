"""Quality rules by line labelling: a linear-chain conditional random field marks each
line content or boilerplate, Viterbi decoding gives the best sequence, and the share of
content decides whether the document stays; counted base rules come first.

No line is labelled by hand.  Lines of an unmistakable shape (menus, notices, shouting,
symbols, repetition) are boilerplate wherever they stand; the other lines of a good document
are content; those of a bad one are latent, and only their document's label constrains them:
half of its characters or more are boilerplate.  Fitting alternates between decoding the
latent lines under that constraint and ascending the likelihood of all lines.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklake.llm.common import documents, held_out

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = "#*$%&|<>"
FEATURES = 13
#: Labelled documents that the field is fitted on, at most about, and lines of each, from its first on.
SAMPLE, LINES = 3000, 40
#: Words of notices.
_NOTICE = frozenset("license licensed licence copyright rights reserved terms privacy policy cookie cookies subscribe newsletter login advertisement sponsored click menu sitemap".split())
#: Least share of characters in content lines.
SHARE = 0.5
CONTENT, BOILERPLATE = 0, 1


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = _WORD.findall(text)
    index: dict[str, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
    repeated = 0
    if len(ids) > 2:
        # three-word windows by number: pairs are numbered anew, so that products stay small
        _, pair = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)
        _, at, times = np.unique(pair[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
        edge = np.zeros(len(ids) + 1, np.int64)
        twice = np.flatnonzero(times[at] > 1)
        edge[twice] += 1
        edge[twice + 3] -= 1
        repeated = int((np.cumsum(edge) > 0).sum())
    seen: set[str] = set()
    doubled = 0
    for line in text.split("\n"):
        if line in seen:
            doubled += bool(_WORD.search(line))
        else:
            seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, _SYMBOLS)), doubled, repeated


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and length of each line that has a word."""
    out, sizes, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        n, m = len(line), len(words)
        upper = sum(map(str.isupper, words)) / m
        symbols = sum(map(line.count, _SYMBOLS)) / n
        shout = line.count("!") / m
        notice = sum(w.strip(".,:;!()").lower() in _NOTICE for w in words) if m < 60 else 0
        stutter = sum(map(str.__eq__, words, words[1:])) / m
        out.append((1.0, min(m, 60) / 60, n / m / 10, upper, min(1.0, symbols * 10), min(2.0, shout), len(set(words)) / m, line in seen, words[-1][-1] in ".!?…\"»)", line.count("|") / m, min(1.0, 4 * notice / m), m < 4, stutter))
        sizes.append(n)
        seen.add(line)
    return np.array(out, np.float64).reshape(len(out), FEATURES), np.array(sizes, np.float64)


def seeds(x: np.ndarray) -> np.ndarray:
    """Lines that are boilerplate by their shape alone."""
    words, upper, symbols, shout, distinct, again, pipes, notice, stutter = (x[:, i] for i in (1, 3, 4, 5, 6, 7, 9, 10, 12))
    several = words > 4 / 60
    return (again > 0) & several | (pipes >= 0.3) | (notice >= 0.75) | several & ((upper >= 0.8) | (symbols >= 0.5) | (shout >= 0.5) | (stutter >= 0.4)) | (words > 15 / 60) & (distinct < 0.35)


class Field:
    """Weights of the linear-chain field: ``emit`` (features, labels) and ``move`` (label, next label)."""

    #: A prior that serves where nothing can be learned: marks, capitals, notices and repetition speak for boilerplate.
    PRIOR = (-3.0, -1.0, 0.0, 3.0, 4.0, 2.0, -1.0, 2.0, -1.0, 3.0, 4.0, 0.0, 3.0)

    def __init__(self) -> None:
        self.emit = np.zeros((FEATURES, 2))
        self.emit[:, BOILERPLATE] = self.PRIOR
        self.move = np.array([[0.5, -0.5], [-0.5, 0.5]])

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray, int]], turns: int = 2) -> "Field":
        """From documents (features, sizes, label): turns of latent labels and ascent.  The
        prior stands where there are no lines, or where all would have one label."""
        docs = [d for d in docs if len(d[0])]
        for _ in range(turns):
            gold = [self.latent(*d) for d in docs]
            if len(np.unique(np.concatenate(gold))) < 2 if docs else True:
                return self
            self._ascend([d[0] for d in docs], gold)
        return self

    def latent(self, x: np.ndarray, sizes: np.ndarray, label: int) -> np.ndarray:
        """Labels of the lines of a document that is content or boilerplate as a whole: seeds
        are boilerplate; the rest of a good document is content; of a bad one they are the
        best sequence in which boilerplate has half of the characters, by the least bonus to
        boilerplate that gives one."""
        fixed = seeds(x)
        if label == CONTENT:
            return np.where(fixed, BOILERPLATE, CONTENT)
        score = x @ self.emit
        score[fixed, BOILERPLATE] += 1e6
        for bonus in (0, 0.5, 1, 2, 4, 8, 16, 1e6):
            got = self._viterbi(score + [0, bonus])
            if sizes[got == BOILERPLATE].sum() >= 0.5 * sizes.sum():
                break
        return got

    @staticmethod
    def pack(x: list[np.ndarray], gold: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Groups of sequences of like lengths, padded: features, mask, labels."""
        order = sorted(range(len(x)), key=lambda i: len(x[i]))
        out = []
        for at in range(0, len(order), 400):
            own = order[at : at + 400]
            wide = len(x[own[-1]])
            f, mask, y = np.zeros((len(own), wide, FEATURES)), np.zeros((len(own), wide), bool), np.zeros((len(own), wide), int)
            for r, i in enumerate(own):
                f[r, : len(x[i])], mask[r, : len(x[i])], y[r, : len(x[i])] = x[i], True, gold[i]
            out.append((f, mask, y))
        return out

    def _ascend(self, x: list[np.ndarray], gold: list[np.ndarray], rounds: int = 120, rate: float = 0.3, decay: tuple[float, float] = (1e-5, 3e-3)) -> None:
        """Adam steps on the mean log likelihood of a line.  The moves are held back more than
        the emissions, as a line's own shape should outweigh its neighbours."""
        packed = self.pack(x, gold)
        lines = sum(len(g) for g in gold)
        sizes, momentum = [np.zeros_like(self.emit), np.zeros_like(self.move)], [np.zeros_like(self.emit), np.zeros_like(self.move)]
        for step in range(1, rounds + 1):
            grads = [-decay[0] * self.emit, -decay[1] * self.move]
            for group in packed:
                _, e, m = self.likelihood(*group)
                grads[0] = grads[0] + e / lines
                grads[1] = grads[1] + m / lines
            for k, w in enumerate((self.emit, self.move)):
                momentum[k] = 0.9 * momentum[k] + 0.1 * grads[k]
                sizes[k] = 0.99 * sizes[k] + 0.01 * grads[k] ** 2
                w += rate * (momentum[k] / (1 - 0.9**step)) / (np.sqrt(sizes[k] / (1 - 0.99**step)) + 1e-6)

    def likelihood(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Log likelihood of the labels, and its gradients (observed less expected counts, by
        the forward-backward recursion)."""
        score = x @ self.emit
        n, t, _ = score.shape
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = score[:, 0]
        for i in range(1, t):
            on = mask[:, i, None]
            alpha[:, i] = np.where(on, np.logaddexp.reduce(alpha[:, i - 1, :, None] + self.move, axis=1) + score[:, i], alpha[:, i - 1])
        for i in range(t - 2, -1, -1):
            on = mask[:, i + 1, None]
            beta[:, i] = np.where(on, np.logaddexp.reduce(self.move + (beta[:, i + 1] + score[:, i + 1])[:, None, :], axis=2), 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        single = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        gold = np.eye(2)[y] * mask[:, :, None]
        emit = np.einsum("ntf,ntk->fk", x, gold - single)
        move = np.zeros((2, 2))
        for i in range(t - 1):
            on = mask[:, i + 1]
            if on.any():
                pair = np.exp(alpha[on, i, :, None] + self.move + (score[on, i + 1] + beta[on, i + 1])[:, None, :] - z[on, None, None])
                move += (gold[on, i, :, None] * gold[on, i + 1, None, :] - pair).sum(axis=0)
        steps = mask[:, 1:]
        value = float((score * gold).sum() + self.move[y[:, :-1], y[:, 1:]][steps].sum() - z.sum())
        return value, emit, move

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most likely labels of one line sequence (Viterbi); content where two are alike."""
        return self._viterbi(x @ self.emit)

    def _viterbi(self, score: np.ndarray) -> np.ndarray:
        if not len(score):
            return np.zeros(0, int)
        score = score.tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = score[0]
        back = []
        for c, d in score[1:]:
            back.append((0 if a + m00 >= b + m10 else 1, 0 if a + m01 >= b + m11 else 1))
            a, b = max(a + m00, b + m10) + c, max(a + m01, b + m11) + d
        at = 0 if a >= b else 1
        path = [at]
        for step in reversed(back):
            at = step[at]
            path.append(at)
        return np.array(path[::-1])


def fit_field(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most_lines: int = LINES) -> Field:
    """Fit on about ``sample`` documents with a quality label that are not held out, half
    of each label, drawn by a hash, and at most ``most_lines`` lines of each; with no labels
    the prior weights stand.  A document of several labels counts with the highest."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = {r.y: r.n for r in y.where(~held_out()).groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Field()
    # 62 bits of a hash, so that the rates are right for any number of labels
    rate = F.lit(0).cast("long")
    for label, n in sizes.items():
        rate = F.when(F.col("y") == label, F.lit((min(sample // 2, n) << 62) // n)).otherwise(rate)
    drawn = y.where(~held_out() & (F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(5)), 2) < rate))

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = []
            for text in batch.column(0).to_pylist():
                f, n = line_features(text or "")
                x.append(np.hstack([f, n[:, None]])[:most_lines].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1)], names=["x", "y"])

    # the drawn ids are at most about ``sample`` rows, so they are broadcast
    got = documents(docs).join(F.broadcast(drawn), "doc_id").select("text", "y").mapInArrow(lines, "x binary, y int").collect()
    known = []
    for r in sorted(got, key=lambda r: (bytes(r.x), r.y)):
        x = np.frombuffer(bytes(r.x), np.float32).astype(np.float64).reshape(-1, FEATURES + 1)
        known.append((x[:, :-1], x[:, -1], CONTENT if r.y else BOILERPLATE))
    return Field().fit(known)


_OUT = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64()), ("n_boilerplate_lines", pa.int64())]


def judge(docs: DataFrame, field: Field, share: float = SHARE) -> DataFrame:
    """One row for each document: doc_id, the base counts, base_failed, kept,
    content_share (of characters, in lines marked content) and n_boilerplate_lines.
    Null and empty texts have no words, so they fail the base rules; two sequences of lines
    that score alike go to content; rows that repeat a doc_id are judged each; very long
    texts are read whole, one at a time; other columns are not read; an empty table gives
    no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = base_counts(text or "")
                x, sizes = line_features(text or "")
                marks = field.decode(x)
                good = float(sizes[marks == CONTENT].sum() / sizes.sum()) if len(sizes) else 0.0
                failed = base_failed(counts[0], counts[4])
                out.append((doc, *counts, failed, not failed and good >= share, good, int((marks == BOILERPLATE).sum())))
            columns = list(zip(*out, strict=True)) if out else [()] * len(_OUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _OUT, strict=True)], names=[n for n, _ in _OUT])

    return documents(docs).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_boilerplate_lines long")


def op8_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` judged by a field fitted on its labelled rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, fit_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
