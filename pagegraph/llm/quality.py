"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features.

A text's features are hashed 3-grams of its bytes, hashed 3-grams of its shape (letters, capitals, digits,
symbols as they are) and how its words repeat, each family as shares of its own total. One weight per bucket is
shared by all grades; grade k ends at an ordered threshold: P(y <= k) = sigmoid(t_k - w.x). The expected grade and
the tail P(y >= k) select.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import mix64, table, text_buffers
from .ngram_join import word_hashes

BUCKETS = 2048  #: per family of 3-grams, a power of two
SAMPLE = 4000  #: labelled rows that a model is fitted on, at most; those with the least hashes of doc_id
SLAB = 1 << 20
TAIL = 0.5
REPEATS = 8  #: buckets for repeated words: as the word before, within the last 2, 4, 8, 16, 32 words, new to these, all
U = np.uint64

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x30:0x3A] = 0x30
_SHAPE[0x41:0x5B] = 0x41
_SHAPE[0x61:0x7B] = 0x61
_SHAPE[0x80:] = 0x61
_MIX = [mix64(np.arange(256, dtype=U) * U(0x9E3779B97F4A7C15) + U(i)) for i in range(1, 4)]
_COLUMNS = [(m >> U(65 - BUCKETS.bit_length())).astype(np.uint16) for m in _MIX]


def _grams(x: np.ndarray) -> np.ndarray:
    """Buckets of the byte 3-grams."""
    return _COLUMNS[0][x[:-2]] ^ _COLUMNS[1][x[1:-1]] ^ _COLUMNS[2][x[2:]]


def _repeats(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per word the bucket of its distance to the same word before it in the text."""
    out = np.full(len(h), REPEATS - 2, np.int64)
    number = np.arange(len(h))
    start = np.repeat(at[:-1], np.diff(at))
    for bucket, (a, b) in reversed(list(enumerate([(1, 2), (2, 3), (3, 5), (5, 9), (9, 17), (17, 33)]))):
        for d in range(a, b):
            same = np.zeros(len(h), bool)
            same[d:] = h[d:] == h[:-d]
            out[same & (number - d >= start)] = bucket
    return out


def slabs(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about SLAB bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + SLAB, side="right")) - 1)
        yield i, j
        i = j


def families(raw: np.ndarray, offsets: np.ndarray):
    """(bucket numbers, text numbers) of each family; 3-grams don't reach over a text's end."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    if len(raw) >= 3:
        inside = owner[:-2] == owner[2:]
        for i, x in enumerate((raw, _SHAPE[raw])):
            yield _grams(x)[inside].astype(np.int64) + i * BUCKETS, owner[:-2][inside]
    h, at = word_hashes(raw, offsets)
    yield _repeats(h, at) + 2 * BUCKETS, np.repeat(np.arange(len(offsets) - 1), np.diff(at))


WIDTH = 2 * BUCKETS + REPEATS


def features(texts) -> np.ndarray:
    """Dense features (for a bounded number of texts)."""
    raw, offsets = text_buffers(texts)
    out = np.zeros((len(offsets) - 1, WIDTH), np.float32)
    for i, j in slabs(raw, offsets):
        part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        for bucket, owner in families(part, at):
            n = np.maximum(np.bincount(owner, minlength=j - i), 1)
            key, count = np.unique(owner * WIDTH + bucket, return_counts=True)
            out[i + key // WIDTH, key % WIDTH] = np.sqrt(count / n[key // WIDTH])
    return out


@dataclass
class Ordinal:
    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(y >= grade) for every grade but the least."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -60, 60)))

    def scores(self, texts) -> np.ndarray:
        raw, offsets = text_buffers(texts)
        out = np.zeros(len(offsets) - 1)
        for i, j in slabs(raw, offsets):
            part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            for bucket, owner in families(part, at):
                if not len(owner):
                    continue
                base = int(bucket[0]) // BUCKETS * BUCKETS
                n = np.bincount(owner, minlength=j - i)
                size = REPEATS if base == 2 * BUCKETS else BUCKETS
                edge = np.concatenate(([0], np.cumsum(n)))
                for k in np.flatnonzero(n):
                    c = np.bincount(bucket[edge[k] : edge[k + 1]] - base, minlength=size)
                    out[i + k] += np.sqrt(c / n[k]) @ self.weights[base : base + size]
        return out


def fit(x: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.05, ridge: float = 1e-4) -> Ordinal:
    """Full-batch Adam on the cumulative-link likelihood, from zero weights; no randomness.

    Thresholds are the first one plus exponentials, hence ordered. One grade or none fits to a constant.
    """
    grades = np.unique(y)
    k = len(grades) - 1
    if k < 1:
        return Ordinal(grades if len(grades) else np.zeros(1), np.zeros(WIDTH), np.zeros(0))
    rank = np.searchsorted(grades, y)
    share = np.clip(np.array([(rank <= i).mean() for i in range(k)]), 1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    p = np.concatenate((np.zeros(x.shape[1]), t[:1], np.log(np.maximum(np.diff(t), 1e-3))))
    m, v = np.zeros_like(p), np.zeros_like(p)
    d = x.shape[1]
    for step in range(1, steps + 1):
        gaps = np.exp(p[d + 1 :])
        t = np.concatenate((p[d : d + 1], p[d] + np.cumsum(gaps)))
        z = np.clip(np.concatenate((np.full((len(y), 1), -40.0), t[None, :] - (x @ p[:d].astype(np.float32))[:, None], np.full((len(y), 1), 40.0)), axis=1), -40, 40)
        s = 1 / (1 + np.exp(-z))
        rows = np.arange(len(y))
        hi, lo = s[rows, rank + 1], s[rows, rank]
        like = np.maximum(hi - lo, 1e-12)
        # d(-log like) / dz at the upper and lower end
        gu, gl = -hi * (1 - hi) / like, lo * (1 - lo) / like
        g = np.zeros_like(p)
        g[:d] = x.T @ (-(gu * (rank < k) + gl * (rank > 0)) / len(y)).astype(np.float32)
        gt = np.array([(gu[rank == i].sum() + gl[rank == i + 1].sum()) / len(y) for i in range(k)])
        g[d] = gt.sum()
        g[d + 1 :] = [gt[i + 1 :].sum() * gaps[i] for i in range(k - 1)]
        g[:d] += ridge * p[:d]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    t = np.concatenate((p[d : d + 1], p[d] + np.cumsum(np.exp(p[d + 1 :]))))
    return Ordinal(grades, p[:d], t)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, text: str = "text") -> Ordinal:
    """Fit on at most ``sample`` labelled rows: those whose doc_id hashes least, so the choice is stable.

    Rows without a grade don't count. The sample's ids (bounded) are sent to the scan of ``docs``.
    """
    chosen = labels.where("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.max("grade").cast("double").alias("grade"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col(text).alias("_text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", "_text").toArrow().sort_by("doc_id")
    y = rows.column("grade").to_numpy()
    return fit(features(rows.column("_text")), y)


def grade(docs: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """Adds expected_grade, p_top (tail of the highest grade) and p_above (tail of the second grade) to ``docs``.

    Null texts are read as empty; those have no features and get the thresholds' own tails. Columns of the new
    names are replaced. With a single grade in training everything has it, with tails of 1.
    """
    new = ["expected_grade", "p_top", "p_above"]
    docs = docs.drop(*new)
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in new)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pickle.loads(sent.value)
        for b in batches:
            if not b.num_rows:
                continue
            tails = m.tails(m.scores(b.column(text))) if len(m.thresholds) else np.ones((b.num_rows, 1))
            expected = m.grades[0] + tails @ np.diff(m.grades) if len(m.thresholds) else np.full(b.num_rows, m.grades[0], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(expected), pa.array(tails[:, -1]), pa.array(tails[:, 0])], names=[*b.schema.names, *new])

    return docs.mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade")))
    return grade(docs, model).select("doc_id", "expected_grade", "p_top", (F.col("p_above") >= TAIL).alias("keep"))
