"""Quality classifier: ordinal cumulative-link (proportional odds) regression on graded ratings.

Grades come from the ratings: 0 bad quality or toxic text, 1 middling, 2 good, whatever levels occur.
Features are the distinct words of a document (ASCII lower-cased) and three tokens for its shape, hashed into ``2**bits`` buckets; all
grades share one weight per bucket, and ordered thresholds cut the score:
``P(grade > k) = sigmoid(w.x - theta_k)``. The expected grade is the sum of these tail probabilities, and
the tail probability of the selection is ``P(grade >= select_grade)``.

Fitting uses a bounded sample: at most ``sample_rows`` rated documents (those of smallest hash); each
is a bitmap of ``2**bits`` bits, so the driver holds at most ``sample_rows * 2**bits / 8`` bytes. Scoring
covers every document in one scan, with the weights (``8 * 2**bits`` bytes) broadcast.

Defined results. Null or blank text: only the shape tokens decide. No ratings: expected
grade and tail probability null, everything kept. One grade: it is expected everywhere. A selection above all rated grades: tail
probability 0, nothing kept; at or below the lowest: 1, everything kept. Several ratings of one document: the lowest. A rated doc_id that repeats with several
texts: one of them is used. Very long texts: read whole. Repeated rows: a row each. Empty table: no rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .storage import text_or_empty


_SHAPES = T.mix(np.arange(1, 4, dtype=np.uint64) * T.U64(0xC2B2AE3D27D4EB4F))


def features(part: T.Buffers, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets, each pair once, in order of rows: the words, and three tokens for the shape of the text
    (share of distinct words, share of symbols, length), hashed like words."""
    found = T.words(part, T.PUNCTUATION, fold=True)
    shift = T.U64(64 - bits)
    key = np.unique((found.row.astype(np.int64) << bits) | (found.hash >> shift).astype(np.int64))
    n = np.maximum(found.counts(part.rows), 1)
    distinct = np.bincount(key >> bits, minlength=part.rows)
    symbols = part.per_row(T.PUNCTUATION[part.data] & ~T.WHITE[part.data])
    shapes = [np.minimum(10, 10 * distinct // n), np.minimum(20, 4 * symbols // n), np.log2(n).astype(np.int64)]
    rows = np.arange(part.rows, dtype=np.int64)
    more = [(rows << bits) | (T.mix(x.astype(np.uint64) ^ seed) >> shift).astype(np.int64) for x, seed in zip(shapes, _SHAPES)]
    key = np.unique(np.concatenate([key, *more]))
    return key >> bits, key & ((1 << bits) - 1)


@dataclass
class Ordinal:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each threshold k, a row each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[:, None] - score[None, :], -60, 60)))


def fit(row: np.ndarray, bucket: np.ndarray, grade: np.ndarray, bits: int, steps: int = 300, lasso: float = 1e-3, rate: float = 0.1) -> Ordinal:
    """Maximum likelihood with a lasso, by Adam with soft thresholding, then without it over the
    buckets that the lasso kept; thresholds stay ordered by their gaps' logarithms."""
    levels = np.unique(grade)
    y = np.searchsorted(levels, grade)
    k, n, size = len(levels), len(grade), 1 << bits
    if k < 2:
        return Ordinal(np.zeros(size), np.zeros(0), levels)
    share = np.array([(y > j).mean() for j in range(k - 1)])
    theta = -np.log(share / (1 - share))
    free = np.concatenate([theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    x = np.concatenate([np.zeros(size), free])
    kept = np.ones(len(x))
    for step in [*range(1, steps + 1), *range(1, steps // 2 + 1)]:
        if step == 1:
            m, v = np.zeros_like(x), np.zeros_like(x)
            rest = lasso if kept.all() else lasso / 10
        w, f = x[:size], x[size:]
        gaps = np.exp(f[1:])
        theta = f[0] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.bincount(row, weights=w[bucket], minlength=n)
        tail = 1 / (1 + np.exp(np.clip(theta[:, None] - s[None, :], -60, 60)))
        high = np.vstack([np.ones(n), tail])  # P(y >= j)
        low = np.vstack([tail, np.zeros(n)])  # P(y > j)
        own = np.arange(n)
        p = np.maximum(high[y, own] - low[y, own], 1e-12)
        slope = np.vstack([np.zeros(n), tail * (1 - tail), np.zeros(n)])  # d tail / d (s - theta)
        up, down = slope[y, own], slope[y + 1, own]
        d_s = (up - down) / p
        d_theta = np.array([(-(up / p)[y == j + 1]).sum() + (down / p)[y == j].sum() for j in range(k - 1)])
        d_free = np.concatenate([[d_theta.sum()], [gaps[j] * d_theta[j + 1 :].sum() for j in range(k - 2)]])
        grad = np.concatenate([-np.bincount(bucket, weights=d_s[row], minlength=size) / n, -d_free / n])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        pace = rate * (1 - step / (steps + 1))
        scale = np.sqrt(v / (1 - 0.999**step)) + 1e-4
        x = x - kept * pace * (m / (1 - 0.9**step)) / scale
        x[:size] = np.sign(x[:size]) * np.maximum(0, np.abs(x[:size]) - pace * rest / scale[:size])
        if step == steps:
            kept[:size] = x[:size] != 0
    return Ordinal(x[:size], x[size] + np.concatenate([[0], np.cumsum(np.exp(x[size + 1 :]))]), levels)


def grade_of(quality: str = "quality", toxic: str = "toxic"):
    """Graded ratings from two flags: bad 0, toxic 1, good 2."""
    q, t = F.coalesce(F.col(quality), F.lit(0)), F.coalesce(F.col(toxic), F.lit(0))
    return F.when(q == 0, 0).when(t == 1, 1).otherwise(2)


def train(docs: DataFrame, ratings: DataFrame, bits: int = 16, sample_rows: int = 8192) -> Ordinal:
    """``ratings``: doc_id, grade; several grades of one document count with their smallest."""
    spark = docs.sparkSession
    rated = ratings.filter("doc_id is not null and grade is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("grade").cast("long").alias("grade"))
    sample = {r[0]: r[1] for r in rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).collect()}
    ids = spark.sparkContext.broadcast(np.sort(np.array(list(sample), np.int64)))

    def bitmaps(batches):
        for batch in batches:
            doc_id = batch.column(0)
            mine = np.flatnonzero(np.isin(doc_id.fill_null(0).to_numpy(zero_copy_only=False), ids.value) & doc_id.is_valid().to_numpy(zero_copy_only=False))
            chosen = batch.take(pa.array(mine))
            for part in T.buffers(chosen.column(1)):
                row, bucket = features(part, bits)
                cut = np.searchsorted(row, np.arange(part.rows + 1))
                maps = []
                for r in range(part.rows):
                    flags = np.zeros(1 << bits, bool)
                    flags[bucket[cut[r] : cut[r + 1]]] = True
                    maps.append(np.packbits(flags).tobytes())
                yield pa.RecordBatch.from_arrays([chosen.column(0).slice(part.first, part.rows), pa.array(maps, pa.binary())], ["doc_id", "bitmap"])

    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    # a doc_id that repeats gives one bitmap
    kept = pairs.mapInArrow(bitmaps, "doc_id long, bitmap binary").groupBy("doc_id").agg(F.min("bitmap").alias("bitmap"))
    rows, buckets, grades = [], [], []
    for n, (doc_id, bitmap) in enumerate(sorted(kept.collect())):  # at most sample_rows
        bucket = np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, np.uint8)))
        rows.append(np.full(len(bucket), n))
        buckets.append(bucket)
        grades.append(sample[doc_id])
    ids.unpersist()
    if not grades:
        return Ordinal(np.zeros(1 << bits), np.zeros(0), np.zeros(0))
    return fit(np.concatenate(rows), np.concatenate(buckets), np.array(grades), bits)


def grade_documents(docs: DataFrame, model: Ordinal, bits: int = 16, select_grade: int = 2, select_probability: float = 0.75) -> DataFrame:
    """doc_id, raw_score, expected_grade, tail_prob, kept for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        model = shared.value
        at = int(np.searchsorted(model.grades, select_grade))  # the first grade that is high enough
        gaps = np.diff(model.grades)
        for batch in batches:
            raw = [np.bincount(row, weights=model.weights[bucket], minlength=part.rows) for part in T.buffers(batch.column(1)) for row, bucket in [features(part, bits)]]
            raw = np.concatenate(raw) if raw else np.zeros(0)
            if len(model.grades):
                tails = model.tails(raw)
                expected = pa.array(model.grades[0] + (gaps[:, None] * tails).sum(axis=0))
                chosen = np.ones(len(raw)) if at == 0 else tails[at - 1] if at <= len(tails) else np.zeros(len(raw))
                tail, kept = pa.array(chosen), pa.array(chosen >= select_probability)
            else:
                expected = tail = pa.nulls(len(raw), pa.float64())
                kept = pa.array(np.ones(len(raw), bool))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw), expected, tail, kept], ["doc_id", "raw_score", "expected_grade", "tail_prob", "kept"])

    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    return pairs.mapInArrow(score, "doc_id long, raw_score double, expected_grade double, tail_prob double, kept boolean")
