"""Quality rules: base rules, then a hashed n-gram log-likelihood ratio of trusted target against raw corpus.

Method. Words and word pairs are hashed into ``2**bits`` buckets. Two multinomials are estimated with
additive smoothing: one over the trusted rows (labelled good), one over every document. A document's
score is the sum of ``log2 p_trusted(bucket) - log2 p_raw(bucket)`` over its n-grams divided by their
number. A document is kept if the base rules pass and its score is at least ``threshold``: the same
verdict for the same score, for every document.

Scale. Two scans of the texts; tasks exchange only (bucket, counts), at most ``2**bits`` rows each, and
the driver receives one bounded table of ``2**bits`` buckets. Trusted rows are a bounded sample
(``trusted_rows`` labelled rows at most, those of smallest hash, whose ids are broadcast: 1.6 MB); the raw multinomial counts every document.

Defined results. Null or blank text: no words, all counts 0, base_failed. Repeated rows: a row each.
Very long texts: read whole. Empty table: no rows. No trusted rows: all scores 0, so the base rules decide. Other columns, whatever their names, are
ignored by the query and kept by ``filter_documents``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .storage import text_or_empty

#: Fixed values of the base rules.
MIN_WORDS = 20
WINDOW = 8
MAX_REPEATED_PERCENT = 30
SYMBOLS = b"#*$%&|<>"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"


def trusted_ids(labels: DataFrame, rows: int) -> DataFrame:
    """At most ``rows`` ids of documents labelled good, those whose hashed id is smallest."""
    good = labels.filter("quality = 1 and toxic = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    return good.distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _buckets(found: T.Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    pair, row = T.ngrams(found, 2)
    shift = T.U64(64 - bits)
    return np.concatenate([found.hash, pair]) >> shift, np.concatenate([found.row, row])


def log_ratios(docs: DataFrame, labels: DataFrame, bits: int = 16, trusted_rows: int = 200_000, smoothing: float = 1.0) -> np.ndarray:
    """``log2 p_trusted - log2 p_raw`` of every bucket."""
    spark = docs.sparkSession
    ids = np.sort(np.array([r[0] for r in trusted_ids(labels, trusted_rows).collect()], np.int64))
    trusted = spark.sparkContext.broadcast(ids)

    def count(batches):
        size = 1 << bits
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            doc_id = batch.column(0)
            good = np.isin(doc_id.fill_null(0).to_numpy(zero_copy_only=False), trusted.value) & doc_id.is_valid().to_numpy(zero_copy_only=False)
            for part in T.buffers(batch.column(1)):
                bucket, row = _buckets(T.words(part, T.WHITE), bits)
                bucket = bucket.astype(np.int64)
                raw += np.bincount(bucket, minlength=size)
                if (mine := good[part.first : part.first + part.rows]).any():
                    target += np.bincount(bucket[mine[row]], minlength=size)
        seen = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(raw[seen]), pa.array(target[seen])], ["bucket", "raw", "target"])

    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    counted = pairs.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    table = np.zeros((2, 1 << bits))
    for bucket, raw, target in counted.collect():  # at most 2**bits rows
        table[:, bucket] = raw, target
    trusted.unpersist()
    if not table[1].sum():
        return np.zeros(1 << bits)
    p = (table + smoothing) / (table + smoothing).sum(axis=1, keepdims=True)
    return np.log2(p[1]) - np.log2(p[0])


def measure(column: pa.Array, ratios: np.ndarray | None) -> list[pa.Array]:
    """The columns of SCHEMA for a column of texts."""
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    for part in T.buffers(column):
        found, n = T.words(part, T.WHITE), part.rows
        counts = found.counts(n)
        starts_char = (part.data & 0xC0) != 0x80
        chars = part.per_row(starts_char & ~T.WHITE[part.data])
        symbols = part.per_row(_SYMBOL[part.data])
        # lines with a word, and those of them that are new
        line = T.words(part, T.NEWLINE)
        solid = np.concatenate([[0], np.cumsum(~T.WHITE[part.data])])
        worded = solid[line.end] > solid[line.start]
        where = line.row[worded]
        _, fresh = np.unique(T.within(line.hash[worded], where), return_index=True)
        dup = np.bincount(where, minlength=n) - np.bincount(where[fresh], minlength=n)
        # words inside a window that occurs twice in its text
        repeated = np.zeros(n, np.int64)
        many = len(found.hash) - WINDOW + 1
        if many > 0:
            begin = np.flatnonzero(found.row[:many] == found.row[WINDOW - 1 :])
            window, row = T.ngrams(found, WINDOW)
            _, back, times = np.unique(T.within(window, row), return_inverse=True, return_counts=True)
            again = begin[times[back] > 1]
            cover = np.zeros(len(found.hash) + 1, np.int64)
            np.add.at(cover, again, 1)
            np.add.at(cover, again + WINDOW, -1)
            repeated = np.bincount(found.row[np.cumsum(cover)[:-1] > 0], minlength=n)
        score = np.zeros(n)
        if ratios is not None:
            bucket, row = _buckets(found, int(len(ratios)).bit_length() - 1)
            score = np.bincount(row, weights=ratios[bucket.astype(np.int64)], minlength=n) / np.maximum(1, np.bincount(row, minlength=n))
        for k, values in enumerate((counts, chars, symbols, dup, repeated, score)):
            out[k].append(values)
    kinds = [np.int64] * 5 + [np.float64]
    return [pa.array(np.concatenate(x).astype(kind) if x else np.zeros(0, kind)) for x, kind in zip(out, kinds)]


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = -0.75, bits: int = 16, trusted_rows: int = 200_000) -> DataFrame:
    """``docs`` without their texts, with the measures, ``score``, ``base_failed`` and ``kept``."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, bits, trusted_rows))

    def score(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *measure(batch.column(1), ratios.value)], ["doc_id", *[c.split()[0] for c in SCHEMA.split(", ")]])

    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(docs).alias("text"))
    return verdict(pairs.mapInArrow(score, f"doc_id long, {SCHEMA}"), threshold)


def verdict(measured: DataFrame, threshold: float) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))


def filter_documents(docs: DataFrame, labels: DataFrame, threshold: float = -0.75, bits: int = 16, trusted_rows: int = 200_000) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns, in one pass after the counts."""
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, labels, bits, trusted_rows))
    at = docs.columns.index("text")

    def keep(batches):
        for batch in batches:
            words, _, _, _, repeated, score = (x.to_numpy() for x in measure(batch.column(at), ratios.value))
            good = (words >= MIN_WORDS) & (100 * repeated <= MAX_REPEATED_PERCENT * words) & (score >= threshold)
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)
