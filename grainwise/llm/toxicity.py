"""Severity of toxic language by cumulative-link ordinal regression.

Grades 0 < 1 < ... < K-1 share one weight per word; ordered thresholds part them:
P(grade <= j) = sigmoid(threshold_j - score). The words are learned: those that occur in
significantly more toxic than clean documents of a bounded labelled sample. Documents are
sparse vectors 1 + log(count) over these words. Fitting is by distributed gradient steps,
scoring one pass with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm import tokens
from grainwise.llm.fitting import lbfgs, sparse
from grainwise.llm.tables import sampled, share, shared, written

#: Most labelled documents of either class that the model is fitted on.
SAMPLE_PER_CLASS = 8000
#: Most words in the model, and the least likelihood ratio and documents that a word needs.
WORDS, LEAST_RATIO, LEAST_DOCS = 4096, 12.0, 3
STEPS, RIDGE = 80, 1e-5
REJECT_AT = 0.5


@dataclass(frozen=True)
class Severity:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # ascending, one fewer than grades


def word_counts(docs: DataFrame) -> DataFrame:
    """(toxic, words, counts) of rows (text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for piece in tokens.pieces(batches):
            h, _, at = tokens.words(*tokens.text_buffer(piece.column(0)), tokens.MARKS)
            found = [np.unique(h[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)]
            columns = [piece.column(1), tokens.lists([x for x, _ in found], pa.int64()), tokens.lists([c.astype(np.int32) for _, c in found], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["toxic", "words", "counts"])

    return docs.mapInArrow(run, "toxic int, words array<long>, counts array<int>")


def telling_words(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of words over-represented in toxic documents, by likelihood ratio."""
    clean, toxic = (float(rows.where(F.col("toxic") == t).count()) for t in (0, 1))
    if not clean or not toxic:
        return np.zeros(0, np.uint64)
    found = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b"))
    x, y = F.col("a"), F.col("b")
    share = (x + y) / (clean + toxic)
    part = lambda seen, n, p: F.when(seen > 0, seen * F.log(seen / (n * p))).otherwise(0) + F.when(seen < n, (n - seen) * F.log((n - seen) / (n * (1 - p)))).otherwise(0)
    ratio = 2 * (part(x, F.lit(toxic), share) + part(y, F.lit(clean), share))
    best = found.where((x >= LEAST_DOCS) & (x / toxic > 4 * y / clean)).where(ratio >= LEAST_RATIO).orderBy(ratio.desc(), "word").limit(WORDS)
    return np.sort(np.array([r.word for r in best.collect()], dtype=np.int64).view(np.uint64))


def present(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Number of each hash among the sorted words, or -1."""
    if not len(words):
        return np.full(len(hashes), -1)
    seen = np.zeros(1 << 16, dtype=bool)
    seen[(words & np.uint64(0xFFFF)).astype(np.int64)] = True
    out = np.full(len(hashes), -1)
    maybe = np.flatnonzero(seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(words, hashes[maybe]), len(words) - 1)
    hit = words[at] == hashes[maybe]
    out[maybe[hit]] = at[hit]
    return out


def graded(rows: DataFrame, words: np.ndarray, grades: int) -> DataFrame:
    """(grade, ids, values): clean rows are grade 0, toxic ones 1.. by how much of the telling words they hold.

    The labels say toxic or not; the grades above 0 are equal parts of the toxic rows in order
    of their summed values.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            row, feature, value = sparse(batch, "words", "counts")
            at = present(feature.astype(np.int64).view(np.uint64), words)
            keep = at >= 0
            cuts = np.searchsorted(row[keep], np.arange(batch.num_rows + 1))
            much = np.bincount(row[keep], weights=1 + np.log(value[keep]), minlength=batch.num_rows).astype(np.float64)
            lists = [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(x)) for x in (at[keep].astype(np.int32), (1 + np.log(value[keep])).astype(np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(much)], names=["toxic", "ids", "values", "much"])

    found = written(rows.mapInArrow(run, "toxic int, ids array<int>, values array<float>, much double"), "graded")
    cuts = found.where("toxic = 1").agg(F.percentile("much", F.array(*(F.lit(g / (grades - 1)) for g in range(1, grades - 1))))).first()[0] if grades > 2 else []
    above = sum((F.col("much") > F.lit(float(c))).cast("int") for c in cuts or [])
    return found.select(F.when(F.col("toxic") == 1, 1 + above).otherwise(0).alias("grade"), "ids", "values")


def fit(docs: DataFrame, labels: DataFrame, grades: int = 3, key: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Severity:
    """Fit on at most about SAMPLE_PER_CLASS toxic and clean labelled documents each.

    Rows with a NULL key or label teach nothing; a key with contradicting labels is toxic.
    Without rows of both classes nothing is learned and every document gets grade 0.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(toxic).isNotNull()).groupBy(F.col(key).alias("__key")).agg(F.max(F.when(F.col(toxic) > 0, 1).otherwise(0)).alias("toxic"))
    known = written(known, "labels")
    chosen = written(sampled(known.where("toxic = 1"), "__key", SAMPLE_PER_CLASS).union(sampled(known.where("toxic = 0"), "__key", SAMPLE_PER_CLASS)), "sample")
    # the sample has a fixed bound, so it may be broadcast
    texts = docs.select(F.col(key).alias("__doc"), F.col(text).alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("__doc") == F.col("__key")).select("text", "toxic")
    # the scan keeps its own tasks; only the sample's words are dealt to a few
    rows = written(word_counts(rows).repartition(12), "words")
    words = telling_words(rows)
    if not len(words):
        return Severity(words, np.zeros(0), np.full(grades - 1, np.inf))
    train = written(graded(rows, words, grades), "train")
    n, total = len(words), train.count()

    def thresholds(w: np.ndarray) -> np.ndarray:
        return w[n] + np.append(0, np.cumsum(np.exp(w[n + 1 :])))

    def part(batch: pa.RecordBatch, w: np.ndarray) -> tuple[float, np.ndarray]:
        row, feature, value = sparse(batch, "ids", "values")
        y = batch.column(0).to_numpy()
        s = np.bincount(row, weights=value * w[feature], minlength=len(y))
        cuts = np.concatenate([[-np.inf], thresholds(w), [np.inf]])
        sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
        up, low = sigmoid(cuts[y + 1] - s), sigmoid(cuts[y] - s)
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up) / p, low * (1 - low) / p
        gradient = np.zeros(len(w))
        gradient[:n] = np.bincount(feature, weights=value * (d_up - d_low)[row], minlength=n)
        at = np.bincount(y, weights=-d_up, minlength=grades)[: grades - 1] + np.bincount(y, weights=d_low, minlength=grades)[1:]
        gradient[n] = at.sum()
        gradient[n + 1 :] = np.exp(w[n + 1 :]) * np.cumsum(at[::-1])[::-1][1:]
        gradient[:n] += RIDGE * len(y) * w[:n]
        return (-np.log(p).sum() + RIDGE * len(y) * (w[:n] @ w[:n]) / 2) / total, gradient / total

    start = np.concatenate([np.zeros(n), [2.0], np.zeros(grades - 2)])
    w = lbfgs(train, part, start, STEPS)
    return Severity(words, w[:n], thresholds(w))


def exceedance(piece: pa.RecordBatch, column: int, m: Severity) -> np.ndarray:
    """P(grade > j) of each text (thresholds x rows)."""
    h, _, offsets = tokens.words(*tokens.text_buffer(piece.column(column)), tokens.MARKS)
    at = present(h, m.words)
    hit = np.flatnonzero(at >= 0)
    row = np.searchsorted(offsets, hit, side="right") - 1
    cell, count = np.unique(row * max(1, len(m.words)) + at[hit], return_counts=True)
    row, feature = np.divmod(cell, max(1, len(m.words)))
    s = np.bincount(row, weights=(1 + np.log(count)) * m.weights[feature], minlength=piece.num_rows)
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(m.thresholds[:, None] - s))


def score(docs: DataFrame, model: Severity, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, severity, grade, p_toxic, rejected) of each row, repeated rows included.

    ``severity`` is the expected grade, ``grade`` the most probable one, ``p_toxic`` the
    probability of any grade above 0, and rows with p_toxic >= REJECT_AT are rejected. NULL and
    empty texts hold none of the model's words and score like any other text without them.
    """
    box = share(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared(box)
        for piece in tokens.pieces(batches):
            over = exceedance(piece, 1, m)
            each = -np.diff(np.vstack([np.ones(piece.num_rows), over, np.zeros(piece.num_rows)]), axis=0)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(over.sum(axis=0)), pa.array(each.argmax(axis=0).astype(np.int32)), pa.array(over[0]), pa.array(over[0] >= REJECT_AT)], names=["doc_id", "severity", "grade", "p_toxic", "rejected"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, severity double, grade int, p_toxic double, rejected boolean")


def accepted(docs: DataFrame, model: Severity, text: str = "text") -> DataFrame:
    """The rows that ``score`` doesn't reject, with all their columns; nothing is joined or shuffled."""
    box, at = share(docs.sparkSession, model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared(box)
        for piece in tokens.pieces(batches, text):
            yield piece.filter(pa.array(exceedance(piece, at, m)[0] < REJECT_AT))

    return docs.mapInArrow(run, docs.schema)
