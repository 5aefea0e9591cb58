"""Language identification in two steps: the family first, then the language within it.

A text becomes the relative frequencies of its hashed byte trigrams (letters of ASCII in lower
case, everything in ASCII that is not a letter as a space). A softmax over families decides
the family; inside it, linear support vector machines with squared hinge loss, one for each
pair of languages, vote. All linear models are fitted together by distributed gradient steps
on a bounded sample of labelled documents. Scoring adds up the weights of a text's trigrams,
so it is one pass over the bytes with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.llm import tokens
from grainwise.llm.fitting import adagrad, sparse
from grainwise.llm.tables import in_sample, written

BUCKETS = 1 << 15
#: Most labelled documents of one language that the models are fitted on.
SAMPLE_PER_LANGUAGE = 1500
#: Tasks of a fitting step; the sample is bounded, so they are.
SAMPLE_TASKS = 12
STEPS, RATE, SCALE = 25, 0.5, 30.0
UNKNOWN = "und"
# Families of languages by ISO 639-1 code; any other code is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
_SHAPE = np.array([32 if b < 128 and not chr(b).isalpha() else ord(chr(b).lower()) if b < 128 else b for b in range(256)], dtype=np.uint8)


def family_of(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), language)


@dataclass(frozen=True)
class Layout:
    """Which row of the weights is which model."""

    languages: tuple[str, ...]

    @property
    def families(self) -> tuple[str, ...]:
        return tuple(sorted({family_of(x) for x in self.languages}))

    @property
    def pairs(self) -> tuple[tuple[str, str], ...]:
        return tuple(p for p in combinations(self.languages, 2) if family_of(p[0]) == family_of(p[1]))


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each trigram whose middle is no space, offsets of the rows in them)."""
    shape = _SHAPE[data]
    if not len(shape):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before, after = np.roll(shape, 1), np.roll(shape, -1)
    inside = offsets[:-1][np.diff(offsets) > 0]
    before[inside] = 32
    after[(np.append(inside[1:], len(shape)) - 1)] = 32
    middle = np.flatnonzero(shape != 32)
    code = (before[middle].astype(np.uint32) << 16) | (shape[middle].astype(np.uint32) << 8) | after[middle]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - 15), np.searchsorted(middle, offsets)


def features(docs: DataFrame) -> DataFrame:
    """(lang, ids, values) of rows (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]):
        for piece in tokens.pieces(batches):
            buckets, at = trigrams(*tokens.text_buffer(piece.column(0)))
            found = [np.unique(buckets[a:b], return_counts=True) for a, b in zip(at[:-1], at[1:], strict=True)]
            ids = tokens.lists([i.astype(np.int32) for i, _ in found], pa.int32())
            values = tokens.lists([(c * (SCALE / max(1, c.sum()))).astype(np.float32) for _, c in found], pa.float32())
            yield pa.RecordBatch.from_arrays([piece.column(1), ids, values], names=["lang", "ids", "values"])

    return docs.mapInArrow(run, "lang string, ids array<int>, values array<float>")


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> tuple[Layout, np.ndarray]:
    """Layout and weights (models x buckets) from at most SAMPLE_PER_LANGUAGE documents of each language.

    The sample goes by a hash of the key. Rows with NULL text, key or language teach nothing.
    """
    labelled = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("key is not null and text is not null and lang is not null")
    sizes = dict(labelled.groupBy("lang").count().collect())
    layout = Layout(tuple(sorted(sizes)))
    if not sizes:
        return layout, np.zeros((0, BUCKETS))
    # one scan draws the samples of all languages; only they are dealt to a few tasks
    chosen = reduce(Column.__or__, [(F.col("lang") == x) & in_sample("key", SAMPLE_PER_LANGUAGE, n) for x, n in sizes.items()])
    rows = written(features(labelled.where(chosen).select("text", "lang")).repartition(SAMPLE_TASKS), "trigrams")
    names, families, pairs = layout.languages, layout.families, layout.pairs
    home = np.array([families.index(family_of(x)) for x in names])
    side = np.array([[1 if x == a else -1 if x == b else 0 for x in names] for a, b in pairs]).reshape(len(pairs), len(names))
    total = sum(min(n, SAMPLE_PER_LANGUAGE) for n in sizes.values())

    def part(batch: pa.RecordBatch, w: np.ndarray) -> tuple[float, np.ndarray]:
        row, feature, value = sparse(batch, "ids", "values")
        which = np.array([names.index(x) for x in batch.column(0).to_pylist()])
        n = batch.num_rows
        z = np.stack([np.bincount(row, weights=value * m[feature], minlength=n) for m in w])
        k = len(families)
        p = np.exp(z[:k] - z[:k].max(axis=0))
        p /= p.sum(axis=0)
        loss = -np.log(p[home[which], np.arange(n)] + 1e-300).sum()
        slope = np.empty_like(z)
        slope[:k] = p
        slope[home[which], np.arange(n)] -= 1
        y = side[:, which]
        short = np.maximum(0, 1 - y * z[k:]) * (y != 0)
        slope[k:] = -2 * y * short
        gradient = np.stack([np.bincount(feature, weights=value * s[row], minlength=BUCKETS) for s in slope])
        return loss + (short**2).sum(), gradient / total

    return layout, adagrad(rows, part, np.zeros((len(families) + len(pairs), BUCKETS)), STEPS, RATE).astype(np.float32)


def predict(docs: DataFrame, layout: Layout, weights: np.ndarray, key: str = "doc_id", text: str = "text", kept: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, the columns of ``kept``, lang_pred, score) of each row.

    Texts that are NULL or hold no letter are ``und`` with score 0; so is everything if
    nothing was learned. The score is the family's probability times the mean of the winner's
    probabilities against its relatives; ties go to the first language in order.
    """
    families, pairs, names = layout.families, layout.pairs, layout.languages
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    kept = kept or {}

    def run(batches: Iterator[pa.RecordBatch]):
        w = shared.value
        for piece in tokens.pieces(batches):
            data, offsets = tokens.text_buffer(piece.column(0))
            buckets, at = trigrams(data, offsets)
            size = np.diff(at)
            full = np.flatnonzero(size)
            z = np.zeros((len(w), piece.num_rows))
            for m in range(len(w)):
                if len(full):
                    z[m, full] = np.add.reduceat(w[m][buckets], at[:-1][full], dtype=np.float64) * SCALE / size[full]
            lettered = piece.column(2).to_numpy(zero_copy_only=False).astype(bool)
            known = lettered & (size > 0) if names else np.zeros(piece.num_rows, bool)
            p = np.exp(z[: len(families)] - z[: len(families)].max(axis=0, initial=0))
            p /= np.maximum(p.sum(axis=0), 1e-300)
            win = 1 / (1 + np.exp(-4 * z[len(families) :]))
            guess, score = np.full(piece.num_rows, UNKNOWN, dtype=object), np.zeros(piece.num_rows)
            first = p.argmax(axis=0) if names else np.zeros(piece.num_rows, int)
            for f, family in enumerate(families):
                own = [x for x in names if family_of(x) == family]
                votes, belief = np.zeros((len(own), piece.num_rows)), np.zeros((len(own), piece.num_rows))
                for j, (a, b) in enumerate(pairs):
                    if a in own:
                        votes[own.index(a)] += win[j] >= 0.5
                        votes[own.index(b)] += win[j] < 0.5
                        belief[own.index(a)] += win[j]
                        belief[own.index(b)] += 1 - win[j]
                best = (votes * len(own) * 2 + belief).argmax(axis=0)
                here = known & (first == f)
                guess[here] = np.array(own, dtype=object)[best[here]]
                mean = belief[best, np.arange(piece.num_rows)] / (len(own) - 1) if len(own) > 1 else np.ones(piece.num_rows)
                score[here] = (p[f] * mean)[here]
            yield pa.RecordBatch.from_arrays([*piece.columns[3:], pa.array(guess, type=pa.string()), pa.array(np.clip(score, 0, 1))], names=[*piece.schema.names[3:], "lang_pred", "score"])

    own = docs.select(F.col(text).alias("text"), F.lit(0).alias("unused"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("lettered"), F.col(key).alias("doc_id"), *(c.alias(n) for n, c in kept.items()))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[3:])
    return own.mapInArrow(run, f"{schema}, lang_pred string, score double")
