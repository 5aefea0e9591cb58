"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class).

* Classes. A word's type is its own number if it is one of the HEAD most frequent words, else
  a hash of its last two bytes. Types are clustered by the frequent words next to them, as
  counted over the whole training text.
* P(class | history) is a softmax over hashed features: the type of the word before, the type
  of the word before that one (a skip), and the classes of the last three words. Every task
  takes AdaGrad steps through its own part of the training text; the tasks' weights are
  averaged, each feature by how often a task saw it, and the next round starts from there on
  other documents. All training documents are used once.
* P(word | class) = (c + 0.5) / Z(class) with exact counts c over all training documents; a
  class keeps 0.5 for words never seen.

Counts of the COMMON most frequent words travel with the model (a fixed bound). Counts of all
others stay in a table and are joined to the texts' rare words; scores are summed in NumPy over
batches of the sparse features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm import tokens
from grainwise.llm.tables import fold, share, shared, written

COMMON = 1 << 18
HEAD, ENDINGS, NEIGHBOURS, CLASSES = 8192, 4096, 32, 16
TYPES = HEAD + ENDINGS
ROUNDS, BATCH, RATE, DAMPING = 2, 16384, 0.3, 10.0
FEATURES = 8192  # of each word feature
ROWS = 2 * FEATURES + CLASSES**3 + 1
END = np.uint64(0xA5A5A5A5DEADBEE5)
START_CLASS, START_TYPE = 0, TYPES
COUNT_BYTES = 16 << 20


class HashIndex:
    """Numbers of known 64-bit keys by open addressing, whole arrays at a time."""

    def __init__(self, keys: np.ndarray):
        self.mask = np.uint64((1 << max(4, int(len(keys) * 4).bit_length())) - 1)
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.number = np.full(int(self.mask) + 1, -1, np.int32)
        left, step = np.arange(len(keys)), np.uint64(0)
        while len(left):
            slot = ((keys[left] + step) & self.mask).astype(np.int64)
            free = np.flatnonzero(self.number[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)
            won = free[one]
            self.keys[slot[won]], self.number[slot[won]] = keys[left[won]], left[won]
            left, step = np.delete(left, won), step + np.uint64(1)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        out, left, step = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), np.uint64(0)
        h = hashes
        while len(left):
            slot = ((h + step) & self.mask).astype(np.int64)
            number = self.number[slot]
            hit = (self.keys[slot] == h) & (number >= 0)
            out[left[hit]] = number[hit]
            more = ~hit & (number >= 0)
            left, h, step = left[more], h[more], step + np.uint64(1)
        return out


def token_rows(piece: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, hash of its ending, offsets of the rows): words, then one end in each row."""
    data, offsets = tokens.text_buffer(piece.column(column))
    h, starts, at = tokens.words(data, offsets)
    rows = len(offsets) - 1
    out, ending = np.full(len(h) + rows, END), np.zeros(len(h) + rows, np.int64)
    place = np.arange(len(h)) + np.repeat(np.arange(rows), np.diff(at))
    out[place] = h
    if len(h):
        blank = tokens.SPACES[data]
        last = np.empty(len(data), bool)
        last[-1] = True
        last[:-1] = blank[1:]
        last[offsets[1:][offsets[1:] > 0] - 1] = True
        last = np.flatnonzero(last & ~blank)
        lower = data | (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
        code = lower[last].astype(np.uint64) << np.uint64(8) | lower[np.maximum(last - 1, starts)]
        ending[place] = (tokens.mix(code + np.uint64(1)) & np.uint64(ENDINGS - 1)).astype(np.int64)
    return out, ending, at + np.arange(rows + 1)


def counted(docs: DataFrame) -> DataFrame:
    """(token, ending, n): exact counts over all rows (text), pre-aggregated in the tasks."""

    def run(batches: Iterator[pa.RecordBatch]):
        for big in tokens.pieces(batches, limit=COUNT_BYTES):
            parts = [token_rows(p, 0)[:2] for p in tokens.pieces([big])]
            h, e = (np.concatenate(x) for x in zip(*parts, strict=True))
            unique, first, n = np.unique(h, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tokens.signed(unique)), pa.array(e[first].astype(np.int32)), pa.array(n)], names=["token", "ending", "n"])

    return docs.select("text").mapInArrow(run, "token long, ending int, n long").groupBy("token", "ending").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What a task needs to know of the counts."""

    index: HashIndex
    count: np.ndarray  # by rank, most frequent first
    ending: np.ndarray
    total: int  # tokens
    distinct: int

    def types(self, rank: np.ndarray, ending: np.ndarray) -> np.ndarray:
        return np.where((rank >= 0) & (rank < HEAD), rank, HEAD + ending)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The COMMON most frequent words at most: all words above the count that keeps to the bound."""
    sizes = counts.groupBy("n").count().orderBy(F.desc("n")).limit(COMMON).collect()
    least, held = 0, 0
    for row in sizes:
        if held + row["count"] > COMMON:
            break
        held += row["count"]
        least = row["n"]
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = counts.where(F.col("n") >= (least or 1 << 62)).toPandas()
    common = common.sort_values(["n", "token"], ascending=[False, True])
    keys = common["token"].to_numpy(np.int64).view(np.uint64)
    return Vocabulary(HashIndex(keys), common["n"].to_numpy(np.int64), common["ending"].to_numpy(np.int64), int(total), int(distinct))


def reduced(parts: DataFrame, shape: tuple[int, ...], groups: int = 8) -> np.ndarray:
    """Sum of the arrays in the rows (part, total) of all tasks, in two stages."""

    def add(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(shape)
        for batch in batches:
            for x in batch.column(1):
                total += np.frombuffer(x.as_py(), dtype=np.float32).reshape(shape)
        yield pa.RecordBatch.from_pydict({"part": pa.array([0], pa.int32()), "total": [total.astype(np.float32).tobytes()]})

    rows = parts.repartition(groups).mapInArrow(add, "part int, total binary").collect()
    return sum((np.frombuffer(r.total, dtype=np.float32).reshape(shape).astype(np.float64) for r in rows), np.zeros(shape))


def _part(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "total": [total.astype(np.float32).tobytes()]})


def neighbours(docs: DataFrame, words: Vocabulary) -> np.ndarray:
    """How often each type stands within two words of each of the most frequent words."""
    box = share(docs.sparkSession, words)

    def run(batches: Iterator[pa.RecordBatch]):
        w = shared(box)
        total = np.zeros(TYPES * NEIGHBOURS)
        for piece in tokens.pieces(batches):
            h, ending, at = token_rows(piece, 0)
            rank = w.index.find(h)
            kind = w.types(rank, ending)
            row = np.repeat(np.arange(len(at) - 1), np.diff(at))
            for k in (1, 2):
                same = row[k:] == row[:-k]
                for word, beside in ((kind[k:], rank[:-k]), (kind[:-k], rank[k:])):
                    near = same & (beside >= 0) & (beside < NEIGHBOURS)
                    total += np.bincount(word[near] * NEIGHBOURS + beside[near], minlength=len(total))
        yield _part(total)

    return reduced(docs.select("text").mapInArrow(run, "part int, total binary"), (TYPES, NEIGHBOURS))


def classes(near: np.ndarray) -> np.ndarray:
    """Class of each type: spherical k-means on square roots of the neighbour shares."""
    weight = near.sum(axis=1)
    points = np.sqrt(near / np.maximum(weight, 1)[:, None])
    seen = np.flatnonzero(weight > 0)
    out = np.zeros(TYPES + 1, np.int64)
    if len(seen) <= CLASSES:
        out[seen] = np.arange(len(seen))
        return out
    order = seen[np.argsort(-weight[seen], kind="stable")]
    centres = [points[order[0]]]
    closest = points[seen] @ centres[0]
    for _ in range(CLASSES - 1):  # farthest first, by weight
        centres.append(points[seen[np.argmax((1 - closest) * np.sqrt(weight[seen]))]])
        closest = np.maximum(closest, points[seen] @ centres[-1])
    centres = np.stack(centres)
    for _ in range(25):
        mine = (points[seen] @ centres.T).argmax(axis=1)
        for k in range(CLASSES):
            own = seen[mine == k]
            if len(own):
                c = (points[own] * np.sqrt(weight[own])[:, None]).sum(axis=0)
                centres[k] = c / np.linalg.norm(c)
    out[:TYPES] = (points @ centres.T).argmax(axis=1)
    return out


def history(kind: np.ndarray, at: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of the three features in the weights, for each token."""
    place = np.arange(len(kind)) - np.repeat(at[:-1], np.diff(at))

    def back(x: np.ndarray, k: int, start: int) -> np.ndarray:
        out = np.full(len(x), start)
        out[k:] = x[: len(x) - k]
        out[place < k] = start
        return out

    one, two = back(kind, 1, START_TYPE), back(kind, 2, START_TYPE)
    spread = lambda x, salt: (tokens.mix(x.astype(np.uint64) + np.uint64(salt << 32)) & np.uint64(FEATURES - 1)).astype(np.int64)
    c = of[kind]
    last = (back(c, 1, START_CLASS) * CLASSES + back(c, 2, START_CLASS)) * CLASSES + back(c, 3, START_CLASS)
    return spread(one, 1), FEATURES + spread(two, 2), 2 * FEATURES + last


def log_classes(weights: np.ndarray, rows: tuple[np.ndarray, ...]) -> np.ndarray:
    """Natural log probability of each class (tokens x classes)."""
    z = weights[-1] + weights[rows[0]] + weights[rows[1]] + weights[rows[2]]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(docs: DataFrame, words: Vocabulary, of: np.ndarray) -> np.ndarray:
    """Weights (ROWS x CLASSES) after one pass over all documents in ROUNDS parts."""
    context = docs.sparkSession.sparkContext
    weights = np.zeros((ROWS, CLASSES), np.float32)
    box = share(docs.sparkSession, (words, of))

    for r in range(ROUNDS):
        begun = context.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], begun=begun):
            known, cls = shared(box)
            w = begun.value.copy()
            past, seen = np.zeros_like(w), np.zeros((ROWS, 1), np.float32)
            for piece in tokens.pieces(batches):
                h, ending, at = token_rows(piece, 0)
                kind = known.types(known.index.find(h), ending)
                rows, target = history(kind, at, cls), cls[kind]
                for a in range(0, len(h), BATCH):
                    part = tuple(x[a : a + BATCH] for x in rows)
                    slope = np.exp(log_classes(w, part))
                    slope[np.arange(len(slope)), target[a : a + BATCH]] -= 1
                    for x in (*part, np.full(len(slope), ROWS - 1)):
                        order = np.argsort(x.astype(np.uint16), kind="stable")
                        first = np.flatnonzero(np.diff(x[order], prepend=-1))
                        touched = x[order[first]]
                        g = np.add.reduceat(slope[order], first, axis=0)
                        past[touched] += g * g
                        w[touched] -= RATE * g / np.sqrt(past[touched] + DAMPING)
                        seen[touched, 0] += np.diff(np.append(first, len(x)))
            yield _part(np.hstack([(w - begun.value) * seen, seen]))

        part = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(ROUNDS)) == r)
        total = reduced(part.select("text").mapInArrow(run, "part int, total binary"), (ROWS, CLASSES + 1))
        weights = weights + (total[:, :-1] / np.maximum(total[:, -1:], 1)).astype(np.float32)
        begun.destroy()
    box.destroy()
    return weights


def class_mass(counts: DataFrame, words: Vocabulary, of: np.ndarray) -> np.ndarray:
    """Z of each class: its training tokens, 0.5 for each of its words and 0.5 for unseen ones."""
    head = min(HEAD, len(words.count))
    by_ending = np.zeros(ENDINGS)
    for row in counts.groupBy("ending").agg(F.sum(F.col("n") + 0.5).alias("mass")).collect():
        by_ending[row.ending] = row.mass
    own = words.count[:head] + 0.5
    by_ending -= np.bincount(words.ending[:head], weights=own, minlength=ENDINGS)
    mass = np.bincount(of[:head], weights=own, minlength=CLASSES) + np.bincount(of[HEAD:TYPES], weights=np.maximum(by_ending, 0), minlength=CLASSES)
    return mass + 0.5


def score(docs: DataFrame, held_out=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Train on the rows that are not held out and score all rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10
    probabilities of the whole text under smoothed word counts and under the model. A text's
    tokens are its words (A-Z lower-cased, cut at ASCII white space) and one end; NULL text is
    empty, so it has one token. ``held_out`` is a condition on the key, by default remainder 1
    of its crc32 modulo 5; rows with a NULL key are not held out and not learned from. Repeated
    rows count and are scored each. Without training rows every token is unseen.
    """
    held = F.coalesce(fold(key, 5) == 1 if held_out is None else held_out, F.lit(False))
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text).alias("text"))
    learned = docs.where("not held_out and doc_id is not null")
    counts = written(counted(learned), "counts")
    words = vocabulary(counts)
    of = classes(neighbours(learned, words))
    weights = train(learned, words, of)
    mass = class_mass(counts, words, of)
    box = share(docs.sparkSession, (words, of, weights, np.log10(mass)))

    def run(batches: Iterator[pa.RecordBatch]):
        known, cls, w, log_mass = shared(box)
        number = TaskContext.get().partitionId() << 33
        log_count = np.log10(known.count + 0.5)
        for piece in tokens.pieces(batches):
            h, ending, at = token_rows(piece, 2)
            rank = known.index.find(h)
            kind = known.types(rank, ending)
            target, rows = cls[kind], history(kind, at, cls)
            own = np.empty(len(h))
            for a in range(0, len(h), BATCH):
                each = log_classes(w, tuple(x[a : a + BATCH] for x in rows))
                own[a : a + BATCH] = each[np.arange(len(each)), target[a : a + BATCH]]
            row = np.repeat(np.arange(piece.num_rows), np.diff(at))
            common = rank >= 0
            word = np.zeros(len(h))
            word[common] = log_count[rank[common]]
            total = lambda x, row=row, n=piece.num_rows: np.bincount(row, weights=x, minlength=n)
            ends = np.searchsorted(row[~common], np.arange(piece.num_rows + 1)).astype(np.int32)
            rare = pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.signed(h[~common])))
            columns = [pa.array(number + np.arange(piece.num_rows)), piece.column(0), piece.column(1), pa.array(np.diff(at)), pa.array(total(common).astype(np.int64)), pa.array(total(word)), pa.array(total(own / np.log(10) - log_mass[target])), rare]
            number += piece.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "held_out", "n_tokens", "n_common", "common", "classes", "rare"])

    found = written(docs.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_common long, common double, classes double, rare array<long>"), "scored")
    rare = found.select("row", F.explode("rare").alias("token")).join(counts.select("token", "n"), "token", "left")
    n = F.coalesce("n", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.log10(n + 0.5)).alias("rare_part"), F.sum((n > 0).cast("long")).alias("n_rare"))
    base = float(np.log10(words.total + 0.5 * (words.distinct + 1)))
    part = F.col("common") + F.coalesce("rare_part", F.lit(0.0))
    return found.drop("rare").join(rare, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + F.coalesce("n_rare", F.lit(0))).alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (part - F.col("n_tokens") * F.lit(base)).alias("base_score"), (part + F.col("classes")).alias("score"),
    )
