"""Benchmark decontamination by TF-IDF retrieval and a sequence check.

1. Word weights. ``idf = log((1 + N) / (1 + df))`` from document frequencies over all
   documents (exact for the words of the benchmark, by hash bucket for all others).
2. Latent space. Items are cut into passages of PASSAGE words at most; their TF-IDF vectors are
   the rows of a matrix. A randomised range finder with power steps, whose products are summed
   over tasks by word, gives its singular vectors: half as many as there are passages, RANK at
   most. Words that go together in passages come near each other. Only the passages' side of
   them is computed and sent; a task makes the words' side from it and the passages.
3. Candidates. Windows of WINDOW words of every document and the passages are compared by the
   product of their projected vectors over the lengths of the full ones. What a passage keeps
   of its length in the space says how much of a cosine of LEAST_COSINE can be seen there.
4. Check. The longest common subsequence of the item and the window's surroundings must
   cover LEAST_MATCH of the item, or PARAPHRASE of it with the item's answer (its last words)
   there in order.
5. Pairs that the space misses. A window's cosine with an item much longer or shorter than it
   is low whatever they share, and a passage may be lost in the reduction. So pairs that have
   not been accepted come to the check by two more ways that miss none it would accept:
   surroundings that hold the answer, and surroundings with as many of the item's rarer words
   as a subsequence of LEAST_MATCH cannot do without.

Items are taken in blocks of bounded size (a longer item is a block of its own), so neither the
vocabulary of a block nor its latent space grows with the benchmark; each block is two passes
over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm import tokens
from grainwise.llm.fitting import summed
from grainwise.llm.tables import share, shared, written
from grainwise.llm.toxicity import present

WINDOW, STRIDE = 32, 8
PASSAGE = 2 * WINDOW
RANK, OVERSAMPLING, POWER_STEPS = 128, 10, 2
LEAST_COSINE = 0.35
#: Least product in the latent space, whatever a passage keeps there, and the part of LEAST_COSINE that must be seen.
LEAST_LATENT, SEEN = 0.12, 0.8
LEAST_MATCH, PARAPHRASE = 0.7, 0.5
ANSWER_WORDS = 4
BLOCK_ITEMS = 256
BLOCK_WORDS = BLOCK_ITEMS * PASSAGE
#: Products of windows and passages that a task makes at once.
PRODUCTS = 1 << 20
#: Share of an item's words, the rarest, that are counted in the surroundings of a window.
RARE = 0.6
#: Buckets of the document frequencies of words outside the benchmark.
BUCKETS = 1 << 16


@dataclass(frozen=True)
class Items:
    """A block of benchmark items with its vocabulary, word weights and latent vectors."""

    ids: list[int]
    texts: list[np.ndarray]  # word hashes
    words: np.ndarray  # sorted distinct hashes
    idf: np.ndarray  # of those words
    other_idf: np.ndarray  # by bucket
    owner: np.ndarray  # item of each passage, ascending
    begin: np.ndarray  # of each word in the two arrays below
    passage: np.ndarray
    value: np.ndarray  # of the word in the passage's vector of unit length
    latent: np.ndarray  # passages x rank, unit length before projection
    mixture: np.ndarray  # passages x rank: the sums of passages that are the space's orthonormal vectors
    rare_begin: np.ndarray  # of each word in the next array
    rare_item: np.ndarray  # items that count the word among their rarer ones
    needed: np.ndarray  # places of rarer words without which an item is not matched
    answers: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: sorted hashes of answers, and their items

    @cached_property
    def projected(self) -> np.ndarray:
        """Words x rank: a word's own TF-IDF vector in the latent space, and zeros; made where it is used, never sent."""
        out = np.zeros((len(self.words) + 1, self.mixture.shape[1]), np.float32)
        for a in range(0, len(self.words), 4096):
            b = min(a + 4096, len(self.words))
            x, y = self.begin[a], self.begin[b]
            out[a:b] = np.add.reduceat(self.value[x:y, None] * self.mixture[self.passage[x:y]], self.begin[a:b] - x, axis=0) * self.idf[a:b, None]
        return out

    @cached_property
    def least(self) -> np.ndarray:
        """Product from which on a window is a candidate, by passage."""
        return np.maximum(LEAST_LATENT, SEEN * LEAST_COSINE * (self.latent**2).sum(axis=1)).astype(np.float32)


def item_blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Blocks of (ids, word hashes) of the items that have words; the driver holds one block at a time."""
    rows = benchmark.select(F.col(key).alias("item"), F.col(text).alias("text")).where("item is not null and text is not null").orderBy("item", "text")
    ids, texts = [], []
    for row in rows.toLocalIterator():
        h, _, _ = tokens.words(*tokens.text_buffer(pa.array([row.text])), tokens.MARKS)
        if len(h):
            ids.append(row.item)
            texts.append(h)
        if len(ids) == BLOCK_ITEMS or sum(map(len, texts)) >= BLOCK_WORDS:
            yield ids, texts
            ids, texts = [], []
    if ids:
        yield ids, texts


def frequencies(docs: DataFrame, words: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(documents, document frequency of each word, document frequency of each bucket) over all documents."""
    size = 1 + len(words) + BUCKETS

    def run(batches: Iterator[pa.RecordBatch]):
        total = np.zeros(size, dtype=np.int64)
        for piece in tokens.pieces(batches):
            h, _, at = tokens.words(*tokens.text_buffer(piece.column(0)), tokens.MARKS)
            row = np.repeat(np.arange(piece.num_rows), np.diff(at))
            known = present(h, words)
            feature = np.where(known >= 0, known, len(words) + (h & np.uint64(BUCKETS - 1)).astype(np.int64))
            total[1:] += np.bincount(np.unique(row * size + feature) % size, minlength=size - 1)
            total[0] += piece.num_rows
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled.astype(np.int32)), pa.array(total[filled])], names=["place", "n"])

    found = docs.select("text").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size, dtype=np.int64)
    total[found.column("place").to_numpy()] = found.column("n").to_numpy()
    return int(total[0]), total[1 : 1 + len(words)], total[1 + len(words) :]


def latent_basis(rows: DataFrame, features: int, rank: int) -> tuple[np.ndarray, np.ndarray]:
    """(leading right singular vectors, features x rank, and their singular values) of the rows (ids, values)."""

    def gram(batch: pa.RecordBatch, right: np.ndarray) -> tuple[float, np.ndarray]:
        total, step = np.zeros(right.shape), max(1, PRODUCTS // features)
        for k in range(0, batch.num_rows, step):
            ids, values = batch.column(0).slice(k, step), batch.column(1).slice(k, step)
            row = np.repeat(np.arange(len(ids)), np.diff(ids.offsets.to_numpy()))
            a = np.zeros((len(ids), features))
            np.add.at(a, (row, ids.flatten().to_numpy()), values.flatten().to_numpy())
            total += a.T @ (a @ right)
        return 0.0, total

    width = min(features, rank + OVERSAMPLING)
    basis = np.random.RandomState(7).standard_normal((features, width))
    for _ in range(1 + POWER_STEPS):
        _, product = summed(rows, gram, basis)
        basis, _ = np.linalg.qr(product)
    _, product = summed(rows, gram, basis)
    values, vectors = np.linalg.eigh(basis.T @ product)
    leading = np.argsort(-values)[: min(rank, int((values > values.max(initial=0) * 1e-8).sum()))]
    return basis @ vectors[:, leading], np.sqrt(values[leading])


def run_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each place on."""
    n = max(0, len(h) - length + 1)
    out = np.zeros(n, np.uint64)
    for k in range(length):
        out = tokens.mix(out + h[k : k + n])
    return out


def rarer(texts: list[np.ndarray], words: np.ndarray, df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin of each word, items, places needed): the rarest words of each item, RARE of its places at least."""
    word, item, needed = [], [], np.zeros(len(texts), np.int64)
    for i, h in enumerate(texts):
        place, n = np.unique(np.searchsorted(words, h), return_counts=True)
        order = np.argsort(df[place], kind="stable")
        held = np.cumsum(n[order])
        last = int(np.searchsorted(held, RARE * len(h)))
        word.append(place[order[: last + 1]])
        item.append(np.full(last + 1, i))
        # A match leaves out so many words of the item at most, be they all rare.
        needed[i] = held[last] - (len(h) - np.ceil(LEAST_MATCH * len(h) - 1e-9))
    word, item = np.concatenate(word), np.concatenate(item)
    order = np.argsort(word, kind="stable")
    return np.searchsorted(word[order], np.arange(len(words) + 1)), item[order], np.maximum(needed, 1)


def endings(texts: list[np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: sorted hashes of the items' answers, and the items."""
    found = {}
    for length in {min(ANSWER_WORDS, len(h)) for h in texts}:
        item = np.array([i for i, h in enumerate(texts) if min(ANSWER_WORDS, len(h)) == length])
        key = np.array([run_hashes(texts[i][-length:], length)[0] for i in item], np.uint64)
        order = np.argsort(key, kind="stable")
        found[length] = key[order], item[order]
    return found


def prepared(docs: DataFrame, ids: list[int], texts: list[np.ndarray]) -> Items:
    """Word weights and latent space for a block of items."""
    words = np.unique(np.concatenate(texts))
    n, df, others = frequencies(docs, words)
    idf, other_idf = np.log((1 + n) / (1 + df)) + 1e-6, np.log((1 + n) / (1 + others)) + 1e-6
    owner, word, value = [], [], []
    for i, h in enumerate(texts):
        for part in np.array_split(h, -(-len(h) // PASSAGE)):
            place, count = np.unique(np.searchsorted(words, part), return_counts=True)
            weight = count * idf[place]
            owner.append(i)
            word.append(place)
            value.append(weight / np.linalg.norm(weight))
    passage = np.repeat(np.arange(len(owner)), [len(p) for p in word])
    word, value = np.concatenate(word), np.concatenate(value)
    order = np.argsort(word, kind="stable")
    passage, value = passage[order].astype(np.int32), value[order].astype(np.float32)
    begin = np.searchsorted(word[order], np.arange(len(words) + 1))
    # A row for each word of the block: what tasks return and get has passages x rank numbers, however many words there are.
    rows = pa.table({"ids": pa.LargeListArray.from_arrays(begin, passage).cast(pa.list_(pa.int32())), "values": pa.LargeListArray.from_arrays(begin, value.astype(np.float64)).cast(pa.list_(pa.float64()))})
    vectors, length = latent_basis(docs.sparkSession.createDataFrame(rows).coalesce(2), len(owner), min(RANK, max(1, len(owner) // 2)))
    latent, mixture = (vectors * length).astype(np.float32), (vectors / length).astype(np.float32)
    return Items(ids, texts, words, idf, other_idf, np.array(owner), begin, passage, value, latent, mixture, *rarer(texts, words, df), endings(texts))


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, a machine word of rows at a time."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for x in b.tolist():
        match = where.get(x)
        if match is not None:
            both = row & match
            row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def answered(item: np.ndarray, region: np.ndarray) -> bool:
    """True if the item's last words stand in the region in a row."""
    answer = item[-ANSWER_WORDS:]
    n = len(region) - len(answer) + 1
    return n > 0 and bool(np.logical_and.reduce([region[i : i + n] == w for i, w in enumerate(answer)]).any())


def squared_lengths(h: np.ndarray, square: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Squared TF-IDF length of windows h[start:end]; ``square`` is each word's squared weight."""
    place = start[:, None] + np.arange(WINDOW)
    inside = place < end[:, None]
    place = np.minimum(place, len(h) - 1)
    word, weight = np.where(inside, h[place], 0), np.where(inside, square[place], 0)
    order = np.argsort(word, axis=1)
    word, weight = np.take_along_axis(word, order, axis=1), np.take_along_axis(weight, order, axis=1)
    first = np.ones(word.shape, bool)
    first[:, 1:] = word[:, 1:] != word[:, :-1]
    group = np.cumsum(first) - 1
    return (weight * np.bincount(group)[group].reshape(word.shape)).sum(axis=1)


def candidates(h: np.ndarray, at: np.ndarray, items: Items) -> list[tuple[int, int, int, float]]:
    """(row, first word of the window, item, cosine) of all windows and items that are close enough in the latent space, sorted.

    Windows begin at every STRIDE-th word of a text until one reaches its end.
    """
    known = present(h, items.words)
    inside = np.flatnonzero(known >= 0)
    if not len(inside):
        return []
    square = items.other_idf[(h & np.uint64(BUCKETS - 1)).astype(np.int64)] ** 2
    square[inside] = items.idf[known[inside]] ** 2
    total = np.append(0, np.cumsum(square))

    size = np.diff(at)
    runs = -(-size // STRIDE)
    run_at = np.append(0, np.cumsum(runs))
    row_of = np.repeat(np.arange(len(size)), runs)
    start = at[row_of] + (np.arange(run_at[-1]) - run_at[row_of]) * STRIDE
    end = np.minimum(start + WINDOW, at[row_of + 1])
    windows = np.where(size > 0, 1 + np.maximum(0, -(-(size - WINDOW) // STRIDE)), 0)
    windows = np.flatnonzero(np.arange(run_at[-1]) - run_at[row_of] < windows[row_of])

    depth, step = WINDOW // STRIDE, max(1, PRODUCTS // len(items.owner))
    found = []
    for k in range(0, len(windows), step):
        own = windows[k : k + step]
        low, high = own[0], min(own[-1] + depth, len(row_of))
        sums = np.zeros((high - low, items.latent.shape[1]), np.float32)  # of the words of each run
        for place in start[low:high] + np.arange(STRIDE)[:, None]:
            word = np.where(place < at[row_of[low:high] + 1], known[np.minimum(place, len(h) - 1)], -1)
            sums += items.projected[word]  # the last of them, zeros, for others
        vector = sums[own - low]
        for d in range(1, depth):
            same = row_of[np.minimum(own + d, len(row_of) - 1)] == row_of[own]
            same &= own + d < len(row_of)
            vector[same] += sums[own[same] + d - low]
        product = vector @ items.latent.T
        # Words that occur twice make a window longer than this, so no near one is missed here.
        shortest = np.sqrt(np.maximum(total[end[own]] - total[start[own]], 1e-12)).astype(np.float32)
        near, passage = np.divmod(np.flatnonzero(product >= shortest[:, None] * items.least), len(items.owner))
        found.append((own[near], passage, product[near, passage]))
    if not found:
        return []
    window, passage, product = (np.concatenate(x) for x in zip(*found, strict=True))
    distinct, which = np.unique(window, return_inverse=True)
    cosine = product / np.sqrt(squared_lengths(h, square, start[distinct], end[distinct]) + 1e-12)[which]
    close = cosine >= items.least[passage]
    window, item, cosine = window[close], items.owner[passage[close]], cosine[close]
    order = np.lexsort((-cosine, item, window))  # an item's nearest passage first
    order = order[np.append(True, (np.diff(window[order]) != 0) | (np.diff(item[order]) != 0))[: len(order)]]
    return list(zip(row_of[window[order]].tolist(), start[window[order]].tolist(), item[order].tolist(), cosine[order].tolist(), strict=True))


def possible(h: np.ndarray, at: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """(row, item, first and last of the word's places) of all stretches that a match or an answer needs, sorted.

    A window's surroundings have WINDOW words and the item's length on both sides at most.
    """
    size = np.array([len(t) for t in items.texts])
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    known = present(h, items.words)
    inside = np.flatnonzero(known >= 0)
    if not len(inside):
        return []
    word = known[inside]
    count = items.rare_begin[word + 1] - items.rare_begin[word]
    place = np.repeat(inside, count)
    item = items.rare_item[np.repeat(items.rare_begin[word] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    order = np.lexsort((place, item, row[place]))
    place, item = place[order], item[order]
    last = np.arange(len(place)) + items.needed[item] - 1
    ok = last < len(place)
    end = np.where(ok, last, 0)
    ok &= (row[place[end]] == row[place]) & (item[end] == item) & (place[end] - place < WINDOW + 2 * size[item])
    found = [(row[place[ok]], item[ok], place[ok], place[end[ok]])]
    for length, (keys, owner) in items.answers.items():
        key = run_hashes(h, length)
        a, b = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
        start = np.flatnonzero(b > a)
        start = start[row[start] == row[start + length - 1]]
        n = (b - a)[start]
        own = owner[np.repeat(a[start] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        begin = np.repeat(start, n)
        found.append((row[begin], own, begin, begin + length - 1))
    rows, item, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((last, first, item, rows))
    return list(zip(*(x[order].tolist() for x in (rows, item, first, last)), strict=True))


def accepted(item: np.ndarray, region: np.ndarray) -> tuple[bool, float]:
    """Whether the region leaks the item, and the share of the item in order."""
    found = common_subsequence(item, region) / len(item)
    return found >= LEAST_MATCH or found >= PARAPHRASE and answered(item, region), found


def accepted_near(h: np.ndarray, a: int, b: int, item: np.ndarray, stretches: list[tuple[int, int]]) -> tuple[bool, float]:
    """The same for all windows of the text h[a:b] whose surroundings hold one of the stretches; the share is that of the leak."""
    n, last = len(item), max(0, -(-(b - a - WINDOW) // STRIDE))
    groups: list[list[int]] = []
    for x, y in stretches:  # the windows of a stretch, by number; overlapping ones are one group
        low = max(0, -(-(y + 1 - n - WINDOW - a) // STRIDE))
        high = min(last, (x + n - a) // STRIDE)
        if low > high:
            continue
        if groups and low <= groups[-1][1] + 1:
            groups[-1] = [min(groups[-1][0], low), max(groups[-1][1], high)]
        else:
            groups.append([low, high])
    region = lambda low, high: h[max(a, a + low * STRIDE - n) : min(b, a + high * STRIDE + WINDOW + n)]
    while groups:
        low, high = groups.pop()
        leak, share_found = accepted(item, region(low, high))
        # What all the windows together do not hold, none of them does.
        if not leak:
            continue
        if low == high:
            return True, share_found
        middle = (low + high) // 2
        groups += [[low, middle], [middle + 1, high]]
    return False, 0.0


def checked(piece: pa.RecordBatch, column: int, m: Items) -> tuple[list[set], np.ndarray, np.ndarray]:
    """Of each text: the items that it leaks, its best cosine and best match."""
    h, _, at = tokens.words(*tokens.text_buffer(piece.column(column)), tokens.MARKS)
    leaked: list[set] = [set() for _ in range(piece.num_rows)]
    cosine, match = np.zeros(piece.num_rows), np.zeros(piece.num_rows)
    for row, first, i, c in candidates(h, at, m):
        cosine[row] = max(cosine[row], c)
        if m.ids[i] in leaked[row]:
            continue
        item = m.texts[i]
        leak, share_found = accepted(item, h[max(at[row], first - len(item)) : min(at[row + 1], first + WINDOW + len(item))])
        match[row] = max(match[row], share_found)
        if leak:
            leaked[row].add(m.ids[i])
    for (row, i), group in groupby(possible(h, at, m), key=lambda x: x[:2]):
        if m.ids[i] in leaked[row]:
            continue
        leak, share_found = accepted_near(h, int(at[row]), int(at[row + 1]), m.texts[i], [x[2:] for x in group])
        if leak:
            leaked[row].add(m.ids[i])
            match[row] = max(match[row], share_found)
    return leaked, cosine, match


def matches(docs: DataFrame, items: Items) -> DataFrame:
    """(doc_id, item_ids, cosine, match) of each row for one block of items."""
    box = share(docs.sparkSession, items)

    def run(batches: Iterator[pa.RecordBatch]):
        m = shared(box)
        for piece in tokens.pieces(batches):
            leaked, cosine, match = checked(piece, 1, m)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([sorted(x) for x in leaked], type=pa.list_(pa.int64())), pa.array(cosine), pa.array(match)], names=["doc_id", "item_ids", "cosine", "match"])

    return docs.mapInArrow(run, "doc_id long, item_ids array<long>, cosine double, match double")


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, leaked, item_ids, cosine, match) of each row.

    ``item_ids`` are the benchmark items found in the text, ascending; ``cosine`` is the best of
    the candidates of step 3 and ``match`` (share of the item in order) the best of those and of
    the leaks of step 5, 0 without any. NULL and blank
    texts leak nothing; items that are NULL, blank or without a key match nothing, repeated
    items count once. Repeated rows give repeated results, rows with a NULL key one with NULL.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    parts = [matches(docs, prepared(docs, ids, texts)) for ids, texts in item_blocks(benchmark, item_key, item_text)]
    if not parts:
        none = F.array().cast("array<long>")
        return docs.select("doc_id", F.lit(False).alias("leaked"), none.alias("item_ids"), F.lit(0.0).alias("cosine"), F.lit(0.0).alias("match"))
    if len(parts) == 1:
        found = parts[0]
    else:  # rows are told apart by their place in the input, which is the same in every pass
        placed = [p.withColumn("__row", F.monotonically_increasing_id()) for p in parts]
        found = written(placed[0], "leaks")
        for p in placed[1:]:
            found = found.union(written(p, "leaks"))
        found = found.groupBy("__row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("cosine").alias("cosine"), F.max("match").alias("match"))
    return found.select("doc_id", (F.size("item_ids") > 0).alias("leaked"), "item_ids", "cosine", "match")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that leak no item, with all their columns; nothing is joined or shuffled."""
    at, whole = docs.columns.index(text), docs.select(F.col(text).alias("text"))
    for ids, texts in item_blocks(benchmark, item_key, item_text):
        box = share(docs.sparkSession, prepared(whole, ids, texts))

        def run(batches: Iterator[pa.RecordBatch], box=box):
            m = shared(box)
            for piece in tokens.pieces(batches, text):
                yield piece.filter(pa.array([not x for x in checked(piece, at, m)[0]], type=pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
