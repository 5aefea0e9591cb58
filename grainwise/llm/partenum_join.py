"""Exact Jaccard self-join of documents on word n-grams with PartEnum signatures.

Two sets of together S elements with similarity of at least t differ in at most
(1-t)/(1+t) * S elements. Sets are put in bands of similar size, a set near the end of a
band in the next one too, so that any two similar sets meet in a band; its largest S bounds
the difference by k. In a band the domain of the n-grams is cut into
``(k + 2) // 2`` parts and a few more and each part into ``splits`` cells: in some part the
two sets differ in one element at most, so they agree in all cells of that part but one. The
signatures of a set are therefore, for each part, all subsets of its cells that leave one
out. A set needs not all parts: with a partner of its own size range it differs in fewer
elements than the band allows, so of the first parts, taken until more of them have no empty
cell than can hold two differences, one agrees. The set that stops first vouches for that, and
its signature is over a cell with elements, so signatures over empty cells are left out; only
a set with too few such parts has all its signatures.

Sharing a signature only makes a candidate. Signatures move once, in ranges, so that a common
one is dealt to many tasks, and each task compares neighbours in order. Each signature's sets
are first compared with the smallest of them in the task and the tasks' border rows with each
other (stars, linear in the group); the components found so far then leave
few pairs of different components under one signature, which are compared as well. An odd
sketch of the set (parities of hashed elements) bounds the difference from below, so pairs
that it rules out are never read; all others are counted exactly. Documents with equal sets
are one set throughout. N-grams are 64-bit hashes.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.llm import tokens
from grainwise.llm.tables import discard, small, unused, written

#: One part is added for so many, one at least.
PARTS_FOR_ONE_MORE = 16
#: Bands grow by this power of 1 / t: a compromise of few bands per set and a small bound k.
STRETCH = 3
#: Least 64-bit words of a sketch; large sets have more, as a full sketch would bound nothing.
SKETCH_WORDS = 16
#: Sets whose signatures a task knows to have given.
REMEMBERED = 200_000
_UNIT = np.uint64(0x9E3779B97F4A7C15)


class Bands:
    """Size bands of a threshold num / den and the signatures of a set in them."""

    def __init__(self, num: int, den: int, splits: int):
        self.num, self.den, self.splits = num, den, splits
        self.first, self.last = [1], []
        self.edges: dict[int, np.ndarray] = {}

    def of(self, size: int) -> list[tuple[int, int]]:
        """(number, k) of every band that holds sets of this size."""
        while self.first[-1] <= size:
            top = max(self.first[-1], int(self.first[-1] * (self.den / self.num) ** STRETCH))
            self.last.append(top * self.den // self.num)
            self.first.append(top + 1)
        j = int(np.searchsorted(self.first, size, side="right")) - 1
        found = []
        while j >= 0 and self.last[j] >= size:
            found.append((j, (self.den - self.num) * 2 * self.last[j] // (self.den + self.num)))
            j -= 1
        return found

    def signatures(self, elements: np.ndarray, values: np.ndarray) -> np.ndarray:
        """All signatures of a set; elements are sorted hashes, values a second hash of each."""
        sums = np.append(np.uint64(0), np.cumsum(values, dtype=np.uint64))
        out = []
        for band, k in self.of(len(elements)):
            if not k:
                continue  # only equal sets are similar here
            least = (k + 2) // 2
            parts = least + max(1, least // PARTS_FOR_ONE_MORE)
            size = len(elements)
            differ = (self.den - self.num) * (size + min(size * self.den // self.num, self.last[band])) // (self.den + self.num)
            cells = parts * self.splits
            if cells not in self.edges:
                self.edges[cells] = np.arange(1, cells, dtype=np.uint64) * np.uint64(2**64 // cells)
            cut = np.concatenate([[0], np.searchsorted(elements, self.edges[cells]), [len(elements)]])
            cell = (sums[cut[1:]] - sums[cut[:-1]]).reshape(parts, self.splits)
            filled = np.diff(cut).reshape(parts, self.splits)
            left_out = np.arange(cells, dtype=np.uint64).reshape(parts, self.splits) + np.uint64(band << 40)
            subsets = tokens.mix(cell.sum(axis=1, dtype=np.uint64)[:, None] - cell + tokens.mix(left_out * _UNIT))
            empty = filled.sum(axis=1)[:, None] == filled
            full = np.flatnonzero(~empty.any(axis=1))
            if len(full) > differ // 2:  # one of them differs in one element at most
                stop = full[differ // 2] + 1
                out.append(subsets[:stop][~empty[:stop]])
            else:
                out.append(subsets.ravel())
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], list[np.ndarray], np.ndarray]]:
    """Batches of (doc_id, text) with the sets, their second hashes and their keys."""
    for piece in tokens.pieces(batches):
        hashes, _, at = tokens.words(*tokens.text_buffer(piece.column(1)))
        sets = tokens.shingles(hashes, at, width)
        values = [tokens.mix(s + _UNIT) for s in sets]
        totals = np.array([np.sum(v, dtype=np.uint64) for v in values], dtype=np.uint64)
        keys = tokens.mix(totals + np.array([len(v) for v in values], dtype=np.uint64) * _UNIT)
        yield piece, sets, values, tokens.signed(keys)


def sketch(values: np.ndarray) -> np.ndarray:
    """Parities of the values' low bits: a bit for each element at least, a power of two in all."""
    bits = max(64 * SKETCH_WORDS, 1 << len(values).bit_length())
    odd = (np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def described(docs: DataFrame, width: int, num: int, den: int, splits: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, sketch, signatures) of each row; an empty set has no key.

    A task gives a set's signatures once and its further copies none; should it have forgotten
    a set among REMEMBERED others, it gives them again.
    """

    def run(batches):
        bands, known = Bands(num, den, splits), set()
        for piece, sets, values, keys in _sets(batches, width):
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            odd = [sketch(v) for v in values]
            signed = []
            for s, v, k in zip(sets, values, keys.tolist(), strict=True):
                signed.append(np.zeros(0, np.uint64) if k in known or not len(s) else bands.signatures(s, v))
                if len(known) >= REMEMBERED:
                    known.clear()
                known.add(k)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(sizes), pa.array(keys, mask=sizes == 0), tokens.lists(odd, pa.int64()), tokens.lists(signed, pa.int64())], names=["doc_id", "n_shingles", "set_key", "sketch", "signatures"]
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set_key long, sketch array<long>, signatures array<long>")


def sets_of(docs: DataFrame, width: int) -> DataFrame:
    """(set_key, elements) of each row."""

    def run(batches):
        for _, sets, _, keys in _sets(batches, width):
            yield pa.RecordBatch.from_arrays([pa.array(keys), tokens.lists(sets, pa.int64())], names=["set_key", "elements"])

    return docs.mapInArrow(run, "set_key long, elements array<long>")


def neighbours(signed: DataFrame) -> DataFrame:
    """(signature, set_key, centre, edge) of the rows (signature, set_key) that may share a signature.

    Rows are dealt in ranges of (signature, set_key), so that a signature of very many sets is
    split, and put in order. A row whose signature another set of the same task has is given
    with the least set of the two or more, ``centre``. Each task's first and last row are
    given as ``edge`` without a centre: only those may share with rows of other tasks.
    """
    names = ["signature", "set_key", "centre", "edge"]

    def part(signature, key, centre, edge):
        flags = np.full(len(signature), edge)
        return pa.RecordBatch.from_arrays([pa.array(signature), pa.array(key), pa.array(centre), pa.array(flags)], names=names)

    def run(batches):
        # the last row and the least set of its signature wait for the row after them
        rest, begun = np.zeros((3, 0), np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            s, k = (batch.column(i).to_numpy() for i in (0, 1))
            if not begun:
                yield part(s[:1], k[:1], k[:1], True)
                begun = True
            s, k = np.append(rest[0], s), np.append(rest[1], k)
            new = np.append(True, (s[1:] != s[:-1]) | (k[1:] != k[:-1]))
            s, k = s[new], k[new]
            first = np.append(True, s[1:] != s[:-1])
            centre = k[np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))]
            if rest.size:
                centre[: int(np.append(np.flatnonzero(first[1:]) + 1, len(s))[0])] = rest[2, 0]
            follows = np.append(s[1:] == s[:-1], False)
            given = ((k != centre) | follows)[:-1]
            yield part(s[:-1][given], k[:-1][given], centre[:-1][given], False)
            rest = np.array([s[-1:], k[-1:], centre[-1:]])
        if rest.size:
            yield part(*rest, True)
            if rest[1, 0] != rest[2, 0]:
                yield part(*rest, False)

    dealt = signed.repartitionByRange("signature", "set_key").sortWithinPartitions("signature", "set_key")
    return dealt.mapInArrow(run, "signature long, set_key long, centre long, edge boolean")


def components(edges: DataFrame, label: str) -> DataFrame:
    """(node, root): the smallest node of each connected component, for all nodes of the edges (a, b).

    Alternates large and small star steps: every step is one aggregate and one join, and hubs
    are pre-aggregated, so neither long chains nor hot nodes need many or large tasks.
    """
    edges, before = edges.where("a <> b"), None
    for step in itertools.count():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large.where("a <> b"), f"{label}-large-{step}")
        # every edge now points from the greater to the smaller node
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least, "a")
        star = hung.select(F.col("b").alias("x"), F.col("m").alias("y")).union(hung.select(F.col("a"), F.col("m"))).where("x <> y").distinct()
        edges = written(star.toDF("a", "b"), f"{label}-small-{step}")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        before = now
    raise AssertionError("unreachable")


def _may_link(a: str, b: str, num: int, den: int) -> Column:
    """What sizes and odd sketches of two sets allow.

    Sets of similar size have sketches of equal length, or one is twice the other and its
    halves are added first: the lower bits of an element stay the same.
    """
    size_a, size_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    one, two = F.col(f"{a}.sketch"), F.col(f"{b}.sketch")

    def level(x: Column, other: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) <= F.size(other), x).otherwise(F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q)))

    odd = F.aggregate(F.zip_with(level(one, two), level(two, one), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = (F.least(size_a, size_b) * den >= F.greatest(size_a, size_b) * num) & (odd * (den + num) <= (size_a + size_b) * (den - num))
    return near


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100, splits: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row.

    Two rows link when den * |A & B| >= num * |A | B| for their sets of ``width``-word
    n-grams (A-Z lower-cased, words cut at ASCII white space; fewer words count as one
    n-gram). NULL and blank texts have an empty set and link with nothing. ``component_id`` is
    the smallest key of the row's component; repeated rows are copies of each other. A row
    with a NULL key keeps its size and has no component.
    """
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sets = written(described(docs, width, num, den, splits), "sets")
    rows = written(sets.drop("signatures"), "rows")
    known = rows.where("doc_id is not null and set_key is not null")
    shared = written(neighbours(sets.where("doc_id is not null").select(F.explode("signatures").alias("signature"), "set_key")), "shared")
    discard(sets)
    border = shared.where("edge").select("signature", "set_key")
    spans = border.groupBy("signature").agg(F.min("set_key").alias("centre"), F.max("set_key").alias("other")).where("centre < other").select("signature", "centre")
    border = written(border.join(spans, "signature"), "border")
    inner = shared.where("not edge").select("signature", "set_key", "centre")
    members = inner.union(border.select("signature", "set_key", "centre"))

    facts = known.join(small(written(members.select("set_key").distinct(), "candidates")), "set_key").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    facts = written(facts, "facts")

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        """Pairs (a, b) whose elements prove the link; only the texts of sets in pairs are read again."""
        pairs = written(pairs, label)
        wanted = pairs.select(F.col("a").alias("set_key")).union(pairs.select("b")).distinct()
        wanted = written(facts.join(wanted, "set_key", "left_semi").select("set_key", "doc_id"), "wanted")
        found = sets_of(docs.join(small(wanted.select("doc_id")), "doc_id", "left_semi"), width)
        elements = written(found.join(small(wanted.select("set_key")), "set_key", "left_semi").dropDuplicates(["set_key"]), "elements")
        one, two = (elements.select(F.col("set_key").alias(x), F.col("elements").alias(f"e{x}")) for x in ("a", "b"))
        joined = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("ea", "eb")))
        links = written(joined.where(F.col("common") * den >= (F.size("ea") + F.size("eb") - F.col("common")) * num).select("a", "b"), "links")
        discard(elements)
        return links

    stars = members.where("set_key <> centre").select(F.col("centre").alias("a"), F.col("set_key").alias("b")).distinct()
    near = stars.join(facts.alias("x"), F.col("a") == F.col("x.set_key")).join(facts.alias("y"), F.col("b") == F.col("y.set_key")).where(_may_link("x", "y", num, den)).select("a", "b")
    labels = written(components(verified(near, "near"), "first"), "labels")

    # Signatures that still hold several components: their pairs across components.
    placed = members.select("signature", "set_key").join(small(labels), F.col("set_key") == F.col("node"), "left").select("signature", "set_key", F.coalesce("root", "set_key").alias("label"))
    mixed = placed.groupBy("signature").agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("n"), F.sum(F.xxhash64("set_key").cast("decimal(38,0)")).alias("same")).where("l < h")
    mixed = mixed.groupBy("n", "same").agg(F.min("signature").alias("signature")).select("signature")
    open_sets = placed.join(small(written(mixed, "mixed")), "signature").join(facts.select("set_key", "n", "sketch"), "set_key")
    open_sets = written(open_sets, "open")
    left, right = open_sets.alias("x"), open_sets.alias("y")
    across = (F.col("x.signature") == F.col("y.signature")) & (F.col("x.set_key") < F.col("y.set_key")) & (F.col("x.label") != F.col("y.label"))
    more = left.join(right, across & _may_link("x", "y", num, den)).select(F.col("x.set_key").alias("a"), F.col("y.set_key").alias("b")).distinct()
    joined = reduce(DataFrame.union, [labels.select(F.col("node").alias("a"), F.col("root").alias("b")), verified(more, "more")])
    labels = written(components(joined, "last"), "classes")

    own = rows.select("doc_id", "n_shingles", "set_key").join(small(labels), F.col("set_key") == F.col("node"), "left")
    own = own.select("doc_id", "n_shingles", F.coalesce("root", "set_key").alias("class"))
    least = own.where("doc_id is not null and class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    # Written, so that the join has a shuffle of its own, whose hot classes can be split.
    return own.join(written(least, "least"), "class", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, splits: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that have the smallest key of their component, with all columns.

    Of rows that are equal in key and text one stays. Rows are told apart by key alone, so rows
    of one key with different texts stay or go together; rows with a NULL key all stay.
    """
    found = written(jaccard_components(docs, width, num, den, splits, key, text), "components")
    gone_key, again_key = unused(docs, "gone", "again")
    removed = written(found.where("component_id <> doc_id").select(F.col("doc_id").alias(gone_key)).distinct(), "removed")
    again = written(found.where("doc_id is not null").groupBy(F.col("doc_id").alias(again_key)).agg(F.count("*").alias("n")).where("n > 1").select(again_key), "again")
    left = docs.join(small(removed), F.col(key) == F.col(gone_key), "left_anti")
    repeated = left.join(small(again), F.col(key) == F.col(again_key), "left_semi").dropDuplicates([key, text])
    return left.join(small(again), F.col(key) == F.col(again_key), "left_anti").union(repeated)
