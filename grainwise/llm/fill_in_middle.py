"""Fill-in-middle texts whose cuts are found from remembered chunks.

A rolling hash over the last ``REACH`` bytes cuts a text into chunks wherever it ends in
``BITS`` zero bits, so a passage is cut alike in every document that holds it, but for the
chunks at its ends. What a task needs to know of a chunk is remembered under the chunk's own
bytes, hence a summary is used only where the whole content is the same: its characters, where
those begin, whether a sentinel is in it, and the bytes at its two ends that could be half
of one. Combining the chunks' counts gives a document's characters and the chunk that holds
a cut; the chunk's summary gives the byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.llm import tokens

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
#: Bytes that the rolling hash sees, zero bits at a boundary, and the least and most bytes of a chunk.
REACH, BITS, LEAST, LONGEST = 32, 10, 64, 16_384
#: Bytes of chunks that a task remembers; beyond, it begins anew.
CACHE_BYTES = 32 << 20
#: Shares, in percent, of texts that are moved and, of those, of the suffix-first form.
MOVED, SUFFIX_FIRST = 90, 20
SCHEMA = "n long, form string, prefix_chars long, middle_chars long, output string"
_GEAR = np.random.RandomState(13).randint(0, 1 << 32, size=256, dtype=np.uint64).astype(np.uint32)


@dataclass(frozen=True)
class Summary:
    characters: int
    begins: np.ndarray | None  # byte of each character, None if every byte is one
    marked: bool  # holds a sentinel
    head: bytes
    tail: bytes

    @classmethod
    def of(cls, chunk: bytes) -> Summary:
        plain = chunk.isascii()
        begins = None if plain else np.flatnonzero((np.frombuffer(chunk, np.uint8) & 0xC0) != 0x80).astype(np.uint16)
        marked = any(s in chunk for s in SENTINELS)
        return cls(len(chunk) if plain else len(begins), begins, marked, chunk[:2], chunk[-2:])

    def byte_of(self, character: int) -> int:
        return character if self.begins is None else int(self.begins[character])


def boundaries(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Ends of the chunks of each row, from the row's first byte; chunks hold whole characters.

    The hash of a byte and the ones before it is made by doubling its reach five times. The
    first ``REACH`` bytes of a row see bytes of the row before, so no chunk ends there. All chunks
    but the last have ``LEAST`` bytes, so a sentinel lies in two chunks at most.
    """
    rolled = _GEAR[data]
    step = 1
    while step < REACH:
        rolled[step:] += rolled[:-step] << np.uint32(step)
        step *= 2
    after = np.flatnonzero(rolled >> np.uint32(32 - BITS) == 0) + 1
    after = after[after < len(data)]
    after = after[(data[after] & 0xC0) != 0x80]
    out, at = [], np.searchsorted(after, offsets)
    for r, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        own = after[at[r] : at[r + 1]]
        ends, last = [], a
        for end in [*own[(own > a + REACH) & (own < b)].tolist(), b]:
            if end - last < LEAST and end < b:
                continue
            while end - last > LONGEST:
                last += min(LONGEST, (end - last) // 2)
                while data[last] & 0xC0 == 0x80:
                    last -= 1
                ends.append(last - a)
            if end > last:
                ends.append(end - a)
                last = end
        out.append(np.array(ends, np.int64))
    return out


class ChunkCache:
    """Summaries by content; a dictionary compares whole keys, so equal hashes alone never match."""

    def __init__(self, most: int = CACHE_BYTES):
        self.known: dict[bytes, Summary] = {}
        self.held, self.most, self.hits, self.misses = 0, most, 0, 0

    def __call__(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is not None:
            self.hits += 1
            return found
        self.misses += 1
        found = Summary.of(chunk)
        cost = len(chunk) + (0 if found.begins is None else found.begins.nbytes) + 200
        if self.held + cost > self.most:
            self.known, self.held = {}, 0
        self.known[chunk] = found
        self.held += cost
        return found


@dataclass(frozen=True)
class Measured:
    """A text's characters and what finds the byte where one begins."""

    characters: int
    marked: bool
    counts: np.ndarray  # characters before each chunk
    starts: list[int]  # bytes before each chunk
    parts: list[Summary]
    size: int

    @classmethod
    def of(cls, text: bytes, ends: np.ndarray, summary: ChunkCache) -> Measured:
        starts = [0, *ends.tolist()]
        parts = [summary(text[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        counts = np.cumsum([0, *(p.characters for p in parts)])
        marked = any(p.marked for p in parts) or any(s in x.tail + y.head for x, y in zip(parts[:-1], parts[1:], strict=True) for s in SENTINELS)
        return cls(int(counts[-1]), marked, counts[:-1], starts[:-1], parts, len(text))

    def byte_of(self, character: int) -> int:
        if character >= self.characters:
            return self.size
        k = int(np.searchsorted(self.counts, character, side="right")) - 1
        return self.starts[k] + self.parts[k].byte_of(character - int(self.counts[k]))


def draws(seed: str, key) -> tuple[int, int, int, int]:
    """Four whole numbers below 2**32 from the seed and the key; a NULL key is the empty text."""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return int(h[:8], 16), int(h[8:16], 16), int(h[16:24], 16), int(h[24:32], 16)


def moved(text: bytes, measured: Measured, numbers: tuple[int, int, int, int]) -> tuple[str, int | None, int | None, bytes]:
    """(form, characters of the prefix, of the middle, output) of a text."""
    n = measured.characters
    if not n or measured.marked or numbers[2] % 100 >= MOVED:
        return "plain", None, None, text
    first, second = sorted((numbers[0] % (n + 1), numbers[1] % (n + 1)))
    a, b = measured.byte_of(first), measured.byte_of(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if numbers[3] % 100 < SUFFIX_FIRST:
        return "spm", first, second - first, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return "psm", first, second - first, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def transform(docs: DataFrame, seed: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output) of each row.

    ``n`` is the text's characters. Texts that are empty or hold a sentinel, and a share of the
    others, are ``plain``: the output is the text and the two counts are NULL. Else the output is
    ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle), each part behind its sentinel.
    NULL text is empty. The draws depend on seed and key alone: repeated rows come out alike, rows with a
    NULL key share the draws of an empty key. Other columns are not read; there is no
    shuffle, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        summary = ChunkCache()
        for piece in tokens.pieces(batches, "text"):
            data, offsets = tokens.text_buffer(piece.column(1))
            rows = []
            for doc, a, b, ends in zip(piece.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), boundaries(data, offsets), strict=True):
                body = data[a:b].tobytes()
                measured = Measured.of(body, ends, summary)
                rows.append((measured.characters, *moved(body, measured, draws(seed, doc))))
            n, form, prefix, middle, output = zip(*rows, strict=True)
            counts = [pa.array(x, pa.int64()) for x in (n, prefix, middle)]
            texts = pa.array(output, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([piece.column(0), counts[0], pa.array(form, pa.string()), *counts[1:], texts], names=["key", *(x.split()[0] for x in SCHEMA.split(", "))])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of ``transform`` was made of; texts that were moved hold no sentinel of their own."""
    part = F.split(output, "<[PSM]>")
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "plain", output).when(form == "psm", psm).when(form == "spm", spm)
