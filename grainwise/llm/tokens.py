"""Words and their 64-bit hashes for whole columns of text, on Arrow buffers with NumPy.

Text is UTF-8 in one buffer; a word is a maximal run of bytes that are not separators. All
separators are ASCII, so a multi-byte character is never cut. A-Z hashes like a-z. Equal
words have equal hashes; different words collide with a chance of 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
_UNIT = np.uint64(0x9E3779B97F4A7C15)

SPACES = np.zeros(256, dtype=bool)
SPACES[[32, *range(9, 14)]] = True
#: Everything in ASCII that is neither letter nor digit.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_LOWER = np.arange(256)
_LOWER[65:91] += 32
EXACT_VALUES = np.random.RandomState(20).randint(1, 2**63 - 1, size=256, dtype=np.int64).astype(np.uint64)
_VALUES = EXACT_VALUES[_LOWER]
_BASE = np.uint64(0xD6E8FEB86659FD93)
_powers = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        factors = np.full(max(n, 256), _BASE, dtype=np.uint64)
        factors[0] = 1
        _powers = np.cumprod(factors, dtype=np.uint64)
    return _powers


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the rows' offsets in them; NULL counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if not len(offsets) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, cut_marks: bool = False, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, first byte of each word, the rows' offsets in the words).

    With ``cut_marks`` the punctuation at a word's end, after an ASCII letter or digit, is a
    word of its own, unless it begins with a bar as the end of a special token does. With
    ``exact`` case counts.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    blank = separators[data]
    begins = np.empty(len(data), dtype=bool)
    begins[0] = True
    begins[1:] = blank[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins &= ~blank
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, np.zeros(len(offsets), np.int64)
    if cut_marks:
        plain = ~MARKS[data]
        last = np.maximum.reduceat(np.where(plain, np.arange(len(data)), -1), starts)
        last = last[(last >= 0) & (last < len(data) - 1)]
        last = last[(data[last] < 128) & ~blank[last + 1] & ~begins[last + 1] & (data[last + 1] != ord("|"))]
        begins[last + 1] = True
        starts = np.flatnonzero(begins)
    values = (EXACT_VALUES if exact else _VALUES)[data]
    values[blank] = 0
    lengths = np.diff(np.append(starts, len(data)))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    values[starts[0] :] *= powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(values, starts)), starts, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, offsets: np.ndarray, width: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each row; fewer words than ``width`` count as one shingle."""
    n = max(0, len(hashes) - width + 1)
    rolled = np.zeros(n, dtype=np.uint64)
    factors = mix(np.arange(1, width + 1).astype(np.uint64) * _UNIT) | np.uint64(1)
    for i in range(width):
        rolled += hashes[i : i + n] * factors[i]
    rolled = mix(rolled)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            out.append(mix(np.array([np.sum(hashes[a:b] * factors[: b - a], dtype=np.uint64) + np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows in runs of about ``limit`` bytes of text each; a longer text is a run of its own."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(batch.schema.get_field_index(text)))
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
            yield batch.slice(a, b - a)
            a = b


def lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A list column from one array per row."""
    ends = np.cumsum([0, *(len(x) for x in rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat, type=kind))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
