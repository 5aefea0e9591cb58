"""Sum-of-squares packing of tokenised documents into fixed windows.

Each task packs the documents of its own input partition in their order. The array
``count[level]`` holds how many open windows are filled up to each level. A document, or the
rest of one after its whole windows are cut off, goes to the level that makes the sum of
``count[level] ** 2`` smallest (a new window is one of the choices). At most ``most_open``
windows stay open: beyond, and at the end of the partition, the open windows are joined in
order of their fill and cut into whole windows. The last rest of a partition is cut into
pieces of 1024, 512, ... tokens: a sequence whose length is a power of two takes no padding.
Tasks share nothing, so the work and the padding do not depend on a driver or on one task,
and a task that is run again reads the same rows in the same order and gives the same result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm import tokens
from grainwise.llm.toxicity import present

WINDOW = 2048
PIECE_BYTES = 4 << 20
#: Words kept with their ids by one task.
CACHE_WORDS = 600_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordEncoder:
    """Ids of whole texts, encoding each distinct word once.

    Right for tokenizers that drop white space and join neither words across it nor a letter or
    digit with punctuation after it. Punctuation at the end of a word therefore counts as a
    word. Distinct words are encoded in runs, set apart by a digit that is a token of its own.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        (self.mark,) = self.model.encode("0", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes, and the words' places in the arrays below
        self.ids, self.begin, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode(self, texts: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order in which the words come, all their ids, number of ids of each word in that order)."""
        odd = [i for i, x in enumerate(texts) if b"0" in x or b"<|" in x]
        apart = set(odd)
        plain = [i for i in range(len(texts)) if i not in apart] if odd else list(range(len(texts)))
        ids, sizes = [], []
        for a in range(0, len(plain), 1000):  # a run's encodings go before the next run's come
            run = plain[a : a + 1000]
            (found,) = self.model.encode_batch_fast([b" 0 ".join([texts[i] for i in run]).decode()], add_special_tokens=False)
            part = np.array(found.ids, dtype=np.uint32)
            cut = part == self.mark
            size = np.diff(np.concatenate([[-1], np.flatnonzero(cut), [len(part)]])) - 1
            if len(size) != len(run):
                raise ValueError("the separator is not a token of its own in this vocabulary")
            ids.append(part[~cut])
            sizes.append(size)
        for i in odd:
            (found,) = self.model.encode_batch_fast([texts[i].decode()], add_special_tokens=False)
            ids.append(np.array(found.ids, dtype=np.uint32))
            sizes.append(np.array([len(ids[-1])]))
        return plain + odd, np.concatenate(ids), np.concatenate(sizes)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each row."""
        parts, firsts, ends = [], [], []
        a, rows = 0, len(offsets) - 1
        word_at = [np.zeros(1, np.int64)]
        while a < rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + tokens.CHUNK_BYTES, side="right")) - 1)
            h, s, o = tokens.words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], cut_marks=True)
            parts.append(h)
            firsts.append(s + offsets[a])
            ends.append(np.minimum(np.append(s[1:], offsets[b] - offsets[a]), np.repeat(offsets[a + 1 : b + 1] - offsets[a], np.diff(o))) + offsets[a])
            word_at.append(o[1:] + word_at[-1][-1])
            a = b
        hashes, first, end, word_at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parts, firsts, ends, word_at))
        if not len(hashes):
            return [np.zeros(0, np.uint32)] * rows
        if len(self.known) > CACHE_WORDS:
            self.forget()
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, unique)
        new = np.flatnonzero(present(unique, self.known) < 0)
        if len(new):
            raw = data.tobytes()
            begin, stop = first[where[new]].tolist(), end[where[new]].tolist()
            order, ids, size = self._encode([raw[a:b].rstrip(b" \t\n\r\x0b\x0c") for a, b in zip(begin, stop, strict=True)])
            self.begin = np.append(self.begin, len(self.ids) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.ids = np.append(self.ids, ids)
            place = np.empty(len(new), np.int64)
            place[order] = len(self.known) + np.arange(len(new))
            self.known, self.place = np.insert(self.known, at[new], unique[new]), np.insert(self.place, at[new], place)
        index = self.place[np.searchsorted(self.known, unique)][inverse]
        size = self.size[index]
        ends_at = np.cumsum(size)
        flat = self.ids[np.arange(ends_at[-1]) + np.repeat(self.begin[index] - ends_at + size, size)]
        cuts = np.append(0, ends_at)[word_at]
        return [flat[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]


class Packer:
    """Open windows of one task. Pieces are (doc_id, start, ids, tokens of the document)."""

    def __init__(self, window: int, most_open: int, first_sequence: int):
        self.window, self.most_open, self.sequence = window, most_open, first_sequence
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list[tuple]]] = [[] for _ in range(window + 1)]
        self.opened = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, dtype="<u4")), total, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        whole = n - n % w
        for a in range(0, whole, w):
            self.close([(doc, a, ids[a : a + w], n)])
        size = n - whole
        if not size:
            return
        # Change of the sum of squares: level h loses one window and h + size gains one.
        change = 2 * (self.count[size:] - self.count[: w + 1 - size] + 1)
        change[-1] = 1 - 2 * self.count[w - size]  # a full window counts no more
        change[self.count[: w + 1 - size] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * self.count[size] + 1
        level = int(len(change) - 1 - np.argmin(change[::-1]))  # ties: the fullest window
        if level:
            pieces = self.open[level].pop()
            self.count[level] -= 1
            self.opened -= 1
        else:
            pieces = []
        pieces.append((doc, whole, ids[whole:].copy(), n))
        if level + size == w:
            self.close(pieces)
        else:
            self.open[level + size].append(pieces)
            self.count[level + size] += 1
            self.opened += 1
            if self.opened > self.most_open:
                self.join(last=False)

    def join(self, last: bool) -> None:
        """Join the open windows and cut whole ones; the rest stays open or ends as powers of two."""
        pieces = [p for level in reversed(self.open) for window in level for p in window]
        self.count[:] = 0
        self.open = [[] for _ in range(self.window + 1)]
        self.opened = 0
        left = sum(len(p[2]) for p in pieces)
        at = 0
        while at < len(pieces):
            target = self.window if left >= self.window or not last else 1 << (left.bit_length() - 1)
            taken, room = [], min(target, left)
            while room:
                doc, start, ids, total = pieces[at]
                k = min(room, len(ids))
                taken.append((doc, start, ids[:k], total))
                room -= k
                left -= k
                if k == len(ids):
                    at += 1
                else:
                    pieces[at] = (doc, start + k, ids[k:], total)
            size = sum(len(p[2]) for p in taken)
            if size == self.window or last:
                self.close(taken)
            else:
                self.open[size].append(taken)
                self.count[size] += 1
                self.opened += 1

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = 1, most_open: int = 512) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    ``tokenizer`` is the path of a vocabulary file that every machine has. A document is its
    ids and ``end_id``; NULL text is empty, so every row has at least one piece. Repeated rows
    are packed once each, rows with a NULL key too. Extra columns are not read. An empty table
    gives no rows. Sequence ids are the partition's number times 2**32 plus a counter.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        encode = WordEncoder(tokenizer)
        packer = Packer(window, most_open, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], dtype=np.uint32)
        for piece in tokens.pieces(batches, text, PIECE_BYTES):
            ids = encode(*tokens.text_buffer(piece.column(1)))
            for doc, found in zip(piece.column(0).to_pylist(), ids, strict=True):
                packer.add(doc, np.concatenate([found, end]))
            yield packer.taken()
        packer.join(last=True)
        yield packer.taken()

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias(text)).mapInArrow(run, SCHEMA)
