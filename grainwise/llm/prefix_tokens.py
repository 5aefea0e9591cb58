"""SentencePiece ids of whole texts by a table of last tokens, and the way back from ids to text.

For merge-type (BPE) models every prefix of a text has its own encoding, and that encoding is
settled by its last token alone: the token t that ends at the prefix's end and is compatible
with the last token of the prefix before t, that is, merging the two tokens' characters gives
just these two tokens again. There is exactly one such t. So one table holds the last token of each prefix;
an automaton over all pieces lists the tokens that end at a position, the compatibility of two
tokens is found by merging their characters once and remembered, and the ids come from
following the table from the end. The work is linear in the text however long a word is, where
merging pair after pair is not.

No piece has a blank after another character (which is checked on loading), so merging
never goes across the beginning of a blank run. A text therefore is encoded in runs, each blanks
and the word after them, and a task encodes each different run once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainwise.llm import tokens

BLANK = "▁"
#: What an unknown id is decoded to.
UNKNOWN = " ⁇ ".encode()
#: Runs that a task remembers with their ids, and pairs of tokens with their compatibility; beyond, it begins anew.
CACHE_RUNS, CACHE_PAIRS = 600_000, 1_500_000
#: Longer runs, in bytes, are encoded each time they occur.
LONGEST_KEPT = 512
SCHEMA = "n_tokens long, ids array<int>, decoded string"


class PrefixTable:
    """Ids of character runs for one model.

    ``pieces`` has (characters, score, id) of all pieces that merging may make; ``spelled`` gives
    the ids of a character that is no piece.
    """

    def __init__(self, pieces: Sequence[tuple[str, float, int]], spelled):
        import ahocorasick

        self.score = {p: s for p, s, _ in pieces}
        self.id_of = {p: i for p, _, i in pieces}
        self.spelled = spelled
        self.text: list[str] = sorted(self.id_of)
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        # A token is its number in ``text`` times 2**16 plus its length.
        for k, p in enumerate(self.text):
            # a piece that its own characters don't merge to is never a token
            if self.merged(p) == [p]:
                self.automaton.add_word(p, k << 16 | len(p))
        self.automaton.make_automaton()

    def merged(self, characters: str) -> list[str]:
        """The tokens of a few characters by merging: the best score first, the leftmost of equals."""
        parts, score = list(characters), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: int, right: int) -> bool:
        a, b = self.text[left >> 16], self.text[right >> 16]
        found = self.merged(a + b) == [a, b]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[left << 32 | right] = found
        return found

    def last_tokens(self, run: str) -> list[int]:
        """The last token of each prefix; -1 for a prefix that ends in a character that is no piece."""
        last, done, known = [-1] * len(run), -1, self.pairs.get
        for end, token in self.automaton.iter(run):
            if end == done:
                continue
            before = end - (token & 0xFFFF)
            if before >= 0 and (left := last[before]) >= 0:
                fits = known(left << 32 | token)
                if not (self.compatible(left, token) if fits is None else fits):
                    continue
            last[end], done = token, end
        return last

    def encode(self, run: str) -> list[int]:
        last, out = self.last_tokens(run), []
        at = len(run) - 1
        while at >= 0:
            token = last[at]
            if token < 0:
                out.extend(reversed(self.spelled(run[at])))
                at -= 1
            else:
                out.append(self.id_of[self.text[token >> 16]])
                at -= token & 0xFFFF
        out.reverse()
        return out


class PieceModel:
    """A SentencePiece BPE model: texts to ids and back.

    Read from the model file are the pieces, their scores and kinds. The model must map
    characters to themselves and put a blank before a text, as its normaliser then says of a
    few texts on loading; unknown characters are spelled in bytes if it has them.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = [(model.is_control(i), model.is_unknown(i), model.is_byte(i), model.is_unused(i)) for i in range(model.get_piece_size())]
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        own = [(model.id_to_piece(i), model.get_score(i), i) for i, k in enumerate(kinds) if not any(k)]
        if any(BLANK in p.lstrip(BLANK) for p, _, _ in own) or [model.encode(x) for x in ("", "  ﬁ Å")] != [[], model.encode(BLANK + BLANK + "ﬁ" + BLANK + "Å")]:
            raise ValueError("only models whose blanks begin pieces and that keep texts as they are can be used")
        self.byte_ids = {int(model.id_to_piece(i)[3:5], 16): i for i, k in enumerate(kinds) if k[2]}
        self.table = PrefixTable(own, lambda c: [self.byte_ids[b] for b in c.encode()] if self.byte_ids else [self.unknown])
        self.bytes_of: list[bytes | None] = [None if k[2] else UNKNOWN if k[1] else b"" if k[0] else model.id_to_piece(i).replace(BLANK, " ").encode() for i, k in enumerate(kinds)]
        self.byte_at = {i: b for b, i in self.byte_ids.items()}
        self.control = {i for i, k in enumerate(kinds) if k[0]}
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat, self.first, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of each row, with the begin and end ids."""
        rows = len(offsets) - 1
        data, offsets = with_blanks(data, offsets)
        starts, at = runs(data, offsets)
        if len(self.known) > CACHE_RUNS:
            self.forget()
        lengths = np.diff(np.append(starts, len(data)))
        short = lengths <= LONGEST_KEPT
        hashes = run_hashes(data, starts, lengths, short)
        keys, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        keys = keys.tolist()
        raw = data.tobytes()
        index = np.empty(len(starts), np.int64)
        made, sizes = [], []

        def encoded(i: int) -> int:
            ids = self.table.encode(raw[starts[i] : starts[i] + lengths[i]].decode().replace(" ", BLANK))
            made.extend(ids)
            sizes.append(len(ids))
            return len(self.size) + len(sizes) - 1

        kept = np.flatnonzero(short)
        number = [self.known[k] if k in self.known else self.known.setdefault(k, encoded(i)) for k, i in zip(keys, kept[where].tolist(), strict=True)]
        index[kept] = np.array(number, np.int64)[inverse]
        for i in np.flatnonzero(~short).tolist():
            index[i] = encoded(i)
        if sizes:
            new = np.array(sizes, np.int64)
            self.first = np.append(self.first, len(self.flat) + np.cumsum(new) - new)
            self.size, self.flat = np.append(self.size, new), np.append(self.flat, np.array(made, np.int32))
        size = self.size[index]
        ends = np.cumsum(size)
        flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.first[index] - ends + size, size)]
        cuts = np.append(0, ends)[at]
        if len(made) and not short.all():
            self.forget()
        edge = [np.array([x], np.int32) for x in (self.begin, self.end)]
        return [np.concatenate([edge[0], flat[cuts[r] : cuts[r + 1]], edge[1]]) for r in range(rows)]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of any ids: control ids are empty, one blank at the beginning goes, byte runs that are no UTF-8 become U+FFFD a byte."""
        parts, spelled = [self.bytes_of[i] for i in ids], None in self.bytes_of
        if spelled and None in parts:
            out, run = [], []
            for i, part in zip([*ids, -1], [*parts, b""], strict=True):
                if part is None:
                    run.append(self.byte_at[i])
                elif run:
                    out.append(valid(bytes(run)))
                    run = []
                if part:
                    out.append(part)
            text = b"".join(out)
        else:
            text = b"".join(parts)
        opening = next((p for i, p in zip(ids, parts, strict=True) if i not in self.control), None)
        return (text[1:] if opening and opening[:1] == b" " and opening != UNKNOWN else text).decode()


def valid(run: bytes) -> bytes:
    """The characters of a run of bytes; each byte that is part of none becomes U+FFFD."""
    try:
        run.decode()
        return run
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                run[at : at + n].decode()
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 0
        n = min(n, len(run) - at)
        out.append(run[at : at + n] if n else "�".encode())
        at += n or 1
    return b"".join(out)


def with_blanks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a blank before each that isn't empty; the blank sign itself is a blank too."""
    texts = [bytes(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    sign = BLANK.encode()
    texts = [b" " + (t.replace(sign, b" ") if sign in t else t) if t else t for t in texts]
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte of each run of blanks and the word after it, the rows' offsets in the runs)."""
    blank = data == 32
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(begins)
    return starts, np.searchsorted(starts, offsets)


def run_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, short: np.ndarray) -> np.ndarray:
    """64-bit hashes of the short runs."""
    if not short.any():
        return np.zeros(0, np.uint64)
    place = np.arange(len(data)) - np.repeat(starts, lengths)
    values = tokens.EXACT_VALUES[data] * tokens.powers(LONGEST_KEPT)[np.minimum(place, LONGEST_KEPT - 1)]
    return tokens.mix(np.add.reduceat(values, starts)[short] + lengths[short].astype(np.uint64))


_models: dict[str, PieceModel] = {}


def loaded(path: str) -> PieceModel:
    """The model of a file, once per Python worker, with the runs it already knows."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", decoded: bool = True) -> DataFrame:
    """(key, n_tokens, ids) of each row, and with ``decoded`` the text that the ids stand for.

    ``model`` is the path of a model file that every machine has. NULL text is empty and has the
    begin and end ids alone; repeated rows and NULL keys are rows like others; other columns are not read. There is
    no shuffle; a task holds a megabyte of text at a time (a longer text is one piece) and the runs it knows.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        own = loaded(model)
        for piece in tokens.pieces(batches, "text"):
            ids = own.encode(*tokens.text_buffer(piece.column(1)))
            columns = [piece.column(0), pa.array([len(x) for x in ids], pa.int64()), tokens.lists(ids, pa.int32())]
            columns.append(pa.array([own.decode(x.tolist()) for x in ids] if decoded else [None] * len(ids), pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_tokens", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)


def digests(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of each row: ``encode`` as digests of the little-endian ids and of the decoded text.

    The ids and texts stay in the task that made them. Cases are those of ``encode``.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        own = loaded(model)
        for piece in tokens.pieces(batches, "text"):
            ids = own.encode(*tokens.text_buffer(piece.column(1)))
            found = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
            back = [hashlib.sha256(own.decode(x.tolist()).encode()).hexdigest() for x in ids]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array(found, pa.string()), pa.array(back, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)
