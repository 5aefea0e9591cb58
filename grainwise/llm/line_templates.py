"""Recurring line templates, found with a fixed-depth parse tree, and their removal.

A line's path in the tree is its token count and its first ``DEPTH`` tokens; a token that
holds a digit stands for a variable field. Below that path a template is all tokens but one of
``FIELDS`` consecutive runs, whose place is a wildcard. Two lines thus fall under one template
if they agree outside one variable run; shorter lines must agree in all tokens but the
digit-bearing ones. Templates are keys that do not depend on the order of arrival, so the tree
needs no task that sees a whole leaf: counting is one partially aggregated shuffle.

The ``wide`` rule, which the query and the pipeline use, finds more: a
template has any two of ``FINE`` runs open, so the variable words may stand apart but still are
a quarter of the line at most, and lines of ``LEAST_SHORT`` tokens on have up to two open
places of their own. As little is fixed in those, such a template must also hold at least
``SHORT_LINES`` lines and half of the lines of its leaf.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainwise.llm import tokens
from grainwise.llm.tables import unused, written

DEPTH = 2
FIELDS = 4
#: Shorter lines have no variable run: a quarter of them would be their meaning.
LEAST_TOKENS = 8
#: Of the wide rule: runs of which two are open, and for shorter lines the least tokens, the share that is fixed, and lines under a template.
FINE = 8
LEAST_SHORT, SHORT_FIXED, SHORT_LINES, SHORT_SHARE = 4, 0.6, 3, 0.5
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[9, 10, 13, 32]] = True
DIGITS = np.array([48 <= b < 58 for b in range(256)])
_UNIT = np.uint64(0x9E3779B97F4A7C15)


def placed_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, line number, first token, tokens) of all lines with tokens, and running sums of the tokens' hashes with their places."""
    h, starts, at = tokens.words(data, offsets, BLANKS, exact=True)
    none = np.zeros(0, np.int64)
    if not len(h):
        return none, none, none, none, np.zeros(1, np.uint64)
    variable, _, _ = tokens.words(np.frombuffer(b"<*>", np.uint8), np.array([0, 3]), BLANKS, exact=True)
    numbered = np.add.reduceat(DIGITS[data].astype(np.int32), starts) > 0
    h = np.where(numbered, variable[0], h)
    breaks = np.flatnonzero(data == 10)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[:-1])[row]
    first = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(line) != 0)))
    n = np.diff(np.append(first, len(h)))
    place = np.arange(len(h)) - np.repeat(first, n)
    total = np.append(np.uint64(0), np.cumsum(tokens.mix(h + place.astype(np.uint64) * _UNIT), dtype=np.uint64))
    return row[first], line[first], first, n, total


def line_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, line number, template, templates of the line before it) of all lines with tokens, flat.

    A line's tokens are hashed with their places; a template is the sum over the tokens that
    it fixes, so all of a line's templates come from running sums.
    """
    row, line, first, n, total = placed_lines(data, offsets)
    whole = total[first + n] - total[first]
    tag = n.astype(np.uint64) * np.uint64(2 * FIELDS + 1)
    keys = [tokens.mix(whole + tokens.mix(tag * _UNIT))]
    for j in range(FIELDS):
        a, b = (first + DEPTH + np.maximum(n - DEPTH, 0) * i // FIELDS for i in (j, j + 1))
        a, b = np.minimum(a, first + n), np.minimum(b, first + n)
        keys.append(tokens.mix(whole - (total[b] - total[a]) + tokens.mix((tag + np.uint64(j + 1)) * _UNIT)))
    used = np.column_stack([np.ones(len(n), bool), *[n >= LEAST_TOKENS] * FIELDS])
    count = used.sum(axis=1)
    return row, line, np.column_stack(keys)[used], np.cumsum(count) - count


def line_parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, line number, tokens, whole line, leaf, parts) of all lines with tokens.

    The parts of a line that is long enough are the hashes of its ``FINE`` runs, those of a shorter one its
    tokens' hashes; in both cases an array of ``FINE`` columns. The leaf is the token count and the leading tokens.
    """
    row, line, first, n, total = placed_lines(data, offsets)
    size = n.astype(np.uint64) * _UNIT
    lead = total[first + np.minimum(n, DEPTH)] - total[first]
    long = n >= LEAST_TOKENS
    parts = []
    for j in range(FINE):
        a, b = (first + DEPTH + np.maximum(n - DEPTH, 0) * i // FINE for i in (j, j + 1))
        a, b = np.where(long, a, np.minimum(first + j, first + n)), np.where(long, b, np.minimum(first + j + 1, first + n))
        parts.append(total[b] - total[a])
    return row, line, n, tokens.mix(total[first + n] - total[first] + size), tokens.mix(lead + size), np.column_stack(parts)


def templates(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(__doc, __same, line_no, templates) of every line with tokens; __same tells texts of one key apart."""

    def run(batches: Iterator[pa.RecordBatch]):
        for piece in tokens.pieces(batches, "__text"):
            row, line, found, begin = line_keys(*tokens.text_buffer(piece.column(2)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(found)).astype(np.int32)), pa.array(tokens.signed(found)))
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(row)), piece.column(1).take(pa.array(row)), pa.array(line.astype(np.int32)), lists], names=["__doc", "__same", "line_no", "templates"])

    named = docs.select(F.col(key).alias("__doc"), F.xxhash64(text).alias("__same"), F.col(text).alias("__text")).where("__doc is not null")
    return named.mapInArrow(run, f"__doc {docs.schema[key].dataType.simpleString()}, __same long, line_no int, templates array<long>")


PARTS = [f"part{j}" for j in range(FINE)]
THIRDS = [PARTS[:3], PARTS[3:6], PARTS[6:]]


def parted_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(__doc, __same, line_no, n, whole, leaf, parts) of every line with tokens."""

    def run(batches: Iterator[pa.RecordBatch]):
        for piece in tokens.pieces(batches, "__text"):
            row, line, n, whole, leaf, parts = line_parts(*tokens.text_buffer(piece.column(2)))
            own = [piece.column(i).take(pa.array(row)) for i in (0, 1)]
            hashes = [pa.array(tokens.signed(np.ascontiguousarray(x))) for x in (whole, leaf, *parts.T)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(line.astype(np.int32)), pa.array(n.astype(np.int32)), *hashes], names=["__doc", "__same", "line_no", "n", "whole", "leaf", *PARTS])

    named = docs.select(F.col(key).alias("__doc"), F.xxhash64(text).alias("__same"), F.col(text).alias("__text")).where("__doc is not null")
    return named.mapInArrow(run, f"__doc {docs.schema[key].dataType.simpleString()}, __same long, line_no int, n int, whole long, leaf long, {', '.join(f'{p} long' for p in PARTS)}")


def opened(size: int | None) -> Column:
    """Templates of a line: the hash of its leaf and of its parts but the open ones. For lines of ``size`` tokens, or of many if None."""
    if size is None:
        places = list(combinations(range(FINE), 2))
        kept = [[p for j, p in enumerate(PARTS) if j not in gap] for gap in places]
    else:
        places = list(combinations(range(DEPTH, size), min(2, int(size * (1 - SHORT_FIXED) + 1e-9))))
        kept = [[PARTS[j] for j in range(DEPTH, size) if j not in gap] for gap in places]
    return F.array(*(F.xxhash64(F.lit(sum(1 << j for j in gap)), "leaf", *own) for gap, own in zip(places, kept, strict=True)))


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", wide: bool = False) -> DataFrame:
    """(__doc, __same, __lines): numbers of the lines whose template occurs in a document of a smaller key."""
    if wide:
        return wide_repeated_lines(docs, key, text)
    rows = written(templates(docs, key, text), "lines").select("__doc", "__same", "line_no", F.explode("templates").alias("template"))
    recurring = rows.groupBy("template").agg(F.min("__doc").alias("first"), F.max("__doc").alias("last")).where("first < last").select("template", "first")
    # A shuffle join at every size; adaptive execution splits the templates of hot lines.
    found = rows.join(written(recurring, "templates"), "template").where("__doc > first")
    return found.groupBy("__doc", "__same").agg(F.array_sort(F.collect_set("line_no")).alias("__lines"))


def alike(df: DataFrame, label: str) -> DataFrame:
    """A written table to join with by a shuffle at every size, as all of them grow with the lines; adaptive execution splits hot keys."""
    return written(df, label).hint("merge")


def wide_repeated_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The same by the wide rule.

    Equal lines are counted first, so what follows works on different lines, each with the first
    and last document that has it. A line's later copies go with the whole line; for the
    templates only its first document matters, and only in leaves where lines begin in
    different documents. A line goes from every document after the first one of any of its
    templates.
    """
    lines = written(parted_lines(docs, key, text), "lines")
    once = ["n", "leaf", *PARTS]
    different = lines.groupBy("whole").agg(F.min("__doc").alias("first"), F.max("__doc").alias("last"), F.count("*").alias("lines"), *(F.first(c).alias(c) for c in once))
    different = written(different, "different")
    many = different.where(F.col("n") >= LEAST_TOKENS)
    keyed = many.select("whole", "first", F.explode(F.array(*(F.xxhash64(F.lit(g), "leaf", *own) for g, own in enumerate(THIRDS)))).alias("agreed"))
    agreed = keyed.groupBy("agreed").agg(F.min("first").alias("low"), F.max("first").alias("high")).where("low < high").select("agreed")
    near = keyed.join(alike(agreed, "agreed"), "agreed", "left_semi").select("whole").distinct()
    few = different.where(F.col("n").between(LEAST_SHORT, LEAST_TOKENS - 1))
    leaves = few.groupBy("leaf").agg(F.min("first").alias("low"), F.max("first").alias("high"), F.sum("lines").alias("leaf_lines")).where("low < high").select("leaf", "leaf_lines")
    many = many.join(alike(near, "near"), "whole", "left_semi").withColumn("leaf_lines", F.lit(None).cast("long"))
    open_lines = written(many.unionByName(few.join(alike(leaves, "leaves"), "leaf")), "open")
    by_size = F.when(F.col("n") >= LEAST_TOKENS, opened(None))
    for size in range(LEAST_SHORT, LEAST_TOKENS):
        by_size = by_size.when(F.col("n") == size, opened(size))
    rows = open_lines.select("whole", "first", "lines", "leaf_lines", (F.col("n") < LEAST_TOKENS).alias("short"), F.explode(by_size).alias("template"))
    counted = rows.groupBy("template").agg(F.min("first").alias("low"), F.max("first").alias("high"), F.sum("lines").alias("lines"), F.first("leaf_lines").alias("leaf_lines"), F.first("short").alias("short"))
    ruling = counted.where("low < high").where(~F.col("short") | ((F.col("lines") >= SHORT_LINES) & (F.col("lines") >= SHORT_SHARE * F.col("leaf_lines"))))
    earlier = rows.select("whole", "first", "template").join(alike(ruling.select("template", "low"), "templates"), "template").where("low < first").groupBy("whole").agg(F.min("low").alias("low"))
    since = different.select("whole", "first", "last").join(alike(earlier, "earlier"), "whole", "left").select("whole", "last", F.coalesce("low", "first").alias("since")).where("since < last")
    found = lines.select("__doc", "__same", "line_no", "whole").join(alike(since.select("whole", "since"), "since"), "whole").where("__doc > since")
    return found.groupBy("__doc", "__same").agg(F.array_sort(F.collect_set("line_no")).alias("__lines"))


def drop_recurring(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars", wide: bool = False) -> DataFrame:
    """The documents without the lines whose template occurred in an earlier document.

    The document with the smallest key keeps a template's lines, all of them; others lose
    them. All rows and columns stay, ``length`` (if there is such a column) is set to the new
    number of characters, and ``n_dropped_lines`` is added or replaced. NULL text stays NULL, a document
    that loses all lines has empty text. Blank lines never count. Rows with a NULL key neither
    lose lines nor make others lose them; repeated rows are one document. With ``wide`` the
    templates are those of the wide rule.
    """
    doc, same, lines = unused(docs, "doc", "same", "lines")
    repeated = repeated_lines(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "key", "text", wide).toDF(doc, f"{same}2", lines)
    tagged = docs.withColumn(same, F.xxhash64(text))
    joined = tagged.join(repeated, (F.col(key) == F.col(doc)) & (F.col(same) == F.col(f"{same}2")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(lines, i)), "\n")
    whole = F.col(lines).isNull()
    out = joined.withColumn(text, F.when(whole, F.col(text)).otherwise(kept))
    if length in docs.columns:
        out = out.withColumn(length, F.when(whole, F.col(length)).otherwise(F.length(text).cast("long")))
    return out.withColumn("n_dropped_lines", F.when(whole, 0).otherwise(F.size(lines)).cast("long")).select(*(c for c in docs.columns if c != "n_dropped_lines"), "n_dropped_lines")
