"""Exact top-k inner products with vector-approximation files.

Candidates are cut into slices of bounded size. A slice holds, beside the exact vectors, a
vector-approximation file: every component replaced by the number of its cell on a grid of
``CELLS`` equal cells per dimension. A scan of the cells gives a lower and an upper bound of
each inner product; exact vectors are then read in the order of their bounds until the k-th
best exact score is above every bound left. Integers only, so bounds and scores are exact.

Queries are a stated set against all rows: blocks of queries meet every slice once, both
bounded, so no task sees an unbounded group. The best of each slice are merged by rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainwise.llm.tables import written

SLICE_ROWS = 8192
BLOCK_QUERIES = 256
CELLS = 64
READ_AT_ONCE = 32
_SLICE = "slice long, dim int, ids binary, exact binary, cells binary, low binary, width binary"
_FOUND = "query_id long, variant long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; vectors with a NULL or non-finite one are left out."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
    return rows.select(F.col(key).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * F.lit(float(scale))).cast("long")).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pack the rows (vec_id, v) of a partition into slices with their approximation files."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes):
            own = batch.filter(pa.array(sizes == dim))
            for a in range(0, own.num_rows, SLICE_ROWS):
                part = own.slice(a, SLICE_ROWS)
                exact = _matrix(part.column(1), int(dim)) if dim else np.zeros((part.num_rows, 0), np.int64)
                low = exact.min(axis=0)
                width = -(-(exact.max(axis=0) - low + 1) // CELLS)
                cells = ((exact - low) // width).astype(np.uint8)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                row = [number, int(dim), ids.tobytes(), exact.tobytes(), cells.tobytes(), low.tobytes(), width.tobytes()]
                yield pa.RecordBatch.from_pylist([dict(zip([x.split()[0] for x in _SLICE.split(", ")], row, strict=True))], schema=pa.schema([("slice", pa.int64()), ("dim", pa.int32()), *((n, pa.binary()) for n in ("ids", "exact", "cells", "low", "width"))]))
                number += 1


def best_of_slice(queries: np.ndarray, own: np.ndarray, ids: np.ndarray, exact: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, scores) of each query's best candidates in one slice, own id left out."""
    reach = int(np.abs(exact).max(initial=1)) * int(np.abs(queries).max(initial=1)) * max(1, exact.shape[1])
    kind = np.float64 if reach < 2**52 else np.int64  # doubles hold these integers exactly
    corner = (low + cells.astype(np.int64) * width).astype(kind)
    q = queries.astype(kind)
    base = q @ corner.T
    above = np.maximum(q, 0) @ (width - 1).astype(kind)
    below = np.minimum(q, 0) @ (width - 1).astype(kind)
    out = []
    for i in range(len(q)):
        others = np.flatnonzero(ids != own[i])
        order = others
        if len(others) > k:
            floor_of_kth = np.partition(base[i][others], len(others) - k)[len(others) - k] + below[i]
            order = others[base[i][others] + above[i] >= floor_of_kth]
        order = order[np.argsort(-base[i][order], kind="stable")]
        read, scores = order[:0], np.zeros(0, np.int64)
        for a in range(0, len(order), READ_AT_ONCE):
            if len(scores) >= k and scores[k - 1] > base[i][order[a]] + above[i]:
                break  # nothing further on can reach the k-th score
            more = order[a : a + READ_AT_ONCE]
            scores = np.append(scores, exact[more] @ queries[i])
            read = np.append(read, more)
            first = np.lexsort((ids[read], -scores))[:k]
            read, scores = read[first], scores[first]
        out.append((read, scores))
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows of each query row, ties to the smaller id.

    ``is_query`` is a condition on ``key``. Vectors that are NULL or hold NULL or non-finite
    components, and rows with a NULL key, take no part. Vectors are compared with those of
    the same length only. Repeated query rows are one query; repeated candidates count each;
    rows of the query's own id are left out. With fewer than k candidates all are returned.
    Scores are longs; components beyond 2**31 / scale in size are not supported.
    """
    rows = written(integer_vectors(vectors, key, vector, scale), "vectors")
    queries = rows.where(is_query).distinct()
    blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")
    asked = queries.groupBy(block.alias("block"), F.size("v").alias("dim")).agg(F.collect_list(F.struct("vec_id", F.xxhash64("v").alias("variant"), "v")).alias("asked"))
    cut = rows.mapInArrow(slices, _SLICE).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                own = np.array([x["vec_id"] for x in r["asked"]])
                q = np.array([x["v"] for x in r["asked"]], dtype=np.int64).reshape(-1, dim)
                ids, exact, low, width = (np.frombuffer(r[n], dtype=np.int64) for n in ("ids", "exact", "low", "width"))
                cells = np.frombuffer(r["cells"], dtype=np.uint8).reshape(-1, dim)
                found = best_of_slice(q, own, ids, exact.reshape(-1, dim), cells, low, width, k)
                n = [len(x) for x, _ in found]
                variant = np.array([x["variant"] for x in r["asked"]])
                columns = np.repeat(own, n), np.repeat(variant, n), ids[np.concatenate([x for x, _ in found])], np.concatenate([s for _, s in found])
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["query_id", "variant", "vec_id", "score"])

    found = cut.join(asked, ["block", "dim"]).mapInArrow(search, _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id", "variant").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
