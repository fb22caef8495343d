"""Exact vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block: 4,096 vectors of 384 numbers are 12 MB.
BLOCK = 4096


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of length 1 in double; rows of zeros stay."""
    out = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1)


def _blocks(table: DataFrame, key: str, name: str) -> DataFrame:
    """Vectors of length 1 packed in blocks: ids and matrix, as binary columns of one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                yield pa.RecordBatch.from_pydict({f"{name}_ids": [part.column(0).to_numpy().astype(np.int64).tobytes()], f"{name}_rows": [_matrix(part.column(1)).tobytes()]})

    given = table.where("embedding IS NOT NULL").select(F.col(key).cast("long").alias("id"), "embedding")
    return given.mapInArrow(run, f"{name}_ids binary, {name}_rows binary")


#: Beyond what products of single precision are off, for vectors of length 1 (of some thousand numbers); and so many nodes in doubt a row are looked at one by one.
DOUBT, IN_DOUBT = 1e-4, 64


def top_pairs(q: np.ndarray, n: np.ndarray, names: np.ndarray, k: int, tile: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, column of n, cosine) of the k highest of each row, ties to the lower name. Products of single precision tell which may be among
    them, and those in double precision, to twelve digits, which are."""
    k, single, odd = min(k, len(n)), np.ascontiguousarray(n.astype(np.float32).T), bool(np.isnan(n).any())
    parts = []
    for start in range(0, len(q) if k else 0, tile):  # some rows at a time, which stay in the cache
        part = q[start : start + tile]
        rough = part.astype(np.float32) @ single
        # the highest of 64 shares of the columns: of k of them the least is not above the k-th highest of all
        best = rough[:, : len(n) // 64 * 64].reshape(len(part), -1, 64).max(1) if k <= 16 and len(n) >= 1024 else rough
        least = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k]
        maybe = rough >= (least - np.float32(DOUBT))[:, None]
        many = (np.count_nonzero(maybe, axis=1) > k + IN_DOUBT) | np.isnan(part).any(1) | odd
        if many.any():  # most of all where vectors are copies: all products in double precision
            at = np.flatnonzero(many)
            scores = np.round(part[at] @ n.T, 12)
            order = np.lexsort((np.broadcast_to(names, scores.shape), -scores), axis=1)[:, :k]
            parts.append((np.repeat(at + start, k), order.ravel(), np.take_along_axis(scores, order, 1).ravel()))
            maybe[many] = False
        rows, columns = np.divmod(np.flatnonzero(maybe), len(n))
        scores = np.round((part[rows] * n[columns]).sum(1), 12)
        order = np.lexsort((names[columns], -scores, rows))
        rows, columns, scores = rows[order], columns[order], scores[order]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        parts.append((rows[first] + start, columns[first], scores[first]))
    return tuple(np.concatenate([np.empty(0, t), *x]) for t, x in zip((np.int64, np.int64, float), zip(*parts, strict=True) if parts else ((), (), ()), strict=True))


def nearest(queries: DataFrame, nodes: DataFrame, k: int, key: str = "query_id") -> DataFrame:
    """The k nodes of highest cosine for each query: key, node_id, similarity, rank; ties go to the lower node_id.

    queries: key, embedding; nodes: node_id, embedding. Both are packed in blocks of BLOCK vectors, and each block of queries meets each block of
    nodes once, in a matrix product; a pair of blocks gives k rows a query. Which side is sent around is up to Spark, by their sizes; nothing
    passes the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_rows, n_ids, n_rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, names = np.frombuffer(q_ids, np.int64), np.frombuffer(n_ids, np.int64)
                rows, columns, scores = top_pairs(np.frombuffer(q_rows).reshape(len(ids), -1), np.frombuffer(n_rows).reshape(len(names), -1), names, k)
                yield pa.RecordBatch.from_pydict({"q": pa.array(ids[rows]), "node_id": pa.array(names[columns]), "similarity": pa.array(scores)})

    met = _blocks(queries, key, "q").crossJoin(_blocks(nodes, "node_id", "n"))  # of blocks, not of rows
    found = met.select("q_ids", "q_rows", "n_ids", "n_rows").mapInArrow(run, "q long, node_id long, similarity double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("similarity"), "node_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("q").alias(key), "node_id", "similarity", "rank")


def encode(texts: DataFrame, model, dim: int, column: str = "text") -> DataFrame:
    """The rows with column embedding from a pluggable model: a function from a list of stripped, lower-case texts to vectors. Empty texts get zeros."""

    @F.pandas_udf("array<float>")
    def run(batch):
        clean = [(x or "").strip().lower() for x in batch]
        full = [x for x in clean if x]
        vectors = iter(model(full) if full else [])
        return batch.map(lambda x: np.asarray(next(vectors), np.float32) if (x or "").strip() else np.zeros(dim, np.float32))

    return texts.withColumn("embedding", run(F.coalesce(F.col(column), F.lit(""))))


def checked(c: Column, dim: int) -> Column:
    """The vector; an error if it has another length. Null stays null."""
    return F.when(c.isNull() | (F.size(c) == dim), c).otherwise(F.raise_error(F.concat(F.lit(f"a vector of {dim} numbers was expected, not of "), F.size(c).cast("string"))))


def to_bytes(c: Column, dim: int) -> Column:
    """Vectors of dim numbers as 4 bytes each."""

    @F.pandas_udf("binary")
    def run(batch):
        return batch.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(checked(c.cast("array<float>"), dim))


def from_bytes(c: Column, dim: int) -> Column:
    """Vectors from 4 bytes a number; an error if there are more or less than dim."""

    @F.pandas_udf("array<float>")
    def run(batch):
        return batch.map(lambda x: None if x is None else np.frombuffer(x, "<f4"))

    size = F.length(c)
    return run(F.when(c.isNull() | (size == 4 * dim), c).otherwise(F.raise_error(F.concat(F.lit(f"a vector of {4 * dim} bytes was expected, not of "), size.cast("string")))))


def index_report(nodes: DataFrame, indexed: DataFrame, share: float) -> DataFrame:
    """Whether the index needs to be built anew: the share of its rows that are no active node with a vector, and what is missing."""
    wanted = nodes.where("is_active AND embedding IS NOT NULL").select("node_id")
    total = indexed.agg(F.count(F.lit(1)).alias("indexed"))
    live = indexed.join(wanted, "node_id", "left_semi").agg(F.count(F.lit(1)).alias("live"))
    missing = wanted.join(indexed, "node_id", "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    stale = F.when(F.col("indexed") > 0, (F.col("indexed") - F.col("live")) / F.greatest(F.col("indexed"), F.lit(1))).otherwise(0.0)
    return total.crossJoin(live).crossJoin(missing).withColumn("stale_share", F.round(stale, 4)).withColumn("rebuild", stale > share)
