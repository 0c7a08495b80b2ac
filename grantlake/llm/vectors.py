"""Blocks of vectors and their meeting with blocks of queries.

A block holds up to ``BLOCK_ROWS`` vectors of one dimension as one row. A stated set of queries is
held against all vectors block by block: candidate blocks have a slot each, query blocks are sent to
every slot, and a task works on one pair of blocks at a time. Per pair only the best of each query
leave the task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

BLOCK_ROWS = 4096
QUERY_ROWS = 256
SLOTS = 4096
BLOCK = "dim int, n int, ids array<long>, data binary"

Matrix = tuple[np.ndarray, np.ndarray]


def usable(batch: pa.RecordBatch, zero_too: bool) -> list[Matrix]:
    """Ids and vectors of a batch by dimension, without rows that are null, hold null or non-finite
    components or (unless wanted) are zero."""
    column = batch.column("embedding")
    ids = batch.column("vec_id")
    valid = np.asarray(column.is_valid()) & np.asarray(ids.is_valid())
    flat = column.flatten() if column.null_count == 0 else column.filter(pa.array(np.asarray(column.is_valid()))).flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.asarray(pa.compute.list_value_length(column).fill_null(0)).astype(np.int64)
    ends = np.cumsum(sizes)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    out = []
    for dim in np.unique(sizes[valid]).tolist():
        at = np.flatnonzero(valid & (sizes == dim))
        if not dim:
            continue
        rows = values[(ends[at] - dim)[:, None] + np.arange(dim)]
        good = np.isfinite(rows).all(axis=1)
        if not zero_too:
            good &= (rows != 0).any(axis=1)
        if good.any():
            out.append((numbers[at[good]], rows[good]))
    return out


def blocks(vectors: DataFrame, rows: int, zero_too: bool, change: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Blocks of ``vectors`` (vec_id, embedding) in the order of their partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Matrix]] = {}

        def out(dim: int) -> Iterator[pa.RecordBatch]:
            ids = np.concatenate([m[0] for m in held[dim]])
            data = np.concatenate([m[1] for m in held[dim]])
            whole = len(ids) - len(ids) % rows if len(ids) >= rows else len(ids)
            for k in range(0, whole, rows):
                part = ids[k : min(k + rows, whole)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([dim], pa.int32()), pa.array([len(part)], pa.int32()), pa.array([part], pa.list_(pa.int64())), pa.array([data[k : k + len(part)].astype("<f8").tobytes()])],
                    ["dim", "n", "ids", "data"],
                )
            held[dim] = [(ids[whole:], data[whole:])] if whole < len(ids) else []

        for batch in batches:
            for ids, data in usable(batch, zero_too):
                dim = data.shape[1]
                held.setdefault(dim, []).append((ids, change(data) if change else data))
                if sum(len(m[0]) for m in held[dim]) >= rows:
                    yield from out(dim)
        for dim in list(held):
            if held[dim]:
                yield from out(dim)

    return vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, BLOCK)


def opened(ids: list[int], data: bytes, dim: int) -> Matrix:
    return np.array(ids, dtype=np.int64), np.frombuffer(data, "<f8").reshape(-1, dim)


def pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every query block with every candidate block of its dimension. ``candidates`` has a number ``block``."""
    sent = queries.select("dim", F.col("n").alias("query_n"), F.col("ids").alias("query_ids"), F.col("data").alias("query_data"), *[c for c in queries.columns if c.startswith("query_")])
    slots = candidates.select("dim", F.pmod("block", F.lit(SLOTS)).alias("slot")).distinct()
    ready = sent.join(slots, "dim")
    return ready.join(candidates.withColumn("slot", F.pmod("block", F.lit(SLOTS))), ["dim", "slot"])


def stated(queries: DataFrame, zero_too: bool = True) -> DataFrame:
    """Query rows, one per vec_id: the smallest usable vector, if there are several rows."""
    bad = float("nan"), float("inf"), float("-inf")
    values = F.col("embedding").cast("array<double>")
    good = F.forall(values, lambda x: x.isNotNull() & ~x.isin(*bad)) & (F.size("embedding") > 0)
    if not zero_too:
        good &= F.exists(values, lambda x: x != 0)
    return queries.where(F.col("vec_id").isNotNull() & good).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` highest scores per query, ties to the smaller vec_id."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def shortest(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best per query in a list of (query, score, id)."""
    order = np.lexsort((ids, -score, query))
    sorted_ = query[order]
    fresh = np.append(True, sorted_[1:] != sorted_[:-1]) if len(order) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - start < k]
