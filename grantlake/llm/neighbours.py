"""Approximate nearest neighbours by cosine: low-dimensional stable projections in a kd-tree.

Vectors are scaled to length one, where the nearest by distance is the nearest by cosine, and are
projected on ``M`` random directions with normal entries (a 2-stable projection: the squared
projected distance over the squared true distance follows a chi-square law with ``M`` degrees). Each
block of vectors has a kd-tree over its projections. A query takes the leaves of the tree in the
order of their projected distance, verifies their vectors by true cosines, and stops when the
chi-square test holds: a vector nearer than its k-th best so far would have been projected beyond
the next leaf with a probability below 1 - ``confidence`` only. All vectors are indexed, the
projection is not fitted to data, and a query meets every block.

Results for odd input: vectors that are null, zero or hold null or non-finite components take no
part, nor do rows with a null ``vec_id``; a query meets vectors of its own dimension, all rows but
those of its own ``vec_id``; if rows share a ``vec_id``, each is a candidate, and the smallest vector
is the query; equal cosines go to the smaller ``vec_id``; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import vectors
from .scratch import Scratch

M = 8
LEAF = 64
AT_ONCE = 4
RESULT = "query_id long, vec_id long, score double"


def chi_square(x: float, degrees: int = M) -> float:
    """Distribution function for an even number of degrees."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**i / math.factorial(i) for i in range(degrees // 2))


def chi_square_limit(p: float, degrees: int = M) -> float:
    low, high = 0.0, 1.0
    while chi_square(high, degrees) < p:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, degrees) < p else (low, middle)
    return high


def directions(dim: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, M))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows at length one; the largest component first becomes one, so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def leaves(points: np.ndarray) -> list[np.ndarray]:
    """kd-tree by median splits on the widest axis: the positions in each leaf."""
    done, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            done.append(at)
            continue
        own = points[at]
        axis = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
        order = np.argpartition(own[:, axis], len(at) // 2)
        todo += [at[order[: len(at) // 2]], at[order[len(at) // 2 :]]]
    return done


class Tree:
    """Leaves of a block in one order of its rows, with the bounds of each."""

    def __init__(self, ids: np.ndarray, data: np.ndarray):
        unit = scaled(data)
        points = unit @ directions(data.shape[1])
        parts = leaves(points)
        order = np.concatenate(parts)
        self.ids, self.data, self.unit = ids[order], data[order], unit[order]
        self.ends = np.cumsum([0, *map(len, parts)])
        self.low = np.array([points[p].min(axis=0) for p in parts])
        self.high = np.array([points[p].max(axis=0) for p in parts])

    def nearest(self, q_ids: np.ndarray, q: np.ndarray, k: int, limit: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and cosine of the k nearest found in this block."""
        unit = scaled(q)
        points = unit @ directions(q.shape[1])
        away = np.zeros((len(q), len(self.low)))
        for axis in range(M):
            x = points[:, axis : axis + 1]
            away += np.maximum(0, np.maximum(self.low[None, :, axis] - x, x - self.high[None, :, axis])) ** 2
        order = np.argsort(away, axis=1)
        cosine = np.full((len(q), len(self.ids)), -2.0)
        top = np.full((len(q), k), -2.0)
        alive = np.arange(len(q))
        for start in range(0, len(self.low), AT_ONCE):
            # squared true distance of the k-th best, from its cosine
            kth = 2 - 2 * np.minimum(top[alive, 0], 1.0)
            alive = alive[(away[alive, order[alive, start]] < limit * kth) | (top[alive, 0] < -1.5)]
            if not len(alive):
                break
            chosen = order[alive, start : start + AT_ONCE]
            rows, leaf = np.repeat(alive, chosen.shape[1]), chosen.reshape(-1)
            by = np.argsort(leaf, kind="stable")
            rows, leaf = rows[by], leaf[by]
            for at in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1):
                a, b, own = self.ends[leaf[at[0]]], self.ends[leaf[at[0]] + 1], rows[at]
                score = unit[own] @ self.unit[a:b].T
                score[q_ids[own][:, None] == self.ids[None, a:b]] = -2.0
                cosine[own, a:b] = score
                both = np.concatenate((top[own], score), axis=1)
                top[own] = np.sort(np.partition(both, both.shape[1] - k, axis=1)[:, -k:], axis=1)
        rows, columns = np.nonzero((cosine >= top[:, :1] - 1e-9) & (cosine > -1.5))
        score = exact_cosine(q, self.data, rows, columns)
        best = vectors.shortest(rows, score, self.ids[columns], k)
        return q_ids[rows[best]], self.ids[columns[best]], score[best]


def exact_cosine(q: np.ndarray, p: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Cosines on the original vectors, each worked out alike, so that equal vectors tie."""
    out = np.zeros(len(rows))
    for k in range(0, len(rows), 65536):
        a, b = q[rows[k : k + 65536]], p[columns[k : k + 65536]]
        with np.errstate(over="ignore", invalid="ignore"):
            value = np.einsum("ij,ij->i", a, b) / (np.sqrt(np.einsum("ij,ij->i", a, a)) * np.sqrt(np.einsum("ij,ij->i", b, b)))
        odd = ~np.isfinite(value)
        if odd.any():
            value[odd] = np.einsum("ij,ij->i", scaled(a[odd]), scaled(b[odd]))
        out[k : k + 65536] = value
    return out


def nearest(vecs: DataFrame, queries: DataFrame, k: int = 5, confidence: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of ``queries`` the k nearest found in ``vecs``."""
    tables = Scratch(vecs.sparkSession, "neighbours")
    made = tables.keep(vectors.blocks(vecs, vectors.BLOCK_ROWS, False).withColumn("block", F.monotonically_increasing_id()), "blocks")
    asked = tables.keep(vectors.blocks(vectors.stated(queries, zero_too=False), vectors.QUERY_ROWS, False), "queries")
    limit = chi_square_limit(confidence)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, Tree] | None = None
        for batch in batches:
            for row in batch.to_pylist():
                if held is None or held[0] != row["block"]:
                    held = (row["block"], Tree(*vectors.opened(row["ids"], row["data"], row["dim"])))
                found = held[1].nearest(*vectors.opened(row["query_ids"], row["query_data"], row["dim"]), k, limit)
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())], ["query_id", "vec_id", "score"])

    met = vectors.pairs(asked, made).sortWithinPartitions("block")
    return vectors.best(met.mapInArrow(run, RESULT), k)
