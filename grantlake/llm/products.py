"""Exact search for the largest inner products, over buckets of vectors of like length.

Vectors lie in buckets in the order of their length. Every query first meets the longest bucket,
which gives it a score that its k-th best reaches at least. For any other bucket that score, divided
by the lengths of the query and of the bucket's longest vector, is a local threshold for the cosine:

* above 1, no vector of the bucket can qualify;
* high, a vector must agree with the query in its strongest coordinates: for a cosine of t a
  coordinate of the unit vector lies within sqrt((1 - t^2)(1 - q^2)) of t q (coordinate pruning);
* else only vectors that are long enough are looked at (length pruning).

What is left is verified by products. Scores are exact integers.

Components are integers held in doubles. Products are taken in doubles where lengths prove them
exact, else in Python integers; a score outside the range of a long becomes the largest or its
negative.

Results for odd input: vectors that are null or hold null or non-finite components take no part, as
query or candidate, nor do rows with a null ``vec_id`` or no components; zero vectors do. A query
meets vectors of its own dimension, all rows but those of its own ``vec_id``; rows that repeat a
``vec_id`` are candidates each, and as queries count once; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import vectors
from .scratch import Scratch

#: From this local cosine threshold on, coordinates prune; below it, lengths.
COORDINATE_THRESHOLD = 0.6
FOCUS = 6
RESULT = "query_id long, vec_id long, score long"
EXACT = 2.0**52
LONG_MAX = 2**63 - 1


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact products of integer vectors, as doubles if they fit and else as integers."""
    bound = lengths(q).max(initial=0) * lengths(p).max(initial=0)
    if bound < EXACT:
        return q @ p.T
    whole = np.array([[int(v) for v in row] for row in q], dtype=object).reshape(q.shape)
    other = np.array([[int(v) for v in row] for row in p], dtype=object).reshape(p.shape)
    exact = whole @ other.T
    return np.array([[min(max(v, -LONG_MAX), LONG_MAX) for v in row] for row in exact], dtype=np.int64).reshape(exact.shape)


def search(q_ids: np.ndarray, q: np.ndarray, p_ids: np.ndarray, p: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, id and score of the k best per query in one bucket, among scores of at least ``least``."""
    q_len, p_len = lengths(q), lengths(p)
    order = np.argsort(-p_len, kind="stable")
    p_ids, p, p_len = p_ids[order], p[order], p_len[order]
    longest = p_len[0]
    reach = q_len * longest
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(reach > 0, least / reach * (1 - 1e-9), np.where(least > 0, np.inf, -np.inf))
    local = np.where(np.isnan(local), -np.inf, local)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(rows: np.ndarray, columns: np.ndarray, score: np.ndarray) -> None:
        good = (score >= least[rows]) & (p_ids[columns] != q_ids[rows])
        rows, columns, score = rows[good], columns[good], score[good].astype(np.int64)
        at = vectors.shortest(rows, score, p_ids[columns], k)
        found.append((rows[at], p_ids[columns[at]], score[at]))

    fine = reach.max(initial=0) < EXACT
    by_coordinate = np.flatnonzero((local >= COORDINATE_THRESHOLD) & (local <= 1)) if fine else np.zeros(0, np.int64)
    if len(by_coordinate):
        unit = p / np.maximum(p_len, 1e-300)[:, None]
        for row in by_coordinate.tolist():
            t, direction = local[row], q[row] / q_len[row]
            alive = np.arange(int(np.searchsorted(-p_len, -least[row] / q_len[row] * (1 - 1e-9), side="right")))
            for f in np.argsort(-np.abs(direction))[:FOCUS].tolist():
                spread = np.sqrt(max(0.0, (1 - t * t) * (1 - direction[f] ** 2))) + 1e-9
                # above t the cosine moves the bound inwards only on the side of the query
                low = t * direction[f] - spread if direction[f] >= 0 else -np.inf
                high = t * direction[f] + spread if direction[f] < 0 else np.inf
                x = unit[alive, f]
                alive = alive[(x >= low) & (x <= high)]
            if len(alive):
                keep(np.full(len(alive), row), alive, products(q[row : row + 1], p[alive])[0])
    by_length = np.flatnonzero(local < COORDINATE_THRESHOLD) if fine else np.flatnonzero(local <= 1)
    if len(by_length):
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(q_len[by_length] > 0, least[by_length] / q_len[by_length], -np.inf)
        prefix = int(np.searchsorted(-p_len, -need.min() * (1 - 1e-9) if need.min() > 0 else np.inf, side="right"))
        score = products(q[by_length], p[:prefix])
        if score.shape[1] > k:
            # rows of the query's own vec_id are no candidates, however many there are
            others = np.where(p_ids[None, :prefix] == q_ids[by_length][:, None], score.dtype.type(-LONG_MAX), score)
            floor = -np.partition(-others, k - 1, axis=1)[:, k - 1]
        else:
            floor = np.full(len(score), -LONG_MAX, dtype=score.dtype)
        rows, columns = np.nonzero(score >= np.maximum(floor, least[by_length])[:, None])
        keep(by_length[rows], columns, score[rows, columns])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, ids, score = (np.concatenate([f[j] for f in found]) for j in range(3))
    return q_ids[rows], ids, score


def largest_products(vecs: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: for every row of ``queries`` the k best of ``vecs`` (both vec_id,
    embedding), of components floor(scale * x)."""
    tables = Scratch(vecs.sparkSession, "products")

    def whole(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(np.floor(scale * x), -np.finfo(np.float64).max, np.finfo(np.float64).max)

    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    usable = vecs.where("vec_id is not null and embedding is not null").select("vec_id", "embedding", length.alias("length"))
    ordered = usable.repartitionByRange(F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id")
    made = tables.keep(vectors.blocks(ordered.select("vec_id", "embedding"), vectors.BLOCK_ROWS, True, whole).withColumn("block", F.monotonically_increasing_id()), "buckets")
    asked = tables.keep(vectors.blocks(vectors.stated(queries), vectors.QUERY_ROWS, True, whole), "queries")
    first = made.groupBy("dim").agg(F.min("block").alias("block"))
    head = made.join(first, ["dim", "block"], "left_semi")
    rest = made.join(first, ["dim", "block"], "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, q = vectors.opened(row["query_ids"], row["query_data"], row["dim"])
                p_ids, p = vectors.opened(row["ids"], row["data"], row["dim"])
                least = np.full(len(q_ids), -np.inf)
                if row.get("query_least"):
                    known = dict(zip(row["query_known"], row["query_least"]))
                    least = np.array([known.get(i, -np.inf) for i in q_ids.tolist()], dtype=np.float64)
                    least = np.where(np.abs(least) < EXACT, least, -np.inf)
                found = search(q_ids, q, p_ids, p, least, k)
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.int64())], ["query_id", "vec_id", "score"])

    start = tables.keep(vectors.pairs(asked, head).mapInArrow(run, RESULT), "first")
    reached = start.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k)
    numbered = asked.withColumn("query_block", F.xxhash64("ids"))
    member = numbered.select("query_block", F.explode("ids").alias("query_id"))
    least = member.join(reached, "query_id").groupBy("query_block").agg(
        F.collect_list("query_id").alias("query_known"), F.collect_list(F.col("least").cast("double")).alias("query_least")
    )
    bounded = numbered.join(least, "query_block", "left")
    return vectors.best(start.unionByName(vectors.pairs(bounded, rest).mapInArrow(run, RESULT)), k)
