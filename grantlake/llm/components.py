"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def components(edges: DataFrame, tables: Scratch, name: str) -> DataFrame:
    """(id, component) for every id of ``edges`` (a, b: long); the component is its smallest id.

    Each step hangs neighbours on the smallest id near them; edges become stars in a number of
    steps that grows with the logarithm of the longest path. Every step is a minimum per id and a
    join back, and is written, so nothing is gathered in one task or at the driver.
    """
    step = 0
    now = tables.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), f"{name}-{step}")
    state = summary(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
        larger = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        larger = larger.where("a <> b").distinct()
        low = larger.groupBy("a").agg(F.min("b").alias("least"))
        smaller = larger.join(low, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        smaller = smaller.unionByName(low.select("a", F.col("least").alias("b"))).where("a <> b").distinct()
        step += 1
        now = tables.keep(smaller, f"{name}-{step}")
        tables.drop(f"{name}-{step - 1}")
        after = summary(now)
        if after == state:
            break
        state = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def summary(edges: DataFrame):
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
