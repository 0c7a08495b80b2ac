"""Joins on keys that may hold a large part of all rows.

A key whose share of the rows is above 1 / ``PARTS`` is heavy; by that rule there are fewer than ``PARTS``
heavy keys whatever the data, so their list is sent to all tasks. A heavy key gets as many runs as
its share asks for; its rows are dealt to the runs by a hash, and the other side's rows of that key
are copied once per run. All other keys have one run. So no key brings more than 1 / ``PARTS`` of the rows to
one task, and what is copied grows with the number of runs, under 2 * ``PARTS`` in all, not with the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .stage import stage

PARTS = 512


def heavy_keys(rows: DataFrame, keys: list[str], parts: int = PARTS) -> DataFrame:
    """Keys with more than 1 / ``parts`` of all rows, and the number of ``runs`` each gets."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    total = rows.agg(F.count("*")).scalar()
    return counts.where(F.col("n") * parts > total).select(*keys, F.ceil(F.col("n") * parts / total).cast("int").alias("runs"))


def _runs(rows: DataFrame, heavy: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the number of runs of their key. ``heavy`` has fewer than ``PARTS`` rows."""
    renamed = heavy.toDF(*[f"heavy_{k}" for k in keys], "runs")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"heavy_{k}")) for k in keys])
    joined = rows.join(F.broadcast(renamed), same, "left").drop(*[f"heavy_{k}" for k in keys])
    return joined.withColumn("runs", F.coalesce("runs", F.lit(1)))


def skew_join(
    rows: DataFrame, others: DataFrame, keys: list[str], how: str = "inner", parts: int = PARTS, grows: bool = False
) -> DataFrame:
    """``rows`` joined to ``others`` on ``keys``; heavy keys of ``rows`` are spread over runs.

    ``rows`` is read twice and should be a table; ``how`` is inner or left. Rows that are equal in
    every column share a run. With ``grows``, for rows that meet many others, both sides are dealt to all
    shuffle partitions and stay there: Spark merges partitions by what they read, not by what the join makes.
    """
    heavy = stage(heavy_keys(rows, keys, parts))
    spread = [f.name for f in rows.schema if not isinstance(f.dataType, (MapType, VariantType))]
    dealt = _runs(rows, heavy, keys).withColumn("run", F.pmod(F.xxhash64(*spread), F.col("runs")).cast("int")).drop("runs")
    copies = _runs(others, heavy, keys).withColumn("run", F.explode(F.sequence(F.lit(0), F.col("runs") - 1))).drop("runs")
    if grows:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt, copies = (side.repartition(tasks, *keys, "run") for side in (dealt, copies))
    return dealt.join(copies, [*keys, "run"], how).drop("run")
