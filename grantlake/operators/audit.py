"""Queries over access logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_events(log: DataFrame, day: str, n: int = 100) -> DataFrame:
    """Newest ``n`` events of one day; ties are broken by the event number."""
    start = F.lit(day).cast("date").cast("timestamp")
    of_day = log.filter((F.col("ts") >= start) & (F.col("ts") < start + F.expr("INTERVAL 1 DAY")))
    return of_day.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(n)


def compare_logs(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Access patterns of two logs: what is on one side only, and what only the new one denies.

    Each log has ``keys`` and a boolean ``denied``. One aggregate over the tagged union does the
    work of a full outer join and combines before the shuffle.
    """
    both = old.select(*keys, "denied", F.lit(True).alias("is_old")).unionByName(
        new.select(*keys, "denied", F.lit(False).alias("is_old"))
    )
    grouped = both.groupBy(*keys).agg(
        F.count_if("is_old").alias("old_events"),
        F.count_if(~F.col("is_old")).alias("new_events"),
        F.count_if(F.col("is_old") & F.col("denied")).alias("old_denied"),
        F.count_if(~F.col("is_old") & F.col("denied")).alias("new_denied"),
    )
    return grouped.withColumn(
        "finding",
        F.when(F.col("new_events") == 0, "old_only")
        .when(F.col("old_events") == 0, F.when(F.col("new_denied") > 0, "new_only_denied").otherwise("new_only"))
        .when((F.col("new_denied") > 0) & (F.col("old_denied") == 0), "newly_denied")
        .otherwise("same"),
    )
