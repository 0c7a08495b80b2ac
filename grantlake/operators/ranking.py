"""Row numbers inside groups that may be very large."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BITS = 16


def spread_row_number(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    """Exact 1-based row number by the long column ``order`` inside ``keys``.

    The group is cut into ranges of ``order`` values. Rows are numbered inside a range and the
    numbers of the ranges before it are added, so no task ever sorts a whole group: the second
    window runs over one count per range only. ``order`` must not repeat inside a group.
    """
    chunk = F.shiftright(F.col(order), CHUNK_BITS)
    chunked = df.withColumn("__chunk", chunk)
    counts = chunked.groupBy(*keys, "__chunk").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        *keys, "__chunk", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start")
    )
    inside = Window.partitionBy(*keys, "__chunk").orderBy(order)
    numbered = chunked.withColumn("__rn", F.row_number().over(inside))
    return (
        numbered.join(starts, [*keys, "__chunk"])
        .withColumn(name, (F.col("__start") + F.col("__rn")).cast("bigint"))
        .drop("__chunk", "__start", "__rn")
    )
