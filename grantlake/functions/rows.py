"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` and a column that is worked out once per row.

    A filter on a computed column is pushed below the projection that makes it, with the whole computation
    and all it reads written out again in it. It stays above a generator.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def unnest(
    df: DataFrame, array: Column | str, name: str, position: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """``keep`` (default: all) columns of ``df`` and one row per element of ``array``.

    Elements must not be null. A plain explode of a computed array makes the optimizer push a
    filter on the size of that array to the scan, which works the whole expression out twice; the
    outer form with a test on the element does not.
    """
    kept = [c for c in (keep or df.columns) if c not in (name, position)]
    if position is None:
        out = df.select(*kept, F.explode_outer(array).alias(name))
    else:
        out = df.select(*kept, F.posexplode_outer(array).alias(position, name))
        out = out.withColumn(position, F.col(position).cast("bigint"))
    return out.filter(F.col(name).isNotNull())
