"""Text sinks for line tables and landing of raw documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import ascii_slug


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ordered lines as text, one folder per export.

    Rows are range-partitioned by their sort key, so file order is line order and a large export
    is written by many tasks. Scripts of other exports in the folder stay.
    """
    key = ["export_id", "part", "block", "sub", "line_no", "line"]
    (
        lines.repartitionByRange(*key)
        .sortWithinPartitions(*key)
        .select("export_id", F.col("line").alias("value"))
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("export_id")
        .text(path)
    )


def landing_name(name):
    """File name under which a raw document is kept."""
    return F.concat(F.lit("user_"), ascii_slug(name, 80))


def land_documents(documents: DataFrame, path: str) -> None:
    """Append raw documents as they are, one folder per document name.

    The name is cut and cleaned, so it is a label only; a hash of the whole id keeps documents apart
    whose labels are the same.
    """
    (
        documents.select(landing_name(F.col("export_id")).alias("name"), F.sha2("export_id", 256).alias("id"), F.col("document").alias("value"))
        .write.mode("append")
        .partitionBy("name", "id")
        .option("lineSep", "\u001e\n")
        .text(path)
    )
