"""Exports that arrive as files, turned into items as they come.

Reading an export is row by row (see ``operators.items``), so the batch code runs on a stream
unchanged and keeps no state. Tag policies need the tags of their own document only, but by joins,
so they are resolved per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import file_stem
from ..operators.fact import items_of_documents


def stream_documents(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder as ``(export_id, document)``."""
    text = spark.readStream.format("text").option("wholetext", True).schema("value string").load(path)
    return text.select(
        file_stem(F.col("_metadata.file_name")).alias("export_id"), F.col("value").alias("document")
    )


def append_items(documents: DataFrame, target: str, checkpoint: str):
    """Start a query that appends the items of each micro-batch to Parquet, by export."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch that is run again writes its own folder anew.
        items_of_documents(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        documents.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
