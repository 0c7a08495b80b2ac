"""Written stages: cut the lineage of a frame that is used several times."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DIR_KEY = "spark.checkpoint.dir"


def stage_dir(spark: SparkSession) -> str:
    """Shared folder for stages, as the session names it.

    Only a session in one process may go without. It then gets a folder of its own, which goes with
    the process.
    """
    named = spark.conf.get(DIR_KEY, None) or spark.sparkContext.getConf().get(DIR_KEY, None)
    if named:
        return named
    if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError(f"set {DIR_KEY} to a folder that all executors reach")
    made = tempfile.mkdtemp(prefix="run-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set(DIR_KEY, made)
    return made


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the stage folder and return the table.

    Unlike a cached frame the table survives lost executors, and readers prune its columns and
    push filters into it.
    """
    path = f"{stage_dir(df.sparkSession)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
