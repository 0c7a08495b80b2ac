"""Tables that an operator writes for itself in the shared folder, and their removal once they are used up."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

from grantlake.operators.stage import stage_dir

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one run of an operator.

    ``keep`` writes a frame as Parquet under the folder in ``spark.checkpoint.dir`` and reads it
    back, so that lost executors cost nothing but their current tasks. ``drop`` removes tables
    that no later step reads.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = f"{stage_dir(spark)}/{what}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.read(df, name)

    @contextlib.contextmanager
    def lean(self) -> Iterator[None]:
        """Shuffle files of a step are removed at its end, not when the driver next collects its garbage. For steps
        that read tables."""
        before = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            yield
        finally:
            if before is None:
                self.spark.conf.unset(CLEANUP)
            else:
                self.spark.conf.set(CLEANUP, before)

    def read(self, like: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)


def parquet(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
