"""Lineage cuts that survive the loss of an executor: tables in the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, one of our own, but only if
    driver and executors are one process: elsewhere executors could not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="symbolgrid-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class Store:
    """Named Parquet tables of one operator run, below the shared folder.

    ``put`` writes a DataFrame and returns a DataFrame that reads the written files, so nothing
    upstream is computed twice and a lost executor costs no recomputation. ``drop`` deletes a table
    that no later step reads.
    """

    def __init__(self, spark: SparkSession, owner: str):
        self.spark = spark
        self.names: set[str] = set()
        self.root = f"{shared_dir(spark).rstrip('/')}/{owner}-{uuid.uuid4().hex[:12]}"

    def put(self, name: str, df: DataFrame, files: int | None = None) -> DataFrame:
        """``files``: for tables of a row a group or so, which would else be a file for each task."""
        path = f"{self.root}/{name}"
        rows = df.repartition(files) if files else df
        rows.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(conf).delete(path, True)
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Drop all tables but these, which the result still reads."""
        self.drop(*(self.names - set(names)))
