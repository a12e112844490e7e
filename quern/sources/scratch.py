"""Files in the readers' formats, written from tables into the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Scratch:
    """A folder below spark.checkpoint.dir that goes when the application ends; a local one only where all runs on this machine."""

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = "file://" + os.path.join(tempfile.gettempdir(), "quern-shared")
        self.spark, self.root = spark, f"{base.rstrip('/')}/files-{uuid.uuid4().hex}"
        system, path = self._at(self.root)
        system.mkdirs(path)
        system.deleteOnExit(path)

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), path

    def table(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows written here and read again."""
        rows.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.root}/{name}")

    def in_order(self, rows: DataFrame, *keys: str) -> DataFrame:
        """Rows by keys in one partition, for a file that is one by nature: sorted over many tasks and stored, so the last task reads on from one part to the next and holds none."""
        context = self.spark.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(self.root)
        return rows.orderBy(*keys).checkpoint().coalesce(1)

    def lines(self, rows: DataFrame, line: Column, folder: str, prefix: str = "part", suffix: str = ".txt", head: str | None = None) -> str:
        """Write a line per row and give the files names that readers look for. head: first line of a single file."""
        raw = f"{self.root}/raw-{uuid.uuid4().hex}"
        out = rows.select(line.alias("value"))
        if head is not None:
            first = self.spark.createDataFrame([(0, head)], "n int, value string")
            out = first.unionByName(out.select(F.lit(1).alias("n"), "value")).coalesce(1).sortWithinPartitions("n").select("value")
        out.write.text(raw)
        system, path = self._at(raw)
        to = self._at(f"{self.root}/{folder}")[1]
        system.mkdirs(to)
        parts = sorted(str(f.getPath()) for f in system.listStatus(path) if f.getPath().getName().startswith("part-"))
        for i, part in enumerate(parts):
            system.rename(self._at(part)[1], self._at(f"{self.root}/{folder}/{prefix}{i}{suffix}")[1])
        return f"{self.root}/{folder}"
