"""Stored tables that take merges: rows in buckets of their key, of which a batch rewrites those that it touches.

A version is a small file that names each bucket's folder, and appears last: readers see a batch whole or not at all, a
batch that broke off has changed nothing, and one whose number has been applied does nothing when it comes again.
"""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import lexicon as L
from quern.operators.index import _bucket, _Files

#: Arrival of rows that a table has already; those of a batch count from 0.
STORED = -1
#: How rows of one key become one: given rows with arrival, the rows that stay.
Rule = Callable[[DataFrame], DataFrame]


def keep_first(key: list[str]) -> Rule:
    """The first row of a key stays, the table's before a batch's (articles, chunks, sources)."""
    return lambda rows: L.first_wins(rows, key, "arrival")


def keep_last(key: list[str]) -> Rule:
    """The last row of a key replaces the others, all its columns, nulls included (dialect forms)."""
    return lambda rows: L.last_wins(rows, key, "arrival")


def headwords(rows: DataFrame) -> DataFrame:
    """The first of a headword stays, and takes the first part of speech that isn't empty."""
    return L.upsert_headwords(rows).drop("arrival")


def definitions(rows: DataFrame) -> DataFrame:
    """The last definition of a headword, language and source; one that replaces another isn't verified."""
    return L.upsert_definitions(rows).drop("arrival")


@dataclass(frozen=True)
class State:
    version: int = 0
    last_batch: int = -1
    buckets: int = 64
    key: list = field(default_factory=list)
    schema: str = ""
    folders: dict = field(default_factory=dict)


def create(spark: SparkSession, path: str, schema: T.StructType | str, key: list[str], buckets: int = 64) -> StoredTable:
    """An empty table at a path, in place of what was there. A bucket should hold what a task can, so buckets should grow with the table."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    _Files(spark, path).delete("")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
    return StoredTable(spark, path, State(buckets=buckets, key=list(key), schema=ddl))._publish({})


def open_table(spark: SparkSession, path: str) -> StoredTable:
    files = _Files(spark, path)
    versions = [int(n.split(".")[0]) for n in files.names("versions") if n.endswith(".json")]
    if not versions:
        raise FileNotFoundError(f"no table at {path}")
    return StoredTable(spark, path, State(**json.loads(files.read(f"versions/{max(versions)}.json"))))


@dataclass(frozen=True)
class StoredTable:
    """One version of a table."""

    spark: SparkSession
    path: str
    state: State

    def _read(self, buckets: list[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/rows/bucket={b}/version={v}" for b, v in self.state.folders.items() if buckets is None or int(b) in buckets]
        schema = T.StructType.fromDDL(self.state.schema)
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    @property
    def rows(self) -> DataFrame:
        return self._read()

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys, from their buckets only."""
        return self._read(self._buckets_of(keys)).join(keys.select(*self.state.key).distinct(), self.state.key, "left_semi")

    def _buckets_of(self, rows: DataFrame) -> list[int]:
        return [r["b"] for r in rows.select(_bucket(self.state.buckets, *self.state.key).alias("b")).distinct().collect()]  # a row per bucket

    def _publish(self, folders: dict, last_batch: int | None = None) -> StoredTable:
        state = dataclasses.replace(self.state, version=self.state.version + 1, folders=folders, last_batch=self.state.last_batch if last_batch is None else last_batch)
        _Files(self.spark, self.path).write_new(f"versions/{state.version}.json", json.dumps(dataclasses.asdict(state)))
        return StoredTable(self.spark, self.path, state)

    def _rewrite(self, rows: DataFrame, buckets: list[int], number: int) -> StoredTable:
        """Put rows in place of those of some buckets; buckets without a row go."""
        version = self.state.version + 1
        names = T.StructType.fromDDL(self.state.schema).names
        kept = rows.select(*names, _bucket(self.state.buckets, *self.state.key).alias("bucket"), F.lit(version).alias("version"))
        kept.repartition("bucket").sortWithinPartitions("bucket", *self.state.key).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket", "version").parquet(f"{self.path}/rows")
        system, path = _Files(self.spark, self.path).at("rows")
        new = system.globStatus(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/bucket=*/version={version}")) or []
        folders = {b: v for b, v in self.state.folders.items() if int(b) not in buckets}
        return self._publish(folders | {f.getPath().getParent().getName().split("=")[1]: version for f in new}, number)

    def merge(self, number: int, rows: DataFrame, rule: Rule, arrival: str = "arrival") -> StoredTable:
        """The table after a batch: where a key is in both, or in the batch more than once, the rule says what stays.

        number tells batches apart and grows. arrival is a column of rows that orders them, from 0 up. Columns of the table
        that rows lack are null. A null in a key is a value like others.
        """
        if number <= self.state.last_batch:
            return self
        names = T.StructType.fromDDL(self.state.schema)
        new = rows.select(*(rows[f.name].cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in names), rows[arrival].cast("long").alias("arrival"))
        touched = self._buckets_of(new)
        both = self._read(touched).withColumn("arrival", F.lit(STORED).cast("long")).unionByName(new)
        return self._rewrite(rule(both), touched, number)

    def delete(self, number: int, condition: Column) -> StoredTable:
        """The table without the rows for which a condition is true. Buckets that hold such rows are found by a scan that takes the condition, and rewritten."""
        if number <= self.state.last_batch:
            return self
        touched = self._buckets_of(self.rows.where(condition))
        return self._rewrite(self._read(touched).where(~F.coalesce(condition, F.lit(False))), touched, number)

    def delete_keys(self, number: int, keys: DataFrame) -> StoredTable:
        """The table without the rows of some keys; keys that it doesn't have touch their buckets too. A null is no key here."""
        if number <= self.state.last_batch:
            return self
        touched = self._buckets_of(keys)
        return self._rewrite(self._read(touched).join(keys.select(*self.state.key).distinct(), self.state.key, "left_anti"), touched, number)

    def vacuum(self) -> None:
        """Delete folders and versions that this version doesn't name. Readers of earlier versions fail afterwards."""
        files = _Files(self.spark, self.path)
        for bucket in files.names("rows"):
            if bucket.startswith("bucket="):
                for version in files.names(f"rows/{bucket}"):
                    if self.state.folders.get(bucket.split("=")[1]) != int(version.split("=")[1]):
                        files.delete(f"rows/{bucket}/{version}")
        for name in files.names("versions"):
            if name != f"{self.state.version}.json":
                files.delete(f"versions/{name}")
