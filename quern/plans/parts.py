"""Long jobs in parts: a part appears whole or not at all, and a job that starts again leaves out what has appeared."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.index import _Files


def _published(files: _Files) -> list[int]:
    return sorted(int(n.removeprefix("part-")) for n in files.names("") if n.startswith("part-"))


def _read(spark: SparkSession, path: str, kind: str, schema: T.StructType) -> DataFrame:
    paths = [f"{path}/part-{n:08d}/{kind}" for n in _published(_Files(spark, path))]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def published(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of the parts that have appeared at a path."""
    return _read(spark, path, "rows", schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema))


def run_in_parts(rows: DataFrame, key: list[str], work: Callable[[DataFrame], DataFrame], path: str, parts: int = 16, progress: Callable[[int, int], None] | None = None) -> DataFrame:
    """What work makes of rows, published in parts at a path; all that has been published, by this run or earlier ones.

    Rows whose key has been published are left out by a join, so a run that broke off goes on where it stopped, a run
    after one that ended does new keys only, and parts may differ from run to run. The others are stored once, dealt by
    hash of their key, so rows that share a key are in one part. A part is written aside, its keys and its rows, and
    renamed: keys of which work makes no row count as done. progress gets the number of each published part and its rows.
    A null in a key is a value like others. One job at a time writes to a path; what broken ones left aside is deleted.
    """
    spark, files = rows.sparkSession, _Files(rows.sparkSession, path)
    for name in files.names(""):
        if name.startswith("aside-"):
            files.delete(name)
    keys = T.StructType([rows.schema[c] for c in key])
    names = {c: f"done {c}" for c in key}
    done = _read(spark, path, "keys", keys).distinct().withColumnsRenamed(names)
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"`{d}`")) for c, d in names.items()]
    left = rows.join(done, same, "left_anti")
    aside = f"aside-{uuid.uuid4().hex}"
    part = "part of the run"
    dealt = left.withColumn(part, F.pmod(F.xxhash64(*key), F.lit(parts)))
    dealt.write.partitionBy(part).parquet(f"{path}/{aside}/todo")
    todo = sorted(n for n in files.names(f"{aside}/todo") if "=" in n)
    schema = work(spark.createDataFrame([], rows.schema)).schema if not todo else None
    try:
        for name in todo:
            one = spark.read.schema(rows.schema).parquet(f"{path}/{aside}/todo/{name}")
            seen, made = Observation(), work(one)
            schema = made.schema
            made.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/{aside}/made/rows")
            one.select(*key).distinct().write.parquet(f"{path}/{aside}/made/keys")
            number = max(_published(files), default=-1) + 1
            (system, here), (_, there) = files.at(f"{aside}/made"), files.at(f"part-{number:08d}")
            if system.exists(there) or not system.rename(here, there):
                raise RuntimeError(f"part {number} was written by another job")
            if progress:
                progress(number, seen.get["n"])
    finally:
        files.delete(aside)
    return published(spark, path, schema)
